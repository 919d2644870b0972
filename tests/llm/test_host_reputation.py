import random
from math import comb

import pytest
from pyspark.sql import functions as F

from marram.llm import host_reputation as hr


@pytest.mark.parametrize(
    ("url", "host", "path", "rule"),
    [
        ("HTTP://WWW.Example.ORG/en/1?x#y", "www.example.org", "/en/1", "example.org/en/1"),
        ("http://example.org/es/", "example.org", "/es/", "example.org/es/"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/"),
        ("http://a.com/fr/x", "a.com", "/fr/x", "com/fr/"),
        ("http://a.com?/fr/", "a.com", "", None),
        ("http://a.org", "a.org", "", None),
        ("x://y://z/", "y:", "//z/", None),
        ("nothing", "", "", None),
        (None, "", "", None),
        ("", "", "", None),
        ("http:///x\ny", "", "/x\ny", None),
    ],
)
def test_parts_and_rules(spark, url, host, path, rule):
    h, p = hr.host_and_path(F.col("u"))
    row = spark.createDataFrame([(url,)], "u string").select(h.alias("h"), p.alias("p")).withColumn("r", hr.match_rule(F.col("h"), F.col("p"))[0]).first()
    assert tuple(row) == (host, path, rule)


def test_levels_shrink(spark):
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.example.net/{i}") for i in range(200)] + [(900, "http://new.example.net/"), (901, "http://bad.other.co.uk/"), (902, None)]
    labels = [(i, 0 if i % 2 else 1) for i in range(200)] + [(None, 1), (5, None), (77777, 0)]
    got = {r["page_id"]: r["verdict"] for r in hr.url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")).collect()}
    assert got[1] == "block" and got[0] == "allow" and len(got) == len(pages)
    rep = {r["host"]: r for r in hr.host_reputation(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")).collect()}
    # hosts of one domain differ as much as they can, so the strength of their prior is the least; levels above hold one group each
    assert rep["bad.example.net"]["strength"] == hr.LEAST_STRENGTH
    assert rep["bad.example.net"]["mean"] == pytest.approx(0.5 / 101, rel=1e-3) and rep["new.example.net"]["mean"] == pytest.approx(0.5, abs=1e-3)
    assert rep["bad.example.net"]["bad"] > 0.999 and rep["good.example.net"]["bad"] < 0.001
    assert got[900] == got[901] == "allow"


def test_strength_is_that_of_the_spread(spark):
    """Outcomes drawn from a beta-binomial give its strength back, without spread the largest; more outcomes shrink less."""
    rng = random.Random(3)
    rows = []
    for _ in range(4000):
        p, n = rng.betavariate(0.8 * 12, 0.2 * 12), rng.randint(1, 30)
        rows.append((float(sum(rng.random() < p for _ in range(n))), float(n), 0.8))
    fit = hr.fitted_strength(spark.createDataFrame(rows, "g double, n double, m double"), "g", "n", "m")
    assert 10 < fit < 14
    same = spark.createDataFrame([(8.0, 10.0, 0.8)] * 50, "g double, n double, m double")
    assert hr.fitted_strength(same, "g", "n", "m") == hr.MOST_STRENGTH
    assert hr.fitted_strength(same.limit(0), "g", "n", "m") == hr.USUAL_STRENGTH


def test_chance_below_equals_the_beta_distribution(spark):
    """Against sums of the binomial: for whole a and b, P(beta < x) = P(at least a of a + b - 1 are under x)."""
    cases = [(a, b, x) for a, b in ((1, 1), (2, 5), (30, 4), (400, 100), (1, 60)) for x in (0.05, 0.4, 0.75, 0.9)]
    rows = spark.createDataFrame([(float(a), float(b), x) for a, b, x in cases], "a double, b double, x double")
    got = [r[0] for r in rows.select(hr.chance_below(F.col("a"), F.col("b"), F.col("x"))).collect()]
    for (a, b, x), p in zip(cases, got, strict=True):
        n = a + b - 1
        assert p == pytest.approx(sum(comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1)), abs=3e-4)


def test_labelled_bad_hosts_go(spark):
    """Among many hosts of the usual quality, those whose pages are labelled bad are blocked; one bad label isn't enough."""
    rng = random.Random(4)
    pages, labels = [], []
    for h in range(60):
        for k in range(40):
            pages.append((len(pages), f"http://www.site{h}.net/{k}"))
            labels.append((len(labels), int(rng.random() < (0.1 if h < 5 else 0.9))))
    pages.append((len(pages), "http://once.net/"))
    labels.append((len(labels), 0))
    docs, out = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, good int")
    got = {r["host"] for r in hr.url_verdicts(docs.union(docs.limit(3)), out).where("verdict = 'block'").collect()}
    assert got == {f"www.site{h}.net" for h in range(5)}


def test_long_urls_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.net/" + "x" * 300_000), (1, "http://a.net/"), (1, "http://a.net/"), (None, "http://" + "a." * 5000 + "net")], "page_id long, url string")
    out = spark.createDataFrame([(1, 1), (1, 0)], "page_id long, good int")
    assert hr.url_verdicts(pages, out).count() == 4


def test_no_labels_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", 0)], "page_id long, url string, _blocked int")
    none = spark.createDataFrame([], "page_id long, good int")
    assert hr.allowed_pages(pages, none).count() == 1
    assert hr.url_verdicts(pages.limit(0), none).count() == 0
