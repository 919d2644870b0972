import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from marram.llm import common, exact_dedup, linededup
from marram.llm.components import components


def texts():
    rng = random.Random(3)
    out = ["", None, " \n\t", "é 日", "é日 ", "x" * 200_000, "x" * 200_000]
    return out + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) + " " * rng.randint(0, 3) for _ in range(400)] + ["same text"] * 700


def test_groups_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    want = set()
    for bare, members in groups.items():
        keep = min(members)[1]
        want |= {(i, keep, len(members), i == keep, hashlib.sha256(bare.encode()).hexdigest()) for _, i in members}
    assert {tuple(r) for r in exact_dedup.exact_groups(docs).collect()} == want
    more = docs.withColumn("_drop", F.lit(1)).withColumn("Keep_ID", F.lit(2))
    kept = exact_dedup.exact_dedup(more)
    assert kept.columns == more.columns and {r["doc_id"] for r in kept.collect()} == {x[0] for x in want if x[3]}


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_BITS", 4)
    monkeypatch.setattr(exact_dedup, "BLOCK", 16)
    docs = spark.createDataFrame([(i, f"t{i % 90}") for i in range(100)], "doc_id long, text string")
    assert exact_dedup.exact_groups(docs, most_bits=4).where("kept").count() == 90
    assert exact_dedup.exact_dedup(docs, most_bits=4).count() == 90


@pytest.mark.parametrize("kind", ["long", "string"])
def test_repeated_and_null_ids_lose_no_text(spark, kind):
    """One row of each text stays, also where ids repeat, are null, or rows are the same in all columns."""
    rng = random.Random(8)
    ids = [None, None, *range(6)]
    rows = [(0, "dup dup", "a"), (1, "dupdup", "b"), (1, "other", "c"), (2, "other", "d"), (None, "lone", "e"), (None, "lo ne", "f"), (7, "same", "g"), (7, "same", "g")]
    rows += [(rng.choice(ids), rng.choice(["x", "x ", "y", "yy", "z", None, ""]), rng.choice("hij")) for _ in range(60)]
    rows = [(i if i is None or kind == "long" else f"id{i}", t, c) for i, t, c in rows]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, more string").repartition(4)
    best = {}
    for i, t, _ in rows:
        bare = "".join((t or "").split())
        best[bare] = min(best.get(bare, (1, True, None)), (-len(t or ""), i is None, i if i is not None else ("" if kind == "string" else 0)))
    kept = [r for r in exact_dedup.exact_dedup(docs).collect()]
    assert sorted("".join((r["text"] or "").split()) for r in kept) == sorted(best)
    for r in kept:
        want = best["".join((r["text"] or "").split())]
        assert (-len(r["text"] or ""), r["doc_id"] is None) == want[:2] and (r["doc_id"] is None or r["doc_id"] == want[2])
    groups = exact_dedup.exact_groups(docs).collect()
    assert len(groups) == len(rows) and sorted(r["text_sha256"] for r in groups if r["kept"]) == sorted(hashlib.sha256(b.encode()).hexdigest() for b in best)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0
    assert linededup.without_wide_lines(none).count() == 0


@pytest.mark.parametrize("most", [10**6, 0])
def test_wide_lines_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(linededup, "MOST_BROADCAST", most)
    rng = random.Random(6)
    rows = [(i, "\n".join(rng.choice(["", " ", *[f" line {k} " for k in range(60)], *[f"own {i} {k}" for k in range(9)]]) for _ in range(rng.randint(0, 6))), f"s{min(int(rng.expovariate(0.15)), 25)}") for i in range(300)]
    rows += [(1000, None, "s1"), (1001, "line 1\nline 1", None), (1002, "", "s2"), (1003, "a" + " " * 50_000 + "b", "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("removed", F.lit("mine"))
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip() and s:
                sites.setdefault(x.strip(), set()).add(s)
    wide = {x for x, s in sites.items() if len(s) >= 10}
    assert wide
    got = {r["doc_id"]: (r["text"], r["removed_"]) for r in linededup.without_wide_lines(docs).collect()}
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip() not in wide]
        assert got[i] == (t if len(kept) == len(lines) else "\n".join(kept), len(lines) - len(kept))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200 + i) for i in range(300)] + [(500, 500), (90, 91)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[200 + i] == 100 for i in range(300)) and got[91] == 90 and 500 not in got


def test_skew_join_and_running(spark):
    rows = [(i, 7 if i % 3 else i) for i in range(2000)] + [(9999, None)]
    docs = common.written(spark.createDataFrame(rows, "i long, k long"), "t")
    facts = spark.createDataFrame([(k, k * 2) for k in range(0, 1500, 3)] + [(7, 14)], "k long, f long")
    got = {r["i"]: r["f"] for r in common.skew_join(docs, facts, "k").collect()}
    known = {k: k * 2 for k in range(0, 1500, 3)} | {7: 14}
    assert got == {i: known.get(k) for i, k in rows}
    before = common.running(docs, ["k"], F.pmod(F.hash("i"), F.lit(5)), [F.col("i")]).collect()
    for key in {k for _, k in rows}:
        own = sorted(r["_before"] for r in before if r["k"] == key)
        assert own == list(range(len(own)))


def test_clear_deletes_what_was_written(spark):
    from pathlib import Path

    common.written(spark.range(3), "gone")
    path = Path(common._tables[-1].removeprefix("file://"))
    assert path.exists()
    common.clear(spark)
    assert not path.exists() and not common._tables
