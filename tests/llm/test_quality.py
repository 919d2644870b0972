import math
import random
import re
from collections import Counter

from marram.llm import quality

SPACE = " \t\n\x0b\x0c\r"


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def base(t):
    w, t = words_of(t), t or ""
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(grams)
    under = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(under)


def texts(seed=1):
    rng = random.Random(seed)
    out = ["", None, " \n\t", "a b", "a a a a", "x\ny\nx\n\n \nx", "ß" * 70000, "a b c " * 4000]
    for _ in range(300):
        v = rng.choice([3, 10, 60, 400])
        out.append("".join(f"{rng.choice(['w', 'W', 'é', '#', '日'])}{rng.randint(0, v)}{rng.choice([' ', ' ', '  ', chr(10), chr(160)])}" for _ in range(rng.choice([5, 40, 60, 200]))))
    out.append(" ".join(f"w{i % 150}" for i in range(460)))
    return out


def test_base_counts_equal_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())]
    got = quality.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string")).select("doc_id", "quality.*").collect()
    for r in got:
        want = base(rows[r["doc_id"]][1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def js(p, q):
    m = [(a / sum(p) + b / sum(q)) / 2 for a, b in zip(p, q, strict=True)]
    half = lambda x: sum(a / sum(x) * math.log2(a / sum(x) / c) for a, c in zip(x, m, strict=True) if a)
    return math.sqrt(max(0, (half(p) + half(q)) / 2))


def test_distances_equal_brute_force(spark):
    rng = random.Random(4)
    make = lambda vocabulary, n: " ".join(rng.choice(vocabulary) for _ in range(n))
    en, de = ["the", "of", "and", "to", *[f"word{i}" for i in range(300)]] + ["the"] * 60, ["der", "die", "und", *[f"Wort{i}" for i in range(300)]] + ["die"] * 60
    rows = [(i, make(en, 120), "en") for i in range(40)] + [(100 + i, make(de, 120), "de") for i in range(40)]
    rows += [(200, make(de, 120), "en"), (201, make(en, 120).upper().replace(" ", "!! "), "en"), (202, make(en, 120), None), (203, make(en, 60), "rare"), (204, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs).select("doc_id", "quality.*").collect()}
    every = Counter(w for _, t, _ in rows for w in (t or "").lower().split())
    for i, lang in ((0, "en"), (200, "en"), (201, "en"), (100, "de"), (203, "rare"), (202, None)):
        n = {w: every[w] / sum(every.values()) for w in every}
        if lang:
            own = Counter(w for _, t, x in rows if x == lang for w in (t or "").lower().split())
            n = {w: own[w] + quality.PRIOR_WORDS * n[w] for w in every}
        common = [w for w in n if n[w] >= quality.COMMON_SHARE * sum(n.values())]
        hist = lambda c: [c[w] for w in common] + [sum(c.values()) - sum(c[w] for w in common)]  # noqa: E731, B023
        text = next(t for d, t, _ in rows if d == i)
        assert abs(got[i]["word_distance"] - js(hist(Counter(text.lower().split())), hist(n))) < 1e-9
    assert all(got[i]["kept"] for i in [*range(40), *range(100, 140)])
    assert got[200]["word_distance"] > 2 * max(got[i]["word_distance"] for i in range(40))
    assert not got[201]["kept"] and not got[204]["kept"]
    assert got[204]["base_failed"] and got[204]["char_distance"] is None
    kept = {r["doc_id"] for r in quality.keep_good(docs.withColumn("quality", docs.doc_id)).collect()}
    assert kept == {i for i, r in got.items() if r["kept"]}


def test_many_languages_are_joined_with_the_same_result(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "of", *[f"w{k}" for k in range(90)]]) for _ in range(90)), rng.choice(["en", "de", "x1", "x2", "", None])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    read = lambda: sorted(map(tuple, quality.quality_verdicts(docs).select("doc_id", "quality.kept", "quality.word_distance", "quality.char_distance").collect()))
    want = read()
    monkeypatch.setattr(quality, "MOST_BROADCAST", 1)
    assert read() == want and len(want) == 150


def test_empty_table(spark):
    assert quality.quality_verdicts(spark.createDataFrame([], "text string, lang string")).count() == 0
