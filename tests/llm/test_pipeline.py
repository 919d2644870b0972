import random
from fractions import Fraction

import corpus_pipeline
from marram.llm import mixing
from test_jaccard import brute


def test_stages_chain(spark, tmp_path):
    """Each stage's decisions take effect, and all but the last keep the columns of documents."""
    rng = random.Random(9)
    words = ["the", "of", "and", *[f"w{i}" for i in range(400)]] + ["the", "of", "and"] * 60
    rows = []
    for i in range(120):
        rows.append((len(rows), " ".join(rng.choice(words) for _ in range(150)), "en", f"s{i % 3}", 0))
    rows.append((len(rows), rows[0][1] + "  ", "en", "s1", 0))  # an exact copy, longer
    rows.append((len(rows), rows[1][1] + " more", "en", "s1", 0))  # a near copy
    rows.append((len(rows), "too short", "en", "s1", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns and now.schema == docs.schema
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"] for r in now.collect()}
    every = set(range(len(rows)))
    assert kept["quality_rules"] == every - {122}
    assert kept["exact_dedup"] == every - {122, 0}  # the longer copy stays
    assert kept["ngram_jaccard"] == every - {122, 0, 121} == kept["mixing"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == kept["mixing"]


def test_sequences_keep_the_mix(spark, tmp_path):
    """Of the packed tokens, each source has its target share in any run of sequences from the first on; ids lie by source."""
    rng = random.Random(10)
    words = [f"w{i}" for i in range(400)]
    sizes = {"a": (900, 150), "b": (300, 150)}
    rows = []
    for s, (n, length) in sizes.items():
        rows += [(len(rows) + i, " ".join(rng.choice(words) for _ in range(length)), "en", s, 0) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixing.mixed(docs, {"a": 1, "b": 1}, block_chars=5000).write.parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/mixed"), str(tmp_path)).collect()
    source = {r[0]: r[3] for r in rows}
    assert sorted({r["doc_id"] for r in out}) == sorted(source)
    tokens = {s: sum(r["length"] for r in out if source[r["doc_id"]] == s) for s in sizes}
    got, seen = 0, 0
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        got, seen = got + r["length"] * (source[r["doc_id"]] == "b"), seen + r["length"]
        if seen < 2 * tokens["b"]:
            assert abs(got - seen / 2) < 0.04 * tokens["b"] + 4 * 2048
    assert got == tokens["b"]


def stages(spark, docs, where):
    """The rows that each stage but the last keeps, and those of the last."""
    docs.write.parquet(f"{where}/documents.parquet")
    now, out = spark.read.parquet(f"{where}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(where))
        now.write.parquet(f"{where}/{name}")
        now = spark.read.parquet(f"{where}/{name}")
        out[name] = now.collect()
    return out


def test_stages_equal_brute_force_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty texts, repeated rows and ids, and columns with the operators' own names."""
    rng = random.Random(14)
    words = ["the", "of", "and", *[f"w{i}" for i in range(300)]] + ["the", "of", "and"] * 50
    make = lambda n: [rng.choice(words) for _ in range(n)]
    rows = [(i, " ".join(make(140)), rng.choice(["en", None, "xx"]), rng.choice(["s1", "s2", None, ""]), 0) for i in range(60)]
    for k in range(12):  # exact copies, repeated rows, near copies
        i, t, lang, source, n = rows[k]
        rows += [(100 + k, t + "  ", lang, source, n), (i, t, lang, source, n)]
        w = t.split()
        w[3] = "changed"
        rows.append((200 + k, " ".join(w), lang, source, None))
    rows += [(None, rows[20][1], None, None, None), (None, " ".join(make(140)), None, None, None), (7, None, "en", "s1", 0), (8, "", "en", "s1", 0), (9, " \n", None, None, 0), (10, "few words", "en", "s2", 0)]
    rows = [(*r, "x", 1, 2) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality string, _slot long, _path long").repartition(3)
    got = stages(spark, docs, tmp_path)
    good = [r for r in rows if len((r[1] or "").split()) >= 50]
    assert sorted(map(str, map(tuple, got["quality_rules"]))) == sorted(map(str, good))
    best = {}
    for r in good:
        key = (-len(r[1]), r[0] is None, r[0] or 0)
        bare = "".join(r[1].split())
        if bare not in best or key < best[bare][0]:
            best[bare] = key, r
    distinct = [r for _, r in best.values()]
    assert sorted(map(str, map(tuple, got["exact_dedup"]))) == sorted(map(str, distinct))
    groups = {}
    for i, _, root in brute([r[1] for r in distinct], 5, Fraction(8, 10)):
        groups.setdefault(root, []).append(distinct[i])
    apart = [min(own, key=lambda r: (r[0] is None, r[0] or 0)) for own in groups.values()]
    assert len(apart) < len(distinct)
    assert sorted(map(str, map(tuple, got["ngram_jaccard"]))) == sorted(map(str, apart)) == sorted(map(str, map(tuple, got["mixing"])))
    assert sorted(str(r["doc_id"]) for r in got["packing"] if r["piece"] == 0) == sorted(str(r[0]) for r in apart)


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert not any(stages(spark, docs, tmp_path).values())
