import collections
import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marram.llm import packing
from marram.llm.queries import tokenizer


def best_fit(histogram, capacity):
    rooms = []
    for size in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= size]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= size
        else:
            rooms.append(capacity - size)
    return len(rooms)


def test_plan_holds_exactly_the_pieces():
    rng = random.Random(3)
    for _ in range(8):
        sizes = rng.sample(range(1, 101), 30)
        histogram = {s: rng.randint(1, 60) for s in sizes}
        got = collections.Counter()
        configs = packing.plan(histogram, 100)
        for config, times in configs:
            assert sum(k * n for k, n in config.items()) <= 100
            for k, n in config.items():
                got[k] += n * times
        assert got == collections.Counter(histogram)
        assert sum(t for _, t in configs) <= 1.02 * best_fit(histogram, 100) + 1


def test_program_beats_best_fit_where_configurations_matter():
    """Triples that fill a sequence, which best-fit decreasing breaks up; and a bound by tokens."""
    histogram = {700: 1000, 800: 1000, 548: 1000, 1348: 300}
    assert best_fit(histogram, 2048) > 1300
    assert sum(t for _, t in packing.plan(histogram, 2048)) <= 1310


def test_most_sequences_are_the_programs(monkeypatch):
    rng = random.Random(5)
    histogram = collections.Counter(min(2047, int(rng.lognormvariate(6, 1)) + 1) for _ in range(6000))
    left = []
    plain = packing.fit_left
    monkeypatch.setattr(packing, "fit_left", lambda a, c: left.append(sum(t for _, t in plain(a, c))) or plain(a, c))
    total = sum(t for _, t in packing.plan(histogram, 2048))
    assert left[0] < total / 5  # what is packed best-fit if no configuration is taken apart
    assert total <= -(-sum(s * n for s, n in histogram.items()) // 2048) * 1.01 + 1
    assert total <= best_fit(histogram, 2048)


def test_fractions_cover_the_demand_about():
    demand = np.zeros(101, np.int64)
    demand[[7, 20, 33, 50, 99]] = 40, 30, 20, 10, 5
    covered = np.zeros(101)
    found = packing.fractional(demand, 100)
    for own, n, x in found:
        assert own @ n <= 100
        covered[own] += n * x
    assert (covered >= 0.7 * demand).all()
    assert sum(x for _, _, x in found) <= 1.15 * 30


def test_configurations_are_the_best_of_all():
    rng = random.Random(6)
    for _ in range(20):
        values = np.zeros(31)
        for s in rng.sample(range(1, 31), 6):
            values[s] = rng.random()
        best = [0.0] * 31
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(best[c - s] + values[s] for s in range(1, c + 1) if values[s])])
        own, n = packing.best_configs(values, 30, 0.01)[0]
        assert own @ n <= 30 and abs(values[own] @ n - best[30]) < 1e-9


def test_query_is_gapless_and_ids_match_the_tokenizer(spark):
    texts = ["", None, "a  b\n c", "it's <|endoftext|> 日本 é <|endoftext|><|endoftext|", "a" * 30_000, "x y z " * 2000, "x y z " * 2000, "\x1c\t   q"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    where = tokenizer()
    rows = packing.packed(docs, **where, rounds=20).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in enumerate(texts):
        ids = [*slow.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(own):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part))
            at += r["length"]
        assert at == len(ids) and (len(own) == 1 or all(r["length"] == 2048 for r in own[1:]))
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    where = tokenizer()
    assert packing.packed(docs, **where).count() == 0


def test_spread_holds_exactly_the_pieces():
    rng = random.Random(4)
    histogram = {s: rng.randint(1, 60) for s in rng.sample(range(1, 101), 30)}
    got = packing.spread(packing.plan(histogram, 100, 60))
    assert got.groupby("length").size().to_dict() == histogram
    for _, own in got.groupby("length"):
        assert list(own["rank"]) == list(range(len(own))) and own["sequence"].is_monotonic_increasing
    assert set(got["sequence"]) == set(range(got["sequence"].max() + 1))
    for _, own in got.sort_values("offset").groupby("sequence"):
        assert list(own["offset"]) == [0, *own["length"].cumsum()][:-1] and own["length"].sum() <= 100


def test_sequences_follow_the_order_of_files(spark, tmp_path):
    """Long texts first, short ones then, against the order of ids: no piece leaves its window of 4 sequences."""
    docs = [(1000 - i, "x y z " * (150 if i < 60 else 40)) for i in range(160)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(3, (-F.col("doc_id")).alias("k")).sortWithinPartitions(-F.col("doc_id"))
    frame.write.parquet(f"{tmp_path}/t")
    read = spark.read.parquet(f"{tmp_path}/t")
    where = tokenizer()
    rows = packing.packed(read, **where, rounds=20, in_order=True, window=4).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in docs)
    at, window = 0, {}
    for r in sorted(rows, key=lambda r: -r["doc_id"]):
        window[r["doc_id"]] = at // (4 * 2048)
        at += r["length"]
    order = [window[r["doc_id"]] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert max(order) > 2 and order == sorted(order)
    assert packing.packed(spark.read.parquet(f"{tmp_path}/t").where("doc_id < 0"), **where, in_order=True).count() == 0
