import math
import random
from collections import Counter, defaultdict

import pytest

from marram.llm import knlm


def brute(train, texts):
    """The model by its formulas, over plain dictionaries."""
    split = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() + ["</s>"]
    pairs = Counter(p for t in train for x in [split(t)] for p in zip(["<s>", *x], x, strict=False))
    count, before, after = Counter(), Counter(), defaultdict(list)
    for (v, w), n in pairs.items():
        count[w] += n
        before[w] += 1
        after[v].append(n)
    d2 = knlm.discounts([sum(n == i for n in pairs.values()) for i in (1, 2, 3, 4)])
    d1 = knlm.discounts([sum(n == i for n in before.values()) for i in (1, 2, 3, 4)])
    kinds, size, total = len(pairs), len(count), sum(count.values())
    left = sum(d1[min(n, 3)] for n in before.values()) / kinds

    def word(w):
        return (before[w] - d1[min(before[w], 3)]) / kinds + left / (size + 1)

    def p(v, w):
        if not after[v]:
            return word(w)
        return max(0, pairs[v, w] - d2[min(pairs[v, w], 3)]) / sum(after[v]) + sum(d2[min(n, 3)] for n in after[v]) / sum(after[v]) * word(w)

    for v in ["<s>", "never", *list(count)[:5]]:
        assert math.isclose(sum(p(v, w) for w in count) + p(v, "never"), 1, abs_tol=1e-9)
    for t in texts:
        x = split(t)
        yield len(x), sum(count[w] > 0 for w in x), sum(math.log10((count[w] + 0.5) / (total + 0.5 * (size + 1))) for w in x), sum(math.log10(p(v, w)) for v, w in zip(["<s>", *x], x, strict=False))


def test_scores_equal_formulas(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(f"W{min(int(rng.expovariate(0.2)), 60)}" for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", None, "unseen words only", "w0 " * 3000]
    monkeypatch.setattr(knlm, "SHARD_CHARS", 9000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = knlm.train(docs.where("doc_id % 5 <> 1").repartition(3))
    assert model.shards > 3
    got = {r["doc_id"]: r for r in knlm.scored(docs, model).collect()}
    for i, (n, known, base, score) in enumerate(brute([t for i, t in enumerate(texts) if i % 5 != 1], texts)):
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (n, known)
        assert got[i]["base_score"] == pytest.approx(base, abs=1e-6) and got[i]["score"] == pytest.approx(score, abs=1e-6)


def test_no_training_text(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = knlm.train(none)
    assert knlm.scored(none, model).count() == 0
    row = knlm.scored(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert row["n_known"] == 0 and math.isfinite(row["score"])
