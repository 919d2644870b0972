import random
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marram.llm import jaccard


def shingles(text, n):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def brute(texts, n, t):
    sets, at = [shingles(x, n) for x in texts], list(range(len(texts)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) * t.denominator >= t.numerator * len(a | b):
                x, y = sorted((root(i), root(j)))
                at[y] = x
    return [(i, len(s), root(i)) for i, s in enumerate(sets)]


def corpus(seed, rows=250):
    rng = random.Random(seed)
    out = ["", None, "A b", "a B", "one", "x y z"]
    while len(out) < rows:
        words = [f"w{rng.randint(0, 40 if rng.random() < 0.3 else 4000)}" for _ in range(rng.choice([4, 9, 12, 15, 20, 23, 30, 80, 300]))]
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            new = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                k = rng.randrange(len(new))
                new[k : k + 1] = rng.choice([[], ["q%d" % rng.randint(0, 9)], [new[k], "z"]])
                new = new or ["z"]
            if rng.random() < 0.3:
                new.append(f"e{rng.randint(0, 3)}")
            if rng.random() < 0.3:
                words = new  # a chain
            out.append(" ".join(new))
    return out


def test_groups_equal_brute_force(spark):
    for seed, n, t in ((1, 3, Fraction(9, 10)), (2, 5, Fraction(8, 10)), (3, 3, Fraction(9, 10))):
        texts = corpus(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = sorted(map(tuple, jaccard.similar_groups(docs, n, t).collect()))
        assert got == brute(texts, n, t)


def test_many_sets_of_one_key(spark, monkeypatch):
    """Tasks that hold few keys hand out many firsts of a list, and clusters are cut into small blocks: no link is lost."""
    monkeypatch.setattr(jaccard, "KEYS", 400)
    monkeypatch.setattr(jaccard, "HOT_SETS", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 300)
    rng = random.Random(12)
    base = [f"b{i}" for i in range(60)]
    texts = corpus(5, 120)
    for _ in range(150):  # one cell after the other changes; neighbours link, the ends don't
        base[rng.randrange(60)] = f"c{rng.randint(0, 30)}"
        texts.append(" ".join(base))
    rng.shuffle(texts)
    for n, t in ((3, Fraction(9, 10)), (2, Fraction(8, 10)), (5, Fraction(8, 10))):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
        assert sorted(map(tuple, jaccard.similar_groups(docs, n, t).collect())) == brute(texts, n, t)


def test_repeated_and_null_ids(spark):
    """Rows are told apart by their texts; keep_one leaves one row of each group, and every text has a like one that stays."""
    rng = random.Random(13)
    texts = corpus(7, 80)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6]), t, i % 3) for i, t in enumerate(texts)] + [(1, texts[8], 0)] * 3 + [(None, texts[9], 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, TKEY int").withColumn("_own", F.lit(1)).repartition(3)
    t = Fraction(8, 10)
    groups = {}
    for i, _, r in brute([x for _, x, _ in rows], 5, t):
        groups.setdefault(r, []).append(i)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    out = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(out) == len(groups)
    for members in groups.values():
        own = [(rows[i][0], rows[i][1]) for i in members]
        stays = [x for x in out if x in own]
        least = min((i is None, i or 0) for i, _ in own)
        assert (stays[0][0] is None, stays[0][0] or 0) == least if len(members) > 1 else stays
    got = jaccard.similar_groups(docs, 5, t).collect()
    assert len(got) == len(rows)


def test_empty_table(spark):
    assert jaccard.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert jaccard.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.data())
def test_linked_sets_share_a_key(s, data):
    t = data.draw(st.sampled_from([Fraction(9, 10), Fraction(8, 10)]))
    sizes = jaccard.Sizes(t)
    rng = random.Random(data.draw(st.integers(0, 10**6)))
    a = {rng.getrandbits(64) for _ in range(s)}
    b = set(a)
    while True:
        c = set(b)
        if rng.random() < 0.5:
            c.add(rng.getrandbits(64))
        else:
            c.discard(rng.choice(sorted(c)))
        if not c or len(a & c) * t.denominator < t.numerator * len(a | c):
            break
        b = c
        if rng.random() < 0.02:
            break
    import numpy as np

    keys = [set(jaccard.keys_of(np.sort(np.array(sorted(x), np.uint64)), sizes, sizes.boundary(), {})[0].tolist()) for x in (a, b)]
    assert keys[0] & keys[1]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 700), st.integers(0, 700), st.integers(0, 700), st.integers(0, 10**6))
def test_sketches_refuse_no_link(both, one, other, seed):
    """Sketches of sets differ in no more bits than the sets in shingles, of whatever sizes; sets with a common passage only are refused."""
    import numpy as np

    rng = random.Random(seed)
    pool = [rng.getrandbits(64) for _ in range(both + one + other)]
    a, b = (np.sort(np.array(x, np.uint64)) for x in (pool[: both + one], pool[:both] + pool[both + one :]))
    p, q = jaccard.sketch(a), jaccard.sketch(b)
    n = min(len(p), len(q))
    assert int(np.bitwise_count(jaccard.folded(p, n) ^ jaccard.folded(q, n)).sum()) <= one + other
    for t in (Fraction(9, 10), Fraction(8, 10)):
        if jaccard.linked(both, len(a), len(b), t):
            assert jaccard.may_link(p, q, len(a) + len(b), t)
        if both + one >= 100 and one >= 9 * both and other >= 9 * both:
            assert not jaccard.may_link(p, q, len(a) + len(b), t)


def test_sets_with_a_common_passage_do_not_move(spark, monkeypatch):
    """Documents that share a passage but aren't linked have cells in common; their whole sets are computed for none of them."""
    moved, real = [], jaccard._bodies
    monkeypatch.setattr(jaccard, "_bodies", lambda docs, names, n: (moved.append(names.count()), real(docs, names, n))[1])
    rng = random.Random(21)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join([*(f"w{rng.randint(0, 10**6)}" for _ in range(90)), passage]) for _ in range(60)]
    texts += [texts[0] + " end", texts[1] + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, jaccard.similar_groups(docs, 5, Fraction(8, 10)).collect())) == brute(texts, 5, Fraction(8, 10))
    assert sum(moved) <= 4
