import random
from fractions import Fraction
from math import ceil, floor

from marram.llm import mixing
from marram.llm.mixing import mixed, schedule, timetable


def brute(weights, blocks):
    """Earliest deadline first, slot by slot, over releases and deadlines summed up in small steps of the fluid schedule."""
    fluid, windows, t = {s: Fraction(0) for s in blocks}, {s: [Fraction(0)] for s in blocks}, Fraction(0)
    while any(fluid[s] < blocks[s] for s in blocks):
        here = [s for s in blocks if fluid[s] < blocks[s]]
        total = sum(Fraction(weights[s]) for s in here)
        step = min((int(fluid[s]) + 1 - fluid[s]) * total / Fraction(weights[s]) for s in here)
        t += step
        for s in here:
            fluid[s] += step * Fraction(weights[s]) / total
            if fluid[s] == int(fluid[s]) == len(windows[s]):
                windows[s].append(t)
    done, out = dict.fromkeys(blocks, 0), {s: [] for s in blocks}
    for slot in range(sum(blocks.values())):
        ready = [(ceil(windows[s][done[s] + 1]), list(blocks).index(s), s) for s in blocks if done[s] < blocks[s] and floor(windows[s][done[s]]) <= slot]
        s = min(ready)[2]
        out[s].append((floor(windows[s][done[s]]), ceil(windows[s][done[s] + 1]), slot))
        done[s] += 1
    return out


def test_timetable_equals_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        w = {f"s{i}": Fraction(rng.randint(1, 30), rng.randint(1, 5)) for i in range(rng.randint(1, 6))}
        blocks = {s: rng.randint(1, 20) for s in w}
        assert {s: list(zip(*own, strict=True)) for s, own in timetable(w, blocks).items()} == brute(w, blocks)


def test_query_equals_brute_force(spark):
    """The whole table: blocks from running characters in the order of the deal, slots by brute force."""
    got = schedule(frame(spark), block_chars=5000).collect()
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
    chars = {}
    for _, t, s, _ in rows():
        chars[s] = chars.get(s, 0) + len(t or "")
    order = sorted(chars, key=lambda s: (s is not None, s or ""))
    plan = brute({s: max(chars[s], 1) ** 0.7 for s in order}, {s: max(1, -(-chars[s] // 5000)) for s in order})
    length = {}
    for i, t, s, _ in rows():
        length.setdefault((i, s), len(t or ""))
    for s, own in by.items():
        at = 0
        for r in sorted(own, key=lambda r: (r["place"], length[r["doc_id"], s] > 0)):
            block = min(at // 5000, len(plan[s]) - 1)
            assert r["place"] == at and (r["block"], (r["release"], r["deadline"], r["slot"])) == (block, plan[s][block])
            at += length[r["doc_id"], s]
        assert at == chars[s]


def test_large_corpora_have_larger_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 10)
    got = schedule(frame(spark), block_chars=50).collect()
    assert len(got) == len(rows()) and len({r["slot"] for r in got}) <= 10 + 6


def rows():
    out = [(i, "x" * (i % 700), f"s{i % 7 % 3}", i) for i in range(900)]
    return out + [(1000, None, None, 1), (1001, "", "", 2), (1002, "y" * 90_000, "s1", 3), (1002, "y" * 90_000, "s1", 3), (None, "z", "rare", 4)]


def frame(spark):
    return spark.createDataFrame(rows(), "doc_id long, text string, source string, _slot int")


def test_every_row_has_one_place(spark):
    got = schedule(frame(spark), {"s0": 3, "s1": 1, "s2": 1, "never": 5}, block_chars=5000).collect()
    assert sorted((r["doc_id"] or -1) for r in got) == sorted((r[0] or -1) for r in rows())
    by = {}
    for r in got:
        assert r["release"] <= r["slot"] < r["deadline"]
        assert by.setdefault(r["slot"], (r["stream"], r["block"])) == (r["stream"], r["block"])
    # blocks of a stream come in order
    for s in {r["stream"] for r in got}:
        own = sorted((r["block"], r["slot"]) for r in got if r["stream"] == s)
        assert [x[1] for x in own] == sorted(x[1] for x in own)
    again = schedule(frame(spark).repartition(9), {"s0": 3, "s1": 1, "s2": 1, "never": 5}, block_chars=5000).collect()
    place = lambda x: sorted((r["doc_id"] or -1, r["slot"], r["place"]) for r in x)
    assert place(again) == place(got)


def test_mixed_keeps_rows_and_order(spark):
    docs = frame(spark)
    out = mixed(docs, block_chars=5000)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert mixed(docs.limit(0)).count() == 0 and schedule(docs.limit(0)).count() == 0


def lag(weights, blocks):
    """Largest difference of blocks done and blocks of the fluid schedule, each source's share of slots while it lasts."""
    plan = timetable(weights, blocks)
    who = {slot: s for s, own in plan.items() for slot in own[2]}
    assert sorted(who) == list(range(sum(blocks.values())))
    exact = {s: Fraction(w) for s, w in weights.items()}
    fluid, done, worst = dict.fromkeys(blocks, Fraction(0)), dict.fromkeys(blocks, 0), Fraction(0)
    for slot in range(len(who)):
        left = Fraction(1)
        while left:
            here = [s for s in blocks if fluid[s] < blocks[s]]
            total = sum(exact[s] for s in here)
            step = min([left, *((blocks[s] - fluid[s]) * total / exact[s] for s in here)])
            for s in here:
                fluid[s] += step * exact[s] / total
            left -= step
        done[who[slot]] += 1
        worst = max(worst, *(abs(done[s] - fluid[s]) for s in blocks))
    for releases, deadlines, slots in plan.values():
        assert all(a <= c < b for a, b, c in zip(releases, deadlines, slots, strict=True))
    return worst


def test_lag_against_unrounded_weights():
    rng = random.Random(9)
    for _ in range(40):
        w = {f"s{i}": Fraction(rng.randint(1, 99), rng.randint(1, 99)) for i in range(rng.randint(1, 6))}
        assert lag(w, {s: rng.randint(0, 25) for s in w} | {"s0": 3}) < 1
    plan = timetable({"a": 0.9999, "b": 0.0001}, {"a": 99_990, "b": 10})
    assert all(abs(slot - 10_000 * k) <= 10_000 for k, slot in enumerate(plan["b"][2]))
    hot = {"hot": 9.5**0.7, **{f"s{i}": 1.0 for i in range(19)}}
    slots = timetable(hot, {s: 22_000 if s == "hot" else 4500 for s in hot})["hot"][2]
    share = Fraction(hot["hot"]) / sum(map(Fraction, hot.values()))
    assert len(slots) == 22_000 and all(-1 < k + 1 - share * (slot + 1) < 1 for k, slot in enumerate(slots) if slot < 100_000)


def test_every_source_has_its_own_stream(spark):
    """More than 64 sources, and null and "" as two of their own, each with less than one block of lag."""
    docs = [(100 * i + j, "x" * 1000, s) for i, s in enumerate([None, "", *(f"s{i:03}" for i in range(98))]) for j in range(60 if i == 0 else 5 + i % 3)]
    got = schedule(spark.createDataFrame(docs, "doc_id long, text string, source string"), block_chars=1000).collect()
    assert len(got) == len(docs) and all(r["stream"] == r["source"] for r in got)
    assert {r["doc_id"]: r["source"] for r in got} == {i: s for i, _, s in docs}
    assert sorted(r["slot"] for r in got) == list(range(len(docs)))
    n = {s: sum(d[2] == s for d in docs) for s in {d[2] for d in docs}}
    w = {s: (1000 * k) ** 0.7 for s, k in n.items()}
    first_end = min(n[s] / w[s] for s in n) * sum(w.values())
    for s in n:
        slots = sorted(r["slot"] for r in got if r["source"] == s)
        assert all(abs(k + 1 - w[s] / sum(w.values()) * (slot + 1)) < 1 for k, slot in enumerate(slots) if slot + 1 < first_end)
