"""Mixing sources to target weights by Pfair scheduling: blocks with release times and deadlines, earliest deadline first."""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Mapping
from fractions import Fraction
from heapq import heappop, heappush
from itertools import accumulate
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import fresh, n_buckets, running, written

#: Characters of a block, and blocks that the driver plans at most: a larger corpus has larger blocks, a millionth of it each.
BLOCK_CHARS, MOST_BLOCKS = 100_000, 1_000_000
#: Blocks of a source in one row of the plan.
PART = 1000


def timetable(weights: Mapping, blocks: Mapping[str, int]) -> dict[str, tuple[array, array, array]]:
    """For each source (releases, deadlines, slots) of its blocks, by weights as they are: exact fractions, never rounded.

    In the fluid schedule each source gets its share of every slot until its blocks are done; by the time that source s has
    had k blocks, v = k / w of it, t(v) = sum of min(blocks, w * v) over sources slots are over. Block k has release time
    floor(t(k / w)) and deadline ceil(t((k + 1) / w)), which is floor(k / share) and ceil((k + 1) / share) while all sources
    last. The fluid schedule keeps these windows, so earliest deadline first does too: before and after each slot a
    source's blocks differ from its fluid blocks by less than one, also where others have ended.
    """
    names = [s for s, n in blocks.items() if n]
    exact = {s: Fraction(weights[s]) for s in names}
    scale = lcm(*(w.denominator for w in exact.values()))
    whole = [int(exact[s] * scale) for s in names]
    count = [blocks[s] for s in names]
    ends = sorted((Fraction(n, w), n, w) for n, w in zip(count, whole, strict=True))
    over = [e for e, _, _ in ends]
    gone = list(accumulate((n for _, n, _ in ends), initial=0))
    rate = list(accumulate((w for _, _, w in ends), lambda a, w: a - w, initial=sum(whole)))

    def times(i: int):
        """(floor, ceil) of t(k / w) for k = 0, 1, ..."""
        w, j = whole[i], 0
        for k in range(count[i] + 1):
            if j < len(ends) and ends[j][1] * w <= k * ends[j][2]:
                j = bisect_right(over, Fraction(k, w), j)
            yield gone[j] + k * rate[j] // w, gone[j] - (-k * rate[j] // w)

    out = [(array("q"), array("q"), array("q")) for _ in names]
    steps = [times(i) for i in range(len(names))]
    waiting, ready = defaultdict(list), []

    def wait(i: int, release: int, slot: int) -> None:
        """Put the next block of source i, of this release time, to where it may run from slot on."""
        low, high = next(steps[i])
        out[i][0].append(release)
        out[i][1].append(high)
        waiting[max(slot, release)].append((high, i, low))

    for i in range(len(names)):
        wait(i, next(steps[i])[0], 0)
    for slot in range(sum(count)):
        for job in waiting.pop(slot, ()):
            heappush(ready, job)
        _, i, low = heappop(ready)
        out[i][2].append(slot)
        if len(out[i][2]) < count[i]:
            wait(i, low, slot + 1)
    return dict(zip(names, out, strict=True))


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_chars: int = BLOCK_CHARS, temperature: float = 0.7) -> DataFrame:
    """One row per row of docs: (id_col, source, stream, block, release, deadline, slot, place).

    weights gives the target share of each source by characters; sources that it doesn't name, and null, share the stream
    "". Without weights every source is a stream, null and "" too, with a share of its characters to the power temperature.
    Within a stream documents are dealt by a hash of id and text; a document belongs
    to the block where it begins, so a block may hold none if a long document covers it. slot orders blocks, place the
    documents of a block: ordering by slot, place gives the mix. Every row stays, once. Releases, deadlines and slots are
    those of timetable: a stream's blocks differ from its share of the slots by less than one, with the weights as they
    are; a stream that ends leaves its slots to the others. The driver holds three numbers a block. A null text has no
    characters and still gets a place.
    """
    name = F.col(source_col).cast("string")
    chars = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), name.alias("source"), chars.alias("chars"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("deal"))
    # equal rows need an order too; a written table keeps the numbers that its rows were given
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    shares = {s: float(w) for s, w in (weights or {}).items() if w > 0}
    if weights is None:
        stream = F.col("source")
    else:
        stream = F.when(F.col("source").isin(*shares), F.col("source")).otherwise("") if shares else F.lit("")
    totals = {r["stream"]: (r["chars"], r["n"]) for r in sizes.groupBy(stream.alias("stream")).agg(F.sum("chars").alias("chars"), F.sum("n").alias("n")).collect()}
    if weights is None:
        shares = {s: max(c, 1) ** temperature for s, (c, _) in totals.items()}
    elif "" in totals and "" not in shares:
        shares[""] = sum(shares.values()) / max(1, len(shares)) or 1.0
    block_chars = max(block_chars, -(-sum(c for c, _ in totals.values()) // MOST_BLOCKS))
    counts = {s: max(1, -(-c // block_chars)) for s, (c, _) in totals.items()}
    order = sorted(totals, key=lambda s: (s is not None, s))
    plan = timetable(shares, {s: counts[s] for s in order})
    buckets = n_buckets(max((n for _, n in totals.values()), default=0))
    placed = running(rows.withColumn("stream", stream), ["stream"], F.floor((F.col("deal") / 2.0**64 + 0.5) * buckets), [F.col("deal"), F.col("row")], F.col("chars"), "_before")
    lasts = rows.sparkSession.createDataFrame([(s, n - 1) for s, n in counts.items()], "s string, last long")
    placed = placed.join(F.broadcast(lasts), F.col("stream").eqNullSafe(F.col("s"))).withColumn("block", F.least(F.floor(F.col("_before") / block_chars), F.col("last")).cast("long")).drop("s")
    parts = [(s, k // PART, *(x[k : k + PART].tolist() for x in own)) for s, own in plan.items() for k in range(0, counts[s], PART)]
    table = rows.sparkSession.createDataFrame(parts, "s string, part long, releases array<long>, deadlines array<long>, slots array<long>")
    out = placed.join(F.broadcast(table), (F.col("stream").eqNullSafe(F.col("s"))) & (F.floor(F.col("block") / PART) == F.col("part")))
    k = F.pmod("block", F.lit(PART)).cast("int")
    return out.select(
        F.col("id").alias(id_col), "source", "stream", "block",
        *[F.get(f"{c}s", k).alias(c) for c in ("release", "deadline", "slot")],
        F.col("_before").alias("place"), F.col("row").alias("tie"),
    )


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs in the order of the mix, with their columns as they are: rows are dealt by ranges of slots and sorted.

    Ids that come more than once share the place of their first row.
    """
    key, slot, place = fresh(docs, "_key", "_slot", "_place")
    plan = schedule(docs, weights, id_col, text_col, source_col, **how)
    plan = plan.groupBy(F.col(id_col).alias(key)).agg(F.min(F.struct("slot", "place")).alias("at")).select(key, F.col("at.slot").alias(slot), F.col("at.place").alias(place))
    rows = docs.join(written(plan, "mix-plan"), docs[id_col].eqNullSafe(F.col(key)), "left")
    return rows.repartitionByRange(F.col(slot), F.col(place)).sortWithinPartitions(slot, place).drop(key, slot, place)
