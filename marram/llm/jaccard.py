"""N-gram Jaccard join: size-aware, with subsets for small sets and inverted lists for large ones.

A document is the set of its word shingles. Small (light) sets: all subsets that a linked partner can share are few, so
each is a key, and sets with a common key are linked by their sizes alone. Large (heavy) sets: inverted lists are scanned.
A list for each shingle would be long for frequent ones, so a heavy set is dealt into more cells, by hash, than linked sets
can have differing shingles: linked sets then agree on the content of a cell, and a list holds the sets with that content.
Cells with few shingles or none say little; a set leaves them out if they are fewer than the cells that linked sets agree on.
The boundary is where the subsets of a size cost more than its cells. A list isn't paired out: its smallest set is held
against the others (exactly, on the whole sets), and links join components. Where sets of a list then lie in different
components, those outside the main one are held against all in blocks, which hand out joined components only. So all links
between different texts count, and no table of a group's pairs is made.

Most sets with a common cell aren't linked: they share a passage. So sketches, a bit or two a shingle, go first: the bits in
which those of two sets differ are no more than the shingles in which the sets do, so where they are too many there is no
link, and only sets that a sketch leaves a partner move as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from math import exp, floor, sqrt

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.llm.common import fresh, skew_join, written
from marram.llm.components import components

#: What a key of a cell costs against one of a subset, as its list has to be verified.
CELL_COST = 4.0
#: Pairs with the same smaller set that one task gets at most.
CHUNK = 500
#: Shingles of a block of a cluster that one task indexes, about.
BLOCK = 500_000
#: So many times larger are blocks of sketches, which have 2 bits a shingle at most where sets have 64.
SKETCH_BLOCKS = 16
#: Keys that a task holds at once, and from how many sets of one key on only the first of them goes on to its list.
KEYS, HOT_SETS = 100_000, 8
#: Shingles of all sets for each partition of their keys, and partitions at most; a partition is sorted, and spills if it must.
PARTITION_SHINGLES, MOST_PARTITIONS = 500_000, 20_000
#: Ids that are broadcast at most, 8 bytes each; beyond that texts are shuffled to them.
MOST_BROADCAST = 1_000_000

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles, A-Z in lower case; of fewer words, one hash of them all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], np.uint64)
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(one) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out + one[k : len(one) - n + 1 + k] + _MIX[0])
    return np.unique(out)


def set_id(h: np.ndarray) -> int:
    """A signed 64-bit name of a set: sets are told apart by it and their size."""
    with np.errstate(over="ignore"):
        return int(mixed(h + _MIX[0]).sum(dtype=np.uint64).astype(np.int64))


def sketch(h: np.ndarray) -> np.ndarray:
    """Words of 64 bits, a power of two of them and at least a bit a shingle: the parity of the shingles that a bit gets."""
    words = 1 << max(0, (len(h) - 1) // 64).bit_length()
    at = (mixed(h + _MIX[2]) % np.uint64(64 * words)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * words) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """Sketches (last axis) as those of n words, which they have or more."""
    while words.shape[-1] > n:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def may_link(p: np.ndarray, q: np.ndarray, sizes: np.ndarray | int, t: Fraction) -> np.ndarray | bool:
    """Whether sets of these sketches can link, sizes being the sum of their sizes: a shingle that one of them lacks changes
    one bit, so the sets differ in as many shingles as their sketches in bits at least, and linked ones in few."""
    n = min(p.shape[-1], q.shape[-1])
    differ = np.bitwise_count(folded(p, n) ^ folded(q, n)).sum(axis=-1, dtype=np.int64)
    return differ * (t.denominator + t.numerator) <= sizes * (t.denominator - t.numerator)


class Sizes:
    """What follows from the threshold: partners' sizes, misses, groups of sizes with their cells, the boundary."""

    def __init__(self, threshold: Fraction):
        self.t = threshold

    def misses(self, s: int) -> int:
        """Most shingles of a set of this size that a linked, different set can lack."""
        return floor((1 - self.t) * s)

    def group(self, s: int) -> int:
        """Groups of sizes such that linked sets are in the same or in neighbouring ones."""
        g, top = 0, 1
        while top < s:
            g, top = g + 1, max(top + 1, floor(top / self.t))
        return g

    def differ(self, g: int) -> int:
        """Most shingles that linked sets can differ in, the smaller of them in this group."""
        top = 1
        for _ in range(g):
            top = max(top + 1, floor(top / self.t))
        return floor((top + floor(top / self.t)) * (1 - self.t) / (1 + self.t))

    def layout(self, g: int) -> tuple[int, int]:
        """(cells of the sets of a group, most shingles of a poor cell): more cells than the sets can differ in, and so many
        more that poor ones are, for nearly all sets, fewer than those that agree. Poor cells have one shingle or none, or
        none where that needs too many cells; -1 if no number does it."""
        d, least = self.differ(g), 1
        for _ in range(g - 1):
            least = max(least + 1, floor(least / self.t))
        for most in (1, 0):
            for c in range(d + 1, floor(1.3 * d) + 2):
                poor = c * exp(-least / c) * (1 + most * least / c)
                if c - d > poor + 3 * sqrt(poor) + 1:
                    return c, most
        return d + 1, -1

    def cells(self, g: int) -> int:
        return self.layout(g)[0]

    def boundary(self) -> int:
        """The largest size up to which a set goes by its subsets: one shingle may be missing, and subsets cost less."""
        s = 1
        while self.misses(s + 1) <= 1 and 1 + (s + 1) * self.misses(s + 1) <= CELL_COST * (self.cells(self.group(s + 1)) + self.cells(max(0, self.group(s + 1) - 1))):
            s += 1
        return s


def keys_of(h: np.ndarray, sizes: Sizes, light_to: int, memo: dict) -> tuple[np.ndarray, np.ndarray]:
    """(keys, light flags) of a set."""
    s, out, flags = len(h), [], []
    with np.errstate(over="ignore"):
        if s <= light_to:
            m = mixed(h + _MIX[0])
            whole = m.sum(dtype=np.uint64)
            subsets = np.append(whole - m if s > 1 and sizes.misses(s) else m[:0], whole)
            counts = np.append(np.full(len(subsets) - 1, s - 1), s).astype(np.uint64)
            out.append(mixed(subsets + counts * _MIX[2]))
            flags.append(np.ones(len(subsets), bool))
        if s >= sizes.t * (light_to + 1):
            if s not in memo:
                g = sizes.group(s)
                memo[s] = [(k, *sizes.layout(k), sizes.differ(k)) for k in (g, g - 1) if k >= 0]
            m = mixed(h ^ _MIX[1])
            for g, cells, most, differ in memo[s]:
                at = (h % np.uint64(cells)).astype(np.int64)
                order = np.argsort(at, kind="stable")
                starts = np.flatnonzero(np.diff(at[order], prepend=-1))
                content = np.zeros(cells, np.uint64)
                content[at[order][starts]] = np.add.reduceat(m[order], starts)
                place = np.arange(cells, dtype=np.uint64) * _MIX[0] + np.uint64(g + 1) * _MIX[2]
                keys = mixed(content + mixed(place))
                # linked sets agree on cells - differ cells at least; where a set has fewer poor cells, a rich one is among them
                poor = np.bincount(at, minlength=cells) <= most
                if poor.sum() < cells - differ:
                    keys = keys[~poor]
                out.append(keys)
                flags.append(np.zeros(len(keys), bool))
    return np.concatenate(out).astype(np.int64), np.concatenate(flags)


def linked(inter: int, a: int, b: int, t: Fraction) -> bool:
    return inter * t.denominator >= t.numerator * (a + b - inter)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(id, tkey, n, sig, sketch) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingle_set(t, n) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "tkey": b["tkey"], "n": np.array([len(h) for h in found], np.int64), "sig": np.array([set_id(h) for h in found], np.int64), "sketch": [sketch(h).tobytes() for h in found]})

    return docs.mapInPandas(run, f"id {docs.schema['id'].dataType.simpleString()}, tkey long, n long, sig long, sketch binary")


def _entries(docs: DataFrame, n: int, sizes: Sizes, light_to: int) -> DataFrame:
    """(key, sig, n, light, psig, pn): keys of each set; a task gives those of a set once, however many copies it reads.

    Where HOT_SETS or more of the sets that a task holds share a key of a cell, the first of them goes on to the list of the
    key, for the others it is their first already. So a key that a large share of all sets has doesn't bring them to one task.
    """

    def listed(key: np.ndarray, sig: np.ndarray, many: np.ndarray, light: np.ndarray) -> pd.DataFrame:
        order = np.lexsort((sig, many, light, key))
        k, s, f = key[order], sig[order], light[order]
        starts = np.append(True, (k[1:] != k[:-1]) | (f[1:] != f[:-1]))
        sizes = np.diff(np.append(np.flatnonzero(starts), len(k)))
        new = starts | f | np.repeat(sizes < HOT_SETS, sizes)
        first = np.empty(len(order), np.int64)
        first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        # rows stay in the order of their sets, which packs far better than that of the keys; 0 where there is no first yet
        own = first == np.arange(len(order))
        keep = own | (sig != sig[first])
        out = pd.DataFrame({"key": key, "sig": sig, "n": many, "light": light, "psig": np.where(own, 0, sig[first]), "pn": np.where(own, 0, many[first])})
        return out[keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, memo = set(), {}
        held: list[tuple] = []
        total = 0
        for b in batches:
            for t in b["text"]:
                h = shingle_set(t, n)
                if not len(h) or (sig := set_id(h)) in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(sig)
                k, f = keys_of(h, sizes, light_to, memo)
                held.append((k, np.full(len(k), sig, np.int64), np.full(len(k), len(h), np.int32), f))
                total += len(k)
                if total > KEYS:
                    yield listed(*map(np.concatenate, zip(*held, strict=True)))
                    held, total = [], 0
        if held:
            yield listed(*map(np.concatenate, zip(*held, strict=True)))

    return docs.select("text").mapInPandas(run, "key long, sig long, n int, light boolean, psig long, pn int")


def _lists(entries: DataFrame, partitions: int) -> DataFrame:
    """The entries of lists with at least two sets, each with its first: smallest n, then sig, as psig, pn.

    Entries that have a first go where their set does; the others, with a pn of 0, meet by key, and the first of these is
    that of the list. A task holds the first of a list and the last entry only, so lists may be of any length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = psig = pn = last = None
        for b in batches:
            done = (b["pn"] > 0).to_numpy()
            if done.any():
                yield b[done]
            b = b[~done]
            if not len(b):
                continue
            k, s, n, f = (b[c].to_numpy() for c in ("key", "sig", "n", "light"))
            new = np.append(True, k[1:] != k[:-1])
            goes_on = key is not None and k[0] == key
            new[0] = not goes_on
            first = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            ps, pc = np.where(first >= 0, s[first], psig if goes_on else 0), np.where(first >= 0, n[first], pn if goes_on else 0)
            again = np.append(goes_on and s[0] == last, (k[1:] == k[:-1]) & (s[1:] == s[:-1]))
            keep = (s != ps) & ~again
            if keep.any():
                yield pd.DataFrame({"key": k, "sig": s, "n": n, "light": f, "psig": ps, "pn": pc})[keep]
            key, psig, pn, last = k[-1], ps[-1], pc[-1], s[-1]

    dealt = entries.repartition(partitions, F.when(F.col("pn") == 0, F.col("key")).otherwise(F.col("sig")))
    return dealt.sortWithinPartitions("key", "n", "sig").mapInPandas(run, "key long, sig long, n int, light boolean, psig long, pn int")


def _chunked(pairs: DataFrame) -> DataFrame:
    """(a, b, chunk): the pairs of a hub a in portions of about CHUNK, so that no task gets all of them."""
    hubs = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "hubs")
    return written(skew_join(pairs, hubs, "a").select("a", "b", F.pmod(F.hash("b"), F.col("chunks")).alias("chunk")), "chunked")


def _possible(pairs: DataFrame, sketches: DataFrame, t: Fraction) -> DataFrame:
    """Those of the distinct pairs (a, b) that can link by their sketches (sig, n, sketch)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            good = np.zeros(len(x), bool)
            for i, (p, q, n) in enumerate(zip(x["pa"], x["pb"], x["sizes"], strict=True)):
                good[i] = may_link(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), n, t)
            yield x.loc[good, ["a", "b"]]

    end = lambda c: sketches.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"p{c}"))
    chunked = _chunked(pairs)
    first = chunked.select("a", "chunk").distinct().join(end("a"), "a")
    both = chunked.join(end("b"), "b").join(first, ["a", "chunk"])
    return both.select("a", "b", "pa", "pb", (F.col("na") + F.col("nb")).alias("sizes")).mapInPandas(run, "a long, b long")


def _verified(chunked: DataFrame, second: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Those of the distinct pairs (a, b, chunk) whose whole sets are similar enough.

    second is the pairs with the set of b as hb, sets is (sig, body). The set of a is sent once for each of its portions.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            good = np.zeros(len(x), bool)
            for i, (p, q) in enumerate(zip(x["ha"], x["hb"], strict=True)):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = np.concatenate((p, q))
                both.sort(kind="stable")
                good[i] = linked(int((both[1:] == both[:-1]).sum()), len(p), len(q), t)
            yield x.loc[good, ["a", "b"]]

    first = chunked.select("a", "chunk").distinct().join(sets.select(F.col("sig").alias("a"), F.col("body").alias("ha")), "a")
    return second.join(first, ["a", "chunk"]).select("a", "b", "ha", "hb").mapInPandas(run, "a long, b long")


def _blocked(members: DataFrame, bodies: DataFrame, block: int) -> DataFrame:
    """(psig, i, j, right, component, sig, n, body): of each cluster, the sets outside its main component against all its
    sets, in blocks of about so many shingles; members is (psig, sig, n, component), bodies (sig, body)."""
    counts = members.groupBy("psig", "component").agg(F.sum("n").alias("m"))
    counts = counts.groupBy("psig").agg(F.sum("m").alias("all"), F.max("m").alias("most"), F.max_by("component", F.struct("m", "component")).alias("main"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    counts = counts.select("psig", "main", blocks(F.col("all")).alias("rights"), blocks(F.col("all") - F.col("most")).alias("lefts"))
    rows = skew_join(members, written(counts, "clusters"), "psig")
    own = lambda n: F.pmod(F.hash("sig"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # a cluster within one component has no left block
    right = rows.where("lefts > 0").select("psig", every(F.col("lefts")).alias("i"), own(F.col("rights")).alias("j"), F.lit(True).alias("right"), "component", "sig", "n")
    left = rows.where("component <> main").select("psig", own(F.col("lefts")).alias("i"), every(F.col("rights")).alias("j"), F.lit(False).alias("right"), "component", "sig", "n")
    both = right.unionByName(left).join(bodies, "sig").select("psig", "i", "j", "right", "component", "sig", "n", "body")
    return both.repartition("psig", "i", "j").sortWithinPartitions("psig", "i", "j", "right")


def _partners(members: DataFrame, sketches: DataFrame, t: Fraction) -> DataFrame:
    """(psig, sig): sets of clusters that can link, by their sketches, with a set of another component of the cluster.

    No pairs come out, so however many sets are like each other there is a row for each of them at most.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept, index, out = None, [], None, set()

        def indexed() -> list[list]:
            """Lefts by the length of their sketches: (sizes in order, ids, components, sketches, whether they have a partner)."""
            levels: dict[int, list] = {}
            for row in sorted(kept, key=lambda x: x[0]):
                levels.setdefault(len(row[3]), []).append(row)
            return [[*map(np.array, list(zip(*x, strict=True))[:3]), np.stack([w for *_, w in x]), np.zeros(len(x), bool)] for x in levels.values()]

        def done() -> list[tuple[int, int]]:
            found = out | {s for _, sig, _, _, live in index or [] for s in sig[live].tolist()}
            return [(at[0], s) for s in found]

        for b in batches:
            rows = []
            for p, i, j, right, c, sig, n, body in b.itertuples(index=False):
                if (p, i, j) != at:
                    if at:
                        rows += done()
                    at, kept, index, out = (p, i, j), [], None, set()
                words = np.frombuffer(body, np.uint64)
                if not right:
                    kept.append((n, sig, c, words))
                    continue
                index = indexed() if index is None else index
                for sizes, _, component, sketched, live in index:
                    lo = np.searchsorted(sizes, -(-n * t.numerator // t.denominator))
                    hi = np.searchsorted(sizes, n * t.denominator // t.numerator, side="right")
                    if lo < hi:
                        good = may_link(sketched[lo:hi], words, sizes[lo:hi] + n, t) & (component[lo:hi] != c)
                        if good.any():
                            live[lo:hi] |= good
                            out.add(sig)
            if rows:
                yield pd.DataFrame(rows, columns=["psig", "sig"])
        if at and (rows := done()):
            yield pd.DataFrame(rows, columns=["psig", "sig"])

    rows = _blocked(members, sketches.select("sig", F.col("sketch").alias("body")), BLOCK * SKETCH_BLOCKS)
    return rows.mapInPandas(run, "psig long, sig long").distinct()


def _joins(heavy: DataFrame, found: DataFrame, sketches: DataFrame, bodies: Callable[[DataFrame], DataFrame], t: Fraction) -> DataFrame:
    """(a, b): components that links join which the first of the lists don't show.

    Lists whose other sets lie in several components are still open; those with the same first make a cluster. Sets that by
    their sketches link with none of another component leave it. Of what stays, the sets outside the main component are
    held against all, BLOCK by BLOCK: a task indexes the shingles of a block and runs the other block's sets over it, and
    only joined components come out, no pairs. bodies gives the sets (sig, body) of a table of names (sig).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept, index, up = None, [], None, {}

        def top(c: int) -> int:
            while up.get(c, c) != c:
                up[c] = up.get(up[c], up[c])
                c = up[c]
            return c

        for b in batches:
            out = []
            for p, i, j, right, c, _, _, body in b.itertuples(index=False):
                if (p, i, j) != at:
                    at, kept, index, up = (p, i, j), [], None, {}
                h = np.frombuffer(body, np.uint64)
                if not right:
                    kept.append((c, h))
                elif kept:
                    if index is None:
                        owner = np.repeat(np.arange(len(kept)), [len(x) for _, x in kept])
                        every = np.concatenate([x for _, x in kept])
                        order = np.argsort(every, kind="stable")
                        index = every[order], owner[order], np.array([len(x) for _, x in kept]), np.array([x for x, _ in kept])
                    keys, owner, many, own = index
                    lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
                    n = hi - lo
                    spots = np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                    inter = np.bincount(owner[spots], minlength=len(kept))
                    good = (inter * t.denominator >= t.numerator * (many + len(h) - inter)) & (own != c)
                    for x in set(own[good].tolist()):  # links that join nothing new in the block say nothing
                        a, z = sorted((top(c), top(x)))
                        if a != z:
                            up[z] = a
                            out.append((a, z))
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    names = found.select(F.col("node").alias("sig"), "component")
    own = F.coalesce("component", "sig").alias("component")
    members = written(skew_join(heavy.select("key", "sig", "n", "psig", "pn"), names, "sig").select("key", "sig", "n", "psig", "pn", own), "members")
    # a first was held against its entries; where a list has several firsts they are its members too
    several = written(members.groupBy("key").agg(F.min("psig").alias("lo"), F.max("psig").alias("hi")).where("lo <> hi").select("key"), "several")
    firsts = skew_join(members.select("key", F.col("psig").alias("sig"), F.col("pn").alias("n"), "psig", "pn"), several.withColumn("two", F.lit(True)), "key", "inner").drop("two").distinct()
    firsts = skew_join(written(firsts, "firsts"), names, "sig").select("key", "sig", "n", "psig", "pn", own)
    members = written(members.unionByName(firsts), "all-members")
    # the first of the whole list is the least of the firsts that its tasks gave
    keys = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct("pn", "psig")).alias("first")).where("lo <> hi")
    members = skew_join(members.drop("psig", "pn"), written(keys.select("key", F.col("first.psig").alias("psig")), "open-keys"), "key", "inner")
    members = written(members.select("psig", "sig", "n", "component").distinct(), "open")
    live = written(_partners(members, sketches, t), "live")
    members = written(members.join(live, ["psig", "sig"]).select("psig", "sig", "n", "component"), "live-members")
    return _blocked(members, bodies(live.select("sig").distinct()), BLOCK).mapInPandas(run, "a long, b long").distinct()


def _bodies(docs: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """(sig, a, chunk, body) for names (id, tkey, sig, a, chunk): the sets of these rows, computed again from their texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["sig", "a", "chunk"]].assign(body=[shingle_set(t, n).tobytes() for t in b["text"]])

    names = names.select(F.col("id").alias("_id"), F.col("tkey").alias("_tkey"), "sig", "a", "chunk")
    same = (F.col("tkey") == F.col("_tkey")) & F.col("id").eqNullSafe(F.col("_id"))
    few = names.count() <= MOST_BROADCAST
    rows = docs.join(F.broadcast(names) if few else names, same).select("sig", F.coalesce("a", "sig").alias("a"), F.coalesce("chunk", F.lit(-1)).alias("chunk"), "text")
    out = written(rows.mapInPandas(run, "sig long, a long, chunk int, body binary"), "bodies")
    return out.dropDuplicates(["sig"]) if out.count() > names.count() else out  # rows may be repeated


def _widened(found: DataFrame, links: DataFrame) -> DataFrame:
    """found, components (node, component), after links (a, b) of components or of nodes that are in none."""
    if links.isEmpty():
        return found
    joined = components(links).select(F.col("node").alias("component"), F.col("component").alias("wider"))
    every = found.select("node", "component").union(links.select("a", "a").union(links.select("b", "b"))).distinct()
    every = every.groupBy("node").agg(F.min("component").alias("component"))
    out = skew_join(written(every, "every"), written(joined, "joined"), "component")
    return written(out.select("node", F.coalesce("wider", "component").alias("component")), "components")


def _components(docs: DataFrame, n: int, threshold: Fraction) -> DataFrame:
    """(id, tkey, n, component_id, kept) of each row of docs (id, text, tkey); kept at the rows with the smallest id, null
    last, then tkey, of a component."""
    sizes = Sizes(threshold)
    light_to = sizes.boundary()
    rows = written(_sets(docs, n), "sets")
    name = F.struct(F.col("id").isNull().alias("none"), "id", "tkey")
    classes = written(rows.where("n > 0").groupBy("sig").agg(F.min(name).alias("name"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "classes")
    sketches, classes = classes.select("sig", "n", "sketch"), classes.select("sig", "name")
    rows = rows.drop("sketch")
    shingles = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTITIONS, shingles // PARTITION_SHINGLES))
    lists = written(_lists(_entries(docs, n, sizes, light_to), partitions), "lists")
    t = F.lit(threshold.numerator), F.lit(threshold.denominator)
    near = lambda a, b: F.col(a) * t[1] >= F.col(b) * t[0]  # noqa: E731  sizes that can link
    # a light list: the sets have the key's subset in common, all of one or all but one of the other
    common = F.when(F.col("n") == F.col("pn"), F.col("pn") - 1).otherwise(F.col("pn"))
    sure = lists.where("light").where(common * t[1] >= (F.col("pn") + F.col("n") - common) * t[0])
    sure = sure.select(F.col("psig").alias("a"), F.col("sig").alias("b"))
    heavy = lists.where(~F.col("light"))
    pairs = written(heavy.where(near("pn", "n")).select(F.col("psig").alias("a"), F.col("sig").alias("b")).distinct(), "pairs")
    pairs = written(_possible(pairs, sketches, threshold), "possible")
    # one pair for each set first: most of the others then lie within a component, and their sets needn't move; a set is
    # computed with its pair beside it, so it moves once
    one = _chunked(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    ends = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    names = classes.join(ends, "sig").join(one.withColumnRenamed("b", "sig"), "sig", "left")
    bodies = _bodies(docs, written(names.select("name.id", "name.tkey", "sig", "a", "chunk"), "ends"), n)
    sets = bodies.select("sig", "body")
    linked_ones = _verified(one, bodies.where("chunk >= 0").select("a", F.col("sig").alias("b"), "chunk", F.col("body").alias("hb")), sets, threshold)
    found = written(components(written(linked_ones.union(sure).distinct(), "links")), "components")
    rest = pairs.join(one.select("a", "b"), ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = skew_join(written(rest, "rest"), found.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end)
        rest = rest.withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    rest = written(rest.where("ca <> cb"), "across")
    more = _chunked(rest.select("a", "b"))
    second = more.join(sets.select(F.col("sig").alias("b"), F.col("body").alias("hb")), "b")
    links = _verified(more, second, sets, threshold).join(rest, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    found = _widened(found, written(links.distinct(), "links"))

    def others(live: DataFrame) -> DataFrame:
        names = classes.join(live, "sig").select("name.id", "name.tkey", "sig", F.lit(None).cast("long").alias("a"), F.lit(None).cast("int").alias("chunk"))
        return _bodies(docs, written(names, "others"), n).select("sig", "body")

    found = _widened(found, written(_joins(heavy, found, sketches, others, threshold), "joins"))
    # the least name of a component's classes
    named = classes.join(found.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    named = written(named, "named")
    least = written(named.groupBy("component").agg(F.min("name").alias("least")), "least")
    whole = written(skew_join(named, least, "component").select("sig", "least"), "whole")
    full = skew_join(rows.where("n > 0"), whole, "sig")
    kept = (F.col("tkey") == F.col("least.tkey")) & F.col("id").eqNullSafe(F.col("least.id"))
    full = full.select("id", "tkey", "n", F.col("least.id").alias("component_id"), kept.alias("kept"))
    return full.unionByName(rows.where("n = 0").select("id", "tkey", "n", F.col("id").alias("component_id"), F.lit(True).alias("kept")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tkey"))


def similar_groups(docs: DataFrame, n: int = 3, threshold: Fraction = Fraction(9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, n_shingles, component_id).

    Documents link when intersection / union of their shingle sets is at least threshold; component_id is the smallest id
    reachable by links. A document without words has an empty set and links with nothing; a null text is one. A null id
    stays null and its component is the smallest other id, or null. Equal texts link. Ids may repeat: rows are told apart by
    their texts too, and each has its own component. An empty table gives an empty result. Other columns play no part.
    """
    out = _components(_keyed(docs, id_col, text_col), n, threshold)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(8, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of similar ones, the one with the smallest id; the columns stay as they are.

    An id of null comes last; of rows with the same id the one with the smaller hash of the text stays, of rows with the
    same id and text one. Documents without words stay, as they are like nothing.
    """
    gone, tkey, own = fresh(docs, "_gone", "_tkey", "_own")
    found = written(_components(_keyed(docs, id_col, text_col), n, threshold).select(F.col("id").alias(gone), F.col("tkey").alias(tkey), "n", "kept"), "kept")
    rows = docs.withColumn(own, F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col(gone)) & (F.col(own) == F.col(tkey))
    # where these are few they are broadcast and the texts don't move
    drop = written(found.where(~F.col("kept")).select(gone, tkey).distinct(), "near")
    out = rows.join(F.broadcast(drop) if drop.count() <= MOST_BROADCAST else drop, same, "left_anti")
    again = written(found.where("kept and n > 0").groupBy(gone, tkey).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    if not again.isEmpty():  # rows with the same id and text
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([id_col, own]))
    return out.drop(own)
