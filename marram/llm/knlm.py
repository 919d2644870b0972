"""Interpolated modified Kneser-Ney language model: counted in Spark, kept as sorted hash arrays, memory-mapped for scoring.

A bigram model: P(w | v) = (c(v w) - D) / c(v .) + gamma(v) P(w), P(w) from the number of different words before w,
P of any other word from the same with none. Counts are over all training texts. The arrays lie in the shared folder, one
set for each shard of the hashes; workers map them and look up batches of hashes, so a worker's own memory stays small.
"""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.llm.common import shared_folder

#: Characters of training text for each shard of the arrays; tokens counted at once, and scored at once.
SHARD_CHARS, COUNT_TOKENS, SCORE_TOKENS = 24_000_000, 3_000_000, 300_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Hashes of the mark before a text and of the one end after it; words hash to other seeds.
BEGIN, END = xxhash.xxh3_64_intdigest(b"begin", seed=1), xxhash.xxh3_64_intdigest(b"end", seed=1)


def tokens(text: str) -> np.ndarray:
    """Hashes of the begin mark, the words with A-Z in lower case, and the end."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(words) + 2, np.uint64)
    out[0], out[-1] = BEGIN, END
    out[1:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return out


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of bigrams."""
    h = (v ^ (v >> np.uint64(31))) * _B + w * _A
    h = (h ^ (h >> np.uint64(29))) * _C
    return h ^ (h >> np.uint64(32))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of values of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return (key[starts], *(np.add.reduceat(v[order], starts) if len(key) else v for v in values))


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Whole files or none: a task that is run again writes the same ones."""
    for k, a in arrays.items():
        part = f"{folder}/{name}.{k}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            np.save(f, a)
        os.replace(part, f"{folder}/{name}.{k}.npy")


def _mapped(where: str) -> np.ndarray | None:
    """An array in a mapped file, or None for an empty one. No file stays open, as there is one for each shard and array."""
    with open(where, "rb") as f:
        np.lib.format.read_magic(f)
        shape, _, kind = np.lib.format.read_array_header_1_0(f)
        at = f.tell()
        if not np.prod(shape):
            return None
        held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))
    return np.frombuffer(held, kind, offset=at).reshape(shape)


def _by_shard(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list]]:
    """The rows of each shard together; rows come sorted by shard."""
    at, held = None, []
    for b in batches:
        for row in b.itertuples(index=False):
            if row.shard != at:
                if at is not None:
                    yield at, held
                at, held = row.shard, []
            held.append(row)
    if at is not None:
        yield at, held


def _count(batches: Iterator[pd.DataFrame], shards: int) -> Iterator[pd.DataFrame]:
    """(shard, first, runs, second, n): bigram counts of some millions of tokens at a time, as packed arrays."""

    def packed(parts: list[np.ndarray]) -> pd.DataFrame:
        v, w = np.concatenate([p[:-1] for p in parts]), np.concatenate([p[1:] for p in parts])
        order = np.lexsort((w, v))
        v, w = v[order], w[order]
        starts = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
        n = np.diff(np.append(starts, len(v))).astype("<u4")
        v, w = v[starts], w[starts]
        shard = shard_of(pair(v, w), shards)
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(shards + 1))
        out = []
        for k in np.flatnonzero(np.diff(edges)):
            at = order[edges[k] : edges[k + 1]]
            runs = np.flatnonzero(np.append(True, v[at][1:] != v[at][:-1]))
            small = np.minimum(n[at], 255).astype(np.uint8)
            out.append((int(k), v[at][runs].tobytes(), np.diff(np.append(runs, len(at))).astype("<u4").tobytes(), w[at].tobytes(), small.tobytes(), n[at][small == 255].tobytes()))
        return pd.DataFrame(out, columns=["shard", "first", "runs", "second", "small", "large"])

    parts, held = [], 0
    for b in batches:
        for t in b["text"]:
            parts.append(tokens(t))
            held += len(parts[-1])
            if held > COUNT_TOKENS:
                yield packed(parts)
                parts, held = [], 0
    if parts:
        yield packed(parts)


def _unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    v = np.repeat(np.frombuffer(row.first, np.uint64), np.frombuffer(row.runs, "<u4"))
    n = np.frombuffer(row.small, np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(row.large, "<u4")
    return v, np.frombuffer(row.second, np.uint64), n


def _halves(facts: np.ndarray) -> tuple[bytes, bytes]:
    """Whole numbers as 4 bytes each, and (place, upper 4 bytes) of the few that need more."""
    flat = facts.ravel()
    large = np.flatnonzero(flat >> 32)
    return flat.astype("<u4").tobytes(), np.stack((large, flat[large] >> 32)).astype("<i8").tobytes()


def _joined(facts: bytes, high: bytes) -> np.ndarray:
    out = np.frombuffer(facts, "<u4").astype(np.int64)
    at, upper = np.frombuffer(high, "<i8").reshape(2, -1)
    out[at] += upper << 32
    return out.reshape(5, -1)


def _merge_pairs(batches: Iterator[pd.DataFrame], folder: str, shards: int) -> Iterator[pd.DataFrame]:
    """Write each shard's bigrams; hand out what they say of their words, and how many have counts of 1 to 4."""
    for k, rows in _by_shard(batches):
        v, w, n = (np.concatenate(x) for x in zip(*map(_unpacked, rows), strict=True))
        key = pair(v, w)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        n = np.add.reduceat(n[order], starts)
        at = order[starts]
        v, w, key = v[at], w[at], key[at]
        small = np.minimum(n, 255).astype(np.uint8)
        _save(folder, f"pairs-{k}", key=key, n=small, over=n[small == 255])
        after, before, count = _sums(w, np.ones(len(w), np.int64), n)
        follow, *kinds = _sums(v, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))
        words = np.concatenate((after, follow))
        zero_a, zero_f = np.zeros(len(after), np.int64), np.zeros(len(follow), np.int64)
        facts = [np.concatenate(x) for x in ((count, zero_f), (before, zero_f), *((zero_a, x) for x in kinds))]
        word, *facts = _sums(words, *facts)
        shard = shard_of(word, shards)
        edges = np.searchsorted(shard, np.arange(shards + 1))
        out = [(int(s), word[a:z].tobytes(), *_halves(np.stack([x[a:z] for x in facts]))) for s in np.flatnonzero(np.diff(edges)) for a, z in [edges[s : s + 2]]]
        out.append((shards, np.array([(n == i).sum() for i in (1, 2, 3, 4)], "<i8").tobytes(), b"", b""))
        yield pd.DataFrame(out, columns=["shard", "word", "facts", "high"])


def _merge_words(batches: Iterator[pd.DataFrame], folder: str, shards: int) -> Iterator[pd.DataFrame]:
    """Write each shard's words with count, words before, and words after by count 1, 2, more; hand out the sums."""
    for k, rows in _by_shard(batches):
        if k == shards:
            sums = sum(np.frombuffer(r.word, "<i8") for r in rows)
            yield pd.DataFrame([["pairs", *map(int, sums), 0, 0, 0]], columns=list("kabcdefg"))
            continue
        word = np.concatenate([np.frombuffer(r.word, np.uint64) for r in rows])
        facts = np.concatenate([_joined(r.facts, r.high) for r in rows], axis=1)
        word, *facts = _sums(word, *facts)
        _save(folder, f"words-{k}", key=word, facts=np.stack(facts))
        count, before = facts[0], facts[1]
        yield pd.DataFrame([["words", *(int((before == i).sum()) for i in (1, 2, 3, 4)), int(count.sum()), int((count > 0).sum()), int(before.sum())]], columns=list("kabcdefg"))


def discounts(n: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2, more from how many have counts 1 to 4; each from 0 to its count."""
    out = [0.0]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    for i in (1, 2, 3):
        out.append(min(float(i), max(0.0, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] and n[i] else 0.5 * i)
    return np.array(out)


class Model:
    """A trained model: where its arrays are, and the sums that scores need. Small, and sent to the workers as it is."""

    def __init__(self, folder: str, shards: int, rows: list):
        self.folder, self.shards = folder, shards
        sums = {"pairs": np.zeros(7, np.int64), "words": np.zeros(7, np.int64)}
        for r in rows:
            sums[r[0]] += np.array(r[1:], np.int64)
        self.n_tokens, self.n_words, self.n_types = (int(x) for x in sums["words"][4:7])
        self.pair_d, self.word_d = discounts(sums["pairs"][:4].tolist()), discounts(sums["words"][:4].tolist())
        more = self.n_words - int(sums["words"][:2].sum())
        self.left = float(self.word_d[1] * sums["words"][0] + self.word_d[2] * sums["words"][1] + self.word_d[3] * more) / max(1, self.n_types) if self.n_types else 1.0
        self.maps: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"maps": {}}

    def _map(self, name: str, k: int, part: str) -> np.ndarray | None:
        where = f"{self.folder}/{name}-{k}.{part}.npy"
        if where not in self.maps:
            self.maps[where] = _mapped(where) if os.path.exists(where) else None
        return self.maps[where]

    def _find(self, name: str, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, places in h, places in its arrays) for the sorted distinct hashes h that the arrays have."""
        edges = np.searchsorted(shard_of(h, self.shards), np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(edges)):
            key = self._map(name, k, "key")
            if key is not None:
                part = h[edges[k] : edges[k + 1]]
                at = np.searchsorted(key, part)
                hit = np.flatnonzero(key[np.minimum(at, len(key) - 1)] == part)
                yield int(k), hit + edges[k], at[hit]

    def words(self, h: np.ndarray) -> np.ndarray:
        """Facts of words, in rows; zeros for others. h is sorted and distinct."""
        out = np.zeros((5, len(h)), np.int64)
        for k, to, at in self._find("words", h):
            out[:, to] = self._map("words", k, "facts")[:, at]
        return out

    def pairs(self, h: np.ndarray) -> np.ndarray:
        """Counts of bigrams. h is sorted and distinct."""
        out = np.zeros(len(h), np.int64)
        for k, to, at in self._find("pairs", h):
            n = self._map("pairs", k, "n")
            got = n[at].astype(np.int64)
            large = np.flatnonzero(got == 255)
            if len(large):
                if ("over", k) not in self.maps:
                    self.maps["over", k] = np.flatnonzero(np.asarray(n) == 255)
                over = self.maps["over", k]
                got[large] = self._map("pairs", k, "over")[np.searchsorted(over, at[large])]
            out[to] = got
        return out

    def score(self, texts: list[str]) -> Iterator[tuple[int, int, float, float]]:
        """(tokens, known tokens, base score, score) of each text."""
        parts = [tokens(t) for t in texts]
        v, w = np.concatenate([p[:-1] for p in parts]), np.concatenate([p[1:] for p in parts])
        every, place = np.unique(np.concatenate((v, w)), return_inverse=True)
        facts = self.words(every)
        v_at, w_at = place[: len(v)], place[len(v) :]
        keys, place = np.unique(pair(v, w), return_inverse=True)
        n = self.pairs(keys)[place]
        count, before, one, two, more = facts
        floor = self.left / (self.n_words + 1)
        p_word = (before - self.word_d[np.minimum(before, 3)]) / max(1, self.n_types) + floor
        follow = count.copy()
        follow[every == np.uint64(END)] = 0
        begin = every == np.uint64(BEGIN)
        follow[begin] = int(facts[0][every == np.uint64(END)].sum())  # a text begins as often as it ends
        held = self.pair_d[1] * one + self.pair_d[2] * two + self.pair_d[3] * more
        gamma = np.where(follow > 0, held / np.maximum(1, follow), 1.0)
        p = np.maximum(0, n - self.pair_d[np.minimum(n, 3)]) / np.maximum(1, follow[v_at]) + gamma[v_at] * p_word[w_at]
        c = count[w_at]
        base = np.log10((c + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1)))
        ends = np.cumsum([len(x) - 1 for x in parts])
        starts = np.append(0, ends[:-1])
        yield from zip(np.diff(np.append(0, ends)), np.add.reduceat((c > 0).astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(p), starts), strict=True)


def train(texts: DataFrame, text_col: str = "text") -> Model:
    """Count all rows of texts; a null text is empty and has the end alone. The shared folder must be mounted everywhere."""
    spark = texts.sparkSession
    where = urlparse(shared_folder(spark))
    if where.scheme not in ("", "file"):
        raise ValueError(f"workers can map files of a mounted shared folder only, not of {where.geturl()}")
    folder = f"{where.path}/marram-knlm-{uuid.uuid4().hex}"
    os.makedirs(folder)
    rows = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = 1 + int(rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // SHARD_CHARS
    pairs = rows.mapInPandas(lambda it: _count(it, shards), "shard int, first binary, runs binary, second binary, small binary, large binary")
    # a task merges one shard
    pairs = pairs.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard")
    words = pairs.mapInPandas(lambda it: _merge_pairs(it, folder, shards), "shard int, word binary, facts binary, high binary")
    words = words.repartitionById(shards + 1, F.col("shard")).sortWithinPartitions("shard")
    sums = words.mapInPandas(lambda it: _merge_words(it, folder, shards), "k string, a long, b long, c long, d long, e long, f long, g long")
    return Model(folder, shards, [tuple(r) for r in sums.collect()])  # a row for each shard


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id_col, n_tokens, n_known, base_score, score, perplexity).

    The scores are log10 probabilities of the whole text with its end; a null text is empty. Other columns play no part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, held, size = [], [], 0
            for i, t in zip(b["id"], b["text"], strict=True):
                ids.append(i)
                held.append(t)
                size += len(t)
                if size > 6 * SCORE_TOKENS:
                    yield out(ids, held, b["id"].dtype)
                    ids, held, size = [], [], 0
            if held:
                yield out(ids, held, b["id"].dtype)

    def out(ids: list, texts: list[str], kind) -> pd.DataFrame:
        x = pd.DataFrame(model.score(texts), columns=["n_tokens", "n_known", "base_score", "score"])
        return x.assign(id=pd.Series(ids, dtype=kind), perplexity=10 ** (-x["score"] / x["n_tokens"]))[["id", "n_tokens", "n_known", "base_score", "score", "perplexity"]]

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, n_tokens long, n_known long, base_score double, score double, perplexity double").withColumnRenamed("id", id_col)


def held_out(id_col: str, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id doesn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
