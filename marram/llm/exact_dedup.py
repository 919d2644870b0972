"""Exact duplicates: two passes over a Bloom filter of text hashes; only hashes that may repeat are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm.common import SPACE, fresh, skew_join, written

#: The filter has 16 bits a row, from 2^16 up to 2^31 bits (256 MB, which bounds the broadcast). With a billion rows, 2 bits
#: each, 6 % of the unique rows pass it and are shuffled too, with 300 million 1 %; the results are exact at every size.
#: Executors with more memory take a larger most_bits.
BITS_A_ROW, LEAST_BITS, MOST_BITS = 16, 16, 31
#: Bits of one row of the merged filter.
BLOCK = 1 << 15


def normal(text: Column) -> Column:
    """The text that is compared: without the characters of white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, chars, sha): a number for each row, code points of the original text, SHA-256 of the normalised one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.length(text).cast("long").alias("chars"), F.sha2(normal(text), 256).alias("sha"))


def _positions(sha: pd.Series, bits: int) -> np.ndarray:
    """Two positions in the filter for each hash."""
    raw = np.frombuffer(bytes.fromhex("".join(sha.str.slice(0, 32))), dtype=">u8").reshape(-1, 2)
    return (raw >> np.uint64(64 - bits)).astype(np.int64)


def repeat_filter(rows: DataFrame, bits: int) -> np.ndarray:
    """First pass: the bytes of a filter that holds what at least two rows have set.

    Each task folds its rows into a filter seen-once and one seen-twice and hands out the blocks that aren't empty; blocks
    of the same place meet in one task, which folds them one after another.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [np.sort(_positions(b["sha"], bits).ravel() if len(b) else np.zeros(0, np.int64)) for b in batches]
        spots, times = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
        edges = np.searchsorted(spots, np.arange(0, (1 << bits) + 1, BLOCK))
        for k in np.flatnonzero(np.diff(edges)):
            part = slice(edges[k], edges[k + 1])
            inside = (spots[part] - k * BLOCK).astype("<u2")
            yield pd.DataFrame({"block": [int(k)], "once": [inside.tobytes()], "twice": [inside[times[part] > 1].tobytes()]})

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, once, twice = None, None, None

        def done() -> pd.DataFrame:
            return pd.DataFrame({"block": [at], "bits": [np.packbits(twice).tobytes()]})

        for b in batches:
            for k, o, t in zip(b["block"], b["once"], b["twice"], strict=True):
                if k != at:
                    if at is not None and twice.any():
                        yield done()
                    at, once, twice = k, np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
                o = np.frombuffer(o, "<u2")
                twice[o[once[o]]] = True
                twice[np.frombuffer(t, "<u2")] = True
                once[o] = True
        if at is not None and twice.any():
            yield done()

    blocks = rows.select("sha").mapInPandas(partial, "block int, once binary, twice binary")
    blocks = blocks.repartition("block").sortWithinPartitions("block").mapInPandas(merge, "block int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in blocks.toLocalIterator():  # together no more than the filter, whose size is bounded
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def may_repeat(spark: SparkSession, table: np.ndarray, bits: int) -> Callable[[Column], Column]:
    """Second pass: whether the filter says that a hash may come twice; it never misses one that does."""
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def look(sha: pd.Series) -> pd.Series:
        held, at = shared.value, _positions(sha, bits)
        return pd.Series(((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1))

    return look


def _filter(rows: DataFrame, most_bits: int) -> Callable[[Column], Column]:
    bits = min(most_bits, max(LEAST_BITS, (BITS_A_ROW * rows.count()).bit_length()))
    return may_repeat(rows.sparkSession, repeat_filter(rows, bits), bits)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of docs: (id_col, keep_id, group_size, kept, text_sha256).

    Texts are equal when they are identical without white space; a null text counts as empty, and empty texts are equal to
    each other. Of each group exactly one row stays: the one with the most code points in its original text, then the
    smallest id, an id of null last, then any of the rows that have the same id. Ids may be of any type with an order. An
    empty table gives an empty result. Other columns of docs play no part.
    """
    rows = written(digests(docs, id_col, text_col), "digests")
    maybe = _filter(rows, most_bits)
    tagged = written(rows.withColumn("maybe", maybe("sha")), "tagged")
    again = tagged.where("maybe").drop("maybe")
    first = F.min(F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("none"), F.col("id"), F.col("row")))
    groups = again.groupBy("sha").agg(F.count("*").alias("group_size"), first.alias("first"))
    groups = written(groups.select("sha", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")), "groups")
    alone = tagged.where(~F.col("maybe")).select("id", "row", "chars", "sha", F.lit(1).cast("long").alias("group_size"), F.col("id").alias("keep_id"), F.col("row").alias("keep_row"))
    both = skew_join(again, groups, "sha").unionByName(alone)
    return both.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """docs with one row of each group of equal texts, the one that exact_groups keeps; the columns stay as they are.

    Rows whose hash can't repeat pass straight through; only the others are shuffled with their texts, one row of a group
    from each task. Of rows with the same text and id the one with the smallest hash of all its columns stays.
    """
    sha, may, one = fresh(docs, "_sha", "_may", "_one")
    rows = written(digests(docs, id_col, text_col).select("sha"), "hashes")
    maybe = _filter(rows, most_bits)
    tagged = docs.withColumn(sha, F.sha2(normal(F.col(text_col)), 256)).withColumn(may, maybe(F.col(sha)))
    alone = tagged.where(~F.col(may)).drop(sha, may)
    chars = F.length(F.coalesce(F.col(text_col), F.lit("")))
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = F.struct(-chars, F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*plain))
    again = tagged.where(F.col(may)).groupBy(sha).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias(one))
    return alone.unionByName(again.select(f"{one}.*"))
