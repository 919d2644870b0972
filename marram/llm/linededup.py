"""Line dedup by distinct-site spread: lines that many sites carry are boilerplate and are removed.

A HyperLogLog sketch of the sites of each line merges by aggregation. Lines whose estimate is near the threshold get an
exact distinct count; the others are decided by the estimate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm.common import SPACE, fresh, skew_join, written

#: Sites from which on a line is boilerplate; the sketch's size (2^LG registers, relative error 1.04 / 2^(LG/2)); how many
#: such errors, and at least how many sites, around the threshold get exact counts.
LEAST_SITES, LG, ERRORS, LEAST_BAND = 10, 11, 4.0, 2.0
#: Bits of the filter of near-threshold lines: 16 a line, up to 2^30 (128 MB, which bounds the broadcast).
BITS_A_LINE, MOST_BITS = 16, 30
#: Line hashes that are broadcast at most, 8 bytes each; beyond that lines are joined to them.
MOST_BROADCAST = 1_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hash_of(line: Column) -> Column:
    """Hash of a line without white space around it; null for a line of white space."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare != "", F.xxhash64(bare))


def among(lines: DataFrame):
    """Whether a hash may be among those of lines, a written table: a filter that never misses one, its size bounded."""
    spark, n = lines.sparkSession, lines.count()
    bits = min(MOST_BITS, max(16, (BITS_A_LINE * n).bit_length()))

    def places(h: np.ndarray) -> np.ndarray:
        return (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    held = np.zeros((1 << bits) // 8, np.uint8)
    for b in lines.select("line").coalesce(max(1, n // 1_000_000)).mapInPandas(lambda it: (pd.DataFrame({"at": [np.unique(places(x["line"].to_numpy())).astype("<i8").tobytes()]}) for x in it), "at binary").toLocalIterator():
        at = np.frombuffer(b["at"], "<i8")
        np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
    shared = spark.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def look(line: pd.Series) -> pd.Series:
        at = places(line.to_numpy())
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0)

    return look


def wide_lines(docs: DataFrame, least_sites: int = LEAST_SITES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(line, sites): hashes of lines on at least least_sites different sites. A null site is none.

    Sketches are merged for all lines. Pairs of line and site are made for lines near the threshold only: a filter of their
    hashes keeps the others from being shuffled.
    """
    rows = docs.where(F.col(site_col).isNotNull()).select(F.col(site_col).cast("string").alias("site"), F.explode(F.array_distinct(F.transform(lines_of(F.col(text_col)), hash_of))).alias("line")).where("line is not null")
    spread = rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG)).alias("sites"))
    band = max(LEAST_BAND, ERRORS * 1.04 / 2 ** (LG / 2) * least_sites)
    maybe = written(spread.where(F.col("sites") >= least_sites - band), "spread")
    near = written(maybe.where(F.col("sites") < least_sites + band).select("line", F.lit(True).alias("near")), "near")
    # distinct before the join: a pair of line and site comes once from a task, however often the line does
    pairs = written(rows.where(among(near)("line")).distinct(), "line-sites")
    exact = skew_join(pairs, near, "line", "inner").groupBy("line").agg(F.count("*").alias("sites"))
    sure = maybe.where(F.col("sites") >= least_sites + band).select("line", F.col("sites").cast("long").alias("sites"))
    return sure.unionByName(exact.where(F.col("sites") >= least_sites))


def flags(spark: SparkSession, held: np.ndarray):
    """For arrays of line hashes, which of them are among the sorted held ones."""
    shared = spark.sparkContext.broadcast(held)

    @F.pandas_udf("array<boolean>")
    def look(hashes: pd.Series) -> pd.Series:
        if not len(hashes):
            return pd.Series([], dtype=object)
        flat = np.concatenate(list(hashes))
        at = np.searchsorted(shared.value, flat)
        hit = shared.value[np.minimum(at, len(shared.value) - 1)] == flat if len(shared.value) else np.zeros(len(flat), bool)
        return pd.Series(np.split(hit, np.cumsum([len(h) for h in hashes])[:-1]))

    return look


def without_wide_lines(docs: DataFrame, least_sites: int = LEAST_SITES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with the boilerplate lines taken out of the text, and with one more column, removed: how many lines went.

    A line is compared without white space around it; lines of white space always stay, as does the order of lines. A null
    text stays null. Ids play no part, so they may repeat or be null. Where the boilerplate is at most MOST_BROADCAST lines
    it is broadcast and the rows don't move; else the places of lines are joined to it, and to the rows by the digest of
    the text, on which alone they depend: the results are the same.
    """
    (removed,) = fresh(docs, "removed")
    wide = written(wide_lines(docs, least_sites, text_col, site_col).select("line"), "wide")
    lines = lines_of(F.col(text_col))
    if wide.count() <= MOST_BROADCAST:
        held = np.sort(np.array([r["line"] for r in wide.collect()], np.int64))  # bounded by the count above
        (gone,) = fresh(docs, "_gone")
        # 0 stands for a line of white space; no text is known whose hash is 0, and such a line would stay
        hashes = F.transform(lines, lambda x: F.coalesce(hash_of(x), F.lit(0).cast("long")))
        out = docs.withColumn(gone, flags(docs.sparkSession, held[held != 0])(hashes))
        kept = F.filter(lines, lambda x, i: ~F.get(gone, i))
        count = F.size(F.filter(gone, lambda x: x))
        return out.withColumn(removed, F.coalesce(count, F.lit(0)).cast("long")).withColumn(text_col, F.when(F.col(removed) > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))).drop(gone)
    key, own, at = fresh(docs, "_key", "_own", "_at")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    places = docs.select(digest.alias(key), F.posexplode(F.transform(lines, hash_of)).alias(at, "line")).where(F.col("line").isNotNull()).where(among(wide)("line"))
    hits = skew_join(written(places.distinct(), "places"), wide.withColumn("wide", F.lit(True)), "line", "inner")
    hits = written(hits.groupBy(key).agg(F.sort_array(F.collect_set(at)).alias(at)), "hits")  # lines of one text
    out = skew_join(written(docs.withColumn(own, digest), "lined"), hits.withColumnRenamed(key, own), own)
    taken = F.coalesce(F.col(at), F.array().cast("array<int>"))
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: ~F.array_contains(taken, y["i"]))
    return out.withColumn(removed, F.size(taken).cast("long")).withColumn(text_col, F.when(F.col(removed) > 0, F.array_join(F.transform(kept, lambda y: y["x"]), "\n")).otherwise(F.col(text_col))).drop(own, at)
