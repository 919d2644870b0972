"""New hits as a stream: stateless filters and scores, one of a key in a while, and ranking batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marram.functions import urls
from marram.operators.ranking import dedup_candidates, top_k


def stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files).load(path)


def fresh_hits(hits: DataFrame, at: str = "seen_at", within: str = "15 minutes") -> DataFrame:
    """Hits with canonical URLs, each (request_id, url) once within the time: the state is as large as that time's keys."""
    rows = hits.withColumn("url", urls.canonical_url(F.col("url"))).where(F.col("url").isNotNull())
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark(["request_id", "url"])


def engine_counts(hits: DataFrame, at: str = "seen_at", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Hits per engine and window; windows end when the watermark has passed them."""
    return hits.withWatermark(at, late).groupBy(F.window(at, window), "engine").agg(F.count("*").alias("hits"))


def rank_batches(hits: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], k: int = 30) -> StreamingQuery:
    """Rank each micro-batch's candidates and hand them to write(batch, number); a batch that comes again has its number."""

    def one(batch: DataFrame, number: int) -> None:
        best = dedup_candidates(batch, ["request_id", "url"])
        write(top_k(best, [F.desc("discovery_score"), F.col("first_seen_ix")], k, ["request_id"]), number)

    return hits.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
