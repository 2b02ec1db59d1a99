"""The corpus filter as a stream: files come in, matching documents and counts go out.

Checkpoints take the place of offsets: a stopped run goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import match


def documents(spark: SparkSession, folder: str, schema: str, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def matching(stream: DataFrame, pats: DataFrame, language: str = "en") -> DataFrame:
    """Stream of (doc_id, idiom): the pairs of the batch join, by its strategies that keep no state.

    Small phrase lists are joined by contains, others searched by the automaton.
    """
    body = F.coalesce(F.lower("text") if language == "en" else F.col("text"), F.lit(""))
    if match.strategy_for(pats.limit(match.NESTED + 1).count()) == "nested":
        return stream.join(F.broadcast(pats), F.contains(body, F.col("pattern"))).select("doc_id", "idiom")
    return match.searched(stream, pats, body, "doc_id").select("doc_id", "idiom")


def run_filter(stream: DataFrame, pats: DataFrame, out: str, checkpoint: str, language: str = "en") -> StreamingQuery:
    """Writes (doc_id, pattern, idiom) of every new file, by the batch strategies; a batch that is repeated replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        match.match(batch, pats, language).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_counts(stream: DataFrame, pats: DataFrame, name: str, checkpoint: str, language: str = "en") -> StreamingQuery:
    """Keeps document counts of each idiom as a table in memory; state is one number for each idiom."""
    counted = matching(stream, pats, language).groupBy("idiom").agg(F.count("*").alias("doc_count"))
    return counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unique_prefix(stream: DataFrame, length: int = 500, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Documents whose first characters are new. With (time column, delay) the state forgets what is older."""
    keyed = stream.withColumn("_head", F.substring(F.coalesce("text", F.lit("")), 1, length))
    if watermark:
        return keyed.withWatermark(*watermark).dropDuplicatesWithinWatermark(["_head"]).drop("_head")
    return keyed.dropDuplicates(["_head"]).drop("_head")


def unprocessed(batch: DataFrame, done: DataFrame, key: str = "index") -> DataFrame:
    return batch.join(done.select(key).distinct(), key, "left_anti")


def windowed_counts(stream: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", time: str = "ts", by: str = "event_type") -> DataFrame:
    """Extension: events in tumbling or sliding windows, with a watermark for late ones."""
    win = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, delay).groupBy(win.alias("w"), by).agg(F.count("*").alias("n")).select("w.start", "w.end", by, "n")
