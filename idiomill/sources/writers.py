"""Sinks: line files, arrays, numbered chunks, tables."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.match import chunked, ordinals


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists", compress: bool = False) -> None:
    df.write.mode(mode).option("compression", "gzip" if compress else "none").json(path)


def json_array(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """One file that holds one JSON array; for reports, which are small."""
    cell = F.struct(*(F.col(c) for c in order), F.to_json(F.struct(*df.columns)).alias("_json"))
    rows = df.agg(F.array_sort(F.collect_list(cell)).alias("a"))
    text = F.concat(F.lit("[\n"), F.array_join(F.transform("a", lambda x: x["_json"]), ",\n"), F.lit("\n]"))
    rows.select(text.alias("value")).coalesce(1).write.mode(mode).text(path)


def chunks(df: DataFrame, path: str, size: int = 10_000, compress: bool = True, key: str = "doc_index", mode: str = "overwrite") -> None:
    """Folders chunk_id=N of exactly size rows each, in order of key; overwriting drops earlier chunks."""
    out = chunked(df, size, key)
    out.repartition(F.col("chunk_id")).sortWithinPartitions("chunk_id", key).write.mode(mode).partitionBy("chunk_id").option("compression", "gzip" if compress else "none").json(path)


def rolling(df: DataFrame, path: str, size: int = 10_000, mode: str = "overwrite") -> None:
    """Files of at most size rows, without a shuffle."""
    df.write.mode(mode).option("maxRecordsPerFile", size).option("compression", "gzip").json(path)


def vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def csv(df: DataFrame, path: str, mode: str = "overwrite", mark: bool = True) -> None:
    """Flat rows with a header; nested columns as JSON. mark: files begin with a byte order mark, as spreadsheets expect."""
    nested = [F.to_json(n).alias(n) if t.startswith(("array", "map", "struct")) else F.col(n) for n, t in df.dtypes]
    out = df.select(*nested)
    if mark:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    out.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def vector_store(df: DataFrame, path: str, rows: int = 100_000, key: str = "vec_id", vector: str = "embedding") -> None:
    """Vectors in half precision: numbered .npz files of at most rows vectors each, and a _meta.json beside each with the other columns.

    Files are made in tasks and pass through the driver one at a time, as they are no
    format that Spark writes.
    """
    spark = df.sparkSession
    others = [c for c in df.columns if c != vector]
    parted = ordinals(df, key, name="_at").withColumn("_file", F.floor(F.col("_at") / rows).cast("long"))
    meta = parted.select("_file", "_at", F.to_json(F.struct(*others)).alias("meta"), F.col(vector).cast("array<float>").alias("v"))
    made = meta.groupBy("_file").applyInArrow(_npz, "name string, data binary, meta string")
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in made.toLocalIterator():
        for ending, data in ((".npz", bytes(r.data)), ("_meta.json", r.meta.encode())):
            out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{r.name}{ending}"), True)
            try:
                out.write(data)
            finally:
                out.close()


def _npz(key, t):
    order = np.argsort(t.column("_at").to_numpy())
    vectors = np.array(t.column("v").to_pylist(), np.float32)[order].astype(np.float16)
    meta = t.column("meta").to_pylist()
    data = io.BytesIO()
    np.savez_compressed(data, embeddings=vectors)
    text = "[" + ",".join(meta[k] for k in order.tolist()) + "]"
    return pa.table({"name": [f"vectors-{key[0].as_py():06d}"], "data": pa.array([data.getvalue()], pa.binary()), "meta": [text]})


def counts(df: DataFrame, language: str, total: int, path: str, mode: str = "overwrite") -> bool:
    """The report of document counts, most frequent first; nothing is written without a count."""
    if df.isEmpty():
        return False
    entry = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("doc_count"), "idiom", "doc_count"))), lambda x: F.struct(x["idiom"], x["doc_count"])))
    row = df.agg(F.lit(language).alias("lang"), F.lit(total).alias("total_docs_searched"), F.count("*").alias("total_idioms_found"), entry.alias("idiom_doc_counts"))
    row.coalesce(1).write.mode(mode).json(path)
    return True


def run_summary(parts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One summary for the run, whatever the number of languages."""
    parts.coalesce(1).write.mode(mode).json(path)


def appended(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
