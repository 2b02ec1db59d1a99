"""Sources: line files of several habits, dictionaries, tables and vectors."""

from __future__ import annotations

import io
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import jsonx, text as X

CORRUPT = "_corrupt_record"


def jsonl(spark: SparkSession, path, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank ones are skipped. A broken line fails a strict read and is dropped otherwise."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    kept = spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return kept.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def json_array(spark: SparkSession, path, schema: str) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_member(spark: SparkSession, path, member: str, schema: str) -> DataFrame:
    """The rows of an array that is a member of the file's one JSON object."""
    whole = spark.read.schema(f"{member} array<struct<{_struct(schema)}>>").option("multiLine", True).json(path)
    return whole.select(F.posexplode(member).alias("pos", "r")).select("pos", "r.*")


def _struct(ddl: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields)


def idiom_set(rows: DataFrame, precedence: bool = False) -> DataFrame:
    """Distinct names that are not empty: the row's, or with precedence the output's where there is one."""
    name = F.when(F.col("output").isNotNull(), F.col("output.idiom")).otherwise(F.col("idiom")) if precedence else F.col("idiom")
    return rows.select(name.alias("idiom")).where("idiom <> ''").distinct()


def with_output(rows: DataFrame) -> DataFrame:
    return rows.where("output is not null")


def with_figurative(rows: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Rows (idiom, index, output as JSON text) that have a figurative meaning, flat; a missing index is -1."""
    part = lambda name: F.get_json_object("output", f"$.{name}")
    flat = {n: F.coalesce(jsonx.strings(part(n), keep_empty), F.array().cast("array<string>")) for n in ("entities", "literal_meanings", "figurative_meanings")}
    name = F.coalesce(X.non_empty(part("idiom")), F.col("idiom"))
    out = rows.where("output is not null").select(F.coalesce("index", F.lit(-1)).cast("long").alias("index"), name.alias("idiom"), *(c.alias(n) for n, c in flat.items()))
    return out.where(F.size("figurative_meanings") > 0)


def culture_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV tables with the tag of their file name, one below the other; null becomes the empty string. Without a path it is an error."""
    if not paths:
        raise FileNotFoundError("no culture table")
    parts = []
    for p in paths:
        read = spark.read.csv(p, header=True, multiLine=True, escape='"')
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        parts.append(read.withColumn("source", X.source_tag(name)).withColumnRenamed("cultural group", "cultural_group"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.na.fill("")


def key_value_lines(spark: SparkSession, path) -> DataFrame:
    """(key, value) of lines cut at their first comma; lines without one are skipped."""
    cut = F.split("value", ",", 2)
    return spark.read.text(path).where(F.col("value").contains(",")).select(X.strip(cut[0]).alias("key"), X.strip(cut[1]).alias("value"))


def tsv(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("sep", "\t")
    return (reader.schema(schema) if schema else reader).csv(path)


def idiom_file(spark: SparkSession, files: dict[str, str], language: str) -> str | None:
    """The lexicon file of a language; None, with a warning, where there is none."""
    path = files.get(language)
    if path:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path
    warnings.warn(f"no idiom file for {language}: {path}", stacklevel=2)
    return None


def chunk_files(spark: SparkSession, folder: str, base: str) -> list[str]:
    """Chunk files in order of name: compressed ones, or plain ones only if there is none."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().toString() for s in fs.listStatus(root))
    mine = [n for n in names if n.rpartition("/")[2].startswith(base)]
    return [n for n in mine if n.endswith(".json.gz")] or [n for n in mine if n.endswith(".jsonl")]


def peek(spark: SparkSession, path, n: int = 5, field: str | None = None, width: int = 200) -> DataFrame:
    """(line_no, shown, ok) of the first physical lines; blank ones count."""
    rows = spark.read.text(path).limit(n).withColumn("line_no", F.monotonically_increasing_id())
    ok = jsonx.is_json("value")
    shown = X.preview(F.get_json_object("value", f"$.{field}"), width) if field else X.preview("value", width)
    return rows.select("line_no", F.when(ok, shown).otherwise(F.lit("malformed")).alias("shown"), ok.alias("ok"))


def vectors(spark: SparkSession, path) -> DataFrame:
    """Meaning vectors, single precision."""
    return spark.read.parquet(path).withColumn("embedding", F.transform("embedding", lambda x: x.cast("float")))


def vector_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The vectors of a store of .npz and _meta.json files, in single precision, with the columns of schema beside them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "vectors-*").load(path)
    name = F.regexp_extract("path", r"(vectors-\d+)(?:\.npz|_meta\.json)$", 1)
    of = lambda ending: files.where(F.col("path").endswith(ending)).select(name.alias("name"), "content")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                with np.load(io.BytesIO(batch.column(1)[i].as_py())) as z:
                    v = z["embeddings"].astype(np.float32)
                at = pa.array(range(len(v)), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(v)), at, pa.array(list(v), pa.list_(pa.float32()))], names=["name", "at", "embedding"])

    vectors = of(".npz").mapInArrow(run, "name string, at long, embedding array<float>")
    rows = F.from_json(F.col("content").cast("string"), f"array<struct<{_struct(schema)}>>")
    meta = of("_meta.json").select("name", F.posexplode(rows).alias("at", "m")).select("name", F.col("at").cast("long").alias("at"), "m.*")
    return meta.join(vectors, ["name", "at"]).drop("name", "at")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus in Parquet or JSON lines, by the ending."""
    return spark.read.parquet(path) if path.endswith("parquet") else spark.read.json(path)


def pdf_pages(texts: DataFrame) -> DataFrame:
    """(path, page_no, page) of extracted texts, whose pages end with a form feed."""
    return texts.select("path", F.posexplode(F.split("text", "\f")).alias("page_no", "page"))


def xinhua(rows: DataFrame) -> DataFrame:
    """word, derivation, explanation, example -> idiom, definition, example, source_input."""
    source = X.joined_or_null("derivation")
    return rows.select(F.col("word").alias("idiom"), X.non_empty("explanation").alias("definition"), X.examples(F.array("example"), F.col("word")).alias("example"), source.alias("source_input"))


def fuxi(rows: DataFrame) -> DataFrame:
    """input, output -> the same columns, without examples."""
    none = F.lit(None).cast("array<string>")
    return rows.select(F.col("input").alias("idiom"), X.non_empty("output").alias("definition"), none.alias("example"), F.lit(None).cast("string").alias("source_input"))


def idiom_kb(rows: DataFrame, meaning: str = "zh_meaning") -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return rows.select("idiom", X.non_empty(meaning).alias("definition"), none.alias("example"), F.lit(None).cast("string").alias("source_input"))


def crawled(spark: SparkSession, fetch_page: Callable, fetch_text: Callable, attempts: int = 5, sleep=None) -> DataFrame:
    """(idiom, wikitext) of a category that fetch_page(token) lists as (titles, next token).

    Listing is sequential, as each token comes with the page before; texts are fetched in
    parallel, and a text that fails is empty.
    """
    from ..operators.models import with_retry

    options = {} if sleep is None else {"sleep": sleep}
    titles, token = [], None
    while True:
        found, token = with_retry(lambda t=token: fetch_page(t), attempts, **options)
        titles += found
        if not token:
            break

    def one(title):
        try:
            return fetch_text(title) or ""
        except Exception:  # noqa: BLE001  a page that fails has no text
            return ""

    @F.pandas_udf("string")
    def text(part: pd.Series) -> pd.Series:
        with ThreadPoolExecutor(8) as pool:
            return pd.Series(list(pool.map(one, part)), dtype=object)

    rows = spark.createDataFrame([(t,) for t in titles], "idiom string")
    return rows.repartition(min(64, max(1, len(titles) // 50 + 1))).select("idiom", text("idiom").alias("wikitext"))
