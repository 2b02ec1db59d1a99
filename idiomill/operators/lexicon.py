"""Dictionary sources: merging, appending, resuming, and joining of model answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx, text as X


def ordered(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rows of the sources with source, file_pos and row_pos; frames without row_pos are numbered by idiom."""
    parts = []
    for k, (name, df) in enumerate(sources):
        if "row_pos" not in df.columns:
            df = df.withColumn("row_pos", F.monotonically_increasing_id())
        parts.append(df.withColumn("source", F.lit(name)).withColumn("file_pos", F.lit(k)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge(rows: DataFrame, preferred: str | None = None, entry: tuple[str, ...] = ("definition", "patterns")) -> DataFrame:
    """(idiom, sources): rows (idiom, source, file_pos, row_pos, entry...) of one idiom together.

    Idioms that differ only in the case of their first letter are one. It is spelled as
    in the preferred source (its last row), else as first seen. Sources are in order.
    """
    rows = rows.where(X.non_empty("idiom").isNotNull())
    at = F.struct("file_pos", "row_pos")
    liked = F.when(F.col("source") == preferred, at) if preferred else F.lit(None).cast("struct<file_pos:int,row_pos:bigint>")
    grouped = rows.withColumn("_key", X.lower_first("idiom")).groupBy("_key").agg(
        F.coalesce(F.max_by(F.when(F.col("source") == F.lit(preferred), F.col("idiom")), liked), F.min_by("idiom", at)).alias("idiom"),
        F.array_sort(F.collect_list(F.struct(at.alias("at"), *entry, "source")), _by_position).alias("_all"),
    )
    plain = F.transform("_all", lambda s: F.struct(*(s[c].alias(c) for c in (*entry, "source"))))
    return grouped.select("_key", "idiom", plain.alias("sources"))


def _by_position(a, b):
    """Compares entries by position alone; maps in them have no order."""
    return F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)


def indexed(merged: DataFrame, key: str = "_key") -> DataFrame:
    """merged with a dense 0-based index in order of key."""
    from .match import ordinals

    return ordinals(merged, key, name="index").drop("_key")


def wide(merged: DataFrame, columns: int | None = None) -> DataFrame:
    """sources as columns source1, source2, ...; for the sink, where the widest row decides."""
    n = columns if columns is not None else merged.agg(F.max(F.size("sources"))).first()[0] or 0
    return merged.select("*", *(F.get("sources", F.lit(k)).alias(f"source{k + 1}") for k in range(n))).drop("sources")


def merge_stats(merged: DataFrame) -> DataFrame:
    """One row: idioms, source entries and their mean (null without idioms)."""
    n = F.size("sources")
    return merged.agg(
        F.count("*").alias("idioms"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("entries"), F.round(F.avg(n), 2).alias("mean_sources")
    )


def full_outer(sources: list[DataFrame], key: str = "idiom") -> DataFrame:
    """(idiom, source1..N): array columns of each source side by side, null where a source lacks the idiom.

    Each source has idiom and value; the rows of an idiom in a source become its array.
    """
    parts = [df.groupBy(key).agg(F.collect_list("value").alias(f"source{k + 1}")) for k, df in enumerate(sources)]
    return reduce(lambda a, b: a.join(b, key, "full"), parts)


def definitions_with_sentences(definitions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Lines (key, value, pos) of two files: the last definition and all sentences of each key, whichever file has it."""
    last = definitions.groupBy("key").agg(F.max_by("value", "pos").alias("definition"))
    listed = sentences.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("s"))
    listed = listed.select("key", F.transform("s", lambda x: x["value"]).alias("sentences"))
    return last.join(listed, "key", "full")


def unprocessed(rows: DataFrame, done: DataFrame, key: str = "index") -> DataFrame:
    """Rows whose index is not among those done."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def appended(existing: DataFrame, new: DataFrame, pos: str = "pos") -> DataFrame:
    """New rows with their first letter in lower case, without those there already; the first of equals stays."""
    named = new.where(X.non_empty("idiom").isNotNull()).withColumn("idiom", X.lower_first("idiom"))
    fresh = named.join(existing.select(X.lower_first("idiom").alias("idiom")).distinct(), "idiom", "left_anti")
    w = Window.partitionBy("idiom").orderBy(pos)
    return fresh.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


ANSWER = "idiom string, entities array<string>, literal_meanings array<string>, figurative_meanings array<string>"


def join_answers(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests (chunk, index, idiom) with the output that their chunk's response (chunk, response) has for the idiom.

    The last item of an idiom wins; an idiom without one has a null output. Fences around
    the JSON are dropped first.
    """
    body = jsonx.fenced("response")
    items = responses.where(jsonx.is_json(body)).select("chunk", F.posexplode(F.from_json(body, f"array<struct<{_fields(ANSWER)}>>")).alias("pos", "item"))
    last = items.groupBy("chunk", F.col("item.idiom").alias("idiom")).agg(F.max_by("item", "pos").alias("output"))
    return requests.join(last, ["chunk", "idiom"], "left")


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (x.split(" ", 1) for x in ddl.split(", ")))


def chunks(rows: DataFrame, size: int, key: str = "index") -> DataFrame:
    """rows with a chunk number: size rows each, in order of key."""
    from .match import ordinals

    return ordinals(rows, key, name="_at").withColumn("chunk", F.floor(F.col("_at") / size).cast("long")).drop("_at")


def without_trivial(rows: DataFrame) -> DataFrame:
    """Rows with an idiom and at least one figurative meaning."""
    name = F.coalesce(F.col("output.idiom"), F.col("idiom"))
    return rows.where(F.col("output").isNotNull() & X.non_empty(name).isNotNull() & (F.size("output.figurative_meanings") > 0))


def extracted_meanings(merged: DataFrame) -> DataFrame:
    """(idiom, meanings) of merged rows: each explanation that is there, with part of speech, usage and examples.

    A source's definition is an array of maps from part of speech to
    (explanation, usage, example).
    """
    flat = F.flatten(F.transform("sources", lambda s: F.flatten(F.transform(s["definition"], F.map_entries))))
    kept = F.filter(flat, lambda e: X.non_empty(e["value"]["explanation"]).isNotNull())
    return merged.select(
        "idiom",
        F.transform(
            kept,
            lambda e: F.struct(
                e["key"].alias("pos"), e["value"]["explanation"].alias("explanation"), e["value"]["usage"].alias("usage"), e["value"]["example"].alias("example")
            ),
        ).alias("meanings"),
    )


def extracted_definitions(merged: DataFrame, sources: tuple[str, ...] = ("source1", "source2", "source3", "source4")) -> DataFrame:
    """(idiom, meanings) of rows whose sources are arrays of (definition, example, source_input) or null: each definition that is there."""
    none = "array<struct<definition:string,example:array<string>,source_input:string>>"
    flat = F.concat(*(F.coalesce(F.col(s), F.array().cast(none)) for s in sources))
    return merged.select("idiom", F.filter(flat, lambda e: X.non_empty(e["definition"]).isNotNull()).alias("meanings"))


def sense_groups(lines: DataFrame, key: str = "page", pos: str = "line_no", line: str = "line", mark: str = "# ") -> DataFrame:
    """lines with sense: how many lines that begin with the mark stand up to each; 0 before the first."""
    w = Window.partitionBy(key).orderBy(pos)
    return lines.withColumn("sense", F.sum(F.startswith(line, F.lit(mark)).cast("int")).over(w).cast("long"))
