"""Line de-duplication over overlapping windows of three lines, in SQL functions only.

A text is cut at line feeds; lines that are not blank, trimmed of ASCII white space, form
the sequence that windows run over. A window of three consecutive lines is repeated if
the same three lines stand together earlier: in a document with a smaller doc_id, or
earlier in the same document. Every line that a repeated window covers is removed
(windows overlap, covered positions are merged); blank lines stay. Windows are judged on
the input, not on what is left.

Windows are compared by two 64-bit hashes. The first position of each is a pre-aggregated
minimum, so a window that stands in a third of all documents does not gather anywhere.
Later positions are marked by a join; windows that are more than one in HOT of all, of
which there are fewer than HOT, are joined by broadcast, so that they gather in no task.

Defined results: texts that are null or have fewer than three lines are unchanged; rows
that share a doc_id are kept, their windows are ordered by a hash of the text; rows that
are equal in doc_id and text are one document, and all get the same text; null ids come
last; columns keep their names, whatever they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SIZE = 3
HOT = 1000
_TRIM = "^[ \\t\\r\\f\\x0B]+|[ \\t\\r\\f\\x0B]+$"


def _once(df: DataFrame, column, name: str) -> DataFrame:
    """df with a computed array that later lambdas read as a column.

    A generator is a barrier: without it the optimiser may put the expression into the
    lambda, which then evaluates it for each element.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def _full(lines):
    """(key, pos) of the lines that are not blank."""
    keyed = F.transform(lines, lambda x, i: F.struct(F.regexp_replace(x, _TRIM, "").alias("key"), i.alias("pos")))
    return F.filter(keyed, lambda x: x["key"] != "")


def _windows(size):
    """at, two hashes and the line positions of each window over the column full."""

    def window(i):
        part = F.slice("full", i + 1, size)
        joined = F.array_join(F.transform(part, lambda x: x["key"]), "\n")
        return F.struct(
            i.alias("at"),
            F.xxhash64(joined).alias("a"),
            F.xxhash64(F.lit(size), F.reverse(joined)).alias("b"),
            F.transform(part, lambda x: x["pos"]).alias("lines"),
        )

    return F.transform(F.sequence(F.lit(0), F.size("full") - size), window)


def _numbered(docs: DataFrame):
    """docs with columns _0, _1, ..., which no column of docs can clash with, and the names that they stand for."""
    return docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns))), list(docs.columns)


def _later(spread: DataFrame, first: DataFrame, place) -> DataFrame:
    """The windows of spread that come after the first of their kind."""
    limit = max(10_000, spread.count() // HOT)
    few, many = first.where(F.col("n") <= limit).drop("n"), first.where(F.col("n") > limit).drop("n")
    hot = F.broadcast(many.withColumnRenamed("first", "hot"))
    told = spread.join(hot, ["a", "b"], "left")
    near = told.where(F.col("hot").isNull()).drop("hot").join(few, ["a", "b"]).where(place > F.col("first")).drop("first")
    return near.unionByName(told.where(F.col("hot").isNotNull() & (place > F.col("hot"))).drop("hot"))


def _marked(docs: DataFrame, text: str, size: int, key: str) -> DataFrame:
    """docs (numbered columns) with lines, the lines of the text, and gone, the places of those to remove (null if none is)."""
    scratch = Scratch(docs.sparkSession, "lines")
    body = F.col(text).cast("string")
    # Rows are named by doc_id and, where rows share one, by a hash of their text.
    named = docs.where(body.contains("\n")).select(F.col(key).alias("id"), F.xxhash64(body).alias("t"), body.alias("body"))
    lined = _once(named, _full(F.split("body", "\n", -1)), "full").where(F.size("full") >= size)
    spread = scratch.keep(
        lined.select("id", "t", F.explode(_windows(size)).alias("w")).select("id", "t", "w.*").dropDuplicates(["id", "t", "at"]),
        "windows",
    )
    place = F.struct(F.col("id").isNull().alias("last"), "id", "t", "at")
    first = scratch.keep(spread.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    gone = _later(spread, first, place).groupBy("id", "t").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))
    gone = scratch.keep(gone, "gone")
    # A merge join at every size: the plan, and what it needs, do not change where the marks outgrow a broadcast.
    joined = docs.join(gone.hint("merge"), F.col(key).eqNullSafe(F.col("id")) & (F.xxhash64(body) == F.col("t")), "left")
    return _once(joined, F.split(body, "\n", -1), "lines")


def _rewritten(text: str):
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.element_at("lines", i + 1)), "\n")
    return F.when(F.col("gone").isNull(), F.col(text).cast("string")).otherwise(kept)


def dedup_lines(docs: DataFrame, text: str = "text", size: int = SIZE, key: str = "doc_id") -> DataFrame:
    """docs with the text rewritten, and the columns n_lines and n_removed (long; 0 for a null text).

    Columns of docs that have those names already are replaced.
    """
    plain, names = _numbered(docs)
    body = f"_{names.index(text)}"
    ready = _marked(plain, body, size, f"_{names.index(key)}")
    counted = F.size(F.filter("lines", lambda x: F.regexp_replace(x, _TRIM, "") != ""))
    return ready.select(
        *((_rewritten(body) if c == text else F.col(f"_{i}")).alias(c) for i, c in enumerate(names) if c not in ("n_lines", "n_removed")),
        F.when(F.col("lines").isNull(), 0).otherwise(counted).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def without_repeats(docs: DataFrame, text: str = "text", size: int = SIZE, key: str = "doc_id", length: str = "n_chars") -> DataFrame:
    """docs, columns and all, with the text rewritten and the length column, if there is one, of rewritten texts renewed."""
    plain, names = _numbered(docs)
    body = f"_{names.index(text)}"
    new = _marked(plain, body, size, f"_{names.index(key)}").withColumn("new", _rewritten(body))
    columns = {names.index(text): F.col("new")}
    if length in names:
        at = names.index(length)
        kind = dict(docs.dtypes)[length]
        columns[at] = F.when(F.col("gone").isNull(), F.col(f"_{at}")).otherwise(F.length("new").cast(kind))
    return new.select(*(columns.get(i, F.col(f"_{i}")).alias(c) for i, c in enumerate(names)))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS pos, p, line
  FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS p,
               unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_replace(line, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g') <> ''),
k AS (SELECT doc_id, pos, p, regexp_replace(line, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g') AS key FROM l),
w AS (SELECT doc_id, pos, key || chr(10) || lead(key, 1) OVER o || chr(10) || lead(key, 2) OVER o AS win
      FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos FROM (
        SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS n FROM w WHERE win IS NOT NULL)
      WHERE n > 1),
gone AS (SELECT DISTINCT k.doc_id, k.p FROM k JOIN r ON k.doc_id = r.doc_id AND k.pos BETWEEN r.pos AND r.pos + 2),
a AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS p,
             unnest(string_split(text, chr(10))) AS line FROM documents),
kept AS (SELECT a.doc_id, string_agg(a.line, chr(10) ORDER BY a.p) AS text
         FROM a LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY a.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(g.n, 0)::BIGINT AS n_removed,
       coalesce(kept.text, '') AS text
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
