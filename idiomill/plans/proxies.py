"""Views over the driver tables that stand for lexicons, corpora and vectors, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phrases(spark, d):
    """The first two words of each benchmark text, in lower case."""
    part = lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    return table(spark, d, "benchmark").select("item_id", F.lower(F.concat(part(1), F.lit(" "), part(2))).alias("idiom"))


PHRASES = "phr AS (SELECT item_id, lower(split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)) AS idiom FROM benchmark)"
PAIRS = PHRASES + """,
prs AS (SELECT DISTINCT d.doc_id, p.idiom FROM documents d JOIN (SELECT DISTINCT idiom FROM phr) p ON contains(lower(d.text), p.idiom)),
num AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index FROM documents),
hit AS (SELECT * FROM num WHERE doc_id IN (SELECT doc_id FROM prs))"""


def many_phrases(spark, d):
    """Each two neighbouring words of each benchmark text's first nine, in lower case."""
    words = F.split(F.lower("text"), " ")
    at = F.sequence(F.lit(0), F.least(F.size(words), F.lit(9)) - 2)
    two = F.transform(F.when(F.size(words) >= 2, at).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(words, i + 1, 2), " "))
    return table(spark, d, "benchmark").select("item_id", F.explode(two).alias("idiom"))


MANY_PAIRS = PAIRS.replace(PHRASES, """wrd AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark),
plc AS (SELECT item_id, w, unnest(range(1, least(len(w), 9))) AS i FROM wrd), phr AS (SELECT item_id, w[i] || ' ' || w[i + 1] AS idiom FROM plc)""")


def idioms(spark, d):
    """Parts as idioms: the words of the name are entities, type and brand are figurative meanings."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("index"), F.col("p_name").alias("idiom"), F.split("p_name", " ").alias("entities"),
        F.array("p_type", "p_brand").alias("figurative_meanings"), F.array("p_type").alias("literal_meanings"),
    )


IDIOMS = """ent AS (SELECT p_partkey AS idx, p_name AS idiom, string_split(p_name, ' ') AS entities, p_type, p_brand FROM part),
men AS (SELECT idx, idiom, unnest(entities) AS entity FROM ent)"""


def pairs(spark, d):
    """Neighbouring parts as pairs of languages; some sides have no entities."""
    p = table(spark, d, "part")
    none = F.array().cast("array<string>")
    a = p.select(
        F.col("p_partkey").alias("a_idx"),
        F.when(F.col("p_partkey") % 7 == 0, none).otherwise(F.split("p_name", " ")).alias("zh_entities"),
        (F.col("p_size") / 50).alias("similarity"),
    )
    b = p.select(
        (F.col("p_partkey") - 1).alias("a_idx"), F.col("p_partkey").alias("b_idx"),
        F.when(F.col("p_partkey") % 5 == 0, none).otherwise(F.split("p_name", " ")).alias("en_entities"),
    )
    return a.join(b, "a_idx")


PAIR_LISTS = """lst AS (SELECT a.p_partkey AS a_idx, b.p_partkey AS b_idx, a.p_size / 50 AS similarity,
  CASE WHEN a.p_partkey % 7 = 0 THEN []::VARCHAR[] ELSE string_split(a.p_name, ' ') END AS zh_entities,
  CASE WHEN b.p_partkey % 5 = 0 THEN []::VARCHAR[] ELSE string_split(b.p_name, ' ') END AS en_entities
  FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)"""


def meanings(spark, d, lang=None):
    """Embeddings as meanings: three for each idiom, two languages."""
    m = table(spark, d, "embeddings").select(
        F.pmod("label", F.lit(2)).cast("int").alias("lang"), F.floor(F.col("vec_id") / 3).cast("long").alias("idiom_idx"),
        (F.col("vec_id") % 3).cast("int").alias("meaning_pos"), "embedding", "vec_id", "label",
    )
    return m if lang is None else m.where(F.col("lang") == lang)


MEANINGS = """men AS (SELECT label % 2 AS lang, cast(floor(vec_id / 3) AS BIGINT) AS idiom_idx, vec_id % 3 AS meaning_pos,
  embedding::DOUBLE[] AS v, vec_id, label FROM embeddings)"""


