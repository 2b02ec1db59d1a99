"""Queries that write driver tables as files of each habit into the shared folder and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import match, models, vectors
from ..sources import mirror, readers, writers
from . import proxies
from .proxies import table
from .registry import fresh_folder, query, shown


def _text_file(spark: SparkSession, lines: DataFrame, folder: str, name: str) -> str:
    """Writes a column of lines, in order of pos, as one file with that name."""
    ordered = lines.repartition(1).sortWithinPartitions("pos").select("value")
    ordered.write.text(f"{folder}/_{name}")
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(path(f"{folder}/_{name}")) if s.getPath().getName().startswith("part-"))
    fs.rename(part, path(f"{folder}/{name}"))
    return f"{folder}/{name}"


def _parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("idiom"), F.col("p_type").alias("kind"))


def _lines(spark, d):
    """JSON lines of the parts, a blank line after every third."""
    row = F.to_json(F.struct("pos", "idiom", "kind"))
    return _parts(spark, d).select("pos", F.when(F.col("pos") % 3 == 0, F.concat(row, F.lit("\n"))).otherwise(row).alias("value"))


@query('SELECT p_partkey AS pos, p_name AS idiom, p_type AS kind FROM part')
def jsonl_strict(spark, d):
    path = _text_file(spark, _lines(spark, d), fresh_folder(spark, "jsonl"), "lines.jsonl")
    return readers.jsonl(spark, path, "pos long, idiom string, kind string")


@query('SELECT p_partkey AS pos, p_name AS idiom, p_type AS kind FROM part')
def jsonl_lenient(spark, d):
    broken = _parts(spark, d).select("pos", F.concat(F.lit('{"pos": 1, "idiom": "'), "idiom").alias("value"))
    path = _text_file(spark, _lines(spark, d).unionByName(broken), fresh_folder(spark, "jsonl"), "lines.jsonl")
    return readers.jsonl(spark, path, "pos long, idiom string, kind string", strict=False)


@query('SELECT doc_id, text FROM documents')
def jsonl_unescaped(spark, d):
    """Texts of all scripts go out as they are and come back equal."""
    path = fresh_folder(spark, "docs")
    writers.jsonl(table(spark, d, "documents").select("doc_id", "text"), path)
    return readers.jsonl(spark, path, "doc_id long, text string")


@query('SELECT doc_id, text FROM documents')
def jsonl_gzip(spark, d):
    path = fresh_folder(spark, "docs")
    writers.jsonl(table(spark, d, "documents").select("doc_id", "text"), path, compress=True)
    return readers.jsonl(spark, path, "doc_id long, text string")


@query('SELECT p_partkey AS pos, p_name AS idiom, p_type AS kind FROM part')
def json_array_file(spark, d):
    path = fresh_folder(spark, "array")
    writers.json_array(_parts(spark, d), path, ["pos"])
    return readers.json_array(spark, path, "pos long, idiom string, kind string")


@query('SELECT p_partkey AS pos, p_name AS word, p_type AS definition, p_brand AS example, p_brand AS source_input FROM part')
def dictionary_array(spark, d):
    """A dictionary that is one JSON array, in the columns of a source."""
    path = fresh_folder(spark, "dictionary")
    part = table(spark, d, "part").select(F.col("p_name").alias("word"), F.col("p_type").alias("explanation"), F.col("p_brand").alias("example"), F.col("p_brand").alias("derivation"), F.col("p_partkey").alias("pos"))
    writers.json_array(part, path, ["pos"])
    rows = readers.json_array(spark, path, "word string, explanation string, example string, derivation string, pos long")
    out = readers.xinhua(rows.withColumn("word", F.concat_ws("#", "pos", "word")))
    at = lambda k: F.split_part("idiom", F.lit("#"), F.lit(k))
    return out.select(at(1).cast("long").alias("pos"), at(2).alias("word"), "definition", shown("example").alias("example"), "source_input")


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, p_name AS idiom, p_type AS kind FROM part")
def json_member_file(spark, d):
    """An object that holds an array."""
    rows = _parts(spark, d).agg(F.array_sort(F.collect_list(F.struct("pos", "idiom", "kind"))).alias("idioms"))
    lines = rows.select(F.lit(0).alias("pos"), F.to_json(F.struct(F.lit("x").alias("name"), "idioms")).alias("value"))
    path = _text_file(spark, lines, fresh_folder(spark, "member"), "dictionary.json")
    whole = readers.json_member(spark, path, "idioms", "number long, idiom string, kind string")
    return whole.select(F.col("pos").cast("long").alias("pos"), "idiom", "kind")


@query("""SELECT c_custkey, c_name AS topic, coalesce(c_mktsegment, '') AS cultural_group, CASE WHEN c_custkey % 2 = 0 THEN 'reddit' ELSE 'tiktok' END AS source FROM customer""")
def culture_files(spark, d):
    """Two CSV files, tagged by their names."""
    folder, paths = fresh_folder(spark, "culture"), []
    quoted = F.concat(F.lit('"'), F.replace("c_name", F.lit('"'), F.lit('""')), F.lit('"'))
    for k, tag in enumerate(("reddit", "tiktok")):
        rows = table(spark, d, "customer").where(F.col("c_custkey") % 2 == k)
        lines = rows.select(F.col("c_custkey").alias("pos"), F.concat_ws(",", F.col("c_custkey").cast("string"), quoted, "c_mktsegment").alias("value"))
        head = spark.createDataFrame([(-1, "c_custkey,topic,cultural group")], "pos long, value string")
        paths.append(_text_file(spark, head.unionByName(lines), folder, f"culturebank_{tag}.csv"))
    return readers.culture_tables(spark, paths).select(F.col("c_custkey").cast("long").alias("c_custkey"), "topic", "cultural_group", "source")


@query("SELECT p_name || '#' || p_partkey AS key, trim(p_type || ',' || p_brand) AS value FROM part")
def key_value_file(spark, d):
    """Lines cut at their first comma, among lines without one and blank lines."""
    part = table(spark, d, "part")
    line = F.concat(F.lit(" "), "p_name", F.lit("#"), F.col("p_partkey").cast("string"), F.lit(" , "), "p_type", F.lit(","), "p_brand", F.lit(" "))
    lines = part.select(F.col("p_partkey").alias("pos"), F.concat(line, F.lit("\nno comma here\n")).alias("value"))
    return readers.key_value_lines(spark, _text_file(spark, lines, fresh_folder(spark, "pairs"), "pairs.txt"))


@query("SELECT p_partkey AS pos, p_name AS idiom, p_type AS kind FROM part")
def tsv_file(spark, d):
    lines = _parts(spark, d).select("pos", F.concat_ws("\t", F.col("pos").cast("string"), "idiom", "kind").alias("value"))
    return readers.tsv(spark, _text_file(spark, lines, fresh_folder(spark, "tsv"), "rows.tsv"), "pos long, idiom string, kind string")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index, cast(floor((row_number() OVER (ORDER BY doc_id) - 1) / 300) AS BIGINT) AS chunk_id FROM documents")
def chunks_written(spark, d):
    """Numbered chunks; a second run leaves nothing of the first."""
    path = fresh_folder(spark, "chunks")
    docs = match.ordinals(table(spark, d, "documents").select("doc_id"))
    writers.chunks(docs, path, 50)
    writers.chunks(docs, path, 300)
    return spark.read.schema("doc_id long, doc_index long, chunk_id long").json(path)


@query("SELECT p_partkey AS pos, p_name AS idiom, p_type AS kind, 'chunk_' || (p_partkey % 3) || '.jsonl' AS file FROM part")
def chunk_files_read(spark, d):
    """Chunk files in order of name, found by the beginning of their names."""
    folder = fresh_folder(spark, "chunkfiles")
    for k in range(3):
        _text_file(spark, _lines(spark, d).where(F.col("pos") % 3 == k), folder, f"chunk_{k}.jsonl")
    _text_file(spark, _lines(spark, d), folder, "other.jsonl")
    files = readers.chunk_files(spark, folder, "chunk_")
    assert files == sorted(files)
    rows = spark.read.schema("pos long, idiom string, kind string").json(files)
    return rows.select("pos", "idiom", "kind", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).where("pos is not null")


@query("SELECT p_partkey AS pos, p_name AS idiom, p_type AS kind FROM part")
def lexicon_of_language(spark, d):
    """The file of a language; a language without one has no rows."""
    import warnings

    path = _text_file(spark, _lines(spark, d), fresh_folder(spark, "lexicon"), "en.jsonl")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        files = [readers.idiom_file(spark, {"en": path, "hi": f"{path}.none"}, k) for k in ("en", "hi", "zh")]
    return readers.jsonl(spark, [f for f in files if f], "pos long, idiom string, kind string")


@query("""SELECT doc_id - (SELECT min(doc_id) FROM documents) AS line_no, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS shown, true AS ok
FROM documents ORDER BY doc_id LIMIT 50""")
def peek_rows(spark, d):
    """The first physical lines of a file."""
    docs = table(spark, d, "documents").orderBy("doc_id").limit(50)
    lines = docs.select(F.col("doc_id").alias("pos"), F.to_json(F.struct("doc_id", "text")).alias("value"))
    return readers.peek(spark, _text_file(spark, lines, fresh_folder(spark, "peek"), "docs.jsonl"), 50, "text")


@query("SELECT p_partkey AS pos, p_name AS idiom, p_type AS kind FROM part UNION ALL SELECT p_partkey, p_name, p_type FROM part WHERE p_size % 2 = 0")
def appended_lines(spark, d):
    path = fresh_folder(spark, "appended")
    writers.appended(_parts(spark, d), path)
    writers.appended(table(spark, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("idiom"), F.col("p_type").alias("kind")), path)
    return readers.jsonl(spark, path, "pos long, idiom string, kind string")


_HALF = """q AS (SELECT vec_id, label, x, CASE WHEN x = 0 THEN 1 ELSE pow(2, greatest(floor(log2(abs(x))), -14) - 10) END AS q
 FROM (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x FROM embeddings))"""


@query(f"WITH {_HALF} SELECT vec_id, label, sum(round_even(x / q, 0) * q * 16777216)::BIGINT AS units, count(*) AS size FROM q GROUP BY vec_id, label")
def vector_store(spark, d):
    """Half precision on disk, single precision in memory. Half-precision numbers are multiples of 2^-24, so their sums are exact."""
    path = fresh_folder(spark, "vectors")
    writers.vector_store(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), path, 300)
    out = readers.vector_store(spark, path, "vec_id long, label long")
    units = F.aggregate("embedding", F.lit(0).cast("long"), lambda s, x: s + (x.cast("double") * (1 << 24)).cast("long"))
    return out.select("vec_id", "label", units.alias("units"), F.size("embedding").cast("long").alias("size"))


@query("SELECT vec_id, label, sum(round(x * 1000000))::BIGINT AS units FROM (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY vec_id, label")
def vector_lines(spark, d):
    """Vectors as JSON lines."""
    path = fresh_folder(spark, "vectorlines")
    writers.jsonl(table(spark, d, "embeddings").select("vec_id", "label", "embedding"), path)
    rows = readers.jsonl(spark, path, "vec_id long, label long, embedding array<float>")
    units = F.aggregate("embedding", F.lit(0).cast("long"), lambda s, x: s + F.round(x.cast("double") * 1000000).cast("long"))
    return rows.select("vec_id", "label", units.alias("units"))


@query(f"""WITH {proxies.MEANINGS}, x AS (SELECT a.idiom_idx AS a_idx, b.idiom_idx AS b_idx, max(list_dot_product(a.v, b.v)) AS s FROM men a JOIN men b ON a.lang = 0 AND b.lang = 1 GROUP BY 1, 2)
SELECT a_idx, b_idx, round(s, 6) AS similarity, kind FROM x, (SELECT unnest(['array', 'lines']) AS kind) WHERE s >= 0.4""")
def pair_files(spark, d):
    """Pairs as one array and as lines."""
    pairs = vectors.cross_pairs(proxies.meanings(spark, d, 0), proxies.meanings(spark, d, 1), 0.4).select("a_idx", "b_idx", "similarity")
    folder = fresh_folder(spark, "pairs")
    writers.json_array(pairs, f"{folder}/array", ["a_idx", "b_idx"])
    writers.jsonl(pairs, f"{folder}/lines")
    schema = "a_idx long, b_idx long, similarity double"
    array, lines = readers.json_array(spark, f"{folder}/array", schema), readers.jsonl(spark, f"{folder}/lines", schema)
    both = array.withColumn("kind", F.lit("array")).unionByName(lines.withColumn("kind", F.lit("lines")))
    return both.withColumn("similarity", F.round("similarity", 6))


@query("SELECT p_partkey AS pos, p_name AS idiom, '[\"' || p_type || '\",\"' || p_brand || '\"]' AS themes, 'EFBBBF' AS mark FROM part")
def csv_export(spark, d):
    """Flat CSV whose files begin with a byte order mark."""
    path = fresh_folder(spark, "export")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("idiom"), F.array("p_type", "p_brand").alias("themes"))
    writers.csv(rows, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    mark = files.agg(F.max(F.hex(F.substring("content", 1, 3))).alias("a"), F.min(F.hex(F.substring("content", 1, 3))).alias("b")).where("a = b").select(F.col("a").alias("mark"))
    read = spark.read.option("header", True).option("escape", '"').option("enforceSchema", True).schema("pos long, idiom string, themes string").csv(path)
    return read.crossJoin(F.broadcast(mark))


@query("SELECT conv_id, string_split(page, chr(12))[k] AS page, k - 1 AS page_no FROM (SELECT conv_id, string_agg(text, chr(12) ORDER BY turn) AS page, unnest(range(1, count(*) + 1)) AS k FROM conversations GROUP BY conv_id)")
def pdf_pages(spark, d):
    """Extracted texts whose pages end with a form feed."""
    turn = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    texts = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("path")).agg(F.array_join(turn, "\f").alias("text"))
    out = readers.pdf_pages(texts)
    return out.select(F.col("path").alias("conv_id"), "page", F.col("page_no").cast("long").alias("page_no"))


@query("SELECT n_name AS idiom, CASE WHEN left(n_name, 1) < 'F' THEN '' ELSE 'text of ' || n_name END AS wikitext FROM nation")
def crawled_pages(spark, d):
    """A category in pages of ten; a listing that fails once is asked again, a text that fails is empty."""
    names = sorted(r.n_name for r in table(spark, d, "nation").collect())
    failed = []

    def fetch_page(token):
        at = int(token or 0)
        if at == 10 and not failed:
            failed.append(at)
            raise OSError("busy")
        return names[at : at + 10], str(at + 10) if at + 10 < len(names) else None

    return readers.crawled(spark, fetch_page, _page_text, sleep=lambda s: None)


def _page_text(title):
    if title < "F":
        raise OSError("gone")
    return f"text of {title}"


@query("SELECT p_partkey % 20 AS chunk, count(*) AS n, 20::BIGINT AS chunks FROM part GROUP BY ALL")
def chunk_answers(spark, d):
    """Chunks of requests, of which only those that failed are asked again."""
    scratch = fresh_folder(spark, "answers")

    def keep(df, attempt):
        df.write.mode("overwrite").parquet(f"{scratch}/{attempt}")
        return spark.read.parquet(f"{scratch}/{attempt}")

    message = F.struct(F.lit("user").alias("role"), F.concat_ws("|", F.sort_array(F.collect_list("p_partkey")).cast("array<string>")).alias("content"))
    chunks = table(spark, d, "part").groupBy((F.col("p_partkey") % 20).alias("chunk")).agg(F.array(message).alias("messages"))
    got = models.completed_chunks(chunks, _Second, keep, model=scratch, attempts=3)
    return got.select("chunk", F.col("response").cast("long").alias("n"), F.lit(got.count()).alias("chunks"))


class _Second:
    """Counts the parts of a request; the first three requests that a process sees fail (each is tried five times at most)."""

    def __init__(self):
        self.left = 3

    def complete(self, messages, **options):
        if self.left:
            self.left -= 1
            raise ValueError("not yet")
        return str(messages[-1]["content"].count("|") + 1)


@query("SELECT p_partkey, 64::BIGINT AS size, 1.0::DOUBLE AS norm, true AS same FROM part")
def meaning_vectors(spark, d):
    """Unit vectors of meanings; equal texts have equal ones."""
    rows = table(spark, d, "part").select("p_partkey", "p_type", F.col("p_type").alias("again"))
    one = models.embedded(rows, models.HashEmbedder, "p_type", "a").withColumnRenamed("embedding", "v")
    two = models.embedded(one, models.HashEmbedder, "again", "b", batch=3)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return two.select("p_partkey", F.size("v").cast("long").alias("size"), F.round(norm, 4).alias("norm"), (F.col("v") == F.col("embedding")).alias("same"))


@query("SELECT p_partkey AS pos, p_name AS idiom, p_type AS kind, 'a/rows_' || (p_partkey % 2) || '.jsonl' AS file FROM part")
def mirrored_files(spark, d):
    """A folder copied by patterns, then again without what has gone from the source."""
    source, target = fresh_folder(spark, "source"), fresh_folder(spark, "target")
    for k in range(2):
        _text_file(spark, _lines(spark, d).where(F.col("pos") % 2 == k), f"{source}/a", f"rows_{k}.jsonl")
    _text_file(spark, _lines(spark, d), f"{source}/a", "rows_old.jsonl")
    _text_file(spark, _lines(spark, d), f"{source}/a", "other.txt")
    patterns = ("a/rows*",), ("*/_*",)
    first = mirror.copied(spark, source, target, *patterns)
    second = mirror.copied(spark, source, target, ("a/rows_?.jsonl",), delete=True)
    if len(first) != 3 or second or len(mirror.listed(spark, target)) != 2:
        raise RuntimeError(f"copied {first}, then {second}")
    name = F.concat(F.lit("a/"), F.element_at(F.split(F.input_file_name(), "/"), -1))
    rows = spark.read.schema("pos long, idiom string, kind string").json([f"{target}/{n}" for n in mirror.listed(spark, target)])
    return rows.select("pos", "idiom", "kind", name.alias("file")).where("pos is not null")
