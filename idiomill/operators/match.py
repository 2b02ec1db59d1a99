"""Phrases in documents: the substring join, what is counted of it, and what is written.

Three strategies give the same pairs. ``nested``: a join on ``contains``, for small
phrase lists. ``automaton``: one pass over each document with all phrases, which are
broadcast if they number at most MAX_BROADCAST and searched in as many broadcasts as it
takes otherwise. ``grams``: an equi-join of each phrase's first characters with the
document's character n-grams and a check, in the JVM only.
"""

from __future__ import annotations

import importlib.util
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import ranges
from .sizes import small

NESTED = 64
"""Phrase lists up to this size are joined by contains."""
MAX_BROADCAST = 500_000
GRAM = 4


def patterns(lexicon: DataFrame, language: str = "en", column: str = "idiom") -> DataFrame:
    """(pattern, idiom): one row for each pattern; of idioms with the same pattern the smallest is named."""
    idiom = F.col(column)
    rows = lexicon.where(X.non_empty(idiom).isNotNull()).select(X.pattern(idiom, language == "en").alias("pattern"), idiom.alias("idiom"))
    return rows.where("pattern <> ''").groupBy("pattern").agg(F.min("idiom").alias("idiom"))


def _searched(docs, language, text):
    body = F.coalesce(F.col(text), F.lit(""))
    return F.lower(body) if language == "en" else body


WORD = r"\p{L}\p{N}_"


def _boundary(body, pattern, regex=False):
    """Whether the pattern stands in the text with no letter, number or underscore on either side.

    With regex the pattern is read as a regular expression (as in SQL that puts it between
    the sides unquoted); a point then stands for any character but a line feed.
    """
    if regex:
        return F.regexp_like(body, F.concat(F.lit(f"(?d)(^|[^{WORD}])"), pattern, F.lit(f"($|[^{WORD}])")))
    quoted = F.concat(F.lit(rf"(?<![{WORD}])\Q"), F.replace(pattern, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(rf"\E(?![{WORD}])"))
    return F.regexp_like(body, quoted)


def _nested(docs, pats, body):
    return docs.join(F.broadcast(pats), F.contains(body, F.col("pattern")))


def _grams(docs, pats, body, key):
    short = pats.where(F.length("pattern") < GRAM)
    long = pats.where(F.length("pattern") >= GRAM).withColumn("gram", F.substring("pattern", 1, GRAM))
    # Cut from each of the first places on: a substring at every place would walk the text from its start each time.
    cuts = [F.regexp_extract_all(F.substr("_body", F.lit(k + 1)), F.lit(f"(?s).{{{GRAM}}}"), F.lit(0)) for k in range(GRAM)]
    named = docs.select(F.col(key), body.alias("_body"))
    spread = named.select(key, F.explode(F.array_distinct(F.concat(*cuts))).alias("gram"))
    hits = spread.join(small(long), "gram").groupBy(key).agg(F.collect_set(F.struct("pattern", "idiom")).alias("_hits"))
    met = named.join(hits, key).select(key, F.explode(F.filter("_hits", lambda h: F.contains("_body", h["pattern"]))).alias("_hit"))
    found = met.select(key, "_hit.pattern", "_hit.idiom")
    return found.unionByName(_nested(named, short, F.col("_body")).select(key, "pattern", "idiom"))


def searched(docs: DataFrame, pats: DataFrame, body, key: str) -> DataFrame:
    """(key, pattern, idiom): the phrases in each row's body, each once, by the automaton."""
    kind = docs.schema[key].dataType.simpleString()
    out = None
    for shared in _broadcasts(pats.select("pattern", "idiom")):
        found = docs.select(F.col(key), body.alias("_body")).mapInArrow(
            _searcher(shared, key), f"`{key}` {kind}, pattern string, idiom string"
        )
        out = found if out is None else out.unionByName(found)
    return out


def _broadcasts(pats):
    """The phrases in broadcasts of about MAX_BROADCAST."""
    groups = max(1, -(-pats.count() // MAX_BROADCAST))
    for g in range(groups):
        part = pats.where(F.pmod(F.xxhash64("pattern"), F.lit(groups)) == g) if groups > 1 else pats
        yield pats.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])


def _searcher(shared, key):
    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p, idiom in shared.value:
            machine.add_word(p, (p, idiom))
        if shared.value:
            machine.make_automaton()
        for batch in batches:
            at, found = [], []
            for k, body in enumerate(batch.column(1).to_pylist()):
                hits = {v for _, v in machine.iter(body)} if shared.value else ()
                at += [k] * len(hits)
                found += sorted(hits)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            names = [pa.array([f[j] for f in found], pa.string()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([ids, *names], names=[key, "pattern", "idiom"])

    return run


def strategy_for(count: int) -> str:
    if count <= NESTED:
        return "nested"
    return "automaton" if importlib.util.find_spec("ahocorasick") else "grams"


def match(
    docs: DataFrame, pats: DataFrame, language: str = "en", strategy: str | None = None,
    key: str = "doc_id", text: str = "text", word_boundary: bool = False, regex: bool = False,
) -> DataFrame:
    """(key, pattern, idiom): the distinct pairs of a document and a phrase it contains.

    Without word_boundary a phrase also matches inside a word. Null texts match nothing.
    With regex the phrase, which must still stand in the text, is a regular expression where its boundaries are judged.
    """
    body = _searched(docs, language, text)
    strategy = strategy or strategy_for(pats.limit(NESTED + 1).count())
    if strategy == "nested":
        found = _nested(docs.select(key, body.alias("_body")), pats, F.col("_body")).select(key, "pattern", "idiom")
    elif strategy == "grams":
        found = _grams(docs, pats, body, key)
    elif strategy == "automaton":
        found = searched(docs, pats, body, key)
    else:
        raise ValueError(f"no such strategy: {strategy}")
    if word_boundary:
        found = found.join(docs.select(key, body.alias("_body")), key).where(_boundary(F.col("_body"), F.col("pattern"), regex)).drop("_body")
    return found.dropDuplicates([key, "pattern"])


def doc_counts(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(idiom, doc_count), of most documents first."""
    return pairs.groupBy("idiom").agg(F.countDistinct(key).alias("doc_count")).orderBy(F.desc("doc_count"), "idiom")


def matching_docs(docs: DataFrame, pats: DataFrame, language: str = "en", strategy: str | None = None, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose text contains a phrase; each row is judged by its own text, whatever its key.

    A semi-join that stops at the first hit for small lists, a filter by the automaton
    for others, and by n-grams a semi-join on the text itself.
    """
    strategy = strategy or strategy_for(pats.limit(NESTED + 1).count())
    body = _searched(docs, language, "text")
    if strategy == "nested":
        return docs.join(F.broadcast(pats), F.contains(body, F.col("pattern")), "left_semi")
    if strategy == "automaton":
        found = F.lit(False)
        for shared in _broadcasts(pats.select("pattern")):
            found = found | _holds(shared)(body)
        return docs.where(found)
    named = docs.select(F.sha2(body, 256).alias("_body_key"), body.alias("text")).dropDuplicates(["_body_key"])
    hits = _grams(named, pats, F.col("text"), "_body_key").select("_body_key").distinct()
    return docs.join(hits, F.sha2(body, 256) == F.col("_body_key"), "left_semi")


def _holds(shared):
    @F.pandas_udf("boolean")
    def holds(bodies: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for (p,) in shared.value:
            machine.add_word(p, True)
        if shared.value:
            machine.make_automaton()
        for part in bodies:
            yield pd.Series([bool(shared.value) and next(machine.iter(b), None) is not None for b in part], dtype=bool)

    return holds


def ordinals(docs: DataFrame, key: str = "doc_id", skip: int = 0, limit: int = 0, name: str = "doc_index") -> DataFrame:
    """docs from the skip-th on (limit of them, all for 0) with dense 0-based ordinals in order of key."""
    out = ranges.ordinals(docs, key, name).where(F.col(name) >= skip)
    return out.where(F.col(name) < skip + limit) if limit else out


def filtered(docs: DataFrame, language: str, source: str | None = None) -> DataFrame:
    """The columns of a filtered document, defaults for what is missing."""
    have = set(docs.columns)
    column = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    return docs.select(
        column("text").alias("text"), column("url").alias("url"), column("timestamp").alias("timestamp"),
        F.lit(source or f"mc4-{language}").alias("source"), F.col("doc_index").cast("long").alias("doc_index"),
    )


def index_report(docs: DataFrame, matched: DataFrame, language: str, dataset: str, split: str = "train", skip: int = 0) -> DataFrame:
    """One row: how many documents were seen, and the indices of those that matched.

    The row is a report for a file; the list grows with the matched documents, so a large
    run should keep ``matched`` as a table instead.
    """
    seen = docs.agg(F.count("*").alias("total_processed"))
    hits = matched.agg(F.count("*").alias("total_matched"), F.sort_array(F.collect_list("doc_index")).alias("doc_indices"))
    return seen.crossJoin(hits).select(
        F.lit(language).alias("lang"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"),
        F.lit(skip).cast("long").alias("skip_docs"), "total_processed", "total_matched", "doc_indices",
    )


def run_reports(docs: DataFrame, matched: DataFrame, language: str, dataset: str, size: int, split: str = "train") -> DataFrame:
    """A report for each run of size documents; the list of a run has size indices at most."""
    run = F.floor(F.col("doc_index") / size).cast("long").alias("run")
    seen = docs.groupBy(run).agg(F.count("*").alias("total_processed"))
    hits = matched.groupBy(run).agg(F.count("*").alias("total_matched"), F.sort_array(F.collect_list("doc_index")).alias("doc_indices"))
    none = F.array().cast("array<long>")
    return seen.join(hits, "run", "left").select(
        F.lit(language).alias("lang"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), (F.col("run") * size).alias("skip_docs"),
        "total_processed", F.coalesce("total_matched", F.lit(0)).alias("total_matched"), F.coalesce("doc_indices", none).alias("doc_indices"),
    )


def progress_log(docs: DataFrame, matched: DataFrame, every: int = 10_000) -> DataFrame:
    """One row for each batch of documents (doc_index dense): how many were seen and matched, in it and up to its end."""
    batch = F.floor(F.col("doc_index") / every).cast("long").alias("batch")
    seen = docs.groupBy(batch).agg(F.count("*").alias("processed"))
    log = seen.join(matched.groupBy(batch).agg(F.count("*").alias("matched")), "batch", "left").na.fill(0, ["matched"])
    out = ranges.running(ranges.running(log, "batch", "processed", "p"), "batch", "matched", "m")
    total = [(F.col(a) + F.col(b)).alias(f"total_{b}") for a, b in (("p", "processed"), ("m", "matched"))]
    return out.select(((F.col("batch") + 1) * every).alias("upto"), "processed", "matched", *total)


def progress(docs: DataFrame, matched: DataFrame) -> DataFrame:
    """One row of totals and the share of matched documents in percent."""
    a, b = docs.agg(F.count("*").alias("total_processed")), matched.agg(F.count("*").alias("total_matched"))
    share = 100.0 * F.col("total_matched") / F.greatest(F.col("total_processed"), F.lit(1))
    return a.crossJoin(b).withColumn("matched_percent", F.round(share, 4))


def chunked(matched: DataFrame, size: int, key: str = "doc_index") -> DataFrame:
    """matched with the number of the output file of each row."""
    return ordinals(matched, key, name="_at").withColumn("chunk_id", F.floor(F.col("_at") / size).cast("long")).drop("_at")


def unique_prefix(docs: DataFrame, length: int = 500, key: str = "doc_id") -> DataFrame:
    """Of documents with the same first characters the one with the smallest key.

    The prefix decides by itself (no hash of it is compared), and the minimum is
    pre-aggregated, so a prefix that very many documents share gathers nowhere.
    """
    head = F.substring(F.coalesce("text", F.lit("")), 1, length)
    first = docs.groupBy(head.alias("_head")).agg(F.min(key).alias("_first")).select("_first")
    return docs.join(first, F.col(key) == F.col("_first"), "left_semi")


SALTS = 64
"""Parts in which the pairs of an idiom are ranked before they meet."""


def capped(pairs: DataFrame, ranking: DataFrame, cap: int = 10_000, key: str = "doc_id", order=("quality", "n_chars")) -> DataFrame:
    """At most cap documents of each idiom, those that rank first: higher values of order, then smaller keys.

    The pairs of an idiom are first capped in parts, so a very frequent one does not gather in one task.
    """
    best = [*(F.col(c).desc_nulls_last() for c in order), F.col(key)]
    rows = pairs.join(ranking.select(key, *order), key).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    for by in (("idiom", "_salt"), ("idiom",)):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= cap)
    return rows.drop("_salt")


def tagged(docs: DataFrame, pairs: DataFrame, meanings: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with a block appended that lists each idiom found with its meanings.

    meanings: idiom, figurative_meanings, literal_meanings (arrays).
    """
    entry = F.concat(
        F.lit("- "), F.col("idiom"), F.lit(": "), F.array_join("figurative_meanings", "; "),
        F.when(F.size("literal_meanings") > 0, F.concat(F.lit(" (literal: "), F.array_join("literal_meanings", "; "), F.lit(")"))).otherwise(""),
    )
    blocks = (
        pairs.join(meanings, "idiom").select(key, entry.alias("entry")).groupBy(key)
        .agg(F.array_join(F.array_sort(F.collect_set("entry")), "\n").alias("block"))
    )
    return docs.join(blocks, key).withColumn("tagged_text", F.concat("text", F.lit("\n\n"), "block")).drop("block")


def snippets(docs: DataFrame, pairs: DataFrame, context: int = 50, most: int = 0, shard=None, start: int = 0, key: str = "doc_id") -> DataFrame:
    """(idiom, key, snippet), with ``most`` documents of each idiom and shard (0: all) from the start-th on."""
    if most:
        w = Window.partitionBy("idiom", shard if shard is not None else F.lit(0)).orderBy(key)
        pairs = pairs.withColumn("_rn", F.row_number().over(w) - 1).where((F.col("_rn") >= start) & (F.col("_rn") < start + most)).drop("_rn")
    return pairs.join(docs.select(key, "text"), key).select(
        "idiom", key, X.snippet("text", "pattern", context).alias("snippet")
    )


def tokens(c):
    """Lower-case words of a text."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: x != "")


def gram_positions(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text", heads: list[str] | None = None) -> DataFrame:
    """(gram, key, pos): the inverted index of token n-grams; with heads only of those that begin with one of these words."""
    # The generator keeps the array a column: lambdas over it would otherwise split the text for each element.
    cut = docs.select(key, F.explode(F.array(tokens(F.col(text)))).alias("_t")).where(F.size("_t") >= n)
    at = F.sequence(F.lit(0), F.size("_t") - n)
    if heads is not None:
        at = F.filter(at, lambda i: F.element_at("_t", i + 1).isin(heads))
    found = F.transform(at, lambda i: F.struct(i.cast("long").alias("pos"), F.array_join(F.slice("_t", i + 1, n), " ").alias("gram")))
    return cut.select(key, F.explode(found).alias("g")).select("g.gram", key, "g.pos")


FEW_HEADS = 2000
"""First words of phrases up to this number are looked for while a text is read."""


def phrase_occurrences(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", column: str = "idiom") -> DataFrame:
    """(idiom, key, pos) of every occurrence of a phrase as consecutive words; one pass over the texts for each phrase length."""
    named = phrases.select(F.col(column).alias("idiom"), tokens(F.col(column)).alias("t")).where(F.size("t") > 0)
    named = named.select("idiom", F.array_join("t", " ").alias("gram"), F.size("t").alias("n"), F.get("t", F.lit(0)).alias("head"))
    lengths = sorted(r.n for r in named.select("n").distinct().collect())
    out = None
    for n in lengths:
        mine = named.where(F.col("n") == n)
        heads = [r.head for r in mine.select("head").distinct().limit(FEW_HEADS + 1).collect()]
        grams = gram_positions(docs, n, key, heads=heads if len(heads) <= FEW_HEADS else None)
        part = grams.join(mine.select("idiom", "gram"), "gram").select("idiom", key, "pos")
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = docs.schema[key].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"idiom string, `{key}` {kind}, pos long")
    return out


def _gram_counts(docs, grams, text):
    """(gram, n) of every occurrence of grams as consecutive words; each text is read once, and tasks add up what they find."""
    body = F.concat(F.lit(" "), F.array_join(tokens(F.col(text)), " "), F.lit(" "))
    out = None
    for shared in _broadcasts(grams.select(F.col("gram").alias("pattern"))):
        found = docs.select(body.alias("_body")).mapInArrow(_tally(shared), "gram string, n long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("gram").agg(F.sum("n").alias("n"))


def _tally(shared):
    def run(batches):
        import ahocorasick

        machine, total = ahocorasick.Automaton(), Counter()
        for (g,) in shared.value:
            machine.add_word(f" {g} ", g)
        if shared.value:
            machine.make_automaton()
            for batch in batches:
                for body in batch.column(0).to_pylist():
                    total.update(g for _, g in machine.iter(body))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    return run


def occurrence_counts(docs: DataFrame, phrases: DataFrame, min_count: int = 0, key: str = "doc_id", column: str = "idiom") -> DataFrame:
    """(idiom, count) of occurrences in the corpus, zero included; min_count keeps the frequent ones.

    Counted by the automaton over the words of each text, or from the inverted index without that library.
    """
    every = phrases.select(F.col(column).alias("idiom")).where("idiom <> ''").distinct()
    if strategy_for(NESTED + 1) == "automaton":
        named = every.select("idiom", F.array_join(tokens("idiom"), " ").alias("gram"))
        grams = named.where("gram <> ''").select("gram").distinct()
        counted = named.join(_gram_counts(docs, grams, "text"), "gram", "left").select("idiom", F.col("n").alias("count"))
    else:
        found = phrase_occurrences(docs, phrases, key, column).groupBy("idiom").agg(F.count("*").alias("count"))
        counted = every.join(found, "idiom", "left")
    return counted.select("idiom", F.coalesce("count", F.lit(0)).cast("long").alias("count")).where(F.col("count") >= min_count)


def occurrence_report(docs: DataFrame | None, phrases: DataFrame, language: str, min_count: int = 1, languages: tuple[str, ...] = ("en",)) -> DataFrame:
    """(lang, status, idiom, count): frequent phrases; one row that says so where a language has no index or documents are missing."""
    spark = phrases.sparkSession
    if language not in languages:
        return spark.createDataFrame([(language, "skipped", None, None)], "lang string, status string, idiom string, count long")
    if docs is None:
        return spark.createDataFrame([(language, "missing", None, None)], "lang string, status string, idiom string, count long")
    return occurrence_counts(docs, phrases, min_count).select(F.lit(language).alias("lang"), F.lit("ok").alias("status"), "idiom", "count")


def merged_reports(reports: DataFrame) -> DataFrame:
    """Partial index reports of one dataset (lang, dataset, doc_indices, totals) put together, indices in order of the runs' offsets."""
    runs = F.array_sort(F.collect_list(F.struct("skip_docs", "doc_indices")))
    return reports.groupBy("lang", "dataset").agg(
        F.sum("total_processed").alias("total_processed"), F.sum("total_matched").alias("total_matched"),
        F.flatten(F.transform(runs, lambda r: r["doc_indices"])).alias("doc_indices"),
    )
