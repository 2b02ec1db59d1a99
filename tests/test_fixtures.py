"""Small inputs with results worked out by hand."""

import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from idiomill.functions import jsonx
from idiomill.functions import text as X
from idiomill.operators import clusters, entities, instruct, lexicon, match, models, ranges, stats, vectors, wikitext
from idiomill.plans import catalogue, pipelines
from idiomill.sources import readers, writers
from idiomill.streaming import filter as stream


def one(spark, **columns):
    """Values of column expressions over one row."""
    row = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    return row.asDict(recursive=True)


def test_pattern_norm(spark):
    got = one(spark, a=X.pattern(F.lit("Go (Away) now")), b=X.pattern(F.lit("(abc)")), c=X.pattern(F.lit("Kick")))
    assert got == {"a": "go  now", "b": "(abc)", "c": "kick"}


def test_lower_first(spark):
    got = one(spark, a=X.lower_first(F.lit("Kick It")), b=X.lower_first(F.lit("'tis")), c=X.lower_first(F.lit("")))
    assert got == {"a": "kick It", "b": "'tis", "c": ""}


def test_snippet(spark):
    got = one(spark, a=X.snippet(F.lit("abcKICKdef"), F.lit("kick"), 2), b=X.snippet(F.lit("abc"), F.lit("zzz"), 2))
    assert got == {"a": "bcKICKde", "b": ""}


def test_senses(spark):
    got = one(spark, a=X.senses(F.lit("1. Lit. to hit_He hit it._They hit. 2. Fig. to die")), b=X.senses(F.lit("to rest_Rest now")), c=X.senses(F.lit("")))
    assert got["a"] == [
        {"explanation": "to hit", "usage": "literal", "example": ["He hit it.", "They hit."]},
        {"explanation": "to die", "usage": "figurative", "example": []},
    ]
    assert got["b"] == [{"explanation": "to rest", "usage": None, "example": ["Rest now"]}]
    assert got["c"] == []


def test_chinese_examples(spark):
    idiom = F.lit("画蛇添足")
    got = one(
        spark, a=X.examples(F.array(F.lit("～是错的")), idiom), b=X.examples(F.array(F.lit("无")), idiom),
        c=X.examples(F.lit(None).cast("array<string>"), idiom), d=X.examples(F.array(F.lit("~a")), idiom),
    )
    assert got == {"a": ["画蛇添足是错的"], "b": None, "c": None, "d": ["画蛇添足a"]}


def test_markup(spark):
    text = "[[run#Noun|run]] {{l|en|x|Y}} {{m|en|cost|Cost}} {{gloss|g}} {{,}} {{zz|q}}"
    assert one(spark, a=X.clean_markup(F.lit(text)))["a"] == "run Y Cost g ,"
    assert wikitext.clean(text) == "run Y Cost g ,"
    assert one(spark, a=X.synonyms(F.lit("{{syn|en|a|t=b|c}} {{altform|en|d}}")))["a"] == ["a", "c", "d"]
    assert wikitext.synonyms("{{syn|en|a|t=b|c}} {{altform|en|d}}") == ["a", "c", "d"]


def test_fenced_json(spark):
    text = '```json {"summary":"s"} ```'
    got = one(spark, a=jsonx.parse(F.lit(text), "summary string"), b=jsonx.parse(F.lit('{"summary":"s"}'), "summary string"), c=jsonx.parse(F.lit("oops"), "summary string"))
    assert got["a"]["summary"] == got["b"]["summary"] == "s" and got["c"] is None


@pytest.mark.parametrize(("answer", "want"), [("[3,1]", ["z", "x"]), ("[0,9]", []), ("{}", []), ("bad", ["x", "y", "z"])])
def test_index_filter(spark, answer, want):
    assert one(spark, a=jsonx.picked(F.lit(answer), F.array(*map(F.lit, "xyz"))))["a"] == want


def test_single_candidate_is_kept(spark):
    assert one(spark, a=jsonx.picked(F.lit("[]"), F.array(F.lit("x"))))["a"] == ["x"]


def test_nested_lists(spark):
    assert one(spark, a=jsonx.strings(F.lit('["a", ["b", " c "], ""]')))["a"] == ["a", "b", "c"]


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("strategy", ["nested", "grams", "automaton"])
def test_strategies_agree(spark, strategy):
    docs = docs_of(spark, "a KICK in", "kick kick", "none", "This", None, "", "çava kicka")
    pats = match.patterns(spark.createDataFrame([("kick",), ("Kick",), ("is",), ("a",), ("(x) ava",)], "idiom string"))
    got = {(r.doc_id, r.pattern) for r in match.match(docs, pats, "en", strategy).collect()}
    assert got == {(0, "kick"), (0, "a"), (1, "kick"), (3, "is"), (6, "kick"), (6, "a"), (6, "ava")}


def test_chinese_is_matched_exactly(spark):
    pats = match.patterns(spark.createDataFrame([("马",)], "idiom string"), "zh")
    assert match.match(docs_of(spark, "马马虎虎"), pats, "zh").count() == 1


def test_word_boundary(spark):
    pats = match.patterns(spark.createDataFrame([("is",)], "idiom string"))
    got = match.match(docs_of(spark, "This", "it is."), pats, word_boundary=True)
    assert [r.doc_id for r in got.collect()] == [1]


def test_word_boundary_of_phrases_with_points(spark, tmp_path):
    """As in the SQL of whole_word_pairs: a point in a phrase is any character where boundaries are judged; numbers are words, marks are not."""
    texts = ["ster. and er; her, er, and we", "ster. and er", "er. and", "²er. and", "\u0301er. and\u203f", "xer. and er\n and"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "Er. and more")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {tuple(r) for r in con.sql(catalogue.ORACLE_SQL["whole_word_pairs"]).fetchall()}
    assert {tuple(r) for r in catalogue.whole_word_pairs(spark, str(tmp_path)).collect()} == want
    assert {r[0] for r in want} == {0, 2, 4}
    quoted = match.match(docs_of(spark, *texts), match.patterns(spark.createDataFrame([("er. and",)], "idiom string")), word_boundary=True)
    assert {r.doc_id for r in quoted.collect()} == {2, 4}


def test_grams_of_a_long_text(spark):
    """A text of a million characters is cut in proportion to its length; phrases start at each place, over line feeds and outside the plane."""
    docs = docs_of(spark, "ab \U0001f600 " * 200_000 + "kick it", "x\ny\nz kick", "kic", None)
    phrases = ["kick it", "y\nz k", "\U0001f600 ab \U0001f600", "x\ny\n", "kic", "ick i", "none here"]
    pats = spark.createDataFrame([(p, p) for p in phrases], "pattern string, idiom string")
    got = {(r.doc_id, r.pattern) for r in match.match(docs, pats, "en", "grams").collect()}
    assert got == {(0, "kick it"), (0, "ick i"), (0, "kic"), (0, "\U0001f600 ab \U0001f600"), (1, "y\nz k"), (1, "x\ny\n"), (1, "kic"), (2, "kic")}


def test_doc_counts_and_indices(spark):
    docs = docs_of(spark, "a kick", "kick kick", "none")
    lex = spark.createDataFrame([("kick",)], "idiom string")
    got = pipelines.filter_corpus(docs, lex)
    assert [tuple(r) for r in got["counts"].collect()] == [("kick", 2)]
    report = got["report"].first()
    assert report.doc_indices == [0, 1] and report.total_processed == 3 and report.total_matched == 2


def test_skip_and_limit(spark):
    docs = docs_of(spark, *["kick"] * 10)
    got = pipelines.filter_corpus(docs, spark.createDataFrame([("kick",)], "idiom string"), skip=2, limit=2)["report"].first()
    assert got.doc_indices == [2, 3] and got.total_processed == 2


def test_chunks(spark):
    rows = spark.createDataFrame([(i,) for i in range(5)], "doc_index long")
    assert [r.chunk_id for r in match.chunked(rows, 2).orderBy("doc_index").collect()] == [0, 0, 1, 1, 2]


def test_ordinals_are_dense(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("doc_id")).repartition(7)
    got = match.ordinals(rows).orderBy("doc_id").collect()
    assert [r.doc_index for r in got] == list(range(1000))


@pytest.mark.parametrize("kind", ["long", "string", "struct"])
def test_ranges_agree(spark, kind):
    """Many ranges give the positions of one."""
    key = {"long": F.col("k"), "string": F.md5(F.col("k").cast("string")), "struct": F.struct(F.col("k") % 7, F.lit("x"), F.col("k"))}[kind]
    rows = spark.range(5000).select((F.col("id") * 37 % 5000).alias("k")).withColumn("key", key).repartition(5)
    got = ranges.ordinals(rows, "key", "n", rows=300)
    want = [r.k for r in rows.orderBy("key").collect()]
    assert [r.k for r in got.orderBy("n").collect()] == want and sorted(r.n for r in got.collect()) == list(range(5000))


def test_running_sums_over_ranges(spark):
    rows = spark.range(1000).select(F.col("id").alias("idx"), (F.col("id") % 3).alias("n")).repartition(3)
    got = ranges.running(rows, "idx", "n", "s", rows=90).orderBy("idx").collect()
    assert [r.s for r in got] == [sum(j % 3 for j in range(i)) for i in range(1000)]


def test_merge_prefers_pages(spark):
    def source(*idioms):
        return spark.createDataFrame([(i, "d", k) for k, i in enumerate(idioms)], "idiom string, definition string, row_pos long")

    rows = lexicon.ordered([("A", source("Kick the bucket", "Break a leg")), ("wikt", source("kick the bucket")), ("C", source("Kick the bucket", "break a leg"))])
    got = {r.idiom: [s.source for s in r.sources] for r in lexicon.merge(rows, "wikt", ("definition",)).collect()}
    assert got == {"kick the bucket": ["A", "wikt", "C"], "Break a leg": ["A", "C"]}


def test_append(spark):
    old = spark.createDataFrame([("break a leg",)], "idiom string")
    new = spark.createDataFrame([("Break a leg", 0), ("Spill it", 1), ("spill it", 2)], "idiom string, pos long")
    assert [(r.idiom, r.pos) for r in lexicon.appended(old, new).collect()] == [("spill it", 1)]


def test_answers_join(spark):
    requests = spark.createDataFrame([(0, 4, "a"), (0, 5, "b")], "chunk long, index long, idiom string")
    items = json.dumps([{"idiom": "a", "entities": ["v1"]}, {"idiom": "a", "entities": ["v2"]}])
    answers = spark.createDataFrame([(0, items)], "chunk long, response string")
    got = {r.idiom: r.output for r in lexicon.join_answers(requests, answers).collect()}
    assert got["a"].entities == ["v2"] and got["b"] is None


def test_full_outer(spark):
    row = lambda *x: spark.createDataFrame(list(x), "idiom string, value string")
    got = lexicon.full_outer([row(("x", "1")), row(("x", "2")), row(("y", "3")), row(("x", "4"))]).orderBy("idiom").collect()
    assert [tuple(r) for r in got] == [("x", ["1"], ["2"], None, ["4"]), ("y", None, None, ["3"], None)]


def test_presence(spark):
    rows = [(["a"], ["a"]), (["a"], ["b"]), (["a"], []), ([], [])]
    got = entities.presence(spark.createDataFrame(rows, "zh_entities array<string>, en_entities array<string>")).first()
    assert (got.both, got.overlapping, got.different, got.only_zh, got.only_en, got.neither) == (2, 1, 1, 1, 0, 1)


def test_text_fallback(spark):
    idioms = spark.createDataFrame([("copycat", ["x"]), ("dog", ["dog"])], "idiom string, entities array<string>")
    c = lambda e: spark.createDataFrame([(1, e)], "cluster_id long, entity string")
    assert [(r.idiom, r.how) for r in entities.idioms_for_clusters(c("cat"), idioms).collect()] == [("copycat", "text")]
    assert [(r.idiom, r.how) for r in entities.idioms_for_clusters(c("dog"), idioms).collect()] == [("dog", "exact")]


def meanings(spark, rows):
    return spark.createDataFrame(rows, "idiom_idx long, meaning_pos int, embedding array<double>")


@pytest.mark.parametrize("join", [vectors.cross_pairs, vectors.pairs_by_functions])
def test_first_maximum_counts(spark, join):
    zh = meanings(spark, [(0, 0, [1.0, 0.0]), (0, 1, [0.0, 1.0])])
    en = meanings(spark, [(5, 0, [0.0, 1.0]), (5, 1, [1.0, 0.0])])
    got = join(zh, en, 0.7).collect()
    assert [(r.a_idx, r.b_idx, r.a_pos, r.b_pos, r.similarity) for r in got] == [(0, 5, 0, 1, 1.0)]


def test_threshold_is_inclusive(spark):
    a = meanings(spark, [(0, 0, [1.0, 0.0])])
    b = meanings(spark, [(1, 0, [0.5, 0.0]), (2, 0, [0.49, 0.0])])
    assert [r.b_idx for r in vectors.cross_pairs(a, b, 0.5).collect()] == [1]


def test_intra_pairs_over_blocks(spark):
    rows = [(i, p, [float(i % 3 == 0), float(i % 3 == 1), float(p)]) for i in range(30) for p in range(2)]
    df = meanings(spark, rows)
    key = lambda r: (r.a_idx, r.b_idx, r.a_pos, r.b_pos)
    a = sorted(map(key, vectors.intra_pairs(df, 0.9, 8).collect()))
    b = sorted(map(key, vectors.pairs_by_functions(df, df, 0.9, True).collect()))
    assert a == b and a


def test_offsets(spark):
    rows = spark.createDataFrame([(0, 2), (1, 1), (2, 3)], "idx long, n long")
    got = vectors.offsets(rows).orderBy("idx").collect()
    assert [(r.embedding_start_idx, r.embedding_end_idx) for r in got] == [(0, 2), (2, 3), (3, 6)]


def test_clique(spark):
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 3)], "a_idx long, b_idx long")
    assert sorted(r.idx for r in clusters.greedy_cliques(pairs).collect()) == [0, 1, 2]


def test_clique_of_many_pairs(spark):
    """More pairs than the driver takes as rows: 2,203,950 of a whole graph, and a pair beside it."""
    n = spark.range(2100)
    pairs = n.toDF("a_idx").join(n.toDF("b_idx"), F.expr("a_idx < b_idx")).unionByName(spark.range(1).selectExpr("5000L a_idx", "5001L b_idx"))
    got = {tuple(r) for r in clusters.greedy_cliques(pairs).collect()}
    assert got == {(0, i) for i in range(2100)} | {(5000, 5000), (5000, 5001)}


def test_claims_of_many_near_idioms(spark):
    """2,250,000 near idioms of 1500 pairs; the first pair claims all of one side."""
    pairs = spark.range(1500).selectExpr("id pair_id", "id zh_idx", "id en_idx")
    near = spark.range(1500).toDF("pair_id").crossJoin(spark.range(1500).toDF("idx"))
    own = pairs.selectExpr("pair_id", "en_idx idx")
    got = {tuple(r) for r in clusters.claim_clusters(pairs, near, own).collect()}
    assert got == {(0, "zh", i) for i in range(1500)} | {(0, "en", 0)}


def test_claims_by_anchor(spark):
    """Near idioms given once for all pairs with the same anchor."""
    pairs = spark.createDataFrame([(0, 1, 1, 7, 0), (1, 2, 2, 8, 1), (2, 3, 3, 7, 2)], "pair_id long, zh_idx long, en_idx long, zh_anchor long, en_anchor long")
    zh = spark.createDataFrame([(7, 2), (7, 1), (8, 9)], "anchor_id long, idx long")
    en = spark.createDataFrame([(0, 1), (2, 4)], "anchor_id long, idx long")
    got = {tuple(r) for r in clusters.claim_clusters(pairs, zh, en).collect()}
    assert got == {(0, "zh", 1), (0, "zh", 2), (0, "en", 1), (2, "zh", 3), (2, "en", 3), (2, "en", 4)}


def test_products_do_not_depend_on_places(spark):
    """Similarities to the last bit as SQL adds them up, so that equal vectors tie."""
    rng = random.Random(4)
    vector = [rng.gauss(0, 0.125) for _ in range(64)]
    rows = [(i, p, np.float32([x + rng.gauss(0, 0.05) * (i % 3) for x in vector]).tolist()) for i in range(60) for p in range(2)]
    a = meanings(spark, rows)
    got = {tuple(r) for r in vectors.cross_pairs(a, a, 0.3, 32).collect()}
    assert got == {tuple(r) for r in vectors.pairs_by_functions(a, a, 0.3).collect()} and got


def test_cluster_claims(spark):
    pairs = spark.createDataFrame([(0, 1, 1), (1, 1, 2), (2, 2, 2)], "pair_id long, zh_idx long, en_idx long")
    none = spark.createDataFrame([], "pair_id long, idx long")
    got = {(r.pair_id, r.side, r.idx) for r in clusters.claim_clusters(pairs, none, none).collect()}
    assert got == {(0, "zh", 1), (0, "en", 1), (2, "zh", 2), (2, "en", 2)}


def test_formatted_clusters(spark):
    members = spark.createDataFrame([(0, "zh", 1), (0, "en", 1), (0, "en", 2), (1, "zh", 3), (1, "en", 4)], "pair_id long, side string, idx long")
    meta = lambda *x: spark.createDataFrame([(i, n, [m], []) for i, n, m in x], "idx long, idiom string, figurative_meanings array<string>, entities array<string>")
    pairs = spark.createDataFrame(
        [(0, "", "zm", [], ["f"], "z1", "e1"), (1, None, "", ["ef"], [], "z3", "e4")],
        "pair_id long, en_matched_meaning string, zh_matched_meaning string, en_figurative_meanings array<string>, zh_figurative_meanings array<string>, zh_idiom string, en_idiom string",
    )
    got = clusters.formatted(members, meta((1, "z1", "a"), (3, "z3", "b")), meta((1, "e1", "c"), (2, "e2", "d"), (4, "e4", "e")), pairs).collect()
    assert [(r.shared_meaning, r.zh_idiom_count, r.en_idiom_count, r.anchor_zh_idiom) for r in got] == [("zm", 1, 2, "z1"), ("ef", 1, 1, "z3")]
    sizes = clusters.size_summary(members).first()
    assert (sizes.clusters, sizes.en_max, sizes.zh_sum) == (2, 2, 2)


def test_missing_lexicon(spark, tmp_path):
    (tmp_path / "en.jsonl").write_text("{}")
    files = {"en": str(tmp_path / "en.jsonl"), "zh": str(tmp_path / "no.jsonl")}
    assert readers.idiom_file(spark, files, "en") == files["en"]
    with pytest.warns(UserWarning, match="no idiom file"):
        assert readers.idiom_file(spark, files, "zh") is None
    pages = spark.createDataFrame([("a.pdf", "one\ftwo")], "path string, text string")
    assert [r.page for r in readers.pdf_pages(pages).orderBy("page_no").collect()] == ["one", "two"]


def test_entity_claims(spark):
    rows = [(0, "en_to_zh", "dog", ["dog"], ["gou"]), (1, "zh_to_en", "gou", ["gou"], ["dog"]), (2, "zh_to_en", "ma", ["ma"], ["horse"])]
    got = clusters.claim_entity_pairs(spark.createDataFrame(rows, "order long, direction string, seed string, members array<string>, targets array<string>"))
    assert [r.order for r in got.orderBy("order").collect()] == [0, 2]


def test_pool(spark):
    idioms = spark.createDataFrame([(f"i{k}",) for k in range(7)], "idiom string")
    contexts = spark.createDataFrame([(k,) for k in range(5)], "ctx_id long")
    got = instruct.drawn(idioms, contexts, 3).collect()
    used = [i for r in got for i in r.idioms]
    assert len(got) == 2 and len(used) == len(set(used)) == 6


@pytest.mark.parametrize(("language", "n", "good"), [("en", 99, False), ("en", 100, True), ("zh", 49, False), ("zh", 50, True)])
def test_output_length(spark, language, n, good):
    qa = F.struct(F.lit("q").alias("input"), F.lit("x" * n).alias("output"))
    assert one(spark, a=instruct.is_valid(qa, language))["a"] is good


def test_equal_input_and_output(spark):
    qa = F.struct(F.lit("x" * 200).alias("input"), F.lit("x" * 200).alias("output"))
    assert one(spark, a=instruct.is_valid(qa, "en"))["a"] is False


def test_group_names(spark):
    got = one(spark, a=instruct.group_name(F.lit("Chinese Students")), b=instruct.group_name(F.lit("Overseas Chinese")))
    assert got == {"a": "中国学生", "b": "overseas 中国"}


def test_stats(spark):
    rows = [("a b", ["x", "y"], None, None), ("c", None, None, None)]
    got = stats.describe(spark.createDataFrame(rows, "idiom string, entities array<string>, literal_meanings array<string>, figurative_meanings array<string>")).first()
    assert (got.words_mean, got.words_std, got.words_median) == (1.5, 0.5, 1.5)
    assert (got.entities_mean, got.entities_max, got.entities_unique) == (1.0, 2.0, 2)


def test_trivial(spark):
    out = "output struct<idiom:string, figurative_meanings:array<string>>"
    rows = [("a", ("a", [])), ("b", ("b", ["m"])), ("c", None)]
    assert [r.idiom for r in lexicon.without_trivial(spark.createDataFrame(rows, f"idiom string, {out}")).collect()] == ["b"]


PAGE = """==English==
===Verb===
{{en-verb}}
# {{lb|en|informal}} To [[hit#Verb|hit]]. A note.
#: {{ux|en|He [[hit]] it.}}
#: {{syn|en|strike|id=x}}
## {{non-gloss|Used {{m|en|as|As}} a name. Fully.}}
# {{syn of|en|boot<id:q>||to kick out}}
====See also====
* {{l|en|kick the bucket}}
===Noun===
no senses here {{altform|en|kik}}
==French==
===Verbe===
# non
"""


def test_page():
    definitions, patterns = wikitext.parse_page(PAGE)
    assert definitions == [
        ("verb", "To hit", None, ["He hit it."]),
        ("verb", "Used As a name. Fully.", None, []),
        ("verb", "to kick out", None, []),
    ]
    assert patterns == ["kick the bucket", "strike", "boot", "kik"]
    assert wikitext.parse_page("==French==\n# x") is None
    assert wikitext.parse_page("== English ==\n# x") is None
    assert wikitext.parse_page("== English ==\n# x", tolerant=True)[0] == [("english", "x", None, [])]
    assert wikitext.parse_page(None) is None


def test_repeated_heading_goes_on():
    tree = wikitext.sections("==A==\nx\n==B==\ny\n==A==\nz").children
    assert tree["==A=="].lines == ["x", "", "z"]


def test_batch_errors_do_not_spread(spark):
    class Half:
        def complete(self, messages, **options):
            if messages[0]["content"] == "bad":
                raise ValueError("no")
            return "ok"

    rows = spark.createDataFrame([(0, [("user", "x")]), (1, [("user", "bad")])], "idx long, messages array<struct<role:string, content:string>>")
    got = {r.idx: (r.response, r.error) for r in models.completed(rows, Half, "half", attempts=1).collect()}
    assert got == {0: ("ok", None), 1: (None, "ValueError: no")}


def test_retry():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert models.with_retry(flaky, sleep=lambda s: None) == 7 and len(calls) == 3


def test_chunks_are_tried_again(spark, tmp_path):
    class Sometimes:
        def complete(self, messages, **options):
            if messages[0]["content"] == "never":
                raise ValueError("no")
            return "ok"

    rows = spark.createDataFrame([(0, [("user", "x")]), (1, [("user", "never")])], "chunk long, messages array<struct<role:string, content:string>>")

    def keep(df, k):
        df.write.parquet(f"{tmp_path}/{k}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{k}")

    got = models.completed_chunks(rows, Sometimes, keep, model="sometimes").collect()
    assert [(r.chunk, r.response) for r in got] == [(0, "ok")]


def test_embedder_is_normalised(spark):
    rows = spark.createDataFrame([("kick the bucket",), ("",)], "meaning string")
    from idiomill.functions import vectors as V

    got = models.embedded(rows, models.HashEmbedder, "meaning").select(F.round(V.norm("embedding"), 4).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-3 for r in got)


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"idiom": "x"}\n\n{bad\n{"idiom": ""}\n')
    rows = readers.jsonl(spark, str(tmp_path / "a.jsonl"), "idiom string", strict=False)
    assert [r.idiom for r in readers.idiom_set(rows).collect()] == ["x"]
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        readers.jsonl(spark, str(tmp_path / "a.jsonl"), "idiom string").collect()
    (tmp_path / "d.json").write_text(json.dumps({"dictionary": [{"phrase": "p", "definition": "d"}]}))
    assert readers.json_member(spark, str(tmp_path / "d.json"), "dictionary", "phrase string, definition string").first().phrase == "p"
    (tmp_path / "e.json").write_text(json.dumps([{"word": "w", "derivation": None, "explanation": "e", "example": "～x"}]))
    got = readers.xinhua(readers.json_array(spark, str(tmp_path / "e.json"), "word string, derivation string, explanation string, example string")).first()
    assert tuple(got) == ("w", "e", ["wx"], None)
    (tmp_path / "k.txt").write_text("成语,甲,乙\n\nnone\n")
    assert [tuple(r) for r in readers.key_value_lines(spark, str(tmp_path / "k.txt")).collect()] == [("成语", "甲,乙")]
    (tmp_path / "t.tsv").write_text("a\tb\n")
    assert tuple(readers.tsv(spark, str(tmp_path / "t.tsv")).first()) == ("a", "b")
    got = readers.peek(spark, str(tmp_path / "a.jsonl"), 3, "idiom").orderBy("line_no").collect()
    assert [r.shown for r in got] == ["x", "malformed", "malformed"]


def test_culture_tables(spark, tmp_path):
    head = "cultural group,context,goal,relation,topic,actor_behavior,eval_whole_desc\n"
    for tag in ("reddit", "tiktok"):
        (tmp_path / f"culturebank_{tag}.csv").write_text(head + 'Chinese,"a, ""b""\nc",,,,,\n')
    got = readers.culture_tables(spark, [str(tmp_path / f"culturebank_{t}.csv") for t in ("reddit", "tiktok")]).collect()
    assert sorted(r.source for r in got) == ["reddit", "tiktok"]
    assert got[0].context == 'a, "b"\nc' and got[0].goal == ""
    with pytest.raises(FileNotFoundError):
        readers.culture_tables(spark, [])


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "doc_index long, text string")
    writers.chunks(rows, str(tmp_path / "c"), 2)
    assert sorted(r["count"] for r in spark.read.json(str(tmp_path / "c")).groupBy("chunk_id").count().collect()) == [1, 2, 2]
    writers.json_array(rows, str(tmp_path / "j"), ["doc_index"])
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "j"), wholetext=True).collect())
    assert [x["doc_index"] for x in json.loads(text)] == [0, 1, 2, 3, 4]
    writers.jsonl(rows, str(tmp_path / "l"), compress=True)
    writers.appended(rows, str(tmp_path / "l2"))
    writers.appended(rows, str(tmp_path / "l2"))
    assert spark.read.json(str(tmp_path / "l2")).count() == 10
    writers.rolling(rows, str(tmp_path / "r"), 2)
    writers.csv(rows.withColumn("a", F.array("text")), str(tmp_path / "v"))
    counts = spark.createDataFrame([("a", 1), ("b", 3)], "idiom string, doc_count long")
    assert writers.counts(counts, "en", 9, str(tmp_path / "n"))
    assert not writers.counts(counts.where("false"), "en", 9, str(tmp_path / "n0"))
    text = spark.read.text(str(tmp_path / "n")).first().value
    assert text.index('"b":3') < text.index('"a":1')
    assert readers.chunk_files(spark, str(tmp_path / "r"), "part")


def test_crawl(spark):
    pages = {None: (["a"], "t"), "t": (["b", "c"], None)}

    def text(title):
        if title == "b":
            raise OSError
        return f"text of {title}"

    got = readers.crawled(spark, lambda token: pages[token], text, sleep=lambda s: None)
    assert {tuple(r) for r in got.collect()} == {("a", "text of a"), ("b", ""), ("c", "text of c")}


def test_stream_resumes(spark, tmp_path):
    pats = match.patterns(spark.createDataFrame([("kick",)], "idiom string"))
    for k, texts in enumerate((["a kick", "none"], ["kick on"])):
        spark.createDataFrame([(10 * k + i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/in/{k}.parquet")
        source = spark.readStream.schema("doc_id long, text string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        stream.run_filter(source, pats, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        got = sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
        assert got == ([0] if k == 0 else [0, 10])
    stream.run_counts(source, pats, "kicks", f"{tmp_path}/check2").awaitTermination()
    assert [tuple(r) for r in spark.table("kicks").collect()] == [("kick", 2)]


def test_stream_prefix(spark, tmp_path):
    spark.createDataFrame([(0, "aab"), (1, "aac"), (2, "b")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = stream.documents(spark, f"{tmp_path}/in", "doc_id long, text string")
    stream.unique_prefix(source, 2).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/o").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/o").count() == 2


def test_stream_windows(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' event_type union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 03:00:00', 'a'")
    rows.write.parquet(f"{tmp_path}/in")
    source = stream.documents(spark, f"{tmp_path}/in", "ts timestamp, event_type string")
    got = stream.windowed_counts(source).writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    got.awaitTermination()
    assert [r.n for r in spark.table("w").collect()] == [2]


def test_lexicon_pipeline(spark):
    pages = spark.createDataFrame([("kick", PAGE), ("none", "==French==")], "idiom string, wikitext string")
    entry = "array<map<string,struct<explanation:string,usage:string,example:array<string>>>>"
    other = spark.createDataFrame([("Kick", [], [])], f"idiom string, definition {entry}, patterns array<string>")
    got = pipelines.build_lexicon(pages, [("kb", other)]).collect()
    assert [(r.idiom, r["index"], len(r.sources)) for r in got] == [("kick", 0, 2)]
    assert len(lexicon.extracted_meanings(pipelines.build_lexicon(pages, [("kb", other)])).first().meanings) == 3


def test_entity_cluster_pairs_takes_all_frequent_entities(spark, sf_dir):
    from idiomill.plans import catalogue, proxies

    best = {r.entity for r in entities.top(entities.counts(proxies.idioms(spark, sf_dir)), 500).collect()}
    got = catalogue.QUERIES["entity_cluster_pairs"](spark, sf_dir).collect()
    assert len(best) > 5 and {r.seed for r in got if r.direction == "en_to_zh"} == best


@pytest.mark.parametrize("strategy", ["nested", "automaton", "grams"])
def test_rows_are_judged_by_their_own_text(spark, strategy):
    """Null and repeated keys make no difference to which rows match."""
    rows = [(None, "kick the bucket"), (1, "he KICKS the bucket"), (1, "nothing"), (2, None), (3, "kick the bucket")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pats = match.patterns(spark.createDataFrame([("the bucket",), ("it",)], "idiom string"))
    got = match.matching_docs(docs, pats, strategy=strategy).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("1", "he KICKS the bucket"), ("3", "kick the bucket"), ("None", "kick the bucket")]


@pytest.mark.parametrize("most", [0, 64])
def test_stream_strategies(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(match, "NESTED", most)
    spark.createDataFrame([(1, "Kick it"), (2, None), (3, "kick and kick it")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    source = stream.documents(spark, f"{tmp_path}/in", "doc_id long, text string")
    pats = match.patterns(spark.createDataFrame([("kick",), ("it",)], "idiom string"))
    name = f"strategy_{most}"
    stream.run_counts(source, pats, name, f"{tmp_path}/check").awaitTermination()
    assert {(r.idiom, r.doc_count) for r in spark.table(name).collect()} == {("kick", 2), ("it", 2)}


def test_cap_over_parts(spark):
    pairs = spark.createDataFrame([("a", "a", i) for i in range(500)], "pattern string, idiom string, doc_id long")
    ranking = spark.createDataFrame([(i, i % 2, i % 10) for i in range(500)], "doc_id long, quality int, n_chars int")
    got = [(r.rank, r.doc_id) for r in match.capped(pairs, ranking, 100).collect()]
    want = sorted(range(500), key=lambda i: (-(i % 2), -(i % 10), i))[:100]
    assert sorted(got) == list(enumerate(want, 1))


def test_large_sides_are_not_broadcast(spark):
    from idiomill.operators import sizes

    df = spark.range(20)
    assert sizes.is_small(df, 20) and not sizes.is_small(df, 19)
    assert spark.range(5).join(sizes.small(df, 3), "id").count() == 5
