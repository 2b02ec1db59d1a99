"""Entities of idioms: counts, lookups, pairs of languages, themes and site tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx, text as X
from . import match


def mentions(idioms: DataFrame, array: str = "entities") -> DataFrame:
    """(idiom, entity) with repeats; null arrays have none."""
    return idioms.select("idiom", F.explode(array).alias("entity"))


def counts(idioms: DataFrame, array: str = "entities") -> DataFrame:
    """(entity, n) of all mentions."""
    return mentions(idioms, array).groupBy("entity").agg(F.count("*").alias("n"))


def top(counted: DataFrame, k: int) -> DataFrame:
    """The k most frequent entities; of equals those that sort first."""
    return counted.orderBy(F.desc("n"), "entity").limit(k)


def density(counted: DataFrame, rows: DataFrame) -> DataFrame:
    """counted with the share of all rows."""
    total = rows.agg(F.count("*").alias("_rows"))
    return counted.crossJoin(F.broadcast(total)).withColumn("density", F.col("n") / F.greatest("_rows", F.lit(1))).drop("_rows")


def hash_order(seed: int, *columns: str) -> Column:
    """A seeded order that other engines can reproduce."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def sampled(rows: DataFrame, n: int, seed: int, *key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n rows in seeded order: of each group in ``by``, or of all."""
    if not by:
        return rows.orderBy(hash_order(seed, *key), *key).limit(n)
    w = Window.partitionBy(*by).orderBy(hash_order(seed, *key), *key)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def idioms_with(entities: DataFrame, idioms: DataFrame, most: int = 20, seed: int = 42) -> DataFrame:
    """(entity, idiom): up to ``most`` idioms for each entity, chosen by a seeded hash."""
    found = mentions(idioms).distinct().join(entities.select("entity").distinct(), "entity")
    return sampled(found, most, seed, "idiom", by=("entity",))


def _containing(idioms: DataFrame, words: DataFrame) -> DataFrame:
    """Idioms joined with the rows of words (entity) whose entity their text contains; each idiom is read once."""
    names = idioms.select("idiom").distinct()
    pats = words.select(F.col("entity").alias("pattern"), F.col("entity").alias("idiom")).distinct()
    found = match.match(names.select(F.col("idiom").alias("name")), pats, "", key="name", text="name")
    return found.select(F.col("name").alias("idiom"), F.col("pattern").alias("entity")).join(words, "entity")


def idioms_for_clusters(clusters: DataFrame, idioms: DataFrame, most: int = 20, seed: int = 42) -> DataFrame:
    """(cluster_id, idiom, how): idioms that have an entity of the cluster (cluster_id, entity).

    Only clusters of which no entity occurs are matched with idioms whose text contains
    one. An idiom counts once for a cluster.
    """
    exact = clusters.join(mentions(idioms), "entity").select("cluster_id", "idiom").distinct().withColumn("how", F.lit("exact"))
    left = clusters.join(exact.select("cluster_id").distinct(), "cluster_id", "left_anti").where("entity <> ''")
    inside = _containing(idioms, left)
    loose = inside.select("cluster_id", "idiom").distinct().withColumn("how", F.lit("text"))
    return sampled(exact.unionByName(loose), most, seed, "idiom", by=("cluster_id",))


def idioms_for_translations(translations: DataFrame, idioms: DataFrame, most: int = 20, seed: int = 42) -> DataFrame:
    """(entity, idioms, matched): for each entity the idioms of its translations (entity, translation, pos), and the translations that had any."""
    ready = translations.select(F.col("entity").alias("source"), F.col("translation").alias("entity")).distinct()
    exact = ready.join(mentions(idioms).distinct(), "entity")
    capped = sampled(exact, most, seed, "idiom", by=("source", "entity"))
    rest = ready.join(capped.select("source").distinct(), "source", "left_anti").where("entity <> ''")
    loose = _containing(idioms, rest)
    loose = sampled(loose.select("entity", "source", "idiom"), most, seed, "idiom", by=("source",))
    both = capped.select("source", "entity", "idiom").unionByName(loose.select("source", "entity", "idiom"))
    return both.groupBy(F.col("source").alias("entity")).agg(
        F.array_sort(F.collect_set("idiom")).alias("idioms"), F.array_sort(F.collect_set("entity")).alias("matched")
    )


# --- pairs of languages -------------------------------------------------------------


def presence(pairs: DataFrame) -> DataFrame:
    """One row: on which sides pairs (zh_entities, en_entities) have entities, and whether they share one."""
    zh, en = (F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0)) > 0 for c in ("zh_entities", "en_entities"))
    share = F.coalesce(F.arrays_overlap("zh_entities", "en_entities"), F.lit(False))
    return pairs.agg(
        F.count("*").alias("total"),
        F.count_if(zh & en).alias("both"),
        F.count_if(zh & en & share).alias("overlapping"),
        F.count_if(zh & en & ~share).alias("different"),
        F.count_if(zh & ~en).alias("only_zh"),
        F.count_if(~zh & en).alias("only_en"),
        F.count_if(~zh & ~en).alias("neither"),
    )


def presence_shares(pairs: DataFrame) -> DataFrame:
    """One row: percentages of the same, and mean numbers of entities."""
    zh, en = (F.coalesce(F.size(c), F.lit(0)) for c in ("zh_entities", "en_entities"))
    percent = lambda c: F.round(F.avg(c.cast("int")) * 100, 6)
    return pairs.agg(
        percent(zh > 0).alias("zh_percent"), percent(en > 0).alias("en_percent"), percent((zh > 0) & (en > 0)).alias("both_percent"),
        F.round(F.avg(zh), 6).alias("mean_zh"), F.round(F.avg(en), 6).alias("mean_en"),
    )


def pair_entities(pairs: DataFrame, side: str) -> DataFrame:
    """(entity, n): pairs in which each entity of a side occurs."""
    return pairs.select(F.explode(F.array_distinct(f"{side}_entities")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n"))


def cooccurrence(pairs: DataFrame) -> DataFrame:
    """(zh_entity, en_entity, n) over the product of the two lists of each pair."""
    one = pairs.select(F.explode("zh_entities").alias("zh_entity"), "en_entities")
    return one.select("zh_entity", F.explode("en_entities").alias("en_entity")).groupBy("zh_entity", "en_entity").agg(F.count("*").alias("n"))


def partners(co: DataFrame, k: int = 5, of: str = "zh_entity", other: str = "en_entity") -> DataFrame:
    """The k most frequent partners of each entity, with their rank."""
    w = Window.partitionBy(of).orderBy(F.desc("n"), other)
    return co.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def categories(counted: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """(category, n): mentions rolled up by the category of the entity."""
    return counted.groupBy(X.category("entity", keywords).alias("category")).agg(F.sum("n").cast("long").alias("n"))


def similar_with_entities(pairs: DataFrame, least: float = 0.8, k: int = 20) -> DataFrame:
    """The k most similar pairs that have entities on both sides."""
    return pairs.where((F.col("similarity") >= least) & (F.size("zh_entities") > 0) & (F.size("en_entities") > 0)).orderBy(F.desc("similarity"), "a_idx", "b_idx").limit(k)


def summary(pairs: DataFrame, zh: DataFrame, en: DataFrame) -> DataFrame:
    """One row: totals, distinct entities, mean and median similarity, the most frequent entity of each side."""
    base = pairs.agg(F.count("*").alias("pairs"), F.round(F.avg("similarity"), 4).alias("mean_similarity"), F.round(F.median("similarity"), 4).alias("median_similarity"))
    for side, c in (("zh", zh), ("en", en)):
        first = F.struct(-F.col("n"), F.col("entity"))
        base = base.crossJoin(c.agg(F.count("*").alias(f"{side}_entities"), F.min_by("entity", first).alias(f"top_{side}")))
    return base


def themes(analyses: DataFrame, column: str = "cultural_analysis") -> DataFrame:
    """(field, theme, n): how often each entry stands in each list of parsed analyses."""
    got = analyses.select(jsonx.parse(jsonx.fenced_object(column), jsonx.ANALYSIS).alias("a"))
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"a.{n}").alias("items")) for n in jsonx.LISTS)))
    return got.select(cells.alias("c")).select("c.field", F.explode("c.items").alias("theme")).groupBy("field", "theme").agg(F.count("*").alias("n"))


def rich(clusters: DataFrame, least: int = 3) -> DataFrame:
    """Cluster pairs with at least so many idioms on each side, largest first."""
    zh, en = F.size("idioms_zh"), F.size("idioms_en")
    return clusters.where((zh >= least) & (en >= least)).orderBy(F.desc(zh + en), "cluster_id")


def first_match(clusters: DataFrame, query: str) -> DataFrame:
    """The first cluster pair whose English entity contains the query, in any case, or whose Chinese one does."""
    hit = F.lower("entity_en").contains(query.lower()) | F.col("entity_zh").contains(query)
    return clusters.where(hit).orderBy("cluster_id").limit(1)


def site_tabs(analysed: DataFrame) -> DataFrame:
    """Rows of the site's first table with parsed analyses; rows of neither direction are dropped."""
    body = jsonx.fenced_object("cultural_analysis")
    empty = F.from_json(F.lit("{}"), jsonx.ANALYSIS)
    parsed = F.coalesce(F.when(jsonx.is_json(body), F.from_json(body, jsonx.ANALYSIS)), empty)
    return analysed.where(F.col("direction").isin("en_to_zh", "zh_to_en")).withColumn("analysis", parsed).drop("cultural_analysis")


def site_page(tabs: DataFrame, direction: str, page: int, size: int = 20, key: str = "cluster_id") -> DataFrame:
    """The records of one page (0-based) of a tab, in order of key."""
    return match.ordinals(tabs.where(F.col("direction") == direction), key, skip=page * size, limit=size, name="row")


def direction_counts(analysed: DataFrame) -> DataFrame:
    return analysed.groupBy("direction").agg(F.count("*").alias("n"))


def translated(entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """entities with their translation, the entity itself where the dictionary has none."""
    return entities.join(dictionary, "entity", "left").withColumn("translation", F.coalesce("translation", "entity"))


def before_after(before: DataFrame, after: DataFrame, array: str = "translations") -> DataFrame:
    """One row: list entries before and after a filter."""
    total = lambda df, n: df.agg(F.coalesce(F.sum(F.size(array)), F.lit(0)).cast("long").alias(n))
    return total(before, "before").crossJoin(total(after, "after"))


def unpaired(candidates: DataFrame, existing: DataFrame, key: str = "entity_zh") -> DataFrame:
    """Candidates whose Chinese entity has no pair yet; the first of equals by pos."""
    w = Window.partitionBy(key).orderBy("pos")
    fresh = candidates.join(existing.select(key).distinct(), key, "left_anti")
    return fresh.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
