"""Instruction data: contexts meet idioms, prompts are rendered, answers are checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsonx, text as X
from .entities import hash_order
from .ranges import running

PER_CONTEXT = 5
LEAST_OUTPUT = {"zh": 50, "en": 100}

# The kinds of answers, in turn; what stands for missing fields, and names of groups in Chinese.
ANSWER_TYPES = ("cultural_behavior_explanation", "cultural_value_analysis", "cultural_norm_reasoning")
MISSING = {
    "en": {"cultural_group": "General", "context": "everyday situations", "topic": "Culture", "actor_behavior": "various behaviors", "goal": "N/A", "relation": "N/A"},
    "zh": {"cultural_group": "一般", "context": "日常生活", "topic": "文化", "actor_behavior": "各种行为", "goal": "N/A", "relation": "N/A"},
}
GROUPS = {
    "chinese": "中国人", "chinese people": "中国人", "chinese students": "中国学生", "chinese immigrants": "中国移民",
    "chinese americans": "华裔美国人", "malaysian chinese": "马来西亚华人",
}
LANGUAGE_GROUP = {"zh": "chinese", "en": "english"}

SYSTEM = {
    "en": "You write instruction data that is grounded in a culture and its figurative expressions. Answer with JSON.",
    "zh": "你负责编写植根于文化及其习语的指令数据。请用JSON回答。",
}
USER = {
    "en": (
        "Group: {cultural_group}\nSituation: {context}\nTopic: {topic}\nBehaviour: {actor_behavior}\nGoal: {goal}\nRelation: {relation}\n"
        "{description}Expressions:\n{knowledge}\n\n"
        "Choose the expression that fits best and write one question and its answer of the kind '{answer_type}'. "
        'Return {"input": "...", "output": "..."} in a json fence.'
    ),
    "zh": (
        "群体：{cultural_group}\n情境：{context}\n话题：{topic}\n行为：{actor_behavior}\n目标：{goal}\n关系：{relation}\n"
        "{description}习语：\n{knowledge}\n\n"
        "请选择最合适的习语，写出一个问题及其“{answer_type}”类型的回答。"
        '在json代码块中返回 {"input": "...", "output": "..."}。'
    ),
}


def of_language(contexts: DataFrame, language: str) -> DataFrame:
    """Contexts whose group names the language's; a null group does not."""
    return contexts.where(F.lower("cultural_group").contains(LANGUAGE_GROUP[language]))


def group_name(c) -> Column:
    """A group's name in Chinese."""
    c = F.col(c) if isinstance(c, str) else c
    low = F.lower(c)
    names = F.create_map(*(F.lit(x) for pair in GROUPS.items() for x in pair))
    replaced = X.strip(F.replace(low, F.lit("chinese"), F.lit("中国")))
    return F.coalesce(F.try_element_at(names, X.strip(low)), F.when(low.contains("chinese"), replaced), c)


def pool_size(pool: DataFrame, contexts: DataFrame, per_context: int = PER_CONTEXT) -> int:
    """How many contexts the pool can serve, each with its own idioms."""
    return min(contexts.count(), pool.count() // per_context)


def drawn(pool: DataFrame, contexts: DataFrame, per_context: int = PER_CONTEXT, seed: int = 42, key: str = "idiom", context_key: str = "ctx_id") -> DataFrame:
    """(context_key, ctx_rn, idioms): idioms in seeded order are dealt to contexts in seeded order, each once.

    Contexts that the pool cannot serve in full get none.
    """
    from .match import ordinals

    n = pool_size(pool, contexts, per_context)
    deal = lambda df, k: ordinals(df.withColumn("_o", F.concat(hash_order(seed, k), F.lit("|"), F.col(k).cast("string"))), "_o", name="_rn").drop("_o")
    idioms = deal(pool.select(key), key).withColumn("ctx_rn", F.floor(F.col("_rn") / per_context)).where(F.col("ctx_rn") < n)
    dealt = idioms.groupBy("ctx_rn").agg(F.array_sort(F.collect_list(F.struct("_rn", F.col(key).alias("idiom")))).alias("a"))
    dealt = dealt.select("ctx_rn", F.transform("a", lambda x: x["idiom"]).alias("idioms"))
    turns = deal(contexts.select(context_key), context_key).withColumnRenamed("_rn", "ctx_rn")
    return turns.join(dealt, "ctx_rn").select(context_key, "ctx_rn", "idioms")


def with_answer_types(rows: DataFrame, rn: str, key: str, seed: int = 42, share: float = 0.2) -> DataFrame:
    """rows with answer_type: a seeded fifth by hash; the others in turn, in order of rn, which random ones do not advance."""
    types = F.array(*(F.lit(t) for t in ANSWER_TYPES))
    spin = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long")
    chance = spin < share * (1 << 32)
    turned = running(rows.withColumn("_own", F.when(chance, 0).otherwise(1)), rn, "_own", "_turn")
    at = F.pmod(F.when(chance, spin).otherwise(F.col("_turn")), F.lit(len(ANSWER_TYPES))) + 1
    return turned.withColumn("answer_type", F.element_at(types, at.cast("int"))).drop("_own", "_turn")


def analysis_index(clusters: DataFrame) -> DataFrame:
    """(entity, analysis): the parsed analysis of the last cluster (cluster_pos, entities, cultural_analysis) that has the entity."""
    parsed = clusters.withColumn("analysis", jsonx.parse("cultural_analysis", jsonx.ANALYSIS)).where("analysis is not null")
    rows = parsed.select(F.explode("entities").alias("entity"), "cluster_pos", "analysis")
    return rows.groupBy("entity").agg(F.max_by("analysis", "cluster_pos").alias("analysis"))


def first_analysis(contexts: DataFrame, entities: DataFrame, index: DataFrame, key: str = "ctx_id") -> DataFrame:
    """contexts with the first analysis found over candidates and their entities (key, cand_pos, ent_pos, entity), or null."""
    best = entities.join(index, "entity").groupBy(key).agg(F.min_by("analysis", F.struct("cand_pos", "ent_pos")).alias("analysis"))
    return contexts.join(best, key, "left")


def knowledge(candidates, language: str) -> Column:
    """Lines of candidates (idiom, figurative_meanings, literal_meanings): up to three and two meanings."""

    def line(c):
        fig = F.array_join(F.slice(c["figurative_meanings"], 1, 3), "; ")
        lit = F.array_join(F.slice(F.coalesce(c["literal_meanings"], F.array().cast("array<string>")), 1, 2), "; ")
        if language == "zh":
            head, tail = F.concat(F.lit("- "), c["idiom"], F.lit(": "), fig), F.concat(F.lit(" (出处: "), lit, F.lit(")"))
        else:
            head, tail = F.concat(F.lit('- "'), c["idiom"], F.lit('": '), fig), F.concat(F.lit(" (literal: "), lit, F.lit(")"))
        return F.when(lit != "", F.concat(head, tail)).otherwise(head)

    return F.array_join(F.transform(candidates, line), "\n")


def prompt(language: str, candidates, answer, limit: int = 600) -> Column:
    """System and user message of a context row."""
    description = F.lit("" if language == "zh" else "Full Description: ")
    fields = {c: X.default(group_name(c) if c == "cultural_group" and language == "zh" else c, d) for c, d in MISSING[language].items()}
    fields |= {
        "description": F.when(X.non_empty("eval_whole_desc").isNotNull(), F.concat(F.lit("- "), description, F.left("eval_whole_desc", F.lit(limit)), F.lit("\n\n"))).otherwise("\n"),
        "knowledge": knowledge(candidates, language),
        "answer_type": answer,
    }
    # The template is cut at its fields and joined, so a value that looks like a field stays as it is.
    parts, rest = [], USER[language]
    while rest:
        at = min((rest.find("{" + n + "}") for n in fields if "{" + n + "}" in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        if at:
            parts.append(F.lit(rest[:at]))
        name = rest[at + 1 : rest.index("}", at)]
        parts.append(fields[name])
        rest = rest[at + len(name) + 2 :]
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(SYSTEM[language])), message("user", F.concat(*parts)))


def is_valid(qa, language: str) -> Column:
    """Whether (input, output) is an example: neither is empty, they differ, and the output is long enough."""
    i, o = qa["input"], qa["output"]
    good = (i != "") & (o != "") & (i != o) & (F.length(o) >= LEAST_OUTPUT.get(language, LEAST_OUTPUT["en"]))
    return F.coalesce(good, F.lit(False))


def examples(rows: DataFrame, language: str) -> DataFrame:
    """Final records of answered contexts with response, idioms, answer_type, analysis and prompt."""
    got = rows.withColumn("qa", jsonx.question_answer("response")).where(is_valid(F.col("qa"), language))
    metadata = F.struct(
        F.col("idioms").alias("idioms_provided"), F.lit(language).alias("language"), "answer_type", "cultural_group", "context", "topic",
        "actor_behavior", "relation", "goal", F.col("analysis").isNotNull().alias("has_cultural_analysis"), "source",
    )
    return got.select(
        F.col("qa.input").alias("instruction"), F.lit("").alias("input"), F.col("qa.output").alias("output"), metadata.alias("metadata"),
        F.col("messages").alias("generation_prompt"),
    )


def distribution(records: DataFrame) -> DataFrame:
    """(answer_type, has_cultural_analysis, n)."""
    return records.groupBy("metadata.answer_type", "metadata.has_cultural_analysis").agg(F.count("*").alias("n"))


def first_wins(rows: DataFrame, *key: str, order: str = "pos") -> DataFrame:
    """One row for each key, the first in order."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


ANALYST = "You compare what two languages express with the same thing. Answer with JSON."


def analysis_prompt(entity_en, entity_zh, idioms_en, idioms_zh) -> Column:
    """Messages that ask how two clusters differ. Idioms are arrays of (idiom, figurative_meanings), entities arrays of names."""

    def block(head, names, idioms):
        lines = F.transform(idioms, lambda i: F.concat(F.lit("- "), i["idiom"], F.lit(": "), X.join_list(i["figurative_meanings"], 3)))
        return F.concat(F.lit(f"{head}: "), F.array_join(names, ", "), F.lit("\n"), F.array_join(lines, "\n"))

    wanted = ", ".join((*jsonx.LISTS, "cultural_explanation", "summary"))
    text = F.concat(block("English", entity_en, idioms_en), F.lit("\n\n"), block("Chinese", entity_zh, idioms_zh), F.lit(f"\n\nReturn an object with {wanted}."))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", F.lit(ANALYST)), message("user", text))
