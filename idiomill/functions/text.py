"""String functions over columns. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters of synonym templates that are not words.
TEMPLATE_PARAMETERS = ("t=", "id=", "alt=", "tr=", "pos=")
NO_EXAMPLE = "无"
PLACEHOLDERS = ("～", "~")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c) -> Column:
    """Runs of white space become one space, and none is left at the ends."""
    return strip(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def non_empty(c) -> Column:
    """Null for an empty string."""
    return F.nullif(_col(c), F.lit(""))


def default(c, value: str) -> Column:
    """value for null and for the empty string."""
    return F.coalesce(non_empty(c), F.lit(value))


def lower_first(c) -> Column:
    """The first character in lower case if it is a letter."""
    c = _col(c)
    return F.when(c.rlike(r"^\p{L}"), F.concat(F.lower(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))).otherwise(c)


def differ_by_first_case(a, b) -> Column:
    """Whether two strings differ in the case of their first character and in nothing else."""
    a, b = _col(a), _col(b)
    heads = F.substring(a, 1, 1), F.substring(b, 1, 1)
    return (F.substr(a, F.lit(2)) == F.substr(b, F.lit(2))) & (F.lower(heads[0]) == F.lower(heads[1])) & (heads[0] != heads[1])


def pattern(c, fold_case: bool = True) -> Column:
    """A phrase as a search pattern: without parentheses, trimmed, the phrase itself if nothing is left."""
    c = _col(c)
    bare = F.coalesce(non_empty(strip(F.regexp_replace(c, r"\([^)]*\)", ""))), c)
    return F.lower(bare) if fold_case else bare


def word_count(c) -> Column:
    """Words separated by Unicode white space."""
    return F.size(F.filter(F.split(_col(c), r"(?U)\s+"), lambda x: x != "")).cast("long")


def snippet(text, phrase, context: int, fold_case: bool = True) -> Column:
    """The first occurrence of phrase with ``context`` characters on each side; empty if there is none."""
    text, phrase = _col(text), _col(phrase)
    at = F.call_function(
        "locate", F.lower(phrase) if fold_case else phrase, F.lower(text) if fold_case else text
    )
    begin = F.greatest(F.lit(1), at - context)
    end = F.least(F.length(text), at + F.length(phrase) - 1 + context)
    return F.when(at > 0, F.substr(text, begin, end - begin + 1)).otherwise("")


def preview(c, limit: int = 200) -> Column:
    """The first ``limit`` characters, with dots if something is cut."""
    c = _col(c)
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("..."))).otherwise(c)


# --- dictionary mark-up -------------------------------------------------------------


def clean_term(c) -> Column:
    """A term without <...> remarks."""
    return strip(F.regexp_replace(_col(c), "<[^>]+>", ""))


def link_targets(c) -> Column:
    """Targets of {{l|en|target|display}}."""
    return F.regexp_extract_all(_col(c), F.lit(r"\{\{l\|en\|([^}|]+)(?:\|[^}]+)?\}\}"), F.lit(1))


def _first_arguments(c, template: str) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\{\{" + template + r"\|en\|([^}|]+)(?:\|[^}]*)?\}\}"), F.lit(1))


def synonyms(c) -> Column:
    """Words of the synonym templates, one template after another."""
    c = _col(c)
    listed = F.regexp_extract_all(c, F.lit(r"\{\{syn\|en\|([^}]+)\}\}"), F.lit(1))
    words = F.transform(F.flatten(F.transform(listed, lambda x: F.split(x, r"\|"))), strip)
    parameter = "^(" + "|".join(TEMPLATE_PARAMETERS) + ")"
    return F.concat(
        F.filter(words, lambda w: (w != "") & ~w.rlike(parameter)),
        *(_first_arguments(c, t) for t in ("syn of", "synonym of", "altform", "alternative form of")),
    )


# The rewriting rules of dictionary mark-up; their order matters.
MARKUP = (
    (r"\[\[(?:[^|\]]*\|)?([^\]]+)\]\]", "$1"),
    (r"\{\{l\|en\|[^}|]+\|([^}]+)\}\}", "$1"),
    (r"\{\{l\|en\|([^}|]+)\}\}", "$1"),
    (r"\{\{m\|en\|(?:[^}]*\|)?([^}|]*)\}\}", "$1"),
    (r"\{\{non-gloss\|([^}|]+)(?:\|[^}]*)?\}\}", "$1"),
    (r"\{\{gloss\|([^}|]+)(?:\|[^}]*)?\}\}", "$1"),
    (r"\{\{n-g\|([^}|]+)(?:\|[^}]*)?\}\}", "$1"),
    (r"\{\{ng\|([^}]+)\}\}", "$1"),
    (r"\{\{ngd\|([^}|]+)(?:\|[^}]*)?\}\}", "$1"),
    (r"\{\{,\}\}", ","),
    (r"\{\{([^|{}]+)\}\}", "$1"),
    (r"\{\{w\|([^}]+)\}\}", "$1"),
    (r"\{\{taxlink\|([^}|]+)(?:\|[^}]*)?\}\}", "$1"),
    (r"\{\{([^|{}]+)\|en\|([^}|]+)(?:\|[^}]*)?\}\}", "$1 $2"),
    (r"\{\{[^}]*\}\}", ""),
)


def clean_markup(c) -> Column:
    """Explanation text without wiki mark-up."""
    c = _col(c)
    for rule, by in MARKUP:
        c = F.regexp_replace(c, rule, by)
    return squeeze(c)


def usage_examples(c) -> Column:
    """Cleaned sentences of {{ux|en|...}}."""
    found = F.regexp_extract_all(_col(c), F.lit(r"\{\{ux\|en\|([^}]+)\}\}"), F.lit(1))
    return F.transform(F.filter(found, lambda x: strip(x) != ""), clean_markup)


def english_section(wikitext, tolerant: bool = False) -> Column:
    """What stands between the English heading and the next heading of its level; null without one."""
    head = r"==\s*English\s*==" if tolerant else "==English=="
    got = F.regexp_extract(_col(wikitext), r"(?s)(?:^|\n)" + head + r"[ \t]*\n(.*?)(?=\n==[^=]|$)", 1)
    return non_empty(strip(got))


# --- dictionary sources -------------------------------------------------------------


def senses(c) -> Column:
    """Senses (explanation, usage, example) of a numbered definition; one for an unnumbered text."""
    c = _col(c)
    numbered = F.regexp_extract_all(c, F.lit(r"(?s)\d+\.\s*(.*?)(?=\s*\d+\.|$)"), F.lit(1))
    parts = F.when(F.size(numbered) > 0, numbered).otherwise(F.array(c))

    def sense(text):
        cut = F.filter(F.transform(F.split(text, "_"), strip), lambda x: x != "")
        head = F.get(cut, F.lit(0))
        usage = F.when(head.contains("Lit."), "literal").when(head.contains("Fig."), "figurative")
        bare = F.when(head.contains("Lit."), F.replace(head, F.lit("Lit."), F.lit(""))).otherwise(F.replace(head, F.lit("Fig."), F.lit("")))
        rest = F.slice(cut, 2, F.greatest(F.size(cut), F.lit(1)))
        return F.struct(strip(bare).alias("explanation"), usage.alias("usage"), rest.alias("example"))

    none = F.array().cast("array<struct<explanation:string,usage:string,example:array<string>>>")
    return F.when(c.isNull(), none).otherwise(F.transform(F.filter(parts, lambda x: x.rlike(r"(?U)[^\s_]")), sense))


def examples(c, idiom) -> Column:
    """An array of examples with the idiom put in; null for null, for the word that says there is none, and in their place."""
    idiom = _col(idiom)

    def fill(x):
        for p in PLACEHOLDERS:
            x = F.replace(x, F.lit(p), idiom)
        return x

    kept = F.filter(_col(c), lambda x: x.isNotNull() & (x != NO_EXAMPLE))
    return F.when(F.size(kept) > 0, F.transform(kept, fill))


def joined_or_null(*cs) -> Column:
    """Strings joined, null as empty; null if nothing is left after trimming."""
    return non_empty(strip(F.concat(*(F.coalesce(_col(c), F.lit("")) for c in cs))))


def source_tag(name) -> Column:
    """``reddit`` of ``culturebank_reddit.csv``."""
    return F.split_part(F.split_part(_col(name), F.lit("_"), F.lit(2)), F.lit("."), F.lit(1))


# --- categories, meanings, prompts --------------------------------------------------


def category(c, keywords: dict[str, list[str]], other: str = "other") -> Column:
    """The first category of which a keyword contains the text or is contained in it."""
    c = F.lower(_col(c))
    out = None
    for name, words in keywords.items():
        hit = None
        for w in words:
            one = c.contains(w.lower()) | F.lit(w.lower()).contains(c)
            hit = one if hit is None else hit | one
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(other) if out is None else out.otherwise(other)


def any_keyword(cs, keywords: list[str]) -> Column:
    """Whether an element of the array and a keyword contain one another."""
    words = F.array(*(F.lit(k.lower()) for k in keywords))
    return F.exists(_col(cs), lambda e: F.exists(words, lambda k: F.lower(e).contains(k) | k.contains(F.lower(e))))


def meaning_index(meanings, wanted) -> Column:
    """0-based place of a meaning: the equal one, else one that contains or is contained, else the first; -1 if there is none."""
    meanings, wanted = _col(meanings), _col(wanted)
    equal = F.array_position(meanings, wanted)
    at = F.transform(meanings, lambda m, i: F.when(m.contains(wanted) | wanted.contains(m), i))
    near = F.get(F.filter(at, lambda i: i.isNotNull()), F.lit(0))
    return F.when(F.size(meanings) <= 0, -1).when(equal > 0, (equal - 1).cast("int")).otherwise(F.coalesce(near, F.lit(0)))


def shared_meaning(en_matched, zh_matched, en_meanings, zh_meanings) -> Column:
    """The first of these that is not empty."""
    return F.coalesce(
        non_empty(en_matched),
        non_empty(zh_matched),
        non_empty(F.get(_col(en_meanings), F.lit(0))),
        non_empty(F.get(_col(zh_meanings), F.lit(0))),
        F.lit(""),
    )


def join_list(cs, limit: int = 5) -> Column:
    """The first items joined, or N/A."""
    cs = _col(cs)
    return F.when(F.size(cs) > 0, F.array_join(F.slice(cs, 1, limit), "; ")).otherwise("N/A")
