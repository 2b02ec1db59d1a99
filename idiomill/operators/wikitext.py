"""Dictionary pages in wiki mark-up: sections, senses, definitions and patterns.

Braces nest, so senses are parsed in Python, one page at a time, behind a vectorised
function. Sections form a tree of headings; a repeated heading under the same parent
goes on with the first one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARKUP, TEMPLATE_PARAMETERS

HEADING = re.compile(r"(=+)\s*(.*?)\s*\1")
LABEL = re.compile(r"\{\{(?:lb|label)\|[^}]*\}\}")
TEMPLATE = re.compile(r"\{\{[^}]*\}\}")
SENTENCE_END = re.compile(r"\.(?:\s|$)")
# Template names, in the order in which they are looked for.
EXPLAINED = ("syn of", "synonym of", "altform")
DEFINING = ("{{non-gloss", "{{gloss", "{{n-g", "{{ng", "{{ngd", "{{l|en", "{{m|en", "{{w|")
GLOSSES = ("gloss", "n-g", "ng", "ngd")
NAMING = ("syn of", "synonym of", "altform", "alternative form of")

SCHEMA = "definition array<struct<pos:string,explanation:string,usage:string,example:array<string>>>, patterns array<string>"

_RULES = [(re.compile(rule), by.replace("$1", r"\1").replace("$2", r"\2")) for rule, by in MARKUP]


def clean(text: str) -> str:
    for rule, by in _RULES:
        text = rule.sub(by, text)
    return " ".join(text.split())


@dataclass
class Section:
    name: str
    lines: list[str] = field(default_factory=list)
    children: dict[str, Section] = field(default_factory=dict)

    def entries(self) -> list[dict]:
        text = "\n".join(self.lines).strip()
        return parse_entries(text, self.name) if text else []


def sections(wikitext: str) -> Section:
    """The tree of headings; children are keyed by their whole heading line."""
    root = Section("")
    path: list[tuple[int, Section]] = [(0, root)]
    for line in wikitext.splitlines():
        m = HEADING.fullmatch(line)
        if not m:
            path[-1][1].lines.append(line)
            continue
        level = len(m[1])
        while path[-1][0] >= level and len(path) > 1:
            path.pop()
        siblings, title = path[-1][1].children, line.strip()
        if title in siblings:
            siblings[title].lines.append("")
        else:
            siblings[title] = Section(title.strip("=").strip())
        path.append((level, siblings[title]))
    return root


def _starts(line: str, mark: str) -> bool:
    """Whether the line opens a sense of this depth, rather than a deeper one, an example or a quotation."""
    s = line.strip()
    return s.startswith(mark) and s[len(mark) : len(mark) + 1] not in ("#", ":", "*") if mark == "#" else (
        s.startswith(mark) and s[len(mark) : len(mark) + 1] not in (":", "*")
    )


def _groups(lines: list[str], mark: str) -> tuple[list[str], list[list[str]]]:
    """The lines before the first sense, and the lines of each sense."""
    head: list[str] = []
    groups: list[list[str]] = []
    for line in lines:
        if _starts(line, mark):
            groups.append([line])
        else:
            (groups[-1] if groups else head).append(line)
    return head, groups


def parse_entries(content: str, name: str | None) -> list[dict]:
    """The entries of a section: one for each sense and subsense that is explained."""
    content = re.sub(r"(?s)<!--.*?-->", "", content)
    raw = {"metadata": content.strip(), "explanation": "", "other": "", "section": None, "examples": []}
    head, groups = _groups(content.split("\n"), "#")
    if not groups:
        return [raw] if content.strip() else []
    header, found = "\n".join(head).strip(), []
    for group in groups:
        main, deeper = _groups(group, "##")
        found += [parse_sense("\n".join(g), header, name) for g in ([main] if main else []) + deeper]
    found = [e for e in found if e["explanation"]]
    return found or [raw]


def _nested(text: str, opening: str) -> tuple[str, str] | None:
    """The content of a template, to the braces that close it, and the text without the template."""
    start = text.find(opening)
    if start < 0:
        return None
    depth, begin = 1, start + len(opening)
    for m in re.finditer(r"\{\{|\}\}", text[begin:]):
        depth += 1 if m[0] == "{{" else -1
        if not depth:
            end = begin + m.start()
            return text[begin:end].strip(), text[:start] + text[end + 2 :].strip()
    return None


def _explanation(text: str) -> tuple[str, str]:
    """The explanation in a definition line and what follows it."""
    if got := _nested(text, "{{non-gloss|"):
        return got
    for name in GLOSSES:
        rule = re.compile(r"\{\{" + name + r"\|([^}]+)\}\}")
        if m := rule.search(text):
            return m[1].strip(), rule.sub("", text).strip()
    if m := SENTENCE_END.search(text):
        return text[: m.start()].strip(), text[m.end() :].strip()
    return text.strip(), ""


def parse_sense(text: str, header: str, name: str | None) -> dict:
    line, *rest = text.split("\n")
    line = line.strip()
    line = line[2:].strip() if line.startswith("##") else line.removeprefix("#").strip()
    told = None
    for template in EXPLAINED:
        rule = re.compile(r"\{\{" + template + r"\|en\|([^|]+)\|\|([^}]+)\}\}")
        if m := rule.search(line):
            term, told = re.sub("<[^>]+>", "", m[1]).strip(), m[2].strip()
            short = "{{" + template + "|en|" + term + "}}"
            line = rule.sub(lambda _, s=short: s, line).strip()
            break
    labels = LABEL.findall(line)
    line = LABEL.sub("", line).strip()
    while line.startswith("{{") and not line.startswith(DEFINING) and (m := TEMPLATE.match(line)):
        labels.append(m[0])
        line = line[m.end() :].strip()
    explanation, after = (told, "") if told else _explanation(line)
    other = "\n".join(x for x in (after, "\n".join(rest)) if x).strip()
    shown = [clean(x) for x in re.findall(r"\{\{ux\|en\|([^}]+)\}\}", other) if x.strip()]
    metadata = "\n".join(x for x in (header, " ".join(labels)) if x).strip()
    return {"metadata": metadata, "explanation": clean(explanation), "other": other, "section": name, "examples": shown}


def synonyms(text: str) -> list[str]:
    out = []
    for words in re.findall(r"\{\{syn\|en\|([^}]+)\}\}", text):
        out += [w.strip() for w in words.split("|") if w.strip() and not w.strip().startswith(TEMPLATE_PARAMETERS)]
    for name in NAMING:
        out += re.findall(r"\{\{" + name + r"\|en\|([^}|]+)(?:\|[^}]*)?\}\}", text)
    return out


def _patterns_of(section: Section) -> list[str]:
    out = []
    for e in section.entries():
        if section.name == "See also":
            out += re.findall(r"\{\{l\|en\|([^}|]+)(?:\|[^}]+)?\}\}", e["metadata"])
        out += synonyms(e["metadata"]) + synonyms(e["other"])
    return out


def _definitions(section: Section):
    for e in section.entries():
        if e["explanation"].strip():
            yield ((e["section"] or "unknown").lower(), e["explanation"].strip(), None, e["examples"])


def _walk_definitions(section: Section):
    for child in section.children.values():
        yield from _definitions(child)
        yield from _walk_definitions(child)


def _walk_patterns(section: Section):
    """Patterns below a section: of related-term sections first, which are not searched deeper."""
    named = {c.name: c for c in section.children.values()}
    for name in ("See also", "Synonyms"):
        if name in named:
            yield from _patterns_of(named[name])
    for child in section.children.values():
        if child.name not in ("See also", "Synonyms"):
            yield from _walk_child(child)


def _walk_child(child: Section):
    named = {c.name: c for c in child.children.values()}
    for name in ("See also", "Synonyms"):
        if name in named:
            yield from _patterns_of(named[name])
    yield from _patterns_of(child)
    for c in child.children.values():
        if c.name not in ("See also", "Synonyms"):
            yield from _walk_child(c)


def parse_page(wikitext: str | None, tolerant: bool = False) -> tuple[list[tuple], list[str]] | None:
    """(definitions, patterns) of a page's English section; null without one.

    The heading must be ``==English==`` to the letter, unless tolerant.
    """
    tops = sections(wikitext or "").children
    english = next((s for title, s in tops.items() if (s.name == "English" if tolerant else title == "==English==")), None)
    if english is None or not (english.children or "\n".join(english.lines).strip()):
        return None
    definitions = [*_walk_definitions(english), *_definitions(english)]
    patterns = [*_walk_patterns(english), *_patterns_of(english)]
    return definitions, list(dict.fromkeys(patterns))


def parse_pages(pages: DataFrame, tolerant: bool = False) -> DataFrame:
    """(idiom, definition, patterns) of pages (idiom, wikitext) that have an English section."""

    @F.pandas_udf(SCHEMA)
    def parse(texts: pd.Series) -> pd.DataFrame:
        rows = [parse_page(t, tolerant) for t in texts]
        names = ("pos", "explanation", "usage", "example")
        return pd.DataFrame(
            {
                "definition": [None if r is None else [dict(zip(names, d, strict=True)) for d in r[0]] for r in rows],
                "patterns": [None if r is None else r[1] for r in rows],
            }
        )

    likely = F.contains("wikitext", F.lit("English" if tolerant else "==English=="))
    got = pages.where(likely).select("idiom", parse("wikitext").alias("p"))
    return got.where("p.patterns is not null").select("idiom", "p.definition", "p.patterns")


def as_source(parsed: DataFrame) -> DataFrame:
    """Definitions as the array of maps that merged sources have."""
    entry = lambda d: F.create_map(d["pos"], F.struct(d["explanation"].alias("explanation"), d["usage"].alias("usage"), d["example"].alias("example")))
    return parsed.withColumn("definition", F.transform("definition", entry))


def heading_parents(lines: DataFrame, levels: int = 6) -> DataFrame:
    """lines (page, line_no, level; 0 for text) with parent: the number of the nearest earlier heading of a smaller level.

    Text belongs to the nearest heading. A heading closes all deeper ones, so the nearest
    smaller one is the latest heading among the smaller levels.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("line_no"))).over(w) for k in range(1, levels + 1)]
    parent = None
    for k in range(levels, 0, -1):
        known = F.greatest(*last[: k - 1], F.lit(None).cast("long")) if k > 2 else (last[0] if k == 2 else F.lit(None).cast("long"))
        parent = F.when(F.col("level") == k, known) if parent is None else parent.when(F.col("level") == k, known)
    return lines.withColumn("parent", parent.otherwise(F.greatest(*last, F.lit(None).cast("long"))))
