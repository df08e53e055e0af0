"""Plans of search texts: driver-side for one, as expressions for a table of them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import tokens

# Words that are operators of the query language, and words that carry no content.
RESERVED = ("and", "or", "not", "near")
STOPWORDS = ("what", "is", "the", "how", "does", "about", "are", "do", "can", "should", "will", "would", "could", "has", "have", "been", "was", "were", "being", "a", "an", "in", "on", "at", "to", "for", "of", "by", "with", "from")
SHARED = "shared"


@dataclass(frozen=True)
class Plan:
    """What to look for: all of `every`, or any of `some`; `fallback` replaces a plan of `every` that finds too little."""

    every: tuple[str, ...] = ()
    some: tuple[str, ...] = ()
    fallback: tuple[str, ...] = ()
    n_tokens: int = 0
    columns: tuple[str, ...] = ()


#: From a number of content terms on: whether all of them are asked for, and whether any of the raw terms may replace them.
SHAPES = ((0, False, False), (1, True, False), (2, True, True), (5, False, False))
_PATH = r"(?i)([\w./-]+\.(?:md|markdown|txt))(?:#([\w-]+))?"


def _shape(n: int) -> tuple[bool, bool]:
    return next((every, fallback) for least, every, fallback in reversed(SHAPES) if n >= least)


def build(text: str) -> Plan:
    """The plan of one text: all content terms of a short one, any raw term of a long one."""
    raw = tuple(t for t in (x.lower() for x in re.findall(r"\w+", text)) if t not in RESERVED)
    content = tuple(t for t in raw if t not in STOPWORDS)
    every, fallback = _shape(len(content))
    pairs = tuple(map(" ".join, zip(content, content[1:]))) if len(content) > 2 else ()
    return Plan(every=content if every else (), some=raw if content and not every else (), fallback=raw + pairs if fallback else (), n_tokens=len(content))


def path_plan(text: str) -> Plan | None:
    """The plan of a text that is a file's path, with or without a section."""
    found = re.fullmatch(_PATH, text.strip())
    if not found:
        return None
    file, section = found.groups()
    terms = [t.lower() for t in re.findall(r"[^\W_]+", file)]
    if section:
        terms.append(" ".join(re.findall(r"[^\W_]+", section.lower())))
    return Plan(every=tuple(terms), n_tokens=len(terms), columns=("source_file", "section") if section else ("source_file",))


def planned(texts: DataFrame) -> DataFrame:
    """The plans of a table of texts (query_id, text): query_id, is_path, has_section, every, some, fallback, n_content. Terms are the index's tokens."""
    none = F.array().cast("array<string>")
    file, section = (F.regexp_extract(F.trim("text"), f"(?U)^{_PATH}$", k) for k in (1, 2))
    rows = texts.select("query_id", (file != "").alias("is_path"), (section != "").alias("has_section"), tokens(file).alias("file"), F.array_join(tokens(section), " ").alias("section"), raw_terms(tokens("text")).alias("raw"))
    rows = rows.withColumn("content", content_terms(F.col("raw"))).withColumn("n", F.size("content"))
    shape = lambda k: F.coalesce(*(F.when(F.col("n") >= s[0], F.lit(s[k])) for s in reversed(SHAPES)))
    every, fallback, plain = shape(1), shape(2), ~F.col("is_path")
    whole = F.when(F.col("has_section"), F.array_append("file", F.col("section"))).otherwise(F.col("file"))
    return rows.select(
        "query_id", "is_path", "has_section",
        F.when(F.col("is_path"), whole).when(every, F.col("content")).otherwise(none).alias("every"),
        F.when(plain & ~every & (F.col("n") > 0), F.col("raw")).otherwise(none).alias("some"),
        F.when(plain & fallback, F.concat("raw", pair_terms("content"))).otherwise(none).alias("fallback"),
        F.when(F.col("is_path"), F.size(whole)).otherwise(F.col("n")).alias("n_content"),
    )


def window(limit: int, narrow: bool = False) -> int:
    """How many candidates each list gives."""
    return min(2**31 - 1, max(5 * limit, 50) if narrow else max(3 * limit, 100))


def contexts(scope: str, project_id: str, label: str | None = None, workspace_id: str | None = None) -> list[str]:
    """The contexts that a search looks into."""
    own = [f"project:{project_id}"] + ([f"label:{project_id}:{label}"] if label else []) + ([f"workspace:{workspace_id}"] if workspace_id else [])
    return {"all": [SHARED, *own], "project": own, "shared": [SHARED]}[scope]


def write_context(explicit: str | None, workspace_id: str | None, project_id: str) -> str:
    return (explicit or "").strip() or (f"workspace:{workspace_id}" if workspace_id else f"project:{project_id}")


def context_key_for(context: str, project_id: str) -> str:
    """The partition key of a context string."""
    kind, _, rest = context.partition(":")
    if context == SHARED:
        return SHARED
    if kind == "project" and rest:
        return f"project:{rest}"
    if kind == "workspace" and rest:
        return f"workspace:{len(project_id)}:{project_id}:{rest}"
    if kind == "label" and rest.partition(":")[1] and rest.partition(":")[0]:
        return f"custom:{len(project_id)}:{project_id}:{rest.partition(':')[2]}"
    return f"custom:{len(project_id)}:{project_id}:{context}"


def bucket(context: str, project_id: str) -> dict[str, str | None]:
    """Scope, project, label and workspace of rows written to a context."""
    empty: dict[str, str | None] = {"scope": None, "project_id": project_id, "context_label": None, "workspace_id": None}
    kind, _, rest = context.partition(":")
    if context == SHARED:
        return empty | {"scope": "shared"}
    if kind == "project" and rest:
        return empty | {"scope": "project", "project_id": rest}
    if kind == "workspace" and rest:
        return empty | {"workspace_id": rest}
    return empty | {"scope": "custom", "context_label": rest.partition(":")[2] if kind == "label" and ":" in rest else context}


def allowed(mode: str | None, common: str | None, action: str) -> bool:
    """Whether a project's access mode, else the common one, else rw, allows to read, write or destroy. Reading is always allowed."""
    rank = {"read": 0, "write": 1, "destructive": 2}
    return rank[action] <= {"ro": 0, "rw": 1, "full": 2}.get(mode or common or "rw", 1)


def raw_terms(found: Column) -> Column:
    return F.filter(found, lambda t: ~t.isin(*RESERVED))


def content_terms(found: Column) -> Column:
    return F.filter(found, lambda t: ~t.isin(*RESERVED, *STOPWORDS))


def pair_terms(content: str) -> Column:
    """Neighbouring content terms as phrases, for three and more."""
    n = F.size(content)
    return F.when(n >= 3, F.zip_with(F.slice(content, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(content, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
