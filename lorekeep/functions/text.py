"""Scalar expressions on text, hashes, keys and ratings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of Latin-1 and Latin Extended-A that are a base letter with marks, and their base letters.
_MARKED = [c for c in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", c)) > 1]
ACCENTED = "".join(_MARKED)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)

RATING_BASE, HALF_LIFE_DAYS, ACCESS_MULTIPLIER = 0.5, 30.0, 0.1
#: Unicode-aware white space, the no-break space included.
SPACE = r"(?U)\s"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(x: Column | str) -> Column:
    """Tokens of the keyword index: runs of letters and digits, lower case, without accents. NULL has none."""
    low = F.lower(F.coalesce(_c(x), F.lit("")))
    plain = F.when(low.rlike(r"[^\x00-\x7f]"), F.translate(low, ACCENTED, PLAIN)).otherwise(low)  # most texts need no translation, which is slow
    return F.array_remove(F.split(plain, r"[^\p{L}\p{N}]+"), "")


def content_hash(path: Column | str, value: Column | str) -> Column:
    return F.sha2(F.concat(_c(path), _c(value)), 256)


def written_path(value: Column | str) -> Column:
    """The path of a memory that has no file: its content's hash."""
    return F.concat(F.sha2(_c(value), 256), F.lit(".md"))


def context_key() -> Column:
    """The partition of a row: the project's length goes first, so that no two contexts share a key."""
    def owned(kind: str, name: Column) -> Column:
        return F.concat(F.lit(f"{kind}:"), F.length("project_id"), F.lit(":"), F.col("project_id"), F.lit(":"), name)

    return (
        F.when(F.col("workspace_id").isNotNull(), owned("workspace", F.col("workspace_id")))
        .when(F.col("scope") == "shared", F.lit("shared"))
        .when(F.col("scope") == "project", F.concat(F.lit("project:"), F.col("project_id")))
        .otherwise(owned("custom", F.coalesce("context_label", F.lit(""))))
    )


def context_name() -> Column:
    """The context string that names a row's bucket."""
    return F.when(F.col("workspace_id").isNotNull(), F.concat(F.lit("workspace:"), "workspace_id")).when(F.col("scope") == "shared", F.lit("shared")).when(F.col("scope") == "project", F.concat(F.lit("project:"), "project_id")).otherwise(F.concat(F.lit("label:"), "project_id", F.lit(":"), F.coalesce("context_label", F.lit(""))))


def stripped(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), SPACE, "")


def json_list(x: Column | str) -> Column:
    """A JSON array of strings; anything else is no string at all."""
    return F.coalesce(F.from_json(_c(x), "array<string>"), F.array().cast("array<string>"))


def as_json_list(x: Column | str) -> Column:
    return F.to_json(F.coalesce(_c(x), F.array().cast("array<string>")))


def parsed(x: Column | str, kind: str, default, least=None, most=None) -> Column:
    """A setting's text as int, double or boolean; the default where it is none or out of bounds."""
    text = F.trim(_c(x))
    if kind == "boolean":
        return F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true").otherwise(F.lit(default))
    value = text.try_cast(kind)
    fits = value.isNotNull() & (F.lit(True) if least is None else value >= least) & (F.lit(True) if most is None else value <= most)
    return F.when(fits, value).otherwise(F.lit(default))


def one_of(x: Column | str, names: tuple[str, ...], default: str) -> Column:
    """A setting's text as one of these names, whatever its case; else the default."""
    return F.coalesce(*(F.when(F.lower(F.trim(_c(x))) == name.lower(), F.lit(name)) for name in names), F.lit(default))


def scopes(x: Column | str) -> Column:
    """A list of paths without repeats, in the order of their code points."""
    return F.array_sort(F.array_distinct(_c(x)))


def sentences(x: Column | str, most: int) -> Column:
    """The first sentences of a text that have at most `most` characters together, the first one in any case."""
    each = F.filter(F.split(F.trim(_c(x)), r"(?<=[.!?])\s+"), lambda s: s != "")
    longer = lambda a, s: F.when((a["text"] != "") & (F.length(a["text"]) + 1 + F.length(s) > most) | a["full"], F.struct(a["text"].alias("text"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat_ws(" ", F.when(a["text"] != "", a["text"]), s).alias("text"), F.lit(False).alias("full")))
    return F.aggregate(each, F.struct(F.lit("").alias("text"), F.lit(False).alias("full")), longer, lambda a: a["text"])


def first_heading(x: Column | str) -> Column:
    """The text of the first heading; empty where there is none."""
    return F.trim(F.regexp_extract(_c(x), r"(?m)^#{1,6}[ \t]+(.+)$", 1))


def epoch(x: Column | str) -> Column:
    """Seconds of a timestamp."""
    return F.unix_seconds(_c(x).cast("timestamp"))


def moment(x: Column | str) -> Column:
    """The timestamp of seconds."""
    return F.timestamp_seconds(_c(x))


def preview(x: Column | str, length: int = 300) -> Column:
    return F.when(F.length(_c(x)) > length, F.concat(F.substring(_c(x), 1, length - 1), F.lit("…"))).otherwise(_c(x))


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def age_days(created_at: Column | str, now: int) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(now) - _c(created_at)) / F.lit(86400.0))


def rating(created_at: Column | str, access_count: Column | str, now: int) -> Column:
    """Halves every 30 days and gains a tenth with each access."""
    return F.lit(RATING_BASE) * F.pow(F.lit(0.5), age_days(created_at, now) / HALF_LIFE_DAYS) * (1 + ACCESS_MULTIPLIER * _c(access_count))


def markdown_strip(x: Column | str) -> Column:
    """Text without headings' marks, inline code ticks, link targets, bullets, table bars and line structure."""
    out = _c(x)
    for pattern, by in ((r"(?m)^#{1,6}\s*", ""), (r"`([^`]*)`", "$1"), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s*[-*]\s*", ""), (r"[|>]", " "), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def slug(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9-]+", "-"), F.lit("-"))


def backoff_seconds(failures: Column | str) -> Column:
    return F.pow(F.lit(2), _c(failures) - 1).cast("long")
