"""Splitting texts into chunks."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.text import slug

#: Tokens of a chunk and of what it repeats of the one before, and the most that an embedding engine reads.
MOST, OVERLAY, WINDOWS = 256, 48, {"local": 256, "openai": 8191}

#: A fenced block, to its closing fence or the text's end, or else a line; both with their line end.
_FENCE = r"[^\S\n]*(?:```|~~~)[^\n]*"
_UNITS = re.compile(rf"{_FENCE}(?:\n(?!{_FENCE})[^\n]*)*(?:\n{_FENCE})?(?:\n|$)|[^\n]*\n|[^\n]+")


def count_words(text: str) -> int:
    return len(text.split())


class TokenCounter:
    """Counts tokens as a tokenizer file of the tokenizers library does; each worker loads it once. The path is one that all workers see."""

    def __init__(self, path: str):
        self.path, self._loaded = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "_loaded": None}

    def encode(self, text: str) -> list[int]:
        if self._loaded is None:
            from tokenizers import Tokenizer

            self._loaded = Tokenizer.from_file(self.path)
        return self._loaded.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> int:
        return len(self.encode(text))


def encoded(rows: DataFrame, counter: TokenCounter, column: str = "value", window: int = WINDOWS["local"]) -> DataFrame:
    """rows with ids, the first `window` token ids of a text: what an embedding engine reads of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("ids", pa.array([counter.encode(t or "")[:window] for t in batch.column(column).to_pylist()], pa.list_(pa.int32())))

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes), "ids array<int>"]))


def bounds(most: int = MOST, overlay: int = OVERLAY, engine: str | None = None) -> tuple[int, int]:
    """The bounds that hold for an engine: no more than it reads, and less overlay than chunk."""
    most = min(most, WINDOWS[engine]) if engine else most
    if not 0 <= overlay or most < 1:
        raise ValueError(f"a chunk of {most} tokens with an overlay of {overlay}")
    return most, min(overlay, most - 1)


def markdown_chunks(text: str, most: int = MOST, overlay: int = OVERLAY, count: Callable[[str], int] = count_words) -> list[str]:
    """Chunks of whole units, which are lines and fenced blocks.

    With before[k] the tokens ahead of unit k, a chunk that begins at unit a and has its first new unit at b ends at the last e for which before[e] - before[a] is at most
    `most`, but has at least unit b. The next begins at the first unit of this one behind which, up to e, there are at most `overlay` tokens, and its first new unit is e.
    """
    if not 0 <= overlay < most:
        raise ValueError(f"an overlay of {overlay} in chunks of {most} tokens")
    units = _UNITS.findall(re.sub(r"\r\n?", "\n", text))
    before = list(accumulate(map(count, units), initial=0))
    begin, new, chunks = 0, 0, []
    while new < len(units):
        end = max(new + 1, bisect_right(before, before[begin] + most) - 1)
        chunks.append("".join(units[begin:end]))
        begin, new = max(begin, bisect_left(before, before[end] - overlay)), end
    return chunks


def chunked(files: DataFrame, most: int = MOST, overlay: int = OVERLAY, count: Callable[[str], int] = count_words) -> DataFrame:
    """(path, chunk_index, total_chunks, chunk) of files (path, text); count is called in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                chunks = markdown_chunks(text or "", most, overlay, count)
                if chunks:
                    n = len(chunks)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(chunks, pa.string())], ["path", "chunk_index", "total_chunks", "chunk"])

    return files.select("path", "text").mapInArrow(run, "path string, chunk_index int, total_chunks int, chunk string")


def ingested(files: DataFrame, bucket: dict[str, str | None], now: int, most: int = MOST, overlay: int = OVERLAY, count: Callable[[str], int] = count_words) -> DataFrame:
    """Rows of a bucket (scope, project_id, context_label, workspace_id) for the chunks of files (path, text), for lifecycle.insert_chunks."""
    rows = chunked(files, most, overlay, count).select("path", F.col("path").alias("source_file"), F.col("chunk").alias("value"), "chunk_index", "total_chunks")
    return rows.withColumns({**{c: F.lit(bucket.get(c)).cast("string") for c in ("scope", "project_id", "context_label", "workspace_id")}, "created_at": F.lit(now).cast("long")})


def files_changed(inserted: DataFrame) -> DataFrame:
    """One row: of how many files something new was inserted."""
    return inserted.agg(F.count_distinct("source_file").alias("n_files"))


def h2_sections(files: DataFrame) -> DataFrame:
    """(path, section_no, name, body): parts below second-level headings, what comes before as `preamble`, a text without any as `body`."""
    blank = r"^\s+|\s+$"
    parts = files.select("path", F.size(F.split("text", r"(?m)^##\s+")).alias("n"), F.posexplode(F.split("text", r"(?m)^##\s+")).alias("section_no", "part"))
    first = F.col("section_no") == 0
    name = F.when(F.col("n") == 1, F.lit("body")).when(first, F.lit("preamble")).otherwise(F.regexp_replace(F.substring_index("part", "\n", 1), blank, ""))
    body = F.when(first, F.col("part")).when(F.instr("part", "\n") == 0, F.lit("")).otherwise(F.expr("substring(part, instr(part, '\n') + 1)"))
    rows = parts.select("path", "section_no", "n", name.alias("name"), F.regexp_replace(body, blank, "").alias("body"))
    return rows.filter((F.col("n") == 1) | (F.col("section_no") > 0) | (F.col("body") != "")).drop("n")


def decision_sections(files: DataFrame, whole_below: int = 1000) -> DataFrame:
    """Sections of decision records, named by their headings' slugs and led by the title; short records stay whole."""
    title = F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1)
    short = files.filter(F.length("text") < whole_below).select("path", F.lit(0).alias("section_no"), F.lit("whole").alias("name"), F.trim("text").alias("body"))
    long = h2_sections(files.filter(F.length("text") >= whole_below)).join(files.select("path", title.alias("title")), "path")
    return short.unionByName(long.select("path", "section_no", slug("name").alias("name"), F.concat_ws("\n\n", F.when(F.col("title") != "", F.col("title")), "body").alias("body")))


def table_rows(files: DataFrame) -> DataFrame:
    """One chunk for each row of a rules table, its header and separator lines left out."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line").rlike(r"^\s*\|") & ~F.col("line").rlike(r"^\s*\|[\s:|-]+\|?\s*$"))
    heads = files.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.col("line").rlike(r"^\s*\|[\s:|-]+\|?\s*$")).select("path", (F.col("line_no") - 1).alias("line_no"))
    return lines.join(heads, ["path", "line_no"], "left_anti").select("path", "line_no", F.trim("line").alias("chunk"))


def headings(files: DataFrame, level: int = 2) -> DataFrame:
    """(path, section_no, name, body): a chunk for each heading of up to this level with what follows it; what comes before the first is `preamble`."""
    mark = rf"(?m)^(?=#{{1,{level}}}\s)"
    parts = files.select("path", F.posexplode(F.split("text", mark)).alias("section_no", "part"))
    headed = F.col("part").rlike(rf"^#{{1,{level}}}\s")
    name = F.when(headed, F.trim(F.regexp_replace(F.substring_index("part", "\n", 1), r"^#+\s*", ""))).otherwise("preamble")
    return parts.select("path", "section_no", name.alias("name"), F.trim(F.regexp_replace("part", r"^\s+|\s+$", "")).alias("body")).filter("body <> ''")


def atomic(files: DataFrame) -> DataFrame:
    """The whole text as one chunk."""
    return files.select("path", F.lit(0).alias("section_no"), F.lit("whole").alias("name"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("body")).filter("body <> ''")


def skill_sections(files: DataFrame) -> DataFrame:
    """Sections below second-level headings, the front matter of a skill left out, each led by the skill's name."""
    name = F.regexp_extract("text", r"(?m)^name:\s*(.+?)\s*$", 1)
    bare = files.select("path", F.regexp_replace("text", r"(?s)\A---\n.*?\n---\n", "").alias("text"))
    rows = h2_sections(bare).join(files.select("path", name.alias("skill")), "path")
    return rows.select("path", "section_no", "name", F.concat_ws("\n\n", F.when(F.col("skill") != "", F.col("skill")), "body").alias("body"))


def dated_sections(files: DataFrame) -> DataFrame:
    """Second-level sections whose heading begins with a date, named by it."""
    date = F.regexp_extract("name", r"^(\d{4}-\d{2}-\d{2})", 1)
    return h2_sections(files).filter(date != "").select("path", "section_no", date.alias("name"), "body")


#: What splits the files of a kind.
CHUNKERS = {
    "adr": lambda files: decision_sections(files), "doc": lambda files: headings(files), "note": lambda files: atomic(files), "skill": lambda files: skill_sections(files),
    "remember": lambda files: dated_sections(files), "rules": lambda files: table_rows(files).select("path", F.col("line_no").alias("section_no"), F.lit("row").alias("name"), F.col("chunk").alias("body")),
}


def by_kind(files: DataFrame) -> DataFrame:
    """(path, kind, section_no, name, body) of files (path, kind, text), each split as its kind asks; unknown kinds are split by headings."""
    known = F.when(F.col("kind").isin(*CHUNKERS), F.col("kind")).otherwise("doc")
    parts = [split(files.filter(known == kind)).select("path", F.lit(kind).alias("kind"), F.col("section_no").cast("int").alias("section_no"), "name", "body") for kind, split in CHUNKERS.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
