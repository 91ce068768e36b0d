"""Chunkers that Catalyst can express: overlapping windows of lines or characters, Markdown sections.

Each is a generator over one row of ``files(file_path, source, ...)``: no shuffle, and a very long file costs its own row only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.functions.text import trim_space

WINDOW_LINES, OVERLAP = 60, 0.2
EMBED_CHARS, EMBED_OVERLAP = 900, 120


def step_of(lines: int = WINDOW_LINES, overlap: float = OVERLAP) -> int:
    return max(1, lines - int(lines * overlap))


def line_windows(files: DataFrame, lines: int = WINDOW_LINES, overlap: float = OVERLAP, source: str = "source") -> DataFrame:
    """One row for each start 0, step, 2 step, ... within the lines: name, text, line_start, line_end. Windows that lie in the one before are kept. Null source: no rows."""
    step = step_of(lines, overlap)
    every = F.split(F.col(source), "\n")

    def window(i: Column) -> Column:
        end = F.least(i + lines, F.size("_cg_lines"))
        return F.struct(F.concat(F.lit("lines_"), i + 1, F.lit("_"), end).alias("name"), F.array_join(F.slice("_cg_lines", i + 1, F.lit(lines)), "\n").alias("text"), (i + 1).alias("line_start"), end.alias("line_end"))

    rows = files.where(F.col(source).isNotNull()).withColumn("_cg_lines", every)
    rows = rows.withColumn("_cg_w", F.transform(F.sequence(F.lit(0), F.size("_cg_lines") - 1, F.lit(step)), window)).drop("_cg_lines")
    return rows.withColumn("_cg_w", F.explode("_cg_w")).select(*files.columns, "_cg_w.*")


def split_large(units: DataFrame, max_tokens: int = 600, lines: int = WINDOW_LINES, overlap: float = OVERLAP) -> DataFrame:
    """Units (name, text, line_start, line_end) of more than max_tokens * 4 characters become windows ``name_part_k``; the others stay."""
    step = step_of(lines, overlap)
    large = F.floor(F.length("text") / 4) > max_tokens
    rows = units.withColumn("_cg_lines", F.split("text", "\n"))
    starts = F.when(large, F.sequence(F.lit(0), F.size("_cg_lines") - 1, F.lit(step))).otherwise(F.array(F.lit(-1)))
    rows = rows.withColumn("_cg_at", F.explode(starts))
    cut = F.col("_cg_at") >= 0
    out = rows.withColumns({
        "name": F.when(cut, F.concat("name", F.lit("_part_"), (F.col("_cg_at") / step).cast("int") + 1)).otherwise(F.col("name")),
        "text": F.when(cut, F.array_join(F.slice("_cg_lines", F.greatest(F.col("_cg_at"), F.lit(0)) + 1, F.lit(lines)), "\n")).otherwise(F.col("text")),
        "line_start": F.when(cut, F.col("line_start") + F.col("_cg_at")).otherwise(F.col("line_start")),
        "line_end": F.when(cut, F.least(F.col("line_start") + F.col("_cg_at") + lines - 1, F.col("line_end"))).otherwise(F.col("line_end")),
    })
    return out.drop("_cg_lines", "_cg_at")


def semantic_windows(files: DataFrame, lines: int = 80, overlap_lines: int = 8, source: str = "source") -> DataFrame:
    """Windows of a file that no other chunker took; blank windows go, the index counts those that stay."""
    step = max(1, lines - overlap_lines)
    every = F.split(F.col(source), "\n")
    windows = F.transform(F.sequence(F.lit(0), F.size(every) - 1, F.lit(step)), lambda i: F.struct((i + 1).alias("line_start"), F.least(i + lines, F.size(every)).alias("line_end"), trim_space(F.array_join(F.slice(every, i + 1, F.lit(lines)), "\n")).alias("text")))
    kept = F.filter(windows, lambda w: w["text"] != "")
    rows = files.where(F.col(source).isNotNull()).select("*", F.posexplode(kept).alias("chunk_index", "_cg_w"))
    return rows.select("*", "_cg_w.*").withColumn("name", F.concat(F.lit("chunk_"), F.col("chunk_index") + 1)).drop("_cg_w")


def char_windows(text: Column | str, chars: int = EMBED_CHARS, overlap: int = EMBED_OVERLAP) -> Column:
    """Pieces of a trimmed text for an embedder with bounded input; blank text has none. The last piece ends with the text."""
    if not 0 <= overlap <= chars - overlap:
        raise ValueError("pieces may overlap by half of their length at most")
    # one pass cuts the text into strides; a piece is a stride and the beginning of the next one
    strides = F.regexp_extract_all(trim_space(text), F.lit(f"(?s).{{1,{chars - overlap}}}"), F.lit(0))
    joined = lambda s: F.transform(s, lambda x, i: F.concat(x, F.coalesce(F.substring(F.get(s, i + 1), 1, overlap), F.lit(""))))
    ends_before = lambda s: (F.size(s) > 1) & (F.length(F.get(s, F.size(s) - 1)) <= overlap)
    pieces = F.transform(F.array(strides), lambda s: F.slice(joined(s), F.lit(1), F.size(s) - F.when(F.size(s) == 0, 0).when(ends_before(s), 1).otherwise(0)))
    return F.element_at(pieces, 1)


HEADING = r"^(#{1,6})\s+(.+)$"
_UNIT = "struct<chunk_type:string,name:string,text:string,line_start:int,line_end:int,chunk_index:int>"


def _numbered(parts: Column, name: Callable[[Column, Column], Column]) -> Column:
    """Units of (kind, name, text, line_start, line_end) structs that have text, with their place among these as index."""
    unit = lambda x, i: F.struct(x["kind"].alias("chunk_type"), name(x, i).alias("name"), x["text"].alias("text"), x["a"].alias("line_start"), x["e"].alias("line_end"), i.alias("chunk_index"))
    return F.transform(F.filter(parts, lambda x: x["text"] != ""), unit).cast(f"array<{_UNIT}>")


def section_array(source: Column | str) -> Column:
    """Sections of a Markdown text as an array of units.

    A heading line starts a section named by its text; what stands before the first is a paragraph. Blank sections take no index. Lines
    are folded within the value, in order: the text is cut before each heading, and line numbers are summed up along the pieces.
    """
    text = F.col(source) if isinstance(source, str) else source
    pieces = F.split(text, r"\n(?=#{1,6}[^\S\n]+[^\n])")  # before each heading line
    start = F.struct(F.lit(1).alias("line"), F.expr("cast(array() as array<struct<kind:string,head:string,text:string,a:int,e:int>>)").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        size = F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit(""))) + 1
        first = F.substring_index(piece, "\n", 1)
        head = F.when(first.rlike(HEADING), trim_space(F.regexp_extract(first, HEADING, 2)))
        one = F.struct(F.when(head.isNotNull(), "section").otherwise("paragraph").alias("kind"), head.alias("head"), trim_space(piece).alias("text"), acc["line"].alias("a"), (acc["line"] + size - 1).alias("e"))
        return F.struct((acc["line"] + size).cast("int").alias("line"), F.concat(acc["out"], F.array(one.cast("struct<kind:string,head:string,text:string,a:int,e:int>"))).alias("out"))

    parts = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return _numbered(parts, lambda x, i: F.coalesce(x["head"], F.concat(F.lit("section_"), i)))


def markdown_sections(files: DataFrame, source: str = "source") -> DataFrame:
    """Sections (kind, name, text, line_start, line_end, chunk_index) of each row, as section_array tells them; null sources give none."""
    rows = files.where(F.col(source).isNotNull()).select("*", F.explode(section_array(source)).alias("_cg_u"))
    return rows.select("*", "_cg_u.*").drop("_cg_u").withColumnRenamed("chunk_type", "kind")


def paragraph_array(source: Column | str, target_tokens: int = 512) -> Column:
    """Paragraphs of a text packed into units of about target_tokens * 4 characters, as an array.

    A fold over what blank lines separate: a paragraph that no longer fits closes the unit before it; one that is longer alone stays whole. Line numbers are
    approximate, as each gap counts as two lines and a unit is numbered back from where it was closed.
    """
    text = F.col(source) if isinstance(source, str) else source
    breaks = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    part = "struct<kind:string,text:string,a:int,e:int>"
    state = f"struct<line:int,size:int,held:string,out:array<{part}>>"
    start = F.expr(f"cast(named_struct('line', 1, 'size', 0, 'held', null, 'out', array()) as {state})")
    unit = lambda held, a, e: F.array(F.struct(F.lit("paragraph").alias("kind"), held.alias("text"), a.alias("a"), e.alias("e")).cast(part))

    def step(acc: Column, raw: Column) -> Column:
        p = trim_space(raw)
        held, line = acc["held"], acc["line"]
        closes = held.isNotNull() & (acc["size"] + F.length(p) > 4 * target_tokens)
        done = F.when(closes, F.concat(acc["out"], unit(held, line - breaks(held) - 1, line))).otherwise(acc["out"])
        size = F.when(closes, F.length(p)).otherwise(acc["size"] + F.length(p))
        now = F.when(closes | held.isNull(), p).otherwise(F.concat(held, F.lit("\n\n"), p))
        after = F.struct((line + breaks(p) + 2).alias("line"), size.alias("size"), now.alias("held"), done.alias("out"))
        blank = F.struct((line + 2).alias("line"), acc["size"].alias("size"), held.alias("held"), acc["out"].alias("out"))
        return F.when(p == "", blank).otherwise(after).cast(state)

    last = lambda acc: F.when(acc["held"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], unit(acc["held"], acc["line"], acc["line"] + breaks(acc["held"]))))
    return _numbered(F.aggregate(F.split(text, "\n\n"), start, step, last), lambda x, i: F.concat(F.lit("paragraph_"), i))


def packed_paragraphs(files: DataFrame, target_tokens: int = 512, source: str = "source") -> DataFrame:
    """Units (chunk_type, name, text, line_start, line_end, chunk_index) of each row, as paragraph_array tells them; null sources give none."""
    rows = files.where(F.col(source).isNotNull()).select("*", F.explode(paragraph_array(source, target_tokens)).alias("_cg_u"))
    return rows.select("*", "_cg_u.*").drop("_cg_u")
