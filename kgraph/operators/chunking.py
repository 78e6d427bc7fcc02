"""Sections and chunks of ordered blocks, and the recursive splitter."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import collapse
from .pages import rows_text

#: Characters of a chunk and of its overlap, separators from the strongest on, headings that open no section.
SIZE, OVERLAP = 1100, 200
#: Texts that are held as Python objects at once.
TEXTS = 64
SEPARATORS = ("\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")
IGNORED_HEADINGS = ["ug intake", "duration", "240", "4 years"]


def _parts(text: str, mark: str) -> list[str]:
    """Cut in front of each mark, so that a part begins with the one that it followed."""
    first, *rest = text.split(mark)
    return [p for p in (first, *(mark + r for r in rest)) if p]


def _merged(parts: list[str], size: int, overlap: int) -> list[str]:
    """Runs of parts of at most ``size``; each takes over the last parts of the one before, as many as make at most
    ``overlap`` and leave room for the next part."""
    out, run, length = [], [], 0
    for part in parts:
        if length + len(part) > size and run:
            out.append("".join(run))
            while length > overlap or (length and length + len(part) > size):
                length -= len(run.pop(0))
        run.append(part)
        length += len(part)
    return [x for x in (t.strip() for t in [*out, "".join(run)]) if x]


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, marks: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: cut at the strongest separator that the text has, small parts merged,
    large ones cut again at the weaker separators, and letter by letter where none is left."""
    mark = next((m for m in marks if m in text), "")
    weaker = marks[marks.index(mark) + 1 :] if mark else ()
    out: list[str] = []
    small: list[str] = []
    for part in _parts(text, mark) if mark else list(text):
        if len(part) < size or not mark:
            small.append(part)
            continue
        out += _merged(small, size, overlap)
        small = []
        out += split_text(part, size, overlap, weaker)
    return out + _merged(small, size, overlap)


def split(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The pieces of each text, in Arrow batches; null has none."""

    @F.arrow_udf(ArrayType(StringType()))
    def pieces(texts: pa.Array) -> pa.Array:
        return split_array(texts, size, overlap)

    return pieces(text)


def split_array(texts: pa.Array, size: int = SIZE, overlap: int = OVERLAP) -> pa.Array:
    """The pieces of each text; ``TEXTS`` of them at a time are Python objects."""
    kind = pa.list_(pa.string())
    done = [pa.array([split_text(t, size, overlap) if t else [] for t in texts.slice(at, TEXTS).to_pylist()], kind) for at in range(0, len(texts), TEXTS)]
    return pa.concat_arrays(done) if done else pa.array([], kind)


def section_runs(blocks: DataFrame, ignored: list[str] = IGNORED_HEADINGS) -> DataFrame:
    """page_id, run, section, content_type, text: of blocks(page_id, ord, type, level, text, items, headers, rows).

    A heading of level h2 or h3 that isn't ignored opens a section; other headings are dropped. A table is a run
    of its own and ends the text run before it. Runs between are paragraphs and lists, a line each."""
    w = Window.partitionBy("page_id").orderBy("ord")
    text = collapse("text")
    opens = (F.col("type") == "heading") & F.col("level").isin("h2", "h3") & (text != "") & ~F.lower(text).isin(ignored)
    table = F.col("type") == "table"
    items = F.array_join(F.transform(F.filter(F.transform("items", collapse), lambda x: x != ""), lambda x: F.concat(F.lit("- "), x)), "\n")
    line = F.when(F.col("type") == "paragraph", text).when(F.col("type") == "list", items).when(table, rows_text(F.concat(F.array("headers"), "rows")))
    rows = blocks.select(
        "page_id", "ord", table.alias("table"), line.alias("line"),
        # a table counts on both of its sides: what follows is another run
        (F.sum(F.when(table, 2).when(opens, 1).otherwise(0)).over(w) - F.when(table, 1).otherwise(0)).alias("run"),
        F.coalesce(F.last(F.when(opens, text), ignorenulls=True).over(w), F.lit("General")).alias("section"),
    )
    rows = rows.where(F.coalesce("line", F.lit("")) != "")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda s: s["line"]), "\n")
    return rows.groupBy("page_id", "run", "section", F.when(F.col("table"), "table").otherwise("text").alias("content_type")).agg(F.trim(lines).alias("text"))


def page_chunks(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP, ignored: list[str] = IGNORED_HEADINGS) -> DataFrame:
    """page_id, run, piece, section, content_type, content: tables whole, texts in pieces, white space collapsed."""
    runs = section_runs(blocks, ignored)
    pieces = F.when(F.col("content_type") == "table", F.array("text")).otherwise(split(F.col("text"), size, overlap))
    rows = runs.select("page_id", "run", "section", "content_type", F.posexplode(pieces).alias("piece", "content"))
    clean = F.when(F.col("content_type") == "table", F.col("content")).otherwise(collapse("content"))
    return rows.withColumn("content", clean).where(F.col("content") != "")
