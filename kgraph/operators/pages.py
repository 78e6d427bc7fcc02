"""Pages and chunks: URLs, parts of clean HTML by pattern (``page_tree`` parses any), fixed chunks, extraction records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..sources.ordering import running_total

#: Extensions of files that are no pages; callers may pass others.
SKIPPED = ["pdf", "jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "css", "js", "zip", "rar", "mp4", "mp3", "avi", "mov"]


def skipped(url: Column, extensions: list[str] = SKIPPED) -> Column:
    """Whether a URL's path ends in one of the extensions."""
    return F.lower(F.regexp_extract(url, r"^([^?#]*)", 1)).rlike(rf"\.({'|'.join(extensions)})$")


def in_scope(url: Column, hosts: list[str], prefix: str = "/") -> Column:
    """Whether a URL is of one of the hosts, and its path below the prefix."""
    host, path = F.lower(F.try_parse_url(url, F.lit("HOST"))), F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.coalesce(host.isin(hosts) & F.startswith(F.when(path == "", "/").otherwise(path), F.lit(prefix)), F.lit(False))


def joined_url(base: Column, link: Column) -> Column:
    """A link as seen from its page: whole URLs as they are, others by the page's scheme, host or folder, dot
    segments resolved from the left, however many, those above the root dropped."""
    scheme, host = F.regexp_extract(base, "^([a-zA-Z]+:)//", 1), F.regexp_extract(base, "^([a-zA-Z]+://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), "^([a-zA-Z]+://[^/]*(?:/.*)?)/[^/]*$", 1)
    folder = F.when(folder.rlike("^[a-zA-Z]+:/?$") | (folder == ""), host).otherwise(folder)
    full = (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, link)).when(F.startswith(link, F.lit("/")), F.concat(host, link))
        .when(F.startswith(link, F.lit("?")), F.concat(F.regexp_replace(base, "[?#].*$", ""), link)).when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), link)).otherwise(F.concat(folder, F.lit("/"), link))
    )
    root, path, rest = (F.regexp_extract(full, "^([a-zA-Z]+://[^/?#]*)?([^?#]*)(.*)$", i) for i in (1, 2, 3))
    steps = F.split(path, "/", -1)
    # a path that ends in a dot segment ends in a slash
    steps = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(steps, F.array(F.lit("")))).otherwise(steps)

    def walk(done: Column, step: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when(step == ".", done).when(step == "..", up).otherwise(F.concat(done, F.array(step)))

    resolved = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)") & (root != ""), F.concat(root, resolved, rest)).otherwise(full)


def rows_text(rows: Column) -> Column:
    """A table of rows of cells: cells that aren't blank joined by bars, a line each."""
    lines = F.transform(rows, lambda r: F.array_join(F.filter(r, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), " | "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def records_text(records: Column) -> Column:
    """A table of maps: key and value of each entry joined by bars, a line each."""
    return F.array_join(F.transform(records, lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws(": ", e["key"], e["value"])), " | ")), "\n")


def record_text(record: Column) -> Column:
    """One map: a line an entry."""
    return F.array_join(F.transform(F.map_entries(record), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")


def normal_url(url: Column) -> Column:
    """https, host in lower case without a leading www., no fragment; path and query as they are."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[a-zA-Z]+://", "")
    host, rest = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), F.regexp_extract(bare, "^[^/?]*(.*)$", 1)
    return F.concat(F.lit("https://"), F.regexp_replace(host, r"^www\.", ""), rest)


def title(html: Column) -> Column:
    return collapse(F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1))


def without_noise(html: Column) -> Column:
    for tag in ("script", "style", "noscript", "iframe", "svg", "nav", "footer"):
        html = F.regexp_replace(html, f"(?is)<{tag}[ >].*?</{tag}>", " ")
    return html


def links(pages: DataFrame) -> DataFrame:
    """page_id, link: each distinct href of a page that isn't a file to skip."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link")).select("page_id", F.trim("link").alias("link")).where((F.col("link") != "") & ~skipped(F.col("link"))).distinct()


def paragraphs(pages: DataFrame, least: int = 20) -> DataFrame:
    """page_id, ord, text of paragraphs longer than ``least`` once tags are gone."""
    found = F.regexp_extract_all(without_noise(F.col("html")), F.lit("(?is)<p>(.*?)</p>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "raw"))
    return rows.select("page_id", F.col("ord").cast("long").alias("ord"), collapse(F.regexp_replace("raw", "<[^>]*>", " ")).alias("text")).where(F.length("text") > least)


def fixed_chunks(docs: DataFrame, size: int = 1100, overlap: int = 200) -> DataFrame:
    """doc_id, piece, text: windows of ``size`` characters, each ``overlap`` into the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.length("text") - overlap, F.lit(1)), F.lit(step))
    return docs.where(F.length("text") > 0).select("doc_id", "text", F.posexplode(starts).alias("piece", "at")).select("doc_id", F.col("piece").cast("long").alias("piece"), F.substring("text", F.col("at"), F.lit(size)).alias("text"))


def number_chunks(chunks: DataFrame, group: str, order: list[str]) -> DataFrame:
    """chunk_n over all rows from 1, by group, then order: counts of groups are summed range by range, and the
    rows themselves are numbered group by group."""
    base = running_total(chunks.groupBy(group).agg(F.count("*").alias("_n")), F.col("_n"), "_base", group).select(group, "_base")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return chunks.withColumn("_r", rank).join(base, group).withColumn("chunk_n", (F.col("_base") + F.col("_r")).cast("long")).drop("_r", "_base")


def token_budget(chunks: DataFrame, limit: int = 8000, margin: int = 400, prompt: int = 900, low: int = 800, high: int = 6000) -> DataFrame:
    """Adds estimate (a token for four characters), completion (what the limit leaves, within bounds) and
    allowed (characters that fit with the least completion)."""
    estimate = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("long")
    room = F.lit(limit - margin - prompt) - estimate
    return chunks.select("*", estimate.alias("estimate"), F.least(F.greatest(room, F.lit(low)), F.lit(high)).cast("long").alias("completion"), F.least(F.length("text"), F.lit(4 * (limit - margin - prompt - low))).cast("long").alias("allowed"))


def salvage(raw: Column, schema: str) -> Column:
    """The record between the first and the last brace, or null."""
    return F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), schema)


def pending(chunks: DataFrame, done: DataFrame, retry_failed: bool) -> DataFrame:
    """Chunks not yet extracted; with ``retry_failed`` also those whose record has an error."""
    settled = done.where(F.col("error").isNull()) if retry_failed else done
    return chunks.join(settled.select("chunk_id"), "chunk_id", "left_anti")
