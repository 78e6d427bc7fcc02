"""Text normalisers and token sets as column expressions; everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in a question.
STOPWORDS = """
a an the is are was were be been of in on at to for from by with and or
what which who whom where when why how does do did has have had tell me
about give list all any there their it its this that these those can
could would should please are available
""".split()

#: White space, as a class of Java's patterns, whose own is ASCII alone.
SPACES = r"\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def collapse(c: Column) -> Column:
    """White space runs to one space, none at the ends; no-break and other spaces of Unicode are white space."""
    return F.trim(F.regexp_replace(c, rf"[{SPACES}]+", " "))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def match_key(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Case-folded letters and digits alone; the collapsed name itself where none are left, so that
    names in other scripts stay apart. ``aliases``: keys that stand for another name, whose key is taken."""
    def key_of(x: Column) -> Column:
        key = F.regexp_replace(casefold(collapse(x)), "[^a-z0-9]+", "")
        return F.when(key == "", collapse(x)).otherwise(key)

    if not aliases:
        return key_of(c)
    named = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return key_of(F.coalesce(F.try_element_at(named, key_of(c)), c))


def plain(c: Column) -> Column:
    """Lower-case letters and digits, all else one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(c: Column) -> Column:
    """Distinct tokens of a plain text; an empty text has none."""
    return F.array_remove(F.array_distinct(F.split(c, " ")), "")


def content_tokens(c: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(plain(c), " "), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def similarity_name(c: Column) -> Column:
    """Punctuation to spaces, case-folded, collapsed: for comparing names only."""
    return collapse(F.regexp_replace(casefold(c), r"[.,;:()\-/&]", " "))


def strip_titles(c: Column) -> Column:
    """Without leading titles of persons, however many."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^((dr|prof|mr|mrs|ms|sri|fr)[. ] *)+", "")


def jaccard(a: Column, b: Column) -> Column:
    """0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def contains_any(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def first_rule(c: Column, rules: list[tuple[str, list[str]]], default: str | None) -> Column:
    """The name of the first rule one of whose needles the text contains."""
    out = None
    for name, needles in rules:
        hit = contains_any(c, needles)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit(default))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
