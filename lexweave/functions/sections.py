"""Section numbers and citations as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.patterns import AMENDED_NUMBER, AMENDMENTS, SECTION
from lexweave.functions.text import strip


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def normalize(c: Column) -> Column:
    """35-a, 35 a and 35A are 35A; suffixes of two letters or more take a hyphen; all else stays."""
    s = strip(c)
    shape = r"^(\d+(?:\.\d+)*)[\s_-]*([A-Za-z]{1,6})$"
    base, suffix = F.regexp_extract(s, shape, 1), F.upper(F.regexp_extract(s, shape, 2))
    return F.when(base == "", s).when(F.length(suffix) == 1, F.concat(base, suffix)).otherwise(F.concat(base, F.lit("-"), suffix))


def variants(c: Column) -> Column:
    """Ever broader spellings of a reference, most specific first: 9(c), 9C, 9."""
    s = strip(c)
    lettered = r"^(\d+(?:\.\d+)*)-?([A-Za-z]{1,3})$"
    base, suffix = found(s, lettered), F.regexp_extract(s, lettered, 2)
    first = F.array(s, F.when(F.length(suffix) == 1, F.concat(base, F.lit("("), F.lower(suffix), F.lit(")"))), base)
    depth = F.length(s) - F.length(F.replace(s, F.lit("("), F.lit("")))
    clause = r"^(.+)\(([A-Za-z\d]+)\)$"

    def peel(state: Column, _: Column) -> Column:
        parent, inner = found(state["at"], clause), F.regexp_extract(state["at"], clause, 2)
        spelled = F.when(inner.rlike("^[A-Za-z]$") & parent.rlike(r"^\d+(?:\.\d+)*$"), F.concat(parent, F.upper(inner)))
        return F.struct(F.coalesce(parent, state["at"]).alias("at"), F.concat(state["out"], F.array(spelled, parent)).alias("out"))

    start = F.struct(s.alias("at"), first.alias("out"))
    peeled = F.when(depth > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), start, peel, lambda x: x["out"])).otherwise(first)
    return F.array_distinct(F.filter(peeled, lambda v: v.isNotNull() & (v != "")))


def mention_pattern(number: Column) -> Column:
    """A pattern that finds a section number where a text is that section or cites it."""
    n = F.regexp_replace(number, r"([^A-Za-z0-9])", r"\\$1")
    shapes = [
        (r"\b(?:section|article|rule)\s+", r"(?:[\s\.\:\-—\(]|$)"),
        (r"§\s*", r"\b"),
        (r"(?:^|[\n\r])\s*", r"\s*[\).\:\-—]\s+\S"),
        (r"(?:^|[\n\r])[^\n]{0,6}", r"\s*[\).\:\-—]\s+\S"),
        (r"(?:^|[\n\r])\s*", r"(?:[\.\:\-]\s|\s)"),
        (r"\b", r"\s*[\.\:\-—]\s"),
        (r"\bsection:\s*[^\n]{0,120}", r"\b"),
    ]
    parts = [x for a, b in shapes for x in (F.lit("|" + a), n, F.lit(b))]
    return F.concat(F.lit("(?im)(?:"), F.lit(shapes[0][0]), *parts[1:], F.lit(")"))


def mentions(text: Column, number: Column) -> Column:
    return F.coalesce((number != "") & F.rlike(text, mention_pattern(number)), F.lit(False))


def clean(number: Column) -> Column:
    """A cited number in normal form; null for years 1500 to 2099 and for a lone 0, 1 or 2."""
    n = strip(number)
    return F.when(n.rlike(r"^(?:1[5-9]|20)\d{2}$") | n.rlike(r"^[0-2]$"), None).otherwise(normalize(n))


_UNIT = r"(?:days?|day|kg|kgs|grams?|gram|gm|gms|rupees?|rs|packets?|persons?|years?|months?|weeks?|hours?|witnesses?)"
_CITED = [
    rf"(?i)(?:section|article|rule|sec)\s+(?:(?:no|num|number|o|of)\.?\s+)?({SECTION})(?!\s+{_UNIT}\b)",
    rf"(?i)\bu/s\s*\.?\s*({SECTION})",
    rf"(?i)§\s*({SECTION})",
]
_POLITE = r"(?i)^(?:what(?:\s+is|'s|s)?|whats|tell\s+me\s+about|explain|define|describe|give\s+me|show\s+me|about|regarding)\s+"
TERSE = 90


def of_query(q: Column) -> Column:
    """The section a question is about, or null.

    The last citation by the last kind of citation that has one; else a question that is just a
    number once polite words are gone; else, in a short question, a leading ``N of <word>``.
    """
    q = F.regexp_replace(q, r"(?<=\d)\s*-\s*([A-Za-z]{1,3})\b", "-$1")
    last = lambda p: F.try_element_at(F.filter(F.transform(F.regexp_extract_all(q, F.lit(p), F.lit(1)), clean), lambda x: x.isNotNull()), F.lit(-1))
    bare = strip(F.regexp_replace(strip(q), _POLITE, ""))
    whole = clean(found(bare, rf"(?i)^(?:section|article|rule|sec)?\s*({SECTION})[.?!]?$"))
    leading = F.when(F.length(strip(q)) <= TERSE, clean(found(bare, rf"(?i)^(?:section|article|rule|sec)?\s*({SECTION})\s+of\s+[A-Za-z]")))
    return F.coalesce(*(last(p) for p in reversed(_CITED)), whole, leading)


def of_title(t: Column) -> Column:
    """A heading's own number: after a keyword at its start, at its start, else after a keyword anywhere."""
    return F.coalesce(found(t, rf"(?i)^\s*(?:Section|Article|Rule)\s+({SECTION})"), found(t, rf"^\s*({SECTION})"), found(t, rf"(?i)(?:Section|Article|Rule)\s+({SECTION})"))


def of_path(path: Column) -> Column:
    """struct(number, heading) of the deepest heading that has a number; heading is the first one if none has."""
    numbered = F.filter(F.transform(F.reverse(path), lambda t: F.struct(of_title(t).alias("number"), t.alias("heading"))), lambda s: s["number"].isNotNull())
    return F.coalesce(F.try_element_at(numbered, F.lit(1)), F.struct(F.lit(None).cast("string").alias("number"), F.try_element_at(path, F.lit(1)).alias("heading")))


def amendments(text: Column) -> Column:
    """array<struct<text,section,pattern>> of amendment marks with a number, pattern by pattern."""

    def hits(k: int, p: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)), lambda x: F.struct(x.alias("text"), F.regexp_extract(x, AMENDED_NUMBER, 1).alias("section"), F.lit(k).alias("pattern")))

    return F.filter(F.concat(*(hits(k, p) for k, p in enumerate(AMENDMENTS))), lambda s: s["section"] != "")


def ext_normalize(csv: Column) -> Column:
    """A comma-separated list of extensions: trimmed, lower case, each with its dot."""
    parts = F.filter(F.transform(F.split(csv, ","), lambda e: F.lower(F.trim(e))), lambda e: e != "")
    return F.transform(parts, lambda e: F.when(e.startswith("."), e).otherwise(F.concat(F.lit("."), e)))
