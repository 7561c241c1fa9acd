"""Text repair and tokenization as Column functions. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.patterns import CLAUSE_LINE, RUN_ON_WORDS


def chain(c: Column, *rules: tuple[str, str]) -> Column:
    """Replace one pattern after the other."""
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def strip(c: Column) -> Column:
    """Blanks at both ends go. A pattern's ``$`` would also match before a last line end that is no blank (U+0085, U+2028)."""
    return F.trim(c, F.lit(" \t\n\x0b\f\r"))


def strip_annotations(c: Column) -> Column:
    """Delete footnote marks: amendment notes to the end of the line, digits after letters, ``[see ...]``."""
    return chain(c, (r"(?i)vide amendments[^\n]*(?:Legis|dated)[^\n]*", ""), (r"([A-Za-z])([1-9]\d{0,2})([\s.\)\],:;\-—])", "$1$3"), (r"(?i)\[see[^\]]*\]", ""))


_ALTERNATIVES = "|".join(sorted((w for w in RUN_ON_WORDS if len(w) >= 3), key=lambda w: (-len(w), w)))
#: What a text must hold for a token of it to be cut: known words run together from a word's start to its end, 12 letters or more.
RUN_ON = rf"(?i)(?<!\p{{L}})(?=[a-z]{{12}})(?:{_ALTERNATIVES}){{2,}}(?!\p{{L}})"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that the plan holds, and works out, once."""
    return F.transform(F.array(value), f)[0]


def repair_token(t: Column) -> Column:
    """A token whose letters (12 or more) are known words run together, cut into them in lower case.

    The cut is the first complete one that takes the longest word at each place, going back where
    the rest cannot be cut; the look-ahead asks for just that. Other tokens stay as they are.
    """
    lead, trail = F.regexp_extract(t, r"^([^\p{L}]*)", 1), F.regexp_extract(t, r"([^\p{L}]*)$", 1)
    core = F.lower(F.regexp_replace(t, r"^[^\p{L}]+|[^\p{L}]+$", ""))
    cut = F.rtrim(F.regexp_replace(core, rf"\G({_ALTERNATIVES})(?=(?:{_ALTERNATIVES})*$)", "$1 "))
    return F.when((F.length(core) >= 12) & core.rlike(rf"^(?:{_ALTERNATIVES}){{2,}}$"), F.concat(lead, cut, trail)).otherwise(t)


def repair_run_ons(c: Column) -> Column:
    """repair_token on every token of every line; texts without a candidate are not taken apart."""
    line = lambda x: F.array_join(F.transform(F.split(x, " "), repair_token), " ")
    return once(c, lambda x: F.when(x.rlike(RUN_ON), F.array_join(F.transform(F.split(x, "\n"), line), "\n")).otherwise(x))


def fix_spacing(c: Column, run_ons: bool = True) -> Column:
    """Cut camel case, put spaces around ``, ; :``, squeeze blanks in lines, repair run-on tokens."""
    c = chain(c, (r"([a-z])([A-Z])", "$1 $2"), (r"([,;:])(?=\S)", "$1 "), (r"(?<=\S)([,;:])", " $1"), (r"[ \t\x0B\f\r]+", " "), (r" *\n *", "\n"))
    return strip(repair_run_ons(c) if run_ons else c)


def normalize_text(c: Column, run_ons: bool = True) -> Column:
    """Raw extracted text to clean text: NULs and line ends, hyphenation, blank lines, annotations, spacing."""
    c = chain(F.replace(c, F.lit("\0"), F.lit("")), (r"\r\n?", "\n"), (r"-\n(?=[a-z])", ""), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"))
    return strip(fix_spacing(strip_annotations(c), run_ons))


def tokens(c: Column, run_ons: bool = True) -> Column:
    """Search tokens in order: no stemming, no stop words; long alphabetic tokens are cut at case changes."""
    cut = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(r"[A-Z][a-z]+|[a-z]+|[A-Z]+"), F.lit(0)), F.lower), lambda p: F.length(p) > 1)
    raw = lambda x: F.filter(F.split(x, r"\s+"), lambda t: t != "")
    mixed = lambda x: F.flatten(F.transform(raw(x), lambda t: F.when(t.rlike(r"^[A-Za-z]{20,}$"), cut(t)).otherwise(F.array(F.lower(t)))))
    # most texts have no such token and need no look at each
    return once(fix_spacing(c, run_ons), lambda x: F.when(x.rlike(r"(?:^|\s)[A-Za-z]{20,}(?:\s|$)"), mixed(x)).otherwise(raw(F.lower(x))))


def normalize_block(c: Column) -> Column:
    """Strip lines, one blank line at most between others."""
    return strip(chain(c, (r"[ \t\x0B\f\r]*\n[ \t\x0B\f\r]*", "\n"), (r"\n{3,}", "\n\n")))


def reflow(c: Column) -> Column:
    """Join wrapped lines of each paragraph; a clause begins a new line."""

    def paragraph(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, "\n"), strip), lambda x: x != "")
        return F.aggregate(lines, F.lit(""), lambda a, x: F.when(a == "", x).when(x.rlike(CLAUSE_LINE), F.concat(a, F.lit("\n"), x)).otherwise(F.concat(a, F.lit(" "), x)))

    return F.array_join(F.filter(F.transform(F.split(c, r"\n\s*\n"), paragraph), lambda x: x != ""), "\n\n")


def clean_markdown(c: Column) -> Column:
    return strip(chain(c, (r"(?m)^#+\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"\n\n\n+", "\n\n")))


def doc_blob(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[-_]+", " ")


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others."""
    pieces = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def humanize(c: Column) -> Column:
    """A file stem as a readable title."""
    return title_case(F.trim(chain(c, (r"[-_]+", " "), (r"\s+", " "))))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda x: x != "")


def words(c: Column, pattern: str = "[a-z0-9]+") -> Column:
    """Matches of a pattern in the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))

