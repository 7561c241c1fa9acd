"""Pieces of DuckDB SQL. The second engine has no look-around, so its patterns capture instead."""

from __future__ import annotations

from lexweave.functions import patterns as P
from lexweave.operators import headings as H


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rep(c: str, *rules: tuple[str, str]) -> str:
    for pattern, to in rules:
        c = f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'g')"
    return c


def strip(c: str) -> str:
    return rep(c, (r"^\s+|\s+$", ""))


#: Applied twice, as a match takes the character that would begin the next one.
_PUNCT = [(r"([,;:])([^\s])", r"\1 \2")] * 2 + [(r"([^\s])([,;:])", r"\1 \2")] * 2


def fix_spacing(c: str) -> str:
    return strip(rep(c, (r"([a-z])([A-Z])", r"\1 \2"), *_PUNCT, (r"[ \t\x0B\f\r]+", " "), (r" *\n *", "\n")))


def strip_annotations(c: str) -> str:
    return rep(c, (r"(?i)vide amendments[^\n]*(?:Legis|dated)[^\n]*", ""), (r"([A-Za-z])([1-9]\d{0,2})([\s.\)\],:;\-—])", r"\1\3"), (r"(?i)\[see[^\]]*\]", ""))


def normalize_text(c: str) -> str:
    c = rep(f"replace({c}, chr(0), '')", (r"\r\n?", "\n"), (r"-\n([a-z])", r"\1"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"))
    return strip(fix_spacing(strip_annotations(c)))


def normalize_block(c: str) -> str:
    return strip(rep(c, (r"[ \t\x0B\f\r]*\n[ \t\x0B\f\r]*", "\n"), (r"\n{3,}", "\n\n")))


def tokens(c: str) -> str:
    cut = "list_filter(list_transform(regexp_extract_all(t, '[A-Z][a-z]+|[a-z]+|[A-Z]+'), lambda p: lower(p)), lambda p: length(p) > 1)"
    raw = f"list_filter(string_split_regex({fix_spacing(c)}, '\\s+'), lambda t: t <> '')"
    return f"flatten(list_transform({raw}, lambda t: CASE WHEN regexp_full_match(t, '[A-Za-z]{{20,}}') THEN {cut} ELSE [lower(t)] END))"


def ext(c: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({c}, {q(pattern)}, {group})"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def normalize_number(c: str) -> str:
    s, shape = strip(c), r"^(\d+(?:\.\d+)*)[\s_-]*([A-Za-z]{1,6})$"
    base, suffix = ext(s, shape), f"upper({ext(s, shape, 2)})"
    return f"CASE WHEN {base} = '' THEN {s} WHEN length({suffix}) = 1 THEN {base} || {suffix} ELSE {base} || '-' || {suffix} END"


def title_case(c: str) -> str:
    return f"list_aggregate(list_transform(regexp_extract_all({c}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda p: upper(p[1:1]) || lower(p[2:])), 'string_agg', '')"


def humanize(c: str) -> str:
    return title_case(f"trim({rep(c, (r'[-_]+', ' '), (r'[\s]+', ' '))})")


def stem(c: str) -> str:
    return rep(f"string_split({c}, '/')[-1]", (r"(.)\.[^.]*$", r"\1"))


def among(c: str, words: list[str]) -> str:
    return f"{c} IN ({', '.join(map(q, words))})"


def words(c: str, pattern: str = "[a-z0-9]+") -> str:
    return f"regexp_extract_all(lower({c}), {q(pattern)})"


def doc_blob(c: str) -> str:
    return rep(f"lower({c})", (r"[-_]+", " "))


def distinctive(c: str) -> str:
    keep = f"length(t) > 2 AND NOT {among('t', P.STOPWORDS)} AND NOT {among('t', P.DOC_NOISE)} AND NOT regexp_full_match(t, '\\d+')"
    return f"list_distinct(list_filter({words(doc_blob(c))}, lambda t: {keep}))"


def joined(c: str, joint: str = ",") -> str:
    """A list in order of its values, as a string."""
    return f"coalesce(array_to_string(list_sort({c}), {q(joint)}), '')"


def acronyms(c: str) -> str:
    w = f"list_filter({words(c, '[a-z]+')}, lambda x: length(x) > 1 AND NOT {among('x', P.DOC_NOISE)} AND NOT {has('x', P.ROMAN)})"
    kind, stop = among("x", P.INSTRUMENT_WORDS), among("x", P.STOPWORDS)
    initials = lambda cond: f"coalesce(array_to_string(list_transform(list_filter({w}, lambda x: {cond}), lambda x: x[1:1]), ''), '')"
    return f"list_distinct(list_filter([{initials(f'NOT {kind} AND NOT {stop}')}, {initials(f'{kind} OR NOT {stop}')}], lambda a: length(a) BETWEEN 3 AND 8))"


def aliases(title: str, name: str) -> str:
    human = humanize(name)
    short = f"list_transform({acronyms(f'CASE WHEN {human} <> {q("")} THEN {human} ELSE {title} END')}, lambda a: upper(a))"
    return f"list_distinct(list_filter(list_concat([{title}, {human}], {short}), lambda a: a IS NOT NULL AND a <> ''))"


def by_length(c: str) -> str:
    """A list of names, longest first, joined by a bar."""
    return f"coalesce(array_to_string(list_transform(list_sort(list_transform({c}, lambda a: {{'n': -length(a), 'a': a}})), lambda s: s.a), '|'), '')"


def group_id(name: str) -> str:
    letters = rep(name, (r"\([^)]*\)", " "), (r"[^a-zA-Z]+", " "))
    core = f"list_filter(string_split(lower({letters}), ' '), lambda w: length(w) > 1 AND NOT {among('w', P.GROUP_NOISE)} AND NOT {has('w', P.ROMAN)})"
    plain = f"lower({rep(rep(name, (r'[-_\s]+', '-')), ('^-+|-+$', ''))})"
    return f"coalesce(nullif(array_to_string({core}, '-'), ''), {plain})"


def document_type(path: str, title: str) -> str:
    p, t = f"lower({path})", f"lower({title})"
    folders = " ".join(f"WHEN contains({p}, '/{f}/') OR starts_with({p}, '{f}/') THEN '{k}'" for f, k in P.TYPE_OF_FOLDER)
    return f"""CASE {folders} WHEN {has(t, '(?i)' + P.AMENDMENT_TITLE)} THEN 'amendment' WHEN contains({t}, 'rules') THEN 'rules' WHEN contains({t}, 'policy') THEN 'policy'
        WHEN contains({t}, 'act') OR contains({t}, 'code') OR contains({t}, 'ordinance') THEN 'base_act' ELSE 'unknown' END"""


def title_number(c: str) -> str:
    n = lambda p: f"nullif({ext(c, p)}, '')"
    return f"coalesce({n(rf'(?i)^\s*(?:Section|Article|Rule)\s+({P.SECTION})')}, {n(rf'^\s*({P.SECTION})')}, {n(rf'(?i)(?:Section|Article|Rule)\s+({P.SECTION})')})"


def mention(number: str) -> str:
    """Pattern for mentions of a section, as an SQL expression."""
    n = rep(number, (r"([^A-Za-z0-9])", r"\\\1"))
    shapes = [(r"\b(?:section|article|rule)\s+", r"(?:[\s\.\:\-—\(]|$)"), (r"§\s*", r"\b"), (r"(?:^|[\n\r])\s*", r"\s*[\).\:\-—]\s+\S"), (r"(?:^|[\n\r])[^\n]{0,6}", r"\s*[\).\:\-—]\s+\S"), (r"(?:^|[\n\r])\s*", r"(?:[\.\:\-]\s|\s)"), (r"\b", r"\s*[\.\:\-—]\s"), (r"\bsection:\s*[^\n]{0,120}", r"\b")]
    return "'(?im)(?:' || " + " || '|' || ".join(f"{q(a)} || {n} || {q(b)}" for a, b in shapes) + " || ')'"


def running(c: str) -> str:
    return f"(NOT {has(c, r'^\s*[.\):;\-—]')} AND {has(c, r'^\s*,?\s*\p{Ll}')})"


def heading(c: str) -> str:
    """A struct of level and title, or NULL. c must be a plain column."""
    t = strip(rep(strip(c), (r"^[\[\]“”‘’\"'\x{FFFD} ]+", "")))
    t = f"({t})"
    words_ = f"list_filter(string_split_regex({t}, '\\s+'), lambda w: {has('w', r'\p{L}')})"
    n = f"len({words_})"
    shouted = f"len(list_filter({words_}, lambda w: upper(w) = w AND lower(w) <> w)) / greatest({n}, 1)"
    capital = f"len(list_filter({words_}, lambda w: {has('w', r'^\p{Lu}')})) / greatest({n}, 1)"
    like = f"length({t}) BETWEEN 4 AND 90 AND NOT {has(t, r'[.;,\-—–]$')} AND len(string_split_regex({t}, '\\s+')) <= 12 AND {n} > 0 AND ({shouted} >= 0.7 OR {capital} >= 0.85)"
    legal, num = ext(t, H.LEGAL), ext(t, H.NUMERIC)
    lead = ext(t, r"(?i)^((?:Section|Article|Schedule|Rule)\s+)")
    label = f"CASE WHEN starts_with(lower({t}), 'article') THEN 'Article' WHEN starts_with(lower({t}), 'rule') THEN 'Rule' WHEN starts_with(lower({t}), 'schedule') THEN 'Schedule' ELSE 'Section' END"
    dots = lambda x: f"length({x}) - length(replace({x}, '.', '')) + 2"
    s = lambda level, title: f"{{'level': ({level})::BIGINT, 'title': {title}}}"
    return f"""CASE WHEN {t} = '' OR {has(t, P.CONTENTS_LINE)} OR {has(t, P.PAGE_LINE)} THEN NULL
        WHEN {legal} <> '' THEN CASE WHEN {running(f'{t}[length({lead}) + length({legal}) + 1:]')} THEN NULL ELSE {s(dots(legal), f"concat_ws(' ', {label}, {legal}, nullif({ext(t, H.LEGAL, 2)}, ''))")} END
        WHEN {has(t, H.LABELLED)} THEN {s('1', strip(f"coalesce(nullif({ext(t, H.LABELLED, 2)}, ''), {ext(t, H.LABELLED)})"))}
        WHEN {num} <> '' THEN CASE WHEN {running(f'{t}[length({num}) + 1:]')} THEN NULL ELSE {s(dots(num), f"concat_ws(' ', {num}, {ext(t, H.NUMERIC, 2)})")} END
        WHEN {has(t, H.LETTER)} THEN {s('4', strip(ext(t, H.LETTER, 2)))}
        WHEN length({ext(t, H.ROMAN)}) BETWEEN 1 AND 6 THEN {s('5', strip(ext(t, H.ROMAN, 2)))}
        WHEN {like} THEN {s('1', t)} ELSE NULL END"""


def intent(c: str) -> str:
    s = strip(c)
    low = strip(f"lower({c})")
    whens = " ".join(f"WHEN {' OR '.join(has(low, p) for p in ps)} THEN '{n}'" for n, ps in P.INTENTS)
    return f"CASE WHEN {has(f'lower(right({s}, 1200))', P.LOOKUP)} THEN 'simple_lookup' {whens} ELSE 'simple_lookup' END"
