"""URL filters with redirect equivalence.

Own rules decide first: a rule (host, path) fits its host and all subdomains if
the path starts with the rule's, and the longest fitting rule wins. Pages that no
rule fits take the decision of their equivalence class: the connected component
over redirect and canonical-link edges, in which an explicit allow of any member
goes before a block, and a block goes before the default.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.shared import Scratch, components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its action. rules: (action, ``host/path``), a bounded list held in the plan."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that the plan holds, and evaluates, once."""
    return F.transform(F.array(value), f)[0]


def undotted(path: Column) -> Column:
    """A path that starts with ``/`` without its ``.`` and ``..`` segments; others as they are."""
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))

    def joined(parts: Column) -> Column:
        left = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
        return _let(left, lambda v: F.concat(F.lit("/"), F.array_join(v, "/"), F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(v) > 0), "/").otherwise("")))

    return F.when(path.startswith("/") & path.contains("/."), _let(F.split(path, "/", -1), joined)).otherwise(path)


def node_of(url: Column) -> Column:
    """A url as a node of the link graph: without its fragment and dot segments, host in lower case."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    query = F.regexp_extract(bare, r"(?s)^.*?://[^/?]*[^?]*(.*)$", 1)
    return F.when(url.contains("://"), F.concat(F.regexp_extract(bare, r"(?s)^(.*?://)", 1), host_of(url), _let(path_of(bare), undotted), query)).otherwise(bare)


def decoded(text: Column) -> Column:
    """An attribute's text with its HTML character references decoded, named and numeric."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def numeric(x: Column) -> Column:
        digits, hexes = F.regexp_extract(x, r"^#0*([0-9]{1,7})(?![0-9])", 1), F.regexp_extract(x, r"^#[xX]0*([0-9a-fA-F]{1,6})(?![0-9a-fA-F])", 1)
        code = F.when(digits != "", digits.cast("int")).when(hexes != "", F.conv(hexes, 16, 10).cast("int"))
        good = lambda c: c.between(1, 0xD7FF) | c.between(0xE000, 0x10FFFF)
        return _let(code, lambda c: F.when(good(c), F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")).when(c.isNotNull(), "\ufffd"))

    def one(x: Column) -> Column:
        # without its semicolon a name before '=' is a parameter
        name = F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9]*+(?:;|(?!=)))", 1)
        named = _let(name, lambda n: F.concat(F.try_element_at(names, n), F.substring(x, F.length(n) + 1, F.length(x))))
        return F.coalesce(F.concat(numeric(x), F.regexp_replace(x, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")), named, F.concat(F.lit("&"), x))

    whole = lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))
    return F.when(text.contains("&"), _let(F.split(text, "&", -1), whole)).otherwise(text)


def resolved(to: Column, base: Column) -> Column:
    """The absolute url that a target names on a page of this url: by scheme, host, path or query, or relative to the page's folder."""
    origin, path = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1), path_of(base)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), to)
        .when(~base.contains("://"), F.lit(""))
        .when(to.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), to))
        .when(to.startswith("/"), F.concat(origin, to))
        .when(to.startswith("?"), F.concat(origin, path, to))
        .when((to == "") | to.startswith("#"), base)
        .otherwise(F.concat(origin, folder, to))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) from each page to the target of its canonical link and of its refresh redirect.

    Targets of every form are taken: absolute, or relative to the page's url or to the one that its base element names.
    Only pages with such an element are parsed further; all others stop at a substring test.
    """
    u, t = F.col(url), F.col(html)
    value = r"""\s*=\s*[\"']?\s*([^\"'\s>]+)"""
    tags = F.array(
        F.regexp_extract(F.regexp_extract(t, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0), rf"(?is)\bhref{value}", 1),
        F.regexp_extract(F.regexp_extract(t, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0), rf"(?is)\burl{value}", 1),
    )
    base = F.regexp_extract(F.regexp_extract(t, r"(?is)<base\b[^>]*>", 0), rf"(?is)\bhref{value}", 1)
    hit = pages.where(u.isNotNull() & (F.lower(t).contains("canonical") | F.lower(t).contains("http-equiv")))
    to = hit.select(u.alias("u"), base.alias("base"), F.explode(F.filter(tags, lambda x: x != "")).alias("to"))
    at = F.when(F.col("base") == "", F.col("u")).otherwise(_let(decoded(F.col("base")), lambda x: resolved(x, F.col("u"))))
    full = _let(at, lambda x: _let(decoded(F.col("to")), lambda y: resolved(y, x)))
    edge = _let(full, lambda x: F.struct(node_of(F.col("u")).alias("a"), node_of(x).alias("b")))
    # a test of what an explode gives is not copied into what makes it
    return to.select(F.explode(F.filter(F.array(edge), lambda e: e["b"].contains("://") & (e["a"] != e["b"]))).alias("e")).select("e.a", "e.b").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str]], edges: DataFrame, scratch: Scratch, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule, verdict and via ('rule', 'alias' or 'default').

    edges: (a, b) urls as ``node_of`` writes them; may be empty. A null url or one without ``://``
    has an empty host and path, fits no rule and has no aliases. Repeated urls are one node. An
    input column named like an output column is replaced. The shuffle of pages is by url and
    happens only if there is an edge; class decisions are combined before their shuffle.
    """
    out = pages.drop("host", "path", "rule", "verdict", "via").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "_own": action, "_node": node_of(F.col(url))})
    cc = components(edges, scratch, "urls")
    if cc.isEmpty():
        out = out.withColumn("_class", F.lit(None).cast("string"))
    else:
        member = scratch.store(cc, "members")
        # targets that are not pages themselves are judged by the rules as well
        own = member.select("component", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)[1].alias("act"))
        said = own.where("act IS NOT NULL").groupBy("component").agg(F.min("act").alias("_class"))  # 'allow' sorts before 'block'
        said = member.join(said, "component").select(F.col("node").alias("_node"), "_class")
        out = out.join(said, "_node", "left")
    via = F.when(F.col("_own").isNotNull(), "rule").when(F.col("_class").isNotNull(), "alias").otherwise("default")
    return out.withColumns({"verdict": F.coalesce("_own", "_class", F.lit(default)), "via": via}).drop("_own", "_class", "_node")
