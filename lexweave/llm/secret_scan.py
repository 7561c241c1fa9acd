"""Secret scans with multipart credential linking.

Base spans come from three patterns. The method adds weak parts, which alone say
nothing: strings of 32 letters and digits or more that mix both, and endpoints. A weak part is reported only
if parts that complete it lie within its scope: a string needs an access identifier,
an endpoint an access identifier and a secret. Scopes are found by an interval join
on a grid of cells as wide as the scope, so a part meets only those in its own and
the neighbouring cells, of which a cell holds a bounded number.

All positions are code points, from the lengths of matches and of the text between
them. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (kind, pattern, group whose length counts, least length).
BASE = [
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
]
WEAK = [
    ("endpoint", r"((?:https?|s3|ftps?)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+)", 1, 10),
    ("secret", r"((?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]*+[0-9])(?=[0-9+/]*+[A-Za-z])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=_-]))", 1, 32),
]
KINDS = [k for k, *_ in BASE + WEAK]
SCOPE = 256


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start,rank,end,kind>> of the leftmost non-overlapping matches whose group is long enough.

    Each array is an argument that is evaluated once: the pieces between matches, the matches, the groups.
    """
    p, rank = _quoted(pattern), KINDS.index(kind)
    none = "cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)"
    span = f"array(named_struct('start', a.p + length(x.gap), 'rank', {rank}, 'end', a.p + length(x.gap) + length(x.hit), 'kind', '{kind}'))"
    step = f"named_struct('p', a.p + length(x.gap) + coalesce(length(x.hit), 0), 's', if(coalesce(length(x.part), 0) < {least}, a.s, concat(a.s, {span})))"
    zipped = f"transform(arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), regexp_extract_all({text}, {p}, {group})), z -> named_struct('gap', z.`0`, 'hit', z.`1`, 'part', z.`2`))"
    found = f"aggregate({zipped}, named_struct('p', 0, 's', {none}), (a, x) -> {step}, a -> a.s)"
    return F.expr(f"if({text} rlike {p}, {found}, {none})")


def base_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, base): base spans by start, then kind as listed. A null text is an empty one."""
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.array_sort(F.concat(*(matches("text", *b) for b in BASE))).alias("base"))


def linked_parts(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(k1, k2, added): for documents with an access identifier, the weak parts that other parts complete.

    k1, k2: hashes of doc_id and text; repeated rows are one. Scope: code points between the starts.
    """
    seed = spans.where(F.col("text").contains("AKIA")).where(F.exists("base", lambda s: s["kind"] == "access"))
    parts = seed.select(F.xxhash64("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), F.explode(F.concat("base", *(matches("text", *w) for w in WEAK))).alias("s")).distinct()
    parts = parts.select("k1", "k2", "s", F.floor(F.col("s.start") / scope).cast("int").alias("cell"))
    # a weak string inside or across a base span is that span
    weak = parts.where("s.kind IN ('endpoint', 'secret')")
    known = parts.where("s.kind NOT IN ('endpoint', 'secret')")
    wide = weak.withColumn("cell", F.explode(F.array(F.col("cell") - 1, "cell", F.col("cell") + 1)))
    right = known.select("k1", "k2", "cell", F.col("s").alias("r"))
    met = wide.join(right, ["k1", "k2", "cell"]).where(F.abs(F.col("s.start") - F.col("r.start")) <= scope)
    over = (F.col("s.start") < F.col("r.end")) & (F.col("r.start") < F.col("s.end"))
    facts = met.groupBy("k1", "k2", "s").agg(F.max(F.col("r.kind") == "access").alias("access"), F.max(F.col("r.kind") != "access").alias("other"), F.max(over & (F.col("s.kind") == "secret")).alias("over"))
    secrets = facts.where("s.kind = 'secret' AND access AND NOT over")
    held = wide.where("s.kind = 'endpoint'").join(secrets.select("k1", "k2", F.floor(F.col("s.start") / scope).cast("int").alias("cell"), F.col("s").alias("r")), ["k1", "k2", "cell"])
    held = held.where(F.abs(F.col("s.start") - F.col("r.start")) <= scope).select("k1", "k2", "s").distinct().withColumn("weak", F.lit(True))
    ends = facts.where("s.kind = 'endpoint' AND access").join(held, ["k1", "k2", "s"], "left").where("other OR weak")
    kept = secrets.select("k1", "k2", "s").union(ends.select("k1", "k2", "s"))
    return kept.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("s")).alias("added"))


def _digest(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row of docs: doc_id, all (array of spans) and the digest columns of the query.

    Texts are scanned where they lie; only span lists are shuffled. Every row gives a row, repeated
    and null ones too; no match gives zero counts, the digest of nothing and an empty list.
    """
    own = base_spans(docs, doc_id, text)
    keyed = own.withColumns({"k1": F.xxhash64("doc_id"), "k2": F.xxhash64("text")}).select("doc_id", "k1", "k2", "base")
    out = keyed.join(linked_parts(own, scope), ["k1", "k2"], "left")
    out = out.withColumn("all", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return out.select("doc_id", "all", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(_digest("base"), 256).alias("base_sha256"), _digest("all").alias("spans"))
