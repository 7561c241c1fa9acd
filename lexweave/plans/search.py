"""The whole search as one declarative plan over a table of queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import sections
from lexweave.functions.patterns import SECTION
from lexweave.functions.text import words
from lexweave.operators import catalog as C
from lexweave.operators import retrieval as R
from lexweave.plans import query_plan as Q
from lexweave.session import reused

FINAL, SCAN = 10, 15


def affinity(query: Column, title: Column, path: Column) -> Column:
    """Share of a question's words in a document's title and file name, 0 to 1."""
    own = lambda c: F.array_distinct(F.filter(words(c), lambda w: F.length(w) > 2))
    q, d = own(query), own(F.replace(F.replace(F.concat_ws(" ", title, C.stem(path)), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")))
    return F.least(F.lit(1.0), F.size(F.array_intersect(q, d)) / F.greatest(F.lit(3.0), F.sqrt(F.size(q).cast("double"))))


def in_heading(path: Column, section: Column) -> Column:
    """A heading of the path is that of the section: a keyword and the number, or the number first."""
    first = lambda h: sections.normalize(sections.found(h, rf"(?i)^(?:section|article|rule)\s+({SECTION})\b"))
    second = lambda h: sections.normalize(sections.found(h, rf"^({SECTION})\s"))
    return F.coalesce(F.exists(path, lambda h: (first(h) == section) | (second(h) == section)), F.lit(False))


def section_boost(c: dict[str, Column]) -> Column:
    """Factor for the section a question asks for, its relatives and its amendments.

    c may hold amendment_target_sections and amendment_sections, arrays that a caller's metadata gives.
    """
    norm, raw, target = sections.normalize(c["section_number"]), c["section_number"], c["section"]
    has = raw.isNotNull()
    exact = has & (norm == target)
    body = (F.length(c["text"]) >= 250) | c["text"].rlike(r"(?i)\(\d+\)|\bshall\b|\bmay\b|\bmeans\b")
    holds = lambda name, f: F.coalesce(F.exists(c[name], lambda x: f(x) == target), F.lit(False)) if name in c else F.lit(False)
    amends, mentioned = holds("amendment_target_sections", lambda x: x), holds("amendment_sections", sections.normalize)
    matched = F.coalesce(exact, F.lit(False)) | amends
    own = F.when(matched, 3.0).when(mentioned, 2.5).otherwise(1.0) * F.when((matched | mentioned) & body, 1.4).otherwise(1.0)
    above = F.when(has & (F.coalesce(target == c["parent_section"], F.lit(False)) | F.coalesce(F.array_contains(c["section_hierarchy"], target), F.lit(False))), 1.8).otherwise(1.0)
    below = F.when(has & raw.startswith(target) & (raw != target), 1.5).otherwise(1.0)
    amended = F.when(has & F.coalesce(c["amendments_detected"], F.lit(False)), 1.6).otherwise(1.0)
    cited = F.when(has & F.coalesce(F.array_contains(c["amendment_references"], target), F.lit(False)), 1.4).otherwise(1.0)
    return own * above * below * amended * cited


def scan_section(plan: DataFrame, named: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, scan): all chunks of the named documents that are or mention the section; the best SCAN."""
    wanted = plan.where("section IS NOT NULL AND target_document IS NOT NULL").select("query_id", "section").join(named, "query_id")
    hits = wanted.join(chunks.select("document_id", "chunk_id", "section_number", "text"), "document_id")
    score = F.when(sections.normalize(F.col("section_number")) == F.col("section"), 5000.0).when(sections.mentions(F.col("text"), F.col("section")), 500.0)
    hits = hits.select("query_id", "chunk_id", score.alias("scan")).where("scan IS NOT NULL")
    return R.top(hits, SCAN, SCAN, "scan").select("query_id", "chunk_id", "scan")


def recover_topic(plan: DataFrame, named: DataFrame, chunks: DataFrame, index: R.Index) -> DataFrame:
    """(query_id, chunk_id, topic): for questions on a document without a section, its chunks ranked by the topic's words, scaled to 20-50."""
    asked = plan.where("target_document IS NOT NULL AND section IS NULL AND intent <> 'comparison'")
    asked = asked.select("query_id", Q.topic_tokens(F.concat_ws(" ", "query_text", "expansion_terms"), F.col("target_title")).alias("ts"))
    terms = asked.select("query_id", F.explode("ts").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n_asked"))
    hits = R.bm25(terms, index).join(chunks.select("chunk_id", "document_id", F.lower(F.array_join("section_path", " ")).alias("head")), "chunk_id").join(named, ["query_id", "document_id"], "left_semi").join(asked, "query_id")
    hits = hits.withColumn("score", F.col("score") * F.when(F.exists("ts", lambda t: F.contains("head", t)), 2.0).otherwise(1.0))
    hits = R.top(hits.select("query_id", "chunk_id", "score"), SCAN, SCAN)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.select("query_id", "chunk_id", (20.0 + 30.0 * F.col("score") / best).alias("topic"))


def upsert(candidates: DataFrame, extra: DataFrame, score: str) -> DataFrame:
    """Raise candidates to the extra rows' scores and add those that are missing."""
    more = extra.select("query_id", "chunk_id", F.lit(0.0).alias("dense_score"), F.lit(0.0).alias("lexical_score"), F.col(score).alias("fused_score"))
    both = candidates.select("query_id", "chunk_id", "dense_score", "lexical_score", "fused_score").unionByName(more)
    return both.groupBy("query_id", "chunk_id").agg(F.max("dense_score").alias("dense_score"), F.max("lexical_score").alias("lexical_score"), F.max("fused_score").alias("fused_score"))


def named_filter(fused: DataFrame, where: DataFrame, named: DataFrame, plan: DataFrame, scan: DataFrame) -> DataFrame:
    """The rows of fused that the document a question names leaves.

    For a question with a target that compares nothing: the named documents' candidates; if there are
    none, nothing if the scan found chunks that will stand for them; else all. Other questions keep all.
    """
    marks = fused.join(where, "chunk_id").join(named.select("query_id", "document_id", F.lit(True).alias("hit")), ["query_id", "document_id"], "left").join(plan.select("query_id", "target_document", "intent"), "query_id")
    marks = marks.join(scan.select("query_id", F.lit(True).alias("scanned")).distinct(), "query_id", "left")
    strict = F.col("target_document").isNotNull() & (F.col("intent") != "comparison")
    any_hit = F.max(F.coalesce("hit", F.lit(False))).over(Window.partitionBy("query_id"))
    return marks.withColumn("any_hit", any_hit).where(~strict | (F.col("any_hit") & F.coalesce("hit", F.lit(False))) | (~F.col("any_hit") & F.col("scanned").isNull()))


def document_boosts(pool: DataFrame, named: DataFrame, plan: DataFrame, cat: DataFrame) -> DataFrame:
    """pool (with document_id) with fused_score doubled for named documents and raised by 1.35 for those related to the target."""
    pool = pool.join(named.select("query_id", "document_id", F.lit(2.0).alias("hit")), ["query_id", "document_id"], "left")
    kin = C.related(cat).select(F.col("document_id").alias("target_document"), F.col("related_id").alias("document_id"), F.lit(1.35).alias("kin"))
    pool = pool.join(plan.select("query_id", "target_document"), "query_id").join(kin, ["target_document", "document_id"], "left")
    return pool.withColumn("fused_score", F.col("fused_score") * F.coalesce("hit", F.lit(1.0)) * F.coalesce("kin", F.lit(1.0)))


def final(rows: DataFrame) -> DataFrame:
    """The FINAL best of each query: with coverage of documents where broad, else by score alone."""
    cols = ["query_id", "rank", "chunk_id", "document_id", "dense_score", "lexical_score", "fused_score"]
    broad = R.coverage(rows.where("broad").drop("broad"), FINAL).select(cols)
    return broad.unionByName(R.top(rows.where("NOT broad").drop("broad"), FINAL, FINAL, "fused_score").select(cols))


def rerank(results: DataFrame, chunks: DataFrame, model=None) -> DataFrame:
    """results with rerank_score: null, or of a model called with lists (questions, texts); the order stays.

    results: (query_id, chunk_id, query_text, ...).
    """
    if model is None:
        return results.withColumn("rerank_score", F.lit(None).cast("double"))
    run = F.pandas_udf(lambda q, t: pd.Series(model(q.tolist(), t.tolist()), dtype=float), "double")
    return results.join(chunks.select("chunk_id", F.col("text").alias("_t")), "chunk_id").withColumn("rerank_score", run("query_text", "_t")).drop("_t")


def search(plan: DataFrame, cat: DataFrame, chunks: DataFrame, index: R.Index, query_vectors: DataFrame, vectors: DataFrame, run_ons: bool = True) -> DataFrame:
    """(query_id, rank, chunk_id, document_id, dense_score, lexical_score, fused_score): the FINAL best of each query.

    plan comes from ``query_plan.plan``. All queries share one pass over each index table; every
    per-query step is a window or a join by query_id. Multiplications follow the order fusion,
    named-instrument filter and scan, document and group boosts, topic recovery, section boosts,
    affinity; ties go to the smaller chunk_id.
    """
    size = plan.select("query_id", "k_channel", "k_fused")
    dense = R.top(R.dense(query_vectors, vectors).join(size, "query_id"), F.col("k_channel"), 48)
    lexical = R.top(R.bm25(R.query_terms(plan, "search_text", run_ons), index).join(size, "query_id"), F.col("k_channel"), 48)
    fused = R.top(R.fuse(dense, lexical).join(size, "query_id"), F.col("k_fused"), 36, "fused_score")

    named = reused(Q.named_documents(plan, cat))
    where = chunks.select("chunk_id", "document_id")
    scan = scan_section(plan.where("intent <> 'comparison'"), named, chunks)
    pool = reused(upsert(named_filter(fused, where, named, plan, scan), scan, "scan"))

    pool = document_boosts(pool.join(where, "chunk_id"), named, plan, cat)
    pool = upsert(pool, recover_topic(plan, named, chunks, index), "topic")

    extra = [c for c in ("amendment_target_sections", "amendment_sections") if c in chunks.columns]
    facts = [*extra, "document_id", "title", "source_path", "text", "section_number", "parent_section", "section_hierarchy", "amendments_detected", "amendment_references"]
    full = pool.join(chunks.select("chunk_id", *facts), "chunk_id").join(plan.select("query_id", "query_text", "section", "intent"), "query_id")
    boost = section_boost({c: F.col(c) for c in [*facts, "section"]}) * (1.0 + 0.55 * affinity(F.col("query_text"), F.col("title"), F.col("source_path")))
    full = full.withColumn("fused_score", F.when(F.col("section").isNotNull(), F.col("fused_score") * boost).otherwise(F.col("fused_score")))
    rows = full.select("query_id", "chunk_id", "document_id", "dense_score", "lexical_score", "fused_score", (F.col("section").isNull() | (F.col("intent") == "comparison")).alias("broad"))
    return final(rows)
