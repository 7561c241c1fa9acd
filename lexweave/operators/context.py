"""Contexts, source lists and prompts from ranked results.

results: (query_id, rank, chunk columns). Every function keeps queries apart by query_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import sections
from lexweave.functions.text import reflow

BUDGET = 15_000


def ordered(parts: str | Column, order: str, joint: str) -> Column:
    """Aggregate: the parts of a group, in order, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(parts).alias("_p") if isinstance(parts, str) else parts.alias("_p")))), lambda s: s["_p"]), joint)


def block(flow: bool = False) -> Column:
    """One result as a block of the context."""
    text = reflow(F.col("text")) if flow else F.col("text")
    path = F.coalesce(F.nullif(F.array_join("section_path", " > "), F.lit("")), F.lit("Document"))
    number = F.when(F.coalesce("section_number", F.lit("")) != "", F.concat(F.lit("Section Number: "), "section_number", F.lit("\n"))).otherwise("")
    return F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), F.coalesce("title", "source_path"), F.lit("\nFile: "), "source_path", F.lit("\nSection: "), path, F.lit("\n"), number, F.lit("Text: "), text)


def within_budget(results: DataFrame, budget: int = BUDGET, flow: bool = False) -> DataFrame:
    """results with block and used, up to the first block that would exceed the budget (joints not counted)."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("block", block(flow)).withColumn("used", F.sum(F.length("block")).over(w)).where(F.col("used") <= budget)


def contexts(results: DataFrame, budget: int = BUDGET, flow: bool = False) -> DataFrame:
    """(query_id, n_blocks, context)."""
    kept = within_budget(results, budget, flow)
    return kept.groupBy("query_id").agg(F.count("*").alias("n_blocks"), ordered("block", "rank", "\n\n---\n\n").alias("context"))


def document_sources(results: DataFrame) -> DataFrame:
    """(query_id, title, sections, n): the section numbers and headings cited of each document, in order of the alphabet."""
    names = F.concat(F.array(F.nullif("section_number", F.lit(""))), F.coalesce("section_path", F.array().cast("array<string>")))
    each = results.select("query_id", F.coalesce("title", F.lit("Unknown Document")).alias("title"), names.alias("names"))
    cited = F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list("names")), lambda x: x.isNotNull())))
    return each.groupBy("query_id", "title").agg(cited.alias("sections"), F.count("*").alias("n"))


def cross_references(results: DataFrame) -> DataFrame:
    """(query_id, n_documents, summary): a line for each document if there are several, else a note that there is one."""
    line = F.concat(F.lit("- "), "title", F.lit(": "), F.coalesce(F.nullif(F.array_join("sections", ", "), F.lit("")), F.lit("Various sections")), F.lit(" ("), F.col("n").cast("string"), F.lit(" excerpt(s))"))
    per = document_sources(results).groupBy("query_id").agg(F.count("*").alias("n_documents"), ordered(line, "title", "\n").alias("lines"))
    return per.select("query_id", "n_documents", F.when(F.col("n_documents") > 1, F.col("lines")).otherwise("Single source.").alias("summary"))


def amendment_notice(results: DataFrame) -> DataFrame:
    """(query_id, document_group_id, titles): groups with an amendment and at least one more document among the results."""
    per = results.where("document_group_id IS NOT NULL").groupBy("query_id", "document_group_id").agg(F.array_sort(F.collect_set("title")).alias("ts"), F.bool_or(F.col("document_type") == "amendment").alias("amended"))
    return per.where("amended AND size(ts) >= 2").select("query_id", "document_group_id", F.array_join("ts", ", ").alias("titles"))


def formatted(results: DataFrame) -> DataFrame:
    """(query_id, context): excerpts, with a banner where the document changes."""
    w = Window.partitionBy("query_id").orderBy("rank")
    rule = "=" * 80
    title = F.coalesce("title", F.lit("Unknown Document"))
    banner = F.when(F.lag(title).over(w).eqNullSafe(title), "").otherwise(F.concat(F.lit(f"\n{rule}\nDOCUMENT: "), title, F.lit("\nSOURCE: "), "source_path", F.lit(f"\n{rule}\n")))
    number = F.when(F.coalesce("section_number", F.lit("")) != "", F.concat(F.lit(" (Section Number: "), "section_number", F.lit(")"))).otherwise("")
    label = F.coalesce(F.nullif(F.array_join("section_path", " > "), F.lit("")), F.lit("Document"))
    part = F.concat(banner, F.lit("\n[EXCERPT "), F.col("rank").cast("string"), F.lit("] ["), label, F.lit("]"), number, F.lit("\n"), "text", F.lit("\n"))
    return results.select("query_id", "rank", part.alias("part")).groupBy("query_id").agg(ordered("part", "rank", "").alias("context"))


#: One neutral template for each intent.
TEMPLATES = {
    "simple_lookup": "Quote the provision asked for.\n\nQuestion: {question}\n\nSources:\n{cross_references}\n\nExcerpts:\n{context}",
    "explanation": "Explain the provision in plain words.\n\nQuestion: {question}\n\nSources:\n{cross_references}\n\nExcerpts:\n{context}",
    "comparison": "Compare the provisions point by point.\n\nQuestion: {question}\n\nSources:\n{cross_references}\n\nExcerpts:\n{context}",
    "procedural": "List the steps in order.\n\nQuestion: {question}\n\nSources:\n{cross_references}\n\nExcerpts:\n{context}",
    "penalty": "State the penalty and its conditions.\n\nQuestion: {question}\n\nSources:\n{cross_references}\n\nExcerpts:\n{context}",
    "cross_reference": "List the provisions that bear on each other.\n\nQuestion: {question}\n\nSources:\n{cross_references}\n\nExcerpts:\n{context}",
    "recommendations": "Recommend which provisions to read.\n\nQuestion: {question}\n\nSources:\n{cross_references}\n\nExcerpts:\n{context}",
}


def template(kind: Column, intent: Column) -> Column:
    """The template of a prompt: recommendations if asked for, else by intent."""
    out = F.when(F.coalesce(kind, F.lit("")) == "recommendations", TEMPLATES["recommendations"])
    for name, text in TEMPLATES.items():
        out = out.when(intent == name, text)
    return out.otherwise(TEMPLATES["explanation"])


#: The layout without templates.
PLAIN = "Answer from the context alone; say so if it is not enough.\n\nQuestion:\n{question}\n\nContext:\n{context}\n\nAnswer:\n"


def prompts(queries: DataFrame, contexts: DataFrame, references: DataFrame, system: str | None = None, plain: bool = False) -> DataFrame:
    """(query_id, prompt) for queries (query_id, query_text, intent[, prompt_type]).

    The template of the question's kind, after the system text and a blank line if there is one; with
    plain, the question, the context and an open answer. A query without context gets an empty one.
    """
    q = queries if "prompt_type" in queries.columns else queries.withColumn("prompt_type", F.lit(None).cast("string"))
    q = q.join(contexts.select("query_id", "context"), "query_id", "left").join(references.select("query_id", "summary"), "query_id", "left")
    filled = F.lit(PLAIN) if plain else template(F.col("prompt_type"), F.col("intent"))
    for slot, value in (("{question}", F.col("query_text")), ("{cross_references}", F.coalesce("summary", F.lit(""))), ("{context}", F.coalesce("context", F.lit("")))):
        filled = F.replace(filled, F.lit(slot), value)
    return q.select("query_id", (F.concat(F.lit(f"{system}\n\n"), filled) if system and not plain else filled).alias("prompt"))


def answers(prompts: DataFrame, model=None) -> DataFrame:
    """(query_id, prompt, answer) by a callable(prompt) -> str run in Arrow batches; a null answer without one."""
    if model is None:
        return prompts.withColumn("answer", F.lit(None).cast("string"))
    return prompts.withColumn("answer", F.pandas_udf(lambda s: s.map(model), "string")("prompt"))


def section_references(results: DataFrame) -> DataFrame:
    """(query_id, rank, law, number, full_reference, relevance): each cited section once, where it ranks first."""
    number = sections.normalize(F.col("section_number"))
    full = F.concat("title", F.lit(" Section "), number)
    fused = F.col("fused_score")
    relevance = F.when(F.coalesce(fused, F.lit(0.0)) == 0, 0.85).otherwise(F.least(F.lit(0.99), F.greatest(F.lit(0.5), 0.5 + 0.01 * fused)))
    own = results.where("coalesce(section_number, '') <> ''").select("query_id", "rank", F.col("title").alias("law"), number.alias("number"), full.alias("full_reference"), relevance.alias("relevance"))
    w = Window.partitionBy("query_id", F.lower("full_reference")).orderBy("rank")
    return own.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fallback_answer(context: Column) -> Column:
    """The first three substantial lines of a context."""
    lines = F.slice(F.filter(F.split(context, "\n"), lambda x: (F.trim(x) != "") & (F.length(x) > 20)), 1, 3)
    return F.coalesce(F.nullif(F.array_join(lines, "\n\n"), F.lit("")), F.lit("No text."))


def fallback_recommendations(references: DataFrame) -> DataFrame:
    """(query_id, recommendations): the first eight references with their relevance in percent."""
    w = Window.partitionBy("query_id").orderBy("rank")
    line = F.concat(F.col("i").cast("string"), F.lit(". "), "full_reference", F.lit(" ("), F.floor(F.col("relevance") * 100).cast("string"), F.lit("% relevant)"))
    rows = references.withColumn("i", F.row_number().over(w)).where("i <= 8")
    return rows.groupBy("query_id").agg(ordered(line, "i", "\n").alias("recommendations"))


def speech_text(text: Column, most: int = 4000) -> Column:
    """Longer texts cut at the last space before the limit, with an ellipsis."""
    head = F.substring(text, 1, most)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(head, r"(?s) [^ ]*$", ""), F.lit("…")))
