"""What a question asks for: intent, language, section, document, and how widely to search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import sections
from lexweave.functions.patterns import DIRECTED, INTENTS, LOOKUP, TOPIC_STOPWORDS
from lexweave.functions.text import strip, words
from lexweave.operators import catalog as C

TERSE = sections.TERSE
ARABIC = r"[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]"


def intent(q: Column) -> Column:
    """One of six classes of questions."""
    s = strip(q)
    tail = F.lower(F.when(F.length(s) > 1200, F.substr(s, F.length(s) - 1199)).otherwise(s))
    out, low = F.when(tail.rlike(LOOKUP), "simple_lookup"), strip(F.lower(q))
    for name, patterns in INTENTS:
        out = out.when(low.rlike("|".join(f"(?:{p})" for p in patterns)), name)
    return out.otherwise("simple_lookup")


def detect_language(text: Column) -> Column:
    """ur if at least 0.3 of the letters are of Arabic script, else en."""
    letters, arabic = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(ARABIC))
    return F.when((letters > 0) & (arabic / F.nullif(letters, F.lit(0)) >= 0.30), "ur").otherwise("en")


def resolve_language(asked: Column, text: Column) -> Column:
    a = F.lower(F.coalesce(asked, F.lit("auto")))
    return F.when(a.isin("ur", "urdu"), "ur").when(a.isin("en", "english"), "en").otherwise(detect_language(text))


#: How the names of models begin that reason, and of those that take the effort "minimal".
REASONING, MINIMAL = ("gpt-5", "o1", "o3", "o4"), "gpt-5"


def effort(kind: Column, text: Column, model: Column | None = None) -> Column:
    """How much reasoning to ask of a model, by intent and length of the question; without a model, as for one that takes all efforts."""
    n = F.length(strip(text))
    least = F.lit("minimal") if model is None else F.when(F.lower(model).startswith(MINIMAL), "minimal").otherwise("low")
    return F.when((kind == "simple_lookup") & (n <= 200), least).when(kind.isin("explanation", "penalty") & (n <= 300), "low").otherwise("medium")


def request_params(model: Column, kind: Column, text: Column, answer_tokens: int = 4000) -> Column:
    """struct(max_completion_tokens, reasoning_effort, temperature, max_tokens): the first two for models that reason, else the others."""
    reasons = F.lower(model).rlike("^(?:" + "|".join(REASONING) + ")")
    return F.struct(
        F.when(reasons, answer_tokens + 4000).alias("max_completion_tokens"),
        F.when(reasons, effort(kind, text, model)).alias("reasoning_effort"),
        F.when(~reasons, 0.3).alias("temperature"),
        F.when(~reasons, answer_tokens).alias("max_tokens"),
    )


def topic_tokens(q: Column, title: Column) -> Column:
    """Words of a question that tell which section of a document it means."""
    named = F.coalesce(C.keywords(title), F.array().cast("array<string>"))
    return F.filter(words(q, "[a-z]+"), lambda w: (F.length(w) > 2) & ~w.isin(TOPIC_STOPWORDS) & ~F.array_contains(named, w))


def anchored(q: Column, section: Column, expansion: Column) -> Column:
    """The search text: the question, the section's spellings, and expansion terms, on lines of their own."""
    anchors = F.concat(F.lit("section "), section, F.lit("\narticle "), section, F.lit("\n"), section, F.lit("."))
    return F.concat_ws("\n", q, anchors, F.nullif(expansion, F.lit("")))


def parse_expansion(raw: Column) -> Column:
    """struct of an expansion answer: the outermost braces as JSON; anything else gives nulls."""
    shape = "retrieval_query string, concepts array<string>, synonyms array<string>, statute_anchors array<string>"
    return F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), shape)


def expansion_terms(parsed: Column) -> Column:
    """Anchors, concepts and synonyms, the first spelling of each, joined by spaces."""
    every = F.flatten(F.transform(F.array(parsed["concepts"], parsed["synonyms"], parsed["statute_anchors"]), lambda a: F.coalesce(a, F.array().cast("array<string>"))))
    own = F.filter(F.transform(every, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))
    first = F.filter(own, lambda t, i: F.array_position(F.transform(own, F.lower), F.lower(t)) == i + 1)
    return F.array_join(first, " ")


def plan(queries: DataFrame, cat: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per query: intent, language, section (as stored), target document, search text and candidate counts.

    queries: (query_id, query_text[, expansion_terms]). A document counts only for short questions,
    with a section, or if the question asks for a provision of it. A section is the first of its
    spellings that the target document, or else any, has.
    """
    q = queries if "expansion_terms" in queries.columns else queries.withColumn("expansion_terms", F.lit(None).cast("string"))
    named = C.match(q, cat).select("query_id", F.col("document_id").alias("_doc"), F.col("title").alias("_title"), "stage")
    q = q.join(named, "query_id", "left").withColumns({"asked_section": sections.of_query(F.col("query_text")), "intent": intent(F.col("query_text")), "language": detect_language(F.col("query_text"))})
    held = (F.length(strip(F.col("query_text"))) <= TERSE) | F.col("asked_section").isNotNull() | F.col("query_text").rlike(DIRECTED)
    q = q.withColumns({"target_document": F.when(held, F.col("_doc")), "target_title": F.when(held, F.col("_title"))})

    matches = named_documents(q, cat)
    stored = chunks.where("section_number IS NOT NULL").select("document_id", sections.normalize(F.col("section_number")).alias("variant")).distinct()
    tried = q.where("asked_section IS NOT NULL").select("query_id", "target_document", F.posexplode(sections.variants(F.col("asked_section"))).alias("pos", "variant"))
    scoped = tried.join(stored, "variant").join(matches.select("query_id", "document_id", F.lit(True).alias("own")), ["query_id", "document_id"], "left").where("target_document IS NULL OR own")
    resolved = scoped.groupBy("query_id").agg(F.min_by("variant", "pos").alias("_found"))
    q = q.join(resolved, "query_id", "left").withColumn("section", F.coalesce("_found", "asked_section"))

    compare = F.col("intent") == "comparison"
    both, alone = F.col("section").isNotNull() & F.col("target_document").isNotNull() & ~compare, F.col("section").isNotNull() & F.col("target_document").isNull()
    return q.withColumns(
        {
            "search_text": anchored(F.col("query_text"), F.col("section"), F.col("expansion_terms")),
            "k_channel": F.when(both, 48).when(alone, 36).otherwise(20),
            "k_fused": F.when(both, 36).otherwise(15),
        }
    ).drop("_doc", "_title", "_found")


def named_documents(q: DataFrame, cat: DataFrame) -> DataFrame:
    """(query_id, document_id): the documents whose names match the target's title."""
    wanted = q.where("target_title IS NOT NULL").select("query_id", "target_title")
    names = cat.select("document_id", C.blob(cat).alias("blob"))
    titles = wanted.select("target_title").distinct().withColumn("_k", F.explode(C.keywords(F.col("target_title"))))
    hits = titles.join(names, F.contains(F.col("blob"), F.col("_k"))).groupBy("target_title", "document_id").agg(F.count("*").alias("hits"))
    need = F.greatest(F.lit(2), F.floor((2 * F.size(C.keywords(F.col("target_title"))) + 2) / 3))
    return wanted.join(hits.where(F.col("hits") >= need), "target_title").select("query_id", "document_id")
