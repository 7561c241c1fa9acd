"""Queries on contexts, sources, intents and languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import fixtures
from lexweave.operators import context as X
from lexweave.plans import query_plan as Q
from lexweave.queries import query
from lexweave.queries import sqltext as S
from lexweave.queries.catalog import QUERIES, act_chunks
from lexweave.session import table


def _results(spark: SparkSession, d: str) -> DataFrame:
    """The sections of each act as the ranked results of a query of that number; every third row is from the next act."""
    rows = act_chunks(spark, d)
    acts = fixtures.acts(spark, d).select("document_id", F.col("act_no").cast("bigint").alias("act_no"))
    rows = rows.join(acts, "document_id").withColumn("rank", F.col("chunk_index") + 1)
    query_id = F.when(F.col("rank") % 3 == 0, (F.col("act_no") + 1) % 20).otherwise(F.col("act_no"))
    score = F.round(10.0 / (F.col("rank") + F.col("act_no")), 6)
    return rows.withColumns({"query_id": query_id, "fused_score": score, "rank": (F.col("rank") * 100 + F.col("act_no")).cast("bigint")})


_RES = f"""{fixtures.CTES}, res AS (SELECT CASE WHEN n % 3 = 0 THEN (acts.act_no + 1) % 20 ELSE acts.act_no END::BIGINT AS query_id, (n * 100 + acts.act_no)::BIGINT AS rank, document_id AS source_path, title,
    CASE WHEN contains(title, 'Amendment') THEN 'amendment' ELSE 'base_act' END AS document_type, {S.group_id(S.stem('document_id'))} AS document_group_id,
    num AS section_number, num || ' Provision ' || doc_id AS path, section_text AS text, round(10.0::DOUBLE / (n + acts.act_no), 6) AS fused_score FROM sections JOIN acts USING (source))"""
_BLOCK = "'[' || rank || '] Source: ' || title || chr(10) || 'File: ' || source_path || chr(10) || 'Section: ' || path || chr(10) || 'Section Number: ' || section_number || chr(10) || 'Text: ' || text"


@query(f"WITH {_RES}, b AS (SELECT query_id, rank, {_BLOCK} AS block FROM res), u AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM b) SELECT query_id, count(*) AS n_blocks, md5(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM u WHERE used <= {X.BUDGET} GROUP BY query_id")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return X.contexts(_results(spark, d)).select("query_id", "n_blocks", F.md5("context").alias("context_md5"))


_SRC = "src AS (SELECT query_id, title, array_to_string(list_sort(list_distinct(flatten(list([section_number, path])))), ', ') AS cited, count(*) AS n FROM res GROUP BY ALL)"


@query(f"WITH {_RES}, {_SRC} SELECT query_id, title, md5(cited) AS sections_md5, n FROM src")
def doc_sources(spark: SparkSession, d: str) -> DataFrame:
    return X.document_sources(_results(spark, d)).select("query_id", "title", F.md5(F.array_join("sections", ", ")).alias("sections_md5"), "n")


@query(f"WITH {_RES}, {_SRC} SELECT query_id, count(*) AS n_documents, md5(CASE WHEN count(*) > 1 THEN string_agg('- ' || title || ': ' || cited || ' (' || n || ' excerpt(s))', chr(10) ORDER BY title) ELSE 'Single source.' END) AS summary_md5 FROM src GROUP BY query_id")
def cross_refs(spark: SparkSession, d: str) -> DataFrame:
    return X.cross_references(_results(spark, d)).select("query_id", "n_documents", F.md5("summary").alias("summary_md5"))


@query(f"WITH {_RES} SELECT query_id, document_group_id, string_agg(DISTINCT title, ', ' ORDER BY title) AS titles FROM res GROUP BY query_id, document_group_id HAVING count(DISTINCT title) >= 2 AND bool_or(document_type = 'amendment')")
def amendment_notice(spark: SparkSession, d: str) -> DataFrame:
    return X.amendment_notice(_results(spark, d))


_BANNER = "CASE WHEN lag(title) OVER (PARTITION BY query_id ORDER BY rank) = title THEN '' ELSE chr(10) || repeat('=', 80) || chr(10) || 'DOCUMENT: ' || title || chr(10) || 'SOURCE: ' || source_path || chr(10) || repeat('=', 80) || chr(10) END"


@query(f"WITH {_RES}, p AS (SELECT query_id, rank, {_BANNER} || chr(10) || '[EXCERPT ' || rank || '] [' || path || '] (Section Number: ' || section_number || ')' || chr(10) || text || chr(10) AS part FROM res) SELECT query_id, length(string_agg(part, '' ORDER BY rank)) AS n_chars, md5(string_agg(part, '' ORDER BY rank)) AS context_md5 FROM p GROUP BY query_id")
def context_format(spark: SparkSession, d: str) -> DataFrame:
    return X.formatted(_results(spark, d)).select("query_id", F.length("context").cast("bigint").alias("n_chars"), F.md5("context").alias("context_md5"))


_REFS = f"""ref0 AS (SELECT query_id, rank, title AS law, {S.normalize_number('section_number')} AS number, CASE WHEN fused_score = 0 THEN 0.85::DOUBLE ELSE least(0.99::DOUBLE, greatest(0.5::DOUBLE, 0.5::DOUBLE + 0.01::DOUBLE * fused_score)) END AS relevance FROM res),
    ref AS (SELECT * FROM (SELECT *, law || ' Section ' || number AS full_reference, row_number() OVER (PARTITION BY query_id, lower(law || ' Section ' || number) ORDER BY rank) AS k FROM ref0) WHERE k = 1)"""


@query(f"WITH {_RES}, {_REFS} SELECT query_id, rank, law, number, full_reference, round(relevance, 6) AS relevance FROM ref")
def section_refs(spark: SparkSession, d: str) -> DataFrame:
    return X.section_references(_results(spark, d)).withColumn("relevance", F.round("relevance", 6))


@query(f"WITH {_RES}, {_REFS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM ref) SELECT query_id, string_agg(i || '. ' || full_reference || ' (' || floor(relevance * 100)::BIGINT || '% relevant)', chr(10) ORDER BY i) AS recommendations FROM t WHERE i <= 8 GROUP BY query_id")
def fallback_recs(spark: SparkSession, d: str) -> DataFrame:
    """The eight best references of each query; the limit is the feature."""
    return X.fallback_recommendations(X.section_references(_results(spark, d)))


@query("SELECT doc_id, md5(coalesce(nullif(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND length(x) > 20)[1:3], chr(10) || chr(10)), ''), 'No text.')) AS answer_md5 FROM documents")
def fallback_answer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.fallback_answer(F.col("text"))).alias("answer_md5"))


_TALK = f"(SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1, query_id, query_text FROM {QUERIES})"


def _talk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "text").union(fixtures.probes(spark).select(F.lit(-1).cast("bigint"), "query_id", "query_text"))


@query(f"SELECT conv_id, turn, {S.intent('text')} AS intent FROM {_TALK}")
def intent(spark: SparkSession, d: str) -> DataFrame:
    return _talk(spark, d).select("conv_id", "turn", Q.intent(F.col("text")).alias("intent"))


@query(f"SELECT conv_id, turn, CASE WHEN i = 'simple_lookup' AND length({S.strip('text')}) <= 200 THEN 'minimal' WHEN i IN ('explanation', 'penalty') AND length({S.strip('text')}) <= 300 THEN 'low' ELSE 'medium' END AS effort FROM (SELECT conv_id, turn, text, {S.intent('text')} AS i FROM {_TALK})")
def effort(spark: SparkSession, d: str) -> DataFrame:
    return _talk(spark, d).select("conv_id", "turn", Q.effort(Q.intent(F.col("text")), F.col("text")).alias("effort"))


@query(f"SELECT conv_id, turn, i AS template FROM (SELECT conv_id, turn, {S.intent('text')} AS i FROM {_TALK})")
def prompt_select(spark: SparkSession, d: str) -> DataFrame:
    """Which template each question gets, read back from the template's text."""
    chosen = X.template(F.lit(None).cast("string"), Q.intent(F.col("text")))
    name = F.lit(None).cast("string")
    for k, t in X.TEMPLATES.items():
        name = F.when(chosen == t, k).otherwise(name)
    return _talk(spark, d).select("conv_id", "turn", name.alias("template"))


LANGS = ["سوال کیا ہے section 9", "what is دفعہ nine of the act", "", "123", "قانون"]
_ARABIC = "[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A2}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]"
_UR = f"CASE WHEN len(regexp_extract_all(text, '\\p{{L}}')) > 0 AND len(regexp_extract_all(text, '{_ARABIC}')) / len(regexp_extract_all(text, '\\p{{L}}')) >= 0.30 THEN 'ur' ELSE 'en' END"


@query(f"SELECT id::BIGINT AS id, {_UR} AS language FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - id, s FROM {fixtures.values_sql(list(enumerate(LANGS)), 'id, s')})")
def lang_detect(spark: SparkSession, d: str) -> DataFrame:
    probes = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(LANGS)], "id bigint, text string")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").union(probes).select("id", Q.detect_language(F.col("text")).alias("language"))


MODELS = ["gpt-5-mini", "GPT-5", "o3-mini", "gpt-4o", "local"]


@query(
    f"""WITH t AS (SELECT conv_id, turn, text, {S.intent('text')} AS i, m.model FROM {_TALK}, (SELECT unnest({MODELS}) AS model) m),
    r AS (SELECT *, regexp_matches(lower(model), '^(gpt-5|o1|o3|o4)') AS reasons, CASE WHEN i = 'simple_lookup' AND length({S.strip('text')}) <= 200 THEN CASE WHEN starts_with(lower(model), 'gpt-5') THEN 'minimal' ELSE 'low' END WHEN i IN ('explanation', 'penalty') AND length({S.strip('text')}) <= 300 THEN 'low' ELSE 'medium' END AS effort FROM t)
    SELECT conv_id, turn, model, CASE WHEN reasons THEN 8000 END AS max_completion_tokens, CASE WHEN reasons THEN effort END AS reasoning_effort, CASE WHEN NOT reasons THEN 0.3::DOUBLE END AS temperature, CASE WHEN NOT reasons THEN 4000 END AS max_tokens FROM r"""
)
def request_params(spark: SparkSession, d: str) -> DataFrame:
    """What is asked of each kind of model for each question."""
    rows = _talk(spark, d).withColumn("model", F.explode(F.array(*map(F.lit, MODELS))))
    return rows.select("conv_id", "turn", "model", Q.request_params(F.col("model"), Q.intent(F.col("text")), F.col("text")).alias("p")).select("conv_id", "turn", "model", "p.*")


_PROMPT = "CASE " + " ".join(f"WHEN {S.intent('query_text')} = '{k}' THEN {S.q(t)}" for k, t in X.TEMPLATES.items()) + " END"
_CROSS = f"WITH {_RES}, {_SRC}, x AS (SELECT query_id, CASE WHEN count(*) > 1 THEN string_agg('- ' || title || ': ' || cited || ' (' || n || ' excerpt(s))', chr(10) ORDER BY title) ELSE 'Single source.' END AS summary FROM src GROUP BY query_id)"
_SLOTS = "replace(replace(replace({t}, '{{question}}', query_text), '{{cross_references}}', coalesce(summary, '')), '{{context}}', coalesce(context, ''))"
_CTX = "(SELECT doc_id AS query_id, text AS context FROM documents)"


def _filled(t: str) -> str:
    return _SLOTS.format(t=t)


@query(f"{_CROSS} SELECT p.query_id::BIGINT AS query_id, md5('Be exact.' || chr(10) || chr(10) || {_filled(_PROMPT)}) AS prompt_md5, md5({_filled(S.q(X.PLAIN))}) AS plain_md5 FROM {QUERIES} p LEFT JOIN x USING (query_id) LEFT JOIN {_CTX} c USING (query_id)")
def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of each probe in both layouts; its context is the text of the document of that number."""
    q = fixtures.probes(spark).withColumn("intent", Q.intent(F.col("query_text")))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("context"))
    refs = X.cross_references(_results(spark, d))
    whole, plain = X.prompts(q, texts, refs, "Be exact."), X.prompts(q, texts, refs, plain=True)
    return whole.join(plain.withColumnRenamed("prompt", "plain"), "query_id").select("query_id", F.md5("prompt").alias("prompt_md5"), F.md5("plain").alias("plain_md5"))


@query(f"SELECT query_id::BIGINT AS query_id, NULL::VARCHAR AS none, upper(query_text) AS answer FROM {QUERIES}")
def answer_hook(spark: SparkSession, d: str) -> DataFrame:
    """Answers of no model, and of one that shouts the prompt."""
    p = fixtures.probes(spark).select("query_id", F.col("query_text").alias("prompt"))
    none = X.answers(p).select("query_id", F.col("answer").alias("none"))
    return none.join(X.answers(p, str.upper).select("query_id", "answer"), "query_id")
