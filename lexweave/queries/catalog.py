"""Queries on document metadata and the catalog, over the derived statutes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import fixtures
from lexweave.functions.patterns import ABBREVIATIONS
from lexweave.operators import catalog as C
from lexweave.queries import query
from lexweave.queries import sqltext as S
from lexweave.session import reused
from lexweave.sources import files

FILES = [
    "/data/amendments/Control of Narcotic Substances (First Amendment) Act 2020.pdf",
    "/data/x/Control-of-Narcotic-Substances-Amendment-Act-2022.txt",
    "/data/x/Control of Narcotic Substances Act 1997.pdf",
    "/data/rules/punjab-police-rules-1934-vol-II.txt",
    "/data/x/Anti-Money-Laundering-Act-2010.md",
    "/data/x/National Policy.md",
    "/data/x/CODE_OF_CRIMINAL_PROCEDURE_1898.html",
    "/data/x/1984.txt",
    "/data/x/qanun-e-shahadat-order-1984.txt",
    "policy/plain practice notes.txt",
]
_FILES = fixtures.values_sql(list(enumerate(FILES)), "id, path")
_FIX = f"(SELECT id::BIGINT AS id, path, {S.stem('path')} AS stem, {S.humanize(S.stem('path'))} AS title FROM {_FILES})"


def _files(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(FILES)), "id bigint, path string")
    none = F.lit(None).cast("string")
    return C.describe(rows.withColumns({"given_title": none, "short_names": F.lit(None).cast("array<string>"), "given_type": none, "given_group": none, "given_amends": none}))


@query(f"SELECT id, title, {S.document_type('path', 'title')} AS document_type FROM {_FIX}")
def doc_type(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark).select("id", "title", "document_type")


@query(f"SELECT id, {S.group_id('stem')} AS document_group_id FROM {_FIX}")
def doc_group(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark).select("id", "document_group_id")


@query(f"SELECT id, {S.joined(S.acronyms('title'))} AS acronyms FROM {_FIX}")
def doc_acronyms(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark).select("id", F.array_join(F.array_sort(C.acronyms(F.col("title"))), ",").alias("acronyms"))


@query(f"SELECT id, {S.by_length(S.aliases('title', 'stem'))} AS aliases FROM {_FIX}")
def doc_aliases(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark).select("id", F.array_join("aliases", "|").alias("aliases"))


_BASE = S.rep("stem", (r"(?i)(?:first\s+)?amendment.*", ""), (r"^[-_ ]+|[-_ ]+$", ""))


@query(f"SELECT id, CASE WHEN {S.document_type('path', 'title')} = 'amendment' AND {_BASE} <> '' THEN {S.group_id(_BASE)} END AS amends_group_id FROM {_FIX}")
def doc_amends(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark).select("id", "amends_group_id")


def act_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, one per section, with the metadata of their acts."""
    rows = fixtures.section_chunks(spark, d).withColumn("source_path", F.col("document_id"))
    s = C.stem(F.col("document_id"))
    kind = F.when(F.col("title").contains("Amendment"), "amendment").otherwise("base_act")
    return rows.withColumns({"document_type": kind, "document_group_id": C.group_id(s, F.lit(None).cast("string")), "amends_group_id": C.amends(s, kind, F.lit(None).cast("string"))})


def act_catalog(spark: SparkSession, d: str) -> DataFrame:
    return reused(C.catalog(act_chunks(spark, d)))


_STEM = S.stem("document_id")
_ABASE = S.rep("stem", (r"(?i)(?:first\s+)?amendment.*", ""), (r"^[-_ ]+|[-_ ]+$", ""))
CATALOG = f"""{fixtures.CTES},
    c0 AS (SELECT document_id, title, {_STEM} AS stem, CASE WHEN contains(title, 'Amendment') THEN 'amendment' ELSE 'base_act' END AS document_type FROM acts),
    c1 AS (SELECT *, {S.group_id('stem')} AS document_group_id, CASE WHEN document_type = 'amendment' AND {_ABASE} <> '' THEN {S.group_id(_ABASE)} END AS amends_group_id, list_distinct([title, {S.humanize('stem')}]) AS aliases FROM c0),
    cat AS (SELECT *, {S.distinctive('title')} AS title_tokens, list_distinct(flatten(list_transform(aliases, lambda b: {S.distinctive('b')}))) AS tokens, list_distinct(flatten(list_transform(list_concat(aliases, [{S.humanize('stem')}]), lambda b: {S.acronyms('b')}))) AS acronyms FROM c1)"""


@query(f"WITH {CATALOG} SELECT document_id, title, document_type, document_group_id, amends_group_id, {S.by_length('aliases')} AS aliases, {S.joined('acronyms')} AS acronyms FROM cat")
def catalog_build(spark: SparkSession, d: str) -> DataFrame:
    return act_catalog(spark, d).select("document_id", "title", "document_type", "document_group_id", "amends_group_id", F.array_join("aliases", "|").alias("aliases"), F.array_join(F.array_sort("acronyms"), ",").alias("acronyms"))


@query(f"WITH {CATALOG} SELECT document_id, {S.joined('tokens')} AS tokens, {S.joined('title_tokens')} AS title_tokens FROM cat")
def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return act_catalog(spark, d).select("document_id", F.array_join(F.array_sort("tokens"), ",").alias("tokens"), F.array_join(F.array_sort("title_tokens"), ",").alias("title_tokens"))


@query(f"WITH {CATALOG} SELECT token, count(DISTINCT document_id) AS n_documents FROM (SELECT document_id, unnest(tokens) AS token FROM cat) GROUP BY token")
def token_doc_freq(spark: SparkSession, d: str) -> DataFrame:
    return C.token_counts(act_catalog(spark, d))


QUERIES = fixtures.values_sql(fixtures.PROBES, "query_id, query_text")
_W = f"list_filter({S.words(S.doc_blob('query_text'), '[a-z]+')}, lambda x: NOT {S.among('x', C.P.STOPWORDS)} AND length(x) > 1)"
_RUNS = ", ".join(f"list_transform(range(1, len({_W}) - {k} + 2), lambda i: array_to_string(list_transform(list_slice({_W}, i, i + {k - 1}), lambda x: x[1:1]), ''))" for k in range(2, 6))


@query(f"SELECT query_id::BIGINT AS query_id, {S.joined(f'list_distinct(flatten([{_RUNS}]))')} AS acronyms FROM {QUERIES}")
def query_acronyms(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.probes(spark).select("query_id", F.array_join(F.array_sort(C.query_acronyms(F.col("query_text"))), ",").alias("acronyms"))


#: Same spelling, or four letters and more, lengths within three, and a matching-blocks ratio of 0.78.
NEAR = [("ember", "amber"), ("amber", "ember"), ("depto", "depot"), ("junipr", "juniper")]
SAME = "amber birch canal cedar depot ember fjord harbor indigo juniper kestrel orchard port quarry trade valley yard".split()


@query(f"SELECT q, t FROM {fixtures.values_sql([*NEAR, *((w, w) for w in SAME)], 'q, t')}")
def fuzzy_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of the probes and title words near in spelling."""
    asked = fixtures.probes(spark).select(F.explode(C.distinctive(F.col("query_text"))).alias("q")).distinct()
    titles = act_catalog(spark, d).select(F.explode("title_tokens").alias("t")).distinct()
    return C.similar_tokens(C.near_pairs(asked, titles))


_KNOWN = fixtures.values_sql([(k, " ".join(v)) for k, v in ABBREVIATIONS.items()], "word, need")


@query(
    f"""WITH {CATALOG}, q AS (SELECT DISTINCT query_id::BIGINT AS query_id, w AS word FROM (SELECT query_id, unnest({S.words("replace(query_text, '.', '')", '[a-z]+')}) AS w FROM {QUERIES}) WHERE length(w) BETWEEN 3 AND 8),
    hit AS (SELECT query_id, document_id FROM q JOIN cat ON list_contains(acronyms, word) UNION SELECT query_id, document_id FROM q JOIN {_KNOWN} k USING (word) JOIN cat ON list_has_all(tokens, string_split(need, ' '))),
    r AS (SELECT query_id, document_id, title, row_number() OVER (PARTITION BY query_id ORDER BY (document_type <> 'base_act')::INT, length(title), title, document_id) AS k FROM hit JOIN cat USING (document_id))
    SELECT query_id, document_id, title FROM r WHERE k = 1"""
)
def abbrev_match(spark: SparkSession, d: str) -> DataFrame:
    return C.abbreviation_matches(fixtures.probes(spark), act_catalog(spark, d))


#: (probe, title, stage): 1 a verbatim name, 2 an abbreviation, 3 enough words of the title, in whatever spelling.
MATCHED = [(2, "Amber Harbor Trade Act", 1), (3, "Birch Valley Trade Act", 1), (4, "Fjord Orchard Trade Act", 1), (6, "Ember Canal Trade Act", 1), (7, "Indigo Port Trade Act", 3), (8, "Juniper Depot Trade Act", 1), (13, "Juniper Depot Trade Act", 3), (17, "Indigo Port Trade Act", 2), (18, "Kestrel Yard Trade Act", 3)]


@query(f"WITH {fixtures.CTES} SELECT query_id::BIGINT AS query_id, document_id, title, stage::BIGINT AS stage FROM {fixtures.values_sql(MATCHED, 'query_id, title, stage')} JOIN acts USING (title)")
def match_query(spark: SparkSession, d: str) -> DataFrame:
    """The document that each probe names, and the stage that found it."""
    return C.match(fixtures.probes(spark), act_catalog(spark, d)).withColumn("stage", F.col("stage").cast("bigint"))


@query(f"WITH {CATALOG} SELECT DISTINCT a.document_id, b.document_id AS related_id FROM cat a JOIN cat b ON a.document_id <> b.document_id AND (a.document_group_id = b.document_group_id OR a.amends_group_id = b.document_group_id OR b.amends_group_id = a.document_group_id)")
def related_docs(spark: SparkSession, d: str) -> DataFrame:
    return C.related(act_catalog(spark, d))


_BLOB = S.doc_blob(f"concat_ws(' ', b.title, array_to_string(list_transform(list_sort(list_transform(b.aliases, lambda v: {{'n': -length(v), 'a': v}})), lambda s: s.a), ' '), b.document_id, b.stem)")
_KEYS = f"list_filter({S.words(S.doc_blob('a.title'))}, lambda w: length(w) > 2)"


@query(f"WITH {CATALOG} SELECT a.title, b.document_id FROM cat a, cat b WHERE len({_KEYS}) > 0 AND len(list_filter({_KEYS}, lambda w: contains({_BLOB}, w))) >= greatest(2, (2 * len({_KEYS}) + 2) // 3)")
def doc_name_match(spark: SparkSession, d: str) -> DataFrame:
    from lexweave.plans.query_plan import named_documents

    cat = act_catalog(spark, d)
    asked = cat.select(F.xxhash64("document_id").alias("query_id"), F.col("title").alias("target_title"))
    return named_documents(asked, cat).join(asked, "query_id").select(F.col("target_title").alias("title"), "document_id")


@query(f"WITH {fixtures.CTES} SELECT document_id AS source_path, title, count(*) AS n_chunks, (SELECT count(*) FROM acts) AS total_documents, (SELECT count(*) FROM sections) AS total_chunks FROM sections JOIN acts USING (source) GROUP BY ALL")
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return C.listing(act_chunks(spark, d))


@query(f"WITH {fixtures.CTES}, m AS (SELECT document_id || '::' || lpad((n - 1)::VARCHAR, 5, '0') AS chunk_id, num, left(section_text, 90) AS head, count(*) OVER () AS n_found FROM sections JOIN acts USING (source) WHERE contains(lower(document_id), 'harbor') AND contains(lower(section_text), 'amended')) SELECT chunk_id, num AS section_number, md5(head) AS head_md5, n_found FROM m ORDER BY chunk_id LIMIT 40")
def debug_sections(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 chunks of a document that contain a text, with the count of all; the limit is the feature."""
    hits = act_chunks(spark, d).where(F.contains(F.lower("source_path"), F.lit("harbor")) & F.contains(F.lower("text"), F.lit("amended")))
    total = hits.agg(F.count("*").alias("n_found"))
    return hits.crossJoin(F.broadcast(total)).select("chunk_id", "section_number", F.md5(F.substring("text", 1, 90)).alias("head_md5"), "n_found").orderBy("chunk_id").limit(40)


@query(f"WITH {fixtures.CTES} SELECT document_id || '::' || lpad((n - 1)::VARCHAR, 5, '0') AS chunk_id, md5(CASE WHEN n % 5 = 0 THEN 'new' ELSE section_text END) AS text_md5 FROM sections JOIN acts USING (source) UNION ALL SELECT 'extra::00000', md5('new')")
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth section replaced and one chunk added."""
    old = act_chunks(spark, d).select("chunk_id", "chunk_index", "text")
    new = old.where("(chunk_index + 1) % 5 = 0").select("chunk_id", "chunk_index", F.lit("new").alias("text")).union(spark.createDataFrame([("extra::00000", 0, "new")], "chunk_id string, chunk_index int, text string"))
    return files.upserted(old, new).select("chunk_id", F.md5("text").alias("text_md5"))


@query(f"WITH {fixtures.CTES} SELECT document_id || '::' || lpad((n - 1)::VARCHAR, 5, '0') AS chunk_id, coalesce(document_id, '') AS source_path, (n - 1)::BIGINT AS chunk_index, length(section_text) AS n_chars FROM sections JOIN acts USING (source)")
def index_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = act_chunks(spark, d)
    return rows.select(F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), F.coalesce("source_path", F.lit("")).alias("source_path"), F.coalesce("chunk_index", F.lit(0)).cast("bigint").alias("chunk_index"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"))
