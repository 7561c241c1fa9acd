"""Queries on the chat log and on ingest, over the driver's tables in those roles."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import fixtures
from lexweave.operators import chatlog as L
from lexweave.queries import query
from lexweave.session import table
from lexweave.sources import files, ingest


def _users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"))


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.concat("o_orderpriority", F.lit(" "), "o_orderstatus").alias("title"), F.col("o_orderdate").alias("updated_at"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Line items as messages: even line numbers are the assistant's, some of them rated."""
    li = table(spark, d, "lineitem")
    role = F.when(F.col("l_linenumber") % 2 == 0, "assistant").when(F.col("l_linenumber") == 7, "system").otherwise("user")
    rating = F.when((F.col("l_linenumber") % 2 == 0) & (F.col("l_quantity") > 25), (F.col("l_partkey") % 5 + 1).cast("int"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("conversation_id"), role.alias("role"), rating.alias("rating"), F.col("l_shipdate").alias("created_at"))


_MSG = """msg AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS conversation_id, CASE WHEN l_linenumber % 2 = 0 THEN 'assistant' WHEN l_linenumber = 7 THEN 'system' ELSE 'user' END AS role,
    CASE WHEN l_linenumber % 2 = 0 AND l_quantity > 25 THEN (l_partkey % 5 + 1)::INT END AS rating, l_shipdate AS created_at FROM lineitem),
    conv AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority || ' ' || o_orderstatus AS title, o_orderdate AS updated_at FROM orders)"""


def _name(spark: SparkSession, d: str) -> str:
    return table(spark, d, "customer").agg(F.min("c_name")).first()[0]


@query("SELECT c_custkey AS user_id, c_name AS username FROM customer WHERE lower(c_name) = (SELECT lower(min(c_name)) FROM customer)")
def user_lookup(spark: SparkSession, d: str) -> DataFrame:
    return L.find_user(_users(spark, d), _name(spark, d).swapcase()).select("user_id", "username")


@query("SELECT o_orderkey AS token, c_custkey AS user_id, c_name AS username FROM orders JOIN customer ON o_custkey = c_custkey")
def session_user(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "orders").select(F.col("o_orderkey").alias("token"), F.col("o_custkey").alias("user_id"))
    return L.session_user(sessions, _users(spark, d)).select("token", "user_id", "username")


@query(f"WITH {_MSG} SELECT id, title, updated_at FROM conv WHERE user_id = 7")
def list_conversations(spark: SparkSession, d: str) -> DataFrame:
    return L.list_conversations(_conversations(spark, d), 7).select("id", "title", "updated_at")


@query(f"WITH {_MSG} SELECT id, user_id, title FROM conv WHERE id = 1 AND user_id = (SELECT user_id FROM conv WHERE id = 1)")
def conv_owner(spark: SparkSession, d: str) -> DataFrame:
    conv = _conversations(spark, d)
    first = conv.where("id = 1").first()
    return L.owned(conv, 1, first["user_id"] if first else -1).select("id", "user_id", "title")


@query("SELECT conv_id AS conversation_id, turn AS id, role, 1::BIGINT AS n_thinking, CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS n_sections FROM conversations")
def list_messages(spark: SparkSession, d: str) -> DataFrame:
    """Turns with JSON columns, decoded; even turns have no sections."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("id"), "role", F.to_json(F.array("role")).alias("thinking"), F.when(F.col("turn") % 2 == 0, "").otherwise('[{"type": "Section", "number": "9", "relevance": 0.9}]').alias("sections"))
    return L.list_messages(rows).select("conversation_id", "id", "role", F.size("thinking").cast("bigint").alias("n_thinking"), F.size("sections").cast("bigint").alias("n_sections"))


@query(f"WITH {_MSG} SELECT count(rating) AS rated, round(avg(rating), 2) AS average FROM msg")
def rating_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.rating_stats(_messages(spark, d))


@query(f"WITH {_MSG} SELECT r::BIGINT AS rating, count(m.id) AS n FROM range(1, 8) t(r) LEFT JOIN msg m ON m.rating = r GROUP BY r")
def rating_hist(spark: SparkSession, d: str) -> DataFrame:
    """Ratings from 1 to 7, so that some are zero-filled."""
    return L.rating_histogram(_messages(spark, d), 1, 7).select(F.col("rating").cast("bigint").alias("rating"), "n")


_CHANGES = "chg AS (SELECT l_orderkey * 10 + l_linenumber AS message_id, o_custkey - (l_linenumber % 3 = 0)::INT AS user_id, l_suppkey % 7 AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')"


@query(f"WITH {_MSG}, {_CHANGES} SELECT m.id, coalesce((SELECT max(c.rating) FROM chg c JOIN conv v ON v.id = m.conversation_id AND v.user_id = c.user_id WHERE c.message_id = m.id AND m.role = 'assistant' AND c.rating BETWEEN 1 AND 5), m.rating)::BIGINT AS rating FROM msg m")
def set_rating(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    changes = li.where("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("message_id"), (F.col("o_custkey") - (F.col("l_linenumber") % 3 == 0).cast("int")).alias("user_id"), (F.col("l_suppkey") % 7).alias("rating"))
    return L.set_rating(_messages(spark, d), _conversations(spark, d), changes).select("id", F.col("rating").cast("bigint").alias("rating"))


@query(f"WITH {_MSG} SELECT c.id, greatest(c.updated_at, max(m.created_at)) AS updated_at FROM conv c LEFT JOIN msg m ON m.conversation_id = c.id GROUP BY c.id, c.updated_at")
def conv_updated_at(spark: SparkSession, d: str) -> DataFrame:
    return L.with_updated_at(_conversations(spark, d), _messages(spark, d)).select("id", "updated_at")


@query(f"WITH {_MSG} SELECT 'conversation' AS kind, id FROM conv WHERE NOT contains(title, 'URGENT') UNION ALL SELECT 'message', m.id FROM msg m WHERE m.conversation_id NOT IN (SELECT id FROM conv WHERE contains(title, 'URGENT'))")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left after all urgent conversations are deleted by their owners."""
    conv = _conversations(spark, d)
    c, m = L.delete_conversations(conv, _messages(spark, d), conv.where(F.contains("title", F.lit("URGENT"))).select("id", "user_id"))
    return c.select(F.lit("conversation").alias("kind"), "id").union(m.select(F.lit("message"), "id"))


@query(f"WITH {_MSG} SELECT 'message_role' AS rule, count(*) AS n FROM msg WHERE role NOT IN ('user', 'assistant') UNION ALL SELECT 'message_rating', count(*) FROM msg WHERE rating NOT BETWEEN 1 AND 5 UNION ALL SELECT 'message_conversation', count(*) FROM msg WHERE conversation_id NOT IN (SELECT id FROM conv) UNION ALL SELECT 'user_name', count(*) FROM (SELECT lower(c_name) FROM customer GROUP BY 1 HAVING count(*) > 1)")
def constraint_check(spark: SparkSession, d: str) -> DataFrame:
    return L.violations(_messages(spark, d), _conversations(spark, d), _users(spark, d))


@query(f"WITH {_MSG} SELECT id, title FROM conv WHERE contains(lower(title), 'urgent')")
def conv_search(spark: SparkSession, d: str) -> DataFrame:
    return L.search_titles(_conversations(spark, d), "Urgent").select("id", "title")


NOW = "1996-03-15 12:00:00"


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderdate::DATE = DATE '1996-03-15' THEN 'Today' WHEN o_orderdate::DATE = DATE '1996-03-14' THEN 'Yesterday' WHEN o_orderdate > TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN strftime(o_orderdate, '%a') ELSE strftime(o_orderdate, '%b %-d') END AS label FROM orders WHERE o_orderdate <= TIMESTAMP '{NOW}'")
def conv_date_bucket(spark: SparkSession, d: str) -> DataFrame:
    now = F.to_timestamp(F.lit(NOW))
    return table(spark, d, "orders").where(F.col("o_orderdate") <= now).select(F.col("o_orderkey").alias("id"), L.date_label(F.col("o_orderdate"), now).alias("label"))


@query("SELECT conv_id, turn, role AS type, md5(text) AS content_md5 FROM conversations")
def sse_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Turns encoded as events and decoded again, with malformed ones left out."""
    raw = table(spark, d, "conversations").select("conv_id", "turn", L.sse_encode(F.struct(F.col("role").alias("type"), F.col("text").alias("content"))).alias("raw"))
    bad = raw.select("conv_id", "turn", F.concat(F.lit("event: "), "raw").alias("raw"))
    return raw.union(bad).withColumn("e", L.sse_decode(F.col("raw"))).where("e IS NOT NULL").select("conv_id", "turn", "e.type", F.md5("e.content").alias("content_md5"))


_KIND = "CASE role WHEN 'assistant' THEN 'answer' WHEN 'user' THEN 'thinking' ELSE 'sections' END"


@query(f"WITH e AS (SELECT conv_id, turn, {_KIND} AS type, text FROM conversations), f AS (SELECT conv_id AS conversation_id, trim(string_agg(CASE WHEN type = 'answer' THEN text END, '' ORDER BY turn), ' ') AS answer, coalesce(string_agg(CASE WHEN type = 'thinking' THEN text END, chr(10) ORDER BY turn), '') AS thinking, arg_max(CASE WHEN type = 'sections' THEN text END, CASE WHEN type = 'sections' THEN turn END) AS sections FROM e GROUP BY conv_id) SELECT conversation_id, md5(answer) AS answer_md5, md5(thinking) AS thinking_md5, md5(sections) AS sections_md5 FROM f WHERE answer <> ''")
def event_fold(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "answer").when(F.col("role") == "user", "thinking").otherwise("sections")
    events = table(spark, d, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), kind.alias("type"), F.col("text").alias("content"))
    return L.fold_events(events).select("conversation_id", F.md5("answer").alias("answer_md5"), F.md5("thinking").alias("thinking_md5"), F.md5("sections").alias("sections_md5"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_new(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no label refers to, as files that no chunk came from."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"))
    chunks = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("source_path"))
    return files.not_indexed(docs, chunks).select("doc_id")


@query(f"WITH {fixtures.CTES} SELECT (SELECT count(*) FROM acts) AS document_count, (SELECT count(*) FROM sections) AS chunk_count")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    return ingest.summary(fixtures.acts(spark, d), fixtures.section_chunks(spark, d))


def _folder() -> str:
    """A folder of small files of every kind, for the file operators on a single machine."""
    root = os.path.join(tempfile.gettempdir(), f"lexweave-files-{os.getuid()}")
    os.makedirs(f"{root}/acts/sub", exist_ok=True)
    texts = {"acts/Trade-Act-1997.TXT": b"1. Title\nThis Act \xff applies.\n\n2. Scope\nAll trade.", "acts/sub/police-rules.md": b"Rule 1\nOn duty", "acts/sub/data.bin": b"\x00", "page.HTML": b"<p>raw</p>", "empty.txt": b" "}
    texts["acts/Trade-Act-1997.TXT.meta.json"] = json.dumps({"title": "Trade Act", "short_names": ["TA"], "document_group_id": "Trade"}).encode()
    texts["acts/sub/police-rules.meta.json"] = b"{not json"
    for name, body in texts.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(body)
    return root


#: The folder's files of allowed kinds: bytes, text as read (bytes that are not UTF-8 are dropped), metadata.
FILES = [("Trade-Act-1997.TXT", 49), ("page.HTML", 10), ("empty.txt", 1), ("police-rules.md", 14)]
READ = [("Trade-Act-1997.TXT", "1. Title\nThis Act  applies.\n\n2. Scope\nAll trade."), ("page.HTML", "<p>raw</p>"), ("empty.txt", " "), ("police-rules.md", "Rule 1\nOn duty")]
DESCRIBED = [
    ("Trade-Act-1997.TXT", "Trade Act", 1, "base_act", "trade", "Trade Act 1997|Trade Act|TA"),
    ("page.HTML", "Page", 1, "unknown", "page", "Page"),
    ("empty.txt", "Empty", 0, "unknown", "empty", "Empty"),
    ("police-rules.md", "Police Rules", 1, "base_act", "police", "Police Rules"),
]


@query(f"SELECT file, length::BIGINT AS length FROM {fixtures.values_sql(FILES, 'file, length')}")
def scan_discover(spark: SparkSession, d: str) -> DataFrame:
    """Files of allowed kinds in a small folder."""
    return files.discover(spark, [_folder()]).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")


@query(f"SELECT file, md5(s) AS text_md5 FROM {fixtures.values_sql(READ, 'file, s')}")
def text_load(spark: SparkSession, d: str) -> DataFrame:
    return files.read_texts(files.discover(spark, [_folder()])).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.md5(F.col("pages")[0]).alias("text_md5"))


@query(f"SELECT file_name, title, page_count::BIGINT AS page_count, document_type, document_group_id, aliases FROM {fixtures.values_sql(DESCRIBED, 'file_name, title, page_count, document_type, document_group_id, aliases')}")
def sidecar_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the folder with their sidecars' metadata."""
    root = _folder()
    pages = files.with_sidecars(files.read_texts(files.discover(spark, [root])), files.sidecars(spark, [root]))
    return files.assemble(pages).select("file_name", "title", F.col("page_count").cast("bigint").alias("page_count"), "document_type", "document_group_id", F.array_join("search_aliases", "|").alias("aliases"))


@query("SELECT step, n::BIGINT AS n FROM (VALUES ('missing', 0), ('created', (SELECT count(*) FROM documents)), ('upserted', (SELECT count(*) FROM documents) + 1), ('changed', (SELECT count(*) FROM documents WHERE doc_id % 5 = 0)), ('reset', (SELECT count(*) FROM documents WHERE doc_id % 2 = 0))) v(step, n)")
def store_changes(spark: SparkSession, d: str) -> DataFrame:
    """A chunk store before it exists, as created by its first upsert, after another and after a reset: how many chunks it has."""
    root = f"{tempfile.mkdtemp(prefix='lexweave-store-')}" if spark.sparkContext.master.startswith("local[") else f"{spark.conf.get('spark.checkpoint.dir')}/store-{uuid.uuid4().hex}"
    store = files.ChunkStore(spark, root, "docs")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "doc_id", "text")
    steps = [("missing", store.scan("chunk_id string").count())]
    store.upsert(docs)
    steps.append(("created", store.scan().count()))
    store.upsert(docs.where("doc_id % 5 = 0").withColumn("text", F.lit("new")).union(spark.createDataFrame([("extra", -1, "x")], "chunk_id string, doc_id bigint, text string")))
    steps += [("upserted", store.scan().count()), ("changed", store.scan().where("text = 'new'").count())]
    store.reset(docs.where("doc_id % 2 = 0"))
    steps.append(("reset", store.scan().count()))
    return spark.createDataFrame(steps, "step string, n bigint")


@query(f"WITH {_MSG} SELECT id, conversation_id, role, NULL::VARCHAR AS content, NULL::VARCHAR AS thinking, NULL::VARCHAR AS sections, NULL::INT AS rating, created_at FROM msg")
def message_migrate(spark: SparkSession, d: str) -> DataFrame:
    """Messages of an older table, which lacks four columns, in the present schema."""
    return L.migrated(_messages(spark, d).select("created_at", "id", "conversation_id", "role"))
