"""The registered queries of this package and, where SQL can express one, its SQL."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import bpe, crf, decontaminate, line_dedup, projection_index, secret_scan, simhash, token_file, toxicity, url_filter
from lexweave.llm.shared import Scratch


def vocabulary() -> str:
    """Where the vocabulary lies, the same path on every executor: LEXWEAVE_VOCABULARY, or what the package of public tokenizers says."""
    return os.environ.get("LEXWEAVE_VOCABULARY") or str(importlib.import_module("public_tokenizers").path("byte_bpe_50k.json"))


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark).root}/tokens"
    token_file.write_tokens(_table(spark, sf_dir, "documents"), path, vocabulary())
    return token_file.read_tokens(spark, path)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(_table(spark, sf_dir, "documents"), Scratch(spark))
    return out.select("doc_id", "n_lines", "n_deleted", "depth", F.md5("text").alias("text_md5"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), Scratch(spark)).drop("distance")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, RULES, url_filter.link_edges(pages), Scratch(spark)).select("page_id", "host", "path", "rule", "verdict")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    learn = F.coalesce(crf.fold("doc_id", 3) != 1, F.lit(False))
    model = toxicity.fit(docs.where(learn), labels.where(learn), Scratch(spark))
    out = toxicity.score(docs, model)
    return out.select("doc_id", F.coalesce(crf.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("_held", F.coalesce(crf.fold("doc_id", 5) == 0, F.lit(False)))
    model = crf.fit(docs.where(~F.col("_held") & F.col("doc_id").isNotNull()))
    out = crf.identify(docs, model)
    return out.select("doc_id", F.coalesce(crf.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return projection_index.nearest(rows, rows.where("vec_id % 20 = 0"), Scratch(spark))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark)).select("doc_id", "fingerprint", "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents")).drop("all")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), vocabulary())


QUERIES = (op1_token_file, op2_line_dedup, op3_decontaminate, op4_url_filter, op5_toxicity, op6_language, op7_nearest, op8_simhash, op9_secret_scan, op10_bpe)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_HOST = r"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_RULES = ", ".join(f"('{a}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for a, r in RULES)


#: Windows of 1, 2, 4, ... lines: a window is a later copy if the same lines begin at a smaller (doc_id, line).
_DEPTHS = 16
_LINES = f"""
    WITH whole AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
    every AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM whole),
    l AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS o, md5(line) AS r0,
                 len(string_split_regex(trim(line), '\\s+')) AS words FROM every WHERE trim(line) <> ''),
    {", ".join(f"r{k + 1}s AS (SELECT *, md5(r{k} || lead(r{k}, {1 << k}) OVER (PARTITION BY doc_id ORDER BY o)) AS r{k + 1} FROM {'l' if k == 0 else f'r{k}s'})" for k in range(_DEPTHS))},
    hit AS ({" UNION ALL ".join(f"SELECT doc_id, o, words, {k} AS k FROM (SELECT doc_id, o, words, row_number() OVER (PARTITION BY r{k} ORDER BY doc_id, o) AS nth FROM r{_DEPTHS}s WHERE r{k} IS NOT NULL) WHERE nth > 1" for k in range(_DEPTHS))}),
    gone AS (SELECT doc_id, o FROM hit WHERE k = 0 AND words >= {line_dedup.MIN_WORDS} UNION SELECT doc_id, o FROM hit WHERE k = 1 UNION SELECT doc_id, o + 1 FROM hit WHERE k = 1),
    depth AS (SELECT doc_id, max(1 << k) AS depth FROM hit WHERE k > 0 OR words >= {line_dedup.MIN_WORDS} GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n_lines, count(g.o) AS n_deleted FROM l LEFT JOIN gone g USING (doc_id, o) GROUP BY doc_id),
    kept AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.i) AS text FROM every e LEFT JOIN l USING (doc_id, i) LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.o = l.o WHERE g.o IS NULL GROUP BY e.doc_id)
    SELECT w.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(depth, 0)::BIGINT AS depth,
           md5(CASE WHEN n_deleted > 0 AND n_deleted = n_lines THEN '' WHEN n_deleted > 0 THEN kept.text ELSE w.text END) AS text_md5
    FROM whole w LEFT JOIN n USING (doc_id) LEFT JOIN depth USING (doc_id) LEFT JOIN kept USING (doc_id)"""


_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_SHINGLES = "CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
#: Every place where a shingle of an item puts the item's start, and the item's weight in the window there; no fingerprints.
_LEAKS = f"""
    WITH it AS (SELECT item_id, len(w)::BIGINT AS n_words, {_SHINGLES} AS hs FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
    part AS (SELECT item_id, n_words, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS pos FROM it),
    wt AS (SELECT h, ln(1 + (SELECT count(DISTINCT item_id) FROM it) / count(DISTINCT item_id)) AS weight FROM part GROUP BY h),
    want AS (SELECT item_id, h, weight, count(*) AS m FROM part JOIN wt USING (h) GROUP BY ALL),
    total AS (SELECT item_id, sum(weight * m) AS total FROM want GROUP BY item_id),
    sh AS MATERIALIZED (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS p, len(hs) AS size FROM (SELECT doc_id, {_SHINGLES} AS hs FROM (SELECT doc_id, {_WORDS} AS w FROM documents))),
    place AS (SELECT DISTINCT doc_id, item_id, n_words, greatest(p - pos, 0) AS start, least(greatest(p - pos, 0), size - 1) AS first FROM sh JOIN part USING (h)),
    held AS (SELECT doc_id, item_id, n_words, start, h, count(*) AS c FROM place JOIN sh USING (doc_id) WHERE p >= first AND p < first + greatest(n_words - 4, 1) GROUP BY ALL),
    scored AS (SELECT doc_id, item_id, n_words, start, round(sum(weight * least(c, m)) / any_value(total), 6) AS similarity FROM held JOIN want USING (item_id, h) JOIN total USING (item_id) GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS k FROM scored WHERE similarity >= {decontaminate.SIMILARITY})
    SELECT doc_id, item_id, start::BIGINT AS start, n_words, similarity FROM best WHERE k = 1"""


def _found(kind: str, pattern: str, keep: str) -> str:
    """Spans of a kind: starts are the lengths of the pieces and matches before; keep is a test of the match h."""
    p = "'" + pattern.replace("'", "''") + "'"
    rank = secret_scan.KINDS.index(kind)
    start = "coalesce(list_sum(list_transform(gaps[1:i + 1], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i], lambda g: length(g))), 0)"
    return f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, ({start})::BIGINT AS s, ({start})::BIGINT + length(h) AS e FROM (SELECT doc_id, hits, gaps, i, hits[i + 1] AS h FROM
        (SELECT doc_id, hits, gaps, unnest(range(len(hits))) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS hits, string_split_regex(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p})))) WHERE {keep}"""


_ASSIGN, _ACCESS, _HEX = (b[1] for b in secret_scan.BASE)
_LONG = "regexp_full_match(h, '[A-Za-z0-9+/]{32,}={0,2}') AND regexp_matches(h, '[0-9]') AND regexp_matches(h, '[A-Za-z]')"
_LIST = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank, e), '')"
_SECRETS = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({_found('assign', _ASSIGN, f"length(regexp_extract(h, '{_ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 6")} UNION ALL {_found('access', _ACCESS, 'length(h) >= 20')} UNION ALL {_found('hex', _HEX, 'true')}),
    weak AS ({_found('endpoint', secret_scan.WEAK[0][1], 'length(h) >= 10')} UNION ALL {_found('secret', '[A-Za-z0-9+/=_-]+', _LONG)}),
    facts AS (SELECT w.doc_id, w.kind, w.rank, w.s, w.e, bool_or(b.kind = 'access') AS access, bool_or(b.kind <> 'access') AS other, bool_or(w.s < b.e AND b.s < w.e) AS over
              FROM weak w JOIN base b ON w.doc_id = b.doc_id AND abs(w.s - b.s) <= {secret_scan.SCOPE} GROUP BY ALL),
    sec AS (SELECT doc_id, kind, rank, s, e FROM facts WHERE kind = 'secret' AND access AND NOT over),
    ends AS (SELECT doc_id, kind, rank, s, e FROM facts f WHERE kind = 'endpoint' AND access AND (other OR EXISTS (SELECT 1 FROM sec WHERE sec.doc_id = f.doc_id AND abs(sec.s - f.s) <= {secret_scan.SCOPE}))),
    b1 AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {_LIST} AS spans FROM base GROUP BY doc_id),
    a1 AS (SELECT doc_id, {_LIST} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM sec UNION ALL SELECT * FROM ends) GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b1.spans, '')) AS base_sha256, coalesce(a1.spans, '') AS spans
    FROM d LEFT JOIN b1 USING (doc_id) LEFT JOIN a1 USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": _LINES,
        "op3_decontaminate": _LEAKS,
        "op9_secret_scan": _SECRETS,
        # no page of the tables has a canonical link or a refresh, so the classes are single urls
        "op4_url_filter": f"""
            WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages), r(act, rule, h, x) AS (VALUES {_RULES}),
            f AS (SELECT p.*, r.act, r.rule, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC NULLS LAST) AS k
                  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.x))
            SELECT page_id, host, path, rule, coalesce(act, 'allow') AS verdict FROM f WHERE k = 1""",
    }
