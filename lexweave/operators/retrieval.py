"""Inverted and vector indexes, the two search channels, and their fusion."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import tokens
from lexweave.session import reused

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Scores are rounded, so that equal texts tie whatever order their parts are added in.
PLACES = 9
RRF_K, DENSE_WEIGHT, BM25_WEIGHT = 60, 0.45, 0.55


@dataclass
class Index:
    """Tables of an index. Postings are best written bucketed by term; see ``write``."""

    postings: DataFrame  # term, chunk_id, tf
    terms: DataFrame  # term, df, idf
    sizes: DataFrame  # chunk_id, dl
    corpus: DataFrame  # n, avgdl: one row

    def write(self, name: str, buckets: int = 64) -> None:
        """Save as tables, postings and terms bucketed by term so that later joins on it do not shuffle."""
        for part in ("postings", "terms"):
            getattr(self, part).write.bucketBy(buckets, "term").sortBy("term").mode("overwrite").saveAsTable(f"{name}_{part}")
        for part in ("sizes", "corpus"):
            getattr(self, part).write.mode("overwrite").saveAsTable(f"{name}_{part}")


def build_index(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text", run_ons: bool = True) -> Index:
    """BM25 statistics of chunks.

    Texts are tokenized once: postings take one shuffle, combined before it, and are written; all
    statistics derive from them. A term in over half the chunks has a negative weight by the formula;
    it gets EPSILON times the mean weight instead.
    """
    words = chunks.select(F.col(chunk_id).alias("chunk_id"), F.explode(tokens(F.col(text), run_ons)).alias("term"))
    postings = reused(words.groupBy("term", "chunk_id").agg(F.count("*").alias("tf")))
    sizes = postings.groupBy("chunk_id").agg(F.sum("tf").alias("dl"))
    every = chunks.agg(F.count("*").alias("n"))
    corpus = every.crossJoin(F.broadcast(postings.agg(F.sum("tf").alias("all")))).select("n", (F.col("all") / F.col("n")).alias("avgdl"))  # one row
    raw = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus.select("n")))  # one row
    raw = raw.select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    return Index(postings, terms, sizes, corpus)


def bm25(asked: DataFrame, index: Index) -> DataFrame:
    """(query_id, chunk_id, score) over 0, for asked (query_id, term, n). Equi-joins on term, then on chunk."""
    hits = asked.join(index.terms, "term").join(index.postings, "term").join(index.sizes, "chunk_id").crossJoin(F.broadcast(index.corpus))
    tf, share = F.col("tf"), F.col("dl") / F.col("avgdl")
    part = F.col("n_asked") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * share))
    return hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), PLACES).alias("score")).where("score > 0")


def query_terms(queries: DataFrame, text: str = "query_text", run_ons: bool = True) -> DataFrame:
    """(query_id, term, n_asked)."""
    return queries.select("query_id", F.explode(tokens(F.col(text), run_ons)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n_asked"))


def top(df: DataFrame, k: int | Column, most: int, score: str = "score") -> DataFrame:
    """The k best rows of each query with their rank. most: a literal upper bound, which lets Spark cut before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return df.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= most) & (F.col("rank") <= k))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense(query_vectors: DataFrame, vectors: DataFrame, block_rows: int = 65_536) -> DataFrame:
    """(query_id, chunk_id, score): the dot product of every query vector with every vector of an index.

    Vectors are dealt by hash to blocks of about block_rows, at least one for each shuffle partition,
    and the queries go to every block: an equi-join of as many tasks as the index asks for.
    """
    spark = vectors.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // block_rows))
    q = query_vectors.select("query_id", F.col("embedding").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    v = vectors.select("chunk_id", F.col("embedding").alias("v"), F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int").alias("block"))
    return q.join(v, "block").select("query_id", "chunk_id", F.round(dot("q", "v"), PLACES).alias("score"))


def fuse(dense_hits: DataFrame, lexical_hits: DataFrame) -> DataFrame:
    """(query_id, chunk_id, dense_score, lexical_score, fused_score): weighted reciprocal ranks of ranked hits."""
    none = F.lit(None).cast("double")
    part = lambda df, w, d, x: df.select("query_id", "chunk_id", d.alias("d"), x.alias("x"), (w / (RRF_K + F.col("rank"))).alias("f"))
    both = part(dense_hits, DENSE_WEIGHT, F.col("score"), none).unionByName(part(lexical_hits, BM25_WEIGHT, none, F.col("score")))
    return both.groupBy("query_id", "chunk_id").agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("dense_score"), F.coalesce(F.max("x"), F.lit(0.0)).alias("lexical_score"), F.round(F.sum("f"), 12).alias("fused_score"))


def coverage(candidates: DataFrame, k: int = 10, floor: float = 0.45) -> DataFrame:
    """The k results of each query: the best of each document whose score is near the top, then the best others; by score.

    candidates: (query_id, document_id, chunk_id, fused_score).
    """
    own = Window.partitionBy("query_id", "document_id").orderBy(F.desc("fused_score"), "chunk_id")
    whole = Window.partitionBy("query_id")
    df = candidates.withColumns({"_nth": F.row_number().over(own), "_top": F.max("fused_score").over(whole)})
    kept = (F.col("_nth") == 1) & (F.col("fused_score") >= floor * F.col("_top"))
    df = df.withColumn("_r", F.row_number().over(whole.orderBy(kept.cast("int").desc(), F.desc("fused_score"), "chunk_id"))).where(F.col("_r") <= k)
    return df.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("fused_score"), "chunk_id"))).drop("_nth", "_top", "_r")


def embed_hashed(df: DataFrame, text: str, dims: int = 64, run_ons: bool = False) -> DataFrame:
    """df with embedding: signed hashed term counts of unit length. A stand-in where no model is there; stays in the JVM."""
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int")
    sign = lambda t: F.when(F.pmod(F.shiftrightunsigned(F.xxhash64(t), 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    hashed = F.transform(tokens(F.col(text), run_ons), lambda t: F.struct(slot(t).alias("s"), sign(t).alias("w")))
    zero = F.array_repeat(F.lit(0.0), dims)
    out = df.withColumn("_h", hashed).withColumn("_v", F.when(F.size("_h") > 0, F.expr(f"transform(sequence(0, {dims - 1}), d -> aggregate(_h, 0D, (a, x) -> a + if(x.s = d, x.w, 0D)))")).otherwise(zero))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    return out.withColumn("embedding", F.transform("_v", lambda x: (x / F.greatest(norm, F.lit(1e-12))).cast("float"))).drop("_h", "_v")


def embed_with(df: DataFrame, text: str, encode, batch: int = 16) -> DataFrame:
    """df with embedding from a model: encode(list of texts) -> array (n, dims), loaded once per worker.

    Batches that fail are halved down to single texts, as models may lack the memory for long ones.
    """

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        def some(part: list[str]) -> list[np.ndarray]:
            try:
                return list(np.asarray(encode(part), np.float32))
            except Exception:
                if len(part) == 1:
                    raise
                return some(part[: len(part) // 2]) + some(part[len(part) // 2 :])

        rows = texts.fillna("").tolist()
        return pd.Series([v for k in range(0, len(rows), batch) for v in some(rows[k : k + batch])])

    return df.withColumn("embedding", run(F.col(text)))
