"""Ingest: files to documents, chunks and the store. Runs under spark-submit as a script too."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import chunking
from lexweave.sources import files as S


def chunks_of(documents: DataFrame, run_ons: bool = True) -> DataFrame:
    """Chunks with the metadata of their documents."""
    meta = documents.select("document_id", "source_path", "page_count", "file_name", "display_title", "document_type", "document_group_id", "search_aliases", "amends_group_id")
    return chunking.chunk(documents, run_ons).join(meta, "document_id")


def summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row (document_count, chunk_count)."""
    return documents.agg(F.count("*").alias("document_count")).crossJoin(chunks.agg(F.count("*").alias("chunk_count")))


def run(spark: SparkSession, roots: list[str], store: S.ChunkStore, allowed: list[str] = S.EXTENSIONS, fallback: list[str] | None = None, force: bool = False) -> DataFrame:
    """Index new files (all of them with force) and return the summary of what was processed."""
    found = S.discover(spark, roots, allowed, fallback)
    if not force:
        have = store.scan("chunk_id string, source_path string")
        found = S.not_indexed(found, have)
    pages = S.with_sidecars(S.read_texts(found), S.sidecars(spark, roots))
    docs = S.assemble(pages)
    chunks = chunks_of(docs)
    if force:
        store.reset(chunks)
    elif not docs.isEmpty():
        store.upsert(chunks)
    return summary(docs, chunks)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Index files into a chunk store.")
    p.add_argument("--data-dir", action="append", help="folder of source files; may repeat (default: data)")
    p.add_argument("--fallback-dir", action="append", help="read if the data folders hold no file (default: .)")
    p.add_argument("--store", default="store", help="folder of the chunk store")
    p.add_argument("--model", default="hashed-64", help="names the collection")
    p.add_argument("--embed-batch-size", type=int, default=16, help="texts that a model embeds together")
    p.add_argument("--extensions", default="", help="comma-separated; default: all that can be read")
    p.add_argument("--force-reindex", "--force", dest="force", action="store_true", help="all files, not only those without a chunk")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(max(1, a.embed_batch_size) * 64))
    store = S.ChunkStore(spark, a.store, S.collection_name(a.model))
    allowed = S.extensions(a.extensions) if a.extensions.strip() else S.EXTENSIONS
    out = run(spark, a.data_dir or ["data"], store, allowed, a.fallback_dir or ["."], a.force).first()
    print(f"{'Force re-indexed' if a.force else 'Indexed'} {out['document_count']} documents into {out['chunk_count']} chunks.")


if __name__ == "__main__":
    main()
