"""Benchmark decontamination by SimHash of item-sized windows.

A window is as many words of a document as a benchmark item has. Windows that share
no five-word shingle with the item have similarity zero, so windows are laid where a
shared shingle puts the item's start, at every such place of every whole text. Every
window is verified by exact weighted-shingle similarity: the share of the item's shingle
weight, repeats included, that the window holds, where a shingle weighs
ln(1 + items / items with it). Fingerprints decide nothing: no radius bounds that
similarity. The distance of the 64-bit SimHashes of window and item is given beside it.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.shared import Scratch

SIZE, SIMILARITY = 5, 0.8
#: Most rows of the benchmark's shingles that are broadcast: about 50 MB. Beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def words_of(text: str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def shingles(words: str, size: int = SIZE) -> Column:
    """Hashes of the shingles of an array of words; fewer words than size make one."""
    hashed = ", ".join(f"{words}[i + {k}]" for k in range(size))
    return F.expr(f"if(size({words}) >= {size}, transform(sequence(0, size({words}) - {size}), i -> xxhash64({hashed})), if(size({words}) > 0, array(xxhash64(array_join({words}, ' '))), cast(array() as array<bigint>)))")


def simhash(hashes: str) -> Column:
    """A bit is set if it is set in over half the hashes."""
    bits = [f"if(2 * size(filter({hashes}, h -> (shiftrightunsigned(h, {k}) & 1) = 1)) > size({hashes}), shiftleft(1L, {k}), 0L)" for k in range(64)]
    return F.expr("(" + " | ".join(bits) + ")")


def blocks(fp: str, radius: int) -> Column:
    """The bits of each of radius + 1 blocks, as array<struct<block, bits>>."""
    n, at, out = radius + 1, 0, []
    for k in range(n):
        width = 64 // n + (k < 64 % n)
        out.append(f"named_struct('block', {k}, 'bits', shiftrightunsigned({fp}, {at}) & {(1 << width) - 1}L)")
        at += width
    return F.expr(f"array({', '.join(out)})")


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): for each document and item, its most similar window of at least that similarity.

    start counts words. Null, empty and wordless texts and items match nothing. Items repeated word
    for word are items of their own; rows of docs that repeat doc_id and text are one. Ties go to the
    first window. Places are combined before they are shuffled by (document, item, start), of which no
    key is hot however common a passage is; texts are read again only for documents with a place.
    """
    scored = _scored(docs, benchmark, scratch, similarity, size, doc_id, text, item_id, item)
    best = F.max_by(F.struct("start", "n_words", "distance", "similarity"), F.struct("similarity", -F.col("start")))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.start").cast("bigint").alias("start"), F.col("b.n_words").cast("bigint").alias("n_words"), F.col("b.distance").cast("bigint").alias("distance"), "b.similarity")


def _scored(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, similarity: float, size: int, doc_id: str, text: str, item_id: str, item: str) -> DataFrame:
    """The windows of at least that similarity; key is the hash of the document's text."""
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("key"), docs[text].alias("t"))
    own = benchmark.select(benchmark[item_id].alias("item_id"), benchmark[item].alias("t")).withColumn("w", words_of("t")).where("size(w) > 0")
    own = own.select("item_id", F.size("w").alias("n_words"), shingles("w", size).alias("hs")).distinct()
    own = scratch.store(own.withColumn("fp", simhash("hs")), "items")
    parts = own.select("item_id", "n_words", F.posexplode("hs").alias("at", "h"))
    spread = own.select("item_id", F.explode(F.array_distinct("hs")).alias("h")).groupBy("h").agg(F.countDistinct("item_id").alias("m"))
    weights = own.select(F.countDistinct("item_id").alias("all")).crossJoin(spread).select("h", F.log1p(F.col("all") / F.col("m")).alias("weight"))
    parts = scratch.store(parts.join(weights, "h"), "item-shingles")
    n_parts = parts.count()
    small = (lambda df: F.broadcast(df)) if n_parts <= BROADCAST_ROWS else (lambda df: df)
    hashed = rows.withColumn("w", words_of("t")).select("doc_id", "key", F.posexplode(shingles("w", size)).alias("p", "h"))
    places = hashed.join(small(parts.select("item_id", "n_words", "at", "h")), "h").select("doc_id", "key", "item_id", "n_words", F.greatest(F.col("p") - F.col("at"), F.lit(0)).alias("start"))
    places = scratch.store(places.groupBy("doc_id", "key", "item_id", "n_words", "start").agg(F.count("*").alias("shared")), "places")
    some = places.select("doc_id", "key").distinct()
    again = rows.join(some.select(F.col("doc_id").alias("d"), F.col("key").alias("k")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi").dropDuplicates(["doc_id", "key"])
    again = again.withColumn("w", words_of("t")).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), shingles("w", size).alias("all"))
    cut = F.when(F.size("all") == 0, F.col("all")).otherwise(F.slice("all", F.least(F.col("start"), F.size("all") - 1) + 1, F.greatest(F.col("n_words") - size + 1, F.lit(1))))
    windows = places.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("doc_id", "key", "item_id", "start", "n_words", cut.alias("hs"))
    windows = scratch.store(windows.withColumn("fp", simhash("hs")), "windows")
    item_fps = own.groupBy("item_id", "n_words").agg(F.min("fp").alias("item_fp"))
    near = windows.join(small(item_fps), ["item_id", "n_words"]).withColumn("distance", F.expr("bit_count(fp ^ item_fp)"))
    want = parts.groupBy("item_id", "h", "weight").agg(F.count("*").alias("m"))
    by = ["doc_id", "key", "item_id", "start", "n_words", "distance"]
    held = near.select(*by, F.explode("hs").alias("h")).join(small(want), ["item_id", "h"]).groupBy(*by, "h", "weight", "m").agg(F.count("*").alias("c"))
    total = want.groupBy("item_id").agg(F.sum(F.col("weight") * F.col("m")).alias("total"))
    scored = held.groupBy(*by).agg(F.sum(F.col("weight") * F.least("c", "m")).alias("got"))
    return scored.join(small(total), "item_id").withColumn("similarity", F.round(F.col("got") / F.col("total"), 6)).where(F.col("similarity") >= similarity)


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, similarity: float = SIMILARITY, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item: str = "text") -> DataFrame:
    """The rows of docs that hold no benchmark item; a row goes by its own text, with or without a doc_id."""
    found = _scored(docs, benchmark, scratch, similarity, size, doc_id, text, item_id, item).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    found = scratch.store(found, "leaks")
    return docs.join(found, docs[doc_id].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text]) == F.col("_key")), "left_anti").select(docs.columns)
