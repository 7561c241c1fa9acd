"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 16 segments of four bits.
The Manhattan distance of two embeddings is a lower bound of the fingerprints' Hamming
distance, so a grid join over the embeddings loses no pair: each distinct fingerprint
enters its own cell and the cells at Manhattan distance one, and two fingerprints
within two bits meet in the cell half way. Only fingerprints that share a cell go on.

They are verified exactly. In a cell of two, the two are compared. Fuller cells are
verified without listing pairs: two fingerprints differ in two or fewer bits if and only if some 64-bit value is within one bit of both. So each
candidate names the 65 values within one bit of itself, and all that name a value are
linked to the least of them: no value is named by more than 65. A group of n near copies
costs 65 n rows, not n squared, and every link between different fingerprints lies in the components that follow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.bpe import chunks
from lexweave.llm.shared import Scratch, components

SEED, BITS = 42, 2


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each shingle: A-Z lower-cased, words cut at ASCII white space; fewer words than size make one shingle."""
    import xxhash

    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    parts = zip(*(w[k:] for k in range(size)), strict=False) if len(w) >= size else [w]
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, parts), repeat(SEED)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is set if it is set in over half the hashes, repeats included; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # whole texts of any length in bounded memory
        part = np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += part.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp bigint): a narrow map. A null text is an empty one, fingerprint zero."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(shingle_hashes(t, size)) for _, texts in chunks(b, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def embedding(fp: str) -> str:
    """SQL for the 16 bit counts (0 to 4), packed into the nibbles of a bigint."""
    ones = "1229782938247303441L"  # the lowest bit of each nibble
    return "(" + " + ".join(f"(shiftrightunsigned({fp}, {k}) & {ones})" for k in range(4)) + ")"


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links within two bits."""
    # a row makes tens of them below: dealt before that, and not put together again
    dealt = lambda df: df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    own = dealt(fps.select("fp").distinct()).withColumn("e", F.expr(embedding("fp")))
    near = ["e"]
    for s in range(0, 64, 4):
        count, unit = f"(shiftrightunsigned(e, {s}) & 15)", f"shiftleft(1L, {s})"
        near += [f"if({count} < 4, e + {unit}, null)", f"if({count} > 0, e - {unit}, null)"]
    entries = own.select("fp", F.explode(F.expr(f"array({', '.join(near)})")).alias("cell")).where("cell IS NOT NULL")
    cells = entries.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    pairs = cells.where(f"n = 2 AND bit_count(a ^ b) <= {BITS}").select("a", "b")
    candidates = entries.join(cells.where("n > 2").select("cell"), "cell").select("fp").distinct()
    flips = ", ".join(["fp", *(f"fp ^ shiftleft(1L, {k})" for k in range(64))])
    named = dealt(candidates).select("fp", F.explode(F.expr(f"array({flips})")).alias("value"))
    met = named.groupBy("value").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps")).where("size(fps) > 1")  # 65 at most
    return met.select(F.explode("fps").alias("a"), "b").where("a <> b").union(pairs).distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, size: int = 3, doc_id: str = "doc_id", text: str = "text", label: str = "simhash") -> DataFrame:
    """One row per row of docs: doc_id, fp, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    Exact copies share a fingerprint and are joined by it, as are all texts without a word. Null
    texts count as empty; a null doc_id gets its component's smallest other id, if any. Repeated
    rows each give a row. Only narrow rows are shuffled: never a text.
    """
    own = scratch.store(fingerprints(docs, size, doc_id, text), f"{label}-fp")
    return grouped(own, scratch.store(links(own), f"{label}-links"), scratch, label)


def grouped(own: DataFrame, edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """The result of near_duplicates from fingerprints of rows (doc_id, fp) and stored edges between fingerprints."""
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    cc = scratch.store(components(edges, scratch, label), f"{label}-cc")
    joined = first.join(cc.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = scratch.store(joined, f"{label}-classes")
    least = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = joined.join(least, "component").select("fp", "component_id")
    out = own.join(classes, "fp")
    return out.select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


BANDS = 16
#: Documents of the sample that orders shingles, and how many shingles it names; by how much the compared texts of a bucket grow a round.
SAMPLE, COMMON, GROWTH = 20_000, 100_000, 16
#: Bits that bound the difference of two sets of shingles; smallest keys of a text by which a pair is made once.
ODD, LEAST = 1024, 32


def band_keys(hashes: np.ndarray) -> list[int]:
    """Keys that two sets of shingles of similarity 0.8 or more very likely share; ``keep_first`` uses ``prefix_of``, which loses none.

    The hash range is dealt into 2^k parts so that a part holds four to eight shingles, and again into
    twice as many; the first BANDS parts of both give a key each, of all shingles in it. Sizes of similar
    sets differ by a fifth at most, so they have one of the two levels in common, where a part is
    untouched by the differing shingles with a chance of 0.3 or more.
    """
    own = np.unique(hashes)
    if not len(own):
        return []
    level, out = max(0, int(np.log2(len(own) / 4)) if len(own) > 4 else 0), []
    mixed = own * np.uint64(0x9E3779B97F4A7C15)
    for k in (level, level + 1):
        part = mixed >> np.uint64(64 - k) if k else np.zeros(len(own), np.uint64)
        for j in range(min(BANDS, 1 << k)):
            if len(held := own[part == j]):
                x = (int(np.bitwise_xor.reduce(held * np.uint64(0xC2B2AE3D27D4EB4F))) ^ int(held.sum()) * 31 ^ k << 56 ^ j << 48) & (1 << 64) - 1
                out.append(x - (1 << 64) if x >> 63 else x)
    return out


def prefix_of(hashes: np.ndarray, known: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The prefix of a set of shingles (distinct hashes): two sets of at least this Jaccard similarity have a shingle of both prefixes in common.

    Holds for any one order of all shingles. This one puts those of the sample (known, sorted; often, their counts) last.
    """
    at = np.searchsorted(known, hashes)
    found = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == hashes) if len(known) else np.zeros(len(hashes), bool)
    count = np.zeros(len(hashes), np.int64)
    count[found] = often[at[found]]
    order = np.lexsort((hashes * np.uint64(0x9E3779B97F4A7C15), count))
    return hashes[order[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1]]


def common_shingles(docs: DataFrame, size: int, doc_id: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of shingles that several documents of a bounded sample have. They only order the work."""
    n = docs.count()
    edge = min(2**63 - 1, int(SAMPLE / max(n, 1) * 2**64) - 2**63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in chunks(b, "text"):
                for t in texts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, size)).view(np.int64))], names=["h"])

    some = docs.where(F.xxhash64(doc_id) <= edge).select(docs[text].alias("text")).mapInArrow(run, "h bigint")
    rows = some.groupBy("h").agg(F.count("*").alias("c")).where("c > 2").orderBy(F.desc("c"), "h").limit(COMMON).toPandas().sort_values("h")
    known = rows.h.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], rows.c.to_numpy(np.int64)[order]


def sketches(docs: DataFrame, size: int, similarity: float, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, fp, sid, m, odd, prefix): hashes of the text and of the set of shingles, the set's size, odd bits and prefix. A narrow map."""
    kind = dict(docs.dtypes)[doc_id]
    known, often = common_shingles(docs, size, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sids, sizes, odds, prefixes = [], [], [], [], []
            for _, texts in chunks(b, "text"):
                for t in texts:
                    h = shingle_hashes(t, size)
                    own = np.unique(h)
                    fps.append(fingerprint(h))
                    sids.append(set_hash(own))
                    sizes.append(len(own))
                    odds.append(odd_bits(own))
                    prefixes.append(prefix_of(own, known, often, similarity).view(np.int64))
            u64 = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), u64(fps), u64(sids), pa.array(sizes, pa.int32()), pa.array(odds, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "key", "fp", "sid", "m", "odd", "prefix"])

    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, key bigint, fp bigint, sid bigint, m int, odd array<bigint>, prefix array<bigint>")


def odd_bits(own: np.ndarray) -> np.ndarray:
    """ODD bits, as 64-bit words: whether an odd number of a set's hashes falls on each.

    A hash that only one of two sets has flips one bit, so the bits that differ are a lower bound of
    the hashes that differ.
    """
    bits = np.bincount((own * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - ODD.bit_length() + 1)).astype(np.int64), minlength=ODD) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def set_hash(own: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def similar_links(docs: DataFrame, own: DataFrame, edges: DataFrame, scratch: Scratch, size: int, similarity: float, doc_id: str, text: str) -> DataFrame:
    """Stored edges (a, b) between fingerprints whose components, with those of edges, are those of all pairs of texts of at least this Jaccard similarity.

    own: stored sketches. Texts that name a shingle in their prefixes share its bucket, so every similar
    pair meets. In the first round each bucket's most central text, whose prefix lies in the fullest
    buckets, is compared with the others. In each later round the buckets that are not one component yet
    compare GROWTH times as many of their texts with all texts of other components, until a bucket is
    one component or all its texts were compared. A group of copies of one text costs about a pair for
    each copy; only pairs that others join already are left out. Later rounds make no pair whose odd
    bits differ in more hashes than the similarity allows, and each pair about once, however many buckets
    it shares, so texts that share passages but are not similar meet without leaving rows. Pairs that the prefixes do not rule out are verified on the
    whole sets; texts are read again for these only.
    """
    known = own.where("m > 0")
    same = known.select("sid", "fp").distinct()
    one = known.groupBy("sid").agg(F.min(F.struct("doc_id", "key")).alias("r"), F.min("fp").alias("fp"), F.max("m").alias("m"), F.first("odd").alias("odd"), F.first("prefix").alias("prefix"))
    one = scratch.store(one.select("sid", F.col("r.doc_id").alias("doc_id"), F.col("r.key").alias("key"), "fp", "m", "odd", "prefix"), "prefix-sets")
    named = one.select("sid", F.explode("prefix").alias("key"))
    buckets = named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    entries = scratch.store(named.join(buckets, "key"), "prefix-entries")
    held = entries.groupBy("sid").agg(F.sum("n").alias("w"), F.slice(F.array_sort(F.collect_list("key")), 1, LEAST).alias("low"))
    nodes = scratch.store(one.select("sid", "fp", "m", "odd").join(held, "sid"), "prefix-nodes")
    members = scratch.store(entries.join(nodes.select("sid", "fp", "m", "w"), "sid"), "prefix-members")
    scratch.drop(entries)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.unique(shingle_hashes(t, size)) for _, texts in chunks(b, "text") for t in texts]
            is_own = pa.array(np.array([set_hash(h) for h in rows], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("sid"), is_own, pa.array([h.view(np.int64) for h in rows], pa.list_(pa.int64()))], names=["sid", "is", "hs"])

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        # a shingle of both sets is in both prefixes or past the end of one, so few shared ones in the prefixes rule a pair out
        side = lambda c: one.select(F.col("sid").alias(c), F.col("m").alias(f"m{c}"), F.col("prefix").alias(f"p{c}"))
        most = F.size(F.array_intersect("px", "py")) + F.greatest(F.col("mx") - F.size("px"), F.col("my") - F.size("py"))
        maybe = pairs.join(side("x"), "x").join(side("y"), "y").where(most >= similarity / (1 + similarity) * (F.col("mx") + F.col("my")) - 1e-6)
        maybe = scratch.store(maybe.select("x", "y", "a", "b"), f"{label}-maybe")
        ids = maybe.select(F.col("x").alias("sid")).union(maybe.select("y")).distinct()
        wanted = scratch.store(one.select("sid", F.col("doc_id").alias("d"), F.col("key").alias("k")).join(ids, "sid"), f"{label}-wanted")
        rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("key"), docs[text].alias("text"))
        texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))).select("sid", "text")
        held = scratch.store(texts.mapInArrow(sets, "sid bigint, is bigint, hs array<bigint>").where("sid = is").select("sid", "hs").dropDuplicates(["sid"]), f"{label}-sets")
        both = maybe.join(held.select(F.col("sid").alias("x"), F.col("hs").alias("hx")), "x").join(held.select(F.col("sid").alias("y"), F.col("hs").alias("hy")), "y")
        shared = F.size(F.array_intersect("hx", "hy"))
        out = scratch.store(both.where(shared >= similarity * (F.size("hx") + F.size("hy") - shared) - 1e-9).select("a", "b").distinct(), label)
        scratch.drop(maybe, wanted, held)
        return out

    def pairs_of(left: DataFrame, pivots: DataFrame, by: str) -> DataFrame:
        """(x, y, a, b): sets and fingerprints of the two, each pair once; sizes alone rule out some."""
        right = pivots.select("key", F.col("sid").alias("sid2"), F.col("fp").alias("fp2"), F.col("m").alias("m2"), F.col(by).alias("by2"))
        may = (F.col(by) != F.col("by2")) & (F.least("m", "m2") >= similarity * F.greatest("m", "m2") - 1e-6)
        if "odd" in left.columns:
            right = right.join(nodes.select(F.col("sid").alias("sid2"), F.col("odd").alias("odd2"), F.col("low").alias("low2")), "sid2")
            differ = F.expr(" + ".join(f"bit_count(odd[{k}] ^ odd2[{k}])" for k in range(ODD // 64)))
            may &= differ <= (1 - similarity) / (1 + similarity) * (F.col("m") + F.col("m2")) + 1e-6
            # not where the two are known to meet under a smaller key: they always meet under the smallest
            may &= F.coalesce(F.array_min(F.array_intersect("low", "low2")) >= F.col("key"), F.lit(True))
        met = left.join(right, "key").where(may)
        turned = F.col("sid") < F.col("sid2")
        pick = lambda p, q, name: F.when(turned, F.col(p)).otherwise(F.col(q)).alias(name)
        return met.select(pick("sid", "sid2", "x"), pick("sid2", "sid", "y"), pick("fp", "fp2", "a"), pick("fp2", "fp", "b")).distinct()

    least = same.groupBy("sid").agg(F.min("fp").alias("b"))
    edges = edges.union(same.join(least, "sid").where("fp <> b").select(F.col("fp").alias("a"), "b"))
    central = members.groupBy("key").agg(F.max(F.struct("w", "sid", "fp", "m")).alias("p")).select("key", "p.*")
    tested = scratch.store(pairs_of(members, central, "fp"), "prefix-pairs-0")
    edges = scratch.store(edges.union(verified(tested, "prefix-found-0")).distinct(), "prefix-links-0")
    most = members.agg(F.max("n")).first()[0] or 0
    tries, k = 1, 0
    while tries < most and most > 2:
        k += 1
        before, tries = tries, tries * GROWTH
        cc = scratch.store(components(edges, scratch, f"prefix-{k}"), f"prefix-cc-{k}")
        open_ = members.where(f"n > {max(2, before)}").join(cc.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        split = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        live = scratch.store(open_.join(split, "key"), f"prefix-live-{k}")
        if live.isEmpty():
            break
        pivots = live.where(F.pmod(F.xxhash64("sid"), F.lit(1 << 30)) / float(1 << 30) * F.col("n") < tries) if tries < most else live
        fresh = pairs_of(live.join(nodes.select("sid", "odd", "low"), "sid"), pivots, "component").join(tested.select("x", "y"), ["x", "y"], "left_anti")
        fresh = scratch.store(fresh, f"prefix-pairs-{k}")
        tested = tested.union(fresh)
        edges = scratch.store(edges.union(verified(fresh, f"prefix-found-{k}")).distinct(), f"prefix-links-{k}")
        scratch.drop(cc, live)
    return edges


def keep_first(docs: DataFrame, scratch: Scratch, size: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are the first of their group, with the columns of docs.

    Groups are the components over links of both kinds: fingerprints within two bits, and shingle sets
    of at least this similarity, which 64 bits within a radius of two can't tell. The first is the one
    of the smallest doc_id (a null one before all), then of the smallest text hash: a row is told by
    both, so rows that repeat a doc_id with another text are documents of their own. Of rows that
    repeat both one stays. Texts without a word are one group.
    """
    own = scratch.store(sketches(docs, size, similarity, doc_id, text), "keep-fp")
    near = scratch.store(links(own), "keep-links")
    edges = similar_links(docs, own, near, scratch, size, similarity, doc_id, text)
    cc = scratch.store(components(edges, scratch, "keep"), "keep-cc")
    row = F.struct("doc_id", "key")
    classes = own.groupBy("fp").agg(F.min(row).alias("first")).join(cc.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    classes = scratch.store(classes, "keep-classes")
    least = classes.groupBy("component").agg(F.min("first").alias("least"))
    gone = own.join(classes.join(least, "component").select("fp", "least"), "fp").where(~row.eqNullSafe(F.col("least")))
    gone = scratch.store(gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "keep-gone")
    kept = docs.join(gone, docs[doc_id].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text]) == F.col("_key")), "left_anti").select(docs.columns)
    if own.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        return kept
    return kept.withColumn("_key", F.xxhash64(text)).dropDuplicates([doc_id, "_key"]).select(docs.columns)
