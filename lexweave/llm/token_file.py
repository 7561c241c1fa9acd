"""Token-id files: texts to ids, ids to coded segments, and back.

A token file is a Parquet table of segments, written and committed by Spark, so lost
executors and repeated tasks leave no half-written data. Rows: part (the writing
task, ascending with doc_id) and seq (within it) order the segments; doc_ids and
doc_tokens give the documents, in order, and how many ids each has; payload is a
segment of ``token_coder``. A segment holds whole documents and is decoded alone.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.llm import token_coder
from lexweave.llm.bpe import byte_chars, text_slices

END = 2
#: Bytes of text that are encoded together.
RUN = 4_000_000
#: Most segments whose start positions are broadcast; beyond, the join shuffles.
BROADCAST_SEGMENTS = 1_000_000


#: Bytes that surely begin something other than white space; of C2, E1, E2 and E3 some characters are white space.
_SOLID = np.array([b > 32 and b not in (0x7F, 0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_OTHER = np.array([b < 128 for b in range(256)]) & ~_LETTER
_PRINTED = np.array([32 < b < 127 for b in range(256)])
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: A space and letters, of blocks in which no letters are yet to be assigned: one piece.
_PIECE = re.compile("".join([" [A-Za-z", *(c for c in map(chr, range(0xAA, 0x250)) if c.isalpha()), "]+"])).fullmatch


class WordTable:
    """Numbers for words of at most 8 * columns bytes, none of them zero, by open addressing on their very bytes."""

    def __init__(self, columns: int):
        self.columns, self.n, self.bits = columns, 0, 16
        self.keys, self.slot = np.zeros((columns, 1 << 12), np.uint64), np.full(1 << 16, -1, np.int32)

    def home(self, keys: np.ndarray) -> np.ndarray:
        x = keys[0] * _MIX[0]
        for k in range(1, self.columns):
            x += keys[k] * _MIX[k]
        x ^= x >> np.uint64(32)
        x *= _MIX[0]
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def numbers(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, and the places in keys of words seen for the first time, in the order of their numbers."""
        if self.n + keys.shape[1] > self.keys.shape[1]:
            self.keys = np.concatenate([self.keys, np.zeros((self.columns, self.n // 2 + keys.shape[1]), np.uint64)], 1)
        while 2 * (self.n + keys.shape[1]) > len(self.slot):
            self.bits += 1
            self.slot = np.full(1 << self.bits, -1, np.int32)
            at, left = self.home(self.keys[:, : self.n]), np.arange(self.n, dtype=np.int32)
            while len(left):
                free = self.slot[at] < 0
                self.slot[at[free]] = left[free]
                lost = self.slot[at] != left
                at, left = at[lost] + 1 & len(self.slot) - 1, left[lost]
        out, new = np.empty(keys.shape[1], np.int32), []
        at, left, own = self.home(keys), np.arange(keys.shape[1]), keys
        while len(left):
            held = self.slot[at]
            free = held < 0
            if free.any():
                place, who = at[free], left[free].astype(np.int32)
                self.slot[place] = who  # of several words for one slot the last stays
                won = self.slot[place] == who
                place, who = place[won], who[won]
                self.slot[place] = np.arange(self.n, self.n + len(who), dtype=np.int32)
                self.keys[:, self.n : self.n + len(who)] = keys[:, who]
                self.n += len(who)
                new.append(who)
                held = self.slot[at]
            same = self.keys[0][held] == own[0]
            for k in range(1, self.columns):
                same &= self.keys[k][held] == own[k]
            out[left[same]] = held[same]
            left = left[~same]
            at, own = at[~same] + 1 & len(self.slot) - 1, keys[:, left]
        return out, np.concatenate(new) if new else np.zeros(0, np.int32)


class LibraryEncoder:
    """The tokenizers library behind a bounded cache of words.

    The library merges within the pieces that a byte-level pre-tokenizer cuts. Texts are cut only where a
    piece always begins: at a space that something other than white space follows, between an ASCII letter
    and an ASCII character that is none, and between a single line end and a letter. What stands before
    such a place has the same pieces there as at the end of a text. Each distinct word, with its space, is
    encoded once. Texts with a special token or a zero byte go through the library whole, as do all
    texts of a vocabulary of another kind. cache_size: words of a table whose ids are kept; when full,
    the cache starts anew, so memory is bounded.
    """

    def __init__(self, path: str, cache_size: int = 1_500_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tool = Tokenizer.from_file(path)
        self.tool.no_truncation()
        self.tool.no_padding()
        spec = json.loads(self.tool.to_str())
        cutter = spec["pre_tokenizer"] or {}
        self.cuts = not spec["normalizer"] and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
        self.special = [x.content for x in self.tool.get_added_tokens_decoder().values()]
        if self.cuts:  # the library's model without its cutting, for words that are one piece
            plain = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
            plain.pre_tokenizer = Split(" ", "removed")
            self.model = plain
            self.shown = {b: c for b, c in enumerate(byte_chars())} | {10: " "}
        vocab = self.tool.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids whose text starts with a space
        self.begins[[i for w, i in vocab.items() if w.startswith("\u0120")]] = True
        self.cache_size = cache_size
        self.forget()

    def forget(self) -> None:
        self.tables = [WordTable(2), WordTable(4)]
        self.runs = [np.zeros((2, 0), np.int64) for _ in self.tables]  # where the ids of each word begin in the pool, and how many they are
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        size = np.zeros(len(words), np.int64)
        where = np.fromiter((_PIECE(w.decode()) is not None for w in words), bool, len(words))
        plain = list(itertools.compress(words, where.tolist()))
        if plain:
            # one text for all: the first id of each word starts with a space, no other does
            ids = np.array(self.model.encode_batch_fast([b"\n".join(plain).decode("latin-1").translate(self.shown)], add_special_tokens=False)[0].ids, np.uint32)
            first = np.flatnonzero(self.begins[ids])
            if len(first) != len(plain):
                where[:] = False
        if not where.any():
            ids, first = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        size[where] = np.diff(np.append(first, len(ids)))
        other = self.library([w.decode() for w, is_plain in zip(words, where.tolist(), strict=True) if not is_plain])
        size[~where] = np.fromiter(map(len, other), np.int64, len(other))
        out, of = np.empty(int(size.sum()), np.uint32), np.repeat(where, size)
        out[of], out[~of] = ids, np.fromiter(itertools.chain.from_iterable(other), np.uint32, len(out) - len(ids))
        return out, size

    def keep(self, ids: np.ndarray) -> int:
        """Put ids behind the used part of the pool; the place where they begin."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used // 2 + len(ids), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        return self.used

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts (null: empty) one after the other, and how many each text has."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        _, offsets, data = texts.buffers()
        edge = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if data else np.zeros(0, np.uint8)
        edge, raw = edge - edge[0], np.concatenate([raw, np.zeros(32, np.uint8)])
        total, filled = int(edge[-1]), edge[1:] > edge[:-1]
        if not total:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        whole = ~filled if self.cuts else np.ones(len(texts), bool)
        if self.cuts:
            for s in [*self.special, "\0"]:
                whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        whole &= filled
        here, after = raw[:total], raw[1 : total + 1]
        begins = (here == 32) & _SOLID[after]
        begins[edge[1:][filled] - 1] = False  # what follows there is another text
        begins[1:] |= _LETTER[here[:-1]] & _OTHER[here[1:]]
        begins[2:] |= _PRINTED[here[:-2]] & (here[1:-1] == 10) & _LETTER[here[2:]]
        begins[edge[:-1][filled]] = True
        start = np.flatnonzero(begins)
        first = np.searchsorted(start, edge)
        length = np.diff(np.append(start, total))
        if any(t.n > self.cache_size for t in self.tables):
            self.forget()
        free = np.ones(len(start), bool)  # words that may come from the cache
        for i in np.flatnonzero(whole).tolist():
            free[first[i] : first[i + 1]] = False
        begin, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        eight = np.ndarray(total + 25, np.dtype("<u8"), raw, strides=(1,))
        low = 0
        for k, table in enumerate(self.tables):
            mine = np.flatnonzero(free & (length > low) & (length <= 8 * table.columns))
            low = 8 * table.columns
            if not len(mine):
                continue
            at, n = start[mine], length[mine]
            keys = np.empty((table.columns, len(mine)), np.uint64)
            for c in range(table.columns):
                keys[c] = eight[at + 8 * c] & _MASK[np.clip(n - 8 * c, 0, 8)]
            number, new = table.numbers(keys)
            if len(new):
                text = raw.tobytes()
                ids, sizes = self.words([text[a : a + m] for a, m in zip(at[new].tolist(), n[new].tolist(), strict=True)])
                here = self.keep(ids)
                self.used += len(ids)
                self.runs[k] = np.concatenate([self.runs[k], np.stack([here + np.cumsum(sizes) - sizes, sizes])], 1)
            begin[mine], size[mine] = self.runs[k][0][number], self.runs[k][1][number]
        # long words and whole texts go to the library as they are
        rest = np.flatnonzero(size == 0)
        of = np.searchsorted(first, rest, side="right") - 1
        keep = ~whole[of] | (rest == first[of])
        rest, of = rest[keep], of[keep]
        a, z = start[rest], np.where(whole[of], edge[of + 1], start[rest] + length[rest])
        own, which = np.unique(np.array([raw[i:j].tobytes() for i, j in zip(a.tolist(), z.tolist(), strict=True)], object), return_inverse=True)
        ids = self.library([w.decode() for w in own.tolist()])
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        here = self.keep(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(n.sum())))
        begin[rest], size[rest] = (here + np.cumsum(n) - n)[which], n[which]
        before = np.cumsum(size) - size
        flat = self.pool[np.repeat(begin - before, size) + np.arange(int(size.sum()))]
        return flat, np.diff(np.append(before, len(flat))[first])


@functools.cache
def library(path: str) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    return LibraryEncoder(path)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end: int = END, segment: int = 1 << 21) -> None:
    """Encode every whole text (null: empty), append the id end to each, and write the ids in ascending doc_id order.

    Equal doc_ids are ordered by their texts' hash, so rows that repeat an id are still dealt to
    several tasks; a null doc_id comes first. Texts are range-partitioned before encoding, so the
    partitioner's sampling pass does not encode. segment: ids after which a segment closes at the
    next document's end, which bounds memory.
    """
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, seq = library(vocabulary), TaskContext.get().partitionId(), 0
        names, sizes, held, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal names, sizes, held, size, seq
            payload = token_coder.encode(np.concatenate(held).astype(np.int64))
            row = {"part": [part], "seq": [seq], "n_tokens": [size], "doc_ids": [names], "doc_tokens": [sizes], "payload": [payload]}
            names, sizes, held, size, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row, schema=shape)

        for b in batches:
            shape = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(b.schema.field("doc_id").type)), ("doc_tokens", pa.list_(pa.int64())), ("payload", pa.binary())])
            for first, texts in text_slices(b.column("text"), RUN):
                flat, counts = tool.batch(texts)
                flat = np.insert(flat, np.cumsum(counts), end)
                at, counts = 0, counts + 1
                own, ends = b.column("doc_id").slice(first, len(texts)).to_pylist(), np.cumsum(counts)
                while at < len(own):  # up to the document that fills the segment
                    begun = int(ends[at - 1]) if at else 0
                    upto = min(len(own), int(np.searchsorted(ends, begun + segment - size)) + 1)
                    names += own[at:upto]
                    sizes += counts[at:upto].tolist()
                    held.append(flat[begun : int(ends[upto - 1])])
                    size += len(held[-1])
                    at = upto
                    if size >= segment:
                        yield flush()
        if names:
            yield flush()

    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    out = rows.mapInArrow(run, f"part int, seq int, n_tokens bigint, doc_ids array<{kind}>, doc_tokens array<bigint>, payload binary")
    out.write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Per document of a token file: doc_id, start (ids before it), n_tokens, ids_crc32 and, with ids=True, ids.

    Segments are decoded where they are read; only their sizes are summed across tasks, first by
    part, so the one ordered pass has a row for each writing task.
    """
    segments = spark.read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    sizes = segments.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    starts = sizes.select("part", "seq", inside.alias("inside")).join(before, "part").select("part", "seq", (F.col("part_start") + F.col("inside")).alias("segment_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                flat = token_coder.decode(row["payload"])
                raw, counts = flat.astype("<u4").tobytes(), np.array(row["doc_tokens"], np.int64)
                at = np.cumsum(counts) - counts
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), counts.tolist(), strict=True)]
                cols = [pa.array(row["doc_ids"], b.schema.field("doc_ids").type.value_type), pa.array(at + row["segment_start"]), pa.array(counts), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.array([flat[a : a + n] for a, n in zip(at.tolist(), counts.tolist(), strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids)

    if sizes.count() <= BROADCAST_SEGMENTS:  # 24 bytes each
        starts = F.broadcast(starts)
    joined = segments.drop("n_tokens").join(starts, ["part", "seq"])
    return joined.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if ids else ""))
