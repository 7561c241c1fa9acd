"""BPE encoding and decoding with contiguous rank arrays.

A word is its bytes. Short words hold, side by side, the ids between their part
boundaries and the ranks of adjacent parts; the least rank is found by scanning,
its boundary deleted, and the two neighbouring ranks refreshed, until no adjacent
pair can merge. All words of one length in a batch go through this together, as
rows of one matrix: each step takes one boundary from every row that still merges,
so the rows stay contiguous and equally long. Words longer than ``LONG`` bytes use
a heap over linked parts, as scanning them would take quadratic time.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lexweave.llm.words import pieces

LONG = 96
NONE = np.iinfo(np.int64).max


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable, else the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in own else chr(256 + n))
        n += b not in own
    return out


class Bpe:
    """A byte-level BPE vocabulary file of the tokenizers library (no normalizer, no prefix space).

    cache_size: words whose ids are kept; when full, the cache starts anew, so memory is bounded.
    """

    def __init__(self, path: str, cache_size: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["model"]["type"] != "BPE" or spec["model"].get("ignore_merges"):
            raise ValueError("only plain byte-level BPE is supported")
        vocab, chars = spec["model"]["vocab"], byte_chars()
        of_char = {c: b for b, c in enumerate(chars)}
        self.piece = {i: bytes(of_char[c] for c in s) for s, i in vocab.items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.piece |= {i: s.encode() for s, i in self.special.items()}
        self.width = max(self.piece) + 1
        self.byte_id = np.array([vocab[c] for c in chars], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made_by_rank = np.append(keys[order], NONE), np.append(order, NONE), made
        self.pair = {int(k): r for r, k in enumerate(keys)}
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def short(self, words: list[bytes], n: int) -> list[bytes]:
        """Ids of words of n bytes each, packed as little-endian unsigned 32-bit integers."""
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)]
        out: list[bytes] = [b""] * len(words)
        row = np.arange(len(words))
        ranks = self.rank_of(ids[:, :-1], ids[:, 1:])

        def finish(done: np.ndarray) -> None:
            raw, step = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
            for k, r in enumerate(row[done].tolist()):
                out[r] = raw[k * step : k * step + step]

        while len(row):
            if ids.shape[1] == 1:
                finish(np.ones(len(row), bool))
                break
            at = ranks.argmin(1)
            least = ranks[np.arange(len(row)), at]
            ends = least == NONE
            if ends.any():
                finish(ends)
                go = ~ends
                ids, ranks, row, at, least = ids[go], ranks[go], row[go], at[go], least[go]
                if not len(row):
                    break
            k, w = np.arange(len(row)), ids.shape[1]
            ids[k, at] = self.made_by_rank[least]
            ids = ids[np.arange(w) != (at + 1)[:, None]].reshape(len(row), w - 1)
            ranks = ranks[np.arange(w - 1) != at[:, None]].reshape(len(row), w - 2)
            if w > 2:
                left, right = np.flatnonzero(at > 0), np.flatnonzero(at < w - 2)
                ranks[left, at[left] - 1] = self.rank_of(ids[left, at[left] - 1], ids[left, at[left]])
                ranks[right, at[right]] = self.rank_of(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def long(self, word: bytes) -> bytes:
        """Ids of one long word, by a heap of (rank, position)."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pair.get(ids[i] * self.width + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = int(self.made_by_rank[r]), False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n and (r := self.pair.get(ids[x] * self.width + ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([x for x, ok in zip(ids, alive, strict=True) if ok], "<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Put the ids of these words into the cache."""
        if len(self.cache) + len(words) > self.cache_size:
            self.cache.clear()
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w.encode()), []).append(w)
        for n, group in by_size.items():
            if n > LONG:
                self.cache.update((w, self.long(w.encode())) for w in group)
            else:
                for k in range(0, len(group), 50_000):
                    part = group[k : k + 50_000]
                    self.cache.update(zip(part, self.short([w.encode() for w in part], n), strict=True))

    @functools.cached_property
    def cut(self):
        import re

        return re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def plain(self, text: str) -> bytes:
        words = pieces(text)
        found = list(map(self.cache.get, words))
        if None in found:
            self.learn({w for w, x in zip(words, found, strict=True) if x is None})
            if (found := list(map(self.cache.get, words))) and None in found:  # the cache was cleared for them
                self.learn(set(words))
                found = list(map(self.cache.get, words))
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers; strings of special tokens become their ids."""
        if self.cut and self.cut.search(text):
            return b"".join(int(self.special[x]).to_bytes(4, "little") if x in self.special else self.plain(x) for x in self.cut.split(text) if x)
        return self.plain(text)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """As encode; new words of the whole batch are merged together."""
        cut = [t for t in texts if not (self.cut and self.cut.search(t))]
        new: set[str] = set()
        split = {id(t): pieces(t) for t in cut}
        for words in split.values():
            new.update(w for w in words if w not in self.cache)
        if new:
            self.learn(new)
        out = []
        for t in texts:
            words = split.get(id(t))
            found = list(map(self.cache.get, words)) if words is not None else [None]
            out.append(self.encode(t) if None in found else b"".join(found))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids, as decode(ids, skip_special_tokens=False): bytes that aren't UTF-8 are replaced."""
        piece = self.piece
        return b"".join([piece[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@functools.cache
def bpe(path: str) -> Bpe:
    """One vocabulary for each worker process."""
    return Bpe(path)


#: Bytes of text taken together, which bounds a worker's memory.
CHUNK = 600_000


def text_slices(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about this many bytes: (first row, texts)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        done = int(size[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(size, done + most, side="right")))
        yield first, texts.slice(first, end - first)
        first = end


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """Runs of the batch's texts (null: empty) of about CHUNK bytes: (first row, texts). Only a run at a time is in Python."""
    for first, texts in text_slices(batch.column(column)):
        yield first, [t or "" for t in texts.to_pylist()]


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """For each row (doc_id, n_tokens, ids_sha256, decoded_sha256), and with ids=True also ids and decoded.

    A null text is an empty one: no ids, digests of nothing. Repeated rows each give a row; other
    columns are not read. path: the vocabulary file, at the same place on every executor. A narrow
    map with no shuffle; a worker holds its batch and a bounded cache.
    """
    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<bigint>, decoded string" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path)
        for b in batches:
            for first, texts in chunks(b, "text"):
                codes = own.encode_batch(texts)
                back = [own.decode(x) for x in codes]
                cols = [b.column("doc_id").slice(first, len(texts)), pa.array([len(x) // 4 for x in codes], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in codes]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back])]
                if ids:
                    cols += [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in codes], pa.list_(pa.int64())), pa.array(back)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * ids)

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)
