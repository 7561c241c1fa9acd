"""Language ID by a linear-chain conditional random field over words.

A word's score for a language is the sum of learned weights of its features: the word
itself (the lexicon), its affixes and its n-grams of bytes, hashed to a fixed number
of slots. Learned transition weights connect neighbouring words, and forward-backward
gives each word its marginal, so code-switched texts are labelled word by word. A
document's language is the one with the largest mean marginal over its whole text.

Forward-backward runs on all documents of a batch at once: texts are cut into blocks,
the transfer matrices of a block are multiplied for all blocks in step, the few block
boundaries of each document are passed over, and the blocks are then filled in from
their exact boundary messages. Nothing is approximated, and one long text costs no
more per word than many short ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.bpe import chunks

SLOT_BITS, BLOCK = 16, 32
SLOTS = 1 << SLOT_BITS
#: A longer run of letters, as scripts without spaces have, counts as several words.
LONGEST = 30
WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")


def words_of(text: str) -> list[str]:
    """Lower-cased words of LONGEST letters at most; none if no character is a letter."""
    w = WORD.findall(text.lower())
    return w if any(map(str.isalpha, w)) or any(c.isalpha() for c in text) else []


def slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the features of words, and which of them each word has: (words, features) arrays.

    The word's bytes between marks give its lexicon feature, prefixes of 2 to 4 bytes,
    suffixes of 2 to 5, and all runs of two and three; hashes are computed for all words together.
    """
    raw = [b"<" + w.encode() + b">" for w in words]
    size = np.array([len(r) for r in raw])
    width = max(6, int(size.max()))
    m = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(-1, width).astype(np.uint32)
    grow, col = np.uint32(0x01000193), np.arange(width)
    mix = lambda h, salt: ((h ^ np.uint32(salt)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
    whole = np.full(len(raw), 0x811C9DC5, np.uint32)
    prefix, out, valid = {}, [], []
    for j in range(width):
        whole = np.where(j < size, (whole ^ m[:, j]) * grow, whole)
        prefix[j + 1] = whole
    out.append(mix(whole, 1)[:, None])
    valid.append(np.ones((len(raw), 1), bool))
    for n in (2, 3, 4):
        out.append(mix(prefix[n], 10 + n)[:, None])
        valid.append((size >= n)[:, None])
    row = np.arange(len(raw))
    for n in (2, 3, 4, 5):
        h = np.full(len(raw), n, np.uint32)
        for j in range(n, 0, -1):
            h = (h ^ m[row, np.maximum(size - j, 0)]) * grow
        out.append(mix(h, 20 + n)[:, None])
        valid.append((size >= n)[:, None])
    for n in (2, 3):
        h = np.full((len(raw), width - n + 1), n, np.uint32)
        for j in range(n):
            h = (h ^ m[:, j : width - n + 1 + j]) * grow
        out.append(mix(h, 30 + n))
        valid.append(col[None, : width - n + 1] + n <= size[:, None])
    return np.concatenate(out, 1).astype(np.int64), np.concatenate(valid, 1)


def scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Summed weights (words, labels) of each word's features."""
    parts = []
    for k in range(0, len(words), 4096):
        at, has = slots(words[k : k + 4096])
        parts.append(np.einsum("nfk,nf->nk", weights[at], has.astype(weights.dtype)))
    return np.concatenate(parts)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (SLOTS, labels)
    moves: np.ndarray  # (labels, labels)
    cache_size: int = 100_000
    cache: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def emissions(self, texts: list[list[str]]) -> np.ndarray:
        """One row per word of all texts; rows of new words are made together."""
        new = list({w for t in texts for w in t if w not in self.cache})
        if len(self.cache) + len(new) > self.cache_size:
            self.cache.clear()
            self.rows, new = None, list({w for t in texts for w in t})
        if new:
            made = scores(new, self.weights)
            first = 0 if self.rows is None else len(self.rows)
            self.rows = made if first == 0 else np.concatenate([self.rows, made])
            self.cache.update(zip(new, range(first, first + len(new)), strict=True))
        get = self.cache.__getitem__
        return self.rows[np.fromiter((i for t in texts for i in map(get, t)), np.int64, sum(map(len, texts)))]

    def marginals(self, emitted: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals (words, labels) of the words of sequences of these sizes (each over 0), and where each sequence begins."""
        n, k = emitted.shape
        per = -(-sizes // BLOCK)
        first = np.cumsum(per) - per
        total = int(per.sum())
        begin = np.cumsum(sizes) - sizes
        seq = np.repeat(np.arange(len(sizes)), sizes)
        where = first[seq] * BLOCK + (np.arange(n) - begin[seq])
        e = np.ones((total * BLOCK, k))
        e[where] = np.exp(emitted - emitted.max(1, keepdims=True))
        real = np.zeros(total * BLOCK, bool)
        real[where] = True
        e, real = e.reshape(total, BLOCK, k), real.reshape(total, BLOCK)
        a = np.exp(self.moves - self.moves.max())
        through = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        for s in range(BLOCK):
            m = (through @ a) * e[:, s, None, :]
            m /= m.max((1, 2), keepdims=True)
            through = np.where(real[:, s, None, None], m, through)
        # messages into and out of each block, in step over all sequences that are long enough
        before, after = np.full((total, k), 1.0 / k), np.ones((total, k))
        for s in range(1, int(per.max())):
            at = first[per > s] + s
            v = (before[at - 1, None, :] @ through[at - 1])[:, 0]
            before[at] = v / v.max(1, keepdims=True)
            back = (first + per - 1)[per > s] - s
            v = (through[back + 1] @ after[back + 1, :, None])[:, :, 0]
            after[back] = v / v.max(1, keepdims=True)
        alpha = np.empty((total, BLOCK, k))
        v = before
        for s in range(BLOCK):
            x = (v @ a) * e[:, s]
            x /= x.max(1, keepdims=True)
            v = np.where(real[:, s, None], x, v)
            alpha[:, s] = v
        v = after
        for s in range(BLOCK - 1, -1, -1):
            alpha[:, s] *= v
            x = (e[:, s] * v) @ a.T
            x /= x.max(1, keepdims=True)
            v = np.where(real[:, s, None], x, v)
        out = alpha.reshape(-1, k)[where]
        return out / out.sum(1, keepdims=True), begin

    def predict(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        """(language, mean marginal) of each text; ('und', 0.0) without words."""
        out = [("und", 0.0)] * len(texts)
        some = [k for k, t in enumerate(texts) if t]
        if some:
            sizes = np.array([len(texts[k]) for k in some])
            p, begin = self.marginals(self.emissions([texts[k] for k in some]), sizes)
            mean = np.add.reduceat(p, begin, axis=0) / sizes[:, None]
            best = mean.argmax(1)
            for k, b, m in zip(some, best.tolist(), mean[np.arange(len(some)), best].tolist(), strict=True):
                out[k] = (self.labels[b], min(1.0, m))
        return out


def train(texts: list[str], langs: list[str], sequences: int = 3000, length: int = 64, epochs: int = 6, batch: int = 200, rate: float = 0.3, seed: int = 7) -> Crf:
    """Fit weights and transitions by Adagrad on the conditional likelihood.

    Training sequences are spans of 4 to 32 words of random labelled texts, put one after the
    other, so the transitions learn from switches as well as from runs.
    """
    rng = np.random.default_rng(seed)
    labels = sorted(set(langs))
    own = [(w, labels.index(y)) for t, y in zip(texts, langs, strict=True) if (w := words_of(t))]
    crf = Crf(labels, np.zeros((SLOTS, len(labels))), np.zeros((len(labels), len(labels))))
    if not own or len(labels) < 2:
        return crf
    by = [[w for w, y in own if y == k] for k in range(len(labels))]
    by = [x for x in by if x]
    kinds = [k for k in range(len(labels)) if any(y == k for _, y in own)]
    data = []
    for _ in range(sequences):
        seq, gold = [], []
        while len(seq) < length:
            c = rng.integers(len(by))
            w = by[c][rng.integers(len(by[c]))]
            n = int(rng.integers(4, 33))
            at = int(rng.integers(max(1, len(w) - n + 1)))
            seq += w[at : at + n]
            gold += [kinds[c]] * len(w[at : at + n])
        data.append((seq[:length], gold[:length]))
    k = len(labels)
    g_w, g_m = np.full_like(crf.weights, 1e-6), np.full_like(crf.moves, 1e-6)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for b in range(0, len(data), batch):
            part = [data[i] for i in order[b : b + batch]]
            at, has = slots([w for seq, _ in part for w in seq])
            flat, size = at[has], has.sum(1)
            e = np.add.reduceat(crf.weights[flat], np.cumsum(size) - size, axis=0).reshape(len(part), length, k)
            gold = np.array([y for _, y in part])
            a = np.exp(crf.moves)
            psi = np.exp(e - e.max(2, keepdims=True))
            alpha, beta = np.empty_like(psi), np.empty_like(psi)
            v = np.full((len(part), k), 1.0 / k)
            for t in range(length):
                v = (v @ a) * psi[:, t]
                v /= v.sum(1, keepdims=True)
                alpha[:, t] = v
            v = np.ones((len(part), k))
            for t in range(length - 1, -1, -1):
                beta[:, t] = v
                v = (psi[:, t] * v) @ a.T
                v /= v.sum(1, keepdims=True)
            p = alpha * beta
            p /= p.sum(2, keepdims=True)
            pair = alpha[:, :-1, :, None] * a * (psi[:, 1:] * beta[:, 1:])[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            d = p.copy()
            d[np.arange(len(part))[:, None], np.arange(length), gold] -= 1
            d = d.reshape(-1, k) / len(part)
            grad = np.stack([np.bincount(flat, np.repeat(d[:, j], size), SLOTS) for j in range(k)], 1) + 1e-5 * crf.weights
            seen = np.zeros((k, k))
            np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            move = (pair.sum((0, 1)) - seen) / len(part) + 1e-3 * crf.moves
            g_w += grad**2
            g_m += move**2
            crf.weights -= rate * grad / np.sqrt(g_w)
            crf.moves -= rate * move / np.sqrt(g_m)
    return crf


def fold(doc_id: str, folds: int):
    """crc32 of the id as text, modulo folds (a null id: null)."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def fit(docs: DataFrame, per_label: int = 300, longest: int = 100_000, budget: int = 60_000_000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Crf:
    """A model from docs, of whose rows with a lang a bounded sample is brought to the driver.

    per_label: about so many documents of each language, those with the smallest id hashes; longest:
    texts of more characters are not in the sample, the others are in it whole; budget: characters
    that the sample may have, so that of many languages each gives fewer documents. All languages
    that documents have are learned, and the driver's memory is bounded whatever the input.
    """
    rows = docs.where(F.col(lang).isNotNull() & (F.length(text) <= longest)).select(F.xxhash64(doc_id).alias("h"), F.col(lang).alias("y"), F.col(text).alias("t"))
    counts = {r["y"]: (r["n"], r["mean"]) for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.avg(F.length("t")).alias("mean")).orderBy("y").collect()}
    if not counts:
        return Crf([], np.zeros((SLOTS, 0)), np.zeros((0, 0)))
    share = min(1.0, budget / max(1.0, sum(min(n, per_label) * mean for n, mean in counts.values())))
    edges = {y: min(2**63 - 1, int(min(1.0, max(per_label * share, 1.0) / n) * 2**64) - 2**63) for y, (n, _) in counts.items()}  # a share of the hash range for each
    cuts = docs.sparkSession.createDataFrame(list(edges.items()), "y string, edge bigint")
    held = rows.join(F.broadcast(cuts), "y").where("h <= edge").select("h", "y", "t").orderBy("h", "y", "t").limit(int(2 * per_label * share * len(counts)) + 2 * len(counts)).collect()
    return train([r["t"] for r in held], [r["y"] for r in held])


def identify(docs: DataFrame, model: Crf, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row: a narrow map over whole texts.

    A null text, or one without a letter, is 'und' with score 0; so is any text if the model has no label.
    """
    kind = dict(docs.dtypes)[doc_id]
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights.astype(np.float32), model.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*sent.value)
        for b in batches:
            found = []
            for _, texts in chunks(b, "text"):
                found += crf.predict([words_of(t) for t in texts]) if crf.labels else [("und", 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Crf, least: float, text: str = "text") -> DataFrame:
    """The rows of docs, whole, whose text has a language with at least this score: a narrow map."""
    sent = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights.astype(np.float32), model.moves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*sent.value)
        for b in batches:
            keep = []
            for _, texts in chunks(b, text):
                found = crf.predict([words_of(t) for t in texts]) if crf.labels else [("und", 0.0)] * len(texts)
                keep += [lang != "und" and score >= least for lang, score in found]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
