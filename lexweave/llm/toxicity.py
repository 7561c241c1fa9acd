"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over which features a text has: its words, their first four
and their first five letters, hashed to slots. A slot takes part if enough texts of P
have it, and a share of P that is several times the share of U.
It learns from confirmed toxic texts P and unlabelled texts U only, by the risk
estimator corrected with the class prior pi:

    R = pi * E_P[loss(+)] + max(0, E_U[loss(-)] - pi * E_P[loss(-)])

where a step that would push the second term below zero is taken back instead. Labels
of zero are used for nothing but the prior. The score is calibrated on texts kept out
of training, so that 0.7 is the cut with the best estimated F1 on P and U.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.bpe import chunks
from lexweave.llm.shared import Scratch

SLOTS = 1 << 17
WORD = re.compile(r"[^\W\d_]+")


def slots(word: str) -> tuple[int, int, int]:
    return tuple(zlib.crc32(p.encode()) & SLOTS - 1 for p in ("=" + word, "4" + word[:4], "5" + word[:5]))


@dataclass
class Model:
    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    cache_size: int = 150_000
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def margin(self, text: str) -> float:
        words = set(WORD.findall(text.lower()))
        new = [w for w in words if w not in self.cache]
        if new:
            if len(self.cache) + len(new) > self.cache_size:
                self.cache.clear()
                new = list(words)
            at = np.array([slots(w) for w in new])
            used = self.weights[at] != 0
            for w, row, u in zip(new, at, used, strict=True):
                self.cache[w] = tuple(row[u].tolist()) if u.any() else ()
        held = {s for t in map(self.cache.__getitem__, words) for s in t}
        return self.bias + sum(self.weights[s] for s in sorted(held))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * (self.margin(text) - self.shift) + np.log(7 / 3), -30, 30))))


def margins(flat: np.ndarray, first: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    if not len(first):
        return np.zeros(0)
    return np.add.reduceat(np.append(w[flat], 0.0), first) * (np.diff(np.append(first, len(flat))) > 0) + bias


def _packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(r) for r in rows], np.int64)
    return (np.concatenate(rows) if rows else np.zeros(0, np.int64)), np.cumsum(size) - size


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], held_p: list[np.ndarray], held_u: list[np.ndarray], prior: float, epochs: int = 12, batch: int = 512, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> Model:
    """Fit by Adam on mini-batches of P and U, each text given by its distinct slots; held_p and held_u calibrate."""
    rng = np.random.default_rng(seed)
    model = Model(np.zeros(SLOTS))
    if not positive or not unlabelled:
        model.bias = -1.0
        return model
    w, b = model.weights, float(np.log(prior / (1 - prior)))
    m1, m2, b1, b2, step = np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 0.0, 0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    for _ in range(epochs):
        order = rng.permutation(len(unlabelled))
        for k in range(0, len(order), batch):
            u = [unlabelled[i] for i in order[k : k + batch]]
            p = [positive[i] for i in rng.choice(len(positive), min(len(positive), batch // 2), replace=False)]
            flat, first = _packed(p + u)
            z = margins(flat, first, w, b)
            zp, zu = z[: len(p)], z[len(p) :]
            rest = soft(zu).mean() - prior * soft(zp).mean()
            g = np.empty(len(z))
            if rest >= 0:
                g[: len(p)] = (-prior * sig(-zp) - prior * sig(zp)) / len(p)
                g[len(p) :] = sig(zu) / len(u)
            else:  # take back what overfits the unlabelled texts
                g[: len(p)] = prior * sig(zp) / len(p)
                g[len(p) :] = -sig(zu) / len(u)
            grad = np.bincount(flat, np.repeat(g, np.diff(np.append(first, len(flat)))), SLOTS) + decay * w
            step += 1
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            b1 += 0.1 * (g.sum() - b1)
            b2 += 0.01 * (g.sum() ** 2 - b2)
            w -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-5)
            b -= rate * (b1 / (1 - 0.9**step)) / (np.sqrt(b2 / (1 - 0.99**step)) + 1e-5)
    w[np.bincount(np.concatenate(positive + unlabelled), minlength=SLOTS) == 0] = 0
    model.bias = b
    zp = np.sort(margins(*_packed(held_p or positive), w, b))
    zu = np.sort(margins(*_packed(held_u or unlabelled), w, b))
    cuts = np.unique(np.concatenate([zp, zu]))
    recall = 1 - np.searchsorted(zp, cuts) / len(zp)
    share = 1 - np.searchsorted(zu, cuts) / len(zu)
    f1 = 2 * prior * recall / (prior + np.maximum(share, prior * recall))
    best = int(f1.argmax())
    model.shift = float(cuts[best] + cuts[max(0, best - 1)]) / 2
    model.scale = float(1 / max(1e-6, np.std(zu)))
    return model


def feature_rows(docs: DataFrame, text: str) -> DataFrame:
    """(y, held, f): the distinct slots of each text, for a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("t").to_pylist():
                words = set(WORD.findall((t or "").lower()))
                rows.append(np.array(sorted({s for x in words for s in slots(x)}), np.int32))
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("held"), pa.array(rows, pa.list_(pa.int32()))], names=["y", "held", "f"])

    return docs.select("y", "held", docs[text].alias("t")).mapInArrow(run, "y int, held boolean, f array<int>")


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, positives: int = 6000, unlabelled: int = 12000, longest: int = 50_000, least: int = 10, lift: float = 3.0, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """A model from a bounded sample of docs and labels (doc_id, toxic).

    positives, unlabelled: about so many texts of each kind, those with the smallest id hashes; longest:
    texts of more characters are not in the sample, the others are in it whole. P: documents that
    a label marks toxic. U: any documents, their labels hidden. A fifth of both is held out for
    calibration. least, lift: a slot takes part if so many texts of P have it, and its share of P is
    lift times that of U; slots are counted where the texts are, so only those that take part reach
    the driver. The prior is the toxic share of all labels given. Conflicting labels of a document
    count as toxic; null ones as none.
    """
    known = labels.where(F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(toxic).alias("_y"))
    n, pos = known.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not n or not pos:
        return train([], [], [], [], 0.5)
    prior = min(0.9, max(0.001, pos / n))
    sized = docs.where(F.length(text) <= longest).withColumn("_h", F.xxhash64(doc_id)).withColumn("held", F.pmod(F.xxhash64(doc_id, F.lit(1)), F.lit(5)) == 0)
    total = sized.count()
    edge = lambda share: min(2**63 - 1, int(share * 2**64) - 2**63)
    own = known.where((F.col("_y") == 1) & (F.xxhash64("_id") <= edge(positives / pos))).select("_id")
    # about as many ids as positives asks for, so no text is shuffled
    p = sized.join(F.broadcast(own), sized[doc_id] == own["_id"], "left_semi").withColumn("y", F.lit(1))
    u = sized.where(F.col("_h") <= edge(unlabelled / max(1, total))).withColumn("y", F.lit(0))
    rows = scratch.store(feature_rows(p.select("y", "held", text).union(u.select("y", "held", text)), text), "toxicity-features")
    n_p, n_u = rows.where("NOT held").agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    if not n_p or not n_u:
        return train([], [], [], [], prior)
    counts = rows.where("NOT held").select("y", F.explode("f").alias("s")).groupBy("s").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("u"))
    part = counts.where((F.col("p") >= min(least, max(2, n_p // 10))) & (F.col("p") / n_p >= lift * (F.col("u") + 1) / n_u)).select("s").toPandas().s.to_numpy()
    use = np.zeros(SLOTS, bool)
    use[part.astype(np.int64)] = True

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [x[use[x]] for x in (np.asarray(f, np.int64) for f in b.column("f").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("held"), pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))], names=["y", "held", "f"])

    local = rows.mapInArrow(keep, "y int, held boolean, f array<int>").limit(4 * (positives + unlabelled)).toPandas()
    # in one order, whatever order the rows came in
    of = lambda y, held: sorted((np.asarray(f, np.int64) for f in local.f[(local.y == y) & (local.held == held)]), key=lambda f: (len(f), f.tobytes()))
    model = train(of(1, False), of(0, False), of(1, True), of(0, True), prior)
    scratch.drop(rows)
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row: a narrow map over whole texts; a null text scores as an empty one."""
    kind = dict(docs.dtypes)[doc_id]
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.scale, model.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for b in batches:
            found = [own.score(t) for _, texts in chunks(b, "text") for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
