"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes; only its label is known. Every passage of the whole text is
encoded (shares of byte-class pairs and word statistics, then a learned projection), gated attention weighs the
passages, and the weighted sum is scored by a logistic output. Encoder, attention and output are trained together from
document labels by back-propagation.

Training reads a bounded sample: the ``sample`` labelled rows with the smallest hash of their id, outside the held-out
fold, and of each text ``passages`` passages at even distances (all, if it has no more), so the driver gets some 1 kB
for each of ``sample`` times ``passages`` passages at most. It takes ``steps`` optimiser steps whatever the size of that
sample. Scoring is one pass over all documents and all passages, without a shuffle.

Defined results: a null or empty text is one empty passage; a null id counts as the empty text for the fold and is
never trained on; ids with more than one label take the smallest; without labelled rows, or with one label only, the
score is the smoothed share of label 1; repeated rows get a row each, and are trained on as often; a table without
rows gives none; a text of any length is scored whole, in pieces of 1 MB and more only for a longer text, which needs
some 50 bytes of memory a byte; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.staging import whole_id

PASSAGE = 1024
HIDDEN, GATE = 24, 12
_KINDS = 16


def _kinds() -> np.ndarray:
    """Byte classes: vowel, consonant, upper case, digit, blank, line end, six kinds of punctuation, other symbols, bytes of longer characters."""
    kind = np.full(256, 12, np.uint8)
    groups = [b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".", b",;:", b"!?", b"'\"", b"()[]{}<>", b"|"]
    for i, own in enumerate(groups):
        kind[list(own)] = i
    kind[list(b"-_/")] = 13
    kind[0x80:0xC0], kind[0xC0:] = 14, 15
    return kind


KIND = _kinds()
FEATURES = _KINDS * _KINDS + 4
#: Optimiser steps of the training: 40 rounds over a full sample of 4000 rows.
STEPS = 1280


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and each text's first passage (n + 1 entries)."""
    sizes = np.diff(offsets)
    per = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    total = int(first[-1])
    features = np.zeros((total, FEATURES), np.float32)
    if len(data):
        row = np.repeat(np.arange(len(sizes)), sizes)
        seat = first[row] + (np.arange(len(data)) - offsets[row]) // PASSAGE
        kind = KIND[data].astype(np.int64)
        cell = seat[1:] * (_KINDS * _KINDS) + kind[:-1] * _KINDS + kind[1:]
        same = seat[1:] == seat[:-1]
        pairs = np.bincount(cell[same], minlength=total * _KINDS * _KINDS).reshape(total, -1)
        length = np.bincount(seat, minlength=total)
        features[:, : _KINDS * _KINDS] = np.sqrt(pairs / np.maximum(1, length)[:, None])
        starts, ends, _ = textkit.words(data, offsets, textkit.SPACE)
        hashes = textkit.word_hashes(data, starts, ends)
        home = seat[starts]
        words = np.bincount(home, minlength=total)
        order = np.lexsort((hashes, home))
        h, o = hashes[order], home[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]) if len(h) else np.zeros(0, bool)
        some = np.maximum(1, words)
        features[:, -4] = np.bincount(o[fresh], minlength=total) / some
        features[:, -3] = np.log1p(np.bincount(home, ends - starts, minlength=total) / some)
        features[:, -2] = np.log1p(words) / 5
        features[:, -1] = np.log1p(length) / 7
    return features, first


class GatedAttention:
    """Encoder, gated attention and logistic output, with hand-written gradients and Adam steps."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        shape = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" else np.zeros(s) for k, s in shape.items()}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, features, first):
        p = self.p
        x = (features - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (v * u) @ p["w"]
        heads, sizes = first[:-1], np.diff(first)
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, heads), sizes))
        a = s / np.repeat(np.add.reduceat(s, heads), sizes)
        z = np.add.reduceat(a[:, None] * h, heads, axis=0)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return score, (x, h, v, u, a, z, sizes, heads)

    def gradients(self, features, first, label):
        p = self.p
        score, (x, h, v, u, a, z, sizes, heads) = self.forward(features, first)
        e = (score - label) / len(label)
        g = {"c": z.T @ e, "d": np.array([e.sum()])}
        dz = np.repeat(e[:, None] * p["c"], sizes, axis=0)
        da = (dz * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, heads), sizes))
        g["w"] = (v * u).T @ ds
        dv, du = ds[:, None] * p["w"] * u * (1 - v * v), ds[:, None] * p["w"] * v * u * (1 - u)
        g["V"], g["U"] = h.T @ dv, h.T @ du
        dh = a[:, None] * dz + dv @ p["V"].T + du @ p["U"].T
        dh *= 1 - h * h
        g["W"], g["b"] = x.T @ dh, dh.sum(0)
        return g

    def fit(self, bags: list[np.ndarray], label: np.ndarray, steps: int = STEPS, batch: int = 128, rate: float = 3e-3, decay: float = 1e-3, seed: int = 11):
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.02
        rng, step = np.random.default_rng(seed), 0
        m, s = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        while step < steps:
            order = rng.permutation(len(bags))
            for at in range(0, min(len(order), (steps - step) * batch), batch):
                own = order[at : at + batch]
                first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in own])])
                step += 1
                for k, g in self.gradients(np.concatenate([bags[i] for i in own]), first, label[own]).items():
                    g = g + decay * self.p[k] * (k in "WVU")
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _bags(passages: int):
    def run(batches):
        schema = pa.schema([("_id", pa.int64()), ("_n", pa.int32()), ("_x", pa.binary())])
        for batch in batches:
            for row, n, data, offsets in textkit.chunks(batch.column("_text")):
                features, first = encode(data, offsets)
                some = [np.unique(np.linspace(a, b - 1, min(b - a, passages)).astype(np.int64)) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield textkit.output(schema, [batch.column("_id").slice(row, n), np.array([len(x) for x in some], np.int32), pa.array([features[x].tobytes() for x in some], pa.binary())])

    return run


def _score(model: GatedAttention | None, prior: float):
    schema = pa.schema([("_id", pa.int64()), ("_held", pa.bool_()), ("_score", pa.float64())])

    def run(batches):
        for batch in batches:
            for row, n, data, offsets in textkit.chunks(batch.column("_text")):
                score = model.forward(*encode(data, offsets))[0] if model else np.full(n, prior)
                yield textkit.output(schema, [batch.column("_id").slice(row, n), batch.column("_held").slice(row, n), score])

    return run


def _held(id_col: str, folds: int, held_fold: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == held_fold


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_fold: int, sample: int, passages: int, steps: int) -> tuple[GatedAttention | None, float]:
    """The model and the smoothed share of label 1 in the sample."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~_held(id_col, folds, held_fold))
    usable = usable.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label_col).cast("double").alias("_label"))
    picked = usable.orderBy(F.xxhash64("_id"), "_id").limit(sample).collect()
    label = {r["_id"]: r["_label"] for r in picked}
    prior = (sum(label.values()) + 1) / (len(label) + 2)
    if len(set(label.values())) < 2:
        return None, prior
    wanted = docs.sparkSession.createDataFrame([(i,) for i in label], "_want long")  # at most ``sample`` rows
    rows = docs.select(whole_id(docs, id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.join(F.broadcast(wanted), F.col("_id") == F.col("_want"), "left_semi").mapInArrow(_bags(passages), "_id long, _n int, _x binary").collect()
    rows.sort(key=lambda r: (r["_id"], r["_x"]))
    bags = [np.frombuffer(r["_x"], np.float32).reshape(r["_n"], FEATURES) for r in rows]
    y = np.array([label[r["_id"]] for r in rows])
    if len(set(y.tolist())) < 2:
        return None, prior
    return GatedAttention().fit(bags, y, steps=steps), prior


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, sample: int = 4000, passages: int = 16, threshold: float = 0.3, steps: int = STEPS) -> DataFrame:
    """One row per document: ``id_col``, held_out, score, predicted."""
    model, prior = train(docs, labels, id_col, text_col, label_col, folds, held_fold, sample, passages, steps)
    rows = docs.select(whole_id(docs, id_col).alias("_id"), _held(id_col, folds, held_fold).alias("_held"), F.col(text_col).alias("_text"))
    scored = rows.mapInArrow(_score(model, prior), "_id long, _held boolean, _score double")
    return scored.select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def _keep(model: GatedAttention | None, prior: float, text_at: int, threshold: float):
    def run(batches):
        for batch in batches:
            for row, n, data, offsets in textkit.chunks(batch.column(text_at)):
                score = model.forward(*encode(data, offsets))[0] if model else np.full(n, prior)
                yield batch.slice(row, n).filter(pa.array(score >= threshold))

    return run


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, sample: int = 4000, passages: int = 16, threshold: float = 0.3, steps: int = STEPS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score reaches the threshold."""
    model, prior = train(docs, labels, id_col, text_col, label_col, folds, held_fold, sample, passages, steps)
    return docs.mapInArrow(_keep(model, prior, docs.columns.index(text_col), threshold), docs.schema)
