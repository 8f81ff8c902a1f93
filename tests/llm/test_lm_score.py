"""Scores of the language model against plain Python, its gradient, and its gain over the unigram base."""

import collections
import math
import zlib

import numpy as np
import pytest

from llm.cases import documents
from tessera.llm import lm_score


def tokens(text):
    raw = (text or "").encode()
    return [int(x) for x in lm_score._tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]]


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def mixed(x):
    return int(lm_score.textkit.mix(np.array([x], np.uint64))[0])


class Plain:
    """Counts, classes and sureness of words, word by word."""

    def __init__(self, every):
        self.docs = [(i, tokens(t)) for i, t in every]
        train = [d for i, d in self.docs if crc(i) % 7 != 2]
        self.count = collections.Counter(w for d in train for w in d)
        signed = lambda w: w - (1 << 64) if w >> 63 else w
        seeds = sorted(sorted(self.count, key=lambda w: (-self.count[w], signed(w)))[: lm_score.SEEDS])
        place = {w: i for i, w in enumerate(seeds)}
        meet = np.zeros((len(seeds), len(seeds)))
        near = [(d[i], d[j]) for d in train for i in range(len(d)) for j in range(i + 1, min(len(d), i + 1 + lm_score.REACH))]
        for a, b in near:
            if a in place and b in place:
                meet[place[a], place[b]] += 1
        own = dict(zip(seeds, lm_score.cluster(meet, lm_score.CLASSES).tolist(), strict=True))
        votes = collections.defaultdict(collections.Counter)
        for a, b in near:
            for x, y in ((a, b), (b, a)):
                if y in own:
                    votes[x][own[y]] += 1
        self.cls, self.level = {}, {}
        for w in {w for _, d in self.docs for w in d}:
            v = votes[w]
            top = max(v.values(), default=0)
            self.cls[w] = own.get(w, min(c for c in v if v[c] == top) if top else (w >> 17) % lm_score.CLASSES)
            share = (top + 1) / (sum(v.values()) + 1 + lm_score.CLASSES / 2)
            self.level[w] = lm_score.LEVELS - 1 if w in own else min(lm_score.LEVELS - 1, int(share * lm_score.LEVELS)) if top else 0
        self.tokens, self.words = collections.Counter(), collections.Counter()
        for w, n in self.count.items():
            self.tokens[self.cls[w]] += n
            self.words[self.cls[w]] += 1

    def inside(self, w):
        c = self.cls[w]
        return math.log10((self.count[w] + 1) / (self.tokens[c] + self.words[c] + 1))

    def features(self, d, t, model):
        """Rows of one token's features."""
        k = lm_score.CLASSES
        hashed = lambda w: (mixed(w) >> 40) % model.rows if w is not None else int(lm_score.START) % model.rows
        one, two = (d[t - 1] if t else None), (d[t - 2] if t > 1 else None)
        pure = lambda w: self.cls[w] * lm_score.LEVELS + self.level[w] if w is not None else k * lm_score.LEVELS
        cls = lambda w: self.cls[w] if w is not None else k
        b = model.bases
        return [hashed(one), b[1] + hashed(two), b[2] + pure(one), b[3] + pure(two), b[4] + cls(two) * (k + 1) + cls(one), b[5]]


def small(spark):
    full = documents(spark).where("length(coalesce(text, '')) < 20000")
    return full, [(r["doc_id"], r["text"]) for r in full.collect()]


def test_scores_without_training(spark, monkeypatch):
    """Over many ranges: the share of each class times the add-one share of the word in it."""
    monkeypatch.setattr(lm_score, "RANGE", 50)
    docs, every = small(spark)
    plain = Plain(every)
    n = sum(plain.tokens.values())
    want = sorted((str(i), len(d), sum(math.log10((plain.tokens[plain.cls[w]] + 1) / (n + lm_score.CLASSES)) + plain.inside(w) for w in d)) for i, d in plain.docs)
    found = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm_score.score_documents(docs.repartition(4), rounds=0).collect())
    # the seeds are those that are common in some chunk, so only documents in one chunk give the same ones
    assert [x[:2] for x in found] == [x[:2] for x in want]
    one = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in lm_score.score_documents(docs.coalesce(1), rounds=0).collect())
    assert np.allclose([x[2] for x in one], [x[2] for x in want], rtol=1e-5, atol=1e-4)


def test_one_round_of_training(spark):
    """One chunk and one round: mini-batches of adaptive steps, token by token."""
    docs, every = small(spark)
    order = [(r["doc_id"], r["text"]) for r in docs.coalesce(1).collect()]
    plain = Plain(order)
    n = sum(plain.tokens.values())
    rows = min(lm_score.MOST, max(lm_score.FEWEST, 1 << (n // lm_score.TOKENS_A_ROW).bit_length()))
    model = lm_score.Model(rows)
    model.weights[-1] = np.log([(plain.tokens[c] + 1) / (n + lm_score.CLASSES) for c in range(lm_score.CLASSES)])
    train = [(plain.features(d, t, model), plain.cls[d[t]]) for i, d in plain.docs if crc(i) % 7 != 2 for t in range(len(d))]
    seen = np.ones(model.weights.shape)
    for at in range(0, len(train), lm_score.BATCH):
        g = np.zeros(model.weights.shape)
        for own, c in train[at : at + lm_score.BATCH]:
            p = np.exp(model.weights[own].sum(0))
            p /= p.sum()
            p[c] -= 1
            for f in own:
                g[f] += p
        seen += g * g
        model.weights -= (lm_score.RATE * g / np.sqrt(seen)).astype(np.float32)
    want = []
    for i, d in plain.docs:
        total = 0.0
        for t, w in enumerate(d):
            p = np.exp(model.weights[plain.features(d, t, model)].sum(0))
            total += math.log10(p[plain.cls[w]] / p.sum()) + plain.inside(w)
        want.append((str(i), total))
    found = sorted((str(r["doc_id"]), r["score"]) for r in lm_score.score_documents(docs.coalesce(1), rounds=1).collect())
    want = sorted(want)
    assert [x[0] for x in found] == [x[0] for x in want]
    assert np.allclose([x[1] for x in found], [x[1] for x in want], rtol=1e-3, atol=1e-2)


def test_shares_are_a_distribution_and_the_gradient_is_right():
    rng = np.random.default_rng(4)
    model = lm_score.Model(8)
    model.weights[:] = rng.normal(size=model.weights.shape)
    packed, hashed = rng.integers(0, 256, 30).astype(np.uint8), rng.integers(0, 8, 30).astype(np.uint16)
    features = model.features(packed, hashed, np.array([0, 1, 12, 30]))
    assert features.min() >= 0 and features.max() == len(model.weights) - 1
    assert np.allclose(model.shares(features).sum(1), 1, atol=1e-5)
    cls = packed // lm_score.LEVELS
    model.weights = model.weights.astype(np.float64)
    loss = lambda: -np.log(model.shares(features)[np.arange(30), cls]).sum()
    g = model.gradient(features, cls)
    for at in ((features[0, 5], 3), (features[2, 7], int(cls[7])), (features[4, 20], 0), (len(model.weights) - 1, 9)):
        model.weights[at] += 1e-5
        up = loss()
        model.weights[at] -= 2e-5
        down = loss()
        model.weights[at] += 1e-5
        assert math.isclose((up - down) / 2e-5, g[at], rel_tol=1e-3, abs_tol=1e-5)


def test_held_out_documents_gain_over_the_base(spark):
    """0.15 decades a held-out token at least, and training adds to what the classes give alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gain = {}
    for rounds in (0, 3):
        found = lm_score.score_documents(docs, rounds=rounds).where("held_out").toPandas()
        gain[rounds] = (found["score"] - found["base_score"]).sum() / found["n_tokens"].sum()
    assert gain[3] >= 0.15 and gain[3] > gain[0] + 0.1


def test_the_commonest_words_are_told_from_counts_of_all():
    """A word that is rare in every chunk is counted in each."""
    import pyarrow as pa
    import zstandard

    text = b"often " * 20000 + b"rare"
    chunk = {"_chunk": 0, "_ids": [1], "_crc": np.zeros(1, np.int64).tobytes(), "_ends": np.array([len(text)]).tobytes(), "_text": zstandard.compress(text)}
    found = list(lm_score._common(7, 2)([pa.RecordBatch.from_pylist([chunk])]))
    assert sorted(n for b in found for n in b.column("_n").to_pylist()) == [1, 1, 20000]
