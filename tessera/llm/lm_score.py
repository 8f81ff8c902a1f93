"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Tokens are the words of the folded text and one end token, told apart by 64-bit hashes. Every word has one of
``CLASSES`` classes, and P(word | context) = P(class | context) P(word | class). The second factor is the add-one share
of the word among the training tokens of its class. The first is a maximum-entropy model whose features are rows of one
weight table:

* n-gram: the word before, hashed to a row; its class and how sure that class is; the pair of classes before;
* skip: the word two back, hashed to a row; its class and how sure that class is.

Classes are learned. The commonest words (``SEEDS``) are clustered by the words that stand near them, by counts over all
training tokens; every other word takes the class that most seeds near its occurrences have. The word table (count,
class, sureness) has a row for every word seen, so it grows with the vocabulary of the corpus; it is sorted and held in
ranges of the hash. A chunk of documents asks each range once for its distinct words. The hashed rows grow with the
corpus too, up to 2^14 for each of the two word features, as they travel with the tasks.

Training is distributed, by iterative parameter mixing. In each round every chunk takes its own part of the training
documents (the rounds together take all of them), runs mini-batches of adaptive gradient steps from the weights of the
round before, and the chunks' rows are averaged by how often each was visited. Scoring is one more pass in NumPy
batches. Texts are held compressed, and after the words have met their table only three bytes a token go on.

Defined results: a null text is empty and consists of the end token; a null id counts as the empty text for the
train/held-out split; repeated rows are scored and counted one by one; with no training rows all counts are 0 and a
table without rows gives none; a text of any length is taken whole, and needs some 100 bytes of memory a byte; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.asking import Asked, sorted_rows
from tessera.llm.staging import Staging, whole_id

CLASSES, SEEDS, REACH = 16, 512, 4
#: Bytes of text of a chunk of documents, names that one task sorts, slices of the seeds' and the weights' tables.
CHUNK, RANGE, SLICES = 1 << 23, 1 << 18, 16
#: Training tokens for each hashed row, and limits of the number of rows.
TOKENS_A_ROW, FEWEST, MOST = 1 << 14, 1 << 10, 1 << 14
BATCH, RATE, LEVELS = 1 << 14, 0.25, 16
END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
_U = np.uint64
_NO_SEED = 255


def _tokens(data, offsets):
    """Token hashes of all texts (each closed by END) and each text's first token."""
    starts, ends, first = textkit.words(data, offsets, textkit.SPACE)
    hashes = textkit.word_hashes(data, starts, ends)
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    out = np.empty(len(hashes) + n, np.uint64)
    out[np.arange(len(hashes)) + owner] = hashes
    begin = first + np.arange(n + 1)
    out[begin[1:] - 1] = END
    return out, begin


# ---- chunks of texts


_PACKED = "_chunk long, _ids array<long>, _crc binary, _ends binary, _text binary"


def _pack(batches):
    """A row for about CHUNK bytes of one task's texts, compressed."""
    schema = pa.schema([("_chunk", pa.int64()), ("_ids", pa.list_(pa.int64())), ("_crc", pa.binary()), ("_ends", pa.binary()), ("_text", pa.binary())])
    held, size, chunk = [], 0, TaskContext.get().partitionId() << 32

    def closed():
        ids = pa.concat_arrays([x[0] for x in held])
        ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        sizes = np.concatenate([x[2] for x in held])
        blobs = np.concatenate([x[1] for x in held]).tobytes(), np.cumsum(sizes).tobytes(), zstandard.compress(b"".join(x[3] for x in held), 1)
        return textkit.output(schema, [pa.array([chunk], pa.int64()), ids, *(pa.array([x], pa.binary()) for x in blobs)])

    for batch in batches:
        for row, n, data, offsets in textkit.chunks(batch.column("_text")):
            held.append((batch.column("_id").slice(row, n), batch.column("_crc").slice(row, n).to_numpy(), np.diff(offsets), data.tobytes()))
            size += len(data) + 64 * n
            if size >= CHUNK:
                yield closed()
                held, size, chunk = [], 0, chunk + 1
    if held:
        yield closed()


class _Texts:
    """Tokens of a packed chunk: hashes, first token of every text, and which texts are trained on."""

    def __init__(self, row: dict, folds: int, held_fold: int):
        raw = np.frombuffer(zstandard.decompress(row["_text"]), np.uint8)
        ends = np.concatenate([[0], np.frombuffer(row["_ends"], np.int64)])
        self.ids, crc = row["_ids"], np.frombuffer(row["_crc"], np.int64)
        self.held, self.part = crc % folds == held_fold, crc // folds
        tokens, begin, doc = [], [np.zeros(1, np.int64)], 0
        while doc < len(crc):
            upto = max(doc + 1, int(np.searchsorted(ends, ends[doc] + (textkit.CHUNK >> 2), side="right")) - 1)
            found, first = _tokens(raw[ends[doc] : ends[upto]], ends[doc : upto + 1] - ends[doc])
            begin.append(first[1:] + begin[-1][-1])
            tokens.append(found)
            doc = upto
        self.tokens, self.begin = np.concatenate(tokens), np.concatenate(begin)
        self.owner = np.repeat(np.arange(len(crc)), np.diff(self.begin))
        self.train = ~self.held[self.owner]


def _near(values: np.ndarray, owner: np.ndarray, reach: int = REACH):
    """Pairs of places of one text that stand at most ``reach`` tokens apart, by distance."""
    for d in range(1, min(reach, len(values) - 1) + 1):
        first = np.flatnonzero(owner[d:] == owner[:-d])
        yield first, first + d


# ---- classes of the commonest words


def _common(folds: int, held_fold: int):
    """How often every word stands among a chunk's training tokens."""
    schema = pa.schema([("_key", pa.int64()), ("_n", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                texts = _Texts(row, folds, held_fold)
                keys, n = np.unique(texts.tokens[texts.train], return_counts=True)
                yield textkit.output(schema, [keys.view(np.int64), n.astype(np.int64)])

    return run


def _places(seeds: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Place of each token among the sorted seeds; the number of seeds where it is none."""
    at = np.minimum(np.searchsorted(seeds, tokens), max(0, len(seeds) - 1))
    return np.where(seeds[at] == tokens, at, len(seeds)) if len(seeds) else np.zeros(len(tokens), np.int64)


def _meetings(seeds: np.ndarray, folds: int, held_fold: int):
    """How often two seeds stand near each other, in slices of the table."""
    schema = pa.schema([("_slice", pa.int32()), ("_n", pa.binary())])
    size = len(seeds) + 1

    def run(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                texts = _Texts(row, folds, held_fold)
                place = _places(seeds, texts.tokens)
                place[~texts.train] = len(seeds)
                for a, b in _near(place, texts.owner):
                    total += np.bincount(place[a] * size + place[b], minlength=size * size)
        if total.any():
            parts = np.array_split(total, SLICES)
            yield textkit.output(schema, [np.arange(SLICES, dtype=np.int32), pa.array([x.tobytes() for x in parts], pa.binary())])

    return run


def _summed(dtype):
    """The sum of a slice's arrays."""

    def run(key, table):
        total = np.sum([np.frombuffer(x, dtype) for x in table.column("_n").to_pylist()], 0)
        return pa.table({"_slice": pa.array([key[0].as_py()], pa.int32()), "_n": pa.array([total.tobytes()], pa.binary())})

    return run


def cluster(meetings: np.ndarray, classes: int) -> np.ndarray:
    """Class of each word from counts of how often two words meet: k-means on the main directions of their positive log shares."""
    n = meetings + meetings.T
    if len(n) <= classes:
        return np.arange(len(n))
    weight = n.sum(1) + 1.0
    share = np.log(np.maximum(1.0, n * weight.sum() / np.outer(weight, weight)))
    share *= np.sqrt(np.minimum(n, 50) / 50)
    u, s, _ = np.linalg.svd(share)
    x = u[:, : 2 * classes] * s[: 2 * classes]
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centres = [int(np.argmax(weight))]
    while len(centres) < classes:
        centres.append(int(np.argmax(np.min([((x - x[c]) ** 2).sum(1) for c in centres], 0))))
    middle = x[centres]
    for _ in range(30):
        own = np.argmin(((x[:, None] - middle[None]) ** 2).sum(2), 1)
        middle = np.stack([np.average(x[own == c], 0, weight[own == c]) if (own == c).any() else middle[c] for c in range(classes)])
    return own


# ---- the word table


def _ask_words(seeds: np.ndarray, classes: np.ndarray, ranges: int, folds: int, held_fold: int):
    """Every distinct word of a chunk with its training count, the class that most seeds near it have, and their number."""
    of_place = np.append(classes, _NO_SEED).astype(np.uint8)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                texts = _Texts(row, folds, held_fold)
                asked = Asked([texts.tokens], ranges, 1)
                n = len(asked.row)
                count = np.bincount(asked.of_row[texts.train], minlength=n)
                cls = of_place[_places(seeds, texts.tokens)]
                cls[~texts.train] = _NO_SEED
                found = [np.zeros(0, np.int64)]
                for a, b in _near(cls, texts.owner):
                    for x, y in ((a, b), (b, a)):
                        use = np.flatnonzero(cls[y] != _NO_SEED)
                        found.append(asked.of_row[x[use]] * CLASSES + cls[y[use]])
                votes = np.bincount(np.concatenate(found), minlength=n * CLASSES).reshape(n, CLASSES)
                top = votes.argmax(1)
                yield asked.batch(row["_chunk"], _count=count.astype(np.int64), _class=top.astype(np.uint8), _votes=votes[np.arange(n), top].astype(np.int32), _all=votes.sum(1).astype(np.int32))

    return run


_ASKED = "_range int, _chunk long, _names binary, _many binary, _count binary, _class binary, _votes binary, _all binary"
_ANSWER = "_chunk long, _range int, _count binary, _class binary, _tokens array<long>, _words array<long>"


def _own_class(names: np.ndarray) -> np.ndarray:
    """Class of a word that no seed stands near, by its hash."""
    return ((names >> _U(17)) % _U(CLASSES)).astype(np.int64)


def _judge(seeds: np.ndarray, classes: np.ndarray):
    """Count, class and sureness of every word of a range: one byte holds class and sureness."""

    def run(key, table):
        parts = [np.frombuffer(x, np.uint64) for x in table.column("_names").to_pylist()]
        cut = np.cumsum([0, *map(len, parts)])
        names = np.concatenate(parts)
        given = {k: np.frombuffer(b"".join(table.column(k).to_pylist()), t) for k, t in (("_count", np.int64), ("_class", np.uint8), ("_votes", np.int32), ("_all", np.int32))}
        order, new = sorted_rows([names])
        group = np.empty(len(names), np.int64)
        group[order] = np.cumsum(new) - 1
        word = names[order][new]
        n = len(word)
        count = np.bincount(group, given["_count"], n).astype(np.int64)
        votes = np.bincount(group * CLASSES + given["_class"], given["_votes"], n * CLASSES).reshape(n, CLASSES)
        every = np.bincount(group, given["_all"], n)
        cls, most = votes.argmax(1), votes.max(1)
        # how far the share of the class is above an even one, with few votes drawn to it
        share = (most + 1.0) / (every + 1.0 + CLASSES / 2)
        level = np.minimum(LEVELS - 1, (share * LEVELS).astype(np.int64))
        cls, level = np.where(most > 0, cls, _own_class(word)), np.where(most > 0, level, 0)
        seed = _places(seeds, word)
        is_seed = seed < len(seeds)
        cls[is_seed], level[is_seed] = classes[seed[is_seed]], LEVELS - 1
        packed = (cls * LEVELS + level).astype(np.uint8)
        known = count > 0
        tokens, words = np.bincount(cls, count, CLASSES).astype(np.int64), np.bincount(cls[known], minlength=CLASSES)
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        return pa.table({
            "_chunk": table.column("_chunk"), "_range": table.column("_range"), "_count": pa.array([count[group[a:b]].tobytes() for a, b in spans], pa.binary()),
            "_class": pa.array([packed[group[a:b]].tobytes() for a, b in spans], pa.binary()),
            "_tokens": pa.array([tokens.tolist()] + [None] * (len(spans) - 1), pa.list_(pa.int64())), "_words": pa.array([words.tolist()] + [None] * (len(spans) - 1), pa.list_(pa.int64())),
        })

    return run


# ---- encoded tokens


_ENCODED = "_chunk long, _ids array<long>, _held binary, _part binary, _begin binary, _known binary, _log binary, _inside binary, _codes binary"


def _encode(ranges: int, rows: int, tokens: np.ndarray, words: np.ndarray, folds: int, held_fold: int):
    """Per token its class byte and its hashed row; per text its known tokens, the sum of log10(count + 1), and that of log10 P(word | class). tokens, words: of each class."""
    schema = pa.schema([("_chunk", pa.int64()), ("_ids", pa.list_(pa.int64()))] + [(k, pa.binary()) for k in ("_held", "_part", "_begin", "_known", "_log", "_inside", "_codes")])
    below = np.log10(tokens + words + 1.0)

    def run(key, packed, answers):
        row = packed.to_pylist()[0]
        texts = _Texts(row, folds, held_fold)
        asked = Asked([texts.tokens], ranges, 1)
        count = asked.given(answers, "_count", np.int64)
        packed_class = asked.given(answers, "_class", np.uint8)
        log = np.log10(count + 1.0)
        inside = log - below[packed_class // LEVELS]
        heads = texts.begin[:-1]
        sums = [np.add.reduceat(x[asked.of_row], heads) if len(heads) else np.zeros(0) for x in ((count > 0).astype(np.int64), log, inside)]
        hashed = ((textkit.mix(asked.columns[0].copy()) >> _U(40)) % _U(rows)).astype(np.uint16)
        codes = zstandard.compress(packed_class[asked.of_row].tobytes() + hashed[asked.of_row].tobytes(), 1)
        blobs = texts.held.tobytes(), (texts.part % 251).astype(np.uint8).tobytes(), texts.begin.tobytes(), sums[0].astype(np.int64).tobytes(), sums[1].tobytes(), sums[2].tobytes(), codes
        return pa.Table.from_batches([textkit.output(schema, [pa.array([row["_chunk"]], pa.int64()), pa.array([row["_ids"]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in blobs)])])

    return run


# ---- the maximum-entropy model


class Model:
    """One weight table over all features; its last row is the bias of every context."""

    def __init__(self, rows: int, weights: np.ndarray | None = None):
        self.rows = rows
        self.bases = np.cumsum([0, rows, rows, CLASSES * LEVELS + 1, CLASSES * LEVELS + 1, (CLASSES + 1) ** 2])
        self.weights = np.zeros((int(self.bases[-1]) + 1, CLASSES), np.float32) if weights is None else weights

    def features(self, packed: np.ndarray, hashed: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Rows (6, n) of the features of every token; before a text stands a start token."""
        none, start = CLASSES * LEVELS, int(START) % self.rows
        cls, word, pure = packed.astype(np.int32) // LEVELS, hashed.astype(np.int32), packed.astype(np.int32)
        n, out = len(packed), np.empty((6, len(packed)), np.int32)
        first = np.zeros(n, bool)
        first[begin[:-1]] = True
        second = np.zeros(n, bool)
        second[begin[:-1][np.diff(begin) > 1] + 1] = True

        def back(x, d, fill):
            y = np.empty_like(x)
            y[d:], y[:d] = x[:-d] if d < n else x[:0], fill
            y[first] = fill
            if d == 2:
                y[second] = fill
            return y

        out[0], out[1] = back(word, 1, start), self.bases[1] + back(word, 2, start)
        out[2], out[3] = self.bases[2] + back(pure, 1, none), self.bases[3] + back(pure, 2, none)
        out[4] = self.bases[4] + back(cls, 2, CLASSES) * (CLASSES + 1) + back(cls, 1, CLASSES)
        out[5] = self.bases[5]
        return out

    def shares(self, features: np.ndarray) -> np.ndarray:
        """P(class | context) of each token."""
        logits = self.weights[features[0]]
        for own in features[1:]:
            logits += self.weights[own]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def gradient(self, features: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Of the summed log loss, for every weight."""
        error = self.shares(features)
        error[np.arange(len(cls)), cls] -= 1
        flat = features.ravel().astype(np.int64)
        return np.stack([np.bincount(flat, np.tile(error[:, k], len(features)), len(self.weights)) for k in range(CLASSES)], 1)

    def fit(self, features: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Adaptive gradient steps over mini-batches; returns how often each row was visited."""
        seen = np.full(self.weights.shape, 1.0)
        for at in range(0, len(cls), BATCH):
            g = self.gradient(features[:, at : at + BATCH], cls[at : at + BATCH])
            seen += g * g
            self.weights -= (RATE * g / np.sqrt(seen)).astype(np.float32)
        return np.bincount(features.ravel(), minlength=len(self.weights)).astype(np.float32)


class _Codes:
    def __init__(self, row: dict, model: Model):
        raw = zstandard.decompress(row["_codes"])
        self.begin = np.frombuffer(row["_begin"], np.int64)
        n = int(self.begin[-1])
        self.packed, self.hashed = np.frombuffer(raw, np.uint8, n), np.frombuffer(raw, np.uint16, n, n)
        self.held, self.part = np.frombuffer(row["_held"], bool), np.frombuffer(row["_part"], np.uint8)
        self.model = model

    def slices(self, docs: np.ndarray):
        """(class, features) of the texts in some 2^18 tokens at a time, and their places among the texts."""
        sizes = np.diff(self.begin)
        group = np.cumsum(sizes[docs]) >> 18
        for g in np.unique(group):
            own = docs[group == g]
            at = np.repeat(self.begin[own] - np.cumsum(sizes[own]) + sizes[own], sizes[own]) + np.arange(sizes[own].sum())
            begin = np.concatenate([[0], np.cumsum(sizes[own])])
            packed = self.packed[at]
            yield own, begin, (packed // LEVELS).astype(np.int64), self.model.features(packed, self.hashed[at], begin)


def _round(rows: int, weights: np.ndarray, r: int, rounds: int):
    """Changes of the chunks' own weights times their visits, and the visits, summed over a task and in slices."""
    schema = pa.schema([("_slice", pa.int32()), ("_n", pa.binary())])

    def run(batches):
        total = np.zeros((len(weights), CLASSES + 1), np.float32)
        for batch in batches:
            for row in batch.to_pylist():
                model = Model(rows, weights.copy())
                codes, visits = _Codes(row, model), np.zeros(len(weights), np.float32)
                for _, _, cls, features in codes.slices(np.flatnonzero(~codes.held & (codes.part % rounds == r))):
                    visits += model.fit(features, cls)
                total[:, :-1] += (model.weights - weights) * visits[:, None]
                total[:, -1] += visits
        if total[:, -1].any():
            yield textkit.output(schema, [np.arange(SLICES, dtype=np.int32), pa.array([x.tobytes() for x in np.array_split(total, SLICES)], pa.binary())])

    return run


_SCORED = "_id long, _held boolean, _tokens long, _known long, _log double, _model double"


def _score(rows: int, weights: np.ndarray):
    schema = pa.schema([("_id", pa.int64()), ("_held", pa.bool_()), ("_tokens", pa.int64()), ("_known", pa.int64()), ("_log", pa.float64()), ("_model", pa.float64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = _Codes(row, Model(rows, weights))
                total = np.frombuffer(row["_inside"], np.float64).copy()
                for own, begin, cls, features in codes.slices(np.arange(len(codes.held))):
                    p = codes.model.shares(features)[np.arange(len(cls)), cls]
                    total[own] += np.add.reduceat(np.log10(np.maximum(p, 1e-30)).astype(np.float64), begin[:-1])
                yield textkit.output(schema, [
                    pa.array(row["_ids"], pa.int64()), codes.held, np.diff(codes.begin), np.frombuffer(row["_known"], np.int64), np.frombuffer(row["_log"], np.float64), total,
                ])

    return run


def _gathered(parts: DataFrame, dtype) -> list[np.ndarray]:
    """The sums of all slices, in order."""
    found = {r["_slice"]: np.frombuffer(bytes(r["_n"]), dtype) for r in parts.groupBy("_slice").applyInArrow(_summed(dtype), "_slice int, _n binary").collect()}
    return [found[k] for k in sorted(found)]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, rounds: int = 3) -> DataFrame:
    """One row per document: ``id_col``, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(id as text) mod ``folds`` is ``held_fold`` are held out. rounds: passes of training, each
    over its own part of the training documents.
    """
    staging = Staging(docs.sparkSession, "lm")
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(whole_id(docs, id_col).alias("_id"), F.col(text_col).alias("_text"), crc.alias("_crc"))
    packed = staging.put(rows.mapInArrow(_pack, _PACKED), "packed")
    fold = (folds, held_fold)

    common = packed.mapInArrow(_common(*fold), "_key long, _n long").groupBy("_key").agg(F.sum("_n").alias("_n"))
    seeds = np.sort(np.array([r["_key"] for r in common.orderBy(F.desc("_n"), "_key").limit(SEEDS).collect()], np.int64).view(np.uint64))
    meetings = _gathered(packed.mapInArrow(_meetings(seeds, *fold), "_slice int, _n binary"), np.int64)
    size = len(seeds) + 1
    meetings = np.concatenate(meetings).reshape(size, size)[:-1, :-1] if meetings else np.zeros((size - 1, size - 1), np.int64)
    classes = cluster(meetings.astype(np.float64), CLASSES).astype(np.int64)

    bytes_ = packed.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    ranges = max(1, -(-bytes_ // (4 * RANGE)))
    asked = packed.mapInArrow(_ask_words(seeds, classes, ranges, *fold), _ASKED)
    answers = staging.put(asked.groupBy("_range").applyInArrow(_judge(seeds, classes), _ANSWER), "answers")
    totals = answers.where("_tokens is not null").agg(*[F.sum(F.col(c)[k]).alias(f"{c}{k}") for c in ("_tokens", "_words") for k in range(CLASSES)]).first()
    tokens, words = (np.array([totals[f"{c}{k}"] or 0 for k in range(CLASSES)], np.int64) for c in ("_tokens", "_words"))
    n, v = int(tokens.sum()), int(words.sum())

    hashed = min(MOST, max(FEWEST, 1 << (n // TOKENS_A_ROW).bit_length()))
    met = packed.groupBy("_chunk").cogroup(answers.select("_chunk", "_range", "_count", "_class").groupBy("_chunk"))
    encoded = staging.put(met.applyInArrow(_encode(ranges, hashed, tokens, words, *fold), _ENCODED), "encoded")
    staging.drop("packed", "answers")

    model = Model(hashed)
    model.weights[-1] = np.log((tokens + 1.0) / (n + CLASSES))
    for r in range(rounds):
        parts = _gathered(encoded.select("_begin", "_held", "_part", "_codes").mapInArrow(_round(hashed, model.weights, r, rounds), "_slice int, _n binary"), np.float32)
        if parts:
            total = np.concatenate([x.reshape(-1, CLASSES + 1) for x in parts])
            model.weights = model.weights + total[:, :-1] / np.maximum(total[:, -1:], 1)
    scored = encoded.select("_ids", "_held", "_part", "_begin", "_known", "_log", "_inside", "_codes").mapInArrow(_score(hashed, model.weights), _SCORED)
    return scored.select(
        F.col("_id").alias(id_col),
        F.col("_held").alias("held_out"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("_log") - F.col("_tokens") * float(np.log10(n + v + 1.0))).alias("base_score"),
        F.col("_model").alias("score"),
    )
