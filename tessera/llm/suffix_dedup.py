"""Removal of long repeated byte strings by distributed prefix doubling.

Positions are thinned first, in a way that depends on content only: the anchor of a start p is the leftmost smallest
8-byte gram in the 96 grams from p on. Equal strings have equal anchors at equal offsets, and no two neighbouring
anchors are more than 96 bytes apart. The text between two anchors is a phrase, the first run of its anchor. (To rank
every byte instead would send 16 bytes a position and round: 27 times the input in each of nine rounds.)

Doubling: a round takes the pair (rank of the run behind a position, rank of the run that follows it), range-partitions
and sorts all pairs, and gives equal pairs one new rank, for a run of twice as many phrases. A pair that stands alone
is unique and its position is out; a position is past the threshold when its run would exceed ``REACH`` bytes, which
is what every repeat of ``LENGTH`` bytes is sure to hold in whole phrases behind its anchor.

The last two rounds rank the exact strings, whose pairs are (bytes before the anchor, bytes from it on), named by
64-bit hashes each. First whole blocks: the starts of one anchor, with all bytes that they cover. A block whose pair
repeats repeats at every start. A block that is alone, but shares the bytes that all strings through its anchor cover,
is taken start by start: each start's pair stands for its 400 bytes, is sorted among all others and is removed if it
repeats; one block of each repeated pair takes part for all its copies.

Positions never travel: a task sorts its own pairs, sends each distinct one once, and gets ranks in the same order, so
a passage that a third of all documents hold costs one pair a task. Texts that hold a candidate are joined by (id, text
hash). Nothing is collected; broadcasts are hinted only for tables counted at 131072 rows or fewer.

Defined results: null counts as empty; texts under ``LENGTH`` bytes keep all bytes; rows that agree in id and text are
copies of each other and lose their bytes; a null id is an id of its own; a table without rows gives none; matches never
cross rows; a text of any length is taken whole, and needs some 60 bytes of memory a byte; extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.asking import Asked, sorted_rows
from tessera.llm.near_dedup import BROADCAST
from tessera.llm.staging import Staging, whole_id

LENGTH, GRAM, WINDOW = 400, 8, 96
#: Bytes behind an anchor that hold only whole phrases in every repeat, and bytes from it on that every repeat holds.
REACH, CORE = LENGTH - 2 * WINDOW - GRAM + 1, LENGTH - WINDOW + 1
#: Bytes of text of one round of NumPy work, of a chunk of the first scan, and of a chunk of texts with candidates.
PIECE, CHUNK, TEXTS = 1 << 17, 1 << 22, 1 << 21
#: Names that one task sorts.
RANGE = 1 << 18
#: The run ends at the text's last anchor; it is past the threshold; it is unique.
_TAIL, _DONE, _ALONE = 1, 2, 4
_U = np.uint64


def _anchor_of(data: np.ndarray) -> np.ndarray:
    """Anchor of every start in one buffer; starts too near to the end are left out."""
    n = len(data) - GRAM + 1
    if n < WINDOW:
        return np.zeros(0, np.int64)
    h = np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)) * _U(0x9E3779B97F4A7C15)
    h >>= _U(33)
    h <<= _U(32)
    h |= np.arange(n, dtype=np.uint64)
    h = h.view(np.int64)
    for shift in (1, 2, 4, 8, 16, 32, 32):
        h = np.minimum(h[:-shift], h[shift:])
    return h & np.int64(0xFFFFFFFF)


def _blocks(data: np.ndarray, offsets: np.ndarray):
    """Of all texts of a piece: each anchor's place in the piece, first and last start, and text."""
    anchor = _anchor_of(data)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[: len(anchor)]
    # the last starts of a text would look into the next one
    bound = np.where(sizes >= LENGTH, offsets[1:] - (WINDOW + GRAM - 2), offsets[:-1])
    start = np.flatnonzero(np.arange(len(anchor)) < bound[text])
    text, anchor = text[start], anchor[start]
    if not len(start):
        return start, start, start, text
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(first[1:], len(start)) - 1
    return anchor[first], start[first], start[last], text[first]


class _Names:
    """Hashes of any strings of one buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.power, self.inverse = textkit.powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        weighed = data.astype(np.uint64)
        weighed += _U(1)
        weighed *= self.power[:n]
        np.cumsum(weighed, out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return textkit.mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


# ---- names, asked for by chunk and given by range


_ASKED = "_range int, _chunk long, _names binary, _many binary"


def _meet(table: pa.Table, width: int):
    """All names of a range: its columns, which names are repeated inside a chunk, and the size of each chunk's share."""
    parts = [np.frombuffer(x, np.uint64).reshape(width, -1) for x in table.column("_names").to_pylist()]
    sizes = [p.shape[1] for p in parts]
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(table.column("_many").to_pylist(), sizes, strict=True)]).astype(bool)
    return [np.concatenate([p[i] for p in parts]) for i in range(width)], many, np.cumsum([0, *sizes])


def _repeated(new: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted names: the group of each, and which groups have several members."""
    first = np.flatnonzero(new)
    twice = np.diff(np.append(first, len(new))) > 1
    if len(first):
        twice |= np.logical_or.reduceat(many, first)
    return np.cumsum(new) - 1, twice


def _ranks(width: int):
    """Ranks of a range's names in their order; 0 for a name that stands alone."""

    def run(key, table):
        columns, many, cut = _meet(table, width)
        order, new = sorted_rows(columns)
        group, twice = _repeated(new, many[order])
        rank = np.zeros(len(order), np.uint64)
        rank[order] = np.where(twice[group], (_U(key[0].as_py()) << _U(40)) + group.astype(np.uint64) + _U(1), _U(0))
        return pa.table({"_chunk": table.column("_chunk"), "_range": table.column("_range"), "_given": pa.array([rank[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})

    return run


_GIVEN = "_chunk long, _range int, _given binary"


# ---- the first scan


_SCANNED = "_rid long, _id long, _hash long, _bytes long, _sha string, _chunk long, _docs binary, _counts binary, _firsts binary, _sizes binary, _names binary"


def _scan(batches):
    """A row for every text; the first of a chunk carries the phrases of all of the chunk's texts: per text with phrases its row id, their count and the first anchor, per phrase size and name."""
    schema = pa.schema([("_rid", pa.int64()), ("_id", pa.int64()), ("_hash", pa.int64()), ("_bytes", pa.int64()), ("_sha", pa.string()), ("_chunk", pa.int64())] + [(c, pa.binary()) for c in ("_docs", "_counts", "_firsts", "_sizes", "_names")])
    held, size, chunk = [], 0, TaskContext.get().partitionId() << 32

    def closed():
        facts, packed = [x[0] for x in held], [np.concatenate([x[1][i] for x in held]) for i in range(5)]
        columns = [pa.concat_arrays([f[i] for f in facts]) for i in range(5)]
        n = len(columns[0])
        blobs = [pa.array([p.tobytes()] + [None] * (n - 1), pa.binary()) for p in packed]
        return textkit.output(schema, [*columns, np.full(n, chunk, np.int64), *blobs])

    for batch in batches:
        for row, n, data, offsets in textkit.chunks(batch.column("_text"), PIECE):
            anchor, _, _, text = _blocks(data, offsets)
            names = _Names(data)
            inner = np.flatnonzero(text[1:] == text[:-1])
            a, b = anchor[inner], anchor[inner + 1] if len(inner) else anchor[:0]
            docs, first, counts = np.unique(text[inner], return_index=True, return_counts=True)
            raw = data.tobytes()
            shas = pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
            rid = batch.column("_rid").slice(row, n)
            own = rid.to_numpy()[docs], counts.astype(np.int32), (a[first] - offsets[docs]).astype(np.int32), (b - a).astype(np.int16), names.of(a, b)
            held.append(([rid, batch.column("_id").slice(row, n), batch.column("_hash").slice(row, n), pa.array(np.diff(offsets)), shas], own))
            size += len(data) + 64 * n
            if size >= CHUNK:
                yield closed()
                held, size, chunk = [], 0, chunk + 1
    if held:
        yield closed()


# ---- doubling


_STATE = {"_rid": np.int64, "_pos": np.int32, "_gap": np.int16, "_span": np.int16, "_flag": np.uint8, "_rank": np.uint64, "_next": np.uint64}
_STATES = "_chunk long, " + ", ".join(f"{c} binary" for c in _STATE) + ", _live long"


def _array(table, column: str, dtype, row: int = 0) -> np.ndarray:
    return np.frombuffer(table.column(column)[row].as_buffer(), dtype)


def _ask_phrases(ranges: int):
    def run(batches):
        for batch in batches:
            for i, chunk in enumerate(batch.column("_chunk").to_pylist()):
                yield Asked([_array(batch, "_names", np.uint64, i)], ranges, 1).batch(chunk)

    return run


def _pairs(table, row: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """Rank pairs of the positions that are neither unique nor past the threshold."""
    todo = (_array(table, "_flag", np.uint8, row) & (_DONE | _ALONE)) == 0
    return [_array(table, c, np.uint64, row)[todo] for c in ("_rank", "_next")], todo


def _ask_pairs(ranges: int):
    def run(batches):
        for batch in batches:
            for i, chunk in enumerate(batch.column("_chunk").to_pylist()):
                yield Asked(_pairs(batch, i)[0], ranges, 2).batch(chunk)

    return run


def _paired(chunk, rid, pos, gap, span, flag, rank) -> pa.Table:
    """Positions (sorted by text and place) with the rank of the run that follows theirs, if they go on."""
    pos, gap, span, flag = pos.astype(np.int64), gap.astype(np.int64), span.astype(np.int64), flag.astype(np.int64)
    n = len(pos)
    text = np.cumsum(np.concatenate([[0], rid[1:] != rid[:-1]])) if n else np.zeros(0, np.int64)
    key, want = (text << 32) + pos, (text << 32) + pos + span
    at = np.minimum(np.searchsorted(key, want), max(0, n - 1))
    there = (key[at] == want) & (span > 0)
    # a position that is missing was unique by its first phrase, whose size is the gap
    reach = span + np.where(there, span[at], gap)
    over = (flag & (_DONE | _ALONE)) > 0
    done = ~over & (((flag & _TAIL) > 0) | (there & ((flag[at] & _DONE) > 0)) | (reach > REACH))
    alone = ~over & ~done & (~there | ((flag[at] & _ALONE) > 0))
    live = ~(over | done | alone)
    grown = alone | live
    after = np.where(live, rank[at], _U(0))
    gap, span = np.where(grown, np.where(there, gap[at], 0), gap), np.where(grown, reach, span)
    flag = np.where(grown & there, (flag & ~_TAIL) | (flag[at] & _TAIL), flag) | np.where(done, _DONE, 0) | np.where(alone, _ALONE, 0)
    # a text without live positions only needs those past the threshold
    still = np.zeros(int(text[-1]) + 1 if n else 0, bool)
    still[text[live]] = True
    keep = still[text] | ((flag & _DONE) > 0)
    columns = (rid, pos, gap, span, flag, rank, after)
    out = {"_chunk": pa.array([chunk], pa.int64()), **{c: pa.array([x[keep].astype(t).tobytes()], pa.binary()) for (c, t), x in zip(_STATE.items(), columns, strict=True)}, "_live": pa.array([int(live.sum())], pa.int64())}
    return pa.table(out)


def _first_round(ranges: int):
    """Positions whose phrase repeats, paired."""

    def run(key, phrases, answers):
        asked = Asked([_array(phrases, "_names", np.uint64)], ranges, 1)
        rank = asked.given(answers, "_given", np.uint64)[asked.of_row]
        counts, sizes = _array(phrases, "_counts", np.int32), _array(phrases, "_sizes", np.int16).astype(np.int64)
        heads = np.cumsum(counts) - counts
        before = np.cumsum(sizes) - sizes
        pos = before + np.repeat(_array(phrases, "_firsts", np.int32) - before[heads], counts)
        flag = np.zeros(len(sizes), np.uint8)
        flag[heads + counts - 1] = _TAIL
        gap = np.where(flag > 0, 0, np.append(sizes[1:], 0))
        keep = rank > 0
        rid = np.repeat(_array(phrases, "_docs", np.int64), counts)
        return _paired(key[0].as_py(), rid[keep], pos[keep], gap[keep], sizes[keep], flag[keep], rank[keep])

    return run


def _next_round(ranges: int):
    def run(key, state, answers):
        pairs, todo = _pairs(state)
        asked = Asked(pairs, ranges, 2)
        found = asked.given(answers, "_given", np.uint64)[asked.of_row]
        rid, pos, gap, span, flag, rank, _ = (_array(state, c, t).copy() for c, t in _STATE.items())
        rank[todo] = found
        places = np.flatnonzero(todo)
        flag[places[found == 0]] |= _ALONE
        return _paired(key[0].as_py(), rid, pos, gap, span, flag, rank)

    return run


def _found(batches):
    """The anchors past the threshold, by text."""
    schema = pa.schema([("_rid", pa.int64()), ("_wanted", pa.binary())])
    for batch in batches:
        for i in range(batch.num_rows):
            over = (_array(batch, "_flag", np.uint8, i) & _DONE) > 0
            rid, pos = _array(batch, "_rid", np.int64, i)[over], _array(batch, "_pos", np.int32, i)[over]
            heads = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]])) if len(rid) else []
            ends = [*heads[1:], len(rid)] if len(rid) else []
            yield textkit.output(schema, [rid[heads] if len(rid) else rid, pa.array([pos[a:b].tobytes() for a, b in zip(heads, ends, strict=True)], pa.binary())])


# ---- exact strings


_PACKED = "_chunk long, _ids array<long>, _text binary, _ends binary, _counts binary, _wanted binary"


def _pack(batches):
    """Texts with candidates, a row a chunk."""
    schema = pa.schema([("_chunk", pa.int64()), ("_ids", pa.list_(pa.int64())), ("_text", pa.binary())] + [(c, pa.binary()) for c in ("_ends", "_counts", "_wanted")])
    ids, texts, wanted, size, chunk = [], [], [], 0, TaskContext.get().partitionId() << 32

    def closed():
        ends, counts = np.cumsum([len(x) for x in texts]), np.array([len(x) >> 2 for x in wanted], np.int32)
        return textkit.output(schema, [pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in (b"".join(texts), ends.astype(np.int64).tobytes(), counts.tobytes(), b"".join(wanted)))])

    for batch in batches:
        for i, raw, own in zip(batch.column("_id").to_pylist(), textkit.texts(batch.column("_text")), batch.column("_wanted").to_pylist(), strict=True):
            ids.append(i)
            texts.append(raw)
            wanted.append(own)
            size += len(raw) + 64
            if size >= TEXTS:
                yield closed()
                ids, texts, wanted, size, chunk = [], [], [], 0, chunk + 1
    if texts:
        yield closed()


class _Candidates:
    """Candidate blocks of a packed chunk: text, anchor, first and last start, and the names of core, left and right part."""

    def __init__(self, row):
        self.data = np.frombuffer(row["_text"], np.uint8)
        self.ends = np.concatenate([[0], np.frombuffer(row["_ends"], np.int64)])
        counts = np.frombuffer(row["_counts"], np.int32)
        wanted = np.sort((np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 32) + np.frombuffer(row["_wanted"], np.int32))
        self.pieces, found, doc = [], [], 0
        while doc < len(counts):
            upto = max(doc + 1, int(np.searchsorted(self.ends, self.ends[doc] + PIECE, side="right")) - 1)
            base = int(self.ends[doc])
            data, offsets = self.data[base : self.ends[upto]], self.ends[doc : upto + 1] - base
            a, p, q, text = _blocks(data, offsets)
            q = np.minimum(q, offsets[text + 1] - LENGTH)
            key = ((text.astype(np.int64) + doc) << 32) + a - offsets[text]
            at = np.minimum(np.searchsorted(wanted, key), max(0, len(wanted) - 1))
            use = (q >= p) & (wanted[at] == key) if len(wanted) else np.zeros(len(a), bool)
            a, p, q, text = a[use], p[use], q[use], text[use]
            names = _Names(data)
            found.append((text.astype(np.int64) + doc, a + base, p + base, q + base, names.of(a, a + CORE), names.of(p, a), names.of(a, q + LENGTH), np.full(len(a), len(self.pieces))))
            self.pieces.append((base, names))
            doc = upto
        self.doc, self.a, self.p, self.q, core, left, right, self.piece = (np.concatenate([x[i] for x in found]) for i in range(8))
        self.names = [core, left, right]

    def starts(self, blocks: np.ndarray):
        """Every start of the blocks: block, place, and the names of the bytes before the anchor and from it on."""
        count = self.q[blocks] - self.p[blocks] + 1
        owner = np.repeat(blocks, count)
        place = np.repeat(self.p[blocks] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        left, right = np.zeros(len(owner), np.uint64), np.zeros(len(owner), np.uint64)
        for k, (base, names) in enumerate(self.pieces):
            at = np.flatnonzero(self.piece[owner] == k)
            s, a = place[at] - base, self.a[owner[at]] - base
            left[at], right[at] = names.of(s, a), names.of(a, s + LENGTH)
        return owner, place, [left, right]


#: What is known of a block after the round of whole blocks: alone even in its core; repeated; alone, its starts may repeat; repeated, and its starts stand for its copies.
_NONE, _EVERY, _OPEN, _STANDS = 0, 1, 2, 3


def _ask_blocks(ranges: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield Asked(_Candidates(row).names, ranges, 1).batch(row["_chunk"])

    return run


def _judge(key, table):
    """Whole blocks of a range, core by core."""
    columns, many, cut = _meet(table, 3)
    order, new = sorted_rows(columns)
    group, twice = _repeated(new, many[order])
    core = columns[0][order]
    new_core = np.concatenate([[True], core[1:] != core[:-1]]) if len(core) else np.zeros(0, bool)
    of_core = np.cumsum(new_core) - 1
    heads = np.flatnonzero(new)
    different = np.bincount(of_core[heads]) if len(core) else np.zeros(0, np.int64)
    single = np.bincount(of_core[heads], ~twice) if len(core) else np.zeros(0)
    asked = ((different > 1) & (single > 0))[of_core]
    verdict = np.where(twice[group], np.where(asked & new, _STANDS, _EVERY), np.where(different[of_core] > 1, _OPEN, _NONE)).astype(np.uint8)
    out = np.empty(len(order), np.uint8)
    out[order] = verdict
    return pa.table({"_chunk": table.column("_chunk"), "_range": table.column("_range"), "_given": pa.array([out[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), "_open": pa.array([int((out[a:b] > _EVERY).sum()) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.int64())})


def _verdicts(candidates: _Candidates, answers: pa.Table, ranges: int):
    asked = Asked(candidates.names, ranges, 1)
    verdict = asked.given(answers, "_given", np.uint8)
    # one block stands for its copies in the chunk too
    taken = np.sort(asked.row[verdict > _EVERY])
    return verdict[asked.of_row], taken


def _ask_starts(ranges: int, finer: int):
    def run(key, texts, answers):
        candidates = _Candidates(texts.to_pylist()[0])
        _, taken = _verdicts(candidates, answers, ranges)
        return pa.Table.from_batches([Asked(candidates.starts(taken)[2], finer, 2).batch(key[0].as_py())])

    return run


def _cut(ranges: int, finer: int):
    schema = pa.schema([("_id", pa.int64()), ("_bytes", pa.int64()), ("_sha", pa.string()), ("_spans", pa.list_(pa.int64()))])

    def run(key, texts, answers):
        row = texts.to_pylist()[0]
        c = _Candidates(row)
        whole = pa.compute.equal(answers.column("_round"), 1)
        verdict, taken = _verdicts(c, answers.filter(whole), ranges)
        owner, place, names = c.starts(taken)
        asked = Asked(names, finer, 2)
        again = asked.given(answers.filter(pa.compute.invert(whole)), "_given", np.uint64)[asked.of_row] > 0
        again &= verdict[owner] == _OPEN
        every = (verdict == _EVERY) | (verdict == _STANDS)
        doc = np.concatenate([c.doc[every], c.doc[owner[again]]])
        # texts are set apart by one byte, so that runs of neighbours do not touch
        low = np.concatenate([c.p[every], place[again]]) + doc
        high = np.concatenate([c.q[every], place[again]]) + LENGTH + doc
        order = np.argsort(low, kind="stable")
        low, high, doc = low[order], np.maximum.accumulate(high[order]) if len(order) else high, doc[order]
        head = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]])) if len(low) else np.zeros(0, np.int64)
        tail = np.append(head[1:], len(low)) - 1 if len(low) else head
        run_doc, run_low, run_high = doc[head], low[head] - doc[head], high[tail] - doc[head]
        edges = np.searchsorted(run_doc, np.arange(len(c.ends)))
        raw, shas, spans = row["_text"], [], []
        for i in range(len(c.ends) - 1):
            h, at, own = hashlib.sha256(), int(c.ends[i]), []
            for a, b in zip(run_low[edges[i] : edges[i + 1]].tolist(), run_high[edges[i] : edges[i + 1]].tolist(), strict=True):
                h.update(raw[at:a])
                at = b
                own += [a - int(c.ends[i]), b - int(c.ends[i])]
            h.update(raw[at : int(c.ends[i + 1])])
            shas.append(h.hexdigest())
            spans.append(own)
        return pa.Table.from_batches([textkit.output(schema, [pa.array(row["_ids"], pa.int64()), np.diff(c.ends), shas, spans])])

    return run


# ---- the operator


def _fits(written: DataFrame) -> bool:
    return written.limit(BROADCAST + 1).count() <= BROADCAST


def _double(staging: Staging, scanned: DataFrame) -> tuple[DataFrame, str]:
    """The positions past the threshold, and the name of the table that holds them."""
    phrases = scanned.where("_names is not null").select("_chunk", "_docs", "_counts", "_firsts", "_sizes", "_names")
    n = phrases.agg(F.sum(F.octet_length("_names"))).first()[0] or 0
    ranges, level = max(1, -(-n // (8 * RANGE))), 0
    asked = phrases.select("_chunk", "_names").mapInArrow(_ask_phrases(ranges), _ASKED)
    answers = asked.groupBy("_range").applyInArrow(_ranks(1), _GIVEN)
    state = staging.put(phrases.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(_first_round(ranges), _STATES), "level0")
    while True:
        live = state.agg(F.sum("_live")).first()[0] or 0
        if not live:
            return state, f"level{level}"
        ranges, level = max(1, -(-live // RANGE)), level + 1
        asked = state.select("_chunk", "_flag", "_rank", "_next").mapInArrow(_ask_pairs(ranges), _ASKED)
        answers = asked.groupBy("_range").applyInArrow(_ranks(2), _GIVEN)
        state = staging.put(state.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(_next_round(ranges), _STATES), f"level{level}")
        staging.drop(f"level{level - 1}")


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_bytes, kept_sha256, spans (removed byte runs: start, end, start, end ...)."""
    spark = docs.sparkSession
    staging = Staging(spark, "suffix")
    rows = docs.select(whole_id(docs, id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    scanned = staging.put(rows.withColumn("_rid", F.monotonically_increasing_id()).mapInArrow(_scan, _SCANNED), "scanned")
    facts = scanned.select("_rid", "_id", "_hash", "_bytes", "_sha")
    state, name = _double(staging, scanned)

    wanted = state.select("_rid", "_pos", "_flag").mapInArrow(_found, "_rid long, _wanted binary")
    wanted = facts.select(F.col("_rid").alias("_r"), F.col("_id").alias("_i"), F.col("_hash").alias("_h")).join(wanted, F.col("_r") == F.col("_rid"))
    wanted = staging.put(wanted.groupBy("_i", "_h").agg(F.min(F.struct("_rid", "_wanted")).alias("_x")).select("_i", "_h", "_x._wanted"), "wanted")
    staging.drop(name)
    keys, same_row = wanted.select("_i", "_h"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))
    small = _fits(wanted)
    some = rows.join(F.broadcast(keys), same_row, "left_semi") if small else rows
    packed = staging.put(some.join(wanted, same_row).select("_id", "_text", "_wanted").mapInArrow(_pack, _PACKED), "packed")

    n = packed.agg(F.sum(F.octet_length("_wanted"))).first()[0] or 0
    ranges = max(1, -(-n // (4 * RANGE)))
    asked = packed.mapInArrow(_ask_blocks(ranges), _ASKED)
    judged = staging.put(asked.groupBy("_range").applyInArrow(_judge, f"{_GIVEN}, _open long"), "judged")
    finer = max(1, -(-(judged.agg(F.sum("_open")).first()[0] or 0) * WINDOW // (2 * RANGE)))
    verdicts = judged.drop("_open")
    asked = packed.groupBy("_chunk").cogroup(verdicts.groupBy("_chunk")).applyInArrow(_ask_starts(ranges, finer), _ASKED)
    again = asked.groupBy("_range").applyInArrow(_ranks(2), _GIVEN)
    answers = verdicts.withColumn("_round", F.lit(1)).unionByName(again.withColumn("_round", F.lit(2)))
    changed = packed.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(_cut(ranges, finer), "_id long, _bytes long, _sha string, _spans array<long>")

    same = facts.join(F.broadcast(keys) if small else keys, same_row, "left_anti").select("_id", "_bytes", "_sha", F.array().cast("array<long>").alias("_spans"))
    return same.unionByName(changed).select(F.col("_id").alias(id_col), F.col("_bytes").alias("n_bytes"), F.col("_sha").alias("kept_sha256"), F.col("_spans").alias("spans"))


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256."""
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    removed = F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)
    return find_repeats(docs, id_col, text_col).select(id_col, "n_bytes", removed.alias("n_removed"), F.floor(F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")
