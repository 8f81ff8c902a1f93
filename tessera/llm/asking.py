"""Names that chunks of documents ask about, and ranges of names that answer.

A chunk sorts its names, sends each distinct one once to the range that its hash falls in, and gets an answer for each
in the same order. A name that a third of all documents hold costs one entry a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm import textkit


def sorted_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and which sorted rows differ from the one before."""
    order = np.argsort(columns[0], kind="stable") if len(columns) == 1 else np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, new


class Asked:
    """Distinct names of a chunk, sorted by range and name."""

    def __init__(self, columns: list[np.ndarray], ranges: int, spread: int):
        """spread: how many of the columns choose the range."""
        order, new = sorted_rows(columns)
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        rows = order[first]
        own = [c[rows] for c in columns]
        home = textkit.mix(own[0].copy())
        for c in own[1:spread]:
            home = textkit.mix(home + c)
        home = ((home >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        by_home = np.argsort(home, kind="stable")
        place = np.empty(len(by_home), np.int64)
        place[by_home] = np.arange(len(by_home))
        #: Place of each row's name among the distinct ones, and a row of each.
        self.of_row = np.empty(len(order), np.int64)
        self.of_row[order] = place[group]
        self.row = rows[by_home]
        self.columns = [c[by_home] for c in own]
        self.many = (np.diff(np.append(first, len(order))) > 1)[by_home]
        self.cut = np.searchsorted(home[by_home], np.arange(ranges + 1, dtype=np.uint64))

    def batch(self, chunk: int, **more) -> pa.RecordBatch:
        """A row for each range that has names; ``more`` are arrays beside the distinct names."""
        full = np.flatnonzero(np.diff(self.cut))
        spans = [slice(self.cut[r], self.cut[r + 1]) for r in full]
        blobs = {"_names": [b"".join(c[s].tobytes() for c in self.columns) for s in spans], "_many": [np.packbits(self.many[s]).tobytes() for s in spans]}
        blobs |= {k: [x[s].tobytes() for s in spans] for k, x in more.items()}
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk, np.int64)), *(pa.array(x, pa.binary()) for x in blobs.values())], names=["_range", "_chunk", *blobs])

    def given(self, answers: pa.Table, column: str, dtype) -> np.ndarray:
        """The answers, which have a row for each range, in the order of the distinct names."""
        by_range = dict(zip(answers.column("_range").to_pylist(), answers.column(column).to_pylist(), strict=True))
        parts = [np.frombuffer(by_range[r], dtype) for r in np.flatnonzero(np.diff(self.cut)).tolist()]
        return np.concatenate(parts) if parts else np.zeros(0, dtype)
