"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation several times, each time a few turns longer. A rolling hash over the turns names every
prefix of every conversation. Conversations with equal full hashes are one; one whose full hash is a proper prefix of
another is a snapshot of it. An anti-join keeps the maximal ones, which are rendered.

Prefix hashes and full hashes are made distinct by partial aggregates before the join, so a first turn or a whole
conversation that a third of the log shares is one row a task. A conversation's turns meet in one task, as its rendered
text is one row.

Defined results: turns are ordered by number, role and text, null numbers first; a null text is empty and a null role
is "unknown"; rows with a null id form one conversation; rows that are repeated are turns that are repeated; of equal
conversations the smallest id stays, null last; a conversation of any length is rendered whole, in the memory of one
task; extra columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.staging import Staging, whole_id

OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(OPEN.format(role=role) + text + "\n" + CLOSE for role, text in turns)


def _roll(batches):
    schema = pa.schema([("_id", pa.int64()), ("_turns", pa.int64()), ("_full", pa.binary()), ("_prefixes", pa.list_(pa.binary())), ("_text", pa.string())])
    for batch in batches:
        ids, turns, full, prefixes, texts = [], [], [], [], []
        for key, rows in zip(batch.column("_id").to_pylist(), batch.column("_list").to_pylist(), strict=True):
            own = [(r["role"], r["text"]) for r in rows]
            state, every = b"", []
            for role, text in own:
                role_, text_ = role.encode(), text.encode()
                state = hashlib.blake2b(state + len(role_).to_bytes(8, "big") + role_ + text_, digest_size=16).digest()
                every.append(state)
            ids.append(key)
            turns.append(len(own))
            full.append(state)
            prefixes.append(every[:-1])
            texts.append(render(own))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, turns, full, prefixes, texts), schema, strict=True)], schema=schema)


def maximal_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per maximal conversation: ``id_col``, n_turns, copies (equal conversations in the log), rendered."""
    staging = Staging(turns.sparkSession, "chat")
    parts = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("unknown")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = turns.groupBy(whole_id(turns, id_col).alias("_id")).agg(F.sort_array(F.collect_list(parts)).alias("_list"))
    rolled = staging.put(rows.mapInArrow(_roll, "_id long, _turns long, _full binary, _prefixes array<binary>, _text string"), "rolled")
    groups = rolled.groupBy("_full").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_copies"))
    shorter = rolled.select(F.explode("_prefixes").alias("_p")).distinct()
    kept = groups.join(shorter, F.col("_full") == F.col("_p"), "left_anti").withColumnRenamed("_full", "_f")
    joined = rolled.drop("_prefixes").join(kept, (F.col("_full") == F.col("_f")) & F.col("_id").eqNullSafe(F.col("_least")))
    return joined.select(F.col("_id").alias(id_col), F.col("_turns").alias("n_turns"), F.col("_copies").alias("copies"), F.col("_text").alias("rendered"))
