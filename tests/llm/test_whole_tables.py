"""op4 and op10 on the driver's tables against versions that look at everything."""

import numpy as np

from tessera.llm import near_dedup, suffix_dedup, textkit


def test_sketches_find_the_links_of_whole_sets(spark):
    """The components of sketches of 40 values are those of whole sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for width in (2, 5):
        some, every = (near_dedup.near_groups(docs, width=width, k=k).toPandas().set_index("doc_id")["component_id"].sort_index() for k in (near_dedup.K, None))
        assert (some == every).all() and every.nunique() < len(every)


def removed_bytes(texts: list[bytes], length: int = 400) -> list[tuple[int, int]]:
    """Removed bytes and runs of every text: every string of that length is hashed and counted."""
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    base = np.uint64(0x100000001B3)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), base)]), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), np.uint64(pow(int(base), -1, 1 << 64)))]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(7)) * power[:-1], dtype=np.uint64)])
    start = np.arange(len(data) - length + 1)
    start = start[start + length <= ends[np.searchsorted(ends, start, side="right")]]
    names = textkit.mix((total[start + length] - total[start]) * inverse[start])
    order = np.argsort(names)
    same = names[order][1:] == names[order][:-1]
    again = start[np.concatenate([order[1:][same], order[:-1][same]])]
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, np.unique(again), 1)
    np.add.at(edge, np.unique(again) + length, -1)
    cut = np.cumsum(edge)[:-1] > 0
    head = cut & ~np.concatenate([[False], cut[:-1]])
    head[ends[:-1][ends[:-1] < len(data)]] |= cut[ends[:-1][ends[:-1] < len(data)]]
    sums, heads = np.concatenate([[0], np.cumsum(cut)]), np.concatenate([[0], np.cumsum(head)])
    return list(zip((sums[ends[1:]] - sums[ends[:-1]]).tolist(), (heads[ends[1:]] - heads[ends[:-1]]).tolist(), strict=True))


def test_removed_bytes_of_ten_thousand_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = sorted((r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect())
    found = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.repeat_report(docs).collect()}
    want = dict(zip((i for i, _ in texts), removed_bytes([t for _, t in texts]), strict=True))
    assert found == want and sum(n > 0 for n, _ in want.values()) > 1000
