"""Which rows the pipeline keeps, against plain Python on planted rows."""

import collections
import hashlib
import math
import random
import re

import corpus_pipeline
from llm.cases import documents


def line(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))


def changed(text, rng):
    words = text.split()
    words[len(words) // 2] = line(rng, 1)
    return " ".join(words)


def test_near_stage_decides_by_row(spark, data):
    rng = random.Random(3)
    a, b, c, d = (line(rng, 120) for _ in range(4))
    rows = [(3, a, "s"), (7, changed(a, rng), "s"), (7, b, "s"), (None, c, "s"), (None, changed(c, rng), "s"), (None, d, "s"), (9, changed(d, rng), "s"), (12, d + " x", "s"), (12, d + " x", "s"), (20, "", "s"), (None, "", "s")]
    rows += [(30, t, "s") for t in [line(rng, 120)] * 2]
    found = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, documents(spark, rows), data).collect())
    of_c = [t for i, t, _ in rows if i is None and t in (rows[3][1], rows[4][1])]
    assert sum(found.pop((None, t), 0) for t in of_c) == 1
    assert found == collections.Counter([(3, a), (7, b), (9, rows[6][1]), (20, ""), (None, ""), (30, rows[-1][1])])


PLAIN = [f"{w}{e}" for w in ("river", "garden", "window", "letter", "morning", "village", "captain", "winter", "summer", "music", "silver", "market") for e in ("", "s", "ed", "ing", "ly")]
SPACE, LOW = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(rng, n=120):
    return " ".join(rng.choice(PLAIN) for _ in range(n)) + "."


def junk(rng):
    return " ".join("".join(rng.choice("#$%&*@!~^0123456789") for _ in range(rng.randint(2, 9))) for _ in range(120))


def brute_mix(rows):
    """(doc_id, size, source_size, target, taken) of rows (doc_id, text, source)."""
    size = lambda t: len(SPACE.findall(t))
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += size(t)
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(total))}
    target, free, left = {}, sorted(total), float(sum(total.values()))
    while free:
        share = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / share > 3 * total[s]]
        if not full:
            target |= {s: left * weight[s] / share for s in free}
            break
        for s in full:
            target[s] = 3.0 * total[s]
            left -= target[s]
            free.remove(s)
    out = []
    for s in total:
        budget, before = math.floor(target[s] + 0.5), 0
        epochs = budget // total[s]
        for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(f"mix:{r[0]}".encode()).hexdigest()):
            n = size(t)
            taken = epochs * n + max(0, min(n, budget - epochs * total[s] - before))
            before += n
            out.append((i, n, total[s], round(target[s], 6), taken))
    return sorted(out)


def test_run_against_plain_python(spark, tmp_path):
    """Planted junk, copies, near copies and benchmark passages: exactly these go, and the amounts of the rest are right."""
    rng = random.Random(8)
    passage, source = prose(rng, 30), lambda i: f"s{i * i % 4}"
    clean = [prose(rng) for _ in range(60)]
    texts = clean + [junk(rng) for _ in range(40)]
    is_junk = [False] * 60 + [True] * 40
    for t in [clean[4], clean[4].upper(), clean[9]] + [changed(clean[k], rng) for k in (11, 11, 20)] + [f"{prose(rng)} {passage} {prose(rng)}" for _ in range(5)]:
        texts.append(t)
        is_junk.append(False)
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k], source(i)) for i, k in enumerate(order)]
    rejected = {i for i, k in enumerate(order) if is_junk[k]}
    bench = [(0, passage), (1, "none of these words")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, int(i not in rejected), 0) for i, _, _ in rows if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    left = [r for r in rows if r[0] not in rejected]
    best = {}
    for r in left:
        best[r[1].translate(LOW)] = max(best.get(r[1].translate(LOW), -1), r[0])
    left = [r for r in left if best[r[1].translate(LOW)] == r[0]]
    sets = {}
    for i, t, _ in left:
        w = SPACE.findall(t.translate(LOW))
        sets[i] = set(zip(*(w[k:] for k in range(5)), strict=False))
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = sorted((group[i], group[j]), reverse=True)
                group = {k: new if g == old else g for k, g in group.items()}
    left = [r for r in left if group[r[0]] == r[0]]
    windows = {tuple(w[k : k + 10]) for _, t in bench for w in [WORD.findall(t.translate(LOW))] for k in range(max(1, len(w) - 9))}
    held = lambda t: any(tuple(w[k : k + n]) in windows for w in [WORD.findall(t.translate(LOW))] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    left = [r for r in left if not held(r[1])]
    assert len(rows) == 111 and len(rejected) == 40 and len(left) == 60
    found = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert found == brute_mix(left)
