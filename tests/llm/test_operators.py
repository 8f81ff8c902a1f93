"""Each operator against brute force on awkward rows, and on an empty table."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from llm.cases import LOW, documents, empty
from tessera.llm import chat_format, decontam, exact_dedup, license_scan, lm_score, mixing, near_dedup, quality, suffix_dedup, warc_revisit

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return (text or "").translate(LOW)


def rows(df):
    return [r.asDict() for r in df.collect()]


def count_by(items):
    return collections.Counter(items)


def test_exact_dedup(spark):
    docs = documents(spark)
    every = [(r["doc_id"], low(r["text"])) for r in docs.collect()]
    groups = collections.defaultdict(list)
    for i, t in every:
        groups[t].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    found = rows(exact_dedup.exact_groups(docs))
    assert count_by((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == count_by((i, best[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in every)
    assert sum(r["kept"] for r in found) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_exact_dedup_keeps_the_smallest_on_demand(spark):
    docs = documents(spark, [(3, "A", "s"), (1, "a", "s"), (2, "b", "s")])
    assert sorted((r["doc_id"], r["kept"]) for r in rows(exact_dedup.exact_groups(docs, keep="smallest"))) == [(1, True), (2, True), (3, False)]


def test_mixing(spark):
    docs = documents(spark)
    found = rows(mixing.mix_sources(docs))
    assert count_by((r["doc_id"], r["size"]) for r in found) == count_by((r["doc_id"], len(SPACE.findall(r["text"] or ""))) for r in docs.collect())
    by = collections.defaultdict(list)
    for r in found:
        by[r["source"]].append(r)
    total = sum(r["size"] for r in found)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    size = {s: sum(r["size"] for r in by[s]) for s in order}
    target, free, left = {}, list(order), float(total)
    while free:
        share = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / share > 3 * size[s]]
        if not full:
            target |= {s: left * weight[s] / share for s in free}
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.remove(s)
    for s in order:
        assert all(r["source_size"] == size[s] and math.isclose(r["target"], target[s], abs_tol=1e-9) for r in by[s])
        assert sum(r["taken"] for r in by[s]) == math.floor(target[s] + 0.5)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in by[s])
    again = rows(mixing.mix_sources(docs.repartition(5)))
    assert count_by((r["doc_id"], r["taken"]) for r in again) == count_by((r["doc_id"], r["taken"]) for r in found)


def components(sets):
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("width", [2, 5])
@pytest.mark.parametrize("short", [24, 2])
def test_near_dedup(spark, width, short, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHORT", short)
    docs = documents(spark)
    every = [(r["doc_id"], SPACE.findall(low(r["text"]))) for r in docs.collect()]
    sets = [frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset() for _, w in every]
    comp = components(sets)
    least = collections.defaultdict(list)
    for (i, _), c in zip(every, comp, strict=True):
        least[c].append(i)
    want = [(i, len(s), (min((x for x in least[c] if x is not None), default=None)) if s else i) for (i, _), s, c in zip(every, sets, comp, strict=True)]
    found = rows(near_dedup.near_groups(docs, width=width))
    assert count_by((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == count_by(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_dedup_of_a_large_group(spark):
    """A group of near copies that fills long lists, beside documents that share one passage."""
    import random

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    made = []
    for _ in range(150):
        own = base[:]
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = word()
        made.append(own)
    made += [passage + [word() for _ in range(rng.choice((4, 10, 60)))] for _ in range(120)]
    docs = documents(spark, [(i, " ".join(w), "s") for i, w in enumerate(made)])
    comp = components([frozenset(zip(w, w[1:], strict=False)) for w in made])
    assert {r["doc_id"]: r["component_id"] for r in rows(near_dedup.near_groups(docs, width=2))} == dict(enumerate(comp))


def test_decontamination(spark):
    docs = documents(spark)
    texts = [r["text"] for r in docs.collect() if r["text"]]
    items = [(0, " ".join(texts[41].split()[25:60])), (1, "One, two!"), (2, None), (3, ""), (4, " ".join(texts[2].split()[:10])), (None, " ".join(texts[4].split()[:12])), (1, "unseen words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("null" if i is None else str(i))
    want = []
    for r in docs.collect():
        w = WORD.findall(low(r["text"]))
        hit, own = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    own |= windows[tuple(w[k : k + n])]
        want.append((r["doc_id"], len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert count_by(tuple(r[c] for c in columns) for r in rows(decontam.contamination_report(docs, bench))) == count_by(want)
    blocks = decontam.find_contamination(docs, bench, block_words=8)
    one = decontam.find_contamination(docs, bench)
    key = lambda r: (r["doc_id"], r["n_words"], tuple(r["spans"]), tuple(r["items"]))
    assert count_by(map(key, rows(blocks))) == count_by(map(key, rows(one)))
    cleaned = {r["doc_id"] for r in rows(decontam.drop_contaminated(docs, bench))}
    assert cleaned == {w[0] for w in want if not w[5]}


def test_fm_index_finds_every_place():
    rng = np.random.default_rng(2)
    symbols = np.concatenate([[0], rng.integers(1, 5, 300), [0], rng.integers(1, 5, 200), [0]])
    index = decontam.FMIndex(symbols, 5)
    for n in (1, 2, 4, 7):
        windows = np.array([symbols[p : p + n] for p in rng.integers(0, len(symbols) - n, 60) if (symbols[p : p + n] > 0).all()] + [[5] * n])
        a, b = index.search(windows)
        for w, x, y in zip(windows, a, b, strict=True):
            want = [p for p in range(len(symbols) - n + 1) if (symbols[p : p + n] == w).all()]
            assert sorted(index.locate(np.arange(x, y)).tolist()) == want


def test_suffix_dedup(spark):
    docs = documents(spark)
    every = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    seen = collections.Counter(b[p : p + 400] for _, b in every for p in range(len(b) - 399))
    want = []
    for i, b in every:
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p] += 1
                gone[p + 400] -= 1
        mask = np.cumsum(gone)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~mask].tobytes()
        want.append((i, len(b), int(mask.sum()), int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert count_by(tuple(r[c] for c in columns) for r in rows(suffix_dedup.repeat_report(docs))) == count_by(want)
    assert sum(w[2] for w in want) > 5000


def test_license_scan(spark):
    lines = [(1, "All rights\nreserved. CC-BY-SA 4.0; GNU General  Public License, version 3.0"), (2, "cc by cc by"), (3, None), (4, ""), (5, "allrights reserved"), (6, "Licensed under the Apache License, Version 2.0"), (7, "Permission is hereby granted, free of charge, to any person obtaining a copy"), (1, "cc by")]
    docs = documents(spark, [(i, t, "s") for i, t in lines])
    found = rows(license_scan.scan_licenses(docs))
    facts = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found), key=str)
    assert facts == sorted([(1, 15, 3, 0, 9, "cc-by,gpl,reserved"), (2, 4, 2, 0, 2, "cc-by"), (3, 0, 0, None, None, ""), (4, 0, 0, None, None, ""), (5, 2, 0, None, None, ""), (6, 8, 0, None, None, ""), (7, 13, 0, None, None, ""), (1, 2, 1, 0, 0, "cc-by")], key=str)
    labels = {r["doc_id"]: r["labels"].split(",") for r in found if r["n_words"] != 2}
    assert {"cc-by", "cc-by-sa", "gpl", "reserved"} <= set(labels[1]) and labels[6] == ["apache-2.0"] and labels[7] == ["mit"]
    assert all(0 <= r["score"] <= 1 for r in found)
    assert len(license_scan.rules()) >= 200


def samples(pattern):
    """Texts that a rule's regex matches: every branch once, the rest as short as it goes."""
    import re._parser as parser

    def words(tree):
        out = [""]
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                own = [chr(arg)]
            elif name == "IN":
                own = ["7" if str(arg[0][0]) == "CATEGORY" else chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])]
            elif name == "ANY":
                own = ["q"]
            elif name == "BRANCH":
                own = [x for branch in arg[1] for x in words(branch)]
            elif name == "SUBPATTERN":
                own = words(arg[3])
            else:
                low, _, inner = arg
                own = [x * max(low, 0) for x in words(inner)] if low else ["", *words(inner)]
            out = [a + b for a in out for b in own][:40]
        return out

    return words(parser.parse(pattern))


@pytest.mark.parametrize("label", sorted({r.label for r in license_scan.rules()}))
def test_every_license_rule_matches(label):
    """Each branch of each rule is found behind its keywords."""
    for rule in license_scan.rules():
        if rule.label != label:
            continue
        for text in samples(rule.regex):
            assert any(f" {k}" in f" {text}" for k in rule.keywords), (rule, text)
            _, _, found = license_scan.scan(f"zzz {text} zzz".encode())
            assert found and min(d.start for d in found) >= 1, (rule, text)
            _, compiled, _ = license_scan._compiled()
            assert any(r.label == label and c.search(f" {text} ") for r, c in zip(license_scan.rules(), compiled, strict=True))


def test_license_rules_by_hand():
    assert len(license_scan.SIGNATURES) >= 200 and len({r for _, _, r in license_scan.SIGNATURES}) == len(license_scan.SIGNATURES)


def test_license_scan_of_a_megabyte_of_places():
    import time

    start = time.perf_counter()
    n, base, found = license_scan.scan(b"cc by " * 170_000)
    assert n == 340_000 and len(base) == 170_000 and len(found) == 170_000 and time.perf_counter() - start < 10
    nested = [license_scan.Detection(i, 200_000 - i, "a", i % 7) for i in range(100_000)]
    start = time.perf_counter()
    kept = license_scan.suppress(nested)
    assert kept and time.perf_counter() - start < 10


def test_license_suppression_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        found = [license_scan.Detection(a, a + rng.randint(1, 9), rng.choice("abc"), rng.choice((10, 20, 30))) for a in (rng.randint(0, 20) for _ in range(rng.randint(0, 25)))]
        kept = []
        for d in sorted(set(found), key=lambda d: (d.priority, d.start - d.end, d.start, d.label)):
            if not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        assert license_scan.suppress(found) == sorted(kept, key=lambda d: (d.start, d.end, d.label))


def test_license_suppression():
    d = license_scan.Detection
    assert license_scan.suppress([d(0, 9, "a", 10), d(2, 5, "b", 20), d(8, 12, "c", 20), d(0, 9, "z", 10)]) == [d(0, 9, "a", 10), d(8, 12, "c", 20)]


def test_language_model(spark):
    docs = documents(spark)
    every = [(r["doc_id"], SPACE.findall(low(r["text"])) + [None]) for r in docs.collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in every if not held(i) for w in t)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in every)
    for own in (docs, docs.repartition(5)):
        found = rows(lm_score.score_documents(own))
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_quality_gradients():
    rng = np.random.default_rng(3)
    model = quality.GatedAttention(1)
    bags = [rng.normal(size=(k, quality.FEATURES)) for k in (1, 3, 2)]
    x, first, y = np.concatenate(bags), np.array([0, 1, 4, 6]), np.array([1.0, 0, 1])
    loss = lambda: -np.mean(y * np.log(model.forward(x, first)[0]) + (1 - y) * np.log(1 - model.forward(x, first)[0]))
    for name, g in model.gradients(x, first, y).items():
        at = tuple(0 for _ in g.shape)
        model.p[name][at] += 1e-5
        up = loss()
        model.p[name][at] -= 2e-5
        down = loss()
        model.p[name][at] += 1e-5
        assert math.isclose((up - down) / 2e-5, g[at], rel_tol=1e-3, abs_tol=1e-6)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(found) > 50 and (found["predicted"] == found["quality"]).mean() >= 0.95


def test_quality_learns_from_long_texts(spark):
    """Texts of over 128 kB are trained on, by passages from all over them."""
    text = lambda good, n: ("plain prose of the best kind " if good else "#### 99 !!! $$$ ") * n
    docs = spark.createDataFrame([(i, text(i % 2, 12_000)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    found = {r["doc_id"]: r for r in rows(quality.score_quality(docs, labels))}
    assert all(r["predicted"] == i % 2 for i, r in found.items())


def test_quality_of_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    found = rows(quality.score_quality(docs, labels))
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    none = rows(quality.score_quality(docs, labels.where("doc_id < 0")))
    assert {r["score"] for r in none} == {0.5}
    assert quality.drop_rejected(docs, labels).count() == sum(r["predicted"] for r in found)


def conversations(spark):
    chats = {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "x", 6: "ab", None: "q"}
    made = [(i, k, "user" if k % 2 == 0 else None, None if t == "d" else t, "extra") for i, text in chats.items() for k, t in enumerate(text)]
    return spark.createDataFrame(made[::-1], "conv_id long, turn long, role string, text string, n_turns string")


def test_chat_formatting(spark):
    found = {r["conv_id"]: r for r in rows(chat_format.maximal_conversations(conversations(spark)))}
    assert {k: (r["n_turns"], r["copies"]) for k, r in found.items()} == {2: (3, 2), 4: (3, 1), 5: (1, 1), None: (1, 1)}
    assert found[4]["rendered"] == chat_format.render([("user", "a"), ("unknown", "b"), ("user", "")])
    assert rows(chat_format.maximal_conversations(conversations(spark).where("false"))) == []


RECORDS = "record_id long, url string, time long, type string, etag string, last_modified string, digest string, headers map<string,string>, status string"


def test_revisits(spark):
    a = {"ETag": "x", "Server": "s", "Vary": "a"}
    made = [
        (1, "http://www.Site.org:80/p/?utm_source=f#t", 10, "response", "x", None, "d1", a, ""), (2, "https://site.org/p", 20, "revisit", 'W/x', None, None, {"Date": "now", "Set-Cookie": "c", "vary": "b"}, ""),
        (3, "site.org/p", 5, "revisit", "x", None, None, None, ""), (4, "site.org/p", 30, "response", "y", "m", "d2", None, ""), (5, "site.org/p", 40, "revisit", "x", None, None, {"A": "b"}, ""),
        (6, "site.org/p", 41, "revisit", None, "m", None, None, ""), (7, "site.org/p", 42, "revisit", None, None, None, None, ""), (8, None, 1, "response", "x", None, "d", None, ""), (9, None, 2, "revisit", "x", None, None, None, ""), (10, "other.org", 9, "revisit", "x", None, None, None, ""),
    ]
    found = {r["record_id"]: r for r in rows(warc_revisit.resolve_revisits(spark.createDataFrame(made, RECORDS)))}
    assert {k: (r["response_id"], r["status"], r["digest"]) for k, r in found.items()} == {2: (1, "resolved", "d1"), 3: (None, "orphan", None), 5: (4, "mismatch", None), 6: (4, "resolved", "d2"), 7: (4, "unverified", "d2"), 9: (None, "orphan", None), 10: (None, "orphan", None)}
    assert found[2]["headers"] == {"ETag": "x", "Server": "s", "Date": "now", "vary": "b"} and found[5]["headers"] == {"A": "b"}
    assert rows(warc_revisit.resolve_revisits(spark.createDataFrame([], RECORDS))) == []


def test_revisits_over_many_partitions(spark):
    """One URL with most records: every revisit takes the last response before it."""
    made = [(i, "hot.org/p" if i % 5 else f"u{i % 7}.org", i, "response" if i % 40 == 1 else "revisit", None, None, None, None, "") for i in range(2000)]
    last, want = {}, {}
    for i, url, _, kind, *_ in made:
        if kind == "response":
            last[url] = i
        else:
            want[i] = last.get(url)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    found = {r["record_id"]: r["response_id"] for r in rows(warc_revisit.resolve_revisits(spark.createDataFrame(made, RECORDS)))}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == want


def test_empty_tables(spark):
    docs = empty(spark)
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    made = [
        exact_dedup.exact_groups(docs), mixing.mix_sources(docs), near_dedup.near_groups(docs), decontam.contamination_report(docs, bench), suffix_dedup.repeat_report(docs),
        license_scan.scan_licenses(docs), lm_score.score_documents(docs), quality.score_quality(docs, labels),
    ]
    assert [df.count() for df in made] == [0] * len(made)
    full = documents(spark)
    assert not any(r["contaminated"] for r in rows(decontam.contamination_report(full, bench)))


def brute_repeats(texts, length=400):
    """Removed bytes and runs of every text, by a plain count of all strings of that length."""
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cut = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cut[i : i + length] = True
        cut[len(t)] = False
        kept = bytes(b for b, c in zip(t, cut, strict=False) if not c)
        out.append((len(t), int(cut.sum()), int((cut[:-1] & ~np.concatenate([[False], cut[:-2]])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup_over_many_chunks_and_ranges(spark, monkeypatch):
    """Shared passages at every kind of offset, periodic texts, and names dealt over many ranges and chunks."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))[: 5 * n]
    shared = [text(n) for n in (75, 80, 81, 90, 160, 400)]
    texts = [text(rng.randint(0, 60)) + "".join(rng.choice(shared)[rng.randint(0, 30) :] + text(rng.randint(0, 20)) for _ in range(rng.randint(0, 3))) for _ in range(60)]
    texts += ["ab" * 700, "ab" * 701, "x" * 399, "x" * 400, "x" * 401, "x" * 900, shared[0][:399], shared[1] * 4, "", "é" * 500, texts[3], texts[3]]
    monkeypatch.setattr(suffix_dedup, "RANGE", 97)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffix_dedup.repeat_report(docs))}
    assert found == dict(enumerate(brute_repeats([t.encode() for t in texts])))


@pytest.mark.parametrize("largest", [True, False])
def test_runs_merge_as_plain_sets_do(largest):
    rng = random.Random(2)
    rows = [(bytes([rng.randint(0, 3), rng.randint(0, 9)]).ljust(48, b"\1"), rng.choice([None, *range(6)]), i) for i in range(400)]
    runs = []
    for at in range(0, 400, 37):
        part = rows[at : at + 37]
        runs.append(exact_dedup._fold(exact_dedup._Run(np.array([k for k, *_ in part], "S48"), np.array([i or 0 for _, i, _ in part]), np.array([i is None for _, i, _ in part]), np.array([r for *_, r in part]), np.ones(len(part), np.int64)), largest))
    own = exact_dedup._multiway(runs, largest)
    groups = collections.defaultdict(list)
    for k, i, r in rows:
        groups[k].append((i is None, 0 if i is None else -i if largest else i, r))
    assert own.keys.tolist() == sorted(groups)
    assert own.counts.tolist() == [len(groups[k]) for k in sorted(groups)]
    assert own.rids.tolist() == [min(groups[k])[2] for k in sorted(groups)]
