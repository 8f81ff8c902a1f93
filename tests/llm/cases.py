"""Small tables with the awkward cases, and brute-force versions of the operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, _id string, size string, score string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    out = [line(rng.randint(1, 300)) for _ in range(40)]
    passage = line(90)
    out += [f"{line(20)} {passage} {line(20)}" for _ in range(6)]
    base = line(150).split()
    for _ in range(12):
        own = base[:]
        for _ in range(rng.randint(0, 12)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        out.append(" ".join(own))
    out += [out[3].upper(), out[3], out[5] + " ", "", " \t\n", "one", "ONE", "one two", "a" * 3000, "ab" * 2000, passage * 3, line(20_000)]
    return out


def documents(spark, rows=None, extra=True):
    """Null ids, texts and sources, ties, repeated rows, and columns whose names the operators use inside."""
    if rows is None:
        rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts())]
        rows += [(900, None, None), (901, None, "s1"), (None, "text without an id", "s2"), rows[0], rows[0]]
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y", "z", "w") for i, t, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
