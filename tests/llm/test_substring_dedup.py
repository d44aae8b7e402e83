import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from triadic.llm import substring_dedup as sd

DOCS = "doc_id long, text string, spans string"


def brute(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for (doc, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(r), sum(gone), spans, kept))
    return sorted(out, key=str)


def run(spark, rows, **k):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], DOCS).repartition(3)
    got = sd.remove_repeats(df, **k).collect()
    return sorted([(r.doc_id, r.n_bytes, sum(s["end"] - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in got], key=str)


def corpus(seed, letters="abc", n=40):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [word(rng.randint(30, 160)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            a = rng.randint(0, 20)
            parts += [word(rng.randint(0, 60)), p[a : len(p) - rng.randint(0, 20)]]
        rows.append((i, "".join(parts)))
    return rows + [(100, rows[3][1]), (101, None), (102, ""), (103, "a" * 300), (104, "ab" * 150), (3, rows[3][1]), (None, rows[5][1]), (105, "é" * 90)]


@pytest.mark.parametrize("seed,letters,window", [(1, "abcdefgh", 20), (2, "ab", 12), (3, "abéß ", 33)])
def test_against_brute_force(spark, seed, letters, window):
    rows = corpus(seed, letters)
    assert run(spark, rows, length=48, window=window, gram=8) == brute(rows, 48)


def test_default_length(spark):
    rng = random.Random(5)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    p = word(700)
    rows = [(i, word(300) + p[i * 20 : 420 + i * 30] + word(300)) for i in range(10)] + [(90, word(399)), (91, "z" * 401), (92, "z" * 399)]
    rows += [(93, rows[0][1]), (94, p[:400]), (95, p[:399])]
    assert run(spark, rows) == brute(rows, 400)


def test_long_texts_are_hashed_in_pieces(spark):
    rng = random.Random(6)
    word = lambda k: "".join(rng.choice("abcd") for _ in range(k))
    p = word(200)
    rows = [(1, word(900) + p + word(1500) + p[:60] + word(700)), (2, "ab" * 900 + p), (3, word(100) + p[40:190])]
    assert run(spark, rows, length=48, window=20, gram=8, piece=300) == brute(rows, 48)


def test_rows_repeated_many_times(spark):
    rng = random.Random(7)
    word = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    p, q = word(600), word(3000)
    rows = [(1, word(200) + p[:450] + word(100)), (2, word(900)), (3, q[500:1000] + word(50)), (None, word(500)), (4, word(30) + p[100:])]
    rows += [(None, p)] * 40 + [(7, "short")] * 30 + [(None, None)] * 20 + [(8, q)] * 25 + [(9, q)] + [(None, word(450))]
    assert run(spark, rows) == brute(rows, 400)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    many = spark.range(10_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(q).alias("text"))
    got = sd.remove_repeats(many).groupBy("n_bytes", F.size("spans").alias("n"), F.octet_length("kept").alias("left")).count().collect()
    assert [tuple(r) for r in got] == [(3000, 1, 0, 10_000)] and spark.conf.get("spark.sql.adaptive.enabled") == before


def test_covered_runs():
    a, b = sd.covered(np.array([50, 0, 3]), np.array([50, 1, 4]), 10)
    assert a.tolist() == [0, 50] and b.tolist() == [14, 60]


def test_nothing(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 0, 0, b"")]
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
