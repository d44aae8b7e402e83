import base64
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from triadic.llm import packing, sampled_pieces
from triadic.llm.common import mix64

DOCS = "doc_id long, text string, ids string, mark string, n_pieces string"
TEXTS = ["Hello, world! It's 12 é", "", None, "a" * 3000, "word " * 2000, "\n\n  x\t", "<|endoftext|> plain", "日本語 text", "▁under  score▁ \u0000 �", "x"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOCS)


def plain_best_fit(lengths, capacity):
    rows, left = [], []
    for item, n in enumerate(lengths):
        fit = [r for r in range(len(rows)) if left[r] >= n > 0]
        if fit:
            room = min(left[r] for r in fit)
            left[next(r for r in fit if left[r] == room)] -= n
        else:
            rows.append(item)
            left.append(capacity - n)
    return sorted(left)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 100])
    lengths = sorted((rng.randint(1, capacity) for _ in range(200)), reverse=True)
    rows, left = packing.best_fit_decreasing(lengths, capacity)
    assert sorted(i for r in rows for i in r) == list(range(200))
    assert [capacity - sum(lengths[i] for i in r) for r in rows] == left and min(left) >= 0
    assert sorted(left) == plain_best_fit(lengths, capacity)


@pytest.mark.parametrize("options", [{}, {"capacity": 50, "matrix_rows": 3, "window_tokens": 400, "bucket_chars": 5000}, {"capacity": 50, "end": None}, {"capacity": 50, "window_tokens": 400, "bucket_chars": None}])
def test_packing_round_trip(spark, options):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (50, TEXTS[0])]
    packed = packing.pack(frame(spark, rows).repartition(2), **options)
    capacity = options.get("capacity", packing.CAPACITY)
    end = options.get("end", packing.END)
    encode = packing.encoder(open(packing.VOCABULARY, "rb").read(), packing.PATTERN)
    want = Counter()
    for i, t in rows:
        ids = encode.encode_ordinary(t or "") + ([end] if end is not None else [])
        if ids:
            want[(i, tuple(ids))] += 1
    got = Counter((r.doc_id, tuple(r.ids)) for r in packing.unpack(packed).collect())
    assert got == want
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u2").reshape(r.n_rows, capacity)
        for k in range(r.n_rows):
            cu = r.cu_seqlens[k]
            assert cu[0] == 0 and cu[-1] <= capacity and r.resets[k] == cu[:-1]
            assert (ids[k, cu[-1] :] == packing.PAD).all()
            own = [s for s in r.segments if s.row == k]
            assert [s.start for s in own] == cu[:-1] and [s.start + s.length for s in own] == cu[1:]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(packing.VOCABULARY, "rb"))}
    assert all(bytes([b]) in ranks for b in range(256))  # every text can be written


def test_packing_does_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = [(i // 2 if i % 5 else None, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 200)))) for i in range(300)] + [(7, "same text")] * 5
    options = {"capacity": 64, "matrix_rows": 4, "window_tokens": 5000, "bucket_chars": 20_000}
    shape = lambda df: sorted((bytes(r.ids), str(r.segments)) for r in packing.pack(df, **options).collect())
    assert shape(frame(spark, rows).repartition(1)) == shape(frame(spark, rows[::-1]).repartition(7))


def test_ids_of_text_may_be_empty(spark):
    rows = [("", "one"), (None, "two"), ("b", "three"), ("", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for options in ({}, {"bucket_chars": None}):
        assert sorted((r.doc_id for r in packing.unpack(packing.pack(df, **options)).collect()), key=str) == ["", "", None, "b"]


def test_nothing_packed(spark):
    assert packing.pack(frame(spark, [])).count() == 0
    assert packing.unpack(packing.pack(frame(spark, []))).count() == 0


@pytest.fixture(scope="module")
def model():
    return sampled_pieces.load(sampled_pieces.MODEL)


def test_pieces_round_trip(spark):
    rng = random.Random(1)
    odd = ["".join(rng.choice(["a", "the", " ", "\n", "é", "▁", "😀", "ß", "\t", "日", "Ω", "ing"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    rows = list(enumerate(TEXTS + odd)) + [(None, "no id"), (3, TEXTS[3])]
    df = frame(spark, rows).repartition(3)
    got = sampled_pieces.encode(df.withColumnRenamed("ids", "other").drop("n_pieces"), check=True)
    assert got.columns == ["doc_id", "other", "mark", "n_pieces", "ids", "lossless"]
    back = sampled_pieces.decode(got)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter(rows)
    assert got.where("NOT lossless").count() == 0
    again = sampled_pieces.encode(frame(spark, rows[::-1]).select("doc_id", "text"))
    first = Counter((r.doc_id, bytes(r.ids) if r.ids is not None else None) for r in got.collect())
    assert first == Counter((r.doc_id, bytes(r.ids) if r.ids is not None else None) for r in again.collect())
    other = sampled_pieces.encode(frame(spark, rows).select("doc_id", "text"), seed=99)
    assert first != Counter((r.doc_id, bytes(r.ids) if r.ids is not None else None) for r in other.collect())
    assert sampled_pieces.encode(frame(spark, []).select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("alpha", [0.0, 0.6])
def test_samples_follow_the_weights_of_segmentations(model, alpha):
    lattices = sampled_pieces.Lattices(model, alpha, 1.0)
    weights = {t: -alpha * np.log(max(r, 0) + 1.0) for t, _, r in model["pieces"]}
    ids = {t: i for t, i, _ in model["pieces"]}
    unit = "▁there"
    exact = {}
    for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
        parts, at = [], 0
        for k, c in enumerate(cuts, 1):
            if c:
                parts.append(unit[at:k])
                at = k
        parts.append(unit[at:])
        if all(p in weights for p in parts):
            exact[tuple(ids[p] for p in parts)] = np.exp(sum(weights[p] for p in parts))
    total = sum(exact.values())
    n = 40000
    out, count = lattices.encode([" there"] * n, mix64(np.arange(n, dtype=np.uint64)))
    ends = np.cumsum(np.r_[0, count])
    seen = Counter(tuple(out[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:]))
    assert set(seen) <= set(exact) and len(exact) > 5
    for s, w in exact.items():
        p = w / total
        assert abs(seen[s] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-4


def test_long_units(model):
    lattices = sampled_pieces.Lattices(model, 0.5, 1.0)
    texts = ["x" * 20000, "ab" * 500 + " " + "é" * 300, ""]
    out, count = lattices.encode(texts, np.arange(3, dtype=np.uint64))
    ends = np.cumsum(np.r_[0, count])
    assert [lattices.decode(out[a:b]).decode() for a, b in zip(ends[:-1], ends[1:])] == texts


def test_stretches_and_portions_change_nothing(model):
    rng = random.Random(9)
    unit = lambda k: "".join(rng.choice(["a", "the", "ing", "é", "▁", "😀", "x", "日", "str"]) for _ in range(k))
    texts = [unit(3000), " " + unit(500) + " ab  c " + unit(900), unit(40) + " x", "", " ", "".join(unit(3) + " " for _ in range(600))]
    keys = mix64(np.arange(len(texts), dtype=np.uint64))
    whole, count = sampled_pieces.Lattices(model, 0.5, 1.0).encode(texts, keys)
    for stretch in (64, 200):
        out, n = sampled_pieces.Lattices(model, 0.5, 1.0).encode(texts, keys, stretch=stretch)
        assert (out == whole).all() and (n == count).all()
    ends = np.cumsum(np.r_[0, count])
    for text, key, a, b in zip(texts, keys, ends[:-1], ends[1:]):
        if text:
            assert (sampled_pieces.Lattices(model, 0.5, 1.0).encode_long(text, key, 100) == whole[a:b]).all()


def test_columns_of_any_name(spark):
    df = frame(spark, [(1, "a b"), (2, None)]).selectExpr("*", "doc_id AS `a.b`", "doc_id AS `__key`", "doc_id AS `x y`")
    out = sampled_pieces.encode(df)
    assert out.columns == ["doc_id", "mark", "a.b", "__key", "x y", "n_pieces", "ids"] and out.where("`a.b` = doc_id AND __key = doc_id").count() == 2
    assert sorted((r.doc_id, r.text) for r in sampled_pieces.decode(out).collect()) == [(1, "a b"), (2, None)]
