import random
import re

import numpy as np
import pytest

from triadic.llm import jaccard_join as jj
from triadic.llm.components import connected_components

DOCS = "doc_id long, text string, source string, cid long, n int"


def sets_of(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()


def brute(rows, threshold):
    sets = [sets_of(t) for _, t in rows]
    n = len(rows)
    label = list(range(n))
    links = [0] * n

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                label[find(i)] = find(j)
    least, same = {}, {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
            same[frozenset(sets[i])] = min(same.get(frozenset(sets[i]), d), d)
    return sorted(((d, least.get(find(i)), same.get(frozenset(sets[i])) if sets[i] else d, links[i]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w = w[rng.randint(0, 5) :] + [word()]
        else:
            w = [word() for _ in range(rng.randint(1, 150))] + passage * (rng.random() < 0.3)
        rows.append((i, " ".join(w)))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "one\ttwo"), (505, "one"), (506, rows[4][1]), (4, rows[4][1]), (None, rows[5][1]), (507, "x y " * 30000)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "s", 0, 1) for d, t in rows], DOCS).repartition(3)
    got = jj.near_duplicates(df, **options)
    return sorted((tuple(r) for r in got.select("doc_id", "class_id", "set_id", "n_links").collect()), key=str)


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"bucket_block": 3, "group_block": 2})])
def test_against_brute_force(spark, seed, options):
    rows = corpus(seed)
    assert run(spark, rows, **options) == brute(rows, 0.8)


def test_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(1000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(len(w))] = f"v{rng.randrange(20)}"
        w[rng.randrange(len(w))] = f"v{rng.randrange(20)}"
        rows.append((i, " ".join(w)))
    assert run(spark, rows, bucket_block=40, group_block=30) == brute(rows, 0.8)


def test_chain_of_near_copies(spark, monkeypatch):
    """Each text is near its neighbours only, so pairs that share a bucket are verified, not all."""
    rng = random.Random(10)
    words = [f"w{rng.randrange(10_000)}" for _ in range(1500)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 150])) for i in range(200)] + [(300, " ".join(words[60:210])), (301, "else " * 9)]
    seen = []
    found = jj._sparse_pairs
    monkeypatch.setattr(jj, "_sparse_pairs", lambda *a: seen.append(found(*a)) or seen[-1])
    assert run(spark, rows, group_block=8) == brute(rows, 0.8)
    assert seen[0] is not None and 397 <= seen[0][1].count() < 200 * 25 / 2


def test_many_rows_without_id(spark):
    rows = [(None, f"text number {i} " + " ".join(f"w{(i * 7 + k) % 997}" for k in range(12))) for i in range(5000)] + [(None, "the same words " * 10)] * 800
    got = run(spark, rows)
    assert len(got) == 5800 and sum(r[3] for r in got) >= 800 * 799


def test_long_chains_and_stars_of_components(spark):
    rng = random.Random(2)
    order = list(range(3000))
    rng.shuffle(order)
    edges = list(zip(order, order[1:])) + [(5000, 5000 + i) for i in range(1, 2000)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).groupBy("component").count().collect()
    assert sorted(map(tuple, got)) == [(0, 3000), (5000, 2000)]


def test_keep_one_and_nothing(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(d, t, "s", 0, 1) for d, t in rows if d != 4 or t is None], DOCS)
    kept = jj.keep_one(df)
    assert kept.columns == df.columns
    want = [d for d, c, _, _ in brute([r for r in rows if r[0] != 4], 0.8) if d == c]
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))
    assert run(spark, []) == [] and run(spark, [(1, None)]) == [(1, 1, 1, 0)]


def test_keep_one_without_and_with_repeated_ids(spark):
    rng = random.Random(6)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(1000)}" for _ in range(80)) for _ in range(5))
    near = lambda t: t + " more"
    rows = [(None, a), (1, near(a)), (None, b), (None, near(b)), (None, c), (None, None), (None, "")]
    rows += [(7, d), (7, e), (3, near(d)), (8, near(e)), (9, "one two")]
    df = spark.createDataFrame([(i, t, "s", 0, 1) for i, t in rows], DOCS).repartition(3)
    kept = [(r.doc_id, r.text) for r in jj.keep_one(df).collect()]
    alone = [(1, near(a)), (None, c), (None, None), (None, ""), (3, near(d)), (7, e), (9, "one two")]
    of_b = [r for r in kept if r in ((None, b), (None, near(b)))]
    assert len(of_b) == 1
    assert sorted(map(str, kept)) == sorted(map(str, alone + of_b))


def test_pruning_plan_keeps_pairs_at_the_threshold():
    plan = jj.least_matches(175, 35, 0.8, 1e-9)
    assert [k for k, _ in plan] == [35, 70, 105, 140, 175]
    rng = np.random.default_rng(0)
    for k, need in plan:
        assert (rng.binomial(k, 0.8, 200000) >= need).mean() > 1 - 1e-4
        assert need > 0.4 * k or k == 35


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            label[b] = a
    want = sorted((x, find(x)) for x in label)
    assert sorted(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect())) == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_of_a_large_group_are_few(spark, monkeypatch):
    """Near copies meet in most of their buckets; what is handed on connects each of them few times, and as brute force does."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(300):
        own = list(words)
        own[rng.integers(120)] = f"x{i}"
        texts.append(" ".join(own))
    seen, plain = [], jj.connected_components

    def counted(edges):
        seen.append(edges.count())
        return plain(edges)

    monkeypatch.setattr(jj, "connected_components", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = jj.near_duplicates(docs).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {299}
    assert len(seen) == 2 and max(seen) <= 300


def test_forest_connects_the_same():
    rng = np.random.default_rng(12)
    for n, m in ((1, 0), (50, 20), (50, 60), (2000, 1999)):
        a, b = (rng.integers(0, n, m), rng.integers(0, n, m)) if m != 1999 else (rng.permutation(2000)[:-1], None)
        if b is None:  # a chain in any order
            order = rng.permutation(2000)
            a, b = order[:-1], order[1:]
        label = list(range(n))
        for _ in range(n):
            before = list(label)
            for x, y in zip(a, b):
                label[x] = label[y] = min(label[x], label[y])
            if label == before:
                break
        x, root = jj.forest(a, b)
        assert {(int(i), int(r)) for i, r in zip(x, root)} == {(i, r) for i, r in enumerate(label) if i != r}
