import random
import zlib

import numpy as np
import pytest

from triadic.llm import language_id as lid

DOCS = "doc_id long, text string, lang string, source string, score double"
WORDS = {"aa": "the and of ing tion her".split(), "bb": "der die und ung keit ich".split(), "cc": "que de la ción los mente".split()}


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 60))), lang, "s", 0.0))
    return rows


def test_held_out_accuracy_and_edge_rows(spark):
    rows = corpus() + [(9001, None, "aa", "s", 0.0), (9002, "123 -- 456", "bb", "s", 0.0), (9003, "", None, "s", 0.0), (None, "und die der keit ung", None, "s", 0.0), (9004, "the and " * 50000, "zz" if False else "aa", "s", 0.0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    model = lid.fit(df)
    assert model.languages == ["aa", "bb", "cc"] and 0.05 < model.temperature < 20
    assert (model.weights == 0).mean() > 0.5  # sparse
    got = {r.doc_id: r for r in lid.predict(df, model).collect()}
    assert len(got) == len(rows)
    out = [(r[2], got[r[0]].lang_pred) for r in rows[:600] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(out) > 80 and np.mean([a == b for a, b in out]) > 0.98
    for i in (9001, 9002, 9003):
        assert (got[i].lang_pred, got[i].score) == (lid.UNKNOWN, 0.0)
    assert got[None].lang_pred == "bb" and got[9004].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_documents_teach_nothing(spark):
    rows = corpus(300)
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    poisoned = [(i, t, "zz" if out(i) else lang, s, x) for i, t, lang, s, x in rows]
    a, b = (lid.fit(spark.createDataFrame(r, DOCS)) for r in (rows, poisoned))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_every_language_is_learned(spark):
    rng = random.Random(7)
    langs = [f"l{k:02}" for k in range(70)]
    words = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüéßñ") for _ in range(6)) for _ in range(4)] for x in langs}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(12)), x, "s", 0.0) for i, x in enumerate(langs * 8 + langs[:60] * 4)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    model = lid.fit(df, buckets=1 << 12)
    assert model.languages == langs
    got = {r.doc_id: r.lang_pred for r in lid.predict(df, model).collect()}
    rare = [r for r in rows if r[2] in langs[60:]]
    assert np.mean([got[r[0]] == r[2] for r in rare]) > 0.9


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None, "s", 0.0)], DOCS)
    assert lid.fit(df) is None
    assert [tuple(r) for r in lid.predict(df, None).collect()] == [(1, lid.UNKNOWN, 0.0)]
    empty = df.where("doc_id < 0")
    assert lid.predict(empty, lid.fit(empty)).count() == 0


def test_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Ünïcode text\n with ßome 123 " * 20
    whole = lid.term_counts(text, 1 << 10)
    monkeypatch.setattr(lid, "PIECE", 7)
    assert np.array_equal(whole, lid.term_counts(text, 1 << 10))
    assert whole.sum() == 3 * len(text) - 3


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 500)
    logits = 8 * (np.eye(3)[y] + rng.normal(size=(500, 3)))
    t = lid.best_temperature(logits, y)
    loss = lambda t: -np.log(lid.softmax(logits / t)[np.arange(500), y]).mean()
    assert loss(t) <= min(loss(1.0), loss(t * 1.1), loss(t / 1.1)) + 1e-9
    assert lid.best_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_ftrl_learns_a_separable_problem():
    ex = [(np.array([i % 3, 4]), np.array([1.0, 1.0])) for i in range(90)]
    w = lid.ftrl(ex, np.array([i % 3 for i in range(90)]), 4, 3)
    assert w.shape == (5, 3) and all((x @ w[at]).argmax() == i % 3 for i, (at, x) in enumerate(ex))
    assert (w[3] == 0).all()
    assert pytest.approx(1.0) == lid.softmax(w[:1]).sum()
