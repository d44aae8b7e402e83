import random

import pytest

from triadic.llm import line_dedup as ld

DOCS = "doc_id long, text string, line int, at string"


def distance(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute(rows, min_chars=ld.MIN_CHARS, max_edits=1, edit_chars=ld.EDIT_CHARS):
    order = sorted({(d is not None, d or 0, (t or "")) for d, t in rows})
    lines, out = [], {}
    for has, d, t in order:
        stays = []
        for i, line in enumerate(t.split("\n")):
            if len(line) >= min_chars:
                if not any(line == x or (min(len(line), len(x)) >= edit_chars and distance(line, x) <= max_edits) for x in lines):
                    stays.append(i)
                lines.append(line)
        out[(d if has else None, t)] = (len(t.split("\n")), stays)
    return sorted(((d, *out[(d, t or "")]) for d, t in rows), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS).repartition(3)
    return sorted(((r.doc_id, r.n_lines, r.stays) for r in ld.line_decisions(df, **options).collect()), key=str)


def corpus(seed, n=40, letters="abcdé😀 ", low=10, high=70):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(letters) for _ in range(k))
    base = [word(rng.randint(low, high)) for _ in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 8)):
            x = rng.choice(base) if rng.random() < 0.7 else word(rng.randint(low, high))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(x) + 1)
                x = rng.choice([x[:p] + word(1) + x[p:], x[:p] + x[p + 1 :], x[:p] + word(1) + x[p + 1 :]])
            lines.append(x)
        rows.append((i, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, rows[2][1]), (2, rows[2][1]), (None, rows[4][1])]


@pytest.mark.parametrize("seed,edits", [(1, 1), (2, 1), (3, 0)])
def test_against_brute_force(spark, seed, edits):
    rows = corpus(seed)
    assert run(spark, rows, max_edits=edits) == brute(rows, max_edits=edits)
    assert run(spark, rows, max_edits=edits, min_chars=20) == brute(rows, 20, edits)


@pytest.mark.parametrize("seed,edits,min_chars", [(4, 1, 1), (5, 0, 1), (6, 1, 5)])
def test_short_lines_against_brute_force(spark, seed, edits, min_chars):
    rows = corpus(seed, low=1, high=24) + corpus(seed + 10, n=20, letters="ab", low=13, high=19)
    rows = [(i, t) for i, (_, t) in enumerate(rows)] + [(500, "a\nb\n\nab"), (501, "a\n\n"), (None, "a" * 15), (502, "a" * 16), (503, "a" * 17 + "\n" + "a" * 18)]
    for least in {min_chars, 9}:
        assert run(spark, rows, min_chars=min_chars, max_edits=edits, edit_chars=least) == brute(rows, min_chars, edits, least)


def test_short_repeats_go_where_asked(spark):
    rows = [(1, "Les.\nx"), (2, "Les.\nAnd ornd."), (3, "And ornd.\n\nEnd here")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS)
    out = ld.drop_repeated_lines(df, min_chars=1, max_edits=0)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "Les.\nx"), (2, "And ornd."), (3, "\nEnd here")]


def test_runs_of_one_letter_and_long_lines(spark):
    rows = [(i, "a" * n) for i, n in enumerate([19, 20, 21, 22, 24, 25, 40, 41, 300, 301, 303])]
    rows += [(50, "ab" * 400), (51, "ab" * 400 + "a"), (52, "b" + "ab" * 400), (53, "ab" * 200 + "x" + "ab" * 200), (54, "ab" * 200 + "y" + "ab" * 200)]
    assert run(spark, rows) == brute(rows)


def test_texts_that_stay(spark):
    rows = [(1, "short\n" + "x" * 30 + "\n" + "x" * 30), (2, "x" * 31 + "\nshort\n" + "y" * 25), (3, None), (4, "short")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], DOCS)
    out = ld.drop_repeated_lines(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "short\n" + "x" * 30), (2, "y" * 25), (3, None), (4, "")]
    odd = df.selectExpr("*", "doc_id AS id", "doc_id AS stays", "doc_id AS `a.b`", "doc_id AS mark")
    out = ld.drop_repeated_lines(odd, min_chars=20)
    assert out.columns == odd.columns and out.where("NOT (id = doc_id AND stays = doc_id AND `a.b` = doc_id AND mark = doc_id)").count() == 0
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "short\n" + "x" * 30), (2, "short\n" + "y" * 25), (3, None), (4, "short")]


def test_long_texts_are_hashed_in_stretches():
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["\n".join("".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(200)), "x" * 900 + "\n", "\n\n" + "y" * 300 + "\nz\n" + "w" * 500]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0]), pa.array(texts)], ["doc_id", "mark", "text"])
    for text in texts:
        for piece in (1, 7, 100, 450):
            assert "\n".join(ld._stretches(text, piece)) == text
    whole, cut = (pa.Table.from_batches(list(ld._lines(1, 20, 8, piece)([batch]))).to_pydict() for piece in (1 << 18, 100))
    assert whole == cut


def test_nothing(spark):
    assert run(spark, []) == []
