import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from test_exact_mix_secrets import targets
from test_jaccard_join import brute as near_brute

from triadic.llm import sampled_pieces


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(8)
    words = {"en": "the and of ing tion her with".split(), "de": "der die und ung keit ich sch".split()}
    rows = []
    for i in range(400):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choice(words[lang]) + rng.choice(words[lang]) for _ in range(rng.randint(20, 80))), lang, f"s{i % 4}" if i % 5 else None, 0))
    rows += [(500 + i, rows[i * 7][1].replace(" ", "  ", 3), "en", "s0", 0) for i in range(30)]
    rows += [(600 + i, rows[i * 5][1] + " extra words", "en", "s1", 0) for i in range(30)]
    rows += [(700, None, "en", "s0", 0), (701, "12 34", "de", "s0", 0), (702, "", None, None, 0), (3, rows[3][1], rows[3][2], rows[3][3], 0)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_each_stage_does_its_job(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = [tuple(r) for r in docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = [tuple(r) for r in docs.collect()]
        if name != "sentencepiece":
            assert docs.columns == columns and set(after) <= set(before)
        if name == "language_id":
            assert Counter(before) - Counter(after) == Counter(r for r in before if r[0] in (700, 701, 702))
        elif name == "exact_dedup":
            least = {}
            for r in before:
                key = " ".join(r[1].split())
                least[key] = min(least.get(key, r), r)
            assert sorted(after) == sorted(least.values())
        elif name == "ngram_jaccard_join":
            groups = near_brute([(r[0], r[1]) for r in before], 0.8)
            assert sorted(r[0] for r in after) == sorted(d for d, c, _, _ in groups if d == c)
        elif name == "mixing":
            sizes, taken = Counter(), Counter()
            for r in before:
                sizes[r[3]] += len(r[1].split())
            for r in after:
                taken[r[3]] += len(r[1].split())
            assert max(Counter(after).values()) <= 2
            for s, t in targets(sizes).items():
                assert abs(taken[s] - t) <= 80
        before = after if name != "sentencepiece" else before
    back = sampled_pieces.decode(docs.select("doc_id", "ids"))
    assert Counter(tuple(r) for r in back.collect()) == Counter((r[0], r[1]) for r in before)


def test_run_agrees_with_itself(spark, sf_dir):
    once, twice = (Counter((r.doc_id, bytes(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert once == twice and len(once) > 200


def test_columns_of_any_name_pass_through(spark, sf_dir, tmp_path):
    names = ["score", "lang_pred", "shards", "position", "size", "h", "name", "cid", "ids", "n_pieces", "class", "mark", "a.b", "__own", "__id", "__size", "__shard", "row", "id", "at", "x y", "gone_id"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", *[f"doc_id * {i} AS `{n}`" for i, n in enumerate(names)])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if name == "sentencepiece":
            assert out.columns == [c for c in docs.columns if c not in ("text", "ids", "n_pieces")] + ["n_pieces", "ids"]
            assert out.count() == docs.count()
        else:
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            assert docs.where("size <> doc_id * 4").count() == 0 < docs.count()


def test_no_different_text_is_lost(spark, tmp_path):
    """Rows without doc_id, and rows that share one, are told apart by their texts in every stage."""
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("the and of ing tion her with over under about".split()) + rng.choice("abcdefgh") for _ in range(30))
    rows = [(None, text(), "en", "s0", 0) for _ in range(300)] + [(i // 3, text(), "en", f"s{i % 2}", 0) for i in range(300)]
    rows += [(None, rows[0][1], "en", "s0", 0)] * 20 + [(1, rows[400][1], "en", "s1", 0), (5, rows[7][1], "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    texts = {r[1] for r in rows}
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, "")
        assert {r.text for r in docs.collect()} == texts
    assert docs.count() == len(texts)
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(r.text.split())
    out = corpus_pipeline.STAGES[3][1](spark, docs, "")
    taken, often = Counter(), Counter()
    for r in out.collect():
        taken[r.source] += len(r.text.split())
        often[(r.doc_id, r.text)] += 1
    assert max(often.values()) <= 2
    for s, t in targets(sizes).items():
        assert abs(taken[s] - t) <= 30


def test_empty_and_wordless_documents(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n", None, "b", 0)]
    for k, part in enumerate((rows, [])):
        docs = spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long")
        for _, stage in corpus_pipeline.STAGES[1:4]:
            assert stage(spark, docs, "").columns == docs.columns
        assert corpus_pipeline.STAGES[0][1](spark, docs, "").count() == 0
        assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() == len(part)
