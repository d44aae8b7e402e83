"""Each registered query on a small folder of tables: its columns, their types, and its values against plain Python."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_exact_mix_secrets import plain_base, targets
from test_jaccard_join import brute as near_brute
from test_line_dedup import brute as lines_brute
from test_substring_dedup import brute as repeats_brute

from triadic.llm import packing, sampled_pieces
from triadic.llm.registry import QUERIES

KINDS = ("assign", "access", "hex", "guess")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = {"en": "the and of ing tion her with".split(), "de": "der die und ung keit ich sch".split()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(words[lang]) for _ in range(n))
    passage = text("en", 90)
    out = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        body = text(lang, rng.randint(5, 60))
        if i % 9 == 0:
            body += "\n" + passage + "\n" + text(lang, 10)
        if i % 11 == 0:
            body += " password=" + "".join(rng.choices("abcdef0123456789", k=30)) + ' token: "k8!Qz#77vLp0"'
        out.append((i, body, lang, f"s{i % 4}" if i % 5 else None, 0))
    out += [(200 + i, out[i * 3][1].replace(" ", "  ", 2), "en", "s0", 0) for i in range(12)]
    out += [(220 + i, out[i * 4 + 1][1] + " more", "en", "s1", 0) for i in range(12)]
    return [*out, (300, None, "en", "s0", 0), (301, "", None, "s1", 0), (302, "12 34\n\n12 34\nab", "de", "s2", 0), (303, "é\n" * 300, "de", "s2", 0)]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    rng = np.random.default_rng(4)
    vectors = [(i, v.tolist(), 0) for i, v in enumerate(rng.standard_normal((300, 16)).round(1))]
    vectors += [(400, None, 0), (500, [0.0] * 16, 0), (600, [float("nan")] * 16, 0), (700, vectors[100][1], 0), (None, vectors[3][1], 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def run(spark, sf_dir, name, types):
    out = QUERIES[name](spark, sf_dir)
    assert dict(out.dtypes) == types
    return out.collect()


def test_op1(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op1_suffix_array_dedup", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"})
    want = [(d, n, gone, spans, hashlib.sha256(kept).hexdigest()) for d, n, gone, spans, kept in repeats_brute([r[:2] for r in rows], 400)]
    assert sorted(map(tuple, got)) == sorted(want) and any(r.n_removed for r in got)


def test_op2(spark, sf_dir, rows):
    types = {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint", "repeats": "int", "shards": "array<int>", "position": "bigint"}
    got = run(spark, sf_dir, "op2_mixing", types)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source, sizes, taken = {r[0]: r[3] for r in rows}, Counter(), Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((r[0], size(r[1])) for r in rows)
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 100 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, QUERIES["op2_mixing"](spark, sf_dir).collect()))


def test_op3(spark, sf_dir):
    got = run(spark, sf_dir, "op3_nearest_neighbours", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"})
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.score, r.vec_id))
    known = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect() if r.vec_id is not None and r.vec_id not in (400, 500, 600)}
    assert set(found) == {0, 100, 200, 700}
    for q, near in found.items():
        want = sorted((float(np.sqrt(((v - known[q]) ** 2).sum())), i) for i, v in known.items() if i != q)[:10]
        assert [i for _, i in near] == [i for _, i in want] and [s for s, _ in near] == pytest.approx([s for s, _ in want], abs=1e-12)


def test_op4(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op4_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    told = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for d, t, lang, _, _ in rows:
        r = told[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(map(str.isalpha, t or "")):
            assert r.lang_pred == "und"
        elif d < 160 and d % 9:
            assert r.lang_pred == lang


def test_op5(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op5_ngram_jaccard_join", {"doc_id": "bigint", "class_id": "bigint", "set_id": "bigint", "n_links": "bigint", "kept": "boolean"})
    assert sorted((r.doc_id, r.class_id, r.set_id, r.n_links) for r in got) == sorted(near_brute([r[:2] for r in rows], 0.8))
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_op6(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op6_line_dedup", {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "n_kept": "bigint", "stays_sha256": "string"})
    long = {r[0]: sum(len(x) >= 1 for x in (r[1] or "").split("\n")) for r in rows}
    want = [(d, n, long[d] - len(stays), n - long[d] + len(stays), hashlib.sha256(",".join(map(str, stays)).encode()).hexdigest()) for d, n, stays in lines_brute([r[:2] for r in rows])]
    assert sorted(map(tuple, got)) == sorted(want)


def test_op7(spark, sf_dir, rows):
    types = {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string", "n_guess": "bigint"}
    told = {r.doc_id: r for r in run(spark, sf_dir, "op7_secret_scans", types)}
    for d, t, *_ in rows:
        base = sorted(plain_base(t or ""))
        listed = [f"{KINDS[k]}:{a}:{b}" for a, k, b in base]
        r = told[d]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("guess")] == listed and len(spans) == len(listed) + r.n_guess
    assert sum(r.n_guess for r in told.values()) and sum(r.n_assign for r in told.values())


def test_op8(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op8_exact_dedup", {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"})
    groups, norm = defaultdict(list), {r[0]: re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows}
    for d, t in norm.items():
        groups[t].append(d)
    assert sorted(map(tuple, got)) == sorted((d, min(groups[t]), len(groups[t]), d == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for d, t in norm.items())


def test_op9(spark, sf_dir, rows):
    packed = QUERIES["op9_token_packing"](spark, sf_dir)
    types = dict(packed.dtypes)
    assert types["ids"] == "binary" and types["cu_seqlens"] == types["resets"] == "array<array<int>>"
    encode = packing.encoder(open(packing.VOCABULARY, "rb").read(), packing.PATTERN)
    want = Counter((r[0], tuple([*encode.encode_ordinary(r[1] or ""), packing.END])) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in packing.unpack(packed).collect()) == want


def test_op10(spark, sf_dir, rows):
    got = run(spark, sf_dir, "op10_sentencepiece", {"doc_id": "bigint", "n_pieces": "bigint", "ids_sha256": "string", "lossless": "boolean"})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = {r.doc_id: r.ids for r in sampled_pieces.encode(docs).collect()}
    assert {r[0]: r[1] for r in rows} == {r.doc_id: r.text for r in sampled_pieces.decode(sampled_pieces.encode(docs)).collect()}
    for r in got:
        assert r.lossless and r.ids_sha256 == (None if ids[r.doc_id] is None else hashlib.sha256(ids[r.doc_id]).hexdigest())
        assert r.n_pieces == len(ids[r.doc_id] or b"") // 2
