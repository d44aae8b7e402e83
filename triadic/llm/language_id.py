"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are character n-grams of 1 to 3 characters of the text in small letters, hashed to `buckets`
columns. Document frequencies are counted over all training documents, on the executors. Weights are
trained with follow-the-regularised-leader (proximal), whose L1 part keeps them sparse and whose L2 part
keeps them small, and the scores are then divided by a temperature that minimises the log loss on
documents that the weights were not trained on.

Training reads only the text and the non-null language of documents whose crc32(doc_id) mod 5 is not 0.
The classifier is fitted on a bounded sample of them: about `per_language` documents of each language (the
bound; those whose hashed doc_id and text fall below the language's share), `calibration` of them set aside for
the temperature. Every language that occurs is learned. Prediction reads the text alone,
all of it.

A text that is null or has no letter gets `und` with score 0; so does every text when there is nothing to
learn from. Ties go to the language first in code-point order. Repeated rows and null doc_ids are predicted
like any other row (a null doc_id is never used for training and is not held out). Other columns are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from triadic.llm.common import clean_text, map_arrow, mix64, quoted, short_batches

UNKNOWN = "und"
BUCKETS, PER_LANGUAGE, CALIBRATION, FOLDS = 1 << 14, 1500, 0.2, 5
ALPHA, BETA, L1, L2, EPOCHS, SEED = 0.5, 1.0, 1e-4, 1e-5, 4, 11
#: Texts are hashed in pieces of so many characters, which bounds memory for texts of any length.
PIECE = 1 << 20


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, with the document frequencies' weights multiplied in
    idf: np.ndarray
    bias: np.ndarray
    temperature: float


def term_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of the small letters of text, over the whole text."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(buckets, np.int64)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for a in range(0, len(points), PIECE):
        c = points[a : a + PIECE + 2]
        own = min(PIECE, len(points) - a)
        h = c * np.uint64(0x9E3779B97F4A7C15)
        two = h[:-1] * np.uint64(0xBF58476D1CE4E5B9) + h[1:]
        three = two[:-1] * np.uint64(0x94D049BB133111EB) + h[2:]
        grams = np.concatenate([g[:own] + np.uint64(k) for k, g in enumerate((h, two, three))])
        counts += np.bincount((mix64(grams) >> shift).astype(np.int64), minlength=buckets)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out(folds: int = FOLDS):
    return F.crc32(F.col("doc_id").cast("string")) % folds == 0


def _document_frequencies(training: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """Over all training documents; a task sends its buckets' counts, so what meets is bounded by buckets times tasks."""

    def count(batches):
        import pyarrow as pa

        df, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                df += term_counts(text.as_py() or "", buckets) > 0
                n += 1
        if n:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], n])], ["bucket", "docs"])

    sums = training.select("text").mapInArrow(count, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).collect()
    out, n = np.zeros(buckets), 0
    for r in sums:
        if r.bucket < 0:
            n = r.docs
        else:
            out[r.bucket] = r.docs
    return out, n


def _sample(training: DataFrame, counts: dict[str, int], per_language: int, buckets: int, seed: int):
    """(language number, hash, buckets, counts) of the sampled documents; features are made on the executors."""
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))]), F.col("lang"))

    def featured(batches):
        import pyarrow as pa

        for batch in batches:
            at, what = [], []
            for text in batch.column(2):
                c = term_counts(text.as_py() or "", buckets)
                nz = np.flatnonzero(c)
                at.append(nz.astype(np.int32))
                what.append(c[nz].astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(what, pa.list_(pa.float32()))], ["lang", "place", "at", "what"])

    chosen = training.select("lang", F.xxhash64(F.lit(seed + 1), "doc_id").alias("place"), "text").where(place < share)
    return chosen.mapInArrow(featured, "lang string, place long, at array<int>, what array<float>").toArrow()


class Examples:
    """Sampled documents in order of their hash, as (columns with the bias, unit vector of TF-IDF with 1); made when asked for, so that the sample is held once."""

    def __init__(self, rows, idf: np.ndarray):
        import pyarrow.compute as pc

        self.order = pc.sort_indices(rows, sort_keys=[("place", "ascending"), ("lang", "ascending")]).to_numpy()
        self.langs = rows["lang"].to_pylist()
        at, what = rows["at"].combine_chunks(), rows["what"].combine_chunks()
        self.ends, self.at, self.what, self.idf = at.offsets.to_numpy(), at.values.to_numpy(), what.values.to_numpy(), idf

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.ends[self.order[i]], self.ends[self.order[i] + 1]
        at = self.at[a:b]
        x = self.what[a:b] * self.idf[at]
        norm = np.sqrt((x * x).sum())
        return np.r_[at, len(self.idf)], np.r_[x / norm if norm else x, 1.0]

    def lang(self, i: int) -> str:
        return self.langs[self.order[i]]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(examples, targets: np.ndarray, buckets: int, classes: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2, epochs=EPOCHS):
    """FTRL-proximal with elastic net for multinomial logistic regression; examples are (columns, values), in a list or given by a call for each epoch. The last column is the bias, which no penalty holds."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        return w

    eye = np.eye(classes)
    for _ in range(epochs):
        for (at, x), y in zip(examples() if callable(examples) else examples, targets):
            w = weights(at)
            g = np.outer(x, softmax(x @ w) - eye[y])
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
            n[at] = after
    return weights(np.arange(buckets + 1))


def best_temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """Least log loss over temperatures, by golden-section search on their logarithm."""
    if not len(targets):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(targets)), targets], 1e-300)).mean()

    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(docs: DataFrame, buckets: int = BUCKETS, per_language: int = PER_LANGUAGE, calibration: float = CALIBRATION, folds: int = FOLDS, seed: int = SEED) -> Model | None:
    """None where there is nothing to learn from."""
    import pyarrow as pa

    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    short_batches(docs.sparkSession)
    training = docs.where(~held_out(folds) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", clean_text().alias("text"))
    counts = {r.lang: r.n for r in training.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    names = sorted(counts)
    df, n = _document_frequencies(training, buckets)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    examples = Examples(_sample(training.where(F.col("lang").isin(names)), counts, per_language, buckets, seed), idf)
    n = len(examples)
    targets = np.array([names.index(examples.lang(i)) for i in range(n)], np.int64)
    aside = int(n * calibration) if n >= 10 else 0
    fitted = range(aside, n)
    w = ftrl(lambda: (examples[i] for i in fitted), targets[aside:], buckets, len(names)) if n else np.zeros((buckets + 1, len(names)))
    logits = np.array([x @ w[at] for at, x in (examples[i] for i in range(aside))]).reshape(-1, len(names))
    del examples
    pa.default_memory_pool().release_unused()
    return Model(names, w[:-1] * idf[:, None], idf, w[-1], best_temperature(logits, targets[:aside]))


def predict_one(model: Model | None, text: str | None) -> tuple[str, float]:
    if model is None or not has_letter(text):
        return UNKNOWN, 0.0
    c = term_counts(text, len(model.idf))
    at = np.flatnonzero(c)
    x = c[at].astype(np.float64)
    norm = np.sqrt(((x * model.idf[at]) ** 2).sum())
    p = softmax((x @ model.weights[at] / norm + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(min(1.0, p[best]))


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs, and the columns named in keep (not those three)."""
    short_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(batches):
        import pyarrow as pa

        own = shipped.value
        for batch in batches:
            out = [predict_one(own, t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())],
                [*batch.schema.names[1:], "lang_pred", "score"],
            )

    chosen = docs.select("text", "doc_id", *[F.col(quoted(c)) for c in keep])
    more = StructType.fromDDL("lang_pred string, score double").fields
    return map_arrow(chosen, run, StructType([*chosen.schema.fields[1:], *more]))


def recognised(docs: DataFrame, model: Model | None, least_score: float = 0.0) -> DataFrame:
    """The rows of docs whose language is told with least_score at least, with docs' columns, whatever their names."""
    short_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            told = [predict_one(shipped.value, t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in told], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
