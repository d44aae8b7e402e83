"""Token ids packed into fixed-width matrices, best fit decreasing.

Each text is tokenised (byte-level BPE from a vocabulary file of ranks) and an end token is appended. A
document longer than `capacity` is split into full pieces and a rest, so no token is lost or repeated.
Pieces are sorted by decreasing length and each goes to the open row with the least room that still holds
it; a segment tree over the rooms 0..capacity finds that room in log2(capacity) steps, and rows of one room
are a stack. Rows of `capacity` ids, padded at the end, make matrices of up to `matrix_rows` rows.

A matrix comes with, for each row: the cumulative segment lengths (from 0; what follows the last is
padding), and the columns at which positions start again at 0 (each segment's start); and with each segment's
doc_id, part and place in the document, from which `unpack` restores the token ids.

Which documents share rows follows from the documents alone, not from files or partitions: a hash of doc_id and
text deals them to buckets of about `bucket_chars` characters, which go to tasks whole and in order of (bucket,
doc_id, hash of the text), and a bucket is packed in windows of about `window_tokens` tokens. A task's memory is
bounded by a window and the longest document. Padding is what is left free in the last rows of windows and
buckets. With bucket_chars = None documents are packed where they are read, without a shuffle; the result
then depends on how the input is split.

A null text counts as empty: its segment is the end token alone (without end token, empty documents give
no segment). Ties go by doc_id (null last), then by text. Repeated rows are documents of
their own; those equal in doc_id and text share a bucket, in one window after the other. A document of any
length is split losslessly, held as ids once. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.llm.common import short_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits texts before the merges of this vocabulary, as its readme gives it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CAPACITY, END, PAD, MATRIX_ROWS, WINDOW_TOKENS, BUCKET_CHARS = 2048, 50256, 50256, 64, 1 << 21, 1 << 24

SCHEMA = (
    "n_rows int, capacity int, ids binary, cu_seqlens array<array<int>>, resets array<array<int>>,"
    " segments array<struct<row: int, start: int, length: int, doc_id: {id}, part: int, offset: long, mark: long>>"
)


@functools.lru_cache(2)
def encoder(file: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Rooms:
    """A segment tree over rooms 0..capacity: which rooms have rows, and the least of them that holds n."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _set(self, room: int, value: int) -> None:
        i = room + self.size
        some = self.some
        some[i] = value
        i >>= 1
        while i:
            value = some[2 * i] | some[2 * i + 1]
            if some[i] == value:
                break
            some[i] = value
            i >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        if len(self.rows[room]) == 1:
            self._set(room, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """A row with the least room of n or more, and its room; the row is taken out."""
        some, i = self.some, n + self.size
        if not some[i]:
            while i > 1 and (i & 1 or not some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if some[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self._set(room, 0)
        return row, room


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Items (by number) of each row in the order they were put in, and the rooms left; lengths must not rise and not pass capacity."""
    rooms, rows, left = Rooms(capacity), [], []
    for item, n in enumerate(lengths):
        found = rooms.take(n) if n < capacity else None
        if found is None:
            row, room = len(rows), capacity
            rows.append([])
            left.append(capacity)
        else:
            row, room = found
        rows[row].append(item)
        left[row] = room - n
        if room > n:
            rooms.put(row, room - n)
    return rows, left


def split_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(offset, length) of a document's pieces: full ones and a rest."""
    return [(a, min(capacity, n - a)) for a in range(0, n, capacity)]


def _pack_window(docs: list[tuple], capacity: int, pad: int, matrix_rows: int, dtype):
    """docs: (doc_id, mark, ids), in the order that ties keep -> rows of SCHEMA."""
    pieces = [(n, d, part, a) for d in range(len(docs)) for part, (a, n) in enumerate(split_pieces(len(docs[d][2]), capacity))]
    pieces.sort(key=lambda p: -p[0])
    rows, _ = best_fit_decreasing([p[0] for p in pieces], capacity)
    for r in range(0, len(rows), matrix_rows):
        some = rows[r : r + matrix_rows]
        matrix = np.full((len(some), capacity), pad, dtype)
        lengths, segments = [], []
        for k, items in enumerate(some):
            at, ends = 0, [0]
            for item in items:
                n, d, part, a = pieces[item]
                matrix[k, at : at + n] = docs[d][2][a : a + n]
                segments.append({"row": k, "start": at, "length": n, "doc_id": docs[d][0], "part": part, "offset": a, "mark": docs[d][1]})
                at += n
                ends.append(at)
            lengths.append(ends)
        yield {"n_rows": len(some), "capacity": capacity, "ids": matrix.tobytes(), "cu_seqlens": lengths, "resets": [x[:-1] for x in lengths], "segments": segments}


def pack(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
    capacity: int = CAPACITY,
    end: int | None = END,
    pad: int = PAD,
    matrix_rows: int = MATRIX_ROWS,
    window_tokens: int = WINDOW_TOKENS,
    bucket_chars: int | None = BUCKET_CHARS,
) -> DataFrame:
    """Matrices of packed ids (little-endian, 16 bits if all ids fit, else 32) with what belongs to their rows."""
    short_batches(docs.sparkSession)
    with open(vocabulary, "rb") as f:  # on the driver; a vocabulary is small and goes to the tasks with the job
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    top = max(int(x.split()[1]) for x in file.value.splitlines() if x)
    dtype = np.dtype("<u2" if max(top, end or 0, pad) < 1 << 16 else "<u4")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        encode = encoder(file.value, pattern)
        held, total, now = [], 0, None

        def flush():
            if bucket_chars is None:
                order = sorted(range(len(held)), key=lambda i: (held[i][0] is None, () if held[i][0] is None else (held[i][0],), i))
                held[:] = [held[i] for i in order]
            for row in _pack_window(held, capacity, pad, matrix_rows, dtype):
                yield pa.RecordBatch.from_pylist([row], schema=shape)

        shape = to_arrow_schema(schema)
        for batch in batches:
            for doc_id, mark, text, bucket in zip(*batch.columns):
                bucket = bucket.as_py()
                if bucket != now:
                    yield from flush()
                    held, total, now = [], 0, bucket
                ids = encode.encode_to_numpy(text.as_py() or "", disallowed_special=())
                if end is not None:
                    ids = np.r_[ids, np.uint32(end)]
                if not len(ids):
                    continue
                held.append((doc_id.as_py(), mark.as_py(), ids.astype(dtype)))
                total += len(ids)
                if total >= window_tokens:
                    yield from flush()
                    held, total = [], 0
        yield from flush()

    schema = docs.sparkSession.createDataFrame([], SCHEMA.format(id=id_type)).schema
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    if bucket_chars is None:
        return rows.withColumn("bucket", F.lit(0).cast("long")).mapInArrow(run, schema)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(max(1, -(-chars // bucket_chars)))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_last(), "mark").mapInArrow(run, schema)


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id, mark, ids (array) of each document of a packed table, put together from its pieces; (doc_id, mark) must be unique."""
    id_type = packed.schema["segments"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                rows, capacity = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                raw = batch.column(2)[i].as_py()
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * rows * capacity else "<u4").reshape(rows, capacity).astype(np.int32)
                parts = batch.column(3)[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s["doc_id"] for s in parts], batch.schema.field(3).type.value_type.field("doc_id").type),
                        pa.array([s["mark"] for s in parts], pa.int64()),
                        pa.array([s["part"] for s in parts], pa.int32()),
                        pa.array([ids[s["row"], s["start"] : s["start"] + s["length"]] for s in parts], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "mark", "part", "ids"],
                )

    pieces = packed.select("n_rows", "capacity", "ids", "segments").mapInArrow(run, f"doc_id {id_type}, mark long, part int, ids array<int>")
    whole = pieces.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    return whole.select("doc_id", "mark", F.flatten("parts.ids").alias("ids"))


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes the matrices with their lengths and resets as Parquet; a row group holds whole matrices."""
    packed.write.mode("overwrite").parquet(path)


def op9_token_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
