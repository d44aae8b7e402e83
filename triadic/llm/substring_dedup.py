"""Removal of repeated substrings by prefix doubling over sampled suffixes.

Task: find each position of the corpus at which a string of `length` bytes starts that also starts at
another position, and remove every byte that such a string covers.

A suffix array built by prefix doubling ranks all positions by their first h bytes, sorts the pairs (rank
at i, rank at a growing offset from i) into ranks by more bytes, and drops what is unique, until h reaches
the threshold. One sorted row for every byte, round after round, would move many times the input, so here
a row stands for a cell of neighbouring positions, and cells shrink as h grows:

* Anchors. Every window of `window` neighbouring 16-byte grams names its leftmost gram of least hash its
  anchor. Equal strings of `length` bytes have their anchors at equal offsets, so a position i is known by
  its anchor p and the offset p - i, and a repeat can be looked for among anchors without missing any.
* A round has cells of g neighbouring offsets of an anchor: first g = window (all of an anchor's positions),
  then 16, then 1. All strings that start in a cell share their h = length - g + 1 middle bytes. Cells are
  grouped by the rank of these bytes; a cell whose rank is unique is dropped with all its positions.
* Where two cells also agree on the bytes before and after, as far as any of their strings reaches,
  all their positions are repeats: they are settled, and one cell speaks for its class in the next round.
  Classes go on only where another class shares their middle bytes. At g = 1 there is nothing before or after,
  the pair is that of the string's halves, and the threshold is reached.

Ranks are 64-bit polynomial names of bytes instead of dense ranks, and grouping by pairs stands for sorting
them. Two strings count as equal if both names of their pair are: strings that differ in both parts are told
apart by 128 bits, strings that differ in one part by the 64 bits of that part, among those that share the other.

Data moves as follows. Anchors' first names are counted, and anchors whose name is not unique go to their
documents, once, together with the texts (packed by zstd), into a checkpoint in the shared folder that is
partitioned by document. Rounds send names only, and what they decide comes back to that partitioning, so
the texts are not shuffled again. Common passages and large groups of copies add up in partial
aggregates, and joins on names are equi-joins whose hot keys adaptive execution can split.

Texts are UTF-8 bytes, null is empty, and matches never cross documents. Documents are known by a hash of
doc_id (which may be null) and text and a second one of the text. Repeated rows (equal in both) are further
occurrences, so each gets its row, with nothing left if it is long enough; two of them take part in the rounds,
however many there are, as a third would tell nothing new. Texts are hashed in pieces of
bounded size. Input columns other than doc_id and text are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.llm.common import bounded_broadcast, clean_text, cut, in_own_session, mix64, short_batches, slices_by_bytes, utf8_buffer, with_settings

LENGTH, WINDOW, GRAM, PIECE = 400, 200, 16, 1 << 20
#: Offsets in a cell after the first round, whose cells have `window`.
CELLS = (16, 1)
BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = (1 << 22) - 1


class Hashes:
    """Names of any substring of one buffer, from prefix sums of a polynomial modulo 2**64."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)
    _letters = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        if len(Hashes._powers) <= n:
            size = max(n + 1, 1 << 16)
            Hashes._powers = np.cumprod(np.r_[np.uint64(1), np.full(size, BASE, np.uint64)], dtype=np.uint64)
            Hashes._inverse = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(BASE, -1, 2**64), np.uint64)], dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(Hashes._letters[raw] * Hashes._powers[:n], out=self.sums[1:])

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of [start, end); the number of bytes is part of the name."""
        return mix64((self.sums[end] - self.sums[start]) * Hashes._inverse[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:-k]) * Hashes._inverse[:n])


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours: prefix and suffix minima of blocks of w."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(blocks, w)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def anchor_rows(raw: np.ndarray, bounds: np.ndarray, length: int, window: int, gram: int):
    """Anchors of the documents raw[bounds[d]:bounds[d + 1]].

    Gives arrays: document, anchor, first and last start that belong to it (all but the document in bytes
    from the document's start), and the name of the bytes that all strings with this anchor share.
    """
    count = np.maximum(np.diff(bounds) - length + 1, 0)
    if not count.any():
        return None
    sums = Hashes(raw)
    key = sums.grams(gram)
    key = (key & ~np.uint64(_PLACE)) | np.arange(len(key), dtype=np.uint64)
    least = (_sliding_least(key, window) & np.uint64(_PLACE)).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), count)
    start = np.arange(len(doc)) - (np.cumsum(count) - count)[doc] + bounds[:-1][doc]
    anchor = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(start)] - 1
    doc, p, lo, hi = doc[head], anchor[head], start[head], start[tail]
    at = bounds[:-1][doc]
    return doc, p - at, lo - at, hi - at, sums.names(p, p + length - window + 1)


def _long_anchor_rows(raw: np.ndarray, length: int, window: int, gram: int, piece: int):
    """anchor_rows of one long document, in pieces that overlap; an anchor on a border is put together again."""
    n, parts = len(raw), []
    for s in range(0, n - length + 1, piece):
        first, last = max(0, s - window), min(n, s + piece + window + length)
        got = anchor_rows(raw[first:last], np.array([0, last - first]), length, window, gram)
        if got is None:
            continue
        doc, p, lo, hi, name = got
        lo, hi = np.maximum(lo + first, s), np.minimum(hi + first, s + piece - 1)
        keep = lo <= hi
        parts.append([x[keep] for x in (doc, p + first, lo, hi, name)])
    if not parts:
        return None
    doc, p, lo, hi, name = (np.concatenate(x) for x in zip(*parts))
    head = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    tail = np.r_[head[1:], len(p)] - 1
    return doc[head], p[head], lo[head], hi[tail], name[head]


def _scan(length: int, window: int, gram: int, piece: int, name_only: bool):
    """(key, mark, text) -> a row for each anchor."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, bounds = utf8_buffer(batch.column(2))
            for a, b in slices_by_bytes(np.diff(bounds), piece):
                part, own = raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                got = anchor_rows(part, own, length, window, gram) if len(part) <= 2 * piece else _long_anchor_rows(part, length, window, gram, piece)
                if got is None:
                    continue
                doc, p, lo, hi, name = got
                columns, names = [pa.array(name.view(np.int64))], ["name"]
                if not name_only:
                    at = pa.array(doc + a)
                    columns += [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x.astype(np.int32)) for x in (p, lo, hi))]
                    names += ["key", "mark", "p", "lo", "hi"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _pack(batches):
    import pyarrow as pa
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = [squeeze.compress((t.as_py() or "").encode()) for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], ["key", "mark", "doc_id", "packed"])


def _unpacked(value) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(value.as_py())


def cell_rows(raw: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, cell: int, length: int):
    """The cells of `cell` offsets in which starts lo to hi of anchors p lie: p, lo, hi and a pair of names.

    Of cells with one offset the names are those of the two halves of its string; else the first is that of
    the bytes that all strings share, the second that of all bytes before and after them that a string reaches.
    """
    first, last = (p - hi) // cell, (p - lo) // cell
    n = last - first + 1
    row = np.repeat(np.arange(len(p)), n)
    j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
    p, lo, hi = p[row], np.maximum(lo[row], p[row] - j * cell - cell + 1), np.minimum(hi[row], p[row] - j * cell)
    origin = p - j * cell
    begin, end = np.maximum(origin - cell + 1, 0), np.minimum(origin + length, len(raw))
    sums = Hashes(raw)
    shared = origin + length - cell + 1
    # The cell's place is part of its name: the same bytes seen from another anchor hold other starts.
    place = mix64(j.astype(np.uint64))
    if cell == 1:
        return p, lo, hi, sums.names(origin, origin + length // 2) + place, sums.names(origin + length // 2, shared)
    around = sums.names(begin, origin) * np.uint64(3) + sums.names(shared, end)
    return p, lo, hi, sums.names(origin, shared) + place, mix64(around)


def _cells(cell: int, length: int, window: int, piece: int):
    """(key, mark, packed, doubts) -> a row for each cell of the anchors in doubt."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                raw = np.frombuffer(_unpacked(batch.column(2)[i]), np.uint8)
                doubts = batch.column(3)[i].values
                p, lo, hi = (np.asarray(doubts.field(k)).astype(np.int64) for k in ("p", "lo", "hi"))
                order = np.argsort(p, kind="stable")
                p, lo, hi = p[order], lo[order], hi[order]
                limit = max(1, (1 << 18) * cell // window)  # anchors whose cells are written at once
                for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(p // piece)) + 1):
                    for c in range(0, len(part), limit):
                        k = part[c : c + limit]
                        # One byte more at an end that is not the text's own, as a name must not seem cut there.
                        base, end = max(0, int(p[k[0]]) - window - 1), min(len(raw), int(p[k[-1]]) + length + 1)
                        at, a, b, *names = cell_rows(raw[base:end], p[k] - base, lo[k] - base, hi[k] - base, cell, length)
                        take = pa.array(np.full(len(at), i))
                        yield pa.RecordBatch.from_arrays(
                            [*(pa.array(x.view(np.int64)) for x in names), batch.column(0).take(take), batch.column(1).take(take), *(pa.array((x + base).astype(np.int32)) for x in (at, a, b))],
                            ["first", "second", "key", "mark", "p", "lo", "hi"],
                        )

    return run


def covered(starts_lo: np.ndarray, starts_hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by strings that start in [lo, hi]."""
    if not len(starts_lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(starts_lo, kind="stable")
    lo, end = starts_lo[order].astype(np.int64), np.maximum.accumulate(starts_hi[order].astype(np.int64) + length)
    new = np.r_[True, lo[1:] > end[:-1]]
    head = np.flatnonzero(new)
    return lo[head], end[np.r_[head[1:], len(lo)] - 1]


def _cut_out(length: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for packed, found in zip(batch.column(3), batch.column(4)):
                raw = _unpacked(packed)
                lo, hi = (np.asarray(found.values.field(k)) for k in ("lo", "hi")) if found.is_valid else (np.zeros(0, np.int32),) * 2
                a, b = (x.tolist() for x in covered(lo, hi, length))
                kept = [raw[s:e] for s, e in zip([0, *b], [*a, len(raw)])]
                out.append((len(raw), [{"start": s, "end": e} for s, e in zip(a, b)], b"".join(kept)))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], span), pa.array([x[2] for x in out], pa.binary())],
                ["key", "mark", "doc_id", "n_bytes", "spans", "kept"],
            )

    return run


def _by_document(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    return rows.groupBy("key", "mark").agg(F.collect_list(F.struct(*columns)).alias(name))


def _round(texts: DataFrame, cell: int, length: int, window: int, piece: int) -> tuple[DataFrame, DataFrame]:
    """(key, mark, packed, doubts) -> settled starts (key, mark, lo, hi), and the cells that stay in doubt (key, mark, p, lo, hi)."""
    pair = ["first", "second"]
    rows = texts.select("key", "mark", "packed", "doubts").mapInArrow(_cells(cell, length, window, piece), "first long, second long, key long, mark int, p int, lo int, hi int")
    if cell == 1:
        classes = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return rows.join(classes, pair, "left_semi").select("key", "mark", "lo", "hi"), None
    classes = cut(rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "mark", "p", "lo", "hi")).alias("one")))
    settled = rows.join(classes.where("n > 1"), pair, "left_semi").select("key", "mark", "lo", "hi")
    several = cut(classes.groupBy("first").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("first"))
    return settled, classes.join(several, "first", "left_semi").select("one.*")


def _kept_by_document(df: DataFrame) -> DataFrame:
    """A checkpoint of df that Spark still knows to be partitioned as df's plan is; an adaptive plan would not tell. It is planned in a session of its own, so the caller's settings stay as they are."""
    return in_own_session(cut(with_settings(df, {"spark.sql.adaptive.enabled": "false"})), df)


def _removed(texts: DataFrame, length: int, window: int, gram: int, piece: int, id_type: str) -> DataFrame:
    """(key, mark, doc_id, text) -> a row for each row, in which at most two rows share key and mark."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alive = texts.select("key", "mark", "text").mapInArrow(_scan(length, window, gram, piece, True), "name long").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    # Written out, so that the join below stands between two plain exchanges and its hot names can be split.
    alive = cut(alive)
    anchors = texts.select("key", "mark", "text").mapInArrow(_scan(length, window, gram, piece, False), "name long, key long, mark int, p int, lo int, hi int").join(alive, "name", "left_semi")
    packed = texts.mapInArrow(_pack, f"key long, mark int, doc_id {id_type}, packed binary").repartition(parts, "key", "mark")
    packed = _kept_by_document(packed.join(cut(_by_document(anchors, "doubts", "p", "lo", "hi")), ["key", "mark"], "left"))
    found, asked = [], packed.where("doubts IS NOT NULL")
    for cell in (window, *(c for c in CELLS if c < window)):
        settled, doubts = _round(asked, cell, length, window, piece)
        found.append(settled)
        if doubts is not None:
            asked = packed.drop("doubts").join(_by_document(doubts, "doubts", "p", "lo", "hi"), ["key", "mark"])
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    told = packed.select("key", "mark", "doc_id", "packed").join(_by_document(every, "found", "lo", "hi"), ["key", "mark"], "left")
    return told.select("key", "mark", "doc_id", "packed", "found").mapInArrow(_cut_out(length), f"key long, mark int, doc_id {id_type}, n_bytes long, {_SPANS}, kept binary")


_SPANS = "spans array<struct<start: long, end: long>>"


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, gram: int = GRAM, piece: int = PIECE) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, spans (removed runs of bytes, end exclusive), kept (the remaining bytes)."""
    if not 1 <= window <= length - gram + 1 or length < 2 * gram or piece < length or 2 * piece + length + 2 * window > _PLACE:
        raise ValueError("needs 1 <= window <= length - gram + 1, length >= 2 * gram and length <= piece <= 2**20")
    short_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.xxhash64("doc_id", clean_text()).alias("key"), F.hash(clean_text()).alias("mark"), "doc_id", clean_text().alias("text"))
    columns = ["doc_id", "n_bytes", "spans", "kept"]
    repeated = cut(texts.groupBy("key", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "mark"))
    if not repeated.limit(1).count():
        return _removed(texts, length, window, gram, piece, id_type).select(columns)
    pair = ["key", "mark"]
    few = bounded_broadcast(repeated)
    same = texts.join(few, pair, "left_semi")
    one = same.where(F.octet_length("text") >= length).dropDuplicates(pair)
    worked = texts.join(few, pair, "left_anti").unionByName(one.withColumn("twice", F.explode(F.array(F.lit(1), F.lit(2)))).drop("twice"))
    others = _removed(worked, length, window, gram, piece, id_type).join(few, pair, "left_anti").select(columns)
    # A row that is repeated goes whole, or is too short to lose anything.
    n, raw = F.octet_length("text").cast("long"), F.encode("text", "UTF-8")
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("end")))
    whole = F.octet_length("text") >= length
    told = same.select("doc_id", n.alias("n_bytes"), F.when(whole, span).otherwise(F.array().cast(_SPANS.partition(" ")[2].replace(": ", ":"))).alias("spans"), F.when(whole, F.lit(b"")).otherwise(raw).alias("kept"))
    return others.unionByName(told)


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 400 bytes, grouped; for small tables with distinct doc_ids.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
b AS (SELECT doc_id, raw, octet_length(raw) AS n FROM d),
p AS (SELECT doc_id, i, md5(raw[i + 1:i + 400]) AS h FROM (SELECT doc_id, raw, unnest(range(0, n - 399)) AS i FROM b WHERE n >= 400)),
r AS (SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
e AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) > 400 AS new FROM r),
g AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, run),
o AS (SELECT s.doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM s GROUP BY s.doc_id),
j AS (SELECT b.doc_id, raw, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, list_concat([0], coalesce(z, [])) AS lo, list_concat(coalesce(a, []), [n]) AS hi FROM b LEFT JOIN o ON o.doc_id = b.doc_id)
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(list_reduce(list_transform(range(1, len(lo) + 1), lambda k: raw[lo[k] + 1:hi[k]]), lambda x, y: x || y)) AS kept_sha256 FROM j
"""
