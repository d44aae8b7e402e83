"""Removal of repeated lines by a deletion-neighbourhood join, up to one edit.

Lines are what newlines separate. A line of at least `min_chars` characters is dropped if an earlier line, of the same
or another document, is equal; one of at least `edit_chars` characters also if an earlier line of that length at
least is within `max_edits` (0 or 1) insertions, deletions or substitutions of one character. By default that is
every line but empty ones, which only part paragraphs, and one edit from 20 characters on, as in a shorter line
an edit often makes another word. Earlier means by doc_id (null first), then by line number.
The rule looks at the input, not at what is left, so order of work does not matter.

Equal lines are found by a pair of 64-bit names. For one edit, a line with one character deleted is a key:
lines that give the same string by deleting at the same place differ by a substitution, and a line that
equals another's variant differs by an insertion. A variant for each character of each line would be as
many rows as characters, so two cheaper rounds come first, and both lose nothing:

* coarse: one edit leaves the first or the last half of a line untouched, so only lines that share such a
  half (on a grid of 8 characters, so that lengths n and n + 1 agree) with a different line go on;
* fine: the other half is cut into cells of 16 characters; only cells without which two different lines are
  equal give variants, one for each character of the cell.

Lines of up to 16 characters have no half that tells them apart, so with a smaller `edit_chars` the distinct
ones skip both rounds and give a variant for each character.

Then equal variants meet in aggregates that keep the earliest line of each key, and each (line, earliest
line) pair found is verified by edit distance on the lines themselves.

Each line's names travel, not the line; the texts are shuffled once, to fetch the lines that the coarse round
leaves. Very common lines, halves and variants add up in partial aggregates, and joins on keys are
equi-joins whose hot keys adaptive execution can split.

Texts are hashed in stretches of whole lines, so memory is bounded by the longest line (some 60 bytes for each of its
characters). Null text is one empty line. Repeated rows of a document (same doc_id, same text) are the same document
and get the same decisions. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.llm.common import clean_text, cut, mix64, quoted, rows_of, short_batches

MIN_CHARS, EDIT_CHARS, MAX_EDITS, GRID, CELL, PIECE = 1, 20, 1, 8, 16, 1 << 18
#: The side of lines that give all their variants.
PLAIN = 4
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = pow(0x9E3779B97F4A7C15, -1, 2**64)


class CharHashes:
    """Names of substrings of one string, by character."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.newline = points == 10
        n = len(points)
        if len(CharHashes._powers) <= n:
            size = max(n + 1, 1 << 16)
            CharHashes._powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _B)], dtype=np.uint64)
            CharHashes._inverse = np.cumprod(np.r_[np.uint64(1), np.full(size, _B_INVERSE, np.uint64)], dtype=np.uint64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * CharHashes._powers[:n], out=self.sums[1:])

    def raw(self, start, end):
        return (self.sums[end] - self.sums[start]) * CharHashes._inverse[start]

    def names(self, start, end):
        return mix64(self.raw(start, end) + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def without(self, start, end, a, b):
        """Names of [start, end) with [a, b) taken out: the same as those of the joined string."""
        joined = self.raw(start, a) + self.raw(b, end) * CharHashes._powers[a - start]
        return mix64(joined + (a - start + end - b).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _grid(m: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the prefix and the suffix that stand for lines of shorter length m."""
    a = m // (2 * grid) * grid
    return a, (m - a) // grid * grid


def _lines(min_chars: int, edit_chars: int, grid: int, piece: int = PIECE):
    """(doc_id, mark, text) -> doc_id, mark, number of lines, and for each long line its number, two names and the coarse keys."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(2)]
            lo = 0
            while lo < len(texts):
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and size + len(texts[hi]) < piece:
                    size += len(texts[hi]) + 1
                    hi += 1
                yield _line_batch(pa, batch.slice(lo, hi - lo), texts[lo:hi], min_chars, edit_chars, grid, piece)
                lo = hi

    return run


def _stretches(text: str, piece: int):
    """text in stretches of whole lines of about `piece` characters, one line at least; their newlines between them are left out."""
    at = 0
    while len(text) - at > piece:
        end = text.rfind("\n", at, at + piece)
        end = text.find("\n", at + piece) if end < 0 else end
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _line_batch(pa, batch, texts, min_chars, edit_chars, grid, piece):
    if len(texts) == 1 and len(texts[0]) > piece:
        found, count = [], 0
        for part in _stretches(texts[0], piece):
            n, doc, number, *rest = _named_lines([part], min_chars, edit_chars, grid)
            found.append((doc, number + count, *rest))
            count += int(n[0])
        counts, (doc, number, h1, h2, flat, side, sizes) = np.array([count]), (np.concatenate(x) for x in zip(*found))
    else:
        counts, doc, number, h1, h2, flat, side, sizes = _named_lines(texts, min_chars, edit_chars, grid)
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    key = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat.view(np.int64)), pa.array(side)], ["key", "side"]))
    line = pa.StructArray.from_arrays([pa.array(number.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), key], ["line", "h1", "h2", "keys"])
    per_doc = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(texts)))].astype(np.int32)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts.astype(np.int32)), pa.ListArray.from_arrays(per_doc, line)], ["doc_id", "mark", "n_lines", "lines"])


def _named_lines(texts, min_chars, edit_chars, grid):
    """Lines of each text; of the lines of min_chars or more: text, number, two names; and the coarse keys of all, their sides, and how many each line has."""
    sums = CharHashes("\n".join(texts) + "\n")
    end = np.flatnonzero(sums.newline)
    begin = np.r_[0, end[:-1] + 1]
    doc_end = np.cumsum([len(t) + 1 for t in texts])
    doc = np.searchsorted(doc_end, begin, side="right")
    count = np.bincount(doc, minlength=len(texts))
    number = np.arange(len(begin)) - (np.cumsum(count) - count)[doc]
    long = end - begin >= min_chars
    begin, end, doc, number = begin[long], end[long], doc[long], number[long]
    n = end - begin
    h1 = sums.names(begin, end)
    half = begin + n // 3
    h2 = mix64(sums.names(begin, half) * np.uint64(3) + sums.names(half, end))
    keys = []
    for m in (n, n - 1):
        a, b = _grid(m, grid)
        keys.append(sums.names(begin, begin + a) + mix64(a.astype(np.uint64) * np.uint64(2)))
        keys.append(sums.names(end - b, end) + mix64(b.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
    # The keys of n - 1 are left out where they are those of n; pairs whose shorter line is below two cells of the grid are compared without.
    edited, same, shorter = n >= edit_chars, n >= 2 * grid, n > 2 * grid
    kept = np.column_stack([same, same, shorter & (keys[2] != keys[0]), shorter & (keys[3] != keys[1]), ~shorter]) & edited[:, None]
    keys.append(h1)
    flat = np.column_stack(keys)[kept] if len(n) else np.zeros(0, np.uint64)
    side = np.broadcast_to(np.array([1, 2, 1, 2, PLAIN], np.int8), kept.shape)[kept] if len(n) else np.zeros(0, np.int8)
    return count, doc, number, h1, h2, flat, side, kept.sum(1) if len(n) else np.zeros(0, np.int64)


def _fetch(batches):
    """(doc_id, mark, wanted, text) -> a row for each wanted line, with the line."""
    import pyarrow as pa

    for batch in batches:
        row, number, sides, lines = [], [], [], []
        for i, text in enumerate(batch.column(3)):
            parts = (text.as_py() or "").split("\n")
            for w in batch.column(2)[i].as_py():
                row.append(i)
                number.append(w["line"])
                sides.append(w["sides"])
                lines.append(parts[w["line"]])
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(sides, pa.int8()), pa.array(lines, pa.string())], ["doc_id", "mark", "line", "sides", "body"]
        )


def _cell_keys(cell: int, grid: int):
    """(lid, sides, body) -> a row for each cell of a half in doubt and each length of the shorter line: lid, start, m, key."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], []]
            for lid, sides, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                sums, n = CharHashes(body), len(body)
                for m in range(n, max(n - 2, 2 * grid - 1), -1):
                    starts = np.arange(0, m + 1, cell)
                    a, b = _grid(np.array([m]), grid)
                    wanted = np.zeros(len(starts), bool)
                    if sides & 1:
                        wanted |= starts + cell >= a[0]
                    if sides & 2:
                        wanted |= starts <= m - b[0] + 1
                    starts = starts[wanted]
                    suffix = np.maximum(m - starts - cell, 0)
                    zero, full = np.zeros(len(starts), np.int64), np.full(len(starts), n)
                    key = mix64(sums.names(zero, starts) * np.uint64(5) + sums.names(full - suffix, full)) + mix64(starts.astype(np.uint64) * np.uint64(1 << 20) + suffix.astype(np.uint64))
                    out[0].append(np.full(len(starts), lid))
                    out[1].append(starts.astype(np.int32))
                    out[2].append(np.full(len(starts), m, np.int32))
                    out[3].append(key.view(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["lid", "start", "m", "key"])

    return run


def _variants(cell: int):
    """(lid, body, cells, sides) -> variants: lid, role (0 substitution, 1 the longer line, 2 the shorter line itself), key."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], []]
            for lid, body, cells, sides in zip(*(batch.column(k).to_pylist() for k in range(4))):
                sums, n = CharHashes(body), len(body)
                for longer in (False, True):
                    if sides & PLAIN:
                        at = [np.arange(n)]
                    else:
                        at = [np.arange(c["start"], min(c["start"] + cell + longer, n)) for c in cells if (c["m"] == n - 1) == longer]
                    if not at:
                        continue
                    i = np.unique(np.concatenate(at))
                    zero, full = np.zeros(len(i), np.int64), np.full(len(i), n)
                    key = sums.without(zero, full, i, i + 1)
                    if not longer:
                        key = mix64(key + mix64(i.astype(np.uint64) + np.uint64(7)))
                        own = sums.names(np.array([0]), np.array([n]))
                        for k, v in enumerate((np.array([lid]), np.array([2], np.int8), own)):
                            out[k].append(v)
                    for k, v in enumerate((np.full(len(i), lid), np.full(len(i), int(longer), np.int8), key)):
                        out[k].append(v)
            if out[0]:
                lid, role, key = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(lid), pa.array(role), pa.array(key.view(np.int64))], ["lid", "role", "key"])

    return run


def _one_edit_apart(first: DataFrame, texts: DataFrame, lines: DataFrame, cell: int, grid: int, plain: bool) -> DataFrame:
    """Places (doc_id, mark, line) of first occurrences that are one edit from an earlier line; plain: there may be lines without halves."""
    id_type = texts.schema["doc_id"].dataType.simpleString()
    keyed = lines.select("at", "h1", "h2", F.explode("keys").alias("k")).select("at", "h1", "h2", "k.key", "k.side")
    halves = keyed.where(F.col("side") != PLAIN) if plain else keyed
    several = halves.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    going = halves.join(several, "key", "left_semi")
    if plain:
        going = going.unionByName(keyed.where(F.col("side") == PLAIN).select(*going.columns))
    doubtful = going.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.bit_or("side").alias("sides"))
    wanted = doubtful.select("at.doc_id", "at.mark", F.struct("at.line", "sides").alias("w")).groupBy("doc_id", "mark").agg(F.collect_list("w").alias("wanted")).withColumnsRenamed({"doc_id": "d", "mark": "m"})
    fetched = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).select("doc_id", "mark", "wanted", "text")
    bodies = fetched.mapInArrow(_fetch, f"doc_id {id_type}, mark long, line int, sides byte, body string").dropDuplicates(["doc_id", "mark", "line"])
    bodies = cut(bodies.select(F.struct("doc_id", "mark", "line").alias("at"), "sides", "body").withColumn("lid", F.monotonically_increasing_id()))
    cells = bodies.select("lid", "sides", "body").mapInArrow(_cell_keys(cell, grid), "lid long, start int, m int, key long")
    both = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    asked = cells.join(both, "key", "left_semi").groupBy("lid").agg(F.collect_list(F.struct("start", "m")).alias("cells"))
    variants = bodies.select("lid", "body", "sides").join(asked, "lid", "left" if plain else "inner")
    if plain:
        variants = variants.where(F.col("cells").isNotNull() | (F.col("sides") >= PLAIN))
    variants = variants.select("lid", "body", "cells", "sides").mapInArrow(_variants(cell), "lid long, role byte, key long")
    placed = cut(variants.join(bodies.select("lid", "at"), "lid").select("key", "role", F.struct("at", "lid").alias("who")))
    # The earliest line of a key, apart for substitutions, longer and shorter lines; an insertion looks at the other side.
    least = placed.groupBy("key", "role").agg(F.min("who").alias("earliest"))
    looked = placed.withColumn("role", F.when(F.col("role") == 0, 0).otherwise(3 - F.col("role")).cast("byte"))
    pairs = looked.join(least, ["key", "role"]).where("earliest.at < who.at").select(F.col("who.lid").alias("lid"), F.col("earliest.lid").alias("other")).distinct()
    pairs = pairs.join(bodies.select("lid", "at", "body"), "lid").join(bodies.select(F.col("lid").alias("other"), F.col("body").alias("earlier")), "other")
    return pairs.where(F.levenshtein("body", "earlier", 1) == 1).select("at.doc_id", "at.mark", "at.line").distinct()


def line_decisions(docs: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS, cell: int = CELL, grid: int = GRID, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """One row for each row of docs: doc_id, mark (hash of the text), n_lines, n_long (lines of min_chars or more), stays (sorted numbers of those that stay, from 0); all other lines stay."""
    if max_edits not in (0, 1) or min_chars < 1:
        raise ValueError("max_edits must be 0 or 1, min_chars at least 1")
    edit_chars = max(min_chars, edit_chars)
    short_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64(clean_text()).alias("mark"), clean_text().alias("text"))
    scanned = cut(
        texts.mapInArrow(_lines(min_chars, edit_chars, grid), f"doc_id {id_type}, mark long, n_lines int, lines array<struct<line: int, h1: long, h2: long, keys: array<struct<key: long, side: byte>>>>")
    )
    lines = scanned.select("doc_id", "mark", F.explode("lines").alias("l")).select(F.struct("doc_id", "mark", "l.line").alias("at"), "l.h1", "l.h2", "l.keys")
    first = lines.groupBy("h1", "h2").agg(F.min("at").alias("at")).select("at.doc_id", "at.mark", "at.line")
    if max_edits:
        near = _one_edit_apart(first, texts, lines, cell, grid, edit_chars <= 2 * grid).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("line").alias("l"))
        first = first.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")) & (F.col("line") == F.col("l")), "left_anti")
    stays = first.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("m")).agg(F.array_sort(F.collect_list("line")).alias("stays"))
    out = scanned.select("doc_id", "mark", "n_lines", F.size("lines").alias("n_long")).join(stays, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    return out.select("doc_id", "mark", "n_lines", "n_long", F.coalesce("stays", F.array().cast("array<int>")).alias("stays"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, **options) -> DataFrame:
    """docs with the lines that stay as text (null stays null), in docs' columns."""
    stays = line_decisions(docs, min_chars, **options).select(F.col("doc_id").alias("stay_id"), F.col("mark").alias("stay_mark"), "stays").dropDuplicates(["stay_id", "stay_mark"])
    joined = rows_of(docs, id=F.col("doc_id"), mark=F.xxhash64(clean_text())).join(stays, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("mark") == F.col("stay_mark")))
    kept = F.filter(F.split("row.text", "\n", -1), lambda line, i: (F.length(line) < min_chars) | F.array_contains(F.col("stays"), i))
    joined = joined.withColumn("text", F.array_join(kept, "\n"))
    return joined.select(*[F.col("text") if c == "text" else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    dropped = F.col("n_long") - F.size("stays")
    return out.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
        (F.col("n_lines") - dropped).cast("long").alias("n_kept"),
        F.sha2(F.array_join(F.transform("stays", lambda i: i.cast("string")), ","), 256).alias("stays_sha256"),
    )


#: Lines that share an untouched half are compared character by character; for small tables with distinct doc_ids.
OP6_SQL = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, i - 1 AS line, parts[i] AS body FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM t) WHERE length(parts[i]) >= 1),
f AS (SELECT body, length(body) AS n, min({'d': doc_id, 'l': line}) AS pos FROM l GROUP BY body),
k AS (SELECT pos, body, n, unnest([{'k': n // 2, 's': 'p' || left(body, n // 2)}, {'k': n - n // 2, 's': 's' || right(body, n - n // 2)},
        {'k': (n - 1) // 2, 's': 'p' || left(body, (n - 1) // 2)}, {'k': n - 1 - (n - 1) // 2, 's': 's' || right(body, n - 1 - (n - 1) // 2)}]) AS key FROM f WHERE n >= 20),
near AS (SELECT DISTINCT a.pos FROM k a JOIN k b ON a.key = b.key AND a.pos > b.pos AND abs(a.n - b.n) <= 1
    WHERE len(list_filter(range(0, greatest(a.n, b.n)), lambda i: left(a.body, i) = left(b.body, i) AND substr(a.body, i + 1 + (a.n >= b.n)::INT) = substr(b.body, i + 1 + (b.n >= a.n)::INT))) > 0),
stays AS (SELECT pos.d AS doc_id, list(pos.l ORDER BY pos.l) AS stays FROM f WHERE pos NOT IN (SELECT pos FROM near) GROUP BY pos.d),
n AS (SELECT t.doc_id, len(parts) AS n_lines, len(list_filter(parts, lambda x: length(x) >= 1)) AS n_long, coalesce(stays, []) AS stays FROM t LEFT JOIN stays ON stays.doc_id = t.doc_id)
SELECT doc_id, n_lines, n_long - len(stays) AS n_dropped, n_lines - n_long + len(stays) AS n_kept, sha256(array_to_string(stays, ',')) AS stays_sha256 FROM n
"""
