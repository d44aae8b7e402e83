"""Sampled segmentations into SentencePiece pieces, and lossless decoding.

A text is cut at its spaces into units, each space going with what follows it; no piece of the vocabulary
joins units except runs of spaces, which are left out. A unit's lattice has an edge for each piece of the
vocabulary that occurs in it, and, for a character that is no piece itself, an edge for its UTF-8 bytes as byte
pieces. Forward filtering gives the total weight of all segmentations up to each character; backward
sampling then draws pieces from the end, each with its share of that total, so a unit's segmentation is
drawn with probability in proportion to the product of its pieces' weights.

The vocabulary's model is a BPE model, whose scores are ranks of merges and no probabilities; a piece's
weight is (rank + 1) ** -(zipf * alpha), and a byte piece's that of the last rank. A larger alpha prefers frequent
pieces, alpha = 0 draws all segmentations alike.

Random numbers are hashes of (seed, row key, number of the unit, step), so a row's segmentation does not
depend on partitions, order or reruns; equal rows get equal segmentations. Decoding joins pieces (the space
mark becomes a space, byte pieces become their bytes) and gives back every text exactly, white space, control
characters and the space mark itself included.

All lattices of a stretch of text are built and sampled together in numpy, each different unit once; a task
keeps them for the texts that follow, until they hold KEPT characters. A text longer than PIECE is encoded in portions
cut before spaces; a unit longer than STRETCH (a multiple of 8) keeps the forward totals between stretches, and each
stretch of its lattice is built again when the draws reach it, with the same result. So memory is bounded by PIECE, KEPT
and the longest text's own characters and ids. Null text has no pieces and
decodes to an empty text; in `encode` its ids are null. Rows are independent, so ties and repeated rows need
no rule. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from triadic.llm.common import map_arrow, mix64, quoted, short_batches, slices_by_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, ZIPF, SEED, PIECE, KEPT, STRETCH = 0.5, 1.0, 23, 1 << 18, 700_000, 1 << 15
#: Stands for a space in front of a unit; no character has this number, so the space mark in a text stays apart.
MARK = 0x110000
SPACE_MARK = "▁"
#: Bits of a slot in a table of hashes; what collides goes to a further table, by other bits.
SLOTS = 18
_B = np.uint64(0x9E3779B97F4A7C15)


def load(path: str) -> dict:
    """The pieces of a model file, as lists that can be sent to tasks; read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, bytes_ = [], [-1] * 256
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            bytes_[int(text[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and SPACE_MARK not in text[1:]:
            pieces.append((text, i, int(-model.get_score(i))))
    if -1 in bytes_:
        raise ValueError("the model has no byte pieces, so it cannot encode every text")
    return {"pieces": pieces, "bytes": bytes_, "size": model.get_piece_size()}


class Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Lattices:
    """The vocabulary as tables of hashes: each prefix of a piece, and its id and weight if it is one."""

    def __init__(self, model: dict, alpha: float, zipf: float):
        self.byte_ids = np.array(model["bytes"], np.int32)
        ranks = max(r for _, _, r in model["pieces"]) + 1
        self.byte_weight = (ranks + 1.0) ** (-zipf * alpha)
        nodes: dict[tuple, tuple[int, float]] = {}
        self.longest = 1
        for text, i, rank in model["pieces"]:
            codes = tuple(MARK if k == 0 and c == SPACE_MARK else ord(c) for k, c in enumerate(text))
            self.longest = max(self.longest, len(codes))
            for k in range(1, len(codes)):
                nodes.setdefault(codes[:k], (-1, 0.0))
            nodes[codes] = (i, (max(rank, 0) + 1.0) ** (-zipf * alpha))
        hashes = np.array([self._hash(c) for c in nodes], np.uint64)
        ids, weights = np.array([v[0] for v in nodes.values()], np.int32), np.array([v[1] for v in nodes.values()], np.float32)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two prefixes of pieces share a hash")
        self.tables = []
        shift = 46
        while len(hashes):
            key, at = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)
            slot = ((hashes >> np.uint64(shift)) & np.uint64((1 << SLOTS) - 1)).astype(np.int64)
            _, first = np.unique(slot, return_index=True)
            key[slot[first]] = hashes[first]
            at[slot[first]] = first
            self.tables.append((np.uint64(shift), key, ids[at], weights[at]))
            rest = np.ones(len(hashes), bool)
            rest[first] = False
            hashes, ids, weights = hashes[rest], ids[rest], weights[rest]
            shift = (shift - SLOTS) % 47
        self.texts = self._piece_bytes(model)
        self._forget()

    def _forget(self) -> None:
        """No units are known. Of known ones: their numbers, where their characters begin and how many there are, and what build gives for each."""
        self.units, self.known, self.chars = Numbers(), 0, 0
        self.begin = self.length = np.zeros(0, np.int64)
        self.shares, self.ids = np.zeros((0, self.longest), np.float32), np.zeros((0, self.longest), np.int32)

    @staticmethod
    def _hash(codes) -> int:
        h = 0
        for m in mix64(np.array(codes, np.uint64) + np.uint64(1)).tolist():
            h = (h * int(_B) + m) % 2**64
        return h

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether hashes are prefixes of pieces, the pieces' ids (-1: none) and weights."""
        known, ids, weights = np.zeros(len(h), bool), np.full(len(h), -1, np.int32), np.zeros(len(h), np.float32)
        todo = np.arange(len(h))
        for shift, key, own, weight in self.tables:
            slot = ((h[todo] >> shift) & np.uint64((1 << SLOTS) - 1)).astype(np.int64)
            hit = key[slot] == h[todo]
            at = todo[hit]
            known[at], ids[at], weights[at] = True, own[slot[hit]], weight[slot[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return known, ids, weights

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and ids of the pieces that end at each character, by length. left: characters from each one to the end of what a piece may cover."""
        n = len(codes)
        weight = np.zeros((n, self.longest), np.float32)
        ids = np.full((n, self.longest), -1, np.int32)
        mixed = mix64(codes.astype(np.uint64) + np.uint64(1))
        at, h = np.arange(n), np.zeros(n, np.uint64)
        for k in range(self.longest):
            h = h * _B + mixed[at + k]
            known, found, w = self._find(h)
            piece = found >= 0
            end = at[piece] + k
            weight[end, k], ids[end, k] = w[piece], found[piece]
            if k == 0:
                lone = at[~piece]  # a character that is no piece: its bytes; its code stands for them for now
                c = codes[lone]
                size = 1 + (c >= 0x80) + (c >= 0x800).astype(np.int64) + (c >= 0x10000)
                weight[lone, 0] = self.byte_weight**size
                ids[lone, 0] = -2 - np.where(c == MARK, 0x20, c).astype(np.int32)
            go = known & (left[at] > k + 1)
            at, h = at[go], h[go]
        return weight, ids

    def build(self, codes: np.ndarray, length: np.ndarray):
        """For units one after the other: the shares (cumulative, by length of the last piece) and ids of edges that end at each character."""
        n, units = len(codes), len(length)
        begin = np.cumsum(length) - length
        weight, ids = self.edges(codes, np.repeat(begin + length, length) - np.arange(n))
        total = np.zeros(n + units)  # by node: a unit's start and the place after each of its characters
        total[begin + np.arange(units)] = 1.0
        shares = np.empty((n, self.longest), np.float32)
        back = np.arange(1, self.longest + 1)
        order = np.argsort(-length, kind="stable")
        falling = -length[order]
        for e in range(int(length.max()) if units else 0):
            some = order[: np.searchsorted(falling, -e, side="left")]
            i = begin[some] + e
            node = i + some + 1
            reach = min(e + 1, self.longest)
            s = weight[i, :reach] * total[node[:, None] - back[:reach]]
            np.cumsum(s, axis=1, out=s)
            total[node] = s[:, -1]
            s /= s[:, -1:]
            shares[i, :reach] = s
            shares[i, reach:] = 1.0
            if e % 8 == 7:  # only ratios of neighbouring totals matter, so they are kept from vanishing
                near = node[:, None] - np.arange(min(e + 2, self.longest + 1))
                total[near] *= 1 / total[node][:, None]
        return begin, shares, ids

    def sample(self, units: np.ndarray, begin: np.ndarray, length: np.ndarray, shares: np.ndarray, ids: np.ndarray, key: np.ndarray):
        """Ids for occurrences of units, in order, and how many each has. key: a 64-bit number for each occurrence."""
        n = len(units)
        active, last = np.arange(n), length[units] - 1
        steps, found, count = [], [], np.zeros(n, np.int64)
        k = 0
        while len(active):
            u = (mix64(key[active] + np.uint64(k * int(_B) % 2**64)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
            i = begin[units[active]] + last
            back = (shares[i] <= u[:, None]).argmin(axis=1)
            steps.append(active)
            found.append(ids[i, back])
            count[active] += 1
            last = last - back - 1
            go = last >= 0
            active, last = active[go], last[go]
            k += 1
        out = np.zeros(int(count.sum()), np.int32)
        after = np.cumsum(count)
        for k, (a, f) in enumerate(zip(steps, found)):
            out[after[a] - 1 - k] = f
        return out, count

    def _stretch(self, codes: np.ndarray, a: int, b: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares and ids of the edges that end at characters a to b of one unit, and the totals of the last nodes, given those of the nodes before a."""
        first, reach = max(0, a - self.longest + 1), self.longest
        weight, ids = self.edges(codes[first:b], b - np.arange(first, b))
        weight, ids = weight[a - first :], ids[a - first :]
        total = np.r_[before, np.zeros(b - a)]
        shares = np.empty((b - a, reach), np.float32)
        for e in range(b - a):
            s = weight[e] * total[e : e + reach][::-1]
            np.cumsum(s, out=s)
            total[e + reach] = s[-1]
            shares[e] = s / s[-1]
            if (a + e) % 8 == 7:
                total[e : e + reach + 1] *= 1 / total[e + reach]
        return shares, ids, total[b - a :]

    def sample_long(self, codes: np.ndarray, key: int, stretch: int) -> np.ndarray:
        """What build and sample give for one unit, holding one stretch of its lattice: forward with the totals between stretches kept, then backward with each stretch built again."""
        edges = [*range(0, len(codes), stretch), len(codes)]
        before = np.zeros(self.longest)
        before[-1] = 1.0
        totals = []
        for a, b in zip(edges[:-1], edges[1:]):
            totals.append(before)
            before = self._stretch(codes, a, b, before)[2]
        out, last, k = array("i"), len(codes) - 1, 0
        for a, b, before in zip(edges[-2::-1], edges[:0:-1], totals[::-1]):
            shares, ids, _ = self._stretch(codes, a, b, before)
            while last >= a:
                u = (mix64(np.array([key], np.uint64) + np.uint64(k * int(_B) % 2**64)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
                back = int((shares[last - a] <= u).argmin())
                out.append(ids[last - a, back])
                last, k = last - back - 1, k + 1
        return np.array(out, np.int32)[::-1]

    def _spell(self, out: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Puts byte pieces in the place of characters that are no pieces."""
        lone = out <= -2
        if not lone.any():
            return out, count
        c = np.where(lone, -2 - out, 0)
        size = np.where(lone, 1 + (c >= 0x80) + (c >= 0x800).astype(np.int64) + (c >= 0x10000), 1)
        owner = np.repeat(np.arange(len(count)), count)
        new = np.repeat(out, size)
        at = np.cumsum(size) - size
        for n, lead in enumerate((0, 0xC0, 0xE0, 0xF0), 1):  # the bytes of UTF-8
            these = lone & (size == n)
            for b in range(n):
                bits = c[these] >> (6 * (n - 1 - b))
                new[at[these] + b] = self.byte_ids[lead | bits if b == 0 else 0x80 | bits & 0x3F]
        return new, np.bincount(owner, weights=size, minlength=len(count)).astype(np.int64)

    def encode(self, texts: list[str], keys: np.ndarray, before: list[int] | None = None, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has. before: units of the same text that went before each."""
        if self.chars > KEPT:
            self._forget()
        number = self.units.__getitem__
        units, per_text, long = [], [], {}
        for text in texts:
            parts = text.split(" ")
            own = [(parts[0],), *parts[1:]] if parts[0] else parts[1:]
            if len(text) > stretch:
                for i, p in enumerate(own):
                    if len(p if isinstance(p, str) else p[0]) > stretch:
                        long[sum(per_text) + i] = p
                own = [p for i, p in enumerate(own) if sum(per_text) + i not in long]
            units.extend(map(number, own))
            per_text.append(len(parts) - (not parts[0]))
        self._learn()
        begin, length, shares, ids = self.begin, self.length, self.shares, self.ids
        per_text = np.array(per_text, np.int64)
        number = np.arange(int(per_text.sum())) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        if before is not None:
            number = number + np.repeat(np.array(before, np.int64), per_text)
        key = mix64(np.repeat(keys, per_text) + mix64(number.astype(np.uint64)))
        usual = np.ones(len(key), bool)
        usual[list(long)] = False
        out, own = self._spell(*self.sample(np.array(units, np.int64), begin, length, shares, ids, key[usual]))
        count = np.zeros(len(key), np.int64)
        count[usual] = own
        if long:
            found = {}
            for o, p in long.items():
                mark = isinstance(p, str)
                codes = np.r_[[MARK] * mark, np.frombuffer((p if mark else p[0]).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
                got = self.sample_long(codes, int(key[o]), stretch)
                found[o], n = self._spell(got, np.array([len(got)]))
                count[o] = n[0]
            ends = np.cumsum(np.r_[0, count])
            whole, rest = np.empty(int(ends[-1]), np.int32), np.ones(int(ends[-1]), bool)
            for o, got in found.items():
                whole[ends[o] : ends[o + 1]] = got
                rest[ends[o] : ends[o + 1]] = False
            whole[rest] = out
            out = whole
        ends = np.cumsum(np.r_[0, count])
        return out, np.diff(ends[np.cumsum(np.r_[0, per_text])])

    def encode_long(self, text: str, key, portion: int) -> np.ndarray:
        """encode for one text, in portions that are cut before a space."""
        out, at, before = [], 0, 0
        while at < len(text):
            end = len(text)
            if end - at > portion:
                end = text.rfind(" ", at + 1, at + portion)
                end = text.find(" ", at + portion) if end < 0 else end
                end = len(text) if end < 0 else end
            part = text[at:end]
            out.append(self.encode([part], np.array([key], np.uint64), [before])[0])
            at, before = end, before + part.count(" ") + (part[0] != " ")
        return np.concatenate(out)

    def _learn(self) -> None:
        """Builds the lattices of units that were numbered since the last call."""
        if len(self.units) == self.known:
            return
        new = list(self.units)[self.known :] if self.known else list(self.units)
        names = [(p[0], 0) if isinstance(p, tuple) else (p, 1) for p in new]
        length = np.array([len(p) + mark for p, mark in names], np.int64)
        marked = np.array([mark for _, mark in names], bool)
        begin = np.cumsum(length) - length
        codes = np.full(int(length.sum()), MARK, np.int64)
        inner = np.ones(len(codes), bool)
        inner[begin[marked]] = False
        codes[inner] = np.frombuffer("".join(p for p, _ in names).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin, shares, ids = self.build(codes, length)
        u, c = slice(self.known, len(self.units)), slice(self.chars, self.chars + len(codes))
        self.begin, self.length = _room(self.begin, u.stop), _room(self.length, u.stop)
        self.shares, self.ids = _room(self.shares, c.stop), _room(self.ids, c.stop)
        self.begin[u], self.length[u], self.shares[c], self.ids[c] = begin + self.chars, length, shares, ids
        self.known, self.chars = u.stop, c.stop

    def _piece_bytes(self, model: dict) -> tuple[np.ndarray, np.ndarray]:
        spelled = [b""] * model["size"]
        for text, i, _ in model["pieces"]:
            spelled[i] = (" " + text[1:] if text[0] == SPACE_MARK else text).encode()
        for b, i in enumerate(model["bytes"]):
            spelled[i] = bytes([b])
        return np.frombuffer(b"".join(spelled), np.uint8), np.cumsum([0, *map(len, spelled)])

    def decode(self, ids: np.ndarray) -> bytes:
        flat, ends = self.texts
        size = ends[ids + 1] - ends[ids]
        at = np.repeat(ends[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return flat[at].tobytes()


def _room(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.empty((max(n, KEPT + PIECE), *x.shape[1:]), x.dtype)  # what is not written takes no memory
    out[: len(x)] = x
    return out


@functools.lru_cache(1)
def _lattices(path: str, alpha: float, zipf: float, shipped) -> Lattices:
    return Lattices(shipped.value, alpha, zipf)


def encode(docs: DataFrame, key: str = "doc_id", model: str = MODEL, alpha: float = ALPHA, zipf: float = ZIPF, seed: int = SEED, check: bool = False) -> DataFrame:
    """docs' columns but text (and any of these names), with n_pieces and ids (little-endian, 16 bits if all ids fit, else 32); with check, also lossless: whether they decode to the text."""
    short_batches(docs.sparkSession)
    vocabulary = load(model)
    dtype = np.dtype("<u2" if vocabulary["size"] <= 1 << 16 else "<u4")
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    others = [c for c in docs.columns if c not in ("text", "n_pieces", "ids", "lossless")]
    chosen = docs.select(F.xxhash64(F.lit(seed), F.col(quoted(key))), F.col("text"), *[F.col(quoted(c)) for c in others])

    def run(batches):
        import pyarrow as pa

        lattices = _lattices(model, alpha, zipf, shipped)
        try:
            for batch in batches:
                yield from encoded(pa, lattices, batch)
        finally:
            lattices._forget()  # the worker lives on for other jobs, which need the memory
            pa.default_memory_pool().release_unused()

    def encoded(pa, lattices, batch):
        import pyarrow.compute as pc

        keys = batch.column(0).to_numpy().view(np.uint64)
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        for lo, hi in slices_by_bytes(sizes, PIECE):
            texts = batch.column(1).slice(lo, hi - lo).to_pylist()
            if hi - lo == 1 and sizes[lo] > PIECE:
                ids = lattices.encode_long(texts[0], keys[lo], PIECE)
                count = np.array([len(ids)])
            else:
                ids, count = lattices.encode([t or "" for t in texts], keys[lo:hi])
            ends = np.cumsum(np.r_[0, count])
            own = [ids[a:b] if texts[i] is not None else None for i, (a, b) in enumerate(zip(ends[:-1], ends[1:]))]
            columns = [c.slice(lo, hi - lo) for c in batch.columns[2:]]
            columns += [pa.array(count), pa.array([None if x is None else x.astype(dtype).tobytes() for x in own], pa.binary())]
            names = [*batch.schema.names[2:], "n_pieces", "ids"]
            if check:
                columns.append(pa.array([x is None or lattices.decode(x) == texts[i].encode() for i, x in enumerate(own)]))
                names.append("lossless")
            yield pa.RecordBatch.from_arrays(columns, names)

    more = StructType.fromDDL("n_pieces long, ids binary" + ", lossless boolean" * check).fields
    return map_arrow(chosen, run, StructType([*chosen.schema.fields[2:], *more]))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded's columns with ids replaced by text (null ids: null)."""
    vocabulary = load(model)
    dtype = np.dtype("<u2" if vocabulary["size"] <= 1 << 16 else "<u4")
    shipped = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    others = [c for c in encoded.columns if c not in ("ids", "text")]

    def run(batches):
        import pyarrow as pa

        lattices = _lattices(model, 1.0, 1.0, shipped)
        for batch in batches:
            texts = [None if x is None else lattices.decode(np.frombuffer(x, dtype).astype(np.int64)).decode() for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*batch.schema.names[1:], "text"])

    chosen = encoded.select("ids", *[F.col(quoted(c)) for c in others])
    return map_arrow(chosen, run, StructType([*chosen.schema.fields[1:], StructField("text", StringType())]))


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    out = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), check=True)
    return out.select("doc_id", "n_pieces", F.sha2("ids", 256).alias("ids_sha256"), "lossless")
