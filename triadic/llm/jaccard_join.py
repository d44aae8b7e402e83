"""Near-duplicate texts by a Jaccard join on word n-grams, with Bayesian pruning of candidates.

A text's words are its runs of characters other than white space, as they stand; its set holds the hashes
of all runs of `shingle` words (of all its words, if it has fewer). Two texts are linked if the Jaccard
similarity of their sets is at least `threshold`.

* Texts with equal sets form a class (by a 128-bit sum over the set); what follows works on classes.
* MinHash: bands * rows_in_band values a class; classes that agree on all values of a band share a bucket.
  With 35 bands of 5 a pair at similarity 0.8 shares none with probability 1e-6.
* Bayesian pruning: pairs in a bucket compare their MinHash values (one byte each) in steps; after each step
  a pair is dropped when the posterior probability that its similarity reaches the threshold, given the
  matches so far and a uniform prior, is below `tolerance`. What remains connects candidate groups.
* Exact verification: within a candidate group the sets themselves are intersected, for every pair of its
  classes, so that a pair that was pruned by bad luck still counts. Links are counted, groups are the
  connected components of verified links.

A bucket of n classes is compared from single members only until all are connected: every member
outside the largest part is compared with all, so no connection is missed and near-copies cost n, not n
squared. Large buckets and groups are cut into blocks, and pairs of blocks are tasks' units of bounded size, in sets
and in bytes; a very long text is hashed in pieces and its set is one member. Counting the links of a group of n texts that are
near each other takes n squared comparisons at the end, in block pairs, as intersections of incidence matrices. In a
large group whose members share few buckets, as a chain of near copies, pairs that share one are verified instead,
where fewer sets travel that way; so pairs are rows only where they are fewer than members times blocks.

Null text counts as empty. Texts without words have no n-grams: they are linked to nothing, and each is
its own class and group. Repeated rows are copies like any others. A row with null doc_id takes part, and a
group's id is the least non-null doc_id (null if there is none). Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.llm.common import bounded_broadcast, clean_text, cut, mix64, rows_of, short_batches, slices_by_bytes, utf8_buffer
from triadic.llm.components import connected_components
from triadic.llm.substring_dedup import Hashes

SHINGLE, THRESHOLD, BANDS, ROWS_IN_BAND, TOLERANCE, STEP_HASHES, SEED = 5, 0.8, 35, 5, 1e-9, 35, 3
BUCKET_BLOCK, GROUP_BLOCK, LEAST_BLOCK, GROUP_BYTES, PIECE = 500, 200, 16, 16 << 20, 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_hashes(raw: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text raw[bounds[d]:bounds[d + 1]]."""
    docs = len(bounds) - 1
    if not len(raw):
        return [np.zeros(0, np.uint64)] * docs
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a text starts or ends here
    edge[bounds] = True
    solid = ~space
    begin = np.flatnonzero(solid & (np.r_[True, space[:-1]] | edge[:-1]))
    end = np.flatnonzero(solid & (np.r_[space[1:], True] | edge[1:])) + 1
    words = Hashes(raw).names(begin, end)
    first = np.searchsorted(begin, bounds)
    out = []
    for d in range(docs):
        w = words[first[d] : first[d + 1]]
        k = min(shingle, len(w))
        if not k:
            out.append(np.zeros(0, np.uint64))
            continue
        total = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            total = total * np.uint64(0x9E3779B97F4A7C15) + mix64(w[i : len(w) - k + 1 + i])
        out.append(np.unique(mix64(total + np.uint64(k))))
    return out


def multipliers(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)) | np.uint64(1)


def minhashes(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 2048):
        np.minimum(least, np.multiply.outer(factors, hashes[a : a + 2048]).min(axis=1), out=least)
    return mix64(least)


def least_matches(n: int, step: int, threshold: float, tolerance: float, values: int = 256) -> list[tuple[int, int]]:
    """(hashes compared, least number of matches to go on) for each step.

    Two values match with probability s + (1 - s) / values at similarity s; s is uniform before.
    """
    s = (np.arange(20000) + 0.5) / 20000
    match = s + (1 - s) / values
    out = []
    for k in [*range(step, n, step), n]:
        need = k + 1
        for m in range(k, -1, -1):
            logs = m * np.log(match) + (k - m) * np.log1p(-match)
            w = np.exp(logs - logs.max())
            if w[s >= threshold].sum() / w.sum() < tolerance:
                break
            need = m
        out.append((k, need))
    return out


def survivors(a: np.ndarray, b: np.ndarray, plan: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of a and b (broadcast against each other) stay after all steps."""
    n = max(len(a), len(b))
    alive, matches, done = np.arange(n), np.zeros(n, np.int64), 0
    pick = lambda x, lo, hi: x[:, lo:hi] if len(x) == 1 and n > 1 else x[alive, lo:hi]
    for k, need in plan:
        matches = matches + (pick(a, done, k) == pick(b, done, k)).sum(1)
        stay = matches >= need
        alive, matches, done = alive[stay], matches[stay], k
        if not len(alive):
            break
    out = np.zeros(n, bool)
    out[alive] = True
    return out


def bucket_parts(sigs: np.ndarray, plan) -> np.ndarray:
    """Labels of the connected parts of a bucket (the least member's place)."""
    n = len(sigs)
    label, asked = np.arange(n), np.zeros(n, bool)
    v = 0
    while True:
        asked[v] = True
        other = np.flatnonzero(label != label[v])
        hit = other[survivors(sigs[v : v + 1], sigs[other], plan)] if len(other) else other
        if len(hit):
            merged = np.unique(np.r_[label[hit], label[v]])
            label[np.isin(label, merged)] = merged[0]
        largest = np.bincount(label, minlength=n).argmax()
        todo = np.flatnonzero(~asked & (label != largest))
        if not len(todo):
            return label
        v = todo[0]


def whole_groups(batches, keys: list[str]):
    """Tables that hold whole groups of rows with equal keys, from batches sorted by them; a group must fit in memory."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.slice(batch.num_rows - 1)
        same = None
        for k in keys:
            eq = pc.equal(batch.column(k), last.column(k)[0])
            same = eq if same is None else pc.and_(same, eq)
        start = int(np.argmax(np.asarray(same)))
        if start == 0 and held and all(held[-1].column(k)[held[-1].num_rows - 1] == last.column(k)[0] for k in keys):
            held.append(batch)  # the whole batch goes on with the held group
            continue
        if start or held:
            done = pa.Table.from_batches([*held, batch.slice(0, start)] if start else held)
            yield done.combine_chunks()
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _edges_of(keys: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.r_[np.flatnonzero(new), len(new)]


def _sketches(shingle: int, bands: int, rows: int, seed: int):
    def run(batches):
        import pyarrow as pa

        factors = multipliers(bands * rows, seed)
        salt = multipliers(bands, seed + 1)
        spread = multipliers(rows, seed + 2)
        for batch in batches:
            raw, bounds = utf8_buffer(batch.column(2))
            for a, b in slices_by_bytes(np.diff(bounds), PIECE):
                sets = shingle_hashes(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], shingle)
                k1, k2, size, keys, sigs = [], [], [], [], []
                for s in sets:
                    size.append(len(s))
                    k1.append(int(mix64(s).sum(dtype=np.uint64)))
                    k2.append(int(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)))
                    if len(s):
                        m = minhashes(s, factors)
                        keys.append(mix64((m.reshape(bands, rows) * spread).sum(axis=1, dtype=np.uint64) + salt).view(np.int64))
                        sigs.append((m & np.uint64(255)).astype(np.uint8).tobytes())
                    else:
                        keys.append(np.zeros(0, np.int64))
                        sigs.append(b"")
                long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), long(k1), long(k2), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    ["doc_id", "mark", "k1", "k2", "n", "buckets", "sig"],
                )

    return run


#: Edges that a task holds to leave out those that connect nothing new.
HELD_EDGES = 1 << 18


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the same nodes as (a, b) do: one from each node to the least that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        u, v = label[x], label[y]
        apart = u != v
        if not apart.any():
            joined = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[joined], nodes[label[joined]]
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (label[label] != label).any():
            label = label[label]


class Forest:
    """Edges of a task, reduced to a forest whenever HELD_EDGES have come; what a forest of many nodes still holds is given away."""

    def __init__(self):
        self.a, self.b, self.n = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        self.a.append(a)
        self.b.append(b)
        self.n += len(a)
        if self.n < HELD_EDGES:
            return None
        a, b = self.rest()
        if len(a) > HELD_EDGES // 2:
            return a, b
        self.a, self.b, self.n = [a], [b], len(a)
        return None

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        found = forest(np.concatenate([none, *self.a]), np.concatenate([none, *self.b]))
        self.a, self.b, self.n = [], [], 0
        return found


#: Tasks whose forests meet in one.
MERGED_TASKS = 16


def _forests(batches):
    """Edges (a, b) -> a forest of them."""
    import pyarrow as pa

    held, rows = Forest(), lambda found: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])
    for batch in batches:
        if (found := held.add(*(batch.column(k).to_numpy() for k in range(2)))) is not None:
            yield rows(found)
    yield rows(held.rest())


def _merged(edges: DataFrame) -> DataFrame:
    """Written edges (a, b), of which those are left out that connect nothing new among MERGED_TASKS tasks."""
    return edges.coalesce(max(1, -(-edges.rdd.getNumPartitions() // MERGED_TASKS))).mapInArrow(_forests, "a long, b long").distinct()


def _compare_buckets(width: int, plan):
    """Rows (bucket, i, j, cid, sig), whole groups by (bucket, i, j) -> edges from each member to the least of its part, less those that connect nothing new within a task."""

    def run(batches):
        import pyarrow as pa

        held, rows = Forest(), lambda found: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])
        for t in whole_groups(batches, ["bucket", "i", "j"]):
            cid = t["cid"].to_numpy()
            sigs = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, width)
            at = _edges_of([t[k].to_numpy() for k in ("bucket", "i", "j")])
            n = np.diff(at)
            pair = at[:-1][n == 2]
            hit = pair[survivors(sigs[pair], sigs[pair + 1], plan)] if len(pair) else pair
            a, b = [cid[hit]], [cid[hit + 1]]
            for g in np.flatnonzero(n > 2):
                lo, hi = at[g], at[g + 1]
                root = bucket_parts(sigs[lo:hi], plan)
                joined = np.flatnonzero(root != np.arange(hi - lo))
                a.append(cid[lo:hi][joined])
                b.append(cid[lo:hi][root[joined]])
            if (found := held.add(np.concatenate(a), np.concatenate(b))) is not None:
                yield rows(found)
        yield rows(held.rest())

    return run


def linked_pairs(sets: list[np.ndarray], threshold: float, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Matrix left x right: whether the exact similarity reaches the threshold. Only hashes in two sets or more are multiplied."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    column = np.cumsum(count > 1) - 1
    owner, col = owner[shared], column[inverse[shared]]
    both = np.zeros((len(left), len(right)))
    width = max(1, (1 << 22) // len(sets))
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    for c in range(0, int((count > 1).sum()), width):
        lo, hi = np.searchsorted(col, [c, c + width])
        x = np.zeros((len(sets), width), np.float32)
        x[owner[lo:hi], col[lo:hi] - c] = 1
        both += x[left] @ x[right].T
    union = size[left][:, None] + size[right][None, :] - both
    return both >= threshold * union - 1e-9


def _verify(threshold: float):
    """Rows (comp, i, j, block, cid, copies, hashes) -> (cid, links, null), a row for each member of each pair of blocks, and (cid, 0, root) for a forest of the links."""

    def run(batches):
        import pyarrow as pa

        held, rows = Forest(), lambda *found: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["cid", "links", "root"])
        edges = lambda found: rows(found[0], np.zeros(len(found[0]), np.int64), found[1])
        for t in whole_groups(batches, ["comp", "i", "j"]):
            cid, copies, block = (t[k].to_numpy() for k in ("cid", "copies", "block"))
            blobs = t["hashes"].to_pylist()
            i, j = t["i"].to_numpy(), t["j"].to_numpy()
            at = _edges_of([t["comp"].to_numpy(), i, j])
            links, root = np.zeros(len(cid), np.int64), cid.copy()
            for lo, hi in zip(at[:-1], at[1:]):
                sets = [np.frombuffer(x, np.uint64) for x in blobs[lo:hi]]
                inside = np.arange(hi - lo)
                if i[lo] == j[lo]:
                    left = right = inside
                    hit = linked_pairs(sets, threshold, left, right)
                    np.fill_diagonal(hit, False)
                    links[lo:hi] = hit @ copies[lo:hi]
                else:
                    left, right = inside[block[lo:hi] == i[lo]], inside[block[lo:hi] == j[lo]]
                    hit = linked_pairs(sets, threshold, left, right)
                    links[lo + left], links[lo + right] = hit @ copies[lo:hi][right], hit.T @ copies[lo:hi][left]
                label = inside.copy()
                for r, row in enumerate(hit):
                    near = np.r_[left[r], right[row]]
                    found = np.unique(label[near])
                    if len(found) > 1:
                        label[np.isin(label, found)] = found[0]
                root[lo:hi] = cid[lo:hi][label]
            yield rows(cid, links, [None] * len(cid))
            joined = cid != root
            if (found := held.add(cid[joined], root[joined])) is not None:
                yield edges(found)
        yield edges(held.rest())

    return run


def _verify_pairs(threshold: float):
    """Rows (a, b, copies of both, hashes of both) -> (cid, links, root) for both of a pair that reaches the threshold."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b, of_a, of_b = (batch.column(k).to_numpy() for k in range(4))
            hit = np.zeros(len(a), bool)
            for r, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit[r] = both >= threshold * (len(x) + len(y) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[a[hit], b[hit]]), pa.array(np.r_[of_b[hit], of_a[hit]]), pa.array(np.r_[a[hit], a[hit]])], ["cid", "links", "root"])

    return run


def _sparse_pairs(sizes: DataFrame, members: DataFrame, rows: DataFrame, bands: int) -> tuple[DataFrame, DataFrame] | None:
    """Of groups of several blocks those in which fewer sets would travel by pairs that share a bucket than by pairs of blocks, as in a chain of near copies; and their pairs. None if there are none."""
    big = sizes.where("cuts > 1")
    if not big.limit(1).count():
        return None
    inside = members.select("cid", "comp").join(bounded_broadcast(big), "comp")
    own = rows.join(inside, "cid")
    shared = own.groupBy("comp", "sets", "cuts", "bucket").agg(F.count(F.lit(1)).cast("double").alias("m")).groupBy("comp", "sets", "cuts").agg(F.sum(F.col("m") * (F.col("m") - 1)).alias("met"))
    # A pair is met once for each bucket that it shares. Pairs of numbers are narrow, so they are made wherever they take no more room than the sets.
    maybe = cut(shared.where(F.col("met") < F.col("sets") * F.col("cuts") * F.lit(float(bands))).select("comp"))
    if not maybe.limit(1).count():
        return None
    own = own.join(maybe, "comp", "left_semi").select("comp", "sets", "cuts", "bucket", "cid")
    pairs = own.withColumnRenamed("cid", "cid_a").join(own.select("comp", "bucket", F.col("cid").alias("cid_b")), ["comp", "bucket"]).where("cid_a < cid_b")
    pairs = cut(pairs.select("comp", "sets", "cuts", "cid_a", "cid_b").distinct())
    sparse = cut(pairs.groupBy("comp", "sets", "cuts").agg(F.count(F.lit(1)).alias("pairs")).where("2 * pairs < cast(sets AS double) * cuts").select("comp"))
    if not sparse.limit(1).count():
        return None
    return sparse, pairs.join(sparse, "comp", "left_semi").select("cid_a", "cid_b")


def _rehash(shingle: int):
    """Rows with their text last -> the same columns with the sorted hashes of its set."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, bounds = utf8_buffer(batch.column(batch.num_columns - 1))
            for a, b in slices_by_bytes(np.diff(bounds), PIECE):
                sets = shingle_hashes(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], shingle)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns[:-1], pa.array([s.tobytes() for s in sets], pa.binary())], [*own.schema.names[:-1], "hashes"])

    return run


def _blocks(parts, of: str):
    """Columns of the member's block and of the pairs of blocks in which it takes part, for a group cut into `parts` blocks."""
    own = F.pmod(F.xxhash64(of), parts.cast("long")).cast("int")
    return own, F.transform(F.sequence(F.lit(0), parts - 1), lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")))


def _dealt(df: DataFrame, group: str, parts: int) -> DataFrame:
    """df with the pairs (i, j) of a group's blocks in turn on one partition after another, so that a large group's pairs are spread evenly; sorted by pair."""
    turn = F.floor(F.col("j").cast("long") * (F.col("j") + 1) / F.lit(2)) + F.col("i")
    at = F.pmod(F.pmod(F.xxhash64(group), F.lit(parts)) + turn, F.lit(parts)).cast("int")
    return df.repartitionById(parts, at).sortWithinPartitions(group, "i", "j", "cid")


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows_in_band: int = ROWS_IN_BAND,
    tolerance: float = TOLERANCE,
    bucket_block: int = BUCKET_BLOCK,
    group_block: int = GROUP_BLOCK,
    group_bytes: int = GROUP_BYTES,
    seed: int = SEED,
) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (least doc_id of its group), set_id (least doc_id with the same set), n_links (other documents at or above the threshold)."""
    found = _near(docs, shingle, threshold, bands, rows_in_band, tolerance, bucket_block, group_block, group_bytes, seed)
    return found.select("doc_id", "class_id", "set_id", "n_links")


def _near(docs: DataFrame, shingle: int, threshold: float, bands: int, rows_in_band: int, tolerance: float, bucket_block: int, group_block: int, group_bytes: int, seed: int) -> DataFrame:
    """near_duplicates with mark, a hash of the text, and stays: whether the row's doc_id and text are the first of its group."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    short_batches(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = bands * rows_in_band
    plan = least_matches(width, STEP_HASHES, threshold, tolerance)
    texts = docs.select("doc_id", F.xxhash64(clean_text()).alias("mark"), clean_text().alias("text"))
    facts = cut(texts.mapInArrow(_sketches(shingle, bands, rows_in_band, seed), f"doc_id {id_type}, mark long, k1 long, k2 long, n int, buckets array<long>, sig binary"))
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))  # a null doc_id comes last
    classes = facts.where("n > 0").groupBy("k1", "k2").agg(least_row.alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.first("sig").alias("sig"))
    classes = classes.select("k1", "k2", "n", F.col("least.doc_id").alias("set_id"), F.col("least.mark").alias("set_mark"), "copies", "buckets", "sig")
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))
    rows = classes.select("cid", F.explode("buckets").alias("bucket"))
    full = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = rows.join(full, "bucket").groupBy("cid").agg(F.collect_list(F.struct("bucket", "size")).alias("shared"))
    shared = shared.join(classes.select("cid", "sig"), "cid").select("cid", "sig", F.explode("shared").alias("s")).select("cid", "sig", "s.bucket", "s.size")
    _, pairs = _blocks(F.ceil(F.col("size") / F.lit(bucket_block)).cast("int"), "cid")
    dealt = shared.select("bucket", F.explode(pairs).alias("pair"), "cid", "sig").select("bucket", "pair.i", "pair.j", "cid", "sig")
    edges = cut(_dealt(dealt, "bucket", parts).mapInArrow(_compare_buckets(width, plan), "a long, b long"))
    groups = connected_components(_merged(edges))
    members = groups.withColumnsRenamed({"node": "cid", "component": "comp"}).join(classes.select("cid", "k1", "k2", "n", "set_id", "set_mark", "copies"), "cid")
    members = cut(members)
    # A block has at most group_block sets on average, fewer where pairs of blocks would not go round all partitions, and about group_bytes of hashes unless one set alone has more.
    sizes = cut(members.groupBy("comp").agg(F.count(F.lit(1)).alias("sets"), (F.sum(F.col("n").cast("long")) * F.lit(8)).alias("bytes")))
    pairs_of_sets = sizes.agg(F.sum(F.col("sets").cast("double") * F.col("sets"))).first()[0] or 0.0
    block_sets = min(group_block, max(LEAST_BLOCK, int((pairs_of_sets / (2 * parts)) ** 0.5)))
    cuts = F.greatest(F.ceil(F.col("sets") / F.lit(block_sets)), F.ceil(F.col("bytes") / F.lit(group_bytes)))
    sizes = sizes.select("comp", "sets", F.least(F.col("sets"), cuts).cast("int").alias("cuts"))
    loose = _sparse_pairs(sizes, members, rows, bands)
    sizes = sizes.drop("sets")
    wanted = members.join(sizes, "comp").drop("n")
    # One text speaks for its class; another of its doc_id and hash would be given away by its set. Rows that are repeated whole are looked at once.
    speaking = texts
    if facts.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count():
        speaking = texts.join(wanted.select(F.col("set_id").alias("doc_id_"), F.col("set_mark").alias("mark_")).distinct(), F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("mark") == F.col("mark_")), "left_semi").dropDuplicates(["doc_id", "mark"])
    spoken = speaking.join(wanted, F.col("doc_id").eqNullSafe(F.col("set_id")) & (F.col("mark") == F.col("set_mark"))).select("cid", "comp", "cuts", "copies", "k1", "k2", "text")
    hashed = spoken.mapInArrow(_checked(_rehash(shingle)), "cid long, comp long, cuts int, copies long, k1 long, k2 long, hashes binary")
    block, pairs = _blocks(F.col("cuts"), "cid")
    by_pair = None
    if loose is not None:
        sparse, asked = loose
        own = cut(hashed.join(sparse, "comp", "left_semi").select("cid", "copies", "hashes"))
        named = lambda side: own.toDF(*[f"{c}_{side}" for c in own.columns])
        by_pair = asked.join(named("a"), "cid_a").join(named("b"), "cid_b").select("cid_a", "cid_b", "copies_a", "copies_b", "hashes_a", "hashes_b")
        by_pair = by_pair.mapInArrow(_verify_pairs(threshold), "cid long, links long, root long")
        hashed = hashed.join(sparse, "comp", "left_anti")
    units = hashed.select("comp", F.explode(pairs).alias("pair"), block.alias("block"), "cid", "copies", "hashes").select("comp", "pair.i", "pair.j", "block", "cid", "copies", "hashes")
    verified = _dealt(units, "comp", parts).mapInArrow(_verify(threshold), "cid long, links long, root long")
    verified = cut(verified if by_pair is None else verified.unionByName(by_pair))
    final = connected_components(_merged(verified.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b"))))
    links = verified.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("cid", "k1", "k2", "set_id", "set_mark", "copies").join(links, "cid", "left").join(final.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.withColumn("component", F.coalesce("component", "cid"))
    first = F.min(F.struct(F.col("set_id").isNull().alias("none"), "set_id", "set_mark"))
    least = known.groupBy("component").agg(first.alias("first")).select("component", F.col("first.set_id").alias("class_id"), F.col("first.set_mark").alias("class_mark"))
    known = known.join(least, "component").select("k1", "k2", "set_id", "class_id", "class_mark", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = cut(known)
    stays = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark"))
    some = facts.where("n > 0").select("doc_id", "mark", "k1", "k2").join(known, ["k1", "k2"]).select("doc_id", "mark", "class_id", "set_id", "n_links", stays.alias("stays"))
    none = facts.where("n = 0").select("doc_id", "mark", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays"))
    return some.unionByName(none)


def _checked(rehash):
    """Rows whose set is not that of their class are left out."""

    def run(batches):
        import pyarrow as pa

        for batch in rehash(batches):
            k1, k2 = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            fine = []
            for r, blob in enumerate(batch.column(6).to_pylist()):
                s = np.frombuffer(blob, np.uint64)
                a = mix64(s).sum(dtype=np.uint64).astype(np.int64)
                b = mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)
                if a == k1[r] and b == k2[r]:
                    fine.append(r)
            yield batch if len(fine) == batch.num_rows else batch.take(pa.array(fine, pa.int64()))

    return run


def keep_one(
    docs: DataFrame,
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows_in_band: int = ROWS_IN_BAND,
    tolerance: float = TOLERANCE,
    bucket_block: int = BUCKET_BLOCK,
    group_block: int = GROUP_BLOCK,
    group_bytes: int = GROUP_BYTES,
    seed: int = SEED,
) -> DataFrame:
    """The rows of docs with the first doc_id (null last) and text of their group, with docs' columns; a doc_id's other texts stand for themselves."""
    found = _near(docs, shingle, threshold, bands, rows_in_band, tolerance, bucket_block, group_block, group_bytes, seed)
    gone = cut(found.where("NOT stays").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct())
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark"))
    return rows_of(docs, id=F.col("doc_id"), mark=F.xxhash64(clean_text())).join(bounded_broadcast(gone), same, "left_anti").select("row.*")


def op5_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


#: Every pair by the n-grams it shares, and components by reaching; for small tables with distinct doc_ids.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS gram FROM w, range(1, 100000) r(i) WHERE i <= greatest(len(w) - 4, least(len(w), 1))),
n AS (SELECT w.doc_id, count(gram) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b, c = x.n AND c = y.n AS same FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id),
g AS (SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(*) AS n_links, min(b) FILTER (same) AS twin FROM l GROUP BY a)
SELECT g.doc_id, class_id, least(g.doc_id, coalesce(twin, g.doc_id)) AS set_id, coalesce(n_links, 0) AS n_links, g.doc_id = class_id AS kept FROM g LEFT JOIN k ON k.doc_id = g.doc_id
"""
