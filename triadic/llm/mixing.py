"""Mixing sources to target weights, with DataFrame and SQL functions only.

Each source's documents are permuted by a hash of seed, doc_id and text, and the permuted order is cut into
blocks of about `block_docs` documents. A source whose target is t times its size runs through all its
blocks floor(t) times and then draws, once more, the first blocks of its permuted order up to its target
(in the last block, documents that fit into what is left); so draws are disjoint within a pass and no
document comes more often than `max_repeats` times.

The blocks so drawn go to `shards` output shards by a multivariate-hypergeometric splitting tree. A node
holds each source's exact number of blocks. It draws how many of them go to its left half without
replacement from the whole urn, source after source, each from the hypergeometric distribution given
what is left (by inversion around the mode, with a hashed uniform number that depends on seed, node and
source only), and the rest goes right; after log2(shards) levels each shard has a quota of blocks of each
source, and the quotas of a source add up to its blocks. A source's blocks, in permuted order, are dealt
to the shards by those quotas, and a hash orders the documents within a shard.

What is gathered for each source: one row with its totals, and an array of sources in each of at most
2 * shards tree nodes. Documents meet their block's decision by an equi-join on (source, block), whose
keys are about block_docs documents each, so a hot source is spread over all its blocks; where all blocks'
decisions are few bytes they are broadcast and the documents stay where they are.

Null text has size 0; a null source is a source of its own, ordered last. Rows with a null or a repeated
doc_id are documents of their own, dealt by their texts. Rows that are repeated with their text have equal places
and so one block; in a source's last block they are taken one by one, in any order, as they are alike.
A text of any length is one document with its whole size. A table without words takes nothing; an empty table
gives an empty result. Other columns, of any name, are carried along and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triadic.llm.common import WORD, bounded_broadcast, clean_text, cut, rows_of

WEIGHTS = (5, 2, 1)
SHARE, MAX_REPEATS, BLOCK_DOCS, SHARDS, SEED = 1.5, 2, 256, 16, 17
#: Blocks that are summed up together before running sums are taken; it changes no result.
STRETCH = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row a source, with source and source_size -> the same rows with target.

    Targets share `share` of all sizes by weight, stop at max_repeats times the source's size, and what
    is above goes to the others by weight until none is above. In the end there is one level x with target =
    min(cap, weight * x): with sources ordered by cap / weight, x is the first level that the rest's
    weights can carry. That needs running sums over the sources only.
    """
    named = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    k = len(weights)
    place = F.pmod(F.row_number().over(W.orderBy(*named)) - 1, F.lit(k)).cast("int") + 1
    out = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place)).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), *named)
    whole, before = W.partitionBy(), by_ratio.rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumns(
        {
            "idx": F.row_number().over(by_ratio),
            "budget": F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "carriers": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumn("level", F.col("budget") / F.col("carriers"))
    first = F.min(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.struct("idx", "level"))).over(whole)
    out = out.withColumn("level", first["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level")))
    return out.select(*sources.columns, target.alias("target"))


def hypergeometric(good: str, total: str, draws: str, u: str) -> str:
    """SQL: how many of `draws` balls drawn from `total`, of which `good` are good, are good; by inversion of u.

    Weights relative to the mode's come from the ratio of neighbours, over a range of 12 standard deviations
    (what is beyond weighs under 1e-30), so nothing under- or overflows.
    """
    up = "((q.g - x) * (q.d - x) * 1.0D) / ((x + 1.0D) * (q.t - q.g - q.d + x + 1.0D))"
    with_range = """struct(
        q.g AS g, q.t AS t, q.d AS d, q.u AS u, greatest(0L, q.d + q.g - q.t) AS lo, least(q.g, q.d) AS hi,
        cast(floor((q.d + 1.0D) * (q.g + 1.0D) / (q.t + 2.0D)) AS bigint) AS peak,
        cast(ceil(12 * sqrt(1.0D * q.d * q.g / greatest(q.t, 1L))) + 20 AS bigint) AS reach)"""
    below = f"""aggregate(sequence(q.mode, greatest(q.lo, q.mode - q.reach)), array(struct(q.mode AS x, 1.0D AS w)),
        (acc, x) -> if(x = q.mode, acc, concat(acc, array(struct(x AS x, element_at(acc, -1).w / ({up}) AS w)))))"""
    above = f"""aggregate(sequence(q.mode, least(q.hi, q.mode + q.reach)), array(struct(q.mode AS x, 1.0D AS w)),
        (acc, y) -> if(y = q.mode, acc, concat(acc, transform(array(y - 1L), x -> struct(y AS x, element_at(acc, -1).w * ({up}) AS w)))))"""
    weighed = f"concat(reverse(slice({below}, 2, 1000000000)), {above})"
    pick = """aggregate(q.ws, struct(q.u * aggregate(q.ws, 0.0D, (t, p) -> t + p.w) AS left, cast(null AS bigint) AS x),
        (acc, p) -> if(acc.x IS NOT NULL AND acc.left <= 0, acc, struct(acc.left - p.w AS left, p.x AS x)), acc -> acc.x)"""
    return f"""transform(transform(transform(transform(
        array(struct({good} AS g, {total} AS t, {draws} AS d, {u} AS u)), q -> {with_range}),
        q -> struct(q.g, q.t, q.d, q.u, q.lo, q.hi, q.reach, least(greatest(q.peak, q.lo), q.hi) AS mode)),
        q -> struct(q.u AS u, {weighed} AS ws)), q -> {pick})[0]"""


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(source, quota) -> (source, shard, quota): shards must be a power of two.

    Each node is a row with an array of (source, n); a level draws the left child's array by a running
    draw over the sources and gives the rest to the right child.
    """
    node = quotas.agg(F.array_sort(F.collect_list(F.struct("source", F.col("quota").cast("long").alias("n")))).alias("urn")).select(F.lit(1).cast("long").alias("node"), "urn")
    for _ in range(shards.bit_length() - 1):
        draw = hypergeometric("s.n", "a.total", "a.draws", f"((pmod(xxhash64({seed}, node, s.source), 4503599627370496L) + 0.5D) / 4503599627370496.0D)")
        left = f"""aggregate(urn,
            struct(aggregate(urn, 0L, (t, s) -> t + s.n) AS total, aggregate(urn, 0L, (t, s) -> t + s.n) div 2 AS draws, array(cast(null AS bigint)) AS got),
            (a, s) -> transform(array({draw}), x -> struct(a.total - s.n AS total, a.draws - x AS draws, concat(a.got, array(x)) AS got))[0],
            a -> slice(a.got, 2, 1000000000))"""
        node = node.withColumn("got", F.expr(left))
        node = node.select(
            F.explode(
                F.expr(
                    "array(struct(node * 2 AS node, zip_with(urn, got, (s, x) -> struct(s.source AS source, x AS n)) AS urn),"
                    " struct(node * 2 + 1 AS node, zip_with(urn, got, (s, x) -> struct(s.source AS source, s.n - x AS n)) AS urn))"
                )
            ).alias("child")
        ).select("child.*")
    return node.select((F.col("node") - shards).cast("int").alias("shard"), F.explode("urn").alias("s")).select("shard", "s.source", F.col("s.n").alias("quota"))


def _placed(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """rows (with source and at) with block, which follows from the place in the permuted order alone; the hot source has most blocks."""
    block = F.floor((F.col("at").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) * F.col("n_blocks")).cast("long")
    named = bounded_broadcast(facts.select(F.col("source").alias("s"), "n_blocks"))
    return rows.join(named, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.least(block, F.col("n_blocks") - 1)).drop("s", "n_blocks")


def _running(blocks: DataFrame) -> DataFrame:
    """blocks (source, block, words) with upto (words up to and with the block), rank and n_blocks, by sums over stretches of blocks first, so that no task holds all blocks of a source."""
    staged = blocks.withColumn("stretch", F.floor(F.col("block") / F.lit(STRETCH)))
    sums = staged.groupBy("source", "stretch").agg(F.sum("words").alias("own"), F.count(F.lit(1)).alias("own_n"))
    before = W.partitionBy("source").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumns({"base": F.coalesce(F.sum("own").over(before), F.lit(0)), "base_n": F.coalesce(F.sum("own_n").over(before), F.lit(0)), "n_blocks": F.sum("own_n").over(W.partitionBy("source"))})
    sums = sums.select(F.col("source").alias("s"), F.col("stretch").alias("st"), "base", "base_n", "n_blocks")
    run = W.partitionBy("source", "stretch").orderBy("block")
    out = staged.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("stretch") == F.col("st")))
    out = out.withColumn("upto", F.col("base") + F.sum("words").over(run)).withColumn("rank", F.col("base_n") + F.row_number().over(run) - 1)
    return out.drop("stretch", "s", "st", "base", "base_n")


def _decided(sized: DataFrame, weights, share: float, max_repeats: int, block_docs: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """From a checkpoint of (source, size, at): sources (with n_blocks), and what is decided for each block: (s, b, source_size, target, passes, extra, room, dealt)."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    totals = totals.withColumn("n_blocks", F.ceil(F.col("n") / F.lit(block_docs)).cast("long"))
    facts = source_targets(totals, weights, share, max_repeats)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0)).cast("long")
    facts = facts.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    facts = cut(facts.drop("n"))
    blocks = _running(_placed(sized, facts).groupBy("source", "block").agg(F.sum("size").alias("words")))
    blocks = blocks.join(facts.drop("n_blocks").withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    before = F.col("upto") - F.col("words")
    state = F.when(F.col("rest") < 0.5, F.lit(-1)).when(F.col("upto") <= F.col("rest"), F.lit(1)).when(before < F.col("rest"), F.lit(0)).otherwise(F.lit(-1))
    blocks = cut(blocks.withColumns({"extra": state, "room": F.col("rest") - before}))
    # Draws: every block once a pass, and the blocks of the last, partial pass (its last block may be taken in part).
    draws = blocks.where("passes > 0 OR extra >= 0").select(
        "source", "block", F.explode(F.expr("sequence(0, cast(passes AS int) + if(extra >= 0, 1, 0) - 1)")).alias("pass"), "rank", "n_blocks"
    )
    draws = draws.withColumn("turn", F.col("pass") * F.col("n_blocks") + F.col("rank"))
    quotas = draws.groupBy("source").agg(F.count(F.lit(1)).alias("quota"))
    tree = splitting_tree(quotas, shards, seed)
    span = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)
    tree = tree.withColumn("hi", F.sum("quota").over(span)).where("quota > 0")
    dealt = tree.select(F.col("source").alias("s"), "shard", F.explode(F.expr("sequence(hi - quota, hi - 1)")).alias("t"))
    placed_draws = draws.join(dealt, draws.source.eqNullSafe(dealt.s) & (F.col("turn") == F.col("t"))).groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    decided = blocks.join(placed_draws.withColumnsRenamed({"source": "s", "block": "b"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    return facts, decided.select(F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", "passes", "extra", "room", "dealt")


def _at(seed: int) -> Column:
    """A document's place in the permuted order: rows of one doc_id, or of none, have their texts' places."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _taken(rows: DataFrame, facts: DataFrame, decided: DataFrame, seed: int) -> DataFrame:
    """rows (row, doc_id, source, size, at) with repeats, shards and position; what is in row is carried along."""
    met = _placed(rows, facts).join(bounded_broadcast(decided), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    partial = _filled(met.where("extra = 0"))
    rest = met.where("extra <> 0").withColumn("more", (F.col("extra") == 1).cast("int"))
    out = rest.unionByName(partial).withColumn("repeats", (F.col("passes") + F.col("more")).cast("int"))
    out = out.withColumn("shards", F.expr("transform(filter(coalesce(dealt, array()), d -> d.pass < repeats), d -> d.shard)"))
    return out.withColumn("position", F.xxhash64(F.lit(seed + 1), "at"))


def mix_decisions(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    block_docs: int = BLOCK_DOCS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken, repeats, shards (of each draw) and position (order in a shard)."""
    rows = cut(docs.select("doc_id", "source", word_count(clean_text()).alias("size"), _at(seed).alias("at")))
    out = _taken(rows, *_decided(rows, weights, share, max_repeats, block_docs, shards, seed), seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", "shards", "position")


def _filled(rows: DataFrame, rounds: int = 4) -> DataFrame:
    """Which documents of a source's last block are taken (more): what fits into room, in permuted order.

    A round takes, of the documents that are not longer than what is left, the first ones that fit together;
    the next round goes on with what is left then. In the end the shortest of the others is taken if that brings
    the sum nearer to room. A block is small, and all rounds share its one shuffle.
    """
    block = W.partitionBy("source", "block")
    run = block.orderBy("at", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({"more": F.lit(0), "left": F.col("room").cast("double"), "serial": F.row_number().over(block.orderBy("at", "doc_id", "size"))})
    for _ in range(rounds):
        fits = F.when((F.col("more") == 0) & (F.col("size") <= F.col("left")), F.col("size"))
        out = out.withColumn("fits", fits).withColumn("upto", F.sum("fits").over(run))
        out = out.withColumn("new", (F.col("fits").isNotNull() & (F.col("upto") <= F.col("left"))).cast("int"))
        out = out.withColumn("left", F.col("left") - F.sum(F.col("new") * F.col("size")).over(block)).withColumn("more", F.col("more") + F.col("new"))
    shortest = F.min(F.when((F.col("more") == 0) & (F.col("size") > 0), F.struct("size", "serial"))).over(block)
    last = (F.col("more") == 0) & (F.struct("size", "serial") == F.col("shortest")) & (F.col("size") < 2 * F.col("left"))
    out = out.withColumn("shortest", shortest).withColumn("more", F.when(F.coalesce(last, F.lit(False)), 1).otherwise(F.col("more")))
    return out.drop("left", "serial", "fits", "upto", "new", "shortest")


def mixed(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    block_docs: int = BLOCK_DOCS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """The documents that the mix takes, each as often as it is taken, with docs' columns, in shards and shuffled within them.

    A partition holds rows of one shard only, and a shard has the same number of partitions, one after another.
    Each row is decided on by itself, by its block, so rows that share doc_id, size or even text are not taken for each other.
    """
    size = word_count(clean_text())
    sized = cut(docs.select("source", size.alias("size"), _at(seed).alias("at")))
    facts, decided = _decided(sized, weights, share, max_repeats, block_docs, shards, seed)
    rows = rows_of(docs, doc_id=F.col("doc_id"), source=F.col("source"), size=size, at=_at(seed))
    out = _taken(rows, facts, decided, seed).select("row", "position", F.explode("shards").alias("shard"))
    parts = -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    part = F.pmod("position", F.lit(parts)).cast("int")
    out = out.repartitionById(shards * parts, F.col("shard") * F.lit(parts) + part)
    return out.sortWithinPartitions("position").select("row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """What op2 aims at, which SQL can express; its draws hang on hashes."""
    return op2_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


#: Weights are shared round by round: sources above their cap get it, the rest is shared again.
TARGETS_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1] AS w FROM d GROUP BY source),
g(round, source, n, w, target) AS (
    SELECT 0, source, n, w, NULL::DOUBLE FROM s
    UNION ALL
    SELECT round + 1, source, n, w, CASE WHEN target IS NOT NULL THEN target WHEN w * level > 2 * n THEN 2.0 * n END
    FROM (SELECT *, (1.5 * sum(n) OVER () - coalesce(sum(target) OVER (), 0)) / sum(w) FILTER (target IS NULL) OVER () AS level FROM g) WHERE round < (SELECT count(*) FROM s)),
l AS (SELECT source, n, coalesce(target, w * (1.5 * sum(n) OVER () - coalesce(sum(target) OVER (), 0)) / sum(w) FILTER (target IS NULL) OVER ()) AS target FROM g WHERE round = (SELECT count(*) FROM s))
SELECT doc_id, size, l.n AS source_size, round(l.target, 4) AS target FROM d JOIN l ON l.source IS NOT DISTINCT FROM d.source
"""
