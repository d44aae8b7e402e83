"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of a fixed number of characters. The distinct blocks are dealt to
buckets, each bucket is sorted by content, and a block's integer name is its bucket and its place there;
then names are paired with their right neighbours and the distinct pairs are sorted and named in turn,
until each document has one name. A name stands for one content, which hashes only choose the bucket of,
so two documents have the same number of blocks and the same last name exactly when their texts are equal.

Only documents that share their length and 64-bit hash with another row are named: for all others the
pair of length and hash is an identity already, as equal texts have equal hashes, so no collision can join two of
them (what naming all costs is in the README). Each round of names is
written to the shared folder, which fixes the integers and cuts the lineage. A round's names stand on
distinct blocks, so thousands of copies add one row to a sort, and the way back to the documents is an
equi-join whose hot keys adaptive execution splits.

Rows with null text count as the empty text. A null doc_id is compared as any value is and sorts last.
Repeated rows are further members of their group; those that carry the smallest doc_id all stay in
`exact_groups`, and `drop_copies` keeps one of them; rows that share a doc_id, or have none, and differ
in text are no copies and stay. An empty table gives an empty result. Columns of the
input other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triadic.llm.common import SPACES, bounded_broadcast, clean_text, cut, rows_of

BLOCK_CHARS, STRETCH = 4096, 256


def normalised(text):
    """Each run of white space becomes one space; a text that has none but single spaces is left alone."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, SPACES, " ")).otherwise(plain)


def _sorted_names(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The distinct rows of these columns, with the number of their partition and their place in its sorted order as one integer.

    A sort over all partitions would need a sample of whole blocks on the driver; the partitions of the
    distinct rows do as well, since names need an order within each only.
    """
    ordered = df.select(*columns).distinct().sortWithinPartitions(*columns)
    return cut(ordered.withColumn(name, F.monotonically_increasing_id()))


def _cut_up(texts: DataFrame, block_chars: int) -> DataFrame:
    """(key, body) -> (key, blocks, at, block), a row for each block, one at least. Texts are first cut into stretches of STRETCH blocks, as a row with a long text is copied for each part of it."""
    blocks = lambda text, n: F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(n))).cast("int")
    part = lambda text, at, n: F.expr(f"substring({text}, {at} * {n} + 1, {n})")
    numbered = lambda text, n: F.explode(F.sequence(F.lit(0), blocks(text, n) - 1))
    long = block_chars * STRETCH
    stretches = texts.select("key", blocks("body", block_chars).alias("blocks"), numbered("body", long).alias("st"), "body").select("key", "blocks", "st", part("body", "st", long).alias("body"))
    cut_up = stretches.select("key", "blocks", "st", numbered("body", block_chars).alias("i"), "body")
    return cut_up.select("key", "blocks", (F.col("st") * STRETCH + F.col("i")).alias("at"), part("body", "i", block_chars).alias("block"))


def named_identities(texts: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(key, body) -> (key, blocks, name): one collision-free identity for each body. key must be unique."""
    blocks = cut(_cut_up(texts, block_chars))
    names = _sorted_names(blocks, ["block"], "name")
    level = cut(blocks.join(names, "block").select("key", "blocks", "at", "name"))
    done, most = [level.where("blocks = 1").select("key", "blocks", "name")], level.agg(F.max("blocks")).first()[0] or 1
    level, width = level.where("blocks > 1"), 1
    while width < most:
        half = F.expr("at div 2")
        pairs = level.groupBy("key", "blocks", half.alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = cut(pairs)
        names = _sorted_names(pairs, ["left", "right"], "name")
        level = cut(pairs.join(names, ["left", "right"]).select("key", "blocks", "at", "name"))
        width *= 2
        finished = F.col("blocks") <= width
        done.append(level.where(finished).select("key", "blocks", "name"))
        level = level.where(~finished)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _groups(docs: DataFrame, block_chars: int) -> DataFrame:
    """exact_groups with mark, a hash of the text as it stands."""
    body = normalised(clean_text())
    facts = docs.select("doc_id", F.xxhash64("text").alias("mark"), body.alias("body"))
    facts = cut(facts.select("doc_id", "mark", F.xxhash64("body").alias("h"), F.length("body").alias("n"), F.sha2("body", 256).alias("text_sha256")))
    shared = facts.groupBy("h", "n").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("h", "n")
    shared = cut(shared)  # the join below then has two plain exchanges, and hot hashes can be split
    texts = docs.select("doc_id", body.alias("body")).select("doc_id", "body", F.xxhash64("body").alias("h"), F.length("body").alias("n"))
    texts = texts.join(shared, ["h", "n"], "left_semi").select(F.struct("doc_id", "h", "n").alias("key"), "body")
    identity = named_identities(texts, block_chars).groupBy("key").agg(F.max("blocks").alias("blocks"), F.max("name").alias("name"))
    identity = identity.select(F.col("key.doc_id").alias("other_id"), F.col("key.h").alias("other_h"), F.col("key.n").alias("other_n"), "blocks", "name")
    facts = facts.join(identity, F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("h") == F.col("other_h")) & (F.col("n") == F.col("other_n")), "left")
    one = F.struct("h", "n", F.coalesce("blocks", F.lit(-1)).alias("blocks"), F.coalesce("name", F.lit(-1)).alias("name"))
    facts = cut(facts.select("doc_id", "mark", "text_sha256", one.alias("class")))
    groups = facts.groupBy("class").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = facts.join(cut(groups), "class")  # two plain exchanges, so that a hot class can be split
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "mark")


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256."""
    return _groups(docs, block_chars).drop("mark")


def drop_copies(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that stay, with docs' columns; of rows that share doc_id and text, one."""
    groups = cut(_groups(docs, block_chars).select("doc_id", "mark", "kept", "text_sha256"))
    gone = groups.where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    same = F.col("id").eqNullSafe(F.col("gone_id")) & F.col("mark").eqNullSafe(F.col("gone_mark"))
    out = rows_of(docs, id=F.col("doc_id"), mark=F.xxhash64("text")).join(bounded_broadcast(gone), same, "left_anti")
    # Rows that stay share doc_id and text only if they are repeated; the texts are shuffled for that only where it occurs.
    repeated = groups.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count()
    if repeated:
        out = out.withColumn("sha", F.sha2(normalised(F.coalesce("row.text", F.lit(""))), 256)).dropDuplicates(["id", "sha"])
    return out.select("row.*")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""
