"""What several operators of this subpackage share: checkpoints, slices of Arrow batches, hashing in numpy."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> None:
    """Uses the folder that the cluster names in spark.checkpoint.dir. Where it names none, a temporary one is set in local mode; a cluster is refused, as its machines share no such folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context._jsc.sc().isLocal():
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="triadic-checkpoints-"))


#: Rows of an Arrow batch to and from Python. Texts are long, and a batch is held whole on both sides.
BATCH_ROWS = 512


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch to BATCH_ROWS, unless they are fewer already.

    Plans read this setting when they run, after an operator has returned, so it stays lowered.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there: a lost executor then costs a read, not a rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_settings(df: DataFrame, settings: dict[str, str]) -> DataFrame:
    """df, and what is made of it, planned in a copy of its session that has other settings; the session itself stays as it is."""
    spark = df.sparkSession
    own = spark._jsparkSession.cloneSession()
    for name, value in settings.items():
        own.conf().set(name, value)
    return _in_session(df, own)


def in_own_session(df: DataFrame, like: DataFrame) -> DataFrame:
    """df planned in the session of `like` again."""
    return _in_session(df, like._jdf.sparkSession())


def without_estimates(df: DataFrame) -> DataFrame:
    """df, a checkpoint, as a table whose size the planner does not guess. A checkpoint keeps the guess of its plan, which is a product over joins, so in a loop its digits double with each round."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), spark)


def _in_session(df: DataFrame, session) -> DataFrame:
    dataset = df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset
    return DataFrame(dataset.ofRows(session, df._jdf.queryExecution().logical()), df.sparkSession)


#: What is broadcast holds no more bytes than this, as counted from its values.
MOST_BYTES = 32 << 20


def bounded_broadcast(df: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """df is broadcast if its values take no more than `most_bytes`, which is summed first; else the join is left to shuffle and to split hot keys."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        plain = f.dataType.simpleString() in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")
        width = width + (F.lit(16) if plain else F.lit(16) + F.coalesce(F.octet_length(F.col(quoted(f.name)).cast("string")), F.lit(0)))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most_bytes else df


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def map_arrow(df: DataFrame, run, schema: StructType) -> DataFrame:
    """df.mapInArrow, by place: columns go in and out under plain names, as PySpark cannot look up names with dots there."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    shape = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return plain.mapInArrow(run, shape).toDF(*schema.names)


def rows_of(docs: DataFrame, **columns: Column) -> DataFrame:
    """docs' rows as one column `row`, beside the columns given: names of docs cannot clash with those of an operator. Give rows back by select("row.*")."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def clean_text(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def slices_by_bytes(sizes: np.ndarray, limit: int):
    """Ranges of rows of about limit bytes together, one row at least; no row is left out."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += int(n)
    if lo < len(sizes):
        yield lo, len(sizes)


def utf8_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column one after the other, and where each row starts (one more entry for the end); null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if column.offset:
        column = pa.concat_arrays([column])
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]
