"""Fields (t, p, v, value) from the event, embedding, line item and order tables, and from a recipe of waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(ts: Column, seconds: int) -> Column:
    """Whole steps of so many seconds since 1970, in the session's time zone."""
    return F.floor((F.unix_timestamp(ts.cast("timestamp")) - F.unix_timestamp(F.lit("1970-01-01 00:00:00").cast("timestamp"))) / F.lit(seconds)).cast("long")


def zero_filled(rows: DataFrame, measures: list[Column]) -> DataFrame:
    """Rows (tick, name, ...) -> sums on every (t, p, v), 0 where there are none.

    Times run from the first tick of the table to its last, points are its names in order (null last), v numbers the
    measures. Rows without a tick have no place. The driver sees the two ends and the number of names.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col("tick").isNotNull())
    names = rows.select("name").distinct().withColumn("p", F.row_number().over(W.orderBy(F.col("name").asc_nulls_last())).cast("long") - 1)
    ends, n = rows.agg(F.min("tick"), F.max("tick")).first(), names.count()
    first, last = ends if n else (0, -1)
    calendar = spark.range(last - first + 1).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)).cast("array<bigint>")).alias("p"))
    known = names.withColumnRenamed("name", "known")
    placed = rows.withColumn("t", F.col("tick") - F.lit(first)).join(known, F.col("name").eqNullSafe(F.col("known")))
    sums = placed.groupBy("t", "p").agg(*[m.alias(f"m{i}") for i, m in enumerate(measures)])
    full = calendar.join(sums, ["t", "p"], "left")
    values = F.array(*[F.coalesce(F.col(f"m{i}").cast("double"), F.lit(0.0)) for i in range(len(measures))])
    return full.select("t", "p", F.posexplode(values).alias("v", "value"))


def events(spark: SparkSession, sf_dir: str, every: str = "hour", measures=("sum",), scale: float = 1.0) -> DataFrame:
    """Events by hour or day and event type."""
    rows = table(spark, sf_dir, "events").select(ticks(F.col("ts"), {"hour": 3600, "day": 86400}[every]).alias("tick"), F.col("event_type").alias("name"), "value")
    known = {"count": F.count(F.lit(1)), "sum": F.sum("value"), "max": F.max("value")}
    return zero_filled(rows, [known[m] / F.lit(scale) for m in measures])


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as samples in time, their dimensions as points."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("p", "value")).select("t", F.col("p").cast("long").alias("p"), F.lit(0).alias("v"), F.col("value").cast("double").alias("value"))


def lineitem_daily(spark: SparkSession, sf_dir: str, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Quantity and extended price by ship date and flags."""
    rows = table(spark, sf_dir, "lineitem").select(ticks(F.col("l_shipdate"), 86400).alias("tick"), F.concat("l_returnflag", "l_linestatus").alias("name"), "l_quantity", "l_extendedprice")
    return zero_filled(rows, [F.sum("l_quantity") / F.lit(scale[0]), F.sum("l_extendedprice") / F.lit(scale[1])])


def orders_daily(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """Total price of orders by day and priority."""
    rows = table(spark, sf_dir, "orders").select(ticks(F.col("o_orderdate"), 86400).alias("tick"), F.col("o_orderpriority").alias("name"), "o_totalprice")
    return zero_filled(rows, [F.sum("o_totalprice") / F.lit(scale)])


def waves(spark: SparkSession, frequencies, wavenumbers, nt: int = 1280, nx: int = 100, dt: float = 1.0) -> DataFrame:
    """A sum of travelling cosines on nx points of [0, 2 pi)."""
    grid = spark.range(nt).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1)).cast("array<bigint>")).alias("p"))
    x = F.col("p") * F.lit(2.0) * F.pi() / F.lit(float(nx))
    value = F.lit(0.0)
    for f, k in zip(frequencies, wavenumbers):
        value = value + F.cos(F.lit(float(k)) * x - F.lit(2.0) * F.pi() * F.lit(float(f)) * F.col("t") * F.lit(float(dt)))
    return grid.select("t", "p", F.lit(0).alias("v"), value.alias("value"))


def with_noise(field: DataFrame, snr: float, seed: int) -> DataFrame:
    """Normal noise whose variance is the field's over snr; a sample's noise depends on its place and the seed only."""
    spread = field.agg((F.sqrt(F.var_pop("value") / F.lit(float(snr)))).alias("spread"))
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), "t", "p", "v"), F.lit(2**52)).cast("double") + 0.5) / F.lit(float(2**52))
    normal = F.sqrt(F.lit(-2.0) * F.ln(u(0))) * F.cos(F.lit(2.0) * F.pi() * u(1))
    return field.join(F.broadcast(spread)).select("t", "p", "v", (F.col("value") + normal * F.col("spread")).alias("value"))  # one row
