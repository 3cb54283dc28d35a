"""Shipment tables: the schema, CSV intake, and the view derived from order data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from freightlens.functions.scalars import no_nan

ID, TARGET = "shipment_id", "silent_failure"

DOUBLE_COLUMNS = [
    "transit_days", "temp_mean_c", "temp_max_c", "temp_min_c", "temp_std_c", "temp_recovery_rate",
    "rh_mean", "rh_std", "rh_max", "product_volume_l", "fill_ratio", "sensor_gap_hours",
    "vibration_index", "feature_x1", "feature_x2",
]
INT_COLUMNS = [
    "door_opens", "leg_count", "package_type", "carrier_id", "origin_zone", "dest_zone", "feature_x3", TARGET,
]
ORDERED_COLUMNS = [
    ID, "transit_days", "door_opens", "leg_count",
    "temp_mean_c", "temp_max_c", "temp_min_c", "temp_std_c", "temp_recovery_rate",
    "rh_mean", "rh_std", "rh_max", "package_type", "product_volume_l", "fill_ratio",
    "carrier_id", "origin_zone", "dest_zone", "sensor_gap_hours", "vibration_index",
    "feature_x1", "feature_x2", "feature_x3", TARGET,
]
OPTIONAL_COLUMNS = ["temp_recovery_rate", "rh_max"]


def _spark_type(name: str) -> T.DataType:
    if name == ID:
        return T.StringType()
    return T.IntegerType() if name in INT_COLUMNS else T.DoubleType()


SHIPMENT_SCHEMA = T.StructType([T.StructField(c, _spark_type(c), True) for c in ORDERED_COLUMNS])
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in ORDERED_COLUMNS])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_shipments_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV scan for trusted files: no inference pass; cells that do not fit their type become NULL and the
    broken line is kept in `_corrupt`."""
    schema = T.StructType(SHIPMENT_SCHEMA.fields + [T.StructField("_corrupt", T.StringType(), True)])
    df = (
        spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    )
    return df.withColumns({c: no_nan(F.col(c)) for c in DOUBLE_COLUMNS})


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """All-text CSV scan, the input of strict validation."""
    return spark.read.schema(RAW_SCHEMA).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Result tables as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: plain sums, first per (order, day), then per order.

    An order that owns a large share of all lines is combined map-side to one row per ship date,
    a number bounded by the calendar, before rows of an order meet:
    - longest gap between ship dates: between neighbouring rows of the order, over the same
      partitioning that the second aggregate uses;
    - distinct suppliers capped at three: a key other than the smallest and the largest exists
      iff sum((x - min) * (max - x)) > 0, which expands into count, sum and sum of squares (kept
      as two 31-bit halves so that no sum can overflow).
    """
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_suppkey").alias("s"),
        F.round("l_quantity").cast("bigint").alias("q"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("dc"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("tx"),
        F.col("l_shipdate").cast("date").alias("day"),
    )
    c = F.col
    by_day = line.groupBy("l_orderkey", "day").agg(
        F.count("*").alias("n"),
        F.min("s").alias("s_min"), F.max("s").alias("s_max"), F.sum("s").alias("s_sum"),
        F.sum(F.shiftright(c("s") * c("s"), 31)).alias("sq_high"),
        F.sum((c("s") * c("s")).bitwiseAND((1 << 31) - 1)).alias("sq_low"),
        F.sum("q").alias("qty"),
        F.sum("dc").alias("ds"), F.sum(c("dc") * c("dc")).alias("dss"),
        F.max("dc").alias("dmax"), F.min("dc").alias("dmin"),
        F.sum("tx").alias("ts"), F.sum(c("tx") * c("tx")).alias("tss"), F.max("tx").alias("tmax"),
        F.sum(c("q") * c("dc")).alias("vib"),
    )
    dated = Window.partitionBy("l_orderkey").orderBy("day")
    by_day = by_day.withColumn("gap", F.datediff("day", F.lag("day").over(dated)))
    least, most = ["s_min", "dmin"], ["s_max", "dmax", "tmax"]
    sums = ["n", "s_sum", "sq_high", "sq_low", "qty", "ds", "dss", "ts", "tss", "vib"]
    agg = by_day.groupBy("l_orderkey").agg(
        *[F.sum(x).alias(x) for x in sums], *[F.min(x).alias(x) for x in least], *[F.max(x).alias(x) for x in most],
        F.coalesce(F.max("gap"), F.lit(0)).cast("bigint").alias("max_gap"),
    )
    wide = lambda x: c(x).cast("decimal(19,0)")
    squares = wide("sq_high") * F.lit(1 << 31) + wide("sq_low")
    inner = (wide("s_min") + wide("s_max")) * wide("s_sum") - squares - wide("n") * wide("s_min") * wide("s_max")
    return agg.withColumn("n_supp", F.when(c("s_min") == c("s_max"), 1).when(inner == 0, 2).otherwise(3)).drop(
        "s_min", "s_max", "s_sum", "sq_high", "sq_low"
    )


def _sample_std(scale: float, n: Column, total: Column, squares: Column) -> Column:
    spread = (n * squares - total * total).cast("double")
    return F.when(n == 1, F.lit(0.0)).otherwise(F.lit(scale) * F.sqrt(spread / (n * (n - 1)).cast("double")))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shipment per order that has at least one line.

    All inputs are summed as integers and divided once, so the values do not depend on how the
    rows are partitioned. Orders and customers are joined first on narrow columns (a customer
    with very many orders is split by adaptive skew handling); the join on the order key then
    reuses the partitioning of the line aggregate.
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"
    )
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    lines = _order_lines(spark, sf_dir)
    base = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(
        lines, F.col("o_orderkey") == F.col("l_orderkey")
    )
    c = F.col
    d = lambda x: (c(x) if isinstance(x, str) else x).cast("double")
    key, n = c("o_orderkey"), c("n")
    return base.select(
        key.cast("string").alias(ID),
        (d("qty") / F.lit(20.0)).alias("transit_days"),
        n.cast("int").alias("door_opens"),
        c("n_supp").cast("int").alias("leg_count"),
        (d(200 * n + 60 * c("ds")) / d(100 * n)).alias("temp_mean_c"),
        (d(200 + 60 * c("dmax")) / F.lit(100.0)).alias("temp_max_c"),
        (d(200 + 60 * c("dmin")) / F.lit(100.0)).alias("temp_min_c"),
        _sample_std(0.6, n, c("ds"), c("dss")).alias("temp_std_c"),
        F.when(key % 125 != 0, F.lit(10.0) / d(10 + c("dmax") - c("dmin"))).alias("temp_recovery_rate"),
        (d(30 * n + 5 * c("ts")) / d(100 * n)).alias("rh_mean"),
        _sample_std(0.05, n, c("ts"), c("tss")).alias("rh_std"),
        F.when(key % 24 != 0, d(30 + 5 * c("tmax")) / F.lit(100.0)).alias("rh_max"),
        (key % 3).cast("int").alias("package_type"),
        d("qty").alias("product_volume_l"),
        (d("qty") / d(50 * n)).alias("fill_ratio"),
        (c("o_custkey") % 8).cast("int").alias("carrier_id"),
        (c("c_nationkey") % 5).cast("int").alias("origin_zone"),
        (key % 5).cast("int").alias("dest_zone"),
        (d("max_gap") / F.lit(100.0)).alias("sensor_gap_hours"),
        (d("vib") / F.lit(100.0)).alias("vibration_index"),
        c("o_totalprice").alias("feature_x1"),
        c("c_acctbal").alias("feature_x2"),
        F.when(c("o_orderstatus") == "F", 1).otherwise(0).cast("int").alias("feature_x3"),
        F.when(
            500 * (c("dmax") - c("dmin")) + 35 * c("qty") + 5 * c("max_gap") + 2 * ((key * 7919) % 2500) > 16400, 1
        ).otherwise(0).cast("int").alias(TARGET),
    )


def raw_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipment view as untrusted text cells, with one kind of damage on each residue class of the key.

    Stands in for an unchecked CSV: wrong types, missing cells, out-of-range values, crossed
    temperatures, empty ids and repeated rows.
    """
    text = shipments(spark, sf_dir).select(
        F.col(ID).cast("bigint").alias("_k"), *[F.col(c).cast("string").alias(c) for c in ORDERED_COLUMNS]
    )
    k = F.col("_k")

    def damage(column: str, modulus: int, residue: int, value) -> Column:
        bad = value if isinstance(value, Column) else F.lit(value).cast("string")
        return F.when(k % modulus == residue, bad).otherwise(F.col(column))

    leg = F.when(k % 97 == 0, F.lit("2.5")).when(k % 79 == 3, F.lit("4")).when(k % 103 == 7, F.lit("0"))
    damaged = text.withColumns({
        "leg_count": leg.otherwise(F.col("leg_count")),
        "transit_days": damage("transit_days", 89, 1, "n/a"),
        "door_opens": damage("door_opens", 83, 2, None),
        "fill_ratio": damage("fill_ratio", 73, 4, "1.2"),
        "rh_mean": damage("rh_mean", 71, 5, "-0.1"),
        "product_volume_l": damage("product_volume_l", 67, 6, "0"),
        "temp_max_c": damage("temp_max_c", 61, 7, "-50.5"),
        "temp_std_c": damage("temp_std_c", 53, 9, "NaN"),
        ID: damage(ID, 59, 8, ""),
    })
    copies = F.when(k % 113 == 10, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return damaged.withColumn("_copy", F.explode(copies)).drop("_k", "_copy")
