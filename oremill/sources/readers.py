"""Reading baskets, retail lines, points and tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_basket_csv(spark: SparkSession, path: str, key: str = "user_id", item: str = "business_id") -> DataFrame:
    """A two-column file with a header line."""
    return spark.read.schema(f"`{key}` string, `{item}` string").csv(path, header=True)


def read_unlettered_csv(spark: SparkSession, path: str, key: str = "user_id", item: str = "business_id") -> DataFrame:
    """The same, dropping every line that starts with a letter, wherever it stands."""
    return unlettered(spark.read.text(path)).select(
        F.split_part("value", F.lit(","), F.lit(1)).alias(key), F.split_part("value", F.lit(","), F.lit(2)).alias(item)
    )


def unlettered(lines: DataFrame) -> DataFrame:
    """Lines whose first character is not a letter; empty lines are dropped."""
    return lines.where((F.length("value") > 0) & ~F.col("value").rlike(r"^\p{L}"))


RETAIL = "date string, customer string, c2 string, c3 string, c4 string, product string"
BROKEN = "broken_line"


def _retail_lines(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a quoted retail file with a header, and lines that do not split into them under ``BROKEN``."""
    reader = spark.read.schema(f"{RETAIL}, {BROKEN} string").option("columnNameOfCorruptRecord", BROKEN)
    # Without pruning every line is split whole, which is what shows a wrong number of columns.
    return reader.option("columnPruning", False).csv(path, header=True, quote='"', mode="PERMISSIVE", enforceSchema=True)


def _reject_reason() -> Column:
    """Why a retail line cannot be used; null if it can."""
    blank = (F.coalesce(F.trim("date"), F.lit("")) == "") | (F.coalesce(F.trim("customer"), F.lit("")) == "")
    number = F.expr("try_cast(product as bigint)")
    return (
        F.when(F.col(BROKEN).isNotNull(), F.lit("columns"))
        .when(blank, F.lit("key"))
        .when(number.isNull(), F.lit("product"))
    )


def retail_rows(raw: DataFrame) -> DataFrame:
    """``(key, item)`` from columns ``date, customer, product`` of a retail file.

    The key is ``date-customer``; the product id is read as a number, which
    drops its leading zeros.
    """
    return raw.select(
        F.concat_ws("-", "date", "customer").alias("key"),
        F.expr("try_cast(product as bigint)").cast("string").alias("item"),
    )


def read_retail_csv(spark: SparkSession, path: str) -> DataFrame:
    """A quoted retail file with a header: date, customer, and the product in the sixth column.

    Lines that cannot be used are left out; :func:`retail_rejects` lists them.
    """
    return retail_rows(_retail_lines(spark, path).where(_reject_reason().isNull()))


def retail_rejects(spark: SparkSession, path: str) -> DataFrame:
    """``(reason, date, customer, product, line)`` of the lines that ``read_retail_csv`` leaves out.

    ``columns``: the line, given whole, does not split into six columns; ``key``: no date
    or no customer; ``product``: the product is no number.
    """
    reason = _reject_reason()
    raw = _retail_lines(spark, path).withColumn("reason", reason).where(F.col("reason").isNotNull())
    return raw.select("reason", "date", "customer", "product", F.col(BROKEN).alias("line"))


def parse_points(lines: DataFrame) -> DataFrame:
    """``(id, features)`` from comma-separated lines whose second field is skipped."""
    fields = F.split("value", ",")
    return lines.where(F.length("value") > 0).select(
        fields[0].cast("bigint").alias("id"),
        F.transform(F.slice(fields, F.lit(3), F.greatest(F.size(fields) - 2, F.lit(0))), lambda x: x.cast("double")).alias("features"),
    )


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_points(spark.read.text(path))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(n, line)`` of an ordered report: part files in the order of their names, numbered from 1.

    Meant for reports whose part files are each read as one split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    order = Window.partitionBy("file").orderBy("at")
    placed = lines.withColumn("k", F.row_number().over(order))
    ends = placed.groupBy("file").agg(F.max("k").alias("rows"))
    before = ends.select("file", (F.sum("rows").over(Window.orderBy("file")) - F.col("rows")).alias("before"))  # one row a file
    return placed.join(before, "file").select((F.col("before") + F.col("k")).alias("n"), "line")
