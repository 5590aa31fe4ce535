"""Text tables: header names are resolved by hand, all columns are text, `seq` keeps the file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def header_index(line: str) -> dict[str, int]:
    """Name to place: leading blanks go, trailing ones stay, and of equal names the last one counts."""
    return {name.lstrip(" "): i for i, name in enumerate(line.rstrip("\r\n").split(","))}


def read_table(spark: SparkSession, path: str, stop_at_blank: bool = False) -> DataFrame:
    """A CSV file, or a folder of them, as text columns plus ``seq``. `stop_at_blank`: a blank line ends the table."""
    index = header_index(spark.read.text(path).first()[0])
    width = max(index.values()) + 1
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    if stop_at_blank:
        lines = in_file_order(spark.read.text(path))
        end = lines.where(F.trim("value") == "").agg(F.min("seq").alias("end"))
        body = lines.join(F.broadcast(end), F.col("end").isNull() | (F.col("seq") < F.col("end"))).where("seq > 0")
        rows = body.select("seq", F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"quote": '"'}).alias("r")).select("seq", "r.*")
    else:
        rows = in_file_order(spark.read.csv(path, header=True, schema=schema, quote='"', enforceSchema=True))
    return rows.select("seq", *[F.col(f"_c{i}").alias(name) for name, i in index.items()])


def in_file_order(rows: DataFrame) -> DataFrame:
    """Rows of a file source plus ``seq``: their number from 0 by file name, then place in the file.

    Spark reads large files first and packs small ones together, so its own row numbers follow no order of
    files; here each piece of a file is counted, and the pieces, one row each, are put in order.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"))
    pieces = placed.groupBy("_file", "_from").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_file", "_from").rowsBetween(Window.unboundedPreceding, -1))
    base = pieces.select("_file", "_from", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base"))
    return placed.join(base, ["_file", "_from"]).withColumn("seq", F.col("_id") + F.col("_base")).drop("_file", "_from", "_id", "_base")


def column(df: DataFrame, name: str) -> Column:
    """A text column, or null where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def lookup(table: DataFrame, section: str, key: str, field: str) -> DataFrame:
    """The field of the first row whose first two columns are the section and the key."""
    first, second = [c for c in table.columns if c != "seq"][:2]
    return table.where((F.col(first) == section) & (F.col(second) == key)).orderBy("seq").limit(1).select(F.col(field).alias("value"))
