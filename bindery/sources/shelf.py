"""Tables of books in buckets, of which a rebuild replaces those that hold its books and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.sources.staging import staged

BUCKETS = 256


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int"))


def store(tables: dict[str, DataFrame], out: str, buckets: int = BUCKETS) -> None:
    """Each table (book_id and more) as Parquet in folders by a hash of the book."""
    for name, df in tables.items():
        _bucketed(df, buckets).repartition(F.col("bucket")).write.partitionBy("bucket").mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")


def load(spark: SparkSession, out: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{out.rstrip('/')}/{name}").where("book_id is not null").drop("bucket") for name in names}


def replace_books(tables: dict[str, DataFrame], out: str, books: DataFrame, buckets: int = BUCKETS) -> None:
    """Puts the rows of ``tables`` in the place of all rows of ``books`` (book_id), whether they had some or not.

    Only buckets with one of these books are read and written again (dynamic partition overwrite); other files stay as they are. What
    replaces a bucket is written elsewhere first, as a bucket can't be read while it is overwritten.
    """
    spark = books.sparkSession
    ids = staged(books.select("book_id").distinct(), "ids")
    hit = [r["bucket"] for r in _bucketed(ids, buckets).select("bucket").distinct().collect()]  # at most ``buckets``
    for name, df in tables.items():
        path = f"{out.rstrip('/')}/{name}"
        old = spark.read.parquet(path).where(F.col("bucket").isin(hit))
        new = _bucketed(df, buckets).select(old.columns)
        now = staged(old.join(ids, "book_id", "left_anti").select(old.columns).unionByName(new), name)
        # a bucket that nothing is left of would not be overwritten: it gets a row without a book, which no reader sees
        left = {r["bucket"] for r in now.select("bucket").distinct().collect()}
        marks = spark.createDataFrame([(b,) for b in hit if b not in left], "bucket int")
        now = now.unionByName(marks, allowMissingColumns=True)
        now.repartition(F.col("bucket")).write.option("partitionOverwriteMode", "dynamic").partitionBy("bucket").mode("overwrite").parquet(path)
