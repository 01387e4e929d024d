"""Numbers and neighbours of ordered rows within a key, without a task for the whole of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.sources.staging import staged


def numbered(rows: DataFrame, part: list[str], order: list[str], near: list[str] | None = None, number: str = "n", total: str | None = None, sums: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """Adds ``number`` (long, from 1 by ``order`` within ``part``), ``total`` (rows of the key) if named, and of each column ``c`` of ``near`` its
    value in the row before and after, as ``prev_c`` and ``next_c``, and of each of ``sums`` its sum up to and with the row, as ``sum_c``.

    Rows are dealt by ranges of (part, order), so a key that fills a third of the table lies in a third of the ranges. Each piece
    of a key in a range is counted, prefix sums of these few counts say where a piece starts, and its last and first row are
    the neighbours over the border. Give keys and short columns only: rows are written once and shuffled twice. Null keys are
    keys like others; rows that are equal in part and order are numbered in any order.
    """
    near, sums = near or [], sums or []
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(rows.repartitionByRange(n, *part, *order).withColumn("__range", F.spark_partition_id()), "ranged")
    ends = F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(near)] or [F.lit(0).alias("c")])
    line = F.struct(*order)
    pieces = ranged.groupBy("__range", *part).agg(F.count("*").alias("count"), F.min_by(ends, line).alias("first"), F.max_by(ends, line).alias("last"), *[F.sum(c).alias(f"s{k}") for k, c in enumerate(sums)])
    across = Window.partitionBy(*part).orderBy("__range")
    before = lambda c: F.coalesce(F.sum(c).over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(
        F.col("__range").alias("__at"), *[F.col(c).alias(f"__k{k}") for k, c in enumerate(part)], before("count").alias("__offset"), *[before(f"s{k}").alias(f"__sum{k}") for k in range(len(sums))], F.sum("count").over(Window.partitionBy(*part)).alias("__total"),
        F.lag("last").over(across).alias("__last"), F.lead("first").over(across).alias("__first"),
    )
    within = Window.partitionBy("__range", *part).orderBy(*order)
    own = ranged.select("*", F.row_number().over(within).alias("__row"), F.lag(ends).over(within).alias("__prev"), F.lead(ends).over(within).alias("__next"), *[F.coalesce(F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias(f"__own{k}") for k, c in enumerate(sums)])
    same = F.col("__range") == F.col("__at")
    for k, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{k}"))
    both = own.join(pieces, same)

    def neighbour(here: str, there: str, k: int) -> Column:
        return F.when(F.col(here).isNotNull(), F.col(f"{here}.c{k}")).otherwise(F.col(f"{there}.c{k}"))

    added = [(F.col("__offset") + F.col("__row")).alias(number)]
    added += [F.col("__total").alias(total)] if total else []
    added += [x for k, c in enumerate(near) for x in (neighbour("__prev", "__last", k).alias(f"prev_{c}"), neighbour("__next", "__first", k).alias(f"next_{c}"))]
    added += [(F.col(f"__sum{k}") + F.col(f"__own{k}")).alias(f"sum_{c}") for k, c in enumerate(sums)]
    return both.select(*rows.columns, *added)
