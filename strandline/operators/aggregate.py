"""SUM, AVG, MIN and MAX over the values of live rows.

Every value has to be a number.  If one isn't, the whole result is an error that names the first such
key in key order; it is found in the same pass.  No rows give null.  A NaN among the values makes MIN
and MAX NaN.  Plain decimals are summed as decimals, so a sum doesn't depend on the order of tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.numeric import PLAIN, parse_f64

NAMES = ("sum", "avg", "min", "max")


class NotNumeric(ValueError):
    """A live value that isn't a number."""


def reductions(rows: DataFrame, condition: Column) -> DataFrame:
    """One row: n, sum, avg, min, max and bad_key (the least key whose value is no number, else null)."""
    plain = F.col("value").rlike(PLAIN)
    # the two sums split what is exact from what isn't
    exact = F.sum(F.when(plain, F.col("value").try_cast("decimal(24,6)")))
    rough = F.sum(F.when(~plain, F.col("x")))
    nan = F.max(F.isnan("x").cast("int"))
    parsed = rows.where(condition).select("key", "value", parse_f64(F.col("value")).alias("x"))
    sums = parsed.agg(
        F.count("*").alias("n"),
        exact.cast("double").alias("exact"),
        rough.alias("rough"),
        F.when(nan == 1, F.lit(float("nan"))).otherwise(F.min("x")).alias("min"),
        F.when(nan == 1, F.lit(float("nan"))).otherwise(F.max("x")).alias("max"),
        F.min(F.when(F.col("x").isNull(), F.col("key"))).alias("bad_key"),
    )
    total = F.when(F.col("n") > 0, F.coalesce(F.col("exact"), F.lit(0.0)) + F.coalesce(F.col("rough"), F.lit(0.0)))
    return sums.select("n", total.alias("sum"), F.try_divide(total, F.col("n").cast("double")).alias("avg"), "min", "max", "bad_key")


def reduce_one(rows: DataFrame, condition: Column, name: str) -> DataFrame:
    """One row: value, the reduction of that name, and bad_key.  value is null where bad_key isn't."""
    return reductions(rows, condition).select(F.when(F.col("bad_key").isNull(), F.col(name)).alias("value"), "bad_key")


def value_of(rows: DataFrame, condition: Column, name: str) -> float | None:
    """The reduction on the driver; raises NotNumeric."""
    found = reduce_one(rows, condition, name).first()
    if found["bad_key"] is not None:
        raise NotNumeric(f"{name.upper()}: non-numeric value for key {found['bad_key']}")
    return found["value"]
