"""Gates: what a value must be, as a fixed set of comparisons; metrics against targets."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Comparisons in the order in which they are looked for in a specification.
COMPARISONS = ("equals", "in", "min", "max", "max_issues", "contains")


def passed(actual: Column, spec: dict[str, Any]) -> Column:
    """Whether a value meets a specification; the first comparison named in it counts, and one without any is met. Null meets none but `equals` None and
    `max_issues`, for which it is no issue."""
    for name in COMPARISONS:
        if name in spec:
            want = spec[name]
            break
    else:
        return F.lit(True)
    if name == "equals":
        return actual.eqNullSafe(F.lit(want))
    if name == "in":
        return F.coalesce(actual.isin(*want), F.lit(False))
    if name in ("min", "max"):
        n = actual.try_cast("double")
        return F.coalesce(n >= want if name == "min" else n <= want, F.lit(False))
    if name == "max_issues":
        return F.coalesce(actual.try_cast("int"), F.lit(0)) <= want
    return F.coalesce(F.contains(actual.cast("string"), F.lit(str(want))), F.lit(False))


def passed_any(values: Column, spec: dict[str, Any]) -> Column:
    """`contains` and `max_issues` on an array: whether any element holds the text, or there are no more elements than allowed."""
    if "max_issues" in spec:
        return F.coalesce(F.size(values), F.lit(0)) <= spec["max_issues"]
    return F.coalesce(F.exists(values, lambda v: F.contains(v.cast("string"), F.lit(str(spec["contains"])))), F.lit(False))


def against_targets(spark: SparkSession, observed: DataFrame, targets: dict[str, tuple[float, str]]) -> DataFrame:
    """(metric, target, direction, observed, status) of every target; observed: (metric, value), one row a metric. What isn't observed is not_measured."""
    goal = spark.createDataFrame([(k, *v) for k, v in targets.items()], "metric string, target double, direction string")
    j = goal.join(observed.select("metric", F.col("value").alias("observed")), "metric", "left")
    met = F.when(F.col("direction") == "min", F.col("observed") >= F.col("target")).otherwise(F.col("observed") <= F.col("target"))
    return j.withColumn("status", F.when(F.col("observed").isNull(), "not_measured").when(met, "pass").otherwise("fail"))
