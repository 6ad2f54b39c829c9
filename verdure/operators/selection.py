"""Exact quantiles of groups of any size by counting: no task holds a group's values.

A pass counts values by bins and keeps of each bin its count and its least and greatest value; a wanted place lies in one bin,
and the next pass looks into that bin alone. Passes end once a bin has one value or few values, which are then ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Bins of a pass after the first; values that may be ordered at once; bins of the first pass to a factor of e.
BINS, FEW, HEAD = 4096, 4096, 64


def _head(v: Column) -> Column:
    """Bins that need no limits and never fall as values rise; NaN comes last, as in an order."""
    size = F.least(F.log1p(F.abs(v)), F.lit(710.0))
    return F.when(F.isnan(v), F.lit(HEAD * 1000)).otherwise(F.floor(F.signum(v) * size * HEAD)).cast("long")


def _fine(v: Column, lo: Column, hi: Column) -> Column:
    """Even bins between two values that occur. The ends have bins of their own, so that each pass leads on, infinite values
    and NaN included; limits are halved lest their difference overflow."""
    share = (v / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0))
    inner = F.when(F.isnan(share), F.lit(0.0)).otherwise(F.coalesce(share, F.lit(0.0)))
    return F.when(v == lo, F.lit(-1)).when(v == hi, F.lit(BINS + 1)).otherwise(F.floor(inner * BINS)).cast("long")


def quantiles(rows: DataFrame, by: list[str], columns: dict[str, list[str]], fractions: list[float], few: int = FEW) -> DataFrame:
    """(by, column, fraction, value): exact quantiles (0..1) of columns, interpolated between the two values around them.

    columns maps a name to the columns whose values are pooled under it. NULL values do not count; rows with NULL in ``by`` are
    left out, and so is a group without values. Each pass is one aggregation that is summed in each task before it travels. What
    a task orders is at most BINS bins of a group (of the first pass some hundreds as a rule), or ``few`` values."""
    fractions = sorted({float(f) for f in fractions})
    pooled = F.array(*[F.struct(F.lit(name).alias("column"), F.col(c).cast("double").alias("v")) for name, cs in columns.items() for c in cs])
    known = rows.dropna(subset=by) if by else rows
    values = known.select(*by, F.inline(pooled)).filter("v is not null")
    group = [*by, "column"]

    counts = F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    heads = values.groupBy(*group, _head(F.col("v")).alias("bin")).agg(*counts)
    whole = Window.partitionBy(*group)
    heads = heads.withColumns({"upto": F.sum("n").over(whole.orderBy("bin")), "total": F.sum("n").over(whole)})
    wanted = heads.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in fractions]))).withColumn("place", F.col("fraction") * (F.col("total") - 1))
    wanted = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))))
    fields = [*group, "fraction", "place", "rank", "k", "lo", "hi", "n"]
    here = (F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto"))
    state = written(wanted.filter(here).withColumn("k", F.col("rank") - (F.col("upto") - F.col("n"))).select(*fields))  # two rows a quantile

    span = [*group, "lo", "hi"]
    within = lambda spans: values.join(spans.select(*span).distinct(), group).filter(F.col("v").between(F.col("lo"), F.col("hi")))
    several = F.col("lo") < F.col("hi")
    while not (wide := state.filter(several & (F.col("n") > few))).isEmpty():
        bins = within(wide).groupBy(*span, _fine(F.col("v"), F.col("lo"), F.col("hi")).alias("bin")).agg(F.count("*").alias("m"), F.min("v").alias("from"), F.max("v").alias("to"))
        bins = bins.withColumn("upto", F.sum("m").over(Window.partitionBy(*span).orderBy("bin"))).drop("bin")
        at = (F.col("k") >= F.col("upto") - F.col("m")) & (F.col("k") < F.col("upto"))
        on = wide.join(bins, span).filter(at).withColumn("k", F.col("k") - (F.col("upto") - F.col("m")))
        on = on.select(*group, "fraction", "place", "rank", "k", F.col("from").alias("lo"), F.col("to").alias("hi"), F.col("m").alias("n"))
        state = written(state.filter(~(several & (F.col("n") > few))).unionByName(on))

    found = state.withColumn("value", F.when(~several, F.col("lo")))
    if not (open_ := state.filter(several)).isEmpty():
        ordered = within(open_).groupBy(*span).agg(F.sort_array(F.collect_list("v")).alias("vs"))  # at most ``few`` values
        found = state.join(ordered, span, "left").withColumn("value", F.when(several, F.get("vs", F.col("k").cast("int"))).otherwise(F.col("lo")))
    ends = found.groupBy(*group, "fraction").agg(F.first("place").alias("place"), F.min("value").alias("low"), F.max("value").alias("high"))
    between = (F.ceil("place") - F.col("place")) * F.col("low") + (F.col("place") - F.floor("place")) * F.col("high")
    return ends.select(*group, "fraction", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("value"))


def wide_quantiles(rows: DataFrame, by: list[str], columns: dict[str, list[str]], fractions: dict[str, float]) -> DataFrame:
    """(by, <prefix>_<column> for each of the named fractions): one row per group that has values."""
    long = quantiles(rows, by, columns, list(fractions.values()))
    named = [F.max(F.when((F.col("column") == c) & (F.col("fraction") == float(f)), F.col("value"))).alias(f"{prefix}_{c}") for prefix, f in fractions.items() for c in columns]
    return long.groupBy(*by).agg(*named)
