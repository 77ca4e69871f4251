"""Aggregation building blocks shared by the operators: distributions, quantiles, histograms, crosstabs, top-n."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from basketlens.functions.columns import known, share_percent

SUMMARY_PROBABILITIES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
# Distance of the approximate cuts from a wanted quantile, ten times the error bound of the approximation.
QUANTILE_MARGIN = 0.001
WEIGHTED_RANGES = 1024


def distribution(df: DataFrame, *keys: str, count_as: str = "count") -> DataFrame:
    """Rows per key; rows with a missing key are left out."""
    return df.where(known(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(count_as))


def with_share(df: DataFrame, part: str, share_as: str) -> DataFrame:
    """Adds ``part`` as a percentage of its total, the total being a scalar subquery over the same rows."""
    total = df.agg(F.sum(part).alias("total")).scalar()
    return df.withColumn(share_as, share_percent(F.col(part), total))


def frequency_of_counts(df: DataFrame, key: str, size_as: str, count_as: str) -> DataFrame:
    """How many keys occur exactly k times."""
    return distribution(distribution(df, key, count_as=size_as), size_as, count_as=count_as)


def value_counts_by_level(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows per value in each group of ``by`` and over all rows, from one pass: (level, ``by``, ``value``, n).

    Grouping sets: ``level`` is 0 for a group and 1 for all rows, whose ``by`` is empty. Rows without a value are left out,
    rows without a group count over all rows only. The counts are combined map-side, so what follows is as small as the
    distinct values; every reader of the result shares its one exchange.
    """
    counted = df.where(known(value)).select(by, value).groupingSets([[by, value], [value]], by, value).agg(
        F.grouping(by).cast("int").alias("level"), F.count(F.lit(1)).alias("n"))
    # the filter on values repeats that of the readers: a filter of its own would keep a reader from the shared exchange
    return counted.where(((F.col("level") == 1) | known(by)) & known(value)).select("level", F.coalesce(by, F.lit("")).alias(by), value, "n")


def top_n(df: DataFrame, n: int, by: str, key: str) -> DataFrame:
    """The n rows with the largest ``by``; equal values are taken in ``key`` order."""
    return df.orderBy(F.desc(by), F.asc(key)).limit(n)


def top_n_per_group(df: DataFrame, group: str, n: int, by: str, key: str, rank_as: str | None = None) -> DataFrame:
    """The n best rows of each group. Spark limits each group before the shuffle, so a hot group stays small."""
    rank = rank_as or "_rank"
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(group).orderBy(F.desc(by), F.asc(key))))
    best = ranked.where(F.col(rank) <= n)
    return best if rank_as else best.drop(rank)


def most_frequent(df: DataFrame, group: str, value: str, count_as: str) -> DataFrame:
    """The most frequent value of each group, the smallest on a tie, with its count.

    Counts are combined map-side and the winner is a plain ``min`` over (-count, value), so no group is ever gathered.
    """
    counts = distribution(df, group, value, count_as="_count")
    best = counts.groupBy(group).agg(F.min(F.struct((-F.col("_count")).alias("negated"), F.col(value))).alias("_best"))
    return best.select(group, F.col(f"_best.{value}").alias(value), (-F.col("_best.negated")).alias(count_as))


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    weight: str | None = None,
    few_groups: bool = False,
    weighted_ranges: int = WEIGHTED_RANGES,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, one column per named probability.

    With ``weight``, a whole number, each row counts as that many equal values; the rows are then cut into
    ``weighted_ranges`` ranges, of which those that hold a wanted rank are sorted. ``few_groups`` says that the groups are
    few by construction (classes, segments, bands): their cuts are then broadcast, and the rows are not shuffled by group.

    The built-in exact percentile keeps every distinct value of a group in one task. Here approximate quantiles a
    little below and above each probability cut the values into a few ranges; the ranges are counted exactly, map-side,
    and only the narrow ones that hold a wanted rank are shuffled and sorted. A poor approximation would make such a
    range wider, never the result wrong.
    """
    by = list(by)
    values = df.where(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("_value"), (F.lit(1) if weight is None else F.col(weight)).alias("_n")
    )
    if weight is None:
        near = {p + d for p in probabilities.values() for d in (-QUANTILE_MARGIN, QUANTILE_MARGIN)}
        cut_points = sorted(min(max(p, 0.0), 1.0) for p in near)
    else:
        # the approximation knows no weights: even cuts of the rows
        cut_points = [i / weighted_ranges for i in range(1, weighted_ranges)]
    cuts = values.groupBy(*by).agg(F.struct(
        F.percentile_approx("_value", cut_points, 10_000).alias("cuts"), F.sum("_n").alias("total")
    ).alias("_group"))
    tagged = values.join(F.broadcast(cuts) if few_groups else cuts, by) if by else values.withColumn("_group", cuts.scalar())
    tagged = tagged.select(
        *by, "_value", "_n", F.col("_group.total").alias("_total"),
        F.size(F.filter("_group.cuts", lambda cut: cut < F.col("_value"))).alias("_range"),
    )

    # One row per range: a handful of rows per group.
    in_group = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, 0)
    ranges = (
        tagged.groupBy(*by, "_range")
        .agg(F.sum("_n").alias("_size"), F.max("_total").alias("_total"))
        .withColumn("_end", F.sum("_size").over(in_group))
        .withColumn("_start", F.col("_end") - F.col("_size"))
    )

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_start")) & (rank < F.col("_end"))

    wanted = F.lit(False)
    for p in probabilities.values():
        wanted = wanted | holds(F.floor(position(p))) | holds(F.ceil(position(p)))
    needed = ranges.where(wanted).select(*by, "_range", "_start")
    if not by or few_groups:
        needed = F.broadcast(needed)  # at most two ranges per probability and group

    in_range = W.partitionBy(*by, "_range").orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        tagged.join(needed, [*by, "_range"])
        .groupBy(*by, "_range", "_start", "_total", "_value")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_end", F.col("_start") + F.sum("_n").over(in_range))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    picks = [F.max("_total").alias("_total")]
    for name, p in probabilities.items():
        picks.append(F.max(F.when(holds(F.floor(position(p))), F.col("_value"))).alias(f"_{name}_low"))
        picks.append(F.max(F.when(holds(F.ceil(position(p))), F.col("_value"))).alias(f"_{name}_high"))
    picked = ranked.groupBy(*by).agg(*picks)

    def interpolated(name: str, p: float) -> Column:
        low, high = F.col(f"_{name}_low"), F.col(f"_{name}_high")
        return (low + (high - low) * (position(p) - F.floor(position(p)))).alias(name)

    return picked.select(*by, *(interpolated(name, p) for name, p in probabilities.items()))


def quantile(df: DataFrame, value: str, probability: float) -> DataFrame:
    """One exact quantile of a whole column as a one-row, one-column frame (use with ``.scalar()``)."""
    return quantiles(df, value, {"quantile": probability})


def describe(df: DataFrame, value: str, by: Sequence[str] = (), few_groups: bool = False) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of a column, per group."""
    by = list(by)
    number = F.col(value).cast("double")
    moments = df.groupBy(*by).agg(
        F.count(value).alias("count"),
        F.avg(number).alias("mean"),
        F.stddev_samp(number).alias("std"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
    )
    order = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    quartiles = quantiles(df, value, SUMMARY_PROBABILITIES, by, few_groups=few_groups)
    if by:
        return moments.join(quartiles, by, "left").select(*by, *order)
    packed = quartiles.select(F.struct(*SUMMARY_PROBABILITIES).alias("q")).scalar()
    return moments.withColumn("_q", packed).select("*", "_q.*").select(*order)


def describe_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``describe`` for several columns at once, one row per column."""
    long = df.select(F.explode(
        F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))
    ).alias("m")).select("m.*")
    return describe(long, "value", ["metric"], few_groups=True)


def histogram(
    df: DataFrame, value: str, bins: int = 10, by: Sequence[str] = (), few_groups: bool = False, weight: str | None = None
) -> DataFrame:
    """Equal-width histogram between the least and the largest value, empty bins included.

    Bins are closed on the left, the last one on both sides. A column with one distinct value gets a range of width 1
    around it. Columns: bin (from 0), bin_low, bin_high, frequency. ``few_groups`` and ``weight`` as in :func:`quantiles`.
    """
    by = list(by)
    data = df.where(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("_value"), (F.lit(1) if weight is None else F.col(weight)).alias("_n")
    )
    # a sum of weights that nothing else reads keeps the rows those of the counts below, so that both share an exchange
    span = data.groupBy(*by).agg(F.min("_value").alias("_low"), F.max("_value").alias("_high"), F.sum("_n").alias("_total")).where(
        F.col("_low").isNotNull() & (F.col("_total") > 0)
    )
    flat = F.col("_low") == F.col("_high")
    span = span.select(
        *by,
        F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low")).alias("_low"),
        F.when(flat, F.col("_high") + 0.5).otherwise(F.col("_high")).alias("_high"),
    )

    def edge(index: Column) -> Column:
        inner = F.col("_low") + index * ((F.col("_high") - F.col("_low")) / bins)
        return F.when(index == bins, F.col("_high")).otherwise(inner)

    if by:
        spread = data.join(F.broadcast(span) if few_groups else span, by)
    else:
        packed = span.select(F.struct("_low", "_high").alias("s")).scalar()
        spread = data.withColumn("_span", packed).select("_value", "_n", "_span._low", "_span._high")
    guess = F.least(
        F.floor((F.col("_value") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1)
    )
    placed = spread.withColumn("_guess", guess.cast("int")).withColumn(
        "bin",
        # rounding may put a value that equals an edge one bin off; compare with the edges themselves
        F.when(F.col("_value") < edge(F.col("_guess")), F.col("_guess") - 1)
        .when((F.col("_guess") < bins - 1) & (F.col("_value") >= edge(F.col("_guess") + 1)), F.col("_guess") + 1)
        .otherwise(F.col("_guess")),
    )
    counts = placed.groupBy(*by, "bin").agg(F.sum("_n").cast("bigint").alias("frequency"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(
        *by, "bin", edge(F.col("bin")).alias("bin_low"), edge(F.col("bin") + 1).alias("bin_high")
    )
    return grid.join(counts, [*by, "bin"], "left").fillna(0, subset=["frequency"])


def crosstab(
    df: DataFrame, row: str, column: str, values: Sequence, measure: Column | None = None
) -> DataFrame:
    """A zero-filled matrix: one row per ``row``, one column per entry of ``values``."""
    cells = df.where(known(row, column)).groupBy(row).pivot(column, list(values))
    return cells.agg(F.count(F.lit(1)) if measure is None else measure).fillna(0)


def crosstab_present(df: DataFrame, row: str, column: str, value_as: str = "count") -> DataFrame:
    """Counts of all pairs of the present rows and columns as (row, column, value), zero where a pair does not occur.

    The labels of the columns are an array in a scalar subquery over the counts; nothing runs while the plan is built.
    """
    counts = distribution(df, row, column, count_as=value_as)
    labels = counts.agg(F.collect_set(column).alias("labels")).scalar()
    grid = counts.select(row).distinct().withColumn("_labels", labels).select(row, F.explode("_labels").alias(column))
    return grid.join(counts, [row, column], "left").fillna(0, subset=[value_as])


def crosstab_long(
    df: DataFrame, row: str, column: str, values: Sequence, value_as: str = "count", measure: Column | None = None
) -> DataFrame:
    """The zero-filled matrix as (row, column, value) rows; a column without any entry is left out."""
    names = [f"_{i}" for i in range(len(values))]
    wide = crosstab(df, row, column, values, measure).toDF(row, *names)
    cells = F.array(*(
        F.struct(F.lit(label).alias(column), F.col(name).alias(value_as)) for label, name in zip(values, names)
    ))
    long = wide.select(row, F.explode(cells).alias("_cell")).select(row, f"_cell.{column}", f"_cell.{value_as}")
    filled = F.max(F.col(value_as) != 0).over(W.partitionBy(column))
    return long.withColumn("_filled", filled).where("_filled").drop("_filled")
