"""Dense positions and running sums without sorting a whole table or group in one task.

Ordering keys are integers. Rows are counted per run of 2^21 consecutive key
values and those counts per run of runs: 21 bits a level, three levels for 64
bits. A prefix sum at each level is a window over at most 2^22 short rows,
whatever the data, and a row's own position is a window inside its run. There
is one path for every size, it is lazy, and sparse keys cost no more than one
row per run that holds any.

Null keys and null groups are values like any other (null keys come last).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.session import staged

BITS = 21


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that matches nulls with nulls; the columns of ``left``, then
    those of ``right`` without the keys."""
    on = list(on)
    r = right.select(*[F.col(c).alias(f"_j_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & left[c].eqNullSafe(r[f"_j_{c}"])
    return left.join(r, cond, how).drop(*[f"_j_{c}" for c in on])


def _before(weight: str, within: Sequence[str], order: str) -> Column:
    """Sum of ``weight`` over the earlier rows of one bounded window."""
    w = (Window.partitionBy(*(within or [F.lit(0)])).orderBy(F.col(order).asc_nulls_last())
         .rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.sum(weight).over(w), F.lit(0))


def run_offsets(runs: DataFrame, groups: Sequence[str], run: str, weight: str, name: str) -> DataFrame:
    """(groups, run, ``name``): sum of ``weight`` over the earlier runs of the
    same group. ``runs`` has one row per group and run; a run is a key shifted
    right by 21 bits, so one more level holds every run of a 64-bit key."""
    g = list(groups)
    low = runs.select(*g, run, weight, F.shiftright(F.col(run), BITS).alias("_up"))
    top = low.groupBy(*g, "_up").agg(F.sum(weight).alias("_w"))
    top = top.select(*g, "_up", _before("_w", g, "_up").alias("_o1"))
    low = low.withColumn("_o0", _before(weight, [*g, "_up"], run))
    return null_safe_join(low, top, [*g, "_up"]).select(*g, run, (F.col("_o0") + F.col("_o1")).alias(name))


def dense_positions(df: DataFrame, key: str, group: str | Sequence[str] | None = None, name: str = "pos",
                    per_group: bool = False) -> DataFrame:
    """1-based position of every row in the order ``(group, key)``; ``key``
    must be an integer, unique within its group (nulls last), and without
    ``per_group`` the group one integer column. With ``per_group`` the
    positions restart at 1 in every group."""
    groups = [group] if isinstance(group, str) else list(group or [])
    d = df.withColumn("_run", F.shiftright(F.col(key).cast("bigint"), BITS))
    runs = d.groupBy(*groups, "_run").agg(F.count(F.lit(1)).alias("_n"))
    offsets = run_offsets(runs, groups, "_run", "_n", "_off")
    if groups and not per_group:
        if len(groups) != 1:
            raise ValueError("positions across groups need one integer group column")
        sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
        sizes = sizes.withColumn("_run", F.shiftright(F.col(groups[0]).cast("bigint"), BITS))
        coarse = run_offsets(sizes.groupBy("_run").agg(F.sum("_n").alias("_n")), [], "_run", "_n", "_c")
        inside = sizes.withColumn("_i", _before("_n", ["_run"], groups[0]))
        group_off = null_safe_join(inside, coarse, ["_run"]).select(
            *groups, (F.col("_i") + F.col("_c")).alias("_goff"))
        offsets = null_safe_join(offsets, group_off, groups).select(
            *groups, "_run", (F.col("_off") + F.col("_goff")).alias("_off"))
    here = Window.partitionBy(*groups, "_run").orderBy(F.col(key).asc_nulls_last())
    j = null_safe_join(d, offsets, [*groups, "_run"])
    return j.withColumn(name, F.col("_off") + F.row_number().over(here)).drop("_run", "_off")


def running_sum_before(df: DataFrame, partition: Sequence[str], order: str, val: str, name: str) -> DataFrame:
    """``sum(val)`` over the earlier rows of each partition, by the integer
    column ``order`` (unique within the partition, nulls last)."""
    part = list(partition)
    d = df.withColumn("_run", F.shiftright(F.col(order).cast("bigint"), BITS))
    runs = d.groupBy(*part, "_run").agg(F.sum(val).alias("_n"))
    offsets = run_offsets(runs, part, "_run", "_n", "_off")
    j = null_safe_join(d, offsets, [*part, "_run"])
    return j.withColumn(name, F.col("_off") + _before(val, [*part, "_run"], order)).drop("_run", "_off")


def numbered(df: DataFrame, order_by: Sequence[str], name: str = "pos") -> DataFrame:
    """Every row with its 1-based position by columns that are unique together (nulls
    last). Rows are dealt into sampled ranges, sorted there and written once: the
    number within a range comes with the write, the sizes of the ranges (an array
    as long as there are ranges) give the rest. One exchange of the rows."""
    order = [F.col(c).asc_nulls_last() for c in order_by]
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(df.sparkSession, rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, here = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.collect_list(F.struct("p", "n")).alias("s"))
    last = F.coalesce(F.array_max(F.transform("s", lambda x: x["p"])), F.lit(0).cast("bigint"))
    before = F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda p: F.aggregate(
        F.filter("s", lambda x: x["p"] < p), F.lit(0).cast("bigint"), lambda total, x: total + x["n"]))
    rows = with_scalar(rows, sizes.select(before.alias("_before")))
    return rows.withColumn(name, F.element_at("_before", (part + 1).cast("int")) + here + 1).drop("_at", "_before")


#: Ranges of an order that has no integer runs, and the distinct rows sampled to place them.
RANGES, RANGE_SAMPLE = 256, 4096


def _total_order(cols: Sequence[str]) -> Column:
    """A struct whose order is that of the columns, each with nulls last."""
    return F.struct(*[x for i, c in enumerate(cols) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))])


def sums_before(df: DataFrame, within: Sequence[str], order_by: Sequence[str], name: str,
                weight: str | None = None) -> DataFrame:
    """Every row with the sum of ``weight`` (1 if not given, nulls count 0) over the
    earlier rows of its group of ``within``, by columns of any orderable type (nulls
    last). Ties go by the other columns; rows that are equal in all come one after
    the other.

    Equal rows collapse to one with a count. A sample of the distinct rows places
    the borders of at most ``RANGES`` ranges over (within, order); sums per group and
    range give each range's offset, and the rest is a window inside one group and
    range. Neither a large group nor a row repeated very often is sorted in one
    task, and the plan is lazy: the borders are a scalar subquery."""
    within = list(within)
    w = F.coalesce(F.col(weight), F.lit(0)) if weight else F.lit(1).cast("bigint")
    rows = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    order = [*within, *[c for c in order_by if c not in within]]
    order += [c for c in df.columns if c not in order]
    rows = rows.withColumn("_k", _total_order(order))
    sample = rows.select("_k").orderBy(F.xxhash64("_k"), "_k").limit(RANGE_SAMPLE)
    ends = sample.agg(F.sort_array(F.collect_list("_k")).alias("_ends"))
    step = F.greatest(F.lit(1), F.floor(F.size("_ends") / RANGES))
    ends = ends.select(F.filter("_ends", lambda k, i: i % step == step - 1).alias("_ends"))
    rows = with_scalar(rows, ends)
    key = F.col("_k")
    rows = rows.withColumn("_range", F.size(F.filter("_ends", lambda end: end < key))).drop("_ends")
    sums = rows.groupBy(*within, "_range").agg(F.sum(F.col("_copies") * w).alias("_sum"))
    per_group = sums.groupBy(*within).agg(F.collect_list(F.struct("_range", "_sum")).alias("_sums"))  # RANGES + 1 at most
    rows = null_safe_join(rows, per_group, within) if within else with_scalar(rows, per_group)
    zero = F.lit(0).cast(sums.schema["_sum"].dataType)
    at = F.col("_range")
    # The array's own order does not matter: sums of doubles are taken by range.
    earlier = F.sort_array(F.filter("_sums", lambda x: x["_range"] < at))
    offset = F.aggregate(earlier, zero, lambda total, x: (total + x["_sum"]).cast(sums.schema["_sum"].dataType))
    here = (Window.partitionBy(*within, "_range").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    before = F.coalesce(F.sum(F.col("_copies") * w).over(here), zero)
    rows = rows.withColumn("_before", offset + before)
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)).alias("_copy")
    return rows.select(*df.columns, "_before", copies).select(
        *df.columns, (F.col("_before") + F.col("_copy") * w).alias(name))


def with_scalar(df: DataFrame, scalar: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row as scalar
    subqueries: evaluated once, inlined as values -- no join at all."""
    for c in scalar.columns:
        df = df.withColumn(c, scalar.select(c).scalar())
    return df
