"""Exact order statistics of groups of any size, without sorting or gathering a group.

A round brackets the wanted rank of each open group between two quantiles of a mergeable sketch, and counts exactly what lies below and inside the bracket. The bracket holds about a
hundredth of the group and is all that the next round reads; a group whose bracket is small is gathered and read off. The counts decide, not the sketch: where it
has missed the rank, the values below or above its bracket are next. The values of a group may lie in any tasks, so one group of all rows is the work of all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightloom.functions.robust import SIGMA
from nightloom.sources.staging import staged

GRID = 400  # quantiles of a sketch
ACCURACY = 4000  # ranks are off by a share of 1 / 4000 at most
GATHERED = 4096  # values of a group that are put into an array
SHARES = 64  # a group's rows meet its facts in so many shares


def middle(n: Column) -> Column:
    """The rank of the upper median among n values, from 1."""
    return F.floor(n / 2) + 1


def met(rows: DataFrame, facts: DataFrame, keys: list[str], shares: int = SHARES) -> DataFrame:
    """rows with the one row of facts of their keys (null keys are equal), by an equi-join on keys and a share: facts go out once a share, so a group with most of all rows is dealt to many tasks."""
    if not keys:
        keys, rows, facts = ["__all"], rows.withColumn("__all", F.lit(0)), facts.withColumn("__all", F.lit(0))
    own = {k: f"__k{i}" for i, k in enumerate(keys)}
    dealt = rows.withColumn("__share", F.monotonically_increasing_id() % shares)
    spread = facts.withColumnsRenamed(own).withColumn("__of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    same = F.col("__share") == F.col("__of")
    for k, o in own.items():
        same = same & F.col(k).eqNullSafe(F.col(o))
    return dealt.join(spread, same).drop("__share", "__of", "__all", *own.values())


def _sketch(v: Column) -> Column:
    return F.percentile_approx(v, [i / GRID for i in range(GRID + 1)], ACCURACY)


def select_rank(df: DataFrame, keys: list[str], value: str, out: str, rank: Callable[[Column], Column] = middle, gathered: int = GATHERED) -> DataFrame:
    """keys, out, n, rounds: of each group's n values that are not null, the one of rank(n) in ascending order (from 1), and the rounds it took.

    Groups without a value, or whose rank is not in 1..n, have no row. NaN is the largest value. gathered bounds the array of a group.
    """
    v, lo, hi, size = F.col("__v"), F.col("__lo"), F.col("__hi"), F.col("__size")
    facts = ["__n", "__rank", "__size", "__lo", "__hi"]
    rows = staged(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v")), "selection-rows")
    state = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), _sketch(v).alias("__grid"))
    state = state.withColumns({"__rank": rank(F.col("__n")).cast("long"), "__size": F.col("__n")}).where("__rank between 1 and __n")
    state = staged(state.select(*keys, *facts, "__grid"), "selection-state")
    found, turn = None, 0
    while True:
        settled = (lo == hi) | (size <= gathered)
        few = met(rows, state.where(settled & (lo != hi)).select(*keys, *facts), keys).where(v.between(lo, hi))
        few = few.groupBy(*keys, "__n", "__rank").agg(F.array_sort(F.collect_list("__v")).alias("__all"))  # `gathered` values at most
        here = few.select(*keys, F.get("__all", (F.col("__rank") - 1).cast("int")).alias(out), F.col("__n").alias("n"), F.lit(turn).alias("rounds"))
        here = here.unionByName(state.where(lo == hi).select(*keys, lo.alias(out), F.col("__n").alias("n"), F.lit(turn).alias("rounds")))
        found = here if found is None else found.unionByName(here)
        state = state.where(~settled)
        if state.isEmpty():
            return found
        if turn:
            rows = staged(met(rows, state.select(*keys, "__lo", "__hi"), keys).where(v.between(lo, hi)).select(*keys, "__v"), "selection-rows")
        state = staged(_narrowed(rows, state, keys, facts), "selection-state")
        turn += 1


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], facts: list[str]) -> DataFrame:
    """state after one round: the range lo..hi of each group shrinks to the part that holds its rank."""
    v, lo, hi, a, b = (F.col(c) for c in ("__v", "__lo", "__hi", "__a", "__b"))
    # Two quantiles below the wanted one and two above; that one alone where they would leave the range as it is. Without a sketch, the range.
    at = F.floor((F.col("__rank") - 1) * GRID / F.col("__size")).cast("int")
    near = lambda i: F.get("__grid", F.greatest(F.lit(0), F.least(F.lit(GRID), i)))
    stays = (near(at - 2) == lo) & (near(at + 3) == hi)
    ends = {"__a": F.when(stays, near(at)).otherwise(near(at - 2)), "__b": F.when(stays, near(at)).otherwise(near(at + 3))}
    state = state.withColumns({"__a": F.coalesce(ends["__a"], lo), "__b": F.coalesce(ends["__b"], hi)}).drop("__grid")
    inside = v.between(a, b)
    counted = met(rows, state, keys).where(v.between(lo, hi)).groupBy(*keys, *facts, "__a", "__b").agg(
        F.count(F.when(v < a, 1)).alias("__under"),
        F.count(F.when(inside, 1)).alias("__inside"),
        F.max(F.when(v < a, v)).alias("__below"),
        F.min(F.when(v > b, v)).alias("__above"),
        _sketch(F.when(inside, v)).alias("__grid"),
    )
    left, mid = F.col("__rank") - F.col("__under"), F.col("__inside")
    which = lambda low, high, hit: F.when(left < 1, low).when(left > mid, high).otherwise(hit)
    none = F.lit(None).cast(counted.schema["__grid"].dataType)
    return counted.select(
        *keys,
        "__n",
        which(F.col("__rank"), left - mid, left).alias("__rank"),
        which(F.col("__under"), F.col("__size") - F.col("__under") - mid, mid).alias("__size"),
        which(lo, F.col("__above"), a).alias("__lo"),
        which(F.col("__below"), hi, b).alias("__hi"),
        which(none, none, F.col("__grid")).alias("__grid"),
    )


def select_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys, out: upper medians of groups that grow with the archive."""
    return select_rank(df, keys, value, out).select(*keys, out)


def select_mad(df: DataFrame, keys: list[str], value: str, median: str, mad: str) -> DataFrame:
    """keys, median, mad (sigma) of such groups."""
    centre = staged(select_median(df, keys, value, median), "medians")
    away = met(df.select(*keys, F.col(value).alias("__value")), centre, keys).select(*keys, F.abs(F.col("__value") - F.col(median)).alias("__away"))
    return met(centre, select_median(away, keys, "__away", "__mad"), keys, 1).select(*keys, median, (F.col("__mad") * SIGMA).alias(mad))
