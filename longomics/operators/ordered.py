"""Ordered prefix scans per group that never put one group into one task.

``block_order`` range-partitions rows by (group, order) and pins the partition number with a
checkpoint; ``scan`` then combines a window inside each (group, block) with the carried totals of
the earlier blocks. A group holding a third of all rows is spread over as many tasks as its size
asks for. Ranks, Benjamini-Hochberg, ROC curves, risk sets and exact percentiles all sit on it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import cut

BLOCK = "_block"
_AGG = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def sort_columns(order: Sequence[str], reverse: bool = False) -> list[Column]:
    """Sort columns from names; a leading '-' means descending."""
    out = []
    for name in order:
        down, plain = name.startswith("-"), name.lstrip("-")
        out.append(F.col(plain).desc() if down != reverse else F.col(plain).asc())
    return out


def block_order(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with a pinned ``_block`` number that rises with ``order`` inside each group."""
    ranged = df.repartitionByRange(*[F.col(c) for c in by], *sort_columns(order))
    return cut(ranged.withColumn(BLOCK, F.spark_partition_id()))


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    aggs: Mapping[str, tuple[str, Column | str]],
    reverse: bool = False,
    exclusive: bool = False,
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running aggregates over block-ordered rows. ``aggs``: output -> (sum|min|max|count, column).

    ``order`` must be total inside a group (use distinct values with weights for tied ranks).
    ``totals``: output -> name in ``aggs`` whose whole-group value rides along with the carry.
    """
    keys = [*by, BLOCK]
    frame_end = -1 if exclusive else Window.currentRow
    local = (Window.partitionBy(*keys).orderBy(*sort_columns(order, reverse))
             .rowsBetween(Window.unboundedPreceding, frame_end))
    block = F.col(BLOCK)
    before = (Window.partitionBy(*by).orderBy(block.desc() if reverse else block.asc())
              .rowsBetween(Window.unboundedPreceding, -1))
    per_block = df.groupBy(*keys).agg(
        *[_AGG[kind](value).alias(f"_t_{out}") for out, (kind, value) in aggs.items()])
    fold = {out: F.sum if kind == "count" else _AGG[kind] for out, (kind, _) in aggs.items()}
    group = Window.partitionBy(*by)
    whole = [fold[name](f"_t_{name}").over(group).alias(out) for out, name in (totals or {}).items()]
    carried = per_block.select(
        *keys, *[fold[out](f"_t_{out}").over(before).alias(f"_c_{out}") for out in aggs], *whole)
    rows = df.select("*", *[_AGG[kind](value).over(local).alias(f"_l_{out}")
                            for out, (kind, value) in aggs.items()])
    joined = rows.join(carried, keys)
    final = []
    for out, (kind, _) in aggs.items():
        here, prior = F.col(f"_l_{out}"), F.col(f"_c_{out}")
        if kind in ("sum", "count"):
            value = F.coalesce(here, F.lit(0)) + F.coalesce(prior, F.lit(0))
        else:
            value = (F.least if kind == "min" else F.greatest)(here, prior)
        final.append(value.alias(out))
    return joined.select(*df.columns, *final, *(totals or {}))


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """1-based position inside each group by a total order."""
    ranked = scan(block_order(df, by, order), by, order, {out: ("count", F.lit(1))})
    return ranked.drop(BLOCK)


def tie_ranks(df: DataFrame, by: Sequence[str], value: str, weight: Column | None = None,
              descending: bool = False) -> DataFrame:
    """One row per distinct value: ``n`` ties, ``rank_min``, ``rank_max``, ``rank_avg``.

    Ties collapse in the map-side aggregate, so a value shared by most rows costs one row.
    """
    distinct = df.groupBy(*by, value).agg(F.sum(F.lit(1) if weight is None else weight).alias("n"))
    order = [("-" if descending else "") + value]
    cum = scan(block_order(distinct, by, order), by, order, {"rank_max": ("sum", "n")})
    return cum.drop(BLOCK).select(
        *by, value, "n",
        (F.col("rank_max") - F.col("n") + 1).alias("rank_min"),
        "rank_max",
        (F.col("rank_max") - (F.col("n") - 1) / 2.0).alias("rank_avg"))


def order_stats(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float],
                weight: Column | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Neighbouring order statistics for linear-interpolation percentiles.

    Per output name: ``<name>_lo``, ``<name>_hi`` and ``<name>_frac``. Exact, distributed.
    ``extra`` aggregates may use ``_n`` (ties), ``_cum`` (running count) and ``_total``.
    """
    distinct = df.groupBy(*by, value).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n"))
    joined = scan(block_order(distinct, by, [value]), by, [value], {"_cum": ("sum", "_n")},
                  totals={"_total": "_cum"})
    cols = []
    for name, prob in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(prob))
        cols += [
            F.min(F.when(F.col("_cum") > F.floor(pos), F.col(value))).alias(f"{name}_lo"),
            F.min(F.when(F.col("_cum") > F.ceil(pos), F.col(value))).alias(f"{name}_hi"),
            F.max(pos - F.floor(pos)).alias(f"{name}_frac"),
        ]
    return joined.groupBy(*by).agg(*cols, *extra, F.max("_total").alias("n_values"))


def interpolate(name: str, transform=lambda c: c) -> Column:
    lo, hi = transform(F.col(f"{name}_lo")), transform(F.col(f"{name}_hi"))
    return lo + (hi - lo) * F.col(f"{name}_frac")


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float],
              weight: Column | None = None) -> DataFrame:
    """Exact linear-interpolation percentiles per group, one output column per entry of ``probs``."""
    stats = order_stats(df, by, value, probs, weight)
    return stats.select(*by, "n_values", *[interpolate(n).alias(n) for n in probs])


def benjamini_hochberg(df: DataFrame, by: Sequence[str], p: str, out: str) -> DataFrame:
    """Adjusted p-values per group; null p-values stay null and are not counted."""
    tested = df.where(F.col(p).isNotNull())
    distinct = tested.groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n"))
    blocks = block_order(distinct, by, [p])
    ranked = scan(blocks, by, [p], {"_rank": ("sum", "_n")}, totals={"_m": "_rank"})
    ranked = ranked.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    adjusted = scan(ranked, by, [p], {"_adj": ("min", "_raw")}, reverse=True)
    adjusted = adjusted.select(*by, p, F.least(F.col("_adj"), F.lit(1.0)).alias(out))
    return df.join(adjusted, [*by, p], "left")
