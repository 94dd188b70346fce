"""The feature cube: conditional statistics of every (window, direction, category value, flag) cell of the anchors' history."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.scalars import all_of, sample_std
from trailmark.operators.ranking import enumerate_values
from trailmark.plans.lookback import Measure, look_back
from trailmark.plans.quantiles import PAIR_FACTOR, by_account
from trailmark.schema import SECOND, WINDOWS

STATS = ("cnt", "sum", "min", "max", "std")


def cell_name(value: str) -> str:
    """A category value as part of a column name."""
    return re.sub(r"\W+", "_", value.strip()).strip("_").lower() or "blank"


def cells(flow: DataFrame, directions: Mapping[str, Column], category: str, flags: Mapping[str, Column], top: int = 50) -> dict[str, Column]:
    """Condition of each cell by name. Values of the category are read from the data, the ``top`` most frequent ones; ``all`` is every row."""
    everything = F.lit(True)
    names: dict[str, Column] = {"all": everything}
    for value in enumerate_values(flow, category, top):
        name = cell_name(value)
        while name in names:  # another value reads the same
            name += "_"
        names[name] = F.col(category) == value
    sides = {**directions, "all": everything}
    marks = {**flags, "all": everything}
    return {f"{d}_{v}_{m}": all_of([dc, vc, mc]) for d, dc in sides.items() for v, vc in names.items() for m, mc in marks.items()}


def feature_cube(
    anchors: DataFrame,
    flow: DataFrame,
    windows: Sequence[str],
    directions: Mapping[str, Column],
    category: str,
    flags: Mapping[str, Column],
    value: Column,
    stats: Sequence[str] = STATS,
    top: int = 50,
    pair_factor: float = PAIR_FACTOR,
) -> DataFrame:
    """One row per anchor: ``f{window}_{direction}_{value}_{flag}_{stat}`` for every cell. Counts and sums of empty cells are 0, other statistics NULL.

    Accounts whose anchors and rows build few pairs are joined: a row is added to the few cells that it is in. For the others all cells
    are columns of one lattice of (account, block) rows, and all windows roll up from it.
    """
    found = cells(flow, directions, category, flags, top)
    return by_account(
        anchors.select("txn_id", "acct", "t"), flow, pair_factor,
        lambda mine, rows: _paired(mine, rows, windows, found, value, stats), lambda mine, rows: _lattice(mine, rows, windows, found, value, stats))


def _paired(anchors: DataFrame, flow: DataFrame, windows: Sequence[str], found: Mapping[str, Column], value: Column, stats: Sequence[str]) -> DataFrame:
    """Sums over the rows that are in the same cells, then over those of each cell: narrow aggregates, all by account."""
    inside = F.array_compact(F.array(*[F.when(where, i) for i, where in enumerate(found.values())]))
    rows = flow.select(F.col("acct").alias("h_acct"), F.col("t").alias("h_t"), inside.alias("inside"), value.alias("v"))
    age = F.col("t") - F.col("h_t")
    widest = max(WINDOWS[w] for w in windows) * SECOND
    pairs = anchors.join(rows, (F.col("acct") == F.col("h_acct")) & (age > 0) & (age <= widest), "left").withColumn("age", age)
    recent = {w: F.col("age") <= WINDOWS[w] * SECOND for w in windows}
    alike, merged = [], []
    for w, new in recent.items():
        v = F.when(new, F.col("v"))
        alike += [F.count_if(new).alias(f"cnt_{w}"), F.sum(v).alias(f"sum_{w}"), F.sum(v * v).alias(f"sq_{w}"), F.min(v).alias(f"min_{w}"), F.max(v).alias(f"max_{w}")]
        merged += [f(f"{n}_{w}").alias(f"{n}_{w}") for n, f in (("cnt", F.sum), ("sum", F.sum), ("sq", F.sum), ("min", F.min), ("max", F.max))]
    sums = pairs.groupBy("acct", "txn_id", "inside").agg(*alike)
    per_cell = sums.withColumn("cell", F.explode_outer("inside")).groupBy("acct", "txn_id", "cell").agg(*merged)
    entry = F.struct("cell", F.struct(*[c for c in per_cell.columns if c not in ("acct", "txn_id", "cell")]).alias("x"))
    per_anchor = per_cell.groupBy("acct", "txn_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("cell").isNotNull(), entry))).alias("m"))
    outs = []
    for i, name in enumerate(found):
        x = F.try_element_at("m", F.lit(i))
        for w in windows:
            n, total = (F.coalesce(x[f"{s}_{w}"], F.lit(0)) for s in ("cnt", "sum"))
            made = {"cnt": n, "sum": total, "min": x[f"min_{w}"], "max": x[f"max_{w}"], "std": sample_std(n, total, F.coalesce(x[f"sq_{w}"], F.lit(0)))}
            outs += [made[s].alias(f"f{w}_{name}_{s}") for s in stats]
    return per_anchor.select("txn_id", *outs)


def _lattice(anchors: DataFrame, flow: DataFrame, windows: Sequence[str], found: Mapping[str, Column], value: Column, stats: Sequence[str]) -> DataFrame:
    """All cells as measures of one look-back."""
    measures, outs = [], []
    for name, where in found.items():
        need = {"cnt": ("cnt",), "sum": ("sum",), "min": ("min",), "max": ("max",), "std": ("cnt", "sum", "sq")}
        parts = {p for s in stats for p in need[s]}
        made = {"cnt": ("count", None), "sum": ("sum", value), "min": ("min", value), "max": ("max", value), "sq": ("sum", value * value)}
        measures += [Measure(f"{name}_{p}", made[p][0], list(windows), where, made[p][1]) for p in sorted(parts)]
        for w in windows:
            for s in stats:
                column = F.col(f"{name}_{s}_{w}") if s != "std" else sample_std(*(F.col(f"{name}_{p}_{w}") for p in ("cnt", "sum", "sq")))
                outs.append(column.alias(f"f{w}_{name}_{s}"))
    return look_back(anchors, flow, measures).select("txn_id", *outs)
