"""Trailing-window aggregates per anchor without building (anchor, history row) pairs.

The account time line is cut into fixed blocks. A window ``[t - W, t)`` whose length is a multiple of
the block width is the disjoint union of

* the rows of the anchor's own block that precede it   - a running aggregate, ascending,
* the rows of block ``b - W/width`` from ``t - W`` on  - a running aggregate, descending,
* the whole blocks in between                          - one pre-aggregated row each.

(The two running aggregates are the van Herk / Gil-Werman sliding-window scheme.) Counts, sums, minima
and maxima of any number of windows come from one shuffle of the rows by (account, block), so cost grows
with ``rows + anchors * windows`` and an account that owns a third of all rows is spread over its
blocks; blocks that are still too large are cut further into time slots. Nothing is subtracted, so
there is no cancellation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.plans.blocked import HOT_ROWS, fetched
from trailmark.plans.dealt import EACH, dealt
from trailmark.schema import SECOND, WINDOWS


def _column(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


_NO_ROWS = "named_struct('n', 0D, 'mean', 0D, 'm2', 0D)"


def _common_spread(parts: str) -> str:
    """One (n, mean, m2) of an array of them: squared deviations are moved to the common mean, so large means cancel nothing."""
    gap, n = "(y.mean - x.mean)", "(x.n + y.n)"
    both = f"named_struct('n', {n}, 'mean', x.mean + {gap} * y.n / {n}, 'm2', x.m2 + y.m2 + {gap} * {gap} * x.n * y.n / {n})"
    return f"aggregate({parts}, {_NO_ROWS}, (x, y) -> case when x.n = 0 then y when y.n = 0 then x else {both} end)"


@dataclass(frozen=True)
class Measure:
    """One aggregate over the rows of a window.

    kind: ``count``, ``sum``, ``min``, ``max``, ``days`` (distinct active days), ``peak`` (largest
    number of rows in one day) or ``spread`` (struct of ``n``, ``mean`` and ``m2``, the squared deviations from the mean).
    ``where`` and ``value`` are columns or SQL text. Output columns are ``{name}_{window label}``.
    """

    name: str
    kind: str
    windows: Sequence[str]
    where: Column | str | None = field(default=None, compare=False)
    value: Column | str | None = field(default=None, compare=False)

    def row_value(self) -> Column:
        value = F.lit(1) if self.kind in ("count", "days", "peak") else _column(self.value)
        return value if self.where is None else F.when(_column(self.where), value)

    def fold(self, x: str, over: str = "") -> str:
        """Aggregate (SQL) of row values within a block."""
        if self.kind == "spread":
            n, mean, var = (f"cast(coalesce({f}({x}) {over}, 0) as double)" for f in ("count", "avg", "var_pop"))
            return f"named_struct('n', {n}, 'mean', {mean}, 'm2', {var} * {n})"
        return f"{self.kind if self.kind in ('min', 'max') else 'sum'}({x}) {over}"

    def merge(self, x: str) -> str:
        """Aggregate (SQL) of block-level partial results across blocks."""
        if self.kind == "spread":
            return _common_spread(f"collect_list({x})")
        if self.kind == "days":
            return f"sum(case when {x} > 0 then 1 end)"
        return f"max({x})" if self.kind == "peak" else self.fold(x)

    def carry(self, x: str, over: str) -> str:
        """Aggregate (SQL) of partial results over a frame of them."""
        return _common_spread(f"collect_list({x}) {over}") if self.kind == "spread" else self.fold(x, over)

    def combine(self, parts: Sequence[str]) -> str:
        """Final value (SQL) from the partial results of the pieces of a window."""
        if self.kind == "spread":
            return _common_spread(f"array_compact(array({', '.join(parts)}))")
        if self.kind in ("min", "max", "peak"):
            pick = "least" if self.kind == "min" else "greatest"
            best = f"{pick}({', '.join(parts)})" if len(parts) > 1 else parts[0]
            return f"coalesce({best}, 0)" if self.kind == "peak" else best
        return " + ".join(f"coalesce({p}, 0)" for p in parts)


def look_back(
    anchors: DataFrame,
    flow: DataFrame,
    measures: Sequence[Measure],
    *,
    inclusive: bool = False,
    pieces: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One row per anchor: ``txn_id`` and ``{measure}_{window}`` over the strictly earlier history.

    Every anchor is kept: counts, sums and days are 0 and minima and maxima NULL on an empty history.
    ``inclusive`` also counts the rows at the anchor's own time (a frame ending at the current row).
    ``pieces`` returns the three parts of each window instead of their combination, as
    ``{measure}_{window}_start`` (oldest block), ``_mid`` (whole blocks) and ``_end`` (the anchor's block).
    """
    groups: dict[int, dict[str, list[str]]] = {}
    for m in measures:
        for label in m.windows:
            secs = WINDOWS[label]
            if m.kind in ("days", "peak") and secs % 86_400:
                raise ValueError(f"{m.kind} needs whole days, not {label}")
            width = 86_400 if secs % 86_400 == 0 else secs
            groups.setdefault(width, {}).setdefault(label, []).append(m.name)
    by_name = {m.name: m for m in measures}
    if len(by_name) != len(measures):
        raise ValueError("measure names must be unique")
    if taken := by_name.keys() & {"acct", "t", "b", "b0", "w", "kind", "slot", "cuts", "txn_id", "n_rows"}:
        raise ValueError(f"reserved measure names: {sorted(taken)}")
    out = None
    for width, labels in sorted(groups.items()):
        used = sorted({n for names in labels.values() for n in names})
        part = _scan(anchors, flow, [by_name[n] for n in used], labels, width * SECOND, inclusive, pieces, hot_rows)
        out = part if out is None else out.join(part, "txn_id")
    return out


def _scan(
    anchors: DataFrame,
    flow: DataFrame,
    measures: Sequence[Measure],
    labels: dict[str, list[str]],
    width: int,
    inclusive: bool,
    pieces: bool,
    hot_rows: int | None,
) -> DataFrame:
    names = [m.name for m in measures]
    span = {lab: WINDOWS[lab] * SECOND // width for lab in labels}
    wants = [(m, lab) for m in measures for lab in labels if m.name in labels[lab]]
    block = f"(t - pmod(t, {width}L)) div {width}L"
    folds = [f"{m.fold(m.name)} as {m.name}" for m in measures]

    rows = flow.select("acct", "t", *[m.row_value().alias(m.name) for m in measures])
    totals = (
        rows.selectExpr("acct", f"{block} as b", *names)
        .groupBy("acct", "b")
        .agg(*[F.expr(x) for x in folds], F.expr("count(1) as n_rows"))
    )

    # Probes: w = 0 is the anchor itself, w = k the start of the window of k blocks.
    spans = sorted(set(span.values()))
    points = [f"struct(0 as w, t as p, {2 if inclusive else 0} as kind)"]
    points += [f"struct({k} as w, t - {k * width}L as p, 0 as kind)" for k in spans]
    probes = anchors.selectExpr("acct", "txn_id", f"explode(array({', '.join(points)})) as x").selectExpr(
        "acct", "x.p as t", "txn_id", "x.w as w", "x.kind as kind"
    )
    lines = (
        rows.selectExpr("*", "1 as kind")
        .unionByName(probes, allowMissingColumns=True)
        .selectExpr("*", f"{block} as b")
    )
    part_by = "acct, b"
    # a row carries every measure up and down its block, so the more measures, the fewer rows a task gets
    each = 6 * EACH // (len(names) + 4)
    deal = None
    if hot_rows:
        n, most, asked = totals.agg(F.sum("n_rows"), F.max("n_rows")).crossJoin(anchors.agg(F.count(F.lit(1)))).first()
        deal = (n or 0) + asked * len(points)
        # at most rows / hot_rows blocks; without any, no block is cut
        hot_rows = hot_rows if (most or 0) > hot_rows else None
    if hot_rows:
        hot = fetched(totals.filter(f"n_rows > {hot_rows}").selectExpr("acct", "b", f"n_rows div {hot_rows}L + 1 as cuts"))
        lines = lines.join(F.broadcast(hot), ["acct", "b"], "left").selectExpr(
            "*", f"coalesce((pmod(t, {width}L) * cuts) div {width}L, 0L) as slot"
        )
        part_by = "acct, b, slot"
    if deal is not None:
        lines = dealt(lines, [k.strip() for k in part_by.split(",")], deal, each)

    frame = "rows between unbounded preceding and current row"
    up = f"over (partition by {part_by} order by t, kind {frame})"
    down = f"over (partition by {part_by} order by t desc, kind desc {frame})"
    ups = [f"{m.fold(m.name, up)} as u_{m.name}" for m in measures]
    downs = [f"{m.fold(m.name, down)} as d_{m.name}" for m in measures]
    keys = [k.strip() for k in part_by.split(",")]
    edge = (
        lines.selectExpr("*", *ups, *downs)
        .filter("kind <> 1")
        .selectExpr(*keys, "txn_id", "w", *[f"case when w > 0 then d_{n} else u_{n} end as {n}" for n in names])
    )
    if hot_rows:
        edge = _add_slot_carry(edge, lines, measures)

    picks = []
    for m, lab in wants:
        parts = {"_end": "0", "_start": str(span[lab])} if pieces else {"": f"0, {span[lab]}"}
        picks += [f"{m.merge(f'case when w in ({ws}) then {m.name} end')} as {m.name}_{lab}{p}" for p, ws in parts.items()]
    edge = edge.selectExpr("*", "b + w as b0")
    if deal is not None and not hot_rows:
        edge = dealt(edge, ["acct", "b0"], deal, each)
    per_anchor = edge.groupBy("txn_id", "acct", "b0").agg(*[F.expr(x) for x in picks])
    outs = {f"{m.name}_{lab}": (m, [f"{m.name}_{lab}"]) for m, lab in wants}
    deepest = max(spans)
    if deepest > 1:
        mids = []
        for m, lab in wants:
            if span[lab] > 1:
                inside = f"case when b0 - b < {span[lab]} then {m.name} end"
                mids.append(f"{m.merge(inside)} as mid_{m.name}_{lab}")
                outs[f"{m.name}_{lab}"][1].append(f"mid_{m.name}_{lab}")
        points_in_blocks = anchors.selectExpr("acct", f"{block} as b0").distinct()
        if deal is not None:
            points_in_blocks = dealt(points_in_blocks, ["acct"], deal, each)
        between = (
            points_in_blocks.alias("a")
            .join(totals.alias("h"), F.expr(f"a.acct = h.acct and h.b < a.b0 and h.b > a.b0 - {deepest}"))
            .selectExpr("a.acct", "a.b0", "h.b", *[f"h.{n}" for n in names])
            .groupBy("acct", "b0")
            .agg(*[F.expr(x) for x in mids])
        )
        per_anchor = per_anchor.join(between, ["acct", "b0"], "left")
    if pieces:
        cols = []
        for m, lab in wants:
            mid = f"mid_{m.name}_{lab}" if span[lab] > 1 else "null"
            cols += [f"{m.name}_{lab}_start", f"{mid} as {m.name}_{lab}_mid", f"{m.name}_{lab}_end"]
        return per_anchor.selectExpr("txn_id", *cols)
    return per_anchor.selectExpr("txn_id", *[f"{m.combine(parts)} as {n}" for n, (m, parts) in outs.items()])


def _add_slot_carry(edge: DataFrame, lines: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """For blocks cut into slots, add the slots of the same block before (after) the probe's slot."""
    frame = "rows between unbounded preceding and 1 preceding"
    before = f"over (partition by acct, b order by slot {frame})"
    after = f"over (partition by acct, b order by slot desc {frame})"
    slots = (
        lines.filter("cuts is not null")
        .groupBy("acct", "b", "slot")
        .agg(*[F.expr(f"{m.fold(m.name)} as {m.name}") for m in measures])
        .selectExpr(
            "acct",
            "b",
            "slot",
            *[f"{m.carry(m.name, before)} as cu_{m.name}" for m in measures],
            *[f"{m.carry(m.name, after)} as cd_{m.name}" for m in measures],
        )
    )
    merged = []
    for m in measures:
        carry = f"case when w > 0 then cd_{m.name} else cu_{m.name} end"
        if m.kind == "spread":
            merged.append(f"{m.combine([m.name, carry])} as {m.name}")
        elif m.kind in ("min", "max"):
            pick = "least" if m.kind == "min" else "greatest"
            merged.append(f"{pick}({m.name}, {carry}) as {m.name}")
        else:
            merged.append(f"coalesce({m.name} + {carry}, {m.name}, {carry}) as {m.name}")
    joined = edge.join(slots, ["acct", "b", "slot"], "left")
    return joined.selectExpr("acct", "b", "txn_id", "w", *merged)


def look_back_days(
    anchors: DataFrame,
    flow: DataFrame,
    measures: Sequence[Measure],
    bands: dict[str, tuple[int, int]],
    *,
    keys: Sequence[str] = ("txn_id", "acct", "dt"),
) -> DataFrame:
    """Date-offset windows ``lo <= datediff(anchor day, history day) <= hi``.

    The flow is reduced to one row per (account, day) before the band join, so an anchor day meets at
    most ``hi - lo + 1`` rows however busy the account is. ``measure.windows`` are labels of ``bands``.
    """
    names = [m.name for m in measures]
    daily = (
        flow.select("acct", "dt", *[m.row_value().alias(m.name) for m in measures])
        .groupBy("acct", "dt")
        .agg(*[F.expr(f"{m.fold(m.name)} as {m.name}") for m in measures])
    )
    acct, day = keys[-2], keys[-1]
    lo = min(b[0] for b in bands.values())
    hi = max(b[1] for b in bands.values())
    points = anchors.selectExpr(f"{acct} as acct", f"{day} as day0").distinct()
    aggs, outs = [], []
    for m in measures:
        for lab in m.windows:
            a, b = bands[lab]
            name = f"{m.name}_{lab}"
            inside = f"case when off between {a} and {b} then {m.name} end"
            aggs.append(F.expr(f"{m.merge(inside)} as {name}"))
            outs.append(f"{m.combine([name])} as {name}")
    windowed = (
        points.alias("a")
        .join(daily.alias("h"), F.expr(f"a.acct = h.acct and datediff(day0, dt) between {lo} and {hi}"), "left")
        .selectExpr("a.acct", "a.day0", "datediff(day0, dt) as off", *[f"h.{n}" for n in names])
        .groupBy("acct", "day0")
        .agg(*aggs)
        .selectExpr(f"acct as {acct}", f"day0 as {day}", *outs)
    )
    return anchors.select(*keys).join(windowed, [acct, day])
