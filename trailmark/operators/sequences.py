"""Order-dependent operators: gaps, lags, carried inflows, rolling frames, daily closes and runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.scalars import flag, positive_ratio, sample_std
from trailmark.operators.joins import pit_join, pit_join_days
from trailmark.plans.blocked import HOT_ROWS, carry_last, hot_accounts, neighbours, running_sum, sum_before
from trailmark.plans.dealt import EACH, dealt
from trailmark.plans.dyadic import TOP, above, cover
from trailmark.plans.lineage import settle
from trailmark.plans.lookback import Measure, look_back
from trailmark.plans.quantiles import PAIR_FACTOR, by_account, interval_quantile, smallest_sums
from trailmark.schema import DAY, SECOND, WINDOWS

ORDER = ("t", "txn_id")


def dedup_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key in a total order. An aggregate, so duplicates collapse map-side."""
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in key]).agg(
        F.min_by(row, F.struct(*order)).alias("m")
    ).select("m.*")


def with_neighbours(
    flow: DataFrame,
    lags: Mapping[str, str] | None = None,
    leads: Mapping[str, str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Attributes of the account's previous and next transaction."""
    return neighbours(flow, ["acct"], list(ORDER), hot_accounts(flow, "t", hot_rows), lags, leads)


def gap_stats(
    anchors: DataFrame, flow: DataFrame, window: str, where: Column, rapid_sec: int = 120, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Positive gaps between consecutive qualifying rows inside the window: number, mean, std, cv.

    ``rapid_cnt`` counts rows at most ``rapid_sec`` after the one before.

    A gap counts for anchors after its later row and as long as its earlier row is still inside the
    window, so each gap is one entry and one exit on the account's time line. Sums are exact integers (microseconds
    and their squares), so what has left the window leaves no trace in the deviation.
    """
    w = WINDOWS[window] * SECOND
    rows = flow.filter(where).select("acct", "txn_id", "t")
    hot = hot_accounts(flow, "t", hot_rows)
    gaps = (
        neighbours(rows, ["acct"], list(ORDER), hot, lags={"pt": "t"})
        .filter(F.col("pt").isNotNull())
        .withColumn("gap", F.col("t") - F.col("pt"))
        .filter(F.col("t") <= F.col("pt") + w)
    )
    g = F.when(F.col("gap") > 0, F.col("gap"))
    steps = gaps.select(
        "acct",
        F.explode(F.array(
            F.struct(F.col("t").alias("e"), F.lit(1).alias("d")),
            F.struct((F.col("pt") + w).alias("e"), F.lit(-1).alias("d")),
        )).alias("x"),
        g.alias("g"),
        flag(F.col("gap") <= rapid_sec * SECOND).alias("r"),
    )
    d = F.col("x.d")
    deltas = steps.select(
        "acct",
        F.col("x.e").alias("e"),
        (d * flag(F.col("g").isNotNull())).cast("long").alias("gap_n"),
        F.coalesce(d * F.col("g"), F.lit(0)).cast("long").alias("gap_sum"),
        F.expr("cast(coalesce(x.d * (cast(g as decimal(19,0)) * cast(g as decimal(19,0))), 0) as decimal(38,0))").alias("gap_ss"),
        (d * F.col("r")).cast("long").alias("rapid_cnt"),
    )
    names = ["gap_n", "gap_sum", "gap_ss", "rapid_cnt"]
    probes = anchors.select("txn_id", "acct", F.col("t").alias("e"))
    out = sum_before(probes, deltas, "e", names, hot).withColumns({
        "gap_sum": F.col("gap_sum") / F.lit(float(SECOND)), "gap_ss": F.col("gap_ss").cast("double") / F.lit(float(SECOND) ** 2),
    })
    mean = positive_ratio("gap_sum", "gap_n")
    std = sample_std(F.col("gap_n"), F.col("gap_sum"), F.col("gap_ss"))
    return out.select(
        "txn_id",
        F.col("gap_n"),
        F.col("rapid_cnt"),
        mean.alias("gap_avg"),
        std.alias("gap_std"),
        F.when(mean > 0, std / mean).alias("gap_cv"),
    )


def gap_range(anchors: DataFrame, flow: DataFrame, window: str, where: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Smallest and largest positive gap between consecutive qualifying rows inside the window.

    A window is an oldest piece, whole days and a newest piece. Gaps inside a piece come from gaps inside
    a day (to the next row for the oldest piece, to the previous row for the newest one); gaps across
    pieces follow from the first and last row of each piece; gaps from one whole day to the next
    are one row per day. Nothing is joined row by row.
    """
    days = WINDOWS[window] // 86_400
    if WINDOWS[window] % 86_400:
        raise ValueError("gap_range needs whole days")
    hot = hot_accounts(flow, "t", hot_rows)
    day = f"({{}} - pmod({{}}, {DAY}L)) div {DAY}L"
    rows = neighbours(
        flow.filter(where).select("acct", "txn_id", "t"), ["acct"], list(ORDER), hot, {"pt": "t"}, {"nt": "t"}
    ).selectExpr("*", f"{day.format('t', 't')} as d", f"{day.format('pt', 'pt')} as pd", f"{day.format('nt', 'nt')} as nd")
    back, ahead = "case when pd = d and t > pt then t - pt end", "case when nd = d and nt > t then nt - t end"
    w = [window]
    got = look_back(anchors, rows, [
        Measure("lo_back", "min", w, None, back), Measure("hi_back", "max", w, None, back), Measure("lo_ahead", "min", w, None, ahead),
        Measure("hi_ahead", "max", w, None, ahead), Measure("first", "min", w, None, "t"), Measure("last", "max", w, None, "t"),
    ], pieces=True, hot_rows=hot_rows)
    # Whole day to whole day: at most one row per account and day.
    cross = rows.filter("nd <> d").select("acct", "d", "nd", (F.col("nt") - F.col("t")).alias("g"))
    own = anchors.selectExpr("acct", f"{day.format('t', 't')} as d0").distinct()
    between = (
        own.alias("a")
        .join(cross.alias("c"), F.expr(f"a.acct = c.acct and c.nd < a.d0 and c.d > a.d0 - {days}"))
        .groupBy("a.acct", "a.d0")
        .agg(F.min("g").alias("lo_cross"), F.max("g").alias("hi_cross"))
    )
    parts = anchors.selectExpr("txn_id", "acct", f"{day.format('t', 't')} as d0").join(between, ["acct", "d0"], "left").join(got, "txn_id")
    f, l = f"first_{window}", f"last_{window}"
    enter = f"coalesce({f}_mid, {f}_end) - {l}_start"
    leave = f"case when {l}_mid is not null then {f}_end - {l}_mid end"

    def all_of(side: str) -> str:
        return f"{side}_ahead_{window}_start, {side}_back_{window}_mid, {side}_back_{window}_end, {side}_cross, {enter}, {leave}"

    second = f"/ {float(SECOND)}D"
    return parts.selectExpr(
        "txn_id", f"least({all_of('lo')}) {second} as gap_min", f"greatest({all_of('hi')}) {second} as gap_max"
    )


def gap_median(
    anchors: DataFrame,
    flow: DataFrame,
    window: str,
    where: Column,
    pair_factor: float = PAIR_FACTOR,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Median positive gap inside the window, exact. Joins the rows only of accounts where that builds few pairs."""
    tagged = flow.filter(where).select("acct", "t", "txn_id")
    mine = anchors.select("txn_id", "acct", "t")

    def paired(mine: DataFrame, tagged: DataFrame) -> DataFrame:
        rows = pit_join(mine, tagged, WINDOWS[window], how="inner", history=["t", "txn_id"])
        per = Window.partitionBy("txn_id").orderBy("h_t", "h_txn_id")
        gaps = rows.withColumn("gap", F.col("h_t") - F.lag("h_t").over(per))
        return gaps.filter("gap > 0").groupBy("txn_id").agg(F.expr("percentile_disc(0.5) within group (order by gap)").alias("q"))

    def digits(mine: DataFrame, tagged: DataFrame) -> DataFrame:
        hot = hot_accounts(tagged, "t", hot_rows)
        pairs = neighbours(tagged, ["acct"], list(ORDER), hot, {"pt": "t"}).filter("t > pt")
        w = WINDOWS[window] * SECOND
        items = pairs.selectExpr("acct", "t as enter", f"pt + {w}L as leave", "t - pt as v").filter("enter <= leave")
        return interval_quantile(mine, items, 0.5, hot_rows)

    stats = by_account(mine, tagged, pair_factor, paired, digits)
    median = (F.col("q") / F.lit(float(SECOND))).alias("gap_median")
    return mine.select("txn_id").join(stats, "txn_id", "left").select("txn_id", median)


def rolling_min(
    flow: DataFrame, value: Column, windows: Sequence[str], name: str, where: Column | None = None
) -> DataFrame:
    """Minimum over the trailing window including the current row, per flow row."""
    return look_back(flow, flow, [Measure(name, "min", list(windows), where, value)], inclusive=True)


def rolling_count(flow: DataFrame, preds: Mapping[str, Column], windows: Sequence[str]) -> DataFrame:
    """Conditional counts over the strictly earlier rows of the trailing window, per flow row."""
    return look_back(flow, flow, [Measure(n, "count", list(windows), p) for n, p in preds.items()])


def last_qualifying(
    flow: DataFrame, pred: Column, name: str = "last_id", col: str = "txn_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Value of ``col`` on the latest qualifying row up to and including the current one."""
    hot = hot_accounts(flow, "t", hot_rows)
    return carry_last(flow, ["acct"], list(ORDER), {name: F.when(pred, F.col(col))}, hot)


def out_follow_in_rank(
    flow: DataFrame, inflow: Column, outflow: Column, within_sec: int = 86_399, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """For outflows within ``within_sec`` of the latest qualifying inflow: their number after that inflow."""
    hot = hot_accounts(flow, "t", hot_rows)
    last = {"in_id": F.when(inflow, F.col("txn_id")), "in_t": F.when(inflow, F.col("t"))}
    carried = carry_last(flow, ["acct"], list(ORDER), last, hot)
    age = F.col("t") - F.col("in_t")
    follows = carried.filter(outflow & F.col("in_id").isNotNull() & age.between(0, within_sec * SECOND))
    ranked = running_sum(follows, ["acct", "in_id"], list(ORDER), {"follow_rank": F.lit(1).cast("long")}, hot)
    return carried.join(ranked.select("txn_id", "follow_rank"), "txn_id", "left")


def day_open_close(flow: DataFrame, value: str = "bal") -> DataFrame:
    """First and last value of every account day; two-sided aggregate, no sort of the day's rows."""
    at = F.struct(*ORDER)
    return flow.groupBy("acct", "dt").agg(
        F.min_by(value, at).alias(f"{value}_open"),
        F.max_by(value, at).alias(f"{value}_close"),
        F.min_by("txn_id", at).alias("first_id"),
        F.max_by("txn_id", at).alias("last_id"),
    )


def balance_trend(daily: DataFrame, close: str = "bal_close") -> DataFrame:
    """14-row moving average, 12-row minus 26-row average, and a flag for closes above 105 % of the first.

    One row per account day goes in, so a window partition is bounded by the days of the history.
    """
    rows = Window.partitionBy("acct").orderBy("dt")

    def ma(n: int) -> Column:
        return F.avg(close).over(rows.rowsBetween(-(n - 1), 0))

    return daily.withColumns({"ma14": ma(14), "macd": ma(12) - ma(26)}).withColumn(
        "high_close", flag(F.col(close) > 1.05 * F.col("ma14"))
    )


def trend_rollup(points: DataFrame, trend: DataFrame, day: str = "snap_dt", days: int = 90) -> DataFrame:
    """Share of negative trend days and number and share of high closes over the last ``days`` days."""
    off = F.datediff(F.col(f"p.{day}"), F.col("h.dt"))
    cond = (F.col("p.acct") == F.col("h.acct")) & off.between(0, days - 1)
    side = trend.select("acct", "dt", flag(F.col("macd") < 0).alias("neg"), F.col("high_close").alias("high"))
    joined = points.alias("p").join(side.alias("h"), cond, "left").select(f"p.acct", f"p.{day}", "h.neg", "h.high")
    none = F.lit(0.0)
    return joined.groupBy("acct", day).agg(
        F.coalesce(F.avg("neg"), none).alias("neg_ratio"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high_cnt"),
        F.coalesce(F.avg("high"), none).alias("high_ratio"),
    )


def low_gap_average(
    points: DataFrame, flow: DataFrame, days: int = 180, lo: float = 0.005, hi: float = 0.015, day: str = "snap_dt", hot_rows: int = HOT_ROWS,
    pair_factor: float = PAIR_FACTOR,
) -> DataFrame:
    """Mean of the gaps whose dense rank, as a share of the window's rows, lies strictly in (lo, hi).

    A gap is in the windows that hold both its rows: one entry and one exit on the account's days. Accounts whose rows and days make
    few pairs have their gaps ranked in each window. For the others the ranks asked for are found digit by digit among the
    distinct gaps in the window, and what lies up to them is added up on the way, so no window of theirs is ever listed.
    """
    hot = hot_accounts(flow, "t", hot_rows)
    flow = flow.select("acct", "txn_id", "t", "dt")
    # a window's rows are sorted three times, so a task gets fewer than usual
    flow = dealt(flow, ["acct"], flow.count(), EACH // 4) if hot.isEmpty() else flow
    follows = neighbours(flow, ["acct"], list(ORDER), hot, lags={"pt": "t", "pd": "dt"})
    number = F.unix_date("dt").cast("long")
    follows = follows.select("acct", number.alias("d"), (F.unix_date("pd").cast("long") + days - 1).alias("leave"), (F.col("t") - F.col("pt")).alias("v"))
    probes = points.select("acct", F.unix_date(day).cast("long").alias("e")).distinct()

    def paired(probes: DataFrame, follows: DataFrame) -> DataFrame:
        near = (F.col("p.acct") == F.col("h.acct")) & (F.col("d") <= F.col("e")) & (F.col("d") > F.col("e") - days)
        rows = probes.alias("p").join(follows.alias("h"), near, "left")
        gaps = rows.groupBy("p.acct", "e", F.when(F.col("e") <= F.col("leave"), F.col("v")).alias("v")).agg(F.count("d").alias("c"))
        per = Window.partitionBy("acct", "e")
        ranked = gaps.withColumns({"rank": F.row_number().over(per.orderBy(F.asc_nulls_last("v"))), "n": F.sum("c").over(per)})
        share = F.when(F.col("n") > 0, F.col("rank").cast("double") / F.col("n"))
        asked = F.col("v").isNotNull() & (share > lo) & (share < hi)
        return ranked.groupBy("acct", "e").agg(*[F.sum(F.when(asked, x)).alias(c) for c, x in (("n", F.col("c")), ("total", F.col("v") * F.col("c")))])

    def digits(probes: DataFrame, follows: DataFrame) -> DataFrame:
        gaps = follows.filter(F.col("v").isNotNull()).select("acct", "v", (F.col("d") - 1).alias("enter"), "leave").filter("enter < leave")
        rows = follows.groupBy("acct", "d").agg(F.count(F.lit(1)).alias("n"))
        rows = rows.select("acct", F.explode(F.array(F.struct((F.col("d") - 1).alias("e"), "n"), F.struct((F.col("d") + days - 1).alias("e"), (-F.col("n")).alias("n")))).alias("x"))
        steps = rows.select("acct", "x.*").groupBy("acct", "e").agg(F.sum("n").alias("n"))
        total = sum_before(probes, steps, "e", ["n"], hot_accounts(steps, "e", hot_rows)).filter("n > 0")
        # the least rank above ``lo`` and the largest below ``hi``, by the same division as in the definition
        at = lambda r: f"(({r}) / cast(n as double))"
        least, most = f"cast(floor({float(lo)}D * n) as bigint)", f"cast(ceil({float(hi)}D * n) as bigint)"
        asked = total.selectExpr(
            "acct", "e", f"case when {at(least)} > {float(lo)}D then {least} when {at(least + ' + 1')} > {float(lo)}D then {least} + 1 else {least} + 2 end as r1",
            f"case when {at(most)} < {float(hi)}D then {most} when {at(most + ' - 1')} < {float(hi)}D then {most} - 1 else {most} - 2 end as r2")
        asked = asked.filter("r1 <= r2").selectExpr("acct", "e", "explode(array(struct(0 as side, r1 - 1 as k), struct(1 as side, r2 as k))) as x")
        sums = smallest_sums(asked.selectExpr("acct", "e", "x.side as side", "x.k as k"), gaps, ["acct", "e", "side"], hot_rows)
        both = sums.groupBy("acct", "e").agg(*[F.sum(F.when(F.col("side") == 1, F.col(c)).otherwise(-F.col(c))).alias(c) for c in ("n", "total")])
        return probes.join(both.select("acct", "e", "n", F.col("total").cast("long").alias("total")), ["acct", "e"], "left")

    sums = by_account(probes, follows, pair_factor, paired, digits, hot_rows)
    mean = F.when(F.col("n") > 0, F.col("total").cast("double") / F.col("n") / F.lit(float(SECOND))).alias("low_gap_avg")
    return sums.select("acct", F.date_from_unix_date(F.col("e").cast("int")).alias(day), mean)


def direction_runs(
    points: DataFrame, flow: DataFrame, lo: int, hi: int, day: str = "snap_dt", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Maximal runs of same-direction rows inside each day window: totals, counts and end of each run.

    Runs are numbered once over the account's whole history and reduced to one row per (run, day)
    before the window join; a window can only cut the first of its runs, at a day boundary.
    """
    hot = hot_accounts(flow, "t", hot_rows)
    turned = neighbours(flow.select("acct", "txn_id", "t", "dt", "dir", "amt"), ["acct"], list(ORDER), hot, {"pd": "dir"})
    change = flag(F.col("pd").isNull() | (F.col("pd") != F.col("dir"))).cast("long")
    numbered = running_sum(turned, ["acct"], list(ORDER), {"run": change}, hot)
    pieces = numbered.groupBy("acct", "run", "dt", "dir").agg(
        F.sum("amt").alias("amt"), F.count("amt").alias("cnt"), F.max("t").alias("t")
    )
    rows = pit_join_days(points, pieces, lo, hi, day, "inner", ["run", "dir", "amt", "cnt", "t"])
    return rows.groupBy("acct", day, F.col("h_run").alias("run"), F.col("h_dir").alias("dir")).agg(
        F.sum("h_amt").alias("run_amt"), F.sum("h_cnt").alias("run_cnt"), F.max("h_t").alias("end_t")
    )


def equal_amount_runs(
    points: DataFrame,
    flow: DataFrame,
    lo: int,
    hi: int,
    low: float = 0.8,
    high: float = 1.2,
    day: str = "snap_dt",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Runs of money in and out whose totals nearly match.

    Runs alternate, so pairing a run with the one before it inside the group opened by each inflow run
    (or by each outflow run) is pairing an outflow run with its inflow run (or the reverse).

    A window cuts only its first and its last run. The pairs of whole runs between them are constant: they are summarised in aligned blocks
    of 1, 2, 4, ... pairs, and a window merges the few blocks that cover its pairs with those two at its ends. No run is
    ever listed for a window, so an account whose directions alternate costs rows x log(rows).
    """
    hot = hot_accounts(flow, "t", hot_rows)
    flow = flow.select("acct", "txn_id", "t", "dt", "dir", "amt")
    rows = flow.count()
    flow = dealt(flow, ["acct"], rows, EACH // 4) if hot.isEmpty() else flow
    turned = neighbours(flow, ["acct"], list(ORDER), hot, {"pd": "dir"})
    change = flag(F.col("pd").isNull() | (F.col("pd") != F.col("dir"))).cast("long")
    numbered = running_sum(turned, ["acct"], list(ORDER), {"run": change}, hot)
    pieces = settle(numbered.groupBy("acct", "run", "dt", "dir").agg(F.sum("amt").alias("amt"), F.count("amt").alias("cnt")))
    runs = settle(pieces.groupBy("acct", "run", "dir").agg(F.sum("amt").alias("amt"), F.sum("cnt").alias("cnt")))
    # no block is larger than the longest account asks for
    top = min(TOP, int(runs.agg(F.max("run")).first()[0] or 0).bit_length())

    def paired(prev_amt: Column, prev_cnt: Column, amt: Column, cnt: Column, after: Column) -> Column:
        """What a pair adds, as the summary of one pair: of the side that its second run's direction names."""
        ratio = amt / F.nullif(prev_amt, F.lit(0.0))
        hit = ratio.between(low, high)
        return F.struct(
            after.alias("side"), F.when(hit, 1).otherwise(0).cast("long").alias("hits"), F.when(hit, F.greatest(amt, prev_amt)).alias("back_amt"),
            F.when(hit, F.greatest(cnt, prev_cnt)).alias("back_cnt"), F.when(ratio.isNotNull(), 1).otherwise(0).cast("long").alias("n"),
            ratio.alias("mean"), F.when(ratio.isNotNull(), F.lit(0.0)).alias("m2"), ratio.alias("top"), ratio.alias("least"))

    # pair j is of the runs j and j + 1 (numbers start at 1)
    nexts = runs.select("acct", (F.col("run") - 1).alias("run"), F.col("dir").alias("n_dir"), F.col("amt").alias("n_amt"), F.col("cnt").alias("n_cnt"))
    pairs = dealt(runs, ["acct", "run"], rows, EACH // 4).join(nexts, ["acct", "run"]).select("acct", "run", paired(F.col("amt"), F.col("cnt"), F.col("n_amt"), F.col("n_cnt"), F.col("n_dir")).alias("p"))
    blocks = pairs.select("acct", F.explode(above(F.col("run"), top)).alias("b"), "p.*").groupBy("acct", "b.level", "b.node", "side").agg(
        F.sum("hits").alias("hits"), F.max("back_amt").alias("back_amt"), F.max("back_cnt").alias("back_cnt"), F.sum("n").alias("n"),
        F.avg("mean").alias("mean"), (F.var_pop("mean") * F.count("mean")).alias("m2"), F.max("top").alias("top"), F.min("least").alias("least"))

    # what is left of a day's first run from that day on, and what there is of its last run up to that day
    by_day = Window.partitionBy("acct", "run")
    ahead, back = (by_day.orderBy(F.desc("dt")), by_day.orderBy("dt"))
    so_far = dealt(pieces, ["acct", "run"], rows, EACH // 4).withColumns({f"{c}_{n}": F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in ("amt", "cnt") for n, w in (("left", ahead), ("upto", back))})
    days = so_far.groupBy("acct", "dt").agg(
        F.min(F.struct("run", F.col("amt_left").alias("amt"), F.col("cnt_left").alias("cnt"))).alias("first"),
        F.max(F.struct("run", F.col("amt_upto").alias("amt"), F.col("cnt_upto").alias("cnt"), "dir")).alias("last"))
    # one row for each active day and each end of a window: bounded by the days of the history
    ends = dealt(points.select("acct", day).distinct(), ["acct", day], rows, EACH // 4)
    marks = ends.select("acct", day, F.explode(F.array(F.struct(F.date_sub(day, hi).alias("dt"), F.lit(0).alias("end")), F.struct(F.date_sub(day, lo).alias("dt"), F.lit(1).alias("end")))).alias("m"))
    line = days.select("acct", "dt", "first", "last", F.lit(None).cast("date").alias(day), F.lit(None).cast("int").alias("end")).unionByName(
        marks.select("acct", "m.dt", F.lit(None).cast(days.schema["first"].dataType).alias("first"), F.lit(None).cast(days.schema["last"].dataType).alias("last"), day, "m.end"))
    line = dealt(line, ["acct"], rows, EACH // 4)
    onward = Window.partitionBy("acct").orderBy(F.desc("dt"), F.asc_nulls_first("end")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("acct").orderBy("dt", F.asc_nulls_first("end")).rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumns({"next_day": F.last(F.when(F.col("first").isNotNull(), F.struct("dt", "first")), ignorenulls=True).over(onward),
        "last_day": F.last(F.when(F.col("last").isNotNull(), F.struct("dt", "last")), ignorenulls=True).over(before)})
    cut = line.filter(F.col("end").isNotNull()).groupBy("acct", day).agg(
        F.max(F.when(F.col("end") == 0, F.col("next_day"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("last_day"))).alias("b"))
    cut = cut.filter("a.dt <= b.dt and a.first.run < b.last.run").select(
        "acct", day, F.col("a.first.run").alias("run_a"), F.col("a.first.amt").alias("amt_a"), F.col("a.first.cnt").alias("cnt_a"),
        F.col("b.last.run").alias("run_b"), F.col("b.last.amt").alias("amt_b"), F.col("b.last.cnt").alias("cnt_b"), F.col("b.last.dir").alias("dir_b"))
    cut = settle(cut)

    # the pairs at both ends; they are one and the same where two runs are all there is
    wide = cut.filter("run_b > run_a + 1")
    second = runs.select("acct", (F.col("run") - 1).alias("run_a"), F.col("dir").alias("o_dir"), F.col("amt").alias("o_amt"), F.col("cnt").alias("o_cnt"))
    prior = runs.select("acct", (F.col("run") + 1).alias("run_b"), F.col("amt").alias("o_amt"), F.col("cnt").alias("o_cnt"))
    only = cut.filter("run_b = run_a + 1").select("acct", day, paired(F.col("amt_a"), F.col("cnt_a"), F.col("amt_b"), F.col("cnt_b"), F.col("dir_b")).alias("p"))
    opens = wide.join(second, ["acct", "run_a"]).select("acct", day, paired(F.col("amt_a"), F.col("cnt_a"), F.col("o_amt"), F.col("o_cnt"), F.col("o_dir")).alias("p"))
    closes = wide.join(prior, ["acct", "run_b"]).select("acct", day, paired(F.col("o_amt"), F.col("o_cnt"), F.col("amt_b"), F.col("cnt_b"), F.col("dir_b")).alias("p"))
    whole = wide.select("acct", day, F.explode(cover(F.col("run_a") + 1, F.col("run_b") - 1, top)).alias("x")).select("acct", day, "x.*")
    inner = whole.join(blocks, ["acct", "level", "node"]).drop("level", "node")
    parts = inner.unionByName(only.unionByName(opens).unionByName(closes).select("acct", day, "p.*"))

    # a few summaries for each window and side: means and squared deviations are merged about the common mean
    mean = (F.sum(F.col("n") * F.col("mean")) / F.nullif(F.sum("n"), F.lit(0))).alias("mean")
    sides = parts.groupBy("acct", day, "side").agg(
        F.sum("hits").alias("hits"), F.max("back_amt").alias("back_amt"), F.max("back_cnt").alias("back_cnt"), F.sum("n").alias("n"), mean,
        F.sum("m2").alias("m2"), F.collect_list(F.when(F.col("n") > 0, F.struct("n", "mean"))).alias("parts"), F.max("top").alias("top"), F.min("least").alias("least"))
    spread = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["n"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean")))
    sides = sides.withColumn("std", F.sqrt((F.col("m2") + spread) / F.nullif(F.col("n"), F.lit(0))))
    zero = F.lit(0)
    stats = sides.groupBy("acct", day).agg(
        F.max("hits").alias("pair_cnt"), F.coalesce(F.max("back_amt"), F.lit(0.0)).alias("pair_max_amt"), F.coalesce(F.max("back_cnt"), zero).alias("pair_max_cnt"),
        F.min("std").alias("ratio_std"), F.max("mean").alias("ratio_avg"), F.max("top").alias("ratio_max"), F.min("least").alias("ratio_min"))
    return ends.join(stats, ["acct", day], "left").fillna(0, ["pair_cnt", "pair_max_amt", "pair_max_cnt"])


def follow_pattern_flag(
    flow: DataFrame, first: Column, second: Column, within_sec: int = 300, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Flag rows matching ``second`` whose previous row matches ``first`` less than ``within_sec`` earlier."""
    marked = flow.withColumn("__first", flag(first))
    out = with_neighbours(marked, {"prev_first": "__first", "prev_t": "t"}, hot_rows=hot_rows)
    quick = F.col("t") - F.col("prev_t") < within_sec * SECOND
    return out.withColumn("follows", flag(second & (F.col("prev_first") == 1) & quick)).drop("__first", "prev_first")


def with_total(df: DataFrame, keys: Sequence[str], name: str = "total") -> DataFrame:
    """Group size next to each row: aggregate and join back, so a hot group is never gathered."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return df.join(sizes, list(keys))


def running_balance(flow: DataFrame, start: float = 1000.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Account balance after each transaction from a common opening balance."""
    signed = F.when(F.col("dir") == 1, F.col("amt")).otherwise(-F.col("amt"))
    hot = hot_accounts(flow, "t", hot_rows)
    out = running_sum(flow, ["acct"], list(ORDER), {"bal": signed}, hot)
    return out.withColumn("bal", F.round(F.col("bal") + start, 2))
