"""Ranks and percentiles of a value inside trailing windows.

Both are exact at every size, whatever the values: NULL rows are left out, equal values are equal, nothing is rounded.
Where an account has few rows the rows of each window are simply joined. For accounts where that would build too many
pairs - anchors times rows of each account are counted first - the values are replaced by their
positions among all distinct values and handled digit by digit: the rows below a value split by the first
digit in which they differ, so a rank is a sum of windowed counts over (account, position prefix), and a
percentile is found by choosing one hexadecimal digit per round from windowed counts. Cost is
rows x digits, and a hot account is spread over its prefixes as well as its time blocks. The two plans give
the same rows; tests hold them against each other and the definition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.plans.blocked import hot_accounts, running_sum, sum_before
from trailmark.plans.lineage import settle
from trailmark.plans.lookback import HOT_ROWS, Measure, look_back

#: Pairs per input row up to which joining is the cheaper plan.
PAIR_FACTOR = 64.0


def heavy_accounts(anchors: DataFrame, flow: DataFrame, pair_factor: float = PAIR_FACTOR, hot_rows: int | None = None) -> DataFrame:
    """Accounts whose anchors times rows exceed ``pair_factor`` for each of their anchors and rows, or that have more than ``hot_rows`` rows. Stored."""
    a = anchors.groupBy("acct").agg(F.count(F.lit(1)).cast("double").alias("a"))
    r = flow.groupBy("acct").agg(F.count(F.lit(1)).cast("double").alias("r"))
    many = F.col("a") * F.col("r") > pair_factor * (F.col("a") + F.col("r"))
    return settle(a.join(r, "acct").filter(many if hot_rows is None else many | (F.col("r") > hot_rows)).select("acct"))


def by_account(
    anchors: DataFrame, flow: DataFrame, pair_factor: float, paired: Callable[[DataFrame, DataFrame], DataFrame], digits: Callable[[DataFrame, DataFrame], DataFrame],
    hot_rows: int | None = None,
) -> DataFrame:
    """The rows of both plans, each for its accounts: joined pairs where they are few *for the account*, digits for the others.

    So the pairs are at most ``pair_factor`` times the input, however the rows are spread over the accounts.
    """
    heavy = heavy_accounts(anchors, flow, pair_factor, hot_rows)
    if heavy.isEmpty():
        return paired(anchors, flow)
    sides = [[df.join(heavy, "acct", how) for df in (anchors, flow)] for how in ("left_anti", "left_semi")]
    return paired(*sides[0]).unionByName(digits(*sides[1]))


def positions(frames: Sequence[DataFrame], value: str) -> tuple[DataFrame, int]:
    """(value, v): the position of every distinct non-NULL value in order, and how many bits hold all positions.

    Values are dealt out by range and numbered range by range; only one count for each range is fetched.
    """
    values = frames[0].select(value)
    for df in frames[1:]:
        values = values.unionByName(df.select(value))
    values = values.filter(F.col(value).isNotNull()).distinct()
    ranged = settle(values.repartitionByRange(value).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").count().orderBy("__p").collect()
    offsets, total = [], 0
    for p, n in sizes:
        offsets.append((p, total))
        total += n
    starts = values.sparkSession.createDataFrame(offsets or [(0, 0)], "__p int, __o long")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(value))
    codes = ranged.join(F.broadcast(starts), "__p").select(value, (F.col("__o") + own - 1).alias("v"))
    return settle(codes), max(1, max(total - 1, 0).bit_length())


def window_rank(
    anchors: DataFrame,
    flow: DataFrame,
    window: str,
    where: Column | str,
    value: str = "amt",
    pair_factor: float = PAIR_FACTOR,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per anchor: rows of the window (``n``), those not above the anchor's value (``n_le``), their share.

    Rows without a value do not count; nothing is at or below an anchor without one.
    """
    from trailmark.operators.joins import pit_join
    from trailmark.schema import WINDOWS

    src = flow.filter(where).filter(F.col(value).isNotNull()).select("acct", "t", value)
    mine = anchors.select("txn_id", "acct", "t", value)

    def paired(mine: DataFrame, src: DataFrame) -> DataFrame:
        pairs = pit_join(mine, src, WINDOWS[window], history=["t", value])
        return pairs.groupBy("txn_id").agg(
            F.count(f"h_{value}").alias("n"), F.count_if(F.col(f"h_{value}") <= F.col(value)).alias("n_le"))

    def digits(mine: DataFrame, src: DataFrame) -> DataFrame:
        codes, bits = positions([mine, src], value)
        nodes = [
            f"struct({i} as l, shiftright(v, {bits - i}) as p, shiftright(v, {bits - 1 - i}) & 1 as bit)" for i in range(bits)
        ]
        nodes.append(f"struct({bits} as l, v as p, 2L as bit)")

        def spread(df: DataFrame, bit: int) -> DataFrame:
            coded = df.join(codes, value).selectExpr("*", f"explode(array({', '.join(nodes)})) as x")
            return coded.filter(f"x.bit in ({bit}, 2)").withColumn("acct", F.struct("acct", "x.l", "x.p"))

        # Rows sit below their first differing digit: 0 where the anchor has 1; or they are equal.
        rows = spread(src, 0).select("acct", "t")
        probes = spread(mine, 1).select(F.struct("txn_id", "x.l").alias("txn_id"), "acct", "t")
        counts = look_back(probes, rows, [Measure("c", "count", [window])], hot_rows=hot_rows)
        below = counts.groupBy(F.col("txn_id.txn_id").alias("txn_id")).agg(F.sum(f"c_{window}").alias("n_le"))
        total = look_back(mine, src, [Measure("rows", "count", [window])], hot_rows=hot_rows)
        out = total.select("txn_id", F.col(f"rows_{window}").alias("n")).join(below, "txn_id", "left")
        return out.withColumn("n_le", F.coalesce("n_le", F.lit(0).cast("long")))

    out = by_account(mine, src, pair_factor, paired, digits)
    return out.withColumn("share", F.expr("n_le / nullif(cast(n as double), 0)"))


def window_quantile(
    anchors: DataFrame,
    flow: DataFrame,
    window: str,
    probs: Sequence[float],
    where: Column | str,
    value: str = "amt",
    pair_factor: float = PAIR_FACTOR,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per anchor the discrete percentiles of the window's values as columns ``q0``, ``q1``, ... (NULL if it has none).

    The percentile is the smallest value that at least the share ``p`` of the values does not exceed.
    """
    from trailmark.operators.joins import pit_join
    from trailmark.schema import WINDOWS

    src = flow.filter(where).filter(F.col(value).isNotNull()).select("acct", "t", value)
    mine = anchors.select("txn_id", "acct", "t")

    def paired(mine: DataFrame, src: DataFrame) -> DataFrame:
        pairs = pit_join(mine, src, WINDOWS[window], history=["t", value])
        exact = [F.expr(f"percentile_disc({float(p)}) within group (order by h_{value})").alias(f"q{i}") for i, p in enumerate(probs)]
        return pairs.groupBy("txn_id").agg(*exact)

    def digits(mine: DataFrame, src: DataFrame) -> DataFrame:
        codes, bits = positions([src], value)
        rounds = (bits + 3) // 4
        coded = src.join(codes, value).select("acct", "t", "v")
        total = look_back(mine, src, [Measure("rows", "count", [window])], hot_rows=hot_rows)
        ranks = ", ".join(f"struct({i} as i, n - floor(n - {float(p)}D * n) as k)" for i, p in enumerate(probs))
        state = settle(
            mine.join(total.selectExpr("txn_id", f"rows_{window} as n"), "txn_id")
            .filter("n > 0")
            .selectExpr("txn_id", "acct", "t", f"explode(array({ranks})) as x")
            .selectExpr("struct(txn_id, x.i as i) as txn_id", "acct", "t", "greatest(x.k, 1) as k", "0L as p")
        )
        for r in range(rounds):
            shift = 4 * (rounds - 1 - r)
            rows = coded.selectExpr(
                f"struct(acct, shiftright(v, {shift + 4}) as p) as acct", "t", f"shiftright(v, {shift}) & 15 as digit")
            probes = state.selectExpr("txn_id", "struct(acct, p) as acct", "t")
            counts = look_back(probes, rows, [Measure(f"c{d}", "count", [window], f"digit = {d}") for d in range(16)], hot_rows=hot_rows)
            sums = [" + ".join(f"c{j}_{window}" for j in range(d + 1)) for d in range(16)]
            cases = " ".join(f"when {s} >= k then {d}" for d, s in enumerate(sums))
            joined = state.join(counts, "txn_id").selectExpr("*", f"case {cases} end as digit", f"array(0L, {', '.join(sums)}) as run")
            state = settle(joined.selectExpr("txn_id", "acct", "t", "k - run[digit] as k", "p * 16 + digit as p"))
        found = state.selectExpr("txn_id.txn_id as txn_id", "txn_id.i as i", "p as v").join(codes, "v")
        picked = found.groupBy("txn_id").agg(*[F.max(F.when(F.col("i") == i, F.col(value))).alias(f"q{i}") for i in range(len(probs))])
        return mine.select("txn_id").join(picked, "txn_id", "left")

    return by_account(mine, src, pair_factor, paired, digits)


def interval_quantile(anchors: DataFrame, items: DataFrame, prob: float, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Discrete percentile of the items that are valid at each anchor: ``enter < t <= leave``.

    ``items`` have acct, enter, leave and a non-negative integer ``v``. Every item is one entry and one exit
    on the time line; the percentile is chosen digit by digit from the running counts per value prefix.
    """
    steps = items.selectExpr(
        "acct", "v", "explode(array(struct(enter as e, 1L as d), struct(leave as e, -1L as d))) as x"
    ).selectExpr("acct", "v", "x.e as e", "x.d as d")
    bits = max(1, int(items.agg(F.max("v")).first()[0] or 0).bit_length())
    rounds = (bits + 3) // 4
    mine = anchors.selectExpr("txn_id", "acct", "t as e")
    valid = sum_before(mine, steps.selectExpr("acct", "e", "d as n"), "e", ["n"], hot_accounts(steps, "e", hot_rows))
    state = settle(valid.filter("n > 0").selectExpr(
        "txn_id", "acct", "e", f"greatest(n - cast(floor(n - {float(prob)}D * n) as bigint), 1L) as k", "0L as p"))
    names = [f"c{i}" for i in range(16)]
    by_acct = hot_accounts(steps, "e", hot_rows)  # no prefix has more rows than its account
    sums = [" + ".join(names[: i + 1]) for i in range(16)]
    cases = " ".join(f"when {x} >= k then {i}" for i, x in enumerate(sums))
    for r in range(rounds):
        shift = 4 * (rounds - 1 - r)
        deltas = steps.selectExpr(
            f"struct(acct, shiftright(v, {shift + 4}) as p) as acct", "e",
            *[f"case when shiftright(v, {shift}) & 15 = {i} then d else 0L end as c{i}" for i in range(16)])
        probes = state.selectExpr("txn_id", "struct(acct, p) as acct", "e")
        hot = by_acct if by_acct.isEmpty() else hot_accounts(deltas, "e", hot_rows)
        counts = sum_before(probes, deltas, "e", names, hot).select("txn_id", *names)
        chosen = state.join(counts, "txn_id").selectExpr("*", f"case {cases} end as digit", f"array(0L, {', '.join(sums)}) as run")
        state = settle(chosen.selectExpr("txn_id", "acct", "e", "k - run[digit] as k", "p * 16 + digit as p"))
    return anchors.select("txn_id").join(state.selectExpr("txn_id", "p as q"), "txn_id", "left")


def smallest_sums(probes: DataFrame, items: DataFrame, ids: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number and sum of the items among the ``k`` smallest *distinct* values valid at each probe: (ids..., n, total).

    ``probes`` have acct, e, k and further ``ids``; ``items`` have acct, enter, leave and an integer ``v``, and are valid where
    ``enter < e <= leave``. Fewer than ``k`` distinct values: all of them. Values are replaced by their positions and the k-th one
    is found digit by digit; at each digit the items of smaller digits are added, so nothing is listed.
    """
    codes, bits = positions([items.select(F.col("v").alias("value"))], "value")
    codes = codes.withColumnRenamed("v", "code")
    rounds = (bits + 3) // 4
    moves = items.selectExpr("acct", "v", "explode(array(struct(enter as e, 1L as d), struct(leave as e, -1L as d))) as x").select("acct", "v", "x.*")
    moves = moves.groupBy("acct", "v", "e").agg(F.sum("d").alias("d")).filter("d <> 0")
    hot = hot_accounts(moves, "e", hot_rows)
    counted = running_sum(moves, ["acct", "v"], ["e"], {"c": F.col("d")}, hot)
    steps = counted.selectExpr("acct", "v as value", "e", "d", "case when c >= 1 then 1L else 0L end - case when c - d >= 1 then 1L else 0L end as seen")
    steps = settle(steps.join(codes, "value"))
    key = F.struct(*[F.col(c) for c in ids])
    state = settle(probes.filter("k > 0").select(key.alias("txn_id"), "acct", "e", F.col("k").cast("long").alias("k"), F.lit(0).cast("long").alias("p"),
                                                 F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("total")))
    names = [f"{x}{i}" for i in range(16) for x in ("s", "n", "t")]
    by_acct = hot_accounts(steps, "e", hot_rows)  # no prefix has more rows than its account
    upto = {x: [" + ".join(f"{x}{j}" for j in range(i + 1)) for i in range(16)] for x in "snt"}
    cases = " ".join(f"when {upto['s'][i]} >= k then {i}" for i in range(16))
    for r in range(rounds):
        shift = 4 * (rounds - 1 - r)
        digit = f"shiftright(code, {shift}) & 15"
        deltas = steps.selectExpr(
            f"struct(acct, shiftright(code, {shift + 4}) as p) as acct", "e",
            *[f"case when {digit} = {i} then {x} else {z} end as {n}{i}" for i in range(16)
              for n, x, z in (("s", "seen", "0L"), ("n", "d", "0L"), ("t", "cast(d as decimal(38,0)) * value", "cast(0 as decimal(38,0))"))])
        deltas = deltas.groupBy("acct", "e").agg(*[F.sum(n).cast("decimal(38,0)" if n[0] == "t" else "long").alias(n) for n in names])
        asked = state.selectExpr("txn_id", "struct(acct, p) as acct", "e")
        hot = by_acct if by_acct.isEmpty() else hot_accounts(deltas, "e", hot_rows)
        found = sum_before(asked, deltas, "e", names, hot).select("txn_id", *names)
        found = found.selectExpr("txn_id", *[f"coalesce({n}, 0) as {n}" for n in names])
        # digit 16: fewer distinct values than asked for, all of them count and the search ends
        picked = state.join(found, "txn_id").selectExpr("*", f"case {cases} else 16 end as digit", *[f"array(0, {', '.join(upto[x])}) as run_{x}" for x in "snt"])
        last = r == rounds - 1
        add = "least(digit + 1, 16)" if last else "digit"
        state = picked.selectExpr("txn_id", "acct", "e", "k - run_s[digit] as k", "p * 16 + digit as p", f"n + run_n[{add}] as n",
                                  f"cast(total + run_t[{add}] as decimal(38,0)) as total", "digit")
        state = settle(state.selectExpr("txn_id", "acct", "e", "k", "case when digit = 16 then -1L else p end as p", "n", "total"))
    out = state.select("txn_id.*", "n", "total")
    none = probes.filter("k <= 0").select(*ids, F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("total"))
    return out.unionByName(none)
