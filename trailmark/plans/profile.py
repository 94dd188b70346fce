"""Sums over the distinct keys of a trailing window: distinct counts, repeats, concentration, entropy.

Each history row enters the windows that start just after it and leaves them ``W`` later. Running
through those two changes per (account, key) gives the key's count ``c`` inside the window at every
moment, and ``f(after) - f(before)`` is what the change adds to ``sum over keys of f(c)``. Summing
these steps up to an anchor yields the total over its window. So a distinct count (``c >= 1``), the
rows of repeated keys (``c if c >= 2``), a Herfindahl index (``c * c``) or an entropy all cost a few
passes over ``2 * rows`` change points: no (anchor, row) pairs, no collected sets, and every
hot account is cut into time stretches, so neither it nor a hot key lands in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.plans.blocked import HOT_ROWS, hot_accounts, neighbours, running_sum, sum_before
from trailmark.plans.lineage import settle
from trailmark.schema import DAY, SECOND, WINDOWS

Profile = Mapping[str, Callable[[Column], Column]]


def distinct(c: Column) -> Column:
    return (c >= 1).cast("long")


def at_least(n: int) -> Callable[[Column], Column]:
    """Rows that belong to a key seen at least ``n`` times."""
    return lambda c: F.when(c >= n, c).otherwise(F.lit(0)).cast("long")


def squares(c: Column) -> Column:
    return (c * c).cast("long")


def rows(c: Column) -> Column:
    return c.cast("long")


def xlogx(c: Column) -> Column:
    return F.when(c > 0, c * F.log(c.cast("double"))).otherwise(F.lit(0.0))


def when(pred: Column, f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Restrict a profile function to keys that satisfy ``pred`` (over the key columns)."""
    return lambda c: F.when(pred, f(c)).otherwise(F.lit(0))


def key_profile(
    anchors: DataFrame,
    flow: DataFrame,
    keys: Sequence[str],
    window: str,
    profiles: Profile,
    *,
    where: Column | None = None,
    peak: str | None = None,
    nulls: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per anchor: ``txn_id`` and each profile over the strict trailing ``window``.

    ``peak`` names an extra output: the largest count of any single key in the window. Rows with a NULL
    key are left out, as in a distinct count, unless ``nulls`` makes NULL a key of its own.
    """
    w = WINDOWS[window] * SECOND
    src = _keyed(flow if where is None else flow.filter(where), keys, nulls)
    changes = src.select("acct", *keys, F.col("t").alias("enter"), (F.col("t") + w).alias("leave"))
    probes = anchors.select("txn_id", "acct", F.col("t").alias("e"))
    last = anchors.agg(F.max("t")).first()[0]
    return _profile(probes, changes, ["txn_id"], keys, profiles, peak, hot_accounts(flow, "t", hot_rows), last)


def key_profile_band(
    anchors: DataFrame,
    flow: DataFrame,
    keys: Sequence[str],
    after: str,
    until: str,
    profiles: Profile,
    *,
    where: Column | None = None,
    nulls: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The same over the older part of a window: ages above ``after`` up to ``until``."""
    lo, hi = WINDOWS[after] * SECOND, WINDOWS[until] * SECOND
    src = _keyed(flow if where is None else flow.filter(where), keys, nulls)
    changes = src.select("acct", *keys, (F.col("t") + lo).alias("enter"), (F.col("t") + hi).alias("leave"))
    probes = anchors.select("txn_id", "acct", F.col("t").alias("e"))
    return _profile(probes, changes, ["txn_id"], keys, profiles, None, hot_accounts(flow, "t", hot_rows))


def key_profile_days(
    anchors: DataFrame,
    flow: DataFrame,
    keys: Sequence[str],
    band: tuple[int, int],
    profiles: Profile,
    *,
    where: Column | None = None,
    per_day: bool = True,
    ids: Sequence[str] = ("txn_id",),
    day: str = "dt",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The same over a date-offset band. ``per_day`` first reduces the flow to (account, key, day)."""
    lo, hi = band
    src = _keyed(flow if where is None else flow.filter(where), keys, False).select("acct", *keys, "dt")
    src = src.distinct() if per_day else src
    number = F.unix_date("dt").cast("long")
    changes = src.select("acct", *keys, (number + lo - 1).alias("enter"), (number + hi).alias("leave"))
    probes = anchors.select(*ids, *([] if "acct" in ids else ["acct"]), F.unix_date(day).cast("long").alias("e"))
    hot = hot_accounts(flow.select("acct", number.alias("day_no")), "day_no", hot_rows)
    return _profile(probes, changes, ids, keys, profiles, None, hot)


@dataclass(frozen=True)
class KeyMeasure:
    """Profiles over the distinct keys of one window: a label of ``WINDOWS`` or a band of days (lo, hi) before the anchor's day."""

    profiles: Profile
    keys: tuple[str, ...]
    window: str | tuple[int, int]
    where: Column | None = None
    nulls: bool = False

    def bounds(self) -> tuple[Column, Column]:
        """The moments after which a row is in the window, and out of it again."""
        if isinstance(self.window, str):
            return F.col("t"), F.col("t") + WINDOWS[self.window] * SECOND
        lo, hi = self.window
        day = F.unix_date("dt").cast("long")
        return (day + lo) * DAY - 1, (day + hi + 1) * DAY - 1


def key_profiles(anchors: DataFrame, flow: DataFrame, measures: Sequence[KeyMeasure], hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per anchor: ``txn_id`` and the profiles of all ``measures``, from one stream of changes.

    Every change carries the number of its measure; changes of one (account, measure, key, moment) are added up before they
    are shuffled. So any number of (keys, window, condition) takes the passes of one: the counts run per (account, measure, key), and
    the steps of all measures at one moment are one row of the account's time line.

    Measures over trailing windows that only ask whether a key is there need no counts: see ``_presence``.
    """
    hot = hot_accounts(flow, "t", hot_rows)
    parts = []
    for make, plain in ((_presence, True), (_counted, False)):
        if some := [m for m in measures if (isinstance(m.window, str) and all(f is distinct for f in m.profiles.values())) == plain]:
            parts.append(make(flow, some, hot))
    names = [n for part in parts for n in part.columns[2:]]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    probes = anchors.select("txn_id", "acct", F.col("t").alias("e"))
    found = sum_before(probes, settle(merged), "e", names, hot)
    return found.select("txn_id", *[n for m in measures for n in m.profiles])


def _key(m: KeyMeasure) -> tuple[Column, Column]:
    """The key of a row as one text, and whether the row counts."""
    texts = [F.col(k).cast("string") for k in m.keys]
    texts = [F.coalesce(x, F.lit("\0")) for x in texts] if m.nulls else texts
    key = F.concat(*[part for x in texts for part in (F.length(x).cast("string"), F.lit(":"), x)])
    return key, key.isNotNull() if m.where is None else key.isNotNull() & m.where


def _presence(flow: DataFrame, measures: Sequence[KeyMeasure], hot: DataFrame) -> DataFrame:
    """(acct, e, a sum of steps for each profile) of distinct counts over trailing windows.

    A row holds its key in the window for the moments after ``t``, up to ``t + W``. A key comes in with a row that no earlier one of the key
    reaches, and goes out after a row that reaches no later one. So one look at the neighbours of a row serves every window over the
    same keys and condition (one ``Column`` object), and rows of a key that stays in the window make no steps.
    """
    groups: dict[tuple, list[KeyMeasure]] = {}
    for m in measures:
        groups.setdefault((m.keys, id(m.where), m.nulls), []).append(m)
    seen = []
    for tag, same in enumerate(groups.values()):
        key, counts = _key(same[0])
        seen.append(F.when(counts, F.struct(F.lit(tag).alias("tag"), key.alias("key"))))
    rows = flow.select("acct", "t", F.explode(F.array_compact(F.array(*seen))).alias("x")).select("acct", "t", "x.*")
    rows = neighbours(rows, ["acct", "tag", "key"], ["t"], hot, lags={"prev": "t"}, leads={"next": "t"})
    steps, names = [], []
    for tag, same in enumerate(groups.values()):
        for m in same:
            w = WINDOWS[m.window] * SECOND
            mine, t, k = F.col("tag") == tag, F.col("t"), len(names)
            names.append(list(m.profiles))
            comes = mine & (F.col("prev").isNull() | (F.col("prev") + w < t))
            goes = mine & (F.col("next").isNull() | (F.col("next") > t + w))
            steps += [F.when(c, F.struct(F.lit(k).alias("k"), e.alias("e"), F.lit(d).cast("long").alias("d"))) for c, e, d in ((comes, t, 1), (goes, t + w, -1))]
    moved = rows.select("acct", F.explode(F.array_compact(F.array(*steps))).alias("s")).select("acct", "s.*")
    sums = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("d"))), F.lit(0)).alias(n) for k, ns in enumerate(names) for n in ns]
    return moved.groupBy("acct", "e").agg(*sums)


def _counted(flow: DataFrame, measures: Sequence[KeyMeasure], hot: DataFrame) -> DataFrame:
    """(acct, e, a sum of steps for each profile) of profiles that take the counts of keys."""
    changes = []
    for tag, m in enumerate(measures):
        key, counts = _key(m)
        for moment, d in zip(m.bounds(), (1, -1), strict=True):
            changes.append(F.when(counts, F.struct(F.lit(tag).alias("tag"), key.alias("key"), moment.alias("e"), F.lit(d).alias("d"))))
    steps = flow.select("acct", F.explode(F.array_compact(F.array(*changes))).alias("x")).select("acct", "x.*")
    steps = steps.groupBy("acct", "tag", "key", "e").agg(F.sum("d").alias("d")).filter("d <> 0")
    counted = running_sum(steps, ["acct", "tag", "key"], ["e"], {"c": F.col("d")}, hot)
    c, d = F.col("c"), F.col("d")
    deltas = {n: F.when(F.col("tag") == tag, f(c) - f(c - d)) for tag, m in enumerate(measures) for n, f in m.profiles.items()}
    # changes that move no profile of any measure are dropped
    moved = F.lit(False)
    for f in {f for m in measures for f in m.profiles.values()}:
        moved = moved | (f(c) != f(c - d))
    return counted.filter(moved).groupBy("acct", "e").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(n) for n, x in deltas.items()])


def _keyed(flow: DataFrame, keys: Sequence[str], nulls: bool) -> DataFrame:
    if nulls:
        return flow.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys})
    return flow.dropna(subset=list(keys))


def _profile(
    probes: DataFrame,
    changes: DataFrame,
    ids: Sequence[str],
    keys: Sequence[str],
    profiles: Profile,
    peak: str | None,
    hot: DataFrame,
    last: int | None = None,
) -> DataFrame:
    """``last`` is the moment of the last probe: changes from then on are before none."""
    steps = changes.select(
        "acct",
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("enter").alias("e"), F.lit(1).alias("d")),
                F.struct(F.col("leave").alias("e"), F.lit(-1).alias("d")),
            )
        ).alias("x"),
    ).select("acct", *keys, "x.e", "x.d")
    steps = steps if last is None else steps.filter(F.col("e") < last)
    counted = running_sum(steps, ["acct", *keys], ["e", "d"], {"c": F.col("d")}, hot)
    c, d = F.col("c"), F.col("d")
    deltas = counted.select("acct", "e", *[(f(c) - f(c - d)).alias(n) for n, f in profiles.items()])
    names = list(profiles)
    if peak:
        # Level j counts the keys seen at least j times; the largest count is the number of levels in use.
        moves = counted.select("acct", F.greatest(c, c - d).alias("level"), "e", "d")
        used = running_sum(moves, ["acct", "level"], ["e", "d"], {"c": F.col("d")}, hot)
        top = used.select("acct", "e", (distinct(c) - distinct(c - d)).alias(peak)).filter(F.col(peak) != 0)
        zero = [F.lit(0).cast(deltas.schema[n].dataType).alias(n) for n in names]
        deltas = deltas.withColumn(peak, F.lit(0).cast("long")).unionByName(top.select("acct", "e", *zero, peak))
        names.append(peak)
    moved = " or ".join(f"`{n}` <> 0" for n in names)
    # Steps at one moment are merged first (map-side), which also drops what cancels out.
    merged = deltas.groupBy("acct", "e").agg(*[F.sum(n).alias(n) for n in names]).filter(moved)
    found = sum_before(probes, merged, "e", names, hot)
    return found.select(*ids, *names)
