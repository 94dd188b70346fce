"""Query registration and the SQL twins of the canonical frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.scalars import rounded
from trailmark.operators.sequences import with_neighbours
from trailmark.schema import DAY, WINDOWS, event_anchors, event_flow

# i integer, d double (6 digits), m large amount or spread (2 digits), s text, D date
TYPES = {"i": "bigint", "d": "double", "m": "double", "s": "string", "D": "date"}
DUCK = {"i": "bigint", "d": "double", "m": "double", "s": "varchar", "D": "date"}
DIGITS = {"d": 6, "m": 2}


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def _spec(text: str) -> list[tuple[str, str]]:
    out = []
    for item in text.split():
        name, _, kind = item.partition(":")
        out.append((name, kind or "d"))
    return out


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Project to declared columns and types; doubles are rounded so that sums compare across engines."""
    cols = []
    for name, kind in _spec(spec):
        c = F.col(name).cast(TYPES[kind])
        cols.append((rounded(c, DIGITS[kind]) + F.lit(0.0) if kind in DIGITS else c).alias(name))
    return df.select(*cols)


def shape_sql(sql: str, spec: str) -> str:
    cols = []
    for name, kind in _spec(spec):
        c = f"cast({name} as {DUCK[kind]})"
        cols.append(f"round({c}, {DIGITS[kind]}) + 0.0 as {name}" if kind in DIGITS else f"{c} as {name}")
    return f"select {', '.join(cols)} from ({sql}) as result"


def query(name: str, spec: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its column list and SQL twin."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(
            lambda spark, sf_dir: shape(fn(spark, sf_dir), spec), None if sql is None else shape_sql(sql, spec)
        )
        return fn

    return wrap


FLOW = """flow as (
  select event_id as txn_id, user_id as acct, epoch_us(ts) as t, cast(ts as date) as dt,
         cast(extract(hour from ts) as int) as hh, case when event_id % 3 = 0 then 1 else 0 end as dir,
         value as amt, event_type as chan, nullif(json_extract_string(props, '$.k'), '0') as party,
         case when event_id % 4 = 0 then 1 else 0 end as novel
  from events)"""

ANCHORS = """anchors as (
  select f.*, case when txn_id % 5 = 0 then 'test' else 'train' end as split from flow f where chan = 'purchase')"""

LABELLED = """nxt as (
  select *, lead(chan) over w as nc, lead(t) over w as nt from flow window w as (partition by acct order by t, txn_id)),
labelled as (
  select * exclude (nc, nt), case when txn_id % 5 = 0 then 'test' else 'train' end as split,
         case when nc = 'error' and nt - t <= 86400000000 then 1 else 0 end as label
  from nxt where chan = 'purchase')"""

ORDERS = """flow as (
  select o_orderkey as txn_id, o_custkey as acct, epoch_us(o_orderdate) as t, cast(o_orderdate as date) as dt,
         case when o_orderstatus = 'F' then 1 else 0 end as dir, o_totalprice as amt, o_orderpriority as chan, p.party
  from orders left join (select l_orderkey, cast(min(l_suppkey) as varchar) as party from lineitem group by 1) p
    on l_orderkey = o_orderkey)"""

SNAPS = "snaps as (select distinct acct, cast(dt - 2 as date) as snap_dt from flow)"

BALANCE = """bal as (
  select *, round(1000 + sum(case when dir = 1 then amt else -amt end) over (
    partition by acct order by t, txn_id rows unbounded preceding), 2) as bal from flow)"""


def hist(window: str, anchors: str = "anchors", flow: str = "flow", name: str = "hist") -> str:
    """Anchors with every strictly earlier row of the window: the plain band join."""
    w = WINDOWS[window] * 1_000_000
    return f"""{name} as (
  select a.txn_id, a.acct, a.t as t0, a.amt as amt0, a.hh as hh0, a.party as party0, a.chan as chan0,
         f.txn_id as h_id, f.t, f.dt, f.hh, f.dir, f.amt, f.chan, f.party, f.novel, (a.t - f.t) / 1e6 as age
  from {anchors} a left join {flow} f on a.acct = f.acct and a.t - f.t > 0 and a.t - f.t <= {w})"""


def days_hist(lo: int, hi: int, name: str = "hist") -> str:
    return f"""{name} as (
  select s.acct, s.snap_dt, f.txn_id, f.t, f.dt, f.dir, f.amt, f.chan, f.party
  from snaps s left join flow f on s.acct = f.acct and date_diff('day', f.dt, s.snap_dt) between {lo} and {hi})"""


def sql(*ctes: str) -> str:
    *parts, body = ctes
    return "with " + ",\n".join(parts) + "\n" + body


def outflow() -> Column:
    return F.col("dir") == 0


def inflow() -> Column:
    return F.col("dir") == 1


def amount() -> Column:
    return F.col("amt")


def events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    flow = event_flow(spark, d)
    return flow, event_anchors(flow)


def labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Anchors with a label: the account's next event is an error within a day."""
    flow = event_flow(spark, d)
    nxt = with_neighbours(flow, leads={"next_chan": "chan", "next_t": "t"})
    hit = (F.col("next_chan") == "error") & (F.col("next_t") - F.col("t") <= DAY)
    marked = nxt.withColumn("label", F.when(hit, 1).otherwise(0)).drop("next_chan", "next_t")
    return flow, event_anchors(marked)
