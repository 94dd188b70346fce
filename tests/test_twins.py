"""Queries against their SQL twins on small tables with odd values."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry


def twin(spark, folder, name, events):
    """Rows of a query and of its SQL twin over ``events``: (seconds, user, type, value) numbered from 0."""
    start = dt.datetime(2024, 1, 1)
    frame = pd.DataFrame([(i, start + dt.timedelta(seconds=s), u, kind, float(v), '{"k": 7}') for i, (s, u, kind, v) in enumerate(events)],
                         columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    con = duckdb.connect()
    con.register("frame", frame)
    con.execute(f"copy (select * replace (cast(ts as timestamp) as ts) from frame) to '{folder}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    df = entry.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rel = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    return got, sorted(repr(tuple(dict(zip(names, r))[c] for c in cols)) for r in rel.fetchall())


@pytest.mark.parametrize("values", [(0, 5, 0), (0.8, 5, 0.20475), (4, 1, 1.02375)])
def test_linkage_to_inflows_of_zero_and_at_halves(spark, tmp_path, values):
    # ids divisible by 3 are inflows; 0.20475 / 0.8 and 1.02375 / 4 are halves of the sixth digit
    got, expect = twin(spark, tmp_path, "inflow_linkage", [(i * 60, 1, "view", v) for i, v in enumerate(values)])
    assert len(got) == 2 and got == expect


def test_statement_deviations(spark, tmp_path):
    # a week of three accounts, some amounts 0
    events = [(i * 3_000, 1 + i % 3, "purchase" if i % 7 == 0 else "view", (i * 37 % 101) / 4) for i in range(200)]
    got, expect = twin(spark, tmp_path, "statement_counters", events)
    assert len(got) == 29 and got == expect
