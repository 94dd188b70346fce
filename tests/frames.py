"""Small frames and brute-force references for the tests."""

from __future__ import annotations

import datetime as dt
import random

SECOND = 1_000_000
DAY = 86_400 * SECOND
BASE = 19_700 * DAY  # midnight of some day

FLOW_SCHEMA = "txn_id long, acct long, t long, dt date, hh int, dir int, amt double, chan string, party string, novel int"


def row(txn_id, acct, t, dir=0, amt=1.0, chan="a", party="p", novel=0):
    moment = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=t)
    return (txn_id, acct, t, moment.date(), moment.hour, dir, amt, chan, party, novel)


def flow_of(spark, rows):
    return spark.createDataFrame([row(*r) if not isinstance(r, dict) else row(**r) for r in rows], FLOW_SCHEMA)


def random_rows(n, seed=7, days=20, ties=True):
    """A skewed log: account 1 owns about half of the rows; some equal times; some missing parties."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        acct = 1 if rng.random() < 0.5 else rng.randint(2, 6)
        t = BASE + rng.randint(0, days * 24) * 3_600 * SECOND if ties else BASE + rng.randint(0, days * DAY)
        party = None if rng.random() < 0.1 else rng.choice("xyzuvw")
        out.append(dict(txn_id=i, acct=acct, t=t, dir=rng.randint(0, 1), amt=round(rng.uniform(1, 300), 2),
                        chan=rng.choice("abc"), party=party, novel=rng.randint(0, 1)))
    return out


def before(rows, anchor, seconds, inclusive=False):
    """History of an anchor by definition."""
    out = []
    for r in rows:
        age = anchor["t"] - r["t"]
        if r["acct"] == anchor["acct"] and age <= seconds * SECOND and (age > 0 or (inclusive and age == 0)):
            out.append(r)
    return out
