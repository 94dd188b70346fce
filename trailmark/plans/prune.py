"""Reading only the history that any anchor can see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Account ids that are broadcast at most (some 50 MB).
ACCOUNTS = 1_000_000


def relevant_history(flow: DataFrame, anchors: DataFrame, days: int) -> DataFrame:
    """Flow rows of the last ``days`` days before any anchor, of anchor accounts.

    One small fact about the anchors is fetched first: their day range, which becomes a literal filter on ``dt``
    (pushed to the scan, partition pruning if stored by day). The accounts are a semi join: a broadcast one up to
    ``ACCOUNTS`` of them, else one that shuffles. Either way the same rows come out.
    """
    first, last = anchors.agg(F.min("dt"), F.max("dt")).first()
    if first is None:
        return flow.limit(0)
    near = flow.filter(F.col("dt").between(F.date_sub(F.lit(first), days), F.lit(last)))
    accounts = anchors.select("acct").distinct()
    short = accounts.limit(ACCOUNTS + 1).count() <= ACCOUNTS
    return near.join(F.broadcast(accounts) if short else accounts, "acct", "left_semi")
