"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance by one more component: vectors are scaled into the unit ball and lifted
onto its sphere, queries are normalised. Each table hashes the lifted vectors by ``FUNCTIONS`` Gaussian projections cut
into cells. For a query, the chance that a neighbour at the calibrated distance lies in a bucket is a product of normal
probabilities; buckets are visited in the order of that chance until the table's share of success is ``SUCCESS`` and at
least ``FEWEST`` vectors are in them. Candidates of all tables are merged and ranked by exact inner products.

Buckets are split into blocks of about ``ROWS`` vectors that meet blocks of about ``ROWS`` queries, so a hot bucket is
many tasks. Of equal vectors only the ``top`` + 1 smallest ids are indexed: no query can need more. Cells and the
calibrated distance come from at most about ``SAMPLE`` vectors, by id hash (documented bound); every row is indexed.
As neighbours get nearer in larger tables than in the sample, the visited share errs on the side of recall.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows with a null id, take
no part; vectors of different lengths are not compared; of rows with one id the nearest counts; fewer candidates than
``top`` give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import settled

FUNCTIONS, TABLES, SUCCESS, CELL, FEWEST, ROWS, SAMPLE = 3, 2, 0.88, 1.3, 64, 4096, 2000
RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass
class Tables:
    """Projections and cells of all tables; ``counts``: indexed vectors by table and bucket."""

    longest: float
    lines: np.ndarray
    inner: list[np.ndarray]
    reach: float
    counts: dict[tuple[int, int], int]

    def cells(self, lifted: np.ndarray) -> np.ndarray:
        """Bucket number by vector and table."""
        out = np.zeros((len(lifted), TABLES), np.int64)
        for j, edges in enumerate(self.inner):
            t = j // FUNCTIONS
            out[:, t] = out[:, t] * (len(edges) + 1) + np.searchsorted(edges, lifted @ self.lines[:, j], "right")
        return out

    def lift(self, x: np.ndarray) -> np.ndarray:
        scaled = x / self.longest
        rest = np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))
        return np.column_stack([scaled, rest])

    def probes(self, x: np.ndarray) -> list[list[tuple[int, int]]]:
        """The buckets that each query visits, in order."""
        aim = np.column_stack([x / np.linalg.norm(x, axis=1)[:, None], np.zeros(len(x))])
        out: list[list[tuple[int, int]]] = [[] for _ in x]
        for t in range(TABLES):
            chance = np.ones((len(x), 1))
            for j in range(t * FUNCTIONS, (t + 1) * FUNCTIONS):
                away = (self.inner[j][None, :] - (aim @ self.lines[:, j])[:, None]) / self.reach
                below = np.vectorize(lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2))), otypes=[float])(away) if away.size else away
                below = np.column_stack([np.zeros(len(x)), below, np.ones(len(x))])
                chance = (chance[:, :, None] * np.diff(below, axis=1)[:, None, :]).reshape(len(x), -1)
            held = np.array([self.counts.get((t, b), 0) for b in range(chance.shape[1])])
            order = np.argsort(-chance, axis=1, kind="stable")
            sure = np.cumsum(np.take_along_axis(chance, order, 1), 1)
            many = np.cumsum(held[order], 1)
            enough = ((sure >= SUCCESS) & (many >= FEWEST)).argmax(1)
            enough[(sure[:, -1] < SUCCESS) | (many[:, -1] < FEWEST)] = chance.shape[1] - 1
            for i, last in enumerate(enough):
                out[i] += [(t, int(b)) for b in order[i, : last + 1] if held[b]]
        return out


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part."""
    out = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return out.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & some, F.lit(False))).withColumn("dim", F.size("v"))


def calibrate(base: DataFrame, n: int, longest: float, dim: int, top: int, seed: int) -> Tables:
    span = 1 << 40
    order = F.pmod(F.xxhash64(F.lit(seed), F.col("vec_id")), F.lit(span))
    share = min(1.0, SAMPLE / n)
    got = base.filter(order < int(span * share)).orderBy(order, "v").limit(2 * SAMPLE).select("v").collect()
    got = got or base.orderBy(order, "v").limit(1).select("v").collect()
    x = np.array([r.v for r in got])
    rng = np.random.default_rng(seed)
    lines = rng.normal(size=(dim + 1, FUNCTIONS * TABLES))
    tables = Tables(longest, lines, [], 1.0, {})
    lifted = tables.lift(x)
    shadow = lifted @ lines
    for j in range(shadow.shape[1]):
        width = CELL * max(float(shadow[:, j].std()), 1e-9)
        low, high = np.quantile(shadow[:, j], [0.02, 0.98])
        shift = rng.uniform(0, width)
        edges = np.arange(math.floor(low / width), math.ceil(high / width) + 1) * width + shift
        tables.inner.append(edges[(edges > low) & (edges < high)])
    aim = np.column_stack([x / np.linalg.norm(x, axis=1)[:, None], np.zeros(len(x))])[:500]
    apart = np.sqrt(np.maximum(0, 1 + (lifted**2).sum(1)[None, :] - 2 * aim @ lifted.T))
    apart[np.arange(len(aim)), np.arange(len(aim))] = np.inf
    near = np.sort(apart, 1)[:, min(top, len(x)) - 1]
    near = near[np.isfinite(near)]
    tables.reach = max(float(np.median(near)) if len(near) else 1.0, 1e-6)
    return tables


def search_length(base: DataFrame, dim: int, is_query: Column, top: int, seed: int) -> DataFrame | None:
    spark = base.sparkSession
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = base.withColumn("__r", F.row_number().over(same)).filter(F.col("__r") <= top + 1).select("vec_id", "v")
    n, longest = base.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    queries = base.filter(is_query).select("vec_id", "v")
    n_queries = queries.count()
    if not n_queries:
        return None
    tables = calibrate(base, n, longest, dim, top, seed)

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            cells = tables.cells(tables.lift(matrix(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(cells), pa.list_(pa.int64()))], ["vec_id", "v", "cells"])

    placed = settled(kept.mapInArrow(place, "vec_id long, v array<double>, cells array<long>"))
    placed = placed.select("vec_id", "v", F.posexplode("cells").alias("t", "bucket"))
    tables.counts = {(r.t, r.bucket): r["count"] for r in placed.groupBy("t", "bucket").count().collect()}  # cells, not rows

    def visit(batches):
        import pyarrow as pa

        for batch in batches:
            visits = tables.probes(matrix(batch.column(1))) if batch.num_rows else []
            at = np.repeat(np.arange(batch.num_rows), [len(v) for v in visits])
            flat = np.array([p for v in visits for p in v], np.int64).reshape(-1, 2)
            picked = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1])], ["query_id", "v", "t", "bucket"])

    visits = queries.mapInArrow(visit, "query_id long, v array<double>, t int, bucket long")
    sizes = spark.createDataFrame([(t, b, -(-c // ROWS)) for (t, b), c in tables.counts.items()], "t int, bucket long, parts int")
    query_parts = -(-n_queries // ROWS)
    key = ["t", "bucket", "part", "query_part"]
    index = placed.join(F.broadcast(sizes), ["t", "bucket"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    index = index.withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))).select(*key, "vec_id", "v")
    asked = visits.join(F.broadcast(sizes), ["t", "bucket"]).withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).select(*key, "query_id", "v")

    def meet(_, vectors, wanted):
        import pyarrow as pa

        ids, x = vectors["vec_id"].to_numpy(), matrix(vectors["v"].combine_chunks()) if vectors.num_rows else np.zeros((0, dim))
        query_ids, q = wanted["query_id"].to_numpy(), matrix(wanted["v"].combine_chunks()) if wanted.num_rows else np.zeros((0, dim))
        near_ids, near_scores, owners = [], [], []
        for a in range(0, len(q), 512) if len(x) else ():
            rough = q[a : a + 512] @ x.T
            rough[query_ids[a : a + 512, None] == ids[None, :]] = -np.inf
            keep = min(top + 12, len(x))  # a few more, as the rough sums differ in their last digits
            near = np.argpartition(-rough, keep - 1, axis=1)[:, :keep]
            exact = (q[a : a + 512, None, :] * x[near]).sum(2)
            exact[~np.isfinite(np.take_along_axis(rough, near, 1))] = -np.inf
            order = np.lexsort((ids[near], -exact), axis=1)[:, :top]
            near, exact = np.take_along_axis(near, order, 1), np.take_along_axis(exact, order, 1)
            real = np.isfinite(exact)
            near_ids.append(ids[near][real])
            near_scores.append(exact[real])
            owners.append(np.repeat(query_ids[a : a + 512], real.sum(1)))
        flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
        return pa.table({"query_id": flat(owners, pa.int64()), "vec_id": flat(near_ids, pa.int64()), "score": flat(near_scores, pa.float64())})

    found = asked.groupBy(*key).cogroup(index.groupBy(*key)).applyInArrow(
        lambda k, wanted, vectors: meet(k, vectors, wanted), "query_id long, vec_id long, score double"
    )
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search(rows: DataFrame, is_query: Column | None = None, vec_id: str = "vec_id", vector: str = "embedding", top: int = 20, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest vectors of each query row; ``is_query`` is a condition on ``vec_id``."""
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    base = settled(usable(rows, vec_id, vector))
    lengths = [r.dim for r in base.select("dim").distinct().orderBy("dim").collect()]
    parts = [search_length(base.filter(F.col("dim") == dim), dim, is_query, top, seed) for dim in lengths]
    out = None
    for part in parts:
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return rows.sparkSession.createDataFrame([], RESULT) if out is None else out
