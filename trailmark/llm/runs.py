"""Periodic runs of words, by recompression.

Block compression replaces each run of one symbol by a symbol, pair compression each pair whose first symbol is of one
half of the alphabet and whose second is of the other. Alternated, they make a run-length grammar: equal stretches are parsed alike but
for their ends. How far two places agree is found by climbing the levels while both are at the start of a symbol and
descending where symbols differ; no suffix array is needed.

A run of period p and length >= 4 p holds four neighbouring multiples of p, so a pair (i, i + p) with i a multiple of 3 p lies in it.
All such pairs of a text are n/3 (1 + 1/2 + 1/3 + ...) (the harmonic grid). Those with equal words, and equal words where any run
around them would have some, are extended exactly to both sides. Of equal stretches the smallest period is kept: by Fine and Wilf
it is the stretch's smallest one. Names of the grammar are exact (no hashes).

Texts are independent: one task holds a block of about ``BLOCK`` bytes of whole texts, or one longer text. Cost is n log n words.

Defined cases: null, empty and blank texts have no words and no runs; rows that repeat get a result each; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import mix, row_blocks, string_bytes

#: A run has at least so many periods, and so many words.
PERIODS, LEAST = 4, 6
BLOCK = 1 << 20
#: Symbols that a text is left with at the top of the grammar, at most.
TOP = 8
#: Pairs of the grid that are looked at together.
PAIRS = 1 << 20


@dataclass
class Level:
    """Symbols of a level, the symbol of the next level that each belongs to, and the first one of each of those."""

    symbols: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    blocks: bool


def grammar(symbols: np.ndarray, texts: int) -> list[Level]:
    """Levels of a row of texts that each end with a symbol of its own (the largest ``texts`` symbols)."""
    levels: list[Level] = []
    ends = symbols >= int(symbols.max()) + 1 - texts
    names = int(symbols.max()) + 1
    blocks = True
    while True:
        edges = np.flatnonzero(ends)
        if np.diff(edges, prepend=-1).max() <= TOP:
            break
        n = len(symbols)
        if blocks:
            new = np.ones(n, bool)
            new[1:] = symbols[1:] != symbols[:-1]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, n))
            out = symbols[first].copy()
            many = size > 1
            rules = out[many] * np.int64(n + 1) + size[many]
        else:
            side = (mix(symbols.astype(np.uint64) * np.uint64(64) + np.uint64(len(levels))) >> np.uint64(63)).astype(bool)
            up, down = ~side[:-1] & side[1:], side[:-1] & ~side[1:]
            paired = up if up.sum() >= down.sum() else down
            new = np.ones(n, bool)
            new[1:] = ~paired
            first = np.flatnonzero(new)
            out = symbols[first].copy()
            many = np.diff(np.append(first, n)) > 1
            rules = out[many] * np.int64(names) + symbols[first[many] + 1]
        if len(rules):
            known, which = np.unique(rules, return_inverse=True)
            out[many] = names + which
            names += len(known)
        levels.append(Level(symbols, (np.cumsum(new) - 1).astype(np.int32), np.append(first, n).astype(np.int32), blocks))
        ends = np.logical_or.reduceat(ends, first)
        symbols, blocks = out, not blocks
    levels.append(Level(symbols, np.zeros(0, np.int32), np.zeros(0, np.int32), True))
    return levels


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of symbols that agree from places a and b on (a differs from b)."""
    x, y = a.astype(np.int64), b.astype(np.int64)
    stop = np.full(len(x), -1, np.int64)  # the level where symbols differ
    live = np.arange(len(x))
    for h, level in enumerate(levels[:-1]):
        s, parent, first = level.symbols, level.parent, level.first
        i, j = x[live], y[live]
        ready = (first[parent[i]] == i) & (first[parent[j]] == j)
        differ = ~ready & (s[i] != s[j])
        move = ~ready & ~differ
        step = np.minimum(first[parent[i] + 1] - i, first[parent[j] + 1] - j) if level.blocks else np.ones(len(i), np.int64)
        i, j = np.where(move, i + step, i), np.where(move, j + step, j)
        differ |= move & (s[i] != s[j])
        stop[live[differ]] = h
        x[live], y[live] = np.where(differ, i, parent[i]), np.where(differ, j, parent[j])
        live = live[~differ]
    top = levels[-1].symbols
    rest = live
    while len(rest):
        rest = rest[top[x[rest]] == top[y[rest]]]
        x[rest] += 1
        y[rest] += 1
    stop[live] = len(levels) - 1
    for h in range(len(levels) - 2, -1, -1):
        level = levels[h]
        down = np.flatnonzero(stop > h)
        i, j = level.first[x[down]].astype(np.int64), level.first[y[down]].astype(np.int64)
        same = level.symbols[i] == level.symbols[j]
        step = np.minimum(level.first[x[down] + 1] - i, level.first[y[down] + 1] - j) if level.blocks else 1
        x[down], y[down] = np.where(same, i + step, i), np.where(same, j + step, j)
    return x - a


_GRID: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
_SHORT = 2048


def _pairs(n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid pairs (i, p) of the periods low to high - 1."""
    period = np.arange(low, high)
    count = -(-(n - period) // ((PERIODS - 1) * period))
    p = np.repeat(period, count)
    turn = np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
    return turn * p * (PERIODS - 1), p


def grid(n: int):
    """The pairs (i, p) of a text of n words, in parts of bounded size."""
    if n <= _SHORT:
        if not _GRID:
            i, p = _pairs(_SHORT, 1, _SHORT // PERIODS + 1)
            need = np.maximum(i + p + 1, PERIODS * p)
            order = np.argsort(need, kind="stable")
            _GRID[0] = i[order], p[order], need[order]
        i, p, need = _GRID[0]
        k = int(np.searchsorted(need, n, "right"))
        yield i[:k], p[:k]
        return
    low, last = 1, n // PERIODS
    while low <= last:
        high = min(last + 1, low + max(1, PAIRS * (PERIODS - 1) * low // n))
        yield _pairs(n, low, high)
        low = high


def candidates(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grid pairs that may lie in a run: it would go on by one and a half periods to one of the sides."""
    n = len(ids)
    out = []
    if n >= LEAST:
        for i, p in grid(n):
            equal = ids[i] == ids[i + p]
            i, p = i[equal], p[equal]

            def agree(at, p=p):
                inside = (at >= 0) & (at + p < n)
                at = np.where(inside, at, 0)
                return inside & (ids[at] == ids[np.minimum(at + p, n - 1)])

            keep = (agree(i + p // 2) & agree(i + p)) | (agree(i - p // 2) & agree(i - p))
            out.append((i[keep], p[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text (symbols >= 0), by start and then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found = [candidates(ids) for ids in texts]
    some = [k for k, (i, _) in enumerate(found) if len(i)]
    if not some:
        return out
    size = np.array([len(texts[k]) + 1 for k in some])
    base = np.cumsum(size) - size
    row = np.concatenate([np.append(texts[k], -1) for k in some]).astype(np.int64)
    row[base + size - 1] = row.max() + 1 + np.arange(len(some))
    back = np.concatenate([np.append(texts[k][::-1], -1) for k in some]).astype(np.int64)
    back[base + size - 1] = row[base + size - 1]
    ahead, behind = grammar(row, len(some)), grammar(back, len(some))
    which = np.repeat(np.arange(len(some)), [len(found[k][0]) for k in some])
    i, p = (np.concatenate([found[k][x] for k in some]) for x in (0, 1))
    lines = []
    for x in range(0, len(i), PAIRS):
        w, at, period = which[x : x + PAIRS], i[x : x + PAIRS], p[x : x + PAIRS]
        more = extensions(ahead, base[w] + at, base[w] + at + period)
        mirrored = base[w] + size[w] - 1 - at  # the word before place ``at``, read backwards
        less = extensions(behind, mirrored, mirrored - period)
        start, length = at - less, less + period + more
        enough = length >= np.maximum(LEAST, PERIODS * period)
        lines.append(np.column_stack([w, start, length, period])[enough])
    table = np.concatenate(lines)
    table = table[np.lexsort((table[:, 3], table[:, 2], table[:, 1], table[:, 0]))]
    new = np.ones(len(table), bool)
    new[1:] = (table[1:, :3] != table[:-1, :3]).any(1)
    table = table[new]
    table = table[np.lexsort((table[:, 3], table[:, 1], table[:, 0]))]
    for w, start, length, period in table.tolist():
        out[some[w]].append((start, length, period))
    return out


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which word stands at each place: in a tenth of the documents the tail repeats (fixed by the query's contract)."""
    order = np.arange(n)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        order[a:] = a + np.arange(n - a) % p
    return order


def unchanged(doc_id: int | None, n: int) -> np.ndarray:
    return np.arange(n)


def find(docs: DataFrame, arrange: Callable[[int | None, int], np.ndarray] = unchanged, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, runs, collapsed): the runs of each text by start and then period, and the text without their repetitions.

    ``arrange`` says which word of the text stands at each place, by id and number of words. ``collapsed`` is binary: the kept
    words joined by one space.
    """
    schema = "doc_id long, words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"

    def run(batches):
        import pyarrow as pa

        struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, bounds = string_bytes(batch.column(1))
            for a, b in row_blocks(bounds, BLOCK):
                names: dict[bytes, int] = {}
                texts, orders, symbols = [], [], []
                for k in range(a, b):
                    own = data[bounds[k] : bounds[k + 1]].tobytes().split()
                    order = arrange(ids[k], len(own))
                    number = np.array([names.setdefault(w, len(names)) for w in own], np.int64)
                    texts.append(own)
                    orders.append(order)
                    symbols.append(number[order])
                found = runs_of(symbols)
                kept = []
                for own, order, runs in zip(texts, orders, found, strict=True):
                    if runs:
                        cover = np.zeros(len(own) + 1, np.int64)
                        for start, length, period in runs:
                            cover[start + period] += 1
                            cover[start + length] -= 1
                        order = order[np.cumsum(cover[:-1]) == 0]
                    kept.append(b" ".join([own[k] for k in order.tolist()]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a:b], pa.int64()), pa.array([len(w) for w in texts], pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in found], struct), pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "words", "runs", "collapsed"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; ties go to the smallest start and then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of the frame that ``find`` returns."""
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

    def run(batches):
        import pyarrow as pa

        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            rows = []
            for doc, runs, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                runs = [(r["start"], r["length"], r["period"]) for r in runs]
                best = strongest(runs) or (None, None, None)
                milli = 1000 * best[1] // best[2] if runs else None
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                rows.append((doc, len(runs), *best, milli, hashlib.sha256(lines).hexdigest(), hashlib.sha256(text.as_buffer()).hexdigest()))
            types = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return found.select("doc_id", "runs", "collapsed").mapInArrow(run, schema)
