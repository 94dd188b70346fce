"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text are cut into quantile bins. Cyclic boosting goes round the features many times; each visit
fits a depth-two tree on one feature's bins to the current gradients and adds it, shrunk, to that feature's lookup
table. The pairs with the most left to gain then get two-way tables in the same way. A score is a sum of
table entries, computed for whole Arrow batches.

Learning takes at most ``SAMPLE`` labelled rows, those with the smallest id hashes (documented bound). Defined cases:
null and empty texts have all-zero features and get a score; a null label is no label; with no labelled rows or one
class only, every score is the (smoothed) share of label 1; repeated rows and null ids come back as they are; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import fold, lower_ascii, mix, row_blocks, string_bytes, word_hashes, words

SAMPLE, BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 12_000, 32, 150, 0.1, 6, 8, 60
BLOCK = 1 << 20
FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "digits", "upper", "punctuation", "marks", "non_ascii", "spaces",
    "lines", "distinct_words", "distinct_pairs", "repeated_lines", "ended_words", "sentence_words", "pure_marks",
)


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text of a block."""
    n = len(bounds) - 1
    if not len(data):
        return np.zeros((n, len(FEATURES)))
    size = np.diff(bounds).astype(float)
    some = np.maximum(size, 1)

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)

    low = lower_ascii(data)
    letter = ((low >= 97) & (low <= 122)) | (data >= 128)
    punctuation = np.isin(data, np.frombuffer(b".,;:!?'\"()-", np.uint8))
    digit = (data >= 48) & (data <= 57)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    mark = ~(letter | punctuation | digit | space)
    start, end, row = words(data, bounds)
    count = np.bincount(row, minlength=n).astype(float)
    any_word = np.maximum(count, 1)
    hashes = word_hashes(low, start, end)

    def distinct(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(n)
        order = np.lexsort((values, rows))
        r, v = rows[order], values[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
        return np.bincount(r[new], minlength=n).astype(float)

    joint = row[1:] == row[:-1]
    pairs = mix(hashes[:-1] * np.uint64(3) + hashes[1:])[joint]
    pair_rows = row[1:][joint]
    cut = data == 10
    line_start = np.flatnonzero(np.concatenate([[True], cut[:-1]]) | np.isin(np.arange(len(data)), bounds[1:-1]))
    line_end = np.append(line_start[1:], len(data))
    line_row = np.searchsorted(bounds, line_start, "right") - 1
    line_hash = word_hashes(data, line_start, line_end - cut[line_end - 1])
    lines = np.bincount(line_row, minlength=n).astype(float)
    tail = data[np.maximum(end - 1, 0)]
    ended = np.bincount(row[np.isin(tail, np.frombuffer(b".!?", np.uint8))], minlength=n).astype(float)
    letters_before = np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])
    bare = np.bincount(row[letters_before[end] == letters_before[start]], minlength=n).astype(float)
    out = np.column_stack([
        np.log1p(size), np.log1p(count), per_row(~space) / any_word, per_row(letter) / some, per_row(digit) / some,
        per_row((data >= 65) & (data <= 90)) / some, per_row(punctuation) / some, per_row(mark) / some, per_row(data >= 128) / some,
        per_row(space) / some, lines / any_word, distinct(row, hashes) / any_word,
        distinct(pair_rows, pairs) / np.maximum(count - 1, 1), 1 - distinct(line_row, line_hash) / np.maximum(lines, 1),
        ended / any_word, count / (ended + 1), bare / any_word,
    ])
    out[size == 0] = 0
    return out


def column_features(column) -> np.ndarray:
    data, bounds = string_bytes(column)
    out = np.zeros((len(bounds) - 1, len(FEATURES)))
    for a, b in row_blocks(bounds, BLOCK):
        out[a:b] = features(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
    return out


@dataclass
class Model:
    bias: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += table[np.searchsorted(cuts, x[:, k], "right")]
        for i, j, table in self.pairs:
            a, b = (np.searchsorted(self.pair_cuts[k], x[:, k], "right") for k in (i, j))
            total += table[a, b]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best split of bins into a left and a right part; place 0: none."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain = np.where((left_h >= least) & (right_h >= least), gain, 0)
    if not len(gain) or gain.max() <= 0:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Leaf value for each bin of a tree of depth two."""
    out = np.zeros(len(g))
    edges = [0, len(g)]
    for _ in range(2):
        more = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            _, at = best_cut(g[a:b], h[a:b], least)
            if at:
                more.append(a + at)
        edges = sorted({*edges, *more})
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def quad_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """Gain and table of the best first cut along either axis, each part then cut along the other one."""
    best, table = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        gain, at = best_cut(a.sum(1), b.sum(1), least)
        if not at:
            at = len(a) // 2
        value = np.zeros_like(a)
        for part in (slice(0, at), slice(at, None)):
            more, cut = best_cut(a[part].sum(0), b[part].sum(0), least)
            gain += more
            for side in (slice(0, cut), slice(cut, None)) if cut else (slice(None),):
                value[part, side] = a[part, side].sum() / (b[part, side].sum() + 1)
        if gain > best:
            best, table = gain, value.T if turned else value
    return best, table


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    least = 5.0 * share * (1 - share)
    binned = lambda k, cuts: np.searchsorted(cuts, x[:, k], "right")
    points = lambda k, n: np.unique(np.quantile(x[:, k], np.linspace(0, 1, n + 1)[1:-1]))
    model.cuts = [points(k, BINS) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins = [binned(k, c) for k, c in enumerate(model.cuts)]
    total = np.full(len(y), model.bias)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, b in enumerate(bins):
            g, h = slopes()
            size = len(model.tables[k])
            add = RATE * shallow_tree(np.bincount(b, g, size), np.bincount(b, h, size), least)
            model.tables[k] += add
            total += add[b]
    model.pair_cuts = [points(k, PAIR_BINS) for k in range(x.shape[1])]
    coarse = [binned(k, c) for k, c in enumerate(model.pair_cuts)]
    width = [len(c) + 1 for c in model.pair_cuts]

    def grids(i: int, j: int, g: np.ndarray, h: np.ndarray):
        cell, size = coarse[i] * width[j] + coarse[j], width[i] * width[j]
        return (np.bincount(cell, v, size).reshape(width[i], width[j]) for v in (g, h))

    g, h = slopes()
    gains = [(quad_tree(*grids(i, j, g, h), least)[0], i, j) for i in range(len(bins)) for j in range(i)]
    model.pairs = [(i, j, np.zeros((width[i], width[j]))) for gain, i, j in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slopes()
            add = RATE * quad_tree(*grids(i, j, g, h), least)[1]
            table += add
            total += add[coarse[i], coarse[j]]
    return model


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from the labelled documents that ``labels`` (id, label) names."""
    order = F.xxhash64(F.lit(7), F.col("__id"))
    named = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y")).filter(F.col("__y").isin(0, 1) & F.col("__id").isNotNull())
    # a share by hash first, so that every task sends its part of the sample and not a sample of its own
    span = 1 << 40
    share = min(1.0, 1.2 * SAMPLE / max(1, named.count()))
    named = named.filter(F.pmod(order, F.lit(span)) < int(share * span)).orderBy(order, "__y").limit(SAMPLE)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("__text")).join(F.broadcast(named), "__id")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = column_features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["__id", "y", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    found = rows.select("__id", "__text", "__y").mapInArrow(run, f"__id {kind}, y int, x array<double>")
    got = found.orderBy("__id", "y", "x").limit(2 * SAMPLE).toPandas()
    if not len(got):
        return Model(0.0)
    return fit(np.stack(got["x"].to_numpy()), got["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) of every document; 0 to 1, higher: label 1 is likelier."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(column_features(batch.column(1))))], [batch.schema.names[0], "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id), F.col(text).cast("string")).mapInArrow(run, f"`{doc_id}` {kind}, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.3, text: str = "text") -> DataFrame:
    """The documents whose score is at least ``least``, all columns kept."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(text)
            yield batch.filter(pa.array(model.scores(column_features(batch.column(at))) >= least))

    return docs.mapInArrow(run, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels outside the held-out fold."""
    return labels.filter(fold("doc_id", 5) != 0)
