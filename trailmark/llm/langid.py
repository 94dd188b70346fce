"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text. A document is parsed against each: a phrase is the longest
match with the language's text, the next phrase begins where it ends. Phrases cost log2 of the size of that text;
the language needing the fewest bits a symbol wins.

Texts are parsed in lockstep: all documents of a block are cut into stretches of ``STRETCH`` symbols (a cut ends a
phrase in every language alike) and numpy steps through all stretches at once, whole texts included. Every language that has a
training text with a letter is learned, from about ``CHARS`` symbols: ``SAMPLE_DOCS`` documents in hash order, of each at most ``SAMPLE_LENGTH``
characters (documented bounds of the sample). Every letter is a symbol of its own, case folded; only what a language's own text
holds can continue a phrase in it. Transitions are dense tables while these are small, sorted keys otherwise; both parse alike.

Defined cases: a null text or one without a letter is ``und`` with score 0; ties go to the language with more
training documents, then by name; with no training rows all is ``und``; rows are treated one by one, so repeated rows
and null ids come back as they are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHARS, SAMPLE_DOCS, SAMPLE_LENGTH = 12_000, 64, 20_000
STRETCH, BLOCK = 256, 1 << 20
#: Letters of a language, and bytes of all languages together, up to which transitions are dense tables.
WIDE, DENSE = 250, 192 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Languages with their training text; symbols: letters in use, 0 is any run of other characters."""

    languages: list[str]
    texts: list[str]


def symbols_of(alphabet: str) -> np.ndarray:
    """Code point to symbol: 0 no letter, 1 a letter outside the alphabet, then the alphabet (case folded)."""
    table = np.zeros(0x110000, np.int32)
    for cp in range(0x20000):
        if chr(cp).isalpha():
            table[cp] = 1
    table[0x20000:0x32000] = 1  # further ideographs
    for i, c in enumerate(alphabet):
        for x in {c, c.upper()}:
            if len(x) == 1:
                table[ord(x)] = i + 2
    return table


def encoded(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text; each run of non-letters is one 0."""
    s = table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; every path from state 0 spells a piece of the text."""
    step: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return step


def parsing_table(step: list[dict[int, int]], width: int) -> np.ndarray:
    """For state and symbol: the next state's row start and, in the two low bits, how many phrases ended.

    The last symbol of a row pads stretches: it stays at state 0 and ends nothing.
    """
    root = np.full(width, 2, np.int32)
    for c, to in step[0].items():
        root[c] = (to * width) << 2 | 1
    table = np.tile(root, (len(step), 1))
    table[0] = np.where(root == 2, 1, root & ~3)  # no phrase is open in state 0
    for state, moves in enumerate(step):
        for c, to in moves.items():
            table[state, c] = (to * width) << 2
    table[:, -1] = 1
    table[0, -1] = 0
    return table.ravel()


class Dense:
    """Transitions as one table; states are the starts of their rows."""

    def __init__(self, step: list[dict[int, int]], width: int):
        self.table = parsing_table(step, width)

    def ended(self, columns: np.ndarray) -> np.ndarray:
        """Phrases that ended in each stretch."""
        state = np.zeros(columns.shape[1], np.int32)
        ended = np.zeros(columns.shape[1], np.int32)
        for column in columns:
            got = self.table[state + column]
            ended += got & 3
            state = got >> 2
        return ended + (state != 0)


class Sorted:
    """Transitions as sorted (state, symbol) keys, for alphabets too large for a table."""

    def __init__(self, step: list[dict[int, int]], width: int):
        keys = np.array([s * width + c for s, moves in enumerate(step) for c in moves] or [-1], np.int64)
        targets = np.array([to for moves in step for to in moves.values()] or [0], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets, self.width = keys[order], targets[order], width
        self.root = np.full(width, -1, np.int64)
        for c, to in step[0].items():
            self.root[c] = to

    def ended(self, columns: np.ndarray) -> np.ndarray:
        state = np.zeros(columns.shape[1], np.int64)
        ended = np.zeros(columns.shape[1], np.int32)
        for column in columns:
            key = state * self.width + column
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            goes_on = self.keys[at] == key
            again = self.root[column]
            closed = (state != 0).astype(np.int32) + ((again < 0) & (column != self.width - 1))
            ended += np.where(goes_on, 0, closed)
            state = np.where(goes_on, self.targets[at], np.maximum(again, 0))
        return ended + (state != 0)


class Parser:
    """The model made ready: symbols, and for each language its own alphabet and transitions."""

    def __init__(self, model: Model, wide: int = WIDE, dense: int = DENSE):
        alphabet = "".join(sorted({c for text in model.texts for c in text.lower() if c.isalpha()}))
        self.languages, self.symbols, self.pad = model.languages, symbols_of(alphabet), len(alphabet) + 2
        self.parsers, self.own, self.cost = [], [], []
        for text in model.texts:
            codes = encoded(text, self.symbols)
            letters = np.unique(codes)
            # 0 is no letter everywhere; what this text doesn't hold is one symbol, on which no phrase goes on; the last one pads
            local = np.full(self.pad + 1, len(letters) + 1, np.int32)
            local[letters] = np.arange(1, len(letters) + 1)
            local[self.pad] = len(letters) + 2
            step = suffix_automaton(local[codes].tolist())
            width = len(letters) + 3
            size = 4 * len(step) * width
            small = width <= wide and size <= dense
            dense -= size if small else 0
            self.parsers.append((Dense if small else Sorted)(step, width))
            self.own.append(local.astype(np.uint8) if width <= 256 else local)
            self.cost.append(np.log2(len(codes) + 2.0))

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a symbol for each text and language, and whether a text has a letter."""
        coded = [encoded(t, self.symbols) for t in texts]
        length = np.array([len(c) for c in coded], np.int64)
        letters = np.array([bool(c.any()) for c in coded], bool)
        pieces = -(-length // STRETCH)
        padded = np.full(int(pieces.sum()) * STRETCH, self.pad, np.int32)
        begin = np.concatenate([[0], np.cumsum(pieces)])
        for c, b in zip(coded, begin, strict=False):
            padded[b * STRETCH : b * STRETCH + len(c)] = c
        columns = np.ascontiguousarray(padded.reshape(-1, STRETCH).T)
        out = np.zeros((len(texts), len(self.parsers)))
        for k, (parser, own) in enumerate(zip(self.parsers, self.own, strict=True)):
            total = np.concatenate([[0], np.cumsum(parser.ended(own[columns]))])
            out[:, k] = (total[begin[1:]] - total[begin[:-1]]) * self.cost[k] / np.maximum(length, 1)
        return out, letters


def learn(labelled: DataFrame, key: Column, text: str = "text", lang: str = "lang") -> Model:
    """A model from labelled rows; ``key`` orders the sample (a hash of the row)."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), key.alias("key"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return Model([], [])
    span = 1 << 40
    # some twice the documents asked for, so that chance leaves no language short; a language with few has them all
    shares = [(r["lang"], int(span * min(1.0, 2 * SAMPLE_DOCS / r["count"]))) for r in counts]
    wanted = F.broadcast(labelled.sparkSession.createDataFrame(shares, "lang string, below long"))
    near = rows.join(wanted, "lang").withColumn("place", F.pmod("key", F.lit(span))).filter(F.col("place") < F.col("below"))
    near = near.select("lang", "place", F.substring("text", 1, SAMPLE_LENGTH).alias("text"))
    first = Window.partitionBy("lang").orderBy("place", "text")
    picked = near.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= SAMPLE_DOCS).orderBy("lang", "nth").collect()
    texts: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    for r in picked:
        if sum(map(len, texts[r["lang"]])) < CHARS:
            texts[r["lang"]].append(r["text"])
    known = [k for k, v in texts.items() if v]
    return Model(known, [" ".join(texts[k])[:CHARS] for k in known])


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` (how far the second language is behind, as a share) and carried columns."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        parser = Parser(model)
        for batch in batches:
            names, scores = [], []
            todo: list[str] = []

            def flush():
                if not model.languages:
                    names.extend([UNKNOWN] * len(todo))
                    scores.extend([0.0] * len(todo))
                elif todo:
                    bits, letters = parser.bits(todo)
                    best = bits.argmin(1)
                    low = bits.min(1)
                    rest = np.partition(bits, 1, 1)[:, 1] if bits.shape[1] > 1 else np.full(len(todo), np.inf)
                    score = np.clip(1 - low / np.where(rest > 0, rest, 1), 0, 1) * letters
                    names.extend(parser.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True))
                    scores.extend(score.tolist())
                todo.clear()

            size = 0
            for value in batch.column(1):
                todo.append(value.as_py() or "")
                size += len(todo[-1])
                if size >= BLOCK:
                    flush()
                    size = 0
            flush()
            kept = [c for i, c in enumerate(batch.columns) if i != 1]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*(n for i, n in enumerate(batch.schema.names) if i != 1), "lang_pred", "score"],
            )

    narrow = docs.select(F.col(doc_id), F.col(text).cast("string").alias("__text"), *carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name != "__text")
    return narrow.mapInArrow(run, f"{kinds}, lang_pred string, score double")
