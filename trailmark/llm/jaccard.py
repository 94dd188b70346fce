"""N-gram Jaccard join with a count-vector R-tree.

Shingles are hashed into groups; a document is the point of its group counts. A node of the tree has the largest
counts of its points as upper corner, and no point below it can share more with a document than the sum of the
coordinate minima. The tree has three levels:

1. The root holds all other documents over very fine groups. The bound of a document against it is the number of its
   shingles whose group some other document touches; below the threshold it has no partner and leaves. Chunks of
   documents send each distinct group once, packed, so frequent passages are no hot keys.
2. Below are nodes that share a fine group among the first ``n - overlap + 1`` of a document in hash order: by the same
   bound, documents that share none of these cannot link. Sizes are a bound too: a node holds sets of like size. Nodes
   with the same smallest member are one.
3. In a node, points over ``GROUPS`` coarse groups are packed into leaves by size and count; pairs of leaves and then
   pairs of points are pruned by the bound, surviving pairs verified on shingle sets. This is done on the part of each set that
   lies in the lowest hashes first, where all others count as shared; whole sets go only to nodes that the parts leave connected.

Equal sets are collapsed to the smallest id first. Nodes of more than ``MEMBERS`` documents or ``SHINGLES`` shingles are cut into blocks that meet
in pairs. Only one link for each new connection leaves a node, never all pairs. Nothing is capped.

Shingles are compared by 64-bit hashes. Defined cases: a text with fewer words than a shingle has its whole sequence as
the only one; null, empty and blank texts have none and are linked with nothing; rows that share an id are one node with
several sets (one row comes back for each, with its own size); null ids are not linked and have a null component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import lower_ascii, mix, row_blocks, sent_if_small, settled, string_bytes, word_hashes, words
from trailmark.llm.components import components

WORDS, PERCENT = 5, 80
#: Coarse groups of a point, points of a leaf, and the documents and shingles that a block of a node holds at most (a longer set stands alone).
GROUPS, LEAF, MEMBERS, SHINGLES = 64, 16, 768, 1 << 19
#: Bytes of text of a chunk, and those that are hashed at once.
CHUNK, BLOCK, MOST_ROWS = 4 << 20, 1 << 20, 60_000
#: Shingles of a thin set, below which a set is thin as a whole.
INNER = 64
#: In a chunk's list: a group that is known to be shared, so that no document is to be told.
TOLD = 0xFFFF
#: Bytes of a fine group beside the bits that deal it out.
REST = 3


def shingles(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, by row and then hash."""
    low = lower_ascii(data)
    start, end, row = words(low, bounds)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = word_hashes(low, start, end)
    count = np.bincount(row, minlength=len(bounds) - 1)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    total = np.zeros(len(h), np.uint64)
    for k in range(width):
        part = np.zeros(len(h), np.uint64)
        part[: max(0, len(h) - k)] = h[k:]
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + part)
    whole = np.arange(len(h)) + width <= (first + count)[row]
    rows, values = row[whole], total[whole]
    for r in np.flatnonzero((count > 0) & (count < width)):  # the whole sequence is the only shingle
        one = np.array([count[r]], np.uint64)
        for x in h[first[r] : first[r] + count[r]]:
            one = mix(one * np.uint64(0x9E3779B97F4A7C15) + x)
        rows, values = np.append(rows, r), np.concatenate([values, one])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


def chunk_shingles(column, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range of each chunk of a string column, and its ``shingles``; what is hashed at once is smaller than a chunk."""
    data, bounds = string_bytes(column)
    for a, b in row_blocks(bounds, CHUNK):
        for c in range(a, b, MOST_ROWS):
            d = min(b, c + MOST_ROWS)
            rows, values = [], []
            for x, y in row_blocks(bounds[c : d + 1], BLOCK):
                lo, hi = bounds[c + x], bounds[c + y]
                r, v = shingles(data[lo:hi], bounds[c + x : c + y + 1] - lo, width)
                rows.append(r + x)
                values.append(v)
            yield c, d, np.concatenate(rows), np.concatenate(values)


def enough(shared, n_a, n_b, percent: int):
    """100 * intersection >= percent * union."""
    return (100 + percent) * shared >= percent * (n_a + n_b)


def bounded_by_root(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, alive, digest): each document's set in short, and whether the root's box leaves it a partner.

    A group is ``bits`` bits of the hash, which say where it is dealt to, and ``REST`` bytes more. There are more of them
    in proportion to the partitions of the input, so groups stay as fine as the input grows.
    """
    bits = max(6, min(24, docs.rdd.getNumPartitions().bit_length() + 2))
    shift, low = np.uint64(64 - bits), np.uint64(64 - bits - 8 * REST)

    def send(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            for a, b, own_rows, own_values in chunk_shingles(batch.column(1), width):
                order = np.argsort(own_values, kind="stable")
                rows, values = own_rows[order], own_values[order]
                first = np.ones(len(values), bool)
                first[1:] = values[1:] != values[:-1]
                again = np.zeros(len(values), bool)  # several documents of the chunk have it
                again[1:] |= ~first[1:]
                again[:-1] |= ~first[1:]
                known = np.bincount(rows[again], minlength=b - a).astype(np.int32)
                owner = np.where(again, TOLD, rows)[first].astype(np.uint16)
                values = values[first]
                part = (values >> shift).astype(np.int64)
                rest = (values >> low).astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :REST]
                cut = np.searchsorted(part, np.arange((1 << bits) + 1))
                sizes = np.bincount(rows, minlength=b - a).astype(np.int32)
                full = np.flatnonzero(np.diff(cut))
                edge = np.searchsorted(own_rows, np.arange(b - a + 1))
                digests = [hashlib.blake2b(own_values[x:y].tobytes(), digest_size=16).digest() for x, y in zip(edge[:-1], edge[1:], strict=True)]
                payload = [known.tobytes()] + [rest[cut[p] : cut[p + 1]].tobytes() + owner[cut[p] : cut[p + 1]].tobytes() for p in full]
                none = [None] * len(full)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk] * len(payload), pa.int64()), pa.array([-1 - chunk, *full], pa.int64()),
                        pa.array([batch.column(0).slice(a, b - a).to_pylist(), *none], pa.list_(pa.int64())),
                        pa.array([sizes.tolist(), *none], pa.list_(pa.int32())),
                        pa.array([digests, *none], pa.list_(pa.binary())), pa.array(payload, pa.binary()),
                    ],
                    ["chunk", "part", "ids", "sizes", "digests", "payload"],
                )
                chunk += 1

    own = "ids array<long>, sizes array<int>, digests array<binary>, payload binary"
    sent = docs.mapInArrow(send, f"chunk long, part long, {own}")

    def meet(group):
        import pyarrow as pa

        if group["part"][0].as_py() < 0:  # a chunk's own row passes
            return group.drop_columns(["part"])
        lists = [p.as_py() for p in group["payload"]]
        long = np.array([len(p) // (REST + 2) for p in lists])
        rest = np.zeros((long.sum(), 4), np.uint8)
        rest[:, :REST] = np.concatenate([np.frombuffer(p, np.uint8, REST * n).reshape(-1, REST) for p, n in zip(lists, long, strict=True)])
        rest = rest.view(np.uint32).ravel()
        owner = np.concatenate([np.frombuffer(p[REST * n :], np.uint16) for p, n in zip(lists, long, strict=True)])
        order = np.argsort(rest, kind="stable")
        same = rest[order][1:] == rest[order][:-1]
        shared = np.zeros(len(rest), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        shared &= owner != TOLD
        at = np.concatenate([[0], np.cumsum(long)])
        told = [owner[a:b][shared[a:b]].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        keep = [k for k, t in enumerate(told) if t]
        none = [None] * len(keep)
        return pa.table({
            "chunk": group["chunk"].take(pa.array(keep, pa.int64())), "ids": pa.array(none, pa.list_(pa.int64())),
            "sizes": pa.array(none, pa.list_(pa.int32())), "digests": pa.array(none, pa.list_(pa.binary())), "payload": pa.array([told[k] for k in keep], pa.binary()),
        })

    told = sent.groupBy("part").applyInArrow(meet, f"chunk long, {own}")

    def settle_chunk(group):
        import pyarrow as pa

        own = group.filter(group["ids"].is_valid())  # the chunk's own row
        ids = own["ids"].combine_chunks().flatten()
        sizes = own["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        shared = np.frombuffer(own["payload"][0].as_py(), np.int32).astype(np.int64)
        for p in group.filter(group["ids"].is_null())["payload"]:
            shared += np.bincount(np.frombuffer(p.as_py(), np.uint16), minlength=len(sizes))
        return pa.table({"doc_id": ids, "n": pa.array(sizes, pa.int32()), "alive": pa.array((sizes > 0) & (100 * shared >= percent * sizes)), "digest": own["digests"].combine_chunks().flatten()})

    return told.groupBy("chunk").applyInArrow(settle_chunk, "doc_id long, n int, alive boolean, digest binary")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(rep, shingles): the sorted set of each document that has one."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, rows, values in chunk_shingles(batch.column(1), width):
                cut = np.searchsorted(rows, np.arange(b - a + 1))
                full = np.flatnonzero(np.diff(cut))
                sets = [values[cut[r] : cut[r + 1]].tobytes() for r in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(full)), pa.array(sets, pa.binary()),
                    ],
                    ["rep", "shingles"],
                )

    return docs.mapInArrow(run, "rep long, shingles binary")


def region(percent: int) -> float:
    """The part of the hash range that ``thin_sets`` cover: twice what sets that link can differ by, so that most others are told apart by it."""
    return min(1.0, 2 * (100 - percent) / (100 + percent))


def thin_sets(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(rep, n, inner, part): of each set its size, its shingles below ``region`` and 32 bits of each of these; of a small set all of them."""
    share = region(percent)
    top = np.uint64(min(int(share * 2**64), 2**64 - 1))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b, rows, values in chunk_shingles(batch.column(1), width):
                cut = np.searchsorted(rows, np.arange(b - a + 1))
                size = np.diff(cut)
                full = np.flatnonzero(size)
                inner = np.bincount(rows[values < top], minlength=b - a)
                kept = np.where(size * share <= INNER, size, inner)
                low = values.astype(np.uint32)
                parts = [low[cut[r] : cut[r] + kept[r]].tobytes() for r in full]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(full)), pa.array(size[full], pa.int32()), pa.array(inner[full], pa.int32()), pa.array(parts, pa.binary())],
                    ["rep", "n", "inner", "part"],
                )

    return docs.mapInArrow(run, "rep long, n int, inner int, part binary")


def node_entries(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(token, rep, n): the nodes that a document enters, its first n - overlap + 1 groups in hash order.

    Sets that link differ in size by less than 100 / percent, so they are of one or of neighbouring size bands. A node is
    for one group and band, and a document enters those of its own band and the next. Texts are hashed here, not read from
    ``shingle_sets``: two Python workers in a row would double the memory of a task.
    """
    band = np.log(100 / percent * 1.0001)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            reps = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, rows, values in chunk_shingles(batch.column(1), width):
                cut = np.searchsorted(rows, np.arange(b - a + 1))
                size = np.diff(cut)
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                n = size[full]
                enters = n - -(-percent * n // 100) + 1
                at = np.repeat(cut[full], enters) + np.arange(enters.sum()) - np.repeat(np.cumsum(enters) - enters, enters)
                first = values[at]
                own = np.repeat((np.log(n) / band).astype(np.int64), enters)
                salt = lambda x: x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                heads = np.concatenate([mix(first + salt(own)), mix(first + salt(own + 1))]).view(np.int64)
                owners, sizes = np.repeat(reps[a:b][full], enters), np.repeat(n, enters).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(np.tile(owners, 2)), pa.array(np.tile(sizes, 2))], ["token", "rep", "n"])

    return docs.mapInArrow(run, "token long, rep long, n int")


@dataclass
class Tree:
    """Leaves of points packed by size: order of the points, bounds of the leaves, their corners, smallest sizes and largest rests."""

    order: np.ndarray
    cut: np.ndarray
    corner: np.ndarray
    least: np.ndarray
    rest: np.ndarray


def packed(points: np.ndarray, sizes: np.ndarray, rest: np.ndarray) -> Tree:
    heavy = points.argmax(1)
    order = np.lexsort((points[:, 0], heavy, sizes))
    cut = np.append(np.arange(0, len(order), LEAF), len(order))
    corner = np.maximum.reduceat(points[order], cut[:-1], axis=0)
    return Tree(order, cut, corner, np.minimum.reduceat(sizes[order], cut[:-1]), np.maximum.reduceat(rest[order], cut[:-1]))


def linked(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int, rest: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a node, one for each connection it makes: (member, smallest member it is connected with).

    ``side``: pairs are looked for between members of side 0 and 1, or among all where there is one side. ``rest``: how many shingles a member
    has beside those in ``sets``; two members may share as many more as the smaller rest, so the links are then all that there can be, and others.
    """
    parent = list(range(len(ids)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    given = np.array([len(s) for s in sets])
    rest = np.zeros(len(given), np.int64) if rest is None else rest
    sizes = given + rest
    points = np.stack([np.bincount((s >> s.dtype.type(20)).astype(np.int64) & (GROUPS - 1), minlength=GROUPS) for s in sets]).astype(np.int32)
    two = side.any() and not side.all()
    members = [np.flatnonzero(side == k) for k in (0, 1)] if two else [np.arange(len(ids))] * 2
    trees = [packed(points[m], sizes[m], rest[m]) for m in members]
    known, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.cumsum(given) - given
    numbered = [numbers[x : x + n] for x, n in zip(cut, given, strict=True)]
    held = np.zeros((len(known), LEAF), np.uint8)  # which shingles the points of a leaf have
    left, right = trees
    for a in range(len(left.least)):
        i = members[0][left.order[left.cut[a] : left.cut[a + 1]]]
        near = np.flatnonzero(enough(np.minimum(left.corner[a], right.corner).sum(1) + np.minimum(left.rest[a], right.rest), left.least[a], right.least, percent))
        near = near if two else near[near >= a]
        if not len(near):
            continue
        for x, p in enumerate(i):
            held[numbered[p], x] = 1
        for b in near:
            j = members[1][right.order[right.cut[b] : right.cut[b + 1]]]
            most = np.minimum(points[i][:, None, :], points[j][None, :, :]).sum(2) + np.minimum(rest[i][:, None], rest[j][None, :])
            maybe = enough(most, sizes[i][:, None], sizes[j][None, :], percent)
            for y in np.flatnonzero(maybe.any(0)):
                q = int(j[y])
                open_ = [x for x in np.flatnonzero(maybe[:, y]) if i[x] != q and top(int(i[x])) != top(q)]
                if open_:
                    shared = held[numbered[q]].sum(0, dtype=np.int64)
                    for x in open_:
                        p = int(i[x])
                        if enough(shared[x] + min(rest[p], rest[q]), sizes[p], sizes[q], percent):
                            parent[top(p)] = top(q)
        for p in i:
            held[numbered[p]] = 0
    least: dict[int, int] = {}
    for i in range(len(ids)):
        r = top(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [(int(ids[i]), int(least[top(i)])) for i in range(len(ids)) if ids[i] != least[top(i)]]


def placed_in_blocks(entered: DataFrame) -> DataFrame:
    """(rep, node, i, j, side) of (node, rep, n): blocks of a node, of which each two meet, and on which side of them a member is."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / MEMBERS), F.ceil(F.sum("n") / SHINGLES))
    nodes = entered.groupBy("node").agg(blocks.cast("int").alias("blocks"))
    placed = entered.join(nodes, "node").withColumn("block", F.pmod(F.xxhash64(F.lit(2), "rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select("rep", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))


def met(placed: DataFrame, sets: DataFrame, columns: list[str], found_in, schema: str) -> DataFrame:
    """Rows of ``schema`` that ``found_in(ids, sides, lists of columns)`` finds in each pair of blocks."""
    key = ["node", "i", "j"]
    full = sets.join(sent_if_small(placed), "rep").repartition(*key).sortWithinPartitions(*key)

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []
        current = None

        def close():
            out = []
            if len(held) > 1:
                ids, side, *rest = zip(*held, strict=True)
                out = found_in(np.array(ids, np.int64), np.array(side), rest)
            held.clear()
            return out

        def told(found):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(len(names_out))], names_out)

        names_out = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            found = []
            names = batch.schema.names
            at = [batch.column(names.index(n)) for n in (*key, "rep", "side", *columns)]
            for node, i, j, *own in zip(*(c.to_pylist() for c in at), strict=True):
                if (node, i, j) != current:
                    found += close()
                    current = (node, i, j)
                held.append(tuple(own))
            yield told(found)
        yield told(close())

    return full.mapInArrow(run, schema)


def links(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between set representatives (rep, text) that connect all that are similar.

    A member of a node sends a part of its set first. What the parts leave connected is a node of its own, named by its smallest member; only there whole
    sets meet. So the sets of documents that share no more than a few shingles don't go to every node that they enter.
    """
    entries, sets = node_entries(docs, width, percent), shingle_sets(docs, width)
    shared = entries.groupBy("token").agg(F.min("rep").alias("node"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    entered = settled(entries.join(shared.select("token", "node"), "token").select("node", "rep", "n").distinct())

    def near(ids, side, rest):
        sizes, inner = (np.array(x, np.int64) for x in rest[:2])
        parts = [np.frombuffer(x, np.uint32) for x in rest[2]]
        if any(len(x) < n for x, n in zip(parts, sizes, strict=True)):  # all are compared below the same hash
            parts = [x[:n] for x, n in zip(parts, inner, strict=True)]
        found = linked(ids, parts, side, percent, sizes - np.array([len(x) for x in parts]))
        largest: dict[int, int] = {}
        for rep, n in zip(ids.tolist(), sizes.tolist(), strict=True):
            largest[rep] = max(n, largest.get(rep, 0))
        return [(b, x, largest[x]) for a, b in found for x in (a, b)]

    thin = met(settled(placed_in_blocks(entered)), thin_sets(docs, width, percent), ["n", "inner", "part"], near, "node long, rep long, n long")
    closer = settled(thin.groupBy("node", "rep").agg(F.max("n").alias("n")))

    def similar(ids, side, rest):
        return linked(ids, [np.frombuffer(x, np.int64) for x in rest[0]], side, percent)

    return met(settled(placed_in_blocks(closer)), sets, ["shingles"], similar, "a long, b long").distinct()


def join(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sized = settled(bounded_by_root(rows, width, percent))
    alive = sized.filter("alive and doc_id is not null").select("doc_id", "digest").distinct()
    reps = alive.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    member = settled(alive.join(reps, "digest").select("doc_id", "rep"))
    own = settled(member.select("rep").distinct())
    chosen = rows.join(sent_if_small(own), rows["doc_id"] == own["rep"], "left_semi")
    first = member.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    several = first.filter("rep <> other").select("doc_id", F.col("rep").alias("b"))  # texts of one id: all of them are linked, not two
    found = links(chosen, width, percent).unionByName(member.join(several, "doc_id").select(F.col("rep").alias("a"), "b"))
    roots = components(found)
    placed = first.join(roots, first["rep"] == roots["node"], "left").select("doc_id", F.coalesce("root", "rep").alias("root"))
    out = sized.select("doc_id", "n").join(placed, "doc_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that reach a smaller id; of rows with one id all stay."""
    gone = join(docs, width, percent, doc_id, text).filter("component_id < doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone = sent_if_small(settled(gone))
    return docs.join(gone, docs[doc_id] == gone["__gone"], "left_anti")
