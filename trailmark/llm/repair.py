"""Conversation structure repair by Hirschberg's divide and conquer.

Rows of a conversation are kept, given another role, deleted, or joined by inserted ones, at least cost, so that the roles come
to ``(system? (user assistant)+)?``. Four states follow the roles: nothing, system, user, assistant. From a state each edit leads to
one other state, so of edits of equal cost the ASCII-least audit is found edit by edit.

Forward costs from the start and backward costs from the end, four numbers each, meet mid-conversation. Where several states there lie on
cheapest edits, a sweep back over the first half carries along which of them the least audit meets. Both halves are then solved alone,
so nothing but four-state vectors is held. The uppermost halves are blocks of rows in different tasks: rows are sorted by range, cut into
blocks of at most ``ROWS``, each block sends its 4 x 4 cheapest costs, and blocks are told the states between them.

Order: by turn (nulls first), role and MD5 of the text. Equal rows are counted, not repeated, before they are shuffled: all but
the first are duplicates. Texts are shuffled once, for the digest of a conversation, which one task reads as a stream in order (a digest
of a whole conversation cannot be shared out); nothing but the audit is held of it.

Defined cases: null roles and texts are one space, so such texts are blank and such roles are no role; null ids are one conversation;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import settled

ROWS = 2048
#: Costs (fixed by the contract): another role, a deletion, an insertion, leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 60
#: The state after an inserted or reroled row, and after a kept one by its role's initial (s, u, a, other), for each state.
TURN_TO = (2, 2, 3, 2)
KEEP_TO = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
INITIALS = "sua"
LEGAL = ("su", "ua", "au")
#: What is left to pay at the end of a conversation.
END = (0, 2 * INSERT, INSERT, 0)
NAMES = {"u": "user", "a": "assistant"}


def back(costs: tuple, code: int) -> tuple:
    """Costs to the end before a row, given those after it. Code: initial, and 4 more where the row is truncated."""
    extra = TRUNCATED if code >= 4 else 0
    keep = KEEP_TO
    c = code & 3
    row = []
    for s in range(4):
        best = min(DELETE + costs[s], REROLE + extra + costs[TURN_TO[s]])
        to = keep[s][c]
        row.append(best if to is None else min(best, extra + costs[to]))
    user, assistant = min(row[2], INSERT + row[3]), min(row[3], INSERT + row[2])
    return min(row[0], INSERT + user), min(row[1], INSERT + user), user, assistant


def forth(costs: tuple, code: int) -> tuple:
    """Costs from the start after a row, given those before it."""
    extra = TRUNCATED if code >= 4 else 0
    user = min(costs[2], INSERT + min(costs[0], costs[1], costs[3]))
    costs = (costs[0], costs[1], user, min(costs[3], INSERT + user))
    c = code & 3
    out = [DELETE + x for x in costs]
    for s in range(4):
        to = TURN_TO[s]
        out[to] = min(out[to], REROLE + extra + costs[s])
        to = KEEP_TO[s][c]
        if to is not None:
            out[to] = min(out[to], extra + costs[s])
    return tuple(out)


def choice(state: int, costs: tuple, after: tuple, code: int) -> tuple[str, int]:
    """The least letter of a cheapest edit before or of a row, and the state it leads to."""
    extra = TRUNCATED if code >= 4 else 0
    goal, turned, kept = costs[state], TURN_TO[state], KEEP_TO[state][code & 3]
    if DELETE + after[state] == goal:
        return "D", state
    if INSERT + costs[turned] == goal:
        return "I", turned
    if kept is not None and extra + after[kept] == goal:
        return "K", kept
    return "R", turned


def met(codes: bytes, low: int, high: int, costs: tuple) -> tuple[int, int, int, int]:
    """For each state before row ``low`` the state before row ``high`` that the least audit meets; ``costs`` hold there."""
    ends = (0, 1, 2, 3)
    for k in range(high - 1, low - 1, -1):
        code = codes[k]
        before = back(costs, code)
        now = []
        for s in range(4):
            letter, to = choice(s, before, costs, code)
            while letter == "I":
                letter, to = choice(to, before, costs, code)
            now.append(ends[to])
        ends, costs = tuple(now), before
    return ends


def solve(codes: bytes, start: int, costs: tuple) -> list[str]:
    """For each row its letter after the roles' initials of rows inserted before it, from a state to where ``costs`` hold."""
    out: list[str] = []
    work = [(0, len(codes), start, costs)]
    while work:
        low, high, state, after = work.pop()
        if high == low:
            continue
        if high - low == 1:
            before = back(after, codes[low])
            text = ""
            letter, to = choice(state, before, after, codes[low])
            while letter == "I":
                text += "ua"[to - 2]
                letter, to = choice(to, before, after, codes[low])
            out.append(text + (letter if letter != "R" else "R" + "ua"[to - 2]))
            continue
        mid = (low + high) // 2
        first = tuple(0 if s == state else NEVER for s in range(4))
        for k in range(low, mid):
            first = forth(first, codes[k])
        last = after
        for k in range(high - 1, mid - 1, -1):
            last = back(last, codes[k])
        total = min(a + b for a, b in zip(first, last, strict=True))
        crossing = [s for s in range(4) if first[s] + last[s] == total]
        at = crossing[0] if len(crossing) == 1 else met(codes, low, mid, last)[state]
        work.append((mid, high, at, after))
        work.append((low, mid, state, tuple(0 if s == at else NEVER for s in range(4))))
    return out


def closing(state: int) -> str:
    """Initials of the rows that are inserted at the end."""
    return ("", "ua", "a", "")[state]


def judged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, copies, blank, first, truncated): equal rows once; ``first``: no earlier row is equal.

    ``rows``: conv_id, turn, role, text, copies.
    """
    filled = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    key = ["conv_id", "turn", "role", "digest"]
    marks = filled.select(
        "conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), "copies",
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )
    once = settled(marks.groupBy(*key).agg(F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated")))
    seen = once.groupBy(*(F.col(c).alias(f"__{c}") for c in ("conv_id", "role", "digest")))
    seen = seen.agg(F.max(F.col("turn").isNull()).alias("__null"), F.min("turn").alias("__turn"))
    same = once["conv_id"].eqNullSafe(F.col("__conv_id")) & (once["role"] == F.col("__role")) & (once["digest"] == F.col("__digest"))
    first = F.when(F.col("__null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("__turn"))
    return once.join(seen, same).select(*key, "copies", "blank", "truncated", first.alias("first"))


_BLOCK = "conv_id long, block long, codes binary, turns array<long>, roles array<string>, digests array<binary>, copies array<long>, forced array<boolean>, illegal long, head string, tail string"


def blocks(rows: DataFrame) -> DataFrame:
    """Rows of ``judged`` in order, a block of a conversation to a row; block numbers ascend in the order of the rows."""
    order = ["conv_id", "turn", "role", "digest"]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held: list[dict] = []

        def close():
            nonlocal block
            codes = bytes(r["code"] for r in held if not r["forced"])
            out = {"conv_id": held[0]["conv_id"], "block": block, "codes": codes}
            out |= {n: [r[c] for r in held] for n, c in (("turns", "turn"), ("roles", "role"), ("digests", "digest"), ("copies", "copies"), ("forced", "forced"))}
            marks = [r["role"][:1] for r in held]
            out["illegal"] = sum(r["copies"] - 1 for r in held) + sum(a + b not in LEGAL for a, b in zip(marks, marks[1:], strict=False))
            out["head"], out["tail"] = marks[0], marks[-1]
            held.clear()
            block += 1
            return out

        schema = pa.schema([
            ("conv_id", pa.int64()), ("block", pa.int64()), ("codes", pa.binary()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
            ("digests", pa.list_(pa.binary())), ("copies", pa.list_(pa.int64())), ("forced", pa.list_(pa.bool_())), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
        ])
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if held and (r["conv_id"] != held[0]["conv_id"] or len(held) >= ROWS):
                    done.append(close())
                r["forced"] = r["blank"] or not r["first"]
                at = INITIALS.find(r["role"][:1]) if r["role"] else -1
                r["code"] = (at if at >= 0 else 3) + 4 * r["truncated"]
                held.append(r)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if held:
            yield pa.RecordBatch.from_pylist([close()], schema)

    return settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _BLOCK))


def between(cut: DataFrame) -> DataFrame:
    """(block, start, stop): the states before and after each block of the conversations that have several blocks."""
    many = cut.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("__conv_id"))
    parts = settled(cut.join(many, F.col("conv_id").eqNullSafe(F.col("__conv_id")), "left_semi").select("conv_id", "block", "codes"))

    def costs(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for codes in batch.column(2).to_pylist():
                matrix: list[int] = []
                for s in range(4):
                    now = tuple(0 if s == t else NEVER for t in range(4))
                    for code in codes:
                        now = forth(now, code)
                    matrix += [min(x, NEVER) for x in now]
                out.append(matrix)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["conv_id", "block", "matrix"])

    def to_the_end(group):
        import pyarrow as pa

        group = group.sort_by("block")
        out, left = [], END
        for matrix in reversed(group["matrix"].to_pylist()):
            out.append(list(left))
            now = [min(matrix[4 * s + t] + left[t] for t in range(4)) for s in range(4)]
            left = tuple(now)
        return pa.table({"conv_id": group["conv_id"], "block": group["block"], "left": pa.array(out[::-1], pa.list_(pa.int64()))})

    left = parts.mapInArrow(costs, "conv_id long, block long, matrix array<long>").groupBy("conv_id").applyInArrow(to_the_end, "conv_id long, block long, left array<long>")

    def crossings(batches):
        import pyarrow as pa

        for batch in batches:
            out = [list(met(codes, 0, len(codes), tuple(left))) for codes, left in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["conv_id", "block", "meets"])

    met_by = parts.join(left.select("block", "left"), "block").select("conv_id", "block", "codes", "left").mapInArrow(crossings, "conv_id long, block long, meets array<long>")

    def follow(group):
        import pyarrow as pa

        group = group.sort_by("block")
        state, out = 0, []
        for meets in group["meets"].to_pylist():
            out.append((state, meets[state]))
            state = meets[state]
        return pa.table({
            "block": group["block"], "start": pa.array([a for a, _ in out], pa.int64()), "stop": pa.array([b for _, b in out], pa.int64()),
            "last": pa.array([k == len(out) - 1 for k in range(len(out))]), "prior": pa.array([None, *group["block"].to_pylist()[:-1]], pa.int64()),
        })

    return met_by.groupBy("conv_id").applyInArrow(follow, "block long, start long, stop long, last boolean, prior long")


def edits(cut: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, audit, before, out_role, after, cost): what becomes of each row of ``blocks``, in the order of the key.

    ``before`` and ``after`` are the initials of rows inserted beside it, ``out_role`` is null where it is deleted; equal rows are one row here.
    """
    told = between(cut)
    schema = "conv_id long, turn long, role string, digest binary, audit string, before string, out_role string, after string, cost long"

    def run(batches):
        import pyarrow as pa

        types = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("audit", pa.string()), ("before", pa.string()), ("out_role", pa.string()), ("after", pa.string()), ("cost", pa.int64())])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                whole = r["start"] is None
                goal = END if whole else tuple(0 if s == r["stop"] else NEVER for s in range(4))
                codes = r["codes"]
                letters = iter(solve(codes, r["start"] or 0, goal))
                code = iter(codes)
                state = r["start"] or 0
                for turn, role, digest, copies, forced in zip(r["turns"], r["roles"], r["digests"], r["copies"], r["forced"], strict=True):
                    row = {"conv_id": r["conv_id"], "turn": turn, "role": role, "digest": digest, "before": "", "out_role": None, "after": ""}
                    if forced:
                        out.append(row | {"audit": "D" * copies, "cost": DELETE * copies})
                        continue
                    text, c = next(letters), next(code)
                    at = max(text.find(x) for x in "DKR")
                    before, letter, target = text[:at], text[at], text[at + 1 :]
                    for _ in before:
                        state = TURN_TO[state]
                    cost = INSERT * len(before) + DELETE * (copies - 1)
                    if letter == "D":
                        cost += DELETE
                    else:
                        cost += (TRUNCATED if c >= 4 else 0) + (REROLE if letter == "R" else 0)
                        state = TURN_TO[state] if letter == "R" else KEEP_TO[state][c & 3]
                        row["out_role"] = NAMES[target] if letter == "R" else role
                    out.append(row | {"audit": "I" * len(before) + letter + "D" * (copies - 1), "before": before, "cost": cost})
                if (whole or r["last"]) and closing(state):
                    out[-1]["after"] = closing(state)
                    out[-1]["cost"] += INSERT * len(closing(state))
            yield pa.RecordBatch.from_pylist(out, types)

    return cut.join(told, "block", "left").select("conv_id", "codes", "turns", "roles", "digests", "copies", "forced", "start", "stop", "last").mapInArrow(run, schema)


def _texts(rows: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, edit, part): the repaired rows; ``part`` orders rows of one key, inserted rows have no text of their own.

    Sorted by conv_id, turn, original role and digest (both in ``key``) and part, they are the conversations in order.
    """
    found = edits(blocks(judged(rows.withColumn("copies", F.lit(1)))))
    texts = _texts(rows).dropDuplicates(["conv_id", "turn", "role", "digest"])
    key = [found[c].eqNullSafe(texts[c]) for c in ("conv_id", "turn", "role", "digest")]
    name = lambda c: F.when(c == "u", "user").otherwise("assistant")
    at = ["conv_id", "turn", F.struct("role", "digest").alias("key")]
    kept = found.filter("out_role is not null").join(texts, key[0] & key[1] & key[2] & key[3]).select(
        found["conv_id"], found["turn"], F.struct(found["role"], found["digest"]).alias("key"), F.col("out_role").alias("role"), "text",
        F.when(F.col("audit").contains("R"), "rerole").otherwise("keep").alias("edit"), F.lit(1000).alias("part"),
    )
    added = []
    for column, base in (("before", 0), ("after", 2000)):
        split = found.filter(F.length(column) > 0).select(*at, F.posexplode(F.split(column, "")).alias("k", "c")).filter("c <> ''")
        added.append(split.select("conv_id", "turn", "key", name(F.col("c")).alias("role"), F.lit("").alias("text"), F.lit("insert").alias("edit"), (F.col("k") + base).alias("part")))
    return kept.unionByName(added[0]).unionByName(added[1])


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, repaired_sha256) of each conversation, from its rows and their ``edits``; texts pass in order, one by one."""
    names = ["conv_id", "turn", "role", "digest", "kind", "audit", "before", "out_role", "after", "cost", "text"]
    none = lambda *columns: [F.lit(None).cast("long" if n == "cost" else "string").alias(n) for n in columns]
    left = found.select(*names[:4], F.lit(0).alias("kind"), *names[5:10], *none("text"))
    right = _texts(rows).select(*names[:4], F.lit(1).alias("kind"), *none(*names[5:10]), "text")

    def run(batches):
        import pyarrow as pa

        types = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        now: dict | None = None

        def line(role: str, text: str) -> None:
            now["sha"].update((("\n" if now["lines"] else "") + role + ":" + text).encode())
            now["lines"] = True

        def close() -> dict:
            for c in now["after"]:
                line(NAMES[c], "")
            return {"conv_id": now["conv_id"], "cost": now["cost"], "audit": "".join(now["audit"]) + "I" * len(now["after"]), "repaired_sha256": now["sha"].hexdigest()}

        for batch in batches:
            done = []
            text = batch.column(names.index("text"))
            columns = [batch.column(names.index(n)).to_pylist() for n in ("conv_id", "kind", "audit", "before", "out_role", "after", "cost")]
            for k, (conv, kind, audit, before, role, after, cost) in enumerate(zip(*columns, strict=True)):
                if kind:
                    if now["due"] is not None:
                        line(now["due"], text[k].as_py())
                        now["due"] = None
                    continue
                if now is None or now["conv_id"] != conv:
                    if now is not None:
                        done.append(close())
                    now = {"conv_id": conv, "cost": 0, "audit": [], "sha": hashlib.sha256(), "lines": False}
                for c in before:
                    line(NAMES[c], "")
                now["due"], now["after"] = role, after
                now["audit"].append(audit)
                now["cost"] += cost
            if done:
                yield pa.RecordBatch.from_pylist(done, types)
        if now is not None:
            yield pa.RecordBatch.from_pylist([close()], types)

    both = left.select(*names).unionByName(right.select(*names))
    return both.repartition("conv_id").sortWithinPartitions(*names[:5]).mapInArrow(run, "conv_id long, cost long, audit string, repaired_sha256 string")


def report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation that has rows.

    ``rows``: conv_id, turn, role, text and copies, how many times the row is there.
    """
    marks = settled(judged(rows))
    cut = blocks(marks)
    count = lambda c: F.sum(c).cast("long")
    by_row = marks.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        count(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        count(F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.col("first").cast("int"))).alias("duplicate"),
        count((~F.col("blank") & F.col("first") & F.col("truncated")).cast("int")).alias("truncated"),
    )
    met_rows = F.concat(F.lag("tail").over(Window.partitionBy("conv_id").orderBy("block")), F.col("head"))
    edge = cut.select("conv_id", "illegal", F.coalesce((~met_rows.isin(*LEGAL)).cast("long"), F.lit(0)).alias("edge"))
    by_block = edge.groupBy("conv_id").agg(count(F.col("illegal") + F.col("edge")).alias("illegal"))
    done = digests(rows, edits(cut))
    out = done
    for part in (by_row, by_block):
        part = part.withColumnRenamed("conv_id", "__conv_id")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("__conv_id"))).drop("__conv_id")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with one of six faults, by the checksum of id and turn (fixed by the query's contract); nulls are one space."""
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(fill("conv_id"), F.lit(":"), fill("turn")).cast("binary")) % 20
    text, role = fill("text"), fill("role")
    return rows.withColumn("__kind", kind).filter("__kind <> 0").select(
        "conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(F.col("__kind") == 3, 2).otherwise(1).alias("copies"),
    )
