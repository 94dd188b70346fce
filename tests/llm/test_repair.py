"""Conversation repair against brute force over all edits."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from trailmark.llm import repair
from trailmark.llm.queries import op13_repair

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAMES = (("u", "user"), ("a", "assistant"))


def cheapest(rows, marks):
    """Least (cost, audit, lines) by trying all edits."""
    known = {}

    def best(i, state, inserted):
        key = i, state, inserted
        if key not in known:
            tries = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
            for c, name in NAMES if inserted < 3 else ():
                if (state, c) in STEP and (rest := best(i, STEP[state, c], inserted + 1)):
                    tries.append((rest[0] + 5, "I" + rest[1], (name + ":", *rest[2])))
            if i < len(rows):
                _, role, text = rows[i]
                if rest := best(i + 1, state, 0):
                    tries.append((rest[0] + 2, "D" + rest[1], rest[2]))
                if marks[i] not in ("blank", "duplicate"):
                    more = 5 if marks[i] else 0
                    for letter, c, name, price in [("K", role[:1], role, 0), *(("R", c, name, 1) for c, name in NAMES)]:
                        if (state, c) in STEP and (rest := best(i + 1, STEP[state, c], 0)):
                            tries.append((rest[0] + more + price, letter + rest[1], (f"{name}:{text}", *rest[2])))
            known[key] = min(tries) if tries else None
        return known[key]

    return best(0, 0, 0)


def brute(rows):
    conversations, out = {}, []
    for conv, *row in rows:
        conversations.setdefault(conv, []).append(row)
    for conv, own in conversations.items():
        after = []
        for turn, role, text in own:
            role, text = role if role is not None else " ", text if text is not None else " "
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                after += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        turns = [r[0] for r in after if r[0] is not None]
        seen, marks = set(), []
        for _, role, text in after:
            bare = text.strip(" \t\n\x0b\x0c\r")
            marks.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        pairs = zip(after[:-1], after[1:], strict=True)
        cost, audit, lines = cheapest(after, marks)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def made(rng, n):
    texts = ["Hi.", "Yes", "no!", "what?\n", "  ", "", "a b c.", None, "x\x0b", "u. "]
    rows = []
    for conv in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            turn = None if rng.random() < 0.07 else t + rng.choice([0, 0, 0, 1, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv or None, turn, role, rng.choice([*texts, f"x{t}.", f"y{t}.", f"z{t}", f"w{t}."])))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("most", [2048, 3])
def test_query(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(repair, "ROWS", most)
    rng = random.Random(most)
    rows = made(rng, 100)
    rows += [(7, (t or 0) + k, r, x) for k, (_, t, r, x) in enumerate(made(rng, 15))]  # one long conversation
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit("x"), "copies": F.lit(5)}).repartition(3)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((tuple(r) for r in op13_repair(spark, str(tmp_path)).collect()), key=str) == brute(rows)
    if most == 3:
        assert repair.blocks(repair.judged(df.withColumn("copies", F.lit(1)))).filter("conv_id = 7").count() > 20


def test_given_data(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op13_repair(spark, sf).collect()), key=str) == brute(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "user", "More."), (1, 3, "user", "End."), (2, 0, "assistant", "Hm.")]
    got = repair.repair(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", F.col("turn"), "key", "part").collect()
    assert [(r.conv_id, r.role, r.text, r.edit) for r in got if r.conv_id == 1] == [
        (1, "system", "Be kind.", "keep"), (1, "user", "More.", "keep"), (1, "assistant", "End.", "rerole"),  # KDKR, the least of its cost
    ]
    assert not [r for r in got if r.conv_id == 2]


def test_many_copies_and_empty(spark):
    rows = [(1, 0, "user", "Hi there.")] * 5000 + [(1, 1, "assistant", "x " * 50_000 + ".")]
    got = repair.report(spark.createDataFrame(rows, SCHEMA).withColumn("copies", F.lit(1))).first()
    assert got.audit == "K" + "D" * 4999 + "K" and got.cost == 2 * 4999 and got.duplicate == 4999 and got.illegal == 4999
    assert repair.report(spark.createDataFrame([], SCHEMA).withColumn("copies", F.lit(1))).count() == 0
