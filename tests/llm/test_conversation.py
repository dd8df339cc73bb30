"""Conversation repair against all edit sequences by hand, and against SQL on odd and on very long conversations."""

import itertools
import random
import re

import duckdb
import pytest

from eventloom.llm import conversation
from eventloom.llm.queries import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, extra int, part string, n int"


def by_hand(rows):
    """(cost, audit, repaired) of rows (role, text) in order: every edit of every row, up to two inserted turns in every gap."""
    gaps = ["", "u", "a", "ua", "au"]
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    name = {"u": "user", "a": "assistant"}
    best = None
    options = [[("D", None)] + ([] if f in ("blank", "duplicate") else [("K", r[0]), ("R", "user"), ("R", "assistant")]) for r, f in zip(rows, faults)]
    for edits in itertools.product(*options):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            initials = put[0] + "".join((role[0] if e != "D" else "") + g for (e, role), g in zip(edits, put[1:]))
            if not re.fullmatch("(s?(ua)+)?", initials):
                continue
            cost = 5 * sum(map(len, put)) + sum({"K": 0, "R": 1, "D": 2}[e] + (5 if f == "truncated" and e != "D" else 0) for (e, _), f in zip(edits, faults))
            audit = "I" * len(put[0]) + "".join(e + "I" * len(g) for (e, _), g in zip(edits, put[1:]))
            if best is None or (cost, audit) < best[:2]:
                said = [f"{name[x]}:" for x in put[0]]
                for (e, role), (_, text), g in zip(edits, rows, put[1:]):
                    said += [f"{role}:{text}"] * (e != "D") + [f"{name[x]}:" for x in g]
                best = (cost, audit, "\n".join(said))
    return best


def test_against_all_edits(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for c in range(40):
        own = [(rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Hi.", "Yes!", "cut", " \n", "So?"])) for _ in range(rng.randint(1, 3))]
        rows += [(c, 2 * i, *x, 0, "", 0) for i, x in enumerate(own)]
        want[c] = by_hand(own)
    report, repaired = conversation.repair(spark.createDataFrame(rows, SCHEMA))
    assert {r.conv_id: (r.cost, r.audit) for r in report.collect()} == {c: w[:2] for c, w in want.items()}
    said = {c: [] for c in want}
    for r in sorted(repaired.collect(), key=lambda r: (r.conv_id, r.position)):
        said[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: "\n".join(x) for c, x in said.items()} == {c: w[2] for c, w in want.items()}


def from_sql(rows):
    import pandas as pd

    con = duckdb.connect()
    frame = pd.DataFrame([r[:4] for r in rows], columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    con.execute("create table conversations as select conv_id::bigint as conv_id, turn::bigint as turn, role::varchar as role, text::varchar as text from frame")
    names = [d[0] for d in con.execute(conversation.oracle_sql()).description]
    return {r[0]: dict(zip(names, r)) for r in con.execute(conversation.oracle_sql()).fetchall()}


def test_whole_table(spark, small, duck, same):
    same(op11_conversation_repair(spark, small), duck, conversation.oracle_sql())


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "a."), (1, None, "user", "x."), (1, None, "user", "x."), (1, None, "", "b!"), (2, 5, "user", ""), (3, 1, "tool", "é．"), (3, 1, "tool", "é．")]
    rows += [(4, t, "user", "same.") for t in range(6)] + [(5, 2, "assistant", "end. \n\t")] * 40 + [(6, 7, "system", "only.")]
    d = spark.createDataFrame([(*r, 1, "p", 9) for r in rows], SCHEMA)
    got = {r.conv_id: r.asDict() for r in conversation.audit(d).collect()}
    assert got == from_sql(rows) and len(got) == 7
    report, repaired = conversation.repair(d)
    assert {r.conv_id: r.audit for r in report.collect()}[5] == "D" * 40  # an answer alone costs an inserted turn to keep
    assert conversation.audit(d.limit(0)).count() == 0 and repaired.where("conv_id = 6").count() == 0


def test_dropped_whole(spark):
    import zlib

    turn = next(t for t in range(100) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    (r,) = conversation.audit(spark.createDataFrame([(9, turn, "user", "x.", 0, "", 0)], SCHEMA)).collect()
    assert r.audit == "" and r.cost == r.gaps == 0 and r.repaired_sha256.startswith("e3b0c442")


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_long_conversation_in_many_partitions(spark, many_partitions):
    rng = random.Random(8)
    rows = [(c, t // 2, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Hi.", "cut", "", "Yes!"]) + str(rng.randint(0, 300)) + rng.choice([".", ""])) for c, n in ((1, 3000), (2, 5), (3, 1), (None, 50)) for t in range(n)]
    d = spark.createDataFrame([(*r, 1, "p", 9) for r in rows], SCHEMA)
    _, repaired = conversation.repair(conversation.damage(d))
    assert repaired.where("not whole").select("conv_id").distinct().count() >= 1
    assert {r.conv_id: r.asDict() for r in conversation.audit(d).collect()} == from_sql(rows)
