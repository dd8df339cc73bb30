"""Repair of the turn structure of conversations by a min-plus scan of 4x4 matrices.

States: nothing yet, after a system turn, after a user turn, after an assistant turn. An element is (cost, audit): the cheapest way from one
state to another and the initials of its edits, ties to the ASCII-least; None where there is no way. A turn's matrix is
the closure under inserted turns times its own edits. The product is associative, so each partition of the sorted turns reduces
what it has of a conversation as a balanced tree, and conversations that reach across partitions are combined SPAN partitions
at a time. (Two audits over the same turns with equal cost are never a proper prefix of each other: the longer one holds more
insertions and is dearer. So the least audit of a product is a product of least audits.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.runtime import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Segments of one conversation that a task combines at a time.
SPAN = 16
_SPACE = " \t\n\x0b\x0c\r"

Element = tuple[int, str] | None
Matrix = tuple[Element, ...]

#: State after a turn of some role, from each state; None where the role may not stand.
_STEPS = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}


def _least(a: Element, b: Element) -> Element:
    return b if a is None else a if b is None else min(a, b)


def times(x: Matrix, y: Matrix) -> Matrix:
    """The min-plus product: costs add, audits join, the least of all ways wins."""
    out: list[Element] = [None] * 16
    for i in range(0, 16, 4):
        for k in range(4):
            a = x[i + k]
            if a is None:
                continue
            for j in range(4):
                b = y[4 * k + j]
                if b is not None:
                    way, have = (a[0] + b[0], a[1] + b[1]), out[i + j]
                    if have is None or way < have:
                        out[i + j] = way
    return tuple(out)


IDENTITY: Matrix = tuple((0, "") if i % 5 == 0 else None for i in range(16))


def _edits(ways: Iterable[tuple[str, int, str]]) -> Matrix:
    """The matrix of single edits (role, cost, initial); an empty role leaves the state."""
    out: list[Element] = [None] * 16
    for role, cost, name in ways:
        for i, j in enumerate(_STEPS[role] if role else range(4)):
            if j is not None:
                out[4 * i + j] = _least(out[4 * i + j], (cost, name))
    return tuple(out)


def _closure() -> Matrix:
    """No, one or more inserted turns; three in a row never pay, as two lead back to the state before."""
    one = _edits((r, INSERT, "I") for r in "ua")
    both = times(one, one)
    return tuple(_least(_least(a, b), c) for a, b, c in zip(IDENTITY, one, both, strict=True))


INSERTS = _closure()


@lru_cache(maxsize=100_000)
def _turns(kinds: str) -> Matrix:
    """The product over a few turns, two characters each: role initial (or -) and fault (B, D, T or -)."""
    if len(kinds) > 2:
        half = len(kinds) // 4 * 2
        return times(_turns(kinds[:half]), _turns(kinds[half:]))
    role, fault = kinds
    ways = [("", DELETE, "D")]
    if fault not in "BD":
        more = TRUNCATED if fault == "T" else 0
        ways += [(r, REROLE + more, "R") for r in "ua"] + ([(role, KEEP + more, "K")] if role in _STEPS else [])
    return times(INSERTS, _edits(ways))


class _Product:
    """A product that grows at its right end, kept as a stack of factors of falling size, so that joined audits stay short."""

    def __init__(self):
        self.stack: list[tuple[int, Matrix]] = []
        self.kinds: list[str] = []

    def add(self, kind: str, times_: int = 1) -> None:
        """A turn, and equal ones right after it."""
        if times_ > 16:
            self._flush()
            base, out = _turns(kind), IDENTITY
            n = times_
            while n:
                out = times(out, base) if n & 1 else out
                base, n = times(base, base) if n > 1 else base, n >> 1
            self._push(times_, out)
            return
        self.kinds += [kind] * times_
        if len(self.kinds) >= 8:
            self._flush()

    def _flush(self) -> None:
        if self.kinds:
            n, m = len(self.kinds), _turns("".join(self.kinds)) if len(self.kinds) <= 8 else None
            for i in range(0, n if m is None else 0, 8):
                part = "".join(self.kinds[i : i + 8])
                self._push(len(part) // 2, _turns(part))
            if m is not None:
                self._push(n, m)
            self.kinds = []

    def _push(self, n: int, m: Matrix) -> None:
        self.stack.append((n, m))
        while len(self.stack) > 1 and self.stack[-2][0] <= self.stack[-1][0]:
            (a, x), (b, y) = self.stack[-2:]
            self.stack[-2:] = [(a + b, times(x, y))]

    def value(self) -> Matrix:
        self._flush()
        out = IDENTITY
        for _, m in reversed(self.stack):
            out = times(m, out)
        return out


def _add(a: dict, b: dict) -> dict:
    """Two neighbouring parts of one conversation as one."""
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "turns", "parts", "sizes")}
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out["illegal"] += a["last_role"] + b["first_role"] not in ("su", "ua", "au")
    out["first_turn"] = b["first_turn"] if a["first_turn"] is None else a["first_turn"]
    out["last_turn"] = a["last_turn"] if b["last_turn"] is None else b["last_turn"]
    out |= {"conv_id": a["conv_id"], "part": a["part"], "edge": a["edge"] or b["edge"], "first_role": a["first_role"], "last_role": b["last_role"]}
    return out | {"matrix": times(a["matrix"], b["matrix"])}


def _tree(segments: list[dict]) -> dict:
    while len(segments) > 1:
        pairs = [_add(*segments[i : i + 2]) for i in range(0, len(segments) - 1, 2)]
        segments = pairs + segments[len(pairs) * 2 :]
    return segments[0]


def _segment_schema(conv: T.DataType, turn: T.DataType) -> T.StructType:
    longs = ["turns", "blank", "duplicate", "truncated", "illegal"]
    return T.StructType(
        [T.StructField("conv_id", conv), T.StructField("part", T.LongType()), T.StructField("edge", T.BooleanType()), T.StructField("first_turn", turn), T.StructField("last_turn", turn)]
        + [T.StructField(c, T.LongType()) for c in longs]
        + [T.StructField(c, T.StringType()) for c in ("first_role", "last_role")]
        + [T.StructField("parts", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType()))]
        + [T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType()))]
    )


def _arrow(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    s = to_arrow_schema(schema)
    for r in rows:
        if "matrix" in r:
            m = r["matrix"]
            r |= {"costs": [e and e[0] for e in m], "audits": [e and e[1] for e in m]}
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in s], schema=s)


def _segments(schema: T.StructType):
    """One segment for each conversation and partition; edge: it is the first or last of its partition, so it may go on elsewhere."""

    def close(s: dict, product: _Product, edge: bool) -> dict:
        return s | {"matrix": product.value(), "edge": edge, "parts": [s["part"]], "sizes": [s["size"]]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, product, first, out = None, None, True, []
        for b in batches:
            for r in b.to_pylist():
                if s is None or s["conv_id"] != r["conv_id"]:
                    if s is not None:
                        out.append(close(s, product, first))
                        first = False
                    s = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal", "size"), 0)
                    s |= {"conv_id": r["conv_id"], "part": r["part"], "first_turn": None, "last_turn": None, "first_role": r["initial"], "last_role": None}
                    product = _Product()
                role, n = r["initial"], r["n"]
                fault = "D" if r["duplicate"] else "-"
                fault = "B" if r["blank"] else "T" if fault == "-" and r["truncated"] else fault
                s["illegal"] += (s["last_role"] is not None and s["last_role"] + role not in ("su", "ua", "au")) + n - 1
                s["last_role"] = role
                if r["turn"] is not None and r["turn"] != s["last_turn"]:
                    s["turns"] += 1
                    s["last_turn"] = r["turn"]
                    s["first_turn"] = r["turn"] if s["first_turn"] is None else s["first_turn"]
                s["blank"] += n if fault == "B" else 0
                s["duplicate"] += n if fault == "D" else 0 if fault == "B" else n - 1
                s["truncated"] += fault == "T"
                s["size"] += n
                kind = role if role in _STEPS else "-"
                product.add(kind + fault)
                if n > 1:  # copies of the row
                    product.add(kind + ("B" if fault == "B" else "D"), n - 1)
            if len(out) >= 1000:
                yield _arrow(out, schema)
                out = []
        if s is not None:
            out.append(close(s, product, True))
        if out:
            yield _arrow(out, schema)

    return run


def _read(r: dict) -> dict:
    return r | {"matrix": tuple(None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True))}


def _joined(schema: T.StructType):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(map(_read, table.to_pylist()), key=lambda r: r["part"])
        out = _tree(rows)
        return pa.Table.from_batches([_arrow([out | {"part": out["part"] // SPAN}], schema)])

    return run


def _solved(conv: T.DataType) -> tuple:
    schema = T.StructType([T.StructField("conv_id", conv), T.StructField("part", T.LongType()), T.StructField("audit", T.StringType()), T.StructField("at", T.LongType()), T.StructField("system", T.BooleanType()), T.StructField("whole", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The piece of the audit that each partition's turns take, and how many turns of the repaired conversation come before it."""
        for b in batches:
            out = []
            for r in b.to_pylist():
                audit = r["audit"]
                system, lo, at = (len(audit) - audit.count("D")) % 2 == 1, 0, 0
                for k, (part, size) in enumerate(zip(r["parts"], r["sizes"], strict=True)):
                    hi, left = lo, size
                    while left:
                        left -= audit[hi] != "I"
                        hi += 1
                    hi = len(audit) if k + 1 == len(r["parts"]) else hi
                    piece = audit[lo:hi]
                    out.append({"conv_id": r["conv_id"], "part": part, "audit": piece, "at": at, "system": system, "whole": len(r["parts"]) == 1})
                    at, lo = at + len(piece) - piece.count("D"), hi
            yield _arrow(out, schema)

    return run, schema


def _repaired(conv: T.DataType) -> tuple:
    schema = T.StructType([T.StructField("conv_id", conv), T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("edit", T.StringType()), T.StructField("whole", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Turns follow the row with the audit of their conversation's part."""
        head, i, at, out, held = None, 0, 0, [], 0

        def put(role: str | None, text: str, edit: str) -> None:
            nonlocal at, held
            turn = at - head["system"]
            out.append({"conv_id": head["conv_id"], "position": at, "role": role if edit == "K" else "user" if turn % 2 == 0 else "assistant", "text": text, "edit": edit, "whole": head["whole"]})
            at += 1
            held += len(text) + 100

        def inserted() -> None:
            nonlocal i
            while i < len(head["audit"]) and head["audit"][i] == "I":
                put(None, "", "I")
                i += 1

        for b in batches:
            for r in b.to_pylist():
                if r["audit"] is not None:
                    if head is not None:
                        inserted()
                    head, i, at = r, 0, r["at"]
                    continue
                for k in range(r["n"]):
                    inserted()
                    edit = head["audit"][i]
                    i += 1
                    if edit != "D":
                        assert k == 0
                        put(r["role"], r["text"], edit)
                if held > 1 << 22:
                    yield _arrow(out, schema)
                    out, held = [], 0
        if head is not None:
            inserted()
        if out:
            yield _arrow(out, schema)

    return run, schema


def _digests(conv: T.DataType) -> tuple:
    schema = T.StructType([T.StructField("conv_id", conv), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, of = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if h is None or r["conv_id"] != of:
                    if h is not None:
                        out.append({"conv_id": of, "repaired_sha256": h.hexdigest()})
                    h, of = hashlib.sha256(), r["conv_id"]
                else:
                    h.update(b"\n")
                h.update(f"{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
            yield _arrow(out, schema)
        if h is not None:
            yield _arrow([{"conv_id": of, "repaired_sha256": h.hexdigest()}], schema)

    return run, schema


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32 of `conv_id:turn` modulo 20; nulls in the key, role and text become one space.

    0 drops a row, 1 empties its text, 2 removes `[.!?]`, 3 repeats it, 4 makes the role user.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    copies = F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return turns.where(k != 0).select("conv_id", "turn", F.when(k == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of every conversation of turns (conv_id, turn, role, text), as (report, repaired turns).

    Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Repaired: conv_id, position from 0, role, text, edit (K, R or I)
    and whole, false for conversations that lay in several partitions.
    Turns are ordered by turn (nulls first), then role and text, so ties have an order and equal rows stand together; null role and
    text count as one space; a role's initial is its first character, an empty role has none and can't stay; a null conv_id is a conversation of
    its own. A text without other characters than white space is blank, so also an empty one. An empty table gives two empty ones. Other columns are
    not looked at. Equal rows travel as one with their number; a long conversation lies in several partitions, ordered by turn.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    keys = ["conv_id", "turn", "role", "text"]
    rows = turns.select("conv_id", "turn", one("role"), one("text")).groupBy(keys).agg(F.count("*").alias("n"))
    rows = rows.withColumn("_said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    # first turn of what a conversation says again in a later turn
    order = F.struct(F.col("turn").isNotNull().alias("a"), F.col("turn").alias("b"))
    again = rows.select("conv_id", "_said", order.alias("o")).groupBy("conv_id", "_said").agg(F.min("o").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("_said").alias("_key"), "_first")
    rows = rows.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_key")), "left")
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    rows = rows.select(
        *keys,
        "n",
        F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.coalesce(order > F.col("_first"), F.lit(False)).alias("duplicate"),
    )
    rows = cut(rows.sort(keys).withColumn("part", F.spark_partition_id().cast("long")))

    conv, turn = (rows.schema[c].dataType for c in ("conv_id", "turn"))
    schema = _segment_schema(conv, turn)
    narrow = rows.select("conv_id", "turn", "initial", "blank", "duplicate", "truncated", "n", "part")
    segments = cut(narrow.mapInArrow(_segments(schema), schema))
    open_ = segments.where("edge")
    reach = rows.rdd.getNumPartitions()
    while reach > 1:
        open_ = open_.groupBy("conv_id", F.expr(f"part div {SPAN}")).applyInArrow(_joined(schema), schema)
        open_ = cut(open_)
        reach = -(-reach // SPAN)
    whole = segments.where("not edge").unionByName(open_).withColumn("best", _best())
    whole = cut(whole.select("conv_id", (F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), "parts", "sizes"))
    report = whole.withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long")).drop("parts", "sizes")

    f, solved = _solved(conv)
    heads = whole.select("conv_id", "audit", "parts", "sizes").mapInArrow(f, solved)
    both = rows.select(*keys, "n", "part").unionByName(heads, allowMissingColumns=True)
    both = both.repartition("part", "conv_id").sortWithinPartitions("part", "conv_id", F.col("audit").isNull(), "turn", "role", "text")
    f, repaired = _repaired(conv)
    return report, cut(both.mapInArrow(f, repaired))


def _best():
    """(cost, audit) of the least way from the start to an end, inserted turns at the end included."""
    ways = []
    for i in range(4):
        for j in (0, 3):
            if (e := INSERTS[4 * i + j]) is not None:
                ways.append(F.when(F.col("costs")[i].isNotNull(), F.struct((F.col("costs")[i] + e[0]).alias("cost"), F.concat(F.col("audits")[i], F.lit(e[1])).alias("audit"))))
    return F.array_min(F.filter(F.array(*ways), lambda x: x.isNotNull()))


def digest(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of conversations with a repaired turn: SHA-256 of `role:text` of all turns, joined by newlines.

    SHA-256 is one chain over the whole conversation, so one task reads a conversation's turns in order; it holds none of them. Those that lay in
    one partition are hashed where they are.
    """
    f, schema = _digests(repaired.schema["conv_id"].dataType)
    across = repaired.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return repaired.where("whole").mapInArrow(f, schema).unionByName(across.mapInArrow(f, schema))


def audit(conversations: DataFrame) -> DataFrame:
    """Damage conversations, repair them and give one row for each of them: counts, cost, audit and the digest of the repaired turns.

    A conversation without rows after the damage has zeros, an empty audit and the digest of an empty string; so has the digest of one all of whose turns went.
    """
    report, repaired = repair(damage(conversations))
    out = conversations.select(F.col("conv_id").alias("_id")).distinct()
    sums = digest(repaired).withColumnRenamed("conv_id", "_conv")
    out = out.join(report, F.col("_id").eqNullSafe(F.col("conv_id")), "left").join(sums, F.col("_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return out.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def oracle_sql() -> str:
    """The same in DuckDB SQL: a recursion over turns with the four states' least (cost, audit), as text with the cost in front."""
    ins = lambda s: f"lpad((substr({s}, 1, 12)::bigint + {INSERT})::varchar, 12, '0') || substr({s}, 13) || 'I'"
    edit = lambda s, cost, name: f"lpad((substr({s}, 1, 12)::bigint + {cost})::varchar, 12, '0') || substr({s}, 13) || '{name}'"
    more = f"(case when fault = 'truncated' then {TRUNCATED} else 0 end)"

    def take(role: str, s: str) -> str:
        keep = f"case when fault in ('blank', 'duplicate') then null when initial = '{role}' then {edit(s, f'{KEEP} + {more}', 'K')}"
        return keep + (f" else {edit(s, f'{REROLE} + {more}', 'R')} end" if role != "s" else " end")

    crc = "list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::ubigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::ubigint)))"
    return f"""
    with recursive o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
    h as (select *, xor({crc}, 4294967295::ubigint) % 20 as d from o),
    c as (select conv_id, turn, case when d = 4 then 'user' else role end as role, case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when d = 3 then [1, 2] else [1] end) as copy from h where d <> 0),
    n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
        regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) as mark from c),
    r as (select conv_id, i, turn, role, text, role[1] as initial, lag(role[1]) over (partition by conv_id order by i) as before,
        case when mark = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when mark not in ('.', '!', '?') then 'truncated' else '' end as fault from n),
    -- state before a turn with inserted turns: p0 to p3
    w as (select conv_id, 0::bigint as i, lpad('', 12, '0') as s0, null::varchar as s1, null::varchar as s2, null::varchar as s3 from (select distinct conv_id from r)
        union all
        select conv_id, i, {edit("p0", DELETE, "D")}, least({edit("p1", DELETE, "D")}, {take("s", "p0")}),
            least({edit("p2", DELETE, "D")}, {take("u", "p0")}, {take("u", "p1")}, {take("u", "p3")}), least({edit("p3", DELETE, "D")}, {take("a", "p2")})
        from (select q.*, least(q.s3, {ins("p2")}) as p3 from (
            select r.conv_id, r.i, r.fault, r.initial, w.s0 as p0, w.s1 as p1, least(w.s2, {ins("w.s0")}, {ins("w.s1")}, {ins("w.s3")}) as p2, w.s3 as s3
            from w join r on w.conv_id is not distinct from r.conv_id and r.i = w.i + 1) q)),
    e as (select conv_id, least(s0, s3, {ins("s2")}, {ins(ins("s0").replace("s0", "(s0)"))}, {ins(ins("s1").replace("s1", "(s1)"))}) as s from w where i = (select max(r.i) from r where r.conv_id is not distinct from w.conv_id)),
    a as (select conv_id, substr(s, 1, 12)::bigint as cost, substr(s, 13) as audit from e),
    l as (select conv_id, audit, unnest(range(1, length(audit) + 1)) as j from a),
    m as (select conv_id, j, audit[j] as edit, sum((audit[j] <> 'I')::int) over v as i, sum((audit[j] <> 'D')::int) over v as p, length(replace(audit, 'D', '')) % 2 as odd from l window v as (partition by conv_id order by j)),
    t as (select m.conv_id, string_agg((case when edit = 'K' then r.role when (p - odd) % 2 = 1 then 'user' else 'assistant' end) || ':' || (case when edit = 'I' then '' else r.text end), chr(10) order by j) as said
        from m left join r on r.conv_id is not distinct from m.conv_id and r.i = m.i where edit <> 'D' group by m.conv_id),
    f as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate, count_if(fault = 'truncated') as truncated,
        count_if(before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from r group by conv_id)
    select x.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
        coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(said, '')) as repaired_sha256
    from (select distinct conv_id from conversations) x left join f on f.conv_id is not distinct from x.conv_id left join a on a.conv_id is not distinct from x.conv_id left join t on t.conv_id is not distinct from x.conv_id
    """
