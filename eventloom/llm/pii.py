"""Personal data: patterns for direct identifiers, and information-theoretic sanitisation of what gives them away.

Every identifier found is a protected entity. Co-occurrence over whole texts estimates how strongly a term reveals it:
PMI(e, t) = log2(N n_et / (n_e n_t)) against the entity's own information IC(e) = log2(N / n_e), where n_et, n_e and
n_t count documents and N is all of them. A term whose PMI
reaches the share `threshold` of IC for some entity discloses it, if the two meet in at least two different texts and chance
would bring that about in at most `level` of all cases, divided by the number of pairs that are tried: one text with an identifier
tells nothing about the words beside it. Wherever it stands, a disclosing term climbs a ladder: its kind and length, its kind alone; it becomes the
first rung that discloses none of its entities by the same measure, and is removed where both do. Counts cover all documents. Candidate
terms reach the tasks as a bitmap of fixed size that only leaves terms out early; an exact join follows.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.runtime import cut

KINDS = ("email", "ip", "card", "phone", "term")
# The contract's patterns in forms that take linear time: an address is looked for around its @, and four numbers from where a run of
# digits starts (a match that starts within a run could start with it as well, and none ends within one).
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W_]+")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Bits of the bitmap, and of each of the regions it is put together from.
BITS, REGION = 1 << 26, 1 << 18
#: Terms that a task counts before it passes them on.
TALLY = 100_000


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[0::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def _emails(text: str):
    """(start, end) of addresses, leftmost first, none over another; each stretch between two @ is read a bounded number of times."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done  # after the last address, the last @, and whatever no local part holds
        for m in _NOT_LOCAL.finditer(text, done, at):
            start = m.end()
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all direct identifiers, in code points, sorted."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(d) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _terms(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, term) of all terms of the text that touch none of the identifiers."""
    out, i, end = [], 0, 0
    for m in _TERM.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            end, i = max(end, spans[i][2]), i + 1
        if m.start() >= end:
            out.append((m.start(), m.end(), m[0].lower()))
    return out


def _bag(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    return {t for _, _, t in _terms(text, spans)} if spans else {t.lower() for t in set(_TERM.findall(text))}


class _Rungs(dict):
    """The narrow rung of each term: its kind and length; the wide rung is the kind alone."""

    def __missing__(self, term: str) -> str:
        if len(self) > 200_000:
            self.clear()
        kind = "word" if term.isalpha() else "number" if term.isdecimal() else "code"
        size = "short" if len(term) < 4 else "middling" if len(term) < 8 else "long"
        self[term] = rung = sys.intern(f"<{size} {kind}>")
        return rung


def wide(rung: Column) -> Column:
    return F.concat(F.lit("<"), F.element_at(F.split(rung, " "), 2))


def _entity(text: str, kind: int, start: int, end: int) -> str:
    value = text[start:end]
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else _NOT_DIGIT.sub('', value)}"


def _spot(terms: list[str]) -> np.ndarray:
    return (np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, terms)), ">u8").astype(np.uint64) & np.uint64(BITS - 1)).astype(np.int64)


def _input(docs: DataFrame, doc: str, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(t).alias("key"), t.alias("t"))


def _bitmap(terms: DataFrame):
    """The terms as a broadcast bitmap of BITS bits: at most that many bits reach the driver, whatever the corpus."""

    def spots(batches):
        for b in filter(len, batches):
            x = np.unique(_spot(b["term"].tolist()))
            yield pd.DataFrame({"region": (x // REGION).astype(np.int32), "spot": (x % REGION).astype(np.int32)})

    def packed(g: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(REGION, bool)
        bits[g["spot"].to_numpy()] = True
        return pd.DataFrame({"region": g["region"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})

    found = terms.select("term").mapInPandas(spots, "region int, spot int").distinct().groupBy("region").applyInPandas(packed, "region int, bits binary")
    bitmap = np.zeros((BITS // REGION, REGION // 8), np.uint8)
    for r in (rows := found.collect()):
        bitmap[r["region"]] = np.frombuffer(r["bits"], np.uint8)
    return terms.sparkSession.sparkContext.broadcast(bitmap.reshape(-1) if rows else None)


def _lots(b: pd.DataFrame, rows: int = 1000):
    """A batch in parts, so that the sets of terms of few texts are held at a time."""
    for i in range(0, len(b), rows):
        yield b.iloc[i : i + rows]


def _known(bitmap: np.ndarray, terms: list[str]) -> set[str]:
    """Those of the terms whose bits are set."""
    if not terms:
        return set()
    x = _spot(terms)
    return {terms[i] for i in np.flatnonzero(bitmap[x >> 3] >> (7 - (x & 7)).astype(np.uint8) & 1)}


@lru_cache(100_000)
def chance(n: int, n_e: int, n_t: int, n_et: int) -> float:
    """Probability that n_e and n_t of n texts, drawn without regard to each other, have at least n_et in common."""

    def choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    p = 0.0
    for i in range(max(n_et, n_e + n_t - n), min(n_e, n_t) + 1):
        q = math.exp(choose(n_e, i) + choose(n - n_e, n_t - i) - choose(n, n_t))
        p += q
        if i * n > n_e * n_t and q < 1e-12 * p:
            break
    return min(p, 1.0)


def _scan(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, key, base, entities, terms, rungs) of every row: its identifiers; for rows with any, their values, and the terms and rungs around them."""

    def scan(batches):
        rungs = _Rungs()
        for b in filter(len, batches):
            base, entities, terms, kinds = [], [], [], []
            for t in b["t"]:
                spans = find_base(t)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                bag = sorted(_bag(t, spans)) if spans else None
                entities.append(sorted({_entity(t, kind, start, end) for start, kind, end in spans}) if spans else None)
                terms.append(" ".join(bag) if spans else None)
                kinds.append(sorted(set(map(rungs.__getitem__, bag))) if spans else None)
            yield pd.DataFrame({"doc": b["doc"].astype("Int64"), "key": b["key"], "base": base, "entities": entities, "terms": terms, "rungs": kinds})

    schema = "doc long, key long, base array<struct<start:long,kind:int,end:long>>, entities array<string>, terms string, rungs array<string>"
    return cut(_input(docs, doc, text).mapInPandas(scan, schema))


def disclosing_terms(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = 0.95, level: float = 0.01, scanned: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(terms, places): the terms that give an entity away, with the share of its information and the mark that replaces
    them (empty: removed); and every place (doc, key, start, end, term) of such a term.

    `level`: chance of meeting as often in some pair, if no pair had regard to each other. It counts
    different texts, so copies are no evidence. A corpus without identifiers has no such terms. `key` is the hash of the text: equal rows share
    places; equal shares need no order; an empty table gives two empty ones. `scanned`: what `_scan` gave for docs.
    """
    d = _input(docs, doc, text)
    scanned = _scan(docs, doc, text) if scanned is None else scanned
    # One row for each different text with identifiers, and how many documents have it.
    seen = scanned.where("entities is not null").groupBy("key").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("entities", "terms", "rungs")))
    each = seen.select("key", "n", F.explode("entities").alias("entity"))
    n_e = cut(each.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("e_texts")))
    tried = seen.agg(F.sum(F.size("entities").cast("double") * F.size(F.split("terms", " "))).alias("n")).first()["n"] or 1.0
    # Only entities of several texts can show anything.
    each = each.join(n_e.where("e_texts > 1").select("entity"), "entity")
    seen = cut(seen.join(each.select("key").distinct(), "key", "left_semi"))
    total = max(docs.count(), 2)
    n = F.lit(float(total))
    # As n_et is n_e at most, a term in more documents than `bound` cannot reach the threshold for any entity of the text. It is in as many as
    # texts with identifiers hold it, at least; what is left of the terms is counted over all documents.
    bound = F.pow(n, F.lit(1 - threshold)) * F.pow(F.col("most"), F.lit(threshold)) * 1.001
    most = each.join(n_e, "entity").groupBy("key").agg(F.max("n_e").alias("most"))
    words = F.explode(F.split("terms", " ")).alias("term")
    own = seen.join(most, "key").select("key", "n", bound.alias("bound"), words).where("term <> ''")
    several = own.groupBy("term").agg(F.count("*").alias("texts"), F.sum("n").alias("least")).where("texts > 1").select("term", "least")
    own = own.join(several, "term").where("least <= bound").select("key", "term", "least")
    # a pair needs two texts of its own; only terms of such pairs are counted in all documents
    n_et = own.join(each, "key").groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("texts"), F.first("least").alias("least")).where("texts > 1")
    # nor can a pair reach the threshold with more documents than it would if only texts with identifiers held the term
    reach = F.pow(n / F.col("n_e"), F.lit(threshold)) <= n * F.col("n_et") / (F.col("n_e") * F.col("least")) * 1.001
    n_et = cut(n_et.join(n_e.select("entity", "n_e"), "entity").where(reach).select("entity", "term", "n_et", "texts"))
    sent = _bitmap(n_et.select("term").distinct())

    def frequencies(batches):
        bitmap, rungs = sent.value, _Rungs()
        n: Counter = Counter()
        for b in filter(len, batches):
            for lot in _lots(b) if bitmap is not None else ():
                bags = [_bag(t, find_base(t)) for t in lot["t"]]
                known = _known(bitmap, list(set().union(*bags)))
                for bag in bags:
                    n.update(known & bag)
                    narrow = set(map(rungs.__getitem__, bag))
                    n.update(narrow)
                    n.update({f"<{x.partition(' ')[2]}" for x in narrow})
            if len(n) > TALLY:
                yield pd.DataFrame({"term": list(n), "n": list(n.values())})
                n.clear()
        if n:
            yield pd.DataFrame({"term": list(n), "n": list(n.values())})

    def telling(batches):
        rungs = _Rungs()
        for b in filter(len, batches):
            p = np.array([chance(*x) for x in zip(*(b[c].tolist() for c in ("n", "n_e", "n_t", "n_et")), strict=True)])
            b = b[p <= level / tried]
            yield b[["entity", "term", "share"]].assign(narrow=b["term"].map(rungs).astype(object))

    n_t = cut(d.select("t").mapInPandas(frequencies, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t")))
    pmi = F.log2(n * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    share = F.round(pmi / F.greatest(F.log2(n / F.col("n_e")), F.lit(1e-9)), 9)
    pairs = n_et.join(n_t, "term").join(n_e, "entity").withColumn("share", share).where(F.col("share") >= threshold)
    copies = F.col("n_et") - F.col("texts")
    pairs = pairs.select("entity", "term", "share", (F.lit(total) - copies).alias("n"), F.col("e_texts").alias("n_e"), (F.col("n_t") - copies).alias("n_t"), F.col("texts").alias("n_et"))
    # One Python step: a task with two of them holds two workers, and executors keep as many for all that follows.
    pairs = cut(pairs.mapInPandas(telling, "entity string, term string, share double, narrow string"))
    # How much each rung tells of each entity; rungs are a dozen.
    kinds = seen.select("key", "rungs", F.transform("rungs", wide).alias("w")).select("key", F.explode(F.array_distinct(F.concat("rungs", "w"))).alias("term"))
    rungs = kinds.join(each, "key").groupBy("entity", "term").agg(F.sum("n").alias("n_et")).join(n_t, "term").join(n_e, "entity").select("entity", F.col("term").alias("rung"), share.alias("tells"))
    steps = pairs.select("entity", "term", F.posexplode(F.array("narrow", wide(F.col("narrow")))).alias("step", "rung")).join(rungs, ["entity", "rung"], "left")
    steps = steps.groupBy("term", "step", "rung").agg(F.max(F.coalesce("tells", F.lit(0.0))).alias("tells")).where(F.col("tells") < threshold)
    steps = steps.groupBy("term").agg(F.min(F.struct("step", "rung"))["rung"].alias("mark"))
    terms = pairs.groupBy("term").agg(F.max("share").alias("share")).join(steps, "term", "left")
    terms = cut(terms.select("term", "share", F.coalesce("mark", F.lit("")).alias("mark")))
    wanted = _bitmap(terms)

    def places(batches):
        bitmap = wanted.value
        for b in filter(len, batches):
            rows = []
            for lot in _lots(b) if bitmap is not None else ():
                bags = [{t.lower() for t in set(_TERM.findall(t))} for t in lot["t"]]
                known = _known(bitmap, list(set().union(*bags)))
                for i, key, t, bag in zip(lot["doc"], lot["key"], lot["t"], bags, strict=True) if known else ():
                    if not known.isdisjoint(bag):
                        rows += [(i, key, start, end, x) for start, end, x in _terms(t, find_base(t)) if x in known]
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "key", "start", "end", "term"]).astype({"doc": "Int64"})

    found = d.mapInPandas(places, "doc long, key long, start long, end long, term string")
    return terms, found.join(terms.select("term"), "term", "left_semi").distinct()


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _name(s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per row of docs: doc, key, base and spans (arrays of struct(start, kind, end), sorted).

    spans holds the direct identifiers and the disclosing terms outside them; how goes to `disclosing_terms`. Null and
    empty texts have none, equal texts the same, repeated rows a row each; an empty table gives an empty one. Other columns of docs are ignored.
    """
    rows = _scan(docs, doc, text)
    terms, places = disclosing_terms(docs, doc, text, scanned=rows, **how)
    extra = places.groupBy("doc", "key").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end")).alias("extra"))
    extra = extra.select(F.col("doc").alias("f"), F.col("key").alias("k"), "extra")
    free = F.filter("extra", lambda x: ~F.exists("base", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    rows = rows.join(extra, (rows["key"] == extra["k"]) & rows["doc"].eqNullSafe(extra["f"]), "left")
    spans = F.when(F.col("extra").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", free)))
    return rows.select("doc", "key", "base", spans.alias("spans"))


def report(docs: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc, n_email, n_ip, n_card, n_phone, n_term, base_sha256 and spans as text, one row per row of docs."""
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    n = {f"n_{k}": count(i) for i, k in enumerate(KINDS)}
    out = find(docs, doc, text, **how).withColumns(n)
    return out.select(F.col("doc").alias(doc), *n, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with identifiers in `text` replaced by `<kind>`, disclosing terms by a rung such as `<long word>` or `<code>`, or removed.

    Keeps every row and column; n_chars, where there is one, is counted anew. A null text stays null.
    """
    terms, places = disclosing_terms(docs, doc, text, **how)
    hits = places.join(terms.select("term", "mark"), "term")
    hits = hits.groupBy("doc", "key").agg(F.collect_set(F.struct("start", "end", "mark")).alias("__hits"))
    hits = hits.select(F.col("doc").alias("__f"), F.col("key").alias("__k"), "__hits")

    @F.pandas_udf("string")
    def clean(t: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for x, h in zip(t, hits, strict=True):
            if x is None:
                out.append(None)
                continue
            spans, at, parts = [], 0, []
            for s, k, e in find_base(x):
                if not spans or s >= spans[-1][1]:
                    spans.append((s, e, f"<{KINDS[k]}>"))
                elif e > spans[-1][1]:  # overlapping kinds: one mark for both
                    spans[-1] = (spans[-1][0], e, spans[-1][2])
            base = list(spans)
            for r in h if h is not None else ():
                if not any(s < r["end"] and r["start"] < e for s, e, _ in base):
                    spans.append((r["start"], r["end"], r["mark"]))
            for s, e, mark in sorted(spans):
                parts += [x[at:s], mark]
                at = e
            out.append("".join([*parts, x[at:]]))
        return pd.Series(out, dtype=object)

    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    cond = (key == F.col("__k")) & docs[doc].cast("long").eqNullSafe(F.col("__f"))
    out = docs.join(hits, cond, "left").withColumn(text, clean(F.col(text), F.col("__hits"))).drop("__f", "__k", "__hits")
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns and text != "n_chars" else out.select(*docs.columns)
