"""Divergence of the sources of a language by joint histograms of term counts.

Terms are counted once for each (language, source). For two sources, what matters of a term is its pair of counts, so per pair of sources the
distinct (count, count) combinations are tallied, those with a zero by subtraction from each source's own histogram of
counts; the measure is evaluated once a combination and multiplied. All arithmetic is on integers and decimals without fractions.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.runtime import cut

#: Entries of counts that a task holds before it hands them on, and pairs of counts that it looks at together.
HELD, PAIRS = 800_000, 4_000_000
#: Letters in lower case and all bytes of other characters stay, the rest becomes a space.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, n_docs) of the batches, added up as far as HELD allows.

    Only the sum of n_docs over a language's sources matters, so the first of them gets all of it.
    """
    held: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    docs: dict[str, Counter] = defaultdict(Counter)

    def handed() -> Iterator[pa.RecordBatch]:
        for lang, sources in held.items():
            spread = docs[lang]
            for source, n in sources.items():
                terms, size = list(n), len(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(pa.scalar(lang, pa.string()), size),
                        pa.repeat(pa.scalar(source, pa.string()), size),
                        pa.array(terms, pa.binary()).cast(pa.string()),
                        pa.array(np.fromiter(n.values(), np.int64, size)),
                        pa.array(np.fromiter((spread.pop(t, 0) for t in terms), np.int64, size)),
                    ],
                    names=["lang", "source", "term", "n", "n_docs"],
                )
        held.clear()
        docs.clear()

    for b in batches:
        langs, sources = b["lang"].to_pylist(), b["source"].to_pylist()
        for lang, source, text in zip(langs, sources, b["text"].cast(pa.binary()), strict=True):
            words = text.as_py().translate(_LETTERS).split()
            held[lang][source].update(words)
            docs[lang].update(set(words))
        if sum(len(n) for x in held.values() for n in x.values()) > HELD:
            yield from handed()
    yield from handed()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences of each term, and documents that hold it; null text, lang and source count as ''."""
    d = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = d.mapInArrow(_count, "lang string, source string, term string, n long, n_docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, total, first): terms in at least `least` documents of their language; total: occurrences there; first: one row a term.

    The rows of a term are as many as sources that hold it. They lie in one partition, ordered by source.
    """
    w = Window.partitionBy("lang", "term")
    rows = counts.repartition("lang", "term").select(
        "lang", "source", "term", "n", F.sum("n").over(w).alias("total"), F.sum("n_docs").over(w).alias("n_docs"), F.row_number().over(w.orderBy("source")).alias("first")
    )
    return rows.where(F.col("n_docs") >= least).select("lang", "source", "term", "n", "total", (F.col("first") == 1).alias("first")).sortWithinPartitions("lang", "term", "source")


def smoothed(count: Column, all_: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (all + 2 terms)), exact for any count."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    below = (all_ + 2 * terms).cast("decimal(19,0)")
    return 1 + F.call_function("div", top, below)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so a long holds the square."""
    p, q = p.cast("long"), q.cast("long")
    return F.call_function("div", (p - q) * (p - q), p + q)


class _Tally:
    """How often each (a, b, na, nb) was seen; numbers of sources for a and b. Keys are packed into one integer where they fit."""

    def __init__(self):
        self.rows: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, rows: np.ndarray) -> None:
        self.waiting.append(rows)
        self.held += rows.shape[1]
        if self.held > PAIRS:
            self.settle()

    def settle(self) -> None:
        some = [np.vstack([x, np.ones((1, x.shape[1]), np.int64)]) for x in self.waiting]
        rows = np.concatenate([*self.rows, *some], axis=1) if self.rows or some else np.zeros((5, 0), np.int64)
        self.waiting.clear()
        self.held = 0
        bits = [int(x.max(initial=0)).bit_length() for x in rows[:4]]
        if sum(bits) < 63:
            key = rows[0]
            for x, n in zip(rows[1:4], bits[1:], strict=True):
                key = (key << n) | x
            key, m = _summed(key, rows[4])
            parts = []
            for n in reversed(bits[1:]):
                parts.append(key & ((1 << n) - 1))
                key = key >> n
            self.rows = [np.stack([key, *reversed(parts), m])]
        else:
            order = np.lexsort(rows[3::-1])
            rows = rows[:, order]
            new = np.flatnonzero(np.concatenate([[True], (rows[:4, 1:] != rows[:4, :-1]).any(axis=0)]))
            self.rows = [np.vstack([rows[:4, new], np.add.reduceat(rows[4], new)])]


def _summed(key: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return key, m
    order = np.argsort(key, kind="stable")
    key, m = key[order], m[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[new], np.add.reduceat(m, new)


def _combinations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, na, nb, m): how many terms have the counts na and nb in sources a < b, both above zero, added up as far as PAIRS allows.

    Batches are ordered by lang, term and source. Row i and row i + d of one term make a pair; d runs over as many rows as the term has.
    """
    ids: dict[tuple[str, str], int] = {}
    tally = _Tally()

    def out() -> Iterator[pa.RecordBatch]:
        tally.settle()
        names = list(ids)
        langs, sources = (np.array([x[i] for x in names], object) for i in (0, 1))
        for x in tally.rows:
            columns = [pa.array(langs[x[0]], pa.string()), pa.array(sources[x[0]], pa.string()), pa.array(sources[x[1]], pa.string()), *map(pa.array, x[2:])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "na", "nb", "m"])
        tally.rows = []

    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b.select(["lang", "source", "term", "n"])])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        last = pc.and_(pc.equal(t["lang"], t["lang"][-1]), pc.equal(t["term"], t["term"][-1])).to_numpy(zero_copy_only=False)
        whole = int(np.argmax(last))  # the last term may go on in the next batch
        rest, t = t.slice(whole), t.slice(0, whole)
        _pairs(t, ids, tally)
        if tally.rows and tally.rows[0].shape[1] > PAIRS // 2:
            yield from out()
    if rest is not None:
        _pairs(rest, ids, tally)
    if ids:
        yield from out()


def _pairs(t: pa.Table, ids: dict[tuple[str, str], int], tally: _Tally) -> None:
    """Adds (a, b, na, nb) of all rows of one term that are d apart, d = 1, 2, ..."""
    if t.num_rows < 2:
        return
    lang, term, source = (t[c].combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
    lang_of, source_of = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
    both = lang_of * len(source.dictionary) + source_of
    used, at = np.unique(both, return_inverse=True)
    langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
    numbers = [ids.setdefault((langs[k // len(sources)], sources[k % len(sources)]), len(ids)) for k in used.tolist()]
    number = np.array(numbers, np.int64)[at]
    group = lang_of * len(term.dictionary) + term.indices.to_numpy()
    n = t["n"].to_numpy().astype(np.int64)
    d = 1
    while d < len(group) and len(i := np.flatnonzero(group[d:] == group[:-d])):
        tally.add(np.stack([number[i], number[i + d], n[i], n[i + d]]))
        d += 1


def audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of docs (columns text, lang, source).

    Part `pair`: the gap to each other source of the language, summed over all its kept terms (0 without any). Part `term`: the kept terms that
    the source has and uses more than its language does, by their gap, the first `top`. Ranks start at 1 in each group and part,
    value descending, then item ascending by UTF-8; equal values so have an order. Null text, lang and source count as ''; groups
    without terms take part; repeated rows count as documents of their own; an empty table gives an empty one; other columns are not looked at.
    """
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    kept = cut(kept_terms(term_counts(docs), least))
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_all"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("all"), F.count("*").alias("held"))
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = cut(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("all", "held", "terms", "lang_all"))))

    p, q = smoothed(F.col("n"), F.col("all"), F.col("terms")), smoothed(F.col("total"), F.col("lang_all"), F.col("terms"))
    own = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    own = own.select("lang", "source", F.lit("term").alias("part"), "item", gap(F.col("p"), F.col("q")).alias("value"))

    between = _between(kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    own = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return own.unionByName(between.withColumn("rank", F.row_number().over(order)))


def _between(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language, from the histograms of unordered ones."""
    both = kept.mapInArrow(_combinations, "lang string, a string, b string, na long, nb long, m long")
    both = cut(both.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m")))
    own = kept.groupBy("lang", "source", F.col("n")).agg(F.count("*").alias("m"))
    side = groups.select("lang", F.col("source").alias("a"), F.col("all").alias("all_a"), F.col("held").alias("held_a"), "terms")
    other = groups.select("lang", F.col("source").alias("b"), F.col("all").alias("all_b"), F.col("held").alias("held_b"))
    pairs = side.join(other, "lang").where("a < b")
    pairs = cut(pairs)
    # terms of one source alone: its own histogram, less what it shares with the other
    only_a = pairs.select("lang", "a", "b").join(own.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.col("n").alias("na"), F.lit(0).cast("long").alias("nb"), "m")
    only_b = pairs.select("lang", "a", "b").join(own.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"), "m")
    less_a = both.select("lang", "a", "b", "na", F.lit(0).cast("long").alias("nb"), (-F.col("m")).alias("m"))
    less_b = both.select("lang", "a", "b", F.lit(0).cast("long").alias("na"), "nb", (-F.col("m")).alias("m"))
    # terms of neither: all, less those of each, plus those of both
    none = pairs.select("lang", "a", "b", F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"), (F.col("terms") - F.col("held_a") - F.col("held_b")).alias("m"))
    shared = both.select("lang", "a", "b", F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"), "m")
    cells = both.select("lang", "a", "b", "na", "nb", "m")
    for x in (only_a, only_b, less_a, less_b, none, shared):
        cells = cells.unionByName(x)
    cells = cells.groupBy("lang", "a", "b", "na", "nb").agg(F.sum("m").alias("m")).where("m <> 0")
    cells = cells.join(pairs, ["lang", "a", "b"])
    pa_, pb = smoothed(F.col("na"), F.col("all_a"), F.col("terms")), smoothed(F.col("nb"), F.col("all_b"), F.col("terms"))
    value = cells.select("lang", "a", "b", "m", pa_.alias("p"), pb.alias("q")).groupBy("lang", "a", "b").agg(F.sum(F.col("m") * gap(F.col("p"), F.col("q"))).alias("value"))
    value = pairs.select("lang", "a", "b").join(value, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
    ways = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    return value.select("lang", "value", F.explode(ways).alias("x")).select("lang", "x.source", "x.item", "value")


def oracle_sql() -> str:
    """The same in DuckDB SQL, every kept term of every pair of sources by itself."""
    p = "1 + (1000000000::hugeint * ({0} + 2)) // ({1} + 2 * v.terms)"
    return f"""
    with d as (select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
    w as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from d),
    c as (select id, lang, source, term, count(*) as n from w group by all),
    t as (select lang, term, sum(n)::hugeint as total from c group by lang, term having count(*) >= 10),
    k as (select lang, source, term, sum(n)::hugeint as n from c join t using (lang, term) group by all),
    g as (select distinct lang, source from d),
    v as (select lang, count(term) as terms, coalesce(sum(total), 0)::hugeint as lang_all from (select distinct lang from g) left join t using (lang) group by lang),
    s as (select g.lang, g.source, coalesce(sum(n), 0)::hugeint as all_ from g left join k using (lang, source) group by all),
    x as (select s.lang, s.source, t.term, coalesce(k.n, 0) as n, {p.format("coalesce(k.n, 0)", "s.all_")} as p, {p.format("t.total", "v.lang_all")} as q
        from s join v using (lang) join t using (lang) left join k using (lang, source, term)),
    pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
        from s a join s b on a.lang = b.lang and a.source <> b.source
        left join (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
            from x a join x b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) f
        on f.lang = a.lang and f.source = a.source and f.item = b.source),
    term as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // (p + q) as value from x where n > 0 and p > q),
    r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from term))
    select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 10
    """
