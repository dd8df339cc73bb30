"""Quality rules: a threshold table compiled into one projection of built-in functions.

No user functions: words, windows and lines are arrays handled by higher-order functions, so a document is
judged inside the scan stage and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus languages (en, fr, de, es), compared as written, in lower case.
STOP_WORDS = (
    "the of and to in a is that for it was on are as with be by this at from or an "
    "de la le et les des en un une du que est pour qui dans par sur au pas avec "
    "der die und das den von zu mit ist des ein eine auf für im dem nicht als auch "
    "el los las del y por con para su se no es al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A document is kept only where `low <= metric <= high`."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Production thresholds.
RULES = (
    Rule("n_words", low=50),
    Rule("mean_word_chars", low=2.0, high=14.0),
    Rule("symbols_per_word", high=0.10),
    Rule("stop_word_ratio", low=0.06),
    Rule("repeat_word_ratio", high=0.50),
    Rule("dup_line_ratio", high=0.50),
)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


#: Metrics that rules may name, over the columns of `measures`.
METRICS = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "word_chars": lambda: F.col("word_chars").cast("double"),
    "mean_word_chars": lambda: _ratio("word_chars", "n_words"),
    "symbols_per_word": lambda: _ratio("n_symbols", "n_words"),
    "stop_word_ratio": lambda: _ratio("n_stop_words", "n_words"),
    "repeat_word_ratio": lambda: _ratio("n_repeat_words", "n_words"),
    "dup_line_ratio": lambda: _ratio("n_dup_lines", "n_lines"),
}


def compile_rules(rules=RULES) -> Column:
    """The threshold table as one boolean column."""
    out = F.lit(True)
    for r in rules:
        m = METRICS[r.metric]()
        if r.low is not None:
            out = out & (m >= F.lit(float(r.low)))
        if r.high is not None:
            out = out & (m <= F.lit(float(r.high)))
    return out


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `q_*`-free measure columns added: n_words, word_chars, n_symbols, n_stop_words, n_lines, n_dup_lines,
    n_repeat_words (all long).

    Null text counts as empty: all measures are 0. Columns of docs whose names clash with a measure are replaced.
    Three-word windows are compared by a 64-bit hash of their words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    spaces = "[\\x20\\x09-\\x0D]+"
    made = ["n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words"]
    d = docs.drop(*[c for c in made if c != text])
    d = d.withColumn("__t", F.btrim(t, F.lit(SPACE)))
    d = d.withColumn("__w", F.when(F.col("__t") == "", F.array().cast("array<string>")).otherwise(F.split("__t", spaces)))
    d = d.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    windows = F.transform(
        F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(F.col("__w"), i + 1), F.get(F.col("__w"), i + 2)),
    )
    d = d.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_stop_words": F.size(F.filter("__w", lambda w: w.isin(STOP_WORDS))).cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "__h": windows,
        }
    )
    # Only where some window repeats are the positions sorted along with the hashes.
    tagged = F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("__p", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), tagged))
    again = F.filter("__p", lambda x, j: F.coalesce(x["h"] == F.get(F.col("__p"), j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(F.col("__p"), j + 1)["h"], F.lit(False)))
    d = d.withColumn("__p", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        "__p",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    # The row number, always 0 here, keeps a later filter on the measures above this projection: pushed below, it would
    # copy the arrays' expressions into the lambdas and evaluate them for every word.
    here = F.least(F.monotonically_increasing_id(), F.lit(0).cast("long"))
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long") + here)
    return d.drop("__t", "__w", "__l", "__h", "__p")


def judge(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """`measures` plus base_failed (under 50 words, or over half of the words in repeated windows) and kept.

    An empty or null text has no words, so it fails. Repeated rows are judged each by itself, in the same way.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs.drop("base_failed", "kept"), text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def oracle_sql() -> str:
    """DuckDB SQL for the query's rows, with the production table written out."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t
), g AS (
  SELECT rid, i, words[i] || chr(0) || words[i + 1] || chr(0) || words[i + 2] AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), r AS (
  SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, win) > 1
), c AS (
  SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 50 AND word_chars / n_words::DOUBLE BETWEEN 2.0 AND 14.0 AND n_symbols / n_words::DOUBLE <= 0.10
  AND n_stop_words / n_words::DOUBLE >= 0.06 AND n_repeat_words / n_words::DOUBLE <= 0.50
  AND (n_lines = 0 OR n_dup_lines / n_lines::DOUBLE <= 0.50) AS kept
FROM b
"""
