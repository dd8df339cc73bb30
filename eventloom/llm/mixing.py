"""Mixing sources to target weights by iterative proportional fitting.

Tokens are added up for each cell (source, language, topic). Raking scales the cells in turn so that each marginal meets its targets;
a document is then kept with the probability of its cell, decided by a hash of its id. Only cell totals, not
documents, are raked: on the driver while they are at most CELLS, beyond that by the same steps as joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.runtime import cut

CELLS = 100_000
DIMENSIONS = ("source", "lang", "topic")
_SPACE = " \t\n\x0b\x0c\r"


def topic(text: str = "text") -> Column:
    """The form of a text, as the topic that a table without topics has: markup, shouting, figures, short or prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)) / n
    return (
        F.when(share("[#*$%&|<>]") > 0.02, "markup")
        .when(share("[A-Z]") > 0.3, "shouting")
        .when(share("[0-9]") > 0.05, "figures")
        .when(n < 500, "short")
        .otherwise("prose")
    )


def tokens(text: str = "text") -> Column:
    """Words of a text, as its token count."""
    t = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, "[\\x20\\x09-\\x0D]+"))).cast("long")


def tempered(totals: pd.Series, power: float) -> pd.Series:
    """Shares in proportion to totals ** power: 1 leaves them, 0 makes them equal."""
    w = np.power(np.maximum(totals.astype(float), 0), power).where(totals > 0, 0.0)
    return w / w.sum() if w.sum() else w


def rake(cells: pd.DataFrame, targets: dict[str, pd.Series], tolerance: float = 1e-9, rounds: int = 500) -> np.ndarray:
    """Weights of cells (columns of DIMENSIONS and tokens) whose weighted marginals meet the targets, as shares of all tokens."""
    w = cells["tokens"].to_numpy(float)
    w = w / w.sum() if w.sum() else w
    codes = {k: t.index.get_indexer(cells[k]) for k, t in targets.items()}
    for _ in range(rounds):
        worst = 0.0
        for k, t in targets.items():
            have = np.bincount(codes[k], weights=w, minlength=len(t))
            factor = np.divide(t.to_numpy(float), have, out=np.zeros(len(t)), where=have > 0)
            worst = max(worst, np.abs(have - t.to_numpy(float)).max(initial=0))
            w = w * factor[codes[k]]
        if worst < tolerance:
            break
    return w


def rake_joined(cells: DataFrame, powers: dict[str, float], tolerance: float = 1e-9, rounds: int = 500) -> DataFrame:
    """The same steps on a cell table of any size: cells with a weight column added."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    w = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    goals = {}
    for k, p in powers.items():
        g = cells.groupBy(k).agg(F.pow(F.sum("tokens").cast("double"), F.lit(p)).alias("goal"))
        goals[k] = cut(g.crossJoin(g.agg(F.sum("goal").alias("all"))).select(F.col(k).alias("__k"), (F.col("goal") / F.col("all")).alias("goal")))
    for _ in range(rounds):
        for k, g in goals.items():
            have = w.groupBy(F.col(k).alias("__k")).agg(F.sum("weight").alias("have")).join(g, "__k")
            w = w.join(have, F.col(k) == F.col("__k")).withColumn("weight", F.when(F.col("have") > 0, F.col("weight") * F.col("goal") / F.col("have")).otherwise(0.0)).drop("__k", "goal", "have")
        w = cut(w)
        worst = [w.groupBy(F.col(k).alias("__k")).agg(F.sum("weight").alias("have")).join(g, "__k").agg(F.max(F.abs(F.col("have") - F.col("goal"))).alias("worst")) for k, g in goals.items()]
        if max((x.first()[0] or 0.0 for x in worst), default=0.0) < tolerance:
            break
    return w


def probabilities(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Keep probabilities, at most 1, in proportion to weight / tokens wherever below 1, that keep `budget` tokens on average."""
    rate = np.divide(weight, tokens, out=np.zeros(len(tokens)), where=tokens > 0)
    p, free = np.zeros(len(tokens)), rate > 0
    left = min(budget, float(tokens[free].sum()))
    while free.any():
        scale = left / float((rate[free] * tokens[free]).sum())
        full = free & (rate * scale >= 1)
        if not full.any():
            p[free] = rate[free] * scale
            break
        p[full] = 1.0
        left -= float(tokens[full].sum())
        free &= ~full
        if left <= 0:
            break
    return np.minimum(p, 1.0)


def mix(docs: DataFrame, powers: dict[str, float] | None = None, keep: float = 0.7, doc: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """docs with topic, n_tokens, probability and kept added; about `keep` of all tokens are kept.

    The target of each dimension is its token share to the power given (0.7 for sources, 0.8 for languages, 0.9 for topics), so large ones yield
    to small ones. Null sources and languages are a value of their own; texts without tokens are always kept, as they
    weigh nothing; rows with equal ids are kept or dropped together if their cells agree. Columns of docs with the added
    names are replaced, except a topic of docs, which is used.
    """
    powers = powers or {"source": 0.7, "lang": 0.8, "topic": 0.9}
    d = docs.drop("n_tokens", "probability", "kept", "weight")
    if "topic" not in d.columns:
        d = d.withColumn("topic", topic(text))
    d = d.withColumn("n_tokens", tokens(text))
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("\0null")).alias(f"__{k}") for k in powers]
    cells = cut(d.groupBy(*keys).agg(F.sum("n_tokens").alias("tokens")))
    names = {f"__{k}": p for k, p in powers.items()}
    if cells.count() <= CELLS:
        local = cells.toPandas()
        targets = {k: tempered(local.groupby(k)["tokens"].sum(), p) for k, p in names.items()}
        local["weight"] = rake(local, targets) if local["tokens"].sum() else 0.0
        local["probability"] = probabilities(local["tokens"].to_numpy(float), local["weight"].to_numpy(float), keep * float(local["tokens"].sum()))
        schema = pa.schema([*((k, pa.string()) for k in names), ("probability", pa.float64())])
        # as Arrow: rows from Python would need workers of another kind
        rates = docs.sparkSession.createDataFrame(pa.Table.from_pandas(local[[*names, "probability"]], schema, preserve_index=False))
        rates = F.broadcast(rates)
    else:
        w = rake_joined(cells, names)
        bounds = cut(w.withColumn("rate", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)))
        total = bounds.where("rate > 0").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        budget = min(keep * float(bounds.agg(F.sum("tokens")).first()[0] or 0), float(total))
        scale, before = 0.0, -1
        while True:  # cells that reach 1 leave their share to the others, until none is left that does
            capped = F.col("rate") * F.lit(scale) >= 1
            n, full, free = bounds.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
            if n <= before or free <= 0 or budget <= full:
                break
            scale, before = (budget - float(full)) / float(free), n
        rates = bounds.select(*names, F.least(F.col("rate") * F.lit(scale), F.lit(1.0)).alias("probability"))
    out = d.withColumns({f"__{k}": F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in powers}).join(rates, list(names), "left").drop(*names)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(doc)), F.lit(1 << 30)) / float(1 << 30)
    p = F.when(F.col("n_tokens") == 0, F.lit(1.0)).otherwise(F.coalesce("probability", F.lit(0.0)))
    return out.withColumn("probability", p).withColumn("kept", draw < F.col("probability"))
