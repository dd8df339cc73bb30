"""Quality classifier: Bradley-Terry pairwise ranking.

Pairs of a better and a worse labelled document give the likelihood prod sigmoid(w . (f(better) - f(worse))); w is
fitted by Newton steps on the logistic loss of the feature differences with a ridge. A document's strength is w . f;
it is accepted above a quantile of the labelled strengths, the one that accepts as many as carry label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
STOP = frozenset(
    "the of and to in a is that for it was on are as with be by this at from or an "
    "de la le et les des en un une du que est pour qui dans par sur au pas avec "
    "der die und das den von zu mit ist ein eine auf für im dem nicht als auch "
    "el los las del y por con para su se no es al lo como".encode().split()
)
FEATURES = ("log_words", "symbols", "bangs", "upper", "digits", "ends", "word_length", "stop_words", "distinct", "runs", "distinct_pairs", "repeated_windows", "longest_run", "repeated_lines", "line_length")


def features(text: str | None) -> np.ndarray:
    """Numbers of one whole text; all but the first are ratios or logarithms in about 0 to 3. Null counts as empty."""
    b = (text or "").encode("utf-8", "replace")
    w = b.split()
    n, size = max(len(w), 1), max(len(b), 1)
    without = lambda drop: (len(b) - len(b.translate(None, drop))) / size
    pairs, triples = set(zip(w, w[1:], strict=False)), set(zip(w, w[1:], w[2:], strict=False))
    runs, longest, here = 0, 0, 0
    for x, y in zip(w, w[1:], strict=False):
        here = here + 1 if x == y else 0
        runs += here > 0
        longest = max(longest, here)
    lines = [x for x in b.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    return np.array(
        [
            np.log1p(len(w)) / 5,
            sum(map(b.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))) / n,
            b.count(b"!!") / n,
            without(_UPPER) / max(without(_LOWER) + without(_UPPER), 1e-9),
            without(_DIGIT),
            without(PUNCTUATION) * 5,
            np.log(sum(map(len, w)) / n + 1),
            sum(map(STOP.__contains__, w)) / n,
            len(set(w)) / n,
            runs / n,
            len(pairs) / max(len(w) - 1, 1),
            1 - len(triples) / max(len(w) - 2, 1) if len(w) > 2 else 0.0,
            np.log1p(longest) / 3,
            1 - len(set(lines)) / k,
            np.log1p(size / k) / 5,
        ]
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float
    slope: float

    def score(self, f: np.ndarray) -> np.ndarray:
        """0 to 1, over 0.5 above the threshold strength."""
        s = self.slope * (((f - self.mean) / self.scale) @ self.weight - self.threshold)
        return 1 / (1 + np.exp(-np.clip(s, -60, 60)))


def fit(f: np.ndarray, label: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, steps: int = 30, seed: int = 7) -> Model:
    """Bradley-Terry weights from `pairs` random pairs of a row with label 1 and a row with label 0.

    Without rows of both labels nothing can be learnt: all weights are 0, and every score is 0.5.
    """
    if len(f) == 0:
        f = np.zeros((1, len(FEATURES)))
        label = np.ones(1, int)
    mean, scale = f.mean(axis=0), np.maximum(f.std(axis=0), 1e-6)
    x = (f - mean) / scale
    good, bad = x[label == 1], x[label == 0]
    if not len(good) or not len(bad):
        return Model(mean, scale, np.zeros(x.shape[1]), 0.0, 1.0)
    rng = np.random.default_rng(seed)
    d = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -60, 60)))
        step = np.linalg.solve((d * (p * (1 - p) + 1e-9)[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = x @ w
    # The quantile that leaves the share of label 0 below; halfway to the next strength above.
    ordered = np.sort(s)
    at = int(round((label == 0).mean() * len(s)))
    threshold = (ordered[max(at - 1, 0)] + ordered[min(at, len(s) - 1)]) / 2
    return Model(mean, scale, w, float(threshold), 1.0)


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "quality", most: int = 20_000) -> Model:
    """Fit on the labelled documents, at most about `most` of them: those with the smallest hashes of their id.

    Rows without a label, or with another than 0 or 1, teach nothing; repeated labels count once.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc).alias("__id"), F.col(label).cast("int").alias("__y")).distinct()
    n = known.count()
    share = min(1.0, most / max(n, 1))
    known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(doc).alias("__id"), F.col(text).alias("t")).join(F.broadcast(known), "__id").select("t", "__y")  # at most about `most` rows are sent

    def make(batches):
        for b in filter(len, batches):
            yield pd.DataFrame({"f": [features(t) for t in b["t"]], "y": b["__y"]})

    got = rows.mapInPandas(make, "f array<double>, y int").toPandas()
    f = np.array(got["f"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort((*f.T, got["y"].to_numpy()))  # so that the order of arrival has no say
    return fit(f[order], got["y"].to_numpy()[order])


def score(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, score and predicted, one row per row of docs; null and empty texts are scored as no words."""

    def rows(batches):
        for b in filter(len, batches):
            s = model.score(np.array([features(t) for t in b["t"]]).reshape(-1, len(FEATURES)))
            yield pd.DataFrame({doc: b["d"].astype("Int64"), "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return docs.select(F.col(doc).cast("long").alias("d"), F.col(text).alias("t")).mapInPandas(rows, f"`{doc}` long, score double, predicted int")
