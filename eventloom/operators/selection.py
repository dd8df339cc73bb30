"""Quality queries with funnel statistics, derived features, preprocessing presets and triggers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.expressions import ExpressionError, compile_expression


@dataclass(frozen=True)
class QualityQuery:
    """Ordered (name, expression) criteria; all must hold. Null and NaN fail a comparison."""

    criteria: tuple[tuple[str, str], ...]
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)

    def columns(self, df: DataFrame) -> list[Column]:
        return [F.coalesce(c, F.lit(False)) for c in self._plain(df)]

    def _plain(self, df: DataFrame) -> list[Column]:
        return [compile_expression(e, dict(df.dtypes), self.functions) for _, e in self.criteria]

    def mask(self, df: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, self.columns(df), F.lit(True))

    def vector(self, df: DataFrame) -> Column:
        """All criteria of a row as an array."""
        return F.array(*self.columns(df))

    def select(self, df: DataFrame) -> DataFrame:
        """Rows that pass; criteria on plain columns reach the scan."""
        return reduce(DataFrame.where, self._plain(df), df)

    def funnel(self, df: DataFrame) -> DataFrame:
        """criteria, counts, cumulative_counts: TOTAL first, in one pass over df."""
        cols = self.columns(df)
        both = [reduce(lambda a, b: a & b, cols[: i + 1]) for i in range(len(cols))]
        aggs = [F.count("*").alias("c0"), F.count("*").alias("k0")]
        aggs += [F.count_if(c).alias(f"c{i + 1}") for i, c in enumerate(cols)] + [F.count_if(c).alias(f"k{i + 1}") for i, c in enumerate(both)]
        names = ["TOTAL", *(n for n, _ in self.criteria)]
        rows = F.array(*[F.struct(F.lit(n).alias("criteria"), F.col(f"c{i}").alias("counts"), F.col(f"k{i}").alias("cumulative_counts")) for i, n in enumerate(names)])
        return df.agg(*aggs).select(F.inline(rows))


def add_statistics(funnels: DataFrame) -> DataFrame:
    """Funnels of several inputs added up."""
    return funnels.groupBy("criteria").agg(F.sum("counts").alias("counts"), F.sum("cumulative_counts").alias("cumulative_counts"))


def generate_features(df: DataFrame, features: list[tuple[str, str]], functions: dict[str, Callable[..., Column]] | None = None) -> DataFrame:
    """Derived columns in order; later ones may use earlier ones. A name that is there already is an error."""
    for name, expression in features:
        if name in df.columns:
            raise ExpressionError(f"column {name} is there already")
        df = df.withColumn(name, compile_expression(expression, dict(df.dtypes), functions))
    return df


@dataclass(frozen=True)
class EventPreprocessor:
    """Rename, derive, select rows, project: in that order."""

    renames: dict[str, str] = field(default_factory=dict)
    features: tuple[tuple[str, str], ...] = ()
    quality: QualityQuery = QualityQuery(())
    output: tuple[str, ...] = ()

    def __call__(self, df: DataFrame) -> DataFrame:
        df = generate_features(df.withColumnsRenamed(self.renames), list(self.features))
        df = self.quality.select(df)
        return df.select(*self.output) if self.output else df


#: Named presets; `register` adds more.
FEATURE_SETS: dict[str, EventPreprocessor] = {}


def register(name: str, preset: EventPreprocessor) -> None:
    if name in FEATURE_SETS:
        raise ValueError(f"feature set {name} is there already")
    FEATURE_SETS[name] = preset


IMAGE_QUALITY = QualityQuery((("has charge", "image_sum > 0"), ("has pixels", "n_pixels > 1")))
STEREO_QUALITY = QualityQuery((("more than 50 p.e.", "hillas_intensity > 50"), ("positive width", "hillas_width > 0"), ("more than 3 pixels", "morphology_n_pixels > 3")))
RING_QUALITY = QualityQuery((("finite radius", "isfinite(radius)"), ("ring pixels", "ring_pixels > 50"), ("contained", "containment > 0.5")))


def valid_rows(df: DataFrame, features: list[str]) -> Column:
    """Whether no feature is null or NaN."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in features], F.lit(True))


def to_float32(c: Column) -> Column:
    """As a 32-bit float; infinities become its largest numbers, NaN stays."""
    top = 3.4028234663852886e38
    return F.when(F.isnan(c), c).otherwise(F.greatest(F.least(c.cast("double"), F.lit(top)), F.lit(-top))).cast("float")


def software_trigger(tel_events: DataFrame, event: list[str], kind: str, least_of_kind: dict[str, int], least: int, kinds: list[str] | None = None) -> DataFrame:
    """Telescope rows that stay: of an allowed kind, with enough of that kind in the event, in an event with enough rows left."""
    if kinds is not None:
        tel_events = tel_events.where(F.col(kind).isin(kinds))
    need = F.lit(0)
    for k, n in least_of_kind.items():
        need = F.when(F.col(kind) == k, n).otherwise(need)
    # One aggregation by event and kind, and the event's total from it: the rows themselves shuffle once.
    per = tel_events.groupBy(*event, kind).agg(F.count("*").alias("__n")).where(F.col("__n") >= need)
    good = per.groupBy(*event).agg(F.sum("__n").alias("__all"), F.collect_set(kind).alias("__kinds")).where(F.col("__all") >= least)
    return tel_events.join(good, event).where(F.array_contains("__kinds", F.col(kind))).drop("__all", "__kinds")
