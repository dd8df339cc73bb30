"""The table store: nodes of an event hierarchy as Parquet, with units and codecs in column metadata."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import codecs
from eventloom.operators.expressions import compile_expression
from eventloom.operators.relational import CannotMerge, check_disjoint, check_equal, join_with_suffix, row_slice, with_row_index
from eventloom.runtime import cut

VERSION = "v1.0.0"


def with_units(df: DataFrame, units: dict[str, str]) -> DataFrame:
    for c, u in units.items():
        df = df.withMetadata(c, {**df.schema[c].metadata, "unit": u})
    return df


def unit_of(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get("unit")


#: Factors to a common unit of each kind: radian, metre, TeV, second.
UNITS = {"rad": 1.0, "deg": 0.017453292519943295, "arcmin": 0.0002908882086657216, "m": 1.0, "cm": 0.01, "km": 1000.0, "TeV": 1.0, "GeV": 0.001, "s": 1.0, "ms": 0.001, "ns": 1e-9, "h": 3600.0}


def convert(df: DataFrame, column: str, unit: str) -> DataFrame:
    """The column in another unit of the same kind."""
    old = unit_of(df, column)
    if old is None or old not in UNITS or unit not in UNITS:
        raise ValueError(f"no way from {old} to {unit}")
    return with_units(df.withColumn(column, F.col(column) * (UNITS[old] / UNITS[unit])), {column: unit})


@dataclass
class TableStore:
    """Nodes below one root path; each node is a Parquet folder, described in a one-row table beside it."""

    spark: SparkSession
    root: str

    def path(self, node: str) -> str:
        return f"{self.root.rstrip('/')}/{node.strip('/')}"

    def write(self, df: DataFrame, node: str, partition_by: list[str] | None = None, mode: str = "errorifexists", fixed: dict[str, tuple] | None = None, enums: dict[str, dict[str, int]] | None = None, meta: dict | None = None) -> None:
        """Write a node: `fixed` columns as scaled integers (scale, offset and, unless uint16, the type), `enums` as numbers; both are undone on reading."""
        for c, how in (fixed or {}).items():
            old = df.schema[c].metadata
            df = df.withColumn(c, codecs.encode_fixed(F.col(c), *how)).withMetadata(c, {**old, "fixed": json.dumps(list(how))})
        for c, values in (enums or {}).items():
            df = df.withColumn(c, codecs.encode_enum(F.col(c), values)).withMetadata(c, {"enum": json.dumps(values)})
        w = df.write.mode(mode)
        (w.partitionBy(*partition_by) if partition_by else w).parquet(self.path(node))
        about = json.dumps({"version": VERSION, **(meta or {})})
        self.spark.createDataFrame([(node, about)], "node string, about string").write.mode("overwrite").parquet(self.path(f"_about/{node}"))

    def exists(self, node: str) -> bool:
        try:
            return bool(self.spark.read.parquet(self.path(f"_about/{node}")).columns)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    def nodes(self) -> list[str]:
        """All nodes written, in order of their names."""
        try:
            about = self.spark.read.option("recursiveFileLookup", "true").parquet(self.path("_about"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r.node for r in about.select("node").distinct().collect())

    def append(self, df: DataFrame, node: str, once: bool = False) -> None:
        """Rows of one more table for a node, which is made if it is not there; with `once` they must be those it has.

        Columns must be those of the node, in any order; values are cast to its types, and encoded as its are. An error if not, or for another data model.
        """
        if not self.exists(node):
            self.write(df, node)
            return
        self.check_version(node)
        old = self.spark.read.parquet(self.path(node))
        if set(df.columns) != set(old.columns):
            raise CannotMerge(f"{node}: columns differ: {sorted(set(df.columns) ^ set(old.columns))}")
        if once:
            check_equal(self.read(node).select(*df.columns), df)
            return
        columns = []
        for f in old.schema:
            c = F.col(f.name)
            if "fixed" in f.metadata:
                c = codecs.encode_fixed(c, *json.loads(f.metadata["fixed"]))
            elif "enum" in f.metadata and isinstance(df.schema[f.name].dataType, T.StringType):
                c = codecs.encode_enum(c, json.loads(f.metadata["enum"]))
            columns.append(c.cast(f.dataType).alias(f.name, metadata=f.metadata))
        df.select(*columns).write.mode("append").parquet(self.path(node))

    def meta(self, node: str) -> dict:
        return json.loads(self.spark.read.parquet(self.path(f"_about/{node}")).first()["about"])

    def read(self, node: str, condition: str | None = None, start: int | None = None, stop: int | None = None, step: int = 1, columns: list[str] | None = None, decode_enums: bool = False) -> DataFrame:
        """A node with its codecs undone. `condition` is on decoded values, and reaches the Parquet reader for columns without a code; start, stop and step need a row_idx column."""
        df = self.spark.read.parquet(self.path(node))
        if start is not None or stop is not None:
            df = row_slice(df, start or 0, stop if stop is not None else 2**62, step)
        for f in df.schema:
            rest = {k: v for k, v in f.metadata.items() if k != "fixed"}
            if "fixed" in f.metadata:
                df = df.withColumn(f.name, codecs.decode_fixed(F.col(f.name), *json.loads(f.metadata["fixed"]))).withMetadata(f.name, rest)
            if decode_enums and "enum" in f.metadata:
                df = df.withColumn(f.name, codecs.decode_enum(F.col(f.name), json.loads(f.metadata["enum"]))).withMetadata(f.name, {k: v for k, v in rest.items() if k != "enum"})
        if condition:
            df = df.where(compile_expression(condition, dict(df.dtypes)))
        return df.select(*columns) if columns else df

    def check_version(self, node: str) -> None:
        if (v := self.meta(node)["version"].split(".")[0]) != VERSION.split(".")[0]:
            raise CannotMerge(f"{node} has data model {v}")


@dataclass
class TableLoader:
    """Joined views over the nodes of a store: array events, telescope events with their event's columns."""

    store: TableStore
    event_keys: tuple[str, ...] = ("obs_id", "event_id")

    def subarray_events(self, nodes: list[str], observation: str | None = None) -> DataFrame:
        """The first node's events, with the columns of further nodes and of their observation, absent ones null."""
        df = self.store.read(nodes[0])
        for n in nodes[1:]:
            if self.store.exists(n):
                df = join_with_suffix(df, self.store.read(n), list(self.event_keys))
        if observation and self.store.exists(observation):
            df = join_with_suffix(df, self.store.read(observation), [self.event_keys[0]])
        return df

    def telescope_events(self, nodes: list[str], subarray: DataFrame | None = None, telescopes: list[int] | None = None, instrument: str | None = None) -> DataFrame:
        keys = [*self.event_keys, "tel_id"]
        tables = [self.store.read(n) for n in nodes if self.store.exists(n)]
        if telescopes is not None:
            tables = [t.where(F.col("tel_id").isin(telescopes)) for t in tables]
        df = tables[0]
        for t in tables[1:]:
            df = join_with_suffix(df, t, keys)
        if subarray is not None:
            df = join_with_suffix(df, subarray, list(self.event_keys))
        if instrument and self.store.exists(instrument):
            df = join_with_suffix(df, self.store.read(instrument), ["tel_id"])
        return df

    def of_observations(self, df: DataFrame, observations: Sequence[int]) -> DataFrame:
        """The events of some observations; the filter reaches the reader of the first node."""
        return df.where(F.col(self.event_keys[0]).isin(list(observations)))

    def information(self, node: str) -> DataFrame:
        """A node that describes observations, scheduling or simulation as it is; an error if it is not there."""
        if not self.store.exists(node):
            raise ValueError(f"the store has no {node}")
        return self.store.read(node)

    def chunked(self, df: DataFrame, size: int, order: Sequence[str]) -> Iterator[tuple[int, int, DataFrame]]:
        """(start, stop, rows) of a joined view in pieces of `size` rows of this order, the last one shorter; none of an empty view.

        The index is made in one pass without one task for all rows and written once; each piece is a filter of it, so pieces may be read in any order. Rows equal in
        `order` are told apart, but not in the same way each time.
        """
        if size < 1:
            raise ValueError("size must be positive")
        rows = cut(with_row_index(df, list(order), "__row"))
        n = rows.count()
        for start in range(0, n, size):
            yield start, min(start + size, n), row_slice(rows, start, start + size, index="__row").drop("__row")

    def numbered(self, df: DataFrame, size: int, order: Sequence[str], name: str = "chunk") -> DataFrame:
        """df with the number (from 0) of the piece that chunked would give a row in: all pieces as groups of one pass, where their rows need not be told apart."""
        if size < 1:
            raise ValueError("size must be positive")
        return with_row_index(df, list(order), "__row").withColumn(name, F.floor(F.col("__row") / size).cast("long")).drop("__row")

    def by_type(self, df: DataFrame, types: list[str], column: str = "type") -> dict[str, DataFrame]:
        return {t: df.where(F.col(column) == t) for t in types}


def merge_stores(target: TableStore, sources: Sequence[TableStore], once: Sequence[str] = (), required: Sequence[str] = (), drop: Mapping[str, Sequence[str]] | None = None, observation: str = "obs_id", events: str | None = None) -> list[str]:
    """Append every node of the sources to the target; the nodes that were written.

    Nodes in `once` are the same in all sources and are kept once. `required` nodes must be in each source, `drop` names columns to leave out. With
    `events`, the node that tells the observations, no two of the tables may share one.
    """
    drop, done = drop or {}, []
    for s in sources:
        here = s.nodes()
        if missing := sorted(set(required) - set(here)):
            raise CannotMerge(f"{s.root} has no {', '.join(missing)}")
        if events and events in here and target.exists(events):
            check_disjoint(target.read(events), s.read(events), observation)
        for n in here:
            s.check_version(n)
            target.append(s.read(n).drop(*drop.get(n, ())), n, once=n in once)
            done += [] if n in done else [n]
    return done


def event_schema() -> dict[str, T.StructType]:
    """Spark types of the main nodes; units are in the metadata."""
    u = lambda x: {"unit": x}
    key = [T.StructField("obs_id", T.LongType(), False), T.StructField("event_id", T.LongType(), False)]
    tel = [*key, T.StructField("tel_id", T.ShortType(), False)]
    d, l, b = T.DoubleType(), T.LongType(), T.BooleanType()
    return {
        "trigger": T.StructType([*key, T.StructField("time", T.TimestampType()), T.StructField("event_type", T.IntegerType()), T.StructField("tels_with_trigger", T.ArrayType(b))]),
        "shower": T.StructType([*key, T.StructField("true_energy", d, True, u("TeV")), *[T.StructField(c, d, True, u("deg")) for c in ("true_alt", "true_az")], *[T.StructField(c, d, True, u("m")) for c in ("true_core_x", "true_core_y")]]),
        "images": T.StructType([*tel, T.StructField("image", T.ArrayType(T.FloatType())), T.StructField("peak_time", T.ArrayType(T.FloatType())), T.StructField("image_mask", T.ArrayType(b))]),
        "parameters": T.StructType([*tel, *[T.StructField(f"hillas_{c}", d) for c in ("intensity", "length", "width", "skewness", "kurtosis")]]),
        "energy": T.StructType([*key, T.StructField("energy", d, True, u("TeV")), T.StructField("energy_uncert", d, True, u("TeV")), T.StructField("is_valid", b), T.StructField("telescopes", T.ArrayType(T.ShortType()))]),
        "pixel_statistics": T.StructType([T.StructField("tel_id", T.ShortType()), *[T.StructField(c, T.TimestampType()) for c in ("time_start", "time_end")], T.StructField("n_events", T.ArrayType(l)), *[T.StructField(c, T.ArrayType(d)) for c in ("mean", "median", "std")]]),
    }
