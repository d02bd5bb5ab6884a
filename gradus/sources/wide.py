"""Tables of thousands of columns, read by position.

A line becomes an array of cells, and columns are places in it: names, roles and samples are array values in the plan, not columns of
it, so that a plan for 50,000 columns is as small as one for five. Three layouts: ``maf``, a row per feature with samples as
columns; ``wide``, a row per sample with features as columns; ``generic``, any other table, read like ``wide``.

Cells are cut by the csv rules, double quotes included; a line is a record. Lines that are short lack their last cells, cells beyond
the header are not read. Blank lines are skipped. An empty file gives no records.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.labels import modality
from gradus.operators.sampling import unique_names
from gradus.sources.tables import column_roles, layout, sample_columns, sniff_delimiter

#: Columns of a maf table that describe a feature.
ANNOTATIONS = ["database_identifier", "chemical_formula", "smiles", "inchi", "metabolite_identification", "mass_to_charge", "fragmentation", "modifications", "charge", "retention_time", "taxid", "species", "database", "database_version", "reliability", "uri", "search_engine", "search_engine_score"]
#: Roles of the columns named by the header, given the header and the first rows: sample_id or id, label, metadata or meta, feature, ignore.
Roles = Callable[[list[str], list[list[str]]], dict[str, str]]


@dataclass
class Wide:
    """A table by position: its header, its (pos, cells) rows in file order, and its first rows."""

    name: str
    header: list[str]
    rows: DataFrame
    first: list[list[str]]

    @property
    def layout(self) -> str:
        return layout(self.header, [r + [""] * (len(self.header) - len(r)) for r in self.first])


def read(spark: SparkSession, path: str, delimiter: str | None = None) -> Wide:
    """Opens one file; only its first lines are looked at."""
    sep = delimiter or sniff_delimiter(spark, path)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    top = [next(csv.reader([r["value"]], delimiter=sep)) for r in lines.limit(21).collect()]
    header = top[0] if top else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = pa.array([next(csv.reader([x], delimiter=sep)) for x in batch.column("value").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("pos"), cells], ["pos", "cells"])

    numbered = lines.select(F.monotonically_increasing_id().alias("pos"), "value")  # rises in file order
    rows = numbered.filter("pos > 0").mapInArrow(cut, "pos long, cells array<string>")
    return Wide(path.rsplit("/", 1)[-1], header, rows, top[1:])


def cell(place: Column | int) -> Column:
    """The trimmed cell at a place; null where it is missing or blank."""
    return F.nullif(F.trim(F.get("cells", place if isinstance(place, Column) else F.lit(place))), F.lit(""))


def number(place: Column) -> Column:
    """The cell as a number, null where it is none or not finite."""
    x = cell(place).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _places(wide: Wide, names: list[str]) -> list[int]:
    first: dict[str, int] = {}
    for i, c in enumerate(wide.header):
        first.setdefault(c, i)
    return [first[c] for c in names]


def long_rows(wide: Wide, names: list[str], key: Column, key_name: str, column: str) -> DataFrame:
    """(key, column, value) for the numbers in the named columns of every row."""
    spots = F.lit([str(c) for c in names]).cast("array<string>"), F.lit(_places(wide, names)).cast("array<int>")
    cells = F.filter(F.zip_with(*spots, lambda n, p: F.struct(n.alias("n"), number(p).alias("v"))), lambda e: e.v.isNotNull())
    return wide.rows.select(key.alias(key_name), F.explode(cells).alias("e")).select(key_name, F.col("e.n").alias(column), F.col("e.v").alias("value"))


def roles_of(wide: Wide, roles: Roles | None = None) -> dict[str, str]:
    """Roles by a callback, else by names; ``id`` and ``meta`` are other words for sample_id and metadata. One column is the sample's id:
    the first that has the role, else the first of all."""
    got = roles(wide.header, wide.first[:20]) if roles else column_roles(wide.header)
    same = {"id": "sample_id", "meta": "metadata"}
    out = {c: same.get(got.get(c, "ignore"), got.get(c, "ignore")) for c in wide.header}
    ids = [c for c, r in out.items() if r == "sample_id"]
    return out | {c: "ignore" for c in ids[1:]} | ({} if ids or not wide.header else {wide.header[0]: "sample_id"})


def feature_names(wide: Wide) -> DataFrame:
    """(pos, name): the features of a maf table. A row without a name is called by its mass, ``mz_`` before it, else ``feature_unknown``; a name
    that was there before, as given or as made, gets mass and modification behind it."""
    low = [c.lower() for c in wide.header]
    at = lambda c: cell(low.index(c)) if c in low else F.lit(None).cast("string")
    mass, change = at("mass_to_charge"), at("modifications")
    given = F.coalesce(at("metabolite_identification"), at("database_identifier"))
    name = F.coalesce(F.when(F.lower(given) != "nan", given), F.concat(F.lit("mz_"), mass), F.lit("feature_unknown"))
    suffix = F.concat(F.coalesce(F.concat(F.lit("_"), mass), F.lit("")), F.coalesce(F.concat(F.lit("_"), change), F.lit("")))
    rows = wide.rows.select("pos", name.alias("name"), suffix.alias("suffix"))
    return unique_names(rows, "name", F.col("suffix"), "pos").select("pos", F.col("unique_name").alias("name"))


def maf_values(wide: Wide) -> DataFrame:
    """(sample, feature, value) of a maf table."""
    samples = sample_columns(wide.header, ANNOTATIONS)
    each = long_rows(wide, samples, F.col("pos"), "pos", "sample")
    return each.join(feature_names(wide), "pos").select("sample", F.col("name").alias("feature"), "value")


def records(wide: Wide, roles: Roles | None = None) -> DataFrame:
    """(sample_id, dataset, modality, features map, label, metadata map), one row per sample, whatever the layout.

    Of a maf table a sample without a number has no record; of features named alike the last number counts."""
    if not wide.header:
        return wide.rows.limit(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (("sample_id", "string"), ("dataset", "string"), ("modality", "string"), ("features", "map<string,double>"), ("label", "string"), ("metadata", "map<string,string>"))])
    if wide.layout == "maf":
        values = maf_values(wide).groupBy("sample", "feature").agg(F.last("value").alias("value"))
        own = values.groupBy("sample").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "value")))).alias("features"))  # a row's worth
        return own.select(F.col("sample").alias("sample_id"), F.lit(wide.name).alias("dataset"), F.lit("metabolomics").alias("modality"), "features", F.lit(None).cast("string").alias("label"), F.lit(None).cast("map<string,string>").alias("metadata"))
    of = roles_of(wide, roles)
    listed = lambda role: list(dict.fromkeys(c for c in wide.header if of[c] == role))
    entries = lambda names, value: F.map_from_entries(F.filter(F.zip_with(F.lit(names).cast("array<string>"), F.lit(_places(wide, names)).cast("array<int>"), lambda n, p: F.struct(n.alias("key"), value(p).alias("value"))), lambda e: e.value.isNotNull()))
    label = [cell(p) for p in _places(wide, listed("label"))]
    sample = F.coalesce(cell(_places(wide, listed("sample_id"))[0]), cell(0), F.concat(F.lit("sample_"), (F.col("pos") - 1).cast("string")))
    kind = modality(F.lit(" ".join([*wide.header, wide.name]).lower()))
    return wide.rows.select(
        sample.alias("sample_id"), F.lit(wide.name).alias("dataset"), kind.alias("modality"), entries(listed("feature"), number).alias("features"),
        (F.coalesce(*label) if label else F.lit(None).cast("string")).alias("label"), entries(listed("metadata"), cell).alias("metadata"))


def contents(df: DataFrame) -> DataFrame:
    """(place, name, n, numbers): for every column of a table how many values it has, and how many are numbers. One aggregate over an array of
    cells, whatever the number of columns."""
    cells = F.posexplode(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])).alias("place", "x")
    per = df.select(cells).groupBy("place").agg(F.count("x").alias("n"), F.count(F.col("x").try_cast("double")).alias("numbers"))
    return per.select("place", F.get(F.lit(df.columns).cast("array<string>"), F.col("place")).alias("name"), "n", "numbers")
