"""Profile entries of stored CSV, JSON and Parquet files: what each format delivers to ``operators.entries``.

The number of jobs does not depend on the number of files: CSV and JSON files share theirs, and Parquet files share one
for each distinct schema.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspark.functions import errors
from driftspark.functions.types import is_missing, type_class
from driftspark.operators import entries
from driftspark.operators.entries import KEY
from driftspark.operators.lookup import join_lookup, key_counts
from driftspark.operators.profile import as_text, fingerprint_of
from driftspark.runtime import col, materialize, shuffle_tasks
from driftspark.sources import blocks, tables
from driftspark.sources.files import PLACE, file_stats, locate

_NOTES = f"{KEY} string, note string"


class Delivery:
    """Shapes, statistics and values of files, and notes on files that gave none."""

    def __init__(self, shapes: DataFrame, stats: DataFrame, values: DataFrame, notes: DataFrame):
        self.shapes, self.stats, self.values, self.notes = shapes, stats, values, notes


def of_csv(files: DataFrame, root: str) -> Delivery:
    """Cells are typed by all cells of their column; the first record names the columns. An empty file has none."""
    records = materialize(blocks.csv_records(files.select(KEY, "size_bytes"), root).drop("size_bytes"), "records")
    columns = materialize(
        entries.text_columns(records.where("not header"), tables.CSV_NULLS, tables.CSV_TRUE, tables.CSV_FALSE), "columns"
    )
    kinds = columns.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("position", "kind"))).alias("kinds"))
    heads = records.groupBy(KEY).agg(
        F.count_if(~F.col("header")).alias("n_rows"), F.first(F.when(F.col("header"), F.col("cells")), True).alias("cells")
    )
    lower = F.transform("cells", lambda c: F.lower(c))
    named = F.transform(
        "cells",
        lambda c, i: F.when(c == "", F.concat(F.lit("_c"), i.cast("string")))
        .when(F.size(F.filter(lower, lambda x: x == F.lower(c))) > 1, F.concat(c, i.cast("string")))
        .otherwise(c),
    )
    kind_of = lambda i: F.coalesce(F.try_element_at("kinds", i.cast("int")), F.lit("float"))
    fields = F.transform(named, lambda c, i: F.struct(c.alias("name"), kind_of(i).alias("kind")))
    shapes = heads.join(kinds, KEY, "left").select(
        KEY, "n_rows", fields.alias("fields"),
        F.filter(
            F.sequence(F.lit(0), F.size("cells") - 1), lambda i: ~kind_of(i).isin(*entries.NUMERIC)
        ).alias("texts"),
    )
    shapes = materialize(
        files.select(KEY).distinct().join(shapes, KEY, "left").withColumns(
            {"n_rows": F.coalesce("n_rows", F.lit(0)), "fields": F.coalesce("fields", F.array().cast(entries.FIELDS))}
        ),
        "shapes",
    )
    rows = records.where("not header").select(KEY, "cells", F.xxhash64("cells").alias("spread"))
    met = join_lookup(rows, shapes.where("size(texts) > 0").select(KEY, "texts"), [KEY], key_counts(rows, [KEY]), "spread")
    cells = met.select(KEY, F.explode("texts").alias("position"), "cells")
    cell = F.get("cells", F.col("position"))
    kept = F.when(~cell.isin(tables.CSV_NULLS), cell)
    # Cells of one truth value have several spellings.
    truth = shapes.where(F.exists("fields", lambda f: f["kind"] == "bool")).select(
        KEY, F.posexplode("fields").alias("position", "field")
    ).where("field.kind = 'bool'").select(KEY, "position", F.lit(True).alias("truth"))
    values = cells.select(KEY, "position", kept.alias("value"), F.xxhash64("cells").alias("spread"))
    values = join_lookup(values, truth, [KEY, "position"], key_counts(values, [KEY, "position"]), "spread")
    value = F.when(F.col("truth"), F.initcap("value")).otherwise(F.col("value"))
    return Delivery(
        shapes.select(KEY, "n_rows", "fields"),
        columns.select(KEY, "position", "n_present", *entries.STATS),
        values.select(KEY, "position", value.alias("value")),
        files.sparkSession.createDataFrame([], _NOTES),
    )


def of_json(files: DataFrame, root: str) -> Delivery:
    """Leaves of nested objects are columns under dotted names; an array is a column, a plain value ``value``.

    A file with an element that is no JSON, too large or too deep gives a note and nothing else.
    """
    items = materialize(tables.parsed_items(files.select(KEY, "size_bytes"), root).drop("size_bytes"), "items")
    ends = materialize(items.groupBy(KEY).agg(F.min("code").alias("code")), "ends")
    good = items.join(ends.where("code is null").select(KEY), KEY, "left_semi").select(KEY, "item")
    found = materialize(tables.item_leaves(good, KEY), "leaves")
    rows = good.where("item is not null").withColumn("spread", F.xxhash64(F.to_json("item")))
    met = join_lookup(rows, found.select(KEY, "leaves"), [KEY], key_counts(rows, [KEY]), "spread")
    # Below the explosion, so once for each item.
    fields = met.withColumn("fields", tables.item_fields(F.col("item")))
    cells = fields.select(KEY, "item", "fields", F.posexplode("leaves").alias("position", "leaf"))
    value = tables.leaf_value(F.col("item"), F.col("fields"), F.col("leaf"))
    cells = cells.select(KEY, "position", F.col("leaf.kind").alias("kind"), value.alias("v"))
    number = F.when(F.col("kind").isin(*entries.NUMERIC), F.try_variant_get("v", "$", "double"))
    stats = cells.groupBy(KEY, "position").agg(F.count("v").alias("n_present"), *entries.number_stats(number))
    text = F.try_variant_get("v", "$", "string")
    text = F.when(F.col("kind") == "bool", F.initcap(text)).otherwise(F.coalesce(text, F.to_json("v")))
    values = cells.where(~F.col("kind").isin(*entries.NUMERIC)).select(KEY, "position", text.alias("value"))
    fields = F.transform("leaves", lambda f: F.struct(f["name"].alias("name"), f["kind"].alias("kind")))
    return Delivery(
        found.select(KEY, "n_rows", fields.alias("fields")), stats, values,
        ends.where("code is not null").select(KEY, F.col("code").alias("note")),
    )


def _footers(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq

        system, base = locate(root)
        for batch in batches:
            found = []
            for place in batch[KEY]:
                try:
                    with system.open_input_file(base + place) as file:
                        found.append((place, pq.read_schema(file).remove_metadata().to_string(), None))
                except (pa.ArrowException, OSError) as error:
                    text = str(error)
                    found.append((place, None, f"{errors.SCHEMA_UNSUPPORTED}: {text.splitlines()[0] if text else place}"))
            yield pd.DataFrame(found, columns=[KEY, "schema", "note"])

    return run


def _stored_path(root: str) -> Column:
    """The path below ``root`` of the file that a row is read from."""
    # Only escapes are to be decoded; a plus is one.
    whole = F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))
    base = re.sub(PLACE, "", root).rstrip("/")
    return F.substring(F.regexp_replace(whole, PLACE, ""), len(base) + 2, 1 << 20)


def _of_one_schema(table: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, statistics and values of files with one schema: one aggregation for all columns, by file."""
    kinds = [type_class(f.dataType) for f in table.schema]
    keyed = table.withColumn("_key", _stored_path(root))
    wanted = [F.count(F.lit(1)).alias("n_rows")]
    for i, field in enumerate(table.schema):
        column = col(field.name)
        missing = is_missing(column, field.dataType)
        wanted.append(F.count_if(~missing).alias(f"n_present{i}"))
        if kinds[i] in entries.NUMERIC:
            number = F.when(~missing, column.cast("double"))
            wanted += [c.alias(f"{name}{i}") for name, c in zip(entries.STATS, entries.number_stats(number), strict=True)]
    wide = materialize(keyed.groupBy("_key").agg(*wanted), "wide")
    none = F.lit(None).cast("double")
    cells = [
        F.struct(
            F.lit(i).alias("position"), F.col(f"n_present{i}").alias("n_present"),
            *[(F.col(f"{s}{i}") if kind in entries.NUMERIC else none).alias(s) for s in entries.STATS],
        )
        for i, kind in enumerate(kinds)
    ]
    rows = wide.select(F.col("_key").alias(KEY), "n_rows")
    spark = table.sparkSession
    stats = wide.select(F.col("_key").alias(KEY), F.inline(F.array(*cells))) if cells else spark.createDataFrame([], entries.ROWS)
    texts = [
        F.struct(F.lit(i).alias("position"), as_text(col(f.name), kinds[i]).alias("value"))
        for i, f in enumerate(table.schema)
        if kinds[i] not in entries.NUMERIC
    ]
    values = keyed.select(F.col("_key").alias(KEY), F.inline(F.array(*texts))) if texts else spark.createDataFrame([], entries.VALUES)
    return rows, stats, values


def of_parquet(files: DataFrame, root: str) -> Delivery:
    """Footers are read by the tasks; files of one schema are one table. A file that cannot be read gives a note."""
    spark = files.sparkSession
    spread = files.select(KEY).distinct().repartition(shuffle_tasks(spark), KEY)
    found = materialize(spread.mapInPandas(_footers(root), f"{KEY} string, schema string, note string"), "footers")
    shapes, stats, values = [], [], []
    # One row for each distinct schema; a group's paths are what the reader of the group is given.
    for group in found.where("schema is not null").groupBy("schema").agg(F.sort_array(F.collect_list(KEY)).alias("paths")).collect():
        places = [root.rstrip("/") + "/" + p for p in group["paths"]]
        table = spark.read.parquet(*[re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in places])
        fields = F.array(
            *[F.struct(F.lit(f.name).alias("name"), F.lit(type_class(f.dataType)).alias("kind")) for f in table.schema]
        ).cast(entries.FIELDS)
        rows, own_stats, own_values = _of_one_schema(table, root)
        named = spark.createDataFrame([(p,) for p in group["paths"]], f"{KEY} string")
        # A file without rows has no group of its own.
        shapes.append(named.join(rows, KEY, "left").select(KEY, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), fields.alias("fields")))
        stats.append(own_stats)
        values.append(own_values)
    return Delivery(
        *(
            reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
            for parts, schema in ((shapes, entries.SHAPES), (stats, entries.ROWS), (values, entries.VALUES))
        ),
        found.where("note is not null").select(KEY, "note"),
    )


READERS = {".csv": of_csv, ".json": of_json, ".parquet": of_parquet}


def file_entries(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """An entry for each stored path of ``files`` (``dest_path``, and ``size_bytes`` if that is known), by its
    lower-cased suffix.

    Columns are those of ``operators.entries.assembled`` and ``note``, which says why a file has no columns: an error
    code, or an unsupported suffix. A path that is asked for more than once has one entry.
    """
    if "size_bytes" not in files.columns:
        files = file_stats(files, root)
    paths = files.groupBy(KEY).agg(F.max("size_bytes").alias("size_bytes"))
    suffix = F.lower(F.regexp_extract(KEY, r"(\.[^./]+)$", 1))
    paths = materialize(paths.withColumn("suffix", suffix), "profiled-paths")
    present = {row["suffix"] for row in paths.where(F.col("suffix").isin(*READERS)).select("suffix").distinct().collect()}
    parts = [READERS[s](paths.where(F.col("suffix") == s), root) for s in READERS if s in present]
    other = paths.where(~F.col("suffix").isin(*READERS)).select(
        KEY, F.concat(F.lit("unsupported extension: "), "suffix").alias("note")
    )
    notes = reduce(DataFrame.unionByName, [d.notes for d in parts], other)
    empty = {
        "n_rows": F.lit(0).cast("long"),
        "columns": F.array().cast("array<string>"),
        "dtypes": F.create_map().cast("map<string,string>"),
        "null_fraction": F.create_map().cast("map<string,double>"),
        "basic_stats": F.create_map().cast("map<string,struct<min:double,max:double,mean:double,std:double>>"),
        "top_values": F.create_map().cast("map<string,array<struct<value:string,n:bigint>>>"),
        "schema_fingerprint": F.lit(fingerprint_of([], {})),
    }
    noted = notes.withColumns(empty)
    if not parts:
        return noted.select(KEY, *empty, "note")
    shapes, stats, values = (reduce(DataFrame.unionByName, [getattr(d, n) for d in parts]) for n in ("shapes", "stats", "values"))
    whole = entries.assembled(shapes, stats, entries.frequent_values(values))
    return whole.withColumn("note", F.lit(None).cast("string")).unionByName(noted)
