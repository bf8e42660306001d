"""Tables to profile: CSV, JSON and Parquet."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftspark.functions import errors
from driftspark.functions.types import numeric_coerce
from driftspark.operators.profile import schema_fingerprint
from driftspark.runtime import col, materialize
from driftspark.sources import blocks
from driftspark.sources.files import PLACE

# Text that a CSV cell uses for null.
CSV_NULLS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# Text that a CSV cell uses for a truth value.
CSV_TRUE = ["True", "TRUE", "true"]
CSV_FALSE = ["False", "FALSE", "false"]

# Bytes of JSON that the engine takes as one value, at least.
JSON_LARGEST = 1 << 24

_WHOLE = r"^\s*[+-]?\d+\s*$"

def typed_text(raw: DataFrame, null_tokens: Sequence[str] = tuple(CSV_NULLS)) -> DataFrame:
    """Text columns cast to the narrowest of BOOLEAN, BIGINT, DOUBLE, STRING that holds every value.

    One aggregation over all columns decides; only its single row reaches the driver.
    """
    cells = raw.select(
        *[F.when(~col(c).isin(list(null_tokens)), col(c)).alias(c) for c in raw.columns]
    )
    tests = []
    for i, name in enumerate(cells.columns):
        cell = col(name)
        truth = cell.isin(CSV_TRUE + CSV_FALSE)
        whole = cell.rlike(_WHOLE) & F.trim(cell).try_cast("long").isNotNull()
        tests += [
            F.count(cell).alias(f"n{i}"),
            F.count_if(truth).alias(f"bool{i}"),
            F.count_if(whole).alias(f"int{i}"),
            F.count(numeric_coerce(cell)).alias(f"float{i}"),
        ]
    seen = cells.agg(*tests).first()
    typed = []
    for i, name in enumerate(cells.columns):
        n, cell = seen[f"n{i}"], col(name)
        if n and seen[f"int{i}"] == n:
            cell = F.trim(cell).try_cast("long")
        elif seen[f"float{i}"] == n:
            # Also a column of nulls only.
            cell = numeric_coerce(cell)
        elif seen[f"bool{i}"] == n:
            cell = cell.isin(CSV_TRUE)
        typed.append(cell.alias(name))
    return cells.select(*typed)


# Quotes inside a quoted cell are doubled.
CSV_QUOTING = {"quote": '"', "escape": '"'}


def _listed(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """Root of a store, and ``dest_path`` and ``size_bytes`` of the files at ``path``, a file, folder or pattern."""
    found = spark.read.format("binaryFile").load(path)
    first = next(iter(found.inputFiles()), "")
    root = re.match(PLACE, first).group(0)
    # The listing may write the root with more or fewer slashes.
    place = F.regexp_replace(F.regexp_replace("path", PLACE, ""), "^/+", "")
    return f"{root}/", found.select(place.alias("dest_path"), F.col("length").alias("size_bytes"))


def read_csv_table(
    spark: SparkSession, path: str, null_tokens: Sequence[str] = tuple(CSV_NULLS), multi_line: bool = True
) -> DataFrame:
    """A CSV file or folder with header, typed by the values of the whole table.

    Cells may hold commas, doubled quotes and line breaks; a file is read by as many tasks as it has blocks. The first
    file names the columns: an empty name becomes ``_c`` and its place, a repeated one gets its place. Missing cells
    are null, further ones are left out. With ``multi_line=False`` line breaks end a record in any case.
    """
    if not multi_line:
        raw = spark.read.options(header=True, nullValue="\x00", **CSV_QUOTING).csv(path)
        return typed_text(raw, null_tokens)
    root, files = _listed(spark, path)
    # Several passes read the cells, so the files are parsed once.
    records = materialize(blocks.csv_records(files, root).select("dest_path", "header", "cells"), "records")
    header = records.where("header").agg(F.min_by("cells", "dest_path")).first()[0]
    if header is None:
        return spark.createDataFrame([], T.StructType())
    cells = records.where("not header")
    names = column_names(header)
    return typed_text(cells.select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)]), null_tokens)


def column_names(header: Sequence[str]) -> list[str]:
    """Names of columns by a header's cells, all different, whatever the case of their letters."""
    lower = [name.lower() for name in header]
    return [
        f"_c{i}" if not name else f"{name}{i}" if lower.count(name.lower()) > 1 else name
        for i, name in enumerate(header)
    ]


def _stored_type(found: T.DataType) -> T.DataType:
    """JSON numbers with a point are DOUBLE; a key that is null throughout is STRING."""
    if isinstance(found, T.DecimalType):
        return T.DoubleType()
    if isinstance(found, T.NullType):
        return T.StringType()
    if isinstance(found, T.ArrayType):
        return T.ArrayType(_stored_type(found.elementType))
    if isinstance(found, T.StructType):
        return T.StructType([T.StructField(f.name, _stored_type(f.dataType)) for f in found])
    return found


def last_key_wins(spark: SparkSession) -> None:
    """JSON objects may repeat a key; as in most parsers the last value counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", True)


def _struct_type(ddl: str) -> str:
    """OBJECT is the variant name of STRUCT; a quoted key that holds the word stays as it is."""
    return "".join(
        part if part.startswith("`") else part.replace("OBJECT<", "STRUCT<")
        for part in re.split(r"(`(?:[^`]|``)*`)", ddl)
    )


def json_schema(rows: DataFrame, text: str) -> T.DataType:
    """Type that holds every JSON document of the column, merged in one aggregation."""
    last_key_wins(rows.sparkSession)
    merged = F.schema_of_variant_agg(F.try_parse_json(F.col(text)))
    found = rows.agg(merged.alias("ddl")).first()["ddl"]
    return _stored_type(T._parse_datatype_string(_struct_type(found or "VOID")))


def _leaves(data_type: T.DataType, column: Column, name: str) -> list[Column]:
    if not isinstance(data_type, T.StructType) or not len(data_type):
        return [column.alias(name)]
    return [
        leaf
        for field in data_type
        for leaf in _leaves(
            field.dataType, column.getField(field.name), f"{name}.{field.name}" if name else field.name
        )
    ]


def flatten_structs(rows: DataFrame) -> DataFrame:
    """Nested objects become dotted columns; an array stays one column."""
    return rows.select(
        *[leaf for field in rows.schema for leaf in _leaves(field.dataType, col(field.name), field.name)]
    )


def flatten_json(rows: DataFrame, text: str, schema: T.DataType | None = None) -> DataFrame:
    """One row per JSON document with dotted columns; a plain value becomes the column ``value``.

    Columns come in name order. Text that is no JSON is left out and reported by ``json_errors``.
    """
    schema = schema or json_schema(rows, text)
    document = F.try_parse_json(F.col(text))
    good = rows.where(document.isNotNull())
    if isinstance(schema, T.StructType):
        return flatten_structs(good.select(F.from_json(text, schema).alias("d")).select("d.*"))
    return good.select(F.try_variant_get(document, "$", schema.simpleString()).alias("value"))


def json_errors(rows: DataFrame, text: str) -> DataFrame:
    last_key_wins(rows.sparkSession)
    broken = F.col(text).isNotNull() & F.try_parse_json(F.col(text)).isNull()
    return rows.where(broken).select(F.lit(errors.JSON_PARSE).alias("code"), F.col(text).alias("value"))


def json_items(texts: DataFrame, text: str) -> DataFrame:
    """``item``, a VARIANT, for every element of a file's array, or for the file's one object.

    A file with an empty array keeps one row, without an item.
    """
    last_key_wins(texts.sparkSession)
    whole = F.try_parse_json(F.col(text))
    items = F.try_variant_get(whole, "$", "array<variant>")
    return texts.withColumn("item", F.explode_outer(F.coalesce(items, F.array(whole)))).drop(text)


def parsed_items(files: DataFrame, root: str, path: str = "dest_path") -> DataFrame:
    """``files`` by element: ``item``, a VARIANT or null, and ``code``, what is wrong with the element or the block.

    An element that the engine does not take is too large or, if it is small, no JSON.
    """
    last_key_wins(files.sparkSession)
    items = blocks.planned_json(files, root, path).withColumn("item", F.try_parse_json("text"))
    refused = F.col("text").isNotNull() & F.col("item").isNull()
    large = F.octet_length("text") > JSON_LARGEST
    code = F.when(refused & large, errors.JSON_ITEM_TOO_LARGE).when(refused, errors.JSON_PARSE).otherwise(F.col("code"))
    return items.withColumn("code", code).drop("text", "broken")


def read_json_table(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one object or one array of objects, flattened; a large array is read by several tasks.

    What is no JSON raises ``E_JSON_PARSE``, and an element that the engine does not take the code that says why; an
    array of plain values is the column ``value``.
    """
    root, files = _listed(spark, path)
    items = materialize(parsed_items(files, root), "items")
    wrong = items.agg(F.min("code")).first()[0]
    if wrong:
        raise ValueError(f"{wrong}: {path}")
    return flatten_json(items.where("item is not null").select(F.to_json("item").alias("document")), "document")


# Type classes of the types a JSON value takes; what is not listed is an object.
_JSON_CLASSES = {
    "BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "BOOLEAN": "bool", "STRING": "string", "VOID": "string",
}
_LEAVES = T.ArrayType(
    T.StructType()
    .add("name", T.StringType())
    .add("kind", T.StringType())
    .add("way", T.ArrayType(T.StringType()))
    .add("path", T.StringType())
)


def _leaf_ways(ddl: str) -> list[tuple[list[str], str]]:
    """Keys from the top to each leaf of a type such as ``OBJECT<a: BIGINT, b: OBJECT<c: STRING>>``, and its class."""
    tokens = re.findall(r"`(?:[^`]|``)*`|\w+(?:\([\d, ]+\))?|[<>]", ddl)
    leaves: list[tuple[list[str], str]] = []

    def skip(at: int) -> int:
        depth = 0
        while True:
            depth += {"<": 1, ">": -1}.get(tokens[at], 0)
            at += 1
            if depth == 0:
                return at

    def walk(at: int, way: list[str]) -> int:
        word, nested = tokens[at], tokens[at + 1 : at + 2] == ["<"]
        if word == "OBJECT" and nested and tokens[at + 2] != ">":
            at += 2
            while tokens[at] != ">":
                field = tokens[at].strip("`").replace("``", "`")
                at = walk(at + 1, [*way, field])
            return at + 1
        leaves.append((way, _JSON_CLASSES.get(word.split("(")[0], "object")))
        return skip(at + 1) if nested else at + 1

    walk(0, [])
    return leaves


def json_leaves(ddl: str) -> list[dict[str, str]]:
    """Dotted names and classes of the leaves of a type."""
    return [{"name": ".".join(way) or "value", "kind": kind} for way, kind in _leaf_ways(ddl)]


def _step(key: str) -> str | None:
    """A key in a path of the engine, which takes no question mark, no empty key, and one kind of quote."""
    if not key or "?" in key or ('"' in key and "'" in key):
        return None
    return f"['{key}']" if '"' in key else f'["{key}"]'


def _with_paths(ddl: str) -> list[dict]:
    """Leaves with the ways to them; of leaves of one dotted name the first counts."""
    found: dict[str, dict] = {}
    for way, kind in _leaf_ways(ddl):
        steps = [_step(key) for key in way]
        path = None if None in steps else "$" + "".join(steps)
        name = ".".join(way) or "value"
        found.setdefault(name, {"name": name, "kind": kind, "way": way, "path": path})
    return list(found.values())


@F.pandas_udf(_LEAVES)
def _leaves_of(types: pd.Series) -> pd.Series:
    return types.map(_with_paths)


def item_leaves(items: DataFrame, *keys: str) -> DataFrame:
    """``keys, n_rows, leaves`` per ``keys`` of rows with a VARIANT ``item`` (or null).

    The type is merged by a partial aggregation, so a file with very many documents is no hot spot; the UDF sees one
    short type per file.
    """
    return (
        items.groupBy(*keys)
        .agg(F.count("item").alias("n_rows"), F.schema_of_variant_agg("item").alias("ddl"))
        .select(
            *keys,
            "n_rows",
            # An empty array has no columns.
            F.when(F.col("n_rows") > 0, _leaves_of("ddl")).otherwise(F.array().cast(_LEAVES)).alias("leaves"),
        )
    )


def item_fields(item: Column) -> Column:
    """The values of an object by key; null for all else."""
    return F.try_variant_get(item, "$", "map<string,variant>")


def leaf_value(item: Column, fields: Column, leaf: Column) -> Column:
    """The VARIANT at a leaf; JSON nulls are null.

    A leaf at the top is looked up in ``fields``, the item's ``item_fields``, found once for all leaves of an item. The
    engine parses a path that is no constant for every value, which takes far longer; only deeper leaves need one.
    """

    def stepwise(value: Column, key: Column) -> Column:
        return F.try_element_at(item_fields(value), key)

    found = (
        F.when(F.size(leaf["way"]) == 1, F.try_element_at(fields, F.get(leaf["way"], F.lit(0))))
        .when(leaf["path"].isNotNull(), F.call_function("try_variant_get", item, leaf["path"], F.lit("variant")))
        .otherwise(F.aggregate(leaf["way"], item, stepwise))
    )
    return F.when(~F.is_variant_null(found), found)


def item_schemas(items: DataFrame, *keys: str) -> DataFrame:
    """``keys, n_rows, columns, dtypes, schema_fingerprint`` per ``keys`` of rows with a VARIANT ``item`` (or null)."""
    return item_leaves(items, *keys).select(
        *keys,
        "n_rows",
        F.col("leaves.name").alias("columns"),
        F.map_from_arrays("leaves.name", "leaves.kind").alias("dtypes"),
    ).withColumn("schema_fingerprint", schema_fingerprint(F.col("columns"), F.col("dtypes")))


def json_file_schemas(texts: DataFrame, text: str, *keys: str) -> DataFrame:
    """``item_schemas`` of any number of JSON files whose text is in a column."""
    return item_schemas(json_items(texts.select(*keys, text), text), *keys)


def suffix_of(path: str) -> str:
    match = re.search(r"\.[^./]+$", path.rstrip("/"))
    return match.group(0).lower() if match else ""


def read_table(spark: SparkSession, path: str) -> tuple[DataFrame | None, str | None]:
    """The table and a note; no table for an unsupported suffix or an unreadable file.

    Notes start with the error code where there is one, so a bad file never ends a run.
    """
    readers = {
        ".csv": read_csv_table,
        ".json": read_json_table,
        ".parquet": lambda s, p: s.read.parquet(p),
    }
    reader = readers.get(suffix_of(path))
    if reader is None:
        return None, f"unsupported extension: {suffix_of(path)}"
    try:
        return reader(spark, path), None
    except Exception as error:
        text = str(error)
        named = (errors.JSON_PARSE, errors.JSON_ITEM_TOO_LARGE, errors.JSON_TOO_DEEP)
        code = next((name for name in named if name in text), errors.SCHEMA_UNSUPPORTED)
        return None, f"{code}: {text.splitlines()[0] if text else path}"
