"""Per-row text rules as column expressions (JVM side, except ``normalize_scope``)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Suffix -> asset type, matched on the lower-cased name.
EXPECTED_TYPES = {
    ".parquet": "parquet",
    ".csv": "csv",
    ".json": "json",
    ".zip": "zip",
    ".tar": "tar",
    ".tar.gz": "tar",
    ".tgz": "tar",
}

# Lengths at which hexadecimal text counts as a commit id; only the last is a full pin.
COMMIT_ID_LENGTHS = [7, 8, 9, 10, 40]
FULL_COMMIT_ID_LENGTH = 40

# Longest sanitized name, fingerprint length.
MAX_NAME_LENGTH = 128
FINGERPRINT_LENGTH = 16


def expected_type(name: Column) -> Column:
    lowered = F.lower(name)
    kind = F.lit("unknown")
    for suffix, label in EXPECTED_TYPES.items():
        kind = F.when(lowered.endswith(suffix), label).otherwise(kind)
    return kind


def split_trim(text: Column) -> Column:
    """``"a, b"`` -> ``["a", "b"]``."""
    return F.transform(F.split(text, ","), strip)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sanitize_name(text: Column) -> Column:
    """Keep letters, digits and ``- _ .``; every other character becomes ``_``."""
    return F.left(
        F.regexp_replace(strip(text), r"[^\p{L}\p{N}_.-]", "_"), F.lit(MAX_NAME_LENGTH)
    )


def safe_name(text: str) -> str:
    """The rule of ``sanitize_name`` for one name that the driver needs."""
    return re.sub(r"[^\w.-]", "_", text.strip())[:MAX_NAME_LENGTH]


def is_commit_id(ref: Column) -> Column:
    trimmed = strip(ref)
    return F.length(trimmed).isin(COMMIT_ID_LENGTHS) & trimmed.rlike("^[0-9a-fA-F]+$")


def is_pinned_ref(ref: Column) -> Column:
    """A reference is pinned only by a full commit id."""
    return is_commit_id(ref) & (F.length(strip(ref)) == FULL_COMMIT_ID_LENGTH)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_json(text: Column) -> Column:
    """Sorted keys, no blanks. Null for text that is no JSON. Numbers take Spark's shortest form."""
    return F.to_json(F.try_parse_json(text))


def _sorted_lists(value):
    if isinstance(value, dict):
        return {key: _sorted_lists(item) for key, item in value.items()}
    if isinstance(value, list):
        return sorted((_sorted_lists(item) for item in value), key=_dump)
    return value


_dump = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode


def _normalize_text(text):
    if text is None:
        return None
    try:
        return _dump(_sorted_lists(json.loads(text)))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def normalize_scope(texts: pd.Series) -> pd.Series:
    """Canonical JSON with every list ordered by the canonical JSON of its elements.

    Ordering lists at any depth has no built-in expression, hence an Arrow UDF. Null for bad JSON.
    """
    return texts.map(_normalize_text)


def scope_fingerprint(text: Column) -> Column:
    return F.left(F.sha2(normalize_scope(text), 256), F.lit(FINGERPRINT_LENGTH))


def is_safe_path(path: Column) -> Column:
    """Relative, not empty, and never above its base at any segment."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest"))

    def step(state: Column, segment: Column) -> Column:
        move = (
            F.when(segment == "..", -1).when(segment.isin("", "."), 0).otherwise(1)
        )
        depth = state["depth"] + move
        return F.struct(
            depth.alias("depth"), F.least(state["lowest"], depth).alias("lowest")
        )

    stays_inside = F.aggregate(F.split(path, "/"), start, step)["lowest"] >= 0
    # Most paths hold no "..", so the walk over the segments is the exception.
    return (
        F.when(path.isNull() | (path == "") | path.startswith("/"), False)
        .when(~path.contains(".."), True)
        .otherwise(stays_inside)
    )


def utc_stamp(ts: Column) -> Column:
    """Seconds precision with a trailing ``Z``; the session time zone is to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
