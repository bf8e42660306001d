"""Error codes and error records. Errors are rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error codes.
SCOPE_INVALID = "E_SCOPE_INVALID"
REF_NOT_FOUND = "E_REF_NOT_FOUND"
ASSET_MISSING = "E_ASSET_MISSING"
AMBIGUOUS_MATCH = "E_AMBIGUOUS_MATCH"
HTTP_404 = "E_HTTP_404"
HTTP_403 = "E_HTTP_403"
HTTP_429 = "E_HTTP_429"
TIMEOUT = "E_TIMEOUT"
CONNECTION = "E_CONNECTION"
HTTP_5XX = "E_HTTP_5XX"
CHECKSUM_MISMATCH = "E_CHECKSUM_MISMATCH"
TRUNCATED_DOWNLOAD = "E_TRUNCATED_DOWNLOAD"
JSON_PARSE = "E_JSON_PARSE"
JSON_ITEM_TOO_LARGE = "E_JSON_ITEM_TOO_LARGE"
JSON_TOO_DEEP = "E_JSON_TOO_DEEP"
SCHEMA_UNSUPPORTED = "E_SCHEMA_UNSUPPORTED"
MANIFEST_MISSING = "E_MANIFEST_MISSING"
CHECKSUMS_MISSING = "E_CHECKSUMS_MISSING"
REQUIRED_ASSET_MISSING = "E_REQUIRED_ASSET_MISSING"
CHECKSUM_RECORD_MISSING = "E_CHECKSUM_RECORD_MISSING"
FILE_MISSING = "E_FILE_MISSING"
NO_SPACE = "E_NO_SPACE"
PERMISSION = "E_PERMISSION"
ATOMIC_RENAME_FAILED = "E_ATOMIC_RENAME_FAILED"
IO = "E_IO"
UNSAFE_DEST_PATH = "E_UNSAFE_DEST_PATH"
FLOATING_REF_DISALLOWED = "E_FLOATING_REF_DISALLOWED"
TERMS_ACK_REQUIRED = "E_TERMS_ACK_REQUIRED"
EXPANSION_FAILED = "E_EXPANSION_FAILED"

# Errors that may go away when tried again, and severities other than "error".
RETRYABLE = [HTTP_429, HTTP_5XX, TIMEOUT, CONNECTION, TRUNCATED_DOWNLOAD]
SEVERITIES = {
    SCOPE_INVALID: "fatal", EXPANSION_FAILED: "fatal", UNSAFE_DEST_PATH: "fatal", JSON_PARSE: "fatal",
    JSON_ITEM_TOO_LARGE: "fatal", JSON_TOO_DEEP: "fatal", NO_SPACE: "fatal", PERMISSION: "fatal", IO: "fatal",
    SCHEMA_UNSUPPORTED: "warn",
}
# Messages of errors that come without one.
MESSAGES = {
    HTTP_404: "HTTP 404", HTTP_403: "HTTP 403", HTTP_429: "HTTP 429 rate limited", HTTP_5XX: "HTTP 5xx",
    JSON_PARSE: "JSON parse failed", SCHEMA_UNSUPPORTED: "Parquet schema unsupported",
    JSON_ITEM_TOO_LARGE: "JSON element too large", JSON_TOO_DEEP: "JSON nested too deep",
}


def _of_code(code: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [x for key, value in table.items() for x in (F.lit(key), F.lit(value))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), default)


def full_record(code: Column, message: Column, detail: Column, url: Column, path: Column) -> Column:
    """``error_record`` with message, ``retryable`` and ``severity`` by the code where they are not given."""
    return error_record(
        code,
        F.coalesce(message, _of_code(code, MESSAGES, code)),
        detail,
        retryable=code.isin(RETRYABLE),
        severity=_of_code(code, SEVERITIES, F.lit("error")),
        url=url,
        path=path,
    )


def error_record(
    code: Column,
    message: Column,
    detail: Column,
    *,
    retryable: Column | None = None,
    severity: Column | None = None,
    url: Column | None = None,
    path: Column | None = None,
) -> Column:
    """Struct ``code, message, detail, url, path``.

    ``detail`` is a MAP<STRING,STRING>, or text, which is wrapped as ``{"detail": text}`` by
    ``wrap_detail``. ``retryable`` and ``severity`` are added unless the detail names them.
    """
    retryable = F.lit("false") if retryable is None else retryable.cast("string")
    severity = F.lit("error") if severity is None else severity
    defaults = F.create_map(
        F.lit("retryable"), retryable, F.lit("severity"), severity
    )
    missing = F.map_filter(defaults, lambda key, _: ~F.map_contains_key(detail, key))
    empty = F.lit(None).cast("string")
    return F.struct(
        code.alias("code"),
        message.alias("message"),
        F.map_concat(detail, missing).alias("detail"),
        (empty if url is None else F.nullif(url, F.lit(""))).alias("url"),
        (empty if path is None else F.nullif(path, F.lit(""))).alias("path"),
    )


def wrap_detail(text: Column) -> Column:
    return F.create_map(F.lit("detail"), text)


def violations(*rules: Column) -> Column:
    """Array of the rules that hold; each rule is ``when(condition, struct)``."""
    return F.filter(F.array(*rules), lambda rule: rule.isNotNull())
