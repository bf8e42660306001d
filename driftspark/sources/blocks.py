"""Large CSV and JSON files read by many tasks.

A block of a file does not say by itself whether it starts within a quoted cell or a string. So each block reports
where it would leave off for every state it may be entered in; composed in order, these reports give the state at each
block, and a task then reads exactly the records or elements that its block owns. Files of one block need no report.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftspark.functions import errors
from driftspark.functions.text import is_safe_path
from driftspark.runtime import col, materialize, shuffle_tasks
from driftspark.sources.files import file_stats, locate

# Bytes of a file that one task reads as its own.
BLOCK = 8 << 20
# Bytes of a JSON file that are read at once.
JSON_BLOCK = 1 << 20
# Levels of JSON that the engine parses.
JSON_DEPTH = 1000
# Bytes that a batch of results holds, give or take a record.
BATCH_BYTES = 1 << 20
_BOM = b"\xef\xbb\xbf"


def file_blocks(files: DataFrame, root: str, path: str = "dest_path", block: int = BLOCK) -> DataFrame:
    """``files`` that are stored, with ``size`` and a row for each block: ``start`` and ``stop`` in bytes.

    Where ``files`` has ``size_bytes``, sizes are taken from there and no file is looked up. An empty file has one
    empty block. Paths that leave ``root`` are never opened.
    """
    if "size_bytes" in files.columns:
        found = files.where(is_safe_path(col(path)) & F.col("size_bytes").isNotNull()).withColumn("size", F.col("size_bytes"))
    else:
        stats = file_stats(files.select(col(path).alias("dest_path")), root)
        known = stats.select(F.col("dest_path").alias("_path"), F.col("size_bytes").alias("size"))
        found = files.join(known, files[path] == known["_path"]).drop("_path")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest("size", F.lit(1)) - 1, F.lit(block).cast("long"))
    rows = found.select("*", F.explode(starts).alias("start"))
    return materialize(rows.withColumn("stop", F.least(F.col("start") + block, "size")), "blocks")


def _read(system, place: str, start: int, stop: int) -> bytes:
    with system.open_input_file(place) as file:
        return file.read_at(max(stop - start, 0), start)


def _entered(blocks: DataFrame, root: str, path: str, report: Callable, result: str, compose: Callable) -> DataFrame:
    """Rows of ``compose`` for each file of several blocks; its blocks' reports, a few numbers each, are one group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = locate(root)
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                data = _read(system, base + row.file, max(row.start - 1, 0), row.stop)
                before, own = (data[:1], data[1:]) if row.start else (b"", data)
                found.append((row.file, row.start, row.stop, row.size, report(own, before)))
            yield pd.DataFrame(found, columns=["file", "start", "stop", "size", "report"])

    several = blocks.where(F.col("size") > F.col("stop") - F.col("start"))
    several = several.select(col(path).alias("file"), "start", "stop", "size").distinct()
    if several.isEmpty():
        return blocks.sparkSession.createDataFrame([], result)
    spread = several.repartition(shuffle_tasks(blocks.sparkSession), "file", "start")
    reports = spread.mapInPandas(run, "file string, start bigint, stop bigint, size bigint, report array<bigint>")

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        return compose(rows.sort_values("start").reset_index(drop=True))

    return materialize(reports, "reports").groupBy("file").applyInPandas(composed, result)


# CSV: outside of quotes, within a quoted cell, and within one just after a quote, which may be the first of two.
OUT, IN, QUOTE = 0, 1, 2
_QUOTED = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')
_OPENING = re.compile(rb'(?<=[,\r\n])"')


def csv_exit(data: bytes, before: bytes, state: int) -> tuple[int, int]:
    """State after ``data``, and where the first record that starts in it does (-1: none).

    A quote opens a cell at the cell's start only, after a comma or line break; ``before`` is the byte ahead.
    """
    at, first = 0, -1
    if state == QUOTE and data:
        state, at = (IN, 1) if data[:1] == b'"' else (OUT, 0)
        before = b'"'
    while data:
        if state == IN:
            closed = _QUOTED.match(data, at)
            if closed is None:
                return IN, first
            at = closed.end()
            if at == len(data):
                return QUOTE, first
        if at == 0 and data[:1] == b'"' and before in (b"", b",", b"\r", b"\n"):
            opening = 0
        else:
            found = _OPENING.search(data, at)
            opening = found.start() if found else len(data)
        if first < 0 and (end := data.find(b"\n", at, opening)) >= 0:
            first = end + 1
        if opening == len(data):
            return OUT, first
        at, state = opening + 1, IN
    return state, first


def _csv_report(data: bytes, before: bytes) -> list[int]:
    """State and first record for each state at entry, bytes to skip, and whether the parts before and from the first
    record on, as entered outside of quotes, are more than empty lines."""
    skipped = len(_BOM) if not before and data.startswith(_BOM) else 0
    data = data[skipped:]
    exits = [csv_exit(data, before, state) for state in (OUT, IN, QUOTE)]
    cut = exits[OUT][1] if exits[OUT][1] >= 0 else len(data)
    return [x for pair in exits for x in pair] + [skipped, *(int(bool(p.strip(b"\r\n"))) for p in (data[:cut], data[cut:]))]


def _csv_ranges(rows: pd.DataFrame) -> pd.DataFrame:
    """Ranges from the first record of a block to that of the next one; the header is in the first that has a record."""
    state, starts, heading = OUT, [], None
    for row in rows.itertuples(index=False):
        report = [int(x) for x in row.report]
        if row.start == 0:
            starts.append(report[6])
        first = report[2 * state + 1]
        if heading is None and report[7]:
            heading = len(starts) - 1
        if first >= 0:
            starts.append(row.start + report[6] + first)
            if heading is None and report[8]:
                heading = len(starts) - 1
        state = report[2 * state]
    stops = [*starts[1:], int(rows["size"].iloc[0])]
    flags = [n == heading for n in range(len(starts))]
    return pd.DataFrame({"file": rows["file"].iloc[0], "start": starts, "stop": stops, "heading": flags})


def _csv_cells(root: str, own: pa.Schema, path: str):
    schema = pa.schema([*own, pa.field("header", pa.bool_()), pa.field("cells", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 31)
        system, base = locate(root)
        for batch in batches:
            places, starts, stops, headings = (batch[name].to_pylist() for name in (path, "start", "stop", "heading"))
            for n, (place, start, stop, heading) in enumerate(zip(places, starts, stops, headings, strict=True)):

                def out(rows: list[list[str]], header: bool, about: pa.RecordBatch = batch.slice(n, 1)) -> pa.RecordBatch:
                    about = about.take(pa.array([0] * len(rows), pa.int32()))
                    flags, cells = pa.array([header] * len(rows)), pa.array(rows, pa.list_(pa.string()))
                    return pa.RecordBatch.from_arrays([*(about[name] for name in own.names), flags, cells], schema=schema)

                data = _read(system, base + place, start, stop)
                if start == 0:
                    data = data.removeprefix(_BOM)
                records: list[list[str]] = []
                size = 0
                for record in csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline="")):
                    if not record:
                        continue
                    if heading:
                        yield out([record], True)
                        heading = False
                        continue
                    records.append(record)
                    size += sum(map(len, record)) + 16
                    if size > BATCH_BYTES:
                        yield out(records, False)
                        records, size = [], 0
                if records:
                    yield out(records, False)

    return run


def csv_records(
    files: DataFrame, root: str, path: str = "dest_path", block: int = BLOCK, tasks: int | None = None
) -> DataFrame:
    """``files`` with a row for each record: ``header``, true for a file's first one, and ``cells``.

    Cells are separated by commas; quoted ones may hold commas, line breaks and doubled quotes, also across blocks.
    A quote within an unquoted cell is a character like others. Empty lines are no records, bytes that are no UTF-8
    become the replacement character, and an empty file has no rows. A task reads the records that start in its block.
    """
    blocks = file_blocks(files, root, path, block)
    ranges = _entered(
        blocks, root, path, _csv_report, "file string, start bigint, stop bigint, heading boolean", _csv_ranges
    )
    own = [col(c) for c in files.columns]
    first = blocks.where("start = 0")
    small = first.where(F.col("stop") == F.col("size")).select(*own, "start", "stop", F.lit(True).alias("heading"))
    large = first.drop("start", "stop").join(ranges, first[path] == ranges["file"])
    rows = small.unionByName(large.select(*own, "start", "stop", "heading")).where("stop > start")
    spread = rows.repartition(tasks or shuffle_tasks(files.sparkSession), col(path), "start")
    schema = T.StructType([*files.schema.fields]).add("header", "boolean").add("cells", T.ArrayType(T.StringType()))
    return spread.mapInArrow(_csv_cells(root, to_arrow_schema(files.schema), path), schema)


# JSON: outside of strings, within one, and within one just after a backslash.
ESCAPE = 2
_STRING = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
_REST = re.compile(rb'[^"\\]*+(?:\\.[^"\\]*+)*+', re.S)
_TOKEN = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\Z)|[\[\]{},]', re.S)
_SPACE = re.compile(r"[ \t\r\n]*")


def _string_end(data: bytes, state: int) -> tuple[int, int]:
    """Where a string that ``data`` starts in is over, and the state there; past the end of ``data`` if it is not."""
    at = 0
    if state == ESCAPE:
        if not data:
            return 0, ESCAPE
        at, state = 1, IN
    if state == IN:
        at = _REST.match(data, at).end()
        if at == len(data):
            return at, IN
        if data[at : at + 1] == b"\\":
            return len(data), ESCAPE
        at += 1
    return at, OUT


def json_exit(data: bytes, state: int) -> tuple[int, int]:
    """State after ``data``, and the levels that it opens less those that it closes."""
    at, state = _string_end(data, state)
    if state != OUT:
        return state, 0
    rest = _STRING.sub(b"", data[at:])
    cut = rest.find(b'"')
    if cut >= 0:
        _, state = _string_end(rest[cut + 1 :], IN)
        rest = rest[:cut]
    return state, sum(rest.count(c) for c in (b"[", b"{")) - sum(rest.count(c) for c in (b"]", b"}"))


def json_separator(data: bytes, state: int, depth: int) -> int:
    """Where the first comma between elements of the file's array is; -1: none."""
    at, state = _string_end(data, state)
    if state != OUT:
        return -1
    for token in _TOKEN.finditer(data, at):
        mark = data[token.start()]
        if mark == 0x2C:
            if depth == 1:
                return token.start()
        elif mark != 0x22:
            depth += 1 if mark in b"[{" else -1
    return -1


def _json_report(data: bytes, before: bytes) -> list[int]:
    """State and change of depth for each state at entry, and the block's first byte that is no white space (0: none)."""
    text = (data if before else data.removeprefix(_BOM)).lstrip(b" \t\r\n")
    return [x for state in (OUT, IN, ESCAPE) for x in json_exit(data, state)] + [text[0] if text else 0]


def _json_states(rows: pd.DataFrame) -> pd.DataFrame:
    """State and depth at each block; a file that is one value is the first block's alone."""
    marks = [int(report[6]) for report in rows["report"]]
    if next((m for m in marks if m), 0) != ord("["):
        rows = rows.iloc[:1]
    state, depth, found = OUT, 0, []
    for row in rows.itertuples(index=False):
        found.append((row.file, row.start, state, depth))
        after, change = int(row.report[2 * state]), int(row.report[2 * state + 1])
        state, depth = after, depth + change
    return pd.DataFrame(found, columns=["file", "start", "state", "depth"])


def _finite(value):
    """A parsed value whose numbers JSON can write; others become null."""
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_finite(v) for v in value]
    if isinstance(value, float) and value - value != 0:
        return None
    return value


def json_elements(
    read: Callable[[int], bytes], block: int = JSON_BLOCK, inside: bool = False, stop: int | None = None
) -> Iterator[str]:
    """Texts of the elements of a file's array, or of its one value, read block by block.

    Only one element and one block are in memory. ``NaN`` and infinities become null. What is no JSON raises
    ``ValueError`` where it stands, and more levels than the parser takes ``RecursionError``. With ``inside`` the text
    starts behind a comma of the array. Elements behind a comma at byte ``stop`` or later are left to others.
    """
    decode = codecs.getincrementaldecoder("utf-8")().decode
    odd: list[str] = []
    scan = json.JSONDecoder(parse_constant=odd.append).raw_decode
    text, at, ended = "", 0, False
    place = 0

    def more(size: int) -> None:
        nonlocal text, at, ended
        data = read(size)
        text, at, ended = text[at:] + decode(data, not data), 0, not data

    def upcoming() -> str:
        """The next character that is no white space; empty at the end."""
        nonlocal at, place
        while True:
            end = _SPACE.match(text, at).end()
            place += end - at
            at = end
            if at < len(text) or ended:
                return text[at : at + 1]
            more(block)

    def value() -> str:
        nonlocal at, place
        size = block
        while True:
            odd.clear()
            try:
                parsed, end = scan(text, at)
                # A number at the end of a block may go on in the next one.
                if end < len(text) or ended:
                    part, at = text[at:end], end
                    place += len(part.encode("utf-8", "surrogatepass"))
                    return json.dumps(_finite(parsed)) if odd else part
            except json.JSONDecodeError:
                if ended:
                    raise
            more(size)
            size *= 2

    if not inside and upcoming() == "﻿":
        at, place = at + 1, place + len(_BOM)
    if not inside and upcoming() != "[":
        yield value()
    else:
        if not inside:
            at, place = at + 1, place + 1
        mark = upcoming()
        if inside and mark == "]":
            raise ValueError("a comma without an element")
        while mark != "]":
            yield value()
            mark = upcoming()
            if mark not in ("]", ",") or not mark:
                raise ValueError("an array goes on without a comma")
            if mark == ",":
                if stop is not None and place >= stop:
                    return
                at, place = at + 1, place + 1
                upcoming()
        at += 1
    if upcoming():
        raise ValueError("text after the end")


def json_depth(text: str) -> int:
    """Levels of a JSON text."""
    if text.count("[") + text.count("{") <= JSON_DEPTH:
        return 0  # no more than that in any case
    depth = deepest = 0
    for token in _TOKEN.finditer(text.encode("utf-8", "surrogatepass")):
        mark = token.group()[0]
        if mark in b"[{":
            depth += 1
            deepest = max(deepest, depth)
        elif mark in b"]}":
            depth -= 1
    return deepest


def _read_elements(root: str, names: list[str], path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = locate(root)
        for batch in batches:
            for row in batch.to_dict("records"):
                place = base + row[path]
                about = [row[n] for n in names]
                start, stop = int(row["start"]), int(row["stop"])
                if start:
                    at = json_separator(_read(system, place, start, stop), int(row["state"]), int(row["depth"]))
                    if at < 0:
                        continue
                    start += at + 1
                part: list[str | None] = []
                codes: list[str | None] = []
                size, code = 0, None

                def out(part: list, codes: list, about: list = about) -> pd.DataFrame:
                    return pd.DataFrame([about] * len(part), columns=names).assign(
                        text=part, broken=[c == errors.JSON_PARSE for c in codes], code=codes
                    )

                with system.open_input_file(place) as stream:
                    stream.seek(start)
                    try:
                        for text in json_elements(stream.read, inside=row["start"] > 0, stop=stop - start):
                            deep = json_depth(text) > JSON_DEPTH
                            part.append(None if deep else text)
                            codes.append(errors.JSON_TOO_DEEP if deep else None)
                            size += len(text)
                            if size > BATCH_BYTES:
                                yield out(part, codes)
                                part, codes, size = [], [], 0
                    except ValueError:
                        code = errors.JSON_PARSE
                    except RecursionError:
                        code = errors.JSON_TOO_DEEP
                # The last row says how the block ended, also where it has no element.
                yield out([*part, None], [*codes, code])

    return run


def planned_json(
    files: DataFrame, root: str, path: str = "dest_path", tasks: int | None = None, block: int = BLOCK
) -> DataFrame:
    """``files`` with a row per JSON element (``text``), and one without for each block, whose ``code`` says what is
    wrong: ``E_JSON_PARSE`` (then ``broken`` is true) or ``E_JSON_TOO_DEEP``.

    The tasks open the files that are asked for and no others. A file that is one array is read by as many tasks as it
    has blocks; each reads the elements behind the commas of its block. A file that is one value is one task's.
    """
    blocks = file_blocks(files, root, path, block)
    states = _entered(
        blocks, root, path, _json_report, "file string, start bigint, state int, depth bigint", _json_states
    ).withColumnRenamed("start", "at")
    own = [col(c) for c in files.columns]
    small = blocks.where(F.col("stop") - F.col("start") == F.col("size")).select(
        *own, "start", "stop", F.lit(OUT).alias("state"), F.lit(0).cast("long").alias("depth")
    )
    met = blocks.join(states, (blocks[path] == states["file"]) & (blocks["start"] == states["at"]))
    rows = small.unionByName(met.select(*own, "start", "stop", "state", "depth"))
    spread = rows.repartition(tasks or shuffle_tasks(files.sparkSession), col(path), "start")
    schema = T.StructType([*files.schema.fields]).add("text", "string").add("broken", "boolean").add("code", "string")
    return spread.mapInPandas(_read_elements(root, files.columns, path), schema)
