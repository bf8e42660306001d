"""Files read by blocks give what a reader of the whole file gives."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from driftspark.functions import errors
from driftspark.sources import blocks, tables


def csv_text(rnd, rows):
    """Cells with commas, doubled quotes, line breaks, quotes within plain cells and empty lines."""
    parts = ["a", "b c", ",", '"', '""', "\n", "\r\n", "é", "x" * 9, ""]
    lines = []
    for n in range(rows):
        cells = []
        for _ in range(rnd.choice([1, 3, 3, 3, 4])):
            cell = "".join(rnd.choice(parts) for _ in range(rnd.randrange(5)))
            if any(c in cell for c in ',"\n\r') and not (cell[:1] != '"' and not any(c in cell for c in ",\n\r") and rnd.random() < 0.5):
                cell = '"' + cell.replace('"', '""') + '"' + rnd.choice(["", "", "", "z"])
            cells.append(cell)
        lines.append(",".join(cells) + rnd.choice(["\n", "\r\n", "\n\n"]))
    return "".join(lines) + rnd.choice(["", "last,one,here", 'last,"open'])


def records_of(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@pytest.mark.parametrize("seed", range(40))
def test_states_at_every_cut(seed):
    """Every record start that is found from the state at a cut is one of the whole file, and none is left out."""
    rnd = random.Random(seed)
    data = csv_text(rnd, 6).encode()
    starts, at = {0}, 0
    state, first = blocks.OUT, -1
    # One byte at a time: the state machine at its finest.
    for n in range(len(data)):
        state, first = blocks.csv_exit(data[n : n + 1], data[n - 1 : n] if n else b"", state)
        if first >= 0:
            starts.add(n + first)
    for size in (2, 3, 7, 20):
        found, state = {0}, blocks.OUT
        for at in range(0, len(data), size):
            part = data[at : at + size]
            state, first = blocks.csv_exit(part, data[max(at - 1, 0) : at], state)
            if first >= 0:
                found.add(at + first)
                assert at + first in starts
    cuts = sorted(starts)
    parts = [data[a:b].decode() for a, b in zip(cuts, [*cuts[1:], len(data)])]
    assert [r for p in parts for r in records_of(p)] == records_of(data.decode())


@pytest.mark.parametrize("block", [5, 64, 4096, 8 << 20])
def test_csv_by_blocks(spark, tmp_path, block):
    rnd = random.Random(block)
    texts = {"a.csv": csv_text(rnd, 80), "b.csv": "﻿\"x\ny\",q\n1,2\n", "empty.csv": "", "head.csv": "only,names", "c.csv": "\n\n" + csv_text(rnd, 3)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    asked = spark.createDataFrame([(n, 7) for n in [*texts, "lost.csv", "../b.csv"]], "dest_path string, size int")
    asked = asked.withColumnRenamed("size", "n")
    found = blocks.csv_records(asked, str(tmp_path), block=block).collect()
    for name, text in texts.items():
        records = records_of(text.removeprefix("﻿"))
        own = [r for r in found if r["dest_path"] == name]
        assert [r["cells"] for r in own if r["header"]] == records[:1]
        assert sorted(r["cells"] for r in own if not r["header"]) == sorted(records[1:])
    assert {r["dest_path"] for r in found} <= set(texts)


def test_one_csv_file_is_read_by_many_tasks_like_multi_line(spark, tmp_path, monkeypatch):
    rnd = random.Random(2)
    with (tmp_path / "t.csv").open("w") as out:
        writer = csv.writer(out)
        writer.writerow(["id", "text", "Text", ""])
        for n in range(3000):
            writer.writerow([n, "".join(rnd.choice(["word ", "\n", ",", '"', "é"]) for _ in range(30)) + ".", n % 7 / 2, "x"])
    monkeypatch.setattr(blocks.csv_records, "__defaults__", ("dest_path", 5000, None))
    path = str(tmp_path / "t.csv")
    df = tables.read_csv_table(spark, path)
    spark_own = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    assert df.columns == spark_own.columns == ["id", "text1", "Text2", "_c3"]
    assert df.dtypes == [("id", "bigint"), ("text1", "string"), ("Text2", "double"), ("_c3", "string")]
    # The other reader makes one line break of two characters.
    texts = lambda x: sorted((int(r[0]), r[1].replace("\r", ""), float(r[2]), r[3]) for r in x.collect())
    assert texts(df) == texts(spark_own)
    asked = spark.createDataFrame([("t.csv",)], "dest_path string")
    used = blocks.csv_records(asked, str(tmp_path), block=5000).groupBy(F.spark_partition_id()).count().count()
    assert used > 3


JSON_VALUES = [{"a": 1}, [1, [2, {"b": "],["}]], "x\\\"y,", "", 12, -1.5e3, None, True, {"é\n": {"c": []}}, {}, "\\", [[]], "a" * 50]


@pytest.mark.parametrize("block", [3, 17, 200, 8 << 20])
def test_json_by_blocks(spark, tmp_path, block):
    rnd = random.Random(block)
    arrays = {f"{n}.json": [rnd.choice(JSON_VALUES) for _ in range(rnd.randrange(30))] for n in range(6)}
    for n, (name, data) in enumerate(arrays.items()):
        (tmp_path / name).write_text(("﻿" if n == 1 else " \n") + json.dumps(data, indent=n % 3 or None, ensure_ascii=n % 2 == 0) + " \n", "utf-8")
    one = {"o.json": {"k": [1, 2, {"z": "," * 400}]}, "s.json": "x,y" * 90}
    for name, data in one.items():
        (tmp_path / name).write_text(json.dumps(data))
    broken = ["[1,2,3,4,5,6,7,8,9", "[1,2 3,4,5,6,7]", "[1,2,]" + " " * 30, '["a","b,c]', "[1,2,3]" + " " * 40 + "x", "[" + "1," * 40 + "]", "", "{not", "[[1,2],[3,4]],[5]"]
    for n, text in enumerate(broken):
        (tmp_path / f"w{n}.json").write_text(text)
    names = [*arrays, *one, *[f"w{n}.json" for n in range(len(broken))], "lost.json"]
    asked = spark.createDataFrame([(n,) for n in names], "dest_path string")
    found = blocks.planned_json(asked, str(tmp_path), block=block).collect()
    wrong = {r["dest_path"] for r in found if r["broken"]}
    assert wrong == {f"w{n}.json" for n in range(len(broken))}
    for name, data in {**arrays, **{n: [d] for n, d in one.items()}}.items():
        texts = [json.loads(r["text"]) for r in found if r["dest_path"] == name and r["text"] is not None]
        assert sorted(map(json.dumps, texts)) == sorted(map(json.dumps, data))


def test_json_states_at_every_cut():
    text = json.dumps(JSON_VALUES * 2, ensure_ascii=False).encode()
    for size in (1, 2, 3, 11):
        state, depth = blocks.OUT, 0
        for at in range(0, len(text), size):
            state, change = blocks.json_exit(text[at : at + size], state)
            depth += change
        assert (state, depth) == (blocks.OUT, 0)


def test_what_the_engine_does_not_take(spark, tmp_path):
    deep = "[" * 1200 + "]" * 1200
    (tmp_path / "nan.json").write_text('[{"a": NaN, "b": [Infinity, -Infinity, 1]}, {"a": 2}]')
    (tmp_path / "deep.json").write_text(f"[1, {deep}]")
    (tmp_path / "deeper.json").write_text("[" * 60_000 + "]" * 60_000)
    (tmp_path / "large.json").write_text('["' + "x" * 30_000_000 + '"]')
    asked = spark.createDataFrame([(n,) for n in ("nan.json", "deep.json", "deeper.json", "large.json")], "dest_path string")
    items = tables.parsed_items(asked, str(tmp_path))
    codes = {r["dest_path"]: r["code"] for r in items.groupBy("dest_path").agg(F.min("code").alias("code")).collect()}
    assert codes == {
        "nan.json": None, "deep.json": errors.JSON_TOO_DEEP, "deeper.json": errors.JSON_TOO_DEEP, "large.json": errors.JSON_ITEM_TOO_LARGE,
    }
    rows = tables.read_json_table(spark, str(tmp_path / "nan.json")).orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(None, [None, None, 1]), (2, None)]
    for name, code in [("deep", errors.JSON_TOO_DEEP), ("large", errors.JSON_ITEM_TOO_LARGE)]:
        assert tables.read_table(spark, str(tmp_path / f"{name}.json"))[1].startswith(code)


def test_a_large_array_through_the_table_reader(spark, tmp_path):
    """150 MB, more than the engine takes as one value, by several tasks."""
    line = json.dumps({"n": 1, "text": "x" * 10_000})
    with (tmp_path / "big.json").open("w") as out:
        out.write("[" + ",\n".join([line] * 15_000) + "]")
    df = tables.read_json_table(spark, str(tmp_path / "big.json"))
    assert df.agg(F.sum("n"), F.min(F.length("text"))).first()[:] == (15_000, 10_000)
    asked = spark.createDataFrame([("big.json",)], "dest_path string")
    items = blocks.planned_json(asked, str(tmp_path)).where("text is not null")
    assert items.groupBy(F.spark_partition_id()).count().count() > 2
