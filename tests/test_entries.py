"""Profile entries of many files against a plain profile of each file."""

import hashlib
import json
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftspark.functions import errors
from driftspark.operators import entries, profile
from driftspark.sources import blocks, tables
from driftspark.sources.entries import file_entries

NULLS = set(tables.CSV_NULLS)


def plain(names, columns, kinds, n_rows):
    """Entry from values by column; null is None, numbers are numbers, all else is text."""
    nulls, stats, tops = {}, {}, {}
    for name, kind in zip(names, kinds):
        own = [v for v in columns[name] if v is not None]
        nulls[name] = (n_rows - len(own)) / n_rows if n_rows else 0.0
        if kind in ("int", "float"):
            if own:
                mean = sum(own) / len(own)
                stats[name] = (min(own), max(own), mean, (sum((v - mean) ** 2 for v in own) / len(own)) ** 0.5)
        elif own:
            ranked = sorted(Counter(own).items(), key=lambda x: (-x[1], hashlib.sha256(x[0].encode()).digest()))
            tops[name] = ranked[: profile.TOP_K]
    return n_rows, names, dict(zip(names, kinds)), nulls, stats, tops


def entry_of(row):
    stats = {k: tuple(v) for k, v in row["basic_stats"].items()}
    tops = {k: [(x["value"], x["n"]) for x in v] for k, v in row["top_values"].items()}
    return row["n_rows"], row["columns"], row["dtypes"], row["null_fraction"], stats, tops


def same(found, wanted):
    assert found[:4] == wanted[:4] and found[5] == wanted[5]
    assert found[4].keys() == wanted[4].keys()
    for name, values in wanted[4].items():
        assert found[4][name] == pytest.approx(values, rel=1e-9, abs=1e-9)


@pytest.fixture
def store(tmp_path):
    """Files of three formats with columns of every class, names that repeat or need quoting, nulls and many values."""
    rnd = random.Random(6)
    wanted = {}
    for n in range(4):
        rows = rnd.choice([7, 120])
        data = {
            "id": [rnd.randrange(90) for _ in range(rows)],
            "x y": [rnd.choice([None, rnd.random() * 100]) for _ in range(rows)],
            "word": [rnd.choice([None, *["w%d" % (i * i % 31) for i in range(40)]]) for _ in range(rows)],
            "ok": [rnd.choice([True, False]) for _ in range(rows)],
            "none": [None] * rows,
        }
        if n % 2:
            del data["word"]
        names = list(data)
        texts = {k: ["True" if v is True else "False" if v is False else v for v in c] for k, c in data.items()}
        kinds = {"id": "int", "x y": "float", "word": "string", "ok": "bool"}
        lines = [",".join(names)] + [
            ",".join(rnd.choice(["", "NA", "null"]) if v is None else rnd.choice(["true", "TRUE", "True"]) if v is True else rnd.choice(["false", "False"]) if v is False else repr(v) if isinstance(v, float) else str(v) for v in r)
            for r in zip(*data.values())
        ]
        (tmp_path / f"t {n}+.csv").write_text("\n".join(lines))
        wanted[f"t {n}+.csv"] = plain(names, texts, [kinds.get(c, "float") for c in names], rows)
        objects = [{k: v for k, v in zip(names, r) if v is not None or rnd.random() < 0.5} for r in zip(*data.values())]
        for o in objects:
            o["in"] = {"it's \"?\"": o.get("word"), "é": [1, o["id"] % 2]}
        objects[0] = {**objects[0], **dict.fromkeys(names)} | {"id": objects[0]["id"], "in": objects[0]["in"]}
        dotted = {k: [o.get(k) for o in objects] for k in names} | {
            "in.it's \"?\"": [o["in"]["it's \"?\""] for o in objects], "in.é": [json.dumps(o["in"]["é"], separators=(",", ":")) for o in objects],
        }
        dotted["ok"] = [None if v is None else str(v) for v in dotted["ok"]]
        (tmp_path / f"j{n}.json").write_text(json.dumps(objects))
        order = sorted(names + ["in"])
        leaves = [x for c in order for x in (sorted(["in.it's \"?\"", "in.é"]) if c == "in" else [c])]
        kinds_j = {**kinds, "in.it's \"?\"": "string", "in.é": "object", "none": "string"}
        wanted[f"j{n}.json"] = plain(leaves, dotted, [kinds_j[c] for c in leaves], rows)
        frame = pd.DataFrame({k: pd.Series(c, dtype={"id": "int64", "x y": "float64", "word": "string", "ok": "bool", "none": "string"}[k]) for k, c in data.items()})
        frame.to_parquet(tmp_path / f"p {n}+%.parquet", index=False)
        wanted[f"p {n}+%.parquet"] = plain(names, texts, [kinds.get(c, "string") for c in names], rows)
    (tmp_path / "head.csv").write_text("a,A,,b\n")
    wanted["head.csv"] = plain(["a0", "A1", "_c2", "b"], dict.fromkeys(["a0", "A1", "_c2", "b"], []), ["float"] * 4, 0)
    (tmp_path / "wide.csv").write_text("a,b\n1\n2,x,further\n")
    wanted["wide.csv"] = plain(["a", "b"], {"a": [1, 2], "b": [None, "x"]}, ["int", "string"], 2)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "plain.json").write_text("[3, 1, null, 1.5]")
    frame.iloc[:0].to_parquet(tmp_path / "rowless.parquet", index=False)
    wanted |= {
        "empty.csv": plain([], {}, [], 0), "none.json": plain([], {}, [], 0),
        "plain.json": plain(["value"], {"value": [3, 1, None, 1.5]}, ["float"], 4),
        "rowless.parquet": plain(names, dict.fromkeys(names, []), [kinds.get(c, "string") for c in names], 0),
    }
    return tmp_path, wanted


def test_entries_of_three_formats(spark, store, monkeypatch):
    folder, wanted = store
    (folder / "broken.json").write_text("[1,")
    (folder / "broken.parquet").write_bytes(b"PAR1")
    (folder / "note.TXT").write_text("x")
    monkeypatch.setattr(blocks.csv_records, "__defaults__", ("dest_path", 300, None))
    names = [*wanted, "broken.json", "broken.parquet", "note.TXT"]
    asked = spark.createDataFrame([(n,) for n in names + names[:3]], "dest_path string")
    found = {r["dest_path"]: r for r in file_entries(spark, asked, str(folder)).collect()}
    assert found.keys() == set(names)
    for name, entry in wanted.items():
        same(entry_of(found[name]), entry)
        assert found[name]["note"] is None
        assert found[name]["schema_fingerprint"] == profile.fingerprint_of(entry[1], entry[2])
    assert found["broken.json"]["note"] == errors.JSON_PARSE
    assert found["broken.parquet"]["note"].startswith(errors.SCHEMA_UNSUPPORTED)
    assert found["note.TXT"]["note"] == "unsupported extension: .txt"
    for name in names[-3:]:
        assert entry_of(found[name]) == (0, [], {}, {}, {}, {})


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    for n in range(200):
        pd.DataFrame({"a": [n, n], "b": ["x", str(n)]}).to_parquet(tmp_path / f"{n}.parquet", index=False)
    spark.range(1).count()

    def jobs(count):
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"entries{count}", "")
        asked = spark.createDataFrame([(f"{n}.parquet",) for n in range(count)], "dest_path string")
        rows = file_entries(spark, asked, str(tmp_path)).collect()
        assert {r["dest_path"]: r["basic_stats"]["a"]["max"] for r in rows} == {f"{n}.parquet": float(n) for n in range(count)}
        return len(tracker.getJobIdsForGroup(f"entries{count}"))

    few, many = jobs(3), jobs(200)
    spark.sparkContext.setJobGroup("", "")
    assert many <= few + 3


def test_no_files(spark, tmp_path):
    asked = spark.createDataFrame([], "dest_path string")
    assert file_entries(spark, asked, str(tmp_path)).collect() == []


def test_short_values_are_read_once_and_long_ones_are_found_again(spark, tmp_path):
    """Values on both sides of the limit, ties and nulls; a table of short values is not read a second time."""
    rnd = random.Random(6)
    texts = ["a", "é" * 32, "é" * 33, "b" * 64, "c" * 65, "d" * 500, "", *[f"{'e' * 70}{i}" for i in range(12)], None]
    rows = [("f", i % 2, rnd.choice(texts[: 7 if i % 2 else None])) for i in range(400)]
    rows += [("g", 0, rnd.choice(["x", "y", "", None])) for _ in range(50)]
    path = str(tmp_path / "values")
    spark.createDataFrame(rows, "dest_path string, position int, value string").write.parquet(path)
    values = spark.read.parquet(path)
    found = {}
    for r in entries.frequent_values(values, 5).orderBy("dest_path", "position", "rank").collect():
        found.setdefault((r["dest_path"], r["position"]), []).append((r["value"], r["n"]))
    for key in {r[:2] for r in rows}:
        counts = Counter(v for *k, v in rows if tuple(k) == key and v is not None)
        assert found[key] == sorted(counts.items(), key=lambda x: (-x[1], hashlib.sha256(x[0].encode()).digest()))[:5]
    short = entries.frequent_values(values.where("dest_path = 'g'"), 5)
    assert not set(short.inputFiles()) & set(values.inputFiles())
    assert short.count() == 3


def test_leaves_at_the_top_need_no_path(spark):
    """A path that is no constant is parsed for every value, so leaves at the top are looked up by their key."""
    documents = ['{"a?": 1, "b": {"c": "x", "d": null}, "": [1]}', '{"a?": null, "b": {"c": 2}}', '{"b": 3}', "7", "null"]
    ways = [(["a?"], "no path"), (["b"], "no path"), ([""], None), (["b", "c"], '$["b"]["c"]'), (["b", "d"], None), ([], "$")]
    leaves = spark.createDataFrame([(i, (w, p)) for i, (w, p) in enumerate(ways)], "i int, leaf struct<way: array<string>, path: string>")
    items = spark.createDataFrame(list(enumerate(documents)), "j int, text string").withColumn("item", F.parse_json("text"))
    cells = items.withColumn("fields", tables.item_fields(F.col("item"))).crossJoin(leaves)
    found = cells.select("i", "j", F.to_json(tables.leaf_value(F.col("item"), F.col("fields"), F.col("leaf"))).alias("v"))
    for r in found.collect():
        value = json.loads(documents[r["j"]])
        for key in ways[r["i"]][0]:
            value = value.get(key) if isinstance(value, dict) else None
        assert (None if r["v"] is None else json.loads(r["v"])) == value
