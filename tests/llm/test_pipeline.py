import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from driftspark.llm import simhash


def test_planted_documents(spark, tmp_path, words):
    rnd = random.Random(9)
    rows, labels = [], []
    for n in range(300):
        text, kind = words(60, n), n % 3
        if kind == 0:
            text = text.replace(" ", " idiot ", 1).replace(" ", " moron ", 2)
        if kind == 1:
            text = text.upper().replace(" ", "!! ")
        rows.append((n, text))
        labels.append((n, int(kind != 1), int(kind == 0)))
    item = words(50, 1000)
    rows += [(400, words(70, 400)), (401, words(70, 400)), (402, words(70, 400) + " tail")]
    rows += [(410, words(20, 410) + " " + item + " " + words(20, 411)), (411, words(65, 412) + " write to a.b@mail.example.org now")]
    rows += [(420, words(60, 420) + " worthless idiot"), (421, words(60, 421).upper().replace(" ", "!! ")), (430, None), (431, "")]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(
        [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left, columns, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, left, str(tmp_path)).write.parquet(path)
        left = spark.read.parquet(path)
        if name != "packing":
            assert left.columns == columns
        kept[name] = {r.doc_id for r in left.collect()}
    good = {n for n in range(300) if n % 3 == 2}
    assert len(good - kept["quality"]) <= 2 and not {n for n in range(300) if n % 3 != 2} & kept["quality"]
    assert {400, 401, 402, 410, 411} <= kept["quality"] and not {420, 421} & kept["quality"]
    # One of each group stays: 402 only if its fingerprint is farther away.
    near = (simhash.fingerprint(words(70, 400)) ^ simhash.fingerprint(words(70, 400) + " tail")).bit_count() <= 4
    gone = kept["quality"] - kept["near_duplicates"]
    assert gone - {431} == ({401, 402} if near else {401})
    assert kept["near_duplicates"] - kept["decontamination"] == {410}
    assert kept["personal_data"] == kept["decontamination"]
    text = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/personal_data").collect()}
    assert text[411].text.endswith("write to <EMAIL> now") and text[411].n_chars == len(text[411].text)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = {i: len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1 for i, r in text.items()}
    found = {}
    for r in left.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == wanted
    sizes = np.array(list(wanted.values()))
    assert left.select("sequence_id").distinct().count() <= -(-sizes.sum() // 1024) + 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(left.collect())
