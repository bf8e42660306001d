import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from driftspark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own


def test_word_by_word_ids_are_those_of_whole_texts():
    rnd = random.Random(6)
    parts = [" ", "  ", "\n", "\t", " ", "don't", "a", "Word", "12", "é", ".", "!!", "<|endoftext|>", "\r\n", "🙂"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)] + [None, "", " ", "a "]
    encoder, plain = packing.Encoder(PATH), tokenizer()
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        expected = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(ids, "<u4").tolist() == expected, repr(text)


def test_very_long_white_space():
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" + "\n \u3000" * 400_000 + "b", "x " * 60_000]
    plain = tokenizer()
    for text, ids in zip(texts, packing.Encoder(PATH).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def test_pieces_have_the_ids_of_the_tokenizer_as_loaded(make_docs):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|", "plain", None]
    texts.append("w " * 1500 + "<|endoftext|>" + " " * 150_000 + "\n<|endoftext|> end")
    plain = Tokenizer.from_file(PATH)
    found = packing.pieces(make_docs(list(enumerate(texts))), PATH, with_ids=True).orderBy("doc_id", "piece").collect()
    for n, text in enumerate(texts):
        own = [r for r in found if r.doc_id == n]
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert b"".join(bytes(r.ids) for r in own) == ids.tobytes()
        assert [(r.start, r.length) for r in own] == packing.cut(len(ids))
        assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in own)


def test_bound_and_packing():
    rnd = random.Random(7)
    for _ in range(60):
        lengths = np.array([rnd.randint(1, 1023) for _ in range(rnd.randint(1, 60))])
        bins, place = packing.best_fit_decreasing(lengths)
        made = bins.max() + 1
        assert packing.lower_bound(lengths) <= made
        for b in range(made):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(place[own])]
            assert place[own].tolist() == np.concatenate([[0], np.cumsum(lengths[own])[:-1]]).tolist()
            assert lengths[own].sum() <= 1024
    assert packing.lower_bound(np.array([600, 600, 600])) == 3
    assert packing.lower_bound(np.array([513, 512, 512])) == 2
    assert packing.lower_bound(np.array([400] * 5)) == 3


def test_documents_come_back_whole(make_docs, words):
    rows = [(n, words(20 + 37 * n % 900, n)) for n in range(60)]
    rows += [(100, None), (101, ""), (102, words(6000, 1)), (3, "again"), (3, "again"), (None, "no id")]
    docs = make_docs(rows, ["ids", "bin", "final"])
    for task_pieces in (10, 100_000):
        packed = packing.pack(packing.pieces(docs, PATH, with_ids=True), task_pieces=task_pieces)
        found = packed.collect()
        plain = tokenizer()
        wanted = sorted(np.array([*plain.encode(t or "").ids, 2], "<u4").tobytes() for _, t in rows)
        by_sequence = {}
        for r in found:
            by_sequence.setdefault(r.sequence_id, []).append(r)
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        for own in by_sequence.values():
            at = 0
            for r in sorted(own, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 1024
        by_doc = {}
        for r in found:
            by_doc.setdefault(r.doc_id, []).append(r)
        for i, own in by_doc.items():
            if i != 3:
                own.sort(key=lambda r: r.piece)
                assert b"".join(bytes(r.ids) for r in own) in wanted
                assert [r.piece for r in own] == list(range(len(own)))
                assert all(r.length == 1024 for r in own[1:])
        assert sum(r.length for r in found) == sum(len(w) // 4 for w in wanted)
        assert len(by_sequence) <= packing.lower_bound(np.array([r.length for r in found])) + (4 if task_pieces == 10 else 1)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for i, own in by_sequence.items():
        assert whole[i] == b"".join(bytes(r.ids) for r in sorted(own, key=lambda r: r.offset))
    assert packing.pack(packing.pieces(make_docs([]), PATH)).count() == 0
