import zlib
from collections import Counter

import pytest

from driftspark.llm import shards


def test_assignment_follows_the_contract(make_docs):
    rows = [(n, f"text {n % 7}" * (n % 5)) for n in range(3000)] + [(None, None), (None, ""), (5, "again"), (5, "again")]
    found = shards.assign(make_docs(rows, ["shard", "file", "block"]), 24).collect()
    assert len(found) == len(rows)
    by_shard = {}
    for r in found:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert sorted(by_shard) == list(range(24))
    for slots in by_shard.values():
        assert sorted(slots) == list(range(len(slots)))
    moved = [r for r in found if r.shard != r.grown_shard]
    assert moved and all(r.grown_shard == 24 for r in moved)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows
    )
    assert len({r.shard for r in found if r.doc_id is None}) == 1
    assert len({r.shard for r in found if r.doc_id == 5}) == 1
    sizes = [len(s) for s in by_shard.values()]
    assert max(sizes) < 2 * min(sizes)


def test_small_blocks_number_without_gaps(make_docs, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK_ROWS", 10)
    found = shards.assign(make_docs([(n % 3, "x") for n in range(500)]), 24).collect()
    for shard in {r.shard for r in found}:
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_weights_decide_shares_and_confine_movement(make_docs):
    docs = make_docs([(n, "x") for n in range(6000)])
    tree = [shards.Shard(0, 0, 0, 1.0), shards.Shard(1, 0, 1, 3.0), shards.Shard(2, 1, 0, 4.0), shards.Shard(3, 1, 1, 0.0)]
    heavier = [*tree[:2], shards.Shard(2, 1, 0, 8.0), tree[3]]
    before = {r.doc_id: (r.shard, r.grown_shard) for r in shards.assign(docs, 4, tree=tree, grown=heavier).collect()}
    share = Counter(s for s, _ in before.values())
    assert share[3] == 0
    assert abs(share[0] / 6000 - 1 / 8) < 0.03 and abs(share[2] / 6000 - 1 / 2) < 0.03
    assert all(new == 2 for old, new in before.values() if old != new)


def test_empty_table_and_too_few_shards(make_docs):
    assert shards.assign(make_docs([]), 24).count() == 0
    with pytest.raises(ValueError):
        shards.uniform_tree(23)
