import struct

import numpy as np
import pytest
import xxhash

from lakeweave.llm import sharding as H


def test_table_is_even_and_stable():
    names = tuple(f"s{i}" for i in range(10))
    a, b = H.lookup_table(names, 1009), H.lookup_table(names[:-1], 1009)
    counts = np.bincount(a)
    assert counts.max() - counts.min() <= 1 and len(a) == 1009
    assert (a[a != 9] == b[a != 9]).mean() > 0.8
    with pytest.raises(ValueError):
        H.lookup_table(names, 1000)
    with pytest.raises(ValueError):
        H.lookup_table(("a", "a"), 11)


def test_placement(spark, tmp_path):
    data = [(i, "t", "old") for i in range(5000)] + [(None, None, "old")] * 2 + [(1, "t", "old")]
    spark.createDataFrame(data, "doc_id long, text string, shard string").write.parquet(str(tmp_path / "documents.parquet"))
    got = H.op9_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(data)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.shard)
    assert all(len(s) == 1 for s in by.values())
    counts = np.bincount([r.shard for r in got], minlength=len(H.SHARDS))
    assert counts.min() > 10 and counts.max() < 90
    out = str(tmp_path / "out")
    H.write_shards(H.place(spark.createDataFrame(data, "doc_id long, text string, shard string")), out, 2)
    assert spark.read.parquet(out).count() == len(data)


def test_empty_table(spark):
    assert H.place(spark.createDataFrame([], "doc_id long")).collect() == []


def test_columns_of_any_name_stay(spark):
    rows = spark.createDataFrame([(1, 2, 3, 4)], "doc_id long, __slot int, slot_ int, shard int")
    assert H.place(rows).columns[:3] == ["doc_id", "__slot", "slot_"] and H.place(rows).first()["__slot"] == 2


def test_shards_equal_brute_force(spark):
    ids = [0, 1, -5, 1 << 40, *range(1000, 1300)]
    names = [f"s{i}" for i in range(7)]
    table, turn = [None] * 1009, 0
    orders = []
    for name in names:  # each shard's whole order of preference
        start, step = xxhash.xxh64_intdigest(name, seed=1) % 1009, xxhash.xxh64_intdigest(name, seed=2) % 1008 + 1
        orders.append([(start + i * step) % 1009 for i in range(1009)])
    while None in table:
        slot = next(s for s in orders[turn % 7] if table[s] is None)
        table[slot] = turn % 7
        turn += 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {i: table[signed(xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)) % 1009] for i in ids}
    got = H.place(spark.createDataFrame([(i,) for i in ids], "doc_id long"), shards=tuple(names), size=1009).collect()
    assert {r.doc_id: r.shard for r in got} == want
