import re

import pytest

from lakeweave.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, share=1.5, cap=2.0, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, active = {}, share * sum(sizes.values()), set(order)
    while active:
        level = left / sum(w[s] for s in active)
        above = {s for s in active if level * w[s] > cap * sizes[s]}
        if not above:
            return out | {s: level * w[s] for s in active}
        for s in above:
            out[s] = cap * sizes[s]
            left -= out[s]
        active -= above
    return out


def rows():
    out = [(i, "ab"[i % 2] if i % 7 else None, "w " * (1 + i * 37 % 90), i) for i in range(600)]
    out += [(600 + i, "hot", "x y z " * (1 + i % 40), 0) for i in range(400)]
    out += [(2000, "hot", "long " * 6000, 0), (2001, "small", "one", 0), (2002, "empty", "", 0), (2003, "empty", None, 0), (2004, "a", "", 0), (5, "b", "same row", 0), (5, "b", "same row", 0), (None, "b", "no id here", 0)]
    return out


def run(spark, tmp_path, data):
    spark.createDataFrame(data, "doc_id long, source string, text string, rate int").write.parquet(str(tmp_path / "documents.parquet"))
    return M.op3_mixing(spark, str(tmp_path)).collect()


def test_targets_and_taken_words(spark, tmp_path):
    data = rows()
    got = run(spark, tmp_path, data)
    assert len(got) == len(data)
    sizes = {}
    for _, s, t, _ in data:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = targets(sizes)
    source = {d: s for d, s, _, _ in data}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 3), (s, taken[s], want[s])
    again = M.op3_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rates_meet_targets_before_rounding(spark, tmp_path):
    data = rows()
    got = run(spark, tmp_path, data)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.rate * r.size)
    for (_, target), parts in by.items():
        assert sum(parts) == pytest.approx(target, rel=1e-6, abs=1e-9)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_many_rows_of_one_id_or_none_share_no_bucket(spark):
    import math

    rows = [(None if i % 2 else 7, "a", "w " * (1 + i % 9)) for i in range(600)] + [(9, "a", "same text")] * 600
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    got = M.mix(docs, bucket_rows=64).collect()
    assert len(got) == 1200 and max(r.copies for r in got) <= 2
    size, target = sum(r["size"] for r in got), got[0].target
    assert abs(sum(r.copies * r["size"] for r in got) - target) <= 0.02 * target and math.isclose(target, 1.5 * size)
    assert sorted(map(str, M.mix(docs, bucket_rows=64).collect())) == sorted(map(str, got))
