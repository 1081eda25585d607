import random
import time

import numpy as np

from lakeweave.llm import decontaminate as D


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence_equals_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(0, 40))] for _ in range(2))
        assert D.common_subsequence(a, b) == lcs(a, b)


def world():
    rng = random.Random(1)
    vocabulary = [f"word{i}" for i in range(3000)]
    text = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, text(rng.choice([12, 25, 40, 90])), None) for i in range(30)]
    docs, want = [], set()
    for d in range(300):
        w = text(rng.randrange(5, 400))
        if d % 10 == 0:
            i = rng.randrange(30)
            copy = list(items[i][1])
            if d % 20 == 0:  # a paraphrase: one word in six replaced or dropped, the end kept
                copy = [x for j, x in enumerate(copy) if j % 6 or j >= len(copy) - 6]
            at = rng.randrange(len(w) + 1)
            w[at:at] = copy
            want.add((d, i))
        docs.append((d, " ".join(w).title() if d % 3 else "\n".join(w)))
    return docs, [(i, " ".join(w), a) for i, w, a in items], want


def write(spark, path, docs, items):
    spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, item_id string, cosine double").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t, _ in items], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_copies_and_paraphrases_are_found_and_clean_texts_left(spark, tmp_path):
    docs, items, want = world()
    docs += [(1000, None), (1001, ""), (1002, "word1 " * 30000), (0, docs[0][1]), (None, docs[10][1])]
    items += [(100, None, None), (101, "", None), (102, "single", None), (103, items[0][1], None)]
    write(spark, tmp_path, docs, items)
    got = {(r.doc_id, r.item_id) for r in D.op4_decontaminate(spark, str(tmp_path)).collect() if r.item_id != 103}
    by_text = {i for d, i in want if d == 10}
    assert got == want | {(None, i) for i in by_text}


def test_blocks_of_the_benchmark_give_the_same(spark, tmp_path, monkeypatch):
    docs, items, want = world()
    write(spark, tmp_path, docs, items)
    monkeypatch.setattr(D, "BLOCK", 17)
    assert {(r.doc_id, r.item_id) for r in D.op4_decontaminate(spark, str(tmp_path)).collect()} == want


def test_an_answer_decides_for_paraphrases(spark):
    item = "the quick brown fox jumps over a lazy dog near some river bank today"
    changed = "the fast brown fox leaps over a sleepy dog near some river shore now and then forty two"
    docs = spark.createDataFrame([(1, 7, changed), *[(i, i, f"other text {i} about things") for i in range(20, 40)]], "row long, doc_id long, text string")
    items = lambda a: spark.createDataFrame([(1, item, a)], "item_id long, text string, answer string")
    assert [r.doc_id for r in D.find_leaks(docs, items("forty two")).collect()] == [7]
    assert D.find_leaks(docs, items("fifty one")).collect() == []


def test_svd_spans_the_matrix(spark):
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 1 << 62, 20).astype(np.uint64).tobytes() for _ in range(12)]
    idf = np.ones(D.TERMS)
    basis = D.randomised_svd(spark.createDataFrame([(bytearray(p),) for p in parts], "part binary").repartition(3), idf)
    row, t, value = D._tfidf(parts, idf)
    a = np.zeros((12, D.TERMS))
    a[row, t] = value
    assert np.allclose(a @ basis @ basis.T, a, atol=1e-4)


def test_a_benchmark_of_many_directions_loses_no_copy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "RANK", 8)
    monkeypatch.setattr(D, "SPACES", 3)
    monkeypatch.setattr(D.randomised_svd, "__defaults__", (8, 7))
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices([f"word{j}" for j in range(3000)], k=rng.choice([15, 30, 58]))), None) for i in range(150)]
    other = lambda n: " ".join(rng.choices([f"other{j}" for j in range(3000)], k=n))
    drop = lambda t: " ".join(x for j, x in enumerate(t.split()) if j % 6 or not j)
    docs = [(i, f"{other(70)} {drop(t) if i % 2 else t} {other(50)}") for i, t, _ in items]
    write(spark, tmp_path, docs, items)
    for gram in (8, 1000):  # by short runs of words, by whole items
        monkeypatch.setattr(D, "GRAM", gram)
        got = [(r.doc_id, r.item_id) for r in D.op4_decontaminate(spark, str(tmp_path)).collect()]
        assert sorted(got) == [(i, i) for i in range(150)]


def test_items_of_words_in_most_documents_are_found(spark, tmp_path):
    rng = random.Random(6)
    common = [f"word{j}" for j in range(40)]
    items = [(i, " ".join(rng.choices(common, k=k)), None) for i, k in enumerate([12, 25, 40, 90])]
    docs = [(100 + d, " ".join(rng.choices(common, k=200))) for d in range(60)]
    docs += [(i, " ".join(f"rare{i}x{j}" for j in range(20)) + f" {t} " + " ".join(f"rare{i}y{j}" for j in range(20))) for i, t, _ in items]
    write(spark, tmp_path, docs, items)
    got = {(r.doc_id, r.item_id): r.lcs for r in D.op4_decontaminate(spark, str(tmp_path)).collect()}
    assert all(got[i, i] == 1 for i, _, _ in items)


def test_every_term_has_a_weight(spark):
    text = "all of these words are in every document of the table"
    docs = spark.createDataFrame([(i, i, text) for i in range(50)], "row long, doc_id long, text string")
    got = D.find_leaks(docs, spark.createDataFrame([(1, text, None)], "item_id long, text string, answer string")).collect()
    assert len(got) == 50 and all(r.cosine > 0.99 for r in got)


def test_items_that_share_an_id_and_leaks_in_many_documents(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices([f"w{j}" for j in range(500)], k=n))
    items = [(5, text(30), None), (5, text(30), None), (None, text(30), None), (None, text(30), None)]
    docs = [(d, d, f"{text(60)} {items[d % 3][1]} {text(20)}" if d < 60 else text(100)) for d in range(200)]
    docs[70] = (70, 70, f"{items[0][1]} {items[1][1]} {items[3][1]}")
    frame = spark.createDataFrame(items, "item_id long, text string, answer string").repartition(2)
    got = D.find_leaks(spark.createDataFrame(docs, "row long, doc_id long, text string"), frame).collect()
    want = [(d, items[d % 3][0]) for d in range(60)] + [(70, 5), (70, 5), (70, None)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.item_id)) for r in got)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path / "a", [], [(1, "some benchmark text", None)])
    assert D.op4_decontaminate(spark, str(tmp_path / "a")).collect() == []
    write(spark, tmp_path / "b", [(1, "text")], [])
    assert D.op4_decontaminate(spark, str(tmp_path / "b")).collect() == []


def test_document_frequencies_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{j}" for j in range(400)], k=rng.randrange(300))) for _ in range(60)] + [None, "", "w1 W1 w1"]
    got, n = D.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    term = lambda x: int(D._terms(D.words_of(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)])).hashes())[0])
    want = np.zeros(D.TERMS, np.int64)
    for t in texts:
        for x in {term(x) for x in (t or "").lower().split()}:
            want[x] += 1
    assert n == len(texts) and np.array_equal(got, want)


def test_sums_of_rows_equal_brute_force_and_cost_less_than_reduceat():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(4000, D.RANK)).astype(np.float32)
    size = rng.integers(0, 17, 8000)
    group, own = np.repeat(np.arange(8000), size), rng.integers(0, 4000, size.sum()).astype(np.int32)
    y, want = np.ones((8000, D.RANK), np.float32), np.ones((8000, D.RANK))
    for g, i in zip(group[:5000].tolist(), own[:5000].tolist(), strict=True):
        want[g] += rows[i]
    D.add_rows(y, rows, own[:5000], group[:5000])
    assert np.allclose(y, want, atol=1e-4)
    D.add_rows(y, rows, own[:0], group[:0])
    assert np.allclose(y, want, atol=1e-4)

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    plain = min(seconds(lambda: np.add.reduceat(rows[own], cut, axis=0)) for _ in range(3))
    assert min(seconds(lambda: D.add_rows(y, rows, own, group)) for _ in range(3)) < plain / 2
