import random
import re

import numpy as np
import pytest

from lakeweave.llm import ngram_join as J
from lakeweave.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def grams(text, n):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(data, n, percent):
    sets = [grams(t, n) for _, t in data]
    root = list(range(len(data)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(data)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(data, sets, strict=True)))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 9, 30, 80, 200]))
        for _ in range(8):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    hot = rng.choices(vocabulary, k=60)
    for i in range(60):
        w = list(hot)
        w[i] = "changed"
        out.append(" ".join(w))
    out += ["Same  Text\there now", "same text here now", "", None, "   ", "long " * 20000, "boiler plate line " + " ".join(rng.choices(vocabulary, k=40))]
    rng.shuffle(out)
    data = [(i, t) for i, t in enumerate(out)]
    return [*data, (None, "same text here now"), data[0], data[0]]


@pytest.mark.parametrize(("n", "percent", "tile"), [(3, 90, 1024), (5, 80, 7)])
def test_components_equal_brute_force(spark, monkeypatch, n, percent, tile):
    for name, value in (("TILE", tile), ("CHUNK", 5 * tile), ("HELD", 3 * tile), ("FEW", 8 if tile > 99 else 0)):
        monkeypatch.setattr(J, name, value)
    data = corpus(n)
    got = J.join_components(spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'x' AS component_id", "1 AS row"), n, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(data, n, percent)


def near_copies(count, words, seed, most=3):
    """Copies of one text with some words changed each; many pairs lie on either side of the threshold."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0 if len(out) % 50 == 7 else 1, most)):
            w[rng.randrange(words)] = f"c{rng.randrange(3)}"
        out.append(" ".join(w))
    return list(enumerate(out))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_large_group_of_near_copies_that_are_not_all_linked(spark, n, percent):
    data = near_copies(1200, 60, n)
    got = J.join_components(spark.createDataFrame(data, "doc_id long, text string").repartition(6), n, percent).collect()
    want = brute(data, n, percent)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert 1 < len({c for _, _, c in want}) < 1200


def vectors(rng, copies, groups=128):
    base = rng.poisson(2, size=(20, groups))
    return np.concatenate([np.clip(base + (rng.random(base.shape) < 0.02) - (rng.random(base.shape) < 0.02), 0, 255) for _ in range(copies)]).astype(np.uint8)


def test_tree_search_keeps_every_pair_within_the_bound():
    rng = np.random.default_rng(1)
    v = vectors(rng, 30)
    size = v.sum(1, dtype=np.int64)
    got = set(zip(*(x.tolist() for x in J.RTree(v, size).search(v[::7], size[::7], 0.9)), strict=True))
    over, total = np.minimum(v[::7, None], v[None]).sum(2, dtype=int), size[::7, None] + size[None]
    like = np.minimum(size[::7, None], size[None]) >= 0.9 * np.maximum(size[::7, None], size[None])
    assert got == set(zip(*(x.tolist() for x in np.nonzero((over >= 0.9 * total / 1.9 - 1e-6) & like)), strict=True))


@pytest.mark.parametrize("cut", [0, 90])
def test_forests_join_what_all_pairs_join(monkeypatch, cut):
    monkeypatch.setattr(J, "FEW", 0)
    rng = np.random.default_rng(3)
    v = vectors(rng, 10)[rng.permutation(200)]
    size, component = v.sum(1, dtype=np.int64), rng.integers(0, 60, len(v))
    left = np.arange(cut or 200)
    right = np.arange(cut, 200) if cut else left
    every, hidden = J.forests(v, size, component, left, right, 0.9, J.FORESTS + 1)
    assert not hidden and all(component[a] != component[b] for a, b in every)

    def joined(pairs):
        label = component.copy()
        for a, b in pairs:
            label[label == label[a]] = label[b]
        return len(set(label.tolist()))

    for most in (1, 8):
        some, hidden = J.forests(v, size, component, left, right, 0.9, most)
        assert set(some) <= set(every) and joined(some) == joined(every) and len(some) <= most * 59
        assert hidden or {frozenset(p) for p in some} == {frozenset(p) for p in every}


def test_forests_with_marks_are_of_links(monkeypatch):
    monkeypatch.setattr(J, "LOOKED_UP", 3000)
    rng = np.random.default_rng(7)
    base = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(300) < rng.choice([0.02, 0.06]), rng.integers(1, 1 << 62, 300).astype(np.uint64), base)) for _ in range(150)]
    g, at = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    marks = J.Marks((g >> np.uint64(8) & np.uint64((1 << J.MARK_BITS) - 1)).astype(np.uint32), at)
    v, size = J.matrix(*J.count_vectors(g, at)), np.diff(at)
    links = {(x, y) for x in range(150) for y in range(150) if x > y and J.linked(len(np.intersect1d(sets[x], sets[y])), size[x] + size[y], 90)}
    every = np.arange(150)
    bounded, _ = J.forests(v, size, every, every, every, 0.9, J.FORESTS + 1)
    assert links < set(bounded)
    for left, right in ((every, every), (every[:70], every[70:])):
        pairs, hidden = J.forests(v, size, every, left, right, 0.9, 1, marks)
        own = {p for p in links if left is right or (p[0] >= 70) != (p[1] >= 70)}

        def joined(found):
            label = every.copy()
            for a, b in found:
                label[label == label[a]] = label[b]
            return len(set(label.tolist()))

        assert {(max(p), min(p)) for p in pairs} <= own and joined(pairs) == joined(own) == 150 - len(pairs) and hidden == (len(pairs) < len(own))
    assert J.forests(v, size, np.zeros(150, int), every, every, 0.9, 1, marks) == ([], False)


def test_rows_of_cells_grow_with_a_group_of_near_copies(spark, monkeypatch):
    """Not with its square: most pairs of the group are no links, but the vectors' bound leaves them in most of its cells."""
    seen, apart = [], J._apart

    def counted(pairs, *more, **named):
        seen.append(pairs.count())
        return apart(pairs, *more, **named)

    monkeypatch.setattr(J, "_apart", counted)
    made = []
    for count in (250, 1000):
        rng = random.Random(8)
        base, out = [f"w{i}" for i in range(150)], []
        for _ in range(count):
            w, at = list(base), rng.randrange(100)
            for i in (*range(at, at + 9), *rng.sample(range(150), rng.randint(0, 2))):
                w[i] = f"c{rng.randrange(10**6)}"
            out.append(" ".join(w))
        seen.clear()
        data = list(enumerate(out))
        got = J.join_components(spark.createDataFrame(data, "doc_id long, text string").repartition(6), 5, 80).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(data, 5, 80)
        made.append(sum(seen))
    assert made[1] <= 8 * made[0], made


def test_folded_vectors_are_those_of_fewer_groups():
    rng = np.random.default_rng(5)
    for n in (0, 1, 31, 64, 500, 9000):
        g = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        v, cut = J.count_vectors(g, np.array([0, len(g)]))
        assert cut[-1] == len(v) == min(max(1 << max(n.bit_length() - 1, 0), J.LEAST_GROUPS), J.MOST_GROUPS) and v.sum(dtype=int) == len(g)
        if len(v) > 128:
            group = ((J.mix64(g ^ J._ODD[2]) >> np.uint64(7)) & np.uint64(127)).astype(int)
            assert J._gathered(v, cut, np.array([0]), 128)[0].tolist() == np.minimum(np.bincount(group, minlength=128), 255).tolist()


def test_linked_sets_share_a_cell():
    rng = np.random.default_rng(2)
    first = J.bands(0.8)
    for _ in range(200):
        n = int(rng.integers(1, 120))
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        b = a.copy()
        k = int(rng.integers(0, n // 8 + 1))
        b[:k] = rng.integers(1, 1 << 62, k).astype(np.uint64)
        b = b[int(rng.integers(0, 2)) :] if n > 1 else b
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            g, at = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
            who, cell, up = J.signatures(g, at, 0.8, first)
            shared = [len(set(cell[(who == 0) & (up == x)].tolist()) & set(cell[(who == 1) & (up == y)].tolist())) for x, y in ((0, 0), (0, 1), (1, 0))]
            need = J.needs(g, at, 0.8, first)
            assert any(n >= max(need[x][0], need[y][1]) for n, (x, y) in zip(shared, ((0, 0), (0, 1), (1, 0)), strict=True))


def test_components_of_long_chains_converge(spark):
    rng = random.Random(4)
    keys = rng.sample(range(-(10**9), 10**9), 1200)
    links = [*zip(keys[:999], keys[1:1000], strict=True), *zip(keys[1000:1199], keys[1001:], strict=True)]
    got = J.components(spark.createDataFrame([(min(x), max(x)) for x in links[150:]], "a long, b long"), Scratch(spark), J.components(spark.createDataFrame([(min(x), max(x)) for x in links[:150]], "a long, b long"), Scratch(spark))).collect()
    assert {r.key: r.component for r in got} == {k: min(keys[:1000]) if i < 1000 else min(keys[1000:]) for i, k in enumerate(keys)}


def test_large_counts_never_lower_the_bound():
    counts = np.full((2, 128), 250)
    counts[0, :9], counts[1, :9] = 256, 300
    v = J.matrix(np.minimum(counts, J.MOST).astype(np.uint8).ravel(), np.array([0, 128, 256]))
    size = counts.sum(1)
    assert (v >= counts).all() and (v[:, 9:] == counts[:, 9:]).all()
    assert J.RTree(v[1:], size[1:]).search(v[:1], size[:1], 0.98)[1].tolist() == [0]


def test_scratch_tables_go(spark, tmp_path):
    work = Scratch(spark)
    first = work.write("a", spark.range(3))
    second = work.write("a", first.selectExpr("id + 1 AS id"))
    assert sorted(r.id for r in second.collect()) == [1, 2, 3]
    kept = work.keep(second)
    assert kept.count() == 3 and spark._jvm.org.apache.hadoop.fs.Path(work.base).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(work.base)) is False


def test_empty_table(spark):
    assert J.join_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
