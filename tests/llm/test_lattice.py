import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lakeweave.llm import lattice as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def brute(word, pieces, table):
    """Sum over all segmentations, by recursion on strings; table: piece text -> log weight."""
    text = L.MARK + word
    at = [0.0] + [-math.inf] * len(text)
    for e in range(1, len(text) + 1):
        parts = [at[s] + table[text[s:e]] for s in range(max(0, e - pieces.longest), e) if text[s:e] in table]
        if text[e - 1] not in table:
            parts.append(at[e - 1] + sum(pieces.log_weight[pieces.byte_piece[b]] for b in text[e - 1].encode()))
        if parts:
            at[e] = max(parts) + math.log(sum(math.exp(p - max(parts)) for p in parts)) if max(parts) > -math.inf else -math.inf
    return at[-1]


@pytest.fixture(scope="module")
def pieces():
    return L.load_pieces()


def test_forward_equals_brute_force(pieces):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=L.VOCABULARY)
    n, table = 0, {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        if sp.is_byte(i):
            n += 1
        elif L.MARK not in sp.id_to_piece(i)[1:]:
            table[sp.id_to_piece(i)] = pieces.log_weight[n]
            n += 1
    words = ["the", "antidisestablishmentarianism", "über", "漢字", "a", "zzzz\U0001f600x", "token", "the"]
    got = L.Lattice([w.encode() for w in words], pieces)
    assert got.totals(got.forward()) == pytest.approx([brute(w, pieces, table) for w in words], rel=1e-9)


def test_expected_uses_spell_the_words(pieces):
    got = L.Lattice([b"hello", "ß漢".encode()], pieces).expected(np.array([2.0, 3.0]))
    eps, base = 1e-5, L.Lattice([b"hello"], pieces)
    best = int(np.argmax(got))
    moved = L.Pieces(pieces.log_weight.copy(), pieces.byte_piece, pieces.longest, pieces.levels)
    moved.log_weight[best] += eps
    both = L.Lattice([b"hello", "ß漢".encode()], pieces), L.Lattice([b"hello", "ß漢".encode()], moved)
    a, b = (x.totals(x.forward()) @ np.array([2.0, 3.0]) for x in both)
    assert (b - a) / eps == pytest.approx(got[best], rel=1e-3)
    assert len(base.length) == 1


def rows():
    out = [(i, " ".join(f"Word{(i * k) % 17} common" for k in range(1, 2 + i % 30)), 1) for i in range(120)]
    return out + [(500, None, 1), (501, "", 1), (502, "unseen rareword " * 3000, 1), (503, "x" * 5000, 1), (7, "again", 1), (7, "again", 1), (None, "no id", 1)]


def run(spark, tmp_path, data):
    spark.createDataFrame(data, "doc_id long, text string, every int").write.parquet(str(tmp_path / "documents.parquet"))
    return L.op2_lattice(spark, str(tmp_path)).collect()


def test_base_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "FREQUENT", 20)
    data = rows()
    got = run(spark, tmp_path, data)
    tokens = [(d, [*WORD.findall((t or "").translate(FOLD)), None]) for d, t, _ in data]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for d, ws in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[500].score == by[501].score > by[503].score


def test_rare_join_and_broadcast_agree(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, True) for i, t, _ in rows()], "doc_id long, text string, training boolean")
    a, b = (sorted((str(r.doc_id), r.n_known, round(r.score, 6), round(r.base_score, 6)) for r in L.score_documents(docs, frequent=f).collect()) for f in (5, 10**6))
    assert a == b


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
