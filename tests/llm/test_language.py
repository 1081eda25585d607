import zlib

import numpy as np
import pytest

from lakeweave.llm import language as L

EN = "the quick brown fox jumps over the lazy dog while seven other animals are watching from their house "
DE = "der schnelle braune fuchs springt über den faulen hund während sieben andere tiere zuschauen und schlafen "
EL = "η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί ενώ άλλα ζώα κοιτάζουν "


def rows():
    out = [(i, (EN, DE, EL)[i % 3] * (1 + i % 3), ("en", "de", "el")[i % 3], 0.5) for i in range(90)]
    return out + [(90, None, "en", 0.5), (91, "", "de", 0.5), (92, "12 34 !!", "en", 0.5), (93, EN * 300 + DE * 100, None, 0.5), (94, EN, None, 0.5), (94, EN, None, 0.5), (None, DE, "de", 0.5), (95, "漢字" * 20, None, 0.5)]


def run(spark, tmp_path, data):
    spark.createDataFrame(data, "doc_id long, text string, lang string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    return L.op10_language(spark, str(tmp_path)).collect()


def test_query(spark, tmp_path):
    data = rows()
    got = run(spark, tmp_path, data)
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    for d, text, lang, _ in data:
        r = by[d]
        assert r.held_out == (d is not None and zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not text or not any(c.isalpha() for c in text):
            assert r.lang_pred == "und" and r.score == 0
        elif lang:
            assert r.lang_pred == lang
    assert by[93].lang_pred == "en" and by[93].n_spans == 2 and 0.7 < by[93].score < 0.8
    assert by[95].score == 0


def test_spans_are_code_points(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, lang string, score double").createOrReplaceTempView("labelled_rows")
    model = L.train_languages(spark.table("labelled_rows"))
    text = EL + "; " + EN * 2
    r = L.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s.lang for s in r.spans] == ["el", "en"] and text[r.spans[1].start : r.spans[1].end].startswith("the quick") and text[: r.spans[0].end].endswith("κοιτάζουν")


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    offsets = np.array([0, 0, 7, 7, 30, 31])
    score = rng.normal(size=(31, 3)) * rng.choice([0.5, 5])
    label = L.viterbi(score, offsets, 6.0)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if a < b:
            best = score[a].copy()
            for t in range(a + 1, b):
                best = np.maximum(best, best.max() - 6) + score[t]
            own = label[a:b]
            assert score[np.arange(a, b), own].sum() - 6 * (own[1:] != own[:-1]).sum() == pytest.approx(best.max())


def test_every_label_is_learnt(spark):
    rng = np.random.default_rng(3)
    word = lambda first, span: "".join(chr(first + x) for x in rng.integers(0, span, 6))
    words = {f"l{i:03}": [word(97, 26) for _ in range(12)] for i in range(300)} | {"zz": [word(0x10D0, 33) for _ in range(12)]}
    text = lambda name, k: " ".join(rng.choice(words[name], k))
    rows_ = [(i, text(name, 40), name) for i, name in enumerate(x for n in words for x in [n] * (1 if n == "zz" else 2))]
    model = L.train_languages(spark.createDataFrame(rows_, "doc_id long, text string, lang string"))
    assert model.langs == sorted(words) and model.scores.size <= L.CELLS
    asked = [(i, text(n, 20)) for i, n in enumerate(words)] + [(1000, text("l290", 30) + " " + text("zz", 10))]
    got = {r.doc_id: r for r in L.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(len(words))] == list(words) and got[300].score > 0.9
    assert [s.lang for s in got[1000].spans] == ["l290", "zz"]


def test_no_labels_and_empty_table(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == []
    got = run(spark, tmp_path / "b", [(1, "text", None, 0.1)])
    assert got[0].lang_pred == "und" and got[0].score == 0


def test_rows_without_an_id_are_sampled_too(spark):
    rows = [(None, f"some words here number {chr(97 + i % 26)} {chr(97 + i // 26)}", "en") for i in range(600)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few = L.train_languages(labelled, per_lang=30)
    every = L.train_languages(labelled, per_lang=10_000)
    assert few.langs == every.langs == ["en"] and not np.allclose(few.scores, every.scores)
