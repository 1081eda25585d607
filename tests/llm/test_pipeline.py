import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_language import DE, EN  # noqa: E402
from tests.llm.test_ngram_join import grams  # noqa: E402


def world():
    rng = random.Random(5)
    en, de = EN.split(), DE.split()
    item = " ".join(rng.choices([f"term{c}" for c in "abcdefghijklmnop"], k=30))
    out = []
    for i in range(120):
        words = rng.choices(en if i % 2 else de, k=rng.randrange(40, 200))
        out.append([i, " ".join(words), "en" if i % 2 else "de", f"s{i % 3}" if i % 5 else None])
    for i in range(120, 140):  # near copies of 0, exact copies of 1
        words = out[i % 2][1].split()
        if i % 2 == 0:
            words[i % len(words)] = "edited"
        out.append([i, " ".join(words), None, "s0"])
    for i in range(140, 150):
        words = out[i - 100][1].split() + rng.choices(en, k=30)
        out.append([i, " ".join([*words[:20], item, *words[20:]]), "en", "s1"])
    out += [[150, None, "en", "s1"], [151, "", "en", "s1"], [152, "123 456 !!!", "en", None], [153, "漢字 " * 30, None, "s1"], [5, out[5][1], "en", "s2"]]
    return [(*r, "extra") for r in out], item


def test_stages(spark, tmp_path):
    data, item = world()
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, row string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = {k: sorted(r.doc_id for r in v) for k, v in seen.items()}
    assert ids["language_id"] == sorted(d for d, *_ in data if d not in (150, 151, 152, 153))
    # Brute force over what the stage got.
    rows = seen["language_id"]
    sets = [grams(r.text, 5) for r in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r.doc_id, least.get(find(i), r.doc_id))
    assert ids["ngram_join"] == sorted(least.values())
    assert ids["decontamination"] == [d for d in ids["ngram_join"] if not 140 <= d < 150]
    size, taken = {}, {}
    for r in seen["decontamination"]:
        size[r.source] = size.get(r.source, 0) + len(r.text.split())
    for r in seen["mixing"]:
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    assert all(ids["mixing"].count(d) <= 2 for d in ids["mixing"])
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.02)
    assert ids["sharding"] == ids["mixing"] and "shard" in seen["sharding"][0].asDict()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
