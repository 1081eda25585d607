import random

from lakeweave.llm import line_dedup as D

LONG = " ".join(f"p{i}" for i in range(60))


def corpus():
    rng = random.Random(3)
    block = [f"shared line number {i} of a block" for i in range(30)]
    out = []
    for i in range(40):
        own = [f"own {i} {j} {rng.random()}" for j in range(rng.randrange(1, 20))]
        at = rng.randrange(len(own) + 1)
        out.append((i, "\n".join([*own[:at], *(block if i % 3 == 0 else []), *own[at:], *([LONG] if i % 4 == 0 else [])]), "x"))
    return [*out, (100, None, "x"), (101, "", "x"), (102, out[1][1], "x"), (5, out[5][1], "x"), (None, out[2][1], "x"), (103, "a line\n" * 20000, "x")]


def brute(data):
    seen, out = set(), {}
    for i, (_, text, _) in sorted(enumerate(data), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        if text is None:
            out[i] = None
            continue
        lines, kept = text.split("\n"), []
        for a, b, repeatable in D.chunk_lines(lines):
            chunk = "\n".join(lines[a:b])
            if not (repeatable and chunk in seen):
                kept += lines[a:b]
            if repeatable:
                seen.add(chunk)
        out[i] = "\n".join(kept)
    return sorted((str(data[i][0]), str(t)) for i, t in out.items())


def run(spark, tmp_path, data):
    spark.createDataFrame(data, "doc_id long, text string, removed string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    return D.op5_line_dedup(spark, str(tmp_path)).collect()


def test_equals_brute_force(spark, tmp_path):
    data = corpus()
    got = run(spark, tmp_path, data)
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == brute(data)
    text = {r.doc_id: r.text for r in got}
    assert sum(LONG in (t or "") for t in text.values()) == 1
    assert sum((t or "").count("shared line number") for t in text.values()) < 14 * 30 * 0.5


def test_boundaries_move_with_the_lines():
    lines = [f"line {i} {i * i}" for i in range(200)]
    a = {(s, e) for s, e, _ in D.chunk_lines(lines)}
    b = {(s - 7, e - 7) for s, e, _ in D.chunk_lines([f"new {i}" for i in range(7)] + lines)}
    assert len(a & b) >= len(a) - 1


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
