import random
import re

from lakeweave.llm import licenses as L

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = [
    (1, "Released under the MIT License.\nCC BY-NC 4.0; cc by nc", 5),
    (2, "Licensed under the Apache License, Version 2.0. É licensed", 5),
    (3, None, None),
    (4, "", 5),
    (5, "This work is licensed under the GNU General Public License, version 3.", 5),
    (6, "word " * 30000 + "CC BY-NC-SA", 5),
    (6, "word " * 30000 + "CC BY-NC-SA", 5),
    (7, "the license of nothing, all rights are mine; ccé by nc", 5),
    (None, "under the mit license", 5),
]


def brute(text):
    words = WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    found = [(i, label) for p, label in L.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, score int").write.parquet(str(tmp_path / "documents.parquet"))
    return L.op7_licenses(spark, str(tmp_path)).collect()


def test_base_equals_brute_force(spark, tmp_path):
    got = run(spark, tmp_path, DOCS)
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=key) == sorted(((d, *brute(t)) for d, t, _ in DOCS), key=key)
    by = {r.doc_id: r for r in got}
    assert by[5].labels == "gpl-3" and by[2].labels == "apache-2" and by[6].labels == "cc-by-nc,cc-by-nc-sa"
    assert by[7].labels == "" and by[7].score == 0 and all(0 <= r.score <= 1 for r in got)


def test_hundreds_of_rules_compile_and_read_lower_case_words(spark):
    assert len(L.rules()) > 300
    for _, keyword, pattern, _, _ in L.rules():
        re.compile(pattern)
        assert keyword == keyword.lower()


def expanded(tree):
    """Texts that a rule's pattern matches: all optional parts, branches and classes of a few letters."""
    out = [""]
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            some = [chr(arg)]
        elif kind == "IN":
            some = [chr(x) if str(o) == "LITERAL" else chr(x[0]) for o, x in arg]
        elif kind == "ANY":
            some = ["x"]
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            some = [t * n for t in expanded(arg[2]) for n in {arg[0], 1}]
        elif kind == "SUBPATTERN":
            some = expanded(arg[3])
        elif kind == "BRANCH":
            some = [t for b in arg[1] for t in expanded(b)]
        else:
            assert kind in ("ASSERT", "ASSERT_NOT", "AT"), kind
            some = [""]
        out = [a + b for a in out for b in some]
    return out


def test_every_match_of_a_rule_passes_gate_and_keyword():
    frames = {f for f, _, _ in L.FRAMES}
    assert "{0}" in frames
    sentences = {f"(?<= ){x[2]}(?= )" for x in L.SIGNATURES}
    for _, keyword, pattern, _, score in L.rules():
        if score == 0.7 or pattern in sentences:  # sentences and bare names; a frame only adds words
            for text in expanded(re._parser.parse(pattern)):
                assert keyword in text, (keyword, text)
                assert re.search(L.GATE, text) and re.search(L.GATE, text.upper().replace(" ", "-")), text


def test_short_names_are_found(spark, tmp_path):
    texts = {
        "Licensed under the GPLv3": "gpl-3", "SPDX-License-Identifier: LGPL-2.1": "lgpl-2.1", "it is AGPL v3 code": "agpl-3", "GNU GPL": "gpl", "PSF License": "python-2", "the Expat license": "mit",
        "Creative Commons Attribution-ShareAlike": "cc-by-sa", "Creative Commons Attribution": "cc-by", "Creative Commons Zero": "cc0", "CC0 1.0": "cc0", "BSD 3-clause": "bsd-3", "Apache 2.0": "apache-2",
    }
    got = run(spark, tmp_path, [(i, t, 5) for i, t in enumerate(texts)])
    assert {r.doc_id: r.labels for r in got} == dict(enumerate(texts.values())) and all(r.score >= 0.7 for r in got)


def test_every_rule_fires_on_a_sample_of_its_own(spark, tmp_path):
    rules = L.rules()
    samples = [expanded(re._parser.parse(pattern))[-1] for _, _, pattern, _, _ in rules]
    got = run(spark, tmp_path, [(i, f"Some text. {t.upper()}. More text.", 5) for i, t in enumerate(samples)])
    assert len(got) == len(rules) > 500
    missed = [(rules[r.doc_id][0], r.labels, samples[r.doc_id]) for r in got if rules[r.doc_id][0] not in r.labels.split(",")]
    assert not missed, missed


def beaten(x, y):
    inside = y[1] <= x[1] and y[2] >= x[2]
    return inside and (y[0] > x[0] or y[0] == x[0] and y[2] - y[1] > x[2] - x[1])


def test_rules_and_suppression_equal_brute_force(spark, tmp_path):
    rng, names = random.Random(3), ["MIT License", "GNU GPL v3", "licensed under the terms of the BSD 3-Clause License", "CC BY-NC-SA 4.0", "all rights reserved", "Apache License, Version 2.0", "this is code", "public domain dedication", "without warranty of any kind, express or implied", "GNU Affero General Public License"]
    texts = [" and ".join(rng.choices(names, k=rng.randint(1, 8))) for _ in range(40)]
    rules = [(label, keyword, re.compile(pattern), priority) for label, keyword, pattern, priority, _ in L.rules()]
    want = []
    for text in texts:
        words = " " + " ".join(WORDS.findall(text.lower())) + " "
        found = {(priority, words[: m.start()].count(" ") - 1, words[: m.end()].count(" "), label) for label, keyword, pattern, priority in rules if keyword in words for m in pattern.finditer(words)}
        labels = {x[3] for x in found if not any(beaten(x, y) for y in found)} | set(brute(text)[4].split(",")) - {""}
        want.append(",".join(sorted(labels)))
    got = run(spark, tmp_path, [(i, t, 5) for i, t in enumerate(texts)])
    assert [r.labels for r in sorted(got)] == want


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
