"""Language ID of mixed texts: script ranges, word scores, Viterbi with a switching penalty.

Training takes a bounded sample of labelled rows (`per_lang` rows of each label, in expectation,
chosen by a hash of doc_id, or of the text where that is null) and counts hashed letter trigrams per language on the executors. With more labels
than `CELLS / BUCKETS`, trigrams share fewer buckets, so that the model keeps its size; no label is left out. A word's score for a language is the sum of its trigrams' log
probabilities. Languages that training never saw in a word's script are no candidates for it.
Over the words of a text, Viterbi picks the labelling with the highest total, each change of
language costing `penalty`; runs of equal labels are spans.

Defined results: null text or a text without letters gives 'und' with score 0; so does a model
without any label. The score is the share of letters in words labelled with the predicted
language (words in unseen scripts count against it). Ties go to the first language in code
point order. Rows are independent; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mix64, small_side, table, text_slices, written

#: First code points of Unicode script ranges, and a script number for each.
RANGES = [
    (0x0000, "latin"), (0x00C0, "latin-accents"), (0x0250, "ipa"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "syriac"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin-accents"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "hiragana"), (0x30A0, "katakana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"),
    (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = list(dict.fromkeys(name for _, name in RANGES))
_STARTS = np.array([a for a, _ in RANGES])
_SCRIPT = np.array([SCRIPTS.index(n) for _, n in RANGES], np.int8)
#: Accented Latin letters occur in words of plain Latin letters: one script for candidates.
_SCRIPT[_SCRIPT == SCRIPTS.index("latin-accents")] = SCRIPTS.index("latin")
BUCKETS = 1 << 15
#: Buckets times labels of a model, and the least number of buckets.
CELLS, LEAST_BUCKETS = 1 << 23, 1 << 10
_tables: list[np.ndarray] = []


def _letters_and_folds() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        most = 0x33000
        every = [chr(c) for c in range(most)]
        _tables.append(np.array([c.isalpha() for c in every]))
        _tables.append(np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in every], np.uint32))
    return _tables[0], _tables[1]


@dataclass
class Letters:
    """Letter trigrams of a slice: bucket of each letter, and words as ranges of letters."""

    bucket: np.ndarray
    script: np.ndarray  # of each word
    first: np.ndarray  # first letter of each word, plus the end
    start: np.ndarray  # code point in the text where the word starts
    end: np.ndarray
    offsets: np.ndarray  # first word of each document, plus the end


def letters_of(data: np.ndarray, offsets: np.ndarray) -> Letters:
    isalpha, fold = _letters_and_folds()
    raw = data.tobytes()
    try:
        text = raw.decode()
        whole = np.flatnonzero((data & 0xC0) != 0x80)
        at = np.searchsorted(whole, offsets)
    except UnicodeDecodeError:
        parts = [raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        text, at = "".join(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.minimum(code, len(fold) - 1)
    alpha, code = isalpha[code], fold[code]
    n = len(code)
    place = np.flatnonzero(alpha)
    if not len(place):
        zero = np.zeros(0, np.int64)
        return Letters(zero, zero, np.zeros(1, np.int64), zero, zero, np.zeros(len(offsets), np.int64))
    doc_start = np.zeros(n + 1, bool)
    doc_start[at] = True
    gap = np.empty(len(place), bool)
    gap[0] = True
    gap[1:] = (np.diff(place) > 1) | doc_start[place[1:]]
    first = np.flatnonzero(gap)
    c = code[place].astype(np.uint64)
    before, after = np.zeros_like(c), np.zeros_like(c)
    before[1:] = np.where(gap[1:], 0, c[:-1])
    after[:-1] = np.where(gap[1:], 0, c[1:])
    bucket = (mix64((before << np.uint64(42)) | (c << np.uint64(21)) | after) & np.uint64(BUCKETS - 1)).astype(np.int32)
    start = place[first]
    last = place[np.append(first[1:], len(place)) - 1]
    script = _SCRIPT[np.searchsorted(_STARTS, code[start], side="right") - 1]
    return Letters(bucket, script, np.append(first, len(place)), start, last + 1, np.searchsorted(start, at))


@dataclass
class LanguageModel:
    langs: list[str]
    scores: np.ndarray  # buckets (a power of two) x langs, log probabilities
    allowed: np.ndarray  # scripts x langs


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by (lang, bucket), and letters by (lang, -1 - script)."""
    for batch in batches:
        lang = batch.column("lang").to_pylist()
        total: dict[str, np.ndarray] = {}
        for a, b, data, offsets in text_slices(batch.column("text")):
            got = letters_of(data, offsets)
            for i in range(b - a):
                lo, hi = got.offsets[i], got.offsets[i + 1]
                if lo < hi:
                    own = total.setdefault(lang[a + i], np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                    own[:BUCKETS] += np.bincount(got.bucket[got.first[lo] : got.first[hi]], minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(got.script[lo:hi], weights=np.diff(got.first[lo : hi + 1]), minlength=len(SCRIPTS)).astype(np.int64)
        for name, own in total.items():
            key = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(np.where(key < BUCKETS, key, BUCKETS - 1 - key)), pa.array(own[key])], ["lang", "key", "n"])


def train_languages(labelled: DataFrame, per_lang: int = 400, least_share: float = 0.005) -> LanguageModel:
    """labelled: (doc_id, text, lang). At most labels x (buckets + scripts) counts reach the driver."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = written(rows.groupBy("lang").count().select(F.col("lang").alias("of"), F.least(F.lit(1.0), per_lang / F.col("count")).alias("share")))
    labels = sizes.count()
    if not labels:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    buckets = BUCKETS
    while buckets > LEAST_BUCKETS and buckets * labels > CELLS:
        buckets //= 2
    of = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    spread = F.pmod(of, F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.join(small_side(sizes), F.col("lang") == F.col("of")).where(spread < F.col("share")).select("lang", "text")
    folded = F.when(F.col("key") >= 0, F.col("key") % buckets).otherwise(F.col("key"))
    counts = sample.mapInArrow(_counts, "lang string, key long, n long").groupBy("lang", folded.alias("key")).agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    number = {name: i for i, name in enumerate(langs)}
    lang, key = np.array([number[x] for x in got.column("lang").to_pylist()], np.int64), got.column("key").to_numpy()
    n = got.column("n").to_numpy()
    table_, letters = np.full((buckets, len(langs)), 0.2, np.float32), np.zeros((len(SCRIPTS), len(langs)))
    tri = key >= 0
    table_[key[tri], lang[tri]] += n[tri]
    letters[-1 - key[~tri], lang[~tri]] = n[~tri]
    scores = np.log(table_ / table_.sum(0, dtype=np.float64)).astype(np.float32)
    allowed = letters >= least_share * np.maximum(letters.sum(0), 1)
    return LanguageModel(langs, scores, allowed)


def viterbi(score: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Label of each word (row of score) in the best labelling of each document.

    Where no stretch of words gains half the penalty over the document's best single language, that
    language is the best labelling: k other stretches gain less than k/2 penalties and need at least
    k changes (k - 1 if they fill the document, k >= 2). Others go word by word, all documents at once.
    """
    n, k = score.shape
    label = np.zeros(n, np.int64)
    filled = np.flatnonzero(np.diff(offsets))
    if not len(filled):
        return label
    starts, ends = offsets[filled], offsets[filled + 1]
    totals = np.add.reduceat(score, starts, axis=0)
    best = totals.argmax(1)
    length = ends - starts
    label[:] = np.repeat(best, length)
    if k == 1:
        return label
    base = score[np.arange(n), label]
    doc = np.repeat(np.arange(len(filled)), length)
    gain = np.zeros(len(filled))
    first = np.zeros(n, bool)
    first[starts] = True
    for other in range(k):
        run = np.cumsum(score[:, other] - base)
        before = np.concatenate(([0.0], run[:-1]))
        step = 2 * (np.abs(run).max() + 1)
        low = np.minimum.accumulate(before - doc * step) + doc * step
        gain = np.maximum(gain, np.maximum.reduceat(run - low, starts))
    hard = np.flatnonzero(gain >= penalty / 2)
    if not len(hard):
        return label
    hard = hard[np.argsort(-length[hard], kind="stable")]
    at, size = starts[hard], length[hard]
    back = np.zeros((n, k), np.int8 if k <= 128 else np.int32)
    now = score[at].copy()
    own = np.arange(k, dtype=back.dtype)[None, :]
    active = np.searchsorted(-size, -np.arange(size[0] + 1), side="left")  # documents longer than t
    for t in range(1, int(size[0])):
        m = active[t]
        b = now[:m]
        arg = b.argmax(1)
        switch = (b[np.arange(m), arg] - penalty)[:, None]
        take = switch > b
        back[at[:m] + t] = np.where(take, arg[:, None], own)
        now[:m] = np.where(take, switch, b) + score[at[:m] + t]
    state = now.argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        m = active[t]
        label[at[:m] + t] = state[:m]
        if t:
            state[:m] = back[at[:m] + t, state[:m]]
    return label


def label_slice(got: Letters, model: LanguageModel, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Label of each word, and whether its script has a candidate."""
    score = np.add.reduceat(model.scores[got.bucket & (len(model.scores) - 1)], got.first[:-1], axis=0).astype(np.float64)
    allowed = model.allowed[got.script]
    some = allowed.any(1)
    score = np.where(allowed, score, np.where(some, -50.0, 0.0)[:, None] + score.min(1, keepdims=True))
    score[~some] = 0
    return viterbi(score, got.offsets, penalty), some


def identify(docs: DataFrame, model: LanguageModel, penalty: float = 12.0) -> DataFrame:
    """Per row: doc_id, lang_pred, score, spans (array of start, end, lang; code points, end exclusive)."""
    schema = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"
    arrow = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array(m.langs, pa.string())
        most = SLICE_BYTES // 2 * 64 // max(64, len(m.langs))
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text"), most):
                got = letters_of(data, offsets)
                d = b - a
                pred, share = np.full(d, -1), np.zeros(d)
                span_first, s, e, lab = np.zeros(d + 1, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
                if len(got.script) and m.langs:
                    label, some = label_slice(got, m, penalty)
                    doc = np.repeat(np.arange(d), np.diff(got.offsets))
                    size = np.diff(got.first)
                    by = np.bincount(doc * len(m.langs) + label, weights=size * some, minlength=d * len(m.langs)).reshape(d, -1)
                    every = np.bincount(doc, weights=size, minlength=d)
                    pred = np.where(every > 0, by.argmax(1), -1)
                    share = by.max(1) / np.maximum(every, 1)
                    cut = np.ones(len(label), bool)
                    cut[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                    head = np.flatnonzero(cut)
                    tail = np.append(head[1:], len(label)) - 1
                    base = _text_starts(data, offsets)[doc[head]]
                    s, e, lab = (got.start[head] - base).astype(np.int32), (got.end[tail] - base).astype(np.int32), label[head]
                    span_first = np.searchsorted(doc[head], np.arange(d + 1)).astype(np.int32)
                langs = pa.array([m.langs[p] if p >= 0 else "und" for p in pred], pa.string())
                spans = pa.ListArray.from_arrays(pa.array(span_first), pa.StructArray.from_arrays([pa.array(s), pa.array(e), names.take(pa.array(lab))], ["start", "end", "lang"]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, d), langs, pa.array(np.clip(share, 0, 1)), spans.cast(arrow.field("spans").type)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _text_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    whole = np.flatnonzero((data & 0xC0) != 0x80)
    return np.searchsorted(whole, offsets[:-1])


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_languages(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
