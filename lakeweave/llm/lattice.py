"""Subword lattice likelihood of whole documents.

The pieces and scores of an existing vocabulary give a weight to every segmentation of a word
(with the word-start mark in front; pieces never cross blanks, so a document's lattice is the
chain of its words' lattices). A log-space forward recursion sums over all segmentations. Piece
weights start from the vocabulary's own scores and take one expectation step over the distinct
training words, since the pieces stand for words that training lacks; the vocabulary itself is not
trained. A training word is one more edge over its whole
lattice, with its discounted relative frequency; the mass that discounting frees goes to the
pieces. A document ends with one end token.

Every distinct word is scored once, after the corpus's word counts have met by word. Words with
more than 1/`frequent` of all tokens (so at most `frequent` of them) are broadcast; occurrences of
the others meet their word's values in a join in which no key has more rows than that share.

Defined results: null text counts as empty and has the end token only; with no training token, N is
0 and pieces keep the vocabulary's scores; rows with equal doc_id are scored one by one; null doc_id
counts as not held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix64, table, text_slices, words_of, written
from .language import held_out

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT = 50_000
DISCOUNT = 0.75
#: Weight of the vocabulary's own scores in the expectation step, in pieces.
PRIOR = 1000.0
MARK = "▁"
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Code points handled at once.
CHUNK = 150_000


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))))


def _hash(code: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix64(np.atleast_1d(((code.astype(np.uint64) + np.uint64(1)) * _powers(_P, len(code))[:-1]).sum(dtype=np.uint64)))[0]


@dataclass
class Pieces:
    """Pieces of a vocabulary: log weights, and levels of a hash table from code-point hashes to pieces."""

    log_weight: np.ndarray
    byte_piece: np.ndarray  # byte -> piece
    longest: int
    levels: list[tuple[np.ndarray, np.ndarray, int]]  # keys, pieces, shift

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        for keys, pieces, shift in self.levels:
            slot = (h >> np.uint64(shift)) & np.uint64(len(keys) - 1)
            hit = keys[slot] == h
            out[hit] = pieces[slot[hit]]
        return out


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """Pieces of a sentencepiece file. A score of -r (a rank) weighs 1 / (10 + r); bytes weigh as the last rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    weight, hashes, own, longest = [], [], [], 1
    byte_piece = np.full(256, -1, np.int32)
    for i in ids:
        text = sp.id_to_piece(i)
        n = len(weight)
        if sp.is_byte(i):
            byte_piece[int(text[3:-1], 16)] = n
            weight.append(1 / (10 + len(ids)))
        elif MARK not in text[1:]:
            weight.append(1 / (10 - sp.get_score(i)))
            hashes.append(_hash(np.frombuffer(text.encode("utf-32-le"), np.uint32)))
            own.append(n)
            longest = max(longest, len(text))
    if (byte_piece < 0).any():
        raise ValueError("the vocabulary needs a piece for every byte")
    keys, pieces, levels, shift = np.array(hashes, np.uint64), np.array(own, np.int32), [], 0
    while len(keys):
        size = 1 << 18
        table_keys, table_pieces = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        slot = (keys >> np.uint64(shift)) & np.uint64(size - 1)
        _, first = np.unique(slot, return_index=True)
        table_keys[slot[first]], table_pieces[slot[first]] = keys[first], pieces[first]
        levels.append((table_keys, table_pieces, shift))
        rest = np.setdiff1d(np.arange(len(keys)), first)
        keys, pieces, shift = keys[rest], pieces[rest], (shift + 11) % 46
    w = np.array(weight)
    return Pieces(np.log(w / w.sum()), byte_piece, longest, levels)


class Lattice:
    """All segmentations of a list of words."""

    def __init__(self, words: list[bytes], pieces: Pieces):
        texts = [MARK + w.decode(errors="replace") for w in words]
        self.pieces, length = pieces, np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate(([0], np.cumsum(length)))
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n, k = len(code), pieces.longest
        inside = np.arange(n) - np.repeat(self.first[:-1], length)
        self.ids = np.full((n, k), -1, np.int32)  # column l - 1: the piece of l code points that ends here
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * _powers(_P, n)[:-1])))
            inverse = _powers(_INV, n)
            for l in range(1, min(k, n) + 1):
                ok = np.flatnonzero(inside >= l - 1)
                if len(ok):
                    self.ids[ok, l - 1] = pieces.find(mix64((total[ok + 1] - total[ok + 1 - l]) * inverse[ok + 1 - l]))
        self.score = np.where(self.ids >= 0, pieces.log_weight[self.ids], -np.inf)
        # A character without a piece of its own is spelled in bytes.
        self.spelled = np.flatnonzero(self.ids[:, 0] < 0)
        strange, back = np.unique(code[self.spelled], return_inverse=True)
        self.spelling = [[int(pieces.byte_piece[b]) for b in chr(c).encode("utf-8", "replace")] for c in strange]
        self.back = back
        if len(strange):
            self.score[self.spelled, 0] = np.array([pieces.log_weight[s].sum() for s in self.spelling])[back]
        self.order = np.argsort(-length, kind="stable")
        self.length = length

    def _steps(self) -> Iterator[tuple[int, np.ndarray]]:
        size = self.length[self.order]
        for t in range(int(size[0]) if len(size) else 0):
            yield t, self.first[self.order[: np.searchsorted(-size, -t, side="left")]] + t

    def forward(self) -> np.ndarray:
        """Log probability of all segmentations up to and including each code point."""
        out, k = np.zeros(len(self.score)), self.pieces.longest
        for t, e in self._steps():
            m = min(k, t + 1)
            before = out[np.maximum(e[:, None] - np.arange(1, m + 1), 0)]
            if m == t + 1:
                before[:, t] = 0.0
            out[e] = _log_sum(before + self.score[e, :m])
        return out

    def totals(self, forward: np.ndarray) -> np.ndarray:
        return forward[self.first[1:] - 1] if len(self.length) else np.zeros(0)

    def expected(self, weight: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, words weighted."""
        alpha, k, n = self.forward(), self.pieces.longest, len(self.score)
        beta, end = np.zeros(n), np.repeat(self.first[1:], self.length)
        for t, e in reversed(list(self._steps())):
            step = e[:, None] + np.arange(1, k + 1)
            ok = step < end[e][:, None]
            at = np.minimum(step, n - 1)
            after = np.where(ok, beta[at] + self.score[at, np.arange(k)[None, :]], -np.inf)
            last = e + 1 == end[e]
            beta[e] = np.where(last, 0.0, _log_sum(after))
        inside = np.arange(n) - np.repeat(self.first[:-1], self.length)
        out = np.zeros(len(self.pieces.log_weight))
        total, w = np.repeat(self.totals(alpha), self.length), np.repeat(weight, self.length)
        for l in range(1, k + 1):
            at = np.flatnonzero(np.isfinite(self.score[:, l - 1]))
            before = np.where(inside[at] >= l, alpha[np.maximum(at - l, 0)], 0.0)
            use = np.exp(before + self.score[at, l - 1] + beta[at] - total[at]) * w[at]
            piece = self.ids[at, l - 1]
            own = piece >= 0
            out += np.bincount(piece[own], weights=use[own], minlength=len(out))
            if l == 1 and len(self.spelled):
                by = np.bincount(self.back, weights=use[~own], minlength=len(self.spelling))
                for s, x in zip(self.spelling, by, strict=True):
                    np.add.at(out, s, x)
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.isfinite(top), top + np.log(np.exp(x - np.where(np.isfinite(top), top, 0)[:, None]).sum(1)), -np.inf)


def _chunks(words: list[bytes]) -> Iterator[slice]:
    at, size = 0, 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= CHUNK:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(words):
        yield slice(at, len(words))


def _as_binary(w: Words, index: np.ndarray) -> pa.Array:
    """The words at index as an Arrow array of their bytes."""
    size = w.ends[index] - w.starts[index]
    offsets = np.concatenate(([0], np.cumsum(size)))
    where = np.arange(offsets[-1]) + np.repeat(w.starts[index] - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(index), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(w.data[where])])


def count_words(docs: DataFrame) -> DataFrame:
    """docs (text, training) -> (word, train, every): occurrences among training rows and all rows."""

    def run(batches):
        for batch in batches:
            training = batch.column("training").to_numpy(zero_copy_only=False).astype(bool)
            for a, b, data, offsets in text_slices(batch.column("text")):
                w = words_of(data, offsets)
                if len(w.starts):
                    _, first, back, n = np.unique(w.hashes(), return_index=True, return_inverse=True, return_counts=True)
                    train = np.bincount(back, weights=np.repeat(training[a:b], np.diff(w.offsets)), minlength=len(n)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([_as_binary(w, first), pa.array(train), pa.array(n.astype(np.int64))], ["word", "train", "every"])

    counted = docs.select("text", "training").mapInArrow(run, "word binary, train long, every long")
    return counted.groupBy("word").agg(F.sum("train").alias("train"), F.sum("every").alias("every"))


def expectation_step(words: DataFrame, pieces: Pieces) -> Pieces:
    """Piece weights after one expectation step over (word, train); the driver gets one number per piece."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        p, total = shared.value, None
        for batch in batches:
            word = batch.column("word").to_pylist()
            for s in _chunks(word):
                got = Lattice(word[s], p).expected(np.ones(len(word[s])))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["piece", "n"])

    got = words.where("train > 0").select("word").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    count = PRIOR * np.exp(pieces.log_weight)
    if got.num_rows:
        np.add.at(count, got.column("piece").to_numpy(), got.column("n").to_numpy())
    return Pieces(np.log(count / count.sum()), pieces.byte_piece, pieces.longest, pieces.levels)


def word_likelihood(words: DataFrame, pieces: Pieces) -> DataFrame:
    """Adds `log_pieces`, the natural log of the sum over all segmentations, to (word, train, every)."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches):
        for batch in batches:
            word = batch.column("word").to_pylist()
            parts = [Lattice(word[s], shared.value) for s in _chunks(word)]
            out = np.concatenate([x.totals(x.forward()) for x in parts]) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("word", "train", "every")), pa.array(out)], ["word", "train", "every", "log_pieces"])

    return words.select("word", "train", "every").mapInArrow(run, "word binary, train long, every long, log_pieces double")


def score_documents(docs: DataFrame, vocabulary: str = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """docs (doc_id, text, training) -> one row each: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    words = written(count_words(docs))
    docs_in = docs.agg(F.count("*").alias("n"), F.count_if("training").alias("train")).first()
    sums = words.agg(F.sum("train").alias("train"), F.sum("every").alias("every"), F.count_if(F.col("train") > 0).alias("types")).first()
    n = (sums["train"] or 0) + docs_in["train"]
    types = sums["types"] + (1 if docs_in["train"] else 0)
    pieces = expectation_step(words, load_pieces(vocabulary))
    norm = math.log10(n + 0.5 * (types + 1))
    freed = math.log(DISCOUNT * sums["types"] / n) if n and sums["types"] else 0.0
    known = F.col("train") > 0
    direct = F.when(known, F.log((F.col("train") - F.lit(DISCOUNT)) / F.lit(float(max(n, 1)))))
    spread = F.col("log_pieces") + F.lit(freed)
    both = F.greatest(direct, spread) + F.log1p(F.exp(F.least(direct, spread) - F.greatest(direct, spread)))
    values = written(
        word_likelihood(words, pieces).select(
            "word", "every", known.cast("long").alias("known"), (F.log10(F.col("train") + 0.5) - F.lit(norm)).alias("base"), (F.when(known, both).otherwise(spread) / F.lit(math.log(10))).alias("model")
        )
    )
    top = values.where(F.col("every") * F.lit(frequent) > F.lit(sums["every"] or 0)).drop("every").toArrow()
    hashes = np.array([_word_hash(x) for x in top.column("word").to_pylist()], np.uint64)
    order = np.argsort(hashes)
    common = tuple(x[order] for x in (hashes, top.column("known").to_numpy(), top.column("base").to_numpy(), top.column("model").to_numpy()))
    shared = spark.sparkContext.broadcast(common)
    end_p = docs_in["train"] / n if docs_in["train"] else 0.5
    end = (int(docs_in["train"] > 0), math.log10(docs_in["train"] + 0.5) - norm, math.log10(end_p))

    def run(batches):
        keys, is_known, base, model = shared.value
        names = ["row", "doc_id", "word", "n_tokens", "n_known", "base", "model"]
        for batch in batches:
            row, doc_id = batch.column("row").to_numpy(), batch.column("doc_id")
            for a, b, data, offsets in text_slices(batch.column("text")):
                w, d = words_of(data, offsets), b - a
                doc, h = w.doc_of(), w.hashes()
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                at, own = at[hit], doc[hit]
                sums = [np.bincount(own, weights=x[at] if len(keys) else None, minlength=d) for x in (is_known, base, model)]
                # Its key holds a blank, so that a document's own row meets no word.
                mark = [b" " + int(r).to_bytes(8, "big", signed=True) for r in row[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[a:b]), doc_id.slice(a, d), pa.array(mark, pa.binary()), pa.array(np.diff(w.offsets).astype(np.int64) + 1), pa.array((sums[0] + end[0]).astype(np.int64)), pa.array(sums[1] + end[1]), pa.array(sums[2] + end[2])], names
                )
                rest = np.flatnonzero(~hit)
                if len(rest):
                    none = pa.nulls(len(rest), pa.int64())
                    zero = pa.array(np.zeros(len(rest), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(row[a:b][doc[rest]]), none, _as_binary(w, rest), zero, zero, pa.array(np.zeros(len(rest))), pa.array(np.zeros(len(rest)))], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = rows.mapInArrow(run, "row long, doc_id long, word binary, n_tokens long, n_known long, base double, model double")
    rare = values.where(F.col("every") * F.lit(frequent) <= F.lit(sums["every"] or 0)).select(F.col("word").alias("w"), F.col("known").alias("k"), F.col("base").alias("b"), F.col("model").alias("m"))
    joined = parts.join(rare, parts["word"] == rare["w"], "left")
    return (
        joined.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
            F.sum(F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
            F.sum(F.col("model") + F.coalesce("m", F.lit(0.0))).alias("score"),
        )
        .withColumn("train_tokens", F.lit(n).cast("long"))
        .drop("row")
    )


def _word_hash(word: bytes) -> np.uint64:
    return words_of(np.frombuffer(word, np.uint8), np.array([0, len(word)])).hashes()[0]


def op2_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs.withColumn("training", ~held_out(F.col("doc_id"), 5, 1)))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
