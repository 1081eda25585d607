"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of about `WINDOW` words; terms are words hashed to `TERMS`
numbers, weighted by inverse document frequency over all documents. A randomised SVD of the
passages' TF-IDF matrix is run over the executors: A^T A is applied to a random matrix, twice with an
orthonormal basis between, and the small Gram matrix of the result gives the latent basis. Every
window of `WINDOW` words of every document (half overlapping) is mapped to it, and windows whose cosine
with a passage reaches `cosine` are candidates. Around a candidate, the longest common subsequence of
words with the whole item decides: a share of `near` of the item is a copy; a share of `paraphrase` is one
if the answer is there too, that is, `answer` of the words of the item's answer, or of its last `ANSWER_WORDS`
words where the benchmark has no answers, appear in their order.

A passage that keeps less than `KEPT` of its length in the latent basis goes, with at most `RANK` others, to a basis
that spans these passages whole. Whatever the cosine, a run of `GRAM` words equal to the item's (all of a shorter
item) makes a candidate, so every verbatim copy is compared; its cosine is null if no window reached `cosine`.

Benchmarks beyond `BLOCK` passages are searched in blocks, and `SPACES` bases at a time, so what is broadcast is
bounded: `TERMS` x `RANK` numbers, the terms of `SPACES` x `RANK` passages by `RANK`, and one block. The benchmark is a stated query set; documents never meet each other.

Defined results: null text counts as empty; null items and items without words match nothing; an item of one
word matches nothing (it has no order); items that share an id, or have none, are searched each by itself, and a
document is listed once for each of them that it holds; repeated rows are searched one by one; an empty benchmark or table gives an
empty result; other columns are ignored, and so is a clash of their names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, numbered, table, text_slices, words_of

TERMS = 1 << 15
WINDOW = 32
RANK = 256
#: So many of the most frequent terms are counted by window and multiplied; the rows of others are summed word by word.
DENSE = 128
#: Half windows whose rows are summed together.
STEP = 512
BLOCK = 20_000
ANSWER_WORDS = 5
LEAST_WORDS = 2
#: A passage that keeps less of its length in the common basis gets one of its own; so many of those meet a document in one pass.
KEPT, SPACES = 0.7, 8
#: Equal words in a row that make a candidate without the latent space.
GRAM = 8
_MASK = np.uint64(TERMS - 1)


def _terms(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(20)) & _MASK).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents with each term, and documents; at most TERMS numbers reach the driver."""

    def run(batches):
        total, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text")):
                w = words_of(data, offsets)
                # Sorting beats the hash table of np.unique() several times over.
                pair = np.sort(w.doc_of() * TERMS + _terms(w.hashes()))
                pair = pair[np.diff(pair, prepend=-1) != 0]
                total += np.bincount(pair % TERMS, minlength=TERMS)
                n += b - a
        if n:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out, n = np.zeros(TERMS, np.int64), 0
    for t, c in zip(got.column("term").to_pylist(), got.column("n").to_pylist(), strict=True):
        if t < 0:
            n = c
        else:
            out[t] = c
    return out, n


def passages(items: DataFrame) -> DataFrame:
    """(item, item_id, text, answer) -> (item, item_id, part, words, answer words); word hashes as binary."""

    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("item", "item_id", "part", "words", "answer")}
            answers = batch.column("answer")
            for a, b, data, offsets in text_slices(batch.column("text")):
                w = words_of(data, offsets)
                h = w.hashes()
                for i in range(b - a):
                    own = h[w.offsets[i] : w.offsets[i + 1]]
                    if len(own) < LEAST_WORDS:
                        continue
                    answer = own[-ANSWER_WORDS:]
                    if answers[a + i].is_valid:
                        raw = np.frombuffer(answers[a + i].as_py().encode("utf-8", "surrogatepass"), np.uint8)
                        answer = words_of(raw, np.array([0, len(raw)])).hashes()
                    # The parts start half a window apart, the last one at the end.
                    starts = [*range(0, max(1, len(own) - WINDOW), WINDOW // 2), max(0, len(own) - WINDOW)]
                    for s in dict.fromkeys(starts):
                        out["item"].append(batch.column("item")[a + i].as_py())
                        out["item_id"].append(batch.column("item_id")[a + i].as_py())
                        out["part"].append(own[s : s + WINDOW].tobytes())
                        out["words"].append(own.tobytes())
                        out["answer"].append(answer.tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("part", pa.binary()), ("words", pa.binary()), ("answer", pa.binary())]))

    return items.mapInArrow(run, "item long, item_id long, part binary, words binary, answer binary")


def _tfidf(parts: list[bytes], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value) of the TF-IDF matrix with rows of length 1."""
    term = [np.unique(_terms(np.frombuffer(p, np.uint64)), return_counts=True) for p in parts]
    row = np.repeat(np.arange(len(parts)), [len(t) for t, _ in term])
    t = np.concatenate([t for t, _ in term]) if term else np.zeros(0, np.int64)
    value = np.concatenate([c for _, c in term]) * idf[t] if term else np.zeros(0)
    length = np.sqrt(np.bincount(row, weights=value**2, minlength=len(parts)))
    return row, t, value / np.maximum(length[row], 1e-12)


def _used_terms(batches):
    for batch in batches:
        every = batch.column("part").to_pylist()
        if every:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_terms(np.frombuffer(b"".join(every), np.uint64))))], ["term"])


def randomised_svd(parts: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """TERMS x r basis of the leading right singular vectors of the passages' TF-IDF matrix."""
    context = parts.sparkSession.sparkContext
    used = parts.select("part").mapInArrow(_used_terms, "term long").distinct().toArrow()
    terms = np.sort(used.column("term").to_numpy())
    place = np.zeros(TERMS, np.int64)
    place[terms] = np.arange(len(terms))
    # Rows for the passages' own terms only; sums travel as float32.
    basis = np.random.default_rng(seed).normal(size=(len(terms), rank + 10)).astype(np.float32)

    def applied(matrix: np.ndarray, gram: bool) -> np.ndarray:
        shared = context.broadcast((matrix, idf, place))

        def run(batches):
            m, weight, at = shared.value
            total = None
            for batch in batches:
                every = batch.column("part").to_pylist()
                for a in range(0, len(every), 2000):
                    row, t, value = _tfidf(every[a : a + 2000], weight)
                    y = np.zeros((min(2000, len(every) - a), m.shape[1]))
                    np.add.at(y, row, value[:, None] * m[at[t]])
                    if gram:
                        out = y.T @ y
                    else:
                        out = np.zeros(m.shape)
                        np.add.at(out, at[t], value[:, None] * y[row])
                    total = out if total is None else total + out
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()])], ["m"])

        pieces = parts.select("part").mapInArrow(run, "m binary").rdd.map(lambda r: np.frombuffer(bytes(r["m"]), np.float32))
        total = pieces.treeReduce(lambda a, b: a + b, 3)
        shared.unpersist()
        return total.reshape((matrix.shape[1],) * 2 if gram else matrix.shape)

    for _ in range(2):
        new = applied(basis, False)
        some = np.flatnonzero(np.abs(new).max(1))  # terms with a weight
        if not len(some):
            return np.zeros((TERMS, 0), np.float32)
        basis = np.zeros((len(terms), min(len(some), new.shape[1])), np.float32)
        basis[some] = np.linalg.qr(new[some])[0]
    values, vectors = np.linalg.eigh(applied(basis, True))
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-9 * max(values.max(initial=0), 1e-30)]
    out = np.zeros((TERMS, len(keep)), np.float32)
    out[terms] = basis @ vectors[:, keep]
    return out


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of an integer."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row, full = 0, (1 << len(a)) - 1
    for y in b:
        u = row | where.get(y, 0)
        row = u & ~(u - ((row << 1) | 1)) & full
    return row.bit_count()


def find_leaks(docs: DataFrame, items: DataFrame, cosine: float = 0.2, near: float = 0.75, paraphrase: float = 0.55, answer: float = 0.8) -> DataFrame:
    """docs (row, doc_id, text), items (item_id, text, answer) -> (row, doc_id, item_id, word, cosine, lcs, answer_share)."""
    spark = docs.sparkSession
    schema = "row long, doc_id long, item long, item_id long, word long, cosine double, lcs double, answer_share double"
    parts = passages(numbered(items.select("item_id", "text", "answer"), "item"))
    if parts.isEmpty():
        return spark.createDataFrame([], schema).drop("item")
    frequency, n = document_frequencies(docs)
    if not n:
        return spark.createDataFrame([], schema).drop("item")
    idf = np.log1p(n / np.maximum(frequency, 1))
    basis = randomised_svd(parts, idf)
    every = parts.rdd.map(lambda r: ((r["item"], r["item_id"]), bytes(r["part"]), bytes(r["words"]), bytes(r["answer"])))
    found, block = [], []
    for r in every.toLocalIterator():
        block.append(r)
        if len(block) == BLOCK:
            found += _searches(docs, block, basis, idf, cosine, near, paraphrase, answer, schema)
            block = []
    if block:
        found += _searches(docs, block, basis, idf, cosine, near, paraphrase, answer, schema)
    if len(found) == 1:
        return found[0].drop("item")
    # An item may be found by several searches: the first word of the highest cosine stays.
    best = F.max(F.struct("cosine", -F.col("word"), *[F.col(c) for c in ("doc_id", "item_id", "word", "lcs", "answer_share")])).alias("best")
    every = reduce(DataFrame.union, found).groupBy("row", "item").agg(best)
    return every.select("row", "best.doc_id", "best.item_id", "best.word", "best.cosine", "best.lcs", "best.answer_share")


def _latent(parts: list[bytes], basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Passages of length 1, mapped to the basis."""
    row, t, value = _tfidf(parts, idf)
    out = np.zeros((len(parts), basis.shape[1]), np.float32)
    np.add.at(out, row, (value[:, None] * basis[t]).astype(np.float32))
    return out


def own_basis(parts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """TERMS x r basis of the whole row space of at most `RANK` passages, by their Gram matrix."""
    row, t, value = _tfidf(parts, idf)
    terms, place = np.unique(t, return_inverse=True)
    a = np.zeros((len(parts), len(terms)))
    a[row, place] = value
    values, vectors = np.linalg.eigh(a @ a.T)
    keep = values > 1e-6 * max(values.max(initial=0), 1e-30)
    out = np.zeros((TERMS, int(keep.sum())), np.float32)
    out[terms] = a.T @ (vectors[:, keep] / np.sqrt(values[keep]))
    return out


def _space(members: list[int], latent: np.ndarray, basis: np.ndarray, idf: np.ndarray) -> tuple:
    """(slot of each term, the most frequent first, weighted rows, latent passages of length 1, their places in the block)."""
    support = np.flatnonzero(np.abs(basis).max(1, initial=0) > 1e-7)
    support = support[np.argsort(idf[support], kind="stable")]
    slot = np.full(TERMS, -1, np.int32)
    slot[support] = np.arange(len(support))
    return slot, (basis[support] * idf[support][:, None]).astype(np.float32), latent / np.maximum(np.sqrt((latent**2).sum(1)), 1e-12)[:, None], members


def add_rows(y: np.ndarray, rows: np.ndarray, own: np.ndarray, group: np.ndarray) -> None:
    """y[g] += the sum of rows[own] over the places of group g; group is in order.

    The first rows of all groups of a step are added, then the second ones of those that have two, and so on, the
    longest groups standing first: each addition is one of whole matrices.
    """
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(cut, len(group)))
    order = np.argsort(-size, kind="stable")
    next_ = np.empty((STEP, rows.shape[1]), rows.dtype)
    for a in range(0, len(order), STEP):
        first, n = cut[order[a : a + STEP]], size[order[a : a + STEP]]
        total = rows[own[first]]
        for r in range(1, int(n[0])):
            m = int(np.searchsorted(-n, -r))  # groups of more than r places
            np.take(rows, own[first[:m] + r], axis=0, out=next_[:m], mode="clip")
            total[:m] += next_[:m]
        y[group[first]] += total


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each run of n word hashes."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        out = mix64(out + h[i : len(h) - n + 1 + i])
    return out


def anchors(texts: dict) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(n, bit table, sorted hashes, items) of the runs of n words that make an item a candidate.

    n is `GRAM`, or the length of a shorter item. Of its runs an item keeps those that the fewest items
    share: at least one, which every verbatim copy holds.
    """
    by: dict[int, list] = {}
    for item, (words, _) in texts.items():
        n = min(GRAM, len(words))
        by.setdefault(n, []).append((item, np.unique(gram_hashes(np.array(words, np.uint64), n))))
    out = []
    for n, every in sorted(by.items()):
        size = np.array([len(g) for _, g in every])
        gram, owner = np.concatenate([g for _, g in every]), np.repeat(np.arange(len(every)), size)
        _, place, count = np.unique(gram, return_inverse=True, return_counts=True)
        least = np.minimum.reduceat(count[place], np.cumsum(size) - size)
        keep = np.flatnonzero(count[place] == least[owner])
        keep = keep[np.argsort(gram[keep], kind="stable")]
        table_ = np.zeros(1 << (8 * len(keep)).bit_length(), bool)
        table_[gram[keep] & np.uint64(len(table_) - 1)] = True
        out.append((n, table_, gram[keep], [every[i][0] for i in owner[keep]]))
    return out


def _searches(docs, block, basis, idf, *limits) -> list[DataFrame]:
    """Searches for one block: passages that keep `KEPT` of their length in the common basis, others in bases of their own."""
    parts = [p for _, p, _, _ in block]
    latent = _latent(parts, basis, idf)
    kept = np.sqrt((latent**2).sum(1)) >= KEPT
    strong, weak = np.flatnonzero(kept).tolist(), np.flatnonzero(~kept).tolist()
    out = []
    for a in range(0, max(1, len(weak)), RANK * SPACES):
        spaces = [_space(strong, latent[strong], basis, idf)] if a == 0 and strong else []
        for b in range(a, min(len(weak), a + RANK * SPACES), RANK):
            own = weak[b : b + RANK]
            rows = [parts[i] for i in own]
            local = own_basis(rows, idf)
            spaces.append(_space(own, _latent(rows, local, idf), local, idf))
        out.append(_search(docs, block, spaces, a == 0, idf, *limits))
    return out


def _search(docs, block, spaces, exact, idf, cosine, near, paraphrase, answer, schema):
    texts = {item: (np.frombuffer(w, np.uint64).tolist(), np.frombuffer(a, np.uint64).tolist()) for item, _, w, a in block}
    shared = docs.sparkSession.sparkContext.broadcast((spaces, idf**2, [i for i, *_ in block], texts, anchors(texts) if exact else []))
    half, least = WINDOW // 2, min(near, paraphrase) - 1e-9

    def run(batches):
        spaces, square, names, texts, runs = shared.value
        for batch in batches:
            out = {c: [] for c in ("row", "doc_id", "item", "item_id", "word", "cosine", "lcs", "answer_share")}
            for first, last, data, offsets in text_slices(batch.column("text")):
                w = words_of(data, offsets)
                size = np.diff(w.offsets)
                if not len(w.starts):
                    continue
                h = w.hashes()
                term = _terms(h)
                # Half windows, then windows of two neighbours of one document.
                halves = -(-size // half)
                start = np.cumsum(halves) - halves
                doc = np.repeat(np.arange(len(size)), size)
                at = start[doc] + (np.arange(len(h)) - w.offsets[doc]) // half
                total = int(halves.sum())
                norm = np.bincount(at, weights=square[term], minlength=total)
                owner = np.repeat(np.arange(len(size)), halves)
                with_next = np.zeros(total, bool)
                with_next[:-1] = owner[1:] == owner[:-1]
                length = np.sqrt(np.maximum(norm + np.where(with_next, np.append(norm[1:], 0), 0), 1e-12))
                seen, tried = set(), set()

                def decide(window, item, like):
                    d = int(owner[window])
                    if (d, item) in seen or (window, item) in tried:
                        return
                    tried.add((window, item))
                    place = int((window - start[d]) * half)
                    words, wanted = texts[item]
                    lo = w.offsets[d] + max(0, place - len(words) - half)
                    hi = min(w.offsets[d + 1], w.offsets[d] + place + WINDOW + len(words) + half)
                    region = h[lo:hi].tolist()
                    # No subsequence is longer than the item's words that occur at all.
                    if sum(map(set(region).__contains__, words)) < least * len(words):
                        return
                    share = common_subsequence(words, region) / len(words)
                    got = common_subsequence(wanted, region) / len(wanted) if wanted else 0.0
                    if share >= near or (share >= paraphrase and got >= answer):
                        seen.add((d, item))
                        for c, x in (("row", batch.column("row")[first + d].as_py()), ("doc_id", batch.column("doc_id")[first + d].as_py()), ("item", item[0]), ("item_id", item[1]), ("word", place), ("cosine", like), ("lcs", share), ("answer_share", got)):
                            out[c].append(x)

                for slot, weighted, latent, members in spaces:
                    y = np.zeros((total + 1, latent.shape[1]), np.float32)
                    own = slot[term]
                    wide = min(DENSE, len(weighted))
                    often = np.flatnonzero((own >= 0) & (own < wide))
                    if len(often):
                        counts = np.bincount(at[often] * wide + own[often], minlength=total * wide).astype(np.float32)
                        y[:-1] = counts.reshape(total, wide) @ weighted[:wide]
                    used = np.flatnonzero(own >= wide)
                    add_rows(y, weighted, own[used], at[used])
                    # No cosine exceeds the share of a window that lies in the latent space.
                    y[:-1] += np.where(with_next[:, None], y[1:], 0)
                    open_ = np.flatnonzero(np.einsum("ij,ij->i", y[:-1], y[:-1]) >= (cosine * length) ** 2)
                    for a in range(0, len(open_), 4096):
                        own = open_[a : a + 4096]
                        like = (y[own] @ latent.T) / length[own, None]
                        for i, j in zip(*np.nonzero(like >= cosine), strict=True):
                            decide(int(own[i]), names[members[j]], float(like[i, j]))
                # Equal runs of words are candidates whatever their weight.
                for n, bits, grams, items in runs:
                    g = gram_hashes(h, n)
                    like = np.flatnonzero(bits[g & np.uint64(len(bits) - 1)])
                    like = like[doc[like] == doc[like + n - 1]]
                    for p, lo, hi in zip(like.tolist(), np.searchsorted(grams, g[like], "left").tolist(), np.searchsorted(grams, g[like], "right").tolist(), strict=True):
                        for item in items[lo:hi]:
                            decide(int(at[p]), item, None)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("item", pa.int64()), ("item_id", pa.int64()), ("word", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer_share", pa.float64())]))

    return docs.select("row", "doc_id", "text").mapInArrow(run, schema)


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
    return items.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return find_leaks(docs, benchmark_items(spark, sf_dir)).drop("row")
