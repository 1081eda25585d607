"""N-gram Jaccard join with count vectors in R-trees.

Texts with equal n-gram sets are one class. A class's set is hashed to a count vector whose number of groups follows
the set's size (a power of two; wider vectors fold to narrower ones by adding their halves). For sets A and B the
overlap is at most the sum over groups of the smaller count, and a link needs an overlap of
t (|A| + |B|) / (1 + t), so the two differ in at most d = (|A| + |B|) (1 - t) / (1 + t) n-grams.

Where the trees stand: boxes around vectors of unrelated texts widen in every coordinate, so one tree
over all vectors would prune little. The first level therefore deals sets to cells. Sizes fall in bands
at most 1/t wide; linked sets are in one band or in neighbouring ones, and each set visits its own band
and the next. In a band, n-grams are dealt by hash into d + 1 + s blocks, s being `spare(d)`. Linked sets agree wholly in
at least 1 + s blocks, so they share a cell (band, block, block content): if either has e <= s empty blocks,
at least 1 + s - e with content, else an empty one, which only sets with more empty blocks visit. Of the cells that a set
shares with any other, it therefore leaves the s - e most crowded (in one order for all sets): two linked sets still
have one in common, while sets that share no more than a passage mostly leave all their cells. No link is lost.
Of the sets of one cell that meet in one Arrow batch only the first goes on to the cell's place, the others to places
of their own, so a hot cell's place gets a row for each batch at most.

First, each set is paired with the first set of its cells; of the pairs that the bound leaves, one of each set
is verified, then one of each two components that are still apart, then all that are. Then every cell whose other sets still are of several
components (one of all cells with the same sets) packs its vectors into R-trees: boxes of maxima, with the bound of summed
minima, leaving boxes that cannot reach the overlap and boxes of one's own component. A cell is solved in
tiles of about `TILE` sets and in pairs of tiles; a component of more sets has tiles of its own, which do not meet.
Of the pairs that the bound leaves, a tile gives a forest over its components, not all pairs. What verification
then refuses may have hidden others, so cells with refused and hidden pairs are solved again, until nothing is hidden. In a large
group of near copies the bound leaves very many pairs that are no links, in most of the group's cells. From the second time on sets
therefore bring `marks` of all their n-grams, and a tile counts the marks that two sets share before it takes a pair: its
forest is of links but for clashes of marks, so a cell gives no more rows than it has components. Should a clash be refused, there
are ever more forests.

Verification sends a text once for each `CHUNK` of its partners, and reads them one after another.

Defined results: null or wordless text has an empty set and is linked with nothing; a text with fewer words
than n is one n-gram; repeated rows and equal texts are one class; a null doc_id is never a component's
smallest unless all are null; other columns are ignored. Set equality and n-gram equality rest on 64-bit
hashes; a clash of class hashes is detected by a second hash and the run is repeated with another seed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, mix64, numbered, small_side, table, text_slices, words_of

#: Least and largest number of groups of a count vector; between them half to all of the set's size.
LEAST_GROUPS, MOST_GROUPS = 128, 8192
#: The highest count a packed vector holds; it stands for any count from it on.
MOST = 255
TILE = 1024
#: Partners of a text that are compared with one copy of it.
CHUNK = 256
#: A tile gives all pairs that the bound leaves if these are at most so many for each set, else forests.
FEW = 1
#: Beyond so many forests, all pairs.
FORESTS = 512
#: Bytes of texts whose n-grams a task holds at once; an n-gram is several numbers of eight bytes for a while.
SLICE = 1 << 19
#: Bits of a mark. Two sets share at least as many marks as n-grams.
MARK_BITS = 24
#: N-grams for which a set counts once among the TILE of a tile when sets bring their marks.
MARKS = 4096
#: Marks that are looked up at once.
LOOKED_UP = 1 << 20
#: Queries that walk a tree together.
TOGETHER = 64
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram hash) sorted and distinct, and the offsets of each document's n-grams."""
    w = words_of(data, offsets)
    h, size = w.hashes(), np.diff(w.offsets)
    d = len(size)
    with np.errstate(over="ignore"):
        count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
        doc = np.repeat(np.arange(d), count)
        first = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(w.offsets[:-1], count)
        length = np.minimum(size, n)[doc]
        g = np.full(len(doc), np.uint64(seed * 2 + 1))
        for k in range(n):
            on = length > k
            g[on] = mix64(g[on] * _ODD[k % len(_ODD)] + h[first[on] + k])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[keep], doc[keep]
    return doc, g, np.searchsorted(doc, np.arange(d + 1))


def _sums(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(g)))
        return total[at[1:]] - total[at[:-1]]


def class_keys(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set; the first is even, as the last bit tells the band in rows of cells."""
    with np.errstate(over="ignore"):
        size = np.diff(at).astype(np.uint64)
        return mix64(_sums(mix64(g ^ _ODD[3]), at) + size) & ~np.uint64(1), mix64(_sums(mix64(g ^ _ODD[4]), at) ^ size)


def bands(t: float, most: int = 1 << 40) -> np.ndarray:
    """Least size of each band; the largest size of a band times t is at most its least."""
    out = [1]
    while out[-1] < most:
        out.append(math.floor(out[-1] / t + 1e-9) + 1)
    return np.array(out)


def differ_at_most(total, t: float):
    """The most n-grams in which linked sets with `total` n-grams together differ."""
    return np.floor(np.asarray(total) * (1 - t) / (1 + t) + 1e-6).astype(np.int64)


def spare(d):
    """Blocks beyond d + 1: more of them are more rows, but let sets leave more of their crowded cells."""
    return 2 + d // 4


def _blocks(g: np.ndarray, at: np.ndarray, t: float, first_sizes: np.ndarray, up: int):
    """(band, spare blocks, blocks, first slot) of each set, and (owner, slot) of each n-gram, in its band or the one above."""
    size = np.diff(at)
    band = np.searchsorted(first_sizes, size, side="right") - 1 + up
    d = differ_at_most(2 * (first_sizes[np.minimum(band + 1, len(first_sizes) - 1)] - 1), t)
    blocks = np.where(size > 0, d + 1 + spare(d), 0)
    start = np.cumsum(blocks) - blocks
    who = np.repeat(np.arange(len(size)), size)
    block = (mix64(g ^ _ODD[0]) >> np.uint64(11)) % blocks[who].astype(np.uint64)
    return band, spare(d), blocks, start, who, start[who] + block.astype(np.int64)


def needs(g: np.ndarray, at: np.ndarray, t: float, first_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells that a set shares at least with any that it links with: in its own band, in the one above."""
    out = []
    for up in (0, 1):
        _, extra, blocks, _, who, slot = _blocks(g, at, t, first_sizes, up)
        filled = np.zeros(int(blocks.sum()), bool)
        filled[slot] = True
        n_empty = blocks - np.bincount(np.repeat(np.arange(len(blocks)), blocks), weights=filled, minlength=len(blocks)).astype(np.int64)
        out.append(np.maximum(1 + extra - n_empty, 1))
    return out[0], out[1]


def signatures(g: np.ndarray, at: np.ndarray, t: float, first_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, cell, whether in the band above) rows of all sets in a slice."""
    whos, cells, ups = [], [], []
    for up in (0, 1):
        band, extra, blocks, start, _, slot = _blocks(g, at, t, first_sizes, up)
        order = np.argsort(slot, kind="stable")
        total = int(blocks.sum())
        ends = np.searchsorted(slot[order], np.arange(total + 1))
        with np.errstate(over="ignore"):
            content = _sums(mix64(g[order] ^ _ODD[1]), ends)
            owner = np.repeat(np.arange(len(blocks)), blocks)
            number = (np.arange(total) - start[owner]).astype(np.uint64)
            cell = mix64(content + mix64(number * _ODD[2] + band[owner].astype(np.uint64) * _ODD[3]))
        empty = np.diff(ends) == 0
        n_empty = np.bincount(owner, weights=empty, minlength=len(blocks))
        keep = ~empty | (n_empty > extra)[owner]
        whos.append(owner[keep])
        cells.append(cell[keep])
        ups.append(np.full(len(cells[-1]), up, np.uint64))
    return np.concatenate(whos), np.concatenate(cells), np.concatenate(ups)


def widths(size: np.ndarray) -> np.ndarray:
    """Number of groups of each set's count vector."""
    return 1 << np.clip(np.frexp(size.astype(float))[1] - 1, LEAST_GROUPS.bit_length() - 1, MOST_GROUPS.bit_length() - 1)


def count_vectors(g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed count vectors of all sets, one after another, and their offsets; higher counts are held at MOST."""
    width = widths(np.diff(at))
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(width)))
    who = np.repeat(np.arange(len(width)), np.diff(at))
    group = ((mix64(g ^ _ODD[2]) >> np.uint64(7)) & (width[who] - 1).astype(np.uint64)).astype(np.int64)
    counts = np.bincount(offsets[who] + group, minlength=int(offsets[-1]))
    return np.minimum(counts, MOST).astype(np.uint8), offsets


def matrix(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Packed vectors as rows of one width, the least; counts at MOST have no bound, so that no minimum is too small."""
    width = np.diff(offsets)
    least = int(width.min())
    v = np.zeros((len(width), least), np.uint8)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        v[at] = _gathered(data, offsets, at, least)
    return np.where(v == MOST, 1 << 40, v.astype(np.int64)) if (v == MOST).any() else v


def _buffers(vector: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary array."""
    vector = vector.cast(pa.large_binary())
    return np.frombuffer(vector.buffers()[2], np.uint8), np.frombuffer(vector.buffers()[1], np.int64)[vector.offset : vector.offset + len(vector) + 1]


def _gathered(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Packed vectors of rows that all have one width, folded to `width`."""
    own = int(offsets[at[0] + 1] - offsets[at[0]])
    v = data[offsets[at][:, None] + np.arange(own)]
    while own > width:
        own //= 2
        v = np.minimum(v[:, :own].astype(np.uint16) + v[:, own:], MOST).astype(np.uint8)
    return v


def _overlap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed minima."""
    return np.minimum(x, y).sum(-1, dtype=np.int64)


def linked(inter, total, percent: int):
    """Jaccard of at least percent/100, in integers: total is |A| + |B|."""
    return 100 * inter >= percent * (total - inter)


class RTree:
    """Count vectors packed in sort-tile order: leaves of LEAF, nodes of FAN leaves."""

    LEAF, FAN = 16, 16

    def __init__(self, vectors: np.ndarray, size: np.ndarray):
        # Sort by size into slabs, and within a slab by the widest coordinate.
        slab = np.argsort(np.argsort(size, kind="stable"), kind="stable") // (self.LEAF * self.FAN)
        self.order = np.lexsort((vectors[:, np.argmax(vectors.max(0).astype(np.int64) - vectors.min(0))], slab))
        self.v, self.size = vectors[self.order], size[self.order]
        self.leaf = self._boxes(np.arange(0, len(self.v), self.LEAF), self.v, self.size, self.size)
        self.node = self._boxes(np.arange(0, len(self.leaf[0]), self.FAN), *self.leaf)

    @staticmethod
    def _boxes(cut, high, least, most):
        return np.maximum.reduceat(high, cut), np.minimum.reduceat(least, cut), np.maximum.reduceat(most, cut)

    def search(self, v: np.ndarray, size: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, position among the constructor's rows) of pairs that may link; the queries walk together."""

        def open_(box, at):
            high, least, most = (x[at] for x in box)
            q = size[:, None]
            need = t * (q + np.maximum(least, np.ceil(t * q - 1e-9))) / (1 + t) - 1e-6
            return (most >= t * q - 1e-6) & (least <= q / t + 1e-6) & (_overlap(v[:, None], high[None]) >= need)

        at = np.arange(len(self.node[0]))
        for box, fan, count in ((self.node, self.FAN, len(self.leaf[0])), (self.leaf, self.LEAF, len(self.v))):
            if count > self.LEAF:
                at = at[open_(box, at).any(0)]
            at = (at[:, None] * fan + np.arange(fan)).ravel()
            at = at[at < count]
        q, x = np.nonzero(open_((self.v, self.size, self.size), at))
        return q, self.order[at[x]]


class Marks:
    """Marks of sets, one after another, and their offsets."""

    def __init__(self, marks: np.ndarray, offsets: np.ndarray):
        self.marks, self.offsets, self.own = marks, offsets, np.zeros(1 << MARK_BITS, bool)

    def shared(self, one: int, others: np.ndarray) -> np.ndarray:
        """Marks of each of others that `one` has, too: no fewer than the n-grams they share."""
        mine = self.marks[self.offsets[one] : self.offsets[one + 1]]
        self.own[mine] = True
        out, count = [], self.offsets[others + 1] - self.offsets[others]
        part = (np.cumsum(count) - count) // LOOKED_UP
        for a in np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(others) else []:
            n = count[a : a + int((part == part[a]).sum())]
            start = np.cumsum(n) - n
            at = np.arange(int(n.sum())) + np.repeat(self.offsets[others[a : a + len(n)]] - start, n)
            out.append(np.add.reduceat(self.own[self.marks[at]], start, dtype=np.int64))
        self.own[mine] = False
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def forests(v: np.ndarray, size: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, t: float, most: int, marks: Marks | None = None) -> tuple[list[tuple[int, int]], bool]:
    """Pairs (of left, of right) of different components that the bound leaves, and whether pairs were left out.

    If there are many, they make at most `most` forests over the components: a pair goes to the first forest that does
    not yet join its ends, so what is left out has ends that every forest joins. With marks there always are forests, of pairs
    that share enough of them.
    """
    tree, found, place = RTree(v[right], size[right]), [], np.zeros(len(v), np.int64)
    place[left] = np.arange(len(left))
    place[right] = np.arange(len(right))
    for a in range(0, len(left), TOGETHER):
        own = left[a : a + TOGETHER]
        if component[own].min() == component[own].max() == component[right].min() == component[right].max():
            continue
        q, x = tree.search(v[own], size[own], t)
        q, x = own[q], right[x]
        keep = component[q] != component[x]
        if left is right:
            keep &= place[q] > place[x]
        q, x = q[keep], x[keep]
        order = np.lexsort((place[x], place[q]))
        found.append((q[order], x[order]))
    q, x = (np.concatenate([f[i] for f in found]) if found else left[:0] for i in (0, 1))
    if not len(q) or marks is None and len(q) <= FEW * most * len(v) or most > FORESTS:
        return list(zip(q.tolist(), x.tolist(), strict=True)), False
    start = np.unique(component, return_inverse=True)[1].ravel()
    labels = [start.copy() for _ in range(most)]
    last, pairs, refused = labels[-1], [], 0
    cut = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(q)], strict=True):
        one, hits = int(q[a]), x[a:b]
        if marks is not None:
            hidden = len(hits) - len(hits := hits[last[hits] != last[one]])
            hits = hits[marks.shared(one, hits) >= t * (size[one] + size[hits]) / (1 + t) - 1e-6]
            refused += b - a - hidden - len(hits)
        while len(hits := hits[last[hits] != last[one]]):
            own = next(lab for lab in labels if lab[one] != lab[hits[0]])
            own[own == own[hits[0]]] = own[one]
            pairs.append((one, int(hits[0])))
            hits = hits[1:]
    return pairs, len(pairs) + refused < len(q)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _rows(docs: DataFrame, n: int, seed: int, t: float) -> DataFrame:
    """(row, doc_id, key, check, size, vector, need_own, need_up) of each row of (row, doc_id, text)."""
    first_sizes = bands(t)

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column("text"), SLICE):
                _, g, at = gram_sets(data, offsets, n, seed)
                key, check = class_keys(g, at)
                v, cut = count_vectors(g, at)
                vector = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(cut), pa.py_buffer(v)]).cast(pa.binary())
                need = [pa.array(x.astype(np.int32)) for x in needs(g, at, t, first_sizes)]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), batch.column("doc_id").slice(a, b - a), _signed(key), _signed(check), pa.array(np.diff(at)), vector, *need], ["row", "doc_id", "key", "check", "size", "vector", "need_own", "need_up"])

    return docs.mapInArrow(run, "row long, doc_id long, key long, check long, size long, vector binary, need_own int, need_up int")


def _marked(docs: DataFrame, sets: DataFrame, n: int, seed: int) -> DataFrame:
    """(key, size, vector, marks) of the sets of docs (text), one of each key: marks are four bytes for each n-gram."""

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text"), SLICE):
                _, g, at = gram_sets(data, offsets, n, seed)
                key, _ = class_keys(g, at)
                marks = (mix64(g ^ _ODD[2]) >> np.uint64(64 - MARK_BITS)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([_signed(key), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(key), [None, pa.py_buffer(4 * at), pa.py_buffer(marks)]).cast(pa.binary())], ["k", "marks"])

    marked = docs.select("text").mapInArrow(run, "k long, marks binary")
    return sets.join(marked, F.col("key") == F.col("k")).select("key", "size", "vector", "marks")


#: Rows of cells that a task holds before it ties those that met.
HELD = 250_000
#: Rows of a batch that goes back to the JVM.
SENT = 50_000


def _cells(docs: DataFrame, n: int, seed: int, t: float) -> DataFrame:
    """(place, cell, code) of every class; copies met again in a task are left out. code: its key, plus 1 in the band above.

    The first set that meets others in a cell here has a row with the cell as place (cell null); where there are
    others, each of them, the first included, has a row with a place of its own.
    """
    first_sizes = bands(t)

    def tied(cells, codes):
        cell, code = np.concatenate(cells), np.concatenate(codes)
        order = np.lexsort((code, cell))
        cell, code = cell[order], code[order]
        new = np.append(True, cell[1:] != cell[:-1])
        other = new | np.append(True, code[1:] != code[:-1])
        head = np.flatnonzero(new)
        several = np.add.reduceat(other, head, dtype=np.int64) > 1
        tie = other & several[np.cumsum(new) - 1]
        null = np.append(np.ones(len(head), bool), np.zeros(int(tie.sum()), bool))
        place = np.append(cell[head], mix64(cell[tie] ^ mix64(code[tie])))
        whole = pa.RecordBatch.from_arrays([_signed(place), pa.array(np.append(cell[head], cell[tie]).view(np.int64), mask=null), _signed(np.append(code[head], code[tie]))], ["place", "cell", "code"])
        return (whole.slice(a, SENT) for a in range(0, whole.num_rows, SENT))

    def run(batches):
        seen: set[int] = set()
        cells, codes, held = [], [], 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text"), SLICE):
                _, g, at = gram_sets(data, offsets, n, seed)
                key, _ = class_keys(g, at)
                fresh = np.zeros(len(key), bool)
                for i, k in enumerate(key.tolist()):
                    if k not in seen:
                        fresh[i] = True
                        if len(seen) < 200_000:
                            seen.add(k)
                who, cell, up = signatures(g, at, t, first_sizes)
                keep = fresh[who]
                cells.append(cell[keep]), codes.append(key[who[keep]] | up[keep])
                held += len(cells[-1])
                if held > HELD:
                    yield from tied(cells, codes)
                    cells, codes, held = [], [], 0
        if held:
            yield from tied(cells, codes)

    return docs.select("text").mapInArrow(run, "place long, cell long, code long")


def _uncrowded(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(cell, key) of members (cell, code) without each set's most crowded cells: one less than it needs in a band."""
    crowd = members.groupBy("cell").agg(F.count("*").alias("n")).withColumnRenamed("cell", "c")
    counted = members.join(crowd, F.col("cell") == F.col("c")).select("cell", F.col("code").bitwiseAND(F.lit(-2)).alias("key"), F.col("code").bitwiseAND(F.lit(1)).alias("up"), "n")
    named = counted.join(classes.select(F.col("key").alias("k"), "need_own", "need_up"), F.col("key") == F.col("k"))
    place = F.row_number().over(Window.partitionBy("key", "up").orderBy(F.desc("n"), "cell"))
    return named.withColumn("place", place).where(F.col("place") >= F.when(F.col("up") == 1, F.col("need_up")).otherwise(F.col("need_own"))).select("cell", "key")


def _met(pairs: DataFrame, payload, columns: list[str]) -> DataFrame:
    """Both sides of pairs (a, b), one after another: (a, part, later, key, *columns), sorted by a, part and later.

    Partners of one a are cut into parts of about CHUNK; each part begins with a itself (later = 0).
    payload takes rows with a key and adds the columns.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("parts")).withColumnRenamed("a", "hub")
    dealt = pairs.join(many.hint("shuffle_hash"), F.col("a") == F.col("hub")).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")
    partners = dealt.select("a", "part", F.lit(1).alias("later"), F.col("b").alias("key"))
    hubs = dealt.select("a", "part").distinct().select("a", "part", F.lit(0).alias("later"), F.col("a").alias("key"))
    full = payload(partners.union(hubs)).select("a", "part", "later", "key", *columns)
    return full.repartition("a", "part").sortWithinPartitions("a", "part", "later")


def summed_minima(data: np.ndarray, offsets: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bound of the overlap of rows x and rows y; unbounded where both hold a count at MOST."""
    out, width = np.zeros(len(x), np.int64), np.diff(offsets)
    code = width[x] * (MOST_GROUPS + 1) + width[y]
    for c in np.unique(code).tolist():
        least, every = min(divmod(c, MOST_GROUPS + 1)), np.flatnonzero(code == c)
        step = max(1, (4 << 20) // max(divmod(c, MOST_GROUPS + 1)))
        for a in range(0, len(every), step):
            at = every[a : a + step]
            m = np.minimum(_gathered(data, offsets, x[at], least), _gathered(data, offsets, y[at], least))
            out[at] = np.where((m == MOST).any(1), 1 << 40, m.sum(1, dtype=np.int64))
    return out


def _bounded(pairs: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """Pairs (a, b) whose sizes and summed minima allow a link; sets: (key, size, vector)."""
    named = sets.select(F.col("key").alias("k"), "size", "vector")

    def run(batches):
        hub = None
        for batch in batches:
            # The last hub of the batch before goes first.
            batch = batch.select(["later", "key", "size", "vector"])
            batch = pa.Table.from_batches([batch] if hub is None else [hub, batch]).combine_chunks().to_batches()[0] if batch.num_rows else batch
            if not batch.num_rows:
                continue
            later, key, size = (np.asarray(batch.column(c)) for c in ("later", "key", "size"))
            place = np.maximum.accumulate(np.where(later == 0, np.arange(len(key)), 0))
            hub = batch.slice(int(place[-1]), 1)
            y = np.flatnonzero((later == 1) & (np.minimum(size, size[place]) >= t * np.maximum(size, size[place]) - 1e-6))
            over = summed_minima(*_buffers(batch.column("vector")), place[y], y)
            y = y[over >= t * (size[y] + size[place[y]]) / (1 + t) - 1e-6]
            yield pa.RecordBatch.from_arrays([pa.array(key[place[y]]), pa.array(key[y])], ["a", "b"])

    met = _met(pairs, lambda roles: roles.join(named, F.col("key") == F.col("k")), ["size", "vector"])
    return met.mapInArrow(run, "a long, b long")


def _pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
    x = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, work: Scratch, n: int, seed: int, percent: int) -> DataFrame:
    """Links among pairs (a, b), decided on the n-gram sets of both texts."""

    def texts(roles):
        wanted = work.write("wanted", roles.join(classes.select(F.col("key").alias("k"), F.col("first_row")), F.col("key") == F.col("k")).drop("k"))
        return docs.join(small_side(wanted), docs["row"] == F.col("first_row"))

    def run(batches):
        hub = None
        for batch in batches:
            out, later, key = [], batch.column("later").to_pylist(), batch.column("key").to_pylist()
            for first, _, data, offsets in text_slices(batch.column("text"), SLICE):
                _, g, at = gram_sets(data, offsets, n, seed)
                for i in range(len(at) - 1):
                    own = g[at[i] : at[i + 1]]
                    if not later[first + i]:
                        hub = key[first + i], own.copy()
                        continue
                    small, large = (own, hub[1]) if len(own) < len(hub[1]) else (hub[1], own)
                    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    if linked(int((large[place] == small).sum()), len(small) + len(large), percent):
                        out.append((hub[0], key[first + i]))
            yield _pairs(out)

    return _met(pairs, texts, ["text"]).mapInArrow(run, "a long, b long")


def _shortened(links: DataFrame) -> DataFrame:
    """Links with the same components: of those that a task holds at once, each end with the smallest key it reaches there."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x):
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while x != top:
                root[x], x = top, root[x]
            return top

        def stars():
            return _pairs([(find(x), x) for x in root if root[x] != x])

        for batch in batches:
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
            if len(root) > HELD:
                yield stars()
                root.clear()
        yield stars()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, work: Scratch, known: DataFrame | None = None, name: str = "components") -> DataFrame:
    """(key, component) of every end of a link: smallest reachable key, by contraction; known: what earlier links gave.

    Each root goes under its smallest neighbour if that is smaller, chains are followed to their ends, and links
    between the roots that are left go on. A root that stays without a gain has a neighbour that went under a still smaller one,
    so it goes in the next round: roots at least halve in two rounds, whatever the keys.
    """
    if known is not None:
        links = _apart(links, known, root=True).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    edges = _shortened(links)
    edges = work.write("edges", edges.union(edges.select("b", "a")).where("a <> b").distinct())
    state = work.write("reached", edges.select(F.col("a").alias("key")).distinct().withColumn("component", F.col("key")))
    while not edges.isEmpty():
        to = work.write("roots", edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("from"), F.least("a", "m").alias("root")))
        moved = True
        while moved:
            once, twice = (small_side(to.select(F.col("from").alias(f"f{i}"), F.col("root").alias(f"r{i}"))) for i in (1, 2))
            after = to.join(once, F.col("root") == F.col("f1")).join(twice, F.col("r1") == F.col("f2"))
            after = work.write("roots", after.select("from", F.col("r2").alias("root"), F.col("r1").alias("before")))
            to, moved = after.drop("before"), not after.where("root <> before").isEmpty()
        up = small_side(to)
        state = work.write("reached", state.join(up, F.col("component") == F.col("from"), "left").select("key", F.coalesce("root", "component").alias("component")))
        x, y = (up.select(F.col("from").alias(f"f{s}"), F.col("root").alias(f"r{s}")) for s in "ab")
        between = edges.join(x, F.col("a") == F.col("fa")).join(y, F.col("b") == F.col("fb")).where("ra <> rb")
        edges = work.write("edges", between.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if known is not None:
        gone = state.select(F.col("key").alias("from"), F.col("component").alias("root"))
        new = state.join(known.select("key"), "key", "left_anti")
        state = known.join(gone, F.col("component") == F.col("from"), "left").select("key", F.coalesce("root", "component").alias("component")).union(new)
    state = work.write(name, state)
    work.drop("edges", "roots", "reached")
    return state


def _apart(pairs: DataFrame, comp: DataFrame, *more: str, root: bool = False) -> DataFrame:
    """Pairs (a, b) whose ends are not yet in one component; root adds the components, root_a and root_b."""
    x, y = (comp.select(F.col("key").alias(f"k{s}"), F.col("component").alias(f"c{s}")) for s in "ab")
    j = pairs.join(x, F.col("a") == F.col("ka"), "left").join(y, F.col("b") == F.col("kb"), "left")
    p, q = F.coalesce("ca", "a"), F.coalesce("cb", "b")
    return j.where(p != q).select("a", "b", *more, *([p.alias("root_a"), q.alias("root_b")] if root else []))


def _open_cells(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(cell, key, component) of cells (cell, key) with several components, one of all cells with the same keys."""
    named = members.join(comp.withColumnRenamed("key", "k"), F.col("key") == F.col("k"), "left").select("cell", "key", F.coalesce("component", "key").alias("component"))
    sums = [F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")]
    cells = named.groupBy("cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), *sums).where("lo <> hi")
    one = cells.groupBy("n", "x", "y").agg(F.min("cell").alias("c"))
    return named.join(one.select("c"), F.col("cell") == F.col("c")).drop("c")


def _tiles(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(cell, own, part, lo, hi, m) of open cells: m lists sets of about TILE weight; own is the component of tiles with only one."""
    by = open_.groupBy("cell", "component").agg(F.sum("weight").alias("n"))
    small = F.when(F.col("n") <= TILE, F.col("n")).otherwise(0)
    rest = by.groupBy("cell").agg(F.sum(small).alias("rest")).withColumnRenamed("cell", "c2")
    parts = by.join(rest, F.col("cell") == F.col("c2")).select(
        F.col("cell").alias("c"), F.col("component").alias("o"), F.when(F.col("n") > TILE, F.col("component")).alias("own"),
        F.ceil(F.when(F.col("n") > TILE, F.col("n")).otherwise(F.col("rest")) / F.lit(TILE)).alias("parts"),
    )
    part = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("component")).otherwise(F.col("key"))), F.col("parts"))
    dealt = open_.join(parts, (F.col("cell") == F.col("c")) & (F.col("component") == F.col("o"))).select("cell", "own", part.alias("part"), "key", "component")
    return _listed(dealt, sets, "cell", "own", "part")


def _listed(open_: DataFrame, sets: DataFrame, *by: str) -> DataFrame:
    """Components' range and members m with their vectors, and marks if there are any, of each group."""
    more = [c for c in sets.columns if c != "key"]
    full = open_.join(sets.select(F.col("key").alias("k"), *more), F.col("key") == F.col("k"))
    return full.groupBy(*by).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.collect_list(F.struct("key", "component", *more)).alias("m"))


def _candidates(open_: DataFrame, sets: DataFrame, work: Scratch, t: float, most: int) -> DataFrame:
    """(cell, a, b) that tiles of open cells, and pairs of tiles of a cell, leave; a row without a pair tells that pairs were left out."""
    with_marks = "marks" in sets.columns

    def joined(sides, name):
        return pa.concat_arrays([s.field(name).cast(pa.large_binary()) for s in sides])

    def run(batches):
        for batch in batches:
            out: list = []
            for i, cell in enumerate(batch.column("cell").to_pylist()):
                sides = [batch.column(c)[i].values for c in batch.schema.names[1:]]
                key, component, size = (np.concatenate([s.field(c).to_numpy() for s in sides]) for c in ("key", "component", "size"))
                v = matrix(*_buffers(joined(sides, "vector")))
                marks = None
                if with_marks:
                    data, at = _buffers(joined(sides, "marks"))
                    marks = Marks(data[at[0] : at[-1]].view(np.uint32), (at - at[0]) // 4)
                # By key, so that cells with much the same sets give much the same forests.
                order, cut = np.argsort(key, kind="stable"), len(sides[0])
                left = right = order
                if len(sides) > 1:
                    left, right = order[order < cut], order[order >= cut]
                pairs, hidden = forests(v, size, component, left, right, t, most, marks)
                out += [(cell, min(key[x], key[y]), max(key[x], key[y])) for x, y in pairs]
                if hidden:
                    out.append((cell, None, None))
            yield pa.RecordBatch.from_arrays([pa.array([None if r[k] is None else int(r[k]) for r in out], pa.int64()) for k in range(3)], ["cell", "a", "b"])

    schema = "cell long, a long, b long"
    if with_marks:
        weight = sets.select(F.col("key").alias("k"), F.ceil(F.col("size") / F.lit(MARKS)).alias("weight"))
        open_ = work.write("weighed", open_.join(weight, F.col("key") == F.col("k")).drop("k"))
    else:
        open_ = open_.withColumn("weight", F.lit(1).cast("long"))
    large = work.write("large", open_.groupBy("cell").agg(F.sum("weight").alias("n")).where(F.col("n") > TILE).select(F.col("cell").alias("l")))
    if large.isEmpty():
        return _listed(open_, sets, "cell").select("cell", "m").mapInArrow(run, schema)
    is_large = F.col("cell") == F.col("l")
    tiles = work.write("tiles", _tiles(open_.join(large, is_large, "left_semi"), sets))
    names = tiles.select("cell", "own", "part")
    x, y = (names.select(F.col("cell").alias(f"c{s}"), F.col("own").alias(f"o{s}"), F.col("part").alias(f"p{s}")) for s in "xy")
    first = lambda s: F.struct(F.coalesce(f"o{s}", F.lit(0)), F.col(f"o{s}").isNull(), F.col(f"p{s}"))
    # Tiles of one component do not meet.
    two = x.join(y, F.col("cx") == F.col("cy")).where((first("x") < first("y")) & ~F.coalesce(F.col("ox") == F.col("oy"), F.lit(False)))
    p, q = (tiles.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cell", "own", "part", "m")]) for s in "pq")
    same = lambda s, z: (F.col(f"c{z}") == F.col(f"cell_{s}")) & F.col(f"o{z}").eqNullSafe(F.col(f"own_{s}")) & (F.col(f"p{z}") == F.col(f"part_{s}"))
    across = two.join(p, same("p", "x")).join(q, same("q", "y")).select(F.col("cx").alias("cell"), "m_p", "m_q")
    inside = _listed(open_.join(large, is_large, "left_anti"), sets, "cell").select("cell", "m").union(tiles.where("lo <> hi").select("cell", "m"))
    return inside.mapInArrow(run, schema).union(across.mapInArrow(run, schema))


def join_components(docs: DataFrame, n: int = 3, percent: int = 90, seed: int = 0, groups: bool = False) -> DataFrame:
    """docs (doc_id, text) -> one row each: row, doc_id, n_shingles, component_id.

    groups adds `group`, a key per component that does not depend on doc_id (null for empty sets).
    """
    t, work = percent / 100, Scratch(docs.sparkSession)
    docs = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = work.write("rows", _rows(docs, n, seed, t))
    classes = work.write("classes", rows.where("size > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.min("row").alias("first_row"), F.min("check").alias("c1"), F.max("check").alias("c2"), F.max("need_own").alias("need_own"), F.max("need_up").alias("need_up")))
    if not classes.where("c1 <> c2").isEmpty():
        work.close()
        return join_components(docs.drop("row"), n, percent, seed + 1, groups)
    by_place = Window.partitionBy("place")
    met = _cells(docs, n, seed, t).withColumns({"lo": F.min("code").over(by_place), "hi": F.max("code").over(by_place)}).where("cell is not null or lo <> hi")
    met = work.write("met", met.select(F.coalesce("cell", "place").alias("cell"), "code").distinct())
    members = work.write("members", _uncrowded(met, classes))
    work.drop("met")
    first = members.groupBy("cell").agg(F.min("key").alias("anchor")).withColumnRenamed("cell", "c")
    live = work.write("live", members.join(first, F.col("cell") == F.col("c")).where("key <> anchor").select("cell", "key", "anchor"))
    stars = work.write("stars", live.select(F.col("anchor").alias("a"), F.col("key").alias("b")).distinct())
    work.drop("members")
    used = stars.select(F.col("a").alias("key")).union(stars.select("b")).distinct()
    chosen = work.write("chosen", classes.join(used, "key", "left_semi").select("first_row"))
    sets = work.write("sets", rows.join(small_side(chosen), F.col("row") == F.col("first_row")).select("key", "size", "vector"))
    likely = work.write("likely", _bounded(stars, sets, t))
    work.drop("stars", "chosen")

    def joined(pairs, known=None):
        links = work.write("links", _verified(pairs, docs, classes, work, n, seed, percent))
        return components(links, work, known)

    # One pair of each set connects most; then only pairs of different components are left to verify.
    tested = work.write("tested", likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    comp = joined(tested)
    for every in (False, True):
        apart = work.write("apart", _apart(likely, comp, root=True).join(tested, ["a", "b"], "left_anti"))
        if not every:
            one = apart.groupBy("root_a", "root_b").agg(F.min(F.struct("a", "b")).alias("p"))
            apart = work.write("apart", one.select("p.a", "p.b"))
        if not apart.isEmpty():
            comp = joined(apart.select("a", "b"), comp)
            tested = work.write("tested", tested.union(apart.select("a", "b")))
    # Each cell's first set has met all others there.
    open_, most = work.write("open", _open_cells(live.select("cell", "key"), comp)), 1
    work.drop("live", "likely")
    while not open_.isEmpty():
        found = work.write("found", _candidates(open_, sets, work, t, most))
        work.drop("tiles", "weighed")
        fresh = work.write("fresh", found.where("a is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        if not fresh.isEmpty():
            comp = joined(fresh, comp)
            tested = work.write("tested", tested.union(fresh))
        # Where all pairs of a cell's forest proved to be links, what they hid is connected, too.
        hidden = found.where("a is null").select(F.col("cell").alias("h")).distinct()
        failed = _apart(found.where("a is not null"), comp, "cell").select(F.col("cell").alias("f")).distinct()
        again = hidden.join(failed, F.col("h") == F.col("f"), "left_semi")
        open_ = work.write("open", _open_cells(open_.select("cell", "key").join(again, F.col("cell") == F.col("h"), "left_semi"), comp))
        if "marks" in sets.columns:
            most *= 8
        elif not open_.isEmpty():
            chosen = work.write("chosen", classes.join(open_.select("key").distinct(), "key", "left_semi").select("first_row"))
            sets = work.write("sets", _marked(docs.join(small_side(chosen), F.col("row") == F.col("first_row")), sets, n, seed))
    named = comp.select(F.col("key").alias("k"), "component")
    own = classes.select("key", "least").join(named, F.col("key") == F.col("k"), "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    smallest = own.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "c")
    lookup = own.join(smallest, F.col("component") == F.col("c")).select(F.col("key").alias("k"), "component_id", F.col("component").alias("group"))
    filled = rows.where("size > 0").join(lookup, F.col("key") == F.col("k")).select("row", "doc_id", "size", "component_id", "group")
    empty = rows.where("size = 0").select("row", "doc_id", "size", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    out = work.keep(filled.union(empty).withColumnRenamed("size", "n_shingles"))
    return out if groups else out.drop("group")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")
