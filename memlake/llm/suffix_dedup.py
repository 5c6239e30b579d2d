"""Passages that repeat across documents, by sparse suffix arrays.

Suffixes are kept only where a minimiser stands: the least hash of ten words among thirty such in a row. Equal
passages of 50 words share one at the same place, whatever surrounds them. Minimisers that occur once are left out
by a count and a bitmap of fixed size. The suffixes left carry the hashes of the words after and before them; a
range sort by the words after them, in which common passages spread over partitions, puts those with the longest
common prefixes side by side. Neighbours are compared, matches extended to the right and to the left, and spans of
at least `least` words kept and merged. Partition ends are compared once more among themselves.

A passage of 50 words has its first minimiser within its first 30 words, so two suffixes that stand for it agree in
21 words to the right at least. Where more rows agree in those than neighbours are compared, the windows of 50 words
around each are hashed and those that two documents hold are kept; rows that may go on beyond a chunk hand their
windows to a count over all chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import bitmap_of
from .shared import keep, slices, sorted_set, with_utf8

LEAST, GRAM, WINDOW = 50, 10, 30
LEFT = WINDOW - 1
NEAR = 4
TIED = LEAST - LEFT
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_TABLE = np.random.default_rng(2).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INDEX = 22


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and where each text's words begin (with the end as last)."""
    with np.errstate(over="ignore"):
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        space = _SPACE[data]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _powers(_BASE, len(data)), dtype=np.uint64)])
        back = _powers(pow(_BASE, -1, 1 << 64), len(data))
        h = _mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
        at = np.cumsum([1, *(len(t) + 1 for t in texts)])
        return h, np.searchsorted(starts, at)


def minimisers(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of minimisers among all words, in order, and the hashes of the words they start."""
    n = len(h)
    if n < GRAM + WINDOW - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        b = np.uint64(_BASE)
        two = h[:-1] * b + h[1:]
        four = two[:-2] * (b * b) + two[2:]
        eight = four[:-4] * (b * b * b * b) + four[4:]
        gram = _mix(eight[: n - GRAM + 1] * (b * b) + two[8 : 8 + n - GRAM + 1])
    low = np.uint64((1 << _INDEX) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while width * 2 <= WINDOW:
        least, width = np.minimum(least[:-width], least[width:]), width * 2
    least = np.minimum(least[: len(least) - (WINDOW - width)], least[WINDOW - width :])
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    whole = doc[: len(least)] == doc[GRAM + WINDOW - 2 :]
    at = sorted_set(least[whole] & low).astype(np.int64)
    return at, gram[at]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices with their words' hashes. A text of over 2^22 words or so is taken in overlapping pieces."""
    piece = 1 << 23
    for batch in slices(batches, limit=1 << 20):
        texts = batch.column("utf8").to_pylist()
        if len(texts) == 1 and len(texts[0]) > piece:  # slices leave no other row beside such a text
            yield from _long(batch, texts[0], piece)
            continue
        h, begin = word_hashes(texts)
        yield batch, h, begin, np.zeros(len(texts), np.int64), *minimisers(h, begin)


def _long(batch: pa.RecordBatch, text: bytes, piece: int) -> Iterator[tuple]:
    """Pieces of a very long text; each repeats the words before it that a suffix may need."""
    hashes = []
    at = 0
    while at < len(text):
        end = min(len(text), at + piece)
        while end < len(text) and text[end] not in b"\t\n\v\f\r ":
            end += 1
        hashes.append(word_hashes([text[at:end]])[0])
        at = end
    h, step = np.concatenate(hashes), 1 << 21
    for lo in range(0, len(h), step):
        own = h[max(0, lo - LEAST - WINDOW) : lo + step + LEAST + WINDOW]
        begin = np.array([0, len(own)])
        yield batch, own, begin, np.array([max(0, lo - LEAST - WINDOW)]), *minimisers(own, begin)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, _, _, gram in _blocks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], ["gram"])


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of words' hashes as binary values that compare word by word."""
    wide = rows.shape[1] * 4
    data = pa.py_buffer(np.ascontiguousarray(rows.astype(">u4")))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * wide), data])


def _values(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").astype(np.uint32).reshape(-1, width)


def _common(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows, at most `most`."""
    apart = a != b
    return np.minimum(np.where(apart.any(1), apart.argmax(1), a.shape[1]), most)


SUFFIX = ["id", "pos", "n_right", "n_left", "right", "left"]


class _Chunk:
    """Sorted suffixes and, for each, how far any neighbour's match goes to the right and to the left."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        self.pos, self.n_right, self.n_left = (batch.column(k).to_numpy() for k in ("pos", "n_right", "n_left"))
        self.right, self.left = _values(batch.column("right"), LEAST), _values(batch.column("left"), LEFT)
        ids = batch.column("id").to_pylist()
        self.change = np.array([i > 0 and ids[i] != ids[i - 1] for i in range(len(ids))])
        self.to_right, self.to_left = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        n = len(ids)
        for d in range(1, NEAR + 1):
            i = np.arange(d, n)
            self._match(i, i - d, ids)
        # The nearest suffix of another document, where many of one document stand together.
        first = np.maximum.accumulate(np.where(self.change, np.arange(n), 0))
        i = np.flatnonzero(first > 0)
        self._match(i, first[i] - 1, ids)
        nxt = np.minimum.accumulate(np.where(np.append(self.change[1:], False), np.arange(n), n)[::-1])[::-1] + 1
        i = np.flatnonzero(nxt < n)
        self._match(i, nxt[i], ids)
        self.open: list[tuple[np.ndarray, int, np.ndarray]] = []
        self._windows()

    def _windows(self) -> None:
        """Windows of LEAST words that two documents hold, among rows that tie with more than their neighbours."""
        n = len(self.pos)
        tie = (self.right[1:, :TIED] == self.right[:-1, :TIED]).all(1) & (self.n_right[1:] >= TIED) & (self.n_right[:-1] >= TIED)
        run = np.cumsum(np.append(False, ~tie))
        edge = (run == run[0]) | (run == run[-1])
        at = np.flatnonzero(((np.bincount(run)[run] > NEAR + 1) | edge) & (self.n_right >= TIED))
        doc = self.batch.column("id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        base, power = np.uint64(_BASE), _powers(_BASE, LEAST + 1)
        before = np.zeros((LEFT + 1, len(at)), np.uint64)
        for o in range(LEFT):
            before[o + 1] = before[o] + self.left[at, o] * power[o]
        after = np.zeros(len(at), np.uint64)
        for k in range(LEAST):
            after = after * base + self.right[at, k]
            o = LEAST - k - 1
            if o > LEFT:
                continue
            has = np.flatnonzero((self.n_left[at] >= o) & (self.n_right[at] > k))
            if not len(has):
                continue
            i, h = at[has], _mix(before[o, has] * power[k + 1] + after[has])
            order = np.lexsort((doc[i], h))
            i, h = i[order], h[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            last = np.append(first[1:], len(h)) - 1
            both = np.repeat(doc[i[first]] != doc[i[last]], last - first + 1)
            self.to_left[i[both]] = np.maximum(self.to_left[i[both]], o)
            self.to_right[i[both]] = np.maximum(self.to_right[i[both]], k + 1)
            told = ~both  # of a window known to be shared, rows of two documents tell the other chunks so
            told[first] = told[last] = True
            told &= edge[i]
            if told.any():
                self.open.append((i[told], o, h[told]))

    def _match(self, i: np.ndarray, j: np.ndarray, ids: list) -> None:
        for at in range(0, len(i), 1 << 15):
            a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            r = _common(self.right[a], self.right[b], np.minimum(self.n_right[a], self.n_right[b]))
            far = np.flatnonzero(r >= GRAM)
            a, b, r = a[far], b[far], r[far]
            left = _common(self.left[a], self.left[b], np.minimum(self.n_left[a], self.n_left[b]))
            ok = [x for x in np.flatnonzero(left + r >= LEAST) if ids[a[x]] != ids[b[x]]]
            for k in (a, b):
                np.maximum.at(self.to_right, k[ok], r[ok])
                np.maximum.at(self.to_left, k[ok], left[ok])

    def found(self, lo: int, hi: int) -> pa.RecordBatch:
        at = np.flatnonzero(self.to_right[lo:hi]) + lo
        none = pa.nulls(len(at), pa.binary())
        zero = pa.array(np.zeros(len(at), np.int32))
        return pa.RecordBatch.from_arrays([self.batch.column("id").take(pa.array(at)), pa.array(self.pos[at] - self.to_left[at]), pa.array(self.pos[at] + self.to_right[at]), zero, pa.nulls(len(at), pa.int64()), zero, zero, none, none, zero], OUT)

    def windows(self) -> Iterator[pa.RecordBatch]:
        """Windows of rows whose ties may go on in another chunk (side 3), their hash as `pos`."""
        for i, o, h in self.open:
            none, zero, start = pa.nulls(len(i), pa.binary()), pa.array(np.zeros(len(i), np.int32)), self.pos[i] - o
            yield pa.RecordBatch.from_arrays([self.batch.column("id").take(pa.array(i)), pa.array(start), pa.array(start + LEAST), pa.array(np.full(len(i), 3, np.int32)), pa.array(h.view(np.int64)), zero, zero, none, none, zero], OUT)

    def edge(self, lo: int, hi: int, side: int, part: int) -> pa.RecordBatch:
        b, n = self.batch.slice(lo, hi - lo), hi - lo
        nil = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([b.column("id"), nil, nil, pa.array(np.full(n, side, np.int32)), *(b.column(k) for k in SUFFIX[1:]), pa.array(np.full(n, part, np.int32))], OUT)

    def reach(self, forward: bool, most: int = 1000) -> int:
        """How many rows from one end must meet the neighbouring rows: some, and one of another document.

        `most` bounds them where one document has a long run of rows: rows of it that match another document's
        tie with all rows between, up to the chunk's end, and their windows are told there.
        """
        turns = np.flatnonzero(self.change)
        n = len(self.change)
        if not len(turns):
            return min(n, most)
        return min(n, most, max(NEAR, turns[0] + 1) if forward else max(NEAR, n - turns[-1] + 1))


OUT = ["id", "start", "end", "side", "pos", "n_right", "n_left", "right", "left", "part"]


def _neighbours(batches: Iterator[pa.RecordBatch], edges: bool, most: int) -> Iterator[pa.RecordBatch]:
    """In chunks of about `most` rows: matches of sorted suffixes (side 0) and, with `edges`, the partition's first (1) and last (2) rows and open windows (3)."""
    part = TaskContext.get().partitionId()
    held: list[pa.RecordBatch] = []
    first = True

    def joined() -> _Chunk:
        return _Chunk(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < most:
            continue
        chunk = joined()
        n = chunk.batch.num_rows
        stay = min(n, 2 * chunk.reach(False))
        if edges and first:
            yield chunk.edge(0, chunk.reach(True), 1, part)
        first = False
        yield chunk.found(0, n)  # rows that stay are compared again with what follows; spans are merged in the end
        if edges:
            yield from chunk.windows()
        held = [chunk.batch.slice(n - stay)]
    if held:
        chunk = joined()
        n = chunk.batch.num_rows
        yield chunk.found(0, n)
        if edges:
            if first:
                yield chunk.edge(0, chunk.reach(True), 1, part)
            yield chunk.edge(n - chunk.reach(False), n, 2, part)
            yield from chunk.windows()


def _shared_windows(windows: DataFrame) -> DataFrame:
    """id, start, end of the windows (id, start, end, window) that two ids hold, null being one."""
    held = windows.groupBy("window").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("id").alias("known"), F.count(F.lit(1)).alias("n"))
    return windows.join(held.filter("low <> high OR (known > 0 AND known < n)").select("window"), "window").select("id", "start", "end")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bitmap_bits: int = 1 << 26, chunk: int = 100_000) -> DataFrame:
    """id_col, start, end (words, end exclusive), n_words: merged spans of passages that another document has too.

    A passage has 50 words or more, words being runs of other than ASCII white space. Null, empty and shorter
    texts have no spans, rows that share an id (null is one) are one document, and copies are spans from end to
    end. No rows: an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = with_utf8(docs, F.col(id_col).alias("id"), text=text_col)
    often = texts.mapInArrow(_count_grams, "gram long").groupBy("gram").count().filter("count > 1")
    held = docs.sparkSession.sparkContext.broadcast(bitmap_of(often, "gram", bitmap_bits))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch, h, begin, moved, at, gram in _blocks(batches):
            place = gram.view(np.int64) & (8 * len(bits) - 1)
            at = at[(bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
            short = (h >> np.uint64(32)).astype(np.uint32)
            for lo in range(0, len(at), 1 << 14):
                p = at[lo : lo + (1 << 14)]
                doc = np.searchsorted(begin, p, side="right") - 1
                right, left = np.minimum(LEAST, begin[doc + 1] - p), np.minimum(LEFT, p - begin[doc])
                steps = np.arange(LEAST)
                after = short[np.minimum(p[:, None] + steps, len(short) - 1)] * (steps < right[:, None])
                steps = np.arange(LEFT)
                before = short[np.maximum(p[:, None] - 1 - steps, 0)] * (steps < left[:, None])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), pa.array(p - begin[doc] + moved[doc]), pa.array(right.astype(np.int32)), pa.array(left.astype(np.int32)), _fixed(after), _fixed(before)], SUFFIX)

    rows = keep(texts.mapInArrow(suffixes, f"id {id_type}, pos long, n_right int, n_left int, right binary, left binary"), "suffixes")
    out = f"id {id_type}, start long, end long, side int, pos long, n_right int, n_left int, right binary, left binary, part int"
    order = ["right", "id", "pos"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = keep(sorted_.mapInArrow(lambda b: _neighbours(b, True, chunk), out), "suffix-matches")
    ends = found.filter("side IN (1, 2)")
    parts = ends.select("part").distinct().withColumn("nth", F.row_number().over(Window.orderBy("part")))  # a row a partition
    ends = ends.join(F.broadcast(parts), "part").withColumn("border", F.when(F.col("side") == 2, F.col("nth")).otherwise(F.col("nth") - 1))
    again = ends.repartition("border").sortWithinPartitions("border", *order).select(*SUFFIX).mapInArrow(lambda b: _neighbours(b, False, chunk), out)
    far = _shared_windows(found.filter("side = 3").select("id", "start", "end", F.col("pos").alias("window")))
    spans = found.filter("side = 0").unionByName(again).select("id", "start", "end").union(far).distinct()
    by_start = Window.partitionBy("id").orderBy("start", "end")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int")).withColumn("nth", F.sum("fresh").over(by_start))
    merged = spans.groupBy("id", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select(F.col("id").alias(id_col), "start", "end", (F.col("end") - F.col("start")).alias("n_words"))
