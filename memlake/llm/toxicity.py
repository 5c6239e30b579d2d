"""Toxicity scores from a factorization machine over hashed terms.

Terms are lower-cased words and their first four and five letters, hashed into 2^20 buckets. A factorization
machine learns a weight for each bucket that occurs in the labelled rows and for each pair of them through `rank`
factors; steps of weights are damped where the bucket's presence hardly goes with the label, factors never are. A
text's score is the logistic of the machine's value for the buckets it holds, whatever its length.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import give_back, slices, with_utf8

BUCKETS = 1 << 20
#: Passes and damping, chosen by the mean log loss of three folds of the rows whose labels may be learned (remainders 0, 1 and 3).
EPOCHS, DAMPING = 20, 25.0
_TERM = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def buckets_of(word: str) -> tuple[int, ...]:
    """Hashed terms of one word."""
    found = [f"w {word}"] + [f"{n} {word[:n]}" for n in (4, 5) if len(word) > n]
    return tuple(zlib.crc32(x.encode()) & (BUCKETS - 1) for x in found)


def words_of(utf8: bytes) -> set[str]:
    return set(_TERM.findall(utf8.decode("utf-8", "replace").lower()))


@dataclass(frozen=True)
class Machine:
    """feature: from bucket to position; bias, weight (n) and factor (n, rank) of the machine."""

    feature: dict[int, int] | range
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, on: list[int]) -> float:
        if not on:
            return 1 / (1 + math.exp(-self.bias))
        v = self.factor[on]
        s = v.sum(0, dtype=float)
        x = self.bias + float(self.weight[on].sum(dtype=float)) + 0.5 * float(s @ s - (v * v).sum())
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def fit_machine(on: list[list[int]] | pa.ListArray, y: np.ndarray, feature: dict[int, int] | range, rank: int = 4, epochs: int = EPOCHS, step: float = 0.1, decay: float = 1e-4, damping: float = DAMPING, seed: int = 5) -> Machine:
    """Logistic loss by AdaGrad over mini-batches of sparse rows. Features that no row has stay at zero.

    epochs: passes over the rows, whatever their number. A weight's steps are damped by ((z^2 + 1) / (z^2 + damping))^2
    with z of its feature's presence by label. Factors move by steps that shrink with the number of features in a
    row, whose moves add up.
    """
    rng, n = np.random.default_rng(seed), max(1, len(feature))
    rate = min(0.98, max(0.02, float(y.mean()))) if len(y) else 0.05
    on = pa.array(on, pa.list_(pa.int32())) if isinstance(on, list) else on
    begin = on.offsets.to_numpy().astype(np.int64)
    flat, size = on.values.to_numpy()[begin[0] :], np.diff(begin)
    begin -= begin[0]
    total = np.bincount(flat, minlength=n)
    seen = np.flatnonzero(total)
    at = np.zeros(n, np.int32)
    at[seen] = np.arange(len(seen))
    toxic, total = np.bincount(flat[np.repeat(y > 0, size)], minlength=n)[seen], total[seen]
    pos, neg = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    share = total / max(1, len(y))
    z2 = (toxic / pos - (total - toxic) / neg) ** 2 / (share * (1 - share) * (1 / pos + 1 / neg) + 1e-12)
    damp = ((z2 + 1) / (z2 + damping)) ** 2
    turn = step * min(1.0, 16 / max(1.0, size.mean())) if len(size) else step

    batches, order = [], rng.permutation(len(y))
    for lo in range(0, len(order), 64):
        rows = order[lo : lo + 64]
        cols = at[np.concatenate([flat[begin[r] : begin[r + 1]] for r in rows])]
        of = np.repeat(np.arange(len(rows), dtype=np.int16), size[rows])
        by = np.argsort(cols, kind="stable")
        used, first = np.unique(cols[by], return_index=True)
        full = np.flatnonzero(size[rows])
        batches.append((y[rows], used, np.searchsorted(used, cols).astype(np.int32), of[by], first, full, (np.cumsum(size[rows]) - size[rows])[full]))

    del on, flat, at
    bias, w, v = math.log(rate / (1 - rate)), np.zeros(len(seen), np.float32), rng.normal(0, 0.01, (len(seen), rank)).astype(np.float32)
    gw, gv, gb = np.full(len(seen), 1e-6, np.float32), np.full((len(seen), rank), 1e-2, np.float32), 1e-6
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            real, used, place, of, first, full, starts = batches[k]
            wu, vu = w[used], v[used]
            s, square, line = np.zeros((len(real), rank)), np.zeros(len(real)), np.zeros(len(real))
            if len(used):
                s[full] = np.add.reduceat(vu[place], starts)
                square[full] = np.add.reduceat((vu * vu).sum(1)[place], starts)
                line[full] = np.add.reduceat(wu[place], starts)
            x = bias + line + 0.5 * ((s * s).sum(1) - square)
            err = (1 / (1 + np.exp(-np.clip(x, -30, 30))) - real) / len(real)
            gb += (d := err.sum()) ** 2
            bias -= step * d / math.sqrt(gb)
            if len(used):
                each = np.add.reduceat(err[of], first)
                dw, dv = each + decay * wu, np.add.reduceat((err[:, None] * s)[of], first) - each[:, None] * vu + decay * vu
                gw[used] += dw**2
                gv[used] += dv**2
                w[used] -= damp[used] * step * dw / np.sqrt(gw[used])
                v[used] -= turn * dv / np.sqrt(gv[used])
    weight, factor = np.zeros(n, np.float32), np.zeros((n, rank), np.float32)
    weight[seen], factor[seen] = w, v
    return Machine(feature, bias, weight, factor)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo 4, is 2. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit_toxicity(docs: DataFrame, labels: DataFrame, most_labels: int = 8_000, most_terms: int = 8_192) -> Machine:
    """Fit on labelled rows outside the held-out quarter: all of them, or the `most_labels` first by a hash of the id.

    Rows without a label, an id or a document are left out; of repeated labels of one id, toxic wins, and of its
    documents the one whose text has the least hash. Only the buckets that the sampled rows hold reach the driver, of
    each row `most_terms` at most, those with the least hashes; weights and factors have a fixed size.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    rows = with_utf8(docs, "doc_id").join(F.broadcast(known), "doc_id").select("doc_id", "utf8", "y")
    feature = range(BUCKETS)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            texts = batch.column("utf8").to_pylist()
            on = [sorted(x) if len(x) <= most_terms else sorted(sorted(x, key=_spread)[:most_terms]) for x in (_present(x, feature, cache) for x in texts)]
            first = [zlib.crc32(x) for x in texts]
            if len(cache) > 150_000:
                cache.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(first, pa.int64()), pa.array(on, pa.list_(pa.int32()))], ["doc_id", "y", "first", "on"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(present, f"doc_id {id_type}, y int, first long, on array<int>")
    held = found.groupBy("doc_id").agg(F.min(F.struct("first", "y", "on")).alias("x")).select("doc_id", "x.y", "x.on").orderBy("doc_id").toArrow()  # at most most_labels rows
    y = np.array(held.column("y").to_pylist(), float)
    on = pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(c.cast(pa.list_(pa.int32())) for c in held.column("on").chunks)])
    del held
    machine = fit_machine(on, y, feature)
    del on
    give_back()
    return machine


def _spread(bucket: int) -> int:
    return bucket * 0x9E3779B1 & 0xFFFFFFFF


def _present(utf8: bytes, feature: dict[int, int] | range, cache: dict[str, tuple[int, ...]]) -> list[int]:
    got: set[int] = set()
    for w in words_of(utf8):
        hit = cache.get(w)
        if hit is None:
            hit = cache[w] = tuple(feature[b] for b in buckets_of(w) if b in feature)
        if hit:
            got.update(hit)
    return sorted(got)


def score_toxicity(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null and empty texts get the score of no features."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = held.value, {}
        for batch in slices(batches):
            out = [m.score(_present(x, m.feature, cache)) for x in batch.column("utf8").to_pylist()]
            if len(cache) > 150_000:
                cache.clear()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])
        del cache
        give_back()

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = with_utf8(docs, "doc_id").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "utf8")
    return rows.mapInArrow(score, f"doc_id {id_type}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean_documents(docs: DataFrame, machine: Machine, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below the threshold, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m, cache = held.value, {}
        for part in parts:
            yield pd.Series([m.score(_present(x.encode() if x is not None else b"", m.feature, cache)) for x in part], dtype="float64")
            if len(cache) > 150_000:
                cache.clear()
        del cache
        give_back()

    return docs.filter(score(F.col(text_col)) < threshold)
