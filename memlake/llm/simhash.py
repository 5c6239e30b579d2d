"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are put into cells by the population counts of their sub-words; two fingerprints differ in
at least as many bits as these counts do in sum, so pairs of cells whose counts differ beyond the radius are
skipped. Cells are cut into tiles of bounded size which meet in blocks, and a task compares two tiles with numpy: exclusive or, bit
counts, and a union-find that emits a forest of the links found, never all pairs of a group. All pairs within the
radius are covered at any size; the work is quadratic in distinct fingerprints, cut by the skipped tile pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import linked
from .components import components
from .line_dedup import bitmap_of, forests
from .shared import WORD, give_back, heavy_join, keep, slices, sorted_set, with_utf8


def _shingle_hashes(utf8: bytes, size: int, seed: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in blocks: `size` words with spaces between, or all words if there are fewer."""
    line = b" ".join(WORD.findall(utf8.lower()))
    if not line:
        return
    space = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    if len(space) < size:
        yield np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
        return
    starts, ends = np.append(0, space + 1)[: len(space) + 2 - size], np.append(space, len(line))[size - 1 :]
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 14):
        pairs = zip(starts[at : at + (1 << 14)].tolist(), ends[at : at + (1 << 14)].tolist(), strict=True)
        yield np.array([hashed(line[a:b], seed) for a, b in pairs], np.uint64)


def _mix(h: np.ndarray, word: int) -> np.ndarray:
    """Further independent 64-bit hashes; word 0 is the hash itself."""
    if not word:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15 * word & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(utf8: bytes, size: int = 3, seed: int = 42, words: int = 1, distinct: bool = False) -> bytes:
    """64 * words bits: a bit is 1 if over half of the shingles' hashes have it. Big-endian; no word: all zero.

    distinct: of the set of shingles, with the set's size in four further bytes.
    """
    ones, n = np.zeros((words, 64), np.int64), 0
    blocks = _shingle_hashes(utf8, size, seed)
    for h in [sorted_set(np.concatenate(held))] if distinct and (held := list(blocks)) else () if distinct else blocks:
        n += len(h)
        for w in range(words):
            for at in range(0, len(h), 1 << 15):
                bits = np.unpackbits(_mix(h[at : at + (1 << 15)], w).astype(">u8").view(np.uint8)).reshape(-1, 64)
                ones[w] += bits.sum(0, dtype=np.uint32)
    return np.packbits(2 * ones > n).tobytes() + (n.to_bytes(4, "big") if distinct else b"")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, seed: int = 42, words: int = 1, distinct: bool = False) -> DataFrame:
    """id_col and fp (see fingerprint) of each row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(x, size, seed, words, distinct) for x in batch.column("utf8").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], [id_col, "fp"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.BinaryType())])
    return with_utf8(docs, id_col, text=text_col).mapInArrow(run, schema)


def _forest(a: np.ndarray, b: np.ndarray, radius: int, first: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of links that join what the tiles' links join. a, b: rows of 64-bit words."""
    n = len(a)
    label = np.arange(n + len(b))
    if same:
        label[n:] = label[:n]
    out: list[tuple[int, int]] = []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, n, step):
        near = np.bitwise_count(a[at : at + step, None, 0] ^ b[None, :, 0]) <= first
        i, j = np.nonzero(near)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        if a.shape[1] > 1 and len(i):
            close = np.concatenate([np.bitwise_count(a[i[k : k + 65536]] ^ b[j[k : k + 65536]]).sum(1) <= radius for k in range(0, len(i), 65536)])
            i, j = i[close], j[close]
        while len(i):
            x, y = label[i], label[n + j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            if not len(i):
                break
            low, high = np.minimum(x, y), np.maximum(x, y)
            # Each label hangs itself on a lower one once; a few passes join everything that the block links.
            high, once = np.unique(high, return_index=True)
            out += zip(i[once].tolist(), j[once].tolist(), strict=True)
            to = np.arange(len(label))
            to[high] = low[once]
            while (to != to[to]).any():
                to = to[to]
            label = to[label]
            if same:
                label[n:] = label[:n]
    return np.array([x for x, _ in out], np.int64), np.array([y for _, y in out], np.int64)


def near_links(fps: DataFrame, radius: int, words: int = 1, first: int | None = None, parts: int = 4, tile: int = 1024, block: int = 8, least: float | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all pairs within `radius` bits.

    fps: distinct non-null `fp`. first: most bits by which linked fingerprints may differ in their first word
    (default: radius). parts: sub-words of the first word whose population counts make a cell, (64/parts + 1)^parts
    cells at most; with one part, counts are taken in steps of first + 1. least: fingerprints end in their set's
    size, and pairs of sizes too far apart for that Jaccard are skipped: sizes make cells by their logarithm.
    Tiles of two cells meet in blocks: a key holds `block` tiles of each side, or more so that no tile is copied
    over 32 times for a neighbouring cell. So the table of cells has a bound that does not depend on the data.
    """
    bits, first = 64 // parts, min(radius, 64) if first is None else first
    step = first + 1 if parts == 1 else 1
    # A sub-word's count and those of its neighbours within the radius decide which cells meet.
    head = F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("long")
    counts = [F.bit_count(F.shiftrightunsigned(head, bits * k).bitwiseAND((1 << bits) - 1 if bits < 64 else -1)) for k in range(parts)]
    cell = [f"p{k}" for k in range(parts)]
    rows = fps.select("fp", *[F.floor(c / step).cast("int").alias(n) for c, n in zip(counts, cell, strict=True)])
    near = [d for d in itertools.product(range(-first, first + 1), repeat=parts) if sum(map(abs, d)) <= first] if step == 1 else [(-1,), (0,), (1,)]
    if least is not None:
        finer = 2
        size = F.conv(F.hex(F.substring("fp", 8 * words + 1, 4)), 16, 10).cast("double")
        rows = rows.withColumn("s", F.floor(F.log(F.greatest(size, F.lit(1.0))) * (finer / math.log(1 / least * (1 + 1e-9)))).cast("int"))
        cell, near = [*cell, "s"], [(*d, e) for d in near for e in range(-finer, finer + 1)]
    reach = [d for d in near if d >= (0,) * len(cell)]
    cells = keep(rows.groupBy(*cell).agg(F.ceil(F.count("*") / tile).alias("tiles")), "cells").withColumn("wide", F.greatest(F.lit(block), F.ceil(F.col("tiles") / 32)))
    salted = rows.join(F.broadcast(cells), cell).withColumn("part", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    blob = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("fp")), lambda x: F.hex(x)), ""))
    tiles = keep(salted.groupBy(*cell, "part").agg(blob.alias("blob"), F.floor(F.col("part") / F.first("wide")).cast("int").alias("run")), "tiles")
    steps = F.explode(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(cell, d, strict=True)]) for d in reach])).alias("d")
    shifted = [(F.col(c) + F.col(f"d.{c}")).cast("int").alias(c) for c in cell]
    runs = F.ceil(F.col("tiles") / F.col("wide")).cast("int")
    other = cells.select("*", steps).select(*shifted, runs.alias("others")).groupBy(*cell).agg(F.max("others").alias("others"))
    sizes = keep(cells.select(*cell, runs.alias("runs")).join(other, cell), "cell-runs")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = tiles.join(F.broadcast(sizes), cell).select(*cell, F.col("run").alias("i"), upto("others").alias("j"), F.col("part").alias("a_part"), F.col("blob").alias("a_blob"))
    same = F.expr(" AND ".join(f"d.{c} = 0" for c in cell))
    right = tiles.select("*", steps).select(*shifted, same.alias("same"), F.col("run").alias("j"), F.col("part").alias("b_part"), F.col("blob").alias("b_blob"))
    right = right.join(F.broadcast(sizes), cell).select("*", upto("runs").alias("i")).filter("NOT same OR i <= j")
    pairs = left.join(right, [*cell, "i", "j"]).filter("NOT same OR a_part <= b_part").select("a_blob", "b_blob", (F.col("same") & (F.col("a_part") == F.col("b_part"))).alias("self"))
    kind = np.dtype([("bits", ">u8", (words,)), ("size", ">u4", (0 if least is None else 1,))])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some: list[list[bytes]] = [[], []]
            for x, y, same in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                a, b = (np.frombuffer(z, kind)["bits"].astype(np.uint64) for z in (x, y))
                w = kind.itemsize
                for out, blob, at in zip(some, (x, y), _forest(a, b, radius, first, same), strict=True):
                    out += [blob[w * k : w * k + w] for k in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in some], ["a", "b"])

    return pairs.mapInArrow(compare, "a binary, b binary")


def near_duplicates(prints: DataFrame, links: Callable[[DataFrame], DataFrame], id_col: str = "doc_id") -> DataFrame:
    """prints (id_col, fp) with component_id, the least id that links reach from the row's fingerprint.

    links: from classes (fp, least: a class's least id) to links (a, b) between fingerprints. Rows with one fingerprint are one class, which only its least id and its fingerprint stand for. Null ids
    are below no other id: a class without any other has a null component_id.
    """
    classes = keep(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "classes")
    joined = components(links(classes), "a", "b")
    roots = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = keep(roots, "roots")
    ids = keep(roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "ids")
    by_print = keep(heavy_join(roots, ids.drop("n"), "root", counts=ids).select("fp", "component_id"), "by-print")
    return heavy_join(prints, by_print, "fp", counts=classes).select(id_col, "fp", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, size: int = 3) -> DataFrame:
    """id_col, fingerprint (16 hex digits) and component_id of every row; other columns are ignored.

    Null, empty and white texts have the zero fingerprint, linked like any other. Repeated rows and ties share
    a class. No rows: an empty result.
    """
    prints = keep(fingerprints(docs, id_col, text_col, size), "prints")
    return near_duplicates(prints, lambda c: near_links(c.select("fp"), radius), id_col).select(id_col, F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def verified_links(docs: DataFrame, classes: DataFrame, candidates: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", size: int = 5, block: int = 256, bitmap_bits: int = 1 << 25) -> DataFrame:
    """Links (a, b) between classes' fingerprints whose texts' shingle sets have a Jaccard of `least` or more.

    candidates: links that join at least those pairs. Texts that they join meet (see blocks); a task compares their
    shingles (as 64-bit hashes) and emits a forest.
    """
    group = components(candidates, "a", "b").withColumnRenamed("node", "key")
    member = keep(group.select(F.col("component").alias("grp"), "key"), "near-members")
    sizes = keep(member.groupBy("grp").agg(F.count("*").alias("n")).withColumn("near", F.col("grp")), "near-sizes")
    asked = keep(classes.join(member.select(F.col("key").alias("fp")), "fp", "left_semi").select("fp", "least"), "near-asked")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(asked.select(F.xxhash64("least").alias("at")), "at", bitmap_bits))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for batch in slices(batches):
            at = batch.column("at").to_numpy() & (8 * len(held) - 1)
            batch = batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            found = [sorted_set(np.concatenate([np.zeros(0, np.uint64), *_shingle_hashes(x, size, 42)])).tobytes() for x in batch.column("utf8").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("least"), pa.array(found, pa.binary())], ["least", "shingles"])
        give_back()

    id_type = docs.schema[id_col].dataType.simpleString()
    marked = with_utf8(docs, F.col(id_col).alias("least"), text=text_col).select("least", F.xxhash64("least").alias("at"), "utf8")
    # Rows that share an id are one document: any of its texts stands for it.
    texts = marked.mapInArrow(sets, f"least {id_type}, shingles binary").join(asked, "least").groupBy("fp").agg(F.min("shingles").alias("shingles"))
    texts = keep(texts.select(F.col("fp").alias("key"), "shingles"), "near-sets")

    def compare(batch: pa.RecordBatch, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, first, of = np.unique(batch.column("key").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        held = batch.column("shingles").take(pa.array(first))
        length = pa.compute.binary_length(held).to_numpy().astype(np.int64) // 8
        numbers = np.unique(np.frombuffer(b"".join(held.to_pylist()), np.uint64), return_inverse=True)[1]
        return forests(group, numbers, (np.cumsum(length) - length)[of], length[of], least)

    return linked(member, sizes, texts, "shingles", compare, 4 << 20, block)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, least: float = 0.8, words: int = 4, radius: int = 72, first: int = 22, block: int = 256) -> DataFrame:
    """id_col and component_id of every row: texts whose sets of `size`-word shingles have a Jaccard of `least`.

    Tiled comparison of fingerprints of the sets finds candidates, exact Jaccard verifies them. Of 256 bits 72 may
    differ, and 22 in the first word; pairs at 0.8 differ in 32 to 48 bits, with a spread of 6, so that over 99.8 %
    of them are candidates (4 shingles of 5 are the worst case). Texts without words are alike. Rows that share an
    id are one document.
    """
    prints = keep(fingerprints(docs, id_col, text_col, size, words=words, distinct=True), "prints")

    def links(classes: DataFrame) -> DataFrame:
        near = near_links(classes.select("fp"), radius, words, first, parts=1, tile=4096, block=4, least=least)
        return verified_links(docs, classes, near, least, id_col, text_col, size, block)

    return near_duplicates(prints, links, id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each near-duplicate group, the one with the least id. Null ids all stay."""
    groups = near_dedup(docs, id_col, text_col, **how)
    stay = groups.filter(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))
    one = Window.partitionBy("id").orderBy("mark")
    kept = whole.filter("id IS NOT NULL").join(stay.withColumnRenamed(id_col, "id"), "id", "left_semi").withColumn("nth", F.row_number().over(one)).filter("nth = 1")
    return kept.select("row").unionByName(whole.filter("id IS NULL").select("row")).select("row.*")
