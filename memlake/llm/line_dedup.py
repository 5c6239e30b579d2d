"""Fuzzy line deduplication by MinHash.

Lines (stripped of white space at their ends, blank ones left alone) get one-permutation MinHash signatures of
their 8-character shingles; bins that stay empty are filled from further permutations, so that two lines' bins
agree with the probability of their Jaccard similarity. Ten bands of four bins find at least 99.4 % of pairs at
0.8 and 99.99 % at 0.9. Bands that several lines share are buckets; equal buckets count once, and large ones are
taken in parts (see blocks). A task verifies a bucket's lines by exact Jaccard and emits a forest of its links,
never all pairs. Distributed union-find joins the links, and one line per component stays: the first by id and
line number. Lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import linked
from .components import components
from .shared import give_back, heavy_join, keep, slices, sorted_set, with_utf8

SIZE, BINS, ROWS = 8, 40, 4
_NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def line_key(line: bytes) -> int:
    """64-bit hash of a stripped line, signed."""
    return xxhash.xxh64_intdigest(line, 8) - (1 << 63)


def _shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lines' shingles, and how many each line has (a line shorter than a shingle has one)."""
    padded = [x if len(x) >= SIZE else x + "\0" * (SIZE - len(x)) for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    h, width = codes, 1
    while width < SIZE:
        h, base, width = h[:-width] * base + h[width:], base * base, 2 * width
    sizes = np.array([len(x) for x in padded])
    counts = sizes - SIZE + 1
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return _mix(h[at]), counts


def signatures(lines: list[str]) -> np.ndarray:
    """Rows of BINS values: the least hash in each bin under the first permutation where the bin isn't empty."""
    with np.errstate(over="ignore"):
        h, counts = _shingles(lines)
        out = np.full((len(lines), BINS), _NONE)
        first = np.cumsum(counts) - counts
        todo = np.arange(len(lines))
        for turn in range(5):
            n = counts[todo]
            if turn:
                at = np.repeat(first[todo] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                x = _mix(h[at] + np.uint64(turn * 0x632BE59BD9B4E019 & (2**64 - 1)))
            else:
                x = h
            cell = np.repeat(np.arange(len(todo)) * BINS, n) + ((x >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
            got = np.full(len(todo) * BINS, _NONE)
            np.minimum.at(got, cell, x)
            some = out[todo]
            out[todo] = np.where(some == _NONE, got.reshape(-1, BINS), some)
            todo = todo[(out[todo] == _NONE).any(1)]
            if not len(todo):
                return out
        for b in range(BINS):  # what is empty still: an own permutation for each bin, of all shingles
            left = todo[out[todo, b] == _NONE]
            if len(left):
                n = counts[left]
                begin = np.cumsum(n) - n
                at = np.repeat(first[left] - begin, n) + np.arange(n.sum())
                out[left, b] = np.minimum.reduceat(_mix(h[at] ^ np.uint64((b + 1) * 0xD1342543DE82EF95 & (2**64 - 1))), begin)
        return out


def bands_of(sigs: np.ndarray) -> np.ndarray:
    """BINS / ROWS band hashes a row, as signed 64-bit integers."""
    with np.errstate(over="ignore"):
        out = np.repeat(np.arange(1, BINS // ROWS + 1, dtype=np.uint64)[None, :], len(sigs), 0) * np.uint64(0x2545F4914F6CDD1D)
        grouped = sigs.reshape(len(sigs), BINS // ROWS, ROWS)
        for r in range(ROWS):
            out = _mix(out ^ grouped[:, :, r])
        return out.view(np.int64)


def _lines(utf8: bytes) -> list[bytes]:
    return [x.strip() for x in utf8.split(b"\n")]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in slices(batches, limit=512 << 10):
        keys, new = [], {}
        for utf8 in batch.column("utf8").to_pylist():
            lines = _lines(utf8)
            own = [line_key(x) if x else None for x in lines]
            keys.append(own)
            new |= {k: x for k, x in zip(own, lines, strict=True) if k is not None and k not in seen}
        if len(seen) > 200_000:
            seen.clear()
        seen.update(new)
        bands = bands_of(signatures([str(x, "utf-8", "replace") for x in new.values()])) if new else np.zeros((0, BINS // ROWS), np.int64)
        signed = pa.StructArray.from_arrays([pa.array(list(new), pa.int64()), pa.ListArray.from_arrays(np.arange(len(new) + 1, dtype=np.int32) * (BINS // ROWS), pa.array(bands.ravel()))], ["key", "bands"])
        ends = np.full(batch.num_rows + 1, len(new), np.int32)
        ends[0] = 0
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(ends), signed)], ["id", "mark", "keys", "signed"])
    del seen
    give_back()


def bitmap_of(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap with the places of a long column's values set: bits / 8 rows reach the driver at most."""
    at = F.col(column).bitwiseAND(bits - 1)
    words = df.select(at.alias("at")).groupBy(F.shiftright("at", 3).alias("at8")).agg(F.bit_or(F.expr("shiftleft(1, cast(at & 7 as int))")).alias("set")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    out[words.column("at8").to_numpy()] = words.column("set").to_numpy()
    return out


def line_sets(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each line's set of shingles as sorted small numbers, one set after another, and the sets' sizes."""
    with np.errstate(over="ignore"):
        h, counts = _shingles([str(x, "utf-8", "replace") for x in lines])
    kinds, number = np.unique(h, return_inverse=True)
    both = sorted_set(np.repeat(np.arange(len(lines)), counts) * len(kinds) + number)
    return both % len(kinds), np.bincount(both // len(kinds), minlength=len(lines))


def forests(group: np.ndarray, numbers: np.ndarray, start: np.ndarray, size: np.ndarray, least: float, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join, in each group, what its pairs with exact Jaccard of `least` or more join.

    Row r's set is numbers[start[r] : start[r] + size[r]], sorted; group: 0, 1, ... in order. In a round every
    group compares one row with those that no link has reached, breadth first from its first row on, all groups at
    once. Empty sets are like no other.
    """
    free, front = np.ones(len(group), bool), np.zeros(len(group), bool)
    base, out = int(numbers.max(initial=0)) + 1, []
    pivot = np.zeros(int(group[-1]) + 1 if len(group) else 0, np.int64)
    while True:
        busy = np.zeros(len(pivot), bool)
        busy[group[free]] = True
        at = np.flatnonzero((free | front) & busy[group])
        at = at[np.lexsort((~front[at], group[at]))]
        at = at[np.append(True, group[at][1:] != group[at][:-1])] if len(at) else at
        free[at] = front[at] = False
        pivot[group[at]] = at
        x = np.flatnonzero(free)
        if not len(x):
            break
        p = pivot[group[x]]
        fits = (np.minimum(size[p], size[x]) >= least * np.maximum(size[p], size[x])) & (size[x] > 0)
        x, p = x[fits], p[fits]
        cuts = np.flatnonzero(np.diff(np.cumsum(size[x]) // most)) + 1
        for x, p in zip(np.split(x, cuts), np.split(p, cuts), strict=True):
            if not len(x):
                continue
            of = p[np.append(True, p[1:] != p[:-1])]  # ascending, as groups are
            mine, theirs = (np.repeat(group[r] * base, size[r]) + numbers[np.repeat(start[r] - (np.cumsum(size[r]) - size[r]), size[r]) + np.arange(size[r].sum())] for r in (of, x))
            hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            both = np.add.reduceat(hit, np.cumsum(size[x]) - size[x], dtype=np.int64)
            near = both >= least * (size[p] + size[x] - both)
            out.append((p[near], x[near]))
            free[x[near]], front[x[near]] = False, True
    return tuple(np.concatenate([np.zeros(0, np.int64), *(o[k] for o in out)]) for k in (0, 1))


def similar_lines(docs: DataFrame, signed: DataFrame, text_col: str = "text", least: float = 0.8, block: int = 256, bitmap_bits: int = 1 << 25) -> DataFrame:
    """Links (a, b) between keys of different lines. signed: (key, bands) of lines, in any multiplicity."""
    rows = signed.select("key", F.explode("bands").alias("band"))
    # Bands of one line alone are the most; a count with map-side sums and a bitmap of fixed size leave the others.
    often = rows.groupBy("band").count().filter("count > 1").select("band")
    common = keep(often, "line-bands")
    held = docs.sparkSession.sparkContext.broadcast(bitmap_of(common, "band", bitmap_bits))

    def shared_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            lists = batch.column("bands")
            bands = lists.flatten().to_numpy()
            at = bands & (8 * len(bits) - 1)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            keys = np.repeat(batch.column("key").to_numpy(), BINS // ROWS)[hit]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(bands[hit])], ["key", "band"])

    member = keep(signed.mapInArrow(shared_bands, "key long, band long").distinct().join(common, "band", "left_semi"), "line-members")
    sets = member.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("near"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.shiftright(F.xxhash64("key", F.lit(1)), 20)).alias("s")).filter("n > 1")
    bucket = keep(sets.groupBy("n", "x", "s").agg(F.min("band").alias("grp"), F.min("near").alias("near")).select("grp", "n", "near"), "line-buckets")
    member = keep(heavy_join(member.select(F.col("band").alias("grp"), "key"), bucket.select("grp"), "grp", "left_semi", counts=bucket), "line-in-buckets")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(member, "key", bitmap_bits))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in slices(batches):
            new = {}
            for utf8 in batch.column("utf8").to_pylist():
                for x in _lines(utf8):
                    k = line_key(x) if x else 0
                    at = k & (8 * len(bits) - 1)
                    if x and bits[at >> 3] >> (at & 7) & 1 and k not in seen:
                        new[k] = x
            if len(seen) > 200_000:
                seen.clear()
            seen.update(new)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(list(new.values()), pa.binary())], ["key", "line"])
        del seen
        give_back()

    line = with_utf8(docs, text=text_col).mapInArrow(texts, "key long, line binary").join(member.select("key").distinct(), "key", "left_semi")
    line = keep(line.groupBy("key").agg(F.first("line").alias("line")), "line-texts")

    def compare(batch: pa.RecordBatch, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, first, of = np.unique(batch.column("key").to_numpy(), return_index=True, return_inverse=True)
        numbers, size = line_sets(batch.column("line").take(pa.array(first)).to_pylist())
        return forests(group, numbers, (np.cumsum(size) - size)[of], size[of], least)

    return linked(member, bucket, line, "line", compare, 1 << 20, block)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, counts: bool = False, block: int = 256) -> DataFrame:
    """docs with the lines that repeat an earlier line, or nearly, taken out of text_col; all columns stay.

    Earlier is by id (null first), then by line number. Blank lines stay; a text whose lines all go becomes
    empty, and a null text stays null. Rows that share an id share its places, so lines alike at one place are
    one line. counts: adds n_lines and n_kept, which docs must not have. block: lines compared at once (see blocks).
    No rows: an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    # Rows without an id share places but not a group below: a mark of the text tells them apart.
    mark = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(0).alias("mark")
    table = keep(with_utf8(docs, F.col(id_col).alias("id"), mark, text=text_col).mapInArrow(_sign, f"id {id_type}, mark long, keys array<long>, signed array<struct<key:long,bands:array<long>>>"), "lines-signed")
    signed = table.select(F.explode("signed").alias("x")).select("x.key", "x.bands")
    lines = table.select("id", "mark", F.posexplode("keys").alias("line", "key")).filter("key IS NOT NULL")
    same = components(similar_lines(docs, signed, text_col, least, block), "a", "b").withColumnRenamed("node", "key")
    firsts = lines.groupBy("key").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n"))
    firsts = keep(firsts.join(same, "key", "left").filter("n > 1 OR component IS NOT NULL").select("key", "first", "n", F.coalesce("component", "key").alias("root")), "line-firsts")
    roots = keep(firsts.groupBy("root").agg(F.min("first").alias("stays"), F.count("*").alias("n")), "line-roots")
    stays = keep(heavy_join(firsts.select("key", "root", F.col("n").alias("rows")), roots.select("root", "stays"), "root", counts=roots).select("key", "stays", F.col("rows").alias("n")), "line-stays")
    gone = heavy_join(lines, stays.drop("n"), "key", counts=stays).filter(~F.struct("id", "line").eqNullSafe(F.col("stays")))
    gone = keep(gone.groupBy("id", "mark").agg(F.collect_set(F.struct("line", "key")).alias("gone")), "lines-gone")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    whole = docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("id"), mark, F.col(text_col).alias("text"))
    gone = gone.withColumnsRenamed({"id": "of", "mark": "of_mark"})
    joined = whole.join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left").select("row", "text", "gone")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held, kept = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                raw = text.encode().split(b"\n") if text is not None else []
                left = raw
                if drop:
                    going = {(x["line"], x["key"]) for x in drop}
                    places = {i for i, _ in going}
                    left = [x for i, x in enumerate(raw) if i not in places or (i, line_key(x.strip()) if x.strip() else None) not in going]
                out.append(None if text is None else text if left is raw else b"\n".join(left).decode())
                held.append(len(raw))
                kept.append(len(left))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), pa.array(held, pa.int64()), pa.array(kept, pa.int64())], ["row", "text", "n_lines", "n_kept"])

    schema = T.StructType([T.StructField("row", whole.schema["row"].dataType), T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_kept", T.LongType())])
    done = joined.mapInArrow(rewrite, schema)
    cols = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return done.select(*cols, *["n_lines", "n_kept"] * counts)


def deduped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text without repeated lines, n_lines, n_kept of every document."""
    return line_dedup(docs.select("doc_id", "text"), counts=True)
