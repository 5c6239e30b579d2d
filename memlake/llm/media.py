"""Media columns stored as content-defined chunks.

A payload is cut where a rolling gear hash over the last 32 bytes has its top bits zero. Its stored form is its
manifest, the ordered list of chunk digests and sizes, and the chunks' bytes. Digests are counted by Spark. A chunk
that no other payload has lies in its payload's row of the store; of a common one, Spark joins name an owner, which
puts its bytes into the pool of common chunks, once. Reading joins chunk lists with the pool, puts the chunks
together in the list's order and verifies the digests of chunks and payload. A bitmap of the common digests, of fixed
size, tells a map task which payloads hold none: those are stored without being shuffled. (A full bitmap sends all
payloads the other way, which is slower and no less right.)
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import heavy_join, keep, slices, with_utf8

#: One 32-bit value per byte, from a seeded generator.
GEAR = np.random.default_rng(10).integers(0, 1 << 32, 256, dtype=np.uint32)
LEAST, MOST, TOP_BITS = 512, 8192, 10
UNIT, PAD = 576, b"\xff"
_HEAD = b"CDC1"
#: Payloads are compressed harder than other tables: they are most of what the store writes.
LEVEL = 9


def pad(utf8: bytes) -> bytes:
    """The bytes followed by 255s up to a positive multiple of 576."""
    return utf8 + PAD * (-len(utf8) % UNIT if utf8 else UNIT)


def chunk_ends(payloads: list[bytes]) -> list[list[int]]:
    """Where each payload's chunks end. A cut depends on the 32 bytes before it, and no chunk is shorter than those."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        more = h[k:] + (h[:-k] << np.uint32(k))
        h = np.concatenate([h[:k], more])
    marks = np.flatnonzero(h >> np.uint32(32 - TOP_BITS) == 0) + 1
    out, at = [], 0
    for p in payloads:
        ends, last = [], 0
        lo, hi = np.searchsorted(marks, [at + LEAST, at + len(p)])
        for m in [*(marks[lo:hi] - at).tolist(), len(p)]:
            while m - last > MOST:
                last += MOST
                ends.append(last)
            if m - last >= LEAST or m == len(p):
                ends.append(m)
                last = m
        if ends[-1:] == ends[-2:-1]:
            ends.pop()
        out.append(ends)
        at += len(p)
    return out


def manifest(payload: bytes, ends: list[int]) -> bytes:
    """Header, payload length, number of chunks, then a 16-byte digest and a size for each."""
    at, rows = 0, []
    for end in ends:
        rows.append(hashlib.blake2b(payload[at:end], digest_size=16).digest() + struct.pack("<I", end - at))
        at = end
    return _HEAD + struct.pack("<QI", len(payload), len(ends)) + b"".join(rows)


def parts_of(listed: bytes) -> list[tuple[bytes, int]]:
    """(digest, size) of each chunk."""
    body = listed[len(_HEAD) + 12 :]
    return [(body[i : i + 16], struct.unpack_from("<I", body, i + 16)[0]) for i in range(0, len(body), 20)]


def features(payload: bytes) -> str:
    """Mean, spread, entropy of the byte histogram and the share of rises from one sample to the next."""
    x = np.frombuffer(payload, np.uint8)
    n = np.bincount(x, minlength=256) / len(x)
    entropy = -float((n[n > 0] * np.log2(n[n > 0])).sum())
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={entropy:.4f};rises={float((x[1:] > x[:-1]).mean()):.4f}"


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[list[int]]]]:
    for batch in slices(batches):
        held = [pad(x) for x in batch.column("utf8").to_pylist()]
        yield batch, held, chunk_ends(held)


def _binary(x: list) -> pa.Array:
    return pa.array(x, pa.binary())


def _list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, held, ends in _payloads(batches):
        digests = [[d for d, _ in parts_of(manifest(p, e))] for p, e in zip(held, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in batch.column("utf8").to_pylist()], pa.int64()), _binary([hashlib.sha256(p).digest() for p in held]), pa.array(digests, pa.list_(pa.binary()))], ["id", "n_bytes", "sha", "digests"])


def _read_back(sha: bytes, listed: bytes, payload: bytes) -> list:
    """A stored payload's values, after its digest and those of its chunks are verified.

    media_bytes and media_sha256 are of the manifest followed by the chunks in its order.
    """
    at = 0
    for digest, size in parts_of(listed):
        if hashlib.blake2b(payload[at : at + size], digest_size=16).digest() != digest:
            raise ValueError("a stored chunk does not match its digest")
        at += size
    if hashlib.sha256(payload).digest() != sha:
        raise ValueError("a stored payload does not match its digest")
    return [sha, len(payload), zlib.crc32(payload[-32:]), len(listed) + len(payload), hashlib.sha256(listed + payload).hexdigest(), features(payload)]


READ = "sha binary, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _read_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])


class MediaStore:
    """Writes the payloads of docs' texts to chunk tables in the shared folder, and reads them back.

    rows: (id, n_bytes, sha) of each row of docs. A null text is an empty payload of 576 padding bytes. Texts
    that are equal share a stored payload; repeated rows keep a row each. Other columns are ignored.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bitmap_bits: int = 1 << 25):
        texts = with_utf8(docs, F.col(id_col).alias("id"), text=text_col)
        id_type = docs.schema[id_col].dataType
        schema = T.StructType([T.StructField("id", id_type), T.StructField("n_bytes", T.LongType()), T.StructField("sha", T.BinaryType()), T.StructField("digests", T.ArrayType(T.BinaryType()))])
        self.rows = keep(texts.mapInArrow(_list_chunks, schema), "media-rows")
        often = self.rows.select(F.explode("digests").alias("digest")).groupBy("digest").count().filter("count > 1")
        place = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long").bitwiseAND(bitmap_bits - 1)
        words = often.select(place.alias("at")).groupBy(F.shiftright("at", 3).alias("at8")).agg(F.bit_or(F.expr("shiftleft(1, cast(at & 7 as int))")).alias("set")).toArrow()  # bitmap_bits / 8 rows at most
        bitmap = np.zeros(bitmap_bits // 8, np.uint8)
        bitmap[words.column("at8").to_numpy()] = words.column("set").to_numpy()
        held = docs.sparkSession.sparkContext.broadcast(bitmap)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squeeze, bits = zstandard.ZstdCompressor(level=LEVEL).compress, held.value
            for _, payloads, ends in _payloads(batches):
                out: list[list] = [[], [], [], []]
                for p, e in zip(payloads, ends, strict=True):
                    listed = manifest(p, e)
                    at = [int.from_bytes(d[:4], "big") & (len(bits) * 8 - 1) for d, _ in parts_of(listed)]
                    shares = any(bits[k >> 3] >> (k & 7) & 1 for k in at)
                    chunks = None if shares else [p[i:j] for i, j in zip([0, *e], e, strict=False)]
                    for col, x in zip(out, (hashlib.sha256(p).digest(), listed, chunks, squeeze(p) if shares else None), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([_binary(out[0]), _binary(out[1]), pa.array(out[2], pa.list_(pa.binary())), _binary(out[3])], ["sha", "manifest", "chunks", "whole"])

        packed = keep(texts.select("utf8").mapInArrow(pack, "sha binary, manifest binary, chunks array<binary>, whole binary"), "media-packed", LEVEL)
        self.alone = packed.filter("whole IS NULL").select("sha", "manifest", "chunks")
        self._store_shared(packed.filter("whole IS NOT NULL"))

    def _store_shared(self, packed: DataFrame) -> None:
        one = keep(packed.groupBy("sha").agg(F.first("manifest").alias("manifest"), F.first("whole").alias("whole")), "media-distinct")
        body = F.expr("substring(hex(manifest), 33)")
        listed = F.transform(F.sequence(F.lit(0), F.expr("cast(length(manifest) - 16 as int) div 20 - 1")), lambda i: F.unhex(body.substr(i * 40 + 1, F.lit(32))))
        entries = keep(one.select("sha", F.posexplode(listed).alias("ord", "digest")), "media-entries")
        owner = keep(entries.groupBy("digest").agg(F.min(F.struct("sha", "ord")).alias("owner"), F.count("*").alias("n")), "media-owners")
        # A digest's owner finds its own entry; an entry that isn't its digest's owner is one of several.
        owns = owner.select("digest", "owner.sha", "owner.ord", F.when(F.col("n") > 1, 1).otherwise(0).alias("role"))
        roles = entries.join(owns, ["digest", "sha", "ord"], "left").select("sha", F.struct("ord", F.coalesce("role", F.lit(2)).alias("role")).alias("x"))
        roles = roles.groupBy("sha").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["role"]).alias("roles"))

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squeeze, loose = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
            for batch in slices(batches, "whole", 1 << 20):
                out: list[list] = [[], [], [], [], []]
                for sha, listed, whole, role in zip(*(batch.column(k).to_pylist() for k in ("sha", "manifest", "whole", "roles")), strict=True):
                    payload, at, mine, common = loose(whole), 0, [], []
                    for (digest, size), r in zip(parts_of(listed), role, strict=True):
                        if r == 0:
                            mine.append(payload[at : at + size])
                        elif r == 1:
                            common.append({"digest": digest, "bytes": squeeze(payload[at : at + size])})
                        at += size
                    for col, x in zip(out, (sha, listed, mine, role, common), strict=True):
                        col.append(x)
                kinds = [pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["sha", "manifest", "chunks", "roles", "common"])

        self.sharing = keep(one.join(roles, "sha").mapInArrow(store, "sha binary, manifest binary, chunks array<binary>, roles array<int>, common array<struct<digest:binary,bytes:binary>>"), "media-store", LEVEL)
        self.entries, self.owner = entries, owner

    def read(self) -> DataFrame:
        """Each stored payload, rebuilt from the stored bytes and verified: READ's columns."""

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _read_batch([_read_back(s, m, b"".join(c)) for s, m, c in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loose = zstandard.ZstdDecompressor().decompress
            for batch in batches:
                rows = []
                for sha, listed, own, role, got in zip(*(batch.column(k).to_pylist() for k in ("sha", "manifest", "chunks", "roles", "got")), strict=True):
                    mine, common = iter(own), {x["ord"]: x["bytes"] for x in got or ()}
                    rows.append(_read_back(sha, listed, b"".join(loose(common[i]) if r else next(mine) for i, r in enumerate(role))))
                yield _read_batch(rows)

        pool = keep(self.sharing.select(F.explode("common").alias("x")).select("x.digest", "x.bytes"), "media-pool")
        # Of chunks that many payloads share, 1,024 of 8 KiB at most are sent to all tasks; see heavy_join.
        got = heavy_join(self.entries, pool, "digest", counts=self.owner).groupBy("sha").agg(F.collect_list(F.struct("ord", "bytes")).alias("got"))
        rebuilt = self.sharing.drop("common").join(got, "sha", "left").mapInArrow(joined, READ)
        return keep(self.alone.mapInArrow(whole, READ).unionByName(rebuilt), "media-read")


def media_report(docs: DataFrame) -> DataFrame:
    """Contract columns: the stored media of every document, read back."""
    store = MediaStore(docs)
    rows = heavy_join(store.rows.select(F.col("id").alias("doc_id"), "n_bytes", "sha"), store.read(), "sha")
    return rows.select("doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("sha")).alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature")
