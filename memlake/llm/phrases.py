"""Phrases of two and three words, counted in a HAT-trie and scored by their weakest cut.

Each task holds a shallow trie over ids of its own words. Its hash containers are hybrid at first, shared by the
phrases of neighbouring first words; one that holds too many bursts between two of these, and a pure one, with a
single first word, between two second words. When a task's trie has too many entries, its largest containers leave it
whole, as a sorted run of (phrase, count) rows. A run's rows go to the partition of their prefix, where runs are merged
in order and counts added. The prefix is the first word, or the first two where the first is so frequent that its
phrases would fill a partition.

Phrases are counted by length. A phrase that occurs `least` times is made of shorter ones that do, so bitmaps of
fixed size keep others out of the next trie; a full bitmap lets everything through, and the counts decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import bitmap_of
from .shared import give_back, heavy_join, keep, slices, small_batches

WORDS = 3
_BITS = 21
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_PLAIN = bytes(range(256)).lower().translate(bytes.maketrans(_ENDS + b"\t", b"\n" * len(_ENDS) + b" "))
_RUN = pa.schema([("lang", pa.string()), ("prefix", pa.int64()), ("phrase", pa.binary()), ("n", pa.int64())])


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\n" + word)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of word pairs from those of their words (unsigned)."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def has_bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class _Ids(dict):
    """Ids of one language's words, given as they come: 0 ends a piece, or is a word that a bitmap rules out; -1 is nothing."""

    def __init__(self, lang: bytes, words: Words) -> None:
        super().__init__({b"": -1, b"\n": 0})
        self.lang, self.words = lang, words

    def __missing__(self, word: bytes) -> int:
        self[word] = new = self.words.add(self.lang, word)
        return new


class Words:
    """The words of a task: id, language, bytes, hash. An id belongs to one language. frequent: a bitmap of the words that get one."""

    def __init__(self, frequent: bytes | None = None) -> None:
        self.langs, self.words, self.hashes, self.size = [b""], [b""], [0], 0
        self.by_lang: dict[bytes, _Ids] = {}
        self.frequent, self._hash = frequent, np.zeros(1, np.uint64)

    def array(self) -> np.ndarray:
        """Hashes by id."""
        if len(self._hash) < len(self.hashes):
            self._hash = np.append(self._hash, np.array(self.hashes[len(self._hash) :], np.uint64))
        return self._hash

    def add(self, lang: bytes, word: bytes) -> int:
        self.size += len(word) + 200
        h = word_hash(lang, word)
        if self.frequent is not None:
            at = h & (8 * len(self.frequent) - 1)
            if not self.frequent[at >> 3] >> (at & 7) & 1:
                return 0
        self.langs.append(lang)
        self.words.append(word)
        self.hashes.append(h)
        return len(self.words) - 1

    def ids(self, lang: bytes, text: bytes) -> np.ndarray:
        """The ids of text's words in order, 0 between pieces. text: lower case, only spaces and line feeds as white space."""
        held = self.by_lang.get(lang)
        if held is None:
            held = self.by_lang[lang] = _Ids(lang, self)
        text = text.replace(b"\n", b" \n ") + b" "
        ends = np.append(0, np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1)
        parts = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text)]).dictionary_encode()
        distinct = parts.dictionary.buffers()[2].to_pybytes().split(b" ")[: len(parts.dictionary)]  # each ends with its space
        known = np.fromiter(map(held.__getitem__, distinct), np.int64, len(distinct))
        out = known[parts.indices.to_numpy()]
        return out[out >= 0]


class HatTrie:
    """Counts of phrases, packed as _BITS bits a word, in hash containers (dict: packed phrase to count).

    starts: the first place of each container, a prefix of one or two words: a sorted node whose neighbouring words
    share a container until it bursts. burst: entries above which a container does. most: entries of the trie above
    which it is `full`.
    """

    def __init__(self, words: int, burst: int = 4096, most: int = 600_000) -> None:
        self.words, self.burst, self.most, self.size = words, burst, most, 0
        self.starts, self.containers = np.zeros(1, np.int64), [{}]

    @property
    def full(self) -> bool:
        return self.size > self.most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """keys: distinct, in order."""
        at = np.searchsorted(self.starts, keys, "right") - 1
        cuts = np.flatnonzero(np.append(True, at[1:] != at[:-1])).tolist()
        large = []
        for i, a, b in zip(at[cuts].tolist(), cuts, cuts[1:] + [len(keys)]):
            held = self.containers[i]
            before, get = len(held), held.get
            for k, n in zip(keys[a:b].tolist(), counts[a:b].tolist()):
                held[k] = get(k, 0) + n
            self.size += len(held) - before
            if len(held) > self.burst:
                large.append(i)
        if large:
            parts = {i: self._parts(self.containers[i]) for i in large}
            starts = [[x for x, _ in parts[i]] if i in parts else [x] for i, x in enumerate(self.starts.tolist())]
            for i in parts:
                starts[i][0] = int(self.starts[i])
            self.containers = [c for i, held in enumerate(self.containers) for c in ([c for _, c in parts[i]] if i in parts else [held])]
            self.starts = np.array([x for xs in starts for x in xs], np.int64)

    def _parts(self, held: dict) -> list[tuple[int, dict]]:
        """A container that bursts, as containers with their starts: cut between first words, or second ones where all have one first word."""
        keys = np.sort(np.fromiter(held, np.int64, len(held)))
        cuts, half = [0], max(1, self.burst // 2)
        for at in range(half, len(keys), half):
            for depth in range(1, self.words):  # the last start of a prefix before `at`, of the shortest that begins after the last cut
                low = _BITS * (self.words - depth)
                start = int(np.searchsorted(keys, keys[at] >> low << low))
                if start > cuts[-1]:
                    cuts.append(start)
                    break
        return [(int(keys[a]), {k: held[k] for k in keys[a:b].tolist()}) for a, b in zip(cuts, [*cuts[1:], len(keys)])]

    def spill(self, share: float = 0.5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases and counts of the largest containers, which leave the trie whole, until `share` of its entries have left."""
        left = self.size * (1 - share)
        keys, counts = [], []
        for i in sorted(range(len(self.containers)), key=lambda i: -len(self.containers[i])):
            if self.size <= left:
                break
            held, self.containers[i] = self.containers[i], {}
            self.size -= len(held)
            keys.append(np.fromiter(held, np.int64, len(held)))
            counts.append(np.fromiter(held.values(), np.int64, len(held)))
        yield from zip(keys, counts)


#: The words of this worker's last task, which its next one over the same bitmap goes on with.
_WORDS: dict[tuple[int, int] | None, Words] = {}


def _words(frequent: bytes | None) -> Words:
    key = None if frequent is None else (len(frequent), hash(frequent))
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words(frequent)
    return _WORDS[key]


def _run(parts: list[tuple[np.ndarray, np.ndarray]], words: Words, length: int, hot: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """The spilled subtrees as one run in order of phrase and language."""
    if not parts:
        return
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if not len(keys):
        return
    each = [keys >> (_BITS * (length - 1 - j)) & ((1 << _BITS) - 1) for j in range(length)]
    used, back = np.unique(np.stack(each), return_inverse=True)
    back = back.reshape(length, -1)
    text = pa.array([words.words[i] for i in used], pa.binary())
    langs = pa.array([str(words.langs[i], "utf-8") for i in used], pa.string())
    order = pc.sort_indices(pa.table({"lang": langs, "word": text}), sort_keys=[("word", "ascending"), ("lang", "ascending")]).to_numpy()
    rank = np.empty(len(used), np.int64)
    rank[order] = np.arange(len(used))
    at = np.lexsort([rank[back[j]] for j in reversed(range(length))])
    hashes = np.array([words.hashes[i] for i in used], np.uint64)
    prefix = hashes[back[0]]
    if length > 1 and hot:
        deep = np.isin(hashes, np.fromiter(hot, np.uint64, len(hot)))[back[0]]
        prefix = np.where(deep, pair_hash(prefix, hashes[back[1]]), prefix)
    for a in range(0, len(at), 1 << 16):
        some = at[a : a + (1 << 16)]
        takes = [text.take(pa.array(back[j][some])) for j in range(length)]
        phrase = pc.binary_join_element_wise(*takes, pa.scalar(b" ", pa.binary())) if length > 1 else takes[0]
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(back[0][some])), pa.array(prefix[some].view(np.int64)), phrase, pa.array(counts[some])], schema=_RUN)


def _grams(ids: np.ndarray, length: int, words: Words, pairs: np.ndarray | None) -> np.ndarray:
    """Packed phrases of `length` words within pieces, without those that hold an infrequent word or pair."""
    fit, n = ids > 0, max(0, len(ids) - length + 1)
    ok = fit[:n].copy()
    for j in range(1, length):
        ok &= fit[j : n + j]
    start = np.flatnonzero(ok)
    if length == 3 and pairs is not None and len(start):
        h = words.array()
        one, two, three = (h[ids[start + j]] for j in range(3))
        start = start[has_bit(pairs, pair_hash(one, two)) & has_bit(pairs, pair_hash(two, three))]
    out = ids[start]
    for j in range(1, length):
        out = out << _BITS | ids[start + j]
    return out


def _pieces(texts: list[bytes], limit: int = 1 << 21) -> Iterator[bytes]:
    """Texts in lower case, pieces apart by line feeds, some megabytes at a time, cut between pieces only."""
    held, size = [], 0
    for text in texts:
        text = text.translate(_PLAIN)
        at = 0
        while len(text) - at > limit:
            cut = text.find(b"\n", at + limit)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut
        held.append(text[at:] if at else text)
        size += len(held[-1])
        if size > limit:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def phrase_runs(batches: Iterator[pa.RecordBatch], length: int, frequent: bytes | None, pairs: np.ndarray | None, hot: frozenset[int], burst: int, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of a partition's phrases; for single words also each language's number of words, as the empty phrase."""
    words, trie, total = _words(frequent), HatTrie(length, burst, most), {}
    found: list[np.ndarray] = []

    def count_found(limit: int) -> None:
        if sum(map(len, found)) > limit:
            trie.add(*np.unique(np.concatenate(found), return_counts=True))
            found.clear()

    for batch in slices(batches):
        by_lang: dict[bytes, list[bytes]] = {}
        for lang, utf8 in zip(batch.column("lang").to_pylist(), batch.column("utf8").to_pylist()):
            by_lang.setdefault(lang.encode(), []).append(utf8)
        for lang, texts in by_lang.items():
            for text in _pieces(texts):
                ids = words.ids(lang, text)
                if length == 1:
                    total[lang] = total.get(lang, 0) + int((ids > 0).sum())
                found.append(_grams(ids, length, words, pairs))
                count_found(most)
                if trie.full:
                    yield from _run(list(trie.spill()), words, length, hot)
                if len(words.words) > 1 << (_BITS - 1) or words.size > 128 << 20:
                    count_found(0)
                    yield from _run(list(trie.spill(1.0)), words, length, hot)
                    _WORDS.clear()
                    words, trie = _words(frequent), HatTrie(length, burst, most)
    count_found(0)
    yield from _run(list(trie.spill(1.0)), words, length, hot)
    if total:
        langs = [str(k, "utf-8") for k in total]
        yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array([0] * len(langs), pa.int64()), pa.array([b""] * len(langs), pa.binary()), pa.array(list(total.values()), pa.int64())], schema=_RUN)
    del trie
    if length == WORDS:
        _WORDS.clear()
    give_back()


def merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Runs that a partition's sort has merged: counts of equal phrases added; those of `least` or more stay, and empty ones."""
    last: tuple | None = None  # (lang, phrase, n) of a group that the next batch may go on with
    for batch in batches:
        size, langs, phrases = batch.num_rows, batch.column("lang"), batch.column("phrase")
        if not size:
            continue
        new = pc.or_(pc.not_equal(phrases.slice(1), phrases.slice(0, size - 1)), pc.not_equal(langs.slice(1), langs.slice(0, size - 1)))
        starts = np.flatnonzero(np.append(True, new.to_numpy(zero_copy_only=False)))
        sums = np.add.reduceat(batch.column("n").to_numpy(), starts)
        at = pa.array(starts)
        langs, phrases = langs.take(at), phrases.take(at)
        if last is not None and (langs[0].as_py(), phrases[0].as_py()) == last[:2]:
            sums[0] += last[2]
        elif last is not None and (last[2] >= least or not last[1]):
            yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]], pa.binary()), pa.array([last[2]], pa.int64())], ["lang", "phrase", "n"])
        last = langs[-1].as_py(), phrases[-1].as_py(), int(sums[-1])
        keep_it = (sums >= least) | (pc.binary_length(phrases).to_numpy() == 0)
        keep_it[-1] = False
        at = pa.array(np.flatnonzero(keep_it))
        yield pa.RecordBatch.from_arrays([langs.take(at), phrases.take(at), pa.array(sums[keep_it])], ["lang", "phrase", "n"])
    if last is not None and (last[2] >= least or not last[1]):
        yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]], pa.binary()), pa.array([last[2]], pa.int64())], ["lang", "phrase", "n"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash that the bitmaps know a phrase of one or two words by."""
    for batch in batches:
        split = [[word_hash(lang.encode(), w) for w in phrase.split(b" ")] for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())]
        out = np.array([h[0] for h in split], np.uint64)
        if split and len(split[0]) == 2:
            out = pair_hash(out, np.array([h[1] for h in split], np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), batch.column("n")], ["h", "n"])


def phrase_counts(docs: DataFrame, least: int = 10, text_col: str = "text", lang_col: str = "lang", burst: int = 4096, most: int = 600_000, bitmap_bits: int = 1 << 25, hot_share: int = 1024) -> tuple[DataFrame, list[DataFrame]]:
    """Each language's number of words (lang, n), and for one, two and three words the phrases (lang, phrase, n) with n >= least.

    A-Z is lower-cased; white space other than space and tab, and .,;:!? end a piece; words are what spaces and tabs
    part; phrases lie within pieces, overlaps counted. A null text is empty, a null language `und`. hot_share: words
    with that part of all words or more, so hot_share words at most, have their phrases dealt by two words.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("utf8"))
    spark = docs.sparkSession
    frequent = pairs = None
    hot: frozenset[int] = frozenset()
    out: list[DataFrame] = []
    for length in range(1, WORDS + 1):
        held = spark.sparkContext.broadcast((frequent, pairs, hot))
        runs = rows.mapInArrow(lambda b, k=length, held=held: phrase_runs(b, k, *held.value, burst, most), "lang string, prefix long, phrase binary, n long")
        sums = runs.repartition("prefix").sortWithinPartitions("phrase", "lang").mapInArrow(lambda b: merged(b, least), "lang string, phrase binary, n long")
        sums = keep(sums, f"phrases-{length}")
        if length == 1:
            sizes, sums = sums.filter("octet_length(phrase) = 0").select("lang", "n"), sums.filter("octet_length(phrase) > 0")
        out.append(sums)
        if length < WORDS:
            hashed = sums.mapInArrow(_hashed, "h long, n long")
            bits = bitmap_of(hashed, "h", bitmap_bits)
            if length == 1:
                frequent = bits.tobytes()
                total = sizes.agg(F.sum("n")).first()[0] or 0
                hot = frozenset(r.h % (1 << 64) for r in hashed.filter(F.col("n") * hot_share >= total).collect())
            else:
                pairs = bits
    return sizes.groupBy("lang").agg(F.sum("n").alias("n")), [x.withColumn("phrase", F.col("phrase").cast("string")) for x in out]


def _key(lang: Column, phrase: Column) -> Column:
    return F.concat(lang, F.lit("\n"), phrase)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) by decimals of 38 digits; counts have 15 digits at most."""
    wide = [c.cast("decimal(15,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (wide[0] * wide[0]), wide[1] * wide[2])


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, inside: int = 50, **counting) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    A phrase of a words' occurrences, cut in two parts that occur l and r times, scores floor(1000000 a a / (l r)); its
    lowest cut counts, of equal ones the first. A phrase that lies in a longer one with `inside` percent of its count or
    more is dropped. Order: score and a descending, phrase ascending. Exact in 38 digits. Other columns are ignored; no
    rows, or no phrase with `least` occurrences: an empty result.
    """
    sizes, by_words = phrase_counts(docs, least, **counting)
    known = by_words[0].unionByName(by_words[1]).unionByName(by_words[2]).select(_key(F.col("lang"), F.col("phrase")).alias("key"), F.col("n").alias("f"))
    known = keep(known, "phrases")
    words = F.split("phrase", " ")
    part = lambda a, n: F.array_join(F.slice(words, F.lit(a), n), " ")
    cuts = by_words[1].unionByName(by_words[2]).select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _key(F.col("lang"), part(1, F.col("k"))).alias("first"), _key(F.col("lang"), F.array_join(F.slice(words, F.col("k") + 1, F.size(words) - F.col("k")), " ")).alias("rest"))
    cuts = keep(heavy_join(keep(cuts, "cuts"), known.select(F.col("key").alias("first"), F.col("f").alias("l")), "first"), "cuts-left")
    cuts = heavy_join(cuts, known.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    pairs = F.explode(F.array(part(1, F.lit(2)), part(2, F.lit(2))))
    longer = by_words[2].select("lang", pairs.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    stays = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside))
    rows = stays.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = rows.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= top).drop("deal")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
