"""Byte-pair encoding and decoding by a walk over a trie of words.

The encoding of a word's prefix is fixed by its last token: that token is the one ending there that is
compatible with the last token of the rest. Distinct words of a batch go into a trie; a depth-first walk
finds the last token at each node from those above it, so prefixes that words share are encoded once. At a
word's leaf the tokens are read off backwards.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .shared import give_back, slices, with_utf8

END = "</w>"
#: Stands for the state before the first symbol; above all ids.
_START = 0xFFFFF


class WordEncoder:
    """Words (as pre-tokenized byte-level strings) to token ids, for a vocabulary with an end-of-word suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        self.vocab, self.name = vocab, {i: t for t, i in vocab.items()}
        self.rank = {vocab[a] << 20 | vocab[b]: i for i, (a, b) in enumerate(merges) if a in vocab and b in vocab and a + b in vocab}
        self.size = {i: len(t.removesuffix(END)) for t, i in vocab.items()}
        self.longest = max(self.size.values())
        self.fits: dict[int, bool] = {}
        self.grown: dict[int, tuple | None] = {}

    def merged(self, parts: list[int]) -> list[int]:
        """Plain merging of a short sequence of ids; used on tokens and pairs of tokens only."""
        return [t for t, _, _, _ in self._merged(parts)[0]]

    def _merged(self, parts: list[int]) -> tuple[list[tuple], bool]:
        """Merged nodes (id, rank of the merge that made it, left, right), and whether ranks only rose."""
        nodes: list[tuple] = [(t, -1, None, None) for t in parts]
        last, rising = -1, True
        while len(nodes) > 1:
            best, at = min((self.rank.get(nodes[i][0] << 20 | nodes[i + 1][0], 1 << 60), i) for i in range(len(nodes) - 1))
            if best == 1 << 60:
                break
            rising, last = rising and best >= last, best
            a, b = nodes[at], nodes[at + 1]
            nodes[at : at + 2] = [(self.vocab[self.name[a[0]] + self.name[b[0]]], best, a, b)]
        return nodes, rising

    def edges(self, t: int) -> tuple | None:
        """What stands at a token's left and at its right end while it is merged: (id, made, replaced) by rank.

        None if the token's symbols do not merge to it; two times None if its merges don't come by rising rank.
        """
        if t not in self.grown:
            nodes, rising = self._merged([self.vocab[c] for c in _symbols(self.name[t])])
            out: list[list] = []
            for side in (2, 3):
                x, gone = nodes[0], 1 << 60
                out.append([])
                while x is not None:
                    out[-1].append((x[0], x[1], gone))
                    x, gone = x[side], x[1]
            self.grown[t] = None if len(nodes) > 1 or nodes[0][0] != t else (out[0], out[1]) if rising else (None, None)
        return self.grown[t]

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens side by side stay as they are; left may be _START.

        They don't if ends of both that stand at one time merge before either is replaced. Where ranks tie or
        fall, the pair is merged in full.
        """
        key = left << 20 | right
        hit = self.fits.get(key)
        if hit is None:
            hit = self.fits[key] = self._fit(left, right)
        return hit

    def _fit(self, left: int, right: int) -> bool:
        r, l = self.edges(right), (None, None) if left == _START else self.edges(left)
        if r is None or l is None or left == _START:
            return r is not None and l is not None
        crossed = False
        if l[1] is not None and r[0] is not None:
            for a, made_a, gone_a in l[1]:
                for b, made_b, gone_b in r[0]:
                    q = self.rank.get(a << 20 | b)
                    if q is not None and q <= gone_a and q <= gone_b:
                        if q in (gone_a, gone_b) or q < made_a or q < made_b:
                            break
                        crossed = True
                else:
                    continue
                break
            else:
                return not crossed
        whole = [self.vocab[c] for t in (left, right) for c in _symbols(self.name[t])]
        return self.merged(whole) == [left, right]

    def last(self, word: str, end: int, suffix: str, ids: list[int]) -> int:
        """The last token of word[:end] + suffix; ids[i] is that of word[:i].

        One token fits at most, so the order of trial is free: the token before, made longer, comes first.
        """
        find, known = self.vocab.get, self.fits.get
        before = ids[end - 1]
        if before != _START:
            token = self.name[before] + word[end - 1] + suffix
            t = find(token)
            if t is not None:
                left = ids[end - len(token) + len(suffix)]
                hit = known(left << 20 | t)
                if self.fit(left, t) if hit is None else hit:
                    return t
        for at in range(end - 1, max(-1, end - 1 - self.longest), -1):
            t = find(word[at:end] + suffix)
            if t is not None:
                left = ids[at]
                hit = known(left << 20 | t)
                if self.fit(left, t) if hit is None else hit:
                    return t
        raise KeyError(f"no token ends {word[max(0, end - self.longest) : end] + suffix!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of each distinct word, by a depth-first walk over their trie.

        Sorted words are the trie's leaves in that order, and what a word shares with the one before is the path
        that the walk stays on; so the path's states are all that is held, whatever the words' length.
        """
        out: dict[str, list[int]] = {}
        ids, before, last, size = [_START], "", self.last, self.size
        for word in sorted(words):
            n = len(word)
            same, most = 0, min(len(before), n) - 1
            while same < most and before[same] == word[same]:
                same += 1
            del ids[same + 1 :]
            for i in range(same + 1, n):
                ids.append(last(word, i, "", ids))
            t = last(word, n, END, ids)
            found, i = [t], n - size[t]
            while i:
                t = ids[i]
                found.append(t)
                i -= size[t]
            found.reverse()
            out[word] = found
            before = word
        return out


def _symbols(token: str) -> list[str]:
    bare = token.removesuffix(END)
    out = list(bare)
    if bare != token and out:
        out[-1] += END
    return out


#: ASCII and the Latin-1 letters, where the normaliser only lower-cases and words can be split by one pattern.
_PLAIN = re.compile(r"[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \t\n\r\x0b\x0ca-z\xdf-\xf6\xf8-\xff0-9]+")


#: Marks a word that comes as shown bytes; no text holds this character.
_SHOWN = "\ud800"


class TextEncoder:
    """Whole texts, as the library encodes them without added special tokens.

    The library's own normaliser and pre-tokenizer split pieces that hold other than ASCII and Latin-1 letters.
    Encoded pieces and words of up to `longest_cached` characters stay cached in two generations of at most
    `most_cached` each, so caches have a bound in bytes; longer ones are encoded anew in each batch.
    """

    def __init__(self, path: str, most_cached: int = 20_000, longest_cached: int = 40):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        tok = Tokenizer.from_file(path)
        self.normalise, self.split = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        self.words = WordEncoder(spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.spaced = {i: f"{t} ".encode() for t, i in [*spec["model"]["vocab"].items(), *self.special.items()]}
        del spec, tok  # its model isn't needed
        self.byte = ["".join(w for w, _ in self.split(chr(b))) for b in range(128)]
        # A byte above 127 shows in the split of a character that holds it; all of them occur in these characters.
        for c in [*map(chr, range(0x80, 0x800)), *map(chr, range(0x800, 0xD800, 64)), *map(chr, range(0xE000, 0x110000, 4096))]:
            for b, shown in zip(c.encode(), "".join(w for w, _ in self.split(c)), strict=False):
                self.byte += [""] * (b + 1 - len(self.byte))
                self.byte[b] = shown
        self.most, self.longest = most_cached, longest_cached
        self.pieces: tuple[dict, dict] = ({}, {})
        self.known: tuple[dict, dict] = ({}, {})

    def words_of(self, piece: str) -> list[str]:
        """The words and special tokens of a piece without ASCII white space. Those outside Latin-1 come as shown bytes."""
        if piece.isalpha() and piece.isascii():
            return [piece.lower()]
        out: list[str] = []
        for i, part in enumerate(self.cut.split(piece)) if "<|" in piece else [(0, piece)]:
            if i % 2:
                out.append(part)
            elif _PLAIN.fullmatch(part):
                out += _PLAIN_WORDS.findall(part.lower())
            else:
                out += [_SHOWN + w for w, _ in self.split(self.normalise(part)) if w]
        return out

    def shown(self, word: str) -> str:
        return word[1:] if word[0] == _SHOWN else word if word.isalpha() and word.isascii() else "".join([self.byte[b] for b in word.encode()])

    def _turn(self, cache: tuple[dict, dict], most: int) -> tuple[dict, dict]:
        return ({}, cache[0]) if len(cache[0]) > most else cache

    def learn(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        """Each piece's ids and their tokens, spaced. Words that aren't cached are encoded in one trie."""
        self.pieces, self.known = self._turn(self.pieces, self.most), self._turn(self.known, self.most)
        if len(self.words.fits) > 8 * self.most:
            self.words.fits.clear()
        new, old = self.pieces
        find, had = new.get, old.get
        out = [find(p) or had(p) for p in pieces]
        need = [i for i, x in enumerate(out) if x is None]
        split = [self.words_of(pieces[i]) for i in need]
        word, before = self.known
        got: dict[str, tuple[bytes, bytes]] = {}
        fresh: dict[str, str] = {}
        for w in {w for ws in split for w in ws}:
            hit = word.get(w) or before.get(w)
            if hit is not None:
                got[w] = hit
            elif w in self.special:
                got[w] = (array("I", [self.special[w]]).tobytes(), self.spaced[self.special[w]])
            else:
                fresh[w] = self.shown(w)
        ids = self.words.encode_words(set(fresh.values()))
        spaced = self.spaced
        for w, s in fresh.items():
            got[w] = (array("I", ids[s]).tobytes(), b"".join([spaced[t] for t in ids[s]]))
        for i, ws in zip(need, split, strict=True):
            out[i] = got[ws[0]] if len(ws) == 1 else (b"".join([got[w][0] for w in ws]), b"".join([got[w][1] for w in ws]))
        longest = self.longest
        word.update((w, x) for w, x in got.items() if len(w) <= longest)
        new.update((p, x) for p, x in zip(pieces, out, strict=True) if len(p) <= longest)
        return out

    def encode_batch(self, texts: pa.Array, decoded: bool = True) -> tuple[list[bytes], list[bytes]]:
        """Of each text: ids as little-endian unsigned 32-bit integers, and their decoded text in UTF-8.

        Distinct pieces between white space are looked up once; Arrow then lines up the texts' pieces. Decoded
        tokens stand side by side with spaces, as the library has it for a file without a decoder.
        """
        texts = texts.cast(pa.string())
        if not pa.compute.any(pa.compute.match_substring(texts, "<|")).as_py():
            texts = pa.compute.ascii_lower(texts)  # special tokens alone tell case apart
        split = pa.compute.ascii_split_whitespace(texts)
        pieces = split.flatten().dictionary_encode()
        learned = self.learn(pieces.dictionary.to_pylist())
        ends = (split.offsets.to_numpy() - split.offsets[0].as_py()).tolist()

        def lined_up(values: list[bytes]) -> list[bytes]:
            lined = pa.array(values, pa.large_binary()).take(pieces.indices.cast(pa.int64()))
            if not len(lined):
                return [b""] * len(texts)
            at = np.frombuffer(lined.buffers()[1], np.int64)[: len(lined) + 1][ends].tolist()
            held = memoryview(lined.buffers()[2] or b"")
            return [bytes(held[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]

        return lined_up([x for x, _ in learned]), [x[:-1] for x in lined_up([x for _, x in learned])] if decoded else []


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_digests: bool = False) -> DataFrame:
    """id_col, n_tokens, then ids (array<int>) or the digests of ids and of the decoded text.

    `vocabulary` is the path of the vocabulary file on every node. A null text counts as empty and has no
    tokens. Rows that repeat are encoded alike; other columns are ignored. No rows: an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = TextEncoder(vocabulary)
        give_back()
        gc.disable()  # what is made here has no cycles, and scanning the caches for some takes long
        try:
            for batch in slices(batches, limit=1 << 20):
                ids, shown = enc.encode_batch(batch.column("utf8"), with_digests)
                sizes = [len(x) // 4 for x in ids]
                cols = [batch.column(0), pa.array(sizes, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
                if with_digests:
                    cols += [pa.array([hashlib.sha256(x).hexdigest() for x in y]) for y in (ids, shown)]
                yield pa.RecordBatch.from_arrays(cols, names)
        finally:
            del enc  # Python workers outlive a stage, and what they hold counts for their executor
            gc.enable()
            give_back()

    names = [id_col, "n_tokens", *["ids"] * with_ids, *["ids_sha256", "decoded_sha256"] * with_digests]
    kinds = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join(f"`{n}` {kinds.get(n) or docs.schema[id_col].dataType.simpleString()}" for n in names)
    return with_utf8(docs, id_col, text=text_col).mapInArrow(run, schema)
