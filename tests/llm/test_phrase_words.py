"""The ids of a text's words, against a lookup of each word."""

from __future__ import annotations

import numpy as np
import pytest

from memlake.llm import phrases


class _Counting(phrases._Ids):
    asked = 0

    def __getitem__(self, word: bytes) -> int:
        self.asked += 1
        return super().__getitem__(word)


@pytest.mark.parametrize("text", [b"", b" ", b"\n", b"\n\n a", b"a", b"  a  b ", b"a\nb", b"\n a b\n\nab a \n", "ö é x \x00 ö\n ".encode(), b"to be or not to be\n" * 500])
@pytest.mark.parametrize("frequent", [None, bytes([0b10101010]) * 64])
def test_ids(text, frequent):
    words, plain = phrases.Words(frequent), phrases.Words(frequent)
    held = words.by_lang[b"de"] = _Counting(b"de", words)
    each = phrases._Ids(b"de", plain)
    want = [n for n in (each[w] for w in text.replace(b"\n", b" \n ").split(b" ")) if n >= 0]
    got = words.ids(b"de", text)
    assert got.dtype == np.int64 and got.tolist() == want and (words.words, words.hashes) == (plain.words, plain.hashes)
    assert held.asked <= len(set(text.replace(b"\n", b" \n ").split(b" "))) + 1  # a word once a text
