"""How many members sets share, tile by tile: frequent members by products of matrices, others by their lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _by_member(member: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their members, and where each of n members begins."""
    order = np.argsort(member, kind="stable")
    return row[order], np.concatenate(([0], np.cumsum(np.bincount(member, minlength=n))))


def _dense(member: np.ndarray, row: np.ndarray, place: np.ndarray, rows: int, wide: int) -> np.ndarray:
    out = np.zeros((rows, wide), np.uint8)
    keep = place[member] >= 0
    out[row[keep], place[member[keep]]] = 1
    return out


def shared_counts(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], members: int, block: int = 512, chunk: int = 1024, most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts) of blocks of left rows: counts of the members that each shares with each of the right rows.

    left, right: (members in the order of rows, sizes of the rows), members as numbers below `members`, once a row.
    A member goes into matrices where the pairs of rows that have it are more than one in 300 of all.
    """
    (a, na), (b, nb) = left, right
    row_a, row_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    pairs = np.bincount(a, minlength=members).astype(np.float64) * np.bincount(b, minlength=members)
    often = np.flatnonzero(pairs * 300 > float(len(na)) * len(nb))
    place = np.full(members, -1, np.int64)
    place[often] = np.arange(len(often))
    wide_b = _dense(b, row_b, place, len(nb), len(often))
    rare_b = place[b] < 0
    listed, starts = _by_member(b[rare_b], row_b[rare_b], members)
    ends = np.concatenate(([0], np.cumsum(na)))
    for first in range(0, len(na), block):
        last = min(first + block, len(na))
        own, row = a[ends[first] : ends[last]], row_a[ends[first] : ends[last]] - first
        wide_a = _dense(own, row, place, last - first, len(often))
        counts = np.zeros((last - first, len(nb)), np.float32)
        for c in range(0, len(often), chunk):
            counts += wide_a[:, c : c + chunk].astype(np.float32) @ wide_b[:, c : c + chunk].astype(np.float32).T
        found = starts[own + 1] - starts[own]
        own, row, found = own[found > 0], row[found > 0], found[found > 0]
        parts = np.cumsum(found) // most
        for cut in np.split(np.arange(len(own)), np.flatnonzero(np.diff(parts)) + 1):
            n = found[cut]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[own[cut]], n)
            cell = np.repeat(row[cut] * len(nb), n) + listed[at]
            counts += np.bincount(cell, minlength=counts.size).reshape(counts.shape)
        yield first, counts


def _bits(member: np.ndarray, row: np.ndarray, place: np.ndarray, rows: int, wide: int, chunk: int = 2048) -> np.ndarray:
    """Rows of 64-bit words, a bit for each of `wide` members; rows are in order."""
    out = [np.zeros((0, -(-wide // 64)), np.uint64)]
    for first in range(0, rows, chunk):
        cut = slice(*np.searchsorted(row, (first, first + chunk)))
        held = _dense(member[cut], row[cut] - first, place, min(chunk, rows - first), -(-wide // 64) * 64)
        out.append(np.packbits(held, axis=1).view(np.uint64))
    return np.concatenate(out)


def similar_rows(left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray], members: int, least: float, same: bool = False, hits: float = 0.5, wide: int = 256, cells: int = 1 << 19, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of left and right rows with a Jaccard above `least`, all of them once.

    left, right: (members in the order of rows, their numbers by row, sizes of the rows' sets), rows by size. Sizes may be
    more than the numbers of members, as members can stand for several; what is missing counts as shared. same: both are
    the same rows, and x < y. Members are counted in three classes: rare ones by their lists, `hits` to a pair of rows in
    all; the `wide` commonest by products of matrices; the others only for pairs that could still be above `least` if the
    lesser row shared all that it has of them. Pairs that sizes rule out aren't compared.
    """
    (a, ha, na), (b, hb, nb) = left, right
    if not len(na) or not len(nb):
        return
    row_a, row_b = np.repeat(np.arange(len(na)), ha), np.repeat(np.arange(len(nb)), hb)
    pairs = np.bincount(a, minlength=members).astype(np.float64) * np.bincount(b, minlength=members)
    order = np.argsort(pairs)
    rare = np.searchsorted(np.cumsum(pairs[order]), hits * len(na) * len(nb), side="right")
    common, middle = order[rare:][-wide:], order[rare:][:-wide]
    places = []
    for some in (common, middle):
        place = np.full(members, -1, np.int64)
        place[some] = np.arange(len(some))
        places.append(place)
    wide_a, wide_b = (_dense(m, r, places[0], len(n), len(common)) for m, r, n in ((a, row_a, na), (b, row_b, nb)))
    wide_b = wide_b.astype(np.float32)
    bits_a, bits_b = (_bits(m, r, places[1], len(n), len(middle)) for m, r, n in ((a, row_a, na), (b, row_b, nb)))
    mid_a, mid_b = (np.bincount(r[places[1][m] >= 0], minlength=len(n)) for m, r, n in ((a, row_a, na), (b, row_b, nb)))
    is_rare = (places[0] < 0) & (places[1] < 0) & (pairs > 0)
    keep_a, keep_b = is_rare[a], is_rare[b]
    listed, starts = (x.astype(np.int32) for x in _by_member(b[keep_b], row_b[keep_b], members))
    a, row_a = a[keep_a], row_a[keep_a].astype(np.int32)
    more_a, more_b, least = na - ha, nb - hb, max(least - 1e-9, 0)
    share = least / (1 + least) * (1 - 1e-5)  # what is shared must be above this share of both sizes; a little less, for rounding
    by_row, by_column = (share * na - mid_a - more_a).astype(np.float32), (share * nb - more_b).astype(np.float32)
    block = max(1, min(512, cells // len(nb)))
    for first in range(0, len(na), block):
        last = min(first + block, len(na))
        begin = max(np.searchsorted(nb, least * na[first]), first + 1 if same else 0)
        end = np.searchsorted(nb, na[last - 1] / least, side="right") if least else len(nb)
        if begin >= end:
            continue
        counts = wide_a[first:last].astype(np.float32) @ wide_b[begin:end].T
        cut = slice(*np.searchsorted(row_a, (first, last)))
        own, row = a[cut], row_a[cut] - np.int32(first)
        found = starts[own + 1] - starts[own]
        shift = starts[own] - np.cumsum(found, dtype=np.int32) + found
        column = listed[np.arange(found.sum(), dtype=np.int32) + np.repeat(shift, found)]
        inside = (column >= begin) & (column < end)
        cell = np.repeat(row * np.int32(end - begin) - np.int32(begin), found)[inside] + column[inside]
        counts += np.bincount(cell, minlength=counts.size).reshape(counts.shape).astype(np.float32)
        x, y = np.nonzero(counts - by_column[None, begin:end] > by_row[first:last, None])
        for part in range(0, len(x), most):
            i, j = x[part : part + most], y[part : part + most]
            known = counts[i, j].astype(np.float64)
            i, j = first + i, begin + j
            known += more_a[i] + more_b[j]
            maybe = (known + np.minimum(mid_a[i], mid_b[j]) > share * (na[i] + nb[j])) & ((i < j) | (not same))
            i, j, known = i[maybe], j[maybe], known[maybe]
            known += np.bitwise_count(bits_a[i] & bits_b[j]).sum(1)
            real = known > least * (na[i] + nb[j] - known)
            yield i[real], j[real]
