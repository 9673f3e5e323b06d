"""Suffixes of a text sorted bucket by bucket, with long ties resolved by ranks of a difference cover's sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A difference cover: every difference modulo PERIOD is one of two members of COVER.
PERIOD, COVER = 7, (0, 1, 3)
#: Suffixes of a bucket that are sorted at one time, unless more of them share their first eight bytes.
BUCKET = 1 << 18
#: Bytes of a text: a rank in the sample then takes 21 bits, and two of them and a place one word.
TEXT = 4 << 20


def _steps() -> np.ndarray:
    """For two places' remainders the least step after which both are in the sample."""
    sampled = [r in COVER for r in range(PERIOD)]
    return np.array([[next(s for s in range(PERIOD) if sampled[(i + s) % PERIOD] and sampled[(j + s) % PERIOD]) for j in range(PERIOD)] for i in range(PERIOD)], np.int64)


STEPS = _steps()


def words_at(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number that sorts like them. text: bytes, eight more than the last place."""
    view = np.ndarray((len(text) - 7,), np.dtype(">u8"), text, 0, (1,))
    return view[at].astype(np.uint64)


def _dense(keys: np.ndarray, bits: int) -> np.ndarray:
    """The rank (from 1) of each key, equal for equal ones; keys have so many bits free at their end for a place."""
    sorted_keys = np.sort(keys | np.arange(len(keys), dtype=np.uint64))
    new = np.ones(len(keys), np.int64)
    new[1:] = (sorted_keys[1:] >> np.uint64(bits)) != (sorted_keys[:-1] >> np.uint64(bits))
    ranks = np.empty(len(keys), np.int64)
    ranks[(sorted_keys & np.uint64((1 << bits) - 1)).astype(np.int64)] = np.cumsum(new)
    return ranks


def cover_ranks(text: np.ndarray, size: int, depth: int) -> np.ndarray:
    """For each sampled place of text its rank among the sample's suffixes, by depth bytes at least; 0 elsewhere.

    text: size bytes and PERIOD + 8 or more zeros. A sampled place's successor at a multiple of PERIOD is sampled too, so ranks
    double their depth without reading the text again.
    """
    ranks = np.zeros(size + PERIOD + 2, np.int64)
    residues = np.zeros(PERIOD, bool)
    residues[list(COVER)] = True
    sample = np.flatnonzero(np.resize(residues, size))
    if not len(sample):
        return ranks
    order = np.argsort(heads := words_at(text, sample) >> np.uint64(8))
    heads = heads[order]
    new = np.ones(len(sample), np.int64)
    new[1:] = heads[1:] != heads[:-1]
    now = np.empty(len(sample), np.int64)
    now[order] = np.cumsum(new)
    bits, reach = max(1, len(sample).bit_length()), PERIOD
    while reach < depth and now.max() < len(sample):
        ranks[sample] = now
        after = sample + reach
        later = np.where(after < size, ranks[np.minimum(after, size)], 0)
        now = _dense(((now.astype(np.uint64) << np.uint64(bits)) | later.astype(np.uint64)) << np.uint64(bits), bits)
        reach *= 2
    ranks[sample] = now
    return ranks


def buckets(text: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (and their first words) in groups that follow one another in order; suffixes of one first word stay together."""
    heads = words_at(text, places)
    if len(places) <= BUCKET:
        yield places, heads
        return
    drawn = np.sort(heads[:: max(1, len(places) // 4096)])
    cuts = np.unique(drawn[:: max(1, len(drawn) * BUCKET // len(places) // 2)])
    which = np.searchsorted(cuts, heads, side="right")
    for k in range(len(cuts) + 1):
        inside = which == k
        if inside.any():
            yield places[inside], heads[inside]


def _resolve(ranks: np.ndarray, order: np.ndarray, group: np.ndarray, same: np.ndarray) -> None:
    """Sorts order in place inside each group (a number for each place, rising) by the sample's ranks; marks equal neighbours in same.

    All groups are split at once into what sorts before, with and after a pivot; two places are compared at the first step at
    which both are sampled.
    """
    slots = np.arange(len(order))
    while len(slots):
        here = order[slots]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[first, len(slots)])
        pivot = np.repeat(here[first + sizes // 2], sizes)
        step = STEPS[here % PERIOD, pivot % PERIOD]
        left, right = ranks[here + step], ranks[pivot + step]
        part = np.repeat(np.arange(len(first)) * 3, sizes) + 1 + (left > right) - (left < right)
        perm = np.argsort(part, kind="stable") if len(part) < 64 else (np.sort((part.astype(np.uint64) << np.uint64(22)) | np.arange(len(part), dtype=np.uint64)) & np.uint64((1 << 22) - 1)).astype(np.int64)
        order[slots], part = here[perm], part[perm]
        tied = part[1:] == part[:-1]
        same[slots[1:][tied & (part[1:] % 3 == 1)]] = True
        open_ = (part % 3 != 1) & (np.r_[False, tied] | np.r_[tied, False])
        slots, group = slots[open_], part[open_]


def sorted_buckets(text: np.ndarray, size: int, places: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For one bucket after the other: its places in the order of their suffixes, and which have the next before them in their first depth bytes.

    text: size bytes, TEXT at most, then depth + 16 or more zeros. Suffixes are compared as far as depth bytes and up to
    twice that; a suffix of the text has zeros after its end. Only one bucket is held beside the text and the sample's ranks.
    """
    ranks = cover_ranks(text, size, depth)
    for inside, heads in buckets(text, places):
        perm = np.argsort(heads)
        order, heads = inside[perm], heads[perm]
        tied = np.r_[False, heads[1:] == heads[:-1]]
        same = np.zeros(len(order), bool)
        several = tied | np.r_[tied[1:], False]
        slots = np.flatnonzero(several)
        if len(slots):
            part, mark = order[slots], np.zeros(len(slots), bool)
            _resolve(ranks, part, np.cumsum(~tied)[slots], mark)
            order[slots], same[slots] = part, mark
        # Neighbours that differ only beyond depth bytes, or that follow different ends, are told apart by their bytes.
        pairs = np.flatnonzero(tied & ~same)
        for at in [*range(8, depth - 8, 8), depth - 8]:
            pairs = pairs[words_at(text, order[pairs] + at) == words_at(text, order[pairs - 1] + at)]
        same[pairs] = True
        yield order, same
