"""Encode texts by units: stretches of bytes that a byte-level pre-tokeniser never joins across.

The pre-tokenisers used here (public_tokenizers.PATTERN) end a pre-token, whatever stands around, before
a space that a visible character follows, between a letter and a mark, and around a line feed between
visible characters. The bytes between two such places can therefore be encoded once and their ids looked
up again, with the same result as encoding the whole text. Units are found, hashed, looked up and put
together in arrays; only units that are not kept reach the tokenizer.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from geoloom.llm import common

#: Bytes of arrays that a cache holds between calls; beyond them the units that were asked for least go.
LIMIT_BYTES = 40 << 20
#: What a kept unit takes beside its ids: hash, place, number of ids, hits.
UNIT_BYTES = 24

_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_STARTS = _VISIBLE.copy()
#: First bytes of UTF-8 characters none of which is white space (those of other first bytes are not cut at).
_STARTS[[*range(0xC3, 0xE0), 0xE0, *range(0xE4, 0xF0), *range(0xF0, 0xF5)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = _VISIBLE & ~_LETTER
_MARK[0x30:0x3A] = False


def _word_ends(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a letter ends at each of some bytes: of ASCII, or of U+00C0 to U+00FF but for the signs of multiplication and division."""
    here = raw[at]
    return _LETTER[here] | ((raw[np.maximum(at - 1, 0)] == 0xC3) & (at > 0) & (here != 0x97) & (here != 0xB7))


def cuts(raw: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each byte, by what stands around it."""
    n = len(raw)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    spaces = np.flatnonzero(raw[:-1] == 0x20)
    out[spaces[_STARTS[raw[spaces + 1]]]] = True
    marks = np.flatnonzero(_MARK[raw[1:]]) + 1
    out[marks[_word_ends(raw, marks - 1)]] = True
    feeds = np.flatnonzero(raw[1:-1] == 0x0A) + 1
    feeds = feeds[_STARTS[raw[feeds + 1]] & (_VISIBLE[raw[feeds - 1]] | _word_ends(raw, feeds - 1))]
    out[feeds] = out[feeds + 1] = True
    return out


class UnitCache:
    """encode: the ids of each of some strings, flat, and how many each has; encode_spaced: of units that hold one space, their first character (optional)."""

    def __init__(self, encode: Callable, encode_spaced: Callable | None = None, special: tuple[bytes, ...] = (), limit: int = LIMIT_BYTES):
        self.encode, self.encode_spaced, self.special, self.limit = encode, encode_spaced or encode, special, limit
        # a seed of its own: nobody can write a text whose units are taken for each other
        self.hash = common.SpanHash(int.from_bytes(os.urandom(8), "little"))
        self._keep(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint32))

    def _keep(self, keys: np.ndarray, counts: np.ndarray, hits: np.ndarray, ids: np.ndarray) -> None:
        """keys, sorted, with their ids one after another."""
        self.keys, self.counts, self.hits, self.ids = keys, counts, hits, ids
        self.at = np.cumsum(counts) - counts

    def _units(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins = cuts(raw)
        if self.special:
            flat = raw.tobytes()
            for token in self.special:
                at = flat.find(token)
                while at >= 0:  # the library looks for special tokens in whole texts
                    row = np.searchsorted(bounds, at, "right") - 1
                    begins[bounds[row] : bounds[row + 1]] = False
                    at = flat.find(token, int(bounds[row + 1]))
        filled = bounds[:-1] < bounds[1:]
        begins[bounds[1:][filled] - 1] = False  # what follows is another row's
        begins[bounds[:-1][filled]] = True
        starts = np.flatnonzero(begins)
        return starts, np.append(starts[1:], len(raw))

    def rows(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of text (UTF-8 bytes and the n + 1 places where rows begin and end), flat, and the n + 1 bounds of the rows in them."""
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        starts, ends = self._units(raw, bounds)
        keys, first, unit, times = np.unique(self.hash.spans(raw, starts, ends), return_index=True, return_inverse=True, return_counts=True)
        place = np.searchsorted(self.keys, keys)
        held = np.zeros(len(keys), bool)
        if len(self.keys):
            held = self.keys[np.minimum(place, len(self.keys) - 1)] == keys
        self.hits[place[held]] += np.minimum(times[held], 1 << 16).astype(np.uint32)
        missing = np.flatnonzero(~held)
        new, counts = self._encode(raw, starts[first[missing]], ends[first[missing]])
        # all ids that are needed: those kept, then the new ones
        n, at = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        n[held], at[held] = self.counts[place[held]], self.at[place[held]]
        n[missing], at[missing] = counts, len(self.ids) + np.cumsum(counts) - counts
        pool = np.concatenate([self.ids, new])
        per_unit = n[unit]
        ends_ = np.cumsum(per_unit)
        out = pool[np.repeat(at[unit] - ends_ + per_unit, per_unit) + np.arange(ends_[-1])]
        in_rows = np.concatenate([[0], ends_])[np.searchsorted(starts, bounds)]
        self._add(keys[missing], counts, times[missing], place[missing], pool, at[missing])
        return out, in_rows

    def _encode(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, flat, and their numbers, of units that are not kept."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        spaces = np.concatenate([[0], np.cumsum(raw == 0x20)])
        spaced = (raw[starts] == 0x20) & (spaces[ends] - spaces[starts] == 1)
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        flat, at = raw.tobytes(), list(zip(starts[order].tolist(), ends[order].tolist(), strict=True))
        texts = [flat[a:b].decode() for a, b in at]
        k = int(spaced.sum())
        made = [f(t) for f, t in ((self.encode_spaced, texts[:k]), (self.encode, texts[k:])) if t]
        ids, counts = (np.concatenate([m[i] for m in made]) for i in (0, 1))
        # back to the order of the units
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        begin = (np.cumsum(counts) - counts)[back]
        n = counts[back]
        stop = np.cumsum(n)
        return ids[np.repeat(begin - stop + n, n) + np.arange(stop[-1])], n

    def _add(self, keys: np.ndarray, counts: np.ndarray, times: np.ndarray, place: np.ndarray, pool: np.ndarray, at: np.ndarray) -> None:
        """Keep new units beside the old ones; if that is too much, the half that was asked for most."""
        if not len(keys):
            return
        target = place + np.arange(len(keys))
        old = np.ones(len(self.keys) + len(keys), bool)
        old[target] = False

        def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            out = np.empty(len(old), a.dtype)
            out[old], out[target] = a, b
            return out

        all_keys, all_counts, all_at = merged(self.keys, keys), merged(self.counts, counts), merged(self.at, at)
        hits = merged(self.hits, np.minimum(times, 1 << 16).astype(np.uint32))
        if len(all_keys) * UNIT_BYTES + len(pool) * 4 > self.limit:
            size = UNIT_BYTES + 4 * all_counts
            by_use = np.argsort(-hits.astype(np.int64), kind="stable")
            stay = np.sort(by_use[np.cumsum(size[by_use]) <= self.limit // 2])
            all_keys, all_counts, all_at, hits = all_keys[stay], all_counts[stay], all_at[stay], hits[stay] >> 1
            stop = np.cumsum(all_counts)
            pool = pool[np.repeat(all_at - stop + all_counts, all_counts) + np.arange(stop[-1] if len(stop) else 0)]
            all_at = stop - all_counts
        self.keys, self.counts, self.hits, self.ids, self.at = all_keys, all_counts, hits, pool, all_at
