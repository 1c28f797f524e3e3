"""Occurrences of many words in whole columns of texts, batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

#: Bytes that are looked through at once, and hash values of the first look.
CHUNK, HASHES = 1 << 20, 1 << 16
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True


def _hashed(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.intp)


def _overlaps_itself(term: bytes) -> bool:
    return any(term[:k] == term[-k:] for k in range(1, len(term)))


class TermMatcher:
    """Finds distinct non-empty terms. Each term is looked for by its first 1, 2, 4 or 8 bytes; where these are, it is compared whole."""

    def __init__(self, terms: Sequence[str]):
        self.terms = [t.encode() for t in terms]
        if not all(self.terms) or len(set(self.terms)) < len(self.terms):
            raise ValueError("terms must be distinct and not empty")
        self.overlapping = np.array([_overlaps_itself(t) for t in self.terms], dtype=bool)
        self.lengths = np.array([len(t) for t in self.terms], dtype=np.int64)
        self.heads: dict[int, dict[int, list[int]]] = {}
        for place, t in enumerate(self.terms):
            size = max(s for s in (1, 2, 4, 8) if s <= len(t))
            self.heads.setdefault(size, {}).setdefault(int.from_bytes(t[:size], "little"), []).append(place)

    def _candidates(self, text: np.ndarray, n: int):
        """Places in ``text`` (padded by zeros behind ``n``) and the terms that may begin there, by equal heads."""
        looks = {}
        for size, heads in self.heads.items():
            keys = np.array(sorted(heads), dtype=np.uint64)
            fits = np.zeros(HASHES, dtype=bool)
            fits[_hashed(keys)] = True
            looks[size] = keys, fits
        for start in range(0, n, CHUNK):
            end = min(start + CHUNK, n)
            window, width = text[start:end + 7].astype(np.uint64), 1
            for size in (1, 2, 4, 8):
                if width < size:
                    window, width = window[:-width] | (window[width:] << np.uint64(8 * width)), size
                if size not in looks:
                    continue
                keys, fits = looks[size]
                at = np.flatnonzero(fits[_hashed(window[:end - start])])
                found = np.searchsorted(keys, window[at])
                same = keys[np.minimum(found, keys.size - 1)] == window[at]
                yield size, keys, at[same] + start, found[same]

    def matches(self, texts: pa.Array, whole_words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, term, count)`` of all terms that occur, by text and term; matches of one term do not overlap.

        With ``whole_words`` neither the byte before nor the one behind a match continues a word at its edge, as
        ``\\b`` has it on ASCII texts. Null texts hold nothing.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return (np.zeros(0, dtype=np.int64),) * 3
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
        text = np.zeros(n + 16, dtype=np.uint8)
        if n:
            text[:n] = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[first:first + n]
        offsets = offsets - first
        places, terms = [], []
        for size, keys, at, head in self._candidates(text, n):
            if not at.size:
                continue
            order = np.argsort(head, kind="stable")
            heads, starts = np.unique(head[order], return_index=True)
            for h, own in zip(heads, np.split(at[order], starts[1:])):
                for place in self.heads[size][int(keys[h])]:
                    term = np.frombuffer(self.terms[place], dtype=np.uint8)
                    left = own[own + term.size <= n]
                    for i in range(size, term.size):
                        left = left[text[left + i] == term[i]]
                    if left.size:
                        places.append(left)
                        terms.append(np.full(left.size, place))
        if not places:
            return (np.zeros(0, dtype=np.int64),) * 3
        place, term = np.concatenate(places), np.concatenate(terms)
        row = np.searchsorted(offsets, place, side="right") - 1
        end = place + self.lengths[term]
        keep = end <= offsets[row + 1]
        if whole_words:
            inner = WORD[text]
            before = inner[place - 1] & (place > offsets[row])
            behind = inner[end] & (end < offsets[row + 1])
            keep &= (before != inner[place]) & (behind != inner[end - 1])
        row, term, place, end = row[keep], term[keep], place[keep], end[keep]
        order = np.lexsort((place, term, row))
        row, term, place, end = row[order], term[order], place[order], end[order]
        taken = np.ones(row.size, dtype=bool)
        if row.size:
            follows = (row[1:] == row[:-1]) & (term[1:] == term[:-1])
            near = np.flatnonzero(follows & self.overlapping[term[1:]] & (place[1:] < end[:-1])) + 1
            if near.size:
                self._drop_overlapping(near, follows, place, end, taken)
            begins = np.flatnonzero(np.concatenate([[True], ~follows]))
            counts = np.add.reduceat(taken.astype(np.int64), begins)
            return row[begins], term[begins], counts
        return row, term, row

    @staticmethod
    def _drop_overlapping(near, follows, place, end, taken) -> None:
        """Left to right, a match that begins inside the last one taken falls out. Runs of overlapping matches are short
        but for texts of one repeated piece."""
        i, last = -1, -1
        for j in near.tolist():
            if j - 1 != i:
                last = end[j - 1]
            if place[j] < last:
                taken[j] = False
            else:
                last = end[j]
            i = j
