"""Token ids of a byte-level BPE vocabulary, by the vocabulary file of the tokenizers library.

Texts are cut into pre-tokens with array operations over a whole batch (letters, numbers, other signs and white space, by the rule of
such vocabularies), each distinct pre-token is encoded once and kept in a bounded table, and ids are gathered. Texts with a
special token's string in them go through the library itself. The ids equal the library's.
"""

from __future__ import annotations

import functools
import json
import sys
import unicodedata
from array import array

import numpy as np

from veriledger.llm import kernels as K

LETTER, NUMBER, SPACE, OTHER = range(4)
#: White space of Unicode.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
MOST_KEPT = 100_000
#: Beyond it there are no letters, numbers or white space.
LAST_ASSIGNED = 0x33479


@functools.cache
def _classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(LAST_ASSIGNED + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[list(WHITE)] = SPACE
    return out


def byte_of() -> dict[str, int]:
    """The printable character that such vocabularies write for each byte, backwards."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokeniser:
    """Of one vocabulary file; made on each worker."""

    def __init__(self, path: str):
        import tiktoken

        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = [s.encode() for s in special]
        of = byte_of()
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.pieces = tiktoken.Encoding("vocabulary", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.classes = _classes()
        self.place: dict[int, int] = {}
        self.pool = array("I")

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens start. points: code points of all texts; first: where each text starts."""
        n = len(points)
        kind = self.classes[points]
        new = np.zeros(n, bool)
        new[first[first < n]] = True
        run = new.copy()
        run[1:] |= kind[1:] != kind[:-1]
        at = run.copy()
        after_space = np.zeros(n, bool)
        after_space[1:] = (points[:-1] == 32) & ~new[1:]
        at &= ~((kind != SPACE) & run & after_space)
        # the last white space before a text's next sign is apart from those before it
        last_white = np.zeros(n, bool)
        last_white[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~new[1:]
        at |= last_white
        # 's 't 're 've 'm 'll 'd after no space
        quote = np.flatnonzero((points == 39) & run & at)
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == LETTER) & ~new[quote + 1]]
        if len(quote):
            one = np.isin(points[quote + 1], [ord(c) for c in "stmd"])
            second = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0).astype(np.int64)
            both = points[quote + 1].astype(np.int64) * 65536 + second
            same_text = np.append(new, True)[quote + 2] == False  # noqa: E712
            two = np.isin(both, [ord(a) * 65536 + ord(b) for a, b in ("re", "ve", "ll")]) & same_text
            for q, width in ((quote[one], 1), (quote[two], 2)):
                at[q + 1] = False
                end = q + 1 + width
                end = end[end < n]
                end = end[(kind[end] == LETTER) & ~run[end]]
                at[end] = True
        return np.flatnonzero(at)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start (n + 1 entries)."""
        n_texts = len(offsets) - 1
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            return self._by_library(raw, offsets)
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(n_texts + 1, np.int64)
        size = 1 + (points >= 0x80).astype(np.uint8) + (points >= 0x800) + (points >= 0x10000)
        byte_at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(size, out=byte_at[1:])
        starts = byte_at[self.starts(points, np.searchsorted(byte_at, offsets[:-1]))]
        ends = np.append(starts[1:], len(data))
        hashes = K.word_hashes(data, starts, ends)
        distinct, sample, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.place) + len(distinct) > MOST_KEPT:
            self.place.clear()
            self.pool = array("I")
        place, pool, encode = self.place, self.pool, self.pieces._encode_single_piece
        found = []
        for key, s in zip(distinct.tolist(), sample.tolist(), strict=True):
            known = place.get(key)
            if known is None:
                ids = encode(raw[starts[s] : ends[s]])
                known = place[key] = len(pool) << 24 | len(ids)
                pool.extend(ids)
            found.append(known)
        found = np.array(found, np.int64)[where]
        at, width = found >> 24, found & 0xFFFFFF
        ids = np.frombuffer(pool, np.uint32)[K.ranges(at, at + width)].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(width)))
        return ids, total[np.searchsorted(starts, offsets)]

    def _by_library(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from tokenizers import Tokenizer

        self.library = self.library or Tokenizer.from_file(self.path)
        parts, total = [], [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = raw[a:b]
            if any(s in own for s in self.special):
                ids = np.array(self.library.encode(own.decode("utf-8"), add_special_tokens=False).ids, np.int64)
            else:
                ids, _ = self.encode(np.frombuffer(own, np.uint8), np.array([0, b - a]))
            parts.append(ids)
            total.append(total[-1] + len(ids))
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array(total)
