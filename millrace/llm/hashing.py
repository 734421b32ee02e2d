"""Words of many texts at once, and 64-bit hashes of words and word sequences, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
WORD_BASE, WORD_INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
SEQ_BASE = 0x9E3779B97F4A7C15

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = {0x20, *range(0x09, 0x0E)}
#: Byte tables: A-Z folded, and everything that is not in a word turned into a space.
BY_WHITE_SPACE = bytes(0x20 if b in _SPACE else _FOLD[b] for b in range(256))
BY_ALPHANUMERIC = bytes(
    _FOLD[b] if b >= 128 or chr(b).isalnum() else 0x20 for b in range(256)
)


def mix(x):
    """Spread the bits of unsigned 64-bit values; a bijection."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(SEQ_BASE))


_POWERS: dict = {}


def powers(base, size):
    """base^0 to base^(size - 1), modulo 2^64."""
    held = _POWERS.get(base)
    if held is None or len(held) < size:
        held = np.full(1 << max(12, int(size).bit_length()), base, U)
        held[0] = 1
        held = _POWERS[base] = np.cumprod(held)
    return held[:size]


class Words:
    """Words of a list of texts: `text` index, `start` and `end` bytes, 64-bit `hash`.

    Offsets count bytes of the texts joined by one byte; `base` holds where each
    text begins. A null text has no words.
    """

    def __init__(self, texts, table, hashed=True):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.base = np.concatenate(
            [[0], np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)]
        ).astype(np.int64)
        self.bytes = np.frombuffer(b"\n".join(raw) + b" ", np.uint8)
        data = np.frombuffer(self.bytes.tobytes().translate(table), np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        # A line feed between texts is a space in every table.
        inside[1:-1] = data != 0x20
        step = np.diff(inside)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.text = np.searchsorted(self.base, self.start, "right") - 1
        #: words of text i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.text, np.arange(len(raw) + 1))
        if hashed:
            total = np.zeros(len(data) + 1, U)
            np.cumsum(_BYTE[data] * powers(WORD_BASE, len(data)), out=total[1:])
            sums = total[self.end] - total[self.start]
            self.hash = mix(sums * powers(WORD_INVERSE, len(data))[self.start])

    @property
    def counts(self):
        return np.diff(self.first)


def shingles(words: Words, size):
    """(text index, hash) of every run of `size` words; a shorter text is one run as a whole."""
    h, n = words.hash, words.counts
    weight = powers(SEQ_BASE, size)
    count = len(h) - size + 1
    owners, values = [], []
    if count > 0:
        sums = np.zeros(count, U)
        for j in range(size):
            sums += h[j : j + count] * weight[j]
        whole = words.text[:count] == words.text[size - 1 :]
        owners.append(words.text[:count][whole])
        values.append(mix(sums[whole]))
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        member = np.isin(words.text, short)
        text = words.text[member]
        place = np.arange(len(h))[member] - words.first[text]
        sums = np.zeros(len(n), U)
        np.add.at(sums, text, h[member] * weight[place])
        owners.append(short)
        values.append(mix(sums[short] ^ n[short].astype(U)))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(owners).astype(np.int64), np.concatenate(values)


def distinct(owner, value):
    """Distinct (owner, value) pairs, sorted by owner, then value."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(owner):
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        owner, value = owner[new], value[new]
    return owner, value
