"""Dense features of texts for the classifiers, by numpy over whole batches of bytes."""

from __future__ import annotations

import numpy as np

from .textbuf import BYTE, U64, mix, prefix_hashes, slice_hashes

NAMES = (
    "words", "bytes", "mean_word", "capitals", "caps_words", "digits", "spaces", "lines", "exclamations", "questions", "symbols", "punctuation",
    "non_ascii", "distinct_words", "top_run", "odd_words", "short_words", "long_words", "second_person", "function_words", "bars",
)
#: Fixed lists: second-person words and frequent function words of four languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros os".split()
FUNCTION_WORDS = (
    "the of and to in a is that for it with as was on by this be are from at an or have not der die das und in zu den von mit ist für auf ein eine dem nicht sich des auch als "
    "le la les de des et en un une du que est pour dans qui sur par pas au el los las y del se por con una para su lo como"
).split()
_KIND = np.zeros(256, np.uint8)  # 0 space, 1 lower, 2 upper, 3 digit, 4 other sign, 5 above ASCII
_KIND[33:128] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_KIND[:9] = _KIND[14:32] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Signs that stand for letters within words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": "*"}
_PLAIN = _LOWER.copy()
for _a, _b in LEET.items():
    _PLAIN[ord(_a)] = ord(_b)
_IN_WORD = np.isin(_KIND, (1, 2, 3, 5))
_IN_WORD[[ord("@"), ord("$"), ord("*")]] = True
_ODD = np.zeros(256, bool)
_ODD[[ord(c) for c in LEET]] = True


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(mix(slice_hashes(prefix_hashes(BYTE[data]), np.array([0]), np.array([len(data)])))[0])


_SECOND = np.sort(np.array([word_hash(w) for w in SECOND_PERSON], U64))
_FUNCTION = np.sort(np.unique(np.array([word_hash(w) for w in FUNCTION_WORDS], U64)))


def member(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each hash is in a sorted table."""
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


class Words:
    """Words of a batch of rows: runs of letters, digits and signs that stand for letters."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _IN_WORD[data]
        opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        opens[edges], closes[edges - 1] = inside[1:-1][edges], inside[1:-1][edges - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.prefix = prefix_hashes(BYTE[_LOWER[data]])
        self.size = self.ends - self.starts
        self.hash = mix(slice_hashes(self.prefix, self.starts, self.ends))

    def prefix_hash(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first ``n`` bytes, and which words are longer than that."""
        longer = self.size > n
        return mix(slice_hashes(self.prefix, self.starts[longer], self.starts[longer] + n)), longer

    def plain_hash(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes with signs read as letters, and which words have such signs beside letters."""
        odd = np.cumsum(np.concatenate([[0], _ODD[self.data].astype(np.int32)]))
        n = odd[self.ends] - odd[self.starts]
        some = (n > 0) & (n < self.size)
        prefix = prefix_hashes(BYTE[_PLAIN[self.data]])
        return mix(slice_hashes(prefix, self.starts[some], self.ends[some])), some

    def count(self, flag: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, flag, len(self.offsets) - 1)


def describe(w: Words) -> np.ndarray:
    """Rows by :data:`NAMES`. Rates are by words or bytes; an empty text has zeros."""
    data, offsets, rows = w.data, w.offsets, len(w.offsets) - 1
    kind = _KIND[data]

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])

    n, size = np.diff(w.first).astype(float), np.diff(offsets).astype(float)
    n1, s1 = np.maximum(n, 1), np.maximum(size, 1)
    upper, lower = per_row(kind == 2), per_row(kind == 1)
    caps = np.concatenate([[0], np.cumsum(kind == 2)])
    all_caps = (caps[w.ends] - caps[w.starts] == w.size) & (w.size > 1)
    sign = kind == 4
    distinct = np.zeros(rows)
    if len(w.hash):
        by = np.lexsort((w.hash, w.row))
        new = np.ones(len(by), bool)
        new[1:] = (w.hash[by][1:] != w.hash[by][:-1]) | (w.row[by][1:] != w.row[by][:-1])
        distinct = np.bincount(w.row[by], new, rows)
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    _, odd = w.plain_hash()
    columns = [
        np.log1p(n), np.log1p(size), np.bincount(w.row, w.size, rows) / n1, upper / np.maximum(upper + lower, 1), w.count(all_caps) / n1, per_row(kind == 3) / s1,
        per_row(kind == 0) / s1, per_row(data == 10) / n1, per_row(data == 33) / n1, per_row(data == 63) / n1,
        per_row(sign & np.isin(data, np.frombuffer(b"#$%&*+/<=>@\\^_`{|}~", np.uint8))) / n1, per_row(sign) / n1, per_row(kind == 5) / s1, distinct / n1, w.count(same) / n1,
        w.count(odd) / n1, w.count(w.size <= 2) / n1, w.count(w.size > 14) / n1, w.count(member(w.hash, _SECOND)) / n1, w.count(member(w.hash, _FUNCTION)) / n1, per_row(data == 124) / n1,
    ]
    return np.stack(columns, 1)
