"""Token ids of whole texts by a public byte-level BPE vocabulary.

A BPE of this kind works on each pre-token alone, and pre-tokens repeat. So texts are cut into
pre-tokens with numpy over code points, each distinct pre-token is encoded once by the library, and
ids are gathered for all. Texts with an apostrophe (contractions) or with the special token's string
go to the library whole. A pre-token's identity is its 64-bit polynomial hash; the store of encoded
pre-tokens has a bounded size and starts anew beyond it, which changes no result.
"""

from __future__ import annotations

import numpy as np
import regex

from .textbuf import U64, mix, prefix_hashes, slice_hashes

STORE_ENTRIES = 1_500_000
SPECIAL = "<|endoftext|>"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, 4 apostrophe, for every code point."""
    out = np.full(0x110000, 3, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for value, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = np.where(np.arange(a, b + 1) // 0x800 == 0x1B, out[a : b + 1], value)
    out[39] = 4
    return out


def _pieces_of(library):
    """A function from the bytes of one pre-token to its ids.

    In this kind of vocabulary a merge's rank is the id of what it makes, so the second library can
    merge by the ids of the first; it is much faster on short pieces.
    """
    import tiktoken

    shown = {chr(b): b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown.values())}
    ranks = {bytes(shown[c] for c in token): i for token, i in library.get_vocab(with_added_tokens=False).items() if token != SPECIAL}
    return tiktoken.Encoding("pieces", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Tokens:
    """Encodes lists of texts; one for each Python worker."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path or vocabulary_path())
        self.library.no_padding()
        self.library.no_truncation()
        self.piece = _pieces_of(self.library)
        self.classes = _classes()
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them without special tokens."""
        plain = [i for i, t in enumerate(texts) if t and "'" not in t and SPECIAL not in t]
        out = [None] * len(texts)
        if plain:
            for i, ids in zip(plain, self._gather([texts[i] for i in plain]), strict=True):
                out[i] = ids
        return [self.whole(t) if out[i] is None else out[i] for i, t in enumerate(texts)]

    def _gather(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        starts = self._starts(points, offsets)
        ends = np.append(starts[1:], len(points))
        values = (points.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) | U64(1)
        hashes = mix(slice_hashes(prefix_hashes(values), starts, ends) + (ends - starts).astype(U64))
        uniq, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(uniq, joined, starts, ends, first)
        row = np.searchsorted(self.keys, uniq)
        at, size = self.at[row][back], self.size[row][back]
        upto = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        ids = self.ids[np.repeat(at - upto[:-1], size) + np.arange(upto[-1])]
        return np.split(ids, upto[np.searchsorted(starts, offsets[1:-1])])

    def _learn(self, uniq, joined, starts, ends, first) -> None:
        if len(self.keys) + len(uniq) > STORE_ENTRIES:
            self.forget()
        place = np.searchsorted(self.keys, uniq)
        known = np.zeros(len(uniq), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == uniq[inside]
        new = np.flatnonzero(~known)
        if not len(new):
            return
        piece = self.piece
        got = [piece(joined[a:b].encode()) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for g in got for i in g), np.uint32, int(size.sum()))
        at = len(self.ids) + np.cumsum(size) - size
        place = place[new]
        self.keys, self.at, self.size = np.insert(self.keys, place, uniq[new]), np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.ids = np.concatenate([self.ids, flat])

    def _starts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin.

        A run of letters, of numbers or of other signs is one, with a space directly before it. Of a
        run of white space before something else, the last character stands apart (or, a space, joins
        what follows); at the end of a text the whole run is one.
        """
        kind = self.classes[points]
        n = len(points)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        change |= edge[:n]
        white = kind == 0
        begins = change.copy()
        last = np.empty(n, bool)  # the last white character of a run that something follows in the same text
        last[:-1] = white[:-1] & ~white[1:] & ~edge[1:n]
        last[-1] = False
        begins |= last
        after = np.zeros(n, bool)
        after[1:] = last[:-1] & (points[:-1] == 32)
        begins &= ~after  # the space before belongs to this run
        return np.flatnonzero(begins)
