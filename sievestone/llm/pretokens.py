"""Pre-tokens of a byte-level tokenizer for many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from .textops import code_points, word_hashes

SPACE, BLANK, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 4, 255


class Pretokens:
    """Cuts texts as the library's byte-level pre-tokenizer does: contractions, runs of letters, numbers or other
    characters with at most one space before, and white space.  What kind a character is, the library itself is asked,
    once for each character that occurs, so that both have the same Unicode version."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.kind = tokenizer, np.full(0x110000, UNKNOWN, np.uint8)
        self.special = sorted((t.content for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.kind[32] = SPACE

    def _ask(self, c: str) -> int:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for probe, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)):
            if len(cut(probe + c)) == 1:
                return kind
        return BLANK

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code points, starts, ends, text number) of every pre-token.  Texts hold no special strings."""
        cp, at = code_points(data, offsets)
        n = len(cp)
        kind = self.kind[cp]
        if (kind == UNKNOWN).any():
            for c in np.unique(cp[kind == UNKNOWN]):
                self.kind[c] = self._ask(chr(c))
            kind = self.kind[cp]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        group = np.where(kind == SPACE, BLANK, kind)
        start = edge[:-1].copy()
        start[1:] |= group[1:] != group[:-1]
        begun = start.copy()
        # The last white-space character before another kind stands alone, or with what follows if it is a space.
        follows = np.flatnonzero((group[:-1] == BLANK) & (group[1:] != BLANK) & ~edge[1:-1]) if n else np.zeros(0, np.int64)
        start[follows] = True
        start[follows[kind[follows] == SPACE] + 1] = False
        # Contractions: an apostrophe that begins a pre-token, alone of its kind, before one of a few letters.
        quote = np.flatnonzero((cp[:-1] == 39) & begun[:-1] & start[:-1] & (kind[1:] == LETTER) & ~edge[1:-1]) if n else follows
        if len(quote):
            one, two = cp[quote + 1], np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], cp[np.minimum(quote + 2, n - 1)], 0)
            short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
            long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            start[quote[short | long] + 1] = False
            for hit, size in ((quote[short], 2), (quote[long], 3)):
                start[(hit + size)[hit + size < n]] = True
        begin = np.flatnonzero(start)
        return cp, begin, np.append(begin[1:], n), np.searchsorted(at, begin, "right") - 1

    @staticmethod
    def hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each pre-token, given by its bytes: one to look it up by, one to be sure of it."""
        return word_hashes(data, begin, end, check=True)


@lru_cache(maxsize=2)
def load(path: str) -> Pretokens:
    """One for each worker process and file."""
    return Pretokens(Tokenizer.from_file(path))
