"""Byte-pair encoding of many words in lockstep: an agenda for each word, one step of all agendas at a time."""

from __future__ import annotations

import heapq

import numpy as np

from .textops import U64, mix, spread

NONE = np.int32(1 << 30)
#: Words of more symbols than this take the one-word agenda.
WIDE = 64
#: Words are stepped in blocks of one width, small enough for a processor's cache.
WIDTHS, ROWS = (3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, WIDE), 1 << 13


class Merges:
    """Which pair of symbol ids merges, in which order, into what: a hash table with open addressing.

    left, right: symbol ids below 65,536; order: a rank for each pair, lower first; result: by rank.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, order: np.ndarray, result: np.ndarray) -> None:
        self.result = np.asarray(result, np.int32)
        size = 1 << max(12, int(4 * len(left)).bit_length())
        self.mask, self.keys, self.ranks = np.int64(size - 1), np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        keys = (np.asarray(left, np.int64) << 16) | np.asarray(right, np.int64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] < 0
            _, one = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            one = one[free[one]]
            self.keys[at[one]], self.ranks[at[one]] = keys[todo[one]], np.asarray(order)[todo[one]]
            left_over = np.ones(len(todo), bool)
            left_over[one] = False
            todo, at = todo[left_over], (at[left_over] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * 0x2545F4914F6CDD1D) >> 20) & self.mask

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it doesn't merge.  Negative ids never merge."""
        keys = (left.astype(np.int64) << 16) | right
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.ranks[at], NONE)
        if len(open_ := np.flatnonzero((got != keys) & (got >= 0))):
            k, a = keys[open_], at[open_]
            while len(open_):
                a = (a + 1) & self.mask
                got = self.keys[a]
                hit = got == k
                out[open_[hit]] = self.ranks[a[hit]]
                more = ~hit & (got >= 0)
                open_, k, a = open_[more], k[more], a[more]
        bad = (left < 0) | (right < 0)
        out[bad] = NONE
        return out

    def agenda(self, symbols: list[int], key: int = 0, limit: int = 0) -> list[int]:
        """One word: a heap of (rank, position) over a linked list.  As encode(), pop by pop."""
        n = len(symbols)
        s, nxt, prev = list(symbols), [*range(1, n), -1], [-1, *range(n - 1)]
        rank = self.find(np.array(s[:-1], np.int64), np.array(s[1:], np.int64)).tolist() + [int(NONE)]
        heap = [(r, i) for i, r in enumerate(rank) if r < NONE]
        heapq.heapify(heap)
        step = 0
        none = int(NONE)
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            step += 1
            if limit and int(_dropped_key(np.array([key], U64), step, np.array([r], np.int32))[0]) < limit:
                rank[i] = none
                continue
            j = nxt[i]
            s[i], rank[j] = int(self.result[r]), none
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for a, b in ((prev[i], i), (i, nxt[i])):
                if a >= 0:
                    rank[a] = none
                    if b >= 0 and (q := int(self.find(np.array([s[a]]), np.array([s[b]]))[0])) < NONE:
                        rank[a] = q
                        heapq.heappush(heap, (q, a))
        out, i = [], 0
        while i >= 0 and n:
            out.append(s[i])
            i = nxt[i]
        return out

    def encode(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray | None = None, dropout: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has) for words symbols[start:end], which lie one behind the other.

        At each step every word's best candidate (lowest rank, then leftmost) is taken from its agenda.  With dropout,
        it is skipped where the hash of (the word's key, step, rank) falls below dropout; a skipped candidate comes
        back only if a neighbour's merge makes it anew.
        """
        limit = int(dropout * 2.0**64) if dropout else 0
        limit = min(limit, (1 << 64) - 1)
        length = end - start
        counts = length.copy()
        out = symbols.astype(np.int32)  # each word's ids are written over the first of its own symbols
        low = 1
        for high in WIDTHS:
            rows = np.flatnonzero((length > low) & (length <= high))
            for at in range(0, len(rows), ROWS):
                self._lockstep(symbols, start, length, rows[at : at + ROWS], high, keys, limit, out, counts)
            low = high
        for w in np.flatnonzero(length > WIDE):
            ids = self.agenda(symbols[start[w] : end[w]].tolist(), int(keys[w]) if keys is not None else 0, limit)
            out[start[w] : start[w] + len(ids)], counts[w] = ids, len(ids)
        # Of a word's symbols the first `counts` are its ids; words lie one behind the other.
        owner, rank = spread(length)
        return out[rank < counts[owner]], counts

    def _lockstep(self, symbols, start, length, rows, width, keys, limit, out, counts) -> None:
        """A column for each word, a row for each place in it, so that every operation runs along many words."""
        first, size = start[rows], length[rows]
        place = np.arange(width)[:, None]
        s = np.where(place < size, symbols[np.minimum(first + place, len(symbols) - 1)], -1).astype(np.int32)
        r = np.full(s.shape, NONE, np.int32)
        r[:-1] = self.find(s[:-1].ravel(), s[1:].ravel()).reshape(width - 1, -1)
        own = keys[rows] if keys is not None else None
        word, left, done, n, step = np.arange(len(rows)), size.copy(), s.copy(), size.copy(), 0
        while True:
            step += 1
            rank = r.min(0)
            live = rank < NONE
            if (alive := np.count_nonzero(live)) < 0.75 * len(live):
                done[:, word], n[word] = s, left
                if not alive:
                    break
                s, r, rank, left, word = s[:, live], r[:, live], rank[live], left[live], word[live]
                own = own[live] if own is not None else None
                live = np.ones(alive, bool)
            at = np.full(len(word), width, np.int32)
            for j in range(width - 2, -1, -1):
                np.copyto(at, j, where=r[j] == rank)
            go = live
            if limit:
                drop = _dropped_key(own, step, rank) < U64(limit)
                go = live & ~drop
                d = np.flatnonzero(live & drop)
                r[at[d], d] = NONE
            np.copyto(at, width, where=~go)
            g = np.flatnonzero(go)
            if not len(g):
                continue
            a = at[g]
            s[a, g] = self.result[rank[g]]
            for j in range(int(a.min()) + 1, width):
                later = at < j
                np.copyto(s[j], s[j + 1] if j + 1 < width else -1, where=later)
                np.copyto(r[j], r[j + 1] if j + 1 < width else NONE, where=later)
            left[g] -= 1
            new = s[a, g]
            r[a, g] = self.find(new, np.where(a + 1 < width, s[np.minimum(a + 1, width - 1), g], -1))
            has = np.flatnonzero(a > 0)
            r[a[has] - 1, g[has]] = self.find(s[a[has] - 1, g[has]], new[has])
        inside = place < n
        out[(first + place)[inside]] = done[inside]
        counts[rows] = n


def _dropped_key(keys: np.ndarray, step: int, rank: np.ndarray) -> np.ndarray:
    return mix(keys + U64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) + rank.astype(U64) * U64(0xBF58476D1CE4E5B9))
