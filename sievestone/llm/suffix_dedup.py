"""Repeated passages by prefix-free parsing: rolling-hash triggers cut texts into overlapping phrases; the suffixes of the
distinct phrases (the dictionary) and where phrases stand (the parse) together order the corpus to passage length.

Every WINDOW-byte string lies within exactly one phrase: it belongs to the trigger that has the least hash of the
string's K-grams (leftmost of equals), and a phrase is what a trigger's consecutive strings cover, so neighbours
overlap by WINDOW - 1 bytes.  Equal strings have equal triggers, and a string never reaches over its phrase: order to
WINDOW bytes is the dictionary's alone, and the parse adds which document comes first.

0. pack: texts in order of key become chunks of a few MB, one compressed row each.  A chunk holds all rows of its keys,
   or rows of one key alone, so the order of chunks' least keys is the order of their documents;
1. parse: a chunk sends each distinct phrase's hash and each distinct trigger's, once; it is told which phrases a chunk
   before it has too (all their strings go), and which triggers have several phrases in several chunks;
2. dictionary: the phrases of such triggers go as bytes, each from the first chunk that has it, to the bucket of their
   trigger.  There their suffixes are sorted by WINDOW bytes, equal ones by the order of their chunks (suffix, then parse
   rank): neighbours tell whether a string stands in a chunk before.  A trigger of very many phrases has no bucket
   of its own: its phrases are cut into single strings, each of which goes to the bucket of its own hash;
3. remove: a chunk takes both answers, orders its own dictionary for what its own documents share, and removes.

A passage copied in a third of all documents gives one entry for each chunk; nothing goes by row or place.  What consecutive
chunks of a range, a unit, have for one bucket goes as one row and is answered by one: with more input a unit is of more chunks, so
that rows, of which every unit has one for every bucket, are few.  Entries are hashes
(80 bits of a phrase; 48 of a trigger, which only choose what is compared); strings are compared byte by byte.
Every step is a table in the shared folder, and its shuffle files go when it is written.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textops import BYTE_VALUE, U64, mix, prefix_hash, span_hash, spread, texts_of

WINDOW, K = 50, 16
#: Bytes of text of a chunk, of a range of chunks that one task packs, of what meets in one bucket, of one round of hashing.
CHUNK_BYTES, RANGE_BYTES, BUCKET_BYTES, BLOCK_BYTES = 2 << 20, 16 << 20, 8 << 20, 1 << 19
#: Strings that are sorted at a time; a bucket is dealt with in so many slices of its triggers.
SORTED_AT_ONCE, SLICES = 1 << 19, 16
#: A trigger of more phrases than this, counted for each chunk, is hot: its strings are dealt out one by one.
HOT = 4096
#: A unit is of more than one chunk where this many units stay, and of all chunks of a range at most.
UNITS = 128
LAST, FIRST = (1 << 63) - 1, -(1 << 63)
PACKED = "chunk long, ord long, body binary"
ENTRIES = "bucket long, kind int, unit long, blob binary"
REPLIES = "unit long, kind int, bucket long, blob binary"
TOP = ~U64(0xFFFF)
PHRASE, TRIGGER, STRING = 0, 1, 2


# --- parse -----------------------------------------------------------------------------------------------------------
def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents of about BLOCK_BYTES: what the arrays over every byte are made for at a time."""
    d = 0
    while d < len(offsets) - 1:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + BLOCK_BYTES, "right")) - 1)
        yield d, e
        d = e


def phrases(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, ...]:
    """(document number, first string, last string, trigger hash, phrase hash, more bits of it, the trigger's place) of every
    phrase, by place."""
    out = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64, U64, np.int64))]
    for d, e in _blocks(offsets):
        at = int(offsets[d])
        found = _block(data[at : offsets[e]], offsets[d : e + 1] - at, window, k)
        out.append((found[0] + d, found[1] + at, found[2] + at, *found[3:6], found[6] + at))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _block(data: np.ndarray, offsets: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    n, none = len(data), np.zeros(0, np.int64)
    if n < window:
        return none, none, none, *[none.astype(U64)] * 3, none
    prefix = prefix_hash(BYTE_VALUE[data])
    grams = np.arange(n - k + 1)
    trigger = span_hash(prefix, grams, grams + k)
    least = (trigger & U64(0xFFFFFFFF00000000)) | grams.astype(U64)
    wide, need = 1, window - k + 1
    while 2 * wide <= need:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if need > wide:
        least = np.minimum(least[: len(least) - (need - wide)], least[need - wide :])
    anchor = (least & U64(0xFFFFFFFF)).astype(np.int64)  # of the string that starts at each place
    ends = np.maximum(offsets[1:] - window + 1, offsets[:-1])
    owner, rank = spread(ends - offsets[:-1])
    start = offsets[:-1][owner] + rank
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, anchor = start[first], start[last], anchor[first]
    # Triggers are least hashes, so small numbers: mixed again, they fill all buckets alike.
    whole = mix(span_hash(prefix, lo, hi + window) + (anchor - lo).astype(U64) * U64(0xD6E8FEB86659FD93))
    parts = mix(span_hash(prefix, lo, anchor + k) + U64(3) * span_hash(prefix, anchor, hi + window))
    return owner[first], lo, hi, mix(trigger[anchor]), whole, parts, anchor


# --- order -----------------------------------------------------------------------------------------------------------
def ordered(data: np.ndarray, start: np.ndarray, rank: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `start`, sorted by their first `window` bytes and equal ones by rank: (order, whether each begins
    another string than the one before).  Eight bytes at a time, and only among those that are still equal."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(data) + 1,), ">u8", padded, strides=(1,))
    if window < 8:
        key = word[start].astype(U64) >> U64(8 * (8 - window))
    else:
        key = word[start].astype(U64)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(start), bool)
    new[1:] = key[1:] != key[:-1]
    for at in [*range(8, window - 7, 8), *([window - 8] if window > 8 and window % 8 else []), None]:
        group = np.cumsum(new) - 1
        tied = np.flatnonzero((np.bincount(group) > 1)[group]) if len(group) else group
        if not len(tied):
            break
        t = order[tied]
        key = rank[t] if at is None else word[start[t] + at].astype(U64)
        by = np.lexsort((key, group[tied]))
        order[tied], key = t[by], key[by]
        if at is not None:
            new[tied[1:]] |= key[1:] != key[:-1]
    return order, new


def least_ranks(data: np.ndarray, start: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """For each suffix the least rank of those that have the same first `window` bytes."""
    order, new = ordered(data, start, rank, window)
    out = np.empty(len(start), rank.dtype)
    out[order] = rank[order][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    return out


# --- what goes between chunks and buckets -----------------------------------------------------------------------------
def _squeeze(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _planes(x: np.ndarray, low: int) -> bytes:
    """Numbers byte by byte from byte `low` on, first all lowest bytes: like bytes compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8)[:, low:].T).tobytes()


def _from_planes(raw: np.ndarray, n: int, low: int) -> np.ndarray:
    x = np.zeros((n, 8), np.uint8)
    x[:, low:] = raw[: (8 - low) * n].reshape(8 - low, n).T
    return x.view(U64)[:, 0]


#: Lowest bytes of the two numbers of an entry that are left out, by kind.  Phrase: 64 and 16 bits of its hashes; trigger: 48 bits,
#: and 32 bits of its one phrase's hash above the number of its phrases (up to 255).
LOW = {PHRASE: (0, 6), TRIGGER: (2, 3)}


def _bucket(a: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash; never falls where a rises."""
    return ((a >> U64(32)) * U64(buckets)) >> U64(32)


def _parts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each run of equal numbers."""
    if not len(bucket):
        return []
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return list(zip(bucket[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(bucket)], strict=True))


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})


def _head(rows: list | np.ndarray) -> bytes:
    """What a blob begins with: a number of rows and the rows, of one width."""
    rows = np.asarray(rows, np.int64)
    return np.int64(len(rows)).tobytes() + rows.tobytes()


def _headed(blob: pa.Scalar, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the head, the bytes after it) of a blob."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_buffer()), np.uint8)
    end = 8 + 8 * width * int(raw[:8].view(np.int64)[0])
    return raw[8:end].view(np.int64).reshape(-1, width), raw[end:]


def _answers(replies: pa.Table) -> dict[int, list[tuple]]:
    """For each chunk of a unit (kind, bucket, flags) of what it asked there, as far as any flag is set."""
    out = defaultdict(list)
    for kind, bucket, blob in zip(replies["kind"].to_pylist(), replies["bucket"].to_pylist(), replies["blob"], strict=True):
        head, raw = _headed(blob, 2)  # (chunk, number of flags)
        end = np.cumsum(head[:, 1]).tolist()
        flags = np.unpackbits(raw).reshape(2 if kind == TRIGGER else 1, -1)[:, : end[-1]].astype(bool)
        for chunk, i, j in zip(head[:, 0].tolist(), [0, *end[:-1]], end, strict=True):
            if flags[:, i:j].any():
                out[chunk].append((kind, bucket, flags[:, i:j]))
    return out


def meet(entries: pa.Table, hot: int = HOT) -> pa.Table:
    """One bucket of hashes: which of its phrases each chunk is not the first to have; which of its triggers have several
    phrases in several chunks, and which are hot."""
    out = []
    for kind in (PHRASE, TRIGGER):
        here = entries.filter(pc.equal(entries["kind"], kind))
        if not here.num_rows:
            continue
        a, b, heads = [], [], []
        low_a, low_b = LOW[kind]
        for blob in here["blob"]:
            head, raw = _headed(blob, 3)  # (chunk, its place, number of entries)
            n = int(head[:, 2].sum())
            a.append(_from_planes(raw, n, low_a))
            b.append(_from_planes(raw[(8 - low_a) * n :], n, low_b))
            heads.append(head)
        at = np.cumsum([0, *map(len, a)])
        a, b, each = np.concatenate(a), np.concatenate(b), np.concatenate(heads)
        flags = _not_first(a, b, np.repeat(each[:, 1], each[:, 2])) if kind == PHRASE else _several(a, b, hot)
        for k, (unit, bucket) in enumerate(zip(here["unit"].to_pylist(), here["bucket"].to_pylist(), strict=True)):
            mine = [f[at[k] : at[k + 1]] for f in flags]
            if any(m.any() for m in mine):
                out.append((unit, kind, bucket, _squeeze(_head(heads[k][:, [0, 2]]), *[np.packbits(m).tobytes() for m in mine])))
    return _table(out, REPLIES)


def _by_pair(a: np.ndarray, b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Order by (a, b, last).  Most values of a are alone, so only ties are looked at further."""
    order = np.argsort(a)
    s = a[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    tied = np.flatnonzero(same[:-1] | same[1:])
    if len(tied):
        t = order[tied]
        order[tied] = t[np.lexsort((last[t], b[t], a[t]))]
    return order


def _not_first(a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    order = _by_pair(a, b, rank)
    a, b, rank = a[order], b[order], rank[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(a), bool)
    out[order] = rank > rank[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
    return [out]


def _several(a: np.ndarray, b: np.ndarray, many: int) -> list[np.ndarray]:
    order = np.argsort(a)
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    count, fold = (b >> U64(24)) & U64(0xFF), b >> U64(32)
    mixed = (np.bincount(group) > 1) & ((np.maximum.reduceat(count, start) > 1) | (np.minimum.reduceat(fold, start) != np.maximum.reduceat(fold, start)))
    hot = mixed & (np.add.reduceat(count.astype(np.int64), start) > many)
    out = [np.empty(len(a), bool), np.empty(len(a), bool)]
    out[0][order], out[1][order] = mixed[group], hot[group]
    return out


def compare(entries: pa.Table, window: int) -> pa.Table:
    """One bucket of the dictionary: for each chunk, which strings of the phrases that it sent stand in a chunk before it.
    Slice by slice of the triggers: equal strings have equal triggers."""
    sent = []
    for blob in entries["blob"]:
        head, raw = _headed(blob, 2)  # (chunk, its place)
        count = raw[: 4 * SLICES * len(head)].view(np.uint32).astype(np.int64).reshape(SLICES, len(head))
        raw = raw[4 * count.size :]
        size = raw[: 2 * count.sum()].view(np.uint16).astype(np.int64)
        sent.append((head, count, np.cumsum([0, *count.sum(1)]), size, np.concatenate([[0], np.cumsum(size)]), raw[2 * len(size) :]))
    answers: list[list[np.ndarray]] = [[] for _ in sent]
    for s in range(SLICES):
        parts = [(data[at[cut[s]] : at[cut[s + 1]]], size[cut[s] : cut[s + 1]], np.repeat(head[:, 1], count[s])) for head, count, cut, size, at, data in sent]
        data, size, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        owner, rank = spread(size - window + 1)
        start = (np.cumsum(size) - size)[owner] + rank
        own = place[owner]
        hit = least_ranks(data, start, own, window) < own
        each = [int((p[1] - window + 1).sum()) for p in parts]
        for k, x in enumerate(np.split(hit, np.cumsum(each)[:-1])):
            answers[k].append(x)
    out = []
    for k, (unit, bucket) in enumerate(zip(entries["unit"].to_pylist(), entries["bucket"].to_pylist(), strict=True)):
        flat, (head, count, _, size, *_) = np.concatenate(answers[k]), sent[k]
        if flat.any():
            chunk = np.repeat(np.repeat(np.tile(np.arange(len(head)), SLICES), count.ravel()), size - window + 1)
            flat = flat[np.argsort(chunk, kind="stable")]  # from slice by slice to chunk by chunk
            out.append((unit, STRING, bucket, _squeeze(_head(np.stack([head[:, 0], np.bincount(chunk, minlength=len(head))], axis=1)), np.packbits(flat).tobytes())))
    return _table(out, REPLIES)


# --- a chunk ----------------------------------------------------------------------------------------------------------
class Chunk:
    """The documents of one chunk, its distinct phrases and triggers."""

    def __init__(self, body: bytes, buckets: int, window: int) -> None:
        self.batch = pa.ipc.open_stream(body).read_all()
        self.data, self.offsets = texts_of(self.batch["_text"])
        self.doc_id = self.batch["_doc"].to_numpy()
        self.window, self.buckets = window, buckets
        self.doc, self.lo, self.hi, trigger, full, more, _ = phrases(self.data, self.offsets, window)
        more &= TOP << U64(32)
        doc = self.doc_id[self.doc]
        order = _by_pair(full, more, doc)
        full, more = full[order], more[order]
        new = np.ones(len(full), bool)
        new[1:] = (full[1:] != full[:-1]) | (more[1:] != more[:-1])
        self.which = np.empty(len(full), np.int64)  # of each phrase of the parse, its number in the dictionary
        self.which[order] = np.cumsum(new) - 1
        self.place = order[new]  # where the dictionary's phrase stands first
        self.full, self.more, self.least = full[new], more[new], doc[self.place]
        self.trigger, self.of = np.unique(trigger[self.place] & TOP, return_inverse=True)
        self.count = np.bincount(self.of, minlength=len(self.trigger))

    def hashes(self) -> list[tuple]:
        """(bucket, kind, one number of each entry, the other) of its phrases and triggers."""
        fold = np.zeros(len(self.trigger), U64)
        fold[self.of] = self.full & U64(0xFFFFFFFF00000000)
        both = ((PHRASE, self.full, self.more), (TRIGGER, self.trigger, fold | (np.minimum(self.count, 255).astype(U64) << U64(24))))
        return [(x, kind, a[i:j], b[i:j]) for kind, a, b in both for x, i, j in _parts(_bucket(a, self.buckets))]

    def told(self, replies: list[tuple]) -> None:
        """Takes what buckets say of phrases and triggers.  replies: (kind, bucket, flags)."""
        self.earlier, mixed, hot = np.zeros(len(self.full), bool), np.zeros(len(self.trigger), bool), np.zeros(len(self.trigger), bool)
        parts = {kind: {x: (i, j) for x, i, j in _parts(_bucket(a, self.buckets))} for kind, a in ((PHRASE, self.full), (TRIGGER, self.trigger))}
        for kind, bucket, flags in replies:
            if kind in parts:
                i, j = parts[kind][bucket]
                if kind == PHRASE:
                    self.earlier[i:j] = flags[0]
                else:
                    mixed[i:j], hot[i:j] = flags
        ask = mixed[self.of] & ~self.earlier
        self.asked, self.hot = np.flatnonzero(ask & ~hot[self.of]), np.flatnonzero(ask & hot[self.of])

    def _strings(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number in chosen, place) of every string of these phrases of the dictionary."""
        at = self.place[chosen]
        owner, rank = spread(self.hi[at] - self.lo[at] + 1)
        return owner, self.lo[at][owner] + rank

    def sent(self) -> tuple[np.ndarray, ...]:
        """(key, start, end, phrase, how far into it) of what goes to buckets of the dictionary, by key: whole phrases by
        trigger, hot ones' strings by their hash."""
        at = self.place[self.asked]
        owner, place = self._strings(self.hot)
        hashed = np.zeros(len(place), U64)
        for d, e in _blocks(self.offsets) if len(place) else ():
            here = np.flatnonzero((place >= self.offsets[d]) & (place < self.offsets[e]))
            p = place[here] - self.offsets[d]
            hashed[here] = span_hash(prefix_hash(BYTE_VALUE[self.data[self.offsets[d] : self.offsets[e]]]), p, p + self.window)
        phrase = np.concatenate([self.asked, self.hot[owner]])
        key = np.concatenate([mix(self.trigger[self.of[self.asked]]), hashed])
        start, end = np.concatenate([self.lo[at], place]), np.concatenate([self.hi[at] + self.window, place + self.window])
        order = np.argsort(key, kind="stable")
        return tuple(x[order] for x in (key, start, end, phrase, start - self.lo[self.place[phrase]]))

    def dictionary(self) -> list[tuple]:
        """(bucket, kind, slice of each of its strings' phrases, its bytes, all their bytes)."""
        key, start, end, *_ = self.sent()
        size, out = end - start, []
        slices = (_bucket(key, self.buckets * SLICES) % U64(SLICES)).astype(np.int64)
        for x, i, j in _parts(_bucket(key, self.buckets)):
            owner, at = spread(size[i:j])
            out.append((x, STRING, slices[i:j], size[i:j], self.data[start[i:j][owner] + at]))
        return out

    def removed(self, replies: list[tuple]) -> np.ndarray:
        """Whether each byte is covered by a string that also starts in a document with a smaller key."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        own = self.doc_id[self.doc]
        gone = self.earlier[self.which] | (self.least[self.which] < own)
        np.add.at(edge, self.lo[gone], 1)
        np.add.at(edge, self.hi[gone] + self.window, -1)
        # Least key known for each string of the phrases that share theirs: FIRST where a chunk before has it.
        several = (self.count > 1)[self.of] & ~self.earlier
        several[self.asked] = several[self.hot] = True
        chosen = np.flatnonzero(several)
        chosen = chosen[np.argsort(self.of[chosen], kind="stable")]  # by trigger
        owner, place = self._strings(chosen)
        first = np.full(len(several), -1, np.int64)
        size = np.bincount(owner, minlength=len(chosen))
        first[chosen] = np.cumsum(size) - size
        least = self.least[chosen][owner]
        i, trigger = 0, self.of[chosen][owner]
        while i < len(place):  # as many triggers at a time as make SORTED_AT_ONCE strings
            j = min(len(place), i + SORTED_AT_ONCE)
            j = int(np.searchsorted(trigger, trigger[j - 1], "right"))
            least[i:j] = least_ranks(self.data, place[i:j], least[i:j], self.window)
            i = j
        if replies:
            key, start, end, phrase, skip = self.sent()
            parts = {x: (i, j) for x, i, j in _parts(_bucket(key, self.buckets))}
            at = np.concatenate([[0], np.cumsum(end - start - self.window + 1)])
            for _, bucket, flags in replies:
                hit = np.flatnonzero(flags[0]) + at[parts[bucket][0]]
                k = np.searchsorted(at, hit, "right") - 1
                least[first[phrase[k]] + skip[k] + hit - at[k]] = FIRST
        ask = np.flatnonzero(several[self.which] & ~gone)
        owner, rank = spread(self.hi[ask] - self.lo[ask] + 1)
        hit = least[first[self.which[ask]][owner] + rank] < own[ask][owner]
        here = (self.lo[ask][owner] + rank)[hit]
        np.add.at(edge, here, 1)
        np.add.at(edge, here + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


# --- a unit -----------------------------------------------------------------------------------------------------------
def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(unit, its chunks' (chunk, place, body)), as far as they come one after another."""
    unit, held = None, []
    for b in batches:
        for now, *row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            if now != unit and held:
                yield unit, held
                held = []
            unit = now
            held.append(tuple(row))
    if held:
        yield unit, held


def _entries(unit: int, found: list[tuple[int, int, list[tuple]]]) -> pa.Table:
    """One row for each bucket and kind of what the chunks of a unit have for it.  found: (chunk, its place, what it has)."""
    held = defaultdict(list)
    for chunk, rank, parts in found:
        for bucket, kind, *what in parts:
            held[bucket, kind].append((chunk, rank, *what))
    rows = []
    for (bucket, kind), own in held.items():
        chunk, rank, *what = zip(*own, strict=True)
        if kind == STRING:
            which = np.repeat(np.arange(len(own)), [len(x) for x in what[0]])
            slices, size, data = (np.concatenate(x) for x in what)
            order = np.argsort(slices, kind="stable")
            if len(own) > 1:
                owner, at = spread(size[order])
                data = data[(np.cumsum(size) - size)[order][owner] + at]
            count = np.bincount(slices * len(own) + which, minlength=SLICES * len(own))
            blob = _squeeze(_head(list(zip(chunk, rank, strict=True))), count.astype(np.uint32).tobytes(), size[order].astype(np.uint16).tobytes(), data.tobytes())
        else:
            a, b = (np.concatenate(x) for x in what)
            low_a, low_b = LOW[kind]
            blob = _squeeze(_head(list(zip(chunk, rank, map(len, what[0]), strict=True))), _planes(a, low_a), _planes(b, low_b))
        rows.append((bucket, kind, unit, blob))
    return _table(rows, ENTRIES)


# --- plan -------------------------------------------------------------------------------------------------------------
class _Packer:
    """Chunks of one range of rows that come in order of key."""

    def __init__(self, limit: int) -> None:
        self.limit, self.made, self.done = limit, 0, []
        self.before, self.before_bytes = [], 0  # (batch, start, end) of whole keys
        self.own, self.own_bytes = [], 0  # of the last key
        self.key, self.alone = None, False

    def add(self, batch: pa.RecordBatch, i: int, j: int, key: int, size: int) -> None:
        """Rows of one key."""
        if key != self.key:
            first = self.key is None
            self._turn()
            self.key, self.alone = key, first  # a range's first key may have begun in the one before
        if self.own and self.own_bytes + size > self.limit:  # more than a chunk of one key
            self._close(self.before)
            self._close(self.own)
            self.before, self.before_bytes, self.own, self.own_bytes, self.alone = [], 0, [], 0, True
        self.own.append((batch, i, j))
        self.own_bytes += size

    def _turn(self) -> None:
        if self.alone:
            self._close(self.own)
        else:
            for batch, i, j in self.own:
                if self.before and self.before[-1][0] is batch and self.before[-1][2] == i:
                    self.before[-1] = (batch, self.before[-1][1], j)
                else:
                    self.before.append((batch, i, j))
            self.before_bytes += self.own_bytes
            if self.before_bytes >= self.limit:
                self._close(self.before)
                self.before, self.before_bytes = [], 0
        self.own, self.own_bytes = [], 0

    def end(self) -> None:
        """A range's last key may go on in the next one: its rows are alone too."""
        self._close(self.before)
        self._close(self.own)

    def _close(self, parts: list[tuple]) -> None:
        if parts:
            t = pa.Table.from_batches([b.slice(i, j - i) for b, i, j in parts]).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
                w.write_table(t)
            self.done.append(((TaskContext.get().partitionId() << 32) + self.made, t["_doc"][0].as_py(), sink.getvalue().to_pybytes()))
            self.made += 1

    def ready(self) -> Iterator[pa.RecordBatch]:
        for row in self.done:
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.binary())], ["chunk", "ord", "body"])
        self.done = []


def _pack(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    packer = _Packer(limit)
    for b in batches:
        doc, size = b.column("_doc").to_numpy(), b.column("_bytes").to_numpy()
        b = b.drop_columns(["_bytes"])
        edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])).tolist() if len(doc) else []
        for i, end in zip(edge, [*edge[1:], len(doc)], strict=True):
            while i < end:  # rows of one key, cut where they are many
                j = i + 1 if end == i + 1 else i + max(1, int(np.searchsorted(np.cumsum(size[i:end]), limit, "right")))
                packer.add(b, i, j, int(doc[i]), int(size[i:j].sum()))
                i = j
        yield from packer.ready()
    packer.end()
    yield from packer.ready()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = False, drop_emptied: bool = False, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a `window`-byte string that also starts in a document with a smaller key.

    Texts are UTF-8 bytes; matches never cross documents; strings are judged on the input.  One row for each row:
    (key, n_bytes, n_removed, n_spans, kept_sha256), or with keep_text the columns of docs, `text` without what was
    removed (a character stays whole if any of its bytes stays).  Null text is like an empty one; with keep_text null and empty
    texts stay as they are, and drop_emptied leaves out rows of which nothing is left.  Null keys count as larger than all others; rows of
    equal keys, repeats included, don't take from each other.  Extra columns of any name are carried by number.  One text
    longer than a chunk is a chunk alone.  hot: phrases of one trigger beyond which its strings are dealt out one by one.  An empty table gives an empty one.
    """
    limit, bucket_bytes = CHUNK_BYTES, BUCKET_BYTES
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = total // bucket_bytes + 1
    carried = [c for c in docs.columns if c != text] if keep_text else [key]
    rows = docs.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(carried)], F.col(text).alias("_text"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("_doc"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("_bytes"), F.spark_partition_id().alias("_salt"))
    # Many rows of one key, null or not, are dealt to several ranges by what else they have.
    dealt = rows.repartitionByRange(int(total // RANGE_BYTES + 1), "_doc", F.xxhash64("_text"), "_salt").sortWithinPartitions("_doc").drop("_salt")
    packed = materialize(dealt.mapInArrow(lambda batches: _pack(batches, limit), PACKED), "chunks")

    each = max(1, min(RANGE_BYTES // limit, int(total // limit // UNITS)))
    packed = packed.select((F.shiftleft(F.shiftright("chunk", 32), 32) + F.floor(F.col("chunk").bitwiseAND(0xFFFFFFFF) / each)).alias("unit"), "chunk", "ord", "body")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in _units(batches):
            found = [(chunk, rank, Chunk(body.as_buffer(), buckets, window).hashes()) for chunk, rank, body in rows]
            yield from _entries(unit, found).to_batches()

    def told(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, int, Chunk, list[tuple]]]:
        answers = _answers(right)
        for chunk, rank, body in zip(left["chunk"].to_pylist(), left["ord"].to_pylist(), left["body"], strict=True):
            c, replies = Chunk(body.as_buffer(), buckets, window), answers.get(chunk, [])
            c.told([r for r in replies if r[0] != STRING])
            yield chunk, rank, c, [r for r in replies if r[0] == STRING]

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table([], ENTRIES)
        return _entries(left["unit"][0].as_py(), [(chunk, rank, c.dictionary()) for chunk, rank, c, _ in told(left, right)])

    out = docs.schema if keep_text else f"{key} {dict(docs.dtypes)[key]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.concat_tables([cleaned(c, replies) for _, _, c, replies in told(left, right)])

    def cleaned(c: Chunk, replies: list[tuple]) -> pa.Table:
        gone, at = c.removed(replies), c.offsets
        if keep_text:
            first = (c.data & 0xC0) != 0x80
            stays = np.bincount((np.cumsum(first) - 1)[~gone], minlength=int(first.sum())) > 0
            keep = stays[np.cumsum(first) - 1]
            texts = [c.data[a:b][keep[a:b]].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]
            null = c.batch["_text"].is_null().to_pylist()
            columns = {name: c.batch[f"_c{k}"] for k, name in enumerate(carried)}
            columns[text] = pa.array([None if x else t for t, x in zip(texts, null, strict=True)], pa.string())
            whole = pa.table({name: columns[name] for name in docs_columns})
            return whole.filter(pa.array([bool(t) or a == b for t, a, b in zip(texts, at[:-1], at[1:], strict=True)])) if drop_emptied else whole
        size = np.diff(at)
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[at[:-1][size > 0]] = gone[at[:-1][size > 0]]
        spans = np.concatenate([[0], np.cumsum(begins)])
        kept = [hashlib.sha256(c.data[a:b][~gone[a:b]]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.table({key: c.batch["_c0"], "n_bytes": pa.array(size), "n_removed": pa.array(total[at[1:]] - total[at[:-1]]), "n_spans": pa.array(spans[at[1:]] - spans[at[:-1]]), "kept_sha256": pa.array(kept, pa.string())})

    docs_columns = docs.columns

    def of_chunks(f: Callable[[pa.Table, pa.Table], pa.Table], replies: DataFrame, schema: object) -> DataFrame:
        return packed.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(f, schema)

    known = materialize(packed.mapInArrow(parse, ENTRIES).groupBy("bucket").applyInArrow(lambda t: meet(t, hot), REPLIES), "known")
    shared = materialize(of_chunks(ask, known, ENTRIES).groupBy("bucket").applyInArrow(lambda t: compare(t, window), REPLIES), "shared")
    return of_chunks(remove, known.unionByName(shared), out)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller document has too; those of which nothing stays go.  Rows as dedup() has
    them: null and empty texts and null ids stay, rows of one id don't take from each other; n_chars is counted anew."""
    out = dedup(docs, keep_text=True, drop_emptied=True)
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
