"""MinHash near-duplicates by a chosen-path set similarity join.

Documents of one shingle set are one class.  Each of several independent trees branches classes by minwise tokens:
a node picks one coordinate of the sketch, or two, and a class goes on, for each, to the child named by its token
there.  With about 1 / threshold branches, pairs below the threshold part company level by level and pairs above it
stay together.  Nodes are split until they are small, then compared exhaustively; what stays large at the last level is
a family of near copies and is compared in blocks that all hold its leaders.  Sketches only choose who meets whom: within
a block, full shingle sets confirm links until what is linked is connected, so a family of m copies gives m links, not m
squared.  Where a large node is still in several components (copies of one template that are not quite near), its classes
are joined by prefixes of their full sets: shingles in one order of about their frequency, rarest first, of which two sets above
the threshold t share one that is among the first (1 - t) n + 1 of the larger set and the first (1 - 2 t / (1 + t)) n + 1
of the other.  That join is exact, and classes that only have a template in common don't meet.  Two classes that share many
such shingles are compared for the first of them alone, by sketches; texts go only for those that are near another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_broadcast, drop_materialized, materialize, small_batches
from .textops import LOWER, NOT_SPACE, U64, mix, runs, spread, texts_of, word_hashes

SIZE = 128  # coordinates of a sketch: 16 bits each where nodes are chosen, the lower 2 where sketches are compared
TREES, LEVELS = 8, 4
NODE, LEADERS = 64, 3  # classes that are compared exhaustively; those of a large node that are in all its blocks
#: Pairs are proposed from this many standard deviations of the sketch's estimate below the threshold.
SLACK = 3.3
#: Classes of a part of a large group of the second join; of a class's groups there, how many go with it.
PART, CARRIED = 512, 16
#: Pairs of a block from which on bounds are taken, and shingles that the bounds count one by one.
MANY, COLUMNS = 512, 4096
#: Pairs of a block of the second join that are compared at once.
AT_ONCE = 1 << 17
#: Counters by which the second join orders shingles; their sum is held by every task.
COUNTERS = 1 << 16
#: Bits of the filter that leaves out most texts that are not asked for: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
LAST = (1 << 63) - 1
ROWS_PER_BIN, BYTES_PER_BIN = 20_000, 4 << 20
_SEEDS = mix(np.arange(1, 2 * SIZE + 1, dtype=U64) * U64(0xA0761D6478BD642F)).astype(np.uint32)
_ADD, _MUL = _SEEDS[:SIZE], _SEEDS[SIZE:] | np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of the distinct k-word shingles of every document, by document and hash.  A document of
    fewer words has its whole sequence as the one shingle; without words it has none."""
    low = LOWER[data]
    begin, end, doc = runs(NOT_SPACE[low], offsets)
    (word,) = word_hashes(low, begin, end)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    size = np.where(count >= k, count - k + 1, 0)
    owner, rank = spread(size)
    at = first[owner] + rank
    full = np.zeros(len(at), U64)
    for j in range(k):
        full = mix(full * U64(3) + word[at + j])
    few = np.flatnonzero((count > 0) & (count < k))
    short = np.zeros(len(few), U64)
    for j in range(k - 1):
        has = count[few] > j
        short[has] = mix(short[has] * U64(3) + word[first[few[has]] + j])
    short = mix(short ^ count[few].astype(U64) ^ U64(0x5851F42D4C957F2D))
    owner, full = np.concatenate([owner, few]), np.concatenate([full, short])
    order = np.lexsort((full, owner))
    owner, full = owner[order], full[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (full[1:] != full[:-1])
    return owner[new], full[new]


def sketches(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set size, two hashes of the set, sketch) of each of n documents."""
    count = np.bincount(owner, minlength=n)
    full = np.flatnonzero(count)
    start = (np.cumsum(count) - count)[full]
    one, two, sketch = np.zeros(n, U64), np.zeros(n, U64), np.zeros((n, SIZE), np.uint16)
    if len(full):
        one[full] = np.add.reduceat(mix(values + U64(11)), start)
        two[full] = np.add.reduceat(mix(values ^ U64(0xDEADBEEFCAFEF00D)), start)
        v = (values >> U64(32)).astype(np.uint32)
        for j in range(SIZE):
            sketch[full, j] = np.minimum.reduceat((v ^ _ADD[j]) * _MUL[j], start) & np.uint32(0xFFFF)
    return count, one, two, sketch


def _signatures(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = texts_of(b.column(2))
            count, one, two, sketch = sketches(*shingle_sets(data, offsets, k), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _binary(sketch), _binary(_narrow(sketch))], ["doc", "th", "n", "one", "two", "wide", "sketch"])

    return docs.select("doc", "th", "text").mapInArrow(run, "doc long, th long, n long, one long, two long, wide binary, sketch binary")


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.itemsize * rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _narrow(sketch: np.ndarray) -> np.ndarray:
    """The lower two bits of every coordinate, 32 to a 64-bit number."""
    parts = (sketch & 3).astype(U64).reshape(len(sketch), SIZE // 32, 32) << np.arange(0, 64, 2, dtype=U64)
    return np.bitwise_or.reduce(parts, axis=2)


def _matrix(column: pa.Array, width: int, kind: type = U64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _children(nodes: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(child, row): where each row goes on from its node.  The node alone chooses the coordinates: one, and for so many of
    the nodes a second one that there are 1 / threshold on average."""
    out, rows = [], []
    second = mix(nodes ^ U64(0x2545F4914F6CDD1D)) < U64(int(min(0.99, 1 / threshold - 1) * 2**64))
    for c in range(2):
        row = np.flatnonzero(second) if c else np.arange(len(nodes))
        at = mix(nodes[row] * U64(2) + U64(c + 1))
        coordinate = (at % U64(SIZE)).astype(np.int64)
        out.append(mix(at ^ (sketch[row, coordinate].astype(U64) * U64(0x9E3779B97F4A7C15))))
        rows.append(row)
    return np.concatenate(out), np.concatenate(rows)


def _branch(rows: DataFrame, root: bool, threshold: float) -> DataFrame:
    """(node, v) one level below, each once by construction.  rows: (v, wide), and node unless root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, sketch = b.column(0), _matrix(b.column(1), SIZE, np.uint16)
            if root:
                tree = np.repeat(mix(np.arange(1, TREES + 1, dtype=U64)), b.num_rows)
                child, row = _children(tree, np.tile(sketch, (TREES, 1)), threshold)
                row = row % b.num_rows
            else:
                child, row = _children(b.column(2).to_numpy().view(U64), sketch, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), v.take(pa.array(row))], ["node", "v"])

    columns = ["v", "wide"] + ([] if root else ["node"])
    return rows.select(*columns).mapInArrow(run, "node long, v long")


def _sized(rows: DataFrame, key: str, worth: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of small groups, rows of large ones), each with its group's size; groups that are not `worth` it, one of a
    kind, are left out.  Large groups are few: told first, their rows take no part in the shuffle join of the others."""
    counts = materialize(rows.groupBy(key).agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high"), F.count_if("index").alias("indexed")).filter(worth).select(key, "size"), "sizes")
    many = bounded_broadcast(counts.filter(F.col("size") > NODE))
    large = materialize(rows.join(many, key), "large")
    small = materialize(rows.join(many.select(key), key, "left_anti").join(counts.filter(F.col("size") <= NODE), key), "small")
    drop_materialized(counts)
    return small, large


def _tree_nodes(classes: DataFrame, threshold: float) -> DataFrame:
    """(node, size, v): membership in the nodes that are compared.  Nodes of one class have nothing to compare."""
    found, now = None, _branch(classes, True, threshold)
    for level in range(1, LEVELS + 1):
        now = materialize(now, "level")
        small, large = _sized(now.withColumns({"component": F.col("v"), "index": F.lit(True)}), "node", F.col("size") > 1)
        drop_materialized(now)
        found = small if found is None else found.unionByName(small)
        if not large.head(1):
            break
        if level == LEVELS:
            found = found.unionByName(large)
        else:
            now = _branch(large.join(classes.select("v", "wide"), "v"), False, threshold)
    return found.select("node", "size", "v")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(node, v, blocks, salt): a large node's classes are dealt to blocks of about NODE."""
    count = F.when(F.col("size") > NODE, F.ceil(F.col("size") / NODE)).otherwise(1)
    return nodes.withColumn("blocks", count).drop("size").withColumn("salt", F.pmod(F.xxhash64("v", "node"), F.col("blocks")))


def _led(blocks: DataFrame) -> DataFrame:
    """(block, v): every block of a large node holds its leaders too."""
    large = blocks.filter("blocks > 1").groupBy("node", "blocks").agg(*[F.min_by("v", F.xxhash64("v", F.lit(k))).alias(f"l{k}") for k in range(LEADERS)])
    leaders = large.select("node", "blocks", F.explode(F.array(*[f"l{k}" for k in range(LEADERS)])).alias("v")).select("node", "v", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("salt"))
    return blocks.select("node", "v", "salt").unionByName(leaders).select(F.xxhash64("node", "salt").alias("block"), "v").distinct()


def _pairs(block: np.ndarray, n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one block whose set sizes allow the threshold.  Rows are sorted by block."""
    end = np.searchsorted(block, block, "right")
    i, rank = spread(end - np.arange(len(block)) - 1)
    j = i + 1 + rank
    fits = np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
    return i[fits], j[fits]


def _alike(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    expected = threshold + (1 - threshold) / 4  # two bits agree by chance in a quarter of the rest
    cut = expected - SLACK * (expected * (1 - expected) / SIZE) ** 0.5
    likely = np.zeros(len(i))
    for x in range(0, len(i), 65536):
        differ = sketch[i[x : x + 65536]] ^ sketch[j[x : x + 65536]]
        likely[x : x + 65536] = 1 - np.bitwise_count((differ | (differ >> U64(1))) & U64(0x5555555555555555)).sum(1) / SIZE
    keep = likely >= cut
    return i[keep], j[keep], likely[keep]


def _may_link(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], numerator: int, denominator: int) -> np.ndarray:
    """Whether sets i and j can be linked, by what they share of the COLUMNS shingles that most sets here have, and as many of
    the others as both could share.  It leaves out no pair that is linked."""
    use, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    i, j = at[: len(i)], at[len(i) :]
    size = np.array([len(sets[x]) for x in use])
    _, column, times = np.unique(np.concatenate([sets[x] for x in use]), return_inverse=True, return_counts=True)
    most = np.argsort(-times, kind="stable")[: min(COLUMNS, np.count_nonzero(times > 1))]
    place = np.full(len(times), -1)
    place[most] = np.arange(len(most))
    owner, at = np.repeat(np.arange(len(use)), size), place[column]
    rest = np.bincount(owner[(at < 0) & (times[column] > 1)], minlength=len(use))
    has = np.zeros((len(use), -(-len(most) // 64) * 64), bool)
    has[owner[at >= 0], at[at >= 0]] = True
    bits, keep = np.packbits(has, axis=1).view(U64), np.zeros(len(i), bool)
    for x in range(0, len(i), 1 << 14):
        a, b = i[x : x + (1 << 14)], j[x : x + (1 << 14)]
        both = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64) + np.minimum(rest[a], rest[b])
        keep[x : x + (1 << 14)] = denominator * both >= numerator * (size[a] + size[b] - both)
    return keep


class _Union:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(p, p)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _unlike(groups: DataFrame, key: str) -> DataFrame:
    """Of groups that have the same classes, one."""
    same = groups.groupBy(key).agg(F.count("*").alias("_n"), F.sum(F.xxhash64("v") % 1_000_000_007).alias("_one"), F.sum(F.xxhash64("v", F.lit(1)) % 1_000_000_009).alias("_two"))
    return groups.join(same.groupBy("_n", "_one", "_two").agg(F.min(key).alias(key)).select(key), key)


def _gathered(blocks: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(block, v) of those that sketches put near another of their block, in groups that they connect; groups that several
    trees found alike are kept once."""

    def run(table: pa.Table) -> pa.Table:
        block, v, n = (table[c].to_numpy() for c in ("block", "v", "n"))
        order = np.lexsort((v, block))
        block, v, n, sketch = block[order], v[order], n[order], _matrix(table["sketch"].combine_chunks(), SIZE // 32)[order]
        i, j, _ = _alike(sketch, *_pairs(block, n, threshold), threshold)
        u = _Union()
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            u.join(x, y)
        rows = np.unique(np.concatenate([i, j]))
        root = np.array([u.root(x) for x in rows.tolist()], np.int64)
        return pa.table({"block": mix(block[rows].view(U64) ^ v[root].view(U64)).view(np.int64), "v": v[rows]})

    bins = blocks.count() // ROWS_PER_BIN + 1
    rows = blocks.join(classes.select("v", "n", "sketch"), "v").withColumn("bin", F.pmod(F.xxhash64("block"), F.lit(bins)))
    found = materialize(rows.groupBy("bin").applyInArrow(run, "block long, v long"), "gathered")
    return _unlike(found, "block")


def _links(blocks: DataFrame, texts: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """(a, b) confirmed on full sets: in each block, enough links to connect all that are linked.

    blocks: (block, v, component); what has the component in common needs no link.  texts: (v, n, bytes, sketch, text)."""
    threshold = numerator / denominator

    def run(table: pa.Table) -> pa.Table:
        block, v, n, comp = (table[c].to_numpy() for c in ("block", "v", "n", "component"))
        order = np.lexsort((v, block))
        table = table.take(pa.array(order))
        block, v, n, comp, sketch = block[order], v[order], n[order], comp[order], _matrix(table["sketch"].combine_chunks(), SIZE // 32)
        i, j = _pairs(block, n, threshold)
        new = comp[i] != comp[j]
        i, j, likely = _alike(sketch, i[new], j[new], threshold)
        if not len(i):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        need = np.unique(np.concatenate([i, j]))
        _, first, which = np.unique(v[need], return_index=True, return_inverse=True)  # a class's set once, in whatever blocks
        owner, values = shingle_sets(*texts_of(table["text"].take(pa.array(need[first]))), k)
        sets = np.split(values, np.searchsorted(owner, np.arange(1, len(first))))
        # In a family that falls apart nearly all pairs are proposed and few are linked: of many pairs, bounds tell most apart.
        keep, edge = np.ones(len(i), bool), np.flatnonzero(np.append(True, block[i][1:] != block[i][:-1]))
        for a, b in zip(edge, [*edge[1:], len(i)], strict=True):
            if b - a >= MANY:
                keep[a:b] = _may_link(which[np.searchsorted(need, i[a:b])], which[np.searchsorted(need, j[a:b])], sets, numerator, denominator)
        i, j, likely = i[keep], j[keep], likely[keep]
        of = dict(zip(need.tolist(), which.tolist(), strict=True))
        # Vertices of a block's graph: (block, component), so that what is connected already counts as such.
        _, vertex = np.unique(np.stack([block, comp]), axis=1, return_inverse=True)
        vertex, u, out, apart = vertex.ravel().tolist(), _Union(), [], set()
        for e in np.argsort(-likely, kind="stable").tolist():
            x, y = int(i[e]), int(j[e])
            pair = (of[x], of[y]) if of[x] < of[y] else (of[y], of[x])
            if pair not in apart and u.root(vertex[x]) != u.root(vertex[y]):
                s, t = sets[of[x]], sets[of[y]]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if denominator * both >= numerator * (len(s) + len(t) - both):
                    u.join(vertex[x], vertex[y])
                    out.append((x, y))
                else:
                    apart.add(pair)  # blocks of several trees have the same pairs
        x, y = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(v[x], v[y]), "b": np.maximum(v[x], v[y])})

    rows = blocks.join(texts, "v")
    size = blocks.join(texts.select("v", "bytes"), "v").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("block"), F.lit(size // BYTES_PER_BIN + 1)))
    return rows.groupBy("bin").applyInArrow(run, "a long, b long").distinct()


def _maybe(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows whose text hash may be asked for, by one bit for each: a bitmap of FILTER_BITS in parts of 4 KB, which is
    broadcast.  Where it fills up, more rows pass; the join that follows tells exactly."""
    place = lambda th: F.pmod(th, F.lit(FILTER_BITS))
    maps = asked.select(place(F.col("th")).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    at = F.bitmap_bit_position(place(F.col("th")))
    byte = F.conv(F.hex(F.substring("map", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("part", F.bitmap_bucket_number(place(F.col("th")))).join(F.broadcast(maps), "part").filter(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).drop("part", "map")


def _prefixed(open_: DataFrame, texts: DataFrame, k: int, numerator: int, denominator: int) -> DataFrame:
    """(node, v, component, index): the shingles, as nodes, of which a class shares one with any class it is linked to, where
    one of the two has it by its shorter prefix (index).

    Shingles are ordered by a count of their hash's last bits over all sets here, then by hash: any one order for all
    gives exactly the pairs above the threshold, and rare ones first keeps the groups small."""
    rows = open_.join(texts.select("v", "text"), "v")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            total += np.bincount((shingle_sets(*texts_of(b.column(0)), k)[1] % U64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    counts = np.zeros(COUNTERS, np.int64)
    for at, n in rows.select("text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect():  # COUNTERS rows at most
        counts[at] = n

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, values = shingle_sets(*texts_of(b.column(2)), k)
            order = np.lexsort((values, counts[(values % U64(COUNTERS)).astype(np.int64)], owner))
            size = np.bincount(owner, minlength=b.num_rows)
            rank = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
            first = rank <= (size + (-size * numerator) // denominator)[owner]  # n - ceil(n * threshold) + 1 of them
            row = pa.array(owner[first])
            index = rank <= (size + (-2 * size * numerator) // (denominator + numerator))[owner]
            yield pa.RecordBatch.from_arrays([pa.array(values[order][first].view(np.int64)), b.column(0).take(row), b.column(1).take(row), pa.array(index[first])], ["node", "v", "component", "index"])

    return rows.select("v", "component", "text").mapInArrow(prefix, "node long, v long, component long, index boolean")


def _dealt(groups: DataFrame) -> DataFrame:
    """(block, node, part, diagonal, v, component, nodes): every two classes of a group that can be in different components meet in one
    block.  The classes of a group's main component are dealt to parts of PART, the others to further ones; a block is two parts,
    or one of the others alone, and there is none of two parts of the main component.  nodes: the least of a class's groups."""
    mine = groups.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("node")), 1, CARRIED).alias("nodes"))
    sizes = groups.groupBy("node", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("node").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("of_main"), F.sum("n").alias("of_all"))
    main = main.select("node", "main", F.ceil(F.col("of_main") / PART).alias("first"), F.ceil((F.col("of_all") - F.col("of_main")) / PART).alias("others"))
    is_main, salt = F.col("component") == F.col("main"), F.xxhash64("v", "node")
    rows = groups.select("node", "v", "component").join(main, "node").join(mine, "v")
    rows = rows.withColumn("part", F.when(is_main, F.pmod(salt, F.col("first"))).otherwise(F.col("first") + F.pmod(salt, F.col("others"))))
    rows = rows.withColumn("with", F.explode(F.sequence(F.when(is_main, F.col("first")).otherwise(F.lit(0)), F.col("first") + F.col("others") - 1)))
    return rows.select(F.xxhash64("node", F.least("part", "with"), F.greatest("part", "with")).alias("block"), "node", "part", (F.col("part") == F.col("with")).alias("alone"), "v", "component", "nodes")


def _met_before(nodes: pa.Array, node: int) -> np.ndarray:
    """Bits for each row: two rows have a group in common that comes before `node`, as far as `nodes` tell, if their bits overlap."""
    size = np.diff(nodes.offsets.to_numpy())
    owner, flat = np.repeat(np.arange(len(size)), size), nodes.flatten().to_numpy()
    owner, flat = owner[flat < node], flat[flat < node]
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    several = times > 1
    column, owner = (np.cumsum(several) - 1)[column[several[column]]], owner[several[column]]
    has = np.zeros((len(size), -(-int(several.sum()) // 64) * 64), bool)
    has[owner, column] = True
    return np.packbits(has, axis=1).view(U64)


def _across(a: int, b: int, part: np.ndarray, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of the block a:b, some at a time: every two of a part alone, else one of either part.  Rows are sorted by part."""
    middle = a + int(np.searchsorted(part[a:b], part[a], "right"))
    step = max(1, AT_ONCE // (b - a))
    for x in range(a, b if alone else middle, step):
        i = np.arange(x, min(x + step, b if alone else middle))
        owner, rank = spread(b - 1 - i if alone else np.full(len(i), b - middle))
        yield i[owner], (i[owner] + 1 if alone else middle) + rank


def _proposed(groups: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(block, v, component) of classes that sketches put near one of another component in a group of theirs, as _gathered does
    for blocks.  Two classes that share several groups are compared in the first of them alone (or in a few, where they have
    more than CARRIED), and no text travels for those that nothing is near."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table["part"].to_numpy(), table["block"].to_numpy()))))
        block, v, n, comp, part, alone = (table[c].to_numpy() for c in ("block", "v", "n", "component", "part", "alone"))
        sketch, nodes, node = _matrix(table["sketch"].combine_chunks(), SIZE // 32), table["nodes"].combine_chunks(), table["node"].to_numpy()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        edge = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist()
        for a, b in zip(edge, [*edge[1:], len(block)], strict=True):
            met, u, near = _met_before(nodes.slice(a, b - a), int(node[a])), _Union(), np.zeros(b - a, bool)
            for i, j in _across(a, b, part, bool(alone[a])):
                new = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
                i, j, _ = _alike(sketch, i[new], j[new], threshold)
                new = ~(met[i - a] & met[j - a]).any(1)
                i, j = i[new] - a, j[new] - a
                near[i] = near[j] = True
                while len(i):  # each row's first pair connects most; of the rest, pairs that are still apart go again
                    first = np.concatenate([np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1]])
                    for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
                        u.join(x, y)
                    root = np.array([u.root(x) for x in range(b - a)])
                    i, j = i[open_ := root[i] != root[j]], j[open_]
            rows = np.flatnonzero(near)
            root = np.array([u.root(x) for x in rows.tolist()], np.int64)
            out.append((mix(block[a:b][rows].view(U64) ^ v[a:b][root].view(U64)).view(np.int64), a + rows))
        block, rows = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"block": block, "v": v[rows], "component": comp[rows]})

    dealt = materialize(_dealt(groups), "dealt")
    rows = dealt.join(classes.select("v", "n", "sketch"), "v").withColumn("bin", F.pmod(F.xxhash64("block"), F.lit(dealt.count() // ROWS_PER_BIN + 1)))
    found = materialize(rows.groupBy("bin").applyInArrow(run, "block long, v long, component long"), "proposed")
    drop_materialized(dealt)
    return _unlike(found, "block")


def near_dups(docs: DataFrame, k: int = 5, numerator: int = 80, denominator: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: (key, n_shingles, component_id, kept).

    Documents are linked if denominator * intersection >= numerator * union of their sets of distinct k-word shingles
    (A-Z lower-cased, words of no white space); component_id is the smallest key reachable by links.  A document
    without words, or null, is linked with nothing; null keys count as larger than others (a component of
    null keys alone has a null id).  Rows of one key are judged by their own texts, repeated rows are one class; an empty table
    gives an empty one.  Long texts are read whole.

    Every link reported is exact.  A pair at the threshold can be missed: its sketch is over SLACK deviations off (one in two
    thousand), or no tree brings it together.  A pair that few others are near meets in most trees; in a family larger than a
    node a tree of four levels keeps it with somewhat over one half, so eight trees miss 0.2 % of such pairs at most, each of
    which matters only where no chain of other links joins the two; where such a family falls apart, all its classes that are
    left in large nodes are joined exactly.
    """
    signed, member = _members(docs, k, numerator, denominator, key, text)
    least = member.groupBy("component").agg(F.min("doc").alias("component_id"))
    known = member.join(least, "component").select("v", "component_id")
    out = signed.withColumn("v", F.when(F.col("n") > 0, F.xxhash64("one", "two", "n"))).select("doc", "n", "v").join(known, "v", "left")
    least_id = F.coalesce("component_id", "doc")
    null = lambda c: F.when(c != LAST, c)
    return out.select(null(F.col("doc")).alias(key), F.col("n").alias("n_shingles"), null(least_id).alias("component_id"), (F.col("doc") == least_id).alias("kept"))


def _members(docs: DataFrame, k: int, numerator: int, denominator: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows' signatures (doc, th, n, ...), classes of equal sets (v, doc, th, component) with their least (doc, th))."""
    threshold = numerator / denominator
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    signed = materialize(_signatures(rows, k), "signatures")
    grouped = signed.filter("n > 0").withColumn("v", F.xxhash64("one", "two", "n")).groupBy("v").agg(F.min(F.struct("doc", "th")).alias("rep"), F.first("n").alias("n"), F.first("wide").alias("wide"), F.first("sketch").alias("sketch"))
    classes = materialize(grouped.select("v", "rep.doc", "rep.th", "n", "wide", "sketch"), "classes")
    blocks = materialize(_blocks(_tree_nodes(classes, threshold)), "members")
    near = materialize(_gathered(_led(blocks), classes, threshold), "near")

    # Texts of the classes that have another near them or are in a large node: all that either round can ask for.
    asked = near.select("v").unionByName(blocks.filter("blocks > 1").select("v")).distinct().join(classes.drop("wide"), "v")
    texts = _maybe(rows, asked).join(asked, ["doc", "th"]).select("v", "n", F.octet_length("text").alias("bytes"), "sketch", "text", "doc", "th").dropDuplicates(["doc", "th"]).drop("doc", "th")  # as the join has dealt them: no second shuffle
    texts = materialize(texts, "texts")
    # Trees find much the same groups.  A third of the blocks connects most of them; of the rest, only blocks that still
    # have several components need their texts.
    part = F.pmod(F.xxhash64("block", F.lit(7)), F.lit(3)) == 0
    links = materialize(_links(near.filter(part).withColumn("component", F.col("v")), texts, k, numerator, denominator), "links")
    rest = near.filter(~part).join(components(links), "v", "left").withColumn("component", F.coalesce("component", "v"))
    apart = rest.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("block")
    links = materialize(links.unionByName(_links(materialize(rest.join(apart, "block"), "apart"), texts, k, numerator, denominator)), "links")

    drop_materialized(near)

    large = blocks.filter("blocks > 1").join(components(links), "v", "left").withColumn("component", F.coalesce("component", "v"))
    several = large.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("node")
    left_open = materialize(large.join(several, "node", "left_semi").select("v", "component").distinct(), "open")
    drop_materialized(blocks)
    if left_open.head(1):
        prefixes = materialize(_prefixed(left_open, texts, k, numerator, denominator), "prefixes")
        small, many = _sized(prefixes, "node", (F.col("low") != F.col("high")) & (F.col("indexed") > 0))
        drop_materialized(prefixes)
        second = materialize(_proposed(_unlike(small, "node").unionByName(many), classes, threshold), "second")
        links = links.unionByName(materialize(_links(second, texts, k, numerator, denominator), "links"))
    drop_materialized(texts)
    joined = components(links)

    return signed, classes.select("v", "doc", "th").join(joined, "v", "left").withColumn("component", F.coalesce("component", "v"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_dups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), k=3, numerator=85)


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, 0.8 or more).

    Null ids count as larger than others.  Of a group's rows with its smallest id, or of a group without ids, one stays:
    that of the least hash of text, and any one of rows that repeat id and text.  Rows of one id that are not near each
    other are of different groups.  A text without words is in no group; only repeats of its id and text go."""
    signed, member = _members(docs.select("doc_id", "text"), 5, 80, 100, "doc_id", "text")
    first = member.groupBy("component").agg(F.min(F.struct("doc", "th")).alias("_row")).select("_row")
    verdict = first.unionByName(signed.filter("n = 0").select(F.struct("doc", "th").alias("_row")).distinct())
    rows = docs.withColumn("_row", F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("th")))
    return rows.join(verdict, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row")
