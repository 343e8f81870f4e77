"""A Merkle manifest of a dataset: leaves by row, a tree for each source, a root over the sources, and proofs by look-up."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import positions
from .shared import bounded_broadcast, lower_ascii, materialize

#: Bits of an index that tell nodes of a run apart: 16 nodes become one.
BITS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node that more than so many paths ask for is copied, and each copy asked by a part of them.
ASKED_BITS = 16
#: Rows of the table of sources' paths (some KB each) that may be broadcast.
PATH_ROWS = 5_000
STEP = "struct<before: string, after: string>"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each `-` for null, else its UTF-8 length, a colon and itself."""
    return F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256)


def _parents(level: DataFrame, at: int) -> DataFrame:
    """The nodes over those of level `at`: trees that have more than one node there go on."""
    runs = level.filter(f"shiftright(n - 1, {BITS * at}) > 0").groupBy("tree", "n", F.expr(f"shiftright(idx, {BITS})").alias("run"))
    nodes = runs.agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("m"))
    return nodes.select("tree", "n", F.col("run").alias("idx"), F.expr("sha2(cast(array_join(transform(m, x -> x.digest), '') AS binary), 256)").alias("digest"))


def grown(level: DataFrame, at: int, largest: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, tops) of the trees whose nodes at level `at` are the rows (tree, n, idx, digest), n being a tree's leaves:
    nodes have siblings and a `level`, tops are what remains of each tree.  Each level is a table."""
    nodes = tops = None
    while True:
        told = level.withColumn("level", F.lit(at))
        above, top = told.filter(f"shiftright(n - 1, {BITS * at}) > 0"), told.filter(f"shiftright(n - 1, {BITS * at}) = 0")
        nodes, tops = (above, top) if nodes is None else (nodes.unionByName(above), tops.unionByName(top))
        if (largest - 1) >> (BITS * at) <= 0:
            return nodes, tops
        level, at = materialize(_parents(level, at), "nodes"), at + 1


def paths(units: DataFrame, nodes: DataFrame, at: int) -> DataFrame:
    """(tree, unit, steps) for each unit, a node of level `at` given as (tree, n, unit): steps are, level by level, what
    stands before and after the node on its way to the top, one string each.

    The coordinates (level, index) of all siblings follow from the unit's index and the size of its tree; they are
    exploded and joined with the node table, then ordered and concatenated.  A node high in a large tree is asked for
    by everything below it, so the node table has it in as many copies as keep each copy's askers few."""
    f = {"levels": f"filter(sequence({at}, 15), l -> shiftright(n - 1, {BITS} * l) > 0)", "place": f"shiftright(unit, {BITS} * (l - {at}))", "run": (1 << BITS) - 1}
    wanted = "flatten(transform({levels}, l -> transform(filter(sequence({place} - ({place} & {run}), least({place} - ({place} & {run}) + {run}, shiftright(n - 1, 4 * l))), x -> x <> {place}), x -> struct(l AS level, x AS idx))))".format(**f)
    copies = f"shiftleft(1L, greatest({BITS} * level - {ASKED_BITS}, 0))"
    asked = units.select("tree", "n", "unit", F.explode_outer(F.expr(wanted)).alias("w")).select("tree", "n", "unit", "w.*").withColumn("copy", F.expr(f"pmod(unit, {copies})"))
    table = nodes.filter(F.col("level") >= at).select("tree", "level", "idx", "digest", F.explode(F.expr(f"sequence(0L, {copies} - 1)")).alias("copy"))
    found = asked.join(bounded_broadcast(table), ["tree", "level", "idx", "copy"], "left").groupBy("tree", "n", "unit").agg(F.sort_array(F.collect_list(F.struct("level", "idx", "digest"))).alias("s"))
    side = "array_join(transform(filter(s, x -> x.level = l AND x.idx {op} {place}), x -> x.digest), '')"
    steps = "transform({levels}, l -> struct({b} AS before, {a} AS after))".format(b=side.format(op="<", **f), a=side.format(op=">", **f), **f)
    return found.select("tree", "unit", F.expr(steps).alias("steps"))


def manifest(docs: DataFrame, shown: Mapping[str, Column] | None = None, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row for each row of docs: (key, leaf, subroot, root, proof_sha256, folded_root, verified).

    A leaf is the hash of the row's fields.  In each group (null is one) leaves ascend by key (null first); 16 neighbours
    at a time become a node until one remains, and the groups' last nodes, ordered by group, become the root likewise.
    `shown` gives other values for some fields: what somebody presents as the row now.  The row's siblings, looked up by
    coordinates, fold the presented leaf to `folded_root`; `verified` says whether that is the root.  proof_sha256 is
    the hash of all siblings in order.

    Rows are ranged by (group, key, leaf), never gathered by group, so a group with a third of all rows is many pieces.
    The siblings above a run of 16 leaves are the same for all 16: a run asks for them once, and a group once for those
    of its last node.  Texts are read once, in the leaf's hash; only digests and keys are shuffled.

    Null fields hash as `-` and empty ones as `0:`; long texts are hashed in the row; repeated rows are leaves of their
    own, side by side; rows that share a key are ordered by leaf; other columns are ignored; an empty table gives no rows.
    """
    given = {c: F.col(c) for c in fields}
    leaf, other = leaf_of(list(given.values())), leaf_of(list((given | dict(shown or {})).values()))
    rows = docs.select(F.col(key).alias("k"), F.col(group).alias("g"), leaf.alias("leaf"), other.alias("shown"), F.monotonically_increasing_id().alias("row"))
    placed = positions(materialize(rows, "leaves"), ["g", "k", "leaf", "row"], "placed")
    pieces = materialize(placed.groupBy("part", "g").agg(F.min("pos").alias("first"), F.count("*").alias("n")), "pieces")
    groups = materialize(pieces.groupBy("g").agg(F.min("first").alias("first"), F.sum("n").alias("n")), "groups")
    groups = materialize(positions(groups, ["first"], "ordered").select("g", "first", "n", F.col("pos").alias("tree")), "trees")
    size = groups.agg(F.max("n"), F.count("*")).first()
    # A piece has few groups, so no key of this join has more rows than a piece.
    where = pieces.select("part", F.col("g").alias("pg")).join(bounded_broadcast(groups), F.col("pg").eqNullSafe(F.col("g"))).select(F.col("part").alias("pp"), "pg", "first", "n", "tree")
    members = placed.join(bounded_broadcast(where), (F.col("part") == F.col("pp")) & F.col("g").eqNullSafe(F.col("pg"))).select("tree", "n", (F.col("pos") - F.col("first")).alias("idx"), "k", "leaf", "shown")
    runs = materialize(members.groupBy("tree", "n", F.expr(f"shiftright(idx, {BITS})").alias("unit")).agg(F.sort_array(F.collect_list(F.struct("idx", "leaf", "shown", "k"))).alias("m")), "runs")
    over = runs.select("tree", "n", F.col("unit").alias("idx"), F.expr("if(n = 1, m[0].leaf, sha2(cast(array_join(transform(m, x -> x.leaf), '') AS binary), 256))").alias("digest"))
    # A lone leaf is its tree's top already; n - 1 shifted is 0 at level 1 too.
    nodes, tops = grown(over, 1, size[0] or 1)
    tops = materialize(tops.select("tree", F.col("digest").alias("subroot")), "subroots")
    subroots = tops.select(F.lit(0).cast("long").alias("tree"), F.lit(size[1]).cast("long").alias("n"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"))
    high, top = grown(subroots, 0, size[1] or 1)
    last = top.first()
    upper = paths(subroots.select("tree", "n", F.col("idx").alias("unit")), high, 0).select(F.col("unit").alias("tree"), F.col("steps").alias("upper"))
    lower = paths(runs.select("tree", "n", "unit"), nodes, 1)
    copies = f"shiftright(n, {ASKED_BITS}) + 1"
    upper = groups.select("tree", "n").join(upper, "tree").join(tops, "tree").select("tree", "upper", "subroot", F.explode(F.expr(f"sequence(0L, {copies} - 1)")).alias("copy"))
    whole = runs.join(lower, ["tree", "unit"]).withColumn("copy", F.expr(f"pmod(unit, {copies})")).join(bounded_broadcast(upper, PATH_ROWS), ["tree", "copy"])
    own = f"if(n = 1, cast(array() AS array<{STEP}>), array(struct(array_join(transform(slice(m, 1, p), x -> x.leaf), '') AS before, array_join(transform(slice(m, p + 2, 16), x -> x.leaf), '') AS after)))"
    each = whole.select("n", "m", "steps", "upper", "subroot", F.posexplode("m").alias("p", "me")).select("me.*", "subroot", F.expr(f"concat({own}, steps, upper)").alias("steps"))
    folded = each.select(F.col("k").alias(key), "leaf", "subroot", F.lit(last["digest"] if last else None).cast("string").alias("root"),
                         F.expr("sha2(cast(array_join(transform(steps, x -> concat(x.before, x.after)), '') AS binary), 256)").alias("proof_sha256"),
                         F.expr("aggregate(steps, shown, (a, x) -> sha2(cast(concat(x.before, a, x.after) AS binary), 256))").alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_text(key: str = "doc_id", text: str = "text") -> Column:
    """The text with A-Z lower-cased where 5 divides the crc32 of the decimal key; rows without a key keep theirs."""
    return F.when(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, lower_ascii(F.col(text))).otherwise(F.col(text))


def query(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), {"text": tampered_text()})


_CRC_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def _leaf_sql(text: str) -> str:
    return "sha256({})".format(" || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)))


ORACLE = f"""
WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
a AS (SELECT documents.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS bad FROM documents, crc),
b AS (SELECT *, CASE WHEN bad THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text2 FROM a),
c AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("text2")} AS shown FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM c),
up(tree, level, idx, n, digest) AS (SELECT tree, 0, idx, n, leaf FROM d UNION ALL
    SELECT tree, level + 1, idx // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY tree, level, idx // 16),
sub AS (SELECT tree, digest FROM up WHERE n = 1),
top(level, idx, n, digest) AS (SELECT 0, tree, count(*) OVER (), digest FROM sub UNION ALL
    SELECT level + 1, idx // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 16),
run AS (SELECT tree, level, idx // 16 AS run, list(digest ORDER BY idx) AS m FROM up WHERE n > 1 GROUP BY ALL),
hrun AS (SELECT level, idx // 16 AS run, list(digest ORDER BY idx) AS m FROM top WHERE n > 1 GROUP BY ALL),
walk(doc_id, leaf, tree, level, idx, n, acc, proof) AS (SELECT doc_id, leaf, tree, 0, idx, n, shown, '' FROM d UNION ALL
    SELECT w.doc_id, w.leaf, w.tree, w.level + 1, w.idx // 16, (w.n + 15) // 16, sha256(array_to_string(m[:w.idx % 16], '') || acc || array_to_string(m[w.idx % 16 + 2:], '')),
        proof || array_to_string(m[:w.idx % 16], '') || array_to_string(m[w.idx % 16 + 2:], '') FROM walk w JOIN run r ON w.n > 1 AND r.tree = w.tree AND r.level = w.level AND r.run = w.idx // 16),
high(doc_id, leaf, tree, level, idx, n, acc, proof) AS (SELECT doc_id, leaf, tree, 0, tree, (SELECT count(*) FROM sub), acc, proof FROM walk WHERE n = 1 UNION ALL
    SELECT w.doc_id, w.leaf, w.tree, w.level + 1, w.idx // 16, (w.n + 15) // 16, sha256(array_to_string(m[:w.idx % 16], '') || acc || array_to_string(m[w.idx % 16 + 2:], '')),
        proof || array_to_string(m[:w.idx % 16], '') || array_to_string(m[w.idx % 16 + 2:], '') FROM high w JOIN hrun r ON w.n > 1 AND r.level = w.level AND r.run = w.idx // 16)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r.digest AS verified
FROM high h JOIN sub s ON s.tree = h.tree, (SELECT digest FROM top WHERE n = 1) r WHERE h.n = 1
"""
