"""Merkle manifest of a table, with inclusion proofs from octopus multiproofs.

Every row is a leaf, and every group (a language, say) a tree: leaves in order, each run of ``ARITY`` neighbours hashed
into its parent until one node is left. The groups' roots are the leaves of one more tree. Nodes are named by
coordinates ``tree, level, place``, so levels are built by grouping on ``place div ARITY``.

Proofs are not fetched leaf by leaf. The leaves are dealt into blocks of neighbours. A block works out the least union
of coordinates that its leaves lack: on each level the siblings of what it knows, which its own leaves do not imply.
These are fetched in one join for all blocks, the interiors that the block's leaves share are derived from them once, and
each leaf's proof is put together locally.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.llm.common import write_scratch
from tieout.operators.ordinal import with_ordinal

ARITY = 8
#: Levels that one grouping adds to the trees.
STEP = 3
#: Leaves that share a multiproof; no power of the arity, so that runs lie across its ends.
BLOCK = 1000
#: The tree of the groups' roots.
TOP = -1
NODES = "tree long, level int, place long, digest string"


def field(value: Column) -> Column:
    """A value as bytes that end where they say: ``-`` for null, else its length in UTF-8, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lower-case hex SHA-256 of the fields one after another."""
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def _hash(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def above(known: set[int], width: int) -> tuple[set[int], list[int]]:
    """Of a level with ``width`` nodes: the parents of the known ones, and the nodes that must be fetched to hash them."""
    parents = {p // ARITY for p in known}
    missing = [p for q in parents for p in range(q * ARITY, min(width, q * ARITY + ARITY)) if p not in known]
    return parents, missing


def missing_nodes(known: set[int], width: int) -> Iterator[tuple[int, int]]:
    """Level and place of every node that is needed, beside the known leaves, to reach the root of a tree."""
    level = 0
    while width > 1:
        known, missing = above(known, width)
        yield from ((level, p) for p in missing)
        level, width = level + 1, -(-width // ARITY)


def interiors(leaves: dict[int, str], width: int, fetched: dict[tuple[int, int], str]) -> list[dict[int, str]]:
    """Digests by level that known leaves and fetched nodes give, up to the root."""
    levels = [dict(leaves)]
    while width > 1:
        now, level = levels[-1], len(levels) - 1
        parents, missing = above(set(now), width)
        now.update((p, fetched[level, p]) for p in missing)
        levels.append({q: _hash([now[p] for p in range(q * ARITY, min(width, q * ARITY + ARITY))]) for q in parents})
        width = -(-width // ARITY)
    return levels


def proofs(levels: list[dict[int, str]], wanted: list[int]) -> list[bytes]:
    """The siblings of each wanted leaf, level by level and left to right, as raw digests one after another."""
    known: dict[tuple[int, int], bytes] = {(len(levels) - 1, 0): b""}

    def path(level: int, place: int) -> bytes:
        if (level, place) not in known:
            first = place // ARITY * ARITY
            row = levels[level]
            own = b"".join(bytes.fromhex(row[p]) for p in range(first, first + ARITY) if p != place and p in row)
            upper = path(level + 1, place // ARITY)
            if level == 0:
                return own + upper
            known[level, place] = own + upper
        return known[level, place]

    return [path(0, p) for p in wanted]


def fold(leaf: str, place: int, width: int, proof: bytes) -> tuple[str, bytes]:
    """The root that a leaf and its siblings give, and what is left of the proof."""
    at = 0
    while width > 1:
        size = min(width, place // ARITY * ARITY + ARITY) - place // ARITY * ARITY
        siblings = [proof[at + 32 * k: at + 32 * k + 32].hex() for k in range(size - 1)]
        at += 32 * (size - 1)
        siblings.insert(place % ARITY, leaf)
        leaf = _hash(siblings)
        place, width = place // ARITY, -(-width // ARITY)
    return leaf, proof[at:]


def build(leaves: DataFrame) -> DataFrame:
    """Every node above the leaves ``tree, place, width, digest`` (``width``: leaves of the tree), as ``tree, level,
    place, digest``; ``level`` is 1 above the leaves. A tree of one leaf has none. Each round groups 512 neighbours and
    adds three levels; its nodes are written, so rounds grow as the logarithm of the widest tree."""
    spark = leaves.sparkSession
    span = ARITY ** STEP

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        tree, block = key[0].as_py(), key[1].as_py()
        width, level = table.column("width")[0].as_py(), table.column("level")[0].as_py()
        row = dict(zip(table.column("place").to_pylist(), table.column("digest").to_pylist(), strict=True))
        out: dict[str, list] = {"tree": [], "level": [], "place": [], "digest": [], "width": []}
        for _ in range(STEP):
            if width <= 1:
                break
            row = {q: _hash([row[p] for p in range(q * ARITY, min(width, q * ARITY + ARITY))])
                   for q in sorted({p // ARITY for p in row})}
            level, width = level + 1, -(-width // ARITY)
            out["place"] += row
            out["digest"] += row.values()
            for name, value in (("tree", tree), ("level", level), ("width", width)):
                out[name] += [value] * len(row)
        return pa.table(out, schema=schema)

    schema = pa.schema([("tree", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()),
                        ("width", pa.int64())])
    row = leaves.where("width > 1").select("tree", F.lit(0).alias("level"), "place", "digest", "width")
    built, level, widest = [], 0, leaves.agg(F.max("width")).first()[0] or 0
    while widest > 1:
        grown = write_scratch(row.groupBy("tree", F.expr(f"place div {span}").alias("block")).applyInArrow(
            grow, f"{NODES}, width long"), "merkle-level")
        built.append(grown.drop("width"))
        level, widest = level + STEP, -(-widest // span)
        row = grown.where((F.col("level") == level) & (F.col("width") > 1)).select("tree", "level", "place", "digest", "width")
    found = spark.createDataFrame([], NODES)
    for part in built:
        found = found.unionByName(part)
    return found


def manifest(rows: DataFrame, group: str, order: list[str], digest: str = "leaf") -> tuple[DataFrame, DataFrame]:
    """Places of the rows and every node of the trees.

    Returns the rows with ``ordinal`` (their place among all), ``tree`` (the group's place), ``place`` and ``width``
    (in the group), and the nodes ``tree, level, place, digest``, leaves included; tree ``TOP`` has the groups' roots
    as leaves and one node, the root, on its last level. Groups ascend, null first, and leaves by ``order`` with null
    first; rows equal in it are ordered by their digest. Names that begin with two underscores are not to be used.
    """
    placed = with_ordinal(rows, [group, *order, digest])
    groups = placed.groupBy(group).agg(F.min("ordinal").alias("__first"), F.count(F.lit(1)).alias("__width"))
    groups = write_scratch(with_ordinal(groups, [group]).select(
        F.col(group).alias("__group"), "__first", F.col("__width").alias("width"), (F.col("ordinal") - 1).alias("tree")),
        "merkle-groups")
    # Groups are as many as there are values; where Spark knows them to be few it sends them, else a hot one is split.
    joined = placed.join(groups, F.col(group).eqNullSafe(F.col("__group"))).withColumn(
        "place", F.col("ordinal") - F.col("__first")).drop("__group", "__first")
    leaves = write_scratch(joined, "merkle-leaves")
    at = leaves.select("tree", "place", "width", F.col(digest).alias("digest"))
    nodes = at.select("tree", F.lit(0).alias("level"), "place", "digest").unionByName(build(at))
    last = F.max(F.struct("level", "digest")).alias("top")
    # The widest level number of a tree is its root's; a tree of one leaf has that leaf.
    roots = nodes.where("place = 0").groupBy("tree").agg(last).select("tree", F.col("top.digest").alias("digest"))
    wide = groups.count()
    upper = write_scratch(roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"),
                                       F.lit(wide).cast("long").alias("width"), "digest"), "merkle-roots")
    top = upper.select("tree", F.lit(0).alias("level"), "place", "digest").unionByName(build(upper))
    return leaves, nodes.unionByName(top)


def prove(leaves: DataFrame, nodes: DataFrame, digest: str = "leaf", block: int = BLOCK) -> DataFrame:
    """``ordinal, subroot, root, groups, proof`` for each leaf of a manifest: ``proof`` has the raw digests of all
    siblings from the leaf to the root, ``groups`` is the width of the upper tree.

    ``subroot`` and ``root`` are derived by the leaf's block from its leaves and the nodes it fetched.
    """
    wide = nodes.where(f"tree = {TOP} and level = 0").count()
    keyed = leaves.select(((F.col("ordinal") - 1) / block).cast("long").alias("block"), "ordinal", "tree", "place", "width",
                          F.col(digest).alias("digest"))
    request = pa.schema([("block", pa.int64()), ("tree", pa.int64()), ("level", pa.int32()), ("place", pa.int64())])

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        held, widths = defaultdict(set), {}
        for tree, place, width in zip(*(table.column(c).to_pylist() for c in ("tree", "place", "width")), strict=True):
            held[tree].add(place)
            widths[tree] = width
        found = [(t, *x) for t, known in held.items() for x in missing_nodes(known, widths[t])]
        found += [(TOP, *x) for x in missing_nodes(set(held), wide)]
        return pa.Table.from_pylist([{"block": key[0].as_py(), "tree": t, "level": lev, "place": p} for t, lev, p in found],
                                    schema=request)

    asked = keyed.select("block", "tree", "place", "width").groupBy("block").applyInArrow(
        ask, "block long, tree long, level int, place long")
    # Nodes near the root are asked for by every block; plain shuffles on both sides let Spark split them.
    fetched = write_scratch(asked.hint("merge").join(nodes, ["tree", "level", "place"]).select(
        "block", "tree", "level", "place", "digest"), "merkle-fetched")

    def expand(key: tuple, table: pa.Table, nodes_of: pa.Table) -> pa.Table:
        have: dict[int, dict[tuple[int, int], str]] = defaultdict(dict)
        for tree, level, place, value in zip(*(nodes_of.column(c).to_pylist() for c in ("tree", "level", "place", "digest")),
                                             strict=True):
            have[tree][level, place] = value
        rows = defaultdict(list)
        for r in table.select(["ordinal", "tree", "place", "width", "digest"]).to_pylist():
            rows[r["tree"]].append(r)
        built = {t: interiors({r["place"]: r["digest"] for r in rs}, rs[0]["width"], have[t]) for t, rs in rows.items()}
        upper = interiors({t: levels[-1][0] for t, levels in built.items()}, wide, have[TOP])
        out: dict[str, list] = {"ordinal": [], "subroot": [], "root": [], "groups": [], "proof": []}
        for tree, rs in rows.items():
            onward = proofs(upper, [tree])[0]
            out["ordinal"] += [r["ordinal"] for r in rs]
            out["proof"] += [p + onward for p in proofs(built[tree], [r["place"] for r in rs])]
            out["subroot"] += [built[tree][-1][0]] * len(rs)
            out["root"] += [upper[-1][0]] * len(rs)
            out["groups"] += [wide] * len(rs)
        return pa.table(out, schema=pa.schema([("ordinal", pa.int64()), ("subroot", pa.string()), ("root", pa.string()),
                                               ("groups", pa.int64()), ("proof", pa.binary())]))

    return keyed.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(
        expand, "ordinal long, subroot string, root string, groups long, proof binary")


def folded(rows: DataFrame, leaf: str, out: str = "folded_root") -> DataFrame:
    """The rows with the root that ``leaf`` and the ``proof`` at ``place`` of ``width``, then ``tree`` of ``groups``,
    give; a wrong leaf gives another root. Null where the leaf or the proof is null."""
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for value, place, width, tree, wide, proof in zip(
                    *(batch.column(c).to_pylist() for c in (leaf, "place", "width", "tree", "groups", "proof")), strict=True):
                if value is None or proof is None:
                    roots.append(None)
                    continue
                sub, rest = fold(value, place, width, proof)
                roots.append(fold(sub, tree, wide, rest)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def certify(documents: DataFrame, tampered: Column | None = None, block: int = BLOCK) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, folded_root, verified`` for each document.

    Leaves hash ``doc_id, source, lang, n_chars, text``; a tree is a language. ``tampered`` is a text to fold instead of
    the document's own (null text stays null); ``verified`` tells whether the root came out. Nulls are a value of
    their own in every column; a null language is a tree, the first one; rows equal in ``doc_id`` are ordered by their
    leaf, so repeated rows get neighbouring places. Texts of any length are hashed where they are read and go no
    further. An empty table gives an empty result.
    """
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own = leaf_digest(*columns, F.col("text"))
    seen = own if tampered is None else F.when(F.col("text").isNull(), own).otherwise(leaf_digest(*columns, tampered))
    # Written first: sorting samples its input, and texts are to be read and hashed once.
    digests = write_scratch(documents.select("doc_id", "lang", own.alias("leaf"), seen.alias("seen")), "merkle-digests")
    leaves, nodes = manifest(digests, "lang", ["doc_id"])
    proven = leaves.select("ordinal", "doc_id", "leaf", "seen", "tree", "place", "width").join(
        prove(leaves, nodes, block=block), "ordinal")
    return folded(proven, "seen").select("doc_id", "leaf", "subroot", "root", "proof", "folded_root",
                                         (F.col("folded_root") == F.col("root")).alias("verified"))
