"""Dependencies between regions: overlaps, degrees, cycles and order."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from tieout.errors import NotConvergedError
from tieout.session import drop_scratch, scratch_folder, write_scratch


# Overlap. An interval is cut into aligned blocks of power-of-two length; a point lies in it exactly
# when one of the point's enclosing blocks is among them. That turns the overlap test into an
# equi-join without false candidates, whatever the rectangles look like.

def _blocks(start: Column, end: Column, levels: int) -> Column:
    """Aligned blocks that together cover start..end: at most two per level, the rest on the top one."""
    found = []
    for level in range(levels + 1):
        block = lambda number: F.struct(F.lit(level).alias("level"), number.alias("block"))
        first = F.shiftright(start.cast("bigint") + (2**level - 1), level)
        after = F.shiftright(end.cast("bigint") + 1, level)
        some = first < after
        if level == levels:
            found.append(F.when(some, F.transform(F.sequence(first, after - 1), block)).otherwise(F.array()))
        else:
            left = F.when(some & (first.bitwiseAND(F.lit(1).cast("bigint")) == 1), block(first))
            right = F.when(some & (after.bitwiseAND(F.lit(1).cast("bigint")) == 1), block(after - 1))
            found.append(F.array_compact(F.array(left, right)))
    return F.concat(*found)


def _enclosing(point: Column, levels: int) -> Column:
    """The block each level holds the point in."""
    return F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright(point.cast("bigint"), level).alias("block"))
                     for level in range(levels + 1)])


# Up to this many producers on a sheet, comparing every consumer with them costs no more rows than the
# blocks would; that bounds what one row is joined to. Fuller sheets go by blocks.
FEW_PRODUCERS = 64


def overlap_edges(producers: DataFrame, consumers: DataFrame, partition: str = "sheet") -> DataFrame:
    """(src, dst) for every producer rectangle a consumer rectangle touches, itself excluded.

    Both sides hold ``id``, the partition column and ``min_row, max_row, min_col, max_col``.
    """
    sides = ["id", partition, "min_row", "max_row", "min_col", "max_col"]
    producers, consumers = producers.select(*sides), consumers.select(*sides)
    full = producers.groupBy(partition).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW_PRODUCERS).select(partition)
    some_full = bool(full.take(1))
    few = producers.join(full, partition, "left_anti") if some_full else producers
    p, c = few.alias("p"), consumers.alias("c")
    touch = F.lit(True)
    for axis in ("row", "col"):
        touch = touch & (F.col(f"p.min_{axis}") <= F.col(f"c.max_{axis}")) & (F.col(f"c.min_{axis}") <= F.col(f"p.max_{axis}"))
    near = p.join(c, (F.col(f"p.{partition}") == F.col(f"c.{partition}")) & (F.col("p.id") != F.col("c.id")) & touch)
    edges = near.select(F.col("p.id").alias("src"), F.col("c.id").alias("dst"))
    if some_full:
        edges = edges.unionByName(_edges_by_blocks(
            producers.join(full, partition, "left_semi"), consumers.join(full, partition, "left_semi"), partition))
    return edges.distinct()


def _edges_by_blocks(producers: DataFrame, consumers: DataFrame, partition: str) -> DataFrame:
    def depth(low: str, high: str) -> int:
        both = producers.select(low, high).unionByName(consumers.select(low, high))
        longest = both.agg(F.max(F.col(high) - F.col(low) + 1)).first()[0] or 1
        return max(0, int(longest).bit_length() - 1)
    levels = {"row": depth("min_row", "max_row"), "col": depth("min_col", "max_col")}

    def keyed(df: DataFrame, name: str, points: dict[str, bool], strict: bool) -> DataFrame:
        out = df.withColumnRenamed("id", name)
        for axis, as_point in points.items():
            low, high = F.col(f"min_{axis}"), F.col(f"max_{axis}")
            keys = _enclosing(low, levels[axis]) if as_point else _blocks(low + 1 if strict else low, high, levels[axis])
            out = out.withColumn(f"{axis}_key", F.explode(keys))
        return out.select(name, partition, "row_key", "col_key")

    # Two intervals overlap when the producer starts inside the consumer, or the consumer starts
    # inside the producer but not where the producer starts. One of the two per axis.
    edges = None
    for row_point in (True, False):
        for col_point in (True, False):
            src = keyed(producers, "src", {"row": row_point, "col": col_point}, strict=True)
            dst = keyed(consumers, "dst", {"row": not row_point, "col": not col_point}, strict=False)
            part = src.join(dst, [partition, "row_key", "col_key"]).where(F.col("src") != F.col("dst")).select("src", "dst")
            edges = part if edges is None else edges.unionByName(part)
    return edges


def graph_degrees(edges: DataFrame) -> DataFrame:
    """Per node: fan-in, fan-out and whether it is a root or a leaf. Repeated edges count once."""
    once = edges.select("src", "dst").distinct()
    ends = once.select(F.explode(F.array(
        F.struct(F.col("src").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out")),
        F.struct(F.col("dst").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("into").alias("fan_in"), F.sum("out").alias("fan_out")).withColumns(
        {"is_root": F.col("fan_in") == 0, "is_leaf": F.col("fan_out") == 0})


def _rounds(limit: int | None):
    """1, 2, 3 and so on; beyond a limit the caller has set, an error instead of part of an answer."""
    for number in itertools.count(1):
        if limit is not None and number > limit:
            raise NotConvergedError(f"not settled within {limit} rounds")
        yield number


#: Up to so many pointers are doubled at once; of more, a quarter is taken out at a time.
FEW_POINTERS = 1 << 20


def _follow(pointers: DataFrame, rounds) -> tuple[DataFrame, bool]:
    """Lead every pointer ``node, to, far, least`` to where pointers end.

    A node's value is the larger of ``least`` and ``far`` more than the value at ``to``, so two steps are one of the same
    kind. While there are many pointers, those with one coin whose target has the other are taken out, and what points at
    them goes on to where they point; no two in a row go at once, so the rest is led on without them. They follow
    from it in reverse, so all rounds together move a few times the pointers, however long a chain is. A circle shrinks
    until a node points at itself. Returns the pointers and whether some go in circles: those still point at a node
    with a pointer.
    """
    taken: list[DataFrame] = []
    size, rings = pointers.count(), False
    # Nodes and targets may differ in type; a coin is that of the type both are compared in.
    kind = pointers.select(F.coalesce("node", "to").alias("c")).schema["c"].dataType
    while size > FEW_POINTERS:
        next(rounds)
        coin = lambda name: F.xxhash64(F.col(name).cast(kind), F.lit(len(taken))).bitwiseAND(F.lit(1)) == 1  # noqa: E731, B023
        out = (coin("node") & ~coin("to")) | F.coalesce(F.col("node") == F.col("to"), F.lit(False))
        gone = write_scratch(pointers.where(out), "taken")
        rings = rings or bool(gone.where("node = to").take(1))
        ahead = gone.select(F.col("node").alias("at"), F.col("to").alias("on"), F.col("far").alias("more"), F.col("least").alias("then"))
        # Only a target with the first coin can be gone.
        moving = pointers.where(~out & coin("to")).join(ahead, F.col("to") == F.col("at"), "left")
        kept = pointers.where(~out & ~coin("to")).unionByName(moving.select("node", *_two_steps()))
        taken.append(gone)
        fewer = write_scratch(kept, "pointers")
        drop_scratch(pointers)
        pointers = fewer
        size = pointers.count()
    pointers, circles = _doubled(pointers, size, rounds)
    for gone in reversed(taken):
        ahead = pointers.select(F.col("node").alias("at"), F.col("to").alias("on"), F.col("far").alias("more"), F.col("least").alias("then"))
        led = gone.join(ahead, F.col("to") == F.col("at"), "left").select("node", *_two_steps())
        every = write_scratch(pointers.unionByName(led), "pointers")
        drop_scratch(pointers)
        drop_scratch(gone)
        pointers = every
    return pointers, circles or rings


def _two_steps() -> list[Column]:
    """``to, far, least`` after a pointer's own step and the one ``at, on, more, then`` that was joined to it, if any."""
    passed = F.col("at").isNotNull()
    return [F.when(passed, F.col("on")).otherwise(F.col("to")).alias("to"),
            F.when(passed, F.col("far") + F.col("more")).otherwise(F.col("far")).alias("far"),
            F.when(passed, F.greatest("least", F.col("then") + F.col("far"))).otherwise(F.col("least")).alias("least")]


def _doubled(pointers: DataFrame, size: int, rounds) -> tuple[DataFrame, bool]:
    """Lead every pointer on by doubling what each has covered; in circles they have taken more steps than there are nodes."""
    steps = 1
    while True:
        next(rounds)
        ahead = pointers.select(F.col("node").alias("at"), F.col("to").alias("on"), F.col("far").alias("more"), F.col("least").alias("then"))
        joined = pointers.join(ahead, F.col("to") == F.col("at"), "left")
        moved = write_scratch(joined.select("node", *_two_steps(), F.col("at").isNotNull().alias("passed")), "pointers")
        drop_scratch(pointers)
        left = moved.where("passed").count()
        pointers, steps = moved.drop("passed"), 2 * steps
        if not left or steps > 2 * size:
            return pointers, bool(left)


def cyclic_core(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Nodes left after peeling, again and again, those without a live edge in or out.

    Before each peeling, chains of nodes with one edge in and one out become single edges, by doubling pointers along
    them, so a long tail takes as many rounds as the logarithm of its length. A chain that ends nowhere is a ring
    and stays; other chains stay where both their ends do. Tables of a round go once the next is written.
    """
    live = write_scratch(edges.select("src", "dst").distinct(), "core")
    rounds, chains = _rounds(max_rounds), []
    while True:
        size = live.count()
        if not size:
            break
        single = lambda end, other: live.groupBy(F.col(end).alias("node")).agg(
            F.min(other).alias(other), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
        through = write_scratch(single("dst", "src").join(single("src", "dst"), "node"), "through")
        if through.take(1):
            ends = []
            for side in ("src", "dst"):
                start = write_scratch(through.select("node", F.col(side).alias("to"), F.lit(0).cast("long").alias("far"), F.lit(0).cast("long").alias("least")), "pointers")
                ends.append(_follow(start, rounds)[0].select("node", F.col("to").alias(side)))
            led = write_scratch(ends[0].join(ends[1], "node"), "chains")
            inner = through.select(F.col("node").alias("inner"))
            ring = led.join(inner, F.col("src") == F.col("inner"), "left_semi").select("node")
            open_ = led.join(inner, F.col("src") == F.col("inner"), "left_anti")
            chains.append((open_, ring))
            touched = live.join(inner, F.col("src") == F.col("inner"), "left_anti").join(
                inner, F.col("dst") == F.col("inner"), "left_anti")
            live, old = write_scratch(touched.unionByName(open_.select("src", "dst")).distinct(), "core"), live
            drop_scratch(old)
        next(rounds)
        entered, left = live.select(F.col("dst").alias("src")).distinct(), live.select(F.col("src").alias("dst")).distinct()
        peeled = write_scratch(live.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst"), "core")
        before, after = live.count(), peeled.count()
        drop_scratch(live)
        live = peeled
        if after == before and not through.take(1):
            break
    core = live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct()
    for chain, ring in reversed(chains):
        held = write_scratch(core, "core-nodes")
        both = chain.join(held.select(F.col("node").alias("src")), "src", "left_semi").join(
            held.select(F.col("node").alias("dst")), "dst", "left_semi").select("node")
        core = held.unionByName(both).unionByName(ring)
    return core.distinct()


def topological_levels(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame | None:
    """Each node's level (0 for roots, else one above its deepest source); None when there is a cycle.

    A node with one source hangs on it at a fixed distance. Chains and trees of such nodes are led to where they begin by
    doubling pointers, in as many rounds as the logarithm of their depth; what is left, roots and nodes with several
    sources, is peeled from the roots, and both are repeated until no edge is left. A node keeps the deepest level that
    resolved sources give it, so shortened edges carry a distance and a least level.
    """
    live = write_scratch(edges.select("src", "dst").distinct().select("src", "dst", F.lit(1).cast("long").alias("far")), "edges")
    every = live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node")))
    if nodes is not None:
        every = every.unionByName(nodes.select("node"))
    # Nodes whose level is not known yet, with the least it can be.
    waiting = write_scratch(every.distinct().withColumn("least", F.lit(0).cast("long")), "waiting")
    rounds, hung, known = _rounds(max_rounds), [], []
    while True:
        single = live.groupBy(F.col("dst").alias("node")).agg(
            F.min("src").alias("to"), F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
        pointers = write_scratch(single.join(waiting, "node"), "pointers")
        if pointers.take(1):
            pointers, circles = _follow(pointers, rounds)
            if circles:
                return None
            hung.append(pointers)
            # Edges from a hanging node start where it hangs, and give what they lead to a least level.
            moved = live.join(pointers.select("node"), F.col("dst") == F.col("node"), "left_anti").join(
                pointers.select(F.col("node").alias("src"), "to", F.col("far").alias("more"), "least"), "src", "left")
            live_now = write_scratch(moved.select(
                F.coalesce("to", "src").alias("src"), "dst", (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"),
                (F.col("least") + F.col("far")).alias("least")), "edges")
            waiting = waiting.join(pointers.select("node"), "node", "left_anti")
        else:
            live_now = live.withColumn("least", F.lit(None).cast("long"))
        next(rounds)
        targets = live_now.select(F.col("dst").alias("node")).distinct()
        roots = write_scratch(waiting.join(targets, "node", "left_anti").select("node", F.col("least").alias("level")), "levels")
        known.append(roots)
        if not live_now.take(1):
            break
        from_roots = live_now.join(roots.select(F.col("node").alias("src"), "level"), "src", "left")
        risen = from_roots.select(F.col("dst").alias("node"), F.greatest("least", F.col("level") + F.col("far")).alias("risen")).groupBy(
            "node").agg(F.max("risen").alias("risen"))
        still = write_scratch(waiting.join(roots.select("node"), "node", "left_anti").join(risen, "node", "left").select(
            "node", F.greatest("least", "risen").alias("least")), "waiting")
        rest = write_scratch(from_roots.where("level is null").groupBy("src", "dst").agg(F.max("far").alias("far")), "edges")
        if not roots.take(1) and not pointers.take(1):
            return None
        drop_scratch(live)
        live, waiting = rest, still
    levels = known[0]
    for part in known[1:]:
        levels = levels.unionByName(part)
    for pointers in reversed(hung):
        held = write_scratch(levels, "levels")
        levels = held.unionByName(pointers.join(held.withColumnRenamed("node", "to"), "to").select(
            "node", F.greatest("least", F.col("level") + F.col("far")).alias("level")))
    return levels.select("node", F.col("level").cast("int").alias("level"))


def dead_nodes(nodes: DataFrame, edges: DataFrame, terminal: Column | None = None) -> DataFrame:
    """Nodes nothing reads, other than those meant to be the end (``terminal``)."""
    unread = nodes.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
    return unread if terminal is None else unread.where(~F.coalesce(terminal, F.lit(False)))
