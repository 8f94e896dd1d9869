import random

import pytest
from pyspark.sql import functions as F

from tieout.errors import ArgumentError, DuplicateKeyError, NotConvergedError
from tieout.operators import frames, graph, lookups, ordered, runs
from tieout.operators.ordinal import with_ordinal


@pytest.fixture
def skewed(spark):
    """Two thirds of the rows in one group, some groups empty, one null group."""
    random.seed(1)
    rows = [(random.choice(["big"] * 6 + ["a", "b", None]), i * 7919 % 10007, float(random.randint(0, 9)) if i % 11 else None) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "g string, o int, v double")


@pytest.mark.parametrize("threshold", [10**9, 60])
def test_row_order_operators_against_plain_loops(skewed, hot, threshold):
    rows, frame = skewed
    hot(threshold)
    total = {(r["g"], r["o"]): r["t"] for r in ordered.running_total(frame, ["g"], ["o"], "v", "t").collect()}
    above = {(r["g"], r["o"]): (r["po"], r["pv"]) for r in ordered.prior_row(frame, ["g"], ["o"], {"po": "o", "pv": "v"}).collect()}
    filled = {(r["g"], r["o"]): r["f"] for r in ordered.fill_forward(frame, ["g"], ["o"], "v", "f").collect()}
    for group in {r[0] for r in rows}:
        so_far, last, before = 0.0, None, (None, None)
        for _, o, v in sorted((r for r in rows if r[0] == group), key=lambda r: r[1]):
            so_far, last = so_far + (v or 0), v if v is not None else last
            assert total[group, o] == so_far
            assert above[group, o] == before
            assert filled[group, o] == last
            before = (o, v)


def test_the_threshold_really_cuts_the_large_group(skewed, hot):
    _, frame = skewed
    hot(60)
    cut = ordered.sliced(frame, ["g"], ["o"])
    sizes = [r["count"] for r in cut.df.groupBy("g", ordered.SLICE).count().collect()]
    assert cut.cut and max(sizes) < 300
    hot(10**9)
    assert not ordered.sliced(frame, ["g"], ["o"]).cut


def test_rows_have_no_order_of_their_own(skewed):
    with pytest.raises(ArgumentError):
        ordered.running_total(skewed[1], ["g"], [], "v")
    with pytest.raises(ArgumentError):
        with_ordinal(skewed[1], [])


def test_ordinal_numbers_every_row_once(spark):
    frame = spark.range(5000).select((F.col("id") % 7).alias("k"), F.lit("same").alias("s"))
    got = with_ordinal(frame, ["k"]).collect()
    assert sorted(r["ordinal"] for r in got) == list(range(1, 5001))
    assert [r["k"] for r in sorted(got, key=lambda r: r["ordinal"])] == sorted(r["k"] for r in got)


def test_lookup_takes_the_first_hit_and_never_multiplies_rows(spark):
    probe = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "zz")], "n int, k string")
    table = spark.createDataFrame([("a", 5, "late"), ("a", 1, "early"), ("b", 2, None), (None, 0, "null key")], "k string, o int, v string")
    got = {r["n"]: r["hit"] for r in lookups.lookup_first(probe, table, ["k"], ["k"], {"hit": "v"}, ["o"]).collect()}
    assert got == {1: "early", 2: None, 3: None, 4: None}


@pytest.mark.parametrize("threshold,limit", [(10**9, 500), (10**9, 0), (5, 0)])
def test_nearest_lookup_against_a_loop(spark, hot, monkeypatch, threshold, limit):
    hot(threshold)
    monkeypatch.setattr(lookups, "BAND_ROWS", limit)
    random.seed(2)
    bands = [(random.randint(0, 50), i) for i in range(25)]
    probes = [(i, random.randint(-5, 60) if i % 9 else None) for i in range(200)]
    got = lookups.lookup_nearest(spark.createDataFrame(probes, "n int, x int"), spark.createDataFrame(bands, "lo int, i int"),
                                 "x", "lo", {"band": "i"}, order=["i"])
    for row in got.collect():
        below = [b for b in bands if row["x"] is not None and b[0] <= row["x"]]
        assert row["band"] == (max(below)[1] if below else None)


def test_sumifs_without_a_match_is_zero_and_averageifs_empty(spark):
    target = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    source = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 9.0)], "s string, v double")
    assert sorted((r["k"] or "", r["t"]) for r in lookups.sumifs(target, source, {"k": "s"}, F.col("v"), "t").collect()) == [("", 0), ("a", 3), ("b", 0)]
    assert {r["k"]: r["t"] for r in lookups.averageifs(target, source, {"k": "s"}, F.col("v"), "t").collect()}["b"] is None
    assert {r["k"]: r["t"] for r in lookups.countifs(target, source, {"k": "s"}, "t").collect()} == {"a": 2, "b": 0, None: 0}


def test_headers():
    assert frames.clean_headers(["  Asset Class ", "Amount", "Amount ", "£", ""]) == ["asset_class", "amount", "amount_2", "column", "column_2"]


def test_totals_rows(spark):
    frame = spark.createDataFrame([("a", 1), ("Total", 99), ("b", 2), (None, 88), ("c", 3), ("Sub Total", 6)], "k string, v int")
    assert frames.strip_totals_rows(frame, "k", ["sub total"]).agg(F.sum("v")).first()[0] == 6


def test_empty_columns(spark):
    frame = spark.createDataFrame([(1, None, None), (2, None, 3)], "a int, b int, c int")
    assert frames.drop_all_null_columns(frame).columns == ["a", "c"]
    assert frames.drop_all_null_columns(frame.where("a > 5")).columns == []


def test_unique_key(spark):
    frame = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (2, None), (2, None)], "a int, b string")
    with pytest.raises(DuplicateKeyError, match="x3"):
        frames.assert_unique_key(frame, ["a", "b"])
    assert frames.assert_unique_key(frame.distinct(), ["a", "b"]).count() == 2


def reference_allocation(parts, total, digits=2):
    step = 10**digits
    units = [int(p * step // 1) for p in parts]
    rest = [p * step - u for p, u in zip(parts, units)]
    short = round(total * step) - sum(units)
    order = sorted(range(len(parts)), key=lambda i: -rest[i])
    for n in range(abs(short)):
        units[order[n % len(order)]] += 1 if short > 0 else -1
    return [u / step for u in units]


@pytest.mark.parametrize("parts,total", [([33.333, 33.333, 33.334], 100), ([1.005, 2.0049, 3.3], 7), ([1.5, 2.25], 1), ([0.129] * 7, 1.0)])
def test_allocation_sums_to_the_total(spark, hot, parts, total):
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(parts)], "n int, p double")
    got = [r["q"] for r in frames.allocate_residual(frame, "p", total, ["n"], into="q").orderBy("n").collect()]
    assert got == reference_allocation(parts, total)
    assert round(sum(got), 2) == total
    groups = spark.createDataFrame([(g, i, p) for g in "ab" for i, p in enumerate(parts)], "g string, n int, p double")
    totals = spark.createDataFrame([("a", float(total)), ("b", float(total) + 1)], "g string, total double")
    hot(2)
    by = frames.allocate_residual_by(groups, "p", totals, ["g"], ["n"], into="q")
    assert [r["q"] for r in by.where("g = 'a'").orderBy("n").collect()] == got
    assert [r["q"] for r in by.where("g = 'b'").orderBy("n").collect()] == reference_allocation(parts, total + 1)


def test_allocation_refuses_empty_cells(spark):
    with pytest.raises(ArgumentError):
        frames.allocate_residual(spark.createDataFrame([(1, None)], "n int, p double"), "p", 1, ["n"])


def test_preview_counts_what_it_leaves_out(spark):
    shown = frames.capped_preview(spark.range(250), rows=10)
    assert (len(shown.rows), shown.total, shown.omitted) == (10, 250, 240) and shown.text.endswith("240 more row(s) omitted")
    assert frames.capped_preview(spark.range(5), max_bytes=20).omitted == 3


def test_embedded_totals_ignore_the_bottom(spark):
    rows = [(1, "a", 1), (2, "Grand total", 1), (3, "b", 2), (4, "subtotal", 2), (5, "Total", 4), (6, None, None)]
    frame = spark.createDataFrame(rows, "n int, k string, v int")
    assert [r["n"] for r in frames.embedded_totals(frame, "n").orderBy("n").collect()] == [2]


@pytest.mark.parametrize("threshold", [10**9, 4])
def test_runs_and_what_breaks_them(spark, hot, threshold):
    hot(threshold)
    patterns = {5: None, 6: "g", 20: None, 21: None, 22: None, 23: None}
    cells = [("A", i, patterns.get(i, "f"), "7" if i == 5 else None) for i in range(1, 31)]
    frame = spark.createDataFrame(cells, "col string, row int, pattern string, value string")
    got = sorted(tuple(r) for r in runs.compress_runs(frame, ["col"], "pattern", "row").collect())
    assert got == [("A", "f", 1, 1, 19, 17), ("A", "f", 2, 24, 30, 7), ("A", "g", 1, 6, 6, 1)]
    broken = sorted((r["row"], r["actual_pattern"], r["actual_value"]) for r in runs.find_breaks(frame, ["col"], "pattern", "row", "value").collect())
    assert broken == [(5, None, "7"), (6, "g", None)]


@pytest.mark.parametrize("few", [64, 0])
def test_overlaps_against_a_double_loop(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_PRODUCERS", few)
    random.seed(3)
    def rectangles(tag):
        made = []
        for i in range(70):
            r, c = random.randint(0, 60), random.randint(0, 20)
            made.append((f"{tag}{i}", f"s{i % 2}", r, r + random.choice([0, 0, 1, 5, 30]), c, c + random.choice([0, 1, 7])))
        return made
    p = rectangles("p")
    c = rectangles("c") + p[:10]
    schema = "id string, sheet string, min_row int, max_row int, min_col int, max_col int"
    got = sorted(map(tuple, graph.overlap_edges(spark.createDataFrame(p, schema), spark.createDataFrame(c, schema)).collect()))
    want = sorted({(a[0], b[0]) for a in p for b in c if a[0] != b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3] and a[4] <= b[5] and b[4] <= a[5]})
    assert got == want


def test_graph_shapes(spark):
    cyclic = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (0, 1)], "src int, dst int")
    assert sorted(r["node"] for r in graph.cyclic_core(cyclic).collect()) == [1, 2, 3]
    assert graph.topological_levels(cyclic) is None
    acyclic = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (9, 4)], "src int, dst int")
    nodes = spark.createDataFrame([(7,)], "node int")
    assert sorted(map(tuple, graph.topological_levels(acyclic, nodes).collect())) == [(1, 0), (2, 1), (3, 2), (4, 3), (7, 0), (9, 0)]
    assert graph.cyclic_core(acyclic).count() == 0
    dead = graph.dead_nodes(spark.createDataFrame([(4, False), (7, True), (1, False)], "node int, end boolean"), acyclic, F.col("end"))
    assert [r["node"] for r in dead.collect()] == [4]


def plain_levels(edges):
    into = {}
    for a, b in edges:
        into.setdefault(b, set()).add(a)
        into.setdefault(a, set())
    levels = {}
    while len(levels) < len(into):
        ready = [n for n, above in into.items() if n not in levels and all(x in levels for x in above)]
        if not ready:
            return None
        levels |= {n: max((levels[x] + 1 for x in into[n]), default=0) for n in ready}
    return levels


def plain_core(edges):
    edges = set(edges)
    while True:
        kept = {(a, b) for a, b in edges if any(y == a for _, y in edges) and any(x == b for x, _ in edges)}
        if kept == edges:
            return {n for e in edges for n in e}
        edges = kept


@pytest.mark.parametrize("seed", range(3))
def test_levels_and_cores_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = 30
    chain = [(100 + i, 101 + i) for i in range(rng.randrange(3, 40))]
    acyclic = [tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(rng.randrange(5, 70))] + chain + [(3, 100)]
    frame = lambda rows: spark.createDataFrame(rows, "src int, dst int").repartition(3)
    got = {r["node"]: r["level"] for r in graph.topological_levels(frame(acyclic + acyclic[:5])).collect()}
    assert got == plain_levels(acyclic)
    tangled = [tuple(rng.choices(range(nodes), k=2)) for _ in range(rng.randrange(10, 45))] + chain + [(chain[-1][1], rng.choice([5, 100, 200]))]
    assert {r["node"] for r in graph.cyclic_core(frame(tangled)).collect()} == plain_core(tangled)
    found = graph.topological_levels(frame(tangled))
    assert plain_levels(tangled) == (None if found is None else {r["node"]: r["level"] for r in found.collect()})


def test_a_long_chain_takes_few_rounds(spark):
    chain = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert graph.topological_levels(chain, max_rounds=16).where("level <> node").count() == 0
    assert graph.cyclic_core(chain, max_rounds=30).count() == 0
    ring = chain.unionByName(spark.createDataFrame([(3000, 1500)], "src long, dst long"))
    assert graph.topological_levels(ring, max_rounds=16) is None
    assert graph.cyclic_core(ring, max_rounds=60).count() == 1501


def test_a_round_limit_is_an_error_not_a_partial_answer(spark):
    chain = spark.range(12).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    with pytest.raises(NotConvergedError):
        graph.cyclic_core(chain, max_rounds=2)
    with pytest.raises(NotConvergedError):
        graph.topological_levels(chain, max_rounds=3)


def test_many_pointers_are_taken_out_and_led_on(spark, monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(graph, "FEW_POINTERS", 24)
    tree = [(rng.randrange(max(0, i - 3), i), i) for i in range(1, 60)]
    # Sources are longs and targets ints: coins must not depend on that.
    frame = lambda rows: spark.createDataFrame(rows, "src long, dst int").repartition(3)
    assert {r["node"]: r["level"] for r in graph.topological_levels(frame(tree)).collect()} == plain_levels(tree)
    rings = [(a, a + 1) for a in range(200, 220)] + [(220, 200)] + [(a, a ^ 1) for a in range(300, 320)] + [(350, 350), (220, 400), (400, 401)]
    assert graph.topological_levels(frame(tree + rings)) is None
    assert {r["node"] for r in graph.cyclic_core(frame(tree + rings)).collect()} == plain_core(tree + rings)


def test_a_chain_of_pointers_moves_a_few_times_its_rows(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_POINTERS", 256)
    written, write = [], graph.write_scratch
    monkeypatch.setattr(graph, "write_scratch", lambda df, name: (lambda out: written.append(out.count()) or out)(write(df, name)))
    chain = spark.range(2048).select((F.col("id") + 1).alias("node"), F.col("id").alias("to"), F.lit(1).cast("long").alias("far"),
                                     F.lit(0).cast("long").alias("least"))
    led, circles = graph._follow(write(chain, "pointers"), graph._rounds(None))
    assert not circles and led.where("to <> 0 or far <> node").count() == 0 and led.count() == 2048
    assert sum(written) < 10 * 2048


@pytest.mark.parametrize("keys", [list(range(9)), [5, 1, 3, 3, None, 8, 3, 2**53 + 1, None, 2**53 + 3], [4, 7]])
def test_the_middle_of_a_chain_is_found_without_holding_its_keys(spark, tmp_path, monkeypatch, keys):
    from tieout.queries import QUERIES

    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    given = []
    monkeypatch.setattr(graph, "topological_levels", lambda edges: given.append(edges))
    assert QUERIES["order_chain_with_cycle"](spark, str(tmp_path)).collect() == [(len(keys), False)]
    placed = sorted(keys, key=lambda k: (k is not None, k or 0))
    sources = [k for k in placed[:-1] if k is not None]
    chain = list(zip(placed, placed[1:]))
    assert sorted(map(repr, map(tuple, given[0].collect()))) == sorted(map(repr, [*chain, (placed[-1], sources[(len(sources) - 1) // 2])]))
    assert "percentile" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
