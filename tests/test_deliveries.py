import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tieout.errors import ContractError, ReadError
from tieout.operators import contract as C, drift as R
from tieout.operators.profile import coverage_status, is_redacted, profile
from tieout.plans.delivery import check_delivery, draft_contract, file_hash
from tieout.sources import delivery as D, files as FS, receipts as S
from tieout.operators import audit
from tieout.streaming.watch import sweep, watch


def write(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def read(spark, path, **options):
    df, layout = D.read_data(spark, path, **options)
    return df, layout, [tuple(r) for r in df.collect()]


BODY = "".join(f"cp{i:03d},{1000 * i}.5\n" for i in range(1, 41))


def test_plain_file(spark, tmp_path):
    df, layout, rows = read(spark, write(tmp_path, "a.csv", "﻿counterparty,EAD\n" + BODY))
    assert df.columns == ["counterparty", "EAD"] and len(rows) == 40 and dict(df.dtypes)["EAD"] == "double"
    assert layout.notes() == []


def test_preamble_and_totals_row(spark, tmp_path):
    df, layout, rows = read(spark, write(tmp_path, "a.csv", "Report run, by, hand, today\nJune\n\ncounterparty,EAD\n" + BODY + "Total:,820020.0\n"))
    assert (layout.header_row, layout.totals_row_excluded, len(rows)) == (3, True, 40)
    assert sum(r[1] for r in rows) == 820020.0


def test_tabs_quotes_and_folders(spark, tmp_path):
    _, _, rows = read(spark, write(tmp_path, "a.tsv", 'name\tn\n"a ""b"" c"\t1\n'))
    assert rows == [('a "b" c', 1)]
    many = tmp_path / "many"
    many.mkdir()
    for part in range(3):
        write(many, f"p{part}.csv", "Title\nname,n\n" + "".join(f"x{part}{i},{i}\n" for i in range(20)))
    df, layout, rows = read(spark, str(many))
    assert layout.header_row == 1 and len(rows) == 60 and {r[0][:2] for r in rows} == {"x0", "x1", "x2"}


def test_unlabelled_totals_need_sums_and_a_blank(spark):
    rows = [(i, f"n{i}", float(i)) for i in range(1, 7)]
    frame = lambda last: spark.createDataFrame(rows + [last], "o int, name string, v double")
    assert D.detect_totals_row(frame((7, None, 21.0)), "o")
    assert not D.detect_totals_row(frame((7, "n7", 21.0)), "o")
    assert not D.detect_totals_row(frame((7, None, 20.0)), "o")
    assert D.detect_totals_row(frame((7, " Grand Total: ", 5.0)), "o")
    assert not D.detect_totals_row(frame((7, "Total Energies", 5.0)), "o")
    assert not D.detect_totals_row(frame((7, "x", 0.0)).limit(1), "o")


@pytest.mark.parametrize("rows,at", [
    ([["a", "b"], ["1", "2"]], 0), ([["Title"], ["a", "b"], ["x", "1"]], 1), ([["prose", "with", "commas"], ["a", "b"], ["x", "1"], ["y", "2"]], 1),
    ([["1", "2"], ["a", "b"]], 1), ([["a", "A"], ["x", "y"]], 1), ([["1", "2"], ["3", "4"]], 0), ([[], []], 0), ([], 0)])
def test_header_row(rows, at):
    assert FS.layout_of(rows) == at


@pytest.mark.parametrize("lines,mark", [
    (["a\tb", "c\td"], "\t"), (["a,b", '"x,y",z'], ","), (["a;b", "1,5;2,5"], ";"), (["a|b,c", "d|e"], "|"), (["one", "two"], None), ([], None)])
def test_delimiter(lines, mark):
    assert FS.delimiter_of(lines) == mark


def test_text_numbers_are_typed_only_when_nothing_is_lost(spark):
    frame = spark.createDataFrame([("1,234.56", "00123", "1234567890123456", "5", None), ("", "1", "1", "n/a", None), (" 89.00", "2", "2", "6", "")],
                                  "a string, b string, c string, d string, e string")
    df, done = D.coerce_numeric_text(frame)
    assert [c.column for c in done] == ["a"] and done[0].rows == 2
    assert [r["a"] for r in df.collect()] == [1234.56, None, 89.0]
    assert D.coerce_numeric_text(frame, ["a"])[1] == ()


def test_pasted_grid_becomes_csv(spark, tmp_path):
    path = write(tmp_path, "paste.txt", 'id\tnote\n\n1\t"a\tb"\n2\tc\n\n(2 rows affected)\n')
    facts = D.normalise_delimited(spark, path, str(tmp_path / "out"))
    assert facts == {"delimiter": "\t", "columns": 2, "rows": 2, "dropped": ["(2 rows affected)"]}
    assert sorted(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "out")).collect())) == [("1", "a\tb"), ("2", "c")]
    with pytest.raises(ReadError, match="line 2 has 3 fields where the header has 2"):
        D.normalise_delimited(spark, write(tmp_path, "bad.txt", "a,b\n1,2,3\n"), str(tmp_path / "bad"))
    with pytest.raises(ReadError):
        D.normalise_delimited(spark, write(tmp_path, "none.txt", "\n \n"), str(tmp_path / "none"))


def test_unreadable_files(spark, tmp_path):
    with pytest.raises(ReadError):
        D.read_data(spark, write(tmp_path, "a.docx", "x"))
    with pytest.raises(ReadError):
        D.read_data(spark, write(tmp_path, "empty.csv", ""))


def test_parquet_delivery(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.createDataFrame([(1, "1,5"), (2, "2,5")], "n int, t string").coalesce(1).write.parquet(path)
    df, _, rows = read(spark, path)
    assert dict(df.dtypes) == {"n": "int", "t": "double"} and sorted(rows) == [(1, 15.0), (2, 25.0)]


def test_hashes_receipts_and_repeats(spark, tmp_path):
    inbox, store = tmp_path / "inbox", str(tmp_path / "store")
    inbox.mkdir()
    first = write(inbox, "June report (1).csv", "a,b\n1,2\n")
    write(inbox, "copy.csv", "a,b\n1,2\n")
    write(inbox, "~$lock.csv", "x")
    write(inbox, "half.csv.partial", "x")
    added = sweep(spark, str(inbox), store).collect()
    assert len(added) == 1 and added[0]["sha256"] == hashlib.sha256(b"a,b\n1,2\n").hexdigest() == file_hash(spark, first)
    assert open(added[0]["path"]).read() == "a,b\n1,2\n" and added[0]["path"].split("/")[-1].startswith(added[0]["sha256"][:12] + "-")
    assert sweep(spark, str(inbox), store).count() == 0
    write(inbox, "july.csv", "a,b\n3,4\n")
    assert sweep(spark, str(inbox), store, settle_seconds=3600).count() == 0
    assert [r["original_name"] for r in sweep(spark, str(inbox), store).collect()] == ["july.csv"]
    assert S.receipts(spark, store).count() == 2


@pytest.mark.parametrize("name,safe", [("June report (1).csv", "June-report-1-.csv"), ("...", "handin"), ("", "handin"), ("x" * 200 + ".csv", "x" * 116 + ".csv")])
def test_safe_names(values, name, safe):
    assert values([name], "string", S.safe_name) == [safe]


def test_watched_folder_is_taken_once(spark, tmp_path):
    inbox, store, seen = tmp_path / "inbox", str(tmp_path / "store"), []
    inbox.mkdir()
    write(inbox, "a.csv", "a\n1\n")
    write(inbox, "b.csv.partial", "a\n1\n")
    run = lambda: watch(spark, str(inbox), store, str(tmp_path / "progress"), once=True, on_received=lambda df: seen.extend(r["original_name"] for r in df.collect())).awaitTermination()
    run()
    run()
    write(inbox, "c.csv", "a\n2\n")
    run()
    assert seen == ["a.csv", "c.csv"]
    # A new stream over the same folder starts from nothing, yet the receipts keep it from adding anything.
    watch(spark, str(inbox), store, str(tmp_path / "again"), once=True).awaitTermination()
    assert S.receipts(spark, store).count() == 2


def test_previous_delivery_must_be_unchanged(spark, tmp_path):
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    path = write(tmp_path, "a.csv", "a\n1\n")
    row = S.receive_paths(spark, path, store).first()
    audit.record_event(spark, log, "r1", "load", "handin", row["sha256"])
    events = audit.read_events(spark, log)
    assert S.previous_delivery(spark, events, "r1", "load", store) == row["path"]
    assert S.previous_delivery(spark, events, "r1", "other", store) is None
    open(row["path"], "a").write("changed")
    assert S.previous_delivery(spark, events, "r1", "load", store) is None


def test_run_log(spark, tmp_path):
    log = str(tmp_path / "log")
    stamp = lambda minute: dt.datetime(2026, 1, 1, 0, minute, tzinfo=dt.timezone.utc)
    for step, value, minute in (("load", "a", 1), ("check", "ok", 2), ("load", "b", 3)):
        audit.record_event(spark, log, "r", step, "decision", value, at=stamp(minute))
    audit.record_parameters(spark, log, "r", rate=0.045)
    events = audit.read_events(spark, log)
    assert events.count() == 4
    assert {r["step"]: r["value"] for r in audit.latest_per_step(events).collect()} == {"load": "b", "check": "ok", "rate": "0.045"}
    assert [r["value"] for r in audit.audit_trail(events.where("kind = 'decision'")).collect()] == ["a", "ok", "b"]
    steps = spark.createDataFrame([("load",), ("sign",)], "step string")
    assert {r["step"]: r["completed"] for r in audit.steps_completed(steps, events).collect()} == {"load": True, "sign": False}


def test_profile_of_awkward_columns(spark):
    frame = spark.createDataFrame(
        [(i, "Alpha" if i % 2 else "alpha ", float("nan") if i == 3 else i - 5.0, None if i < 3 else "5,0", [1.0]) for i in range(10)],
        "n int, code string, v double, t string, e array<double>")
    for exact in (True, False):
        rows = {r["header"]: r for r in profile(frame, exact=exact, order=["n"], redact=["^v$", "(broken"]).collect()}
        code = rows["code"]
        assert code["distinct_count"] == 2 and code["category"] is False and any("whitespace" in a for a in code["format_anomalies"])
        # Frequent values and casing need the values themselves, which a sketch does not hold.
        assert (code["top_k"][0]["n"] == 5 and any(a.startswith("inconsistent casing") for a in code["format_anomalies"])) if exact else code["top_k"] is None
        assert rows["v"]["redacted"] and rows["v"]["numeric"] is None and rows["v"]["top_k"] is None and rows["v"]["head"] is None
        assert rows["t"]["null_count"] == 3 and rows["t"]["mostly_text_numbers"] and rows["n"]["head"] == ["0", "1", "2", "3", "4"] and rows["n"]["tail"][-1] == "9"
    assert rows["n"]["numeric"]["negative_count"] == 0 and rows["e"]["dtype"] == "List"
    infinite = profile(spark.createDataFrame([(float("inf"),), (0.0,)], "v double")).first()["numeric"]
    assert infinite["max"] is None and infinite["min"] == 0.0 and infinite["zero_count"] == 1
    empty = profile(frame.where("n > 99")).collect()
    assert [r["row_count"] for r in empty] == [0] * 5
    assert is_redacted("Account Number", ["account"]) and is_redacted("a(b", ["a(b"]) and not is_redacted("x", [])
    assert coverage_status(0, 0) == "not_applicable" and coverage_status(1000, 996) == "present" and coverage_status(10, 9) == "partial"


def shape(columns, rows=100, **layout):
    made = []
    for i, (name, dtype, extra) in enumerate(columns):
        made.append({"column_index": i, "header": name, "dtype": dtype, "row_count": rows, "null_count": 0, "distinct_count": 5, "numeric": None,
                     "top_k": [], "redacted": False, **extra})
    return R.DeliveryShape("sha", made, rows, **layout)


def found(before, after, **options):
    return [(i.kind, i.severity, i.column) for i in R.compare_shape(before, after, **options).items]


def test_drift(spark):
    numbers = {"numeric": {"min": 1.0, "max": 9.0, "sum": 45.0}}
    base = shape([("counterparty", "String", {}), ("EAD", "Float64", numbers)])
    assert R.compare_shape(None, base).items == () and found(base, base) == []
    assert found(base, shape([("counterparty", "String", {}), ("EAD_GBP", "Float64", numbers)])) == [("column_renamed", "WARNING", "EAD_GBP")]
    assert found(base, shape([("counterparty", "String", {}), ("EAD", "String", {})])) == [("numeric_to_text", "ERROR", "EAD")]
    assert found(base, shape([("counterparty", "String", {}), ("EAD", "Int64", {})])) == [("dtype_changed", "WARNING", "EAD")]
    assert found(base, shape([("counterparty", "String", {})])) == [("column_removed", "ERROR", "EAD")]
    assert found(base, shape([("EAD", "Float64", numbers), ("counterparty", "String", {}), ("extra", "Boolean", {})])) == [
        ("column_added", "INFO", "extra"), ("column_reordered", "INFO", None)]
    assert found(base, shape([("counterparty", "String", {"null_count": 30}), ("EAD", "Float64", {})])) == [("null_rate_shift", "WARNING", "counterparty")]
    assert found(shape([("a", "String", {"null_count": 30})]), shape([("a", "String", {})])) == [("null_rate_shift", "INFO", "a")]
    assert found(base, shape([("counterparty", "String", {}), ("EAD", "Float64", {})], rows=0)) == [("row_count_shift", "ERROR", None)]
    assert found(base, shape([("counterparty", "String", {}), ("EAD", "Float64", {})], rows=121)) == [("row_count_shift", "WARNING", None)]
    assert found(shape([("a", "String", {})]), shape([("a", "String", {})], preamble_rows=2, has_totals_row=True, sheet="S")) == [
        ("preamble_rows_changed", "WARNING", None), ("sheet_changed", "WARNING", None), ("totals_row_appended", "WARNING", None)]
    assert found(shape([("a", "String", {})], has_totals_row=True), shape([("a", "String", {})])) == [("totals_row_removed", "INFO", None)]
    assert found(shape([("alpha", "String", {})]), shape([("zzz", "Float64", {})])) == [("column_removed", "ERROR", "alpha"), ("column_added", "INFO", "zzz")]


FRAME = [("a", 1.0, "A"), ("b", 2.0, "BBB"), ("c", 3.0, "BB")]


def exposures(spark, rows=FRAME):
    return spark.createDataFrame(rows, "counterparty string, EAD double, rating string")


CONTRACT = C.Contract("exposures", [C.ColumnContract("counterparty", "String", nullable=False, unique=True), C.ColumnContract("EAD", "Float64", min_value=0),
                                    C.ColumnContract("rating", "String", allowed_values=["A", "BBB", "BB"])], min_rows=1, max_rows=5, unique_key=["counterparty", "EAD"])


def test_contract_checks(spark):
    good = C.validate(exposures(spark), CONTRACT)
    assert good.ok and [c.check for c in good.checks] == ["columns_present", "row_count", "dtype", "not_null", "unique", "dtype", "value_range", "dtype", "allowed_values", "unique_key"]
    bad = C.validate(exposures(spark, FRAME + [("a", -1.0, "C"), (None, None, "D"), ("a", 1.0, "A")]), CONTRACT)
    assert [(c.check, c.column) for c in bad.failures] == [
        ("row_count", None), ("not_null", "counterparty"), ("unique", "counterparty"), ("value_range", "EAD"), ("allowed_values", "rating"), ("unique_key", None)]
    assert [c.actual for c in bad.failures][1:4] == ["1 nulls", "2 duplicate value(s)", "min -1.0, max 3.0"]
    with pytest.raises(ContractError):
        bad.raise_for_status()
    gone = C.validate(exposures(spark).drop("EAD"), CONTRACT)
    assert [(c.check, c.status) for c in gone.checks if c.status in ("FAIL", "SKIP")] == [("columns_present", "FAIL"), ("dtype", "SKIP"), ("unique_key", "SKIP")]
    text = C.validate(spark.createDataFrame([("1",), ("x",)], "n string"), C.Contract("t", [C.ColumnContract("n", "Int64", min_value=5)]))
    assert [(c.check, c.status) for c in text.checks] == [("columns_present", "PASS"), ("dtype", "FAIL"), ("value_range", "FAIL")]
    many = spark.createDataFrame([(f"v{i}",) for i in range(9)], "n string")
    listed = C.validate(many, C.Contract("m", [C.ColumnContract("n", "String", allowed_values=["v0"])])).failures[0].actual
    assert listed == "v1, v2, v3, v4, v5, ... and 3 more"


@pytest.mark.parametrize("mode,status", [("ignore", None), ("warn", "WARN"), ("require", "FAIL")])
def test_checksum_modes(spark, mode, status):
    contract = C.Contract("c", [], checksum="abc", checksum_mode=mode)
    got = [c.status for c in C.validate(exposures(spark), contract, "other").checks if c.check == "checksum"]
    assert got == ([status] if status else [])
    if status:
        assert C.validate(exposures(spark), contract, "abc").checks[0].status == "PASS"


def test_contract_specifications(spark, tmp_path):
    assert C.Contract.from_json(CONTRACT.to_json()) == CONTRACT
    for text in ('{"name": "x", "colour": 1}', '{"name": " "}', "[]", "nope", '{"name": "x", "min_rows": -1}', '{"name": "x", "columns": [{"name": ""}]}'):
        with pytest.raises(ContractError):
            C.Contract.from_json(text)
    path = str(tmp_path / "contracts")
    C.save_contract(CONTRACT, spark, path)
    assert C.load_contract(spark, path, "exposures") == CONTRACT
    with pytest.raises(ContractError):
        C.load_contract(spark, path, "other")


def test_inferred_contract_holds_on_its_source(spark):
    frame = spark.range(40).select("id", (F.col("id") % 3).cast("string").alias("kind"), F.when(F.col("id") > 3, F.lit("1,5")).alias("t"))
    contract, notes = C.infer_contract(frame, "c")
    assert C.validate(frame, contract).ok
    assert contract.unique_key == ["id"] and contract.columns[1].allowed_values == ["0", "1", "2"] and (contract.min_rows, contract.max_rows) == (20, 61)
    assert contract.columns[2].nullable and any("WARNING" in n for n in notes["t"])
    with pytest.raises(ContractError):
        C.infer_contract(spark.range(1).drop("id"), "c")


def test_sketch_is_looser(spark):
    frame = spark.range(40).select("id", F.current_date().alias("d"), F.lit(None).cast("string").alias("blank"), F.lit("#N/A").alias("bad"), F.lit(" x").alias(" two  words "))
    contract, omitted = C.sketch_contract(profile(frame, exact=True).collect(), "s")
    assert [(c.name, c.dtype, c.nullable, c.unique) for c in contract.columns] == [("id", "Float64", False, True), ("d", "Any", True, False), ("two words", "String", True, False)]
    assert (contract.min_rows, contract.max_rows, contract.checksum_mode) == (10, 160, "ignore") and len(omitted) == 2
    assert C.validate(frame.withColumnRenamed(" two  words ", "two words"), contract).ok
    few = profile(frame.limit(10), exact=True).collect()
    assert C.sketch_contract(few, "s")[0].min_rows is None
    assert C.sketch_contract(profile(frame, exact=True).collect(), "s", truncated=True)[0].max_rows is None


def test_whole_delivery(spark, tmp_path):
    store = str(tmp_path / "store")
    first = write(tmp_path, "june.csv", "counterparty,EAD\n" + BODY)
    contract, _ = draft_contract(spark, first, "exposures")
    june = check_delivery(spark, first, store, contract)
    assert june.drift.items == () and june.validation.ok
    S.accept_shape(spark, store, june.shape)
    second = write(tmp_path, "july.csv", "July\ncounterparty,EAD_GBP\n" + BODY + "Total,1\n")
    july = check_delivery(spark, second, store, contract)
    assert {i.kind for i in july.drift.items} == {"column_renamed", "preamble_rows_changed", "totals_row_appended"}
    assert not july.validation.ok and {c.check for c in july.validation.failures} == {"columns_present"}
    assert july.validation.warnings and S.last_accepted(spark, store).sha256 == june.shape.sha256


def test_labels_repeated_on_a_header_row(spark, tmp_path):
    from tieout.operators.frames import duplicate_headers

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    write(inbox, "a.csv", "Title\nRef,Amount, amount \n1,2,3\n")
    write(inbox, "b.csv", "Ref,Amount\n1,2\n")
    labels = FS.header_labels(FS.list_files(spark, str(inbox)))
    # The first file has no row of distinct labels, so its first row counts as the header.
    assert duplicate_headers(labels, "path", "label").count() == 0
    rows = spark.createDataFrame([("a", "Amount"), ("a", " amount"), ("a", ""), ("a", ""), ("b", "Amount")], "path string, label string")
    assert [tuple(r) for r in duplicate_headers(rows, "path", "label").collect()] == [("a", "amount", 2)]


def test_columns_with_odd_names(spark):
    from tieout.operators.ordered import prior_row, running_total

    frame = spark.createDataFrame([("x", 1, 2.0), ("x", 2, 3.0)], ["a.b", "c`d", "it's"])
    assert [r["t"] for r in running_total(frame, ["a.b"], ["c`d"], "it's", "t").orderBy("t").collect()] == [2.0, 5.0]
    assert prior_row(frame, ["a.b"], ["c`d"], {"p": "it's"}).where("p = 2.0").count() == 1
    assert [r["header"] for r in profile(frame, exact=True).orderBy("column_index").collect()] == frame.columns
    contract, _ = C.infer_contract(frame, "odd")
    assert C.validate(frame, contract).ok


def test_files_of_one_delivery_keep_their_own_layout(spark, tmp_path):
    (tmp_path / "1.csv").write_text("id,name,amount\n1,\"a, b\",2\n2,c,3\n")
    (tmp_path / "2.csv").write_text("Report of the day\n\namount,id,name\n5,7,x\n6,8,\n")
    rows, layout = D.read_data(spark, str(tmp_path))
    assert sorted(map(tuple, rows.select("id", "name", "amount").collect())) == [(1, "a, b", 2), (2, "c", 3), (7, "x", 5), (8, None, 6)]
    assert layout.preamble_rows == 2
    (tmp_path / "3.csv").write_text("id,name\n1,z\n")
    with pytest.raises(ReadError, match="amount"):
        D.read_data(spark, str(tmp_path))


def test_every_file_may_end_in_a_totals_row(spark, tmp_path):
    for n in (1, 2):
        lines = [f"k{i},{i * n}" for i in range(1, 6)]
        (tmp_path / f"{n}.csv").write_text("\n".join(["key,amount", *lines, f"Total:,{15 * n}"]) + "\n")
    rows, layout = D.read_data(spark, str(tmp_path))
    assert layout.totals_row_excluded and rows.count() == 10 and rows.agg(F.sum("amount")).first()[0] == 45


@pytest.mark.parametrize("line,why", [("2,y,LOST", "3 fields"), ("2", "1 fields"), ('3,"a', "quote open")])
def test_lines_that_do_not_fit_are_refused(spark, tmp_path, line, why):
    (tmp_path / "x.csv").write_text(f"a,b\n1,x\n{line}\n")
    with pytest.raises(ReadError, match=why):
        D.read_data(spark, str(tmp_path))


def test_a_batch_costs_what_its_files_cost(spark, tmp_path, monkeypatch):
    from tieout.streaming import watch as W

    inbox, store = tmp_path / "inbox", str(tmp_path / "store")
    inbox.mkdir()
    looks, width = [], spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(W, "receipts", lambda *a: looks.append(a) or S.receipts(*a))
    for n in range(3):
        write(inbox, f"{n}.csv", f"a\n{n % 2}\n")
    run = lambda: W.watch_distinct(spark, str(inbox), store, str(tmp_path / "progress"), once=True, files_per_trigger=1).awaitTermination()
    run()
    assert len(looks) == 1 and S.receipts(spark, store).count() == 2
    assert len([p for p in (tmp_path / "progress/state/0").iterdir() if p.name.isdigit()]) == 1
    write(inbox, "3.csv", "a\n7\n")
    write(inbox, "4.csv", "a\n1\n")
    run()
    assert len(looks) == 2 and S.receipts(spark, store).count() == 3
    assert spark.conf.get("spark.sql.shuffle.partitions") == width
