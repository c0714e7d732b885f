"""What has no cap any more, what is refused instead, and round trips of sessions, lists and overrides."""

import pytest
from pyspark.sql import functions as F

from assayworks.functions import numeric, text, units
from assayworks.operators import audit, cleaning, consensus, matching, media, references, review, shape, unit_build
from assayworks.sources import files, shared


def test_dedup_changes_no_result(spark):
    rows = [(i, ["Technical x (pure)", " Y, unspecified", None, "(+)-z"][i % 4], "67-64-1") for i in range(60)]
    df = spark.createDataFrame(rows, "original_row_id long, name string, cas string")
    a, b = (cleaning.run(df, {"name": "Name", "cas": "CASRN"}, use_dedup=d) for d in (True, False))
    key = lambda s: sorted(map(repr, s.data.select(sorted(s.data.columns)).collect()))
    log = lambda s: sorted(map(repr, s.audit.collect()))
    assert key(a) == key(b) and log(a) == log(b) and a.audit.count() > 60
    checked = cleaning.run(df, {"name": "Name", "cas": "CASRN"}, respect_prechecks=True)
    assert key(checked) == key(b)


def test_units_by_distinct_and_by_row(spark):
    rows = [(1.0, "mg / L", "aqueous", 2.0), (2.0, "M", None, 100.0), (2.0, "M", None, None), (3.0, "ppb", "air", None), (4.0, None, None, None), (5.0, "m", None, None)] * 3
    df = spark.createDataFrame(rows, "v double, _unit string, m string, w double")
    got = [sorted(map(repr, units.harmonized(df, units.unit_map(spark), "v", "_unit", "m", "w", dedup=d).collect())) for d in (True, False)]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_unicode_of_wide_and_marked_text(apply):
    assert apply(text.clean_unicode, ["a𝛂b𝛃", "αβ", "x\u0001αy", "É→𝟘", ""]) == ["aalphabbeta", "alphabeta", "x\u0001alphay", "É->𝟘", ""]


def test_numbers_as_people_write_them(spark):
    values = [" <= 1,234.5", "1 x10^3", "3X10^2", "≥ 7", "2 - 3", "-1.5e3", "<", "~.5", "1,2,3,4"]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    got = {}
    for r in numeric.parsed(df, "x").filter("parse_flag <> 'x'").collect():
        got.setdefault(r["orig_result"], []).append((r["qualifier"], r["numeric_value"], r["parse_flag"]))
    assert got[" <= 1,234.5"] == [("<=", 1234.5, "")] and got["3X10^2"] == [("", 300.0, "")] and got["≥ 7"] == [(">=", 7.0, "")]
    assert sorted(got["2 - 3"]) == [("<=", 3.0, ""), (">=", 2.0, ""), ("~", 2.5, "")] and got["-1.5e3"] == [("", -1500.0, "")]
    assert got["1 x10^3"] == [("", None, "unparseable")] and got["<"] == [("<", None, "narrative")] and got["~.5"] == [("~", 0.5, "")] and got["1,2,3,4"] == [("", 1234.0, "")]


def test_csv_is_judged_by_the_whole_file(spark, tmp_path):
    late = tmp_path / "late.csv"
    late.write_bytes(b"a,b\n" + b"x,y\n" * 40_000 + b"caf\xe9,1\nq,\"1\n2\",z\n")
    grid = files.read_csv(spark, f"file://{late}")
    last = grid.orderBy(F.col("_row").desc()).limit(2).collect()
    assert [tuple(r)[1:] for r in last] == [("q", "1\n2", "z"), ("café", "1", None)] and grid.count() == 40_003
    wide = tmp_path / "wide.csv"
    wide.write_text("Report\na;b;c\n1;\"2;x\";3\n")
    assert [tuple(r) for r in files.read_csv(spark, f"file://{wide}").orderBy("_row").collect()] == [(1, "Report", None, None), (2, "a", "b", "c"), (3, "1", "2;x", "3")]
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(ValueError):
        files.read_csv(spark, f"file://{empty}")


def test_too_much_is_refused(spark, monkeypatch):
    df = spark.createDataFrame([(1, "U238")], "original_row_id long, name string")
    isotopes = spark.createDataFrame([("U", str(m), "Uranium", None) for m in (234, 235, 238)], "symbol string, mass string, element_name string, dtxsid string")
    assert cleaning.expand_isotopes_step(df, ["name"], isotopes).data.first()["name"] == "Uranium-238"
    monkeypatch.setattr(cleaning, "MAX_ISOTOPES", 2)
    with pytest.raises(ValueError):
        cleaning.expand_isotopes_step(df, ["name"], isotopes)
    nodes = spark.createDataFrame([("a", None, "x"), ("b", "a", "y"), ("c", "b", "z")], "node_id string, parent_id string, routing_category string")
    assert media.validate_ontology(nodes) == [f"unknown route {r} of {n}" for n, r in (("a", "x"), ("b", "y"), ("c", "z"))]
    monkeypatch.setattr(media, "MAX_TERMS", 2)
    with pytest.raises(ValueError):
        media.validate_ontology(nodes)
    rules = spark.createDataFrame([("a", "(", "regex"), ("b", "x", "regex"), ("c", "", "regex")], "term string, pattern string, match_mode string")
    assert [p[:2] for p in references.problems(rules)] == [("error", "a"), ("error", "c")]
    with pytest.raises(ValueError):
        references.problems(rules, most=2)
    monkeypatch.setattr(review, "MAX_OVERRIDES", 0)
    with pytest.raises(ValueError):
        review.replayed(df, review.Spec([review.Override("name", "x", {"name": "U238"})]))


def test_conflicting_routes_are_refused(spark):
    nodes = spark.createDataFrame([("a", None, "A", "air"), ("b", "a", "B", "solid")], "node_id string, parent_id string, label string, routing_category string")
    with pytest.raises(Exception, match="routes conflict"):
        media.ontology_index(nodes).collect()
    rows = spark.createDataFrame([("m", "b", "air", True)], "canonical_media string, ontology_node_id string, routing_category string, active boolean")
    index = media.ontology_index(nodes.withColumn("routing_category", F.lit("air")))
    assert media.canonical_with_paths(rows, index).first()["ontology_path"] == "A > B"
    with pytest.raises(ValueError):
        media.canonical_with_paths(rows.withColumn("ontology_node_id", F.lit("zz")), index)


def test_unknown_multi_analyte_actions_are_refused(spark):
    df = spark.createDataFrame([(1, "a and b", "x")], "original_row_id long, name string, cleaning_flag string")
    made = lambda action: review.resolve_multi_analyte(df, "name", spark.createDataFrame([(1, action, None)], "original_row_id long, action string, values string"))
    assert [r["name"] for r in made("Split").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="no such action"):
        made("drop").collect()


def test_overrides_of_several_kinds(spark):
    df = spark.createDataFrame([(1, "a", None, 1.5, True), (2, "b", None, 2.5, False), (3, None, "x", None, None)], "original_row_id long, k string, v string, d double, flag boolean")
    spec = review.Spec([review.Override("v", "one", {"k": "a", "d": 1.5}), review.Override("v", "none", {"k": None}), review.Override("v", "last", {"flag": True}), review.Override("n", 7, {"d": 2.5}), review.Override("flag", None, {"k": "b"}, "measurement")])
    got = {r["original_row_id"]: (r["v"], r["n"], r["flag"]) for r in review.replayed(df, spec).collect()}
    assert got == {1: ("last", None, True), 2: (None, 7, None), 3: ("none", None, None)}
    with pytest.raises(ValueError):
        review.replayed(df, review.Spec([review.Override("v", "x", {"k": "zz"})]))
    with pytest.raises(ValueError):
        review.replayed(df, review.Spec([review.Override("v", "x", {"gone": 1})]))
    assert {r["original_row_id"]: r["v"] for r in review.replayed_by_row(df, {2: {"v": "by row"}}).collect()}[2] == "by row"


def test_workbook_session_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([(1, "a"), (2, "b")], "original_row_id long, name string")
    curated = consensus.with_state(raw.withColumn("consensus_status", F.lit("single")))
    state = curated.withColumns({"pinned": F.col("original_row_id") == 2, "row_flag": F.when(F.col("original_row_id") == 1, "BAD")})
    lists = spark.createDataFrame([("stop words", "foo", "", "", "user", "true", "")], "type string, term string, pattern string, match_mode string, source string, active string, notes string")
    audit_rows = spark.createDataFrame([(1, "5", 5.0)], "orig_row_id long, orig_result string, numeric_value double")
    sheets = files.export_sheets(spark, {"Raw Data": raw, "Curated Data": curated, "Session State": files.session_state(state, consensus.summary(state), consensus.REVIEW), "Reference Lists": lists, "Harmonization Audit": audit_rows}, {"name": "Name"}, {"header_row": 3})
    path = str(tmp_path / "session.xlsx")
    files.write_export(sheets, path)
    got = files.hydrated(files.read_export(spark, f"file://{path}"), references.all_lists(spark))
    assert {(int(r["original_row_id"]), r["pinned"], r["row_flag"]) for r in got.curated.collect()} == {(1, False, "BAD"), (2, True, None)}
    assert got.tags == {"name": "Name"} and got.config["header_row"] == "3" and got.summary["single"] == 2.0 and not got.warnings
    assert got.harmonized.first()["numeric_value"] == 5.0 and got.lists["stop_words"].filter("term = 'foo' and source = 'imported'").count() == 1
    files.write_xlsx({"Other": raw}, str(tmp_path / "other.xlsx"))
    assert files.read_export(spark, f"file://{tmp_path}/other.xlsx") is None


def test_lists_in_a_folder(spark, tmp_path):
    folder = f"file://{tmp_path}/lists"
    assert references.user_list(spark, folder, "stop_words").count() == 0
    mine = references.updated(references.default_list(spark, "stop_words"), spark, "mine")
    references.save_user_lists({"stop_words": mine}, folder)
    got = references.all_lists(spark, folder)
    assert got["stop_words"].filter("term = 'mine'").count() == 1 and got["stop_words"].count() == len(references.STOP_WORDS) + 1 and references.help_text("Stop words")
    assert references.corrected_list(references.corrected_list(references.corrections(spark), "a", "b"), "a", "c").collect() == [("a", "c")]
    twice = mine.unionByName(mine.withColumn("notes", F.lit("n")))
    assert references.snapshot_hash(twice) == references.snapshot_hash(twice.repartition(5))


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Context:
        master = "spark://x"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(ValueError):
        shared.checkpoint_folder(Session())


def test_header_words(spark):
    rows = [["Report", None, None], ["x", "1", "2"], ["Chemical Name", "CAS Number", "Batch"], ["benzene", "1", "2"]]
    assert shape.by_keywords(rows).header_row == 3 and len(shape.KEYWORDS) == 39
    assert shape.by_keywords([["1", "2"]]).confidence == 0.2 and shape.by_keywords([]) is None


def test_incremental_units_and_audit(spark):
    t = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0)], "from_unit string, to_unit string, multiplier double")
    assert [r[0] for r in unit_build.changed_units(t, t.withColumn("multiplier", F.when(F.col("from_unit") == "b", 3.0).otherwise(F.col("multiplier")))).collect()] == ["b"]
    assert audit.empty_audit(spark).count() == 0 and matching.flattened_synonyms is not None


def test_the_entry_gives_sql_before_queries():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; o = e.oracle_sql(); assert set(o) <= set(e.queries()) and len(o) > 100"], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
