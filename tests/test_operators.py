import pytest
from pyspark.sql import functions as F

from assayworks.operators import cleaning, consensus, detection, matching, references, review, shape, tags, toxval, unit_build
from assayworks.sources import files


def test_cleaning_chain_and_audit(spark):
    df = spark.createDataFrame([(1, "  Benzene (pure) ", "71-43-2"), (2, "xylene, dimethylbenzene, xylol", "1330-20-7"), (3, "(+)-x µ", None)], "original_row_id long, name string, cas string")
    step = cleaning.run(df, {"name": "Name", "cas": "CASRN"})
    rows = step.data.orderBy("original_row_id", "synonym_index").collect()
    assert [r["name"] for r in rows] == ["Benzene", "xylene", "dimethylbenzene", "xylol", "(+)-x u"]
    assert [r["cas"] for r in rows] == ["71-43-2", "1330-20-7", None, None, None]
    assert rows[4]["cleaning_flag"] == cleaning.CHIRAL_FLAG and rows[0]["formula_extract_name"] == "pure"
    steps = {(r["row_id"], r["step"]) for r in step.audit.collect()}
    assert {(1, "strip_terminal_enclosures"), (2, "split_synonyms"), (3, "unicode_to_ascii")} <= steps
    assert step.data.filter("name = 'xylol'").count() == 1  # a filter on the result ends


def test_mask_and_rescue(spark):
    df = spark.createDataFrame([(1, "acetone 67-64-1", None), (2, "none 12-34-5", "x")], "original_row_id long, name string, cas string")
    got = cleaning.rescue_cas_step(df, {"name": "Name", "cas": "CASRN"})
    assert [(r["name"], r["cas_extract_name"]) for r in got.data.orderBy("original_row_id").collect()] == [("acetone", "67-64-1"), ("none", None)]
    with pytest.raises(ValueError):
        cleaning.normalized_mask({"nothing": True})


def test_flags(spark):
    df = spark.createDataFrame([(1, "Sample"), (2, "a sample of x"), (3, "proprietary"), (4, "benzene")], "original_row_id long, name string")
    for kind, how, label in (("stop_words", "warning", "stop word"), ("block_patterns", "blocking", "blocked")):
        df = cleaning.flag_references_step(df, ["name"], references.as_terms(references.default_list(spark, kind)), how, label).data
    assert [r["cleaning_flag"] for r in df.orderBy("original_row_id").collect()] == ["WARN: stop word [exact]", "WARN: stop word [substring]", "BLOCK: blocked [substring]", None]


def test_consensus_and_resolution(spark):
    rows = [(1, "silica", "D1", "D2", "Silica", "Estradiol"), (2, "silica", "D1", "D3", "Silica", "Silica gel"), (3, "x", "D1", "D1", "a", "a"), (4, "x", None, None, None, None), (5, "x", "D1", None, "a", None)]
    df = spark.createDataFrame(rows, "original_row_id long, name string, dtxsid_a string, dtxsid_b string, preferredName_a string, preferredName_b string")
    got = consensus.classified(df)
    assert [r["consensus_status"] for r in got.orderBy("original_row_id").collect()] == ["disagree", "disagree", "agree", "error", "single"]
    done = {r["original_row_id"]: r for r in consensus.auto_resolved(got, "name").collect()}
    assert done[1]["consensus_status"] == "auto_resolved" and done[1]["consensus_dtxsid"] == "D1" and done[2]["consensus_status"] == "suggested"
    chained = {r["original_row_id"]: r["consensus_dtxsid"] for r in consensus.by_priority(got, ["dtxsid_b", "dtxsid_a"]).collect()}
    assert chained[1] == "D2" and chained[3] == "D1"


def test_detection(spark):
    df = spark.createDataFrame([(1, 5.0, 5.0, None), (2, 6.0, 5.0, None), (3, None, 5.0, None), (4, 4.8, 5.0, 1.0), (5, -1.0, 5.0, None), (6, 1.0, None, None)], "i int, result_value double, reporting_limit_value double, uncertainty_value double")
    got = [r["detection_event_class"] for r in detection.classified(df).orderBy("i").collect()]
    assert got == ["non_reportable", "robust_reportable_detect", "indeterminate", "threshold_ambiguous", "review_required", "review_required"]
    assert detection.classified(df, operator=">=").filter("i = 1").first()["result_flag"]
    with pytest.raises(ValueError):
        detection.classified(df.withColumn("result_flag", F.lit(True)))


def test_matching(spark):
    names = spark.createDataFrame([("Benzene",), ("arsenick",), ("zzz",)], "search_value string")
    d = spark.createDataFrame([("Arsenic", "Arsenic", "canonical"), ("Benzol", "Benzene", "synonym")], "name string, canonical_name string, type string")
    got = {r["input_name"]: r for r in matching.match_wqx(names, d).collect()}
    assert got["arsenick"]["wqx_name"] == "Arsenic" and got["arsenick"]["match_tier"] == "wqx_fuzzy" and got["zzz"]["match_tier"] == "miss"


def test_shape_and_tags(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Report,,\n,,\nChemical Name,CAS Number,Result\nBenzene,71-43-2,5\nToluene,108-88-3,6\n")
    grid = files.read(spark, f"file://{path}")
    start = shape.detect_start(grid)
    assert start.header_row == 3
    df = shape.without_empty(shape.sliced(grid, start))
    assert df.columns == ["_row", "Chemical Name", "CAS Number", "Result"] and df.count() == 2
    assert tags.suggest(["Chemical Name", "CAS Number", "Sample ID", "Result Value", "Units"]) == {"Chemical Name": "Name", "CAS Number": "CASRN", "Result Value": "Result", "Units": "Unit"}
    assert shape.clean_names(["A b", "A b", "%x"]) == ["a_b", "a_b_2", "percent_x"]


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a<b", None), ("ü", "2")], "x string, y string")
    files.write_xlsx({"One": df}, str(tmp_path / "t.xlsx"))
    got = files.read_xlsx(spark, f"file://{tmp_path}/t.xlsx").orderBy("_row").collect()
    assert [tuple(r)[1:] for r in got] == [("x", "y"), ("a<b", None), ("ü", "2")]


def test_override_round_trip(spark):
    before = consensus.with_state(spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "y")], "original_row_id long, name string, k string"))
    after = before.withColumn("row_flag", F.when(F.col("original_row_id") == 3, "BAD"))
    spec = review.build(before, after, {"name": "Name"})
    assert spec.overrides and review.replayed(before, spec).filter("row_flag = 'BAD'").count() == 1
    with pytest.raises(ValueError):
        review.replayed(before, review.Spec([review.Override("row_flag", "BAD", {"name": "none"})]))
    assert "Override(" in review.script("in", "out", {}, 1, spec)


def test_output_schema(spark):
    assert len(toxval.COLUMNS) == 56
    c = spark.createDataFrame([(1, "D1", "benzene")], "original_row_id long, dtxsid string, name string")
    h = spark.createDataFrame([(1, 5.0, "mg/L", "ug/L"), (1, 6.0, "mg/L", "ug/L")], "orig_row_id long, harmonized_value double, harmonized_unit string, orig_unit string")
    got = toxval.mapped(c, h)
    toxval.assert_typed(got)
    rows = got.collect()
    assert len(rows) == 2 and rows[0]["qc_status"] == "pass" and len({r["source_hash"] for r in rows}) == 2


def test_unit_build(spark):
    raw = spark.createDataFrame([("gram per liter", "g/l", 1.0, "", 1), ("M", "mol/l", 1.0, None, 2)], "orig string, cur_target string, ecotox_mult double, domain string, ord int")
    got = {r["from_unit"]: r for r in unit_build.transformed(raw).collect()}
    assert got["gram per liter"]["multiplier"] == 1000.0 and got["M"]["to_unit"] == "NEEDS_MW" and got["M"]["multiplier"] is None


def test_streams(spark, tmp_path):
    from assayworks.streaming import rows

    spark.createDataFrame([("Benzene (pure)",), ("2015",)], "name string").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("name string").parquet(f"file://{tmp_path}/in")
    q = rows.cleaned(stream, {"name": "Name"}).select("name").writeStream.format("memory").queryName("cleaned_names").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["name"] for r in spark.table("cleaned_names").collect()} == {"Benzene", "2015"}


def test_queries_of_all_tiers_equal_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from assayworks.plans import catalog

    names_ = "ALGERIA ARGENTINA BRAZIL CANADA EGYPT ETHIOPIA FRANCE GERMANY INDIA INDONESIA IRAN IRAQ JAPAN JORDAN KENYA MOROCCO MOZAMBIQUE PERU CHINA ROMANIA SAUDI_ARABIA VIETNAM RUSSIA UNITED_KINGDOM UNITED_STATES".split()
    spark.createDataFrame([(i, n.replace("_", " ")) for i, n in enumerate(names_)], "n_nationkey long, n_name string").coalesce(1).write.parquet(f"file://{tmp_path}/nation.parquet")
    db = duckdb.connect()
    db.execute(f"create view nation as select * from read_parquet('{tmp_path}/nation.parquet/*.parquet')")
    for query, tiers in (("wqx_tiers", {"wqx_exact", "wqx_alias", "wqx_fuzzy", "miss"}), ("tiered_lookup", {"exact", "cas_in_name", "wqx_alias", "wqx_fuzzy", "starts_with", "cas", "cas_miss", "cas_invalid"})):
        got = catalog.queries()[query](spark, f"file://{tmp_path}")
        want = db.execute(catalog.oracle_sql()[query])
        rows = got.select([c[0] for c in want.description]).collect()
        assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want.fetchall()))
        assert {t for r in rows for t in r if t in tiers} == tiers


def test_unicode_query_takes_whole_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from assayworks.functions.text import UNICODE
    from assayworks.plans import catalog

    texts = [None, "", "plain", "É È Ñ Ó Ç Ê Ü Ö Ä Í stay", "a" + "".join(UNICODE) + "z", "e\u0301 中\n🙂 α-naphthol 10⁻³ µg ‘x’"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = sorted(map(tuple, catalog.queries()["unicode_ascii"](spark, f"file://{tmp_path}").collect()))
    assert got == sorted(db.execute(catalog.oracle_sql()["unicode_ascii"]).fetchall())
    import hashlib

    whole = "".join(["a", *UNICODE.values(), "z"])
    assert got[4][1] == hashlib.md5(whole.encode()).hexdigest() and got[3][1] == hashlib.md5(texts[3].encode()).hexdigest()
