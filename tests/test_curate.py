from assayworks.plans.curate import curate


def test_headless_run(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text('Report,,,,\n,,,,\nChemical Name,CAS Number,Result,Units,Reporting Limit\nBenzene (pure),71-43-2,<5,ug/L,1\n"xylene, dimethylbenzene, xylol",1330-20-7,5-10,mg / L,2\n')
    got = curate(spark, f"file://{path}", f"file://{tmp_path}/out")
    assert got.tags["chemical_name"] == "Name" and got.data.count() == 4
    rows = [(r["name"], r["casrn"], r["toxval_numeric"], r["toxval_units"]) for r in got.toxval.collect()]
    assert len(rows) == 1 + 3 * 3 and ("Benzene", "71-43-2", 0.005, "mg/L") in rows and ("xylol", None, 7.5, "mg/L") in rows
    assert spark.read.parquet(f"file://{tmp_path}/out/toxval.parquet").count() == 10
    assert {r["step"] for r in got.audit.collect()} >= {"strip_terminal_enclosures", "split_synonyms"}
