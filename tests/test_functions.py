import pytest
from pyspark.sql import functions as F

from assayworks.functions import cas, dates, names, numeric, text, units
from assayworks.functions.similarity import jaro


def test_text(apply):
    assert apply(text.clean_unicode, ["naïve µ α β≥Ω é 𝛂 ² ™ß 中", None]) == ["naive u alpha beta>=Omega e alpha 2 ss 中", None]
    assert apply(text.clean_text_field, ["  __a  b**", "67-64-1", "2,4-d"]) == ["a b", "67-64-1", "2,4-d"]


def test_cas(apply):
    assert apply(cas.as_cas, ["50-00-0", "0067641", "67-64-2", None, "x"]) == ["50-00-0", "67-64-1", None, None, None]
    assert apply(cas.is_cas, ["67-64-1", "67-64-2", None]) == [True, False, None]
    assert apply(cas.extract_cas, ["a 67-64-1 and 50000, 1-2-3"]) == [["67-64-1", "50-00-0"]]


def test_numbers(spark):
    values = ["5-10", "-10--5", "4.56+02", "1,234,567", "<5", "ND", "2020-01", "4.56-02", "1d", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    got = {}
    for r in numeric.parsed(df, "x").orderBy("i", "range_bin").collect():
        got.setdefault(r["orig_result"], []).append((r["numeric_value"], r["qualifier"], r["parse_flag"]))
    assert sorted(got["5-10"]) == [(5.0, ">=", ""), (7.5, "~", ""), (10.0, "<=", "")]
    assert sorted(v[0] for v in got["-10--5"]) == [-10.0, -7.5, -5.0]
    assert got["4.56+02"] == [(456.0, "", "")] and got["4.56-02"] == [(0.0456, "", "")]
    assert got["1,234,567"] == [(1234567.0, "", "")] and got["<5"] == [(5.0, "<", "")]
    assert got["ND"] == [(None, "", "narrative")] and got[None] == [(None, "", "narrative")] and got["1d"] == [(None, "", "unparseable")]
    assert sorted(v[0] for v in got["2020-01"]) == [1.0, 1010.5, 2020.0]


def test_units(spark):
    rows = [("mg / L", 1.0, "mg/L", ""), (" µg / L ", 0.001, "mg/L", ""), ("Bq/L", 27.027027027027, "pCi/L", ""), ("nCi/L", 1000.0, "pCi/L", ""), ("M", 100000.0, "mg/L", ""), ("ppb", 0.001, "mg/L", ""), ("ppt", 1.0, "ppt", "unmatched"), ("m", 1 / 60, "hr", "ambiguous_unit"), ("MG/L", 1.0, "mg/L", "case_fallback"), ("days", 24.0, "hr", "")]
    df = spark.createDataFrame([(1.0, r[0], "aqueous", 100.0) for r in rows], "v double, u string, m string, w double")
    got = {r["orig_unit"]: r for r in units.harmonized(df, units.unit_map(spark, durations=True), "v", "u", "m", "w").collect()}
    for unit, factor, to, flag in rows:
        assert got[unit]["conversion_factor"] == pytest.approx(factor) and (got[unit]["harmonized_unit"], got[unit]["unit_flag"]) == (to, flag)
    assert len(units.radiological_rows()) == 52


def test_dates(spark):
    want = {"2015-03-15": ("2015-03-15", ""), "20150315": ("2015-03-15", ""), "15MAR2015": ("2015-03-15", ""), "03/15/2015": ("2015-03-15", ""), "15/03/2015": ("2015-03-15", ""), "Mar 2015": ("2015-03-01", "partial"), "2015-03": ("2015-03-01", "partial"), "01/02/2015": ("2015-01-02", "ambiguous"), "3/4/15 14:30": ("2015-03-04", "inferred_format"), "xx": (None, "unparseable")}
    df = spark.createDataFrame([(k,) for k in want], "x string")
    got = {r["raw_date"]: (r["parsed_date"], r["date_flag"]) for r in df.select(*[c.alias(k) for k, c in dates.parsed(F.col("x")).items()]).collect()}
    assert got == want


def test_names(apply):
    assert apply(names.split_synonyms, ["xylene, dimethylbenzene, xylol", "butane, 2,2-dimethyl", "a;b"]) == [["xylene", "dimethylbenzene", "xylol"], ["butane, 2,2-dimethyl"], ["a", "b"]]
    assert apply(lambda c: names.strip_enclosures(c)[0], ["Silica (amorphous)", "x (propyl)", "Cr (III)", "a () "]) == ["Silica", "x (propyl)", "Cr (III)", "a"]
    assert apply(names.wqx_key, ["BENZO[A]ANTHRACENE", "dibenz [g, h, i] perylene"]) == ["benzo(a)anthracene", "dibenz(g,h,i)perylene"]
    isotopes = [("Ra", "228", "Radium"), ("Cs", "137", "Caesium"), ("U", "238", "Uranium")]
    assert apply(lambda c: names.expand_isotopes(c, isotopes, {"Cesium": "Caesium"}), ["Ra 228", "Cs-137", "u238 x", "cesium 137", "Ra 999"]) == ["Radium-228", "Caesium-137", "Uranium-238 x", "Caesium-137", "Ra 999"]
    assert apply(names.is_bare_formula, ["H2O", "NaCl", "Water", "ABC", None]) == [True, True, False, False, False]
    assert apply(lambda c: names.restore_chiral(names.protect_chiral(c)), ["(+)-x (R,S)"]) == ["(+)-x (R,S)"]


def test_jaro():
    assert jaro("arsenick", "arsenic") == pytest.approx(0.9583, abs=1e-4) and jaro("", "a") == 0 and jaro("a", "a") == 1


def test_wqx_key_of_many_commas(apply):
    wide = "(" + " , ".join(map(str, range(40))) + ")"
    assert apply(names.wqx_key, ["dioxin (1, 2, 3, 4, 6, 7, 8, 9)", f"x{wide}y", "a, b (1 ,2) c, (d e, f)", "1, 2"]) == ["dioxin(1,2,3,4,6,7,8,9)", f"x{wide.replace(' ', '')}y", "a, b(1,2)c, (d e, f)", "1, 2"]
