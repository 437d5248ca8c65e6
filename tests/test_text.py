"""Golden rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from assaymill.functions import formula as M
from assaymill.functions import geometry as G
from assaymill.functions import jsonish as J
from assaymill.functions import text as T

VALUES = {
    "12.5 nM": "12.5 nM", ">1000": ">1000", "-": None, "--": "--", "-5.2": "-", "1-5": "-", "1e-9": "-", "1,200 nM": "1", "Signal": "na", "amount 5": "nt", "+++++++": "+++++",
    "0.5%": "0.5 %", "++ (3)": "++", "|7|": "7", "inactive": "inactive", "≤ 3 uM": "≤ 3 uM", "None": None, "": None, None: None, "(": None, "xyz": None,
}
TABLE_IDS = {"Example 7": "7", "Cpd. 12a": "12a", "100-7": "100", "12345": "1234", "(3b)": "3b", "#007": "007", "Example": None, "Exhibit 4": "4", None: None, "": None}
MERGE_IDS = {"#007": "7", "100-7": "100-7", "12345": "12345", "(3b)": "(3b)", "Exhibit 4": "hibit 4", "Examples 9": "s 9", None: None}
REPAIRS = {"12b": "126", "12a": "12a", "12B": "123", "1OO": "100", "l0-s": "10-5", "110a": "110a", "abc": "abc", "1|2": "1|2", "1|2b": "1126"}
PLUS = {"+444": "++++", "44": "++", "H+": "+", "++t": "++", "+4+": "+++", "abc": "abc", "+4+4+x": "+++++x"}
NAMES = {"ICso": "IC50", "lC-50": "IC50", "Glso (nM)": "GI50 (nM)", "EC 9O": "EC90", "Ernax": "Emax", "Ki": "Ki"}
HEADERS = {
    "AcCoA (nM) AcCoA (nM) AcCoA (nM)": "AcCoA (nM)", "Exam- 3": "Assay 3", "mple IC50 (nM)! count Compound Name": "IC50 (nM)", "No. (mM) (nM)": None, "7": "Assay_7", " ": None,
    "a very long sentence about the inhibition of some enzyme by the compounds": "% inhibition", "No.": "No.",
}
LABELS = {"Compound 7": "7", "12a": "12a", "HoN2Se": None, "PCT/US": None, "12345": None, "Example iv": "iv", "a long label text": None}


@pytest.mark.parametrize(
    "function,table",
    [(T.parse_value, VALUES), (T.table_id, TABLE_IDS), (T.merge_id, MERGE_IDS), (T.repair_digits, REPAIRS), (T.plus_signs, PLUS), (T.repair_assay_name, NAMES), (T.clean_header, HEADERS), (T.label_id, LABELS)],
    ids=lambda x: getattr(x, "__name__", ""),
)
def test_golden(spark, function, table):
    df = spark.createDataFrame([(k,) for k in table], "x string").select("x", function(F.col("x")).alias("y"))
    assert {r.x: r.y for r in df.collect()} == table


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_more_scalars(spark):
    x = F.lit
    assert one(spark, T.strict_value(x("-5.2")), T.strict_value(x("1e-9")), T.strict_value(x("1,200 nM")), T.strict_value(x("Signal"))) == ("-5.2", "1e-9", "1,200 nM", None)
    assert one(spark, T.truth_id(x("12.0")), T.reference_id(x("Ex. 85")), T.reference_id(x("85")), T.number_base(x("007a")), T.number_base(x("1-2"))) == ("12", "85", "85", "7", None)
    assert one(spark, T.ocr_value(x("ttt"), x(50)), T.ocr_value(x("ttt"), x(30)), T.ocr_value(x("—"), x(1)), T.ocr_value(x("12.5 nM"), x(1)), T.ocr_value(x("1234"), x(1)), T.ocr_value(x("b"), x(60)), T.ocr_value(x("He"), x(60))) == ("+++", None, "-", "12.5 nM", "1234", "B", "++")
    assert one(spark, T.heading_id(x("see Example 12.3a now")), T.eta(x(59)), T.eta(x(61)), T.eta(x(3700))) == ("12.3a", "59 sec", "1 min 1 sec", "1 hr 1 min")
    assert one(spark, T.largest_fragment(x("CCCCCC.C")), T.largest_fragment(x("CCC.CC")), T.smiles_answer(x("```\nCCO\n```")), T.smiles_answer(x("NONE")), T.smiles_answer(x("no idea what"))) == ("CCCCCC", "CCC.CC", "CCO", None, None)
    assert one(spark, T.display_smiles(x(""), x("bad")), T.validity(x("C"), x(False)), T.validity(x(None).cast("string"), x(True))) == ("ERROR: bad", "Invalid", "N/A")
    assert one(spark, T.is_analytical(x("1H NMR (400 MHz, DMSO) yield")), T.is_analytical(x("1H NMR (400 MHz) ic50")), T.looks_two_column(x("a\nExample 1 Example 2"))) == (True, False, True)
    assert one(spark, T.near_section(x("EXAMPLES\nStep 1 synthesis")), T.near_section(x("EXAMPLES\nThe following examples are meant to be illustrative")), T.near_section(x("CLAIMS"), claims=True)) == (True, False, True)


def test_formula(spark):
    x = F.lit
    e, m, p, zero = one(spark, M.element_map(x("C2H6NaClC")), M.mass(x("C2H6O")), M.ppm(x(100.001), x(100.0)), M.ppm(x(1.0), x(0.0)))
    assert e == {"C": 3, "H": 6, "Na": 1, "Cl": 1} and abs(m - 46.041865) < 1e-5 and abs(p - 10) < 1e-6 and zero == 0
    same, close, far = (one(spark, M.compare(x("C2H6O"), x(46.041865), x(f).cast("string"), x(r)))[0].status for f, r in (("OC2H6", 47.0), (None, 47.0), ("C2", 60.5)))
    assert (same, close, far) == ("match", "mass_only_match", "mismatch")
    assert one(spark, M.tanimoto(F.array(x(7)), F.array(x(3))), M.tanimoto(F.array(x(0)), F.array(x(0)))) == (pytest.approx(2 / 3), 0.0)


def test_geometry(spark):
    b = lambda *v: tuple(F.lit(k) for k in v)
    assert one(spark, G.iou(b(0, 0, 10, 10), b(5, 0, 15, 10)), G.iou(b(0, 0, 0, 0), b(0, 0, 0, 0))) == (pytest.approx(1 / 3), 0.0)
    assert one(spark, G.is_structure_size(b(0, 0, 50, 250)), G.is_structure_size(b(0, 0, 50, 251)), G.is_scheme(b(0, 0, 60, 40), F.lit(100), F.lit(100)), G.padding(F.lit(1000), F.lit(1000))) == (True, False, True, 50)
    made = one(spark, G.to_pixels(*[F.lit(v) for v in (10.0, 90.0, 50.0, 40.0, 100.0, 100.0)], F.lit(200), F.lit(200), F.lit(True)))[0]
    assert tuple(made) == (20, 20, 100, 120)
    assert one(spark, G.progress(F.lit(2), F.lit(4), F.lit(1), F.lit(2)), G.region(b(0, 0, 10, 100), "left", F.lit(100), F.lit(100))) == (37.5, None)


def test_json(spark):
    x = F.lit
    get = lambda text, n: [tuple(e) for e in one(spark, J.entries(x(text), x(n)))[0]]
    assert get('ok ```json\n{"1": {"type": "example_compound", "id": "25"}, "2": "other",}\n```', 2) == [("example_compound", "25"), ("other", None)]
    assert get('{"85": {"type":"example_compound","id":"85"}, "86": "other"}', 2) == [("example_compound", "85"), ("other", None)]
    assert get("no json here", 2) == [("other", None)] * 2
    assert get("{'1': {'type': 'odd', 'id': 'null'}}", 1) == [("other", None)]
    refs = one(spark, J.formula_refs(x('```json\n[{"formula":"C2H6O","mass":"47.05","compound_id":" 7 ","source":"hrms"},{"formula":null,"mass":null},{"mass":"x","formula":"CH4"}]\n```')))[0]
    assert [(r.formula, r.mass, r.compound_id, r.source, r.confidence) for r in refs] == [("C2H6O", 47.05, "7", "hrms", 0.95), ("CH4", None, None, "formula_only", 0.7)]
    assert one(spark, J.formula_refs(x("broken")))[0] == []
