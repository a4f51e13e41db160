from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from strataq.functions.units import AREA_EDGES, Affine, ConversionGraph
from strataq.operators.quantities import convert_quantities, number

NOTES = [
    ("Ordinet", "Sizes are in square feet if nothing else is said."), ("LegalPress", "A size given without a unit is a number of acres."),
    ("CodeLibrary", "Units as printed; entries without one were not resolved."), ("CountyRoll", "Bare figures are in hundredths of an acre."),
    ("PlanDigest", "Bare figures are thousands of square feet."), ("SurveySheet", "Metric sheet. Bare figures are square metres."),
]
SCHEMA = "lot_id bigint, min_lot_size string, unit string, source string, lot_text string, want double"
M2 = 1 / 0.3048**2


def test_compositions_are_shortest_and_exact():
    graph = ConversionGraph()
    f, steps = graph.compositions("hectare")["square_foot"]
    assert f.scale == 10000 * Fraction(1562500, 145161) and steps == 2
    celsius, _ = graph.compositions("degree_celsius")["degree_rankine"]
    assert celsius == Affine(Fraction(9, 5), Fraction("491.67"))


def test_an_inconsistent_cycle_is_found():
    with pytest.raises(ValueError, match="inconsistent"):
        ConversionGraph([*AREA_EDGES, ("acre", "square_yard", "4841", "0")])
    with pytest.raises(ValueError, match="inverted"):
        ConversionGraph([("a", "b", "0", "1")])


@pytest.mark.parametrize(
    ("value", "unit", "source", "text", "want"),
    [
        ("2.5", "Acres", "Ordinet", None, 108900), ("8,400 square foot", None, "LegalPress", None, 8400), (" 10000 ", "sqft", "CountyRoll", None, 10000), ("120 000", "Sq. Feet", "Ordinet", None, 120000),
        ("35K", "sq ft", "Ordinet", None, 35000), ("130.68 thousand", "Square Feet", "Ordinet", None, 130680), ("135 ft by 180 ft", "feet", "Ordinet", None, 24300), ("85' x 215'", None, "Ordinet", None, 18275),
        ("185X120", "ft", "Ordinet", None, 22200), ("2½", "ac", "Ordinet", None, 108900), ("¾", "AC", "Ordinet", None, 32670), ("1 1/4", "acre(s)", "Ordinet", None, 54450), ("one-quarter acre", "-", "Ordinet", None, 10890),
        ("two and one-half (2 1/2) acres", "", "Ordinet", None, 108900), ("seventy-nine thousand eight hundred square feet", "see value", "Ordinet", None, 79800), ("two hundred seventeen thousand eight hundred (217,800) square feet", "n/a", "CodeLibrary", None, 217800),
        ("43.5", "000 sq ft", "Ordinet", None, 43500), ("90", "x100 SF", "Ordinet", None, 9000), ("12", "1000 SF", "Ordinet", None, 12000), ("1880", "square metres", "Ordinet", None, 1880 * M2), ("0.4", "ha", "Ordinet", None, 4000 * M2),
        ("3550", "SY", "Ordinet", None, 31950), ("300", None, "CountyRoll", None, 130680), ("0.4", None, "LegalPress", None, 17424), ("45", "", "PlanDigest", None, 45000), ("800", "?", "SurveySheet", None, 800 * M2),
        ("9000", None, "CodeLibrary", None, None), ("7,500 sq. ft.", None, "CountyRoll", None, 7500), ("1.25acres", "n/a", "PlanDigest", None, 54450), ("10 ac.", "-", "CodeLibrary", None, 435600),
        ("n/a", None, "Ordinet", "No dwelling shall be placed on a lot smaller than 69,800 sq. ft., with 175 feet of frontage.", 69800), ("9000", "Acres", "LegalPress", "Lots of record after 1994 must hold not less than nine thousand (9,000) square feet of land.", 9000),
        ("x", None, "Ordinet", "A house of at least 1480 square feet may stand on a lot of no less than 8,400 square foot.", 8400), ("1", None, "Ordinet", "Lot area, R-1: 14,400 s.f.; sheds may cover up to 1140 square feet.", 14400),
        ("2", "Square Feet", "Ordinet", "Frontage 155 ft., depth 165 ft., area 0.75 ac.", 32670), ("", "Acres", "Ordinet", "1½ acres per lot; front yard 35 feet.", 65340), ("5", "Acres", "Ordinet", "The lot area shall be set by the board.", 217800),
        ("none", "Acres", "LegalPress", None, None), ("-1", "Acres", "Ordinet", None, None), (None, None, None, None, None), ("", "", "", "", None), ("0", "Acres", "Ordinet", None, 0), ("8400", "square feet", None, None, 8400),
        ("4 furlongs", "furlong", "Ordinet", None, None),
    ],
)
def test_conversion_of_one_record(spark, value, unit, source, text, want):
    rows = spark.createDataFrame([(1, value, unit, source, text, None)], SCHEMA)
    got = convert_quantities(rows, spark.createDataFrame(NOTES, "source string, note string")).first()["quantity"]
    assert got is None if want is None else got == pytest.approx(want, rel=1e-9), got


def test_number_words(spark):
    said = {"five hundred": 500, "one million two hundred thousand": 1_200_000, "two hundred and fifty thousand": 250_000, "one and one-half": 1.5, "three-quarters": 0.75, "twenty-one": 21, "1,234.5": 1234.5, "3 k": 3000, "1/0": None, "": None}
    rows = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in said.items()], "q string, want double").select("q", "want", number(F.col("q")).alias("got")).collect()
    for r in rows:
        assert r["got"] == (None if r["want"] is None else pytest.approx(r["want"])), r


def test_empty_and_clashing_tables(spark):
    notes = spark.createDataFrame(NOTES, "source string, note string")
    empty = spark.createDataFrame([], SCHEMA)
    assert convert_quantities(empty, notes).count() == 0
    odd = spark.createDataFrame([(1, "2", "Acres", "x", None, "mine", "theirs", 5)], "lot_id bigint, min_lot_size string, unit string, source string, lot_text string, quantity string, note string, scale int")
    out = convert_quantities(odd, notes)
    assert out.columns.count("quantity") == 1 and out.first()["quantity"] == 87120 and out.first()["note"] == "theirs" and out.first()["scale"] == 5
    long = spark.createDataFrame([(1, None, None, "Ordinet", "word " * 50_000 + "a lot of 5 acres", None)] * 2, SCHEMA)
    assert [r["quantity"] for r in convert_quantities(long, notes).collect()] == [217800, 217800]
