"""Queries of the general data problems: quantities in mixed units (p1) and nested records (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.functions.units import AREA_EDGES, LENGTH_EDGES, TEMPERATURE_EDGES, ConversionGraph
from strataq.operators.nested import flatten_lines
from strataq.operators.quantities import convert_quantities
from strataq.session import latest, table

LOT_COLUMNS = ["lot_id", "min_lot_size", "unit", "lot_text", "source", "extracted_at"]


def _lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = latest(table(spark, sf_dir, "lot_size").select(*LOT_COLUMNS), ["lot_id"], ["extracted_at"])
    return convert_quantities(lots, table(spark, sf_dir, "lot_source"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a size above zero, in whole square feet, unless min_lot_size already is just those digits."""
    feet = F.round(F.col("quantity")).cast("long")
    found = _lots(spark, sf_dir).where(F.col("quantity") > 0).select("lot_id", feet.alias("square_feet"), "min_lot_size")
    return found.where(~F.col("min_lot_size").eqNullSafe(F.col("square_feet").cast("string"))).select("lot_id", "square_feet")


def p1_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its size and where that comes from."""
    return _lots(spark, sf_dir).select("lot_id", "quantity", "quantity_unit", "quantity_basis")


def p1_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversions to square feet that the graph composes."""
    return ConversionGraph(AREA_EDGES + LENGTH_EDGES + TEMPERATURE_EDGES).table(spark, ["square_foot"]).select("unit", F.round("scale", 6).alias("scale"), F.round("shift", 6).alias("shift"))


def _nested(name: str):
    return lambda spark, sf_dir: flatten_lines(table(spark, sf_dir, "batch_line"))[name]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the table of districts."""
    return flatten_lines(table(spark, sf_dir, "batch_line"))["districts"].select("line_id", "choice_pos", "call_pos", "district_pos", "parent_pos")


QUERIES = {
    "p1_found": p1_found,
    "p1_sizes": p1_sizes,
    "p1_conversions": p1_conversions,
    "p4_found": p4_found,
    "p4_responses": _nested("responses"),
    "p4_choices": _nested("choices"),
    "p4_calls": _nested("calls"),
    "p4_districts": _nested("districts"),
}

ORACLES = {
    "p1_conversions": """SELECT unit, CAST(round(scale, 6) AS DOUBLE) AS scale, CAST(0 AS DOUBLE) AS shift FROM (VALUES
        ('square_foot', 1.0::DOUBLE), ('acre', 43560::DOUBLE), ('square_yard', 9::DOUBLE), ('square_inch', 1::DOUBLE / 144), ('square_rod', 272.25::DOUBLE),
        ('square_mile', 27878400::DOUBLE), ('square_metre', 1::DOUBLE / (0.3048::DOUBLE * 0.3048::DOUBLE)), ('are', 100::DOUBLE / (0.3048::DOUBLE * 0.3048::DOUBLE)),
        ('hectare', 10000::DOUBLE / (0.3048::DOUBLE * 0.3048::DOUBLE)), ('square_kilometre', 1000000::DOUBLE / (0.3048::DOUBLE * 0.3048::DOUBLE)),
        ('hundred_square_feet', 100::DOUBLE), ('thousand_square_feet', 1000::DOUBLE), ('hundredth_acre', 435.6::DOUBLE), ('thousandth_acre', 43.56::DOUBLE)) t(unit, scale)""",
}
