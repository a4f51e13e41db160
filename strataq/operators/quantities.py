"""Measured quantities in mixed units and spellings, converted to one unit (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.functions.units import ConversionGraph
from strataq.session import let

# Number words.
WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
FRACTIONS = {"half": 0.5, "halves": 0.5, "third": 1 / 3, "thirds": 1 / 3, "quarter": 0.25, "quarters": 0.25, "fourth": 0.25, "fourths": 0.25, "eighth": 0.125, "eighths": 0.125, "tenth": 0.1, "tenths": 0.1}
VULGAR = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}
# Spellings of area units within running text, lower case, "²" already "2".
IN_TEXT = [
    ("square_metre", r"sq(?:uare)?\.? ?met(?:re|er)s?|sq\.? ?m\.?|m2"),
    ("square_foot", r"sq(?:uare)?\.? ?(?:feet|foot|ft)\.?|s\.? ?f\.?|(?:feet|foot|ft)\.? ?(?:2|squared)"),
    ("square_yard", r"sq(?:uare)?\.? ?(?:yards?|yds?)\.?|s\.? ?y\.?|yd2"),
    ("square_mile", r"sq(?:uare)?\.? ?(?:miles?|mi)\.?"),
    ("square_kilometre", r"sq(?:uare)?\.? ?(?:kilomet(?:re|er)s?|km)\.?|km2"),
    ("hectare", r"hectares?(?:\(s\))?|ha\.?"),
    ("acre", r"acres?(?:\(s\))?|ac\.?"),
]
#: Nouns whose own size is meant when they come before a quantity, unless a noun of the lot comes between.
NOT_LAND = "house|houses|dwelling|dwellings|home|homes|building|buildings|shed|sheds|garage|garages|floor|structure|structures|porch|pool|apartment|unit|units"
LAND = "lot|lots|land|area|parcel|parcels|tract|tracts|site|sites"

NUMBER = r"(?:\d{1,3}(?:[, ]\d{3})+(?!\d)(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)"
FRACTION = r"(?:\d+ )?\d+ ?/ ?\d+"
SCALE = r"(?: ?(?:k|thousand|hundred|million)(?![a-z]))?"
WORD = "(?:" + "|".join([*WORDS, *FRACTIONS, "hundred", "thousand", "million", "a"]) + ")(?![a-z])"
SPELLED = rf"{WORD}(?:(?: and | |-){WORD})*"
QUANTITY = rf"(?<![\d.,/a-z-])(?:{FRACTION}|{NUMBER}{SCALE}|{SPELLED})"
FACTORS = {"k": 1e3, "thousand": 1e3, "hundred": 1e2, "million": 1e6}


def plain(text: Column) -> Column:
    """Lower case, one space for any run of white space, fractions and squares in ASCII."""
    t = F.regexp_replace(F.lower(text), r"[\s    ​]+", " ")
    for sign, words in VULGAR.items():
        t = F.replace(t, F.lit(sign), F.lit(f" {words}"))
    t = F.translate(t, "²’′×‐‑–", "2''x---")
    return F.trim(F.regexp_replace(t, " {2,}", " "))


def tag_units(text: Column) -> Column:
    """Spelled area units become <unit>."""
    for unit, pattern in IN_TEXT:
        text = F.regexp_replace(text, rf"(?<![a-z])(?:{pattern})(?![a-z0-9])", f" <{unit}>")
    return F.regexp_replace(text, " +<", " <")


def _lookup(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in (kv[0], float(kv[1]))])


def number(q: Column) -> Column:
    """The value of a quantity in digits, digits with a fraction, or words; null if it isn't one."""

    def slashed(x: Column) -> Column:
        parts = [F.regexp_extract(x, r"^(?:(\d+) )?(\d+) ?/ ?(\d+)$", i) for i in (1, 2, 3)]
        whole, top, under = (F.expr("CAST(NULL AS DOUBLE)") if i < 0 else p.try_cast("double") for i, p in enumerate(parts))
        return F.coalesce(whole, F.lit(0.0)) + F.try_divide(top, under)

    def digits(x: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(x, r"^[\d., ]*\d", 0), "[, ]", "").try_cast("double")
        scale = F.try_element_at(_lookup(FACTORS), F.regexp_extract(x, "[a-z]+$", 0))
        return value * F.coalesce(scale, F.lit(1.0))

    def spelled(x: Column) -> Column:
        def step(s: Column, w: Column) -> Column:
            unit, part = F.try_element_at(_lookup(WORDS), w), F.try_element_at(_lookup(FRACTIONS), w)
            total, cur = s["total"], s["cur"]
            one = F.when(cur == 0, 1.0).otherwise(cur)
            state = lambda a, b: F.struct(a.alias("total"), b.alias("cur"))
            zero = F.lit(0.0)
            return (
                F.when(unit.isNotNull(), state(total, cur + unit))
                .when(part.isNotNull(), state(total + one * part, zero))
                .when(w == "hundred", state(total, one * 100.0))
                .when(w == "thousand", state(F.when(total < 1000, (total + one) * 1e3).otherwise(total + one * 1e3), zero))
                .when(w == "million", state((total + one) * 1e6, zero))
                .when(w == "and", state(total + cur, zero))
                .otherwise(s)
            )

        start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("cur"))
        return F.aggregate(F.split(x, "[ -]+"), start, step, lambda s: s["total"] + s["cur"])

    return (
        F.when(F.coalesce(q, F.lit("")) == "", F.lit(None).cast("double"))
        .when(q.contains("/"), slashed(q))
        .when(q.rlike(r"^[\d.]"), digits(q))
        .otherwise(spelled(q))
    )


def stated_in_text(text: Column) -> Column:
    """struct(q, unit) of the first area in a text that is said of the land and not of a building; nulls if there is none."""
    tagged = tag_units(plain(text))
    other = rf"\b(?:{NOT_LAND})\b(?:(?!\b(?:{LAND})\b|<)[^;])*?{QUANTITY}\)? ?<\w+>(?! (?:per|of) (?:{LAND}))"
    mention = rf"({QUANTITY})\)? ?<(\w+)>"

    def read(t: Column) -> Column:
        return F.struct(F.regexp_extract(t, mention, 1).alias("q"), F.regexp_extract(t, mention, 2).alias("unit"))

    return let(F.regexp_replace(F.coalesce(tagged, F.lit("")), other, " "), read)


def stated_in_fields(value: Column) -> Column:
    """struct(q, unit, width, depth) of a value field: a bare figure, a figure with its unit, or two dimensions."""
    side = rf"({NUMBER}) ?(?:ft|feet|foot|'|m|metres|meters)?\.?"
    both = rf"^{side} ?(?:x|by|\*) ?{side}$"
    bare = rf"^({QUANTITY})\)?$"
    full = rf"^(?:{SPELLED} ?\()?({QUANTITY})\)? ?<(\w+)>$"

    def read(t: Column) -> Column:
        q = F.when(t.rlike(full), F.regexp_extract(t, full, 1)).otherwise(F.regexp_extract(t, bare, 1))
        size = [F.when(t.rlike(both), F.regexp_replace(F.regexp_extract(t, both, i), "[, ]", "").try_cast("double")) for i in (1, 2)]
        return F.struct(q.alias("q"), F.regexp_extract(t, full, 2).alias("unit"), size[0].alias("width"), size[1].alias("depth"), t.rlike(r"\d ?(?:m|metres|meters)\b").alias("metric"))

    return let(F.coalesce(tag_units(plain(value)), F.lit("")), read)


def unit_of_note(note: Column) -> Column:
    """The unit that a source's note gives for bare figures, as words say it; empty if it gives none."""
    t = plain(note)
    unit = F.lit("")
    for words, name in [  # later ones are more specific
        (r"square feet|sq\.? ?ft", "square_foot"), (r"\bacres?\b", "acre"), (r"hectares?", "hectare"), (r"square yards?", "square_yard"), (r"square met(?:re|er)s?", "square_metre"),
        (r"hundreds of (?:square feet|sq)", "hundred_square_feet"), (r"thousands? of (?:square feet|sq)", "thousand_square_feet"), (r"hundredths? of an acre", "hundredth_acre"), (r"thousandths? of an acre", "thousandth_acre"),
    ]:
        unit = F.when(t.rlike(words), name).otherwise(unit)
    return F.coalesce(F.when(t.rlike("not (?:been )?resolved|unknown|unresolved"), "").otherwise(unit), F.lit(""))


def alias_key(unit: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(F.coalesce(unit, F.lit(""))), "²", "2"), "[^a-z0-9]", "")


def convert_quantities(
    rows: DataFrame,
    notes: DataFrame,
    value: str = "min_lot_size",
    unit: str = "unit",
    text: str = "lot_text",
    source: str = "source",
    target: str = "square_foot",
    graph: ConversionGraph | None = None,
) -> DataFrame:
    """Append ``quantity`` (in ``target``), ``quantity_unit`` and ``quantity_basis`` (text, fields, note) to every row.

    What the text demands comes first, then what value and unit say together, then the note of the source. Nothing is
    dropped: rows whose quantity can't be settled (nulls, blanks, placeholders, unknown units) get nulls. Columns of the
    input with one of these three names are replaced. Each row takes an equi-join with the conversions, whose size is
    that of the constant unit graph; the notes are one row per source, and Spark broadcasts them only by their size.
    """
    graph = graph or ConversionGraph()
    spark = rows.sparkSession
    mine = ["_alias", "_n", "_basis", "_note_unit", "quantity", "quantity_unit", "quantity_basis"]
    keep = [c for c in rows.columns if c not in mine]
    notes = notes.groupBy(F.lower(F.trim(F.col("source"))).alias("_source")).agg(F.max(unit_of_note(F.col("note"))).alias("_note_unit"))
    out = rows.select(*[F.col(f"`{c}`") for c in keep]).withColumn("_source", F.lower(F.trim(F.col(source)))).join(notes, "_source", "left")

    said, fields, own = stated_in_text(F.col(text)), stated_in_fields(F.col(value)), alias_key(F.col(unit))
    out = out.withColumns({"_said": said, "_field": fields, "_own": own})
    known = graph.aliases(spark, [target])
    lengths = {"feet", "foot", "ft", "m", "metre", "metres", "meter", "meters"}
    is_known = F.broadcast(known.select(F.col("alias").alias("_own"), F.col("unit").alias("_own_unit")).where(~F.col("alias").isin(*lengths)))
    out = out.join(is_known, "_own", "left")

    in_text, dims, with_unit = F.col("_said.q") != "", F.col("_field.width").isNotNull(), F.col("_field.unit") != ""
    metric = F.coalesce(F.col("_field.metric"), F.lit(False)) | F.col("_own").isin("m", "metre", "metres", "meter", "meters")
    has_unit = F.col("_own_unit").isNotNull()
    no_unit = F.col("_own").isin("", "na", "none", "null", "seevalue", "unknown", "nan")
    basis = F.when(in_text, "text").when(dims | with_unit | has_unit, "fields").when(no_unit & (F.coalesce("_note_unit", F.lit("")) != ""), "note")
    alias = (
        F.when(in_text, F.col("_said.unit"))
        .when(dims, F.when(metric, "square_metre").otherwise("square_foot"))
        .when(with_unit, F.col("_field.unit"))
        .when(has_unit, F.col("_own_unit"))
        .when(no_unit, F.col("_note_unit"))
    )
    n = F.when(in_text, number(F.col("_said.q"))).when(dims, F.col("_field.width") * F.col("_field.depth")).otherwise(number(F.col("_field.q")))
    out = out.withColumns({"_alias": alias, "_n": n, "_basis": basis})
    rates = graph.table(spark, [target]).select(F.col("unit").alias("_alias"), F.col("target").alias("_target"), F.col("scale").alias("_scale"), F.col("shift").alias("_shift"))
    out = out.withColumn("_target", F.lit(target)).join(F.broadcast(rates), ["_alias", "_target"], "left")  # bounded by the constant graph
    size = F.round(F.col("_n") * F.col("_scale") + F.col("_shift"), 6)
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        size.alias("quantity"),
        F.when(size.isNotNull(), F.col("_alias")).alias("quantity_unit"),
        F.when(size.isNotNull(), F.col("_basis")).alias("quantity_basis"),
    )
