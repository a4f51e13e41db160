"""Units as a graph whose edges are affine functions; conversions are its shortest compositions."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

# Definitions of units, y = scale * x + offset, exact.
AREA_EDGES = [
    ("acre", "square_foot", "43560", "0"),
    ("square_yard", "square_foot", "9", "0"),
    ("square_foot", "square_inch", "144", "0"),
    ("square_rod", "square_yard", "121/4", "0"),
    ("square_mile", "acre", "640", "0"),
    ("square_metre", "square_foot", "1562500/145161", "0"),
    ("square_yard", "square_metre", "0.83612736", "0"),
    ("are", "square_metre", "100", "0"),
    ("hectare", "are", "100", "0"),
    ("hectare", "square_metre", "10000", "0"),
    ("square_kilometre", "hectare", "100", "0"),
    ("hundred_square_feet", "square_foot", "100", "0"),
    ("thousand_square_feet", "square_foot", "1000", "0"),
    ("hundredth_acre", "acre", "0.01", "0"),
    ("thousandth_acre", "acre", "0.001", "0"),
]
LENGTH_EDGES = [
    ("yard", "foot", "3", "0"),
    ("foot", "inch", "12", "0"),
    ("rod", "yard", "5.5", "0"),
    ("mile", "foot", "5280", "0"),
    ("foot", "metre", "0.3048", "0"),
    ("kilometre", "metre", "1000", "0"),
]
TEMPERATURE_EDGES = [
    ("degree_celsius", "degree_fahrenheit", "1.8", "32"),
    ("degree_celsius", "kelvin", "1", "273.15"),
    ("kelvin", "degree_rankine", "1.8", "0"),
]
# Spellings of units, letters and digits only, lower case, without a multiplier.
SPELLINGS = {
    "square_foot": ["squarefeet", "squarefoot", "sqft", "sqfeet", "sqfoot", "sf", "ft2", "feet2"],
    "acre": ["acre", "acres", "ac", "acs"],
    "hectare": ["hectare", "hectares", "ha"],
    "are": ["are", "ares"],
    "square_metre": ["squaremetre", "squaremetres", "squaremeter", "squaremeters", "sqm", "sqmetres", "sqmeters", "m2"],
    "square_yard": ["squareyard", "squareyards", "sqyd", "sqyds", "sqyards", "sy", "yd2"],
    "square_mile": ["squaremile", "squaremiles", "sqmi"],
    "square_kilometre": ["squarekilometre", "squarekilometres", "squarekilometers", "sqkm", "km2"],
    "square_rod": ["squarerod", "squarerods", "sqrd"],
    "square_inch": ["squareinch", "squareinches", "sqin"],
    "foot": ["feet", "foot", "ft"],
    "yard": ["yard", "yards", "yd", "yds"],
    "metre": ["metre", "metres", "meter", "meters", "m"],
}
# Spellings of a multiplier before a spelling of the square foot.
MULTIPLES = {
    "hundred_square_feet": ["100", "x100", "hundred", "hundreds", "hundredsof", "00"],
    "thousand_square_feet": ["1000", "x1000", "thousand", "thousands", "thousandsof", "000", "k"],
}


@dataclass(frozen=True)
class Affine:
    scale: Fraction
    offset: Fraction

    def then(self, other: Affine) -> Affine:
        return Affine(self.scale * other.scale, self.offset * other.scale + other.offset)

    def inverse(self) -> Affine:
        return Affine(1 / self.scale, -self.offset / self.scale)


IDENTITY = Affine(Fraction(1), Fraction(0))


@dataclass
class ConversionGraph:
    """Edges (source, target, scale, offset). The graph is constant and small: it never grows with the data."""

    edges: list[tuple[str, str, str, str]] = field(default_factory=lambda: AREA_EDGES + LENGTH_EDGES + TEMPERATURE_EDGES)

    def __post_init__(self) -> None:
        self.out: dict[str, list[tuple[str, Affine]]] = {}
        for source, target, scale, offset in self.edges:
            f = Affine(Fraction(scale), Fraction(offset))
            if not f.scale:
                raise ValueError(f"{source} -> {target} can't be inverted")
            self.out.setdefault(source, []).append((target, f))
            self.out.setdefault(target, []).append((source, f.inverse()))
        self.check_cycles()

    def compositions(self, source: str) -> dict[str, tuple[Affine, int]]:
        """The shortest composition from ``source`` to each unit that it reaches, with its number of edges."""
        found, queue = {source: (IDENTITY, 0)}, deque([source])
        while queue:
            at = queue.popleft()
            f, steps = found[at]
            for unit, g in self.out.get(at, []):
                if unit not in found:
                    found[unit] = (f.then(g), steps + 1)
                    queue.append(unit)
        return found

    def check_cycles(self) -> None:
        """Every edge must agree with the composition along the rest of its component, else a cycle isn't the identity."""
        seen: set[str] = set()
        for root in self.out:
            if root in seen:
                continue
            to = self.compositions(root)
            seen |= set(to)
            for unit in to:
                for other, g in self.out[unit]:
                    if to[unit][0].then(g) != to[other][0]:
                        raise ValueError(f"inconsistent cycle through {unit} -> {other}")

    def table(self, spark: SparkSession, targets: list[str]) -> DataFrame:
        """(unit, target, scale, shift, steps) of every unit that reaches a target; a few dozen rows."""
        rows = []
        for target in targets:
            for unit, (f, steps) in sorted(self.compositions(target).items()):
                back = f.inverse()
                rows.append((unit, target, float(back.scale), float(back.offset), steps))
        return spark.createDataFrame(rows, "unit string, target string, scale double, shift double, steps int")

    def aliases(self, spark: SparkSession, targets: list[str]) -> DataFrame:
        """The same by spelling: (alias, unit, target, scale, shift). Its size is that of SPELLINGS x MULTIPLES."""
        spelled = [(a, unit) for unit, names in SPELLINGS.items() for a in [*names, unit.replace("_", "")]]
        spelled += [(p + a, unit) for unit, ps in MULTIPLES.items() for p in ps for a in SPELLINGS["square_foot"]]
        names = spark.createDataFrame(sorted(set(spelled)), "alias string, unit string")
        return names.join(self.table(spark, targets), "unit").select("alias", "unit", "target", "scale", "shift")
