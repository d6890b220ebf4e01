"""Units of measures: texts to units and multipliers, and which measures may be taken together."""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNT = "COUNT"
# Words of unit texts, as statistical offices write them in English and Dutch.
#: Scale words; the rest of the text is the unit.
SCALES = {"mln": 1e6, "million": 1e6, "miljoen": 1e6, "mld": 1e9, "billion": 1e9, "miljard": 1e9, "thousand": 1e3, "duizend": 1e3}
#: Unit texts that stand for one unit each.
WORDS = {
    "%": "PERCENT", "percent": "PERCENT", "percentage point": "PERCENT", "procentpunt": "PERCENT", "ratio": "PERCENT", "kans": "PERCENT",
    "‰": "PERMILLE", "promille": "PERMILLE",
    "": COUNT, "number": COUNT, "aantal": COUNT, "absoluut": COUNT, "waarde": COUNT, "value": COUNT, "personen": COUNT, "persons": COUNT, "stuks": COUNT,
    "overnachtingen": COUNT, "aantal meldingen": COUNT, "euro": "EURO", "euros": "EURO", "usd": "USD",
    "gram": "GRAM", "kg": "KG", "kgs": "KG", "kilogram": "KG", "ton": "TON", "tonnes": "TON", "tonne": "TON", "tonkm": "TON-KM", "tonkilometer": "TON-KM",
    "cm": "CM", "m": "M", "hm": "HM", "km": "KM", "kilometres": "KM", "passenger kilometres": "KM", "reizigerskilometers": "KM",
    "m2": "M2", "m²": "M2", "km2": "KM2", "km²": "KM2", "ha": "HA", "hectare": "HA", "m3": "M3", "m³": "M3", "liter": "LITRE", "litre": "LITRE",
    "kwh": "KWH", "mwh": "MWH", "gj": "GJ", "tj": "TJ", "pj": "PJ",
    "minuten": "MINUTE", "minutes": "MINUTE", "uur": "HOUR", "uren": "HOUR", "hour": "HOUR", "hours": "HOUR", "dagen": "DAY", "days": "DAY",
    "jaar": "YEAR", "jaren": "YEAR", "year": "YEAR", "years": "YEAR", "arbeidsjaren": "YEAR", "labour years": "YEAR", "mensjaren": "YEAR", "man-years": "YEAR",
}
#: Units that others are multiples of.
SCALING = {"KG": "GRAM", "TON": "GRAM", "CM": "M", "HM": "M", "KM": "M", "KM2": "M2", "HA": "M2", "KWH": "JOULE", "MWH": "JOULE", "GJ": "JOULE", "TJ": "JOULE", "PJ": "JOULE"}
#: Units that compare amounts and so have no dimension.
DIMENSIONLESS = {"PERCENT", "PERMILLE", "INDEX", "RATIO"}


class UnitCompatibilityError(TypeError):
    """Measures whose units can't be taken together."""


@dataclass(frozen=True)
class Unit:
    """unit: None if unknown. scaling_of: the unit that it is a multiple of, by default itself. multiplier: None if
    unknown."""

    unit: str | None = None
    multiplier: float | None = None
    scaling_of: str | None = None
    text: str = ""

    @property
    def base(self) -> str | None:
        return self.scaling_of or self.unit

    @property
    def dimensionless(self) -> bool:
        return self.unit in DIMENSIONLESS or self.unit == COUNT


def normalise(text: str) -> Unit:
    """Unit of a free text such as "x 1 000", "1,000 euro", "mln kg" or "% of GDP".

    Shares of anything are percent. Leading factors and scale words multiply, what is left is looked up; nothing left is a
    count. Rates ("per 1 000 inhabitants"), indices ("2015 = 100") and words that aren't known have no unit and no
    multiplier, as in a catalogue that says nothing of them. Multipliers are 1 without a factor."""
    told = " ".join(text.lower().split())
    if told in WORDS:
        return _unit(WORDS[told], 1.0, text)
    if "%" in told:
        return _unit("PERCENT", 1.0, text)
    rest, multiplier = told.removeprefix("x "), 1.0
    while m := re.match(r"(?:x\s+)?(\d{1,3}(?:(?:[ .]|, ?)\d{3})+|\d+)(?=\s|$|[a-z])\s*", rest):
        multiplier *= float(re.sub(r"[ .,]", "", m[1]))
        rest = rest[m.end() :]
    words = rest.split()
    while words and words[0] in SCALES:
        multiplier *= SCALES[words.pop(0)]
    rest = " ".join(words)
    return _unit(WORDS[rest], multiplier, text) if rest in WORDS else Unit(text=text)


def _unit(unit: str, multiplier: float, text: str) -> Unit:
    return Unit(unit, multiplier, SCALING.get(unit), text)


def check(units: dict[str, Unit], allow_scaling: bool = True) -> None:
    """UnitCompatibilityError unless the measures may be aggregated together. Those without unit and multiplier are left
    out. With allow_scaling, multiples of one unit may be mixed."""
    known = {m: u for m, u in units.items() if u.unit is not None or u.multiplier is not None}
    if len(known) < 2:
        return
    names = ", ".join(known)
    if any(u.dimensionless and u.unit != COUNT for u in known.values()):
        raise UnitCompatibilityError(f"can't aggregate two or more measures with a dimensionless unit: {names}")
    kinds = {u.unit for u in known.values()}
    if len(kinds) == 1 and None not in kinds:
        if COUNT in kinds:
            warnings.warn(f"measures are counts, maybe of different things: {names}", stacklevel=2)
        if not allow_scaling and len({u.multiplier for u in known.values()}) > 1:
            raise UnitCompatibilityError(f"can't aggregate measures with different conversion multipliers: {names}")
        return
    bases = {u.base for u in known.values()}
    if allow_scaling and len(bases) == 1 and None not in bases:
        return
    raise UnitCompatibilityError(f"can't aggregate over measures with a different unit: {names}")


def verdicts(measures: DataFrame, keys: Sequence[str], allow_scaling: bool = True) -> DataFrame:
    """check() for many groups at once: (*keys, n, verdict) of measures (*keys, unit, multiplier, scaling_of), one row per
    group of keys. verdict: ok, counts (equal units that are counts, which check() warns of), dimensionless, multipliers or
    units. n counts the measures that have a unit or a multiplier; with fewer than two the verdict is ok."""
    known = F.col("unit").isNotNull() | F.col("multiplier").isNotNull()
    base = F.coalesce("scaling_of", "unit")
    told = measures.groupBy(*keys).agg(
        F.count_if(known).cast("long").alias("n"),
        F.count_if(known & F.col("unit").isin(list(DIMENSIONLESS))).alias("shares"),
        F.count_if(known & F.col("unit").isNull()).alias("blank"),
        F.count_distinct(F.when(known, F.col("unit"))).alias("kinds"),
        F.count_if(known & (F.col("unit") == COUNT)).alias("counts"),
        F.count_distinct(F.when(known, F.struct("multiplier"))).alias("factors"),
        F.count_if(known & base.isNull()).alias("bare"),
        F.count_distinct(F.when(known, base)).alias("bases"),
    )
    same = (F.col("kinds") == 1) & (F.col("blank") == 0)
    verdict = F.when(F.col("n") < 2, "ok").when(F.col("shares") > 0, "dimensionless")
    if not allow_scaling:
        verdict = verdict.when(same & (F.col("factors") > 1), "multipliers")
    verdict = verdict.when(same & (F.col("counts") > 0), "counts").when(same, "ok")
    if allow_scaling:
        verdict = verdict.when((F.col("bases") == 1) & (F.col("bare") == 0), "ok")
    return told.select(*keys, "n", verdict.otherwise("units").alias("verdict"))
