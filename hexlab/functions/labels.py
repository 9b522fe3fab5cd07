"""Labels, codes and small scalar rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity levels from the least on; absence comes before them with rank 0.
LEVELS = ("Léger", "Modéré", "Grave")
ABSENT = "Aucun"


def code_to_label(code: Column, levels: Sequence[str] = LEVELS) -> Column:
    """1, 2, 3 … to the levels; other codes to null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, level in enumerate(levels, 1):
        out = out.when(code == i, F.lit(level))
    return out


def unaccented(text: Column) -> Column:
    return F.replace(F.lower(F.trim(text)), F.lit("é"), F.lit("e"))


def label_to_int(label: Column) -> Column:
    """Null to 0, the levels in either spelling to 1, 2, 3, other text to the number it is (else null)."""
    number = F.when(label.isNull(), F.lit(0)).when(label.isin("Leger", "Léger"), 1).when(label.isin("Modere", "Modéré"), 2).when(label == "Grave", 3)
    return number.otherwise(label.try_cast("int"))


def normalize_intensity(label: Column, levels: Sequence[str] = LEVELS) -> Column:
    """Trimmed, case and accent free match with the levels; what matches none stays as it is."""
    key, out = unaccented(label), None
    for level in levels:
        hit = key == level.lower().replace("é", "e")
        out = F.when(hit, F.lit(level)) if out is None else out.when(hit, F.lit(level))
    return out.otherwise(label)


def parse_age_class(code: Column, uneven_young: float = 30, uneven_old: float = 90) -> Column:
    """Age of the leading class of a code; null if blank or unknown."""
    lead = F.substring(code, 1, 2)
    return (
        F.when(code.startswith("120"), F.lit(120.0))
        .when(lead == "JI", F.lit(float(uneven_young)))
        .when(lead == "VI", F.lit(float(uneven_old)))
        .when(lead.isin("10", "30", "50", "70", "90"), lead.try_cast("double"))
    )


def severity_rank(label: Column, levels: Sequence[str] = LEVELS) -> Column:
    """Place among the levels from 1; absence, null and unknown labels are 0."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, levels)), label), F.lit(0)).cast("int")


def severity_label(rank: Column, levels: Sequence[str] = LEVELS, absent: str = ABSENT) -> Column:
    return F.get(F.array(F.lit(absent), *map(F.lit, levels)), F.coalesce(rank, F.lit(0)))


def strength_label(strength: Column) -> Column:
    """Right-closed classes of a strength of association."""
    return F.when(strength <= 0.1, "négligeable").when(strength <= 0.3, "faible").when(strength <= 0.5, "modérée").when(strength.isNotNull(), "forte")


def error_class(observed: Column, predicted: Column) -> Column:
    d = predicted - observed
    return F.when(d == 0, "Correct").when(d > 0, "Surestimation").when(d < 0, "Sous-estimation")


def gap_label(gap: Column) -> Column:
    """A signed gap with its sign written out when positive."""
    return F.when(gap > 0, F.concat(F.lit("+"), gap.cast("string"))).otherwise(gap.cast("string"))


def significant(x: Column, digits: int = 3) -> Column:
    """Rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def covered(value: Column, coverage: Column, least: float = 0.25) -> Column:
    """The value where enough of the hex is covered, else null."""
    return F.when(coverage >= least, value)
