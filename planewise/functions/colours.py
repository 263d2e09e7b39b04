"""Colours of objects, as expressions over their names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from planewise.functions.vectors import colour_hue

#: Hues that stay apart for ten classes and more, by the golden angle.
GOLDEN_ANGLE = 137.508


def palette(n: int) -> list[str]:
    return [f"hsl({round(k * GOLDEN_ANGLE % 360)}, 65%, 50%)" for k in range(n)]


def by_index(code: Column, colours: list[str]) -> Column:
    """The colour at a class' index, from the start again after the last."""
    return F.element_at(F.array(*map(F.lit, colours)), (F.pmod(code, F.lit(len(colours))) + 1).cast("int"))


def _first(tests: list[tuple[Column, str]], otherwise: Column) -> Column:
    return reduce(lambda rest, t: F.when(t[0], F.lit(t[1])).otherwise(rest), reversed(tests), otherwise)


def by_prefix(name: Column, colours: dict[str, str], otherwise: Column) -> Column:
    return _first([(name.startswith(p), c) for p, c in colours.items()], otherwise)


def by_substring(name: Column, colours: dict[str, str], otherwise: Column) -> Column:
    return _first([(name.contains(p), c) for p, c in colours.items()], otherwise)


def by_name(name: Column) -> Column:
    """A colour from a hash of the name."""
    return F.concat(F.lit("hsl("), colour_hue(name).cast("string"), F.lit(", 65%, 50%)"))
