"""Transforms of one vector, as expressions over ``ARRAY<DOUBLE>`` columns; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planewise.conventions import CLR_DELTA, LOG_FLOOR, LOGIT_EPS, NATS_FLOOR, NEGATIVE_ATOL


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def sqrt_probability(v: Column) -> Column:
    """Square roots; entries below ``-NEGATIVE_ATOL`` raise, lesser negatives count as 0."""
    return F.transform(v, lambda x: F.when(x < -NEGATIVE_ATOL, F.raise_error(F.lit("negative probability")).cast("double")).otherwise(F.sqrt(F.greatest(x, F.lit(0.0)))))


def logit(v: Column, eps: float = LOGIT_EPS) -> Column:
    def one(x: Column) -> Column:
        c = F.least(F.greatest(x, F.lit(eps)), F.lit(1.0 - eps))
        return F.ln(c / (1.0 - c))

    return F.transform(v, one)


def clr(v: Column, delta: float = CLR_DELTA) -> Column:
    """Centred log ratios; exact zeros become ``delta`` and the others give up that mass."""
    zeros = F.size(F.filter(v, lambda x: x == 0))
    filled = F.transform(v, lambda x: F.when(x == 0, F.lit(delta)).otherwise(x * (1.0 - zeros * delta)))
    logs = F.transform(filled, lambda x: F.ln(F.greatest(x, F.lit(LOG_FLOOR))))
    # An array of one, so that the logs are computed once for the mean and the differences.
    centred = F.transform(F.array(logs), lambda a: F.transform(a, lambda x: x - total(a) / F.size(a)))[0]
    return F.when(zeros * delta >= 1, F.raise_error(F.lit("too many zeros for this delta")).cast("array<double>")).otherwise(centred)


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(F.array(e), lambda a: F.transform(a, lambda x: x / total(a)))[0]


def renormalize(v: Column) -> Column:
    return F.transform(v, lambda x: x / total(v))


def entropy(v: Column, unit: str = "bits") -> Column:
    """Shannon entropy in ``bits`` (0 log 0 is 0) or ``nats`` (entries floored)."""
    if unit == "bits":
        return -F.aggregate(v, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.log2(x)).otherwise(0.0)) + 0.0
    if unit == "nats":
        return -F.aggregate(v, F.lit(0.0), lambda s, x: s + x * F.ln(F.greatest(x, F.lit(NATS_FLOOR)))) + 0.0
    raise ValueError(f"unknown unit {unit!r}")


def confidence(v: Column) -> Column:
    return F.array_max(v)


def argmax(v: Column) -> Column:
    """Place of the first greatest entry, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def argmax_label(v: Column, names: list[str]) -> Column:
    """Name of the first greatest entry, without a leading ``p_``."""
    return F.element_at(F.array(*(F.lit(n.removeprefix("p_")) for n in names)), argmax(v) + 1)


def correct(true: Column, predicted: Column) -> Column:
    """Whether the prediction holds; never for ``ambiguous``, never for null."""
    return F.coalesce((true == predicted) & (true != "ambiguous"), F.lit(False))


def label(component: Column, pred: Column, true: Column, predicted: Column, greatest: Column) -> Column:
    """A row's class: the first of these that isn't null or empty."""
    given = [F.nullif(c, F.lit("")) for c in (component, pred, true, predicted)]
    return F.coalesce(*given, greatest.cast("string"))


def rashomon_label(true_label: Column, true_class: Column, component: Column, pred: Column, label_: Column, class_: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (true_label, true_class, component, pred, label_, class_)), F.lit("0"))


def colour_hue(name: Column) -> Column:
    """A hue of 0 to 359 from the MD5 of a name: the 128-bit number modulo 360, eight hexadecimal digits at a time."""
    digits = F.md5(name.cast("binary"))
    rest = F.lit(0).cast("long")
    for k in range(4):
        rest = (rest * (16**8 % 360) + F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long")) % 360
    return rest.cast("int")
