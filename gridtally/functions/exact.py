"""Exact sums of doubles: what a double stands for, in limbs, and back.

A double stands for the decimal that Spark prints it as: 0.1 is one tenth, so ten of them are 1, and
12.345 lies exactly between two hundredths. Such a decimal is an integer times a power of
ten. It is cut into limbs of six digits, whose places are fixed by a *bin*: limb ``i`` of
bin ``b`` counts units of ``10 ** (6 * (b + i) - 9)``. Values of one bin are added limb by
limb as integers; nothing is rounded, so neither partitions nor retries nor the order of
rows decide a digit. Sums of several bins, a few rows for each group, meet at the end
(:mod:`gridtally.operators.exact_sums`), where carries are passed on.

An *exact total* is an array of such sums, one for each bin in use. Almost all values have
at most nine decimals and less than four million units: bin 0. They take a short way in,
and their totals a short way out. Limb sums are safe up to 9e12 rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS = ("l0", "l1", "l2", "l3")
#: Type of an exact total.
TOTAL = f"array<struct<bin: int, {', '.join(f'{limb}: bigint' for limb in LIMBS)}>>"

_DIGITS = 6
_UNIT = 10**_DIGITS
#: Decimals that bin 0 ends with.
_SCALE = 9
#: Infinities have a bin of their own: ``l0`` counts the positive ones, ``l1`` the others.
_INFINITE = 1_000
#: Up to here the decimals of a bin-0 value are finer than the doubles themselves.
_SHORT = float(1 << 22)


def nan_to_null(value: Column) -> Column:
    """NaN is "missing" here; Spark would sort and compare it as the largest number."""
    return F.when(~F.isnan(value), value)


def _div(a: Column, b: int) -> Column:
    """Integer quotient, towards zero like the remainder ``%``."""
    return F.call_function("div", a, F.lit(b))


def _limbs(bin_: Column, *limbs: Column) -> Column:
    padded = [*limbs, *[F.lit(0)] * (len(LIMBS) - len(limbs))]
    named = [limb.cast("bigint").alias(name) for name, limb in zip(LIMBS, padded)]
    return F.struct(bin_.cast("int").alias("bin"), *named)


def limbs(value: Column) -> Column:
    """A double as one struct of ``TOTAL``; NULL for NULL and NaN.

    Meant for a column, not for an expression: it is looked at several times.
    """
    billionths = F.rint(value * F.lit(1e9))
    short = (F.abs(value) < _SHORT) & (billionths / F.lit(1e9) == value)
    n = billionths.cast("bigint")
    thousandths = _div(n, _UNIT)
    return (
        F.when(short, _limbs(F.lit(0), n % _UNIT, thousandths % _UNIT, _div(thousandths, _UNIT)))
        .when(value.isNull() | F.isnan(value), None)
        .when(
            F.abs(value) == F.lit(float("inf")),
            _limbs(F.lit(_INFINITE), (value > 0).cast("int"), (value < 0).cast("int")),
        )
        .otherwise(_long_way(value))
    )


def _long_way(value: Column) -> Column:
    """Limbs of any finite double, by way of its text."""
    text = F.abs(value).cast("string")
    mantissa = F.substring_index(text, "E", 1)
    power = F.when(F.instr(text, "E") > 0, F.substring_index(text, "E", -1)).otherwise("0")
    last = power.cast("int") - F.length(F.substring_index(mantissa, ".", -1))
    place = last + _SCALE
    bin_ = F.floor(place / F.lit(_DIGITS))
    zeros = F.repeat(F.lit("0"), (place - bin_ * _DIGITS).cast("int"))
    digits = F.concat(F.replace(mantissa, F.lit("."), F.lit("")), zeros)
    padded = F.lpad(digits, _DIGITS * len(LIMBS), "0")
    sign = F.when(value < 0, -1).otherwise(1)
    parts = [
        F.substring(padded, _DIGITS * (len(LIMBS) - 1 - i) + 1, _DIGITS).cast("bigint") * sign
        for i in range(len(LIMBS))
    ]
    return _limbs(bin_, *parts)


# -- out of limbs ------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _short_total(total: Column) -> Column:
    """The total as a decimal, if all values were of bin 0."""
    only = total[0]
    # Narrow types: the products must keep their nine decimals.
    units = (("0.000000001", "decimal(9,9)"), ("0.001", "decimal(3,3)"), ("1000", "decimal(4,0)"))
    parts = [
        (only[limb].cast("decimal(19,0)") * F.lit(unit).cast(kind)).cast("decimal(35,9)")
        for limb, (unit, kind) in zip(LIMBS, units)
    ]
    return (parts[0] + parts[1] + parts[2]).cast("decimal(38,9)")


def _is_short(total: Column) -> Column:
    return (F.size(total) == 1) & (total[0]["bin"] == 0)


def _infinite(total: Column) -> Column:
    """+-infinity if values were infinite, NULL if they were of both signs."""
    found = F.filter(total, lambda s: s["bin"] == _INFINITE)[0]
    plus, minus = found["l0"] > 0, found["l1"] > 0
    return (
        F.when(plus & minus, None)
        .when(plus, F.lit(float("inf")))
        .otherwise(F.lit(float("-inf")))
    ).cast("double")


def _has_infinite(total: Column) -> Column:
    return F.exists(total, lambda s: s["bin"] == _INFINITE)


def _carried(total: Column, sign: int) -> Column:
    """``carry, digits``: the limbs of all bins with carries passed on.

    ``digits`` holds six for each place from the lowest bin up. The last carry is 0, or -1
    for a negative total, whose digits then are a complement.
    """
    low = F.array_min(F.transform(total, lambda s: s["bin"]))
    high = F.array_max(F.transform(total, lambda s: s["bin"]))
    # Sums of limbs have up to 19 digits: they carry into three further places.
    places = F.sequence(low, high + len(LIMBS) + 3)

    def at(place: Column) -> Column:
        def of(s: Column) -> Column:
            chosen = F.lit(0).cast("bigint")
            for i, limb in enumerate(LIMBS):
                chosen = F.when(s["bin"] + i == place, s[limb]).otherwise(chosen)
            return chosen.cast("decimal(38,0)")

        zero = F.lit(0).cast("decimal(38,0)")
        return F.aggregate(total, zero, lambda a, s: (a + of(s) * sign).cast("decimal(38,0)"))

    def step(state: Column, place: Column) -> Column:
        def passed(sum_: Column) -> Column:
            digit = F.pmod(sum_, F.lit(_UNIT).cast("decimal(38,0)"))
            carry = ((sum_ - digit) / F.lit(_UNIT)).cast("decimal(38,0)")
            return F.struct(
                carry.alias("carry"),
                F.concat(F.lpad(digit.cast("bigint").cast("string"), _DIGITS, "0"), state["digits"]).alias("digits"),
            )

        return let((state["carry"] + at(place)).cast("decimal(38,0)"), passed)

    start = F.struct(F.lit(0).cast("decimal(38,0)").alias("carry"), F.lit("").alias("digits"))
    return F.aggregate(places, start, step)


def _digits(total: Column) -> Column:
    """``negative, digits, last``: the finite total is +-digits * 10 ** last."""
    low = F.array_min(F.transform(total, lambda s: s["bin"]))

    def signed(state: Column) -> Column:
        negative = state["carry"] < 0
        digits = F.when(negative, _carried(total, -1)["digits"]).otherwise(state["digits"])
        return F.struct(
            negative.alias("negative"), digits.alias("digits"), (low * _DIGITS - _SCALE).alias("last")
        )

    return let(_carried(total, 1), signed)


def _minus(d: Column) -> Column:
    return F.when(d["negative"], "-").otherwise("")


def _of_total(total: Column, short, long) -> Column:
    """One of two ways out; NULL for a NULL total, and where infinities cancel out."""
    return F.when(_is_short(total), short(_short_total(total))).when(
        F.size(total) > 0,
        F.when(_has_infinite(total), _infinite(total)).otherwise(let(_digits(total), long)),
    )


def _as_double(d: Column, power: int) -> Column:
    last = (d["last"] + power).cast("string")
    return F.concat(_minus(d), d["digits"], F.lit("E"), last).cast("double")


def _thousandth(short: Column, power: int) -> Column:
    """A short total, or a thousandth of it."""
    if power == 0:
        return short
    return short.cast("decimal(31,9)") * F.lit("0.001").cast("decimal(3,3)")


def to_double(total: Column, power: int = 0) -> Column:
    """The double nearest to an exact total times ten to a power of 0 or -3.

    A unit a thousand times larger is exact this way; values divided one by one are not.
    """
    return _of_total(
        total, lambda short: _thousandth(short, power).cast("double"), lambda d: _as_double(d, power)
    )


def rounded(total: Column, places: int = 2, power: int = 0) -> Column:
    """The total times ten to a power (0 or -3) at so many places, ties to even, as a double.

    From 1e30 on doubles are so far apart that places make no difference.
    """

    def long(d: Column) -> Column:
        last = d["last"] + power
        # ``cut`` digits go: all behind the places, one at least, as the total may end before.
        behind = F.greatest(-last, F.lit(places + 1))
        cut = behind - places
        digits = F.concat(d["digits"], F.repeat(F.lit("0"), last + behind))
        digits = F.lpad(digits, F.greatest(F.length(digits), cut + 1), F.lit("0"))
        kept = F.left(digits, F.length(digits) - cut)
        rest = F.right(digits, cut)
        half = F.rpad(F.lit("5"), cut, F.lit("0"))
        significant = F.regexp_replace(kept, "^0+", "")
        whole = F.concat(F.lit("0"), significant).cast("decimal(38,0)")
        odd = F.right(kept, F.lit(1)).cast("int") % 2 == 1
        up = (rest > half) | ((rest == half) & odd)
        counted = whole + F.when(up, 1).otherwise(0)
        text = F.concat(_minus(d), counted.cast("decimal(38,0)").cast("string"), F.lit(f"E-{places}"))
        near = F.length(significant) <= 32
        # Zero has no sign here.
        return F.when(near, text.cast("double")).otherwise(_as_double(d, power)) + F.lit(0.0)

    def short_way(short: Column) -> Column:
        return F.bround(_thousandth(short, power), places).cast("double")

    return _of_total(total, short_way, long)


def sign(total: Column) -> Column:
    """-1, 0 or 1; NULL where there is no total."""

    def long(d: Column) -> Column:
        zero = F.length(F.translate(d["digits"], "0", "")) == 0
        return F.when(zero, 0.0).when(d["negative"], -1.0).otherwise(1.0)

    return F.signum(_of_total(total, lambda short: short.cast("double"), long)).cast("int")


def to_text(total: Column) -> Column:
    """A text that two totals share only if they are the same number."""

    def plain(negative: Column, digits: Column, last: Column) -> Column:
        def trimmed(kept: Column) -> Column:
            zeros = F.length(digits) - F.length(kept)
            shown = F.concat(
                F.when(negative, "-").otherwise(""), F.regexp_replace(kept, "^0+", ""),
                F.lit("E"), (last + zeros).cast("string"),
            )
            return F.when(F.length(F.translate(kept, "0", "")) == 0, "0").otherwise(shown)

        return let(F.regexp_replace(digits, "0+$", ""), trimmed)

    def short(value: Column) -> Column:
        text = F.translate(F.abs(value).cast("string"), ".", "")
        return plain(value < 0, text, F.lit(-_SCALE))

    return F.when(_is_short(total), short(_short_total(total))).when(
        F.size(total) > 0,
        F.when(_has_infinite(total), _infinite(total).cast("string")).otherwise(
            let(_digits(total), lambda d: plain(d["negative"], d["digits"], d["last"]))
        ),
    )
