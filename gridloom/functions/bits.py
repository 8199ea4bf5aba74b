"""Bit-packed quality flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The quality bits that transforms set.
BAD, INDETERMINATE, INTERPOLATED, EXTRAPOLATED, NOT_CLOSEST, SOME_BAD, ZERO_WEIGHT, OUTSIDE, ALL_BAD, BAD_STD, IND_STD, BAD_GOODFRAC, IND_GOODFRAC = (1 << k for k in range(13))


def mask_for(assessments: dict[int, str], assessment: str = "Bad") -> int:
    """Mask of the bits (from 1) with an assessment; for Bad, bit 1 if none has it."""
    mask = sum(1 << (bit - 1) for bit, said in assessments.items() if said.lower() == assessment.lower())
    return mask or (1 if assessment.lower() == "bad" else 0)


def any_of(qc: Column, mask: int) -> Column:
    return F.coalesce(qc, F.lit(0)).bitwiseAND(F.lit(mask)) != 0


def bit_if(test: Column, flag: int) -> Column:
    """The flag where the test holds, else 0; a null test doesn't hold."""
    return F.when(test, F.lit(flag)).otherwise(F.lit(0))


def either(*flags: Column) -> Column:
    out = flags[0]
    for flag in flags[1:]:
        out = out.bitwiseOR(flag)
    return out


def record(qc: Column, bit: int, test: Column) -> Column:
    """Sets a bit (from 1) where the test holds."""
    return either(F.coalesce(qc, F.lit(0)), bit_if(test, 1 << (bit - 1)))


def roll_up(qc: Column, mask: int, bad_flag: int = 1, ind_flag: int = 2, onto: Column | None = None) -> Column:
    """One of two flags for any set bit; or-ed onto another column if that is given."""
    flag = F.when(any_of(qc, mask), F.lit(bad_flag)).when(F.coalesce(qc, F.lit(0)) != 0, F.lit(ind_flag)).otherwise(F.lit(0))
    return flag if onto is None else either(F.coalesce(onto, F.lit(0)), flag)


def map_codes(qc: Column, bad_codes: list[int]) -> Column:
    """Listed codes become bad, all other non-zero ones indeterminate."""
    return F.when(qc.isin(*bad_codes), F.lit(BAD)).when(F.coalesce(qc, F.lit(0)) != 0, F.lit(INDETERMINATE)).otherwise(F.lit(0))


def is_good(value: Column, qc: Column | None = None, mask: int = 1) -> Column:
    """Not null, finite and without masked bits."""
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.coalesce(ok if qc is None else ok & ~any_of(qc, mask), F.lit(False))
