"""Checks of identifier numbers as Column expressions.

All take a string column and return a boolean column, null for null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public standards: GB 11643 (resident id) and GB 32100 (credit code).
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECK = "10X98765432"
CODE_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
CODE_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)
CODE_AUTHORITIES = "159Y"
PLATE_PROVINCES = "京津冀晋蒙辽吉黑沪苏浙皖闽赣鲁豫鄂湘粤桂琼渝川贵云藏陕甘青宁新"


def _char(s: Column, i: int) -> Column:
    return F.substring(s, i + 1, 1)


def real_date(digits: Column) -> Column:
    """Eight digits that are a day of the years 1900 to 2099."""
    return digits.rlike("^(19|20)[0-9]{6}$") & F.try_to_timestamp(digits, F.lit("yyyyMMdd")).isNotNull()


def resident_id_shape(s: Column) -> Column:
    s = F.trim(s)
    return s.rlike("^[1-8][0-9]{16}[0-9Xx]$") & F.coalesce(real_date(F.substring(s, 7, 8)), F.lit(False))


def resident_id_valid(s: Column) -> Column:
    """Shape and check character; a small x is never the check character."""
    t = F.trim(s)
    total = sum((F.coalesce(_char(t, i).try_cast("int"), F.lit(0)) * w for i, w in enumerate(ID_WEIGHTS)), F.lit(0))
    return resident_id_shape(s) & (_char(t, 17) == F.substring(F.lit(ID_CHECK), total % 11 + 1, F.lit(1)))


def credit_code_shape(s: Column) -> Column:
    return F.trim(s).rlike(f"^[{CODE_AUTHORITIES}][{CODE_ALPHABET}][0-9]{{6}}[{CODE_ALPHABET}]{{10}}$")


def credit_code_valid(s: Column) -> Column:
    t = F.trim(s)
    total = sum((_position(CODE_ALPHABET, _char(t, i)) * w for i, w in enumerate(CODE_WEIGHTS)), F.lit(0))
    check = F.pmod(31 - total % 31, F.lit(31))
    return t.rlike(f"^[{CODE_ALPHABET}]{{17}}.$") & (_char(t, 17) == F.substring(F.lit(CODE_ALPHABET), check + 1, F.lit(1)))


def _position(alphabet: str, c: Column) -> Column:
    """Place of a character in the alphabet, from 0."""
    return F.instr(F.lit(alphabet), c) - 1


def luhn(s: Column) -> Column:
    t = F.trim(s)
    return t.rlike("^[0-9]{12,}$") & F.call_function("luhn_check", t)


def card_shape(s: Column) -> Column:
    return F.trim(s).rlike("^[2-6][0-9]{12,18}$")


def account_shape(s: Column) -> Column:
    return F.trim(s).rlike("^[0-9]{8,32}$")


def malaysian_id_shape(s: Column) -> Column:
    """Twelve digits, the first six a day of this or the last century."""
    d = F.regexp_replace(s, "[^0-9]", "")
    day = F.substring(d, 1, 6)
    dated = [F.coalesce(real_date(F.concat(F.lit(c), day)), F.lit(False)) for c in ("19", "20")]
    return (F.length(d) == 12) & (dated[0] | dated[1])


def plate_shape(s: Column) -> Column:
    return F.trim(s).rlike(f"^[{PLATE_PROVINCES}][A-Za-z][0-9A-HJ-NP-Za-hj-np-z]{{5,6}}$")
