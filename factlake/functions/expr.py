"""Typing of text cells, ids, locators and exact decimal arithmetic, as Column expressions."""

from __future__ import annotations

import unicodedata
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CURRENCIES, SCALE_FACTORS, VALUE, YEAR_DAYS

#: White space that is trimmed: control spaces, U+0020, U+0085 and U+00A0.
SPACES = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0))


def _unaccented(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))


#: Latin-1 characters, and upper forms of theirs, that lose an accent or a compatibility form.
_PLAIN = {c: p for c in [*map(chr, range(0x80, 0x100)), "\u0178"] if (p := _unaccented(c)) != c}


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def trimmed(c: Column) -> Column:
    return F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))


def blank_to_null(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def strip_accents(c: Column) -> Column:
    """Complete for Latin-1 text: single characters by one translate, the rest (fractions) by replace."""
    one = {k: v for k, v in _PLAIN.items() if len(v) == 1}
    out = F.translate(c, "".join(one), "".join(one.values()))
    for k, v in _PLAIN.items():
        if len(v) != 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def upper_plain(c: Column) -> Column:
    return strip_accents(F.upper(trimmed(c)))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def iso_date(c: Column) -> Column:
    """yyyy-mm-dd, exactly, or null."""
    t = trimmed(c)
    return F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t.try_cast("date"))


def decimal_value(c: Column) -> Column:
    return trimmed(c).try_cast(VALUE)


def digits_int(c: Column) -> Column:
    """An int written in digits only; leading zeros count for nothing."""
    t = trimmed(c)
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))


def yes_no(c: Column) -> Column:
    t = F.upper(trimmed(c))
    return F.when(t == "S", F.lit(True)).when(t == "N", F.lit(False))


def row_id(*parts: Column) -> Column:
    """32 hex digits of the SHA-256 of the parts, joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 32)


def packed(c: Column) -> Column:
    """Text as bytes without loss, lower-case hexadecimal in half as many: ids are shuffled so. The order is not that of the text."""
    raw = F.unhex(c)
    return F.when(F.lower(F.hex(raw)) == c, F.concat(F.unhex(F.lit("01")), raw)).otherwise(F.concat(F.unhex(F.lit("00")), c.cast("binary")))


def unpacked(c: Column) -> Column:
    """The text of packed."""
    rest = F.substring(c, 2, 2_000_000_000)
    return F.when(F.substring(c, 1, 1) == F.unhex(F.lit("01")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def locator(member: Column, line: Column, account: Column, column: Column) -> Column:
    return F.concat(member, F.lit("#L"), line.cast("string"), F.lit(":cd_conta="), account, F.when(column != "", F.concat(F.lit(":coluna="), column)).otherwise(F.lit("")))


_LOCATOR = "^(.*)#L([0-9]+):cd_conta=(.*?)(?::coluna=(.*))?$"


def locator_parts(c: Column) -> dict[str, Column]:
    """Columns member, line_no, account and column of a locator."""
    part = [F.regexp_extract(c, _LOCATOR, i) for i in range(1, 5)]
    return {"member": part[0], "line_no": part[1].try_cast("int"), "account": part[2], "column": part[3]}


def scale_factor(c: Column) -> Column:
    out, up = F.lit(None).cast("decimal(4,0)"), F.upper(c)
    for name, factor in SCALE_FACTORS.items():
        out = F.when(up == name, F.lit(factor).cast("decimal(4,0)")).otherwise(out)
    return out


def scaled(value: Column, scale: Column) -> Column:
    """value * factor without loss of scale; null if it takes more than 23 integer digits or the scale is unknown."""
    return (value.try_cast("decimal(33,10)") * scale_factor(scale)).cast(VALUE)


def currency(c: Column) -> Column:
    out, up = F.lit(None).cast("string"), F.upper(c)
    for name, code in CURRENCIES.items():
        out = F.when(up == name, F.lit(code)).otherwise(out)
    return out


def period_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def period_type(start: Column, end: Column) -> Column:
    return F.when(start.isNull(), F.lit("instant")).when(period_days(start, end).between(*YEAR_DAYS), F.lit("year"))


def entity_id(cnpj: Column) -> Column:
    return F.when(cnpj.rlike("^[0-9]{14}$"), F.concat(F.lit("br:cnpj:"), cnpj))


def metric(statement: Column, account: Column, column: Column) -> Column:
    return F.concat(F.lit("cvm:"), F.lower(statement), F.lit(":"), account, F.when(column != "", F.concat(F.lit(":"), column)).otherwise(F.lit("")))


def narrow(c: Column) -> Column:
    """A value as decimal(37,10), in which differences of two keep all ten places; null if it has more than 27 integer digits."""
    return c.try_cast("decimal(37,10)")


def delta(original: Column, revised: Column) -> Column:
    """Exact difference; of values with 28 integer digits to nine places, and null if it takes 29 digits."""
    return F.coalesce(narrow(revised) - narrow(original), F.try_subtract(revised, original).try_cast(VALUE))


#: Bases of a value's three parts: unscaled, it is high * 10^24 + low * 10^10 + places.
_LOW, _PLACES = 10**14, 10**10
_PART = "decimal(38,0)"


def _number(n: int) -> Column:
    return F.lit(Decimal(n)).cast(f"decimal({max(1, len(str(abs(n))))},0)")


def _parts(c: Column) -> list[Column]:
    """high, low and places of a value of decimal(38,10), of its sign, each a whole number of 14 digits or fewer."""
    c = c.cast(VALUE)
    whole = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("decimal(28,0)")
    low = (whole % _number(_LOW)).cast("decimal(14,0)")
    # exact: what is divided is a multiple of the divisor
    high = ((whole - low).cast("decimal(28,0)") / _number(_LOW)).cast("decimal(14,0)")
    places = (((c % _number(1)).cast("decimal(10,10)")) * _number(_PLACES)).cast("decimal(10,0)")
    return [high, low, places]


def _floored(c: Column, base: int) -> Column:
    """Floor of a whole number by a base."""
    rest = F.pmod(c, _number(base)).cast("decimal(15,0)")
    return ((c - rest).cast(_PART) / _number(base)).cast("decimal(37,0)")


def _reaches(original: Column, revised: Column, left: int, right: int) -> Column:
    """|revised - original| * left >= |original| * right, exactly, of any two values; left and right have up to 21 digits.

    All is done on parts, whose products fit, and carried upwards; the sign of the highest part decides.
    """
    grown, negative = F.when(revised >= original, _number(1)).otherwise(_number(-1)), F.when(original < 0, _number(-1)).otherwise(_number(1))
    high, low, places = [
        (((r - o).cast("decimal(15,0)") * grown).cast("decimal(15,0)") * _number(left)).cast("decimal(37,0)") - ((o * negative).cast("decimal(14,0)") * _number(right)).cast("decimal(36,0)")
        for o, r in zip(_parts(original), _parts(revised), strict=True)
    ]
    low = (low.cast("decimal(37,0)") + _floored(places.cast("decimal(37,0)"), _PLACES)).cast("decimal(37,0)")
    return (high.cast("decimal(37,0)") + _floored(low, _LOW)) >= 0


def _hundredfold(c: Column) -> Column:
    """100 times a value below 10^27, all places kept."""
    c = c.try_cast("decimal(37,10)")
    whole = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("decimal(27,0)")
    places = ((c % _number(1)).cast("decimal(10,10)") * _number(100)).cast("decimal(10,8)")
    return ((whole * _number(100)).cast("decimal(29,0)") + places).cast("decimal(38,8)")


def _percent(original: Column, revised: Column) -> Column:
    """Percent of |original|; exact to the result's places while the difference is below 10^27, else of a product to six places."""
    d = delta(original, revised)
    return F.coalesce(F.try_divide(_hundredfold(d), F.abs(original)), F.try_divide(F.try_multiply(d, _number(100)), F.abs(original)))


def delta_pct(original: Column, revised: Column) -> Column:
    """Percent of |original|, six places; null where the original is zero or it takes more than 32 integer digits."""
    return F.when(original != 0, _percent(original, revised).try_cast("decimal(38,6)"))


#: Places and digits of a limit in percent.
LIMIT_PLACES, LIMIT_DIGITS = 18, 21


def at_least_pct(original: Column, revised: Column, min_pct: float | Decimal | str) -> Column:
    """|delta| in percent of |original| is min_pct or more, exactly, for any two values; zero originals drop out.

    A limit has up to 18 places and, its places included, 21 digits; one below zero is met by all.
    """
    limit = Decimal(str(min_pct))
    places = max(0, -limit.normalize().as_tuple().exponent)
    right = int(limit.scaleb(places))
    if places > LIMIT_PLACES or right >= 10**LIMIT_DIGITS:
        raise ValueError(f"a limit in percent has at most {LIMIT_PLACES} places and {LIMIT_DIGITS} digits: {min_pct}")
    return (original != 0) & (_reaches(original, revised, 100 * 10**places, right) if right > 0 else original.isNotNull() & revised.isNotNull())


def thousands(value: Column) -> Column:
    return (value.cast("decimal(33,5)") / F.lit(1000).cast("decimal(4,0)")).cast(VALUE)
