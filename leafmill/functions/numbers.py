"""Spreadsheet arithmetic and number texts as Columns; every rule that differs from SQL is stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """halves go towards plus infinity."""
    p = float(10**digits) if digits >= 0 else 1.0 / 10**-digits
    return F.floor(x * p + 0.5).cast("double") / p


def round_up(x: Column, digits: int = 0) -> Column:
    """away from zero."""
    p = float(10.0**digits)
    return F.signum(x) * F.ceil(F.abs(x) * p).cast("double") / p


def round_down(x: Column, digits: int = 0) -> Column:
    """towards zero."""
    p = float(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * p).cast("double") / p


def modulo(a: Column, b: Column) -> Column:
    """with the sign of the divisor; null where the divisor is 0 (an error of the sheet)."""
    return F.when(b == 0, None).otherwise(a - b * F.floor(a / F.when(b != 0, b)))


def utf16_length(s: Column) -> Column:
    """code units of UTF-16."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def squeeze(s: Column) -> Column:
    """ends trimmed, white space inside as single blanks."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def left(s: Column, n: Column) -> Column:
    """a negative length gives ''."""
    return F.when(n <= 0, "").otherwise(F.left(s, n))


def right(s: Column, n: Column) -> Column:
    """more than there is gives the whole text."""
    return F.when(n <= 0, "").otherwise(F.right(s, n))


def mid(s: Column, start: Column, n: Column) -> Column:
    """a start below 1 counts from the end."""
    at = F.when(start >= 1, start).otherwise(F.greatest(F.length(s) + start, F.lit(1)))
    return F.when(n <= 0, "").otherwise(F.substring(s, at, n))


def parse_number(s: Column) -> Column:
    """blanks left out, a decimal comma, a percent sign; null where it is no number."""
    t = F.regexp_replace(s, r"[\s ]+", "")
    percent = t.endswith("%")
    body = F.replace(F.regexp_replace(t, "%$", ""), F.lit(","), F.lit("."))
    value = F.when(body.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), body.try_cast("double"))
    return F.when(percent, value / 100).otherwise(value)


def typed_number(raw: Column) -> Column:
    """Q8: the number that typed text stands for: dates as serials of 1899-12-30 with lenient days, percent, a decimal comma.

    Codes with leading zeros, more than 15 digits, months beyond 12 and days beyond 31 stay text (null).
    """
    s = F.regexp_replace(F.trim(raw), r"[  ]", "")
    date = r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$"
    d, m, y = (F.regexp_extract(s, date, i).try_cast("int") for i in (1, 2, 3))
    good = m.between(1, 12) & d.between(1, 31) & (y >= 1)
    serial = F.datediff(F.date_add(F.make_date(F.when(good, y).otherwise(2000), F.when(good, m).otherwise(1), F.lit(1)), F.when(good, d).otherwise(1) - 1), F.lit("1899-12-30").cast("date"))
    percent = s.endswith("%")
    t = F.regexp_replace(s, "%$", "")
    t = F.when((F.length(t) - F.length(F.replace(t, F.lit(","), F.lit(""))) == 1) & ~t.contains("."), F.replace(t, F.lit(","), F.lit("."))).otherwise(t)
    plain = t.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$") & ~t.rlike(r"^-?0\d") & (F.length(F.regexp_replace(t, r"[-.]", "")) <= 15)
    value = F.when(plain, t.try_cast("double"))
    return F.when(s.rlike(date), F.when(good, serial.cast("double"))).otherwise(F.when(percent, value / 100).otherwise(value))


def differs(a: Column, b: Column) -> Column:
    """apart by more than 1e-9, relative to the larger of 1 and a."""
    return F.abs(a - b) > 1e-9 * F.greatest(F.lit(1.0), F.abs(a))


def grouped(x: Column, digits: int = 0) -> Column:
    """Thousands apart by blanks, a point for decimals."""
    return F.translate(F.format_number(x, digits), ",", " ")


def general(x: Column) -> Column:
    """whole numbers without a point, others with at most ten significant digits."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    digits = F.greatest(F.lit(0), F.lit(10) - F.when(x == 0, 1).otherwise(F.floor(F.log10(F.abs(F.when(x == 0, 1.0).otherwise(x)))) + 1)).cast("int")
    text = F.regexp_replace(F.replace(F.format_string("%.10f", F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)), F.lit(","), F.lit("")), r"\.?0+$", "")
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(text)


def column_name(index: Column) -> Column:
    """Q9: 0 is A, 25 is Z, 26 is AA; up to three letters."""
    letter = lambda n: F.char((n + 65).cast("int"))
    i = index.cast("int")
    return (
        F.when(i < 26, letter(i))
        .when(i < 702, F.concat(letter((i / 26).cast("int") - 1), letter(i % 26)))
        .otherwise(F.concat(letter(((i - 702) / 676).cast("int")), letter(((i - 702) % 676 / 26).cast("int")), letter((i - 702) % 26)))
    )


def column_index(name: Column) -> Column:
    """Q9: A is 0."""
    return F.aggregate(F.split(F.upper(name), ""), F.lit(0), lambda a, c: a * 26 + (F.ascii(c) - 64)) - 1


def cell_reference(ref: Column) -> Column:
    """Q10: ``B3`` and ``$B$3`` as (row, col), both from 0; anything else null."""
    pattern = r"^\$?([A-Za-z]{1,3})\$?(\d+)$"
    return F.when(ref.rlike(pattern), F.struct((F.regexp_extract(ref, pattern, 2).cast("int") - 1).alias("row"), column_index(F.regexp_extract(ref, pattern, 1)).alias("col")))


def display(x: Column, code: str | None) -> Column:
    """A number by a format code: General, dates, percent, grouped and plain decimals, and a literal in quotes after it."""
    import re

    if not code or code == "General":
        return general(x)
    literal = re.search(r'"([^"]*)"', code)
    core = re.sub(r'\[[^\]]*\]|\\|"[^"]*"', "", code.split(";")[0])
    low = core.lower()
    if ("y" in low or "d" in low) and "0" not in low:
        day = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(x).cast("int"))
        seconds = F.round((x - F.floor(x)) * 86400).cast("int")
        clock = F.date_format(F.timestamp_seconds(seconds), "HH:mm:ss" if "ss" in low else "HH:mm")
        return F.concat_ws(" ", F.date_format(day, "dd.MM.yyyy"), clock) if "h" in low else F.date_format(day, "dd.MM.yyyy")
    digits = len(re.match(r"[0#]*", core.partition(".")[2])[0].replace("#", ""))
    if "%" in core:
        return F.concat(F.translate(F.format_number(x * 100, digits), ",", ""), F.lit("%"))
    out = grouped(x, digits) if "," in core else F.translate(F.format_number(x, digits), ",", "")
    return F.concat(out, F.lit(" " + literal[1])) if literal and literal[1] else out


def utf16_units(char: Column) -> Column:
    """The signed numbers of a character's UTF-16 units, as rich text escapes them, apart by ``?\\u``; '' for none."""
    units = F.hex(F.encode(char, "UTF-16BE"))
    number = lambda i: F.conv(F.substring(units, i, F.lit(4)), 16, 10).cast("int")
    signed = lambda n: F.when(n > 32767, n - 65536).otherwise(n).cast("string")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(units) - 3, F.lit(1)), F.lit(4)), lambda i: signed(number(i))), "?\\u")
