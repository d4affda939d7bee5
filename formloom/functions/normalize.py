"""Value normalisation: each function returns struct<value string, codes array<string>>."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Accepted boolean spellings and month names.
TRUE_WORDS = ("true", "yes", "y", "checked", "1", "x")
FALSE_WORDS = ("false", "no", "n", "unchecked", "0")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
DATE_ORDERS = ("DMY", "MDY", "YMD", "REJECT_AMBIGUOUS")


def _result(value: Column, code: Column | None = None) -> Column:
    codes = F.when(code.isNull(), F.array().cast("array<string>")).otherwise(F.array(code)) if code is not None else F.array().cast("array<string>")
    return F.struct(value.cast("string").alias("value"), codes.alias("codes"))


def _checked(value: Column, code: str) -> Column:
    return _result(value, F.when(value.isNull(), F.lit(code)))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """The ISO string of a date, null if there is no such day. Two-digit years are of this century."""
    full = F.when(year < 100, year + 2000).otherwise(year)
    return F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", full, month, day), "yyyy-MM-dd"), "yyyy-MM-dd")


def normalize_boolean(raw: Column) -> Column:
    value = let(F.lower(F.trim(raw)), lambda v: F.when(v.isin(*TRUE_WORDS), "true").when(v.isin(*FALSE_WORDS), "false"))
    return let(value, lambda v: _checked(v, "invalid_boolean"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_date(raw: Column, order: str = "REJECT_AMBIGUOUS") -> Column:
    """Slashed, dotted, compact and month-name dates. Six or eight digits are read as a compact date before month names are."""
    if order not in DATE_ORDERS:
        raise ValueError(f"unknown date order {order}")
    ymd, dmy = r"^(\d{4})/(\d{1,2})/(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$"
    before, after = r"^(\d{1,2}) ([a-z]+) (\d{4})$", r"^([a-z]+) (\d{1,2}) (\d{4})$"
    part = lambda text, pattern, i: F.regexp_extract(text, pattern, i).try_cast("int")
    text = F.trim(raw)
    forms = F.struct(F.regexp_replace(text, r"\s*[.,\-/]\s*", "/").alias("slashed"), F.regexp_replace(text, r"\D", "").alias("digits"), F.lower(F.regexp_replace(text, r"\s+", " ")).alias("words"))

    def triple(y: Column, m: Column, d: Column, swap: bool) -> Column:
        """Year and two numbers; ``swap`` says that the order of the two is the setting's."""
        if swap and order == "MDY":
            m, d = d, m
        doubt = (m <= 12) & (d <= 12) if swap and order == "REJECT_AMBIGUOUS" else F.lit(False)
        return F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"), doubt.alias("doubt"))

    def parsed(f: Column) -> Column:
        s, g, w = f["slashed"], f["digits"], f["words"]
        piece = lambda a, n: F.substring(g, a, n).try_cast("int")
        month = lambda name: F.coalesce(*[F.when(name.isin(m, m[:3]), F.lit(i)) for i, m in enumerate(MONTHS, 1)])
        eight = triple(piece(1, 4), piece(5, 2), piece(7, 2), False) if order == "YMD" else triple(piece(5, 4), piece(3, 2), piece(1, 2), True)
        return (
            F.when(s.rlike(ymd), triple(part(s, ymd, 1), part(s, ymd, 2), part(s, ymd, 3), False))
            .when(s.rlike(dmy), triple(part(s, dmy, 3), part(s, dmy, 2), part(s, dmy, 1), True))
            .when(F.length(g) == 6, triple(piece(5, 2) + 2000, piece(3, 2), piece(1, 2), True))
            .when(F.length(g) == 8, eight)
            .when(w.rlike(before), triple(part(w, before, 3), month(F.regexp_extract(w, before, 2)), part(w, before, 1), False))
            .when(w.rlike(after), triple(part(w, after, 3), month(F.regexp_extract(w, after, 1)), part(w, after, 2), False))
        )

    def finished(t: Column) -> Column:
        value = F.when(~t["doubt"], iso_date(t["y"], t["m"], t["d"]))
        return let(F.struct(value.alias("v"), t["doubt"].alias("doubt")), lambda x: _result(x["v"], F.when(x["doubt"], F.lit("ambiguous_date")).when(x["v"].isNull(), F.lit("invalid_date"))))

    return let(forms, lambda f: let(parsed(f), finished))


def normalize_time(raw: Column) -> Column:
    pattern = r"^(\d{1,2}):?(\d{2})?(am|pm)?$"

    def parsed(v: Column) -> Column:
        part = lambda i: F.regexp_extract(v, pattern, i)
        good = v.rlike(pattern) & ~v.rlike(r"^\d{1,2}:(am|pm)?$")
        return F.struct(F.when(good, part(1).try_cast("int")).alias("h"), F.when(part(2) != "", part(2).try_cast("int")).otherwise(F.lit(0)).alias("m"), part(3).alias("half"))

    def finished(t: Column) -> Column:
        hour = F.when(t["half"] == "", t["h"]).when(t["h"].between(1, 12), t["h"] % 12 + F.when(t["half"] == "pm", 12).otherwise(0))
        return F.when(hour.between(0, 23) & t["m"].between(0, 59), F.format_string("%02d:%02d", hour, t["m"]))

    value = let(F.lower(F.regexp_replace(raw, r"[.\s]", "")), lambda v: let(parsed(v), finished))
    return let(value, lambda v: _checked(v, "invalid_time"))


def _trimmed(x: Column, digits: int) -> Column:
    """A number as Python formats it: exact binary value, ties to even, no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.format_number(x, digits), F.lit(","), F.lit("")), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def normalize_weight(raw: Column, unit: str = "kg") -> Column:
    pattern = r"(\d+(?:\.\d+)?)\s*(kg|g)?"

    def parsed(v: Column) -> Column:
        return F.struct(F.when(v.rlike(pattern), F.regexp_extract(v, pattern, 1).try_cast("double")).alias("n"), F.regexp_extract(v, pattern, 2).alias("unit"))

    def kilos(t: Column) -> Column:
        return F.when((t["unit"] == "g") | ((t["unit"] == "") & (t["n"] > 20)), t["n"] / 1000).otherwise(t["n"])

    shown = (lambda x: F.concat(F.format_string("%.0f", F.bround(x * 1000, 0)), F.lit(" g"))) if unit == "g" else (lambda x: F.concat(_trimmed(x, 3), F.lit(" kg")))
    value = let(F.replace(F.lower(raw), F.lit(","), F.lit(".")), lambda v: let(let(parsed(v), kilos), shown))
    return let(value, lambda v: _checked(v, "invalid_weight"))


def normalize_value(raw: Column, kind: Column, date_order: str = "REJECT_AMBIGUOUS", weight_unit: str = "kg") -> Column:
    """By field type; blank values are missing, strings are squeezed."""
    blank = raw.isNull() | (F.trim(F.regexp_replace(raw, r"(?U)\s+", " ")) == "")
    return (
        F.when(blank, _result(F.lit(None), F.lit("missing_value")))
        .when(kind == "boolean", normalize_boolean(raw))
        .when(kind == "date", normalize_date(raw, date_order))
        .when(kind == "time", normalize_time(raw))
        .when(kind == "weight", normalize_weight(raw, weight_unit))
        .otherwise(_result(F.trim(F.regexp_replace(raw, r"(?U)\s+", " "))))
    )
