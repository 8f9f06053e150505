"""Scalar functions as Column expressions: all stay in the JVM, none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def guarded_ratio(value: Column, by: Column, zero: str = "zero_reference") -> tuple[Column, Column]:
    """(value / by, null) or (null, reason); a quotient that underflows to 0 ends the query."""
    q = F.try_divide(value.cast("double"), by.cast("double"))
    lost = (q == 0) & (value != 0)
    return F.when(lost, F.raise_error(F.lit("underflow")).cast("double")).otherwise(q), F.when(by == 0, F.lit(zero))


def gcd(a: Column, b: Column) -> Column:
    """the greatest common divisor of two longs, by Euclid; 92 steps suffice for any two longs."""
    start = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, s["y"]).otherwise(F.try_mod(s["x"], s["y"])).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step)["x"]


def half_away(x: Column, digits: int = 6) -> Column:
    """rounded half away from zero, as an exact decimal."""
    return F.round(x.cast("decimal(30,12)"), digits)


def is_close(a: Column, b: Column, relative: float = 1e-9) -> Column:
    """whether two numbers agree to a relative tolerance; equal infinities do, NaN does not."""
    return F.coalesce((a == b) | (F.abs(a - b) <= relative * F.greatest(F.abs(a), F.abs(b))), F.lit(False)) & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))


def clean_text(s: Column, pattern: str | None = None) -> Column:
    """not empty, no white space at the ends, no control characters, and a full match if a pattern is given."""
    ok = (F.length(s) > 0) & (F.trim(s) == s) & ~s.rlike(r"[\x00-\x1f\x7f]")
    if pattern:
        ok = ok & s.rlike(rf"\A(?:{pattern})\z")
    return F.coalesce(ok, F.lit(False))


def escape_markdown(s: Column) -> Column:
    """text that can make no heading, link, tag or cell; a missing value is named."""
    # What is escaped, and the text for a missing value.
    for old, new in (("\n", " "), ("\r", " "), ("|", "\\|"), ("<", "&lt;"), (">", "&gt;"), ("[", "\\["), ("]", "\\]")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.coalesce(s, F.lit("Não informado"))


def valid_utf8(b: Column) -> Column:
    """whether bytes are UTF-8 text; null bytes are not."""
    return F.coalesce(F.is_valid_utf8(b.cast("string")), F.lit(False))


def strict_date(s: Column) -> Column:
    """F16: a date of the form YYYY-MM-DD that the calendar has, else null."""
    return F.when(s.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).cast("date"))


def instant(s: Column) -> Column:
    """an ISO instant with an offset, cut to milliseconds, else null."""
    form = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})\z"
    return F.when(s.rlike(form), F.date_trunc("millisecond", F.try_to_timestamp(s)))


def civil_day(t: Column, zone: str) -> Column:
    """the day that the instant falls on in a time zone."""
    return F.from_utc_timestamp(t, zone).cast("date")


def utc_text(t: Column) -> Column:
    """the instant as ISO text in UTC with milliseconds (the session's time zone is UTC)."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def id_digest(ids: Column) -> Column:
    """SHA-256 of the compact JSON list of the group's ids, in order (an aggregate)."""
    return F.sha2(F.to_json(F.array_sort(F.collect_list(ids))), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """the keyed hash of RFC 2104 in lower-case hex, of a key of at most 64 bytes."""
    if len(key) > 64:
        raise ValueError("a key of at most 64 bytes is needed")
    padded = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(k ^ pad for k in padded)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def keys_are(json: Column, names: list[str]) -> Column:
    """whether a JSON object has exactly these keys."""
    return F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array(*[F.lit(n) for n in sorted(names)]), F.lit(False))


def exact_decimal(s: Column, precision: int, scale: int) -> Column:
    """a plain decimal of at most these digits, without exponent, sign or leading zeros, else null."""
    whole = precision - scale
    form = rf"\A(0|[1-9][0-9]{{0,{whole - 1}}})([.][0-9]{{1,{scale}}})?\z"
    return F.when(s.rlike(form), s.cast(f"decimal({precision},{scale})"))


def canonical_number(s: Column) -> Column:
    """the text of a number without trailing zeros behind the point."""
    return F.when(F.instr(s, ".") > 0, F.regexp_replace(s, r"[.]?0+\z", "")).otherwise(s)


def cents_of(s: Column) -> Column:
    """a price with `.` or `,` and one or two decimals, as whole cents, else null."""
    form = r"\A([0-9]{1,12})(?:[.,]([0-9]{1,2}))?\z"
    whole, part = F.regexp_extract(s, form, 1), F.regexp_extract(s, form, 2)
    return F.when(s.rlike(form), whole.cast("long") * 100 + F.rpad(part, 2, "0").cast("long"))


def format_cents(cents: Column) -> Column:
    """cents as reais: R$ 1.234,56."""
    digits = F.translate(F.format_number(F.floor(F.abs(cents) / 100), 0), ",", ".")
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("R$ "), digits, F.lit(","), F.lpad((F.abs(cents) % 100).cast("string"), 2, "0"))
