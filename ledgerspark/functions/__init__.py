"""Column functions of the inventory's scalar rows."""

from .scalars import (
    canonical_number, cents_of, civil_day, clean_text, escape_markdown, exact_decimal, format_cents, gcd, guarded_ratio, half_away, hmac_sha256, id_digest, instant, is_close, keys_are, strict_date, utc_text, valid_utf8,
)

__all__ = [
    "canonical_number", "cents_of", "civil_day", "clean_text", "escape_markdown", "exact_decimal", "format_cents", "gcd", "guarded_ratio", "half_away", "hmac_sha256", "id_digest", "instant", "is_close", "keys_are", "strict_date", "utc_text", "valid_utf8",
]
