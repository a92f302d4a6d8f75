"""Session ids, canonical JSON, digests and common prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SAFE_SESSION = r"\A[A-Za-z0-9._-]{1,64}\z"
LENGTH_BITS = 30  # texts of up to 2**31 - 1 characters


def sha256_hex(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def safe_session(header: Column) -> Column:
    """A session id usable as a file name; anything unusual is replaced by a hash id."""
    return F.when(F.rlike(header, F.lit(_SAFE_SESSION)), header).otherwise(
        F.concat(F.lit("hdr-"), sha256_hex(header, 10))
    )


def auto_session(canonical: Column) -> Column:
    return F.concat(F.lit("auto-"), sha256_hex(canonical, 10))


def canonical_json(value: Column) -> Column:
    """Compact JSON text of a VARIANT with sorted keys; NULL for JSON null.

    Number text is normalized (``1.0`` becomes ``1``), so digests are comparable within this
    package only.
    """
    text = F.to_json(value)
    return F.when(text != "null", text)


def canonical_list(items: Column) -> Column:
    """Canonical text of a list whose elements are canonical texts."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def common_prefix_len(a: Column, b: Column, bits: int = LENGTH_BITS) -> Column:
    """Number of leading characters two texts share, by halving steps over substrings.

    ``bits``: the texts are shorter than ``2 ** (bits + 1)`` characters.
    """
    limit = F.least(F.length(a), F.length(b))

    def extend(done: Column, bit: Column) -> Column:
        step = F.pow(F.lit(2.0), bit).cast("int")
        start = done + 1
        fits = done.cast("bigint") + step.cast("bigint") <= limit
        same = F.substr(a, start, step) == F.substr(b, start, step)
        return F.when(fits & same, done + step).otherwise(done)

    return F.when(
        a.isNotNull() & b.isNotNull(),
        F.aggregate(F.sequence(F.lit(bits), F.lit(0), F.lit(-1)), F.lit(0), extend),
    )


def ledger_day(ts: Column) -> Column:
    """The local day as written in the timestamp text."""
    return F.to_date(F.substring(ts, 1, 10))


def hmac_sha256_hex(salt: bytes, text: Column, length: int = 64) -> Column:
    """HMAC-SHA-256 of a text under one key, as nested digests."""
    import hashlib

    key = hashlib.sha256(salt).digest() if len(salt) > 64 else salt
    key = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    first = F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))
    return F.substring(F.sha2(F.concat(outer, first), 256), 1, length)
