"""Keyed tokens and perceptual-hash words."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(key: str, message: Column) -> Column:
    """HMAC-SHA256 of a text under a fixed key, as hex; two nested digests."""
    raw = key.encode()
    k = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def normal_identifier(kind: Column, value: Column) -> Column:
    """Per-kind normal form of an identifier."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind.isin("pan", "ifsc"), F.regexp_replace(F.upper(value), "[^A-Z0-9]", ""))
        .when(kind.isin("account", "account_number", "payout_account"), digits)
        .when(kind == "phone", F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise(digits))
        .otherwise(F.regexp_replace(F.trim(F.upper(value)), r"\s+", " "))
    )


def entity_token(kind: Column, value: Column, pepper: str) -> Column:
    return hmac_sha256(pepper, F.concat(kind, F.lit(":"), normal_identifier(kind, value)))


def hash_words(hex_col: Column) -> Column:
    """A 64-digit hex hash as four signed 64-bit words."""
    return F.array(*[F.conv(F.substring(hex_col, i * 16 + 1, 16), 16, -10).cast("bigint") for i in range(4)])


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of four words."""
    d = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(4)]
    return d[0] + d[1] + d[2] + d[3]


def salted(words: Column, salt_words: list[int]) -> Column:
    return F.array(*[F.get(words, F.lit(i)).bitwiseXOR(F.lit(s).cast("bigint")) for i, s in enumerate(salt_words)])
