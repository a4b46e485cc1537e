"""HMAC-SHA256 of a text column from nested SHA-2, without leaving the JVM.

A key given as a string becomes two literals that show in query plans. Where plans are exposed, give
the key as a column instead, read from a table of one row: then no plan holds it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(secret: str) -> tuple[bytes, bytes]:
    key = secret.encode()
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    return bytes(k ^ 0x36 for k in key), bytes(k ^ 0x5C for k in key)


def _column_pads(secret: Column) -> tuple[Column, Column]:
    """The pads of a key column: its bytes, hashed if too long and filled with zeros, under two masks."""
    raw = F.encode(secret, "UTF-8")
    key = F.when(F.octet_length(raw) > _BLOCK, F.unhex(F.sha2(raw, 256))).otherwise(raw)
    digits = F.rpad(F.hex(key), 2 * _BLOCK, "0")

    def masked(mask: int) -> Column:
        places = F.sequence(F.lit(0), F.lit(_BLOCK - 1))
        byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        pairs = F.transform(places, lambda i: F.lpad(F.hex(byte(i).bitwiseXOR(F.lit(mask))), 2, "0"))
        return F.unhex(F.array_join(pairs, ""))

    return masked(0x36), masked(0x5C)


def hmac_sha256(message: Column, secret: str | Column) -> Column:
    if isinstance(secret, str):
        inner_pad, outer_pad = (F.lit(bytearray(pad)) for pad in _pads(secret))
    else:
        inner_pad, outer_pad = _column_pads(secret)
    inner = F.sha2(F.concat(inner_pad, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def sign(message: Column, secret: str | Column) -> Column:
    return F.concat(F.lit("sha256="), hmac_sha256(message, secret))


def bare_signature(header: Column) -> Column:
    """Signature without its scheme: text after the first ``=``, else after the first ``:``."""
    return F.regexp_replace(header, r"\A(?:[^=]*=|[^=:]*:(?=[^=]*\z))", "")


def verify(message: Column, header: Column, secret: str | Column) -> Column:
    return bare_signature(header) == hmac_sha256(message, secret)
