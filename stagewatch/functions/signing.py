"""HMAC-SHA256 as a Catalyst expression.

The two padded key blocks of each secret are prepared once on the driver (one secret per source
system, six at most); the hashing of the payloads is ``sha2`` inside the JVM.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

BLOCK = 64
PREFIX = "sha256="


def key_blocks(secret: str) -> tuple[bytes, bytes]:
    """Inner and outer key block of RFC 2104."""
    key = secret.encode("utf-8")
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(body: Column, inner: Column, outer: Column) -> Column:
    """Hex digest of ``body`` under the prepared key blocks."""
    first = F.unhex(F.sha2(F.concat(inner, F.encode(body, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)
