"""Digests, keyed digests and authenticated encryption with built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column) -> Column:
    """First 24 hex digits: keeps tenant names out of counter keys."""
    return F.substring(sha256(text), 1, 24)


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """Keyed digest as lower-case hex; the two pads are literals made from the secret."""
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    first = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def checked_key(key_hex: str) -> bytes:
    """A 256-bit key from 64 hex digits."""
    key = bytes.fromhex(key_hex)
    if len(key) != 32:
        raise ValueError("the key must have 64 hex digits")
    return key


def seal(plain: Column, key_hex: str, bound_to: Column, nonce: Column | None = None) -> Column:
    """AES-256-GCM, nonce first, authenticated together with ``bound_to``.

    Without ``nonce`` a fresh random one is drawn per row.
    """
    key = F.lit(bytearray(checked_key(key_hex)))
    iv = F.lit(bytearray()) if nonce is None else nonce
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), iv, bound_to)


def open_sealed(blob: Column, key_hex: str, bound_to: Column) -> Column:
    """Plain text, or NULL if the blob was moved to another name or altered."""
    key = F.lit(bytearray(checked_key(key_hex)))
    plain = F.try_aes_decrypt(blob, key, F.lit("GCM"), F.lit("DEFAULT"), bound_to)
    return let(plain, lambda b: F.decode(b, "UTF-8"))
