"""Column functions on bytes, trits, hashes and randomness that depends on nothing but its key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_values(payload: Column) -> Column:
    """The bytes of a binary column as an array of ints."""
    return F.transform(F.regexp_extract_all(F.hex(payload), F.lit(".."), 0), lambda h: F.conv(h, 16, 10).cast("int"))


def trits(payload: Column) -> Column:
    """Six base-3 digits for each byte, as a string."""
    return F.array_join(F.transform(F.regexp_extract_all(F.hex(payload), F.lit(".."), 0), lambda h: F.lpad(F.conv(h, 16, 3), 6, "0")), "")


def with_length(payload: Column) -> Column:
    """The payload behind its length as four bytes, high byte first."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(payload).cast("long")), 8, "0")), payload)


def djb2(payload: Column) -> Column:
    """The 32-bit hash 5381 * 33 + byte, wrapping."""
    return F.aggregate(byte_values(payload), F.lit(5381).cast("long"), lambda h, b: (h * 33 + b).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def content_hash(payload: Column) -> Column:
    """The first eight bytes of SHA-256, as 16 hex digits."""
    return F.substring(F.sha2(payload, 256), 1, 16)


def archive_id(name: Column, hash16: Column, codec: Column, profile: Column, created_at: Column) -> Column:
    """``archive-`` and 16 hex digits over name, content hash, codec, profile and the time as eight bytes."""
    body = F.concat(name.cast("binary"), F.unhex(hash16), codec.cast("binary"), profile.cast("binary"), F.unhex(F.lpad(F.hex(created_at.cast("long")), 16, "0")))
    return F.concat(F.lit("archive-"), F.substring(F.sha2(body, 256), 1, 16))


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone: md5's first 32 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in key))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalised(v: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    scaled = lambda w, n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w)
    # one-element arrays hold the vector and its norm, so that neither is computed again
    return F.transform(F.array(v), lambda w: F.transform(F.array(norm(w)), lambda n: scaled(w, n))[0])[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))
