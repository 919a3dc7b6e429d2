"""Seeded hashes. Every random decision is a function of seed, salt and key, so it doesn't depend on partitioning, order or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOP = 18446744073709551615.0


def _bits(seed: int | str, salt: str, *keys: Column | str | int) -> Column:
    parts = [F.lit(str(seed)), F.lit(salt), *(k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") if isinstance(k, str) else F.lit(str(k)) for k in keys)]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16), 16, 10)


def hash_unit(seed: int | str, salt: str, *keys: Column | str | int) -> Column:
    """A double from 0 to 1: the first 64 bits of SHA-256 of "seed|salt|keys" over the largest such number. Null keys are left out."""
    return _bits(seed, salt, *keys).cast("double") / F.lit(_TOP)  # the nearest double of the digits, as a decimal on the way would give


def hash_int(seed: int | str, salt: str, modulus: int | Column, *keys: Column | str | int) -> Column:
    """A long from 0 to modulus - 1 of the same 64 bits."""
    m = F.lit(modulus).cast("decimal(20,0)") if isinstance(modulus, int) else modulus.cast("decimal(20,0)")
    return (_bits(seed, salt, *keys).cast("decimal(20,0)") % m).cast("long")


def digest_text(seed: int | str, salt: str, key: str) -> str:
    """The digest's 64 digits, whose order is that of hash_unit, as SQL."""
    return f"sha2(concat_ws('|', '{seed}', '{salt}', {key}), 256)"


def _bits_text(seed: int | str, salt: str, key: str) -> str:
    return f"conv(substring({digest_text(seed, salt, key)}, 1, 16), 16, 10)"


def unit_text(seed: int | str, salt: str, key: str) -> str:
    """hash_unit of a text expression, as SQL."""
    return f"(CAST({_bits_text(seed, salt, key)} AS DOUBLE) / {_TOP!r}D)"


def int_text(seed: int | str, salt: str, modulus: int, key: str) -> str:
    """hash_int of a text expression, as SQL of an int."""
    return f"CAST(CAST({_bits_text(seed, salt, key)} AS DECIMAL(20, 0)) % {modulus} AS INT)"
