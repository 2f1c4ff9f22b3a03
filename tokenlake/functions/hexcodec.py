"""Hex text helpers for 0x-prefixed byte strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_body(c: Column) -> Column:
    """Hex digits without the optional ``0x`` prefix."""
    return F.when(c.startswith("0x") | c.startswith("0X"), F.substring(c, 3, 1 << 30)).otherwise(c)


def hex_length(c: Column) -> Column:
    """Number of hex digits without the optional ``0x`` prefix; nothing is copied to count them."""
    return F.length(c) - F.when(c.startswith("0x") | c.startswith("0X"), 2).otherwise(0)


def topic_address(topic: Column) -> Column:
    """Address in a 32-byte topic: its last 20 bytes, ``0x`` + 40 lower-case hex.

    The last 40 digits are the same with or without the ``0x`` prefix.
    """
    return F.concat(F.lit("0x"), F.lower(F.substring(topic, -40, 40)))
