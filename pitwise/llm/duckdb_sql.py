"""Expressions for the DuckDB SQL of this subpackage's queries."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes, which DuckDB has no function for."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    zeros = ", ".join(["CAST(0 AS BIGINT)"] * 8)
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END"
    octet = f"list_reduce(list_prepend(xor(c, b), [{zeros}]), lambda x, z: {step})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: {octet}), CAST(4294967295 AS BIGINT))"


def ascii_lower_sql(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
