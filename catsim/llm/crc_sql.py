"""CRC-32 for the DuckDB SQL of this subpackage, which has no such function."""

from __future__ import annotations

#: A CTE of one row: the table of the byte-wise CRC-32, made from the reversed polynomial 0xEDB88320.
TABLE = """crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table
)"""


def crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text's UTF-8 bytes; ``crc`` has to be among the tables."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({text}), '..'), lambda b: ('0x' || b)::BIGINT)),
        lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"""
