"""Pieces of DuckDB SQL that several queries of this subpackage share."""

from __future__ import annotations

#: CRC-32 of the sixteen half bytes (polynomial EDB88320, reflected).
CRC_HALF_BYTES = [
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
]


def crc32_sql(text: str) -> str:
    """SQL for the unsigned CRC-32 of the UTF-8 bytes of a text expression, as BIGINT: half a byte at a time."""
    half = lambda c: f"xor(({c}) >> 4, {CRC_HALF_BYTES}[(({c}) & 15) + 1])"
    digit = lambda b, i: f"(strpos('0123456789ABCDEF', {b}[{i}]) - 1)"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: CAST({digit('b', 1)} * 16 + {digit('b', 2)} AS BIGINT))"
    return f"xor(list_reduce({octets}, lambda c, b: {half(half('xor(c, b)'))}, CAST(4294967295 AS BIGINT)), 4294967295)"


#: Upper and lower case of the letters A to Z, for translate().
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
