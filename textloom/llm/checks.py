"""SQL pieces that the checking queries of this subpackage share."""

from __future__ import annotations

#: CRC-32 of the eight single-bit bytes, from which the others follow by exclusive or.
CRC_BITS = (0x77073096, 0xEE0E612C, 0x076DC419, 0x0EDB8832, 0x1DB71064, 0x3B6E20C8, 0x76DC4190, 0xEDB88320)


def crc32_sql(text: str) -> str:
    """DuckDB expression: unsigned CRC-32 of the UTF-8 bytes of the expression ``text``, which isn't null."""
    low = "(xor(c, b) & 255)"
    entry = f"(({low} & 1) * {CRC_BITS[0]})"
    for bit, value in enumerate(CRC_BITS[1:], 1):
        entry = f"xor({entry}, ({low} >> {bit} & 1) * {value})"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda z: ('0x' || z)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, {entry})), 4294967295)"
