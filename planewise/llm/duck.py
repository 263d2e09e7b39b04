"""SQL that oracles share: DuckDB has no CRC32."""

from __future__ import annotations


def crc32(text: str) -> str:
    """DuckDB SQL of the unsigned CRC32 of a string's UTF-8: bytes are folded through the polynomial's table."""
    table = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        table.append(b)
    digits = f"hex(encode({text}))"
    own = f"list_transform(range(0, length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    fold = f"list_reduce({own}, lambda c, x: xor(c >> 8, ([{', '.join(map(str, table))}])[CAST((xor(c, x) & 255) + 1 AS BIGINT)]), 4294967295::BIGINT)"
    return f"CAST(xor({fold}, 4294967295::BIGINT) AS BIGINT)"
