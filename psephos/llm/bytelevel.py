"""The printable characters that stand for bytes in byte-level vocabularies."""

from __future__ import annotations


def byte_symbols() -> list[str]:
    """The character for each byte, by the public byte-level rule: printable bytes stand for themselves, the others take the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
