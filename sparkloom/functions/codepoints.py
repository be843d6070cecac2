"""UTF-8, escaping and code-point helpers for bytes, on the Python side of UDFs and on the driver."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable

REPLACEMENT = 0xFFFD


def char_length(lead: int) -> int:
    """Length that a lead byte announces; a continuation byte counts as 1."""
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def is_trail(b: int) -> bool:
    return b & 0xC0 == 0x80


def is_valid_codepoint(c: int) -> bool:
    return 0 <= c < 0xD800 or 0xE000 <= c <= 0x10FFFF


def decode_one(b: bytes, at: int = 0) -> tuple[int, int]:
    """(code point, bytes used); U+FFFD and 1 byte for anything that is not strict UTF-8."""
    n = char_length(b[at])
    try:
        return ord(b[at : at + n].decode()), n
    except (UnicodeDecodeError, TypeError):
        return REPLACEMENT, 1


def decode(b: bytes) -> list[int]:
    out, at = [], 0
    while at < len(b):
        c, n = decode_one(b, at)
        out.append(c)
        at += n
    return out


def encode(codepoints: Iterable[int]) -> bytes:
    return "".join(map(chr, codepoints)).encode()


def is_valid(b: bytes) -> bool:
    try:
        b.decode()
    except UnicodeDecodeError:
        return False
    return True


def replace_invalid(b: bytes) -> str:
    """Each byte outside of a valid sequence becomes one U+FFFD (Spark's make_valid_utf8 replaces per sequence)."""
    return "".join(map(chr, decode(b)))


def byte_to_piece(byte: int) -> str:
    return f"<0x{byte:02X}>"


_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def piece_to_byte(piece: str | bytes) -> int:
    m = _BYTE_PIECE.match(piece if isinstance(piece, str) else piece.decode("latin-1"))
    return int(m[1], 16) if m else -1


def escape(b: bytes) -> str:
    r"""Tab, LF, CR, backslash and bytes that are not UTF-8 become \xHH."""
    out, at = [], 0
    while at < len(b):
        c, n = decode_one(b, at)
        part = b[at : at + n]
        bad = c == REPLACEMENT and part != "�".encode()
        out.append(f"\\x{part[0]:02X}" if bad or part in (b"\t", b"\n", b"\r", b"\\") else chr(c))
        at += n
    return "".join(out)


def unescape(s: str) -> bytes:
    parts = re.split(r"\\x([0-9A-Fa-f]{2})", s)
    return b"".join(bytes([int(p, 16)]) if i % 2 else p.encode("utf-8", "surrogatepass") for i, p in enumerate(parts))


def encode_pod(kind: str, value: float) -> bytes:
    """Raw little-endian bytes of a scalar; kind as in struct."""
    return struct.pack(f"<{kind}", value)


def decode_pod(kind: str, b: bytes) -> float | int | None:
    """The scalar of raw bytes, None when the size is not its size."""
    return struct.unpack(f"<{kind}", b)[0] if len(b) == struct.calcsize(f"<{kind}") else None
