"""Encodings of other programs' files: binary values, order-preserving integers, hashes, a generator, and query strings."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from typing import Any
from urllib.parse import parse_qsl, unquote_plus

_WORD = (1 << 64) - 1
# The offset and prime of the 64-bit FNV-1a hash.
_FNV = (0xCBF29CE484222325, 0x100000001B3)


def pack(value: Any) -> bytes:
    """A JSON value as MessagePack, in the shortest form."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        return _integer(value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return _sized(len(raw), (0xA0, 32), (0xD9, 0xDA, 0xDB)) + raw
    if isinstance(value, dict):
        return _sized(len(value), (0x80, 16), (None, 0xDE, 0xDF)) + b"".join(pack(k) + pack(v) for k, v in value.items())
    if isinstance(value, (list, tuple)):
        return _sized(len(value), (0x90, 16), (None, 0xDC, 0xDD)) + b"".join(map(pack, value))
    raise TypeError(type(value).__name__)


def _integer(n: int) -> bytes:
    if -32 <= n < 128:
        return struct.pack(">b", n)
    unsigned, signed = ((0xCC, ">B"), (0xCD, ">H"), (0xCE, ">I"), (0xCF, ">Q")), ((0xD0, ">b"), (0xD1, ">h"), (0xD2, ">i"), (0xD3, ">q"))
    for tag, form in unsigned if n >= 0 else signed:
        try:
            return bytes([tag]) + struct.pack(form, n)
        except struct.error:
            continue
    raise OverflowError(n)


def _sized(n: int, short: tuple[int, int], tags: Sequence[int | None]) -> bytes:
    if n < short[1]:
        return bytes([short[0] | n])
    for tag, form in zip(tags, (">B", ">H", ">I"), strict=True):
        if tag is not None and n < 1 << (8 * struct.calcsize(form)):
            return bytes([tag]) + struct.pack(form, n)
    raise OverflowError(n)


def unpack(raw: bytes) -> Any:
    """The value of exactly one MessagePack item; what is cut short, left over or no JSON value is a ``ValueError``."""
    try:
        value, end = _item(raw, 0)
    except (IndexError, struct.error, UnicodeDecodeError) as e:
        raise ValueError("malformed value") from e
    if end != len(raw):
        raise ValueError("bytes behind the value")
    return value


_FIXED = {0xC0: None, 0xC2: False, 0xC3: True}
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_TEXTS, _LISTS, _MAPS = {0xD9: ">B", 0xDA: ">H", 0xDB: ">I"}, {0xDC: ">H", 0xDD: ">I"}, {0xDE: ">H", 0xDF: ">I"}


def _item(raw: bytes, at: int) -> tuple[Any, int]:
    tag, at = raw[at], at + 1
    if tag < 0x80 or tag >= 0xE0:
        return (tag if tag < 0x80 else tag - 256), at
    if tag in _FIXED:
        return _FIXED[tag], at
    if tag in _NUMBERS:
        form = _NUMBERS[tag]
        return struct.unpack_from(form, raw, at)[0], at + struct.calcsize(form)
    for tags, low, high, read in ((_TEXTS, 0xA0, 0xBF, _text), (_LISTS, 0x90, 0x9F, _list), (_MAPS, 0x80, 0x8F, _map)):
        if low <= tag <= high:
            return read(raw, at, tag - low)
        if tag in tags:
            n = struct.unpack_from(tags[tag], raw, at)[0]
            return read(raw, at + struct.calcsize(tags[tag]), n)
    raise ValueError(f"no JSON value: {tag:#x}")


def _text(raw: bytes, at: int, n: int) -> tuple[str, int]:
    if at + n > len(raw):
        raise IndexError(at)
    return raw[at : at + n].decode(), at + n


def _list(raw: bytes, at: int, n: int) -> tuple[list, int]:
    out = []
    for _ in range(n):
        value, at = _item(raw, at)
        out.append(value)
    return out, at


def _map(raw: bytes, at: int, n: int) -> tuple[dict, int]:
    both, at = _list(raw, at, 2 * n)
    return dict(zip(both[::2], both[1::2], strict=True)), at


def varint(n: int) -> bytes:
    """An unsigned 64-bit integer so that the bytes sort as the integers do: their number, then the integer without leading zeros."""
    if not 0 <= n <= _WORD:
        raise OverflowError(n)
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([len(raw)]) + raw


def varints(raw: bytes) -> Iterator[int]:
    """The integers of joined ``varint`` bytes."""
    at = 0
    while at < len(raw):
        n = raw[at]
        if n > 8 or at + 1 + n > len(raw):
            raise ValueError("malformed integer")
        yield int.from_bytes(raw[at + 1 : at + 1 + n], "big")
        at += 1 + n


def fnv64(raw: bytes) -> int:
    """The 64-bit FNV-1a hash."""
    h, prime = _FNV
    for b in raw:
        h = (h ^ b) * prime & _WORD
    return h


class SplitMix:
    """The splitmix64 generator: the same numbers for a seed in every program that has it."""

    def __init__(self, seed: int):
        self.state = seed & _WORD

    def next(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & _WORD
        x = self.state
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _WORD
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _WORD
        return x ^ (x >> 31)

    def below(self, n: int) -> int:
        """A number under ``n``, by the high half of a product."""
        return self.next() * n >> 64

    def unit(self) -> float:
        """A number in [0, 1) of 53 bits."""
        return (self.next() >> 11) / (1 << 53)


def unescape(text: str) -> str:
    """Text of a URL's query: plus signs are blanks, escapes are UTF-8, broken ones stay as they are."""
    return unquote_plus(text)


def parse_query(text: str) -> list[tuple[str, str]]:
    """Names and values of a URL's query, in order; a name without a value has an empty one."""
    return parse_qsl(text, keep_blank_values=True)
