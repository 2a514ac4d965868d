"""Bilevel fax rows: one-dimensional, mixed and two-dimensional codes of ITU-T T.4 and T.6.

A row is a list of the columns where its colour changes, white first. Rows go
in and out as arrays of 0 (white) and 1 (black).
"""

from __future__ import annotations

import numpy as np

from tessera.codec import Malformed, Refused, Unsupported

# Fixed values of ITU-T T.4: codes of runs of 0 to 63 signs, of 64 to 1728 in steps of 64, and of both colours from 1792 on.
WHITE_SHORT = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 "
    "0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 "
    "00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 "
    "01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100"
).split()
WHITE_LONG = (
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 "
    "011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
).split()
BLACK_SHORT = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 "
    "0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 "
    "000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 "
    "000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 "
    "000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 "
    "000001011001 000000101011 000000101100 000001011010 000001100110 000001100111"
).split()
BLACK_LONG = (
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 "
    "0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 "
    "0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
).split()
BOTH_LONG = (
    "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 "
    "000000011101 000000011110 000000011111"
).split()
#: Fixed values of ITU-T T.6: moves of the vertical mode, then pass, horizontal and extension.
MODES = {"1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3, "0001": "pass", "001": "horizontal", "0000001": "extension"}

WINDOW = 13
MOST_PIXELS = 1 << 28


def _runs(short, long) -> dict[str, int]:
    return dict(zip(short, range(64))) | dict(zip(long, range(64, 1729, 64))) | dict(zip(BOTH_LONG, range(1792, 2561, 64)))


def _lookup(codes: dict) -> list:
    """(value, length) for every value of the next WINDOW bits."""
    table: list = [None] * (1 << WINDOW)
    for code, value in codes.items():
        low, span = int(code, 2) << (WINDOW - len(code)), 1 << (WINDOW - len(code))
        table[low : low + span] = [(value, len(code))] * span
    return table


RUN_CODES = (_runs(WHITE_SHORT, WHITE_LONG), _runs(BLACK_SHORT, BLACK_LONG))
_RUN_TABLES, _MODE_TABLE = tuple(map(_lookup, RUN_CODES)), _lookup(MODES)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.size = data + b"\0\0\0\0", 0, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 4], "big") << (self.at & 7) & 0xFFFFFFFF) >> (32 - n)

    def symbol(self, table: list):
        got = table[self.peek(WINDOW)] if self.at < self.size else None
        if got is None or self.at + got[1] > self.size:
            return None
        self.at += got[1]
        return got[0]

    def run(self, colour: int) -> int | None:
        total = 0
        while True:
            n = self.symbol(_RUN_TABLES[colour])
            if n is None:
                return None
            total += n
            if n < 64:
                return total

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8

    def end_of_line(self) -> bool:
        """Skips fill bits and an end-of-line code, if one comes next."""
        at = self.at
        while at < self.size and not self.data[at >> 3] >> (7 - (at & 7)) & 1:
            at += 1
        if at >= self.size or at - self.at < 11:
            return False
        self.at = at + 1
        return True


def _row_1d(bits: _Bits, columns: int) -> list[int] | None:
    out, at, colour = [], 0, 0
    while at < columns:
        n = bits.run(colour)
        if n is None or at + n > columns:
            return None
        at += n
        out.append(at)
        colour ^= 1
    return out


def _row_2d(bits: _Bits, before: list[int], columns: int) -> list[int] | None:
    """Changes of a row coded against the changes of the one before (with two sentinels at the end)."""
    out, at, colour, near = [], -1, 0, 0
    while at < columns:
        while near < len(before) - 2 and before[near] <= at:
            near += 1
        place = near + ((near ^ colour) & 1)
        first = before[min(place, len(before) - 1)]
        mode = bits.symbol(_MODE_TABLE)
        if mode is None:
            return None
        if mode == "pass":
            at = before[min(place + 1, len(before) - 1)]
        elif mode == "horizontal":
            one, two = bits.run(colour), None
            if one is not None:
                two = bits.run(colour ^ 1)
            if two is None:
                return None
            middle = min(columns, max(at, 0) + one)
            at = min(columns, middle + two)
            out += [middle, at]
        elif mode == "extension":
            raise Unsupported("fax: uncompressed mode")
        else:
            if not max(at, 0) <= first + mode <= columns:
                raise Malformed("fax: a vertical code leaves its row")
            at = first + mode
            out.append(at)
            colour ^= 1
    return out


def _line(changes: list[int], columns: int) -> np.ndarray:
    return (np.cumsum(np.bincount(changes, minlength=columns + 1)[:columns]) & 1).astype(np.uint8)


def _changes(line: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(line, prepend=np.uint8(0))).tolist()


def decode(data: bytes, k: int, columns: int, rows: int = 0, byte_align: bool = False) -> np.ndarray:
    """Rows of 0 and 1. k below 0: two-dimensional; 0: one-dimensional; above: a tag bit after each end of line tells.

    rows of 0 reads to the end. Two-dimensional data ends at a row that doesn't
    decode; otherwise such a row, and too few rows, are damage.
    """
    if not 1 <= columns <= 1 << 24 or rows < 0:
        raise Malformed("fax: geometry")
    if rows * columns > MOST_PIXELS:
        raise Refused("fax: too many pixels")
    bits, out, before = _Bits(data), [], [columns, columns]
    while (not rows or len(out) < rows) and bits.at < bits.size:
        if byte_align:
            bits.align()
        if k < 0:
            if bits.peek(24) == 0x001001:
                break
            got = _row_2d(bits, before, columns)
            if got is None:
                break
        else:
            ends = 0
            while bits.peek(11) == 0 and bits.end_of_line():
                ends += 1
                plain = k == 0 or bits.peek(1) == 1
                bits.at += k > 0
            if ends >= 2 and out or bits.at >= bits.size or (not rows and bits.size - bits.at < 8 and bits.peek(8) == 0):
                break
            if not ends:
                plain = k == 0 or not out
            got = _row_1d(bits, columns) if plain else _row_2d(bits, before, columns)
            if got is None:
                raise Malformed(f"fax: row {len(out)}")
        out.append(_line(got, columns))
        before = [*_changes(out[-1]), columns, columns]
        if len(out) * columns > MOST_PIXELS:
            raise Refused("fax: too many pixels")
    if k >= 0 and rows and len(out) < rows:
        raise Malformed(f"fax: {len(out)} of {rows} rows")
    return np.stack(out) if out else np.zeros((0, columns), np.uint8)


def _run_bits(n: int, colour: int) -> str:
    out = ""
    names = {v: c for c, v in RUN_CODES[colour].items()}
    while n > 2623:
        out, n = out + names[2560], n - 2560
    return out + (names[n // 64 * 64] if n > 63 else "") + names[n % 64]


def _packed(bits: str) -> bytes:
    return np.packbits(np.frombuffer(bits.encode(), np.uint8) & 1).tobytes()


def encode(image: np.ndarray, k: int = -1) -> bytes:
    """Rows of 0 and 1 as two-dimensional codes (k below 0) or one-dimensional ones that each begin at a byte (0)."""
    columns, out, parts = image.shape[1], [], []
    names = {v: c for c, v in MODES.items()}
    before = [columns, columns]
    for line in image:
        now = [*_changes(line), columns, columns]
        if k >= 0:
            edges, row = [0, *now[:-1]], ""
            for i, (a, b) in enumerate(zip(edges, edges[1:])):
                row += _run_bits(b - a, i & 1)
            parts.append(_packed(row + "0" * (-len(row) % 8)))
            continue
        at, colour = -1, 0
        while at < columns:
            one = next(c for i, c in enumerate(now) if c >= columns or (c > at and i & 1 == colour))
            near = next(i for i, c in enumerate(before) if c >= columns or (c > at and i & 1 == colour))
            first, second = before[near], before[min(near + 1, len(before) - 1)]
            if second < one:
                out.append(names["pass"])
                at = second
            elif abs(one - first) <= 3:
                out.append(names[one - first])
                at, colour = one, colour ^ 1
            else:
                two = next((c for c in now if c > one), columns)
                out.append(names["horizontal"] + _run_bits(one - max(at, 0), colour) + _run_bits(two - one, colour ^ 1))
                at = two
        before = now
    return b"".join(parts) if k >= 0 else _packed("".join(out) + "000000000001" * 2)
