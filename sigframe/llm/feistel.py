"""Keyed permutations of a finite range, as alternating Feistel rounds over two factors."""

from __future__ import annotations

from hashlib import blake2b

ROUNDS = 10


def _round(key: bytes, tweak: bytes, k: int, value: int) -> int:
    h = blake2b(b"%d|%d|" % (k, value) + tweak, digest_size=24, key=key)
    return int.from_bytes(h.digest(), "big")


def permute(value: int, a: int, b: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A permutation of range(a * b): value = left * b + right, each side shifted by the other."""
    left, right = divmod(value, b)
    for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        sign = -1 if back else 1
        if k % 2 == 0:
            left = (left + sign * _round(key, tweak, k, right)) % a
        else:
            right = (right + sign * _round(key, tweak, k, left)) % b
    return left * b + right


def permute_range(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A permutation of range(size) for any size: walks the cycle until it is inside again."""
    if size < 2:
        return value
    side = int(size**0.5)
    while side * side < size:
        side += 1
    while True:
        value = permute(value, side, side, key, tweak, back)
        if value < size:
            return value


def permute_digits(digits: list[int], radices: list[int], key: bytes, tweak: bytes, back: bool = False) -> list[int]:
    """A permutation of all digit lists of the given radices."""
    half = len(digits) // 2
    b = 1
    for r in radices[half:]:
        b *= r
    a = 1
    for r in radices[:half]:
        a *= r
    value = 0
    for d, r in zip(digits, radices, strict=True):
        value = value * r + d
    if a < 2 or b < 2:
        value = permute_range(value, a * b, key, tweak, back)
    else:
        value = permute(value, a, b, key, tweak, back)
    out = []
    for r in reversed(radices):
        value, d = divmod(value, r)
        out.append(d)
    return out[::-1]
