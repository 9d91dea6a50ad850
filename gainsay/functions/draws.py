"""Counter-based random draws written as SQL expressions.

Draw number ``i`` of a seed is a pure function of ``(seed, i)``: a retried or speculative task
redraws the same pairs, and any other SQL engine can replay the sample.  The mixer multiplies
32-bit words by multipliers below 2**31, so no product leaves the signed 64-bit range and ANSI
overflow checks never fire.
"""

from __future__ import annotations

MASK32 = 0xFFFFFFFF
MULTIPLIERS = (0x7FEB352D, 0x31848BAB, 0x5BD1E995)
SHIFTS = (16, 15, 14)
HIGH_WORD = 0x3C6EF372
STREAMS = ("x_hi", "x_lo", "y_hi", "y_lo")


def mix_int(h: int) -> int:
    """The mixer on a plain integer; used to derive the stream keys from the seed."""
    for mult, shift in zip(MULTIPLIERS, SHIFTS):
        h = ((h ^ (h >> shift)) * mult) & MASK32
    return h ^ (h >> 16)


def stream_keys(seed: int) -> dict[str, int]:
    """One 32-bit key per random stream."""
    return {s: mix_int((seed * 0x9E3779B1 + 977 * (k + 1)) & MASK32) for k, s in enumerate(STREAMS)}


def _mix(h: str) -> str:
    for mult, shift in zip(MULTIPLIERS, SHIFTS):
        h = f"((({h} ^ shiftright({h}, {shift})) * {mult}L) & {MASK32}L)"
    return f"({h} ^ shiftright({h}, 16))"


def word_sql(i: str, key: int) -> str:
    """32 random bits of counter ``i``."""
    return _mix(f"(({i} ^ (shiftright({i}, 32) * {HIGH_WORD}L) ^ {key}L) & {MASK32}L)")


def below_sql(high: str, low: str, bound: int) -> str:
    """Uniform integer in ``[0, bound)`` from two 32-bit words (62 bits are used).

    The remainder counts as nullable; ``coalesce`` says it never is, which keeps joins on the draw
    from computing it a second time in a null filter.
    """
    return f"coalesce((shiftright({high}, 1) * {1 << 31}L + shiftright({low}, 1)) % {bound}L, 0L)"
