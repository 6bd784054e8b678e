"""The chunk rule reaches the end of a text."""

import random

import zstandard

from stylemill.llm import quality_rules


def prose(size):
    rng = random.Random(5)
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(size)).encode()[:size]


def test_bytes_after_the_last_full_chunk_are_judged():
    z = zstandard.ZstdCompressor(level=quality_rules.LEVEL)
    whole, tail = prose(4096), b" " + b"a" * 3000
    low, high = quality_rules.limits(len(whole + tail))
    ratio, chunks, outside, kept = quality_rules.bands(whole + tail, z)
    assert low <= ratio <= high  # the whole looks well
    assert (chunks, outside, kept) == (2, 1, False)
    # a few bytes can't be held against the rest
    assert quality_rules.bands(whole + b" end", z)[1:] == (2, 1, True)
    assert quality_rules.bands(whole, z)[1:] == quality_rules.bands(whole[:4000], z)[1:] == (1, 0, True)
