"""Stateless random numbers from hashes of keys: the same row gets the same draw in any plan, partition or retry."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, functions as F

#: Messages that are hashed at a time: their words stay in the cache.
MESSAGES = 16_384
# Fixed values of MD5: what a step adds, by how much it turns, which word it reads, its start.
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16, 32)), *((3 * i + 5) % 16 for i in range(32, 48)), *(7 * i % 16 for i in range(48, 64))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _key(part) -> Column:
    return part.cast("string") if isinstance(part, Column) else F.lit(str(part))


def draw(tag: str, seed: int, *keys: Column) -> Column:
    """An integer in [0, 2^60)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(tag), F.lit(str(seed)), *map(_key, keys))), 1, 15), 16, 10).cast("long")


def uniform(tag: str, seed: int, *keys: Column) -> Column:
    """A double in [0, 1)."""
    return draw(tag, seed, *keys) / F.lit(float(1 << 60))


def uniforms(tag: str, seed: int, keys: list[bytes], dims: int) -> np.ndarray:
    """The doubles of uniform(tag, seed, key, k) for all keys and k < dims, inside a task: keys of equal length are hashed together."""
    head, tails = f"{tag}|{seed}|".encode(), [b"|%d" % k for k in range(dims)]
    longest = max(map(len, tails), default=0)
    draws = np.empty((len(keys), dims), np.uint64)
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    for length in np.unique(lengths):
        same = np.flatnonzero(lengths == length)
        if len(head) + length + longest > 55:  # more than one block
            for i in same:
                draws[i] = [int.from_bytes(hashlib.md5(head + keys[i] + t, usedforsecurity=False).digest()[:8], "big") for t in tails]
            continue
        step, ends = max(1, MESSAGES // max(1, dims)), _ends(len(head) + int(length), tails)
        for lo in range(0, len(same), step):
            part = same[lo : lo + step]
            draws[part] = _first_64_bits(head, b"".join([keys[i] for i in part]), len(part), int(length), ends).reshape(len(part), dims)
    return (draws >> np.uint64(4)).astype(np.float64) / float(1 << 60)


def _ends(at: int, tails: list[bytes]) -> np.ndarray:
    """The last part of each message, a block of 64 bytes: the tail, MD5's padding and the message's length in bits."""
    blocks = np.zeros((len(tails), 64), np.uint8)
    for k, tail in enumerate(tails):
        blocks[k, at : at + len(tail) + 1] = np.frombuffer(tail + b"\x80", np.uint8)
        blocks[k, 56:58] = np.frombuffer((8 * (at + len(tail))).to_bytes(2, "little"), np.uint8)
    return blocks.view("<u4")


def _first_64_bits(head: bytes, joined: bytes, n: int, length: int, ends: np.ndarray) -> np.ndarray:
    """The first 64 bits of MD5 of head + key + tail, for n joined keys of one length with each tail (see _ends)."""
    starts = np.zeros((n, 64), np.uint8)
    starts[:, : len(head)] = np.frombuffer(head, np.uint8)
    starts[:, len(head) : len(head) + length] = np.frombuffer(joined, np.uint8).reshape(n, length)
    words = []
    for s, e in zip(starts.view("<u4").T, ends.T, strict=True):  # a word is the same in all messages, or it is that of the key, or it has some of the tail
        words.append(int(s[0]) + int(e[0]) if (s == s[0]).all() and (e == e[0]).all() else np.add.outer(s, e).reshape(-1))
    a, b, c, d = (np.full(n * len(ends), x, np.uint32) for x in _START)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(d, np.bitwise_and(b, np.bitwise_xor(c, d, out=f), out=f), out=f)
        elif i < 32:
            np.bitwise_xor(c, np.bitwise_and(d, np.bitwise_xor(b, c, out=f), out=f), out=f)
        elif i < 48:
            np.bitwise_xor(d, np.bitwise_xor(b, c, out=f), out=f)
        else:
            np.bitwise_xor(c, np.bitwise_or(b, np.invert(d, out=f), out=f), out=f)
        word = words[_WORDS[i]]
        f += a
        if isinstance(word, int):
            f += np.uint32((_ADDED[i] + word) % 2**32)
        else:
            f += word
            f += np.uint32(_ADDED[i])
        np.left_shift(f, np.uint32(_TURNS[i]), out=turned)
        f >>= np.uint32(32 - _TURNS[i])
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap().astype(np.uint64)
