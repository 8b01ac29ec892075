"""The keyed draws of :func:`contestry.functions.probability.keyed_uniform`, for many rows and
replicates at once."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: A keyed number is this many bits of a digest, its first thirteen hex digits.
HEAD_BITS = 52
#: Draws hashed in one go, so that their state stays in a core's cache.
DRAWS_A_GO = 16_384
#: A message of so many bytes fills one block of the hash.
ONE_BLOCK = 55


def head_drawer():
    """A function of (prefixes, texts): a matrix of the heads of md5(prefix + text).

    A head over ``2**HEAD_BITS`` is the keyed number. All prefixes have one length, and ``texts``
    is a matrix of bytes. The functions are nested so that a worker needs no package.
    """
    sines = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
    turns = [np.uint32(s) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
    backs = [np.uint32(32) - s for s in turns]
    order = [(m * i + n) % 16 for m, n in ((1, 0), (5, 1), (3, 5), (7, 0)) for i in range(16)]
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]

    def hashed(words: list, shape: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The first two words of the digests of one-block messages; None is a word of zeros."""
        a, b, c, d = (np.full(shape, x) for x in start)
        f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
        for i in range(64):
            if i < 16:
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            word = words[order[i]]
            f += sines[i] if word is None else word + sines[i]
            np.right_shift(f, backs[i], out=t)
            f <<= turns[i]
            f |= t
            f += b
            a, d, c, b, f = d, c, b, f, a
        return a + start[0], b + start[1]

    def heads(prefixes: list[bytes], texts: np.ndarray) -> np.ndarray:
        n, many, own, length = len(texts), len(prefixes), len(prefixes[0]), texts.shape[1]
        end = own + length
        if end > ONE_BLOCK:
            each = [[hashlib.md5(p + t.tobytes()).hexdigest()[:13] for p in prefixes] for t in texts]
            return np.array([[int(h, 16) for h in row] for row in each], np.int64).reshape(n, many)
        rows, firsts = np.zeros((n, 64), np.uint8), np.zeros((many, 64), np.uint8)
        rows[:, own:end], rows[:, end] = texts, 0x80
        rows[:, 56], rows[:, 57] = (8 * end) % 256, (8 * end) // 256
        firsts[:, :own] = np.frombuffer(b"".join(prefixes), np.uint8).reshape(many, own)
        rows, firsts = rows.view("<u4"), firsts.view("<u4")
        out, step = np.empty((n, many), np.int64), max(1, DRAWS_A_GO // many)
        for at in range(0, n, step):
            part, words = rows[at : at + step], [None] * 16
            for w in (*range(end // 4 + 1), 14):
                words[w] = part[:, w, None] | firsts[None, :, w] if 4 * w < own else part[:, w, None]
            a, b = hashed(words, (len(part), many))
            out[at : at + step] = (a.byteswap().astype(np.int64) << 20) | (b.byteswap() >> np.uint32(12))
        return out

    return heads
