"""The seeded numbers of ``text.point`` for many consecutive integers at once, with numpy."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np

_SINE = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _first_word(words: np.ndarray) -> np.ndarray:
    """First word of the MD5 of messages of one block; ``words`` has a row for each of the block's sixteen words."""
    a, b, c, d = (np.full(words.shape[1], x) for x in _START)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif turn == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif turn == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + _SINE[i] + words[g]
        s = _TURNS[turn][i % 4]
        a, d, c, b = d, c, b, b + ((f << np.uint32(s)) | (f >> np.uint32(32 - s)))
    return a + _START[0]


def points(prefix: str, n: int, chunk: int = 8192) -> Iterator[np.ndarray]:
    """``point(prefix, 0)`` to ``point(prefix, n - 1)`` in chunks."""
    head = f"{prefix}|".encode()
    for begin in range(0, n, chunk):
        end = min(n, begin + chunk)
        if len(head) + len(str(end)) > 55:
            yield np.array([int.from_bytes(hashlib.md5(head + str(i).encode()).digest()[:4], "big") for i in range(begin, end)], dtype=np.int64)
            continue
        while begin < end:  # numbers of one length at a time
            digits = len(str(begin))
            to = min(end, 10**digits)
            block = np.zeros((to - begin, 64), dtype=np.uint8)
            size = len(head) + digits
            block[:, : len(head)] = np.frombuffer(head, dtype=np.uint8)
            number = np.arange(begin, to, dtype=np.int64)
            for k in range(size - 1, len(head) - 1, -1):
                block[:, k] = 48 + number % 10
                number //= 10
            block[:, size] = 128
            block[:, 56], block[:, 57] = size * 8 % 256, size * 8 // 256
            yield _first_word(np.ascontiguousarray(block.view("<u4").T)).astype("<u4").byteswap().astype(np.int64)
            begin = to
