"""Uniform numbers from a hash of the row id.

Unlike ``rand()`` the value of a row does not depend on how the table is
partitioned, survives recomputation of a lost partition, and can be pushed
below other operators.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kernspan.functions.vectors import let


def _digest(id_col: Column | str, seed: int | str, round_no: int) -> Column:
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(F.lit(f"{seed}:{round_no}:"), col.cast("string")))


def _word(digest: Column, part: int) -> Column:
    return F.substring(digest, 8 * part + 1, 8)


def hash_uniform(
    id_col: Column | str, seed: int | str, round_no: int = 0, part: int = 0
) -> Column:
    """A uniform double in [0, 1) from md5 of ``seed:round:id``, 32 bits wide.

    The digest holds four independent numbers; ``part`` 0 .. 3 picks one, so
    several uniforms of a row can share one digest.
    """
    word = F.conv(_word(_digest(id_col, seed, round_no), part), 16, 10)
    return word.cast("bigint") / F.lit(4294967296.0)


def uniform_below(id_col: Column | str, seed: int | str, round_no: int, share: float) -> Column:
    """Whether ``hash_uniform`` is below ``share``, compared as text, without conversion."""
    limit = max(0, math.ceil(share * 4294967296))
    if limit > 0xFFFFFFFF:
        return (F.col(id_col) if isinstance(id_col, str) else id_col).isNotNull()
    return _word(_digest(id_col, seed, round_no), 0) < F.lit(f"{limit:08x}")


def any_uniform_below(
    id_col: Column | str, seed: int | str, round_no: int, parts: int, share: float
) -> Column:
    """Whether one of the first ``parts`` uniforms of a digest is below ``share``.

    The digest is computed once and compared as text, without conversion.
    """
    limit = F.lit(f"{math.ceil(share * 4294967296):08x}")

    def hit(digest: Column) -> Column:
        hits = _word(digest, 0) < limit
        for part in range(1, parts):
            hits = hits | (_word(digest, part) < limit)
        return hits

    return let(_digest(id_col, seed, round_no), hit)


def nested_level(u: Column, n_levels: int) -> Column:
    """How many of ``n_levels`` nested coin flips a row survives.

    Level i (from 0) is survived with probability 2^-(i+1), so a row with
    result L belongs to the levels 0 .. L-1.
    """

    def survived(coin: Column) -> Column:
        flips = [(coin < F.lit(0.5 ** (i + 1))).cast("int") for i in range(n_levels)]
        return reduce(Column.__add__, flips)

    return let(u, survived)


#: md5: the rotations of its four rounds, its constants and its start (RFC 1321)
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: bytes of a text that fits one block of md5
_ONE_BLOCK = 55


def first_words(prefix: bytes, keys: pa.Array) -> np.ndarray:
    """The first 32 bits of md5 of ``prefix`` and each of the binary ``keys``, which has no
    nulls: the number behind ``hash_uniform``, for a block of rows at once."""
    n, data = len(keys), np.frombuffer(keys.buffers()[2] or b"", dtype=np.uint8)
    offsets = np.frombuffer(keys.buffers()[1], dtype=np.int32)[keys.offset : keys.offset + n + 1]
    lengths = np.diff(offsets)
    total = lengths + len(prefix)
    if n and total.max() > _ONE_BLOCK:
        words = [int.from_bytes(hashlib.md5(prefix + k).digest()[:4], "big") for k in keys.to_pylist()]
        return np.array(words, dtype=np.uint32)
    text = np.zeros((n, 64), dtype=np.uint8)
    text[:, : len(prefix)] = np.frombuffer(prefix, dtype=np.uint8)
    for at in range(int(lengths.max()) if n else 0):
        has = np.flatnonzero(lengths > at)
        text[has, len(prefix) + at] = data[offsets[:-1][has] + at]
    text[np.arange(n), total] = 0x80
    words = np.ascontiguousarray(text.view("<u4").T)
    words[14] = total * 8
    a, b, c, d = (np.full(n, v) for v in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + words[g] + _SINES[i]
        turn = _TURNS[i // 16][i % 4]
        a, b, c, d = d, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn))), b, c
    return (a + _START[0]).byteswap()
