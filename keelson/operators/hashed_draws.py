"""Bernoulli draws from md5 for whole Arrow batches: numpy words in place of a text a draw.

A draw's uniform is eight hex digits of the md5 of 'key|number|seed'.  Rows whose keys are of one length share the layout of the
message, so the 64 steps of one md5 run over a block of rows at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

TURNS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: the longest message of one md5 block, in bytes
ONE_BLOCK = 55
#: rows hashed at a time: the arrays of a block stay in the processor's cache
ROWS = 16384


def md5_words(message: list, rows: int) -> list[np.ndarray]:
    """The four words of each row's md5; ``message``: 16 little-endian words, each an array or a number that all rows share."""
    a, b, c, d = (np.full(rows, s, np.uint32) for s in START)
    f, t = np.empty(rows, np.uint32), np.empty(rows, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        word, known = message[g], SINES[i]
        if isinstance(word, np.ndarray):
            f += word
        else:
            known = (known + word) % 2 ** 32
        f += np.uint32(known)
        np.left_shift(f, np.uint32(TURNS[i]), out=t)
        np.right_shift(f, np.uint32(32 - TURNS[i]), out=f)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    for word, s in zip((a, b, c, d), START):
        word += np.uint32(s)
    return [a, b, c, d]


def digest_numbers(keys: np.ndarray, tail: bytes) -> list[np.ndarray]:
    """The four 32-bit numbers, in the order of the hex digits, of md5(key + tail); ``keys``: (rows, length) bytes."""
    rows, length = keys.shape
    if length + len(tail) > ONE_BLOCK:
        digests = b"".join(hashlib.md5(k.tobytes() + tail, usedforsecurity=False).digest() for k in keys)
        return list(np.frombuffer(digests, ">u4").reshape(rows, 4).T.astype(np.uint32))
    whole, rest = length // 4, length % 4
    padded = np.zeros((rows, 4 * (whole + 1)), np.uint8)
    padded[:, :length] = keys
    own = np.ascontiguousarray(padded.view("<u4").T).astype(np.uint32)
    shared = bytearray(64)
    shared[length:length + len(tail) + 1] = tail + b"\x80"
    shared[56:] = (8 * (length + len(tail))).to_bytes(8, "little")
    message: list = [int(w) for w in np.frombuffer(bytes(shared), "<u4")]
    for i in range(whole):
        message[i] = own[i]
    if rest:
        message[whole] = own[whole] + np.uint32(message[whole])
    return [w.byteswap(inplace=True) for w in md5_words(message, rows)]


def hits_per_simulation(batches: Iterator[pd.DataFrame], n_sims: int, seed: int, parts: int) -> Iterator[pd.DataFrame]:
    """sim_id, _n and _c (hits and their cents) of all rows (_key text or null, _most: the largest number that hits, _cents).

    Draw d takes number d % parts of md5('key|d div parts|seed'); a null key is left out of the text."""
    count, cents = np.zeros(n_sims, np.int64), np.zeros(n_sims, np.int64)

    def draw(heads: list[bytes], most: list[int], worth: list[int]) -> None:
        keys = np.frombuffer(b"".join(heads), np.uint8).reshape(len(heads), len(heads[0]))
        limit, money = np.array(most, np.uint32), np.array(worth, np.int64)
        for group in range(n_sims // parts):
            numbers = digest_numbers(keys, f"{group}|{seed}".encode())
            for k in range(parts):
                hit = numbers[k] <= limit
                count[group * parts + k] += np.count_nonzero(hit)
                cents[group * parts + k] += (money * hit).sum()

    waiting: dict[int, tuple[list, list, list]] = {}   # by the key's length, fewer than ROWS rows each
    for pdf in batches:
        for key, most, worth in zip(pdf["_key"], pdf["_most"].tolist(), pdf["_cents"].tolist()):
            head = b"" if key is None else key.encode() + b"|"
            block = waiting.setdefault(len(head), ([], [], []))
            block[0].append(head), block[1].append(most), block[2].append(worth)
            if len(block[0]) == ROWS:
                draw(*waiting.pop(len(head)))
    for block in waiting.values():
        draw(*block)
    yield pd.DataFrame({"sim_id": np.arange(n_sims), "_n": count, "_c": cents})


def drawn_below(keys: list[str | None], n_trees: int, parts: int, what: str, below: float) -> tuple[pa.Array, pa.Array, pa.Array]:
    """row, tree and number of every (row, tree) whose number is less than ``below``.

    Tree t takes number t % parts of md5('key|what|t div parts'); a null key is left out of the text."""
    heads = [b"" if k is None else k.encode() + b"|" for k in keys]
    of_length: dict[int, list[int]] = {}
    for i, head in enumerate(heads):
        of_length.setdefault(len(head), []).append(i)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))]
    for length, block in of_length.items():
        own, places = np.frombuffer(b"".join(heads[i] for i in block), np.uint8).reshape(len(block), length), np.array(block, np.int64)
        for group in range(-(-n_trees // parts)):
            numbers = digest_numbers(own, f"{what}|{group}".encode())
            for k in range(min(parts, n_trees - group * parts)):
                hit = np.flatnonzero(numbers[k] < below)
                found.append((places[hit], np.full(len(hit), group * parts + k, np.int32), numbers[k][hit].astype(np.int64)))
    row, tree, number = (np.concatenate(column) for column in zip(*found))
    return pa.array(row), pa.array(tree), pa.array(number)
