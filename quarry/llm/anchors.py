"""Anchors of fixed-length windows: every window of `length` bytes picks one position by its own bytes alone."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

GRAM = 32  #: bytes of the k-grams whose hashes are compared; less than the window
SEGMENT = 1 << 20  #: window starts handled at a time

_rng = np.random.default_rng(11)
BYTE_HASHES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
STEP_HASHES = _rng.integers(0, 1 << 63, 5, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by five doublings."""
    h = BYTE_HASHES[data]
    width = 1
    for m in STEP_HASHES:
        h = h[: len(h) - width] * m + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from minima run forwards and backwards in blocks of w."""
    n = len(h)
    pad = np.full(-n % w, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    blocks = np.concatenate([h, pad]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchor_blocks(data: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each segment of a text: arrays (key, start, windows, anchor) of runs of window starts that share an anchor.

    A window's anchor is the leftmost of its GRAM-byte strings with the smallest hash, so that equal windows have
    equal keys and equal distances to their anchors, wherever they stand.
    """
    w = length - GRAM + 1
    raw = np.frombuffer(data, np.uint8)
    for a in range(0, len(raw) - length + 1, SEGMENT):
        part = raw[a : a + SEGMENT + length - 1]
        h = gram_hashes(part)
        low = sliding_minimum(h, w)
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (h[: len(low) - 1] == low[:-1])
        starts = np.flatnonzero(new)
        at = starts + w - 1  # a smaller hash has come in on the right, unless
        search = np.ones(len(starts), bool)
        search[1:] = low[starts[1:]] >= low[starts[1:] - 1]
        view = np.lib.stride_tricks.sliding_window_view(h, w)
        for s in range(0, len(starts), 4096):
            pick = np.flatnonzero(search[s : s + 4096]) + s
            at[pick] = starts[pick] + view[starts[pick]].argmin(axis=1)
        yield low[starts].view(np.int64), starts + a, np.diff(np.append(starts, len(low))), at + a


def content_hash(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)
