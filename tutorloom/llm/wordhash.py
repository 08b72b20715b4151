"""Words of a batch of texts as 64-bit hashes in one numpy array, and hashes of runs of words."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd 64-bit multipliers


@dataclass
class Words:
    """``hashes`` of all words in order; text ``i`` has those from ``bounds[i]`` to ``bounds[i + 1]``."""

    lists: list[list[bytes]]
    hashes: np.ndarray
    bounds: np.ndarray


def hashed(texts: list[str | None], split: Callable[[bytes], list[bytes]]) -> Words:
    """``split`` turns the UTF-8 bytes of a text into its words (null: none)."""
    lists = [split(t.encode()) if t else [] for t in texts]
    flat = pa.array(list(chain.from_iterable(lists)), pa.binary()).dictionary_encode()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    hashes = each[flat.indices.to_numpy(zero_copy_only=False)] if len(each) else each
    return Words(lists, hashes, np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words; entry ``i`` begins at word ``i`` (runs may cross texts)."""
    out = hashes[: max(len(hashes) - n + 1, 0)]
    for j in range(1, n):
        out = scramble(out) * STEP + hashes[j : j + len(out)]
    return scramble(out)


def run_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Positions where a run of ``n`` words begins that stays in its text."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    total = int(counts.sum())
    skipped = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total) + skipped


def text_of(bounds: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Index of the text that holds each position."""
    return np.searchsorted(bounds, positions, side="right") - 1
