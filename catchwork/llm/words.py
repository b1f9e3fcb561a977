"""Words of whole texts as numbers, a batch of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch whose texts have about max_bytes together: one document at least, whole documents always."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(lengths) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 texts, null as the empty text."""
    return [b or b"" for b in batch.column(column).cast(pa.binary()).to_pylist()]


class Words(dict):
    """Gives each word of a batch a number; lo and hi are its 128-bit hash, the same in every process."""

    def __init__(self) -> None:
        super().__init__()
        self.known: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.known)
        self.known.append(word)
        return n

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.known)), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def rolling(x: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of every run of width values: sum of x[i + j] * base**j modulo 2**64, by doubling."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, out, done, have, run = np.uint64(base), None, 0, 1, x.astype(np.uint64)
    with np.errstate(over="ignore"):
        scale = np.uint64(1)  # base ** done
        while True:
            if width & have:
                part = run[done : done + n] * scale
                out = part if out is None else out + part
                done += have
                scale = scale * power
            have *= 2
            if have > width:
                return out
            run = run[: len(run) - have // 2] + run[have // 2 :] * power
            power = power * power


def spread(x: np.ndarray) -> np.ndarray:
    """Mixes the bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))
