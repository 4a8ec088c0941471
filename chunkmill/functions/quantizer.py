"""Coarse centroids and product codes of vectors: fitted on a bounded sample with numpy, applied to Arrow batches in tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes that coarse centroids may take, and codes of a subspace.
BOOK_BYTES, CODES = 16 << 20, 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(-1, keepdims=True)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int, sphere: bool = False) -> np.ndarray:
    """k means of the rows; on the sphere, means have length 1 and the largest product counts as nearest."""
    rng = np.random.default_rng(seed)
    means = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = (x @ means.T - (0 if sphere else (means * means).sum(1) / 2)).argmax(1)
        order = np.argsort(own, kind="stable")
        held, at = np.unique(own[order], return_index=True)
        new = np.add.reduceat(x[order], at, axis=0) / np.diff([*at, len(x)])[:, None]
        size = np.sqrt((new * new).sum(1, keepdims=True))
        fine = size[:, 0] > 1e-6 if sphere else np.ones(len(held), bool)
        means[held[fine]] = (new / np.where(size > 0, size, 1))[fine] if sphere else new[fine]
    return means


@dataclass
class Quantizer:
    """Coarse centroids of length 1, and a codebook for each subspace of what is left of a vector without its centroid."""

    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, pieces: int, rounds: int = 8) -> Quantizer:
        """From unit rows. There are at most a cell for 16 rows, and BOOK_BYTES of centroids."""
        width = x.shape[1]
        most = max(1, min(len(x) // 16, BOOK_BYTES // (8 * width)))
        centroids = kmeans(x, max(1, min(most, cells)), rounds, 1, sphere=True)
        rest = x - centroids[(x @ centroids.T).argmax(1)]
        ends = np.cumsum([len(p) for p in np.array_split(range(width), min(pieces, width))])[:-1]
        return cls(centroids, [kmeans(p, min(CODES, len(p)), rounds, 2) for p in np.split(rest, ends, axis=1)], ends.tolist())

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    def shaped(self, vectors: list[np.ndarray]) -> np.ndarray:
        """Vectors as rows of the centroids' width: longer ones are cut and shorter ones filled up, which brings vectors closer or leaves them as far."""
        out = np.zeros((len(vectors), self.width))
        for k, v in enumerate(vectors):
            out[k, : min(self.width, len(v))] = v[: self.width]
        return out

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the rows of given cells, and how far each row is from what its code stands for."""
        rest = x - self.centroids[cell]
        codes, miss = np.zeros((len(x), len(self.books)), np.uint8), np.zeros(len(x))
        for m, (p, book) in enumerate(zip(np.split(rest, self.cuts, axis=1), self.books, strict=True)):
            codes[:, m] = (p @ book.T - (book * book).sum(1) / 2).argmax(1)
            miss += ((p - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(miss)

    def decode(self, codes: np.ndarray, cell: int) -> np.ndarray:
        """The vectors that codes of a cell stand for."""
        return self.centroids[cell] + np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)

    def distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of rows to what codes of a cell stand for, summed from a table of each subspace."""
        out = np.zeros((len(x), len(codes)), np.float32)
        for m, (p, book) in enumerate(zip(np.split(x - self.centroids[cell], self.cuts, axis=1), self.books, strict=True)):
            looked = (p * p).sum(1)[:, None] - 2 * p @ book.T + (book * book).sum(1)
            out += looked.astype(np.float32)[:, codes[:, m]]
        return out
