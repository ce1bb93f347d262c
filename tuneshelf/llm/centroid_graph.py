"""Balanced clustering of a sample, and an in-memory neighbour graph over its centroids."""

from __future__ import annotations

import numpy as np

DEGREE = 16  # neighbours of a centroid in the graph
ENTRIES = 16  # centroids that a search begins from
STEP = 4  # beam entries expanded at a time
SEARCH_ROWS = 256  # queries searched together


def square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of both, by the dot-product form (never below 0)."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :], 0)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 4) -> np.ndarray:
    """Centroids of ``lists`` clusters of nearly equal size, in the order of a split tree.

    The sample is halved at the median along the line between two far points, again and
    again, each part getting its share of the lists; then points move to the centroid that
    is nearest after a penalty for clusters above their fair size.
    """
    x = x.astype(np.float32)
    parts: list[np.ndarray] = []
    todo = [(np.arange(len(x)), lists)]
    while todo:
        at, k = todo.pop()
        if k <= 1 or len(at) <= 1:
            parts.append(at)
            continue
        own = x[at]
        far = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
        other = own[((own - far) ** 2).sum(1).argmax()]
        order = np.argsort(own @ (other - far), kind="stable")
        half = max(1, min(len(at) - 1, len(at) * (k // 2) // k))
        todo.append((at[order[half:]], k - k // 2))  # a stack: the left part is finished first
        todo.append((at[order[:half]], k // 2))
    centroids = np.stack([x[p].mean(0) for p in parts if len(p)])
    fair = len(x) / len(centroids)
    for _ in range(rounds):
        size, total = np.zeros(len(centroids)), np.zeros_like(centroids, dtype=np.float64)
        load = np.zeros(len(centroids), np.float32)
        for start in range(0, len(x), 2048):
            rows = x[start: start + 2048]
            d = square(rows, centroids)
            near = (d + load * np.float32(np.median(d.min(1)))).argmin(1)
            size += np.bincount(near, minlength=len(centroids))
            np.add.at(total, near, rows)
            load = np.maximum(size / fair * len(x) / (start + len(rows)) - 1, 0).astype(np.float32) * np.float32(0.1)
        some = size > 0
        centroids[some] = (total[some] / size[some, None]).astype(np.float32)
    return centroids


class CentroidGraph:
    """Beam search over a graph of each centroid's nearest ones; a ring keeps it connected."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids.astype(np.float32)
        n = len(self.c)
        degree = min(DEGREE, n - 1)
        near = np.empty((n, degree + 2), np.int64)
        for start in range(0, n, 1024):
            rows = np.arange(start, min(start + 1024, n))
            d = square(self.c[rows], self.c)
            d[np.arange(len(rows)), rows] = np.inf
            if degree:
                near[rows, :degree] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
            near[rows, degree], near[rows, degree + 1] = (rows + 1) % n, (rows - 1) % n
        self.near = near
        self.entries = np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int64))

    def __len__(self) -> int:
        return len(self.c)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids found and their distances, nearest first (rows of
        the graph that were not reached: index -1, distance infinite)."""
        width = min(width, len(self.c))
        out = [self._beam(x[s: s + SEARCH_ROWS].astype(np.float32), width) for s in range(0, len(x), SEARCH_ROWS)]
        if not out:
            return np.zeros((0, width), np.int64), np.zeros((0, width), np.float32)
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def _beam(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        b, row = len(x), np.arange(len(x))[:, None]
        seen = np.zeros((b, len(self.c)), bool)
        ids, dist = np.full((b, width), -1, np.int64), np.full((b, width), np.inf, np.float32)
        done = np.zeros((b, width), bool)
        new = np.tile(self.entries, (b, 1))
        while True:
            new = np.sort(new, axis=1)
            fresh = (new >= 0) & ~seen[row, np.maximum(new, 0)]
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            seen[np.broadcast_to(row, new.shape)[fresh], new[fresh]] = True
            d = np.full(new.shape, np.inf, np.float32)
            at, col = np.nonzero(fresh)
            diff = x[at] - self.c[new[at, col]]
            d[at, col] = np.einsum("ij,ij->i", diff, diff)
            every, alld = np.concatenate([ids, new], 1), np.concatenate([dist, d], 1)
            flag = np.concatenate([done, np.zeros(new.shape, bool)], 1)
            keep = np.argpartition(alld, width - 1, axis=1)[:, :width]
            ids, dist, done = every[row, keep], alld[row, keep], flag[row, keep]
            left = np.where(done | ~np.isfinite(dist), np.inf, dist)
            if not np.isfinite(left).any():
                break
            step = min(STEP, width)
            pick = np.argpartition(left, step - 1, axis=1)[:, :step]
            ok = np.isfinite(left[row, pick])
            done[np.broadcast_to(row, pick.shape)[ok], pick[ok]] = True
            new = np.where(ok[:, :, None], self.near[np.maximum(ids[row, pick], 0)], -1).reshape(b, -1)
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = ids[row, order], dist[row, order]
        return np.where(np.isfinite(dist), ids, -1), np.sqrt(dist)

    def within(self, x: np.ndarray, ratio: float, sizes: np.ndarray, enough: int, width: int = 64) -> list[np.ndarray]:
        """For each row the centroids no farther than ``ratio`` times its nearest one, and
        further ones until their lists (of the given sizes) hold ``enough`` entries.  The beam
        widens until its last entry is beyond both, so none of those found is dropped."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(x)
        todo = np.arange(len(x))
        while len(todo):
            ids, dist = self.search(x[todo], width)
            bound = dist[:, :1] * ratio + 1e-12
            before = np.cumsum(np.where(ids >= 0, sizes[np.maximum(ids, 0)], 0), axis=1)
            want = (dist <= bound) | (np.concatenate([np.zeros((len(ids), 1)), before[:, :-1]], 1) < enough)
            full = want[:, -1] & (ids.shape[1] < len(self.c))
            for i in np.nonzero(~full)[0]:
                out[todo[i]] = ids[i][want[i] & (ids[i] >= 0)]
            todo, width = todo[full], width * 4
        return out

    def replicas(self, x: np.ndarray, ratio: float, most: int) -> list[np.ndarray]:
        """The lists that hold each row: its nearest centroid and, for a boundary vector,
        further ones within ``ratio`` that no chosen centroid is closer to than the row is."""
        ids, dist = self.search(x, max(24, 4 * most))
        out = []
        for i in range(len(x)):
            near = [int(ids[i, 0])]
            for j in range(1, ids.shape[1]):
                if len(near) >= most or ids[i, j] < 0 or dist[i, j] > ratio * dist[i, 0] + 1e-12:
                    break
                gap = ((self.c[near] - self.c[ids[i, j]]) ** 2).sum(1).min()
                if gap > dist[i, j] ** 2 * 0.5:
                    near.append(int(ids[i, j]))
            out.append(np.array(near))
        return out
