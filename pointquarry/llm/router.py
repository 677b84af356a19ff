"""A learned partition of vectors: a neighbour graph cut into balanced parts, and a
classifier that says which parts hold the neighbours of a vector."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rows of a product of matrices that are held at once.
ROWS = 1024


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of the largest inner product with each row, without itself."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    for a in range(0, len(x) if k > 0 else 0, ROWS):
        near = x[a : a + ROWS] @ x.T
        near[np.arange(len(near)), a + np.arange(len(near))] = -np.inf
        out[a : a + ROWS] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def halves(x: np.ndarray, graph: np.ndarray, nodes: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Which half (-1 or 1) each node falls into, of equal sizes and with few edges between.

    It starts at the median along the main direction; in each round nodes move to the side
    of most of their neighbours, as far as both halves stay equal.
    """
    d = x[nodes] - x[nodes].mean(axis=0)
    axis = rng.normal(size=x.shape[1])
    for _ in range(20):
        axis = d.T @ (d @ axis)
        axis /= np.linalg.norm(axis) or 1.0
    along, middle = d @ axis, len(nodes) // 2

    def equal(score: np.ndarray) -> np.ndarray:
        side = np.full(len(nodes), -1.0)
        side[np.argsort(score, kind="stable")[middle:]] = 1.0
        return side

    side, local = equal(along), np.full(len(x), -1)
    local[nodes] = np.arange(len(nodes))
    to = local[graph[nodes]]
    inside, to = to >= 0, np.maximum(to, 0)
    source = np.broadcast_to(np.arange(len(nodes))[:, None], to.shape)[inside]
    for _ in range(rounds):
        pull = np.where(inside, side[to], 0).sum(axis=1)
        np.add.at(pull, to[inside], side[source])
        moved = equal(pull + 3 * side + 1e-6 * along)
        if (moved == side).all():
            break
        side = moved
    return side


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int, rounds: int = 30) -> np.ndarray:
    """A part below ``parts`` (a power of two) for each row, by halving again and again."""
    rng, out = np.random.default_rng(seed), np.zeros(len(x), np.int64)
    split = [(np.arange(len(x)), parts, 0)]
    while split:
        nodes, n, first = split.pop()
        if n == 1 or len(nodes) < 2:
            out[nodes] = first
            continue
        side = halves(x, graph, nodes, rounds, rng)
        split += [(nodes[side < 0], n // 2, first), (nodes[side > 0], n // 2, first + n // 2)]
    return out


@dataclass
class Router:
    """One hidden layer over scaled vectors; ``mass`` is the probability at which parts suffice."""

    scale: float
    weights: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    mass: float

    @property
    def parts(self) -> int:
        return len(self.weights[3])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A row for each vector: how probable each part is to hold a neighbour."""
        w1, b1, w2, b2 = self.weights
        h = np.maximum(np.clip(x / self.scale, -1e3, 1e3).astype(np.float32) @ w1 + b1, 0)
        z = h @ w2 + b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def shares(near: np.ndarray, parts: int) -> np.ndarray:
    """A row for each row of part numbers: which share of them each part has."""
    out = np.zeros((len(near), parts), np.float32)
    np.add.at(out, (np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()), 1 / max(1, near.shape[1]))
    return out


def trained(x: np.ndarray, near: np.ndarray, parts: int, hidden: int, epochs: int, seed: int) -> tuple:
    """Weights that bring the classifier near the shares of the parts ``near`` each row (Adam on the cross
    entropy). Shares are made for a batch at a time, so many parts cost no memory."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(size=(x.shape[1], hidden)) * np.sqrt(2 / max(1, x.shape[1])), np.zeros(hidden), rng.normal(size=(hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
    w = [a.astype(np.float32) for a in w]
    first, second, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for epoch in range(epochs if len(x) else 0):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            rows, t = order[a : a + 256], t + 1
            h = np.maximum(x[rows] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - shares(near[rows], parts)) / len(rows)
            back = (g @ w[2].T) * (h > 0)
            for k, d in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ g, g.sum(axis=0))):
                d = d + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                w[k] -= 3e-3 * (1 - epoch / epochs) * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
    return tuple(w)


def fitted(x: np.ndarray, parts: int, k: int, recall: float, hidden: int = 128, epochs: int = 20, seed: int = 42) -> Router:
    """Cut the neighbour graph of a sample and learn its parts.

    The classifier learns how the k neighbours of a vector spread over the parts. An eighth
    of the sample is kept from it and says at which probability mass the parts visited
    hold the wanted share of neighbours; rows are dealt by the classifier there as in the index.
    """
    scale = float(np.sqrt(np.mean(np.square(x)))) if x.size else 1.0
    x = np.clip(x / (scale or 1.0), -1e3, 1e3).astype(np.float32)
    graph = neighbour_graph(x, k)
    part = balanced_parts(x, graph, parts, seed)
    near = part[graph] if graph.shape[1] else part[:, None]
    own = np.arange(len(x)) % 8 > 0
    router = Router(1.0, trained(x[own], near[own], parts, hidden, epochs, seed), 1.0)
    if graph.shape[1] and not own.all():
        home = np.concatenate([router.probabilities(x[a : a + ROWS]).argmax(axis=1) for a in range(0, len(x), ROWS)])
        asks, needed = np.flatnonzero(~own), []
        for a in range(0, len(asks), ROWS):
            some = asks[a : a + ROWS]
            p = router.probabilities(x[some])
            order = np.argsort(-p, axis=1, kind="stable")
            sorted_p = np.take_along_axis(p, order, axis=1)
            # The mass before the part of a neighbour: it is visited if that is below the limit.
            before = np.cumsum(sorted_p, axis=1) - sorted_p
            at = np.take_along_axis(np.argsort(order, axis=1), home[graph[some]], axis=1)
            needed.append(np.take_along_axis(before, at, axis=1).ravel())
        needed = np.sort(np.concatenate(needed))
        router.mass = float(min(1.0, needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))] + 1e-6))
    router.scale = scale or 1.0
    return router
