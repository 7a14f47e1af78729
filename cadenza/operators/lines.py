"""What two decoders and two groupings share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class BestLine:
    """The best chain through items that come in order: add() each, then read best.

    An item keeps its best total and a link to the item before, so a chain that nobody can join any more is let go, and
    memory is bounded by what is in reach. in_reach(earlier, item) must stay false once it is; cost(earlier, item) is None
    where item can't follow. Of equal totals the earlier predecessor holds, and the end that comes first or has the smaller rank.
    """

    def __init__(self, in_reach: Callable, cost: Callable):
        self.in_reach, self.cost = in_reach, cost
        self.near: list[tuple] = []
        self.best: tuple | None = None

    def add(self, item, gain: float, alone: float, rank: int = 0) -> None:
        """gain: what the item adds to a chain; alone: what a chain that begins with it is worth."""
        self.near = [x for x in self.near if self.in_reach(x[0], item)]
        total, before = alone, None
        for earlier, so_far, node in self.near:
            off = self.cost(earlier, item)
            # in the order of the SQL: sums in another order fall either way where two ways are worth the same
            if off is not None and so_far - off + gain > total:
                total, before = so_far - off + gain, node
        node = (item, before)
        self.near.append((item, total, node))
        if self.best is None or (-total, rank) < (-self.best[0], self.best[1]):
            self.best = (total, rank, node)

    def items(self) -> list:
        found, node = [], self.best[2] if self.best else None
        while node is not None:
            found.append(node[0])
            node = node[1]
        return found[::-1]


def greedy_labels(sim: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each threshold the group of each of n blocks, and the number of groups. In order, each joins the leader it is most like (the later of ties) among those at or above the threshold, else it leads a group of its own."""
    n, rows = len(sim), np.arange(len(thresholds))
    labels, leads, counts = np.zeros((len(rows), n), int), np.zeros((len(rows), n), bool), np.zeros(len(rows), int)
    for b in range(n):
        fits = np.where(leads[:, :b] & (sim[b, :b] >= thresholds[:, None]), sim[b, :b], -np.inf)
        joins = np.isfinite(fits).any(axis=1)
        last = b - 1 - fits[:, ::-1].argmax(axis=1) if b else np.zeros(len(rows), int)
        labels[:, b] = np.where(joins, labels[rows, last], counts)
        leads[:, b] = ~joins
        counts += ~joins
    return labels, counts


def separation(sim: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of labels the mean similarity of pairs inside groups and of pairs between them; NaN where there are none."""
    i, j = np.triu_indices(len(sim), 1)
    same = labels[:, i] == labels[:, j]
    with np.errstate(invalid="ignore", divide="ignore"):
        return (same * sim[i, j]).sum(axis=1) / same.sum(axis=1), (~same * sim[i, j]).sum(axis=1) / (~same).sum(axis=1)
