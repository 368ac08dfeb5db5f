"""A grouping genetic algorithm for bin packing, on the items of one shard.

Items are numbered from the longest to the shortest.  An individual is a list of
bins, each a list of items; its fitness is the mean square of the fillings.
"""

from __future__ import annotations

import numpy as np

Bins = list[list[int]]


def best_fit(items: list[int], sizes: list[int], capacity: int, bins: Bins) -> Bins:
    """Put each item, in the given order, where it leaves the least room, else in a new bin; ``bins`` is extended in place."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has exactly r left
    for k, b in enumerate(bins):
        room = capacity - sum(sizes[i] for i in b)
        by_room[room].append(k)
        rooms |= 1 << room
    for i in items:
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        left = room - size
        by_room[left].append(k)
        rooms |= 1 << left
    return bins


class Island:
    """A population that evolves by itself between migrations; deterministic for its seed."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int, population: int = 4) -> None:
        self.sizes, self.capacity, self.population = [int(x) for x in sizes], capacity, population
        self.draw = np.random.default_rng(seed)
        self.array = np.asarray(sizes)
        #: No packing has fewer bins.
        self.bound = max(-(-int(self.array.sum()) // capacity), int((self.array * 2 > capacity).sum()))
        self.members: list[tuple[float, Bins]] = []
        self.crossed = 0

    def fitness(self, bins: Bins) -> float:
        fill = [sum(self.sizes[i] for i in b) for b in bins]
        return float(np.mean((np.array(fill) / self.capacity) ** 2)) if bins else 1.0

    def add(self, bins: Bins) -> None:
        """Keep an individual if it belongs to the best; of equal ones only the first."""
        score = self.fitness(bins)
        if all(abs(score - s) > 1e-12 for s, _ in self.members):
            self.members = sorted([*self.members, (score, bins)], key=lambda m: -m[0])[: self.population]

    def start(self) -> None:
        n = len(self.sizes)
        self.add(best_fit(list(range(n)), self.sizes, self.capacity, []))
        for k in range(1, self.population):
            if self.solved():
                return
            noise = self.array * (1 + 0.05 * k * self.draw.standard_normal(n))
            self.add(best_fit(np.argsort(-noise, kind="stable").tolist(), self.sizes, self.capacity, []))

    def solved(self) -> bool:
        return bool(self.members) and len(self.members[0][1]) <= self.bound

    def cross(self, one: Bins, two: Bins) -> Bins:
        """Inject well-filled bins of ``two`` into ``one``, drop what holds their items too, and best-fit what that displaces."""
        self.crossed += 1
        room = np.array([self.capacity - sum(self.sizes[i] for i in b) for b in two])
        full = np.argsort(room, kind="stable")[: max(1, len(two) // 2)]
        chosen = self.draw.permutation(full)[: max(1, int(len(full) * self.draw.uniform(0.3, 0.9)))]
        taken = bytearray(len(self.sizes))
        child: Bins = []
        for k in chosen.tolist():
            child.append(list(two[k]))
            for i in two[k]:
                taken[i] = 1
        displaced: list[int] = []
        for b in one:
            if any(taken[i] for i in b):
                displaced += [i for i in b if not taken[i]]
            else:
                child.append(list(b))
        return best_fit(sorted(displaced), self.sizes, self.capacity, child)

    def mutate(self, bins: Bins) -> Bins:
        """Empty the least filled bins and some others, and best-fit their items again."""
        room = np.array([self.capacity - sum(self.sizes[i] for i in b) for b in bins])
        gone = set(np.argsort(-room, kind="stable")[: max(1, len(bins) // 20)].tolist()) | set(self.draw.choice(len(bins), max(1, len(bins) // 50)).tolist())
        return best_fit(sorted(i for k in gone for i in bins[k]), self.sizes, self.capacity, [list(b) for k, b in enumerate(bins) if k not in gone])

    def evolve(self, generations: int) -> None:
        for _ in range(generations):
            if self.solved() or not self.sizes:
                return
            for _ in range(self.population // 2):
                a, b = self.draw.choice(len(self.members), 2) if len(self.members) > 1 else (0, 0)
                child = self.cross(self.members[min(a, b)][1], self.members[max(a, b)][1])
                self.add(child)
                self.add(self.mutate(child))


def encode(bins: Bins, n: int) -> bytes:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def decode(data: bytes) -> Bins:
    of = np.frombuffer(data, np.int32)
    bins: Bins = [[] for _ in range(int(of.max()) + 1 if len(of) else 0)]
    for i, k in enumerate(of.tolist()):
        bins[k].append(i)
    return bins
