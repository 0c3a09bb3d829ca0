"""Ways between all nodes of a graph that fits a task, by taking nodes out one after the other.

A node that is taken out leaves roads between its neighbours, so that all shortest ways are kept: a way goes up to later and later
nodes, then down. Nodes that do not wait for each other form a level, and a level is worked on at once for many sources, a column each.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np

#: Lengths are equal within this share.
EQUAL = 1e-9
#: Steps of taking nodes out after which a graph is too dense for it; cells (node, source) that are worked on at a time.
MOST_STEPS, SWEEP_CELLS = 30_000_000, 6_000_000
#: Cells (node, road) that are solved for at a time; potentials are equal that differ by less, where a road's ends can differ by 1.
SOLVE_CELLS, FLAT = 8_000_000, 2.0**-50
#: Neighbours of a group at most, so that what is worked on stays in a processor's cache.
GROUP_ROWS = 512
#: Pairs of neighbours that are worked on at a time.
PAIR_CELLS = 1_000_000
#: Places whose differences are worked on at a time.
AGREE_ROWS = 2048


def least_labels(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0..n-1 the least node of each one's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[u], root[v])
        for end in (u, v):
            np.minimum.at(root, root[end], low)
        root = root[root]
        if (root == before).all():
            return root


class Levels:
    """Nodes 0..n-1 in the order they were taken out, each with the neighbours it had then and what led there: `values`, a row of
    numbers for each neighbour. Places put the last node first, so neighbours come before; groups are of one level and degree.
    Nodes are a tree, too: `up` from each; `turn` counts them with all below a node next to it, and its neighbours before it, so
    the first turns up to any are all that ways between these lead over."""

    def __init__(self, n: int, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray):
        degree = np.diff(starts)
        level, up = np.zeros(n, np.int64), np.full(n, -1)
        for k, a, b in zip(order[::-1].tolist(), starts[-2::-1].tolist(), starts[:0:-1].tolist(), strict=True):
            if b > a:
                near = ends[a:b]
                up[k] = near[np.argmax(level[near])]
                level[k] = level[up[k]] + 1
        turn, size = _turns(order, up)
        node_degree, node_start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        node_degree[order], node_start[order] = degree, starts[:-1]
        self.n, self.nodes = n, np.lexsort((turn, node_degree, level))
        #: Of each place its turn, and how many nodes are below it, itself included.
        self.turn, self.size = turn[self.nodes], size[self.nodes]
        self.place = np.empty(n, np.int64)
        self.place[self.nodes] = np.arange(n)
        # The neighbour taken out first: all others are met going on from it.
        self.up = np.where(up[self.nodes] < 0, -1, self.place[up[self.nodes]])
        self.down = np.argsort(self.up, kind="stable")
        self.first_down = np.searchsorted(self.up[self.down], np.arange(n + 1))
        sizes, first = node_degree[self.nodes], node_start[self.nodes]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        taken = np.repeat(first - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.ends, self.values = self.place[ends[taken]], values[taken]
        kind = np.stack([level[self.nodes], sizes], 1)
        runs = [0, *(np.flatnonzero((kind[1:] != kind[:-1]).any(axis=1)) + 1).tolist(), n]
        self.roots = np.flatnonzero(sizes == 0)
        self.runs = [(a, b, int(sizes[a])) for a, b in pairwise(runs) if sizes[a : a + 1].sum()]
        self.groups = self.cut(GROUP_ROWS, lambda degree: degree)

    def cut(self, most: int, cells: Callable[[int], int]) -> list[tuple[int, int, int, int, int]]:
        """(first place, end, first neighbour, end, degree) of groups that have neighbours, of as many nodes as have `most` cells."""
        cuts = [(k, min(k + step, b)) for a, b, degree in self.runs for step in [max(1, most // cells(degree))] for k in range(a, b, step)]
        return [(a, b, int(self.starts[a]), int(self.starts[b]), int(self.starts[a + 1] - self.starts[a])) for a, b in cuts]

    def until(self, turn: int) -> list[tuple[int, int, int, int, int]]:
        """The groups' parts of turns before this one."""
        counts = np.concatenate([[0], np.cumsum(self.turn < turn)])
        return [(a, a + m, i, i + m * degree, degree) for a, b, i, _, degree in self.groups if (m := int(counts[b] - counts[a]))]

    def share(self, part: int, parts: int) -> list[np.ndarray]:
        """Places in turn, of `parts` that are as much work each one, if a place is as much work as turns come before it."""
        runs = np.array_split(np.argsort(self.turn), 2 * parts)
        return [r for r in (runs[2 * parts - 1 - part], runs[part]) if len(r)]

    def next_below(self, places: np.ndarray) -> np.ndarray:
        """All places whose `up` is among these."""
        return _ranges(self.down, self.first_down[places], self.first_down[places + 1])

    def above(self, places: np.ndarray) -> np.ndarray:
        """The places and all that are met going up from them, sorted."""
        seen: set[int] = set()
        for p in places.tolist():
            while p >= 0 and p not in seen:
                seen.add(p)
                p = int(self.up[p])
        return np.array(sorted(seen), np.int64)


def _turns(order: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each node its turn as the tree is walked, and how many nodes are below it, itself included."""
    above, n = up.tolist(), len(up)
    size, turn, free, roots = [1] * n, [0] * n, [0] * n, 0
    for k in order.tolist():
        if above[k] >= 0:
            size[above[k]] += size[k]
    for k in order[::-1].tolist():
        if above[k] >= 0:
            turn[k] = free[above[k]]
            free[above[k]] += size[k]
        else:
            turn[k] = roots
            roots += size[k]
        free[k] = turn[k] + 1
    return np.array(turn, np.int64), np.array(size, np.int64)


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]


def eliminate(n: int, near: list[dict], mesh: Callable[[list[dict], list], list], most_steps: int | None = None) -> Levels | None:
    """Takes out nodes, those of few neighbours first. near: of each node its neighbours' values, the same from both ends;
    mesh(near, found) joins the neighbours (node, value) of the node that goes, and gives the row of numbers to keep for each. None
    if the steps are more than most_steps."""
    # By degree alone, one node would wait for the next along a whole street; a node counts the levels that it waits for as well.
    waits, rank = [0] * n, [len(x) for x in near]
    heap = [(r, k) for k, r in enumerate(rank)]
    heapq.heapify(heap)
    gone, steps = bytearray(n), 0
    order, starts, ends, values = array("q"), array("q", [0]), array("q"), array("d")
    while heap:
        r, k = heapq.heappop(heap)
        if gone[k] or r != rank[k]:
            continue
        gone[k] = 1
        steps += len(near[k]) ** 2
        if most_steps is not None and steps > most_steps:
            return None
        found = list(near[k].items())
        near[k] = {}
        for a, _ in found:
            del near[a][k]
        for (a, _), x in zip(found, mesh(near, found), strict=True):
            waits[a] = max(waits[a], waits[k] + 1)
            rank[a] = len(near[a]) + waits[a]
            heapq.heappush(heap, (rank[a], a))
            ends.append(a)
            values.extend(x)
        order.append(k)
        starts.append(len(ends))
    whole = [np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in (order, starts, ends)]
    return Levels(n, *whole, np.frombuffer(values, np.float64).reshape(len(ends), -1) if len(ends) else np.zeros((0, 2)))


def _shorter(near: list[dict], found: list) -> list:
    """Roads (length, number of ways): the shorter one, or both."""
    for i, (a, (length_a, ways_a)) in enumerate(found):
        at = near[a]
        for b, (length_b, ways_b) in found[:i]:
            length, known = length_a + length_b, at.get(b)
            slack = EQUAL * (1 + length)
            if known is None or length < known[0] - slack:
                at[b] = near[b][a] = (length, ways_a * ways_b)
            elif length <= known[0] + slack:
                at[b] = near[b][a] = (min(length, known[0]), known[1] + ways_a * ways_b)
    return [x for _, x in found]


def _shorter_both(near: list[dict], found: list) -> list:
    """Roads (length in one graph, in another): the shorter one in each."""
    for i, (a, (x, y)) in enumerate(found):
        at = near[a]
        for b, (p, q) in found[:i]:
            p, q = p + x, q + y
            if (known := at.get(b)) is not None:
                p, q = min(p, known[0]), min(q, known[1])
            at[b] = near[b][a] = (p, q)
    return [x for _, x in found]


def _conducting(near: list[dict], found: list) -> list:
    """Conductances: a star's mesh. Kept are a neighbour's conductance and that of all."""
    total = sum(x for _, x in found)
    for i, (a, x) in enumerate(found):
        at, share = near[a], x / total
        for b, y in found[:i]:
            at[b] = near[b][a] = at.get(b, 0.0) + share * y
    return [(x, total) for _, x in found]


class Network:
    """Currents in a network of roads u, v between nodes 0..n-1, of conductances g. Each component's last node is at 0."""

    @classmethod
    def of(cls, u: np.ndarray, v: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, Network, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of the nodes, the network between these, and its roads: places and conductances, in turn."""
        # One order of the roads, so that all who make it take nodes out alike.
        order = np.lexsort((length, v, u))
        ids, at = np.unique(np.concatenate([u[order], v[order]]), return_inverse=True)
        a, b, g = at[: len(u)], at[len(u) :], 1 / np.maximum(length[order], 1e-9)
        network = cls(len(ids), a, b, g)
        a, b, turn = network.levels.place[a], network.levels.place[b], network.levels.turn
        order = np.argsort(np.maximum(turn[a], turn[b]), kind="stable")
        return ids, network, (a[order], b[order], g[order])

    def __init__(self, n: int, u: np.ndarray, v: np.ndarray, g: np.ndarray):
        near: list[dict] = [{} for _ in range(n)]
        for a, b, w in zip(u.tolist(), v.tolist(), g.tolist(), strict=True):
            near[a][b] = near[b][a] = near[a].get(b, 0.0) + w
        self.levels = eliminate(n, near, _conducting)
        self.flow, self.total = (np.ascontiguousarray(self.levels.values[:, k])[:, None] for k in (0, 1))

    def potentials(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row: a place; column k: the potentials as a unit current goes in at place a[k] and out at place b[k]."""
        levels, column = self.levels, np.arange(len(a))
        x = np.zeros((levels.n, len(a)))
        x[a, column] += 1
        x[b, column] -= 1
        for p in levels.above(np.concatenate([a, b]))[::-1].tolist():
            i, j = levels.starts[p], levels.starts[p + 1]
            x[levels.ends[i:j]] += self.flow[i:j] / self.total[i:j] * x[p]
        x[np.diff(levels.starts) == 0] = 0
        for p, q, i, j, degree in levels.groups:
            near = x.take(levels.ends[i:j], axis=0)
            near *= self.flow[i:j]
            x[p:q] += near.reshape(q - p, degree, -1).sum(axis=1)
            x[p:q] /= self.total[i:j:degree]
        return x


    def flows(self, a: np.ndarray, b: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Of each node, the sum over all pairs of nodes of the currents in roads (places a, b, conductances g) that it has, as one
        unit goes from one node of a pair to the other. Roads next to each other should come together."""
        sums, step = np.zeros(self.levels.n), max(1, min(64, SOLVE_CELLS // self.levels.n))
        for k in range(0, len(a), step):
            # A unit between s and t gives a road what a unit between the road's ends gives as difference of s and t.
            p, q = a[k : k + step], b[k : k + step]
            total = self._differences(p, q, g[k : k + step])
            np.add.at(sums, p, total)
            np.add.at(sums, q, total)
        return sums[self.levels.place]

    def _differences(self, a: np.ndarray, b: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Of each road, the sum over all pairs of nodes of the difference of their potentials times g. Potentials below a node lie
        between those of its neighbours, unless a current goes in there; where these are equal but for rounding, so are all below."""
        levels, column = self.levels, np.arange(len(a))
        high = levels.above(np.concatenate([a, b]))
        row = np.full(levels.n, -1)
        row[high] = np.arange(len(high))
        put = np.zeros((len(high), len(a)))
        put[row[a], column] += 1
        put[row[b], column] -= 1
        for k in range(len(high) - 1, -1, -1):
            i, j = levels.starts[high[k]], levels.starts[high[k] + 1]
            put[row[levels.ends[i:j]]] += self.flow[i:j] / self.total[i:j] * put[k]
        x, bound = np.empty((levels.n, len(a))), FLAT / g
        degree = np.diff(levels.starts)
        now = np.flatnonzero(degree == 0)
        x[now] = 0
        met, counts = [now], [np.ones(len(now), np.int64)]
        while len(now := levels.next_below(now)):
            now = now[np.argsort(degree[now], kind="stable")]
            cuts, left = [0, *(np.flatnonzero(np.diff(degree[now])) + 1).tolist(), len(now)], []
            for c, d in pairwise(cuts):
                size = int(degree[now[c]])
                for k in range(c, d, step := max(1, 4 * GROUP_ROWS // size)):
                    part = now[k : min(k + step, d)]
                    at = levels.starts[part][:, None] + np.arange(size)
                    near = x[levels.ends[at]]
                    flat = ((near.max(axis=1) - near.min(axis=1)) <= bound).all(axis=1) & (row[part] < 0)
                    near *= self.flow[at]
                    made, fed = near.sum(axis=1), np.flatnonzero(row[part] >= 0)
                    made[fed] += put[row[part[fed]]]
                    made /= self.total[at[:, 0]]
                    x[part] = made
                    met.append(part)
                    counts.append(np.where(flat, levels.size[part], 1))
                    left.append(part[~flat])
            now = np.concatenate(left)
        values, counts = np.ascontiguousarray(x[np.concatenate(met)].T), np.concatenate(counts)
        order = np.argsort(values, axis=1)
        values, counts = np.take_along_axis(values, order, axis=1), counts[order]
        before = np.cumsum(counts, axis=1) - counts
        # The k-th of n sorted values is taken k times from others, and n - 1 - k times others are taken from it.
        return g * (values * (counts * (2 * before + counts - levels.n))).sum(axis=1)


class Ways:
    """Shortest ways of a graph of roads u, v, length above 0 between nodes `ids` (sorted)."""

    def __init__(self, ids: np.ndarray, levels: Levels):
        self.ids, self.levels = ids, levels
        self.length, self.count = np.ascontiguousarray(levels.values[:, 0]), np.ascontiguousarray(levels.values[:, 1])
        #: Ids by place.
        self.named = ids[levels.nodes]

    @classmethod
    def of(cls, u: np.ndarray, v: np.ndarray, length: np.ndarray, most_steps: int = MOST_STEPS) -> Ways | None:
        """None for graphs that are too dense, or whose lengths are not all above 0."""
        if not (length > 0).all():
            return None
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        near: list[dict] = [{} for _ in ids]
        for a, b, w in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), length.tolist(), strict=True):
            if a != b and (b not in near[a] or w < near[a][b][0]):
                near[a][b] = near[b][a] = (w, 1.0)
        levels = eliminate(len(ids), near, _shorter, most_steps)
        return None if levels is None else cls(ids, levels)

    def batches(self, sources: np.ndarray, cells: int = SWEEP_CELLS) -> Iterator[np.ndarray]:
        """Places of sources (ids) in turn, a batch at a time, so those that go up alike are together."""
        places = self.levels.place[np.searchsorted(self.ids, sources)]
        yield from self.in_turn(places[np.argsort(self.levels.turn[places])], cells)

    def in_turn(self, places: np.ndarray, cells: int = SWEEP_CELLS) -> Iterator[np.ndarray]:
        """Places, a batch at a time."""
        size = max(1, min(256, cells // max(1, self.levels.n)))
        for k in range(0, len(places), size):
            yield places[k : k + size]

    def distances(self, sources: np.ndarray, until: int | None = None) -> np.ndarray:
        """Row: a place; column: a source's place; a negative place reaches nothing. With until, of turns before it only, the
        sources' among them."""
        levels = self.levels
        dist = np.full((levels.n, len(sources)), np.inf)
        some = np.flatnonzero(sources >= 0)
        dist[sources[some], some] = 0
        for p in levels.above(sources[some])[::-1].tolist():
            a, b = levels.starts[p], levels.starts[p + 1]
            ends = levels.ends[a:b]
            dist[ends] = np.minimum(dist[ends], dist[p] + self.length[a:b, None])
        for a, b, i, j, degree in levels.groups if until is None else levels.until(until):
            offers = dist.take(levels.ends[i:j], axis=0)
            offers += self.length[i:j, None]
            np.minimum(dist[a:b], offers.reshape(b - a, degree, -1).min(axis=1), out=dist[a:b])
        return dist

    def betweenness(self, part: int, parts: int, asked: np.ndarray) -> np.ndarray:
        """Of each id, the shares of the shortest ways from asked ids (booleans) to all others that lead over it. Of `parts` that
        add up to all ways, each as much work, one: a way is taken from its end of the later turn, for both ways that are asked."""
        levels = self.levels
        roads, load = np.zeros(len(levels.ends)), np.zeros(levels.n)
        weight = asked[levels.nodes].astype(float)
        with np.errstate(invalid="ignore", divide="ignore"):
            for places in levels.share(part, parts):
                until = int(levels.turn[places[-1]]) + 1
                groups = levels.until(until)
                merged = [_merge(levels.ends[i:j]) for _, _, i, j, _ in groups]
                # Taken once, as new pages cost as much as what is done with them.
                size = len(next(self.in_turn(places)))
                held = [np.empty(levels.n * size) for _ in range(3)] + [np.empty(len(levels.ends) * size, bool)]
                for batch in self.in_turn(places):
                    self._batch(batch, until, groups, merged, weight, roads, load, held)
            self._unpack(roads, load)
        out = np.empty(levels.n)
        out[levels.nodes] = load
        return out

    def _batch(self, sources: np.ndarray, until: int, groups: list, merged: list, weight: np.ndarray, roads: np.ndarray, load: np.ndarray, held: list[np.ndarray]) -> None:
        """Adds what goes over roads that are left by nodes taken out, and over nodes."""
        levels, column = self.levels, np.arange(len(sources))
        dist, ways, owed, tight = (x[: rows * len(sources)].reshape(rows, -1) for x, rows in zip(held, [levels.n] * 3 + [len(levels.ends)], strict=True))
        dist.fill(np.inf)
        ways.fill(0)
        owed.fill(0)
        dist[sources, column], ways[sources, column] = 0, 1
        high = levels.above(sources)
        for p in high[::-1].tolist():
            a, b = levels.starts[p], levels.starts[p + 1]
            ends = levels.ends[a:b]
            offer, more, now = dist[p] + self.length[a:b, None], ways[p] * self.count[a:b, None], dist[ends]
            slack = EQUAL * (1 + offer)
            ways[ends] = np.where(offer + slack < now, more, ways[ends] + np.where(offer <= now + slack, more, 0))
            dist[ends] = np.minimum(now, offer)
        up_dist, up_ways = dist[high], ways[high]
        for a, b, i, j, degree in groups:
            offers = dist.take(levels.ends[i:j], axis=0)
            offers += self.length[i:j, None]
            offers = offers.reshape(b - a, degree, -1)
            best = np.minimum(dist[a:b], offers.min(axis=1))
            bound = best + EQUAL * (1 + best)
            np.less_equal(offers, bound[:, None, :], out=tight[i:j].reshape(offers.shape))
            more = ways.take(levels.ends[i:j], axis=0)
            more *= self.count[i:j, None]
            more *= tight[i:j]
            more = more.reshape(b - a, degree, -1)
            own = ways[a:b]
            own *= dist[a:b] <= bound
            own += more.sum(axis=1)
            dist[a:b] = best
        # What goes to a node and over it to others, for each way to it; first for all ways down, the last nodes of a way first.
        since = levels.turn[sources[0]]

        def pass_on(rows: slice | np.ndarray) -> np.ndarray:
            asked = np.isfinite(dist[rows]) * (weight[rows, None] + weight[sources])
            if levels.turn[rows].max(initial=-1) >= since:
                asked *= levels.turn[rows, None] < levels.turn[sources]
            load[rows] += np.einsum("ij,ij->i", owed[rows], ways[rows])
            each = asked / ways[rows]
            each[ways[rows] == 0] = 0
            owed[rows] += each
            return owed[rows]

        for (a, b, i, j, degree), parts in zip(groups[::-1], merged[::-1], strict=True):
            each = pass_on(slice(a, b))
            moved = np.multiply(tight[i:j], self.count[i:j, None])
            by_node = moved.reshape(b - a, degree, -1)
            by_node *= each[:, None, :]
            roads[i:j] += np.einsum("ij,ij->i", moved, ways.take(levels.ends[i:j], axis=0))
            for places, rows in parts:
                if rows.ndim == 2:
                    owed[places] += rows.astype(float) @ moved
                else:
                    owed[places] += moved.take(rows, axis=0)
        pass_on(levels.roots[levels.turn[levels.roots] < until])
        np.subtract.at(load, sources, owed[sources, column])
        # Then for the ways up, back to the source.
        best = dist[high]
        back = owed[high] * up_ways * (up_dist <= best + EQUAL * (1 + best))
        row = np.full(levels.n, -1)
        row[high] = np.arange(len(high))
        for k, p in enumerate(high.tolist()):
            a, b = levels.starts[p], levels.starts[p + 1]
            ends = row[levels.ends[a:b]]
            offer = up_dist[k] + self.length[a:b, None]
            tight = (offer <= up_dist[ends] + EQUAL * (1 + offer)) & (up_ways[k] > 0)
            moved = np.where(tight, back[ends] * up_ways[k] * self.count[a:b, None] / up_ways[ends], 0)
            roads[a:b] += moved.sum(axis=1)
            came = moved.sum(axis=0)
            back[k] += came
            load[p] += came[sources != p].sum()

    def _unpack(self, roads: np.ndarray, load: np.ndarray) -> None:
        """What goes over a road left by a node goes over that node, and its roads."""
        levels = self.levels
        owner = np.repeat(np.arange(levels.n), np.diff(levels.starts))
        keys = owner * levels.n + levels.ends
        turn = np.argsort(keys)
        keys = keys[turn]
        for a, b, i, j, degree in levels.cut(PAIR_CELLS, lambda degree: degree * degree):
            ends, length, count = (x[i:j].reshape(b - a, degree) for x in (levels.ends, self.length, self.count))
            x, y = np.tril_indices(degree, -1)
            p, q = np.maximum(ends[:, x], ends[:, y]), np.minimum(ends[:, x], ends[:, y])
            at = turn[np.searchsorted(keys, p * levels.n + q)]
            way = length[:, x] + length[:, y]
            moved = roads[at] * np.where(way <= self.length[at] + EQUAL * (1 + way), count[:, x] * count[:, y] / self.count[at], 0)
            load[a:b] += moved.sum(axis=1)
            has = np.zeros((len(x), degree))
            has[np.arange(len(x)), x] = has[np.arange(len(x)), y] = 1
            roads[i:j] += (moved @ has).ravel()


class Agreement:
    """Ways of two graphs of roads (u, v, length above 0) between nodes that are matched, over one set of levels. `there`, `back`:
    nodes and their matches in the other graph, a match for a node. A place is a node of either graph, or one of each."""

    def __init__(self, levels: Levels, ids: np.ndarray, known: np.ndarray, asked: np.ndarray | None, other: np.ndarray, alike: int):
        self.levels, self.length = levels, np.ascontiguousarray(levels.values)
        #: Pairs whose ways are the same in both graphs, of nodes that are no places.
        self.alike = alike
        #: Of either graph by place: the ids, whether there is one, whether it is asked for (None: all), the place of its match, and
        #: whether that is its own.
        self.ids, self.known, self.asked, self.other = ids, known, asked, other
        here = np.arange(levels.n)
        self.plain = (other == here) | ((other < 0) & ~known[::-1]) | ~known

    @classmethod
    def of(cls, roads: list[tuple[np.ndarray, np.ndarray, np.ndarray]], asked: list[np.ndarray], matches: list[tuple[np.ndarray, np.ndarray]], most_steps: int = MOST_STEPS) -> Agreement | None:
        """asked: node ids of either graph whose ways to nodes of greater ids count. None for graphs that are too dense."""
        names = [np.unique(np.concatenate(r[:2])) for r in roads]
        find = lambda k, ids: np.where(np.isin(ids, names[k]), np.searchsorted(names[k], ids), -1)
        twins = []
        for k, (a, b) in enumerate(matches):
            a, b = find(k, a), find(1 - k, b)
            twin = np.full(len(names[k]), -1)
            twin[a[a >= 0]] = b[a >= 0]
            twins.append(twin)
        # A node of the second graph is one with the first node that it is the match of.
        n = len(names[0])
        number = [np.arange(n), np.full(len(names[1]), -1)]
        met, first = np.unique(twins[0], return_index=True)
        number[1][met[met >= 0]] = first[met >= 0]
        alone = np.flatnonzero(number[1] < 0)
        number[1][alone] = n + np.arange(len(alone))
        n += len(alone)
        ids, other = np.zeros((2, n), np.int64), np.full((2, n), -1)
        known, held = np.zeros((2, n), bool), np.zeros((2, n), bool)
        for k in range(2):
            ids[k, number[k]], known[k, number[k]], held[k, number[k]] = names[k], True, np.isin(names[k], asked[k])
            other[k, number[k]] = np.where(twins[k] < 0, -1, number[1 - k][twins[k]] if len(names[1 - k]) else -1)
        ends, length = _roads_of_both(n, [(number[k][find(k, u)], number[k][find(k, v)], w) for k, (u, v, w) in enumerate(roads)])
        # A component of the same nodes and roads in both graphs has the same ways: its pairs differ by 0, and are but counted. One
        # that another node is matched with is needed for that node's ways.
        part, own = least_labels(ends[:, 0], ends[:, 1], n), other == np.arange(n)
        differs = ~(known & held & own).all(axis=0)
        differs[ends[length[:, 0] != length[:, 1]]] = True
        differs[other[(other >= 0) & ~own]] = True
        left = np.isin(part, part[differs])
        sizes = np.bincount(part[~left])
        at, some = np.cumsum(left) - 1, left[ends[:, 0]]
        near: list[dict] = [{} for _ in range(int(left.sum()))]
        for (a, b), x in zip(at[ends[some]].tolist(), map(tuple, length[some].tolist()), strict=True):
            near[a][b] = near[b][a] = x
        levels = eliminate(len(near), near, _shorter_both, most_steps)
        if levels is None:
            return None
        turned = np.flatnonzero(left)[levels.nodes]
        place = np.full(n, -1)
        place[turned] = np.arange(levels.n)
        ids, known, held, other = ids[:, turned], known[:, turned], held[:, turned], other[:, turned]
        return cls(levels, ids, known, None if held[known].all() else held, np.where(other < 0, -1, place[other]), int((sizes * (sizes - 1) // 2).sum()))

    def distances(self, sources: np.ndarray, until: int | None = None) -> np.ndarray:
        """[place, graph, k]: from place sources[graph, k]; from none below 0."""
        levels = self.levels
        dist = np.full((levels.n, *sources.shape), np.inf)
        for k in range(2):
            some = np.flatnonzero(sources[k] >= 0)
            dist[sources[k, some], k, some] = 0
        for p in levels.above(np.unique(sources[sources >= 0]))[::-1].tolist():
            a, b = levels.starts[p], levels.starts[p + 1]
            ends = levels.ends[a:b]
            dist[ends] = np.minimum(dist[ends], dist[p] + self.length[a:b, :, None])
        for a, b, i, j, degree in levels.groups if until is None else levels.until(until):
            offers = dist.take(levels.ends[i:j], axis=0)
            offers += self.length[i:j, :, None]
            np.minimum(dist[a:b], offers.reshape(b - a, degree, *sources.shape).min(axis=1), out=dist[a:b])
        return dist

    def sums(self, part: int, parts: int, ways: int = 2) -> np.ndarray:
        """[graph]: the sum of differences over its pairs, as shares of its way, at most 1 and that where the other graph lacks the
        way; and how many pairs. Of `parts` that add up to all one; of the first graph alone if ways is 1."""
        levels, found = self.levels, np.zeros((ways, 2))
        if part == 0:
            found[:, 1] += self.alike
        step = max(1, min(256, SWEEP_CELLS // max(1, 2 * levels.n)))
        for places in levels.share(part, parts):
            for k in range(0, len(places), step):
                batch = places[k : k + step]
                first, until = levels.turn[batch[0]], int(levels.turn[batch[-1]]) + 1
                dist = self.distances(np.stack([batch, batch]), until)
                late = np.flatnonzero((levels.turn >= first) & (levels.turn < until))
                dist[late] = np.where(levels.turn[late, None, None] < levels.turn[batch], dist[late], np.inf)
                rows = np.flatnonzero(levels.turn < until)
                for c in range(0, len(rows), AGREE_ROWS):
                    at = rows[c : c + AGREE_ROWS]
                    both = dist.take(at, axis=0)
                    for g in range(ways):
                        counted = None
                        if not (self.plain[g, at].all() and self.plain[g, batch].all()):
                            counted = self.plain[g, at][:, None] & self.plain[g, batch]
                        found[g] += self._differences(g, at, batch, both[:, g], both[:, 1 - g], counted)
        # Pairs of a node that is not one with its match: two with the same match, or one that is not matched back.
        for g in range(ways):
            rest = np.flatnonzero(~self.plain[g])
            rest = np.array_split(rest[np.argsort(levels.turn[rest])], parts)[part]
            rows = np.flatnonzero(self.known[g])
            for k in range(0, len(rest), step):
                batch = rest[k : k + step]
                asked = np.stack([batch, self.other[g, batch]])
                dist = self.distances(asked if g == 0 else asked[::-1])
                far = dist[:, 1 - g].take(np.maximum(self.other[g, rows], 0), axis=0)
                far[self.other[g, rows] < 0] = np.inf
                counted = self.plain[g, rows][:, None] | (levels.turn[rows, None] < levels.turn[batch])
                found[g] += self._differences(g, rows, batch, dist[rows, g], far, counted)
        return found

    def _differences(self, g: int, rows: np.ndarray, columns: np.ndarray, way: np.ndarray, other: np.ndarray, counted: np.ndarray | None) -> tuple[float, int]:
        some = way < np.inf
        if counted is not None:
            some &= counted
        if self.asked is not None:
            some &= np.where(self.ids[g, rows][:, None] > self.ids[g, columns], self.asked[g, columns], self.asked[g, rows][:, None])
        n = int(np.count_nonzero(some))
        with np.errstate(invalid="ignore", divide="ignore"):
            share = other - way
            np.abs(share, out=share)
            share /= way
            np.minimum(share, 1.0, out=share)
        return float(share.sum() if n == share.size else share.sum(where=some)), n


def _roads_of_both(n: int, roads: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ends a < b < n of all roads of two graphs, once each, and their least lengths in either: infinite in one that lacks the road."""
    u, v, length = (np.concatenate([r[k] for r in roads]) for k in range(3))
    kind = np.repeat(range(2), [len(r[0]) for r in roads])
    some = u != v
    pairs, at = np.unique((np.minimum(u, v) * n + np.maximum(u, v))[some], return_inverse=True)
    least = np.full((len(pairs), 2), np.inf)
    np.minimum.at(least, (at, kind[some]), length[some])
    return np.stack(np.divmod(pairs, max(1, n)), 1), least


def _merge(places: np.ndarray, most: int = 8192) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places that differ, their rows): rows are added up by a matrix of both, or, if that had more than `most` cells, in as many
    turns as a place has rows."""
    turn = np.argsort(places, kind="stable")
    at = places[turn]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    if len(first) * len(at) <= most:
        return [(at[first], at[first][:, None] == places)]
    nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return [(at[nth == k], turn[nth == k]) for k in range(nth.max() + 1)]
