"""Nearest neighbours and their ranks by blocks of points, without a row for each pair.

Both sides are cut into blocks, every left block meets every right one in one task, and
distances within a task are array arithmetic.  A task gives, of each left point, only the
k nearest of its right block by each measure; the k nearest of all blocks are chosen
among those.  Their ranks by the other measures are counts of nearer points, which a
second meeting of the blocks adds up.  Where distances stand in the order of a number
that a matrix product gives (``metrics.Key``), that number rules out nearly all pairs with
room for its last bits, and only the others are measured; neighbours in a plane come from
a window of its first coordinate.  So what is shuffled are points times blocks and
neighbours, never pairs.  Both sides have equally many blocks once there are more points
than tasks need: each point is sent about as often as the root of the number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from planewise.conventions import ORDER_PLACES
from planewise.cutting import cut
from planewise.functions.metrics import SQUARE, Metric
from planewise.shipping import ship

#: Points of a left and of a right block, about; a right one of points with more than WIDE_FROM numbers has as much fewer.
LEFT_ROWS = RIGHT_ROWS = 200_000
WIDE_FROM = 16
#: Left points whose neighbours in many planes a task holds at most, and pairs whose distances by all measures are taken at once.
PLANES_ROWS, MEASURED_PAIRS = 32_000, 65_536
#: Left points whose distances to a right block are held at once, and right points that are measured at once (a cache's worth).
HELD_ROWS, CACHED_ROWS = 64, 2_048
#: Left and right points whose keys are held at once, and right points next to a left one along a plane's first axis that give a first bound.
KEYED_ROWS, KEYED_COLUMNS, SUMMED_COLUMNS, BESIDE = 64, 4_096, 1_024, 512
#: Right points of a leaf, and leaves next to left points that give a first bound in a plane and by the metric.
LEAF_ROWS, NEAR_LEAVES = 32, (16, 64)
#: Entries of a row that are counted at once, at most 255 times eight.
LANES = 1_024
#: Limits of one point from which on its keys are sorted to be counted, and keys of it that are sorted at once.
SORTED_FROM, SORTED_COLUMNS = 8, 8_192
#: Pairs whose count is open that look through a row of keys at once.
OPEN_PAIRS = 256
#: Squared lengths of two vectors together up to which keys are of single precision.
NEAR_ORIGIN = 8.0
MOST_PARTITIONS = 10_000
#: Two places of ``ORDER_PLACES``: distances this much apart stay apart when rounded.
APART = 2.0 * 10.0**-ORDER_PLACES

Plane = tuple[Column, Column]


def placed(points: DataFrame, vec: str, dimension: int, metric: Metric, planes: list[Plane]) -> DataFrame:
    """(object_id, s0.., x0, y0, x1, ..) of the points that have a vector: prepared entries and coordinates in each plane."""
    read = points.where(F.col(vec).isNotNull() & F.col("object_id").isNotNull()).withColumn("__p", metric.prepare(F.col(vec)))
    views = [c.cast("double").alias(f"{name}{n}") for n, plane in enumerate(planes) for name, c in zip("xy", plane, strict=True)]
    return read.select("object_id", *(F.col("__p")[k].cast("double").alias(f"s{k}") for k in range(dimension)), *views)


def _where(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the true entries; eight false ones are passed over at once."""
    if chosen.shape[1] % 8 or not chosen.flags.c_contiguous:
        return np.divmod(np.flatnonzero(chosen), chosen.shape[1])
    flat = chosen.reshape(-1)
    at = (np.flatnonzero(flat.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(at[flat[at]], chosen.shape[1])


def _counted(chosen: np.ndarray) -> np.ndarray:
    """True entries of each row of a matrix that is a multiple of ``LANES`` wide: bytes are added eight at a time, so few that none overflows."""
    words = chosen.view(np.uint64).reshape(len(chosen), -1, LANES // 8).sum(axis=2)
    return words.view(np.uint8).sum(axis=1, dtype=np.int64)


def _leaves(x: np.ndarray, size: int) -> np.ndarray:
    """The points in an order in which each ``size`` of them are a leaf of a tree: halves along the widest axis."""
    order = np.arange(len(x))
    parts = [(0, len(x))]
    while parts:
        a, e = parts.pop()
        if e - a <= size:
            continue
        own = order[a:e]
        held = x[own]
        half = -(-(e - a) // size) // 2 * size
        order[a:e] = own[np.argpartition(held[:, np.argmax(held.max(axis=0) - held.min(axis=0))], half)]
        parts += [(a, a + half), (a + half, e)]
    return order


class _Leaves:
    """Points in leaves of a tree with the box of each."""

    def __init__(self, x: np.ndarray, few: np.ndarray) -> None:
        self.turn = few[_leaves(x[few], LEAF_ROWS)]
        self.starts = np.arange(0, len(self.turn), LEAF_ROWS)
        self.low, self.high = (f.reduceat(x[self.turn], self.starts) for f in (np.minimum, np.maximum))

    def far(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Squared distances of a box to the leaves' boxes."""
        return (np.maximum(np.maximum(self.low - high, low - self.high), 0.0) ** 2).sum(axis=1)

    def of(self, leaves: np.ndarray) -> np.ndarray:
        """Places of some leaves' points, ascending."""
        at = (self.starts[leaves][:, None] + np.arange(LEAF_ROWS)).ravel()
        return at[at < len(self.turn)]


class _Keyed:
    """A left and a right block, the right one in the order of ids: distances of chosen pairs, keys of all."""

    def __init__(self, meeting: _Meeting, left: pd.DataFrame, right: pd.DataFrame) -> None:
        self.meeting, self.key, self.n = meeting, meeting.key, (len(left), len(right))
        self.left, self.right = ({c: np.ascontiguousarray(x[c].to_numpy(np.float64)) for c in meeting.numbers} for x in (left, right))
        ids, own = right["object_id"].to_numpy(), left["object_id"].to_numpy()
        self.ids = ids
        first, last = (np.searchsorted(ids, own, side) for side in ("left", "right"))
        # (left row, right place) of points with one id, by left row: they are no pairs.
        self.same = np.repeat(np.arange(len(own)), last - first), np.concatenate([np.arange(0), *(np.arange(a, b) for a, b in zip(first, last, strict=True) if b > a)]).astype(np.int64)
        a, b = (np.column_stack([x[c] for c in meeting.entries]) for x in (self.left, self.right))
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        most = float(aa.max(initial=0.0) + bb.max(initial=0.0))
        self.most = [most, *(2.0 * float(max(np.abs(side[f"{c}{v}"]).max(initial=0.0) for side in (self.left, self.right) for c in "xy")) ** 2 for v in range(meeting.views))]
        ones = lambda x: np.ones((len(x), 1))
        self.a = -a if self.key.dot else np.hstack([-2.0 * a, aa[:, None], ones(a)])
        self.b = np.ascontiguousarray((b if self.key.dot else np.hstack([b, ones(b), bb[:, None]])).T)
        # Single precision rules out as many pairs, but for vectors far from the origin.
        self.kinds = [np.float32 if m <= NEAR_ORIGIN else np.float64 for m in self.most]
        self.fast = [(self.a.astype(self.kinds[0]), self.b.astype(self.kinds[0]))]
        # Right places in the order of keys: by id, in a plane by its first axis.
        self.turns, self.sames = [np.arange(self.n[1])], [self.same]
        for v in range(meeting.views):
            turn = np.argsort(self.right[f"x{v}"], kind="stable")
            held = np.empty_like(turn)
            held[turn] = np.arange(len(turn))
            self.turns.append(turn)
            self.sames.append((self.same[0], held[self.same[1]]))
            ends = (self.left[f"x{v}"], self.left[f"y{v}"], self.right[f"x{v}"][turn], self.right[f"y{v}"][turn])
            self.fast.append(tuple(x.astype(self.kinds[1 + v]) for x in ends))

    def noise(self, measure: int, kind: type) -> float:
        """What keys of a measure can be off by at most: rounding of entries, products and their sum, and of the limit itself."""
        # A dot product is at most half of what squared lengths add up to, and rounding is by half an eps.
        share = 0.4 if measure == 0 and self.key.dot else 1.0
        return share * max(len(self.b) + 6, 14) * float(np.finfo(kind).eps) * self.most[measure] + 1e-30

    def noises(self, measure: int, kind: type, limits: np.ndarray) -> np.ndarray | float:
        """The same for keys about those of ``limits``: in a plane they are squares of differences, off by their own size and that of the entries' rounding."""
        if measure == 0:
            return self.noise(0, kind)
        eps, far = float(np.finfo(kind).eps), limits + APART
        entries = eps * math.sqrt(2.0 * self.most[measure])
        return 4.0 * (far * entries + entries * entries + 2.0 * eps * far * far) + 1e-30

    def at(self, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """(measure, pair): distances of some pairs, as ``block`` gives them."""
        out = np.empty((1 + self.meeting.views, len(rows)))
        for first in range(0, len(rows), MEASURED_PAIRS):
            now = slice(first, first + MEASURED_PAIRS)
            a, b = ({c: x[at[now]] for c, x in side.items()} for side, at in ((self.left, rows), (self.right, places)))
            out[0, now] = self.meeting.block([a[c] for c in self.meeting.entries], [b[c] for c in self.meeting.entries])
            for v in range(self.meeting.views):
                out[1 + v, now] = np.sqrt((a[f"x{v}"] - b[f"x{v}"]) ** 2 + (a[f"y{v}"] - b[f"y{v}"]) ** 2)
        return out

    def rounded(self, measure: int, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        if measure == 0:
            e = self.meeting.entries
            d = self.meeting.block([self.left[c][rows] for c in e], [self.right[c][places] for c in e])
        else:
            v = measure - 1
            d = np.sqrt((self.left[f"x{v}"][rows] - self.right[f"x{v}"][places]) ** 2 + (self.left[f"y{v}"][rows] - self.right[f"y{v}"][places]) ** 2)
        return np.round(d, ORDER_PLACES)

    def keys(self, measure: int, rows: np.ndarray, c: int, e: int) -> np.ndarray:
        """Keys of left rows, ascending, and right points from c to e in the order of ``turns``; infinite for no pairs."""
        if measure == 0:
            out = self.fast[0][0][rows] @ self.fast[0][1][:, c:e]
        else:
            ax, ay, bx, by = self.fast[measure]
            out, y = ax[rows, None] - bx[None, c:e], ay[rows, None] - by[None, c:e]
            out *= out
            y *= y
            out += y
        self._part(out, rows, c, e, measure=measure)
        return out

    def doubles(self, rows: np.ndarray, c: int, e: int) -> np.ndarray:
        """The keys by the metric in double precision."""
        out = self.a[rows] @ self.b[:, c:e]
        self._part(out, rows, c, e)
        return out

    def _part(self, keys: np.ndarray, rows: np.ndarray, c: int, e: int, fill: float = np.inf, measure: int = 0) -> None:
        r, p = self.sames[measure]
        own = slice(*np.searchsorted(r, [rows[0], rows[-1] + 1]))
        r, p = r[own], p[own]
        met = (p >= c) & (p < e)
        r, p = r[met], p[met]
        at = np.searchsorted(rows, r)
        held = rows[at] == r
        keys[at[held], p[held] - c] = fill

    def best(self, rows: np.ndarray, places: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The k first pairs of each row by rounded distance and place, with their ranks."""
        order = np.lexsort((places, d, rows))
        rows, places, d = rows[order], places[order], d[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
        few = rank <= self.meeting.k
        return rows[few], places[few], d[few], rank[few]

    def by_measure(self, measure: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left row, right place, rank) of the k nearest of each left point by the metric or in a plane.

        Left points near each other first meet the leaves that are nearest to their box,
        which bounds what they look for: in a plane they then meet the leaves within that
        bound, by the metric all points, whose keys are compared with it.
        """
        k, out, plane = self.meeting.k, [], measure > 0
        names = [f"x{measure - 1}", f"y{measure - 1}"] if plane else self.meeting.entries
        a, b = (np.column_stack([x[c] for c in names]) for x in (self.left, self.right))
        tree = _Leaves(b, self._first_copies(b))
        x = tree.turn
        ends = b[x].T if plane else np.ascontiguousarray(self.fast[0][1][:, x])
        held = np.full(self.n[1], -1)
        held[x] = np.arange(len(x))
        r, p = self.same[0], held[self.same[1]]
        r, p = r[p >= 0], p[p >= 0]
        noise = self.noise(0, self.kinds[0])

        def keys(rows: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
            """Keys (in a plane: distances) of some rows and places in the tree, ascending; infinite for no pairs."""
            if plane:
                d, e = (a[rows, c, None] - ends[c][at] for c in (0, 1))
                d *= d
                e *= e
                d += e
                np.sqrt(d, out=d)
            else:
                d = self.fast[0][0][rows] @ ends[:, at]
            starts, stops = (np.searchsorted(r, rows, side) for side in ("left", "right"))
            n = np.repeat(np.arange(len(rows)), stops - starts)
            own = p[np.concatenate([np.arange(0), *map(np.arange, starts, stops)]).astype(np.int64)] if len(n) else p[:0]
            if isinstance(at, slice):
                met, c = (own >= at.start) & (own < at.stop), own - at.start
            else:
                c = np.minimum(np.searchsorted(at, own), len(at) - 1)
                met = at[c] == own
            d[n[met], c[met]] = np.inf
            return d

        groups = _leaves(a, KEYED_ROWS)
        for first in range(0, self.n[0], KEYED_ROWS):
            rows = np.sort(groups[first : first + KEYED_ROWS])
            far = tree.far(a[rows].min(axis=0), a[rows].max(axis=0))
            limit = np.full(len(rows), np.inf)
            few = min(NEAR_LEAVES[not plane], len(far))
            d = keys(rows, tree.of(np.sort(np.argpartition(far, few - 1)[:few])))
            if d.shape[1] > k:
                worst = np.partition(d, k - 1, axis=1)[:, k - 1].astype(float)
                known = np.isfinite(worst)
                limit[known] = worst[known] + APART if plane else self.key.of(self.key.distance(worst[known] + noise) + APART) + noise
            if plane:
                parts = [tree.of(np.flatnonzero(far <= (limit.max() * (1.0 + 1e-9)) ** 2))]
            else:
                parts = [slice(c, min(c + KEYED_COLUMNS, len(x))) for c in range(0, len(x), KEYED_COLUMNS)]
            found = []
            for at in parts:
                d = keys(rows, at)
                n, c = _where(d <= limit.astype(d.dtype)[:, None])
                found.append((n, x[at][c], d[n, c]))
            n, j, d = (np.concatenate(y) for y in zip(*found, strict=True))
            told = np.isfinite(d)
            n, j, d = n[told], j[told], d[told]
            if not plane and len(n) > 2 * k * len(rows):
                # The k least keys of all parts bound more tightly.
                order = np.lexsort((d, n))
                at = np.searchsorted(n[order], np.arange(len(rows))) + k - 1
                full = np.flatnonzero((at < len(n)) & (n[order[np.minimum(at, len(n) - 1)]] == np.arange(len(rows))))
                limit[full] = np.minimum(limit[full], self.key.of(self.key.distance(d[order[at[full]]].astype(float) + noise) + APART) + noise)
                told = d <= limit.astype(d.dtype)[n]
                n, j, d = n[told], j[told], d[told]
            i = rows[n]
            i, j, _, rank = self.best(i, j, np.round(d, ORDER_PLACES) if plane else self.rounded(0, i, j))
            out.append((i, j, rank))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _first_copies(self, b: np.ndarray) -> np.ndarray:
        """Places of right points without those that have k + 1 equal ones of lower, different ids, and so are nobody's neighbours."""
        order = np.lexsort((np.arange(len(b)), *b.T))
        new = np.ones(len(b), bool)
        new[1:] = (b[order[1:]] != b[order[:-1]]).any(axis=1)
        other = new.copy()
        other[1:] |= self.ids[order[1:]] != self.ids[order[:-1]]
        nth = np.cumsum(other)
        return order[nth - nth[np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))] <= self.meeting.k]

    def before(self, measure: int, rows: np.ndarray, limits: np.ndarray, places: np.ndarray, held: np.ndarray | None = None) -> np.ndarray:
        """How many right points stand before each pair (left row, rounded distance, right place) by a measure.

        ``held`` tells of each pair whether its point is in the right block, as all are by
        default: its key is then one of those about the limit, and no reason to look for others.
        """
        total = np.zeros(len(rows), np.int64)
        if not len(rows):
            return total
        turn = self.turns[measure]
        order = np.argsort(rows, kind="stable")
        asked, starts, numbers = np.unique(rows[order], return_index=True, return_counts=True)
        many = numbers.max() > SORTED_FROM
        # Of many limits some are near any key of single precision, and each of those would be looked for.
        kind = np.float64 if many and measure == 0 else self.kinds[measure]
        key, noise = self.key if measure == 0 else SQUARE, self.noises(measure, kind, limits)
        low = np.where(limits > APART, key.of(np.maximum(limits - APART, 0.0)) - noise, -np.inf).astype(kind)
        high = (key.of(limits + APART) + noise).astype(kind)
        own = places
        if measure:
            own = np.empty(len(turn) + 1, np.int64)
            own[turn], own[-1] = np.arange(len(turn)), -1
            own = own[places]
        own = own if held is None else np.where(held, own, -1)
        wide = SORTED_COLUMNS if many else KEYED_COLUMNS
        if measure:
            x, y = self.left[f"x{measure - 1}"][asked], self.right[f"x{measure - 1}"][turn]
            reach, along = np.maximum.reduceat(limits[order], starts) + APART, np.argsort(x, kind="stable")
        for first in range(0, len(asked), KEYED_ROWS):
            at = slice(first, first + KEYED_ROWS)
            begin, end = 0, self.n[1]
            if measure:
                # Left points side by side in the plane meet the right ones within reach along its first axis.
                at = np.sort(along[at])
                begin, end = np.searchsorted(y, (x[at] - reach[at]).min()), np.searchsorted(y, (x[at] + reach[at]).max(), "right")
            part, start, count = asked[at], starts[at], numbers[at]
            # Pairs of each row side by side; rows with fewer ones end with limits that nothing is below.
            slots = np.arange(count.max(initial=0))
            filled = slots[None, :] < count[:, None]
            pairs = order[np.where(filled, start[:, None] + slots[None, :], 0)]
            lows, highs = (np.where(filled, z[pairs], -np.inf).astype(kind) for z in (low, high))
            mine = own[pairs]
            if len(slots) > SORTED_FROM:
                # Up to a limit are the keys below the next number.
                limits_of = np.hstack([lows, np.nextafter(highs, np.array(np.inf, kind))])
                turned = np.argsort(limits_of, axis=1)
                limits_of, back = np.take_along_axis(limits_of, turned, axis=1), np.argsort(turned, axis=1)
            for c in range(begin, end, wide):
                e = min(c + wide, end)
                keys = self.doubles(part, c, e) if many and measure == 0 else self.keys(measure, part, c, e)
                if len(slots) > SORTED_FROM:
                    # Rows next to each other and limits in order: the search stays in a cache.
                    keyed = np.sort(keys, axis=1)
                    both = np.array([u.searchsorted(w) for u, w in zip(keyed, limits_of, strict=True)])
                    sure, most = np.take_along_axis(both, back, axis=1).reshape(len(part), 2, -1).swapaxes(0, 1)
                else:
                    under = np.zeros((len(part), -(-wide // LANES) * LANES), bool)
                    told = under[:, : e - c]
                    sure, most = (np.column_stack([_counted(under) for t in slots if test(keys, z[:, t, None], out=told) is told]) for test, z in ((np.less, lows), (np.less_equal, highs)))
                total[pairs[filled]] += sure[filled]
                opened = np.nonzero((most - sure > ((mine >= c) & (mine < e))) & filled)
                for now in range(0, len(opened[0]), OPEN_PAIRS):
                    n, t = (x[now : now + OPEN_PAIRS] for x in opened)
                    some = keys[n]
                    told = some >= lows[n, t, None]
                    told &= some <= highs[n, t, None]
                    open_, near = _where(told)
                    real = np.isfinite(some[open_, near])
                    pair, place = pairs[n, t][open_[real]], turn[near[real] + c]
                    d = self.rounded(measure, rows[pair], place)
                    np.add.at(total, pair[(d < limits[pair]) | (d == limits[pair]) & (place < places[pair])], 1)
        return total

    def dense(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The first of some left and of some right points with their distances by the metric and in plane 0, 0 for no pairs; small ones by the metric are measured pair by pair."""
        small = float(self.key.of(np.float64(1e-4)) + self.noise(0, np.float64))
        x0, y0, x1, y1 = (side[f"{c}0"] for side in (self.left, self.right) for c in "xy")
        for first in range(0, self.n[0], KEYED_ROWS):
            rows = np.arange(first, min(first + KEYED_ROWS, self.n[0]))
            for c in range(0, self.n[1], SUMMED_COLUMNS):
                e = min(c + SUMMED_COLUMNS, self.n[1])
                keys, l, y = self.a[rows] @ self.b[:, c:e], x0[rows, None] - x1[None, c:e], y0[rows, None] - y1[None, c:e]
                l *= l
                y *= y
                l += y
                r, p = _where(keys <= small)
                h = self.key.distance(keys)
                if len(r):
                    x = self.meeting.entries
                    h[r, p] = self.meeting.block([self.left[n][rows[r]] for n in x], [self.right[n][p + c] for n in x])
                np.sqrt(l, out=l)
                for m in (h, l):
                    self._part(m, rows, c, e, 0.0)
                yield first, c, h, l


class _Meeting:
    """What a task does with a left and a right block: all measures are the metric and then the distances in the planes."""

    def __init__(self, metric: Metric, dimension: int, views: int, k: int) -> None:
        self.block, self.entries, self.views, self.k = metric.block, [f"s{d}" for d in range(dimension)], views, k
        self.numbers = [*self.entries, *(f"{c}{v}" for v in range(views) for c in "xy")]
        self.key = metric.key

    def keyed(self, left: pd.DataFrame, right: pd.DataFrame) -> _Keyed | None:
        """The two blocks by keys, if the metric has one and all numbers are finite."""
        if self.key is None or not all(np.isfinite(x[self.numbers].to_numpy(np.float64)).all() for x in (left, right)):
            return None
        return _Keyed(self, left, right)

    def measures(self, left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        """Rounded distances, (measure, left, right); none of a point to one of its own id."""
        out = np.empty((1 + self.views, len(left), len(right)))
        a = {c: left[c].to_numpy(np.float64)[:, None] for c in self.numbers}
        whole = {c: right[c].to_numpy(np.float64)[None, :] for c in self.numbers}
        for first in range(0, len(right), CACHED_ROWS):
            at = slice(first, first + CACHED_ROWS)
            b = {c: x[:, at] for c, x in whole.items()}
            out[0, :, at] = self.block([a[c] for c in self.entries], [b[c] for c in self.entries])
            for v in range(self.views):
                out[1 + v, :, at] = np.sqrt((a[f"x{v}"] - b[f"x{v}"]) ** 2 + (a[f"y{v}"] - b[f"y{v}"]) ** 2)
        out[:, left["object_id"].to_numpy()[:, None] == right["object_id"].to_numpy()[None, :]] = np.inf
        return out

    def nearest(self, left: pd.DataFrame, right: pd.DataFrame, ranks: tuple[int, ...], sums: bool) -> pd.DataFrame:
        """Of each left point the neighbours by any measure, with all distances and their ranks within the block.

        Ranks beyond k are right for the measures in ``ranks`` and k + 1 for the others.
        """
        right = right.sort_values("object_id")  # places order equal distances as ids do
        if keyed := self.keyed(left, right):
            return self._nearest_keyed(keyed, left, right, ranks, sums)
        ids, totals = right["object_id"].to_numpy(), np.zeros(3)
        found: list[tuple[np.ndarray, ...]] = []  # (left ids, right places, distances, ranks) of each left point
        k = min(self.k, len(right))
        for first in range(0, len(left), HELD_ROWS):
            part = left.iloc[first : first + HELD_ROWS]
            exact = self.measures(part, right)
            if sums and self.views:
                h, l = (np.where(np.isfinite(m), m, 0.0) for m in exact[:2])
                totals += [(h * h).sum(), (l * l).sum(), (h * l).sum()]
            d = np.round(exact, ORDER_PLACES)
            bound = np.partition(d, k - 1, axis=2)[:, :, k - 1]
            for r, i in enumerate(part["object_id"]):
                own, tops = d[:, r], []
                for m in range(len(own)):
                    near = np.flatnonzero(own[m] <= bound[m, r])
                    near = near[np.argsort(own[m][near], kind="stable")][:k]
                    tops.append(near[np.isfinite(own[m][near])])
                at = np.unique(np.concatenate(tops))
                if not len(at):
                    continue
                n = np.full((len(own), len(at)), self.k + 1)
                for m, near in enumerate(tops):
                    n[m, np.searchsorted(at, near)] = np.arange(1, len(near) + 1)
                for m in ranks:
                    open_ = np.flatnonzero(n[m] > self.k)
                    mine = own[m][at[open_], None]
                    n[m, open_] = ((own[m] < mine) | (own[m] == mine) & (np.arange(len(ids)) < at[open_, None])).sum(axis=1) + 1
                found.append((np.full(len(at), i, object), at, exact[:, r, at], n))
        m = 1 + self.views
        found = found or [(np.empty(0, object), np.empty(0, np.int64), np.empty((m, 0)), np.empty((m, 0)))]
        i, at, far, n = (np.concatenate(x, axis=-1) for x in zip(*found, strict=True))
        return self._table(i, ids[at], far, n, totals, sums)

    def _nearest_keyed(self, keyed: _Keyed, left: pd.DataFrame, right: pd.DataFrame, ranks: tuple[int, ...], sums: bool) -> pd.DataFrame:
        totals, tops = np.zeros(3), [keyed.by_measure(m) for m in range(1 + self.views)]
        if sums and self.views:
            for _, _, h, l in keyed.dense():
                h, l = h.ravel(), l.ravel()
                totals += [h @ h, l @ l, h @ l]
        code = [r * len(right) + p for r, p, _ in tops]
        pairs = np.unique(np.concatenate(code))
        rows, at = pairs // len(right), pairs % len(right)
        far = keyed.at(rows, at)
        n = np.full((1 + self.views, len(pairs)), self.k + 1)
        for m, (own, (_, _, rank)) in enumerate(zip(code, tops, strict=True)):
            n[m, np.searchsorted(pairs, own)] = rank
        for m in ranks:
            open_ = np.flatnonzero(n[m] > self.k)
            n[m, open_] = keyed.before(m, rows[open_], np.round(far[m, open_], ORDER_PLACES), at[open_]) + 1
        return self._table(left["object_id"].to_numpy()[rows], right["object_id"].to_numpy()[at], far, n, totals, sums)

    def _table(self, i: np.ndarray, j: np.ndarray, far: np.ndarray, n: np.ndarray, totals: np.ndarray, sums: bool) -> pd.DataFrame:
        more = int(sums and self.views > 0)  # one row for the sums, without ids
        tail = lambda x, fill: np.concatenate([x, [fill] * more])
        columns = {"i": tail(i, None), "j": tail(j, None), **{f"d{k}": tail(x, np.nan) for k, x in enumerate(far)}, **{f"r{k}": tail(x.astype(float), np.nan) for k, x in enumerate(n)}}
        columns |= {c: tail(np.full(len(i), np.nan), x) for c, x in zip(("hh", "ll", "hl"), totals, strict=True)}
        return pd.DataFrame(columns)

    def columns(self) -> list[str]:
        m = range(1 + self.views)
        return ["i", "j", *(f"d{k}" for k in m), *(f"r{k}" for k in m), "hh", "ll", "hl"]

    def schema(self) -> str:
        m = range(1 + self.views)
        return ", ".join(["i string", "j string", *(f"d{k} double" for k in m), *(f"r{k} long" for k in m), "hh double", "ll double", "hl double"])

    def nearer(self, pairs: pd.DataFrame, right: pd.DataFrame, ranks: tuple[int, ...]) -> pd.DataFrame:
        """How many points of the right block stand before each pair's second point, by each measure in ``ranks`` that its rank is open by; 0 for others."""
        right = right.sort_values("object_id")
        ids = right["object_id"].to_numpy()
        place = np.searchsorted(ids, pairs["j"].to_numpy())
        held = ids[np.minimum(place, len(ids) - 1)] == pairs["j"].to_numpy()
        row, left = pd.factorize(pairs["object_id"])[0], pairs.drop_duplicates("object_id")
        keyed, counts = self.keyed(left, right), np.zeros((1 + self.views, len(pairs)), np.int64)
        limits = [np.round(pairs[f"d{m}"].to_numpy(np.float64), ORDER_PLACES) for m in range(1 + self.views)]
        asked = {m: np.flatnonzero(pairs[f"r{m}"].to_numpy() > self.k) for m in ranks}
        if keyed:
            for m, at in asked.items():
                counts[m, at] = keyed.before(m, row[at], limits[m][at], place[at], held[at])
        else:
            for t, own in enumerate(np.split(np.argsort(row, kind="stable"), np.cumsum(np.bincount(row))[:-1])):
                d = np.round(self.measures(left.iloc[t : t + 1], right), ORDER_PLACES)[:, 0]
                for m, at in asked.items():
                    for p in np.intersect1d(own, at):
                        counts[m, p] = (d[m] < limits[m][p]).sum() + (d[m][: place[p]] == limits[m][p]).sum()
        return pd.DataFrame({"i": pairs["object_id"], "j": pairs["j"], **{f"c{m}": counts[m] for m in range(1 + self.views)}})


def shape(n: int, cores: int, numbers: int = 1) -> tuple[int, int]:
    """Numbers of left and of right blocks for ``n`` points of so many numbers; few points have more left blocks, so that all cores work."""
    right = RIGHT_ROWS * WIDE_FROM / max(WIDE_FROM, numbers)
    return max(min(2 * cores, math.ceil(n / HELD_ROWS)), math.ceil(n / LEFT_ROWS), 1), max(1, math.ceil(n / right))


def _blocks(points: DataFrame, n: int, own: str, other: str, others: int) -> GroupedData:
    """Points by their block and each block of the other side.

    The number of partitions is given: points are few bytes for the work they make, and
    adaptive execution, which goes by bytes, would put all blocks into one task.
    """
    numbered = points.withColumn(own, F.pmod(F.xxhash64("object_id"), F.lit(n)).cast("int"))
    met = numbered.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    meetings, cores = n * others, points.sparkSession.sparkContext.defaultParallelism
    # Few meetings go to many partitions: by hash two of them would often share one while cores are idle.
    return met.repartition(min(max(2 * meetings, min(16 * meetings, 32 * cores)), MOST_PARTITIONS), "__l", "__r").groupBy("__l", "__r")


def neighbours(points: DataFrame, dimension: int, metric: Metric, views: int, k: int, target: str | None = None, ranks: tuple[int, ...] | None = None, sums: bool = False, count: int | None = None) -> DataFrame:
    """(i, j, d0.., r0.., hh, ll, hl) of the pairs of ``placed`` points that are among the k nearest by any measure.

    Measure 0 is the metric, the others are the planes; ``d`` are distances and ``r``
    ranks (from 1, by distance to ``ORDER_PLACES``, then id).  ``ranks`` names the
    measures whose ranks beyond k are wanted, all by default; those of the others may be
    more than k by any number.  ``target`` restricts ``i``.  With
    ``sums`` some rows without ids hold sums over all pairs of squares and products of
    the metric and plane 0.
    """
    if k < 1:
        raise ValueError("k must be 1 at least")
    if metric.block is None:
        raise ValueError(f"{metric.id} has no form for blocks")
    ship(points.sparkSession)
    ranks = tuple(range(1 + views)) if ranks is None else ranks
    meeting = _Meeting(metric, dimension, views, k)
    n = points.count() if count is None else count
    lefts = points if target is None else points.where(F.col("object_id") == target)
    cores = points.sparkSession.sparkContext.defaultParallelism
    nl, nr = shape(n, cores, len(meeting.numbers))
    nl = nl if target is None else 1
    again = points.select(*(F.col(c).alias(c) for c in points.columns))  # columns of its own: both sides are the same points
    right = _blocks(again, nr, "__r", "__l", nl)
    met = _blocks(lefts, nl, "__l", "__r", nr).cogroup(right)
    empty = pd.DataFrame(columns=meeting.columns())
    first = met.applyInPandas(lambda a, b: meeting.nearest(a, b, ranks if nr == 1 else (), sums) if len(a) and len(b) else empty, meeting.schema())
    if nr == 1:
        return first
    if ranks or sums:
        first = cut(first)  # read more than once: without this each reader would let all blocks meet again
    measured = [f"r{m}" for m in range(1 + views)]
    found = first.where(F.col("i").isNotNull())
    for m, r in enumerate(measured):
        found = found.withColumn(r, F.row_number().over(Window.partitionBy("i").orderBy(F.round(f"d{m}", ORDER_PLACES), "j")).cast("long"))
    near = found.where(reduce(lambda a, b: a | b, (F.col(r) <= k for r in measured)))
    if ranks:
        held = near.select(F.col("i").alias("object_id"), "j", *(f"{c}{m}" for m in range(1 + views) for c in "dr")).where(reduce(lambda a, b: a | b, (F.col(f"r{m}") > k for m in ranks))).join(points, "object_id")
        back = _blocks(held, nl, "__l", "__r", nr).cogroup(right)
        none = pd.DataFrame(columns=["i", "j", *(f"c{m}" for m in range(1 + views))])
        counted = back.applyInPandas(lambda a, b: meeting.nearer(a, b, ranks) if len(a) and len(b) else none, ", ".join(["i string", "j string", *(f"c{m} long" for m in range(1 + views))]))
        whole = counted.groupBy("i", "j").agg(*(F.sum(f"c{m}").alias(f"c{m}") for m in ranks))
        for_m = lambda m: F.when(F.col(f"r{m}") > k, F.coalesce(f"c{m}", F.lit(0)) + 1).otherwise(F.col(f"r{m}")).alias(f"r{m}")
        own = {f"r{m}": for_m(m) for m in ranks}
        near = near.join(whole, ["i", "j"], "left").select(*(own.get(c, F.col(c)) for c in meeting.columns()))
    return near.unionByName(first.where(F.col("i").isNull())) if sums else near


class _Planes:
    """Ranks by the metric of the neighbours in many planes.

    Planes are bases over the prepared entries; a task makes their coordinates itself,
    one plane at a time, and holds of each left point the k nearest in each plane.
    """

    def __init__(self, metric: Metric, dimension: int, planes: list[np.ndarray], k: int) -> None:
        self.meeting, self.seeing = _Meeting(metric, dimension, 0, k), _Meeting(metric, dimension, 1, k)
        self.planes, self.k = planes, k

    def _placed(self, points: pd.DataFrame, plane: np.ndarray) -> pd.DataFrame:
        """The points with coordinates in a plane, whose terms are added in the order of the entries."""
        axes = [[points[f"s{e}"].to_numpy(np.float64) * float(w) for e, w in enumerate(axis) if w] for axis in plane.T]
        x, y = (reduce(np.add, terms) if terms else np.zeros(len(points)) for terms in axes)
        return points.assign(x0=x, y0=y)

    def _near(self, left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each plane (left rows, right places) of the k nearest and (metric, plane) their rounded distances; the right points are in the order of ids."""
        for plane in self.planes:
            a, b = self._placed(left, plane), self._placed(right, plane)
            if keyed := self.seeing.keyed(a, b):
                rows, at, _ = keyed.by_measure(1)
                yield rows, at, np.round(keyed.at(rows, at), ORDER_PLACES)
                continue
            found = []
            for first in range(0, len(a), HELD_ROWS):
                d = np.round(self.seeing.measures(a.iloc[first : first + HELD_ROWS], b), ORDER_PLACES)
                at = np.argsort(d[1], axis=1, kind="stable")[:, : self.k]
                rows = np.repeat(np.arange(len(at)), at.shape[1])
                at = at.ravel()
                told = np.isfinite(d[1, rows, at])
                found.append((rows[told] + first, at[told], d[:, rows[told], at[told]]))
            yield tuple(np.concatenate(x, axis=-1) for x in zip(*found, strict=True))

    def _before(self, left: pd.DataFrame, right: pd.DataFrame, rows: np.ndarray, limits: np.ndarray, places: np.ndarray, held: np.ndarray | None = None) -> np.ndarray:
        """How many right points stand before each pair by the metric."""
        if keyed := self.meeting.keyed(left, right):
            return keyed.before(0, rows, limits, places, held)
        out, order = np.zeros(len(rows), np.int64), np.argsort(rows, kind="stable")
        starts = np.searchsorted(rows[order], np.arange(len(left) + 1))
        for t in np.unique(rows):
            d = np.round(self.meeting.measures(left.iloc[t : t + 1], right), ORDER_PLACES)[0, 0]
            for p in order[starts[t] : starts[t + 1]]:
                out[p] = (d < limits[p]).sum() + (d[: places[p]] == limits[p]).sum()
        return out

    def lost(self, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """For each plane how far beyond k the ranks of its neighbours are together, if the right block holds all points."""
        right = right.sort_values("object_id")
        code, far, sizes = [], [], []
        for rows, at, d in self._near(left, right):
            code.append(rows * len(right) + at)
            far.append(d[0])
            sizes.append(len(rows))
        pairs, first, held = np.unique(np.concatenate(code), return_index=True, return_inverse=True)
        rank = self._before(left, right, pairs // len(right), np.concatenate(far)[first], pairs % len(right)) + 1
        beyond = np.split(np.maximum(rank - self.k, 0)[held], np.cumsum(sizes)[:-1])
        return pd.DataFrame({"v": np.arange(len(beyond)), "lost": [int(x.sum()) for x in beyond]})

    def seen(self, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """(i, v, j, d, l): the k nearest of the right block in each plane, with distances by the metric (d) and in the plane."""
        right = right.sort_values("object_id")
        own, ids = left["object_id"].to_numpy(), right["object_id"].to_numpy()
        parts = [pd.DataFrame({"i": own[rows], "v": v, "j": ids[at], "d": d[0], "l": d[1]}) for v, (rows, at, d) in enumerate(self._near(left, right))]
        return pd.concat(parts)

    def counted(self, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """(i, v, c): how many of the right points stand before each of the pairs that a left point brings as arrays (v, j, d)."""
        right = right.sort_values("object_id")
        sizes = left["j"].map(len).to_numpy()
        rows = np.repeat(np.arange(len(left)), sizes)
        ids, others = right["object_id"].to_numpy(), np.concatenate(left["j"].to_numpy())
        places = np.searchsorted(ids, others)
        held = ids[np.minimum(places, len(ids) - 1)] == others
        counts = self._before(left, right, rows, np.concatenate(left["d"].to_numpy()).astype(float), places, held)
        return pd.DataFrame({"i": left["object_id"].to_numpy(), "v": left["v"].to_numpy(), "c": np.split(counts, np.cumsum(sizes)[:-1])})


def rank_penalties(points: DataFrame, dimension: int, metric: Metric, planes: list[np.ndarray], k: int, count: int) -> list[int]:
    """For each plane, over the k nearest in it of all points, by how much their ranks by the metric are beyond k together.

    ``points`` are ``placed`` without planes.  While one right block holds all points, a
    task gives a number for each plane; beyond that neighbours of all blocks are merged
    and their ranks are counts that a second meeting adds up.
    """
    spark = points.sparkSession
    ship(spark)
    task, cores = _Planes(metric, dimension, planes, k), spark.sparkContext.defaultParallelism
    nl, nr = shape(count, cores, dimension)
    nl = max(nl, math.ceil(count / PLANES_ROWS))
    again = points.select(*(F.col(c).alias(c) for c in points.columns))
    right = _blocks(again, nr, "__r", "__l", nl)

    def run(lefts: DataFrame, what: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        empty = pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
        return _blocks(lefts, nl, "__l", "__r", nr).cogroup(right).applyInPandas(lambda a, b: what(a, b) if len(a) and len(b) else empty, schema)

    if nr == 1:
        lost = run(points, task.lost, "v int, lost long")
    else:
        first = run(points, task.seen, "i string, v int, j string, d double, l double").repartition(min(max(2 * cores, 4 * nl * nr), MOST_PARTITIONS), "i")
        rank = F.row_number().over(Window.partitionBy("i", "v").orderBy("l", "j"))
        near = first.withColumn("n", rank).where(F.col("n") <= k).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("v", "j", "d"))).alias("near"))
        asked = points.join(near.withColumnRenamed("i", "object_id"), "object_id").select(*points.columns, *(F.col("near")[c].alias(c) for c in "vjd"))
        parts = run(asked, task.counted, "i string, v array<int>, c array<long>").groupBy("i").agg(F.first("v").alias("v"), F.collect_list("c").alias("c"))
        total = F.transform("v", lambda _, n: F.aggregate(F.transform("c", lambda x: x[n]), F.lit(0).cast("long"), lambda a, b: a + b))
        rows = parts.select(F.explode(F.arrays_zip(F.col("v").alias("v"), total.alias("before"))).alias("at"))
        lost = rows.select(F.col("at.v").alias("v"), F.greatest(F.col("at.before") + 1 - k, F.lit(0)).alias("lost"))
    found = {r["v"]: int(r["lost"]) for r in lost.groupBy("v").agg(F.sum("lost").alias("lost")).collect()}
    return [found.get(v, 0) for v in range(len(planes))]


class _Sums:
    """Sums of a left and a right block over all pairs of different points: by the metric (h) and in the plane (l)."""

    def __init__(self, metric: Metric, dimension: int) -> None:
        self.meeting = _Meeting(metric, dimension, 1, 1)

    def parts(self, left: pd.DataFrame, right: pd.DataFrame) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """The first of some left and of some right points, which are in the order of ids, with their distances, 0 for no pairs."""
        if keyed := self.meeting.keyed(left, right):
            yield from keyed.dense()
            return
        for first in range(0, len(left), HELD_ROWS):
            h, l = self.meeting.measures(left.iloc[first : first + HELD_ROWS], right)
            pair = np.isfinite(h)
            yield first, 0, np.where(pair, h, 0.0), np.where(pair, l, 0.0)

    def squares(self, left: pd.DataFrame, right: pd.DataFrame, twice: bool = False) -> pd.DataFrame:
        """Sums of squares and products; ``twice`` for blocks that meet once for both their orders."""
        total = np.zeros(3)
        for _, _, h, l in self.parts(left, right.sort_values("object_id")):
            h, l = h.ravel(), l.ravel()
            total += [h @ h, l @ l, h @ l]
        return pd.DataFrame([total * (1 + twice)], columns=["hh", "ll", "hl"])

    def means(self, left: pd.DataFrame, right: pd.DataFrame, twice: bool = False) -> pd.DataFrame:
        """Sums and numbers of the positive distances; ``twice`` as for ``squares``."""
        total = np.zeros(4)
        for _, _, h, l in self.parts(left, right.sort_values("object_id")):
            total += [h.sum(), np.count_nonzero(h > 0), l.sum(), np.count_nonzero(l > 0)]
        return pd.DataFrame([total * (1 + twice)], columns=["h", "nh", "l", "nl"])

    def ratios(self, left: pd.DataFrame, right: pd.DataFrame, least: float, twice: bool = False) -> pd.DataFrame:
        """For each left point, with ``twice`` also for each right one, the sum and number of l / h over pairs with h above ``least``."""
        right = right.sort_values("object_id")
        sides = [left, right][: 1 + twice]
        sums, counts = ([np.zeros(len(x), kind) for x in sides] for kind in (float, np.int64))
        for first, c, h, l in self.parts(left, right):
            told = h > least
            h[~told] = np.inf
            np.divide(l, h, out=l)
            for axis, at in enumerate((slice(first, first + h.shape[0]), slice(c, c + h.shape[1]))[: 1 + twice]):
                sums[axis][at] += l.sum(axis=1 - axis)
                counts[axis][at] += told.sum(axis=1 - axis)
        return pd.DataFrame({"i": np.concatenate([x["object_id"].to_numpy() for x in sides]), "ratio": np.concatenate(sums), "n": np.concatenate(counts)})


def square_sums(points: DataFrame, dimension: int, metric: Metric, count: int) -> DataFrame:
    """(hh, ll, hl), a row for each two blocks: sums over all ordered pairs of ``placed`` points of squares and products of the metric and plane 0."""
    return _once(points, count, _Sums(metric, dimension).squares, "hh double, ll double, hl double")


def mean_distances(points: DataFrame, dimension: int, metric: Metric, count: int) -> tuple[float, float]:
    """Means of the positive distances by the metric and in plane 0 of ``placed`` points; 1 if there are none."""
    parts = _once(points, count, _Sums(metric, dimension).means, "h double, nh double, l double, nl double")
    s = parts.agg(*(F.sum(c).alias(c) for c in ("h", "nh", "l", "nl"))).first()
    return tuple(s[c] / s[n] if s[n] else 1.0 for c, n in (("h", "nh"), ("l", "nl")))


def ratio_sums(points: DataFrame, dimension: int, metric: Metric, count: int, least: float) -> DataFrame:
    """(i, ratio, n): sum and number of the ratios of plane to metric distance of each point, over pairs further than ``least`` by the metric."""
    sums = _Sums(metric, dimension)
    parts = _once(points, count, lambda a, b, twice: sums.ratios(a, b, least, twice), "i string, ratio double, n long")
    return parts.groupBy("i").agg(F.sum("ratio").alias("ratio"), F.sum("n").alias("n"))


def _once(points: DataFrame, count: int, task: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str) -> DataFrame:
    """What ``task`` gives of every two blocks, which meet once: distances are the same both ways. It is told whether the blocks differ."""
    ship(points.sparkSession)
    n = max(min(math.ceil(math.sqrt(8 * points.sparkSession.sparkContext.defaultParallelism)), math.ceil(count / HELD_ROWS)), math.ceil(count / RIGHT_ROWS), 1)
    own = F.pmod(F.xxhash64("object_id"), F.lit(n)).cast("int")
    again = points.select(*(F.col(c).alias(c) for c in points.columns))
    a = points.withColumn("__l", own).withColumn("__r", F.explode(F.sequence(F.col("__l"), F.lit(n - 1))))
    b = again.withColumn("__r", own).withColumn("__l", F.explode(F.sequence(F.lit(0), F.col("__r"))))
    left, right = (x.repartition(min(n * (n + 1), MOST_PARTITIONS), "__l", "__r").groupBy("__l", "__r") for x in (a, b))
    empty = pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
    return left.cogroup(right).applyInPandas(lambda key, a, b: task(a, b, bool(key[0] != key[1])) if len(a) and len(b) else empty, schema)
