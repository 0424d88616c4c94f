"""First row of a large table whose ranges hold values: boxes that hold points, in numpy over Arrow batches.

Points are dealt to the cells of a grid over their first two dimensions. A box goes to the cells it meets, except those
that a box of a lower index is known to fill. Within a cell boxes come by index, and a tree over the points that no
earlier box holds takes them: a node that a box fills is not entered further, so pairs of boxes and points are compared in
the tree's leaves only. Where boxes are many, those of the lowest indices come by themselves first: what points they leave
is known by cells and by narrow strips of each dimension, and a later box that can hold none of these is not dealt at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of the grid for one dimension, and for each of the first two where there are more.
BINS_OF_ONE, BINS_OF_TWO = 256, 32
#: Points of a cell that one task takes, points of a leaf, boxes taken at once, pairs of boxes and cells looked at at once.
CELL_POINTS, LEAF_POINTS, CHUNK, PAIRS = 200_000, 8, 1 << 14, 1 << 20
#: From so many boxes that are not empty and meet the span of all points on, this share of them comes first; strips of a dimension.
MANY_BOXES, EARLY_SHARE, STRIPS = 2_000_000, 1 / 64, 4096
NONE, LOWEST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def ordered(x: np.ndarray) -> np.ndarray:
    """Integers in the order of doubles as Spark has it: NaN is above all others, 0.0 and -0.0 are one."""
    bits = np.where(np.isnan(x), np.nan, x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & NONE)


def doubles(k: np.ndarray) -> np.ndarray:
    return (k ^ ((k >> 63) & NONE)).view(np.float64)


class Tree:
    """Points of a cell and the least index of a box that holds each; boxes come in ascending order of their index."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.first = x, np.full(x.shape[1], NONE)
        self._grow(np.arange(x.shape[1]))

    def _grow(self, open_: np.ndarray) -> None:
        self.at, n = open_, len(open_)
        self.levels = max(0, (n // LEAF_POINTS).bit_length() - 1) if n else 0
        for level in range(self.levels):
            half = np.repeat(np.arange(1 << level), np.diff(self._starts(level, n)))
            self.at = self.at[np.lexsort((self.x[level % len(self.x)][self.at], half))]
        self.left = n
        self._bound()

    @staticmethod
    def _starts(level: int, n: int) -> np.ndarray:
        return (n * np.arange((1 << level) + 1, dtype=np.int64)) >> level

    def _bound(self) -> None:
        """The spans of each node's points that no box holds yet."""
        n, gone = len(self.at), self.first[self.at] != NONE
        starts = self._starts(self.levels, n)[:-1]
        low = np.array([np.minimum.reduceat(np.where(gone, NONE, x[self.at]), starts) for x in self.x])
        high = np.array([np.maximum.reduceat(np.where(gone, LOWEST, x[self.at]), starts) for x in self.x])
        self.spans = [(low, high)]
        for _ in range(self.levels):
            low, high = np.minimum(low[:, ::2], low[:, 1::2]), np.maximum(high[:, ::2], high[:, 1::2])
            self.spans.insert(0, (low, high))

    def take(self, lo: np.ndarray, hi: np.ndarray, index: np.ndarray) -> None:
        if not self.left:
            return
        box, node, n = np.arange(len(index)), np.zeros(len(index), np.int64), len(self.at)
        known = np.full(1, NONE)
        for level, (low, high) in enumerate(self.spans):
            if level:
                box, node, known = np.repeat(box, 2), np.repeat(2 * node, 2), np.repeat(known, 2)
                node[1::2] += 1
            meets, fills = np.ones(len(box), bool), np.ones(len(box), bool)
            for d in range(len(lo)):
                a, b = low[d][node], high[d][node]
                meets &= (lo[d][box] <= b) & (hi[d][box] >= a)
                fills &= (lo[d][box] <= a) & (hi[d][box] >= b)
            np.minimum.at(known, node[fills], index[box[fills]])
            more = meets & ~fills
            more &= index[box] < known[node]
            box, node = box[more], node[more]
        starts = self._starts(self.levels, n)
        found = np.repeat(known, np.diff(starts))
        sizes = starts[node + 1] - starts[node]
        box, place = np.repeat(box, sizes), np.repeat(starts[node], sizes) + _counts(sizes)
        held = np.ones(len(box), bool)
        for d, x in enumerate(self.x):
            own = x[self.at[place]]
            held &= (lo[d][box] <= own) & (own <= hi[d][box])
        np.minimum.at(found, place[held], index[box[held]])
        self.first[self.at] = np.minimum(self.first[self.at], found)
        left = self.at[self.first[self.at] == NONE]
        if len(left) < self.left:
            self.left = len(left)
            if self.left and 2 * self.left < n:
                self._grow(left)
            elif self.left:
                self._bound()


def _counts(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each of the sizes, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Strips:
    """Strips of the first dimensions with the spans of the points in each that no early box holds."""

    def __init__(self, cuts: list[np.ndarray], dims: int) -> None:
        self.cuts = cuts
        self.low = [np.full((dims, len(c) + 1), NONE) for c in cuts]
        self.high = [np.full((dims, len(c) + 1), LOWEST) for c in cuts]

    def tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each dimension, the spans of 1, 2, 4 ... strips from each strip on."""
        out = []
        for spans in zip(self.low, self.high, strict=True):
            both = []
            for least, x in zip((np.minimum, np.maximum), spans, strict=True):
                levels = [x]
                while (k := 1 << len(levels)) <= x.shape[1]:
                    last, k = levels[-1].copy(), k // 2
                    last[:, :-k] = least(last[:, :-k], last[:, k:])
                    levels.append(last)
                both.append(np.array(levels))
            out.append((both[0], both[1]))
        return out

    def some(self, tables: list[tuple[np.ndarray, np.ndarray]], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The boxes that may hold a point: places in ascending order."""
        left = np.arange(lo.shape[1])
        for d, (lows, highs) in enumerate(tables):
            a, b = np.searchsorted(self.cuts[d], lo[d, left]), np.searchsorted(self.cuts[d], hi[d, left])
            level = np.frexp(b - a + 1)[1] - 1
            b -= (1 << level) - 1
            meets = np.ones(len(left), bool)
            for e in range(len(lo)):
                meets &= np.minimum(lows[level, e, a], lows[level, e, b]) <= hi[e, left]
                meets &= np.maximum(highs[level, e, a], highs[level, e, b]) >= lo[e, left]
            left = left[meets]
        return left


def _finer(cuts: np.ndarray, low: float, high: float) -> np.ndarray:
    """Cuts into STRIPS or so, evenly between the given ones."""
    edges = np.array([low, *cuts, high], float)
    with np.errstate(invalid="ignore"):
        fine = np.interp(np.linspace(0, len(edges) - 1, STRIPS + 1), np.arange(len(edges)), edges)
    return np.unique(ordered(fine[np.isfinite(fine)]))


class Grid:
    """The cells that hold points: place on the grid, spans of their points, number of parts. cuts: of the first dimensions."""

    def __init__(self, cuts: list[np.ndarray]) -> None:
        self.cuts, self.shape = cuts, [len(c) + 1 for c in cuts]

    def places(self, xs: list[np.ndarray]) -> np.ndarray:
        at = np.zeros(len(xs[0]), np.int64)
        for c, n, x in zip(self.cuts, self.shape, xs, strict=False):
            at = at * n + np.searchsorted(c, x)
        return at

    def of(self, rows: list[Any], dims: int) -> None:
        size = int(np.prod(self.shape))
        self.parts, self.low, self.high = np.zeros(size, np.int64), np.full((dims, size), NONE), np.full((dims, size), LOWEST)
        for r in rows:
            self.parts[r["cell"]] = -(-r["n"] // CELL_POINTS)
            for d in range(dims):
                self.low[d, r["cell"]], self.high[d, r["cell"]] = ordered(np.array([r[f"a{d}"], r[f"b{d}"]]))

    def narrowed(self, low: np.ndarray, high: np.ndarray) -> Grid:
        """The same cells with other spans."""
        out = Grid(self.cuts)
        out.parts, out.low, out.high = self.parts, low, high
        return out

    def meet(self, lo: np.ndarray, hi: np.ndarray, index: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(boxes, cells) that meet, but for cells that a box of lower index fills; known: least index that fills each."""
        first = [np.searchsorted(c, lo[d]) for d, c in enumerate(self.cuts)]
        wide = [np.searchsorted(c, hi[d]) - first[d] + 1 for d, c in enumerate(self.cuts)]
        pairs = np.multiply.reduce(wide)
        ends, start = np.cumsum(pairs), 0
        while start < len(index):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
            box = np.repeat(np.arange(start, stop), pairs[start:stop])
            k = _counts(pairs[start:stop])
            if len(self.cuts) == 1:
                cell = first[0][box] + k
            else:
                cell = (first[0][box] + k // wide[1][box]) * self.shape[1] + first[1][box] + k % wide[1][box]
            meets, fills = np.ones(len(box), bool), np.ones(len(box), bool)
            for d in range(len(lo)):
                a, b = self.low[d][cell], self.high[d][cell]
                meets &= (lo[d][box] <= b) & (hi[d][box] >= a)
                fills &= (lo[d][box] <= a) & (hi[d][box] >= b)
            fills &= meets
            np.minimum.at(known, cell[fills], index[box[fills]])
            meets &= index[box] <= known[cell]
            box, cell = box[meets], cell[meets]
            copies = self.parts[cell]
            yield np.repeat(box, copies), np.stack([np.repeat(cell, copies), _counts(copies)])
            start = stop


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.array([batch.column(n).to_numpy(zero_copy_only=False) for n in names])


def _keys(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return ordered(_columns(batch, names))


def _spans(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of points, and the least and greatest of the points of each."""
    order = np.argsort(keys, kind="stable")
    own, starts = np.unique(keys[order], return_index=True)
    return own, np.minimum.reduceat(x[:, order], starts, axis=1), np.maximum.reduceat(x[:, order], starts, axis=1)


def first_boxes(points: DataFrame, boxes: DataFrame, dims: int, many: bool = True) -> DataFrame:
    """The points (x0, x1 ...: doubles, distinct) that a box holds, with ``at``: the least ``i`` of a box (i; lo0, hi0, lo1,
    hi1 ...) that does. many: whether there may be MANY_BOXES."""
    xs, los, his = ([f"{k}{d}" for d in range(dims)] for k in ("x", "lo", "hi"))
    bins = BINS_OF_ONE if dims == 1 else BINS_OF_TWO
    shares = [k / bins for k in range(1, bins)]
    kind = ", ".join(f"{c} double" for c in xs)
    ends = ", ".join(f"{lo} double, {hi} double" for lo, hi in zip(los, his, strict=True))
    order = [c for pair in zip(los, his, strict=True) for c in pair]
    spans = [f(x).alias(f"{k}{d}") for d, x in enumerate(xs) for k, f in (("a", F.min), ("b", F.max))]

    def placed(batches):
        for b in batches:
            if b.num_rows:
                x = _keys(b, xs)
                yield pa.RecordBatch.from_arrays([pa.array(grid.places(list(x))), *[b.column(c) for c in xs]], names=["cell", *xs])

    def dealt(batches):
        known, tables = np.full(len(grid.parts), NONE), strips.tables() if later else None
        for b in batches:
            lo, hi, index = _keys(b, los), _keys(b, his), b.column("i").to_numpy()
            rounds = [(grid, np.arange(len(index)))]
            if later:
                late = np.flatnonzero(index > bound)
                rounds = [(grid, np.flatnonzero(index <= bound)), (later, late[strips.some(tables, lo[:, late], hi[:, late])])]
            for cells, own in rounds:
                l, h, i = lo[:, own], hi[:, own], index[own]
                for box, (cell, part) in cells.meet(l, h, i, known):
                    if len(box):
                        sides = [pa.array(doubles(s[d][box])) for d in range(dims) for s in (l, h)]
                        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part), pa.array(i[box]), *sides], names=["cell", "part", "i", *order])

    def found(batches, rest=False):
        """Rows by cell and part: points first, then boxes by index. rest: gives spans of the points that no box holds."""
        now, waiting, boxes, tree, size = None, [], [], None, 256

        def flush():
            nonlocal boxes
            if boxes:
                lo, hi, index = (np.concatenate(c, axis=-1) for c in zip(*boxes, strict=True))
                boxes = []
                tree.take(lo, hi, index)

        def result():
            flush()
            if rest:
                x = tree.x[:, tree.first == NONE] if tree else np.concatenate([np.zeros((dims, 0), np.int64), *waiting], axis=1)
                kinds = [np.full(x.shape[1], now[0]), *[np.searchsorted(c, v) for c, v in zip(strips.cuts, x, strict=False)]]
                for k, keys in enumerate(kinds if x.shape[1] else []):
                    place, low, high = _spans(keys, x)
                    sides = [pa.array(s[d]) for d in range(dims) for s in (low, high)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), k)), pa.array(place), *sides], names=["kind", "place", *order])
                return
            x, first = (tree.x, tree.first) if tree else (np.zeros((dims, 0), np.int64), np.zeros(0, np.int64))
            some = first != NONE
            yield pa.RecordBatch.from_arrays([*[pa.array(doubles(v[some])) for v in x], pa.array(first[some])], names=[*xs, "at"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = _columns(b, ["cell", "part"])
            ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), b.num_rows]
            lo, hi, start = _keys(b, los), _keys(b, his), 0
            is_point = b.column("i").is_null().to_numpy(zero_copy_only=False)
            index = b.column("i").fill_null(0).to_numpy()
            for end in ends:
                if (key := tuple(keys[:, start])) != now:
                    if now is not None:
                        yield from result()
                    now, waiting, boxes, tree, size = key, [], [], None, 256
                split = start + int(is_point[start:end].sum())
                if split > start:
                    waiting.append(lo[:, start:split])
                if split < end and waiting:
                    tree, waiting = Tree(np.concatenate(waiting, axis=1)), []
                while split < end and tree is not None and tree.left:
                    stop = min(end, split + size - sum(len(x[2]) for x in boxes))
                    boxes.append((lo[:, split:stop], hi[:, split:stop], index[split:stop]))
                    split = stop
                    if sum(len(x[2]) for x in boxes) >= size:
                        flush()
                        size = min(2 * size, CHUNK)
                start = end
        if now is not None:
            yield from result()

    def together(points: DataFrame, boxes: DataFrame) -> DataFrame:
        parts = {int(c): int(grid.parts[c]) for c in np.flatnonzero(grid.parts > 1)}
        part = F.lit(0).cast("long")
        if parts:
            copies = F.create_map(*[F.lit(v).cast("long") for kv in parts.items() for v in kv])
            part = F.pmod(F.xxhash64(*xs), F.coalesce(F.try_element_at(copies, F.col("cell")), F.lit(1).cast("long")))
        sides = [F.col(x).alias(s) for x, lo, hi in zip(xs, los, his, strict=True) for s in (lo, hi)]
        points = points.mapInArrow(placed, f"cell long, {kind}").select("cell", part.alias("part"), F.lit(None).cast("long").alias("i"), *sides)
        both = points.unionByName(boxes.mapInArrow(dealt, f"cell long, part long, i long, {ends}"))
        return both.repartition("cell", "part").sortWithinPartitions("cell", "part", F.col("i").asc_nulls_first())

    strips = later = bound = None
    whole = points.agg(*[F.percentile_approx(x, shares, 100 * bins).alias(x) for x in xs[:2]], *spans).first()
    cuts = [np.array(c or [], float) for c in whole[: len(xs[:2])]]
    grid = Grid([np.unique(ordered(c)) for c in cuts])
    for d, (lo, hi) in enumerate(zip(los, his, strict=True)):
        boxes = boxes.where(F.col(lo) <= F.col(hi))
        if whole["a0"] is not None:
            boxes = boxes.where((F.col(lo) <= whole[f"b{d}"]) & (F.col(hi) >= whole[f"a{d}"]))
    grid.of(points.mapInArrow(placed, f"cell long, {kind}").groupBy("cell").agg(F.count("*").alias("n"), *spans).collect(), dims)
    if many:
        n, first = boxes.agg(F.count("*"), F.percentile_approx("i", EARLY_SHARE)).first()
        if n >= max(1, MANY_BOXES):
            strips = Strips([_finer(c, whole[f"a{d}"], whole[f"b{d}"]) for d, c in enumerate(cuts)], dims)
            rest = together(points, boxes.where(F.col("i") <= first)).mapInArrow(lambda b: found(b, True), "kind long, place long, " + ends.replace("double", "long"))
            rest = rest.groupBy("kind", "place").agg(*[f(c).alias(c) for lo, hi in zip(los, his, strict=True) for f, c in ((F.min, lo), (F.max, hi))]).collect()
            low, high = np.full_like(grid.low, NONE), np.full_like(grid.high, LOWEST)
            for r in rest:
                a, b = (low, high) if not r["kind"] else (strips.low[r["kind"] - 1], strips.high[r["kind"] - 1])
                a[:, r["place"]], b[:, r["place"]] = [r[c] for c in los], [r[c] for c in his]
            bound, later = first, grid.narrowed(low, high)
    return together(points, boxes).mapInArrow(found, f"{kind}, at long")
