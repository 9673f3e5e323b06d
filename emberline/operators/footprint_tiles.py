"""How many of a tile's footprints meet each of its boxes, without a row for each pair of them.

Of an edge of a footprint that crosses no other, the inside lies on one side all along. So how many footprints hold a place is
a sum over edges: those that cross the line from the place to the east count 1 with the inside to their west and -1 else. By
columns of places, an edge adds as a whole to all columns west of it and to part of each column that it passes; only places
beside it there are tested. A closed box meets a footprint too if an edge enters it and its corner isn't held: boxes beside an
edge are tested. Footprints whose edges cross, touch or are very many are held against the boxes of the cells that they touch.

Every test is the one that a pair would get, in the same arithmetic; what is near a rounding is decided by whole footprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Degrees by which what an edge reaches is widened, far over what rounding moves it.
SLACK = 1e-9
#: Footprints of a grid and pairs tested at a time; places of a block, keys of footprints and places, and edges of a footprint that are held against each other.
AT_ONCE, TESTS, BLOCK, KEYS, FEW = 1 << 11, 1 << 16, 1 << 14, 1 << 22, 256
#: Footprints dealt at a time, and vertices sent at a time.
ROWS, SENT = 1 << 15, 1 << 22
DEALT = "tile_x bigint, tile_y bigint, part bigint, xy binary, rings binary, feet binary"


class Feet(NamedTuple):
    """Edges (x1, y1, x2, y2) one footprint after another, the footprint of each, whether the inside lies to its left; of each footprint its first edge, how many, and whether no two of them meet."""

    e: np.ndarray
    foot: np.ndarray
    left: np.ndarray
    start: np.ndarray
    size: np.ndarray
    plain: np.ndarray

    def only(self, which: np.ndarray) -> Feet:
        """The footprints of which."""
        edges, size = which[self.foot], self.size[which]
        return Feet(self.e[:, edges], np.repeat(np.arange(len(size)), size), self.left[edges], np.cumsum(size) - size, size, self.plain[which])

    def part(self, low: int, high: int) -> Feet:
        a, b = self.start[low], self.start[high - 1] + self.size[high - 1]
        return Feet(self.e[:, a:b], self.foot[a:b] - low, self.left[a:b], self.start[low:high] - a, self.size[low:high], self.plain[low:high])


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of so many items each: whose an item is, and which of them."""
    whose = np.repeat(np.arange(len(lengths)), lengths)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def follow(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """So many numbers from each beginning on."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + lengths, lengths)


def runs(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose lengths sum up to about most."""
    ends = np.cumsum(lengths)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(most, ends[-1] if len(ends) else 0, most)), [len(lengths)]]))
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _edges(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The edges of rings of so many vertices each."""
    after, ends = np.arange(1, len(x) + 1), np.cumsum(sizes)
    after[ends - 1] = ends - sizes
    return np.stack([x, y, x[after], y[after]])


def _rings(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Known vertices x and y of the rings of three or more of them, without those that the next repeats; those rings' sizes and rows."""
    row, each = pc.list_parent_indices(rings).to_numpy(), pc.list_flatten(rings)
    ring, places = pc.list_parent_indices(each).to_numpy(), pc.list_flatten(each)
    lon, lat = (pc.struct_field(places, c).cast(pa.float64()) for c in ("lon", "lat"))
    known = pc.and_(pc.is_valid(lon), pc.is_valid(lat)).to_numpy(zero_copy_only=False)
    size = np.bincount(ring[known], minlength=len(row))
    known &= (size >= 3)[ring]
    x, y, ring = lon.to_numpy(zero_copy_only=False)[known], lat.to_numpy(zero_copy_only=False)[known], ring[known]
    e = _edges(x, y, size[size >= 3])
    differs = (e[0] != e[2]) | (e[1] != e[3])
    # A ring's only place stays once.
    first = np.flatnonzero(np.diff(ring, prepend=-1))
    differs[first] |= (np.bincount(ring[differs], minlength=len(row)) == 0)[ring[first]]
    return x[differs], y[differs], np.bincount(ring[differs], minlength=len(row))[size >= 3], row[size >= 3]


def _meeting(e: np.ndarray, i: np.ndarray, j: np.ndarray, next_: np.ndarray) -> np.ndarray:
    """Which pairs of edges meet or come near, but for those that follow one another at an angle."""
    (x1, y1, x2, y2), (u1, v1, u2, v2) = e.take(i, 1), e.take(j, 1)
    dx, dy, du, dv = x2 - x1, y2 - y1, u2 - u1, v2 - v1
    near, far = SLACK * (np.abs(dx) + np.abs(dy)), SLACK * (np.abs(du) + np.abs(dv))
    a, b = dx * (v1 - y1) - dy * (u1 - x1), dx * (v2 - y1) - dy * (u2 - x1)
    c, d = du * (y1 - v1) - dv * (x1 - u1), du * (y2 - v1) - dv * (x2 - u1)
    apart = (np.minimum(a, b) > near) | (np.maximum(a, b) < -near) | (np.minimum(c, d) > far) | (np.maximum(c, d) < -far)
    for p, q, r, s in ((x1, x2, u1, u2), (y1, y2, v1, v2)):
        apart |= (np.minimum(p, q) > np.maximum(r, s) + SLACK) | (np.minimum(r, s) > np.maximum(p, q) + SLACK)
    turn, along = np.abs(dx * dv - dy * du), dx * du + dy * dv
    return np.where((next_[i] == j) | (next_[j] == i), (turn < np.abs(along) * 1e-3) & (along < 0), ~apart)


def _inside(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, feet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of footprints of so many rings each: which rings have the inside to the left of their edges, and which footprints' edges meet only end to end."""
    e = _edges(x, y, sizes)
    first = np.cumsum(sizes) - sizes
    ring, of = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(feet)), feet)
    foot, size = of[ring], np.bincount(of, sizes, len(feet)).astype(np.int64)
    start = np.cumsum(size) - size
    next_ = np.arange(1, len(x) + 1)
    next_[first + sizes - 1] = first
    dy = e[3] - e[1]
    plain = (size <= FEW) & (np.bincount(foot, np.abs(e[2] - e[0]) + np.abs(dy) < 1e-6, len(feet)) == 0)
    rest = np.where(plain[foot], (start + size)[foot] - np.arange(len(x)) - 1, 0)
    for a, b in runs(rest, TESTS):
        whose, k = spread(rest[a:b])
        bad = _meeting(e, a + whose, a + whose + 1 + k, next_)
        plain[foot[a + whose[bad]]] = False
    # The ring's tallest edge: how many edges lie to the east of its middle.
    tall = np.lexsort((-np.abs(dy), ring))[first] if len(x) else first
    middle, at = (e[1, tall] + e[3, tall]) / 2, (e[0, tall] + e[2, tall]) / 2
    others, east = np.where(plain[of], size[of], 0), np.zeros(len(sizes), np.int64)
    for a, b in runs(others, TESTS):
        whose, k = spread(others[a:b])
        whose += a
        x1, y1, x2, y2 = e.take(start[of[whose]] + k, 1)
        spans = ((y1 > middle[whose]) != (y2 > middle[whose])) & (start[of[whose]] + k != tall[whose])
        off = (x2 - x1) * (middle[whose] - y1) / np.where(spans, y2 - y1, 1.0) + x1 - at[whose]
        plain[of[whose[spans & (np.abs(off) < SLACK)]]] = False
        east += np.bincount(whose[spans & (off > 0)], minlength=len(sizes))
    plain[of[np.abs(dy[tall]) < 1e-6]] = False
    return (east % 2 == 0) == (dy[tall] > 0), plain


def deal(table: pa.Table, tile: float, pad: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT: the footprints (part, rings) that may meet a tile's boxes, many in one row."""
    x, y, sizes, row = _rings(table["rings"].combine_chunks())
    if not len(x):
        return
    rows, feet = np.unique(row, return_counts=True)
    part = table["part"].to_numpy()[rows]
    ring_at = np.cumsum(feet) - feet
    size = np.add.reduceat(sizes, ring_at)
    start = np.cumsum(size) - size
    bin_ = lambda v: np.floor(v / tile).astype(np.int64)
    low = [bin_(np.minimum.reduceat(v, start) - p - SLACK) for v, p in ((x, pad[0]), (y, pad[1]))]
    high = [bin_(np.maximum.reduceat(v, start) + SLACK) for v in (x, y)]
    wide, tiles = high[0] - low[0] + 1, np.prod([b - a + 1 for a, b in zip(low, high, strict=True)], axis=0)
    if table.num_rows > 1 and (size * tiles).sum() > SENT:
        for some in (table[: table.num_rows // 2], table[table.num_rows // 2 :]):
            yield from deal(some, tile, pad)
        return
    left, plain = _inside(x, y, sizes, feet)
    f, k = spread(tiles)
    keys = [low[0][f] + k % wide[f], low[1][f] + k // wide[f], part[f]]
    order = np.lexsort(keys[::-1])
    f, keys = f[order], [v[order] for v in keys]
    begins = np.flatnonzero(np.concatenate([[True], np.any([v[1:] != v[:-1] for v in keys], axis=0)]))

    def blobs(values: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """The values of each row's footprints as its bytes."""
        whose, k = spread(lengths[f])
        sent = np.ascontiguousarray(values[at[f][whose] + k])
        ends = np.concatenate([[0], np.cumsum(np.add.reduceat(lengths[f], begins))]) * (sent.nbytes // len(sent))
        return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(sent)])

    one = np.ones(len(feet), np.int64)
    sent = [blobs(np.stack([x, y], 1), start, size), blobs(np.where(left, sizes, -sizes).astype(np.int32), ring_at, feet), blobs(np.where(plain, feet, -feet).astype(np.int32), np.arange(len(feet)), one)]
    yield pa.RecordBatch.from_arrays([*[pa.array(v[begins]) for v in keys], *sent], ["tile_x", "tile_y", "part", "xy", "rings", "feet"])


def dealt(batches: Iterator[pa.RecordBatch], tile: float, pad: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield from deal(pa.Table.from_batches(held), tile, pad)
            held = []
    if held:
        yield from deal(pa.Table.from_batches(held), tile, pad)


def received(table: pa.Table) -> Feet:
    xy, rings, feet = (np.frombuffer(b"".join(table[c].to_pylist()), kind) for c, kind in (("xy", np.float64), ("rings", np.int32), ("feet", np.int32)))
    sizes, many = np.abs(rings).astype(np.int64), np.abs(feet)
    of = np.repeat(np.arange(len(feet)), many)
    size = np.bincount(of, sizes, len(feet)).astype(np.int64)
    return Feet(_edges(*xy.reshape(-1, 2).T, sizes), np.repeat(np.arange(len(feet)), size), np.repeat(rings > 0, sizes), np.cumsum(size) - size, size, feet > 0)


class Block:
    """Boxes sorted by south, in columns by west; at: where those of a column and under a rank begin."""

    def __init__(self, west: np.ndarray, south: np.ndarray, east: np.ndarray, north: np.ndarray) -> None:
        n = len(west)
        sorted_ = np.sort(west)
        columns = int(np.clip(np.sqrt(n), 1, 256))
        bounds = np.unique(np.concatenate([sorted_[np.arange(columns) * n // columns], [np.nextafter(sorted_[-1], np.inf)]]))
        column = np.searchsorted(bounds, west, "right")
        self.order = np.argsort(column, kind="stable")
        self.n, self.bounds, self.souths, self.columns = n, bounds, south, len(bounds) + 1
        self.column = column[self.order]
        self.west, self.south, self.east, self.north = (v[self.order] for v in (west, south, east, north))
        self.begin = np.searchsorted(self.column, np.arange(self.columns))
        one = np.zeros((self.columns, n + 1), np.int32)
        one[column, np.arange(n) + 1] = 1
        self.at = (np.cumsum(one, 1, dtype=np.int32) + self.begin[:, None].astype(np.int32)).ravel()
        self.bins, self.step = 4 * n, (south[-1] - south[0]) / (4 * n) or 1.0
        marks = south[0] + self.step * np.arange(self.bins + 2)
        self.under = np.searchsorted(south, marks - SLACK)
        self.until = np.concatenate([[0], np.searchsorted(south, marks[1:] + SLACK, "right"), [n]])

    def ranks(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks from the first to after the last that may lie between low and high; a few more may be among them."""
        place = lambda v: np.floor((v - self.souths[0]) / self.step)
        return self.under.take(np.clip(place(low), 0, self.bins + 1).astype(np.int64)), self.until.take(np.clip(place(high) + 1, 0, self.bins + 2).astype(np.int64))

    def passed(self, e: np.ndarray, before: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The first and last column with boxes that edges pass, where boxes reach so far east; none if the first is after the last."""
        first = np.searchsorted(self.bounds, np.minimum(e[0], e[2]) - before - SLACK)
        last = np.searchsorted(self.bounds, np.maximum(e[0], e[2]) + SLACK, "right")
        return np.maximum(first, 1), np.minimum(last, self.columns - 2)

    def beside(self, e: np.ndarray, slope: np.ndarray, column: np.ndarray, before: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Between which ordinates edges pass columns."""
        x1, y1, dx, dy = e[0], e[1], slope, e[3] - e[1]
        ends = [y1 + np.clip((x - x1) / dx, 0.0, 1.0) * dy for x in ((self.bounds - SLACK).take(column - 1), (self.bounds + (before + SLACK)).take(column))]
        return np.minimum(*ends) - SLACK, np.maximum(*ends) + SLACK


def _slope(e: np.ndarray) -> np.ndarray:
    """How far edges go east; a very little for upright ones."""
    dx = e[2] - e[0]
    return np.where(np.abs(dx) < 1e-300, 1e-300, dx)


def _holding(e: np.ndarray, sign: np.ndarray, start: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of a footprint (its edges from start on) and a place: whether an odd number of edges lies to the east, and the sum of their signs."""
    odd, total = np.zeros(len(start), bool), np.zeros(len(start), np.int64)
    for a, b in runs(size, TESTS):
        edge, many = follow(start[a:b], size[a:b]), size[a:b]
        x1, y1, x2, y2 = (v.take(edge) for v in e)
        px, py = np.repeat(x[a:b], many), np.repeat(y[a:b], many)
        spans = (y1 > py) != (y2 > py)
        cross = spans & (px < (x2 - x1) * (py - y1) / np.where(spans, y2 - y1, 1.0) + x1)
        begin = np.cumsum(many) - many
        odd[a:b], total[a:b] = np.logical_xor.reduceat(cross, begin), np.add.reduceat(sign.take(edge) * cross, begin)
    return odd, total


def _held(feet: Feet, block: Block) -> np.ndarray:
    """How many footprints hold the place (west, south) of each box."""
    sign = np.where(feet.left == (feet.e[3] > feet.e[1]), 1, -1).astype(np.int64)
    rank = [np.searchsorted(block.souths, f(feet.e[1], feet.e[3])) for f in (np.minimum, np.maximum)]
    first, last = block.passed(feet.e)
    kept = np.flatnonzero((rank[1] > rank[0]) & (last >= 1))
    e, s, r0, r1, first, last = feet.e[:, kept], sign[kept], rank[0][kept], rank[1][kept], first[kept], last[kept]
    slope = _slope(e)
    rises = (e[3] > e[1]) == (slope > 0)
    whole = np.zeros((block.n + 1, block.columns), np.int32)
    np.add.at(whole.reshape(-1), r0 * block.columns + np.where(rises, first - 1, last), s.astype(np.int32))
    np.add.at(whole.reshape(-1), r1 * block.columns + np.where(rises, last, first - 1), -s.astype(np.int32))
    partly, counts = np.zeros(block.n + block.columns + 1, np.int64), np.zeros(block.n, np.int64)
    for a, b in runs(last - first + 1, TESTS):
        p, k = spread(last[a:b] - first[a:b] + 1)
        p += a
        column, from_, to, up, sign_ = first.take(p) + k, r0.take(p), r1.take(p), rises.take(p), s.take(p)
        low, high = block.ranks(*block.beside(e.take(p, 1), slope.take(p), column))
        low, high = np.minimum(np.maximum(low, from_), to), np.minimum(np.maximum(high, from_), to)
        base = column * (block.n + 1)
        begin, end = block.at.take(base + low).astype(np.int64), block.at.take(base + high).astype(np.int64)
        np.add.at(partly, np.where(up, end, begin) + column, np.where(up, sign_, -sign_))
        for c, d in runs(end - begin, TESTS):
            edge, at = np.repeat(p[c:d], end[c:d] - begin[c:d]), follow(begin[c:d], end[c:d] - begin[c:d])
            x1, y1, x2, y2 = (v.take(edge) for v in e)
            x, y = block.west.take(at), block.south.take(at)
            cross = np.flatnonzero(x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            np.add.at(counts, at.take(cross), s.take(edge.take(cross)))
            # Beside a vertex two crossings may be rounded past one another.
            near = np.flatnonzero((np.abs(x - x1) < SLACK) & (np.abs(y - y1) < SLACK))
            if len(near):
                pairs = np.unique(np.stack([feet.foot[kept[edge[near]]], at[near]]), axis=1)
                odd, total = _holding(feet.e, sign, feet.start[pairs[0]], feet.size[pairs[0]], block.west[pairs[1]], block.south[pairs[1]])
                np.add.at(counts, pairs[1], odd - total)
    whole = np.cumsum(np.cumsum(whole[:, ::-1], 1, dtype=np.int32)[:, ::-1], 0, dtype=np.int64)
    partly = np.concatenate([[0], np.cumsum(partly)])
    return counts + whole[block.order, block.column] + partly[np.arange(block.n) + block.column + 1] - partly[(block.begin + np.arange(block.columns))[block.column]]


def _entered(feet: Feet, block: Block, pad: tuple[float, float], counts: np.ndarray, seen: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Adds how many footprints have an edge that enters each closed box, but don't hold its south-western corner."""
    n = block.n
    # Edges of one way after another, as the same corners of boxes decide for them.
    kind = (feet.e[2] >= feet.e[0]) * 2 + (feet.e[3] >= feet.e[1])
    order = np.argsort(kind.astype(np.int8), kind="stable")
    e, foot, left = feet.e.take(order, 1), feet.foot[order], feet.left[order]
    first, last = block.passed(e, pad[0])
    p, k = spread(np.maximum(last - first + 1, 0))
    column, slope = first.take(p) + k, _slope(e)
    low, high = block.beside(e.take(p, 1), slope.take(p), column, pad[0])
    low, high = block.ranks(low - pad[1], high)
    base = column * (n + 1)
    begin = block.at.take(base + low).astype(np.int64)
    lengths = np.maximum(block.at.take(base + high) - begin, 0)
    if len(feet.size) > 1 and lengths.sum() > 8 * TESTS:
        half = len(feet.size) // 2
        for some in (feet.part(0, half), feet.part(half, len(feet.size))):
            _entered(some, block, pad, counts, seen)
        return
    dx, dy = e[2] - e[0], e[3] - e[1]
    near, off = SLACK * (np.abs(dx) + np.abs(dy)), dx * e[1] - dy * e[0]
    x_low, x_high, y_low, y_high = np.minimum(e[0], e[2]), np.maximum(e[0], e[2]), np.minimum(e[1], e[3]), np.maximum(e[1], e[3])
    # Between its ends an edge passes all of a box of these pieces, if it passes its corners.
    inner = (x_low.take(p) < (block.bounds - SLACK).take(column - 1)) & (x_high.take(p) > (block.bounds + (pad[0] + SLACK)).take(column))
    cuts, found = np.searchsorted(kind[order][p], np.arange(5)), []
    for way, ends in itertools.product(range(4), (False, True)):
        low, high = cuts[way : way + 2]
        pieces = low + np.flatnonzero((inner[low:high] != ends) & (lengths[low:high] > 0))
        # Of a box's corners that farthest to the right of such edges, and that farthest to their left.
        corner = (block.east if way % 2 else block.west, block.south if way // 2 else block.north)
        other = (block.west if way % 2 else block.east, block.north if way // 2 else block.south)
        for a, b in runs(lengths.take(pieces), TESTS):
            own = pieces[a:b]
            many = lengths.take(own)
            edge, at = np.repeat(p.take(own), many), follow(begin.take(own), many)
            w, h, c, m = (v.take(edge) for v in (dx, dy, off, near))
            least, most = (w * y.take(at) - h * x.take(at) - c for x, y in (corner, other))
            some = np.flatnonzero((least <= m) & (most >= -m))
            at, edge, m = at.take(some), edge.take(some), m.take(some)
            enters = (least.take(some) < -m) & (most.take(some) > m)
            if ends:
                within = np.minimum(np.minimum(block.east[at] - x_low[edge], x_high[edge] - block.west[at]), np.minimum(block.north[at] - y_low[edge], y_high[edge] - block.south[at]))
                some = np.flatnonzero(within >= -SLACK)
                at, edge, enters = at[some], edge[some], enters[some] & (within[some] > SLACK)
            open_ = np.flatnonzero(~enters)
            if len(open_):
                f, k = edge[open_], at[open_]
                sides = [dx[f] * (y[k] - e[1, f]) - dy[f] * (x[k] - e[0, f]) for x, y in (corner, other)]
                enters[open_] = (x_low[f] <= block.east[k]) & (x_high[f] >= block.west[k]) & (y_low[f] <= block.north[k]) & (y_high[f] >= block.south[k]) & (sides[0] <= 0) & (sides[1] >= 0)
            found.append((at, edge, enters))
    if not found:
        return
    at, edge, enters = (np.concatenate(v) for v in zip(*found, strict=True))
    key = foot.take(edge) * n + at
    first_of, several, entered = seen
    mark = np.arange(len(key), dtype=np.int32)
    first_of[key] = mark
    own = first_of.take(key) == mark
    again = key.take(np.flatnonzero(~own))
    several[again] = True
    shared = several.take(key)
    once, more = np.flatnonzero(own & ~shared & enters), key.take(np.flatnonzero(own & shared))
    several[again] = False
    hit = key.take(np.flatnonzero(enters))
    entered[hit] = True
    more = more[entered[more]]
    entered[hit] = False
    f, place = edge.take(once), at.take(once)
    side = dx.take(f) * block.south.take(place) - dy.take(f) * block.west.take(place) - off.take(f)
    sure = np.abs(side) > near.take(f)
    counts += np.bincount(place.take(np.flatnonzero(sure & ((side > 0) != left.take(f)))), minlength=n)
    more = np.concatenate([more, key[once[~sure]]])
    f, place = more // n, more % n
    odd, _ = _holding(feet.e, np.zeros(e.shape[1], np.int8), feet.start[f], feet.size[f], block.west[place], block.south[place])
    counts += np.bincount(place[~odd], minlength=n)


def _classes(e: np.ndarray, foot: np.ndarray, n: int, grid: tuple, pad: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Of n footprints and the cells of a grid (footprint, row, column): which an edge touches, and which lie inside by their middle.

    A cell counts as touched also where an edge is no farther than pad to its east or north.
    """
    x0, y0, w, h, side = grid
    x1, y1, x2, y2 = e
    low = np.clip(np.floor((np.minimum(y1, y2) - pad[1] - SLACK - y0) / h), 0, side).astype(np.int64)
    high = np.clip(np.floor((np.maximum(y1, y2) + SLACK - y0) / h), -1, side - 1).astype(np.int64)
    at, k = spread(np.maximum(high - low + 1, 0))
    row, (x1, y1, x2, y2) = low[at] + k, e[:, at]
    level, dx, dy = y1 == y2, x2 - x1, np.where(y1 == y2, 1.0, y2 - y1)
    south, middle = y0 + row * h, y0 + (row + 0.5) * h
    ends = [np.where(level, x, x1 + dx * np.clip((y - y1) / dy, 0, 1)) for x, y in ((x1, south - SLACK), (x2, south + h + pad[1] + SLACK))]
    first = np.clip(np.floor((np.minimum(*ends) - pad[0] - SLACK - x0) / w), 0, side).astype(np.int64)
    last = np.clip(np.floor((np.maximum(*ends) + SLACK - x0) / w), -1, side - 1).astype(np.int64)
    flat, some = (foot[at] * side + row) * (side + 1), last >= first
    size, shape = n * side * (side + 1), (n, side, side + 1)
    touched = np.bincount((flat + first)[some], minlength=size) - np.bincount((flat + last + 1)[some], minlength=size)
    cross = (y1 > middle) != (y2 > middle)
    until = np.clip(np.ceil((x1 + dx * ((middle - y1) / dy) - x0) / w - 0.5), 0, side).astype(np.int64)
    beyond = np.bincount((flat + until)[cross], minlength=size).reshape(shape)[:, :, :0:-1]
    return np.cumsum(touched.reshape(shape), 2)[:, :, :-1] > 0, np.cumsum(beyond, 2)[:, :, ::-1] % 2 == 1


def _met(e: np.ndarray, start: np.ndarray, size: np.ndarray, west: np.ndarray, south: np.ndarray, east: np.ndarray, north: np.ndarray, closed: bool) -> np.ndarray:
    """Which pairs of a footprint (its edges from start on) and a box meet; not closed: of which the footprint holds the place."""
    odd, hit = np.zeros(len(start), bool), np.zeros(len(start), bool)
    for k in range(size.max(initial=0)):
        at = np.flatnonzero((size > k) & ~hit)
        x1, y1, x2, y2 = e[:, start[at] + k]
        w, s = west[at], south[at]
        spans = (y1 > s) != (y2 > s)
        odd[at] ^= spans & (w < (x2 - x1) * (s - y1) / np.where(spans, y2 - y1, 1.0) + x1)
        if closed:
            t, n = east[at], north[at]
            sides = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (w, t) for y in (s, n)]
            apart = (np.minimum(x1, x2) > t) | (np.maximum(x1, x2) < w) | (np.minimum(y1, y2) > n) | (np.maximum(y1, y2) < s)
            hit[at] = ~apart & (np.minimum.reduce(sides) <= 0) & (np.maximum.reduce(sides) >= 0)
    return odd | hit


def _counts_by_cells(feet: Feet, sides: list[np.ndarray], corner: tuple[float, float], tile: float, pad: tuple[float, float], closed: bool) -> np.ndarray:
    """How many footprints meet each box of the tile from corner on, whatever their edges do. Only cells that an edge touches have their boxes tested."""
    west, south, east, north = sides
    e = feet.e
    side = int(np.clip(np.sqrt(len(west) / 2), 4, 48))
    grid = (*corner, tile / side, tile / side, side)
    index = lambda v, k: np.clip(np.floor((v - grid[k]) / grid[k + 2]), 0, side - 1).astype(np.int64)
    cell = index(south, 1) * side + index(west, 0)
    order, held = np.argsort(cell, kind="stable"), np.bincount(cell, minlength=side * side)
    begins, sure, counts = np.cumsum(held) - held, np.zeros(side * side, np.int64), np.zeros(len(west), np.int64)
    for low in range(0, len(feet.size), AT_ONCE):
        some = feet.part(low, min(low + AT_ONCE, len(feet.size)))
        touched, inside = _classes(some.e, some.foot, len(some.size), grid, pad)
        sure += (inside & ~touched).sum(0).ravel()
        foot, where = np.nonzero(touched.reshape(len(some.size), -1) & (held > 0))
        for a, b in runs(held[where], TESTS):
            whose, k = spread(held[where[a:b]])
            box, f = order[begins[where[a:b]][whose] + k], foot[a:b][whose]
            met = _met(some.e, some.start[f], some.size[f], west[box], south[box], east[box], north[box], closed)
            counts += np.bincount(box[met], minlength=len(west))
    return counts + sure[cell]


def tile_counts(feet: Feet, sides: list[np.ndarray], corner: tuple[float, float], tile: float, pad: tuple[float, float], closed: bool) -> np.ndarray:
    """How many footprints meet each box (west, south, east, north) of the tile from corner on; not closed: hold its south-western corner."""
    counts = np.zeros(len(sides[0]), np.int64)
    if not feet.plain.all():
        counts += _counts_by_cells(feet.only(~feet.plain), sides, corner, tile, pad, closed)
    feet = feet.only(feet.plain)
    order = np.argsort(sides[1], kind="stable")
    for low in range(0, len(order), BLOCK):
        at = order[low : low + BLOCK]
        block = Block(*[v[at] for v in sides])
        seen = (np.zeros(max(KEYS, block.n), np.int32), np.zeros(max(KEYS, block.n), bool), np.zeros(max(KEYS, block.n), bool)) if closed else None
        own = np.zeros(block.n, np.int64)
        with np.errstate(over="ignore"):
            for a, b in runs(feet.size, TESTS):
                own += _held(feet.part(a, b), block)
            few = max(1, KEYS // block.n)
            for a in range(0, len(feet.size) if seen else 0, few):
                _entered(feet.part(a, min(a + few, len(feet.size))), block, pad, own, seen)
        counts[at[block.order]] += own
    return counts
