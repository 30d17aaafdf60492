"""Scores of pairs inside a block comparison: the numbers that ``grouping.scored`` gives, to the last digit, without a join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from shutterlake.functions.media import Profile

HASHES = ("phash", "dhash", "ahash")
SIGNALS = (*HASHES, "bhash", "color")
#: What rounding of the signals and of their mean can lift a score by, with room.
MARGIN = 0.15
#: Pairs that pass a block's first look, before they are scored together.
FLUSH = 1 << 18


def to_tenths(x: np.ndarray) -> np.ndarray:
    """``media.rounded``: one decimal, correctly rounded on the exact binary value, ties to even."""
    scaled = x * 10
    out = np.rint(scaled) / 10
    for k in np.flatnonzero(np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-6):  # too near a tie for this product to tell
        out[k] = float(f"{x[k]:.1f}")
    return out


def percents(bits: int) -> np.ndarray:
    """``media.similarity_percent`` of 0 to ``bits`` differing bits."""
    return np.array([float(f"{(1.0 - d / float(bits)) * 100.0:.1f}") for d in range(bits + 1)])


SIXTY_FOUR, WIDE = percents(64), percents(256)


class Pictures:
    """A block's signals as arrays; a row without phash takes no part."""

    def __init__(self, table: pa.Table) -> None:
        self.table = table.combine_chunks()
        self.ids = self.table["file_id"].to_numpy()
        self.has, self.bits = {}, {}
        for h in HASHES:
            self.has[h] = self.table[h].is_valid().to_numpy()
            self.bits[h] = pc.fill_null(self.table[h], 0).to_numpy().astype(np.int64).view(np.uint64)
        for name, wide in (("bhash", 4), ("color", None)):
            self.has[name], self.bits[name] = lists(self.table[name], wide)
        self.bits["bhash"] = self.bits["bhash"].view(np.uint64)
        self.sums = self.bits["color"].sum(1)


def lists(column: pa.ChunkedArray, wide: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(there, rows) of a column of lists of one length without nulls in them; rows of zeros where there is none."""
    there = column.is_valid().to_numpy()
    flat = pc.list_flatten(column).to_numpy().astype(np.int64)
    wide = wide or len(flat) // max(1, int(there.sum()))
    rows = np.zeros((len(there), wide), np.int64)
    rows[there] = flat.reshape(-1, wide) if len(flat) else rows[there]
    return there, rows


def within_radius(left: Pictures, right: Pictures, one: bool, radius: int, rows: int = 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y): rows of both blocks whose phash differs in at most ``radius`` bits, some many at once; of one block each two once."""
    use, other = np.flatnonzero(left.has["phash"]), np.flatnonzero(right.has["phash"])
    width = -(-len(other) // 8) * 8
    mine, theirs = left.bits["phash"][use], np.zeros(width, np.uint64)
    theirs[: len(other)] = right.bits["phash"][other]
    apart, bits = np.empty((rows, width), np.uint64), np.empty((rows, width), np.uint8)
    found, held = [], 0
    for start in range(0, len(use), rows):
        m = min(rows, len(use) - start)
        np.bitwise_xor(mine[start : start + m, None], theirs[None, :], out=apart[:m])
        np.bitwise_count(apart[:m], out=bits[:m])
        # hits are rare: look for eight at once
        hit = (bits[:m] <= radius).reshape(-1)
        eights = np.flatnonzero(hit.view(np.uint64))
        k = np.flatnonzero(hit.reshape(-1, 8)[eights])
        at = eights[k >> 3] * 8 + (k & 7)
        x, y = start + at // width, at % width
        keep = y < len(other)
        if one:
            keep &= y > x
        found.append((use[x[keep]], other[y[keep]]))
        held += len(found[-1][0])
        if held >= FLUSH:
            yield tuple(np.concatenate(p) for p in zip(*found))
            found, held = [], 0
    if held:
        yield tuple(np.concatenate(p) for p in zip(*found))


def hash_percent(left: Pictures, right: Pictures, x: np.ndarray, y: np.ndarray, h: str) -> np.ndarray:
    """Similarity of one hash of pairs, NaN where either lacks it."""
    apart = np.bitwise_count(left.bits[h][x] ^ right.bits[h][y])
    value = WIDE[apart.astype(np.int64).sum(1)] if h == "bhash" else SIXTY_FOUR[apart]
    return np.where(left.has[h][x] & right.has[h][y], value, np.nan)


def color_percent(left: Pictures, right: Pictures, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    there = left.has["color"][x] & right.has["color"][y]
    value = np.full(len(x), np.nan)
    x, y = x[there], y[there]
    if len(x):
        shared = np.minimum(left.bits["color"][x], right.bits["color"][y]).sum(1)
        value[there] = to_tenths(100.0 * shared / np.minimum(left.sums[x], right.sums[y]))
    return value


def score_of(profile: Profile, of: dict[str, np.ndarray]) -> np.ndarray:
    """``grouping.weighted_score``: terms are added in the same order."""
    weights = profile.normalised()
    value, active, plain, n = 0.0, 0.0, 0.0, 0
    for k in SIGNALS:
        there = ~np.isnan(of[k])
        value = value + np.where(there, of[k] * weights[k], 0.0)
        active = active + np.where(there, weights[k], 0.0)
        plain, n = plain + np.where(there, of[k], 0.0), n + there
    with np.errstate(divide="ignore", invalid="ignore"):
        return to_tenths(np.where(active > 0, value / active, plain / n))


def may_reach(left: Pictures, right: Pictures, x: np.ndarray, y: np.ndarray, profile: Profile, least: float) -> np.ndarray:
    """Whether the three short hashes leave room for a score of ``least``, whatever the other signals say."""
    weights = profile.normalised()
    if not weights["phash"] > 0:
        return np.ones(len(x), bool)
    short = sum(weights[h] * (100.0 - np.nan_to_num(hash_percent(left, right, x, y, h), nan=100.0)) for h in HASHES)
    return short <= 100.0 - least + MARGIN


def signals_of(left: Pictures, right: Pictures, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    return {h: hash_percent(left, right, x, y, h) for h in (*HASHES, "bhash")} | {"color": color_percent(left, right, x, y)}


def batch(left: Pictures, right: Pictures, x: np.ndarray, y: np.ndarray, values: dict[str, np.ndarray], columns: tuple[str, ...] = ("file_id", "width", "height")) -> pa.RecordBatch:
    """Rows of pairs, the smaller file_id as a: a_ and b_ of ``columns``, then ``values`` with NaN as null."""
    first = pa.array(left.ids[x] < right.ids[y])
    out = {}
    mine = {c: left.table[c].take(pa.array(x)).combine_chunks() for c in columns}
    theirs = {c: right.table[c].take(pa.array(y)).combine_chunks() for c in columns}
    for c in columns:
        out[f"a_{c}"] = pc.if_else(first, mine[c], theirs[c])
    for c in columns:
        out[f"b_{c}"] = pc.if_else(first, theirs[c], mine[c])
    out |= {k: pa.array(v, mask=np.isnan(v)) for k, v in values.items()}
    return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


class Palettes(Pictures):
    """A block's pictures with all of them in order of their palettes' sums; every row has a palette."""

    def __init__(self, table: pa.Table) -> None:
        super().__init__(table)
        self.order = np.argsort(self.sums, kind="stable")
        self.counts = self.bits["color"][self.order].astype(np.float32)
        self.roots = np.sqrt(np.maximum(self.counts, 0))
        self.totals = self.sums[self.order]


def sharing(left: Palettes, right: Palettes, one: bool, percent: float, rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, y): all pairs whose palettes may share ``percent`` of the smaller sum, and some that share a little less; of one block each two once.

    The smaller of two counts is at most the root of their product, so a product of matrices tells most pairs from which nothing can come.
    """
    least = (percent - 0.06) / 100
    ones = np.ones(left.counts.shape[1], np.float32)
    for i in range(0, len(left.ids), rows):
        for j in range(0, len(right.ids), rows):
            a, b = slice(i, i + rows), slice(j, j + rows)
            bound = left.roots[a] @ right.roots[b].T
            # sums are in order, so those of a square are nearly alike
            hit = (bound >= np.float32(least * min(left.totals[i], right.totals[j]) * (1 - 1e-4))).ravel()
            at = np.flatnonzero(hit)
            x, y = i + at // bound.shape[1], j + at % bound.shape[1]
            for k in range(0, len(at), FLUSH):
                m, n = x[k : k + FLUSH], y[k : k + FLUSH]
                shared = np.minimum(left.counts[m], right.counts[n]) @ ones
                good = shared >= least * np.minimum(left.totals[m], right.totals[n]) * (1 - 1e-4)
                m, n = left.order[m[good]], right.order[n[good]]
                if one:
                    m, n = m[m < n], n[m < n]
                yield m, n


class Videos:
    """A block's videos in order of duration, with their frames as a matrix; places that a video lacks aren't valid."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by("duration").combine_chunks()
        self.ids, self.durations = table["file_id"].to_numpy(), table["duration"].to_numpy().astype(float)
        sizes = pc.list_value_length(table["frames"]).to_numpy().astype(np.int64)
        flat = pc.list_flatten(table["frames"])
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.frames, self.valid = np.zeros((sizes.max(initial=0), len(sizes)), np.int64), np.zeros((sizes.max(initial=0), len(sizes)), bool)
        self.frames[place, row], self.valid[place, row] = pc.fill_null(flat, 0).to_numpy(), flat.is_valid().to_numpy()
        self.frames, self.whole = self.frames.view(np.uint64), self.valid.all(1)


def alike_frames(left: Videos, right: Videos, one: bool, within: float, rows: int = 16) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row of left, of right, matrix): about how alike the frames of videos of like duration are, in percent, not rounded (``frame_percent`` is at most 0.1 away); -1 for other pairs and those with fewer than two frames. Of one block each two once."""
    places = min(len(left.frames), len(right.frames))
    for start in range(0, len(left.ids), rows):
        stop = min(start + rows, len(left.ids))
        low = max(int(np.searchsorted(right.durations, left.durations[start] - within - 1e-3)), start + 1 if one else 0)
        high = int(np.searchsorted(right.durations, left.durations[stop - 1] + within + 1e-3, "right"))
        if low >= high:
            continue
        bits, shared = np.zeros((stop - start, high - low), np.int32), np.zeros((stop - start, high - low), np.int32)
        for k in range(places):
            apart = np.bitwise_count(left.frames[k, start:stop, None] ^ right.frames[k, None, low:high])
            if left.whole[k] and right.whole[k]:
                shared += 1
            else:
                both = left.valid[k, start:stop, None] & right.valid[k, None, low:high]
                apart *= both
                shared += both
            bits += apart
        with np.errstate(invalid="ignore"):
            near = np.abs(left.durations[start:stop, None] - right.durations[None, low:high]) <= within
        near &= shared >= 2
        if one:
            near &= np.arange(low, high)[None, :] > np.arange(start, stop)[:, None]
        yield start, low, np.where(near, 100.0 - bits * (100 / 64) / np.maximum(shared, 1), -1.0)


def frame_percent(left: Videos, right: Videos, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``media.frame_similarity`` of pairs with two shared frames or more: terms are added in the same order."""
    total, shared = np.zeros(len(x)), np.zeros(len(x))
    for k in range(min(len(left.frames), len(right.frames))):
        both = left.valid[k, x] & right.valid[k, y]
        total += np.where(both, SIXTY_FOUR[np.bitwise_count(left.frames[k, x] ^ right.frames[k, y])], 0.0)
        shared += both
    return to_tenths(total / shared)


class Stars:
    """Rows of two blocks linked by pairs that come some at a time: what is held follows the rows, not the pairs."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.root, self.least = ids, np.arange(len(ids)), np.full(len(ids), np.inf)

    def add(self, u: np.ndarray, v: np.ndarray, value: np.ndarray) -> None:
        np.minimum.at(self.least, u, value)
        while True:
            u, v = self.root[u], self.root[v]
            apart = u != v
            if not apart.any():
                return
            u, v = u[apart], v[apart]
            # every root follows the least root that it meets
            np.minimum.at(self.root, np.maximum(u, v), np.minimum(u, v))
            while not np.array_equal(further := self.root[self.root], self.root):
                self.root = further

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, value): each linked row with one row of its group, and the least value of the group's pairs."""
        least = np.full(len(self.ids), np.inf)
        np.minimum.at(least, self.root, self.least)
        v = np.flatnonzero(self.root != np.arange(len(self.ids)))
        u = self.root[v]
        return np.minimum(self.ids[u], self.ids[v]), np.maximum(self.ids[u], self.ids[v]), least[u]
