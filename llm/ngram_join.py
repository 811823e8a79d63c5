"""N-gram Jaccard join with count-vector R-trees.

A document's set holds the hashes of its distinct shingles of ``width`` words (3, if the caller names no other);
sets link from a Jaccard similarity of ``percent`` (90) on.  Its shingles are hashed into
``DIMS`` groups and the group counts are its point: the overlap of two sets is at most the sum of the
coordinate minima of their points, and of two tree nodes at most that of their upper corners.

A tree's node bound tells documents of different sizes apart, but hardly two unrelated texts of one
size, so one tree over everything would compare all documents of like size.  The points are therefore
first dealt into tiles that lose no link: sets of like size are cut into one group more than the
shingles in which linked sets can differ, so linked sets agree on a whole group, whose content hash
names the tile.  Within each tile a tree joins the points; pairs that survive are verified exactly.

Copies share one set and are joined once.  Tiles that share members are joined as one group, so a pair is
looked at once however many tiles it shares.  Sets too few of whose shingles are in any other set link with nothing and
leave first: texts with common lines only, which would make one group of most of a corpus.  Then every member is verified against the first owner with which
it shares most tiles: this connects large groups of near copies with no more pairs than members.
Only groups that are not yet connected are joined by trees, large ones by size class, in blocks of bounded size; pairs that survive
the bounds are verified exactly, unless their documents are connected by then.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tables import cut, release
from llm.textops import U, Words, mix, pieces, range_hashes, raw, repeated, signed, windows

DIMS = 256
# what op9 asks for; links need 100 * intersection >= percent * union
WIDTH = 3
PERCENT = 90
# shingles of one block of a group (8 MB); a set goes along once for each block of its group
BLOCK = 1 << 20
LEAF, FAN = 32, 8
# tiles of one batch; text for each range of tile hashes; bytes of a hash that are sent, beside its range
BATCH_TILES, RANGE_BYTES, TILE_BYTES = 500_000, 1 << 22, 6
# share of the hashes by which sets that cannot link with any other are found
SLICE = 0.5
# up to this many ids of sets (8 MB) are broadcast
BROADCAST_IDS = 1_000_000
# more blocks than a size class of a group has
CLASS = 1 << 40
# rows for one task of the steps on pairs and links
ROWS = 100_000


def allowed(smaller: int, percent: int = PERCENT) -> int:
    """In how many shingles linked sets can differ, by the size of the smaller."""
    return smaller * (100 - percent) // percent


@functools.cache
def _class_edges(percent: int) -> np.ndarray:
    """Least sizes of the size classes; they grow faster than linked sets can differ in size, so links span two at most."""
    if not 70 <= percent < 100:
        raise ValueError("percent must be from 70 to 99")
    edges = [-(-percent // (100 - percent))]
    while edges[-1] <= 1 << 40:
        edges.append(edges[-1] * 3 // 2)
    return np.array(edges)


@functools.cache
def _slack(c: int, percent: int) -> int:
    """Groups of class ``c`` beyond those that must agree: so many that few sets have more empty groups.

    Any number loses no link.  Where groups hold few shingles many are empty, and sets that name their empty
    groups would meet all others that do.
    """
    n, d = int(_class_edges(percent)[c]), allowed(int(_class_edges(percent)[c + 1]) - 1, percent)
    slack = least = 1 + d // 64
    while slack <= 2 * d:
        groups = d + 1 + slack
        empty = groups * (1 - 1 / groups) ** n
        spread = max(0.0, groups * (groups - 1) * (1 - 2 / groups) ** n + empty - empty * empty)
        if empty + 2 * math.sqrt(spread) <= slack:
            return slack
        slack += 1 + slack // 32
    return least


def shingle_sets(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``width`` words are one shingle, none are none."""
    data, offsets = raw(column)
    w = Words(data, offsets, lower=True)
    h = w.hashes()
    first, _ = w.window_starts(width)
    long = windows(h, first, width)
    n = np.maximum(w.counts - width + 1, 0)
    ends = np.cumsum(n)
    short = np.flatnonzero((w.counts > 0) & (n == 0))
    alone = range_hashes(mix(h), w.at[:-1][short], w.at[1:][short], 0x2545F4914F6CDD1D)
    out = [np.unique(long[e - k : e]) for e, k in zip(ends, n)]
    for i, v in zip(short, alone):
        out[i] = np.array([v], np.uint64)
    return out


def identity(s: np.ndarray) -> int:
    """One 64-bit hash for a whole set."""
    with np.errstate(over="ignore"):
        return int(np.int64(mix(np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum() + U(len(s))], np.uint64)).view(np.int64)[0]))


def tiles(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Names of the tiles of one set: the content hashes of its groups, for each size class in which it may be linked.

    With ``d`` the differences allowed in a class, there are ``d + 1 + slack`` groups; linked sets agree on
    at least ``1 + slack`` of them.  Empty groups name a tile only in sets with more than ``slack`` of them.
    """
    n, edges = len(s), _class_edges(percent)
    k = int(np.searchsorted(edges, n, "right")) - 1
    if k < 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(s), out=sums[1:])
    out = []
    for c in {k, k - 1} if k and percent * n <= 100 * (int(edges[k]) - 1) else {k}:
        d = allowed(int(edges[c + 1]) - 1, percent)
        slack = _slack(c, percent)
        groups = d + 1 + slack
        bounds = np.arange(1, groups, dtype=np.uint64) * U((1 << 64) // groups)
        at = np.concatenate([[0], np.searchsorted(s, bounds), [n]])
        sig = mix(sums[at[1:]] - sums[at[:-1]] + np.arange(groups, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(c << 40))
        full = at[1:] > at[:-1]
        out.append(sig if (~full).sum() > slack else sig[full])
    return np.unique(np.concatenate(out))


def _keys(docs: DataFrame, text: str, width: int, row: list[str]) -> DataFrame:
    ids = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"`{c}`").cast("long").alias(c) for c in row)]
    src = docs.select(*ids, F.col(f"`{text}`").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "__text"):
            sets = shingle_sets(b.column("__text"), width)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([identity(s) if len(s) else None for s in sets], pa.int64()),
                    *(b.column(c) for c in row),
                ],
                names=["doc_id", "n_shingles", "sid", *row],
            )

    return src.mapInArrow(run, "doc_id bigint, n_shingles bigint, sid bigint" + "".join(f", `{c}` bigint" for c in row))


def _stars(owners: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (owner, tile) pairs: which are the first of their tile, and the rest as edges to the tile's first owner."""
    order = np.lexsort((owners, names))
    new = np.ones(len(order), bool)
    new[1:] = names[order[1:]] != names[order[:-1]]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    edges = np.stack([owners[order[~new]], owners[first[~new]]], axis=1)
    return order[new], *np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0, return_counts=True)


def _edges_table(edges: np.ndarray, counts: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(edges[:, 0].copy(), pa.int64()), "b": pa.array(edges[:, 1].copy(), pa.int64()), "n": pa.array(counts, pa.int64())})


def _tile_edges(docs: DataFrame, text: str, width: int, percent: int) -> DataFrame:
    """``(a, b, n)``: sets a share n tiles whose first owner is b; it connects all that share a tile.

    Sets that share a tile within a batch are connected there, and the batch sends every tile once, with its first
    owner, as bare hashes by hash range.  So a tile of very many sets costs one entry a batch, and no tile is sent twice.
    """
    src = docs.select(F.col(f"`{text}`").cast("binary").alias("__text"))
    size = src.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    ranges = size // RANGE_BYTES + 1

    def messages(owners: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        first, edges, counts = _stars(owners, names)
        owners, names = owners[first], names[first]
        spot = ((names >> U(32)) * U(ranges) >> U(32)).astype(np.int64)
        order = np.lexsort((owners, spot))
        owners, spot = owners[order], spot[order]
        bare = names[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TILE_BYTES]
        begin = np.flatnonzero(np.r_[True, (spot[1:] != spot[:-1]) | (owners[1:] != owners[:-1])]) if len(spot) else spot
        sizes = np.diff(np.r_[begin, len(spot)])
        at = np.flatnonzero(np.r_[True, spot[begin][1:] != spot[begin][:-1]]) if len(begin) else begin
        ends = np.r_[at[1:], len(begin)] if len(at) else at
        rows = [
            (int(spot[begin[x]]), owners[begin[x:y]].tobytes(), sizes[x:y].astype("<u4").tobytes(), bare[begin[x] : begin[x] + sizes[x:y].sum()].tobytes())
            for x, y in zip(at, ends)
        ]
        # the batch's own edges go along with one of its messages
        mine = [np.c_[edges, counts].astype(np.int64).tobytes(), *[b""] * (len(rows) - 1)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)), pa.array(mine, pa.binary())],
            names=["range", "sids", "sizes", "tiles", "edges"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task's split: copies name their tiles once
        names, owners, held = [], [], 0
        for b in pieces(batches, "__text"):
            for s in shingle_sets(b.column("__text"), width):
                if len(s) and (sid := identity(s)) not in seen:
                    seen.add(sid)
                    names.append(tiles(s, percent))
                    owners.append(np.full(len(names[-1]), sid, np.int64))
                    held += len(names[-1])
            if held >= BATCH_TILES:
                yield messages(np.concatenate(owners), np.concatenate(names))
                names, owners, held = [], [], 0
        if held:
            yield messages(np.concatenate(owners), np.concatenate(names))

    def meet(part: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b"".join(part[c].to_pylist()), t) for c, t in (("sids", np.int64), ("sizes", "<u4"), ("tiles", np.uint8))]
        names = np.zeros((len(parts[2]) // TILE_BYTES, 8), np.uint8)
        names[:, :TILE_BYTES] = parts[2].reshape(-1, TILE_BYTES)
        _, edges, counts = _stars(np.repeat(parts[0], parts[1]), names.view("<u8").ravel())
        mine = np.frombuffer(b"".join(part["edges"].to_pylist()), np.int64).reshape(-1, 3)
        return pa.concat_tables([_edges_table(edges, counts), _edges_table(mine[:, :2], mine[:, 2].copy())])

    sent = src.mapInArrow(run, "range bigint, sids binary, sizes binary, tiles binary, edges binary")
    met = sent.groupBy("range").applyInArrow(meet, "a bigint, b bigint, n bigint")
    return met.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    src = docs.select(F.col(f"`{text}`").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "__text"):
            sets = [s for s in shingle_sets(b.column("__text"), width) if len(s)]
            if not sets:
                continue
            ends = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            values = pa.array(signed(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([identity(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["sid", "shingles"]
            )

    return src.mapInArrow(run, "sid bigint, shingles array<bigint>")


def _dealt(sids: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """Counts by set as one row for each bucket of sets: a set has counts from as many ranges of hashes as there are."""
    spot = (sids.view(np.uint64) % U(buckets)).astype(np.int64)
    order = np.argsort(spot, kind="stable")
    sids, counts, spot = sids[order], counts[order].astype("<u4"), spot[order]
    cuts = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1], True]) if len(spot) else np.zeros(1, np.int64)
    spans = list(zip(cuts[:-1], cuts[1:]))
    return pa.table(
        {
            "bucket": pa.array(spot[cuts[:-1]], pa.int64()),
            "sids": pa.array([sids[lo:hi].tobytes() for lo, hi in spans], pa.binary()),
            "counts": pa.array([counts[lo:hi].tobytes() for lo, hi in spans], pa.binary()),
        }
    )


def _linkable(sets: DataFrame, percent: int) -> DataFrame:
    """The ids (sid) of sets that may link with another at all.

    Of a linked set at least ``percent`` of 100 shingles are in the other, so at most the rest of them are in no other set;
    nor are there more such shingles among those below the hash ``SLICE``, which are looked at here.  Texts that
    share common lines only are told apart by this, whatever connects their tiles.  Hashes cut to some bytes may
    take a shingle for a shared one, never the other way round.  A shingle is sent once a batch, however common it is.
    """
    size = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    ranges = int(size * SLICE * TILE_BYTES) // RANGE_BYTES + 1
    lowest = U(int(SLICE * (1 << 32)))

    def messages(sids: list[int], slices: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(slices)
        owners = np.repeat(np.arange(len(sids)), [len(x) for x in slices])
        common = repeated(values)
        known = np.bincount(owners[common], minlength=len(sids))
        # shared within the batch and counted: sent once, without an owner
        owners, values = np.r_[owners[~common], np.full(len(again := np.unique(values[common])), -1)], np.r_[values[~common], again]
        spot = ((values >> U(32)) * U(ranges) // lowest).astype(np.int64)
        order = np.lexsort((owners, spot))
        owners, values, spot = owners[order], values[order], spot[order]
        cuts = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1], True]) if len(spot) else np.zeros(1, np.int64)
        rows = [(-1, np.array(sids, np.int64).tobytes(), known.astype("<u4").tobytes(), b"")]
        named = np.r_[np.array(sids, np.int64), 0]  # the last one stands for no owner
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            who, n = np.unique(owners[lo:hi], return_counts=True)
            bare = values[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TILE_BYTES]
            flags = np.where(who < 0, n + (1 << 31), n)
            rows.append((int(spot[lo]), named[who].tobytes(), flags.astype("<u4").tobytes(), bare.tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))],
            names=["range", "sids", "sizes", "hashes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sids, slices, held = [], [], 0
        for b in batches:
            for sid, s in zip(b.column("sid").to_pylist(), b.column("shingles")):
                own = s.values.to_numpy().view(np.uint64)
                sids.append(sid)
                slices.append(own[: np.searchsorted(own, lowest << U(32))])
                held += len(slices[-1])
                if held >= BATCH_TILES:
                    yield messages(sids, slices)
                    sids, slices, held = [], [], 0
        if sids:
            yield messages(sids, slices)

    def meet(part: pa.Table) -> pa.Table:
        sids, sizes = (np.frombuffer(b"".join(part[c].to_pylist()), t) for c, t in (("sids", np.int64), ("sizes", "<u4")))
        if part["range"][0].as_py() < 0:
            shared = sizes.astype(np.int64)
        else:
            free, sizes = sizes >= 1 << 31, sizes & ((1 << 31) - 1)
            bare = np.frombuffer(b"".join(part["hashes"].to_pylist()), np.uint8).reshape(-1, TILE_BYTES)
            names = np.zeros((len(bare), 8), np.uint8)
            names[:, :TILE_BYTES] = bare
            hits = np.r_[0, np.cumsum(repeated(names.view("<u8").ravel()))]
            ends = np.cumsum(sizes.astype(np.int64))
            shared = np.where(free, 0, hits[ends] - hits[ends - sizes])
        return _dealt(sids[shared > 0], shared[shared > 0], ranges)

    def total(part: pa.Table) -> pa.Table:
        sids, counts = (np.frombuffer(b"".join(part[c].to_pylist()), t) for c, t in (("sids", np.int64), ("counts", "<u4")))
        found, spot = np.unique(sids, return_inverse=True)
        return pa.table({"sid": pa.array(found, pa.int64()), "shared": pa.array(np.bincount(spot, counts, len(found)).astype(np.int64))})

    sent = sets.mapInArrow(run, "range bigint, sids binary, sizes binary, hashes binary")
    # the batches' own counts need no common task
    spread = F.when(F.col("range") < 0, -1 - F.pmod(F.xxhash64("sids"), F.lit(ranges))).otherwise(F.col("range"))
    met = sent.withColumn("range", spread).groupBy("range").applyInArrow(meet, "bucket bigint, sids binary, counts binary")
    met = met.groupBy("bucket").applyInArrow(total, "sid bigint, shared bigint")
    # signed longs keep the order of the hashes when the highest bit is turned
    below = F.size(F.filter("shingles", lambda x: x.bitwiseXOR(F.lit(-(1 << 63))) < F.lit(int(lowest << U(32)) - (1 << 63))))
    counts = sets.select("sid", F.size("shingles").alias("size"), below.alias("below"))
    alone = F.col("below") - F.coalesce("shared", F.lit(0))
    return counts.join(met, "sid", "left").where(100 * alone <= (100 - percent) * F.col("size")).select("sid")


def _points(sets: list[np.ndarray]) -> np.ndarray:
    """The sets' group counts; they stop at 65,535, from where on all sizes are let through by the bound."""
    counts = np.stack([np.bincount((s & U(DIMS - 1)).astype(np.int64), minlength=DIMS) for s in sets])
    full = counts.max(axis=1) >= 65_535
    counts[full] = 65_535
    return counts.astype(np.uint16)


class Tree:
    """A packed R-tree: points sorted by size and coordinates, leaves of ``LEAF`` points, nodes of ``FAN`` nodes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        low, high, top, step = self.sizes, self.sizes, self.points, LEAF
        while not self.levels or len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            top = np.maximum.reduceat(top, at, axis=0)
            self.levels.append((low, high, top))
            step = FAN


def _may_link(size_a, size_b, most, percent: int) -> np.ndarray:
    """``most``: an upper bound of the overlap; sizes: lower bounds of the sizes."""
    return (100 + percent) * most >= percent * (size_a + size_b)


def tree_pairs(a: Tree, b: Tree, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the points that may link by the bound, found from the roots down."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def down(nodes: np.ndarray, others: np.ndarray, fan: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        children = (nodes[:, None] * fan + np.arange(fan)).ravel()
        others = np.repeat(others, fan)
        keep = children < count
        return children[keep], others[keep]

    while True:
        (al, ah, at), (bl, bh, bt) = a.levels[la], b.levels[lb]
        sized = (percent * al[i] <= 100 * bh[j]) & (percent * bl[j] <= 100 * ah[i])
        i, j = i[sized], j[sized]
        near = _may_link(al[i], bl[j], np.minimum(at[i], bt[j]).sum(axis=1, dtype=np.int64), percent)
        i, j = i[near], j[near]
        if la == lb == 0 or not len(i):
            break
        if la >= lb:
            la -= 1
            i, j = down(i, j, FAN, len(a.levels[la][0]))
        else:
            lb -= 1
            j, i = down(j, i, FAN, len(b.levels[lb][0]))
    left, right = [], []
    for x, y in zip(i * LEAF, j * LEAF):
        pa_, pb = a.points[x : x + LEAF], b.points[y : y + LEAF]
        sa, sb = a.sizes[x : x + LEAF, None], b.sizes[None, y : y + LEAF]
        most = np.minimum(pa_[:, None, :], pb[None, :, :]).sum(axis=2, dtype=np.int64)
        p, q = np.nonzero(_may_link(sa, sb, most, percent) & (percent * sa <= 100 * sb) & (percent * sb <= 100 * sa))
        left.append(a.order[x + p])
        right.append(b.order[y + q])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(left or empty), np.concatenate(right or empty)


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _block_links(part: pa.Table, percent: int) -> pa.Table:
    """Verified links between different labels in the groups (or pairs of blocks of a group) of ``part``.

    A pair is skipped when its labels are connected by links that this block pair has found before.
    """
    out: list[tuple[int, int]] = []
    part = part.sort_by([("super", "ascending"), ("one", "ascending"), ("two", "ascending")])
    key = np.stack([part[c].to_numpy() for c in ("super", "one", "two")], axis=1)
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    sid, label, own = (part[c].to_numpy() for c in ("sid", "label", "block"))
    lists = part["shingles"].combine_chunks()
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    for lo, hi in zip(starts, np.r_[starts[1:], part.num_rows]):
        if (label[lo:hi] == label[lo]).all():
            continue
        one, two = key[lo][1:]
        x, y = lo + np.flatnonzero(own[lo:hi] == one), lo + np.flatnonzero(own[lo:hi] == two)
        if not len(x) or not len(y):
            continue
        sets = {r: values[ends[r] : ends[r + 1]] for r in range(lo, hi)}
        a = Tree(_points([sets[r] for r in x]), np.array([len(sets[r]) for r in x]))
        b = a if one == two else Tree(_points([sets[r] for r in y]), np.array([len(sets[r]) for r in y]))
        i, j = tree_pairs(a, b, percent)
        i, j = x[i], y[j]
        keep = (label[i] != label[j]) & ((i < j) | (one != two))
        root = {v: v for v in label[lo:hi].tolist()}

        def find(v: int, root=root) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for p, q in zip(i[keep].tolist(), j[keep].tolist()):
            u, v = find(int(label[p])), find(int(label[q]))
            if u != v and _links(sets[p], sets[q], percent):
                root[max(u, v)] = min(u, v)
                out.append((int(sid[p]), int(sid[q])))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets really link."""
    left = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("sb"))
    right = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return pairs.join(left, "b").join(right, "a").where(100 * both >= percent * union).select("a", "b")


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed and cut, in as many partitions as its rows need."""
    done = cut(df)
    return done.coalesce(done.count() // ROWS + 1)


def components(links: DataFrame, limit: int = 100) -> DataFrame:
    """``(node, root)`` of all nodes in ``links(a, b)``, root the smallest node reachable; alternating star steps."""
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges, before = settled(links.select(high, low).where("u <> v").distinct()), None
    for _ in range(limit):
        tasks = max(1, edges.rdd.getNumPartitions())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(tasks)
        edges = cut(small.distinct().coalesce(tasks))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError("components did not settle")


def jaccard_components(
    docs: DataFrame, text: str = "text", width: int = WIDTH, percent: int = PERCENT, row: str | None = None
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Links join texts whose sets of ``width``-word shingles have a Jaccard similarity of ``percent`` or more.
    Nulls and texts without words have no shingles and are linked with nothing; repeated rows are kept
    and share a component.  Rows without an id belong to components but give them no name.
    With ``row``, the name of a bigint column, this column is returned too, and ``group``: one number for each component,
    also where an id with several texts names several; null without words.
    """
    extra = [row] if row else []
    keys = cut(_keys(docs, text, width, extra))
    known = keys.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first"))
    spark = docs.sparkSession
    stars = settled(_tile_edges(docs, text, width, percent))
    release(spark)
    shared = settled(stars.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    # the texts that give these classes their names, or have none
    firsts = shared.join(known, "sid").select("first").distinct()
    texts = docs.join(firsts, docs.doc_id.eqNullSafe(firsts["first"]), "left_semi")
    sets = _sets(texts, text, width).dropDuplicates(["sid"])
    sets = cut(sets.join(shared, "sid", "left_semi"))
    able = _linkable(sets, percent)
    release(spark)  # once another query has run, or the last plan is still held
    able = settled(able)
    able = F.broadcast(able) if able.count() <= BROADCAST_IDS else able
    sets = cut(sets.join(able, "sid", "left_semi"))
    release(spark)

    groups = components(stars.select("a", "b"))
    both = stars.join(able.withColumnRenamed("sid", "a"), "a", "left_semi").join(able.withColumnRenamed("sid", "b"), "b", "left_semi")
    best = both.groupBy("a").agg(F.max(F.struct("n", "b")).alias("c")).select("a", F.col("c.b").alias("b"))
    release(spark)
    links = settled(_verify(best, sets, percent))
    release(spark)
    roots = settled(components(links))

    label = F.coalesce("root", "sid").alias("label")
    grouped = groups.select(F.col("node").alias("sid"), F.col("root").alias("super"))
    grouped = settled(grouped.join(roots, grouped.sid == roots.node, "left").select("sid", "super", label))
    grouped = grouped.join(able, "sid", "left_semi")
    mixed = grouped.groupBy("super").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    open_ = grouped.join(mixed.select("super"), "super")
    open_ = open_.join(sets.select("sid", F.size("shingles").alias("n")), "sid")
    # a group of several blocks is dealt by size first: linked sets are of one class or of two that follow each other
    many = open_.groupBy("super").agg((F.sum("n") > BLOCK).alias("many"))
    step = math.log(100 / percent) * 1.001
    open_ = open_.join(many, "super").withColumn("class", F.when(F.col("many"), F.floor(F.log("n") / step)).otherwise(0).cast("long"))
    open_ = settled(open_.select("super", "sid", "label", "n", "class"))
    weights = open_.groupBy("super", "class").agg(F.sum("n").alias("n"))
    weights = weights.withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    own = F.sequence(F.col("class") * CLASS, F.col("class") * CLASS + F.col("blocks") - 1)
    near = weights.select("super", F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1)).alias("class"), own.alias("own"))
    near = near.groupBy("super", "class").agg(F.flatten(F.collect_list("own")).alias("others"))
    weights = settled(weights.join(near, ["super", "class"]))
    work = weights.agg(F.sum(F.col("n") * F.size("others"))).first()[0] or 0
    open_ = open_.drop("n").join(weights.drop("n"), ["super", "class"])
    open_ = open_.withColumn("block", F.col("class") * CLASS + F.pmod(F.xxhash64("sid"), "blocks"))
    open_ = open_.withColumn("other", F.explode("others"))
    open_ = open_.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    part = F.pmod(F.xxhash64("super", "one", "two"), F.lit(work // BLOCK + 1)).alias("part")
    open_ = open_.join(sets, "sid").select("super", "one", "two", "block", "sid", "label", "shingles", part)
    found = open_.groupBy("part").applyInArrow(lambda part: _block_links(part, percent), "a bigint, b bigint")
    roots = components(links.unionByName(found))

    classes = known.join(roots, known.sid == roots.node, "left").select("sid", "first", label)
    named = classes.groupBy("label").agg(F.min("first").alias("component"))
    classes = classes.join(named, "label").select("sid", "component", F.col("label").alias("group"))
    more = [*extra, "group"] if row else []
    linked = keys.where("sid is not null").join(classes, "sid").select("doc_id", "n_shingles", "component", *more)
    alone = keys.where("sid is null").withColumns({"component": F.col("doc_id"), "group": F.lit(None).cast("long")})
    alone = alone.select("doc_id", "n_shingles", "component", *more)
    return linked.unionByName(alone).withColumnRenamed("component", "component_id")
