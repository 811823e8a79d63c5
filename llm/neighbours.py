"""Approximate nearest neighbours by learned partitions.

A bounded sample of the distinct vectors is linked to its nearest neighbours; that graph is cut into
balanced partitions by label moves that keep neighbours together; a small classifier (softmax with one
hidden layer) learns from nine tenths of the sample to tell the partition of a vector.  Every vector is filed
under its most probable partition.  A query goes to its most probable ones, as many as hold a certain share of
its probability, where all members are compared, and the best of all probed partitions are ranked by
their exact products.  That share is measured: on the last tenth of the sample it reaches ``RECALL`` of the
neighbours.

Vectors that are equal are indexed once: of a group of copies only the smallest ids can be among the
nearest, and a group of equal queries is searched once.  The sample, the model (0.2 MB) and the number of
partitions are bounded; a task streams the members of its share of the partitions past a bounded block of
queries and keeps the best of each, so what it holds and what it returns do not follow the number of members.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.tables import cut

SAMPLE = 20_000
MAX_PARTS = 256
# a query meets its partitions in this many tasks, and leaves its nearest once in each; a task holds so many queries
STRIPES, HELD_QUERIES = 16, 20_000
HIDDEN = 128
GRAPH = 20
# share of the neighbours in the sample that the probed partitions must hold
RECALL = 0.97


def usable(column: str) -> Column:
    """Vectors with components, all of them finite, not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(column, lambda x: x != 0)
    return F.coalesce(F.col(column).isNotNull() & ~bad & some, F.lit(False))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` of largest inner product with each sample vector (lengths count), block by block."""
    out = np.empty((len(x), k), np.int32)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, k, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.3) -> np.ndarray:
    """Labels 0..parts-1 that cut few graph edges, none with more than ``slack`` times an equal share.

    Starts from the nearest of ``parts`` centres and moves vertices to the label that most of their neighbours
    (and those of whom they are neighbours) have, while there is room.
    """
    rng = np.random.default_rng(11)
    n, room = len(x), int(np.ceil(slack * len(x) / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(6):
        label = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), x[rng.choice(n, parts)])
    gain = x @ centres.T
    label = np.full(n, -1)
    size = np.zeros(parts, np.int64)
    wishes = np.argsort(-gain, axis=1)[:, : min(parts, 16)]
    for i in np.argsort(-gain.max(axis=1)):
        free = [p for p in wishes[i] if size[p] < room]
        label[i] = free[0] if free else int(np.argmin(size))
        size[label[i]] += 1
    src, dst = np.repeat(np.arange(n), graph.shape[1]), graph.ravel().astype(np.int64)
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    for _ in range(rounds):
        keys, votes = np.unique(a * parts + label[b], return_counts=True)
        vertex, wish = keys // parts, keys % parts
        best = np.lexsort((-votes, vertex))
        first = np.r_[True, vertex[best][1:] != vertex[best][:-1]]
        vertex, wish, votes = vertex[best][first], wish[best][first], votes[best][first]
        own = np.bincount(a, weights=label[b] == label[a], minlength=n)[vertex]
        move = np.flatnonzero((wish != label[vertex]) & (votes > own))
        moved = 0
        for m in move[np.argsort(own[move] - votes[move], kind="stable")]:
            v, p = vertex[m], wish[m]
            if size[p] < room:
                size[label[v]] -= 1
                size[p] += 1
                label[v] = p
                moved += 1
        if not moved:
            break
    return label


class Router:
    """A classifier of vectors into partitions, trained on soft labels: where a vector and its neighbours are."""

    def __init__(self, weights: list[np.ndarray], mass: float = 1.0):
        self.weights, self.mass = weights, mass

    def ranked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Partitions from the most probable on, and the probability of all before each."""
        z = self.logits(x).astype(np.float64)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, axis=1)
        return order, np.cumsum(p, axis=1) - p

    def calibrate(self, x: np.ndarray, graph: np.ndarray, asked: np.ndarray) -> None:
        """Set ``mass``, the probability ahead of a partition up to which it is probed, from ``asked`` vectors."""
        home = self.ranked(x)[0][:, 0]
        order, before = self.ranked(x[asked])
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        ahead = np.take_along_axis(before, np.take_along_axis(place, home[graph[asked]], axis=1), axis=1)
        self.mass = float(np.quantile(ahead, RECALL))

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum(x @ a + b, 0) @ c + d

    @classmethod
    def fit(cls, x: np.ndarray, label: np.ndarray, graph: np.ndarray, parts: int, rows: np.ndarray, epochs: int = 30) -> Router:
        rng = np.random.default_rng(5)
        dim = x.shape[1]
        w = [rng.normal(0, 1.5 / np.sqrt(dim), (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
        w = [v.astype(np.float32) for v in w]
        x = x.astype(np.float32)
        speed, power = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(rows)
            for lo in range(0, len(order), 256):
                i = order[lo : lo + 256]
                goal = np.zeros((len(i), parts), np.float32)
                np.add.at(goal, (np.arange(len(i)), label[i]), 0.5)
                for k in range(graph.shape[1]):
                    np.add.at(goal, (np.arange(len(i)), label[graph[i, k]]), 0.5 / graph.shape[1])
                h = np.maximum(x[i] @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                g = (p / p.sum(axis=1, keepdims=True) - goal) / len(i)
                gh = (g @ w[2].T) * (h > 0)
                step += 1
                for j, grad in enumerate((x[i].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                    speed[j] = 0.9 * speed[j] + 0.1 * grad
                    power[j] = 0.999 * power[j] + 0.001 * grad**2
                    rate = 3e-3 * (1 - epoch / epochs) + 1e-4
                    w[j] -= rate * (speed[j] / (1 - 0.9**step)) / (np.sqrt(power[j] / (1 - 0.999**step)) + 1e-8)
        return cls(w)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(vectors: DataFrame, rows: int) -> Router | None:
    """Partition and classifier from at most ``SAMPLE`` distinct vectors (those of least hash), in one task."""
    parts = int(min(MAX_PARTS, max(1, rows // 800)))
    if parts < 2:
        return None
    some = vectors.select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE).withColumn("one", F.lit(0))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["vec"].to_numpy()).astype(np.float64)
        graph = neighbour_graph((x / np.abs(x).max()).astype(np.float32), min(GRAPH, len(x) - 1))
        x = _unit(x).astype(np.float32)
        label = balanced_partition(x, graph, parts)
        asked = np.arange(len(x)) % 10 == 9
        router = Router.fit(x, label, graph, parts, np.flatnonzero(~asked))
        router.calibrate(x, graph, np.flatnonzero(asked))
        w = router.weights
        return pd.DataFrame({"w": [v.tobytes() for v in w], "shape": [list(v.shape) for v in w], "i": range(4), "mass": router.mass})

    found = some.groupBy("one").applyInPandas(run, "w binary, shape array<int>, i int, mass double").collect()
    weights = [np.frombuffer(r["w"], np.float32).reshape(r["shape"]) for r in sorted(found, key=lambda r: r["i"])]
    return Router(weights, found[0]["mass"])


class Best:
    """The queries of one stripe and the ``k`` nearest found so far of each, while the members stream by."""

    def __init__(self, k: int):
        self.k, self.asked, self.q, self.ready = k, [], [], False

    def ask(self, rows: pd.DataFrame) -> None:
        self.asked.append(rows)

    def _begin(self) -> None:
        rows = pd.concat(self.asked) if self.asked else pd.DataFrame({"gid": np.zeros(0, np.int64), "vec": [], "parts": []})
        self.qid, self.asked, self.ready = rows["gid"].to_numpy(), [], True
        self.width = max(map(len, rows["vec"]), default=0)
        self.q = _filled(rows["vec"], self.width)
        flat = np.concatenate([*rows["parts"], np.zeros(0, int)]).astype(int)
        order = np.argsort(flat, kind="stable")
        parts, first = np.unique(flat[order], return_index=True)
        owner = np.repeat(np.arange(len(rows)), [len(p) for p in rows["parts"]])[order]
        self.places = dict(zip(parts.tolist(), np.split(owner, first[1:])))
        self.gid = np.zeros((len(rows), self.k), np.int64)
        self.score = np.full((len(rows), self.k), -np.inf)

    def meet(self, part: int, members: pd.DataFrame) -> None:
        if not self.ready:
            self._begin()
        which = self.places.get(int(part))
        if which is None:
            return
        width = max(self.width, *map(len, members["vec"]))
        x, gid = _filled(members["vec"], width), members["gid"].to_numpy()
        take = min(len(x), self.k + 8)
        for lo in range(0, len(which), 256):
            rows = which[lo : lo + 256]
            y = np.pad(self.q[rows], ((0, 0), (0, width - self.width)))
            rough = y @ x.T
            # as far as the two products can differ by rounding
            off = 1e-12 * np.linalg.norm(y, axis=1) * np.linalg.norm(x, axis=1).max()
            some = rough.max(axis=1) >= self.score[rows, -1] - off
            if not some.any():
                continue
            rows, y, rough = rows[some], y[some], rough[some]
            near = np.argpartition(-rough, take - 1, axis=1)[:, :take]
            # the same order of additions for each pair, so equal vectors get equal scores
            exact = np.stack([(x[i] * q).sum(axis=1) for i, q in zip(near, y)])
            gids, scores = np.c_[self.gid[rows], gid[near]], np.c_[self.score[rows], exact]
            order = np.lexsort((gids, -scores))[:, : self.k]
            self.gid[rows], self.score[rows] = np.take_along_axis(gids, order, axis=1), np.take_along_axis(scores, order, axis=1)

    def found(self) -> pd.DataFrame:
        if not self.ready:
            self._begin()
        i, j = np.nonzero(np.isfinite(self.score))
        return pd.DataFrame({"qid": self.qid[i], "gid": self.gid[i, j], "score": self.score[i, j]})


def _filled(vectors, width: int) -> np.ndarray:
    return np.stack([np.pad(x, (0, width - len(x))) for x in vectors]) if len(vectors) else np.zeros((0, width))


def nearest(
    rows: DataFrame, queries: Column, k: int = 20, id_: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found of every row for which ``queries`` holds.

    Null ids and vectors that are null, empty, zero or not finite take no part; vectors shorter than the longest
    are compared as if filled with zeros.  Rows that repeat an id are candidates of their own.
    """
    spark = rows.sparkSession
    v = rows.select(F.col(id_).cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"), queries.alias("q"))
    v = v.where(F.col("id").isNotNull() & usable("vec"))
    # of equal vectors, the k + 1 smallest ids can be among a query's nearest
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    heads = v.select("id", "vec").withColumn("place", place).where(F.col("place") <= k + 1)
    groups = heads.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    groups = cut(groups.withColumn("gid", F.col("ids")[0]))
    state = groups.agg(F.count("*"), F.max(F.size("vec"))).first()
    n, dim = state[0], state[1] or 0
    same = groups.agg(F.min(F.size("vec"))).first()[0]
    router = learn(groups, n) if same == dim else None
    shared = spark.sparkContext.broadcast((router.weights, router.mass) if router else None)
    asked = cut(v.where(F.coalesce(F.col("q"), F.lit(False))).select("id", "vec"))
    asked_groups = asked.select("vec").distinct()
    asked_groups = asked_groups.withColumn("qid", F.xxhash64("vec"))

    def route(home: bool, names: list[str]):
        def run(parts):
            own = Router(*shared.value) if shared.value else None
            for part in parts:
                if own is None or not len(part):
                    part["part"] = [[0]] * len(part)
                else:
                    order, before = own.ranked(_unit(np.stack(part["vec"].to_numpy())).astype(np.float32))
                    count = np.ones(len(order), int) if home else (before <= own.mass).sum(axis=1)
                    part["part"] = [o[:c].tolist() for o, c in zip(order, count)]
                yield part[[*names, "part"]]

        return run

    filed = groups.select("gid", "vec").mapInPandas(route(True, ["gid", "vec"]), "gid long, vec array<double>, part array<int>")
    filed = filed.select("gid", "vec", F.col("part")[0].alias("part"))
    blocks = asked_groups.count() // HELD_QUERIES + 1
    # a stripe has its share of every partition; a block of queries meets each stripe in one task
    stripe = F.pmod(F.xxhash64("gid"), F.lit(STRIPES)).cast("int").alias("stripe")
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    members = filed.select(stripe, block, F.col("part").alias("at"), "gid", "vec", F.lit(None).cast("array<int>").alias("parts"))
    sent = asked_groups.mapInPandas(route(False, ["qid", "vec"]), "qid long, vec array<double>, part array<int>")
    stripe = F.explode(F.sequence(F.lit(0), F.lit(STRIPES - 1))).alias("stripe")
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block")
    sent = sent.select(stripe, block, F.lit(-1).alias("at"), F.col("qid").alias("gid"), "vec", F.col("part").alias("parts"))

    def compare(batches):
        """The rows of a stripe and block: its queries, then its members by partition.  Held are the queries, the best so far of each, and one batch."""
        key, held = None, None
        for batch in batches:
            for own, rows in batch.groupby(["stripe", "block"], sort=False):
                if own != key:
                    if held is not None:
                        yield held.found()
                    key, held = own, Best(k + 1)
                for part, some in rows.groupby("at", sort=False):
                    if part < 0:
                        held.ask(some)
                    else:
                        held.meet(part, some)
        if held is not None:
            yield held.found()

    both = members.unionByName(sent).repartition(STRIPES * blocks, "stripe", "block").sortWithinPartitions("stripe", "block", "at")
    found = both.mapInPandas(compare, "qid long, gid long, score double")
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "gid"))
    found = found.withColumn("r", best).where(F.col("r") <= k + 1).drop("r")
    # groups back to ids: at most (k + 1) ** 2 for a query, of which k + 1 stay
    found = found.join(groups.select("gid", "ids"), "gid").select("qid", "score", F.explode("ids").alias("vec_id"))
    best = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("r", best).where(F.col("r") <= k + 1)
    lists = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    out = asked.withColumn("qid", F.xxhash64("vec")).join(lists, "qid")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("id")), 1, k)
    out = out.select(F.col("id").alias("query_id"), F.posexplode(others).alias("p", "f"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
