"""Quality classifier: a factorisation machine.

Features of a text are its words hashed into ``SLOTS`` (with lengths-one weights), structure statistics and
metadata (the stated number of characters).  The score is

    b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2),

pairwise interactions of low rank in time linear in the words.  It is learned from at most ``SAMPLE_ROWS``
labelled rows (those with the least hash of their id), dealt over ``SHARDS`` tasks; in every round each
task runs stochastic gradient steps over its shard from the shared parameters, and the results are
averaged.  The parameters have a fixed size (0.6 MB), which bounds what is broadcast and collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.outliers import text_statistics
from llm.tables import cut
from llm.textops import U, Words, per_text, pieces, raw

SLOT_BITS = 14
SLOTS = 1 << SLOT_BITS
FACTORS = 8
SAMPLE_ROWS = 20_000
SHARDS = 8
ROUNDS = 6
DENSE = 10


def dense_features(column: pa.Array, n_chars: np.ndarray) -> np.ndarray:
    """Structure statistics and metadata, each of about unit scale."""
    data, offsets = raw(column)
    s = text_statistics(column)
    chars = np.maximum(per_text((data & 0xC0) != 0x80, offsets), 1)
    words, letters = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    upper = per_text((data >= 65) & (data <= 90), offsets)
    digits = per_text((data >= 48) & (data <= 57), offsets)
    marks = per_text(np.isin(data, np.frombuffer(b"!?|;:@/\\^~_=+<>{}[]()", np.uint8)), offsets)
    return np.column_stack(
        [
            np.log1p(s["n_words"]) / 5,
            np.log(letters / words) / 2,
            np.sqrt(s["n_symbols"] / letters) * 3,
            np.sqrt(s["n_dup_lines"] / np.maximum(s["n_lines"], 1)) * 2,
            np.sqrt(s["n_repeat_words"] / words) * 2,
            np.sqrt(upper / letters) * 2,
            np.sqrt(digits / letters) * 3,
            np.sqrt(marks / letters) * 3,
            np.log1p(s["n_lines"]) / 3,
            np.log1p(np.abs(n_chars - chars)) / 5,
        ]
    )


def sparse_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the distinct slots of its words and their weights; the weights of a text have length one."""
    data, offsets = raw(column)
    w = Words(data, offsets, lower=True)
    slot = (w.hashes() >> U(64 - SLOT_BITS)).astype(np.int64)
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    keys, times = np.unique((text << SLOT_BITS) | slot, return_counts=True)
    weight = np.log1p(times)
    text = keys >> SLOT_BITS
    length = np.sqrt(np.bincount(text, weights=weight**2, minlength=len(w.counts)))
    return keys & (SLOTS - 1), weight / length[text], np.bincount(text, minlength=len(w.counts))


class Machine:
    """Parameters: ``w`` and ``v`` have a row for each slot, then one for each dense feature."""

    def __init__(self, w: np.ndarray, v: np.ndarray, b: float):
        self.w, self.v, self.b = w, v, b

    @classmethod
    def fresh(cls) -> Machine:
        rng = np.random.default_rng(7)
        return cls(np.zeros(SLOTS + DENSE), rng.normal(0, 0.02, (SLOTS + DENSE, FACTORS)), 0.0)

    def score(self, slot: np.ndarray, x: np.ndarray, counts: np.ndarray, dense: np.ndarray) -> np.ndarray:
        text, n = np.repeat(np.arange(len(counts)), counts), len(counts)
        out = self.b + dense @ self.w[SLOTS:] + np.bincount(text, weights=self.w[slot] * x, minlength=n)
        for f in range(FACTORS):
            vf = self.v[:, f]
            vx = vf[slot] * x
            total = np.bincount(text, weights=vx, minlength=n) + dense @ vf[SLOTS:]
            out += (total**2 - np.bincount(text, weights=vx**2, minlength=n) - dense**2 @ vf[SLOTS:] ** 2) / 2
        return out

    def learn(self, rows: pd.DataFrame, rate: float, decay: float, seed: int, batch: int = 64) -> None:
        """One pass of mini-batch steps of the logistic loss, in an order that ``seed`` fixes."""
        order = np.random.default_rng(seed).permutation(len(rows))
        slots, weights = rows["slots"].to_numpy(), rows["weights"].to_numpy()
        dense, label = np.stack(rows["dense"].to_numpy()), rows["label"].to_numpy(float)
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            counts = np.array([len(slots[i]) for i in pick])
            slot, x = np.concatenate([slots[i] for i in pick]).astype(np.int64), np.concatenate([weights[i] for i in pick])
            z, n = dense[pick], len(pick)
            text = np.repeat(np.arange(n), counts)
            gap = label[pick] - 1 / (1 + np.exp(-np.clip(self.score(slot, x, counts, z), -30, 30)))
            step = rate / n
            self.b += rate * gap.mean()
            gx = gap[text] * x
            used, where = np.unique(slot, return_inverse=True)
            size = len(used)
            dw = np.bincount(where, weights=gx, minlength=size)
            for f in range(FACTORS):
                vf = self.v[:, f]
                total = np.bincount(text, weights=vf[slot] * x, minlength=n) + z @ vf[SLOTS:]
                own = np.bincount(where, weights=gx * total[text] - gap[text] * x * x * vf[slot], minlength=size)
                dense_step = (gap * total) @ z - gap @ z**2 * vf[SLOTS:]
                self.v[used, f] += step * own - rate * decay * self.v[used, f]
                self.v[SLOTS:, f] += step * dense_step - rate * decay * self.v[SLOTS:, f]
            self.w[used] += step * dw - rate * decay * self.w[used]
            self.w[SLOTS:] += step * (gap @ z)


def _features(docs: DataFrame, keep: list[str]) -> DataFrame:
    kinds = "".join(f"{c} {dict(docs.dtypes)[c]}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "__text"):
            slot, x, counts = sparse_features(b.column("__text"))
            dense = dense_features(b.column("__text"), b.column("__chars").to_numpy(zero_copy_only=False))
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            columns = [
                pa.ListArray.from_arrays(at, pa.array(slot, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(x, pa.float32())),
                pa.array(dense.tolist(), pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *columns], names=[*keep, "slots", "weights", "dense"])

    return docs.mapInArrow(run, f"{kinds}slots array<int>, weights array<float>, dense array<double>")


def _pass(shared, rate: float, decay: float, k: int):
    """Passes over one shard from the shared parameters, in an order that does not depend on the shuffle."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        w, v, b = shared.value
        own = Machine(w.copy(), v.copy(), b)
        names = [s.tobytes() for s in part["slots"]]
        part = part.iloc[sorted(range(len(part)), key=names.__getitem__)]
        for epoch in range(max(2, min(100, 5_000 // len(part)))):  # small shards need more passes for as many steps
            own.learn(part, rate, decay, 10_000 * k + 10 * epoch + int(key[0]))
        return pd.DataFrame({"w": [own.w.tobytes()], "v": [own.v.tobytes()], "b": [own.b], "n": [float(len(part))]})

    return run


def train(docs: DataFrame, labels: DataFrame, rate: float = 0.5, decay: float = 1e-5) -> Machine:
    """Fit on ``docs(doc_id, __text, __chars)`` and ``labels(doc_id, label)``; without labels the machine scores 0."""
    spark, machine = docs.sparkSession, Machine.fresh()
    # the sample's ids: SAMPLE_ROWS at most, so the broadcast has a fixed bound
    sample = F.broadcast(cut(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)))
    rows = docs.join(sample, "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int"))
    rows = cut(_features(rows, ["label", "shard"]).repartition(SHARDS, "shard"))
    if not rows.take(1):
        machine.v[:] = 0
        return machine
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((machine.w, machine.v, machine.b))
        parts = rows.groupBy("shard").applyInPandas(_pass(shared, rate / (1 + k), decay, k), "w binary, v binary, b double, n double").collect()
        n = sum(p["n"] for p in parts)
        machine.w = sum(np.frombuffer(p["w"]) * (p["n"] / n) for p in parts)
        machine.v = sum(np.frombuffer(p["v"]).reshape(-1, FACTORS) * (p["n"] / n) for p in parts)
        machine.b = sum(p["b"] * (p["n"] / n) for p in parts)
        shared.unpersist()
    return machine


def quality(
    docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", chars: str = "n_chars"
) -> DataFrame:
    """``keep`` of every document with ``score``, the probability of label 1.

    ``labels(doc_id, label)`` are the rows to learn from.  Null and empty texts are scored by their (zero) statistics;
    a null number of characters counts as zero.  Repeated rows are scored alike.
    """
    extra = [F.col(f"`{text}`").cast("binary").alias("__text"), F.coalesce(F.col(f"`{chars}`").cast("double"), F.lit(0.0)).alias("__chars")]
    model = train(docs.select("doc_id", *extra), labels)
    model = docs.sparkSession.sparkContext.broadcast((model.w, model.v, model.b))
    src = docs.select(*[F.col(f"`{c}`") for c in keep], *extra)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-2])
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Machine(*model.value)
        for b in pieces(batches, "__text"):
            dense = dense_features(b.column("__text"), b.column("__chars").to_numpy(zero_copy_only=False))
            score = own.score(*sparse_features(b.column("__text")), dense)
            score = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(score)], names=[*names, "score"])

    return src.mapInArrow(run, f"{kinds}score double")
