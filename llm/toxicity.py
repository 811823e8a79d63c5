"""Toxicity by class-conditional Kneser-Ney models of word pairs.

Toxic and ordinary training texts each get an interpolated Kneser-Ney model with absolute discounting D at both levels,

    p_c(w | v) = max(n_c(v, w) - D, 0) / n_c(v, .) + back_c(v) * p_c(w)
    p_c(w)     = max(types_c(w) - D, 0) / T_c + rest_c * p(w)

``n_c(v, w)`` is the number of texts of class c with the pair, so a passage repeated within a text counts once;
``back_c(v)`` is what the discount took from the pairs of v (1 where v is new).  ``types_c(w)`` is the continuation
count, the number of different words before ``w`` in class c, so passages that are copied or quoted count once here;
``p(w)`` comes from the types of both classes together: a rare word has no evidence of its own in either class and is
smoothed by these shared counts, which leaves its likelihood ratio near one.  An expression is ``WIDTH`` consecutive
words; the score of a text compares its two log-likelihoods per word, over the whole text and over its most toxic
expression, and a logistic curve on both gives the probability.

All labelled training texts are counted, in ranges of the first word of a pair, then of the second.  The model holds
the words, first words and pairs with a count over D in some class; all others have exactly the ratio of the level below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.tables import cut
from llm.textops import U, Words, pieces, raw

# words are known by so many bits of their hash, a pair by those of both words
WORD_BITS = 32
WORD = (1 << WORD_BITS) - 1
DISCOUNT = 4.0
WIDTH = 2
# letters, digits and all bytes of characters beyond ASCII
SOLID = np.zeros(256, bool)
SOLID[[b for b in range(256) if b >= 128 or chr(b).isalnum()]] = True
START = U(0x1D8E4E27C47D124F)
# labels up to this many rows (32 MB at most) are broadcast; more of them go through a shuffled join
BROADCAST_LABELS = 1_000_000
# the curve is fitted on so many training rows at most
CURVE_ROWS = 20_000
KEYS_PER_RANGE = 1_000_000
# texts of about so many bytes are counted before their pairs are sent
COUNT_PIECE = 2 << 20


def held_out(by: int, rest: int) -> Column:
    """Rows whose crc32 of the id as text leaves ``rest``; a row without an id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % by == rest, F.lit(False))


def training_labels(labels: DataFrame, column: str, by: int, rest: int) -> DataFrame:
    """One ``(doc_id, label)`` for each labelled row to learn from; of contradicting labels the larger holds."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out(by, rest))
    return rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def with_label(docs: DataFrame, labels: DataFrame, text: str) -> DataFrame:
    known = cut(labels)
    known = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    return docs.select("doc_id", F.col(f"`{text}`").cast("binary").alias("__text")).join(known, "doc_id")


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each word with the one before (a mark before the first) as one key, first word first, and words of each text."""
    data, offsets = raw(column)
    w = Words(data, offsets, lower=True, solid=SOLID)
    h = w.hashes() >> U(64 - WORD_BITS)
    before = np.full(len(h), START >> U(64 - WORD_BITS))
    before[1:] = h[:-1]
    before[w.at[:-1][w.counts > 0]] = START >> U(64 - WORD_BITS)
    return (before << U(WORD_BITS)) | h, w.at


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a new value starts in a sorted array."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


def _packed(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _unpacked(blobs: list[bytes], sizes: list[int]) -> np.ndarray:
    """Numbers of all blobs, each of which has its own width."""
    parts = [np.frombuffer(b, f"u{len(b) // n}").astype(np.int64) for b, n in zip(blobs, sizes) if n]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _ranges(keys: np.ndarray, shift: int, bits: int) -> Iterator[tuple[int, slice]]:
    """Stretches of sorted keys that have the same ``bits`` bits above ``shift``."""
    part = (keys >> U(shift - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    lo = _starts(part)
    for x, y in zip(lo, np.r_[lo[1:], len(keys)]):
        yield int(part[x]), slice(x, y)


def _count(docs: DataFrame, bits: int) -> DataFrame:
    """Pairs of each class with the number of texts that hold them, in sorted runs by ranges of the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "__text", COUNT_PIECE):
            keys, at = _tokens(b.column("__text"))
            text = np.repeat(np.arange(b.num_rows), np.diff(at))
            toxic = b.column("label").to_numpy(zero_copy_only=False)[text].astype(bool)
            rows: dict[str, list] = {"range": [], "toxic": [], "keys": [], "texts": []}
            for c in (0, 1):
                own = toxic == bool(c)
                k, t = keys[own], text[own]
                order = np.argsort(k, kind="stable")
                k, t = k[order], t[order]
                lo = _starts(k)
                new = np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])][: len(k)]
                k, n = k[lo], np.add.reduceat(new, lo, dtype=np.int64) if len(k) else np.zeros(0, np.int64)
                for r, at_ in _ranges(k, 64, bits):
                    rows["range"].append(r)
                    rows["toxic"].append(c)
                    rows["keys"].append(k[at_].tobytes())
                    rows["texts"].append(_packed(n[at_]))
            kinds = [("range", pa.int32()), ("toxic", pa.int32()), ("keys", pa.binary()), ("texts", pa.binary())]
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(kinds))

    return docs.mapInArrow(run, "range int, toxic int, keys binary, texts binary")


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    lo = _starts(keys)
    return keys[lo], np.add.reduceat(n, lo) if len(keys) else n


def _at(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys stand in a sorted table, and whether they do."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    spot = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return spot, table[spot] == keys


PARTS = "range int, toxic int, words binary, types binary, pairs binary, shares binary, firsts binary, backs binary"
PART_COLUMNS = [x.split()[0] for x in PARTS.split(", ")]


def _first_words(bits: int, word_bits: int):
    """From all pairs of a range of first words: discounted shares, back-off weights and types, by ranges of the second.

    ``shares`` holds of each pair with a count over the discount, for both classes, its share and the back-off weight of
    its first word; ``backs`` the log ratio of these weights for each first word of such pairs.
    """

    def run(key: tuple, part: pa.Table) -> pa.Table:
        rows: dict[str, list] = {c: [] for c in PART_COLUMNS}

        def add(**values) -> None:
            for c in PART_COLUMNS:
                rows[c].append(values.get(c))

        counted = []
        for c in (0, 1):
            mine = part.filter(pc.equal(part["toxic"], c))
            blobs = mine["keys"].to_pylist()
            keys, n = _summed(
                np.frombuffer(b"".join(blobs), np.uint64), _unpacked(mine["texts"].to_pylist(), [len(b) // 8 for b in blobs])
            )
            counted.append((keys, n))
            words, types = np.unique(keys & U(WORD), return_counts=True)
            for r, at in _ranges(words, WORD_BITS, word_bits):
                add(range=r, toxic=c, words=words[at].astype(np.uint32).tobytes(), types=_packed(types[at]))
        pairs = np.unique(np.concatenate([k[n > DISCOUNT] for k, n in counted]))
        firsts = np.unique(pairs >> U(WORD_BITS))
        shares, backs = np.zeros((len(pairs), 4)), np.zeros((len(firsts), 2))
        for c, (keys, n) in enumerate(counted):
            spot, there = _at(firsts, keys >> U(WORD_BITS))
            total = np.bincount(spot[there], weights=n[there], minlength=len(firsts))
            kept = np.bincount(spot[there], weights=np.maximum(n[there] - DISCOUNT, 0), minlength=len(firsts))
            whole = np.maximum(total, 1)
            backs[:, c] = 1 - kept / whole
            spot, there = _at(keys, pairs)
            own = np.searchsorted(firsts, pairs >> U(WORD_BITS))
            shares[there, c] = np.maximum(n[spot[there]] - DISCOUNT, 0) / whole[own[there]]
            shares[:, 2 + c] = backs[own, c]
        order = np.argsort(pairs & U(WORD), kind="stable")
        for r, at in _ranges((pairs & U(WORD))[order], WORD_BITS, word_bits):
            add(range=r, pairs=pairs[order][at].tobytes(), shares=shares[order][at].tobytes())
        if len(firsts):
            ratio = np.log(backs[:, 1]) - np.log(backs[:, 0])
            add(range=0, firsts=firsts.astype(np.uint32).tobytes(), backs=ratio.astype(np.float32).tobytes())
        return pa.table({c: pa.array(rows[c], pa.int32() if c in ("range", "toxic") else pa.binary()) for c in PART_COLUMNS})

    return run


TABLES = "words binary, types binary, pairs binary, shares binary, n_words bigint, types0 double, types1 double, kept0 double, kept1 double"


def _second_words(key: tuple, part: pa.Table) -> pa.Table:
    """Types of the words of one range: those over the discount, and beside the shares of each pair those of its second word."""
    read = lambda c, kind: np.frombuffer(b"".join(x for x in part[c].to_pylist() if x), kind)
    pairs, shares = read("pairs", np.uint64), read("shares", float).reshape(-1, 4)
    found = []
    for c in (0, 1):
        mine = part.filter(pc.equal(part["toxic"], c))
        blobs = mine["words"].to_pylist()
        words = np.frombuffer(b"".join(blobs), np.uint32)
        found.append(_summed(words, _unpacked(mine["types"].to_pylist(), [len(b) // 4 for b in blobs])))
    words = np.unique(np.concatenate([w for w, _ in found]))
    types = np.zeros((len(words), 2))
    for c, (w, n) in enumerate(found):
        types[np.searchsorted(words, w), c] = n
    seconds = types[np.searchsorted(words, (pairs & U(WORD)).astype(np.uint32))]
    large = (types > DISCOUNT).any(axis=1)
    kept = np.maximum(types - DISCOUNT, 0).sum(axis=0)
    values = [
        words[large].tobytes(), types[large].tobytes(), pairs.tobytes(), np.c_[shares, seconds].tobytes(),
        len(words), *types.sum(axis=0).tolist(), *kept.tolist(),
    ]
    return pa.table({x.split()[0]: [v] for x, v in zip(TABLES.split(", "), values)})


def _ratios_of(sums: dict):
    """Log-likelihood ratios of the words and pairs of a range, once the sums over all ranges are known."""

    def words_of(types: np.ndarray) -> list[np.ndarray]:
        shared = (types.sum(axis=1) + 0.5) / (sums["types0"] + sums["types1"] + 0.5 * (sums["n_words"] + 1))
        rest = [1 - sums[f"kept{c}"] / sums[f"types{c}"] for c in (0, 1)]
        return [np.maximum(types[:, c] - DISCOUNT, 0) / sums[f"types{c}"] + rest[c] * shared for c in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"words": b.column("words").to_pylist(), "word_ratios": [], "pairs": b.column("pairs").to_pylist(), "pair_ratios": []}
            for types, shares in zip(b.column("types").to_pylist(), b.column("shares").to_pylist()):
                p = words_of(np.frombuffer(types, float).reshape(-1, 2))
                out["word_ratios"].append((np.log(p[1]) - np.log(p[0])).astype(np.float32).tobytes())
                x = np.frombuffer(shares, float).reshape(-1, 6)
                p = words_of(x[:, 4:])
                logs = [np.log(x[:, c] + x[:, 2 + c] * p[c]) for c in (0, 1)]
                out["pair_ratios"].append((logs[1] - logs[0]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.binary()) for c in out]))

    return run


class Table:
    """Numbers by key; most keys that are asked for are not in it, which a table of bits tells first."""

    BITS = 21

    def __init__(self, keys: list[bytes], values: list[bytes], kind):
        keys, values = np.frombuffer(b"".join(keys), kind), np.frombuffer(b"".join(values), np.float32)
        order = np.argsort(keys)
        self.keys, self.values, self.some = keys[order], values[order], None

    @staticmethod
    def spread(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64, copy=False) * U(0x9E3779B97F4A7C15)) >> U(64 - Table.BITS)).astype(np.int32)

    def put(self, keys: np.ndarray, into: np.ndarray, add: bool = False) -> None:
        if not len(self.keys):
            return
        if self.some is None:
            self.some = np.zeros(1 << self.BITS, bool)
            self.some[self.spread(self.keys)] = True
        maybe = np.flatnonzero(self.some[self.spread(keys)])
        spot, there = _at(self.keys, keys[maybe])
        found, values = maybe[there], self.values[spot[there]]
        into[found] = into[found] + values if add else values


class Model:
    """Log-likelihood ratios (toxic to ordinary) of words, first words and pairs; without both classes all are zero."""

    def __init__(self, rest: float, words: Table, firsts: Table, pairs: Table):
        self.rest, self.words, self.firsts, self.pairs = rest, words, firsts, pairs

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Ratio of each word behind the one before."""
        out = np.full(len(keys), self.rest)
        self.words.put((keys & U(WORD)).astype(np.uint32), out)
        self.firsts.put((keys >> U(WORD_BITS)).astype(np.uint32), out, add=True)
        self.pairs.put(keys, out)
        return out

    def ratios(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Highest and mean log-likelihood ratio per word over each text's expressions, and its words."""
        keys, at = _tokens(column)
        counts = np.diff(at)
        best, mean = np.zeros(len(counts)), np.zeros(len(counts))
        full = counts > 0
        if not full.any():
            return best, mean, counts
        first = at[:-1][full]
        own = self.of(keys)
        place = np.arange(len(keys)) - np.repeat(first, counts[full])
        window, words = own.copy(), np.minimum(place + 1, WIDTH)
        for k in range(1, WIDTH):
            window[k:] += np.where(place[k:] >= k, own[:-k], 0)
        # a window at the start of a text is a whole expression only in texts shorter than one
        whole = (place >= WIDTH - 1) | (np.repeat(counts[full], counts[full]) < WIDTH)
        best[full] = np.maximum.reduceat(np.where(whole, window / words, -np.inf), first)
        mean[full] = np.add.reduceat(own, first) / counts[full]
        return best, mean, counts


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """Count all texts of ``labels(doc_id, label)``; what has a count over the discount meets on the driver."""
    rows = with_label(docs, labels, text)
    size = rows.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
    bits = min(12, max(0, int(size // (6 * KEYS_PER_RANGE)).bit_length()))
    parts = cut(_count(rows, bits).groupBy("range").applyInArrow(_first_words(bits, bits // 2), PARTS))
    by_word = parts.where("firsts is null").groupBy("range").applyInArrow(_second_words, TABLES)
    by_word = cut(by_word)
    names = ("n_words", "types0", "types1", "kept0", "kept1")
    sums = by_word.agg(*[F.sum(c).alias(c) for c in names]).first().asDict()
    if not sums["types0"] or not sums["types1"]:
        empty = Table([], [], np.uint32)
        return Model(0.0, empty, empty, empty)
    found = by_word.select("words", "types", "pairs", "shares").mapInArrow(
        _ratios_of(sums), "words binary, word_ratios binary, pairs binary, pair_ratios binary"
    ).collect()
    firsts = parts.where("firsts is not null").select("firsts", "backs").collect()
    rest = [1 - sums[f"kept{c}"] / sums[f"types{c}"] for c in (0, 1)]
    return Model(
        float(np.log(rest[1]) - np.log(rest[0])),
        Table([r["words"] for r in found], [r["word_ratios"] for r in found], np.uint32),
        Table([r["firsts"] for r in firsts], [r["backs"] for r in firsts], np.uint32),
        Table([r["pairs"] for r in found], [r["pair_ratios"] for r in found], np.uint64),
    )


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps with a light ridge; constant where there is nothing to learn."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    if len(y):
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
            b = b + np.clip(step, -5, 5)
    return b


RESULTS = ("best_ratio", "mean_ratio", "n_words", "score")


def _rated(rows: DataFrame, model) -> DataFrame:
    """The other columns of ``rows`` with the ratios of ``__text``."""
    names = [c for c in rows.columns if c != "__text"]
    added = T.StructType.fromDDL("best_ratio double, mean_ratio double, n_words bigint")
    schema = T.StructType([rows.schema[c] for c in names] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "__text"):
            best, mean, counts = model.value.ratios(b.column("__text"))
            columns = [b.column(c) for c in names] + [pa.array(best), pa.array(mean), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "best_ratio", "mean_ratio", "n_words"])

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` of every document with ``best_ratio``, ``mean_ratio`` and ``score``, the probability of label 1.

    ``labels(doc_id, label)`` are the rows to learn from.  Null and empty texts have ratios of zero and the
    score that the curve gives to those.  Repeated rows are scored alike.  A kept column with the name of a result
    gives way to it; nest columns in a struct to keep them whatever their names.
    """
    keep = tuple(c for c in keep if c not in RESULTS)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text))
    columns = [F.col(f"`{c}`") for c in keep]
    src = docs.select(*columns, F.col(f"`{text}`").cast("binary").alias("__text"))

    # the curve needs CURVE_ROWS rows at most, so their ids have a fixed bound
    some = F.broadcast(cut(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CURVE_ROWS)))
    learn = _rated(docs.select("doc_id", F.col(f"`{text}`").cast("binary").alias("__text")).join(some, "doc_id"), model)
    learn = learn.select("best_ratio", "mean_ratio", "label").limit(2 * CURVE_ROWS).toPandas()
    b = curve(learn[["best_ratio", "mean_ratio"]].to_numpy(float), learn["label"].to_numpy(float))
    line = F.lit(float(b[0])) + F.lit(float(b[1])) * F.col("best_ratio") + F.lit(float(b[2])) * F.col("mean_ratio")
    return _rated(src, model).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), line))))
