"""Runs: stretches of words that repeat themselves with a period.

A run is a maximal stretch with smallest period ``q`` that holds the period at least twice.  Periods under
``SHORT`` are found by direct lag scans: words are compared with those ``q`` words on.  Longer periods are found
scale by scale.  At scale ``W``, for periods from ``W`` to ``2 W - 1``, every word position has the hash of the
``W / 4`` words that begin there; the least hash of each window of ``W / 4`` positions is a minimizer.  Within a
run, what is least in a window is least one period on too, so two equal minimizers lie one period apart:
pairs of equal minimizers at such a distance are seeds, and each seed is extended to the whole run.

Stretches of a short period would give a minimizer at every turn, hence very many pairs.  Hashes of stretches
inside a known run with a period of at most ``W / 8`` are therefore no minimizers; equal hashes of what is left
are more than ``W / 8`` words apart, so each has a bounded number of partners at its scale.  What this leaves out
is exactly a run whose period is one stretch of a shorter period (``aba aba``: its two halves lie in two
neighbouring runs of that shorter period); there the phases of the two neighbours give the seeds.

Extension compares hashes of prefixes; every run found is then compared word by word.  All work is vectorised
over batches of whole texts inside a task; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.textops import U, Words, mix, pieces, powers, raw

SHORT = 32
LEAST = 12
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_BASE = 0xA24BAED4963EE407
_TOP = U(0xFFFFFFFFFFFFFFFF)
_NONE = np.zeros((0, 3), np.int64)


class Prefixes:
    """Compares stretches of one sequence by polynomial hashes."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.up, self.down = powers(_BASE, self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * self.up[: self.n], out=self.sums[1:])

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` values from ``a`` equal those from ``b``; b >= a."""
        return (self.sums[a + size] - self.sums[a]) * self.up[b - a] == self.sums[b + size] - self.sums[b]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many values from ``a`` on equal those from ``b`` on."""
        return self._longest(a, b, self.n - b, 0)

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many values before ``a`` equal those before ``b``."""
        return self._longest(a, b, a, 1)

    def _longest(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: int) -> np.ndarray:
        low = np.zeros(len(a), np.int64)
        if not len(a):
            return low
        step = 1 << int(most.max()).bit_length()
        while step:
            want = low + step
            fits = want <= most
            size = np.where(fits, want, 0)
            low = np.where(fits & self.same(a - back * size, b - back * size, size), want, low)
            step >>= 1
        return low


def windows_least(values: np.ndarray, width: int) -> np.ndarray:
    """Flags of the values that are least in some window of ``width`` (a power of two) values; ties count."""
    low, have = values, 1
    while have < width:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    # position i lies in the windows that start at i - width + 1 .. i
    high = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    have = 1
    while have < width:
        high, have = np.maximum(high[:-have], high[have:]), 2 * have
    return high == values


def _flagged(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def lag_runs(values: np.ndarray, period: int, least: int) -> np.ndarray:
    """Stretches with this period, not necessarily their smallest, by comparing all values with those a period on."""
    if len(values) <= period:
        return _NONE
    same = np.empty(len(values) - period + 2, bool)
    same[0] = same[-1] = False
    np.equal(values[:-period], values[period:], out=same[1:-1])
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2] + period
    ok = size >= max(least, 2 * period)
    return np.stack([start[ok], size[ok], np.full(ok.sum(), period, np.int64)], 1)


def minimizer_seeds(values: np.ndarray, prefixes: Prefixes, bounds: np.ndarray, runs: np.ndarray, scale: int) -> np.ndarray:
    """(position, distance) of equal minimizers ``scale`` to ``2 * scale - 1`` apart within one text."""
    span = scale // 4
    n = len(values) - span + 1
    if n < scale:
        return _NONE[:, :2]
    at = np.arange(n)
    key = mix((prefixes.sums[at + span] - prefixes.sums[at]) * prefixes.down[:n])
    known = runs[(runs[:, 2] <= span // 2) & (runs[:, 1] >= span)]
    key[_flagged(n, known[:, 0], known[:, 0] + known[:, 1] - span + 1)] = _TOP
    # stretches that reach into the next text belong to no run
    key[_flagged(n, np.clip(bounds - span + 1, 0, n), np.minimum(bounds + 1, n))] = _TOP
    spot = np.flatnonzero(windows_least(key, span) & (key != _TOP))
    order = spot[np.argsort(key[spot], kind="stable")]
    found, lag = [], 1
    while lag < len(order):
        a, b = order[:-lag], order[lag:]
        near = (key[a] == key[b]) & (b - a < 2 * scale)
        if not near.any():
            break
        seed = near & (b - a >= scale)
        found.append(np.stack([a[seed], (b - a)[seed]], 1))
        lag += 1
    return np.concatenate(found) if found else _NONE[:, :2]


def neighbour_seeds(prefixes: Prefixes, runs: np.ndarray, scale: int) -> np.ndarray:
    """Seeds of runs whose period is itself one stretch of a period of at most ``scale / 8``."""
    known = runs[(runs[:, 2] <= scale // 8) & (runs[:, 1] >= scale)]
    known = known[np.lexsort((known[:, 0], known[:, 2]))]
    found = []
    touch = (known[:-1, 2] == known[1:, 2]) & (known[1:, 0] <= known[:-1, 0] + known[:-1, 1])
    for (a1, n1, p), (a2, n2, _) in zip(known[:-1][touch].tolist(), known[1:][touch].tolist()):
        turn = np.arange(p)
        phase = np.flatnonzero(prefixes.same(a1 + turn, np.full(p, a2), np.full(p, p)))
        if not len(phase):
            continue
        rest = (a2 - a1 - int(phase[0])) % p
        most = min(n1, n2, (a2 + n2 - a1) // 2, 2 * scale - 1)
        q = np.arange(scale + (rest - scale) % p, most + 1, p)
        found.append(np.stack([np.maximum(a1, a2 - q), q], 1))
    return np.concatenate(found) if found else _NONE[:, :2]


def extended(prefixes: Prefixes, seeds: np.ndarray, least: int) -> np.ndarray:
    """The maximal stretch around each seed, if it holds the period twice."""
    if not len(seeds):
        return _NONE
    at, q = seeds[:, 0], seeds[:, 1]
    start = at - prefixes.behind(at, at + q)
    size = at + prefixes.ahead(at, at + q) + q - start
    ok = size >= np.maximum(least, 2 * q)
    return np.unique(np.stack([start[ok], size[ok], q[ok]], 1), axis=0)


def runs_of(values: np.ndarray, bounds: np.ndarray, least: int = LEAST, short: int = SHORT) -> np.ndarray:
    """All runs ``(start, length, period)`` of a sequence of texts, ordered by start and period.

    ``values`` are word hashes with a value of its own at every position in ``bounds``, the ends of the texts;
    so no run reaches from one text into the next.  ``short``, a power of two, is the least period that
    minimizers look for.
    """
    sizes = np.diff(np.r_[-1, bounds]) - 1
    longest = int(sizes.max(initial=0))
    runs = np.concatenate([_NONE, *(lag_runs(values, q, least) for q in range(1, min(short, longest // 2 + 1)))])
    runs = smallest(runs)
    keep = sizes >= 2 * short  # only texts that can hold two longer periods go on
    if keep.any():
        inside = np.repeat(keep, sizes + 1)
        spot, moved = np.flatnonzero(inside), np.cumsum(inside) - 1
        mine = runs[inside[runs[:, 0]]]
        mine = np.stack([moved[mine[:, 0]], mine[:, 1], mine[:, 2]], 1)
        more = runs_of_long(values[inside], moved[bounds[keep]], mine, least, short)
        runs = smallest(np.concatenate([runs, np.stack([spot[more[:, 0]], more[:, 1], more[:, 2]], 1)]))
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of_long(values: np.ndarray, bounds: np.ndarray, runs: np.ndarray, least: int, scale: int) -> np.ndarray:
    """``runs`` with those of periods from ``scale`` on; all runs of shorter periods are known."""
    longest = int((np.diff(np.r_[-1, bounds]) - 1).max(initial=0))
    prefixes = Prefixes(values)
    while 2 * scale <= longest:
        seeds = [minimizer_seeds(values, prefixes, bounds, runs, scale), neighbour_seeds(prefixes, runs, scale)]
        found = extended(prefixes, np.concatenate(seeds), least)
        right = [np.array_equal(values[s : s + n - q], values[s + q : s + n]) for s, n, q in found.tolist()]
        if not all(right):  # equal hashes of different stretches
            wrong = np.unique(found[~np.array(right), 2]).tolist()
            found = np.concatenate([found[right], *(lag_runs(values, q, least) for q in wrong)])
        runs = smallest(np.concatenate([runs, found]))
        scale *= 2
    return runs


def smallest(runs: np.ndarray) -> np.ndarray:
    """Of stretches with the same ends the one with the smallest period: the others are its multiples."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):
        runs = runs[np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)]]
    return runs


def separated(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with a value of its own behind every text, and where these values are."""
    n = len(words.counts)
    bounds = np.cumsum(words.counts + 1) - 1
    values = np.empty(int(words.counts.sum()) + n, np.uint64)
    inside = np.ones(len(values), bool)
    inside[bounds] = False
    values[inside] = words.hashes()
    values[bounds] = mix(np.arange(1, n + 1, dtype=np.uint64) * U(_BASE))
    return values, bounds


def kept_words(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the kept words of each text, joined by one space."""
    spot = np.flatnonzero(kept)
    text = np.repeat(np.arange(len(words.counts)), words.counts)[spot]
    step = np.zeros(len(words.data) + 1, np.int8)
    step[words.starts[spot]] += 1
    step[words.ends[spot]] -= 1
    chosen = np.cumsum(step[:-1], dtype=np.int8) > 0
    gap = words.ends[spot[:-1]][text[:-1] == text[1:]]  # white space behind a word that another one follows
    chosen[gap] = True
    data = words.data.copy()
    data[gap] = 32
    sizes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(chosen, out=sizes[1:])
    return data[chosen], sizes[words.offsets]


def periodic_runs(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", least: int = LEAST, short: int = SHORT
) -> DataFrame:
    """``row``, the struct of the ``keep`` columns of every document, with ``n_words``, ``runs`` and ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared by 64-bit hashes.  ``runs`` are all ``(start, length, period)`` with
    length of ``least`` and twice the period at least, by start, then period.  ``collapsed`` is the words that no
    run holds behind its first period, joined by one space.  Null and empty texts have no words and no runs;
    repeated rows are worked on alike; the other columns of ``docs`` play no part.
    """
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("binary").alias("body"))
    kind = src.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "body"):
            words = Words(*raw(b.column("body")))
            values, bounds = separated(words)
            runs = runs_of(values, bounds, least, short)
            begin = np.r_[0, bounds + 1]
            owner = np.searchsorted(begin, runs[:, 0], "right") - 1
            first = runs[:, 0] - owner  # as a word number of the batch
            kept = ~_flagged(len(words.starts), first + runs[:, 2], first + runs[:, 1])
            data, offsets = kept_words(words, kept)
            cuts = pa.array(np.searchsorted(owner, np.arange(b.num_rows + 1)), pa.int32())
            columns = [pa.array(x) for x in (runs[:, 0] - begin[owner], runs[:, 1].copy(), runs[:, 2].copy())]
            found = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(columns, fields=list(RUN)))
            out = pa.Array.from_buffers(
                pa.large_string(), b.num_rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
            )
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(words.counts, pa.int64()), found, out.cast(pa.string())],
                names=["row", "n_words", "runs", "collapsed"],
            )

    return src.mapInArrow(
        run, f"row {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )


def retold(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where one in ten texts goes on periodically from a word that its id names.

    With ``h`` the crc32 of the decimal id and ``g`` its tenth, texts of ids with ``h % 10 = 0`` have from word
    ``a = g % n`` on the words ``a + (i - a) % p``, where ``p = 1 + (n - a) div (3 + g % 8)``.  Other texts, those
    without words and those without an id stay.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", h.alias("h")).withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    chosen = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    some = docs.where(chosen).withColumn("w", words).withColumn("n", F.size("w").cast("long"))
    some = some.withColumn("a", F.expr("g % greatest(n, 1L)"))
    some = some.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    told = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    some = some.select("doc_id", F.when(F.col("n") > 0, told).otherwise(F.col("text")).alias("text"))
    return docs.where(~F.coalesce(chosen, F.lit(False))).select("doc_id", "text").unionByName(some)


def digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest one (ties: least start, then period), and digests of the runs and of the collapsed text."""
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as less, r.start as start, r.period as period)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    longest = -F.col("best.less")
    return found.withColumn("best", best).select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        longest.alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-1000 * best.less) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
