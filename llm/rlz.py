"""Substring deduplication by relative Lempel-Ziv parsing.

Documents are dealt by hash into blocks of about a megabyte.  Every block is a reference block, and
every document is factored against all of them: at a word, the factor is the longest run of words
that one reference block holds as well.  A factor counts when it has ``width`` words or more, so an index
of the ``width``-word windows of all blocks is enough to find its starts, to follow it window by window, and
to check the windows that straddle the border of two factors.  What factors cover is duplicate.

The index is distributed: a block sends each of its distinct windows once, as bare hashes grouped by
hash range, and gets back those that occur elsewhere, with the first other block that holds them.  A
passage in a third of all documents therefore costs one entry a block and never gathers its
documents.  To send few windows, a block first asks in the same way which of its anchors repeat: the
anchor of a window is its least ``SEED``-word hash, so equal windows have equal anchors, there is one
anchor in about 15 words, and only windows whose anchor repeats can repeat.

The texts are shuffled once; the plan reads that shuffle three times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.textops import U, Words, raw, repeated, windows

WIDTH = 35
SEED = 8
BLOCK_BYTES = 1 << 20
RANGE_VALUES = 500_000
MESSAGE = "range int, block int, values binary, own binary"
ANSWER = "block int, values binary, refs binary"


def _ordered(block: pa.Table) -> pa.Table:
    """Rows of one block in an order that is the same whenever the block is read."""
    return block.sort_by([("__row", "ascending")])


def _windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows, and the word at which each window's anchor starts."""
    first, _ = words.window_starts(width)
    if not len(first):
        return first, first
    seeds = np.full(len(words.starts), U(0xFFFFFFFFFFFFFFFF))
    starts, _ = words.window_starts(SEED)
    seeds[starts] = windows(words.hashes(), starts, SEED)
    span, have = width - SEED + 1, 1
    best = np.arange(len(seeds))
    while have < span:  # the leftmost least seed of ever longer stretches
        step = min(have, span - have)
        other = best[step:]
        mine = best[: len(other)]
        best = np.where(seeds[other] < seeds[mine], other, mine)
        have += step
    return first, best[first]


def _anchors(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, the hash of each window's anchor, and the hashes of all anchors that occur (with repeats)."""
    first, anchor = _windows(words, width)
    if not len(first):
        none = np.zeros(0, np.uint64)
        return first, none, none
    values = windows(words.hashes(), anchor, SEED)
    new = np.r_[True, anchor[1:] != anchor[:-1]]
    return first, values, values[new]


def _message(block: int, values: np.ndarray, bits: int) -> pa.Table:
    """Distinct hashes by range; ``own`` marks those that the block itself holds twice."""
    twice = np.unique(values[repeated(values)])
    values = np.unique(values)
    own = np.isin(values, twice)
    slot = (values >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    at = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
    ends = np.r_[at[1:], len(slot)] if len(slot) else at
    return pa.table(
        {
            "range": pa.array(slot[at].astype(np.int32)),
            "block": pa.array(np.full(len(at), block, np.int32)),
            "values": pa.array([values[a:b].tobytes() for a, b in zip(at, ends)], pa.binary()),
            "own": pa.array([np.packbits(own[a:b]).tobytes() for a, b in zip(at, ends)], pa.binary()),
        }
    )


def _answer(messages: pa.Table) -> pa.Table:
    """For each block, its hashes of this range that occur elsewhere or twice in it, and a block that holds them."""
    parts = [np.frombuffer(v, np.uint64) for v in messages["values"].to_pylist()]
    own = [np.unpackbits(np.frombuffer(o, np.uint8))[: len(v)] for o, v in zip(messages["own"].to_pylist(), parts)]
    sizes = [len(v) for v in parts]
    values, own = np.concatenate(parts), np.concatenate(own).astype(bool)
    block = np.repeat(messages["block"].to_numpy(), sizes)
    order = np.lexsort((block, values))
    v, b = values[order], block[order]
    start = np.r_[True, v[1:] != v[:-1]]
    head = np.flatnonzero(start)[np.cumsum(start) - 1]
    second = np.minimum(head + 1, len(v) - 1)
    has_second = (v[second] == v) & (second > head)
    ref = np.where(b[head] != b, b[head], np.where(has_second, b[second], np.where(own[order], b, -1)))
    refs = np.empty(len(v), np.int32)
    refs[order] = ref
    out = {"block": [], "values": [], "refs": []}
    at = np.cumsum([0, *sizes])
    for name, lo, hi in zip(messages["block"].to_pylist(), at[:-1], at[1:]):
        hit = refs[lo:hi] >= 0
        if hit.any():
            out["block"].append(name)
            out["values"].append(values[lo:hi][hit].tobytes())
            out["refs"].append(refs[lo:hi][hit].tobytes())
    return pa.table({"block": pa.array(out["block"], pa.int32()), "values": pa.array(out["values"], pa.binary()), "refs": pa.array(out["refs"], pa.binary())})


def _hits(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(b"".join(answers["values"].to_pylist()), np.uint64)
    refs = np.frombuffer(b"".join(answers["refs"].to_pylist()), np.int32)
    order = np.argsort(values)
    return values[order], refs[order]


def _look_up(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is known, and where."""
    if not len(known):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    spot = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[spot] == values, spot


def factors(hit: np.ndarray, ref: np.ndarray, first: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy factors ``(first word, words, block)`` of one document from its windows' look-ups.

    ``hit[i]`` says whether window i is known, ``ref[i]`` in which block.  A factor follows its block
    as far as the block goes on holding the next window.
    """
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (ref[at[1:]] != ref[at[:-1]])]
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(at)] - 1
    return [(int(first[at[s]]), int(at[e] - at[s] + width), int(ref[at[s]])) for s, e in zip(start, end)]


RESULTS = ("n_words", "n_removed", "kept", "factors")


def substring_dedup(
    docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", width: int = WIDTH, verbatim: bool = False
) -> DataFrame:
    """``keep`` of every document with ``n_words``, ``n_removed``, ``kept`` and ``factors``.

    A word is removed when a window of ``width`` words that covers it starts anywhere else too, in the same
    document or another; all occurrences go, and all windows are judged on the input.  ``kept`` is the
    remaining words joined by one space; with ``verbatim``, a text that loses nothing is kept as it is.  ``factors`` are ``(start, length, block)`` in words.  Nulls and
    texts of fewer than ``width`` words lose nothing; repeated rows are copies of each other.  A kept column with the
    name of a result gives way to it; nest columns in a struct to keep them whatever their names.
    """
    keep = tuple(c for c in keep if c not in RESULTS)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text"))
    size = src.agg(F.sum(F.octet_length("__text")), F.count("*")).first()
    blocks = max(1, -(-(size[0] or 0) // BLOCK_BYTES))
    bits = max(0, int((size[0] or 0) // (4 * RANGE_VALUES)).bit_length() - 2)
    row = F.xxhash64(*src.columns)
    src = src.withColumn("__row", row).withColumn("__block", F.pmod("__row", F.lit(blocks)).cast("int"))
    names = list(keep)

    def ask_anchors(key: tuple, block: pa.Table) -> pa.Table:
        return _message(key[0].as_py(), _anchors(Words(*raw(block["__text"])), width)[2], bits)

    def ask_windows(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        if not block.num_rows:
            return _message(0, np.zeros(0, np.uint64), bits)
        words = Words(*raw(block["__text"]))
        first, anchors, _ = _anchors(words, width)
        hit, _ = _look_up(anchors, _hits(answers)[0])
        return _message(key[0].as_py(), windows(words.hashes(), first[hit], width), bits)

    def parse(key: tuple, block: pa.Table, answers: pa.Table) -> pa.Table:
        block = _ordered(block)
        words = Words(*raw(block["__text"]))
        known, refs = _hits(answers)
        first, doc = words.window_starts(width)
        hit, spot = _look_up(windows(words.hashes(), first, width) if len(known) else first.astype(np.uint64), known)
        ref = refs[spot] if len(refs) else np.full(len(first), -1, np.int32)
        step = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(step, first[hit], 1)
        np.add.at(step, first[hit] + width, -1)
        gone = np.cumsum(step[:-1]) > 0
        at = np.searchsorted(doc, np.arange(block.num_rows + 1))
        kept, spans, removed = [], [], []
        for i, t in enumerate(block["__text"].to_pylist()):
            lo, hi = words.at[i], words.at[i + 1]
            parts = (t or b"").split()
            drop = gone[lo:hi]
            removed.append(int(drop.sum()))
            if removed[-1]:
                parts = [parts[k] for k in np.flatnonzero(~drop)]
            kept.append(t if verbatim and not removed[-1] else b" ".join(parts))
            a, b = at[i], at[i + 1]
            found = factors(hit[a:b], ref[a:b], first[a:b] - lo, width) if removed[-1] else []
            spans.append([{"start": s, "length": n, "block": r} for s, n, r in found])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("block", pa.int32())]))
        return pa.table(
            {c: block[c] for c in names}
            | {
                "n_words": pa.array(words.counts, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "factors": pa.array(spans, kind),
            }
        )

    texts = src.groupBy("__block")
    anchors = texts.applyInArrow(ask_anchors, MESSAGE).groupBy("range").applyInArrow(_answer, ANSWER)
    found = src.groupBy("__block").cogroup(anchors.groupBy("block")).applyInArrow(ask_windows, MESSAGE)
    found = found.groupBy("range").applyInArrow(_answer, ANSWER)
    added = T.StructType.fromDDL(
        "n_words bigint, n_removed bigint, kept string, factors array<struct<start: bigint, length: bigint, block: int>>"
    )
    schema = T.StructType(src.schema.fields[: len(names)] + added.fields)
    return src.groupBy("__block").cogroup(found.groupBy("block")).applyInArrow(parse, schema)
