"""Byte-level BPE by overlapping chunks.

A long text is cut into chunks that overlap.  All chunks are pre-tokenised in parallel; in an overlap, the
first pre-token border that both neighbours have is where one hands over to the other: matching looks
ahead only, so from a common border on both see the same pre-tokens.  Each chunk then encodes its
pre-tokens between its two borders, and the ids of the chunks are put together in order.  A text with an
overlap without a common border (a run of one kind of character longer than the overlap) is pre-tokenised
whole.  Texts of one chunk are encoded where they are read.  Decoding concatenates the ids' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.textops import pieces

CHUNK, OVERLAP = 1 << 14, 512
# borders this near to a chunk's end may depend on characters behind it: the longest look-ahead of the pattern
# is three characters
MARGIN = 16
REMEMBERED = 300_000
_coders: dict = {}


class Coder:
    """Ranks and pattern, loaded once in each worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.known: dict[str, bytes] = {}  # as bytes they take a quarter of the memory

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_ordinary(text), np.uint32)

    def encode_pieces(self, found: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        ids: list[bytes] = []
        for p in found:
            if (have := self.known.get(p)) is None:
                have = self.known[p] = np.array(self.library.encode_ordinary(p), np.uint32).tobytes()
            ids.append(have)
        return np.frombuffer(b"".join(ids), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.tolist()])


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    return _coders[path, pattern]


def chunk_bounds(text: bytes, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Byte ranges of the chunks; no character is cut."""

    def whole(at: int) -> int:
        while at < len(text) and text[at] & 0xC0 == 0x80:
            at += 1
        return at

    starts = [whole(s) for s in range(0, max(len(text) - overlap, 1), chunk)]
    return [(s, whole(min(n + overlap, len(text)))) for s, n in zip(starts, [*starts[1:], len(text)])]


def borders(text: bytes, start: int, pattern) -> np.ndarray:
    """Where pre-tokens of a chunk begin, in bytes of the whole text."""
    sizes = [len(p.encode()) for p in pattern.findall(text.decode())]
    return start + np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def encode(
    docs: DataFrame,
    path: str,
    pattern: str,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``keep`` of every document with ``ids``, its token ids as little-endian uint32.

    Null and empty texts have no ids.  Repeated rows stay repeated.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("__text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])
    names = list(keep)
    is_long = F.coalesce(F.octet_length("__text") > chunk + overlap, F.lit(False))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for b in pieces(batches, "__text"):
            ids = [own.encode((t or b"").decode()).tobytes() for t in b.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(ids, pa.binary())], names=[*names, "ids"])

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "__text"):
            for row, t in zip(b.column("__row").to_pylist(), b.column("__text").to_pylist()):
                spans = chunk_bounds(t, chunk, overlap)
                for lo in range(0, len(spans), 64):
                    some = spans[lo : lo + 64]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "row": pa.array([row] * len(some), pa.int64()),
                            "chunk": pa.array(range(lo, lo + len(some)), pa.int64()),
                            "start": pa.array([s for s, _ in some], pa.int64()),
                            "body": pa.array([t[s:e] for s, e in some], pa.binary()),
                        }
                    )

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for b in batches:
            head, tail = [], []
            for start, body in zip(b.column("start").to_pylist(), b.column("body").to_pylist()):
                at = borders(body, start, own.pattern)
                end = start + len(body)
                head.append(at[at <= start + overlap + MARGIN].tolist())
                tail.append(at[(at >= end - overlap - MARGIN) & (at <= end - MARGIN)].tolist())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("row", "chunk", "start")), pa.array(head, kind), pa.array(tail, kind)],
                names=["row", "chunk", "start", "head", "tail"],
            )

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for b in batches:
            ids, raw_text = [], []
            for start, body, lo, hi, ahead, lost in zip(
                *(b.column(c).to_pylist() for c in ("start", "body", "lo", "hi", "ahead", "lost"))
            ):
                if lost:  # the text goes on as it is, without what the next chunk has too
                    ids.append(None)
                    raw_text.append(body if ahead is None else body[: ahead - start])
                    continue
                # from a border on, matches are those of the whole text; the last ones may be cut and go
                found, at, used = own.pattern.findall(body[lo - start :].decode()), lo, 0
                stop = start + len(body) if hi is None else hi
                while at < stop:
                    at += len(found[used].encode())
                    used += 1
                ids.append(own.encode_pieces(found[:used]).tobytes())
                raw_text.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("chunk"), pa.array(ids, pa.binary()), pa.array(raw_text, pa.binary())],
                names=["row", "chunk", "ids", "raw"],
            )

    def together(key: tuple, part: pa.Table, rows: pa.Table) -> pa.Table:
        part = part.sort_by("chunk")
        if part["raw"].null_count < part.num_rows:
            ids = coder(path, pattern).encode(b"".join(part["raw"].to_pylist()).decode()).tobytes()
        else:
            ids = b"".join(part["ids"].to_pylist())
        rows = rows.take(np.repeat(np.arange(rows.num_rows), rows["__times"].to_numpy()))
        return pa.table([*(rows[c] for c in names), pa.array([ids] * rows.num_rows, pa.binary())], names=[*names, "ids"])

    out = src.where(~is_long).mapInArrow(whole, f"{kinds}ids binary")
    # long texts: equal rows are encoded once, and the chunks are shuffled once
    long = src.where(is_long).withColumn("__row", F.xxhash64(*src.columns))
    rows = long.groupBy("__row", *names).agg(F.count("*").alias("__times"))
    chunks = long.select("__row", "__text").mapInArrow(cut_up, "row bigint, chunk bigint, start bigint, body binary")
    chunks = chunks.repartition("row", "chunk").dropDuplicates(["row", "chunk"])
    edges = chunks.mapInArrow(overlaps, "row bigint, chunk bigint, start bigint, head array<bigint>, tail array<bigint>")
    order = Window.partitionBy("row").orderBy("chunk")
    met = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    lo = F.when(F.col("chunk") == 0, 0).otherwise(met)
    edges = edges.select("row", "chunk", lo.alias("lo"), F.lead("start").over(order).alias("ahead"))
    lost = F.max(F.col("lo").isNull()).over(Window.partitionBy("row"))
    edges = edges.withColumns({"hi": F.lead("lo").over(order), "lost": lost})
    stitched = chunks.join(edges, ["row", "chunk"]).mapInArrow(spans, "row bigint, chunk bigint, ids binary, raw binary")
    rest = stitched.groupBy("row").cogroup(rows.groupBy("__row")).applyInArrow(together, f"{kinds}ids binary")
    return out.unionByName(rest)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids; without ids, no bytes."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields) + ", decoded binary"
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for b in pieces(batches, "ids"):
            found = [own.decode(np.frombuffer(x or b"", np.uint32)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, schema)


def digests(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Number of ids, sha256 of the ids in decimal joined by spaces, and sha256 of the decoded bytes."""
    src = encoded.select(*[F.col(f"`{c}`") for c in keep], "ids")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in src.schema.fields[:-1])
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for b in pieces(batches, "ids"):
            n, a, d = [], [], []
            for x in b.column("ids").to_pylist():
                ids = np.frombuffer(x, np.uint32)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join([own.text_of[i] for i in ids.tolist()]).encode()).hexdigest())
                d.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(n, pa.int64()), pa.array(a), pa.array(d)],
                names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return src.mapInArrow(run, f"{kinds}n_tokens bigint, ids_sha256 string, decoded_sha256 string")
