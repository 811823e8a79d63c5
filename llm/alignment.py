"""Tokens of two tokenizers aligned by the bytes they cover.

Both tokenizers cut the same bytes.  Offsets where a token of each ends cut both token sequences into groups;
within a group, every byte range between two neighbouring ends belongs to one token of each, a link.

What a byte range of a document holds is a ``Fragment``: the tokens that end in it up to the first common end
(the open prefix), the closed groups behind, and the tokens after the last common end (the open suffix).
``compose`` joins the fragments of two neighbouring ranges: the suffix of the first and the prefix of the second
make one group.  It is associative and ``EMPTY`` is its neutral element, so the ranges of a very long document
are worked on by different Spark tasks and reduced in a tree.

Both tokenizers never join what stands before a space with the space, if that is no white space itself.  So a
text is tokenised by such stretches, each of which begins and ends at a common end, and the fragments of frequent
stretches are remembered.  The corpus-wide counts need a second pass: each batch of documents asks once for every
pair of ids that it links.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tables import cut
from llm.textops import pieces

CHUNK, FAN = 1 << 16, 16
BATCH_LINKS = 3_000_000
REMEMBERED = 150_000
# a space at the very end is no stretch of its own: one tokenizer gives nothing for it alone
STRETCH = re.compile(r"(?<=\S)(?= .)", re.S)
SAFE = re.compile(rb"(?<=[!-~]) (?=.)", re.S)
Tokens = tuple[list[int], list[int]]  # ids and the bytes at which they end
_pairs: dict = {}


class Fragment(NamedTuple):
    """Tokens of both tokenizers that end within a byte range; without a common end all of them are the prefix."""

    closed: bool
    prefix: tuple[Tokens, Tokens]
    groups: str
    codes: bytes
    sizes: tuple[int, int]
    suffix: tuple[Tokens, Tokens]
    broken: bool = False


NOTHING: tuple[Tokens, Tokens] = (([], []), ([], []))
EMPTY = Fragment(False, NOTHING, "", b"", (0, 0), NOTHING)


def linked(a: Tokens, b: Tokens, ids: int) -> tuple[str, bytes]:
    """The groups of tokens that begin and end at common ends, and ``a_id * ids + b_id`` of all their links."""
    groups, codes, mine, others = [], array("I"), [], []
    second = zip(*b)
    y_id, y = next(second, (0, 0))
    for x_id, x in zip(*a):
        mine.append(x_id)
        codes.append(x_id * ids + y_id)
        while y < x:  # the next token of the other side begins within this one
            others.append(y_id)
            y_id, y = next(second)
            codes.append(x_id * ids + y_id)
        if y == x:
            if others or len(mine) > 1:
                others.append(y_id)
                groups.append(f"{','.join(map(str, mine))}|{','.join(map(str, others))}")
                others = []
            else:
                groups.append(f"{x_id}|{y_id}")
            mine = []
            y_id, y = next(second, (0, 0))
    return ";".join(groups), codes.tobytes()


def joined(f: tuple[Tokens, Tokens], g: tuple[Tokens, Tokens]) -> tuple[Tokens, Tokens]:
    return tuple((x[0] + y[0], x[1] + y[1]) for x, y in zip(f, g))  # type: ignore[return-value]


def fragment(a: Tokens, b: Tokens, ids: int) -> Fragment:
    """The fragment of a range from the tokens that end in it."""
    sizes = (len(a[0]), len(b[0]))
    common = set(a[1]) & set(b[1])
    if not common:
        return EMPTY._replace(prefix=(a, b), sizes=sizes)
    first, last = min(common), max(common)
    (i, k), (j, m) = (tuple(int(np.searchsorted(t[1], x, "right")) for x in (first, last)) for t in (a, b))
    groups, codes = linked((a[0][i:k], a[1][i:k]), (b[0][j:m], b[1][j:m]), ids)
    prefix = ((a[0][:i], a[1][:i]), (b[0][:j], b[1][:j]))
    suffix = ((a[0][k:], a[1][k:]), (b[0][m:], b[1][m:]))
    return Fragment(True, prefix, groups, codes, sizes, suffix)


def compose(f: Fragment, g: Fragment, ids: int) -> Fragment:
    sizes, broken = (f.sizes[0] + g.sizes[0], f.sizes[1] + g.sizes[1]), f.broken or g.broken
    if not f.closed:
        return g._replace(prefix=joined(f.prefix, g.prefix), sizes=sizes, broken=broken)
    if not g.closed:
        return f._replace(suffix=joined(f.suffix, g.prefix), sizes=sizes, broken=broken)
    text, codes = linked(*joined(f.suffix, g.prefix), ids)
    groups = ";".join(x for x in (f.groups, text, g.groups) if x)
    return Fragment(True, f.prefix, groups, f.codes + codes + g.codes, sizes, g.suffix, broken)


def whole(f: Fragment, ids: int) -> tuple[str, bytes, int, int]:
    """Groups, links and sizes of a document's fragment; none where the tokens don't give the text back."""
    if f.broken or not f.closed:
        return "", b"", 0, 0
    text, codes = linked(*f.prefix, ids)
    return ";".join(x for x in (text, f.groups) if x), codes + f.codes, *f.sizes


class Tokenizers:
    """Both tokenizers, loaded once in each worker, and the stretches that they met lately."""

    def __init__(self, byte_path: str, piece_path: str, pattern: str):
        import sentencepiece
        import tiktoken

        # byte-level spelling: printable Latin-1 stands for itself, the other bytes for 256 and the following in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spelt = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        with open(byte_path, encoding="utf-8") as f:
            told = json.load(f)
        special = {x["id"] for x in told["added_tokens"]}
        ranks = {bytes(spelt[c] for c in t): i for t, i in told["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = {i: t for t, i in ranks.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.ids = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(self.ids)]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)
        ]
        if any(re.search("[^▁]▁", p) for p in names):
            raise ValueError("pieces that go on behind a space cannot be found stretch by stretch")
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}

    def tokens(self, stretch: str, b_ids: list[int] | None = None) -> tuple[Tokens, Tokens] | None:
        """Tokens of a space and ``stretch``; None if they don't give it back."""
        want = b" " + stretch.encode()
        a_ids, b_ids = self.a.encode_ordinary(" " + stretch), self.b.encode(stretch) if b_ids is None else b_ids
        a, b = [self.a_bytes[i] for i in a_ids], [self.b_bytes[i] for i in b_ids]
        if b"".join(a) != want or b"".join(b) != want:
            return None
        return (a_ids, list(accumulate(map(len, a)))), (b_ids, list(accumulate(map(len, b))))

    def learn(self, stretches: set[str]) -> None:
        """Remember the groups of new stretches, the latest ones and those that were used meanwhile."""
        new = []
        for s in stretches:
            if s in self.old:
                self.young[s] = self.old[s]
            else:
                new.append(s)
        for s, b_ids in zip(new, self.b.encode(new, num_threads=1) if new else []):
            # a part that ends in white space goes on in the next one
            found = () if not s or s[-1].isspace() else self.tokens(s, b_ids)
            self.young[s] = (*linked(*found, self.ids), len(found[0][0]), len(found[1][0])) if found else found

    def parts(self, parts: list[str]) -> list[tuple | None]:
        """Groups, links and sizes of each part; an empty tuple for one that goes on, None for one that is not given back."""
        missing = {p for p in parts if p not in self.young}
        if missing:
            if len(self.young) > REMEMBERED:
                self.old, self.young, missing = self.young, {}, set(parts)
            self.learn(missing)
        return [self.young[p] for p in parts]

    def stretches(self, text: str) -> tuple[list[str], list[tuple | None]]:
        """The stretches of a space and ``text``, each without the space before it, and what is known of them."""
        parts = text.split(" ")
        found = self.parts(parts)
        if () in found[:-1] or found[-1] == ():
            parts = [p[1:] for p in STRETCH.split(" " + text)]
            found = [f if f != () else self.last(p) for p, f in zip(parts, self.parts(parts))]
        return parts, found

    def last(self, part: str) -> tuple | None:
        found = self.tokens(part)
        return found and (*linked(*found, self.ids), len(found[0][0]), len(found[1][0]))

    def document(self, text: str) -> tuple[str, bytes, int, int]:
        """Groups, links and sizes of a space and a whole text; nothing for an empty one."""
        _, found = self.stretches(text) if text else ([], [])
        if not found or None in found:
            return "", b"", 0, 0
        groups, codes, a, b = zip(*found)
        return ";".join(groups), b"".join(codes), sum(a), sum(b)

    def range(self, body: bytes, start: int, lo: int, hi: int) -> Fragment:
        """The fragment of the bytes ``lo`` to ``hi`` of a text with a space before, from a piece of it that holds them."""
        out, at, run = EMPTY, start, []
        parts, found = self.stretches(body[1:].decode())

        def flush(out: Fragment) -> Fragment:
            if not run:
                return out
            groups, codes, a, b = zip(*run)
            run.clear()
            mine = Fragment(True, NOTHING, ";".join(groups), b"".join(codes), (sum(a), sum(b)), NOTHING)
            return compose(out, mine, self.ids)

        for part, known in zip(parts, found):
            end = at + 1 + len(part.encode())
            if at >= hi or end <= lo:
                pass
            elif known is None:
                return EMPTY._replace(broken=True)
            elif lo <= at and end <= hi:
                run.append(known)
            else:
                sides = []
                for ids, ends in self.tokens(part) or NOTHING:
                    mine = [(i, at + e) for i, e in zip(ids, ends) if lo < at + e <= hi]
                    sides.append(([i for i, _ in mine], [e for _, e in mine]))
                out = compose(flush(out), fragment(*sides, self.ids), self.ids)
            at = end
        return flush(out)


def tokenizers(*paths: str) -> Tokenizers:
    if paths not in _pairs:
        _pairs[paths] = Tokenizers(*paths)
    return _pairs[paths]


def ranges(text: bytes, chunk: int) -> list[tuple[int, int, int, int]]:
    """Byte ranges of a text that begins with a space, and where the stretches that hold them begin and end.

    Ranges end at multiples of ``chunk``, but not where no stretch ends near by.
    """
    out, lo, start = [], 0, 0
    for x in range(chunk, len(text), chunk):
        before = [m.start() for m in SAFE.finditer(text, x - chunk // 4, x + 2)]
        behind = SAFE.search(text, x, x + chunk // 4)
        if before and behind:
            out.append((lo, x, start, behind.start()))
            lo, start = x, before[-1]
    return [*out, (lo, len(text), start, len(text))]


def _packed(side: tuple[Tokens, Tokens]) -> bytes:
    (a, ae), (b, be) = side
    return np.array([len(a), *a, *ae, *b, *be], np.int64).tobytes()


def _unpacked(data: bytes) -> tuple[Tokens, Tokens]:
    n, *x = np.frombuffer(data, np.int64).tolist()
    m = (len(x) - 2 * n) // 2
    return (x[:n], x[n : 2 * n]), (x[2 * n : 2 * n + m], x[2 * n + m :])


FRAGMENT = "doc bigint, chunk bigint, closed boolean, prefix binary, body binary, codes binary, a bigint, b bigint, suffix binary, broken boolean"


def _table(docs: list[int], chunks: list[int], found: list[Fragment]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "doc": pa.array(docs, pa.int64()),
            "chunk": pa.array(chunks, pa.int64()),
            "closed": pa.array([f.closed for f in found], pa.bool_()),
            "prefix": pa.array([_packed(f.prefix) for f in found], pa.binary()),
            "body": pa.array([f.groups.encode() for f in found], pa.binary()),
            "codes": pa.array([f.codes for f in found], pa.binary()),
            "a": pa.array([f.sizes[0] for f in found], pa.int64()),
            "b": pa.array([f.sizes[1] for f in found], pa.int64()),
            "suffix": pa.array([_packed(f.suffix) for f in found], pa.binary()),
            "broken": pa.array([f.broken for f in found], pa.bool_()),
        }
    )


def _fragments(table: pa.Table) -> list[Fragment]:
    return [
        Fragment(r["closed"], _unpacked(r["prefix"]), r["body"].decode(), r["codes"], (r["a"], r["b"]), _unpacked(r["suffix"]), r["broken"])
        for r in table.to_pylist()
    ]


def long_fragments(docs: DataFrame, paths: tuple[str, ...], chunk: int, chunks: int) -> DataFrame:
    """One fragment for each ``doc`` of ``(doc, body)``: ranges in parallel, then a tree of ``compose``."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "body"):
            for doc, body in zip(b.column("doc").to_pylist(), b.column("body").to_pylist()):
                text = b" " + body
                for k, (lo, hi, start, end) in enumerate(ranges(text, chunk)):
                    yield pa.RecordBatch.from_pydict(
                        {"doc": [doc], "chunk": [k], "lo": [lo], "hi": [hi], "start": [start], "body": [text[start:end]]}
                    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(*paths)
        for b in pieces(batches, "body"):
            rows = b.to_pylist()
            found = [own.range(r["body"], r["start"], r["lo"], r["hi"]) for r in rows]
            yield _table([r["doc"] for r in rows], [r["chunk"] for r in rows], found)

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        ids = tokenizers(*paths).ids
        found = reduce(lambda f, g: compose(f, g, ids), _fragments(table.sort_by("chunk")))
        return pa.Table.from_batches([_table([key[0].as_py()], [key[1].as_py()], [found])])

    parts = docs.mapInArrow(cut_up, "doc bigint, chunk bigint, lo bigint, hi bigint, start bigint, body binary")
    parts = parts.dropDuplicates(["doc", "chunk"]).mapInArrow(work, FRAGMENT)  # equal rows once
    while chunks > 1:
        above = F.floor(F.col("chunk") / FAN).cast("long")
        parts = parts.groupBy("doc", above.alias("above")).applyInArrow(meet, FRAGMENT)
        chunks = -(-chunks // FAN)
    return parts


class Batch:
    """Documents whose links are numbered by one list of id pairs, the most frequent first."""

    def __init__(self, number: int):
        self.number, self.rows, self.codes, self.links = number, [], [], 0

    def add(self, row: pa.Array, times: int, found: tuple[str, bytes, int, int]) -> None:
        text, codes, a, b = found
        digest = hashlib.sha256(text.encode()).hexdigest() if a else ""
        self.rows.append((row, times, a, b, a + b - len(codes) // 4, len(codes) // 4, digest, text))
        self.codes.append(codes)
        self.links += len(codes) // 4

    def table(self, groups: bool) -> pa.RecordBatch:
        codes = np.frombuffer(b"".join(self.codes), "<u4")
        times = np.repeat([r[1] for r in self.rows], [r[5] for r in self.rows]).astype(np.int64)
        values, number = np.unique(codes, return_inverse=True)
        counts = np.bincount(number, times, len(values)).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        planes = rank[number].view(np.uint8).reshape(-1, 4).T.tobytes()
        n, rest = len(self.rows), [None] * (len(self.rows) - 1)
        columns = list(zip(*self.rows))
        return pa.RecordBatch.from_pydict(
            {
                "batch": pa.array([self.number] * n, pa.int64()),
                "spot": pa.array(range(n), pa.int32()),
                "row": pa.concat_arrays(columns[0]),
                "times": pa.array(columns[1], pa.int64()),
                **{k: pa.array(columns[i], pa.int64()) for i, k in enumerate(NUMBERS, 2)},
                "groups_sha256": pa.array(columns[6], pa.string()),
                "groups": pa.array(columns[7] if groups else [None] * n, pa.string()),
                "codes": pa.array([values[order].astype("<u4").tobytes(), *rest], pa.binary()),
                "counts": pa.array([counts[order].tobytes(), *rest], pa.binary()),
                "links": pa.array([zlib.compress(planes, 1), *rest], pa.binary()),
            }
        )


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def _batches(found: Iterator[tuple], groups: bool, sign: int) -> Iterator[pa.RecordBatch]:
    """``found`` yields (row, times, groups, links and sizes)."""
    task, k = TaskContext.get().partitionId() << 32, 0
    own = Batch(sign * (task + 1))
    for row, times, what in found:
        own.add(row, times, what)
        if own.links >= BATCH_LINKS or len(own.rows) >= 50_000:
            yield own.table(groups)
            k += 1
            own = Batch(sign * (task + k + 1))
    if own.rows:
        yield own.table(groups)


def aligned(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    pattern: str,
    keep: tuple[str, ...] = ("doc_id",),
    text: str = "text",
    chunk: int = CHUNK,
    groups: bool = False,
) -> DataFrame:
    """``row``, the struct of the ``keep`` columns of every document, with numbers of its alignment.

    The text, with a space before it, is encoded by both vocabularies without special tokens.  ``n_a``, ``n_b`` and
    ``n_groups`` count tokens and groups; ``n_links`` the links; ``n_best`` those whose pair of ids is linked as
    often in the whole corpus as any pair with the same second id; ``count_sum`` adds up how often each
    link's pair is linked in the corpus.  ``groups_sha256`` is the digest of ``a1,a2|b1;a3|b2,b3``, which the
    column ``groups`` holds if asked for.  Null and empty texts, and those that either tokenizer doesn't give back,
    have zeros and empty strings; repeated rows count as often as they stand there.
    """
    paths = (byte_path, piece_path, pattern)
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").cast("binary").alias("body"))
    size = F.octet_length("body")
    most = src.agg(F.max(size)).first()[0] or 0
    kind = src.schema["row"].dataType.simpleString()
    sealed = (
        f"batch bigint, spot int, row {kind}, times bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "groups_sha256 string, groups string, codes binary, counts binary, links binary"
    )

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            own = tokenizers(*paths)
            for b in pieces(batches, "body"):
                rows = b.column("row")
                for k, t in enumerate(b.column("body").to_pylist()):
                    yield rows.slice(k, 1), 1, own.document((t or b"").decode())

        return _batches(found(), groups, 1)

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            ids = tokenizers(*paths).ids
            for b in pieces(batches, "body"):
                rows = b.column("row")
                times = b.column("times").to_pylist()
                for k, f in enumerate(_fragments(pa.Table.from_batches([b]))):
                    yield rows.slice(k, 1), times[k], whole(f, ids)

        return _batches(found(), groups, -1)

    is_long = F.coalesce(size > 2 * chunk, F.lit(False))
    sealed_rows = src.where(~is_long).mapInArrow(short, sealed)
    if most > 2 * chunk:
        mine = src.where(is_long).withColumn("doc", F.xxhash64("row", "body"))
        found = long_fragments(mine.select("doc", "body"), paths, chunk, -(-(most + 1) // chunk))
        named = mine.groupBy("doc", "row").agg(F.count("*").alias("times"))
        sealed_rows = sealed_rows.unionByName(found.join(named, "doc").mapInArrow(long, sealed))
    rows = cut(sealed_rows)
    return _scored(rows, kind, tokenizers(*paths).ids, groups)


def _scored(rows: DataFrame, kind: str, ids: int, groups: bool) -> DataFrame:
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, codes, counts in zip(*(b.column(c).to_pylist() for c in ("batch", "codes", "counts"))):
                code = np.frombuffer(codes, "<u4").astype(np.int64)
                for lo in range(0, len(code), 50_000):
                    part = code[lo : lo + 50_000]
                    some = [np.full(len(part), number), part, np.frombuffer(counts, np.int64)[lo : lo + 50_000]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in some], names=["batch", "code", "n"])

    named = f"row {kind}, times bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string"

    def finish(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.sort_by("spot")
        codes = np.frombuffer(docs["codes"][0].as_py(), "<u4")
        planes = np.frombuffer(zlib.decompress(docs["links"][0].as_py()), np.uint8)
        rank = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()
        told = answers["code"].to_numpy()
        spot = np.argsort(told)[np.searchsorted(np.sort(told), codes)] if len(codes) else np.zeros(0, np.int64)
        total, best = answers["total"].to_numpy()[spot][rank], answers["best"].to_numpy()[spot][rank]
        ends = np.cumsum(docs["n_links"].to_numpy())
        begin = np.r_[0, ends[:-1]]
        sums = [np.r_[0, np.cumsum(x.astype(np.int64))] for x in (best, total)]
        out = docs.select(["row", "times", *NUMBERS, "groups_sha256", "groups"])
        for name, s in zip(("n_best", "count_sum"), sums):
            out = out.append_column(name, pa.array(s[ends] - s[begin]))
        return out

    asked = rows.where("spot = 0").select("batch", "codes", "counts").mapInArrow(unpack, "batch bigint, code bigint, n bigint")
    totals = cut(asked.groupBy("code").agg(F.sum("n").alias("total")))
    # at most one row for each piece of the vocabulary
    best = totals.groupBy((F.col("code") % ids).alias("b")).agg(F.max("total").alias("most"))
    scored = totals.join(F.broadcast(best), F.col("code") % ids == F.col("b"))
    scored = scored.select("code", "total", (F.col("total") == F.col("most")).alias("best"))
    answers = asked.select("batch", "code").join(scored, "code")
    out = rows.groupBy("batch").cogroup(answers.groupBy("batch"))
    out = out.applyInArrow(finish, f"{named}, n_best bigint, count_sum bigint")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    last = ["groups"] if groups else []
    return out.select("row", *NUMBERS, "n_best", "count_sum", "groups_sha256", *last)
