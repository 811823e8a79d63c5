"""Token ids as length-delimited binary records.

A shard is a file of records; each is framed as ``uint64 length, uint32 masked crc32c of those 8 bytes,
payload, uint32 masked crc32c of the payload``, little-endian.  The mask is ``rotate_right(crc, 15) +
0xA282EAD8``.  A payload is ``int64 doc_id``, one byte that tells whether there is an id, one byte with the bytes of
a token id (2 for vocabularies of up to 65,536 entries, else 4), and the token ids.  Beside ``x.rec`` lies ``x.idx``: the offset of every record and of the end, as ``uint64``, so records
can be read in any order.

Documents are range-partitioned by id, each task encodes and streams its range into one shard, and only the
shards named by the tasks that succeeded are read: a task that runs twice leaves a file that nobody names.
"""

from __future__ import annotations

import os
import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.tables import cut, ensure_checkpoint_dir
from llm.textops import Words, pieces, raw

MASK = 0xA282EAD8
HEAD = 12
# words, and as many parts of words, whose ids a worker remembers in each of two generations; the memory is bounded and
# the ids do not depend on it
REMEMBERED = 250_000
# texts of about this many bytes are looked up at once, each distinct word of them one time
TOGETHER = 4 << 20
# between these two ASCII characters the pre-tokenizer always cuts: at digits, and between letters and marks, where an
# apostrophe may belong to the letters behind it
CUT = re.compile(
    rb"(?<=[0-9])(?=[!-~])|(?<=[!-~])(?=[0-9])|(?<=[A-Za-z])(?=[!-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[A-Za-z])"
)
TARGET_BYTES = 16 << 20
_tokenizers: dict = {}


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """States after one and after two zero bytes, by the low bits of the state; reflected polynomial 0x82F63B78."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ (np.uint32(0x82F63B78) * (one & np.uint32(1)))
    two = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(2):
        two = one[two & np.uint32(0xFF)] ^ (two >> np.uint32(8))
    return one, two


_ONE, _TWO = _crc_tables()


def _shift_tables(matrix: np.ndarray) -> np.ndarray:
    """Four tables of 256 for the linear map whose columns (images of the 32 bits) are ``matrix``."""
    out = np.zeros((4, 256), np.uint32)
    for b in range(4):
        for bit in range(8):
            out[b, np.arange(256) >> bit & 1 == 1] ^= matrix[b * 8 + bit]
    return out


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


def _zeros_after() -> list[np.ndarray]:
    """Tables that carry a crc state over 1, 2, 4, ... zero bytes."""
    state = np.uint32(1) << np.arange(32, dtype=np.uint32)
    state = _ONE[state & np.uint32(0xFF)] ^ (state >> np.uint32(8))
    out = []
    for _ in range(48):
        out.append(_shift_tables(state))
        state = _apply(out[-1], state)
    return out


_ZEROS = _zeros_after()
_LANE = 7  # 2**7 bytes a lane


def crc32c(records: list[bytes]) -> np.ndarray:
    """crc32c of each record; all records run side by side in lanes of 128 bytes."""
    sizes = np.array([len(r) for r in records], np.int64)
    lane = 1 << _LANE
    lanes = np.maximum(-(-sizes // lane), 1)
    # records end where their last lane ends: leading zeros leave a zero state as it is
    zeros = bytes(lane)
    parts: list[bytes] = []
    for r, pad in zip(records, (lanes * lane - sizes).tolist()):
        parts += (zeros[:pad], r)
    padded = np.frombuffer(b"".join(parts), np.uint8)
    words = padded.view(np.uint16).reshape(-1, lane // 2)
    state = np.zeros(len(words), np.uint32)
    for k in range(lane // 2):
        state = _TWO[(state ^ words[:, k]) & np.uint32(0xFFFF)] ^ (state >> np.uint32(16))
    level = _LANE
    while len(state) > len(sizes):  # join pairs of lanes, again aligned to the ends
        half = -(-lanes // 2)
        new_ends = np.cumsum(half)
        grid = np.zeros(2 * int(new_ends[-1]), np.uint32)
        grid[np.arange(len(state)) + np.repeat(2 * new_ends - np.cumsum(lanes), lanes)] = state
        state = _apply(_ZEROS[level], grid[0::2]) ^ grid[1::2]
        lanes, level = half, level + 1
    start = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for bit in range(int(sizes.max()).bit_length() if len(sizes) else 0):
        on = (sizes >> bit & 1).astype(bool)
        start[on] = _apply(_ZEROS[bit], start[on])
    return state ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def framed(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The records of ``payloads`` and their lengths with frames."""
    sizes = np.array([len(p) for p in payloads], np.uint64)
    heads = [n.tobytes() for n in sizes]
    parts = []
    for h, hc, p, pc in zip(heads, masked(crc32c(heads)), payloads, masked(crc32c(payloads))):
        parts += (h, hc.tobytes(), p, pc.tobytes())
    return b"".join(parts), sizes.astype(np.int64) + HEAD + 4


def unframed(block: bytes, offsets: np.ndarray) -> list[bytes]:
    """Payloads of the records at ``offsets`` (and the end); raises when a length or checksum is wrong."""
    view = memoryview(block)
    spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
    heads, body = [bytes(view[a : a + 8]) for a, _ in spans], [bytes(view[a + HEAD : b - 4]) for a, b in spans]
    if [int.from_bytes(h, "little") for h in heads] != [len(p) for p in body]:
        raise ValueError("a record's length is not what the index says")
    if [c.tobytes() for c in masked(crc32c(heads))] != [bytes(view[a + 8 : a + HEAD]) for a, _ in spans]:
        raise ValueError("a length's checksum is wrong")
    if [c.tobytes() for c in masked(crc32c(body))] != [bytes(view[b - 4 : b]) for _, b in spans]:
        raise ValueError("a payload's checksum is wrong")
    return body


class Memory:
    """The ids of what a worker met lately: the young generation becomes the old one when it is full."""

    def __init__(self):
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def missing(self, names: list[bytes]) -> list[bytes]:
        """Names that are not known; those of the old generation become young again."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for n in names:
            if n not in young:
                if n in old:
                    young[n] = old[n]
                else:
                    out.append(n)
        return out


class WordEncoder:
    """Ids of whole texts by the tokenizers library.

    The vocabulary's pre-tokenizer drops white space and never joins across it, so the ids of a text are those of
    its white-space separated words.  A word met again is looked up, and so are the parts of a new one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # a text's strings of added tokens are these tokens, as is the library's default
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.words, self.parts = Memory(), Memory()
        # which ids end a pre-token; None where the vocabulary has no such mark
        vocabulary = self.tokenizer.get_vocab()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = None
        if suffix:
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encode(self, column: pa.Array, end_id: int) -> list[bytes]:
        """Little-endian ids of each text, ``width`` bytes each, and the end's."""
        words = Words(*raw(column))
        bounds = np.zeros(len(words.starts) + 1, np.int64)
        np.cumsum(words.ends - words.starts, out=bounds[1:])
        body = [None, pa.py_buffer(bounds), pa.py_buffer(words.data[words.inside])]
        found = pa.Array.from_buffers(pa.large_binary(), len(words.starts), body).dictionary_encode()
        data, offsets = raw(found.dictionary)
        data, offsets = data.tobytes(), offsets.tolist()
        names = [data[a:b] for a, b in zip(offsets, offsets[1:])]
        if new := self.words.missing(names):
            self._learn(new)
        ids = [*map(self.words.young.__getitem__, names)]
        # the ids of all words one after the other, an end behind those of each text
        sizes = np.array([*map(len, ids), self.width]) // self.width
        begin, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids) + np.array([end_id], self.kind).tobytes(), self.kind)
        which = np.insert(found.indices.to_numpy(), words.at[1:], len(names))
        many = sizes[which]
        ends = np.cumsum(many)
        out = flat[np.arange(int(many.sum())) + np.repeat(begin[which] - (ends - many), many)].tobytes()
        stops = ends[words.at[1:] + np.arange(len(words.counts))] * self.width
        return [out[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words by their parts.  ASCII parts are lowered, as the normalizer does.  Added tokens are found
        before anything is cut, in their own case and marks: words with such strings stay as they are."""
        alone, split, parts = [], [], []
        for w in words:
            if w.isalpha():
                alone.append(w)
                parts.append(w.lower())
                continue
            if b"<" in w and any(t in w.lower() for t in self.added):
                some = [w]
            else:
                some = CUT.split(w.lower() if w.isascii() else w)
            if len(some) == 1:
                alone.append(w)
                parts.append(some[0])
            else:
                # parts between ASCII characters; only those without others are lowered here
                some = tuple([p.lower() if p.isascii() else p for p in some])
                split.append((w, some))
        new = self.parts.missing(list({*parts, *chain.from_iterable([x for _, x in split])}))
        known, kind = self.parts.young, "H" if self.width == 2 else "I"
        if self.last is not None:
            # ASCII letters are one pre-token: thousands of such parts are one text, cut at the ends of pre-tokens
            letters, new = [p for p in new if p.isalpha()], [p for p in new if not p.isalpha()]
            for k in range(0, len(letters), 5_000):
                some = letters[k : k + 5_000]
                if (ids := self._joined(some)) is None:
                    new += some
                else:
                    known.update(zip(some, ids))
        for k in range(0, len(new), 20_000):
            some = new[k : k + 20_000]
            ids = self.tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)
            known.update(zip(some, [array(kind, e.ids).tobytes() for e in ids]))
        young = self.words.young
        young.update(zip(alone, map(known.__getitem__, parts)))
        for w, some in split:
            young[w] = b"".join([known[p] for p in some])

    def _joined(self, parts: list[bytes]) -> list[bytes] | None:
        """Ids of parts that are one pre-token each, encoded as one text; None if the ends don't match the parts."""
        text = b" ".join(parts).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        ends = (np.flatnonzero(self.last[ids]) + 1) * self.width
        if len(ends) != len(parts) or ends[-1] != ids.nbytes:
            return None
        flat, ends = ids.tobytes(), ends.tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


def _encoder(path: str) -> WordEncoder:
    if path not in _tokenizers:
        _tokenizers[path] = WordEncoder(path)
    return _tokenizers[path]


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text", shards: int | None = None
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write shards in ascending ``doc_id`` order (no id first).

    Returns ``(shard, path, docs, tokens)``, in order of the shards; null texts are empty.  Rows of one id stand
    in order of a hash of their texts.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("__text"))
    if shards is None:
        size = src.agg(F.sum(F.octet_length("__text"))).first()[0] or 0
        shards = max(1, -(-size // TARGET_BYTES))
    # ranges are drawn from a sample of ids and hashes, not of texts
    order = [F.col("doc_id"), F.xxhash64("__text")]
    ordered = src.repartitionByRange(shards, *order).sortWithinPartitions(*order, "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(tokenizer)
        width = bytes([encoder.width])
        fs, base = pafs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name = f"{base}/{shard:08d}-{uuid.uuid4().hex}"
        docs_done = tokens = at = 0
        offsets = []
        out = None
        for b in pieces(batches, "__text", TOGETHER):
            if out is None:
                out = fs.open_output_stream(f"{name}.rec")
            ids = encoder.encode(b.column("__text"), end_id)
            keys = b.column("doc_id")
            known = keys.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
            keys = keys.fill_null(0).to_numpy()
            block, sizes = framed([k.tobytes() + v.tobytes() + width + x for k, v, x in zip(keys, known, ids)])
            out.write(block)
            offsets.append(at + np.cumsum(sizes) - sizes)
            at += int(sizes.sum())
            docs_done += len(ids)
            tokens += sum(map(len, ids)) // encoder.width
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{name}.idx") as index:
            index.write(np.append(np.concatenate(offsets), at).astype("<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name.rpartition("/")[2]], "docs": [docs_done], "tokens": [tokens]})

    return cut(ordered.mapInArrow(run, "shard bigint, name string, docs bigint, tokens bigint"))


def read_records(spark: SparkSession, folder: str, written: DataFrame, batch: int = 1 << 20) -> DataFrame:
    """The records of the shards in ``written``, checked: ``doc_id, start, n_tokens, ids`` (binary, uint32).

    ``start`` is the number of ids in all records before.  One row a shard meets on the driver for these sums; the
    records are read by the executors, some megabytes at a time, by the offset index.
    """
    rows = sorted(written.collect(), key=lambda r: r["shard"])
    before = np.cumsum([0, *(r["tokens"] for r in rows)])
    jobs = [(r["name"], int(b)) for r, b in zip(rows, before)]
    todo = spark.createDataFrame(jobs, "name string, start bigint").repartition(max(1, len(jobs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist()):
                with fs.open_input_stream(f"{base}/{name}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
                with fs.open_input_file(f"{base}/{name}.rec") as f:
                    lo = 0
                    while lo < len(offsets) - 1:
                        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + batch, "right")) - 1)
                        block = f.read_at(int(offsets[hi] - offsets[lo]), int(offsets[lo]))
                        found = unframed(block, offsets[lo : hi + 1] - offsets[lo])
                        ids = [p[10:] if p[9] == 4 else np.frombuffer(p, "<u2", offset=10).astype("<u4").tobytes() for p in found]
                        sizes = np.array([len(x) // 4 for x in ids], np.int64)
                        keys = np.array([int.from_bytes(p[:8], "little", signed=True) for p in found], np.int64)
                        starts = start + np.cumsum(sizes) - sizes
                        start += int(sizes.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys, mask=np.array([p[8] == 0 for p in found])), pa.array(starts), pa.array(sizes), pa.array(ids, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )
                        lo = hi

    return todo.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def records_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    base = ensure_checkpoint_dir(spark)
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    base = base.replace("file:/", "file:///", 1) if base.startswith("file:/") and not base.startswith("file://") else base
    folder = f"{base.rstrip('/')}/records-{uuid.uuid4().hex}"
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    return folder

