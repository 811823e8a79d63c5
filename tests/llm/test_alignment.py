"""Alignment of two tokenizers against brute force with both libraries."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import reduce

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import alignment

SF = "/root/testdata/sf0.001"
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN


def spans(ids, tokens):
    out, at = [], 0
    for i, t in zip(ids, tokens):
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


@pytest.fixture(scope="module")
def encode():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelt = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}

    def run(text):
        if not text:
            return [], []
        e, ids = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        first = [bytes(spelt[c] for c in t) for t in e.tokens]
        second = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        if not b"".join(first) == b"".join(second) == (" " + text).encode():
            return [], []
        return spans(e.ids, first), spans(ids, second)

    return run


def brute(texts, encode):
    seen, linked = [], Counter()
    for text in texts:
        a, b = encode(text)
        groups, links, i, j = [], [], 0, 0
        for end in sorted({x[2] for x in a} & {x[2] for x in b}):
            k = next(k for k in range(i, len(a)) if a[k][2] == end) + 1
            m = next(m for m in range(j, len(b)) if b[m][2] == end) + 1
            groups.append(",".join(str(x[0]) for x in a[i:k]) + "|" + ",".join(str(x[0]) for x in b[j:m]))
            links += [(x[0], y[0]) for x in a[i:k] for y in b[j:m] if x[1] < y[2] and y[1] < x[2]]
            i, j = k, m
        linked.update(links)
        seen.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, y), n in linked.items():
        best[y] = max(best[y], n)
    return [
        (
            a, b, len(groups), len(links), sum(linked[x] == best[x[1]] for x in links), sum(linked[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "", ";".join(groups),
        )
        for a, b, groups, links in seen
    ]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    marks = "ab  \n\t é 中文 the quick . ,<|endoftext|>\U0001f600 1 23\x1c　"
    docs += ["".join(rng.choice(marks) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    docs += [None, "", " ", "  ", "a ", "\n", " \n x", "x▁y", "<s> </s>", "a\n\n  b", "\x00", "x" * 5000, "thxe. "]
    docs += [" ".join(d for d in docs[:9]), "  ".join(docs[20:26]), "中文" * 700 + " x " + "a b" * 900]
    return docs + docs[-3:] * 2


@pytest.mark.parametrize("chunk", [1 << 16, 256])
def test_whole_and_chunked(spark, encode, texts, chunk):
    docs = spark.createDataFrame([(i, t, 7, "mine") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, row string")
    got = alignment.aligned(docs, *PATHS, keep=("doc_id", "n_a", "row"), chunk=chunk, groups=True).collect()
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
    assert {(r.row.n_a, r.row.row) for r in got} == {(7, "mine")}
    assert [tuple(r[n] for n in names) for r in sorted(got, key=lambda r: r.row.doc_id)] == brute(texts, encode)


def test_compose_is_associative(encode):
    a, b = encode("unbelievable internationalisation of tokenizers, naïvely " * 8)
    size, ids = a[-1][2], 32_000
    want = alignment.whole(alignment.fragment(*[([x[0] for x in t], [x[2] for x in t]) for t in (a, b)], ids), ids)
    rng = random.Random(4)
    for _ in range(60):
        cuts = [0, *sorted(rng.sample(range(1, size), rng.randint(1, 12))), size]
        parts = []
        for lo, hi in zip(cuts, cuts[1:]):
            sides = [[x for x in t if lo < x[2] <= hi] for t in (a, b)]
            parts.append(alignment.fragment(*[([x[0] for x in s], [x[2] for x in s]) for s in sides], ids))
        k = rng.randint(0, len(parts))
        left, right = (reduce(lambda f, g: alignment.compose(f, g, ids), p, alignment.EMPTY) for p in (parts[:k], parts[k:]))
        assert alignment.whole(alignment.compose(left, right, ids), ids) == want


def test_remembered_stretches_are_forgotten_in_turn(monkeypatch, encode):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    own = alignment.Tokenizers(*PATHS)
    for text in ("one two three four five", "five six one", "two seven  eight\n", "one two three"):
        a, b = encode(text)
        found = own.document(text)
        assert found[2:] == (len(a), len(b)) and len(own.young) <= 3 + 5


def test_odd_rows(spark, odd, encode):
    rows = odd.select("doc_id", "text").collect()
    got = alignment.aligned(odd.withColumn("batch", F.lit(1)), *PATHS, keep=tuple(odd.columns) + ("batch",)).collect()
    want = brute([r.text for r in rows], encode)
    assert sorted((str(r.row.doc_id), r.n_a, r.n_links, r.count_sum, r.groups_sha256) for r in got) == sorted(
        (str(r.doc_id), w[0], w[3], w[5], w[6]) for r, w in zip(rows, want)
    )


def test_empty_table(none):
    assert alignment.aligned(none, *PATHS).collect() == []
