"""Operators on texts against brute force, on odd rows, on an empty table, and on given rows."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm import bpe, licences, mixing, ngram_join, outliers, quality_fm, records, rlz, textops, toxicity

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def given(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.unionByName(odd.select(F.col("doc_id") + 1_000_000, *odd.columns[1:5]).toDF(*docs.columns), True)


def base(text):
    ws, text = words(text), text or ""
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if words(line):
            repeated += line in seen
            seen.add(line)
    count = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {i + k for i in range(len(ws) - 7) if count[tuple(ws[i : i + 8])] > 1 for k in range(8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_base_statistics(given):
    got = Counter(tuple(r) for r in outliers.statistics(given, keep=("doc_id",)).drop("n_lines").collect())
    assert got == Counter((r.doc_id, *base(r.text)) for r in given.collect())


def test_repeated_lines_and_windows(spark):
    text = "a b\n\n a b\na b\n" + "p q r s t u v w " * 3
    row = outliers.statistics(spark.createDataFrame([(1, text, "x", "y")], "doc_id int, text string, lang string, source string")).first()
    assert tuple(row)[3:8] == base(text)


def test_chi2():
    assert outliers.chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3)


def test_tables_of_cells_are_one_file(spark, given, monkeypatch):
    """Few cells: one file each time, however many tasks have summed them; only the rows keep a file a task."""
    settings = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    files = []
    monkeypatch.setattr(outliers, "cut", lambda df: files.append((df.columns, (done := df.checkpoint()).rdd.getNumPartitions())) or done)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        outliers.quality_rules(given).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(files) > 15
    assert {n for columns, n in files if "n_words" not in columns} == {1}


def test_outliers_are_rejected_and_the_rest_is_kept(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        ws = ["w" * int(rng.integers(2, 8)) + str(rng.integers(999)) for _ in range(int(rng.integers(80, 200)))]
        text = " ".join(ws) if i % 20 else " ".join(w + "$%&#" for w in ws)
        rows.append((i, text, "en", "a" if i % 3 else "hot"))
    got = outliers.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(0, 400, 20))


def test_moderate_junk_is_rejected(spark):
    """15 % symbols: beyond any usual cut-off, but within the bound that sums of floors and covariances left."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        ws = ["w" * int(rng.integers(2, 8)) + str(rng.integers(100, 999)) for _ in range(int(rng.integers(80, 200)))]
        text = " ".join(ws) if i % 20 else " ".join(w + ("#" if k % 3 else "##") for k, w in enumerate(ws))
        rows.append((i, text, "en", "a"))
    got = outliers.quality_rules(spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(0, 400, 20))


def test_floors_are_a_minimum():
    floor = np.array([0.5, 0.1, 0.2])
    turn = np.linalg.qr(np.random.default_rng(10).normal(size=(3, 3)))[0]
    wide = turn @ np.diag([4.0, 9.0, 1.5]) @ turn.T * np.outer(floor, floor)
    np.testing.assert_allclose(outliers.at_least(wide, floor), wide)
    np.testing.assert_allclose(outliers.at_least(np.zeros((3, 3)), floor), np.diag(floor**2))
    thin = turn @ np.diag([4.0, 0.01, 1.5]) @ turn.T * np.outer(floor, floor)
    np.testing.assert_allclose(outliers.at_least(thin, floor), turn @ np.diag([4.0, 1.0, 1.5]) @ turn.T * np.outer(floor, floor))


def test_mcd_centre_resists_a_quarter_of_bad_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.normal(200, 20)), int(rng.normal(1000, 80)), 0 if i % 5 else 900, 0, 0, 5, "en", "a") for i in range(500)]
    names = ["doc_id", *outliers.STATS, "lang", "source"]
    got = outliers.mcd_verdicts(spark.createDataFrame(rows, names), F.lit(True)).collect()
    assert {r.doc_id for r in got if r.outlier} == {i for i in range(500) if i % 5 == 0}


def test_crc32c():
    sizes = [9, 0, 1, 127, 128, 129, 5000]
    data = [b"123456789"] + [np.random.default_rng(n).bytes(n) for n in sizes[1:]]

    def slow(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 * (c & 1))
        return c ^ 0xFFFFFFFF

    assert records.crc32c(data).tolist() == [slow(d) for d in data]
    assert slow(b"123456789") == 0xE3069283


def test_added_tokens_in_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), records.WordEncoder(path)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y.", "<|endoftext|>", "<|EndOfText|> <|ENDOFTEXT|>", "\u00e9t\u00e9<|endoftext|>?!", "Word<|endoftext|>", "<|endoftext|"]
    got = [np.frombuffer(b, encoder.kind).tolist()[:-1] for b in encoder.encode(pa.array(texts), 1)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0][1] == 49407


def test_records_round_trip(spark, given):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    folder = records.records_folder(spark)
    written = records.write_records(given, folder, public_tokenizers.path("word_bpe_49k.json"), 1, shards=3)
    got = records.read_records(spark, folder, written, batch=50_000).orderBy("start").collect()
    rows = given.withColumn("h", F.xxhash64(F.col("text").cast("binary"))).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.text is not None, (r.text or "").encode()))
    start = 0
    for g, r in zip(got, rows, strict=True):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, start, len(ids))
        assert bytes(g.ids) == np.array(ids, "<u4").tobytes()
        start += len(ids)


def test_damage_is_found():
    block, sizes = records.framed([b"abc", b"defgh"])
    offsets = np.cumsum([0, *sizes])
    assert records.unframed(block, offsets) == [b"abc", b"defgh"]
    for at in range(len(block)):
        bad = bytearray(block)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            records.unframed(bytes(bad), offsets)


@pytest.mark.parametrize("chunk, overlap", [(500, 64), (bpe.CHUNK, bpe.OVERLAP)])
def test_bpe(given, chunk, overlap):
    own = bpe.coder(*BPE)
    encoded = bpe.encode(given, *BPE, chunk=chunk, overlap=overlap)
    got = Counter(tuple(r) for r in bpe.digests(encoded, *BPE).collect())
    want = Counter()
    for r in given.collect():
        ids = own.library.encode_ordinary(r.text or "")
        a, b = " ".join(map(str, ids)), r.text or ""
        want[r.doc_id, len(ids), hashlib.sha256(a.encode()).hexdigest(), hashlib.sha256(b.encode()).hexdigest()] += 1
    assert got == want


def test_bpe_without_common_border(spark):
    texts = ["a" * 3000, " " * 2000 + "x" + "\n" * 2000, "it's  'll é " * 300, "日本語" * 800]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    back = bpe.decode(bpe.encode(docs, *BPE, chunk=400, overlap=40), *BPE).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == dict(enumerate(texts))
    own = bpe.coder(*BPE)
    for r in back:
        assert np.frombuffer(r.ids, np.uint32).tolist() == own.library.encode_ordinary(texts[r.doc_id])


def components_of(rows):
    sets = []
    for r in rows:
        ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets.append({tuple(ws[k : k + 3]) for k in range(len(ws) - 2)} if len(ws) > 2 else ({tuple(ws)} if ws else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = Counter()
    for members in groups.values():
        ids = [rows[i].doc_id for i in members if rows[i].doc_id is not None]
        for i in members:
            out[rows[i].doc_id, len(sets[i]), min(ids) if ids else None] += 1
    return out


def test_ngram_join(given):
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(given).collect())
    assert got == components_of(given.collect())


def test_ngram_join_around_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 2_000)  # several blocks for one group
    rng = np.random.default_rng(3)
    first = [f"t{i}" for i in range(150)]
    rows = [(0, " ".join(first))]
    for i in range(1, 60):
        ws = list(first)
        for at in rng.choice(150, int(rng.integers(0, 7)), replace=False):
            ws[at] = f"e{i}_{at}"
        rows.append((i, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(docs).collect())
    want = components_of(docs.collect())
    assert got == want and len({k[2] for k in want}) > 5


def test_tiles_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    for n in (9, 12, 50, 147, 301, 2000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            d = ngram_join.allowed(len(a))
            drop = int(rng.integers(0, d + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, d - drop, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 90 * (len(a) + len(b) - both):
                assert len(np.intersect1d(ngram_join.tiles(a), ngram_join.tiles(b)))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_substring_dedup(given):
    rows = given.collect()
    seen = Counter()
    for r in rows:
        ws = words(r.text)
        seen.update({tuple(ws[k : k + 35]): 0 for k in range(len(ws) - 34)})
        for k in range(len(ws) - 34):
            seen[tuple(ws[k : k + 35])] += 1
    want = Counter()
    for r in rows:
        ws = words(r.text)
        gone = {k + i for k in range(len(ws) - 34) if seen[tuple(ws[k : k + 35])] > 1 for i in range(35)}
        want[r.doc_id, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)] += 1
    got = rlz.substring_dedup(given).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
    for r in got:
        covered = {k for f in r.factors for k in range(f.start, f.start + f.length)}
        assert len(covered) == r.n_removed and all(f.length >= 35 for f in r.factors)


def test_periodic_text(spark):
    docs = spark.createDataFrame([(1, "a b c " * 30), (2, "a " * 35), (3, "z " * 36)], "doc_id int, text string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in rlz.substring_dedup(docs, verbatim=True).collect()}
    assert got == {1: (90, ""), 2: (0, "a " * 35), 3: (36, "")}


def test_permutation(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        ids, key = spark.range(n), [F.lit(5), F.lit(n)]
        out = ids.select("id", mixing.permuted(F.col("id"), F.lit(n).cast("long"), key).alias("p"))
        out = out.withColumn("back", mixing.permuted(F.col("p"), F.lit(n).cast("long"), key, True)).collect()
        assert sorted(r.p for r in out) == list(range(n)) and all(r.id == r.back for r in out)


def test_mix(given):
    docs = mixing.sizes(given)
    got = mixing.taken(docs).collect()
    assert sorted(got, key=repr) == sorted(mixing.taken(docs).collect(), key=repr)
    rows = given.collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, len(words(r.text))) for r in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, full, target = sum(sizes.values()), set(), {}
    while True:
        share = left / sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and share * weight[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
        left -= sum(3 * sizes[s] for s in over)
    for s in order:
        target[s] = 3.0 * sizes[s] if s in full else share * weight[s]
    mix = mixing.Mix(docs.select("doc_id", "source", "size"))
    for r in mix.sources.collect():
        assert r.target == pytest.approx(target[r.source])
    by_target = defaultdict(int)
    for r in got:
        by_target[r.target] += r.taken
    assert all(abs(v - t * len([s for s in target if abs(target[s] - t) < 1e-9])) < 40 for t, v in by_target.items())
    # slots of one source and epoch never meet a block twice
    slots = mix.slots.collect()
    assert len({(s.sid, s.epoch, s["index"]) for s in slots}) == len(slots)


def test_mixed_texts(given):
    taken = defaultdict(int)
    for r in mixing.mixed(given).collect():
        taken[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    want = defaultdict(int)
    for r in mixing.taken(mixing.sizes(given)).collect():
        want[r.doc_id] += r.taken
    assert sum(taken.values()) == sum(want.values())
    assert mixing.mixed(given).columns == given.columns


def test_licences(spark):
    texts = [
        "Foo\nReleased under the MIT license",
        "All Rights Reserved",
        "released under the MIT license of nobody in this world today",
        "x\nAll rights reserved.\nLicensed under CC BY-NC 4.0.",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.licence, r.dice, r.line) for r in licences.scan(docs).collect()}
    none = (None, None, None)
    assert got == {0: ("MIT", 1.0, 1), 1: ("all-rights-reserved", 1.0, -1), 2: none, 3: ("all-rights-reserved", 1.0, 1), 4: none}


def test_whole_licences_and_notices_within_texts(spark):
    whole = licences.whole_texts()
    prose = " ".join(f"w{i}" for i in range(300))
    mit = "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + whole["MIT-whole"]
    apache = "".join(f"# {x}\n" for x in whole["Apache-2.0-notice"].split("\n"))
    texts = [
        mit,
        prose + "\n" + apache + prose,
        prose + " " + " ".join(whole["BSD-3-Clause-whole"].split()) + " " + prose,
        "one\nReleased under\nthe MIT License.\ntwo\n" + prose,
        whole["GPL-3.0-whole"].replace("\n", "\r\n") + prose,
        prose + "\n" + " ".join(whole["ISC-whole"].split()[:40]),
        prose,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [(r.licence, r.dice, r.line) for r in licences.scan(docs).orderBy("doc_id").collect()]
    assert got == [
        ("MIT-whole", 1.0, 4),
        ("Apache-2.0-notice", 1.0, 1),
        ("BSD-3-Clause-whole", 1.0, 0),
        ("MIT", 1.0, 1),
        ("GPL-3.0-whole", 1.0, 0),
        (None, None, None),
        (None, None, None),
    ]


def test_best_stretch_by_brute_force():
    rng = np.random.default_rng(8)
    for n in (6, 24):
        own = [f"a{i}" for i in range(n + 1)]
        scanner = licences.Scanner({"x": " ".join(own)}, 0.8)
        for _ in range(20):
            ws = [f"b{k}" for k in rng.integers(0, 3, 8)] + own + [f"b{k}" for k in rng.integers(0, 3, 8)]
            for at in rng.choice(len(ws), int(rng.integers(0, 3))):
                ws[at] += "c"
            borders = rng.random(len(ws)) < 0.3
            text = "".join(x + ("\n" if b else " ") for x, b in zip(ws, borders))
            cuts = [0, *(i + 1 for i in range(len(ws)) if borders[i]), len(ws)]
            places = cuts if n < licences.LONG else range(len(ws) + 1)
            pairs, best = {(own[i], own[i + 1]) for i in range(n)}, 0.0
            for i in places:
                for j in places:
                    unit = {(ws[k], ws[k + 1]) for k in range(i, j - 1)}
                    best = max(best, 2 * len(unit & pairs) / (len(unit) + n))
            data = np.frombuffer(text.encode(), np.uint8)
            templates = [k for _, k in scanner.candidates(data, np.array([0, len(data)]))]
            got = scanner.stretch(data, templates, 0.0) if templates else None
            assert (got[0] if got else 0.0) == (best if best >= 0.8 else 0.0)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(1500):
        ws = ["".join(rng.choice(list("abcdef"), 4)) for _ in range(int(rng.integers(30, 80)))]
        toxic, poor = i % 6 == 0, i % 5 == 0
        if toxic:
            for k in rng.choice(len(ws), 3, replace=False):
                ws[k] = ["scum", "moron", "loser"][int(rng.integers(3))]
        if poor:
            ws = [w.upper() + "!!" for w in ws]
        rows.append((i, " ".join(ws), "en", "a", 100))
        labels.append((i, int(toxic), int(not poor)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    out = toxicity.toxicity(docs, toxicity.training_labels(labels, "toxic", 5, 0))
    rows = out.join(labels, "doc_id").where(toxicity.held_out(5, 0)).collect()
    assert {r.doc_id for r in rows} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in rows]) > 0.98


def brute_kneser_ney(docs, d=toxicity.DISCOUNT):
    """Ratios of the words of every text by the formula, from ``(words, label or None)``."""
    n, types = [Counter(), Counter()], [Counter(), Counter()]
    steps = lambda ws: list(zip(["", *ws], ws))
    for ws, label in docs:
        if label is not None:
            n[label].update(set(steps(ws)))
    for c in (0, 1):
        types[c].update(w for _, w in n[c])
    seen = set(types[0]) | set(types[1])
    size = sum(types[0].values()) + sum(types[1].values()) + 0.5 * (len(seen) + 1)

    def word(c, w):
        total = sum(types[c].values())
        rest = 1 - sum(max(t - d, 0) for t in types[c].values()) / total
        return max(types[c][w] - d, 0) / total + rest * (types[0][w] + types[1][w] + 0.5) / size

    def pair(c, v, w):
        after = [t for (a, _), t in n[c].items() if a == v]
        if not after:
            return word(c, w)
        return max(n[c][v, w] - d, 0) / sum(after) + (1 - sum(max(t - d, 0) for t in after) / sum(after)) * word(c, w)

    return [[math.log(pair(1, v, w) / pair(0, v, w)) for v, w in steps(ws)] for ws, _ in docs]


@pytest.mark.parametrize("per_range", [10**9, 40])
def test_kneser_ney_against_brute_force(spark, monkeypatch, per_range):
    monkeypatch.setattr(toxicity, "KEYS_PER_RANGE", per_range)
    rng = np.random.default_rng(8)
    docs = []
    for i in range(160):
        ws = [f"w{int(x)}" for x in rng.zipf(1.5, 25) % 40]
        if i % 4 == 0:
            ws[10:12] = ["you", "scum"]  # the pair, not its words, tells the classes apart
        else:
            ws[5], ws[15] = "you", "scum"
        docs.append((ws * (1 + i % 3), None if i % 10 == 9 else int(i % 4 == 0)))
    docs += [(["new"], None), ([], 0), (["w1", "unseen", "w1"], None)]
    rows = spark.createDataFrame([(i, " ".join(ws)) for i, (ws, _) in enumerate(docs)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(docs) if y is not None], "doc_id long, label int")
    got = {r.doc_id: r for r in toxicity.toxicity(rows, labels).collect()}
    assert len(got) == len(docs)
    for i, own in enumerate(brute_kneser_ney(docs)):
        pairs = [(a + b) / 2 for a, b in zip(own, own[1:])] or own or [0.0]
        assert got[i].mean_ratio == pytest.approx(np.mean(own or [0.0]), abs=1e-5)
        assert got[i].best_ratio == pytest.approx(max(pairs), abs=1e-5)
    assert np.mean([(got[i].best_ratio > 1) == (i % 4 == 0) for i in range(160)]) > 0.95


def test_toxicity_learns_nothing_from_held_out_labels(labelled):
    docs, labels = labelled
    other = labels.withColumn("toxic", F.when(toxicity.held_out(5, 0), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.toxicity(docs, toxicity.training_labels(x, "toxic", 5, 0)).select("doc_id", "score") for x in (labels, other))
    assert sorted(a.collect()) == sorted(b.collect())


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    out = quality_fm.quality(docs, toxicity.training_labels(labels, "quality", 3, 1))
    rows = out.join(labels, "doc_id").where(toxicity.held_out(3, 1)).collect()
    assert np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows]) > 0.98


def test_machine_uses_the_sum_of_squares_identity():
    m = quality_fm.Machine.fresh()
    m.w = np.random.default_rng(0).normal(size=m.w.shape)
    slot, x, dense = np.array([3, 9, 11]), np.array([0.5, 0.2, 0.7]), np.arange(quality_fm.DENSE) / 10
    full = np.zeros(len(m.w))
    full[slot], full[quality_fm.SLOTS :] = x, dense
    v = m.v * full[:, None]
    pairs = sum(float(v[i] @ v[j]) for i in np.flatnonzero(full) for j in np.flatnonzero(full) if i < j)
    assert m.score(slot, x, np.array([3]), dense[None, :])[0] == pytest.approx(float(full @ m.w) + pairs)


def test_hashing_words_holds_a_small_multiple_of_a_stretch():
    text = " ".join(f"w{i % 977}é{i}" for i in range(400_000)).encode()
    words = textops.Words(*textops.raw(pa.array([text, b"", text[:1000]])))
    tracemalloc.start()
    found = words.hashes()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most - found.nbytes < 64 * textops.STRETCH + (4 << 20)
    assert len(np.unique(found[:400_000])) == 400_000
    assert (found[400_000:-1] == found[: len(found) - 400_001]).all()  # wherever a stretch ends


def operators(docs, labels):
    yield outliers.quality_rules(docs)
    yield licences.scan(docs)
    yield mixing.mixed(docs)
    yield mixing.taken(mixing.sizes(docs))
    yield bpe.digests(bpe.encode(docs, *BPE), *BPE)
    yield toxicity.toxicity(docs, labels)
    yield quality_fm.quality(docs, labels)
    yield ngram_join.jaccard_components(docs)
    yield rlz.substring_dedup(docs)


def test_odd_rows_and_clashing_columns(spark, odd):
    labels = spark.createDataFrame([(1, 0), (10, 1)], "doc_id long, label int")
    for out in operators(odd, labels):
        assert "doc_id" in out.columns and len(out.collect()) >= 6


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, label int")
    for out in operators(none, labels):
        assert out.collect() == []
    folder = records.records_folder(spark)
    written = records.write_records(none, folder, public_tokenizers.path("word_bpe_49k.json"), 1)
    assert records.read_records(spark, folder, written).collect() == []


def test_no_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, label int")
    for out in (toxicity.toxicity(odd, labels), quality_fm.quality(odd, labels)):
        assert all(0 <= r.score <= 1 for r in out.collect())
