"""Stages of the pipeline and the registered queries."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from llm import ngram_join, queries

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in queries.QUERIES["op7_kneser_ney"](spark, SF).where("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = docs.checkpoint()
        now = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "toxicity":
            assert dict(now) == {i: t for i, t in before.items() if i not in toxic}
        elif name == "ngram_jaccard_join":
            assert set(now) <= set(before.items()) and len(now) == len(set(now))
            texts = Counter(" ".join(words(t)).lower() for _, t in now if words(t))
            assert max(texts.values()) == 1
        elif name == "substring_dedup":
            seen = Counter()
            for t in before.values():
                seen.update(tuple(words(t)[k : k + 35]) for k in range(len(words(t)) - 34))
            for i, t in now:
                gone = [k for k in range(len(words(before[i])) - 34) if seen[tuple(words(before[i])[k : k + 35])] > 1]
                assert gone or t == before[i]
        else:
            taken = defaultdict(int)
            for i, t in now:
                taken[i] += len(words(t))
            assert all(n <= 3 * len(words(before[i])) for i, n in taken.items())
        before = dict(now) if name != "mixing" else before
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert Counter(r.doc_id for r in last.collect()) == Counter(r.doc_id for r in docs.collect())


def test_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert oracle.compare(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.SQL[name]) == []


def test_near_duplicates_as_brute_force(spark):
    """Five-word shingles, similarity of 0.8 or more: copies with one to five changed words of 100 lie on both sides."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = [f"t{i}" for i in range(100)]
    texts = [first, first[:4], first[:8], first[1:9], first[:9]]
    for changes in ([50], [20, 60], [20, 50, 80], [30, 31, 32, 33], [10, 30, 50, 70], [1, 20, 40, 60, 80]):
        texts.append([f"e{changes[0]}_{k}" if k in changes else w for k, w in enumerate(w + "x" * len(changes) for w in first)])
        texts.append([w + "x" * len(changes) for w in first])
    rows = [(1_000_000 + i, " ".join(ws), "en", "a", 9) for i, ws in enumerate(texts)]
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    have = docs.select("doc_id", "text").collect()

    sets = {}
    for r in have:
        ws = [w.lower() for w in words(r.text)]
        sets[r.doc_id] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids[: ids.index(a)]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = {i for i in ids if find(i) == i}
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # two changed words of 100: 86 of 106 five-word shingles are shared, but only 92 of 104 of three words
    assert 1_000_008 not in want


def test_near_duplicates_leave_by_row(spark):
    """Id 5 has a copy of document 1, and texts of its own, of which one names a component and two are near copies."""
    a, b, c, d = ([f"{x}{i}" for i in range(100)] for x in "abcd")
    near = [*c[:50], "other", *c[51:]]
    rows = [(1, a), (5, a), (5, b), (5, c), (5, near), (7, c), (8, d), (8, d), (None, a), (9, []), (9, ["one"])]
    rows = [(i, " ".join(ws), "en", "a", 9) for i, ws in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    one_of = [(5, " ".join(c)), (5, " ".join(near))]
    assert sum(got.pop(x, 0) for x in one_of) == 1
    assert got == Counter([(1, " ".join(a)), (5, " ".join(b)), (8, " ".join(d)), (None, " ".join(a)), (9, ""), (9, "one")])


CLASHING = ["score", "best_ratio", "mean_ratio", "n_words", "n_removed", "kept", "factors", "ids", "size", "group", "component_id", "range"]


def many(spark):
    """Odd rows: nulls, repeats, an id with two texts, a passage in two texts, extra columns named like results."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"start {passage} end"), (2, f"other {passage} tail"), (3, "plain words here"), (3, "plain words here"),
            (3, "another text of the same id"), (4, None), (5, ""), (None, "no id at all"), (None, None), (6, " \n ")]
    base = spark.createDataFrame([(i, t, "en", None, len(t) if t else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return base.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce("doc_id", F.lit(-1))) for c in CLASHING})


def test_stages_keep_columns_named_like_their_results(spark):
    docs = many(spark)
    rows = Counter(tuple(r) for r in docs.collect())
    assert Counter(tuple(r) for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()) == rows
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert near.columns == docs.columns
    plain = [r for r in near.collect() if r.doc_id == 3 and r.text == "plain words here"]
    assert len(plain) == 1 and set(map(tuple, near.collect())) <= set(rows)
    assert {r.doc_id for r in near.collect()} >= {3, 4, 5, 6, None}
    cut = corpus_pipeline.cut_repeats(spark, docs, SF)
    assert cut.columns == docs.columns
    got = {(r.doc_id, r.text): r for r in cut.collect()}
    assert cut.count() == docs.count() and {(1, "start end"), (2, "other tail"), (4, None), (5, ""), (6, " \n ")} <= set(got)
    assert all(r[c] == f"{c} of {-1 if r.doc_id is None else r.doc_id}" for r in got.values() for c in CLASHING)
    assert got[(1, "start end")].n_chars == 9
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns
    assert all(r[c] == f"{c} of {-1 if r.doc_id is None else r.doc_id}" for r in mixed.collect() for c in CLASHING)
    last = corpus_pipeline.encode(spark, docs, SF)
    assert Counter(r.doc_id for r in last.collect()) == Counter(r.doc_id for r in docs.collect())


def test_stages_of_an_empty_table(spark):
    docs = many(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == [] and (name == "byte_level_bpe" or out.columns == docs.columns)


def test_of_repeated_rows_the_same_one_stays(spark):
    rows = [(7, "some words again", x) for x in range(6)] + [(8, "some words again", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    first = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(5), SF).collect()]
    assert len(first) == 1 and first[0][:2] == (7, "some words again")
    assert first == [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs.orderBy(F.desc("extra")), SF).collect()]


def test_texts_with_common_lines_only_are_not_sent_to_be_compared(spark, monkeypatch):
    """300 unrelated texts with 30 common words are one group of tiles; ten have a near copy, and only these meet, in small blocks."""
    common = " ".join(f"c{i}" for i in range(30))
    texts = [f"{common} " + " ".join(f"t{i}_{k}" for k in range(60 + i % 90)) for i in range(300)]
    texts += [texts[i] + f" x{i}" for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    tables = []
    settled = ngram_join.settled
    monkeypatch.setattr(ngram_join, "settled", lambda df: tables.append(out := settled(df)) or out)
    monkeypatch.setattr(ngram_join, "_verify", lambda pairs, sets, percent: pairs.where("false"))
    monkeypatch.setattr(ngram_join, "BLOCK", 500)
    monkeypatch.setattr(ngram_join, "BATCH_TILES", 2_000)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, width=5, percent=80).collect()}
    assert got == {i: i if i < 300 else i - 300 for i in range(310)}
    groups = next(t for t in tables if t.columns == ["sid", "super", "label"])
    assert groups.groupBy("super").count().agg(F.max("count")).first()[0] >= 250
    sent = [t for t in tables if "class" in t.columns and "label" in t.columns]
    assert len(sent) == 1 and sent[0].count() == 20


def test_a_task_of_any_stage_has_one_python_worker_and_small_batches(spark):
    """Workers that follow each other in a task are all kept by the executor, each with room for its largest batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(5000).select(
        F.col("id").alias("doc_id"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" ")), 500).alias("text"), F.lit("en").alias("lang"),
        F.lit("a").alias("source"), F.lit(9).cast("long").alias("n_chars"),
    )
    few = docs.where("doc_id < 20")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([b.nbytes], pa.int64())})

    for name, stage in corpus_pipeline.STAGES:
        spark.conf.set(key, before)
        done = stage(spark, few, SF)
        plan = done._jdf.queryExecution().executedPlan().toString()
        # an exchange ends a task; below it the Python steps of another one begin
        for line in re.split(r"Exchange|Scan ExistingRDD", plan):
            assert len(re.findall(r"MapInArrow|InArrow|InPandas", line)) <= 1, name
        if name != "mixing":  # the only stage without Python
            largest = docs.select("text").coalesce(1).mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0]
            assert largest <= 2 * corpus_pipeline.BATCH_BYTES, name
    spark.conf.set(key, before)


def test_counts_of_shared_shingles_come_back_in_few_rows(spark, monkeypatch):
    """A set with shingles in every range of hashes is no row of each; what may link is the same with many ranges."""
    lists = [[(7919 * i + k) * 0x9E3779B97F4A7C15 % 2**64 for k in range(40 + i % 3)] for i in range(300)]
    lists = [sorted(x) for x in lists + [[*x[:38], *y[38:]] for x, y in zip(lists, lists[1:])]]
    rows = [(i * 0x632BE59BD9B4E019 % 2**63, [v - 2**64 if v >= 2**63 else v for v in x]) for i, x in enumerate(lists, 1)]
    sets = spark.createDataFrame(rows, "sid long, shingles array<long>").repartition(4).checkpoint()
    held = Counter(v for x in lists for v in x if v < 2**63)
    alone = {r[0]: sum(held[v] == 1 for v in x if v < 2**63) for r, x in zip(rows, lists)}
    expected = {r[0] for r in rows if 100 * alone[r[0]] <= 20 * len(r[1])}
    assert 0 < len(expected) < len(rows)
    monkeypatch.setattr(ngram_join, "RANGE_BYTES", 1 << 12)
    made = []

    def walk(node):
        if node.nodeName().startswith("FlatMapGroupsInArrow"):
            made.append(node.metrics().apply("pythonNumRowsReceived").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        able = ngram_join._linkable(sets, 80)
        assert {r.sid for r in able.collect()} == expected
        walk(able._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert made and max(made) <= len(rows)
