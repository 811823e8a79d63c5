"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents are laid end to end in hash order and cut into blocks of ``block`` words.
The output is a row of slots, ``shard`` slots to an output shard.  A slot draws its source from the target
weights, so a shard's counts are multinomial; slots that a source draws beyond what its target needs are
handed to sources that drew too few.  The running number of a slot within its source, modulo the number
of blocks, goes through a pseudorandom permutation (one for each source and epoch) to a block index, and
slots meet blocks by (source, index).  In its last epoch a source stops within a block when the target is
reached.

Nothing is collected.  Running sums over a source go through buckets of about ``BUCKET`` documents or
blocks, so a source with a third of all rows is many small windows; the tables that grow with the number of
sources only are joined as Spark sees fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.tables import cut

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 128
SHARD = 256
BUCKET = 5_000
# cells of the unit interval in which a draw looks up its source
CELLS = 4096
TIMES = 3
SEED = 20_240_501


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size``, the number of words (a null text has none)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long"))


def targets(by_source: DataFrame) -> DataFrame:
    """``(source, source_size)`` with ``weight`` and ``target``.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the total size; a target stops at
    ``TIMES`` the source's size and the excess is shared by weight again until none is above.
    """
    # one row for each source; the order of all sources is one window over that table
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    w = cut(by_source.withColumn("weight", ((place - 1) % 3 + 1).cast("double")))
    # sources fill up in the order of size to weight: those below the level are full, the rest share what is left
    key = F.col("source_size") / F.col("weight")
    before = Window.orderBy(key, F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - TIMES * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumns({"__key": key, "__left": left, "__share": share})
    # the first source whose cap holds its share, and all after it, share what those before it leave
    fits = F.col("__left") * F.col("weight") <= TIMES * F.col("source_size") * F.col("__share")
    w = w.withColumn("__first", F.min(F.when(fits, F.col("__key"))).over(everything))
    at = F.max(F.when(F.col("__key") == F.col("__first"), F.struct("__share", "__left"))).over(everything)
    cap = (TIMES * F.col("source_size")).cast("double")
    share = F.least(F.col("weight") * at["__left"] / at["__share"], cap)
    target = F.when(F.col("source_size") > 0, F.when(F.col("__key") >= F.col("__first"), share).otherwise(cap)).otherwise(0.0)
    return w.withColumn("target", target).select("source", "source_size", "weight", "target")


def running(df: DataFrame, group: str, order: list[Column | str], value: str, out: str, bucket: Column) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of ``group`` that come before, bucket by bucket.

    ``bucket`` must not fall along ``order``; a window then holds one bucket, or one group's buckets.
    """
    df = df.withColumn("__bucket", bucket)
    totals = df.groupBy(group, "__bucket").agg(F.sum(value).alias("__total"))
    earlier = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(group, "__bucket", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__base"))
    base = base.select(F.col(group).alias("__g"), F.col("__bucket").alias("__b"), "__base")
    inside = Window.partitionBy(group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    df = df.join(base, (F.col(group) == F.col("__g")) & (F.col("__bucket") == F.col("__b")))
    return df.withColumn(out, F.col("__base") + F.col("__own")).drop("__bucket", "__own", "__base", "__g", "__b")


def _round(x: Column, key: list[Column], m: Column) -> Column:
    return F.pmod(F.xxhash64(x, *key), m)


def permuted(i: Column, n: Column, key: list[Column], inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1, one for each ``key``.

    Four Feistel rounds on a grid of at least n cells, ``a`` by ``b``; an index that lands beyond n is sent on
    until it is back inside (on average under two steps; at most as many as cells beyond n).
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def once(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, b)
        for r in range(3, -1, -1) if inverse else range(4):
            sign = -1 if inverse else 1
            if r % 2 == 0:
                left = F.pmod(left + sign * _round(right, [*key, F.lit(r)], a), a)
            else:
                right = F.pmod(right + sign * _round(left, [*key, F.lit(r)], b), b)
        return left * b + right

    first = once(i)
    walk = F.aggregate(F.sequence(F.lit(1).cast("long"), a * b - n), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(first < n, first).otherwise(walk)


def _look_up(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, span: Column) -> DataFrame:
    """Join points in [0, span) with the disjoint intervals [low, high) that cover it, by ``CELLS`` equal cells.

    An interval is listed in each cell it touches: at most ``CELLS`` rows more than intervals.
    """

    def cell(x: Column) -> Column:
        return F.least(F.floor(x / span * CELLS), F.lit(CELLS - 1)).cast("int")

    listed = intervals.where(F.col(high) > F.col(low)).withColumn(
        "__cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high))))
    )
    points = points.withColumn("__cell", cell(F.col(at)))
    return points.join(listed, "__cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__cell")


def _number(df: DataFrame, order: list[Column | str], value: str, out: str) -> DataFrame:
    """Running sum over a table with one row for each source."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))


class Mix:
    """The tables of one mix, all derived from ``docs(doc_id, source, size)`` and further small columns of the caller.

    ``documents``: every row with ``sid`` (a source's number) and ``start``, its place in the source's words.
    ``sources``: target, number of blocks ``n``, whole epochs and the words of the last one.
    ``slots``: (shard, sid, epoch, index, words), the draws; ``words`` of the block are taken from its start.
    """

    def __init__(self, docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED):
        self.block, self.seed = block, seed
        by_source = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
        by_source = cut(by_source)
        place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
        t = targets(by_source.select("source", "source_size"))
        s = t.join(by_source.select(F.col("source").alias("__s"), "rows"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        n = F.ceil(F.col("source_size") / block).cast("long")
        s = s.withColumns({"sid": place, "n": n, "want": F.least(F.round("target").cast("long"), TIMES * F.col("source_size"))})
        size = F.greatest(F.col("source_size"), F.lit(1))
        s = s.withColumn("epochs", F.floor(F.col("want") / size).cast("long"))
        s = s.withColumn("rest", F.col("want") - F.col("epochs") * size)
        s = s.withColumn("tail", F.col("source_size") - (F.greatest(F.col("n"), F.lit(1)) - 1) * block)
        # where the short last block stands in the last epoch, and how many draws that epoch needs
        last = F.when(F.col("n") > 0, permuted(F.col("n") - 1, F.greatest(F.col("n"), F.lit(1)), self._key(F.col("epochs")), True))
        s = s.withColumn("tail_at", last)
        through = F.col("tail_at") * block + F.col("tail")
        draws = (
            F.when(F.col("rest") <= F.col("tail_at") * block, F.ceil(F.col("rest") / block))
            .when(F.col("rest") <= through, F.col("tail_at") + 1)
            .otherwise(F.col("tail_at") + 1 + F.ceil((F.col("rest") - through) / block))
        )
        s = s.withColumn("need", F.when(F.col("n") > 0, F.col("epochs") * F.col("n") + draws).otherwise(0).cast("long"))
        self.sources = cut(s)
        keys = self.sources.select(F.col("source").alias("__s"), "sid", F.col("rows").alias("__rows"))
        d = docs.join(keys, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        order = F.xxhash64(F.lit(seed), "doc_id", "size")
        bucket = F.floor((F.shiftrightunsigned(order, 1) / F.lit(2.0**63)) * F.ceil(F.col("__rows") / BUCKET)).cast("long")
        d = d.withColumn("__order", order)
        by = [F.shiftrightunsigned("__order", 1), F.col("doc_id"), F.col("size")]
        self.documents = cut(running(d, "sid", by, "size", "start", bucket).drop("__order", "__rows"))
        self.slots = self._slots(shard)

    def _key(self, epoch: Column) -> list[Column]:
        return [F.lit(self.seed), F.col("sid"), epoch]

    def _slots(self, shard: int) -> DataFrame:
        spark = self.sources.sparkSession
        s = _number(self.sources.where("need > 0"), ["sid"], "need", "__low")
        s = s.withColumn("__high", F.col("__low") + F.col("need"))
        total = s.agg(F.sum("need")).first()[0] or 0
        ranges = s.select("sid", "__low", "__high")
        u = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.lit("draw"), "id"), 1) / F.lit(2.0**63) * F.lit(float(total))
        draws = spark.range(total).select(F.floor(F.col("id") / shard).alias("shard"), u.alias("__at"))
        drawn = _look_up(draws, "__at", ranges, "__low", "__high", F.lit(float(max(total, 1))))
        counts = drawn.groupBy("shard", "sid").agg(F.count("*").alias("c"))
        counts = cut(counts)
        counts = running(counts, "sid", ["shard"], "c", "base", F.floor(F.col("shard") / BUCKET))
        need = s.select("sid", "need")
        counts = counts.join(need, "sid").withColumn("keep", F.greatest(F.least(F.col("need") - F.col("base"), F.col("c")), F.lit(0)))
        counts = cut(counts.withColumn("over", F.col("c") - F.col("keep")))
        kept = counts.where("keep > 0").select("shard", "sid", F.col("base").alias("first"), F.col("keep").alias("many"))
        # surplus slots, numbered from 0, go to the sources that drew too few
        got = counts.groupBy("sid").agg(F.sum("c").alias("got"), F.sum("over").alias("over"))
        got = need.join(got, "sid", "left").fillna(0, ["got", "over"])
        got = got.withColumn("lack", F.greatest(F.col("need") - F.col("got"), F.lit(0)))
        got = _number(got, ["sid"], "lack", "__from").withColumn("__to", F.col("__from") + F.col("lack"))
        got = cut(_number(got, ["sid"], "over", "__over"))
        spare = running(counts.where("over > 0"), "sid", ["shard"], "over", "__place", F.floor(F.col("shard") / BUCKET))
        spare = spare.join(got.select("sid", "__over"), "sid")
        at = F.col("__over") + F.col("__place")
        spare = spare.select("shard", F.explode(F.sequence(at, at + F.col("over") - 1)).alias("__at"))
        lacking = got.select("sid", "__from", "__to", "got")
        lack_total = got.agg(F.sum("lack")).first()[0] or 0
        moved = _look_up(spare, "__at", lacking, "__from", "__to", F.lit(float(max(lack_total, 1))))
        moved = moved.select("shard", "sid", (F.col("got") + F.col("__at") - F.col("__from")).alias("first"), F.lit(1).cast("long").alias("many"))
        runs = kept.unionByName(moved)
        j = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("many") - 1))
        slots = runs.select("shard", "sid", j.alias("j"))
        slots = slots.join(self.sources.select("sid", "n", "epochs", "rest", "tail", "tail_at"), "sid")
        slots = slots.withColumns({"epoch": F.floor(F.col("j") / F.col("n")).cast("long"), "pos": F.pmod("j", "n")})
        slots = slots.withColumn("index", permuted(F.col("pos"), F.col("n"), self._key(F.col("epoch"))))
        length = F.when(F.col("index") == F.col("n") - 1, F.col("tail")).otherwise(self.block)
        before = F.col("pos") * self.block - F.when(F.col("tail_at") < F.col("pos"), self.block - F.col("tail")).otherwise(0)
        part = F.greatest(F.least(F.col("rest") - before, length), F.lit(0))
        words = F.when(F.col("epoch") < F.col("epochs"), length).otherwise(part).cast("long")
        return slots.select("shard", "sid", "epoch", "index", words.alias("words")).where("words > 0")

    def pieces(self, columns: list[str]) -> DataFrame:
        """The documents' parts in the drawn blocks: ``(columns, sid, start, size, shard, epoch, first, words)``.

        ``first`` is the part's first word within the document.
        """
        d = self.documents.where("size > 0")
        low = F.floor(F.col("start") / self.block).cast("long")
        high = F.floor((F.col("start") + F.col("size") - 1) / self.block).cast("long")
        d = d.select(*columns, "sid", "start", "size", F.explode(F.sequence(low, high)).alias("index"))
        both = d.join(self.slots, ["sid", "index"])
        from_ = F.greatest(F.col("start"), F.col("index") * self.block)
        to = F.least(F.col("start") + F.col("size"), F.col("index") * self.block + F.col("words"))
        both = both.withColumns({"first": from_ - F.col("start"), "words": to - from_}).where("words > 0")
        return both.select(*columns, "sid", "start", "size", "shard", "epoch", "first", "words")


def taken(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    ``docs`` has ``doc_id``, ``source`` and ``size``; null sources are one source, empty documents are taken
    zero times, equal rows (same id, source and size) have places of their own and stay rows of their own.
    """
    mix = Mix(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "size"))
    d = mix.documents.select("doc_id", "sid", "start", "size")
    sums = mix.pieces(["doc_id"]).groupBy("sid", "start").agg(F.sum("words").alias("taken"))
    sums = sums.select(F.col("sid").alias("__sid"), F.col("start").alias("__start"), "taken")
    full = d.where("size > 0").join(sums, (F.col("sid") == F.col("__sid")) & (F.col("start") == F.col("__start")), "left")
    full = full.select("doc_id", "sid", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    none = d.where("size = 0").select("doc_id", "sid", "size", F.lit(0).cast("long").alias("taken"))
    out = full.unionByName(none).join(mix.sources.select("sid", "source_size", "target"), "sid")
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: the columns of ``docs``, one row for each document and epoch in which words of it are taken.

    ``text`` holds the words taken, in the order of the document; a document that is taken whole keeps its text as it
    is, else each word keeps the white space behind it.  ``n_chars``, where there is such a column, is set anew.
    Documents of which nothing is taken (empty ones too) have no row.
    """
    space = r"[\x20\x09-\x0D]"
    row = F.xxhash64("doc_id", "source", F.col(f"`{text}`"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row.alias("__row"))
    small = sizes(docs.select("doc_id", "source", F.col(f"`{text}`").alias("text"), row.alias("__row"))).drop("text")
    mix = Mix(small)
    parts = mix.pieces(["__row"]).groupBy("__row", "sid", "start", "size", "epoch")
    parts = parts.agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts"), F.sum("words").alias("words"))
    both = keyed.dropDuplicates(["__row"]).join(parts, "__row")
    words = F.split(F.regexp_replace(F.col("doc")[text], f"^{space}+", ""), f"(?<={space})(?=[^\\x20\\x09-\\x0D])")
    # the array of words is bound once, not once for each part
    chosen = F.transform(
        F.array(words),
        lambda w: F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(w, p["first"].cast("int") + 1, p["words"].cast("int")))), ""),
    )[0]
    both = both.withColumn("__text", F.when(F.col("words") == F.col("size"), F.col("doc")[text]).otherwise(chosen))
    new = {text: F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return both.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
