"""Linking names to a gazetteer by edit distance, and what is built on such a link.

The nearest name within ``max_dist`` edits is found exactly, without comparing all pairs.  Rounds
run from distance 0 upwards and a name leaves as soon as it is matched.  In the round for distance
t a gazetteer name of length L > t is cut into t+1 segments: t edits cannot touch all of them, so a
true match contains one segment unchanged, close to its place (Li, Deng, Wang, Feng, PASS-JOIN,
VLDB 2011).  That turns the search into an equi-join on (length, segment number, segment text).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.quantiles import continuous_summary
from canvass.functions.semantics import null_safe, pct, pearson, trimmed_upper
from canvass.functions.skew import join_per_key
from canvass.operators.shares import count_by
from canvass.session import materialize

# One join group compares at most about GROUP x GROUP names; larger groups are split on both sides.
GROUP = 2_000
# Signatures of at most this many (counted) names are broadcast; beyond it both sides are shuffled.
BROADCAST_NAMES = 5_000
# Gazetteer names compared by one task of a round.
NAMES_PER_TASK = 50_000


# accented capitals and what they are folded to; letters that are not listed stay as they are
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUY"


def fold(c: Column) -> Column:
    """Upper case without the listed accents; ß becomes SS."""
    return F.translate(F.upper(F.replace(c, F.lit("ß"), F.lit("ss"))), ACCENTED, PLAIN)


def normalize_name(c: Column | str) -> Column:
    """Upper case, without surrounding white space."""
    return trimmed_upper(c)


def _segment_windows(max_dist: int) -> list[tuple[int, int, int]]:
    """(length difference, segment number, shift) combinations that can carry a match.

    With left length minus right length = diff, an unchanged i-th segment found ``shift`` places off
    costs at least |shift| edits before it and |diff - shift| after it; some unchanged segment has at
    most i-1 edits before it and max_dist+1-i after it.
    """
    return [
        (diff, i, shift)
        for diff in range(-max_dist, max_dist + 1)
        for i in range(1, max_dist + 2)
        for shift in range(-(i - 1), i)
        if abs(diff - shift) <= max_dist + 1 - i
    ]


def _segment(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i when ``length`` is cut into ``parts`` nearly equal parts."""
    base = F.floor(length / parts).cast("int")
    short = F.lit(parts) - length % parts
    start = 1 + (i - 1) * base + F.greatest(i - 1 - short, F.lit(0))
    return start.cast("int"), (base + (i > short).cast("int")).cast("int")


def _characters(name: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.col(name), ""), lambda ch: ch != ""))


def _right_signatures(right: DataFrame, blocks: Sequence[str], max_dist: int) -> DataFrame:
    """Gazetteer names with their segments; names too short to cut are listed under their characters."""
    parts = max_dist + 1
    size = F.length("__r")
    cols = [*blocks, "__r", "__ord"]
    start, width = _segment(F.col("__len"), F.col("__i"), parts)
    cut = (
        right.where(size >= parts)
        .select(*cols, size.alias("__len"), F.explode(F.sequence(F.lit(1), F.lit(parts))).alias("__i"))
        .select(*cols, "__len", "__i", F.substring(F.col("__r"), start, width).alias("__t"))
    )
    short = right.where((size > 0) & (size < parts)).select(
        *cols, F.lit(0).alias("__len"), F.lit(0).alias("__i"), F.explode(_characters("__r")).alias("__t")
    )
    return cut.unionByName(short)


def _left_signatures(left: DataFrame, blocks: Sequence[str], max_dist: int) -> DataFrame:
    """The substrings of each name that could equal a segment of a name in reach."""
    parts = max_dist + 1
    size = F.length("__l")
    cols = [*blocks, "__l"]
    windows = F.array(
        *[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s")) for d, i, s in _segment_windows(max_dist)]
    )
    start, width = _segment(F.col("__len"), F.col("__w.i"), parts)
    begin = start + F.col("__w.s")
    cut = (
        left.select(*cols, size.alias("__size"), F.explode(windows).alias("__w"))
        .withColumn("__len", (F.col("__size") - F.col("__w.d")).cast("int"))
        .where(F.col("__len") >= parts)
        .where((begin >= 1) & (begin + width - 1 <= F.col("__size")))
        .select(*cols, "__len", F.col("__w.i").alias("__i"), F.substring(F.col("__l"), begin, width).alias("__t"))
    )
    short = left.where((size > 0) & (size <= 2 * max_dist)).select(
        *cols, F.lit(0).alias("__len"), F.lit(0).alias("__i"), F.explode(_characters("__l")).alias("__t")
    )
    return cut.unionByName(short)


def _spread(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Add two salts so that a signature shared by very many names is compared in many small groups.

    Each left name takes one row of the grid and visits every column; each right name the reverse.  The salts come from
    counts that are combined before the shuffle, and reach the names by a join that keeps the names of a frequent
    signature out of the shuffle.  Signatures that only one side has end there, as they make no pair.
    """
    sizes = materialize(
        count_by(left, keys, "__nl")
        .join(count_by(right, keys, "__nr"), list(keys))
        .withColumn("__big", F.col("__nl").cast("double") * F.col("__nr") > GROUP * GROUP)
        .select(
            *keys,
            "__nl",
            "__nr",
            F.when(F.col("__big"), F.ceil(F.col("__nl") / GROUP)).otherwise(1).cast("int").alias("__sl"),
            F.when(F.col("__big"), F.ceil(F.col("__nr") / GROUP)).otherwise(1).cast("int").alias("__sr"),
        )
    )

    def split(
        df: DataFrame, name: str, count: str, own: str, other: str, own_salt: str, other_salt: str
    ) -> DataFrame:
        out = join_per_key(df, sizes.select(*keys, count, own, other), keys, count)
        mine = F.pmod(F.xxhash64(name), F.col(own)).cast("int")
        return out.select(*df.columns, mine.alias(own_salt), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_salt))

    return (
        split(left, "__l", "__nl", "__sl", "__sr", "__a", "__b"),
        split(right, "__r", "__nr", "__sr", "__sl", "__b", "__a"),
    )


def _round(left: DataFrame, n_left: int, right: DataFrame, blocks: Sequence[str], dist: int) -> DataFrame:
    """Best gazetteer name at distance <= ``dist`` for names that have none at a smaller distance.

    Few names left: their signatures are broadcast and the gazetteer is not shuffled, so a signature
    shared by many gazetteer names stays spread over its partitions.  Many names: both sides are
    shuffled and common signatures are split.
    """
    keys = [*blocks, "__len", "__i", "__t"]
    ls, rs = _left_signatures(left, blocks, dist), _right_signatures(right, blocks, dist)
    if n_left <= BROADCAST_NAMES:
        ls = F.broadcast(ls)
    else:
        ls, rs = _spread(ls, rs, keys)
        keys += ["__a", "__b"]
    distance = F.levenshtein(F.col("__l"), F.col("__r"), dist)
    ls, rs = ls.alias("ls"), rs.alias("rs")
    on = distance >= 0
    for k in keys:
        on = on & (F.col(f"ls.{k}") == F.col(f"rs.{k}"))
    pairs = ls.join(rs, on).select(
        *[F.col(f"ls.{b}").alias(b) for b in blocks],
        "__l",
        F.struct(distance.alias("dist"), F.col("__ord").alias("ord"), F.col("__r").alias("name")).alias("__m"),
    )
    # Two short names without a common character are max(length) edits apart, so only the first
    # gazetteer name of each short length can win that way: at most dist+1 candidates per block.
    firsts = (
        right.where(F.length("__r") <= dist)
        .groupBy(*blocks, F.length("__r").alias("__size"))
        .agg(F.min(F.struct(F.col("__ord").alias("ord"), F.col("__r").alias("name"))).alias("__c"))
        .groupBy(*blocks)
        .agg(F.collect_list("__c").alias("__c"))
    )
    short = left.where(F.length("__l") <= dist).select(*blocks, "__l")
    if blocks:
        short = short.join(firsts, list(blocks))
    else:
        short = short.withColumn("__c", firsts.scalar())
    short = short.select(*blocks, "__l", F.explode("__c").alias("__c")).select(
        *blocks,
        "__l",
        F.struct(
            F.levenshtein(F.col("__l"), F.col("__c.name")).alias("dist"),
            F.col("__c.ord").alias("ord"),
            F.col("__c.name").alias("name"),
        ).alias("__m"),
    )
    return pairs.unionByName(short).groupBy(*blocks, "__l").agg(F.min("__m").alias("__m"))


def nearest_names(
    left: DataFrame,
    right: DataFrame,
    left_name: str,
    right_name: str,
    right_order: Sequence[str],
    max_dist: int = 3,
    block_on: Sequence[str] = (),
    skip_blank: bool = True,
) -> DataFrame:
    """For each distinct left name the nearest right name, if it is within ``max_dist`` edits.

    Ties go to the right row that comes first by ``right_order`` (then by name).  Columns: the
    blocks, ``left_name``, ``n`` (left rows with the name), ``match_distance`` and ``matched_name``
    (NULL without a match).  Missing names and missing blocks never match; blank names only with
    ``skip_blank=False``.
    """
    blocks = list(block_on)

    def usable(df: DataFrame, name: str) -> DataFrame:
        for c in [*blocks, name]:
            df = df.where(F.col(c).isNotNull())
        return df.where(F.col(name) != "") if skip_blank else df

    r = (
        usable(right, right_name)
        .groupBy(*blocks, F.col(right_name).alias("__r"))
        .agg(F.min(F.struct(*right_order)).alias("__ord"))
    )
    names = usable(left, left_name).groupBy(*blocks, F.col(left_name).alias("__l")).agg(F.count(F.lit(1)).alias("n"))
    # the rounds are bound by comparisons, not by bytes: tasks get names in numbers that follow the gazetteer, not the
    # cluster, and a small gazetteer is still spread over all cores
    r = materialize(r)
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, -(-r.count() // NAMES_PER_TASK))
    r = materialize(r.repartition(tasks))
    rx = r.select(*[F.col(b).alias(f"__rb_{b}") for b in blocks], "__r", "__ord")
    same = F.col("__l") == F.col("__r")
    for b in blocks:
        same = same & (F.col(b) == F.col(f"__rb_{b}"))
    state = names.join(rx, same, "left").select(
        *blocks,
        "__l",
        "n",
        F.when(
            F.col("__r").isNotNull(),
            F.struct(F.lit(0).alias("dist"), F.col("__ord").alias("ord"), F.col("__r").alias("name")),
        ).alias("__m"),
    )
    for dist in range(1, max_dist + 1):
        state = materialize(state)
        open_names = state.where("__m is null").select(*blocks, "__l")
        n_open = open_names.count()
        if n_open == 0:
            break
        best = _round(open_names, n_open, r, blocks, dist).withColumnRenamed("__m", "__best")
        state = state.join(best, [*blocks, "__l"], "left").select(
            *blocks, "__l", "n", F.coalesce(F.col("__m"), F.col("__best")).alias("__m")
        )
    return state.select(
        *blocks,
        F.col("__l").alias(left_name),
        "n",
        F.col("__m.dist").cast("int").alias("match_distance"),
        F.col("__m.name").alias("matched_name"),
    )


def fuzzy_link(
    left: DataFrame, nearest: DataFrame, left_name: str, block_on: Sequence[str] = ()
) -> DataFrame:
    """Left rows with a match, with its distance and name.

    ``nearest`` has one row per distinct name and its row count, which steers very frequent names
    around the shuffle.
    """
    table = materialize(nearest.where("matched_name is not null"))
    return join_per_key(left, table, [*block_on, left_name], "n")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by an explicit order; combined before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    picked = df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(
        F.min_by(row, F.struct(*order)).alias("__row")
    )
    return picked.select("__row.*")


def attach_first(nearest: DataFrame, right: DataFrame, right_name: str, right_order: Sequence[str]) -> DataFrame:
    """Add the other columns of the first gazetteer row that carries the matched name.

    Done on the table of distinct names, before :func:`fuzzy_link` spreads it over the rows.
    """
    first = first_rows(right.where(F.col(right_name).isNotNull()), [right_name], right_order)
    first = first.withColumnRenamed(right_name, "__right_name")
    return nearest.join(first, F.col("matched_name") == F.col("__right_name")).drop("__right_name")


def match_quality(nearest: DataFrame) -> DataFrame:
    """Left rows per match distance."""
    matched = nearest.where("match_distance is not null")
    return matched.groupBy("match_distance").agg(F.count(F.lit(1)).alias("n_names"), F.sum("n").alias("n_rows"))


def match_rate(nearest: DataFrame) -> DataFrame:
    hit = F.col("match_distance").isNotNull()
    return nearest.agg(
        F.count(F.lit(1)).alias("n_names"),
        F.count_if(hit).alias("n_matched"),
        pct(F.count_if(hit), F.count(F.lit(1))).alias("pct_matched"),
    )


def link_via_code(
    linked: DataFrame,
    code: str,
    keys: DataFrame,
    key_code: str,
    key_id: str,
    attributes: DataFrame,
    per: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """Linked rows -> numeric code -> id -> attributes, one row per ``per``.

    Codes are compared as numbers; text that is not a number, and missing codes, match nothing.
    When a code leads to several ids the first row by ``order`` stays.  Rows with the same ``per`` and
    code meet the same ids, so only the first of them goes into the join.
    """
    number = F.col(code).try_cast("double")
    known_order = [c for c in order if c in linked.columns] or [code]
    linked = first_rows(linked.where(number.isNotNull()), [*per, code], known_order)
    k = keys.select(F.col(key_code).try_cast("double").alias("__code"), F.col(key_id)).where(
        F.col("__code").isNotNull() & F.col(key_id).isNotNull()
    )
    resolved = linked.withColumn(code, number).join(k, F.col(code) == F.col("__code")).drop("__code")
    return first_rows(resolved, per, order).join(attributes, key_id, "left")


def population_rates(df: DataFrame, population: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Percentages of the population; NULL where the population is zero or missing."""
    out = {}
    for name, parts in groups.items():
        total = F.col(parts[0])
        for p in parts[1:]:
            total = total + F.col(p)
        out[name] = pct(total, F.col(population))
    return df.withColumns(out)


def validation_table(linked: DataFrame, survey: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """Linked places that also have survey aggregates, with the required values present."""
    out = linked.join(survey, key)
    for c in required:
        out = out.where(F.col(c).isNotNull())
    return out


def validation_correlations(validation: DataFrame, pairs: dict[str, tuple[str, str]], min_n: int = 6) -> DataFrame:
    """One correlation per pair of columns; no rows when there are too few places."""
    wide = validation.agg(F.count(F.lit(1)).alias("n"), *[pearson(a, b).alias(n) for n, (a, b) in pairs.items()])
    return wide.where(F.col("n") >= min_n).unpivot(["n"], list(pairs), "pair", "r")


def validation_medians(validation: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median and mean of the chosen columns."""
    long = validation.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "variable", "value"
    )
    s = continuous_summary(long, ["variable"], "value", (0.5,))
    return s.select("variable", "n", F.col("q")[0].alias("median"), "mean")
