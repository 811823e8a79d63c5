"""Linkage queries: words of the benchmark texts against the words of all documents.

A "name" is a maximal run of the letters A-Z in a text, in upper case.  The gazetteer has one row
per word with the document it first occurs in as its code; document totals play the census.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from canvass.operators import linkage
from canvass.plans.inputs import rounded, rounded_sql, table
from canvass.session import materialize

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def _words(df, id_column):
    runs = F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)
    return df.select(id_column, F.explode(runs).alias("word")).withColumn("word", linkage.fold(F.col("word")))


def gazetteer(spark, sf):
    words = _words(table(spark, sf, "documents"), "doc_id")
    return words.groupBy("word").agg(F.min("doc_id").alias("code"), F.count(F.lit(1)).alias("uses"))


def left_words(spark, sf):
    return _words(table(spark, sf, "benchmark"), "item_id").select("item_id", linkage.normalize_name("word").alias("word"))


def _nearest(spark, sf, right=None):
    right = gazetteer(spark, sf).withColumnRenamed("word", "place") if right is None else right
    return linkage.nearest_names(left_words(spark, sf), right, "word", "place", ["code", "place"])


FOLDED = f"translate(upper(replace({{}}, 'ß', 'ss')), '{linkage.ACCENTED}', '{linkage.PLAIN}')"
WORDS = f"""
gz AS (SELECT w AS place, min(doc_id) AS code, count(*) AS uses FROM (
    SELECT doc_id, {FOLDED.format(r"unnest(regexp_extract_all(text, '\p{L}+'))")} AS w FROM documents) GROUP BY 1),
lw AS (SELECT item_id, {FOLDED.format(r"unnest(regexp_extract_all(text, '\p{L}+'))")} AS word FROM benchmark),
ln AS (SELECT word, count(*) AS n FROM lw GROUP BY 1),
cand AS (
  SELECT ln.word, 0 AS d, gz.code, gz.place FROM ln JOIN gz ON ln.word = gz.place
  UNION ALL
  SELECT u.word, levenshtein(u.word, gz.place) AS d, gz.code, gz.place
  FROM (SELECT word FROM ln WHERE word NOT IN (SELECT place FROM gz)) u, gz
  WHERE abs(length(u.word) - length(gz.place)) <= 3),
best AS (SELECT word, CAST(d AS INTEGER) AS match_distance, place AS matched_name FROM cand WHERE d <= 3
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY d, code, place) = 1),
near AS (SELECT ln.word, ln.n, match_distance, matched_name FROM ln LEFT JOIN best ON ln.word = best.word)
"""


@query("WITH t(doc_id, name) AS (SELECT doc_id, upper(trim(lang, E' \\t\\r\\n')) || '|' || "
       "upper(trim(source, E' \\t\\r\\n')) FROM documents) SELECT name, count(*) AS n FROM t GROUP BY name")
def normalized_names(spark, sf):
    d = table(spark, sf, "documents")
    name = F.concat_ws("|", linkage.normalize_name("lang"), linkage.normalize_name("source"))
    return d.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WORDS} SELECT * FROM near")
def nearest_names(spark, sf):
    return _nearest(spark, sf)


@query(f"""WITH {WORDS} SELECT match_distance, count(*) AS n_names, CAST(sum(n) AS BIGINT) AS n_rows FROM near
  WHERE match_distance IS NOT NULL GROUP BY 1""")
def match_quality(spark, sf):
    return linkage.match_quality(_nearest(spark, sf)).orderBy("match_distance")


@query(rounded_sql(f"""WITH {WORDS} SELECT count(*) AS n_names, count(match_distance) AS n_matched,
  100.0 * count(match_distance) / count(*) AS pct_matched FROM near""", "pct_matched"))
def match_rate(spark, sf):
    return linkage.match_rate(_nearest(spark, sf))


@query(f"""WITH {WORDS} SELECT lw.item_id, lw.word, match_distance, matched_name FROM lw JOIN near ON lw.word = near.word
  WHERE matched_name IS NOT NULL""")
def fuzzy_link(spark, sf):
    return linkage.fuzzy_link(left_words(spark, sf), _nearest(spark, sf), "word")


BLOCKED = """
gz AS (SELECT upper(substr(n_name, 1, 6)) AS grp, n_name AS place, n_nationkey AS ord FROM nation),
lw AS (SELECT 'NATION' AS grp, 'NATION_' || c_nationkey || c_mktsegment[1:1] AS word FROM customer),
ln AS (SELECT grp, word, count(*) AS n FROM lw GROUP BY 1, 2),
cand AS (SELECT ln.grp, ln.word, levenshtein(ln.word, gz.place) AS d, gz.ord, gz.place FROM ln JOIN gz ON ln.grp = gz.grp),
best AS (SELECT grp, word, CAST(d AS INTEGER) AS match_distance, place AS matched_name FROM cand WHERE d <= 2
  QUALIFY row_number() OVER (PARTITION BY grp, word ORDER BY d, ord, place) = 1)
"""


@query(f"""WITH {BLOCKED} SELECT ln.grp, ln.word, ln.n, match_distance, matched_name
  FROM ln LEFT JOIN best ON ln.grp = best.grp AND ln.word = best.word""")
def nearest_names_blocked(spark, sf):
    right = table(spark, sf, "nation").select(
        F.upper(F.substring("n_name", 1, 6)).alias("grp"), F.col("n_name").alias("place"), F.col("n_nationkey").alias("ord")
    )
    left = table(spark, sf, "customer").select(
        F.lit("NATION").alias("grp"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey"), F.substring("c_mktsegment", 1, 1)).alias("word"),
    )
    return linkage.nearest_names(left, right, "word", "place", ["ord", "place"], 2, ["grp"])


# the words of documents labelled toxic against those of documents labelled good, language by language
BY_LANGUAGE = f"""
words AS (SELECT lang, quality, toxic, d.doc_id,
    {FOLDED.format(r"unnest(regexp_extract_all(text, '\p{L}+'))")} AS word
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE lang IS NOT NULL AND (quality = 1 OR toxic = 1)),
gz AS (SELECT lang, word AS place, min(doc_id) AS ord FROM words WHERE quality = 1 GROUP BY 1, 2),
ln AS (SELECT lang, word, count(*) AS n FROM words WHERE toxic = 1 GROUP BY 1, 2),
cand AS (
  SELECT ln.lang, ln.word, 0 AS d, gz.ord, gz.place FROM ln JOIN gz ON ln.lang = gz.lang AND ln.word = gz.place
  UNION ALL
  SELECT u.lang, u.word, levenshtein(u.word, gz.place) AS d, gz.ord, gz.place
  FROM (SELECT lang, word FROM ln ANTI JOIN gz ON ln.lang = gz.lang AND ln.word = gz.place) u
  JOIN gz ON u.lang = gz.lang AND abs(length(u.word) - length(gz.place)) <= 2),
best AS (SELECT lang, word, CAST(d AS INTEGER) AS match_distance, place AS matched_name FROM cand WHERE d <= 2
  QUALIFY row_number() OVER (PARTITION BY lang, word ORDER BY d, ord, place) = 1)
"""


@query(f"""WITH {BY_LANGUAGE} SELECT ln.lang, ln.word, ln.n, match_distance, matched_name
  FROM ln LEFT JOIN best ON ln.lang = best.lang AND ln.word = best.word""")
def nearest_names_by_language(spark, sf):
    """Blocks of very different size: one for each language."""
    labels = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    d = table(spark, sf, "documents").select("doc_id", "lang", "text").join(labels, "doc_id")
    d = d.where("quality = 1 or toxic = 1").withColumn("keys", F.struct("doc_id", "lang", "quality", "toxic"))
    words = _words(d, "keys").select("keys.*", "word")
    right = words.where("quality = 1").select("lang", F.col("word").alias("place"), F.col("doc_id").alias("ord"))
    return linkage.nearest_names(words.where("toxic = 1"), right, "word", "place", ["ord"], 2, ["lang"])


# ------------------------------------------------ code -> id -> attributes -> validation

LINKED = f"""{WORDS},
kt AS (SELECT doc_id AS key_code, source || '/' || doc_id AS place_id FROM documents),
att AS (SELECT source || '/' || d.doc_id AS place_id, n_chars AS pop, quality AS q, toxic AS t
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
linked AS (SELECT lw.item_id, lw.word, near.match_distance, near.matched_name, gz.code, gz.uses
           FROM lw JOIN near ON lw.word = near.word JOIN gz ON near.matched_name = gz.place),
resolved AS (SELECT linked.* REPLACE (CAST(code AS DOUBLE) AS code), place_id FROM linked JOIN kt ON code = key_code
             QUALIFY row_number() OVER (PARTITION BY word ORDER BY item_id, place_id) = 1),
ids AS (SELECT r.*, pop, q, t FROM resolved r LEFT JOIN att ON r.place_id = att.place_id),
rated AS (SELECT *, 100.0 * (q + t) / nullif(pop, 0) AS pct_flags, 100.0 * uses / nullif(pop, 0) AS use_rate FROM ids),
survey AS (SELECT word, count(*) AS survey_n, 100.0 * count(*) FILTER (WHERE item_id % 3 = 0) / count(*) AS survey_pct
           FROM lw GROUP BY word),
val AS (SELECT rated.*, survey_n, survey_pct FROM rated JOIN survey ON rated.word = survey.word
        WHERE pop IS NOT NULL AND survey_n IS NOT NULL)
"""


def _linked(spark, sf):
    right = materialize(gazetteer(spark, sf).withColumnRenamed("word", "place"))
    near = linkage.attach_first(_nearest(spark, sf, right), right, "place", ["code", "place"])
    return linkage.fuzzy_link(left_words(spark, sf), near, "word")


def _resolved(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    place = F.concat(F.col("source"), F.lit("/"), F.col("doc_id"))
    keys = d.select(F.col("doc_id").alias("key_code"), place.alias("place_id"))
    attributes = d.join(table(spark, sf, "labels"), "doc_id", "left").select(
        place.alias("place_id"), F.col("n_chars").alias("pop"), F.col("quality").alias("q"), F.col("toxic").alias("t")
    )
    ids = linkage.link_via_code(
        _linked(spark, sf), "code", keys, "key_code", "place_id", attributes, ["word"], ["item_id", "place_id"]
    )
    return linkage.population_rates(ids, "pop", {"pct_flags": ["q", "t"], "use_rate": ["uses"]})


def _validation(spark, sf):
    survey = left_words(spark, sf).groupBy("word").agg(
        F.count(F.lit(1)).alias("survey_n"),
        F.try_divide(F.lit(100.0) * F.count_if(F.col("item_id") % 3 == 0), F.count(F.lit(1))).alias("survey_pct"),
    )
    return linkage.validation_table(_resolved(spark, sf), survey, "word", ["pop", "survey_n"])


@query(rounded_sql(f"WITH {LINKED} SELECT word, item_id, match_distance, matched_name, code, uses, place_id, pop, q, t, "
                   f"pct_flags, use_rate FROM rated", "code pct_flags use_rate"))
def link_via_code(spark, sf):
    return _resolved(spark, sf).select(
        "word", "item_id", "match_distance", "matched_name", "code", "uses", "place_id", "pop", "q", "t", "pct_flags",
        "use_rate"
    )


@query(rounded_sql(f"""WITH {LINKED}, c AS (SELECT count(*) AS n, corr(survey_n, pop) AS size, corr(survey_pct, pct_flags) AS share
    FROM val)
  SELECT n, 'size' AS pair, size AS r FROM c UNION ALL SELECT n, 'share', share FROM c""", "r"))
def validation_correlations(spark, sf):
    pairs = {"size": ("survey_n", "pop"), "share": ("survey_pct", "pct_flags")}
    return linkage.validation_correlations(_validation(spark, sf), pairs)


VALIDATED = ["pop", "pct_flags", "survey_pct", "use_rate"]


@query(rounded_sql(f"WITH {LINKED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count({c}) AS n, CAST(median({c}) AS DOUBLE) AS median, avg({c}) AS mean FROM val"
    for c in VALIDATED), "median mean"))
def validation_medians(spark, sf):
    return linkage.validation_medians(_validation(spark, sf), VALIDATED)
