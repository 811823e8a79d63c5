"""Regression, bootstrap and variance queries, with closed-form SQL for one and two regressors."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from canvass.functions import semantics as S
from canvass.operators import effects, inference, variance
from canvass.operators.inference import WEBB
from canvass.operators.moments import Spec
from canvass.plans.inputs import INTERVIEWS, interviews, q, rounded, table
from canvass.plans.inputs import rounded_sql as round_in_sql
from canvass.sources.tables import stack_all

QUERIES: dict = {}
SQL: dict[str, str] = {}
REPS, SEED = 999, 42


def query(sql: str | None = None, digits: int = 6):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def rounded_sql(sql: str, columns: str, digits: int = 6) -> str:
    return round_in_sql(sql, columns, digits)


def key_sql(*columns: str) -> str:
    """The name of a cluster: the length and text of each part, or a dash for a missing one."""
    return " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in columns)


# ---------------------------------------------------------------- inputs

def order_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    d = o.join(c, o.o_custkey == c.c_custkey)
    return d.select(
        F.col("c_nationkey").alias("state"),
        F.col("c_custkey").alias("village"),
        S.log1p_or_null("o_totalprice").alias("log_total"),
        (F.col("c_acctbal") / 1000).alias("balance"),
        S.indicator(F.col("c_acctbal") < 0).alias("debtor"),
        S.indicator(S.in_set("o_orderpriority", ["1-URGENT", "2-HIGH"])).alias("rush"),
        S.indicator(F.month("o_orderdate") >= 10).alias("late_in_year"),
        F.when(F.col("o_orderstatus") != "P", S.indicator(F.col("o_orderstatus") == "O")).alias("still_open"),
        F.month("o_orderdate").alias("month"),
    )


ORDER_ROWS = """d AS (SELECT c_nationkey AS state, c_custkey AS village, ln(1 + o_totalprice) AS log_total,
  c_acctbal / 1000 AS balance, CAST(c_acctbal < 0 AS INTEGER) AS debtor,
  CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INTEGER) AS rush,
  CAST(month(o_orderdate) >= 10 AS INTEGER) AS late_in_year,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderstatus = 'O' AS INTEGER) END AS still_open,
  month(o_orderdate) AS month
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

# each with a second regressor held fixed
ORDER_SPECS = [
    Spec("value by balance", "log_total", ("balance", "rush"), min_n=1000),
    Spec("open by value", "still_open", ("log_total", "rush"), min_n=1000),
    Spec("rush by debt", "rush", ("debtor", "late_in_year"), min_n=1000),
    Spec("value by rush", "log_total", ("rush", "debtor"), min_n=1000),
    Spec("value late in the year", "log_total", ("late_in_year", "balance"), min_n=1000),
    Spec("open by debt", "still_open", ("debtor", "late_in_year"), min_n=1000),
    Spec("balance late in the year", "balance", ("late_in_year", "log_total"), min_n=1000),
]
ORDER_CLUSTERS = {"village": ["state", "village"], "state": ["state"]}
ORDER_KEYS = {"village": key_sql("state", "village"), "state": key_sql("state")}


def line_rows(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag"
    )
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    d = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    return d.select(
        F.col("s_nationkey").alias("state"),
        F.col("l_suppkey").alias("supplier"),
        F.col("p_brand").alias("brand"),
        F.floor(F.col("p_retailprice") / 2).cast("int").alias("price_group"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_extendedprice") / 1000).alias("price"),
        (F.col("p_retailprice") + F.col("l_quantity")).alias("built_in"),
        (F.col("p_retailprice") + F.col("s_acctbal") / 50 + F.col("l_quantity")).alias("mixed"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("treatment"),
    )


LINE_ROWS = """d AS (SELECT s_nationkey AS state, l_suppkey AS supplier, p_brand AS brand,
  CAST(floor(p_retailprice / 2) AS INTEGER) AS price_group, l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
  l_extendedprice / 1000 AS price, p_retailprice + l_quantity AS built_in,
  p_retailprice + s_acctbal / 50 + l_quantity AS mixed, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS treatment
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
LINE_CLUSTERS = {"state": ["state"]}
LINE_KEYS = {"state": key_sql("state")}


# ---------------------------------------------------------------- closed-form SQL

def hash_sql(kind: str, text: str) -> str:
    return f"CAST(('0x' || substr(md5('{SEED}|{kind}|' || {text}), 1, 8)) AS BIGINT) % {inference.PRIME}"


def weights_sql(clusters: str) -> str:
    """(g, rep, w) for every cluster g of a table and every replication."""
    options = ", ".join(repr(w) for w in WEBB)
    m = inference.PRIME
    return (
        f"(SELECT g, rep, ([{options}])[(x2 * x2 + r) % {m} % 6 + 1] AS w FROM (SELECT *, (x1 * x1 + c) % {m} AS x2 FROM "
        f"(SELECT g, rep, c, r, (c * r + c + r) % {m} AS x1 FROM (SELECT g, {hash_sql('c', 'g')} AS c FROM "
        f"(SELECT DISTINCT g FROM {clusters})), (SELECT rep, {hash_sql('r', 'rep')} AS r FROM "
        f"(SELECT unnest(range(1, {REPS + 1})) AS rep)))))"
    )


def regression_sql(rows: str, specs: list[Spec], keys: dict[str, str], boot: bool = True, min_n: int = 0,
                   nested: tuple[str, ...] = ()) -> str:
    """WITH clauses ending in ``res``: one row per spec, for specs with one or two regressors.

    The absorbed effect counts as one parameter in the errors of the clusters it is ``nested`` in.

    Works on rows and per-cluster sums with residuals written out, independently of the operator's
    algebra.  With one regressor the second is a column of zeros.
    """
    fe = specs[0].fe
    two = max(len(s.xs) for s in specs) == 2
    k = 2 if two else 1
    cluster = ", ".join(f"{expr} AS g_{name}" for name, expr in keys.items())
    group = f"{fe[0]}" if fe else "0"
    long = " UNION ALL ".join(
        f"SELECT '{s.label}' AS spec, '{s.y}' AS outcome, '{s.key}' AS key_predictor, CAST({s.y} AS DOUBLE) AS y, "
        f"CAST({s.xs[0]} AS DOUBLE) AS x1, CAST({s.xs[1] if len(s.xs) > 1 else '0'} AS DOUBLE) AS x2, "
        f"{group} AS fe, {cluster} FROM d"
        for s in specs
    )
    over = "PARTITION BY spec, fe" if fe else "PARTITION BY spec"
    g_cols = ", ".join(f"g_{name}" for name in keys)
    s22, s12, s2y = ("sum(x2 * x2)", "sum(x1 * x2)", "sum(x2 * y)") if two else ("1.0", "0.0", "0.0")
    params = f"{k} + f.levels" if fe else f"{k + 1}"
    parts = [
        rows,
        f"lng AS (SELECT * FROM ({long}) WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL)",
        f"c AS (SELECT spec, outcome, key_predictor, fe, {g_cols}, x1 - avg(x1) OVER w AS x1, x2 - avg(x2) OVER w AS x2, "
        f"y - avg(y) OVER w AS y FROM lng WINDOW w AS ({over}))",
        f"f0 AS (SELECT spec, outcome, key_predictor, count(*) AS n, count(DISTINCT fe) AS levels, sum(x1 * x1) AS s11, "
        f"{s12} AS s12, {s22} AS s22, sum(x1 * y) AS s1y, {s2y} AS s2y FROM c GROUP BY 1, 2, 3 HAVING count(*) >= {min_n})",
        "f AS (SELECT *, s11 * s22 - s12 * s12 AS det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, "
        "(s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, s22 / (s11 * s22 - s12 * s12) AS a1, "
        "-s12 / (s11 * s22 - s12 * s12) AS a2, s2y / s22 AS r2 FROM f0)",
        f"r AS (SELECT c.spec, c.fe, {g_cols}, x1, x2, y, a1 * x1 + a2 * x2 AS p, y - b1 * x1 - b2 * x2 AS u, "
        "y - r2 * x2 AS e FROM c JOIN f ON c.spec = f.spec)",
        "h AS (SELECT spec, sum((p * u) * (p * u)) AS meat FROM r GROUP BY spec)",
    ]
    columns = ["f.spec", "f.outcome", "f.key_predictor", "f.n AS n_obs", "f.b1 AS beta",
               f"sqrt(f.n / (f.n - ({params})) * h.meat) AS se_hc1"]
    joins = "f JOIN h ON f.spec = h.spec"
    icpt = "0.0" if fe else "1.0"
    for name in keys:
        g = f"g_{name}"
        parts.append(
            f"cl_{name} AS (SELECT spec, fe, {g} AS g, sum(p * u) AS u, sum(p * e) AS al, {icpt} * sum(e) AS te, "
            f"sum(e) AS esum, sum(p) AS apt, sum(x1 * e) AS e1, sum(x2 * e) AS e2, {icpt} * sum(p) AS ct, sum(p * x1) AS c1, "
            f"sum(p * x2) AS c2 FROM r GROUP BY spec, fe, {g})"
        )
        parts.append(
            f"t_{name} AS (SELECT spec, count(*) AS gs, sum(u * u) AS meat FROM "
            f"(SELECT spec, g, sum(u) AS u FROM cl_{name} GROUP BY 1, 2) GROUP BY spec)"
        )
        columns += [f"t_{name}.gs AS n_clusters_{name}",
                    f"sqrt(t_{name}.gs / (t_{name}.gs - 1) * (f.n - 1) / (f.n - ({k + 1 if name in nested else params})) "
                    f"* t_{name}.meat) AS se_{name}"]
        joins += f" JOIN t_{name} ON f.spec = t_{name}.spec"
        if not boot:
            continue
        mu = ("0.0" if not fe else "mu")
        mu_join = f"JOIN mu_{name} m ON m.spec = z.spec AND m.rep = w.rep AND m.fe = z.fe" if fe else ""
        parts.append(
            f"w_{name} AS {weights_sql(f'cl_{name}')}"
        )
        if fe:
            parts.append(
                f"mu_{name} AS (SELECT z.spec, w.rep, z.fe, sum(w * esum) / any_value(nf) AS mu FROM cl_{name} z "
                f"JOIN w_{name} w ON z.g = w.g JOIN (SELECT spec, fe, count(*) AS nf FROM r GROUP BY 1, 2) q "
                f"ON q.spec = z.spec AND q.fe = z.fe GROUP BY 1, 2, 3)"
            )
        parts.append(
            f"d_{name} AS (SELECT spec, rep, d0, (s22 * e1 - s12 * e2) / det AS d1, (s11 * e2 - s12 * e1) / det AS d2 FROM "
            f"(SELECT z.spec, w.rep, sum(w * te) / any_value(f.n) AS d0, sum(w * e1) AS e1, sum(w * e2) AS e2, "
            f"any_value(s11) AS s11, any_value(s12) AS s12, any_value(s22) AS s22, any_value(det) AS det "
            f"FROM cl_{name} z JOIN w_{name} w ON z.g = w.g JOIN f ON f.spec = z.spec GROUP BY 1, 2))"
        )
        parts.append(
            f"v_{name} AS (SELECT spec, rep, sum(sc * sc) AS v FROM (SELECT z.spec, w.rep, z.g, "
            f"sum(w.w * al - apt * {mu} - ct * d0 - c1 * d1 - c2 * d2) AS sc FROM cl_{name} z JOIN w_{name} w ON z.g = w.g "
            f"{mu_join} JOIN d_{name} d ON d.spec = z.spec AND d.rep = w.rep GROUP BY 1, 2, 3) GROUP BY 1, 2)"
        )
        parts.append(
            f"p_{name} AS (SELECT d.spec, avg(CASE WHEN d1 * d1 / v > b1 * b1 / meat * (1 + 1e-9) THEN 1.0 ELSE 0.0 END) AS p "
            f"FROM d_{name} d JOIN v_{name} v ON d.spec = v.spec AND d.rep = v.rep JOIN f ON f.spec = d.spec "
            f"JOIN t_{name} t ON t.spec = d.spec GROUP BY 1)"
        )
        columns.append(f"p_{name}.p AS p_boot_{name}")
        joins += f" JOIN p_{name} ON f.spec = p_{name}.spec"
    parts.append(f"res AS (SELECT {', '.join(columns)} FROM {joins})")
    flags = ["*", "beta / se_hc1 AS t_hc1", "abs(beta / se_hc1) > 1.96 AS sig_hc1"]
    for name in keys:
        flags += [f"beta / se_{name} AS t_{name}", f"abs(beta / se_{name}) > 1.96 AS sig_{name}"]
        if boot:
            flags.append(f"p_boot_{name} < 0.05 AS sig_boot_{name}")
    parts.append(f"tab AS (SELECT {', '.join(flags)}, false AS boot_failed FROM res)")
    return "WITH " + ", ".join(parts)


def inference_columns(keys, boot=True) -> str:
    names = ["beta", "se_hc1", "t_hc1"]
    for c in keys:
        names += [f"se_{c}", f"t_{c}"] + ([f"p_boot_{c}"] if boot else [])
    return " ".join(names)


def _order_table(spark, sf):
    return inference.inference_table(order_rows(spark, sf), ORDER_SPECS, ORDER_CLUSTERS, reps=REPS, seed=SEED)


ORDER_SQL = regression_sql(ORDER_ROWS, ORDER_SPECS, ORDER_KEYS, min_n=1000)
ORDER_DOUBLES = inference_columns(ORDER_KEYS)


@query(rounded_sql(regression_sql(ORDER_ROWS, ORDER_SPECS, ORDER_KEYS, boot=False, min_n=1000) + " SELECT * FROM tab",
                   inference_columns(ORDER_KEYS, boot=False)))
def regression_errors(spark, sf):
    return inference.inference_table(order_rows(spark, sf), ORDER_SPECS, ORDER_CLUSTERS, bootstrap=[])


@query(rounded_sql(ORDER_SQL + " SELECT * FROM tab", ORDER_DOUBLES))
def inference_table(spark, sf):
    return _order_table(spark, sf)


VERDICT = """CASE WHEN sig_hc1 AND sig_state AND sig_boot_state THEN 'ROBUST'
  WHEN sig_hc1 AND NOT sig_boot_state THEN 'FRAGILE' WHEN NOT sig_hc1 THEN 'Not sig' ELSE 'Mixed' END AS verdict"""
CODE = "||".join(f"CASE WHEN {f} THEN '{c}' ELSE '-' END" for f, c in [
    ("sig_hc1", "H"), ("sig_village", "V"), ("sig_state", "S"), ("sig_boot_village", "v"), ("sig_boot_state", "s")])


@query(f"{ORDER_SQL} SELECT spec, {VERDICT}, {CODE} AS sig_code FROM tab")
def verdicts(spark, sf):
    letters = {"sig_hc1": "H", "sig_village": "V", "sig_state": "S", "sig_boot_village": "v", "sig_boot_state": "s"}
    t = inference.verdict(_order_table(spark, sf), "sig_hc1", "sig_state", "sig_boot_state")
    return inference.significance_code(t, letters).select("spec", "verdict", "sig_code")


@query(f"{ORDER_SQL} " + " UNION ALL ".join(
    f"SELECT '{m}' AS method, count(*) AS n_specs, count(*) FILTER (WHERE {m}) AS n_significant, "
    f"count(*) FILTER (WHERE sig_hc1 AND NOT {m}) AS n_flips FROM tab"
    for m in ["sig_hc1", "sig_village", "sig_state", "sig_boot_village", "sig_boot_state"]))
def flip_summary(spark, sf):
    others = ["sig_village", "sig_state", "sig_boot_village", "sig_boot_state"]
    return inference.flip_summary(_order_table(spark, sf), "sig_hc1", others)


T_LABELS = {"t_hc1": "HC1", "t_village": "Village cluster", "t_state": "State cluster"}


@query(rounded_sql(f"{ORDER_SQL} " + " UNION ALL ".join(
    f"SELECT spec, '{lab}' AS method, CAST({i} AS INTEGER) AS method_order, {c} AS t_stat, abs({c}) AS size FROM tab"
    for i, (c, lab) in enumerate(T_LABELS.items(), 1)), "t_stat size"))
def t_by_method(spark, sf):
    return inference.tidy(_order_table(spark, sf), ["spec"], T_LABELS, "method", "t_stat")


P_LABELS = {"p_boot_village": "Village", "p_boot_state": "State"}


@query(rounded_sql(f"{ORDER_SQL} " + " UNION ALL ".join(
    f"SELECT spec, '{lab}' AS level, CAST({i} AS INTEGER) AS level_order, {c} AS p_value, abs({c}) AS size FROM tab"
    for i, (c, lab) in enumerate(P_LABELS.items(), 1)), "p_value size"))
def p_by_level(spark, sf):
    return inference.tidy(_order_table(spark, sf), ["spec"], P_LABELS, "level", "p_value")


OUTCOMES = {"quantity": "Quantity", "discount": "Discount", "tax": "Tax", "price": "Price", "built_in": "Built in",
            "absent": "Not in the table"}
OUTCOME_SPECS = [Spec(label, y, ("treatment",)) for y, label in OUTCOMES.items() if y != "absent"]


@query(rounded_sql(regression_sql(LINE_ROWS, OUTCOME_SPECS, LINE_KEYS, min_n=100) + f" SELECT *, {VERDICT} FROM tab",
                   inference_columns(LINE_KEYS)))
def multi_outcome_effect(spark, sf):
    rows = line_rows(spark, sf)
    specs = inference.outcome_specs(rows, OUTCOMES, "treatment")
    t = inference.inference_table(rows, specs, LINE_CLUSTERS, reps=REPS, seed=SEED)
    return inference.verdict(t, "sig_hc1", "sig_state", "sig_boot_state")


KEY_SPECS = [
    Spec("Price ~ quantity", "price", ("quantity", "discount"), min_n=50),
    Spec("Price ~ discount", "price", ("discount", "quantity"), min_n=50),
    Spec("Built in ~ quantity", "built_in", ("quantity", "tax"), min_n=50),
    Spec("Built in ~ tax", "built_in", ("tax", "quantity"), min_n=50),
]


@query(rounded_sql(regression_sql(LINE_ROWS, KEY_SPECS, LINE_KEYS, min_n=50) + f" SELECT *, {VERDICT} FROM tab",
                   inference_columns(LINE_KEYS)))
def key_predictor_report(spark, sf):
    t = inference.inference_table(line_rows(spark, sf), KEY_SPECS, LINE_CLUSTERS, reps=REPS, seed=SEED)
    return inference.verdict(t, "sig_hc1", "sig_state", "sig_boot_state")


FE_SPECS = [
    Spec("Price ~ quantity + brand", "price", ("quantity", "discount"), fe=("brand",), min_n=100),
    Spec("Price ~ discount + brand", "price", ("discount", "quantity"), fe=("brand",), min_n=100),
]


@query(rounded_sql(regression_sql(LINE_ROWS, FE_SPECS, LINE_KEYS, min_n=100) + f" SELECT *, {VERDICT} FROM tab",
                   inference_columns(LINE_KEYS)))
def absorbed_effect_report(spark, sf):
    t = inference.inference_table(line_rows(spark, sf), FE_SPECS, LINE_CLUSTERS, reps=REPS, seed=SEED)
    return inference.verdict(t, "sig_hc1", "sig_state", "sig_boot_state")


# customers lie within nations, not within months
NESTED_SPECS = [
    Spec("value by rush + village", "log_total", ("rush", "late_in_year"), fe=("village",), min_n=100),
    Spec("open by value + village", "still_open", ("log_total", "rush"), fe=("village",), min_n=100),
]
NESTED_CLUSTERS = {"state": ["state"], "month": ["month"]}
NESTED_KEYS = {"state": key_sql("state"), "month": key_sql("month")}


@query(rounded_sql(regression_sql(ORDER_ROWS, NESTED_SPECS, NESTED_KEYS, boot=False, min_n=100, nested=("state",)) + " SELECT * FROM tab",
                   inference_columns(NESTED_KEYS, boot=False)))
def nested_effect_report(spark, sf):
    """An absorbed effect nested in one kind of cluster and not in the other."""
    return inference.inference_table(order_rows(spark, sf), NESTED_SPECS, NESTED_CLUSTERS, bootstrap=[])


# interviews with missing answers among the parts of the cluster keys
ANSWER_SPECS = [
    Spec("size by hour", "q_size", ("start_hour", "date_interview"), min_n=50),
    Spec("minutes by size", "duration_mins", ("q_size", "start_hour"), min_n=50),
]
ANSWER_CLUSTERS = {"answer": ["state", "q_group"], "kind": ["q_kind"]}
ANSWER_KEYS = {"answer": key_sql("state", "q_group"), "kind": key_sql("q_kind")}


def answer_sql(where: str = "true") -> str:
    rows = f"{INTERVIEWS}, d AS (SELECT * FROM iv WHERE {where})"
    sql = regression_sql(rows, ANSWER_SPECS, ANSWER_KEYS, min_n=50) + " SELECT * FROM tab"
    return rounded_sql(sql, inference_columns(ANSWER_KEYS))


def _answer_report(spark, sf, missing):
    return inference.inference_table(
        interviews(spark, sf), ANSWER_SPECS, ANSWER_CLUSTERS, reps=REPS, seed=SEED, missing_clusters=missing
    )


@query(answer_sql())
def missing_clusters_as_level(spark, sf):
    return _answer_report(spark, sf, "level")


@query(answer_sql("state IS NOT NULL AND q_group IS NOT NULL AND q_kind IS NOT NULL"))
def missing_clusters_dropped(spark, sf):
    return _answer_report(spark, sf, "drop")


# the last regressor is the sum of two others, so one of the three has to go: the last in the order of the spec
MANY_SPECS = [
    Spec("price by quantity", "price", ("quantity", "discount", "tax", "levies"), min_n=50),
    Spec("price by discount", "price", ("discount", "quantity", "tax", "levies"), min_n=50),
    Spec("price by levies", "price", ("levies", "quantity", "discount", "tax"), min_n=50),
]
MANY_ROWS = LINE_ROWS + ", m AS (SELECT *, discount + tax AS levies FROM d)"


def partialling_sql(rows: str, source: str, specs: list[Spec], keys: dict[str, str]) -> str:
    """Errors of specs with any number of regressors, by taking out one regressor after the other.

    The first round, in the spec's order, finds the regressors with variation of their own; the second
    takes those out of the reported one and of the outcome.  No matrix is inverted.
    """
    k = max(len(s.xs) for s in specs)
    xs = range(1, k + 1)
    g = ", ".join(f"{expr} AS g_{name}" for name, expr in keys.items())
    names = ", ".join(f"g_{name}" for name in keys)
    long = " UNION ALL ".join(
        f"SELECT '{s.label}' AS spec, '{s.y}' AS outcome, '{s.key}' AS key_predictor, CAST({s.y} AS DOUBLE) AS y, "
        + ", ".join(f"CAST({s.xs[j - 1] if j <= len(s.xs) else '0'} AS DOUBLE) AS x{j}" for j in xs)
        + f", {g} FROM {source}"
        for s in specs
    )
    w = "WINDOW w AS (PARTITION BY spec)"

    def without(j: int, of: list[str]) -> str:
        own = f"sum(b{j} * b{j}) OVER w > 1e-10 * sum(x{j} * x{j}) OVER w"
        return ", ".join(
            f"CASE WHEN {own} THEN {v} - b{j} * (sum(b{j} * {v}) OVER w / sum(b{j} * b{j}) OVER w) ELSE {v} END AS {v}" for v in of
        )

    parts = [
        rows,
        f"lng AS (SELECT * FROM ({long}) WHERE y IS NOT NULL AND " + " AND ".join(f"x{j} IS NOT NULL" for j in xs) + ")",
        f"a0 AS (SELECT spec, outcome, key_predictor, {names}, y - avg(y) OVER w AS y, "
        + ", ".join(f"x{j} - avg(x{j}) OVER w AS x{j}, x{j} - avg(x{j}) OVER w AS b{j}" for j in xs) + f" FROM lng {w})",
    ]
    for j in range(1, k):
        parts.append(f"a{j} AS (SELECT * REPLACE ({without(j, [f'b{i}' for i in range(j + 1, k + 1)])}) FROM a{j - 1} {w})")
    own = {j: f"sum(b{j} * b{j}) OVER w > 1e-10 * sum(x{j} * x{j}) OVER w" for j in xs}
    parts.append(
        f"c1 AS (SELECT * REPLACE ({', '.join(f'CASE WHEN {own[j]} THEN x{j} ELSE 0 END AS b{j}' for j in xs)}), "
        + " + ".join(f"CASE WHEN {own[j]} THEN 1 ELSE 0 END" for j in xs) + f" AS params FROM a{k - 1} {w})"
    )
    for j in range(2, k + 1):
        parts.append(f"c{j} AS (SELECT * REPLACE ({without(j, ['b1', 'y', *[f'b{i}' for i in range(j + 1, k + 1)]])}) FROM c{j - 1} {w})")
    parts += [
        f"f AS (SELECT spec, outcome, key_predictor, count(*) AS n, any_value(params) + 1 AS params, sum(b1 * b1) AS s11, "
        f"sum(b1 * y) / sum(b1 * b1) AS beta FROM c{k} GROUP BY 1, 2, 3)",
        f"r AS (SELECT spec, {names}, b1 / s11 * (y - beta * b1) AS u FROM c{k} JOIN f USING (spec))",
        "h AS (SELECT spec, sum(u * u) AS meat FROM r GROUP BY 1)",
    ]
    columns = ["f.spec", "f.outcome", "f.key_predictor", "f.n AS n_obs", "f.beta", "sqrt(n / (n - params) * h.meat) AS se_hc1"]
    joins = "f JOIN h ON f.spec = h.spec"
    for name in keys:
        parts.append(
            f"t_{name} AS (SELECT spec, count(*) AS gs, sum(u * u) AS meat FROM "
            f"(SELECT spec, g_{name}, sum(u) AS u FROM r GROUP BY 1, 2) GROUP BY 1)"
        )
        columns += [f"t_{name}.gs AS n_clusters_{name}", f"sqrt(t_{name}.gs / (t_{name}.gs - 1) * (n - 1) / (n - params) * t_{name}.meat) AS se_{name}"]
        joins += f" JOIN t_{name} ON f.spec = t_{name}.spec"
    flags = ["*", "beta / se_hc1 AS t_hc1", "abs(beta / se_hc1) > 1.96 AS sig_hc1", "false AS boot_failed"]
    for name in keys:
        flags += [f"beta / se_{name} AS t_{name}", f"abs(beta / se_{name}) > 1.96 AS sig_{name}"]
    return f"WITH {', '.join(parts)} SELECT {', '.join(flags)} FROM (SELECT {', '.join(columns)} FROM {joins})"


@query(rounded_sql(partialling_sql(MANY_ROWS, "m", MANY_SPECS, LINE_KEYS), inference_columns(LINE_KEYS, boot=False)))
def many_regressors(spark, sf):
    """Four regressors, one of them the sum of two others."""
    rows = line_rows(spark, sf).withColumn("levies", F.col("discount") + F.col("tax"))
    return inference.inference_table(rows, MANY_SPECS, LINE_CLUSTERS, bootstrap=[])


SURVIVOR_FLAGS = ["sig_hc1", "sig_state", "sig_boot_state"]


@query(regression_sql(LINE_ROWS, KEY_SPECS, LINE_KEYS, min_n=50) + f" SELECT spec, key_predictor FROM tab WHERE {' AND '.join(SURVIVOR_FLAGS)}")
def surviving_specs(spark, sf):
    """The specifications that are significant under every method."""
    t = inference.inference_table(line_rows(spark, sf), KEY_SPECS, LINE_CLUSTERS, reps=REPS, seed=SEED)
    return inference.survivors(t, SURVIVOR_FLAGS).select("spec", "key_predictor")


SCREEN = 0.5  # a wide net: what has a robust |t| above this is listed unless every bootstrap confirms it


@query(f"""{ORDER_SQL} SELECT spec, key_predictor FROM tab WHERE abs(t_hc1) > {SCREEN} AND NOT (sig_boot_village AND sig_boot_state)
  AND p_boot_village IS NOT NULL AND p_boot_state IS NOT NULL""")
def fragile_specs(spark, sf):
    """Above the screening value with robust errors, not significant under some bootstrap; specifications whose bootstrap failed are no part."""
    t = inference.inference_table(order_rows(spark, sf), ORDER_SPECS, ORDER_CLUSTERS, reps=REPS, seed=SEED, crit=SCREEN)
    listed = inference.fragile(t, "sig_hc1", ["sig_boot_village", "sig_boot_state"], ["p_boot_village", "p_boot_state"])
    return listed.select("spec", "key_predictor")


RESTRICTED = "village >= 30 AND balance < 5 AND late_in_year = 1"


RESTRICTED_ROWS = f"{ORDER_ROWS.replace('d AS', 'everyone AS', 1)}, d AS (SELECT * FROM everyone WHERE {RESTRICTED})"


@query(rounded_sql(regression_sql(RESTRICTED_ROWS, ORDER_SPECS[:2], ORDER_KEYS, boot=False, min_n=20) + " SELECT * FROM tab",
                   inference_columns(ORDER_KEYS, boot=False)))
def restricted_sample(spark, sf):
    """Two regressions on the rows that meet three conditions; a missing value meets none."""
    rows = order_rows(spark, sf).where(RESTRICTED)
    specs = [replace(s, min_n=20) for s in ORDER_SPECS[:2]]
    return inference.inference_table(rows, specs, ORDER_CLUSTERS, bootstrap=[])


@query(rounded_sql(
    "SELECT * FROM (" + regression_sql(LINE_ROWS, KEY_SPECS[:2], LINE_KEYS, boot=False)
    + " SELECT spec, beta, t_hc1, t_state AS t_clust, 'state' AS cluster_type FROM tab) UNION ALL SELECT * FROM ("
    + regression_sql(ORDER_ROWS, ORDER_SPECS[:2], {"village": ORDER_KEYS["village"]}, boot=False)
    + " SELECT spec, beta, t_hc1, t_village AS t_clust, 'village' AS cluster_type FROM tab)", "beta t_hc1 t_clust"))
def combined_report(spark, sf):
    """Two reports with differently named cluster columns stacked into one table."""
    lines = inference.inference_table(line_rows(spark, sf), KEY_SPECS[:2], LINE_CLUSTERS, bootstrap=[])
    orders = inference.inference_table(order_rows(spark, sf), ORDER_SPECS[:2], {"village": ["state", "village"]}, bootstrap=[])
    keep = ["spec", "beta", "t_hc1", "t_clust", "cluster_type"]
    a = lines.withColumnRenamed("t_state", "t_clust").withColumn("cluster_type", F.lit("state")).select(*keep)
    b = orders.withColumnRenamed("t_village", "t_clust").withColumn("cluster_type", F.lit("village")).select(*keep)
    return stack_all(a, b)


# ---------------------------------------------------------------- variance

CELLS = """y0 AS (SELECT price_group AS a, supplier AS b, {y} AS y FROM d WHERE {y} IS NOT NULL),
  y1 AS (SELECT a, b, y - avg(y) OVER () AS y FROM y0),
  tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(y) AS s, sum(y * y) AS ss FROM y1),
  cell AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM y1 GROUP BY a, b),
  ga AS (SELECT a, CAST(count(*) AS DOUBLE) AS n, sum(y) AS s FROM y1 GROUP BY a),
  gb AS (SELECT b, CAST(count(*) AS DOUBLE) AS n, sum(y) AS s FROM y1 GROUP BY b),
  ta AS (SELECT count(*) AS la, sum(s * s / n) AS ba, sum(n * n) AS qa FROM ga),
  tb AS (SELECT count(*) AS lb, sum(s * s / n) AS bb, sum(n * n) AS qb FROM gb),
  xa AS (SELECT sum(cell.n * cell.n / ga.n) AS ca FROM cell JOIN ga ON cell.a = ga.a),
  xb AS (SELECT sum(cell.n * cell.n / gb.n) AS cb FROM cell JOIN gb ON cell.b = gb.b)"""
MOMENTS = """eq AS (SELECT n, la, lb, ss - ba AS u1, ss - bb AS u2, n * ss - s * s AS u3,
    n - ca AS p, n - la AS q, n - cb AS r, n - lb AS t, n * n - qa AS v, n * n - qb AS w, n * n - n AS z
    FROM tot, ta, tb, xa, xb),
  -- u1 = p vb + q ve;  u2 = r va + t ve;  u3 = v va + w vb + z ve
  sol AS (SELECT *, (u3 - v * u2 / r - w * u1 / p) / (z - v * t / r - w * q / p) AS ve FROM eq),
  raw AS (SELECT *, (u2 - t * ve) / r AS va, (u1 - q * ve) / p AS vb FROM sol),
  vc AS (SELECT CAST(n AS BIGINT) AS n, la AS levels_a, lb AS levels_b, greatest(va, 0) AS var_a, greatest(vb, 0) AS var_b,
    greatest(ve, 0) AS var_residual, va < 0 OR vb < 0 OR ve < 0 AS clipped FROM raw)"""
SHARES = "var_a / (var_a + var_b + var_residual) AS icc_a, var_b / (var_a + var_b + var_residual) AS icc_b"


def moments_sql(outcomes):
    return " UNION ALL ".join(
        f"(WITH {LINE_ROWS}, {CELLS.format(y=y)}, {MOMENTS} SELECT '{label}' AS outcome, *, {SHARES} FROM vc)"
        for label, y in outcomes.items())


MOMENT_OUTCOMES = {"Mixed": "mixed", "Quantity": "quantity"}


@query(rounded_sql(moments_sql(MOMENT_OUTCOMES), "var_a var_b var_residual icc_a icc_b", 4), digits=4)
def moment_components(spark, sf):
    parts = []
    for label, y in MOMENT_OUTCOMES.items():
        c = variance.materialize(variance.cells(line_rows(spark, sf), y, "price_group", "supplier"))
        found = variance.moment_components(variance.centre(c))
        parts.append(found.select(F.lit(label).alias("outcome"), "*"))
    return stack_all(*parts)


@query()
def variance_components(spark, sf):
    return variance.variance_components(line_rows(spark, sf), MOMENT_OUTCOMES, "price_group", "supplier")


BALANCED = {"Mixed": "mixed", "Quantity": "quantity", "Discount": "discount"}


def balanced_sql(label: str, y: str) -> str:
    """REML of a two-way table with one value in every cell: mean squares, pooled from below where they are out of order."""
    return f"""(WITH {LINE_ROWS}, k AS (SELECT state AS a, brand AS b, avg({y}) AS y FROM d GROUP BY 1, 2),
  size AS (SELECT count(*) AS n, count(DISTINCT a) AS la, count(DISTINCT b) AS lb, avg(y) AS m, var_samp(y) * (count(*) - 1) AS sst FROM k),
  fa AS (SELECT sum((x - m) ** 2) AS q FROM (SELECT avg(y) AS x FROM k GROUP BY a), size),
  fb AS (SELECT sum((x - m) ** 2) AS q FROM (SELECT avg(y) AS x FROM k GROUP BY b), size),
  sq AS (SELECT n, la, lb, fa.q * lb AS ssa, fb.q * la AS ssb, sst - fa.q * lb - fb.q * la AS sse,
    la - 1 AS dfa, lb - 1 AS dfb, (la - 1) * (lb - 1) AS dfe FROM size, fa, fb),
  ms AS (SELECT *, ssa / dfa AS msa, ssb / dfb AS msb FROM sq),
  one AS (SELECT *, least(msa, msb) AS low, CASE WHEN msa <= msb THEN ssa ELSE ssb END AS ss1,
    CASE WHEN msa <= msb THEN dfa ELSE dfb END AS df1, CASE WHEN msa <= msb THEN ssb ELSE ssa END AS ss2,
    CASE WHEN msa <= msb THEN dfb ELSE dfa END AS df2 FROM ms),
  two AS (SELECT *, CASE WHEN low < sse / dfe THEN sse + ss1 ELSE sse END AS ss, CASE WHEN low < sse / dfe THEN dfe + df1 ELSE dfe END AS df FROM one),
  three AS (SELECT *, CASE WHEN ss2 / df2 < ss / df THEN (ss + ss2) / (df + df2) ELSE ss / df END AS e FROM two),
  var AS (SELECT n, la, lb, greatest(msa - e, 0) / lb AS va, greatest(msb - e, 0) / la AS vb, e FROM three)
SELECT '{label}' AS outcome, n, la AS levels_a, lb AS levels_b, va AS var_a, vb AS var_b, e AS var_residual, 'reml' AS estimator,
  false AS clipped, true AS converged, va / (va + vb + e) AS icc_a, vb / (va + vb + e) AS icc_b
FROM var WHERE n >= 100 AND la > 10 AND lb > 10)"""


@query(rounded_sql(" UNION ALL ".join(balanced_sql(label, y) for label, y in BALANCED.items()),
                   "var_a var_b var_residual icc_a icc_b", 6), digits=6)
def balanced_components(spark, sf):
    rows = line_rows(spark, sf).groupBy("state", "brand").agg(*[F.avg(y).alias(y) for y in BALANCED.values()])
    return variance.variance_components(rows, BALANCED, "state", "brand")


@query(rounded_sql(" UNION ALL ".join(
    f"SELECT outcome, '{name}' AS component, {expr} AS variance_share FROM ({moments_sql({'Mixed': 'mixed'})}) "
    "WHERE levels_a > 10 AND levels_b > 10 AND n >= 100"
    for name, expr in [("Price group", "icc_a"), ("Supplier", "icc_b"), ("Residual", "1 - icc_a - icc_b")]),
    "variance_share", 4), digits=4)
def variance_shares(spark, sf):
    found = variance.variance_components(line_rows(spark, sf), {"Mixed": "mixed"}, "price_group", "supplier", estimator="moments")
    return variance.share_table(found, {"a": "Price group", "b": "Supplier", "residual": "Residual"})


@query(rounded_sql(f"WITH {LINE_ROWS}, {CELLS.format(y='mixed')} SELECT CAST(n AS BIGINT) AS n, (ba - s * s / n) / (ss - s * s / n) AS r2_a, "
                   "(bb - s * s / n) / (ss - s * s / n) AS r2_b FROM tot, ta, tb", "r2_a r2_b"))
def one_way_r2(spark, sf):
    c = variance.cells(line_rows(spark, sf), "mixed", "price_group", "supplier")
    return variance.one_way_r2(variance.centre(c))


def two_way_sql(label: str, y: str, steps: int = 25) -> str:
    """Both group effects by alternating means over the cells, written out step by step."""
    chain = []
    for t in range(1, steps + 1):
        before = f"b{t - 1}" if t > 1 else "(SELECT b, 0.0 AS e FROM sb)"
        chain += [
            f"a{t} AS MATERIALIZED (SELECT k.a, (any_value(sa.s) - sum(k.n * p.e)) / any_value(sa.n) AS e FROM cell k "
            f"JOIN {before} p ON k.b = p.b JOIN sa ON k.a = sa.a GROUP BY k.a)",
            f"b{t} AS MATERIALIZED (SELECT k.b, (any_value(sb.s) - sum(k.n * p.e)) / any_value(sb.n) AS e FROM cell k "
            f"JOIN a{t} p ON k.a = p.a JOIN sb ON k.b = sb.b GROUP BY k.b)",
        ]
    return f"""(WITH {LINE_ROWS}, r0 AS (SELECT price_group AS a, supplier AS b, {y} AS y FROM d WHERE {y} IS NOT NULL),
  r1 AS (SELECT * FROM r0 QUALIFY count(*) OVER (PARTITION BY a) >= 5),
  r2 AS (SELECT * FROM r1 QUALIFY count(*) OVER (PARTITION BY b) >= 5),
  r3 AS MATERIALIZED (SELECT a, b, y - avg(y) OVER () AS y FROM r2),
  cell AS MATERIALIZED (SELECT a, b, count(*) AS n FROM r3 GROUP BY 1, 2),
  sa AS MATERIALIZED (SELECT a, count(*) AS n, sum(y) AS s FROM r3 GROUP BY 1),
  sb AS MATERIALIZED (SELECT b, count(*) AS n, sum(y) AS s FROM r3 GROUP BY 1),
  {', '.join(chain)},
  x AS (SELECT (SELECT count(*) FROM r3) AS n, (SELECT sum(y * y) FROM r3) AS sst,
    (SELECT sum(s * s / n) FROM sa) AS ea, (SELECT sum(s * s / n) FROM sb) AS eb,
    (SELECT sum(sa.s * p.e) FROM sa JOIN a{steps} p ON sa.a = p.a)
      + (SELECT sum(sb.s * p.e) FROM sb JOIN b{steps} p ON sb.b = p.b) AS eab)
  SELECT '{label}' AS outcome, n, ea / sst AS r2_a, eb / sst AS r2_b, eab / sst AS r2_both,
    (eab - ea) / sst AS r2_b_given_a FROM x)"""


@query(rounded_sql(" UNION ALL ".join(two_way_sql(label, y) for label, y in MOMENT_OUTCOMES.items()),
                   "r2_a r2_b r2_both r2_b_given_a"))
def fe_r2(spark, sf):
    return variance.fe_r2(line_rows(spark, sf), MOMENT_OUTCOMES, "price_group", "supplier")


MEANS = """mn AS (SELECT source, interviewer, count(*) AS n, avg(q_size) AS mean_value, stddev_samp(q_size) AS sd_value,
    100.0 * avg(CASE WHEN q_group IN (1, 2) THEN 1 ELSE 0 END) AS pct_flag, count(DISTINCT state) AS n_areas
  FROM iv WHERE q_size > 0 AND q_size < 100 GROUP BY 1, 2 HAVING count(*) >= 20)"""


def _means(spark, sf):
    d = interviews(spark, sf).withColumn("flag", S.indicator(S.in_set("q_group", [1, 2]), missing_as_zero=True))
    return variance.interviewer_means(d, "q_size", "flag", "state", ["source", "interviewer"])


@query(q(INTERVIEWS, f", {MEANS} SELECT * FROM mn", "mean_value sd_value pct_flag"), digits=9)
def interviewer_means(spark, sf):
    return _means(spark, sf)


@query(q(INTERVIEWS, f""", {MEANS} SELECT source, count(*) AS n_interviewers, avg(mean_value) AS mean_value_mean,
  stddev_samp(mean_value) AS mean_value_sd, stddev_samp(mean_value) / avg(mean_value) AS mean_value_cv,
  avg(pct_flag) AS pct_flag_mean, stddev_samp(pct_flag) AS pct_flag_sd, stddev_samp(pct_flag) / avg(pct_flag) AS pct_flag_cv
  FROM mn GROUP BY source""", "mean_value_mean mean_value_sd mean_value_cv pct_flag_mean pct_flag_sd pct_flag_cv"), digits=9)
def interviewer_mean_spread(spark, sf):
    return variance.interviewer_mean_spread(_means(spark, sf), ["source"])
