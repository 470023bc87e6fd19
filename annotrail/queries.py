"""Registered queries over the driver's tables, with their SQL for DuckDB.

Coders are rules over columns, so both engines can apply them: on documents the
gold quality, a length rule and a language rule; on orders three ordinal
ratings; on lineitem three measurements.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotrail.operators import corpus, legacy, reliability, validation
from annotrail.operators import ratings as R
from annotrail.plans import codebook as cb
from annotrail.plans import coding, lineage
from annotrail.session import ship
from annotrail.sources.backends import RuleBackend, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


NOMINAL = ["quality", "length", "language"]
ORDINAL = ["priority", "customer", "price"]
INTERVAL = ["quantity", "line", "mixed"]


def _coders(spark: SparkSession, sf_dir: str, kind: str, names: list[str], complete: bool = True) -> DataFrame:
    """Long ratings of the coders ``names``: one pass over the table, a row for each coder."""
    if kind == "nominal":
        d = _table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
        d = d.join(_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "inner" if complete else "left")
        rules = {"quality": F.col("quality"), "length": (F.col("n_chars") >= 500).cast("int"), "language": (F.col("lang") == "en").cast("int")}
        unit = F.col("doc_id")
        if not complete:
            rules["language"] = F.when(F.col("n_chars") < 3000, rules["language"])
    elif kind == "ordinal":
        d = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
        rules = {"priority": F.substring("o_orderpriority", 1, 1).cast("int"), "customer": F.col("o_custkey") % 5 + 1, "price": F.least(F.floor(F.col("o_totalprice") / 50000) + 1, F.lit(5))}
        unit = F.col("o_orderkey")
    else:
        d = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
        # A key may occur again; its least measurements count.
        d = d.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_tax").alias("t"))
        rules = {"quantity": F.col("q"), "line": F.col("q") + F.col("l_linenumber"), "mixed": F.floor(F.col("q") * (1 + F.col("t") * 5))}
        unit = F.concat_ws("-", "l_orderkey", "l_linenumber")
    cells = [F.struct(F.lit(n).alias("rater_id"), rules[n].cast("double").alias("num")) for n in names]
    long = d.select(unit.cast("string").alias("unit_id"), F.inline(F.array(*cells)))
    return long.select("unit_id", "rater_id", R.label(F.col("num"), long.schema["num"].dataType).alias("code"), "num")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select([F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- SQL building blocks --------------------------------------------------

_NOM = """
base AS (SELECT CAST(d.doc_id AS VARCHAR) AS unit_id, quality, CAST(n_chars >= 500 AS INT) AS length, CAST(lang = 'en' AS INT) AS language
         FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
_MISS = """
base AS (SELECT CAST(d.doc_id AS VARCHAR) AS unit_id, quality, CAST(n_chars >= 500 AS INT) AS length,
                CASE WHEN n_chars < 3000 THEN CAST(lang = 'en' AS INT) END AS language
         FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_ORD = """
base AS (SELECT CAST(o_orderkey AS VARCHAR) AS unit_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_custkey % 5 + 1 AS customer,
                least(CAST(floor(o_totalprice / 50000) AS BIGINT) + 1, 5) AS price FROM orders)"""
_INT = """
base AS (SELECT l_orderkey || '-' || l_linenumber AS unit_id, q AS quantity, q + l_linenumber AS line, floor(q * (1 + t * 5)) AS mixed
         FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q, min(l_tax) AS t FROM lineitem GROUP BY ALL))"""


def _long_sql(base: str, names: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT unit_id, '{n}' AS rater_id, CAST(CAST({n} AS BIGINT) AS VARCHAR) AS code, CAST({n} AS DOUBLE) AS num FROM base" for n in names)
    return f"WITH {base}, r AS ({rows})"


_ALPHA_NOMINAL = """
 p AS (SELECT * FROM (SELECT *, count(code) OVER (PARTITION BY unit_id) AS m FROM r WHERE code IS NOT NULL) WHERE m >= 2),
 u AS (SELECT unit_id, any_value(m) AS m, sum(n * n) AS s2 FROM (SELECT unit_id, code, any_value(m) AS m, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1),
 o AS (SELECT sum(m) AS nn, sum((m * m - s2) / (m - 1)) AS do_ FROM u),
 e AS (SELECT sum(n * n) AS c2 FROM (SELECT count(*) AS n FROM p GROUP BY code)),
 alpha AS (SELECT 1 - do_ / ((nn * nn - c2) / (nn - 1)) AS alpha FROM o, e)"""
_ALPHA_INTERVAL = """
 p AS (SELECT unit_id, x - avg(x) OVER () AS x, m FROM (SELECT unit_id, {x} AS x, count(*) OVER (PARTITION BY unit_id) AS m FROM r)),
 u AS (SELECT any_value(m) AS m, sum(x) AS s, sum(x * x) AS q FROM p GROUP BY unit_id),
 alpha AS (SELECT 1 - sum(2 * (m * q - s * s) / (m - 1)) / (2 * (sum(m) * sum(q) - sum(s) * sum(s)) / (sum(m) - 1)) AS alpha FROM u)"""


def _agree(names: list[str], tolerance: float = 0) -> str:
    cols = ", ".join(names)
    return f"avg(CAST(greatest({cols}) - least({cols}) <= {tolerance} AS INT))"


def _corr(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


def _mean_corr(names: list[str]) -> str:
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return "(" + " + ".join(_corr(a, b) for a, b in pairs) + f") / {len(pairs)}"


def _ranks(names: list[str]) -> str:
    return ", ".join(f"rank() OVER (ORDER BY {n}) + (count(*) OVER (PARTITION BY {n}) - 1) / 2.0::DOUBLE AS r_{n}" for n in names)


def _icc(names: list[str]) -> str:
    m = len(names)
    row = "(" + " + ".join(names) + f") / {m}.0::DOUBLE"
    sq = " + ".join(f"pow({n} - g, 2)" for n in names)
    col = " + ".join(f"pow(avg({n}) - any_value(g), 2)" for n in names)
    return f"""
 g AS (SELECT avg({row}) AS g FROM base),
 s AS (SELECT count(*)::DOUBLE AS n, {m} * sum(pow({row} - g, 2)) AS ssr, sum({sq}) AS sst, count(*) * ({col}) AS ssc FROM base, g),
 v AS (SELECT n, ssr / (n - 1) AS msr, ssc / {m - 1} AS msc, (sst - ssr - ssc) / ((n - 1) * {m - 1}) AS mse FROM s),
 icc AS (SELECT (msr - mse) / (msr + {m - 1} * mse + {m} * (msc - mse) / n) AS icc FROM v)"""


_CONF = "c AS (SELECT {t} AS truth, {e} AS estimate, count(*) AS n FROM base GROUP BY 1, 2)"
_CLASSES = """
 k AS (SELECT truth AS class FROM c UNION SELECT estimate FROM c),
 b AS (SELECT class, coalesce((SELECT sum(n) FROM c WHERE truth = class), 0) AS n_truth, coalesce((SELECT sum(n) FROM c WHERE estimate = class), 0) AS n_estimate,
              coalesce((SELECT sum(n) FROM c WHERE truth = class AND estimate = class), 0) AS tp FROM k),
 f AS (SELECT *, CAST(tp AS DOUBLE) / nullif(n_estimate, 0) AS p, CAST(tp AS DOUBLE) / nullif(n_truth, 0) AS q FROM b),
 x AS (SELECT *, CASE WHEN p IS NULL OR q IS NULL THEN NULL WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END AS f1 FROM f)"""
#: Levels 1 to 5 spread the validation over several classes.
_VAL = "WITH " + _ORD + ", " + _CONF.format(t="CAST(priority AS VARCHAR)", e="CAST(customer AS VARCHAR)") + "," + _CLASSES


# ---- alignment and reshaping ----------------------------------------------

@_query(_long_sql(_MISS, NOMINAL) + """, one AS (SELECT unit_id FROM r GROUP BY unit_id HAVING count(code) = 3)
SELECT unit_id, quality, length, language FROM (SELECT unit_id, CAST(quality AS VARCHAR) AS quality, CAST(length AS VARCHAR) AS length, CAST(language AS VARCHAR) AS language FROM base) JOIN one USING (unit_id)""")
def align_units(spark, sf_dir):
    return R.ratings_wide(R.complete_cases(_coders(spark, sf_dir, "nominal", NOMINAL, False), 3), NOMINAL)


@_query(_long_sql(_MISS, NOMINAL) + " SELECT rater_id, code, count(*) AS n FROM r WHERE unit_id IN (SELECT unit_id FROM r GROUP BY 1 HAVING count(code) = 3) GROUP BY 1, 2")
def complete_cases(spark, sf_dir):
    return R.complete_cases(_coders(spark, sf_dir, "nominal", NOMINAL, False), 3).groupBy("rater_id", "code").agg(F.count("*").alias("n"))


@_query("WITH " + _MISS + " SELECT count(*) AS units, count(*) FILTER (quality IS NULL) AS missing_quality, count(*) FILTER (length IS NULL) AS missing_length, count(*) FILTER (language IS NULL) AS missing_language FROM base")
def missing_counts(spark, sf_dir):
    return R.missing_counts(_coders(spark, sf_dir, "nominal", NOMINAL, False), NOMINAL)


@_query(_long_sql(_MISS, NOMINAL) + " SELECT unit_id, rater_id, code FROM r WHERE code IS NOT NULL")
def ratings_long(spark, sf_dir):
    wide = R.ratings_wide(_coders(spark, sf_dir, "nominal", NOMINAL, False), NOMINAL)
    return R.first_codes(R.wide_to_long(wide, "unit_id", NOMINAL)).select("unit_id", "rater_id", "code")


@_query("WITH " + _MISS + " SELECT unit_id, CAST(quality AS VARCHAR) AS quality, CAST(length AS VARCHAR) AS length, CAST(language AS VARCHAR) AS language FROM base")
def ratings_wide(spark, sf_dir):
    return R.ratings_wide(_coders(spark, sf_dir, "nominal", NOMINAL, False), NOMINAL)


@_query(_long_sql(_MISS, NOMINAL) + " SELECT unit_id, rater_id, code FROM r WHERE unit_id IN (SELECT unit_id FROM r GROUP BY 1 HAVING count(code) >= 3)")
def min_coders_filter(spark, sf_dir):
    return R.min_coders(_coders(spark, sf_dir, "nominal", NOMINAL, False), 3).select("unit_id", "rater_id", "code")


@_query("WITH " + _ORD + " SELECT priority AS value, CAST(count(*) AS BIGINT) AS n, CAST(rank() OVER (ORDER BY priority) AS INT) AS level FROM base GROUP BY 1")
def level_encoding(spark, sf_dir):
    r = _coders(spark, sf_dir, "ordinal", ORDINAL[:1])
    return R.encoded(r).groupBy(F.col("code").cast("int").alias("value")).agg(F.count("*").alias("n"), F.min("num").cast("int").alias("level"))


# ---- agreement --------------------------------------------------------------

@_query("WITH " + _NOM + f" SELECT round({_agree(NOMINAL)}, 6) AS percent_agreement FROM base")
def percent_agreement_nominal(spark, sf_dir):
    return _rounded(reliability.percent_agreement(_coders(spark, sf_dir, "nominal", NOMINAL)))


@_query("WITH " + _ORD + f" SELECT round({_agree(ORDINAL, 1)}, 6) AS percent_agreement FROM base")
def percent_agreement_tolerance(spark, sf_dir):
    return _rounded(reliability.percent_agreement(_coders(spark, sf_dir, "ordinal", ORDINAL), 1, numeric=True))


_KAPPA = """ SELECT round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM (SELECT avg(CAST({a} = {b} AS INT)) AS po FROM base),
 (SELECT sum(na * nb) / pow(sum(na), 2) AS pe FROM (SELECT v, count(*) FILTER (who = 1) AS na, count(*) FILTER (who = 2) AS nb
  FROM (SELECT {a} AS v, 1 AS who FROM base UNION ALL SELECT {b}, 2 FROM base) GROUP BY v))"""


@_query("WITH " + _NOM + _KAPPA.format(a="quality", b="length"))
def cohen_kappa(spark, sf_dir):
    return _rounded(reliability.cohen_kappa(_coders(spark, sf_dir, "nominal", NOMINAL[:2]), *NOMINAL[:2]))


@_query(_long_sql(_NOM, NOMINAL) + """ SELECT round((p - pe) / (1 - pe), 6) AS kappa FROM
 (SELECT (sum(k * k) - count(DISTINCT unit_id) * 3) / (count(DISTINCT unit_id) * 6.0) AS p FROM (SELECT unit_id, code, count(*) AS k FROM r GROUP BY 1, 2)),
 (SELECT sum(k * k) / pow(sum(k), 2) AS pe FROM (SELECT count(*) AS k FROM r GROUP BY code))""")
def fleiss_kappa(spark, sf_dir):
    return _rounded(reliability.fleiss_kappa(_coders(spark, sf_dir, "nominal", NOMINAL), 3))


@_query("WITH " + _ORD + " SELECT round(1 - avg(pow(priority - customer, 2)) / (avg(priority * priority) + avg(customer * customer) - 2 * avg(priority) * avg(customer)), 6) AS kappa_weighted FROM base")
def weighted_kappa(spark, sf_dir):
    r = R.encoded(_coders(spark, sf_dir, "ordinal", ORDINAL[:2]))
    return _rounded(reliability.weighted_kappa(R.ratings_wide(r, ORDINAL[:2], "num"), *ORDINAL[:2]))


@_query(_long_sql(_MISS, NOMINAL) + "," + _ALPHA_NOMINAL + " SELECT round(alpha, 6) AS alpha_nominal FROM alpha")
def alpha_nominal(spark, sf_dir):
    return _rounded(reliability.alpha_nominal(_coders(spark, sf_dir, "nominal", NOMINAL, False)))


@_query(_long_sql(_ORD, ORDINAL) + "," + _ALPHA_INTERVAL.format(x="rank() OVER (ORDER BY num) - 1 + count(*) OVER (PARTITION BY num) / 2.0::DOUBLE") + " SELECT round(alpha, 6) AS alpha_ordinal FROM alpha")
def alpha_ordinal(spark, sf_dir):
    return _rounded(reliability.alpha_ordinal(R.encoded(_coders(spark, sf_dir, "ordinal", ORDINAL))))


@_query(_long_sql(_INT, INTERVAL) + "," + _ALPHA_INTERVAL.format(x="num") + " SELECT round(alpha, 6) AS alpha_interval FROM alpha")
def alpha_interval(spark, sf_dir):
    return _rounded(reliability.alpha_interval(_coders(spark, sf_dir, "interval", INTERVAL)))


@_query(_long_sql(_INT, INTERVAL) + """,
 v AS (SELECT num, count(*) AS k FROM r GROUP BY 1),
 de AS (SELECT sum(a.k * b.k * coalesce(pow((a.num - b.num) / nullif(a.num + b.num, 0), 2), 0)) / (any_value(t.n) - 1) AS de FROM v a, v b, (SELECT sum(k) AS n FROM v) t),
 do_ AS (SELECT sum(coalesce(pow((a.num - b.num) / nullif(a.num + b.num, 0), 2), 0)) / 2 AS do_ FROM r a JOIN r b USING (unit_id))
 SELECT round(1 - do_ / de, 6) AS alpha_ratio FROM de, do_""")
def alpha_ratio(spark, sf_dir):
    return _rounded(reliability.alpha_ratio(_coders(spark, sf_dir, "interval", INTERVAL)))


@_query("WITH " + _ORD + f", k AS (SELECT {_ranks(ORDINAL)} FROM base) SELECT round(12 * var_pop(r_priority + r_customer + r_price) * count(*) / (9 * (pow(count(*), 3) - count(*))), 6) AS w FROM k")
def kendall_w(spark, sf_dir):
    return _rounded(reliability.kendall_w(R.mid_ranks(_coders(spark, sf_dir, "ordinal", ORDINAL)), 3))


@_query("WITH " + _ORD + f", k AS (SELECT {_ranks(ORDINAL)} FROM base) SELECT round({_mean_corr(['r_' + x for x in ORDINAL])}, 6) AS rho FROM k")
def spearman_pairwise(spark, sf_dir):
    ranked = R.mid_ranks(_coders(spark, sf_dir, "ordinal", ORDINAL))
    return _rounded(reliability.mean_pairwise(R.ratings_wide(ranked, ORDINAL, "rank"), ORDINAL, "rho"))


@_query("WITH " + _INT + f" SELECT round({_mean_corr(INTERVAL)}, 6) AS r FROM base")
def pearson_pairwise(spark, sf_dir):
    return _rounded(reliability.mean_pairwise(R.ratings_wide(_coders(spark, sf_dir, "interval", INTERVAL), INTERVAL, "num"), INTERVAL, "r"))


@_query("WITH " + _INT + "," + _icc(INTERVAL) + " SELECT round(icc, 6) AS icc FROM icc")
def icc_a1(spark, sf_dir):
    return _rounded(reliability.icc_agreement(R.ratings_wide(_coders(spark, sf_dir, "interval", INTERVAL), INTERVAL, "num"), INTERVAL))


@_query(_long_sql(_NOM, NOMINAL[:2]) + "," + _ALPHA_NOMINAL + ", kap AS (" + _KAPPA.format(a="quality", b="length") + f""")
 SELECT 'nominal' AS level, count(*) AS subjects, 2 AS raters, 'Cohen''s' AS kappa_type, round(any_value(alpha), 6) AS alpha_nominal, any_value(kap.kappa) AS kappa, round({_agree(NOMINAL[:2])}, 6) AS percent_agreement FROM base, alpha, kap""")
def compare_nominal(spark, sf_dir):
    return _rounded(reliability.compare(_coders(spark, sf_dir, "nominal", NOMINAL[:2]), NOMINAL[:2], "nominal"))


@_query(_long_sql(_ORD, ORDINAL) + "," + _ALPHA_INTERVAL.format(x="rank() OVER (ORDER BY num) - 1 + count(*) OVER (PARTITION BY num) / 2.0::DOUBLE") + f""", k AS (SELECT {_ranks(ORDINAL)} FROM base)
 SELECT 'ordinal' AS level, (SELECT count(*) FROM base) AS subjects, 3 AS raters, round((SELECT alpha FROM alpha), 6) AS alpha_ordinal,
        round(12 * var_pop(r_priority + r_customer + r_price) * count(*) / (9 * (pow(count(*), 3) - count(*))), 6) AS w, round({_mean_corr(['r_' + x for x in ORDINAL])}, 6) AS rho,
        (SELECT round({_agree(ORDINAL)}, 6) FROM base) AS percent_agreement FROM k""")
def compare_ordinal(spark, sf_dir):
    return _rounded(reliability.compare(_coders(spark, sf_dir, "ordinal", ORDINAL), ORDINAL, "ordinal"))


@_query(_long_sql(_INT, INTERVAL) + "," + _ALPHA_INTERVAL.format(x="num") + "," + _icc(INTERVAL) + f"""
 SELECT 'interval' AS level, count(*) AS subjects, 3 AS raters, round((SELECT alpha FROM alpha), 6) AS alpha_interval, round((SELECT icc FROM icc), 6) AS icc, round({_mean_corr(INTERVAL)}, 6) AS r,
        round({_agree(INTERVAL)}, 6) AS percent_agreement FROM base""")
def compare_interval(spark, sf_dir):
    return _rounded(reliability.compare(_coders(spark, sf_dir, "interval", INTERVAL), INTERVAL, "interval"))


# ---- validation ---------------------------------------------------------------

def _pairs(spark, sf_dir):
    return validation.aligned(_coders(spark, sf_dir, "ordinal", ["customer", "priority"]), "customer", "priority")


@_query(_VAL + " SELECT t.class AS truth, e.class AS estimate, CAST(coalesce(n, 0) AS BIGINT) AS n FROM k t CROSS JOIN k e LEFT JOIN c ON c.truth = t.class AND c.estimate = e.class")
def confusion(spark, sf_dir):
    return validation.confusion_filled(validation.confusion(_pairs(spark, sf_dir)))


@_query("WITH " + _NOM + _KAPPA.format(a="quality", b="length").replace(" SELECT round(", " SELECT (SELECT count(*) FROM base) AS n, round(po, 6) AS accuracy, round(", 1))
def accuracy_kappa(spark, sf_dir):
    pairs = validation.aligned(_coders(spark, sf_dir, "nominal", NOMINAL[:2]), "length", "quality")
    return _rounded(validation.accuracy_kappa(validation.by_class(validation.confusion(pairs))))


@_query(_VAL + " SELECT round(avg(p), 6) AS precision, round(avg(q), 6) AS recall, round(avg(f1), 6) AS f1 FROM x")
def prf_macro(spark, sf_dir):
    return _rounded(validation.averaged(validation.by_class(validation.confusion(_pairs(spark, sf_dir))), "macro"))


@_query(_VAL + " SELECT round(sum(tp) / sum(n_truth), 6) AS precision, round(sum(tp) / sum(n_truth), 6) AS recall, round(sum(tp) / sum(n_truth), 6) AS f1 FROM x")
def prf_micro(spark, sf_dir):
    return _rounded(validation.averaged(validation.by_class(validation.confusion(_pairs(spark, sf_dir))), "micro"))


@_query(_VAL + " SELECT round(sum(p * n_truth) / sum(n_truth) FILTER (p IS NOT NULL), 6) AS precision, round(sum(q * n_truth) / sum(n_truth) FILTER (q IS NOT NULL), 6) AS recall, round(sum(f1 * n_truth) / sum(n_truth) FILTER (f1 IS NOT NULL), 6) AS f1 FROM x")
def prf_weighted(spark, sf_dir):
    return _rounded(validation.averaged(validation.by_class(validation.confusion(_pairs(spark, sf_dir))), "weighted"))


@_query(_VAL + " SELECT class, CAST(n_truth AS BIGINT) AS n_truth, CAST(n_estimate AS BIGINT) AS n_estimate, CAST(tp AS BIGINT) AS tp, round(p, 6) AS precision, round(q, 6) AS recall, round(f1, 6) AS f1 FROM x")
def by_class(spark, sf_dir):
    return _rounded(validation.by_class(validation.confusion(_pairs(spark, sf_dir))))


@_query("WITH " + _ORD + f""", k AS (SELECT priority, customer, {_ranks(["priority", "customer"])} FROM base), c AS (SELECT priority AS i, customer AS j, count(*)::DOUBLE AS n FROM base GROUP BY 1, 2),
 d AS (SELECT sum(a.n * b.n * sign(a.i - b.i) * sign(a.j - b.j)) AS s, sum(a.n * b.n * CAST(a.i <> b.i AS INT)) AS x, sum(a.n * b.n * CAST(a.j <> b.j AS INT)) AS y FROM c a, c b)
 SELECT count(*) AS n, round({_corr('r_priority', 'r_customer')}, 6) AS rho, round((SELECT s / sqrt(x * y) FROM d), 6) AS tau, round(avg(abs(priority - customer)), 6) AS mae FROM k""")
def ordinal_rho_tau_mae(spark, sf_dir):
    return _rounded(validation.ordinal_metrics(validation.confusion(_pairs(spark, sf_dir))))


@_query("WITH " + _INT + "," + _icc(["line", "quantity"]) + f" SELECT count(*) AS n, round({_corr('line', 'quantity')}, 6) AS r, round(avg(abs(line - quantity)), 6) AS mae, round(sqrt(avg(pow(line - quantity, 2))), 6) AS rmse, round((SELECT icc FROM icc), 6) AS icc FROM base")
def interval_r_icc_mae_rmse(spark, sf_dir):
    pairs = validation.aligned(_coders(spark, sf_dir, "interval", ["line", "quantity"]), "line", "quantity")
    return _rounded(validation.interval_metrics(pairs))


# ---- the older interface -------------------------------------------------------

_ICR_SQL = _long_sql(_MISS, NOMINAL) + """,
 q AS (SELECT * FROM r WHERE code IS NOT NULL AND unit_id IN (SELECT unit_id FROM r GROUP BY 1 HAVING count(code) >= 2)),""" + _ALPHA_NOMINAL.replace("FROM r ", "FROM q ") + """,
 pr AS (SELECT a.rater_id AS a, b.rater_id AS b, a.code AS x, b.code AS y FROM q a JOIN q b ON a.unit_id = b.unit_id AND a.rater_id < b.rater_id),
 po AS (SELECT a, b, count(*) AS n, avg(CAST(x = y AS INT)) AS po FROM pr GROUP BY 1, 2 HAVING count(*) >= 2),
 pe AS (SELECT a, b, sum(nx * ny) / pow(sum(nx), 2) AS pe FROM (SELECT a, b, c, count(*) FILTER (s = 1) AS nx, count(*) FILTER (s = 2) AS ny
        FROM (SELECT a, b, x AS c, 1 AS s FROM pr UNION ALL SELECT a, b, y, 2 FROM pr) GROUP BY 1, 2, 3) GROUP BY 1, 2),
 mp AS (SELECT avg(po) AS ag, avg((po - pe) / (1 - pe)) AS ka FROM po JOIN pe USING (a, b)),
 w AS (SELECT * FROM q WHERE unit_id IN (SELECT unit_id FROM q GROUP BY 1 HAVING count(*) = 3)),
 fl AS (SELECT (p - pe) / (1 - pe) AS fl FROM (SELECT (sum(k * k) - count(DISTINCT unit_id) * 3) / (count(DISTINCT unit_id) * 6.0) AS p FROM (SELECT unit_id, code, count(*) AS k FROM w GROUP BY 1, 2)),
        (SELECT sum(k * k) / pow(sum(k), 2) AS pe FROM (SELECT count(*) AS k FROM w GROUP BY code)))
 SELECT count(DISTINCT unit_id) AS units_included, count(DISTINCT rater_id) AS coders, count(DISTINCT code) AS categories,
  round((SELECT avg(CAST(s AS INT)) FROM (SELECT min(code) = max(code) AS s FROM q GROUP BY unit_id)), 4) AS percent_unanimous_units,
  round((SELECT ag FROM mp), 4) AS mean_pairwise_percent_agreement, round((SELECT ka FROM mp), 4) AS mean_pairwise_cohens_kappa,
  round((SELECT alpha FROM alpha), 4) AS kripp_alpha_nominal, round((SELECT fl FROM fl), 4) AS fleiss_kappa FROM q"""


@_query(_ICR_SQL)
def legacy_icr(spark, sf_dir):
    return legacy.icr(_coders(spark, sf_dir, "nominal", NOMINAL, False), NOMINAL, 2)


@_query(_long_sql(_MISS, NOMINAL) + """,
 g AS (SELECT r.rater_id AS coder_id, t.code AS t, r.code AS e FROM r JOIN r t ON r.unit_id = t.unit_id AND t.rater_id = 'quality' WHERE r.rater_id <> 'quality' AND r.code IS NOT NULL AND t.code IS NOT NULL),
 s AS (SELECT coder_id, c, sum(nt) AS nt, sum(ne) AS ne, sum(tp) AS tp FROM (SELECT coder_id, t AS c, 1 AS nt, 0 AS ne, CAST(t = e AS INT) AS tp FROM g UNION ALL SELECT coder_id, e, 0, 1, 0 FROM g) GROUP BY 1, 2),
 m AS (SELECT coder_id, nt, tp, tp / nullif(ne, 0) AS p, tp / nullif(nt, 0) AS q FROM s)
 SELECT coder_id, CAST(sum(nt) AS BIGINT) AS n, round(sum(tp) / sum(nt), 4) AS accuracy, round(avg(p), 4) AS precision_macro, round(avg(q), 4) AS recall_macro, round(avg(2 * p * q / nullif(p + q, 0)), 4) AS f1_macro FROM m GROUP BY coder_id""")
def legacy_gold(spark, sf_dir):
    return legacy.gold(_coders(spark, sf_dir, "nominal", NOMINAL, False), NOMINAL, "quality")


# ---- coding, lineage, corpus ------------------------------------------------------

@_query("SELECT CAST(doc_id AS VARCHAR) AS unit_id, CASE WHEN length(text) % 2 = 0 THEN 'pos' ELSE 'neg' END AS sentiment, CAST(least(length(text) // 500 + 1, 10) AS INT) AS rating FROM documents")
def rule_coding_struct(spark, sf_dir):
    size = F.length("content")
    rules = RuleBackend(sentiment=F.when(size % 2 == 0, "pos").otherwise("neg"), rating=F.least(F.floor(size / 500) + 1, F.lit(10)))
    return coding.code(texts(_table(spark, sf_dir, "documents")), cb.SENTIMENT, "rules/length", rules).df


_RUNS_SQL = "runs(name, parents) AS (SELECT CAST(conv_id AS VARCHAR) || '/' || turn, CASE WHEN turn > 0 THEN [CAST(conv_id AS VARCHAR) || '/' || (turn - 1)] ELSE [] END FROM conversations WHERE NOT (turn = 1))"


def _turns(spark, sf_dir):
    """Turns as runs, each the child of the turn before it; the second turns are lost."""
    c = _table(spark, sf_dir, "conversations").filter("turn <> 1")
    name = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    parents = F.when(F.col("turn") > 0, F.array(name(F.col("turn") - 1))).otherwise(F.array().cast("array<string>"))
    return c.select(name(F.col("turn")).alias("name"), parents.alias("parents"))


@_query("WITH " + _RUNS_SQL + ", e AS (SELECT name AS child, unnest(parents) AS parent FROM runs) SELECT child, parent FROM e WHERE parent NOT IN (SELECT name FROM runs)")
def trail_missing_parents(spark, sf_dir):
    return lineage.missing_parents(_turns(spark, sf_dir))


@_query("WITH RECURSIVE " + _RUNS_SQL + """, e AS (SELECT name AS child, p AS parent FROM (SELECT name, unnest(parents) AS p FROM runs) WHERE p IN (SELECT name FROM runs)),
 line(name, depth) AS (SELECT name, 0 FROM runs WHERE name NOT IN (SELECT child FROM e) UNION ALL SELECT e.child, depth + 1 FROM line JOIN e ON e.parent = line.name)
 SELECT name, max(depth) AS depth FROM line GROUP BY name""")
def trail_order(spark, sf_dir):
    return lineage.depths(_turns(spark, sf_dir))


@_query("""SELECT coalesce(CAST(o_orderstatus AS VARCHAR), 'Total') AS o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT", count(*) FILTER (o_orderpriority = '5-LOW') AS "5-LOW", count(*) AS total FROM orders GROUP BY ROLLUP (o_orderstatus)""")
def crosstab_totals(spark, sf_dir):
    return corpus.crosstab(_table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "5-LOW"])


@_query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 5")
def stratified_top_n(spark, sf_dir):
    return corpus.stratified(_table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], 5, F.col("doc_id"))


@_query("SELECT doc_id, source, n_chars FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)")
def corpus_dedup(spark, sf_dir):
    return corpus.distinct_texts(_table(spark, sf_dir, "documents")).select("doc_id", "source", "n_chars")


@_query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS position FROM documents")
def corpus_positions(spark, sf_dir):
    return corpus.sequence_ids(_table(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"]).select("doc_id", "position")
