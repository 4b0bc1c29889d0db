"""The registered queries, and the same in DuckDB's SQL. Sums of doubles are rounded, since engines add in different orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import numbers as M
from ..operators import cells as C
from ..operators import derive, evaluate, impute, multivariate, rank, refit, resolve, upsert
from ..session import settle
from ..sources import feeds, sinks
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _register(sql: str | None = None):
    def put(query: Query) -> Query:
        _queries[query.__name__] = query
        if sql:
            _sql[query.__name__] = sql
        return query

    return put


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# Cells

OBS = """obs AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS entity, p_brand AS metric, l_returnflag AS source, CAST(ascii(l_returnflag) AS BIGINT) AS ord, avg(l_quantity) AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE (l_suppkey * 7 + CAST(substr(p_brand, 7) AS INT) * 13) % 5 NOT IN (0, 1)
  GROUP BY l_suppkey, p_brand, l_returnflag
)"""
CELLS = OBS + """, cells AS (
  SELECT entity, metric, count(*) AS n, CASE WHEN count(*) > 1 THEN avg(coalesce(score, 0)) ELSE max(score) END AS score,
    CASE WHEN count(*) > 1 THEN stddev_samp(coalesce(score, 0)) ELSE 0 END AS std_dev
  FROM obs GROUP BY entity, metric
)"""
GRID = CELLS + """, grid AS (
  SELECT e.entity, m.metric, c.score, coalesce(c.std_dev, 0) AS std_dev, c.score IS NOT NULL AS is_known
  FROM (SELECT DISTINCT entity FROM cells) e CROSS JOIN (SELECT DISTINCT metric FROM cells) m LEFT JOIN cells c ON c.entity = e.entity AND c.metric = m.metric
)"""
MEANS = GRID + ", means AS (SELECT metric, coalesce(avg(score), 0) AS mean FROM grid GROUP BY metric)"
ENTITIES = """ent AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS entity, n_name AS company, s_name AS url, d.release_date, a.input, a.output, CAST(s_suppkey AS BIGINT) AS ord
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  LEFT JOIN (SELECT l_suppkey, CAST(min(o_orderdate) AS DATE) AS release_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey) d ON s_suppkey = d.l_suppkey
  LEFT JOIN (SELECT l_suppkey, list_sort(list(DISTINCT p_type)) AS input, list_sort(list(DISTINCT l_returnflag)) AS output
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49 AND l_linenumber <= 2 GROUP BY l_suppkey) a ON s_suppkey = a.l_suppkey
)"""


def _pairs(cells: str, name: str, by: str = "") -> str:
    """CTE of pair regressions over the known cells of a CTE; by: a further key column with a comma after it."""
    on = "".join(f" AND k.{c.strip()} = j.{c.strip()}" for c in by.split(",") if c.strip())
    key = "".join(f"k.{c.strip()}, " for c in by.split(",") if c.strip())
    return f"""{name}_m AS (
  SELECT {key}k.metric AS bk, j.metric AS bj, count(*) AS n, avg(k.score) AS mk, avg(j.score) AS mj
  FROM {cells} k JOIN {cells} j ON k.entity = j.entity AND k.metric <> j.metric{on}
  WHERE k.score IS NOT NULL AND j.score IS NOT NULL GROUP BY {key}k.metric, j.metric
), {name}_s AS (
  SELECT {key.replace('k.', 'm.')}m.bk, m.bj, any_value(m.n) AS n, any_value(m.mk) AS mk, any_value(m.mj) AS mj,
    sum((j.score - m.mj) * (k.score - m.mk)) AS sxy, sum((j.score - m.mj) * (j.score - m.mj)) AS sxx
  FROM {cells} k JOIN {cells} j ON k.entity = j.entity AND k.metric <> j.metric{on}
  JOIN {name}_m m ON m.bk = k.metric AND m.bj = j.metric{on.replace('j.', 'm.')}
  WHERE k.score IS NOT NULL AND j.score IS NOT NULL GROUP BY {key.replace('k.', 'm.')}m.bk, m.bj
), {name} AS (
  SELECT {by}bk, bj, n, CASE WHEN sxx = 0 THEN 0 ELSE sxy / sxx END AS a, mk - (CASE WHEN sxx = 0 THEN 0 ELSE sxy / sxx END) * mj AS b FROM {name}_s
)"""


def _bivariate(cells: str, name: str, by: str = "", open_cells: str = "score IS NULL") -> str:
    """CTEs of one pass of weighed bivariate regression over a CTE; the last is `name`."""
    keys = [c.strip() for c in by.split(",") if c.strip()]
    on = lambda a, b: "".join(f" AND {a}.{c} = {b}.{c}" for c in keys)
    key = lambda a: "".join(f"{a}.{c}, " for c in keys)
    return f"""{_pairs(cells, name + '_p', by)}, {name}_l AS (SELECT * FROM {name}_p WHERE a <> 0), {name}_g AS (
  SELECT {key('o')}o.entity, p.bk, p.bj, j.score AS x, p.a * j.score + p.b AS p
  FROM (SELECT * FROM {cells} WHERE {open_cells}) o JOIN {cells} j ON o.entity = j.entity AND j.score IS NOT NULL{on('o', 'j')}
  JOIN {name}_l p ON p.bk = o.metric AND p.bj = j.metric{on('o', 'p')}
), {name}_x AS (
  SELECT {by}entity, metric AS bj, score AS x FROM {cells} WHERE score IS NOT NULL
  UNION ALL SELECT {key('g')}g.entity, g.bk, avg(g.p) FROM {name}_g g JOIN {cells} c ON c.entity = g.entity AND c.metric = g.bk AND c.score IS NULL{on('g', 'c')} GROUP BY {key('g')}g.entity, g.bk
), {name}_r AS (
  SELECT {key('k')}l.bk, l.bj, k.score AS s, x.x, l.a, l.b FROM {cells} k JOIN {name}_x x ON x.entity = k.entity{on('k', 'x')}
  JOIN {name}_l l ON l.bk = k.metric AND l.bj = x.bj{on('k', 'l')} WHERE k.score IS NOT NULL
), {name}_rm AS (
  SELECT {by}bk, bj, count(*) AS n, avg(x) AS mean_x, sum((s - a * x - b) * (s - a * x - b)) / greatest(count(*) - 2, 1) AS mse FROM {name}_r GROUP BY {by}bk, bj
), {name}_e AS (
  SELECT {key('r')}r.bk, r.bj, any_value(m.n) AS n, any_value(m.mean_x) AS mean_x, any_value(m.mse) AS mse, sum((r.x - m.mean_x) * (r.x - m.mean_x)) AS ss_x
  FROM {name}_r r JOIN {name}_rm m ON m.bk = r.bk AND m.bj = r.bj{on('r', 'm')} GROUP BY {key('r')}r.bk, r.bj
), {name}_v AS (
  SELECT {key('g')}g.entity, g.bk, g.p, CASE WHEN e.ss_x = 0 THEN e.mse ELSE e.mse * (1 + CAST(1 AS DOUBLE) / e.n + (g.x - e.mean_x) * (g.x - e.mean_x) / e.ss_x) END AS v
  FROM {name}_g g JOIN {name}_e e ON e.bk = g.bk AND e.bj = g.bj{on('g', 'e')} WHERE e.n > 2
), {name}_w AS (
  SELECT {by}entity, bk AS metric, sum(1 / (v + 1e-15)) AS sw, sum(1 / ((v + 1e-15) * (v + 1e-15))) AS sww, sum(p / (v + 1e-15)) AS swp, sum(v / ((v + 1e-15) * (v + 1e-15))) AS swwv
  FROM {name}_v GROUP BY {by}entity, bk
), {name}_mean AS (
  SELECT {by}metric, coalesce(avg(score), 0) AS mean FROM {cells} GROUP BY {by}metric
), {name} AS (
  SELECT {key('c')}c.entity, c.metric, CASE WHEN {open_cells.replace('score', 'c.score').replace('is_known', 'c.is_known')} THEN coalesce(w.swp / w.sw, m.mean) ELSE c.score END AS score,
    CASE WHEN {open_cells.replace('score', 'c.score').replace('is_known', 'c.is_known')} THEN coalesce(sqrt(greatest(0, (w.swwv + w.sw * w.sw - w.sww) / (w.sw * w.sw))), abs(m.mean)) ELSE c.std_dev END AS std_dev, c.is_known
  FROM {cells} c LEFT JOIN {name}_w w ON w.entity = c.entity AND w.metric = c.metric{on('c', 'w')} JOIN {name}_mean m ON m.metric = c.metric{on('c', 'm')}
)"""


_NUMBER = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


@_register(f"WITH {CELLS} SELECT entity, metric, n, round(score, 6) AS score, round(std_dev, 6) AS std_dev FROM cells")
def cell_merge(spark, sf):
    out = C.merge_cells(X.observations(spark, sf))
    return out.select("entity", "metric", "n", _r("score"), _r("std_dev"))


@_register(f"""WITH {OBS} SELECT entity, metric, CASE WHEN count(*) > 1 THEN 'Multiple: ' || string_agg('Score ' || {_NUMBER.format('round(score, 4)')} || ' at ' || source, '; ' ORDER BY ord)
  ELSE coalesce(nullif(any_value(source), ''), 'Original') END AS source FROM obs GROUP BY entity, metric""")
def cell_provenance(spark, sf):
    obs = X.observations(spark, sf).withColumn("score", F.round("score", 4))
    return C.merge_cells(obs).select("entity", "metric", "source")


@_register(f"WITH {OBS} SELECT metric, count(*) AS n FROM obs WHERE metric <> '' GROUP BY metric")
def metric_counts(spark, sf):
    return C.metric_counts(X.observations(spark, sf))


@_register(f"WITH {OBS} SELECT DISTINCT metric FROM obs")
def metric_distinct(spark, sf):
    return C.metric_names(X.observations(spark, sf))


@_register(f"WITH {OBS} SELECT metric, count(*) AS n, round(avg(score), 6) AS mean, round(CASE WHEN stddev_pop(score) = 0 THEN 1 ELSE stddev_pop(score) END, 6) AS std_dev FROM obs GROUP BY metric")
def metric_stats_pop(spark, sf):
    return C.raw_stats(X.observations(spark, sf)).select("metric", "n", _r("mean"), _r("std_dev"))


@_register(f"WITH {MEANS} SELECT metric, round(mean, 6) AS mean FROM means")
def metric_mean(spark, sf):
    return C.metric_means(X.grid(spark, sf)).select("metric", _r("mean"))


@_register(f"WITH {CELLS} SELECT metric, count(score) AS n, round(coalesce(avg(score), 0), 6) AS mean, round(coalesce(stddev_pop(score), 1), 6) AS std_dev FROM cells GROUP BY metric")
def cell_stats(spark, sf):
    return C.cell_stats(X.cells(spark, sf)).select("metric", "n", _r("mean"), _r("std_dev"))


@_register(f"WITH {OBS} SELECT entity, metric, round(max_by(score, ord), 6) AS score, max_by(source, ord) AS source FROM obs GROUP BY entity, metric")
def last_observation(spark, sf):
    return C.last_by_name(X.observations(spark, sf)).select("entity", "metric", _r("score"), "source")


@_register(f"WITH {GRID} SELECT entity, metric, round(score, 6) AS score, round(std_dev, 6) AS std_dev, is_known FROM grid")
def densify(spark, sf):
    return X.grid(spark, sf).select("entity", "metric", _r("score"), _r("std_dev"), "is_known")


# Imputers


def _filled(df: DataFrame) -> DataFrame:
    return df.select("entity", "metric", _r("score"), _r("std_dev"), "is_known")


@_register(f"""WITH {MEANS} SELECT g.entity, g.metric, round(coalesce(g.score, m.mean), 6) AS score, round(CASE WHEN g.score IS NULL THEN abs(m.mean) ELSE g.std_dev END, 6) AS std_dev, is_known
  FROM grid g JOIN means m ON g.metric = m.metric""")
def impute_mean(spark, sf):
    return _filled(impute.impute_mean(X.grid(spark, sf)))


@_register(f"WITH {GRID}, {_pairs('grid', 'pairs')} SELECT bk, bj, n, round(a, 6) AS a, round(b, 6) AS b FROM pairs")
def pair_regression(spark, sf):
    return impute.pair_regression(X.grid(spark, sf)).select("bk", "bj", "n", _r("a"), _r("b"))


@_register(f"WITH {GRID}, {_bivariate('grid', 'f')} SELECT bk, bj, n, round(mean_x, 6) AS mean_x, round(ss_x, 4) AS ss_x, round(mse, 4) AS mse FROM f_e")
def pair_error_stats(spark, sf):
    grid = X.grid(spark, sf)
    out = impute.pair_errors(grid, impute.pair_regression(grid).where("a <> 0"))
    return out.select("bk", "bj", "n", _r("mean_x"), _r("ss_x", 4), _r("mse", 4))


@_register(f"WITH {GRID}, {_bivariate('grid', 'f')} SELECT entity, metric, round(score, 6) AS score, round(std_dev, 6) AS std_dev, is_known FROM f")
def impute_bivariate(spark, sf):
    return _filled(impute.impute_bivariate(X.grid(spark, sf)))


@_register(f"WITH {GRID}, {_bivariate('grid', 'f')} SELECT metric, count(*) AS n, round(avg(std_dev * std_dev), 6) AS variance, round(max(std_dev * std_dev), 6) AS most FROM f WHERE NOT is_known GROUP BY metric")
def impute_bivariate_variance(spark, sf):
    out = impute.impute_bivariate(X.grid(spark, sf)).where("not is_known").withColumn("v", F.col("std_dev") * F.col("std_dev"))
    return out.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("variance"), F.round(F.max("v"), 6).alias("most"))


@_register(f"WITH {GRID}, {_bivariate('grid', 'f')}, {_bivariate('f', 'h', '', 'NOT is_known')} SELECT entity, metric, round(score, 6) AS score, round(std_dev, 6) AS std_dev, is_known FROM h")
def impute_bivariate_2iter(spark, sf):
    return _filled(impute.impute_bivariate(X.grid(spark, sf), 2))


_CONSOLIDATED = f"""{MEANS}, {_pairs('grid', 'pairs')}, shifts AS (
  SELECT o.entity, o.metric, sum((coalesce(p.a, 0) + coalesce(q.a, 0)) * (j.score - m.mean)) / sum(1 + coalesce(q.a, 0) * coalesce(q.a, 0)) AS shift
  FROM grid o JOIN grid j ON o.entity = j.entity AND j.score IS NOT NULL JOIN means m ON m.metric = j.metric
  LEFT JOIN pairs p ON p.bk = o.metric AND p.bj = j.metric LEFT JOIN pairs q ON q.bk = j.metric AND q.bj = o.metric
  WHERE o.score IS NULL GROUP BY o.entity, o.metric
), filled AS (
  SELECT g.entity, g.metric, coalesce(g.score, m.mean + coalesce(s.shift, 0)) AS score, CASE WHEN g.score IS NULL THEN 0 ELSE g.std_dev END AS std_dev, is_known
  FROM grid g JOIN means m ON m.metric = g.metric LEFT JOIN shifts s ON s.entity = g.entity AND s.metric = g.metric
)"""


@_register(f"WITH {_CONSOLIDATED} SELECT entity, metric, round(score, 6) AS score, round(std_dev, 6) AS std_dev, is_known FROM filled")
def impute_consolidated(spark, sf):
    return _filled(impute.impute_consolidated(X.grid(spark, sf)))


@_register(f"""WITH {_CONSOLIDATED}, x AS (SELECT entity, metric, score FROM filled UNION ALL SELECT DISTINCT entity, '', 1 FROM filled)
  SELECT a.metric AS i, b.metric AS j, round(sum(a.score * b.score), 4) AS g FROM x a JOIN x b ON a.entity = b.entity AND a.metric >= b.metric GROUP BY a.metric, b.metric""")
def gram_matrix(spark, sf):
    return multivariate.gram_matrix(impute.impute_consolidated(X.grid(spark, sf))).select("i", "j", _r("g", 4))


def _multivariate(cells: str, name: str) -> str:
    """CTEs of one pass of least squares of every metric on all others over a CTE, for missing cells; the last is `name`. The Gram matrix
    (metrics, and a constant) is inverted by sweeping one row after the other, so it must have full rank; WITH must be RECURSIVE."""
    at = "k + 1"
    return f"""{name}_x AS (SELECT entity, metric AS m, score FROM {cells} UNION ALL SELECT DISTINCT entity, '~', CAST(1 AS DOUBLE) FROM {cells}
), {name}_i AS (SELECT m, row_number() OVER (ORDER BY m) AS i FROM (SELECT DISTINCT m FROM {name}_x)
), {name}_v AS (SELECT x.entity, i.i, x.score FROM {name}_x x JOIN {name}_i i ON i.m = x.m
), {name}_n AS (SELECT count(*) AS size, (SELECT count(DISTINCT entity) FROM {cells}) - count(*) + 1 AS free FROM {name}_i
), {name}_g AS (SELECT a.i, b.i AS j, sum(a.score * b.score) AS g FROM {name}_v a JOIN {name}_v b ON a.entity = b.entity GROUP BY a.i, b.i
), {name}_s AS (
  SELECT CAST(0 AS BIGINT) AS k, i, j, g FROM {name}_g
  UNION ALL SELECT {at}, i, j, CASE WHEN i = {at} AND j = {at} THEN -1 / p WHEN i = {at} THEN c / p WHEN j = {at} THEN r / p ELSE g - r * c / p END
  FROM (SELECT k, i, j, g, max(CASE WHEN i = {at} THEN g END) OVER (PARTITION BY j) AS c, max(CASE WHEN j = {at} THEN g END) OVER (PARTITION BY i) AS r, max(CASE WHEN i = {at} AND j = {at} THEN g END) OVER () AS p FROM {name}_s WHERE k < (SELECT size FROM {name}_n))
), {name}_p AS (SELECT i, j, -g AS p FROM {name}_s WHERE k = (SELECT size FROM {name}_n)
), {name}_y AS (SELECT v.entity, p.j AS i, sum(v.score * p.p) AS y FROM {name}_v v JOIN {name}_p p ON p.i = v.i GROUP BY v.entity, p.j
), {name}_w AS (SELECT v.entity, sum(v.score * y.y) AS whole FROM {name}_v v JOIN {name}_y y ON y.entity = v.entity AND y.i = v.i GROUP BY v.entity
), {name}_e AS (
  SELECT v.entity, i.m AS metric, -(y.y - v.score * d.p) / d.p AS guess,
    sqrt(1 / d.p / n.free * (1 + greatest(0, w.whole - 2 * v.score * y.y + v.score * v.score * d.p - (y.y - v.score * d.p) * (y.y - v.score * d.p) / d.p))) AS guess_sd
  FROM {name}_v v JOIN {name}_i i ON i.i = v.i JOIN {name}_y y ON y.entity = v.entity AND y.i = v.i JOIN {name}_w w ON w.entity = v.entity JOIN {name}_p d ON d.i = v.i AND d.j = v.i CROSS JOIN {name}_n n
), {name} AS (
  SELECT c.entity, c.metric, CASE WHEN is_known THEN score ELSE guess END AS score, CASE WHEN is_known THEN std_dev ELSE guess_sd END AS std_dev, is_known
  FROM {cells} c JOIN {name}_e e ON e.entity = c.entity AND e.metric = c.metric
)"""


#: Needs more entities than metrics, as from sf0.01 on.
@_register(f"WITH RECURSIVE {GRID}, {_bivariate('grid', 'f')}, {_multivariate('f', 'm1')}, {_multivariate('m1', 'm2')} SELECT entity, metric, round(score, 6) AS score, round(std_dev, 6) AS std_dev, is_known FROM m2")
def impute_multivariate(spark, sf):
    return _filled(multivariate.impute_multivariate(X.grid(spark, sf), 2))


@_register()
def impute_multivariate_gd(spark, sf):
    return _filled(multivariate.impute_multivariate_gd(X.grid(spark, sf), 100))


@_register()
def impute_consolidated_gd(spark, sf):
    return _filled(multivariate.impute_consolidated_gd(X.grid(spark, sf), 10_000))


# Rankings

_CRITERIA = "criteria(metric_name, bench, weight) AS (VALUES " + ", ".join(f"('{n}', '{b}', CAST({w} AS DOUBLE))" for n, b, w in X.CRITERIA) + ")"
COMPOSITE = f"""{CELLS}, {_CRITERIA}, stats AS (SELECT metric, coalesce(avg(score), 0) AS mean, coalesce(stddev_pop(score), 1) AS sd FROM cells GROUP BY metric), sums AS (
  SELECT metric_name, entity, sum(weight * (CASE WHEN sd = 0 THEN score ELSE (score - mean) / sd END)) AS top, sum(weight) AS below
  FROM cells JOIN criteria ON bench = cells.metric JOIN stats ON stats.metric = cells.metric WHERE score IS NOT NULL GROUP BY metric_name, entity
), composites AS (
  SELECT n.metric_name, e.entity, round(coalesce(CASE WHEN below = 0 THEN 0 ELSE top / below END, 0), 6) AS composite
  FROM (SELECT DISTINCT entity FROM cells) e CROSS JOIN (SELECT DISTINCT metric_name FROM criteria) n LEFT JOIN sums s ON s.entity = e.entity AND s.metric_name = n.metric_name
), balanced AS (SELECT entity, composite FROM composites WHERE metric_name = 'balanced')"""


def _balanced(spark, sf) -> DataFrame:
    criteria = X.criteria(spark).where("metric_name = 'balanced'")
    return rank.composite_scores(X.cells(spark, sf), criteria).select("entity", _r("composite"))


@_register(f"WITH {COMPOSITE} SELECT * FROM composites")
def composite_score(spark, sf):
    return rank.composite_scores(X.cells(spark, sf), X.criteria(spark)).select("metric_name", "entity", _r("composite"))


@_register(f"WITH {COMPOSITE} SELECT entity, composite, row_number() OVER (ORDER BY composite DESC, entity) AS rank FROM balanced")
def ranking_table(spark, sf):
    return rank.ranking(_balanced(spark, sf))


@_register(f"WITH {COMPOSITE} SELECT entity, composite, row_number() OVER (ORDER BY composite DESC, entity) AS rank FROM balanced WHERE entity IN (SELECT entity FROM cells WHERE metric = 'Brand#4' AND score < 25)")
def ranking_filtered(spark, sf):
    return rank.ranking(_balanced(spark, sf).join(rank.passing(X.cells(spark, sf), "Brand#4", 25.0), "entity", "left_semi"))


@_register(f"WITH {CELLS} SELECT DISTINCT entity FROM cells WHERE metric = 'Brand#4' AND score > 26")
def threshold_filter(spark, sf):
    return rank.passing(X.cells(spark, sf), "Brand#4", 26.0, below=False)


@_register(f"WITH {COMPOSITE} SELECT c.entity, round(c.score, 6) AS x, b.composite AS y FROM cells c JOIN balanced b ON b.entity = c.entity WHERE metric = 'Brand#5'")
def chart_points(spark, sf):
    return rank.chart_points(X.cells(spark, sf), _balanced(spark, sf), "Brand#5").select("entity", _r("x"), "y")


@_register(f"WITH {COMPOSITE}, {ENTITIES} SELECT DISTINCT company FROM cells c JOIN balanced b ON b.entity = c.entity JOIN ent e ON e.entity = c.entity WHERE metric = 'Brand#5'")
def plottable_companies(spark, sf):
    points = rank.chart_points(X.cells(spark, sf), _balanced(spark, sf), "Brand#5")
    return rank.plottable_companies(points, X.entities(spark, sf))


@_register(f"WITH {COMPOSITE}, {ENTITIES}, best AS (SELECT company, max(composite) AS best FROM balanced b JOIN ent e ON e.entity = b.entity GROUP BY company) SELECT company, best, row_number() OVER (ORDER BY best DESC, company) - 1 AS index FROM best")
def company_best(spark, sf):
    return rank.company_best(_balanced(spark, sf), X.entities(spark, sf))


@_register(f"""WITH {COMPOSITE}, {ENTITIES}, timed AS (
  SELECT company, b.entity, release_date, composite, max(composite) OVER (PARTITION BY company ORDER BY release_date, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM balanced b JOIN ent e ON e.entity = b.entity WHERE release_date IS NOT NULL)
  SELECT company, entity, release_date, composite FROM timed WHERE before IS NULL OR composite > before""")
def running_best(spark, sf):
    return rank.running_best(_balanced(spark, sf), X.entities(spark, sf))


@_register(f"WITH {CELLS} SELECT e.entity, round(coalesce(c.score, 0), 6) AS score FROM (SELECT DISTINCT entity FROM cells) e LEFT JOIN cells c ON c.entity = e.entity AND c.metric = 'Brand#7'")
def ranking_by_metric(spark, sf):
    return rank.by_metric(X.cells(spark, sf), "Brand#7").select("entity", _r("score"))


def _composite(cells: str) -> str:
    """CTEs up to the balanced composite over a CTE of cells."""
    return COMPOSITE[len(CELLS) :].replace("FROM cells", f"FROM {cells}").replace("cells.metric", f"{cells}.metric")


@_register(f"WITH {GRID}, {_bivariate('grid', 'f')}{_composite('f')} SELECT entity, composite, row_number() OVER (ORDER BY composite DESC, entity) AS rank FROM balanced")
def ranking_imputed(spark, sf):
    """A ranking with every cell filled: z-scores are over imputed cells, too."""
    criteria = X.criteria(spark).where("metric_name = 'balanced'")
    filled = impute.impute_bivariate(X.grid(spark, sf))
    return rank.ranking(rank.composite_scores(filled, criteria).select("entity", _r("composite")))


@_register("SELECT CAST(s_suppkey AS VARCHAR) AS entity, row_number() OVER (ORDER BY CAST(s_suppkey AS VARCHAR)) AS place FROM supplier")
def entity_order(spark, sf):
    names = X.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("entity"))
    return rank.name_places(names)


@_register(f"""WITH {COMPOSITE}, {ENTITIES}, points AS (SELECT c.entity, e.company FROM cells c JOIN balanced b ON b.entity = c.entity JOIN ent e ON e.entity = c.entity WHERE metric = 'Brand#5')
  SELECT entity, company, 'others hidden' AS shown FROM points WHERE company NOT IN ('NATION_1', 'NATION_2', 'NATION_3') UNION ALL SELECT entity, company, 'alone' FROM points WHERE company = 'NATION_4'""")
def company_visibility(spark, sf):
    points = rank.chart_points(X.cells(spark, sf), _balanced(spark, sf), "Brand#5").join(X.entities(spark, sf).select("entity", "company"), "entity").select("entity", "company")
    some, one = rank.visible(points, hidden=["NATION_1", "NATION_2", "NATION_3"]), rank.visible(points, isolated="NATION_4")
    return some.withColumn("shown", F.lit("others hidden")).unionByName(one.withColumn("shown", F.lit("alone")))


@_register(f"""WITH {CELLS}, r AS (SELECT entity, metric, round(score, 6) AS score, round(std_dev, 6) AS std_dev FROM cells), told AS (
  SELECT entity, metric, CAST(CAST(trunc(score) AS BIGINT) AS VARCHAR) || CASE WHEN std_dev <> 0 THEN '±' || CAST(CAST(round(2 * std_dev) AS BIGINT) AS VARCHAR) ELSE '' END AS text FROM r WHERE metric IN ('Brand#7', 'Brand#8'))
  SELECT rpad(entity, 12, ' ') || ' ' || rpad(coalesce(max(text) FILTER (WHERE metric = 'Brand#7'), ''), 12, ' ') || ' ' || rpad(coalesce(max(text) FILTER (WHERE metric = 'Brand#8'), ''), 12, ' ') AS line FROM told GROUP BY entity""")
def text_table(spark, sf):
    return rank.text_table(X.cells(spark, sf).select("entity", "metric", _r("score"), _r("std_dev")), ["Brand#7", "Brand#8"])


_LN = "ln(1 - CAST(0.99 AS DOUBLE) * CAST(0.99 AS DOUBLE))"
_T = f"(2 / (3.141592653589793 * CAST(0.147 AS DOUBLE)) + {_LN} / 2)"
_ERF = f"sqrt(sqrt({_T} * {_T} - {_LN} / CAST(0.147 AS DOUBLE)) - {_T})"


def _two(x: str) -> str:
    return _NUMBER.format(f"(floor(({x}) * 100 + 0.5) / 100)")


@_register(f"WITH {CELLS} SELECT entity, metric, round(std_dev * sqrt(2) * {_ERF}, 6) AS interval FROM cells")
def ci99_interval(spark, sf):
    return X.cells(spark, sf).select("entity", "metric", F.round(M.confidence_interval(F.col("std_dev")), 6).alias("interval"))


@_register(f"WITH {CELLS}, r AS (SELECT entity, metric, round(score, 6) AS score, round(std_dev, 6) AS std_dev FROM cells) SELECT entity, metric, {_two('score')} || CASE WHEN std_dev > 0 THEN ' ±' || {_two(f'std_dev * sqrt(2) * {_ERF}')} ELSE '' END AS text FROM r")
def ci99_format(spark, sf):
    return rank.table_texts(X.cells(spark, sf).select("entity", "metric", _r("score"), _r("std_dev")))


# Derivations

_RENAMED = OBS + ", named AS (SELECT entity, CASE metric " + " ".join(f"WHEN '{b}' THEN '{m}'" for b, m in X.BRANDS.items()) + " ELSE metric END AS metric, source, ord, score FROM obs)"


def _firsts(**metrics: str) -> str:
    names = ", ".join(f"'{m}'" for m in metrics.values())
    return "firsts AS (SELECT entity, " + ", ".join(f"arg_min(score, ord) FILTER (WHERE metric = '{m}') AS {k}" for k, m in metrics.items()) + f" FROM named WHERE metric IN ({names}) GROUP BY entity)"


def _derived(df: DataFrame) -> DataFrame:
    return df.select("entity", "metric", _r("score"), "source")


_YEAR = "year(release_date) + CAST(date_diff('day', make_date(year(release_date), 1, 1), release_date) AS DOUBLE) / date_diff('day', make_date(year(release_date), 1, 1), make_date(year(release_date) + 1, 1, 1))"


@_register(f"WITH {ENTITIES} SELECT entity, 'Release date' AS metric, round({_YEAR}, 6) AS score, url AS source FROM ent")
def derive_release_year(spark, sf):
    return _derived(derive.release_dates(X.entities(spark, sf)))


@_register(f"""WITH {_RENAMED}, {ENTITIES}, {_firsts(size=derive.SIZE)} SELECT e.entity, '{derive.RELEASE_SIZE}' AS metric, round(({_YEAR}) * ln(size), 6) AS score, 'Calculated from Release date and Size' AS source
  FROM ent e JOIN firsts f ON f.entity = e.entity WHERE size IS NOT NULL AND release_date IS NOT NULL""")
def derive_date_size(spark, sf):
    obs = X.renamed(spark, sf).unionByName(derive.release_dates(X.entities(spark, sf)))
    return _derived(derive.release_by_size(obs))


_RULES = "rules(metric, random_score, need_input, need_output) AS (VALUES " + ", ".join(f"('{m}', CAST({s} AS DOUBLE), CAST({i!r} AS VARCHAR[]), CAST({o!r} AS VARCHAR[]))" for m, s, i, o in X.REQUIREMENTS) + ")"
_GAPS = f"""{ENTITIES}, {_RULES}, gaps AS (
  SELECT entity, metric, random_score, list_concat(list_transform(list_filter(need_input, lambda x: NOT list_contains(input, x)), lambda x: 'input:' || x), list_transform(list_filter(need_output, lambda x: NOT list_contains(output, x)), lambda x: 'output:' || x)) AS missing
  FROM ent CROSS JOIN rules WHERE input IS NOT NULL)"""


@_register(f"WITH {_GAPS} SELECT entity, metric, array_to_string(missing, ', ') AS missing FROM gaps WHERE len(missing) > 0")
def capability_missing(spark, sf):
    out = derive.capability_gaps(X.entities(spark, sf), X.requirements(spark))
    return out.select("entity", "metric", F.concat_ws(", ", "missing").alias("missing"))


@_register(f"""WITH {OBS}, {_GAPS}, every AS (SELECT entity, metric, score FROM obs UNION ALL SELECT entity, metric, random_score FROM gaps WHERE len(missing) > 0)
  SELECT entity, metric, count(*) AS n, round(CASE WHEN count(*) > 1 THEN avg(score) ELSE max(score) END, 6) AS score FROM every GROUP BY entity, metric""")
def capability_floor(spark, sf):
    obs = X.observations(spark, sf)
    out = C.merge_cells(obs.unionByName(derive.capability_floor(X.entities(spark, sf), X.requirements(spark))))
    return out.select("entity", "metric", "n", _r("score"))


@_register(f"""WITH {OBS}, {_GAPS}, floors AS (SELECT entity, metric, random_score FROM gaps WHERE len(missing) > 0), every AS (
  SELECT entity, metric, score FROM obs o WHERE NOT EXISTS (SELECT 1 FROM floors f WHERE f.entity = o.entity AND f.metric = o.metric) UNION ALL SELECT * FROM floors)
  SELECT entity, metric, count(*) AS n, round(CASE WHEN count(*) > 1 THEN avg(score) ELSE max(score) END, 6) AS score FROM every GROUP BY entity, metric""")
def capability_floor_replacing(spark, sf):
    out = C.merge_cells(derive.with_capability_floor(X.observations(spark, sf), X.entities(spark, sf), X.requirements(spark), replace=True))
    return out.select("entity", "metric", "n", _r("score"))


@_register(f"WITH {ENTITIES} SELECT company AS entity, array_to_string(arg_max(input, ord) FILTER (WHERE input IS NOT NULL), ',') AS input, array_to_string(arg_max(output, ord) FILTER (WHERE input IS NOT NULL), ',') AS output FROM ent GROUP BY company")
def capabilities_attached(spark, sf):
    known = X.entities(spark, sf).select(F.col("company").alias("entity"), "capabilities", "ord")
    out = derive.with_capabilities(known.select("entity", F.lit(None).alias("capabilities")).distinct(), known)
    listed = lambda c: F.when(F.col("capabilities").isNotNull(), F.array_join(f"capabilities.{c}", ",")).alias(c)
    return out.select("entity", listed("input"), listed("output"))


@_register(f"""WITH {_RENAMED}, {_firsts(tokens=derive.TOKENS, speed=derive.SPEED, active=derive.ACTIVE)}, used AS (SELECT *, coalesce(speed, CAST(3.35e12 AS DOUBLE) / (active * 1e9 * 2)) AS used FROM firsts WHERE tokens IS NOT NULL)
  SELECT entity, 'Output speed' AS metric, round(used, 6) AS score, 'Estimated from Active Parameters and H100 SXM Memory Bandwidth' AS source FROM used WHERE speed IS NULL AND active IS NOT NULL
  UNION ALL SELECT entity, 'Completion Latency', round(tokens / CAST(7.3 AS DOUBLE) * 119 / used, 6), 'Calculated from ArtificialAnalysis Consumed Tokens and Active Parameters' FROM used WHERE used > 0""")
def derive_latency(spark, sf):
    return _derived(derive.latency(X.renamed(spark, sf)))


def _price(kind: str, name: str, fit) -> str:
    (c, a, r), (d, b) = fit
    return f"""SELECT entity, '{name}' AS metric, round(CASE WHEN speed > 0 THEN CAST({c} AS DOUBLE) + CAST({a} AS DOUBLE) * active + CAST({r} AS DOUBLE) * (active / speed) ELSE CAST({d} AS DOUBLE) + CAST({b} AS DOUBLE) * active END, 6) AS score,
  CASE WHEN speed > 0 THEN 'Estimated from Active parameters + Output speed ratio' ELSE 'Estimated from Active parameters' END AS source FROM firsts WHERE active IS NOT NULL AND {kind} IS NULL"""


@_register(f"WITH {_RENAMED}, {_firsts(active=derive.ACTIVE, speed=derive.SPEED, input=derive.INPUT, output=derive.OUTPUT)} {_price('input', derive.INPUT, derive.INPUT_FIT)} UNION ALL {_price('output', derive.OUTPUT, derive.OUTPUT_FIT)}")
def derive_price(spark, sf):
    return _derived(derive.prices(X.renamed(spark, sf)))


@_register(f"""WITH {_RENAMED}, {_firsts(tokens=derive.TOKENS, input=derive.INPUT, output=derive.OUTPUT)}
  SELECT entity, 'Cost of 1K responses' AS metric, round(1e3 * (input / 1e6 * 11 + output / 1e6 * (tokens / CAST(7.3 AS DOUBLE) * 119)), 6) AS score, 'Calculated from ArtificialAnalysis Consumed Tokens' AS source FROM firsts WHERE tokens IS NOT NULL""")
def derive_cost_1k(spark, sf):
    return _derived(derive.cost_of_1k(X.renamed(spark, sf)))


@_register(f"WITH {ENTITIES} SELECT company AS entity, arg_max(url, ord) AS url, arg_max(release_date, ord) AS release_date, count(*) AS n FROM ent GROUP BY company")
def entity_info(spark, sf):
    rows = X.entities(spark, sf).select(F.col("company").alias("entity"), "company", "url", "release_date", "ord")
    rows = rows.withColumn("release_date", F.col("release_date").cast("string"))
    info = derive.entity_info(rows).select("entity", "url", F.col("release_date").cast("date").alias("release_date"))
    return info.join(rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "entity")


@_register(f"WITH {ENTITIES} SELECT entity, round(CASE WHEN release_date IS NULL THEN CAST(0.7 AS DOUBLE) ELSE greatest(0, 1 - date_diff('day', release_date, DATE '1996-01-01') / CAST(365 AS DOUBLE)) END, 6) AS alpha FROM ent")
def age_transparency(spark, sf):
    return X.entities(spark, sf).select("entity", F.round(N.age_alpha(F.col("release_date"), F.lit("1996-01-01").cast("date")), 6).alias("alpha"))


@_register("SELECT 'Brand#' || i AS metric, 'Brand#' || i AS label, 'logarithmic' AS scale FROM range(1, 4) t(i) UNION ALL SELECT 'Size', 'Size (Billion Parameters)', 'logarithmic' UNION ALL SELECT 'Release date', 'Release Date (Year)', 'linear'")
def axis_labels(spark, sf):
    rows = spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#3",), ("Size",), ("Release date",)], "metric string")
    return rows.select("metric", N.axis_label(F.col("metric")).alias("label"), N.axis_scale(F.col("metric")).alias("scale"))


# Resolution

_NORM = "trim(regexp_replace(translate(regexp_replace(lower({0}), '[0-9]{{8}}', ''), '-._', '   '), '\\s+', ' ', 'g'))"
_EXT = """ext AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN upper(replace(p_name, ' ', '_')) WHEN 1 THEN replace(p_name, ' ', '-') ELSE replace(p_name, 'a', '') END AS name FROM part),
ours AS (SELECT p_name AS entity, min(p_partkey) AS ord FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name)"""


def _external(spark, sf) -> DataFrame:
    name = F.col("p_name")
    told = F.when(F.col("p_partkey") % 3 == 0, F.upper(F.replace(name, F.lit(" "), F.lit("_")))).when(F.col("p_partkey") % 3 == 1, F.replace(name, F.lit(" "), F.lit("-"))).otherwise(F.replace(name, F.lit("a"), F.lit("")))
    return X.table(spark, sf, "part").groupBy(told.alias("name")).agg(F.min("p_partkey").alias("ord"))


def _ours(spark, sf) -> DataFrame:
    return X.table(spark, sf, "part").where("p_partkey % 2 = 0").groupBy(F.col("p_name").alias("entity")).agg(F.min("p_partkey").alias("ord"))


@_register(f"WITH {_EXT} SELECT name, {_NORM.format('name')} AS norm FROM ext UNION ALL SELECT s_name, {_NORM.format('s_name')} FROM supplier")
def name_normalize(spark, sf):
    names = _external(spark, sf).select("name").unionAll(X.table(spark, sf, "supplier").select(F.col("s_name").alias("name")))
    return names.select("name", N.normalize_name(F.col("name")).alias("norm"))


@_register(f"WITH {_EXT}, first AS (SELECT {_NORM.format('entity')} AS norm, arg_min(entity, ord) AS entity FROM ours GROUP BY 1) SELECT e.name, f.entity FROM ext e JOIN first f ON f.norm = {_NORM.format('e.name')}")
def name_exact_match(spark, sf):
    return resolve.by_equal_name(_external(spark, sf), _ours(spark, sf))


@_register(f"""WITH l AS (SELECT s_name AS name, {_NORM.format('s_name')} AS norm, row_number() OVER (PARTITION BY {_NORM.format('s_name')} ORDER BY s_suppkey) AS turn FROM supplier),
  r AS (SELECT 'new-' || s_name AS entity, {_NORM.format('s_name')} AS norm, row_number() OVER (PARTITION BY {_NORM.format('s_name')} ORDER BY s_suppkey DESC) AS turn FROM supplier WHERE s_suppkey % 2 = 0)
  SELECT name, replace(entity, 'new-', '') AS entity FROM l JOIN r ON l.norm = r.norm AND l.turn = r.turn""")
def name_pair_1to1(spark, sf):
    suppliers = X.table(spark, sf, "supplier")
    right = suppliers.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("entity"), (-F.col("s_suppkey")).alias("ord"))
    return resolve.by_equal_name_once(suppliers.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord")), right)


@_register(f"""WITH {_EXT}, pairs AS (SELECT name, entity, ord, levenshtein({_NORM.format('name')}, {_NORM.format('entity')}) AS distance FROM ext CROSS JOIN ours),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, ord, entity) AS turn FROM pairs) SELECT name, entity, distance FROM ranked WHERE turn = 1""")
def name_nearest(spark, sf):
    return resolve.nearest(_external(spark, sf), _ours(spark, sf))


@_register("SELECT p_name AS name, p_partkey AS ord FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0)")
def unknown_names(spark, sf):
    part = X.table(spark, sf, "part")
    names = part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    return resolve.unknown_names(names, part.where("p_partkey % 50 = 0").select(F.col("p_name").alias("name")))


@_register("""WITH known AS (SELECT p_name AS name, min(p_partkey) AS ord FROM part WHERE p_partkey % 97 = 0 GROUP BY p_name), un AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name NOT IN (SELECT name FROM known)),
  ranked AS (SELECT u.name, k.name AS closest, levenshtein(u.name, k.name) AS distance, row_number() OVER (PARTITION BY u.name ORDER BY levenshtein(u.name, k.name), k.ord, k.name) AS turn FROM un u CROSS JOIN known k)
  SELECT name, closest, distance FROM ranked WHERE turn = 1""")
def nearest_suggestion(spark, sf):
    part = X.table(spark, sf, "part")
    names = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    known = part.where("p_partkey % 97 = 0").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"))
    return resolve.suggestions(names, known).select("name", "closest", "distance")


_MATCH = f"""{_EXT}, dict AS (SELECT name, 'small ring' AS entity FROM ext WHERE name LIKE 'RED%' AND EXISTS (SELECT 1 FROM ours WHERE entity = 'small ring')),
  rest AS (SELECT name FROM ext WHERE name NOT IN (SELECT name FROM dict)),
  first AS (SELECT {_NORM.format('entity')} AS norm, arg_min(entity, ord) AS entity FROM ours GROUP BY 1),
  exact AS (SELECT e.name, f.entity FROM rest e JOIN first f ON f.norm = {_NORM.format('e.name')}),
  near AS (SELECT name, entity, distance, row_number() OVER (PARTITION BY name ORDER BY distance, ord, entity) AS turn
    FROM (SELECT name, entity, ord, levenshtein({_NORM.format('name')}, {_NORM.format('entity')}) AS distance FROM rest CROSS JOIN ours WHERE name NOT IN (SELECT name FROM exact))),
  matched AS (SELECT name, entity, 'dictionary' AS kind FROM dict UNION ALL SELECT name, entity, 'exact' FROM exact UNION ALL SELECT name, entity, 'nearest' FROM near WHERE turn = 1)"""


def _matches(spark, sf) -> DataFrame:
    ext, ours = _external(spark, sf), _ours(spark, sf)
    return resolve.match(ext, ours, ext.where("name like 'RED%'").select("name", F.lit("small ring").alias("entity")))


@_register(f"WITH {_MATCH} SELECT e.name, m.entity, coalesce(m.kind, 'none') AS kind FROM ext e LEFT JOIN matched m ON m.name = e.name")
def name_match(spark, sf):
    return _matches(spark, sf).select("name", "entity", "kind")


@_register(f"""WITH {_MATCH}, sure AS (SELECT e.name, m.entity, coalesce(m.entity IS NOT NULL AND (m.kind = 'dictionary' OR {_NORM.format('e.name')} = {_NORM.format('m.entity')}), false) AS sure FROM ext e LEFT JOIN matched m ON m.name = e.name)
  SELECT count(*) AS total, count(*) FILTER (WHERE sure) AS unambiguous, count(*) FILTER (WHERE NOT sure) AS ambiguous, count(*) FILTER (WHERE entity IS NULL) AS unmatched FROM sure""")
def match_summary(spark, sf):
    return resolve.summary(_matches(spark, sf))


@_register(f"""WITH {_MATCH}, fields AS (SELECT p_name AS entity, arg_min(p_type, p_partkey) AS company, arg_min(p_brand, p_partkey) AS url, CAST(arg_min(p_size, p_partkey) AS VARCHAR) AS release_date FROM part WHERE p_partkey % 2 = 0 GROUP BY p_name)
  SELECT e.name, m.entity, f.company, f.url, f.release_date FROM ext e LEFT JOIN matched m ON m.name = e.name LEFT JOIN fields f ON f.entity = m.entity
  WHERE NOT coalesce(m.entity IS NOT NULL AND (m.kind = 'dictionary' OR {_NORM.format('e.name')} = {_NORM.format('m.entity')}), false)""")
def match_ambiguous(spark, sf):
    part = X.table(spark, sf, "part").where("p_partkey % 2 = 0").groupBy(F.col("p_name").alias("entity")).agg(F.min_by(F.struct(F.col("p_type").alias("company"), F.col("p_brand").alias("url"), F.col("p_size").cast("string").alias("release_date")), "p_partkey").alias("f"))
    return resolve.ambiguous_report(_matches(spark, sf), part.select("entity", "f.*")).select("name", "entity", "company", "url", "release_date")


@_register("SELECT p_partkey, p_name FROM part WHERE p_name <> 'red bolt' AND NOT starts_with(p_name, 'small') AND NOT starts_with(p_name, 'old r')")
def name_ignore_lists(spark, sf):
    names = X.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"))
    out = resolve.not_ignored(names, spark.createDataFrame([("red bolt",)], "name string"), spark.createDataFrame([("small",), ("old r",)], "prefix string"))
    return out.select(F.col("ord").alias("p_partkey"), F.col("name").alias("p_name"))


# Feeds

_FEED_NAMES = {"view": "Views", "click": "Clicks", "error": "Errors", "purchase": "Purchases"}


@_register("""WITH e AS (SELECT user_id, event_type, round(sum(value), 2) AS v FROM events GROUP BY user_id, event_type)
  SELECT CAST(user_id AS VARCHAR) AS name, CASE event_type WHEN 'view' THEN 'Views' WHEN 'click' THEN 'Clicks' ELSE 'Errors' END AS metric,
    floor((CASE WHEN event_type = 'click' THEN v ELSE v * 100 END) * 100 + 0.5) / 100 AS score, 'https://artificialanalysis.ai' AS source
  FROM e WHERE event_type IN ('view', 'click', 'error') AND v <> 0""")
def feed_flatten(spark, sf):
    sums = X.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 2).alias("v"))
    feed = sums.groupBy(F.col("user_id").cast("string").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("evaluations"), F.min("user_id").alias("ord"))
    feed = feed.withColumns({"pricing": F.lit(None).cast("map<string,double>"), "speed": F.lit(None).cast("double")})
    return feeds.flatten_feed_a(feed, _FEED_NAMES, ("click",), ("Purchases",)).select("name", "metric", "score", "source")


@_register("SELECT CAST(user_id AS VARCHAR) AS name, 'LMArena ' || upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS metric, floor(max(value) + 0.5) AS score FROM events GROUP BY user_id, event_type")
def feed_arena(spark, sf):
    rows = X.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("arena")).agg(F.max("value").alias("rating"))
    return feeds.flatten_feed_b(rows).select("name", "metric", "score")


_UPDATES = OBS + ", updates AS (SELECT entity, metric, CASE WHEN source = 'N' THEN 'feed' ELSE source END AS source, CASE WHEN source = 'R' THEN score ELSE floor(score) + 100 END AS score, ord FROM obs WHERE source IN ('N', 'R') OR CAST(entity AS BIGINT) % 2 = 0)"


def _updates(spark, sf) -> DataFrame:
    obs = X.observations(spark, sf).where("source in ('N', 'R') or cast(entity as bigint) % 2 = 0")
    return obs.select("entity", "metric", F.when(F.col("source") == "N", "feed").otherwise(F.col("source")).alias("source"), F.when(F.col("source") == "R", F.col("score")).otherwise(F.floor("score") + 100.0).alias("score"), "ord")


@_register(f"""WITH {_UPDATES} SELECT coalesce(o.entity, u.entity) AS entity, coalesce(o.metric, u.metric) AS metric, coalesce(o.source, u.source) AS source, round(coalesce(u.score, o.score), 6) AS score,
  CASE WHEN o.entity IS NULL THEN 'appended' WHEN u.entity IS NOT NULL AND u.score <> o.score THEN 'replaced' ELSE 'kept' END AS action
  FROM obs o FULL JOIN updates u ON u.entity = o.entity AND u.metric = o.metric AND u.source = o.source""")
def feed_upsert_source_key(spark, sf):
    return upsert.upsert_by_source(X.observations(spark, sf), _updates(spark, sf)).select("entity", "metric", "source", _r("score"), "action")


@_register(f"""WITH {_UPDATES}, new AS (SELECT entity, metric, arg_max(score, ord) AS score, arg_max(source, ord) AS source FROM updates WHERE source = 'feed' GROUP BY entity, metric),
  old AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY ord) AS turn FROM obs WHERE source <> 'A'), hit AS (
  SELECT o.*, n.score AS new_score, n.source AS new_source, o.turn = 1 AND n.score IS NOT NULL AND n.score <> o.score AS hit FROM old o LEFT JOIN new n ON n.entity = o.entity AND n.metric = o.metric)
  SELECT entity, metric, CASE WHEN hit THEN new_source ELSE source END AS source, round(CASE WHEN hit THEN new_score ELSE score END, 6) AS score, CASE WHEN hit THEN 'replaced' ELSE 'kept' END AS action FROM hit
  UNION ALL SELECT entity, metric, source, round(score, 6), 'appended' FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.entity = n.entity AND o.metric = n.metric)""")
def feed_upsert_metric_key(spark, sf):
    out = upsert.upsert_by_metric(X.observations(spark, sf).where("source <> 'A'"), _updates(spark, sf).where("source = 'feed'"))
    return out.select("entity", "metric", "source", _r("score"), "action")


@_register(f"WITH {ENTITIES} SELECT entity, regexp_replace(lower(company), '[\\s.]', '', 'g') AS company_slug FROM ent")
def owner_routing(spark, sf):
    entities = X.entities(spark, sf)
    return sinks.owners(entities.select("entity"), entities)


@_register(f"WITH {OBS} SELECT metric || chr(9) || CAST(count(*) AS VARCHAR) AS value FROM obs GROUP BY metric")
def name_count_lines(spark, sf):
    return sinks.tab_lines(C.metric_counts(X.observations(spark, sf)).orderBy("metric"), "metric", "n")


@_register(f"WITH {CELLS}, {ENTITIES} SELECT e.entity AS name, e.company, count(c.metric) AS n, round(coalesce(sum(c.score), 0), 4) AS total FROM ent e LEFT JOIN cells c ON c.entity = e.entity GROUP BY e.entity, e.company")
def nested_document(spark, sf):
    cells = C.merge_cells(X.observations(spark, sf)).drop("n")
    out = sinks.nested(cells, X.entities(spark, sf))
    total = F.aggregate("benchmarks", F.lit(0.0), lambda s, b: s + F.coalesce(b["score"], F.lit(0.0)))
    return out.select("name", "company", F.size("benchmarks").cast("long").alias("n"), F.round(total, 4).alias("total"))


# Evaluation

_SAMPLE = OBS + ", picked AS (SELECT entity, metric, source, ord, score AS truth, md5('12345|' || entity || '|' || metric || '|' || CAST(ord AS VARCHAR)) AS holdout FROM obs ORDER BY holdout LIMIT {0})"


@_register(f"WITH {_SAMPLE.format(100)} SELECT entity, metric, source, ord, round(truth, 6) AS truth, holdout FROM picked")
def holdout_sample(spark, sf):
    return evaluate.holdout_sample(X.observations(spark, sf)).select("entity", "metric", "source", "ord", _r("truth"), "holdout")


def _heldout(n: int) -> str:
    """CTEs of the grids of all hold-outs of whole cells."""
    return f"""{_SAMPLE.format(n)}, rest AS (
  SELECT p.holdout, o.* FROM obs o CROSS JOIN picked p WHERE NOT (o.entity = p.entity AND o.metric = p.metric)
), hcells AS (
  SELECT holdout, entity, metric, CASE WHEN count(*) > 1 THEN avg(score) ELSE max(score) END AS score, CASE WHEN count(*) > 1 THEN stddev_samp(score) ELSE 0 END AS std_dev FROM rest GROUP BY holdout, entity, metric
), hgrid AS (
  SELECT h.holdout, e.entity, m.metric, c.score, coalesce(c.std_dev, 0) AS std_dev, c.score IS NOT NULL AS is_known
  FROM (SELECT holdout FROM picked) h JOIN (SELECT DISTINCT holdout, entity FROM hcells) e ON e.holdout = h.holdout JOIN (SELECT DISTINCT holdout, metric FROM hcells) m ON m.holdout = h.holdout
  LEFT JOIN hcells c ON c.holdout = h.holdout AND c.entity = e.entity AND c.metric = m.metric
)"""


_STATS = "stats AS (SELECT metric, avg(score) AS mean, CASE WHEN stddev_pop(score) = 0 THEN 1 ELSE stddev_pop(score) END AS sd FROM obs GROUP BY metric)"
_MSE = "SELECT count(*) AS tests, round(avg(error * error), 5) AS mse, round(sqrt(avg(error * error)), 5) AS rmse FROM errors"


def _mse(errors: DataFrame) -> DataFrame:
    return evaluate.mean_squared_error(errors).select("tests", _r("mse", 5), _r("rmse", 5))


@_register(f"""WITH {_heldout(100)}, {_STATS}, hmeans AS (SELECT holdout, metric, coalesce(avg(score), 0) AS mean FROM hgrid GROUP BY holdout, metric),
  errors AS (SELECT (h.mean - s.mean) / s.sd - (p.truth - s.mean) / s.sd AS error FROM picked p JOIN hmeans h ON h.holdout = p.holdout AND h.metric = p.metric JOIN stats s ON s.metric = p.metric) {_MSE}""")
def holdout_mse_mean(spark, sf):
    obs = X.observations(spark, sf)
    return _mse(evaluate.evaluate_mean(obs, evaluate.holdout_sample(obs), whole_cell=True))


@_register(f"""WITH {_heldout(100)}, {_STATS}, {_bivariate('hgrid', 'f', 'holdout, ')},
  errors AS (SELECT (f.score - s.mean) / s.sd - (p.truth - s.mean) / s.sd AS error FROM picked p JOIN f ON f.holdout = p.holdout AND f.entity = p.entity AND f.metric = p.metric JOIN stats s ON s.metric = p.metric) {_MSE}""")
def holdout_mse_bivariate(spark, sf):
    obs = X.observations(spark, sf)
    return _mse(evaluate.evaluate_bivariate(obs, evaluate.holdout_sample(obs), whole_cell=True))


# The same by refitting all of the matrix for each hold-out: evaluate takes any imputer, refit_bivariate holds the matrix densely.


@_register()
def holdout_mse_mean_all(spark, sf):
    obs = X.observations(spark, sf)
    return _mse(evaluate.evaluate(obs, evaluate.holdout_sample(obs), impute.impute_mean, whole_cell=True))


@_register()
def holdout_mse_bivariate_all(spark, sf):
    obs = settle(X.observations(spark, sf), "observations")
    return _mse(refit.refit_bivariate(obs, evaluate.holdout_sample(obs), whole_cell=True))


# One observation is held out, so a cell that has others stays known, and their mean is what is predicted for it.

_LEFT = """lefts AS (SELECT p.holdout, avg(o.score) AS score FROM picked p JOIN obs o ON o.entity = p.entity AND o.metric = p.metric AND o.ord <> p.ord GROUP BY p.holdout)"""


@_register(f"""WITH {_heldout(100)}, {_STATS}, {_LEFT}, {_bivariate('hgrid', 'f', 'holdout, ')},
  errors AS (SELECT (coalesce(l.score, f.score) - s.mean) / s.sd - (p.truth - s.mean) / s.sd AS error
    FROM picked p JOIN stats s ON s.metric = p.metric LEFT JOIN lefts l ON l.holdout = p.holdout LEFT JOIN f ON f.holdout = p.holdout AND f.entity = p.entity AND f.metric = p.metric
    WHERE coalesce(l.score, f.score) IS NOT NULL) {_MSE}""")
def holdout_mse_observation(spark, sf):
    obs = X.observations(spark, sf)
    return _mse(evaluate.evaluate_bivariate(obs, evaluate.holdout_sample(obs)))
