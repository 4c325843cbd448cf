"""Queries on fitted models, releases that choose their tables, nearest rows without a cap, attacks, and generation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from hushtable.operators import adaptive, attacks, centres, decode, fitted, near_points, propensity, stage, transport, workloads
from hushtable.operators.graphical import fit, Measured
from hushtable.plans.evaluation import _FAR, _NAMES, _POINT
from hushtable.plans.registry import query
from hushtable.plans.release import _histogram_sql, _WORKLOAD, CLIPPED, COHORTS, halves, IDS, items, ITEMS
from hushtable.sources.shared import shared_folder
from hushtable.streaming import generation

PAIRS = list(combinations(adaptive.features(ITEMS), 2))
_BIN = {c: _histogram_sql(c, e) for c, e in ITEMS.numeric.items()} | {c: f"CASE WHEN {c} IN ({', '.join(repr(v) for v in ITEMS.bins(c))}) THEN {c} END" for c in [*ITEMS.categorical, ITEMS.target]}


@query("set_counts", " UNION ALL ".join(f"SELECT '{a}|{b}' AS col, {_BIN[a]} || '|' || {_BIN[b]} AS bin, count(*) AS n FROM {CLIPPED} WHERE {_BIN[a]} IS NOT NULL AND {_BIN[b]} IS NOT NULL GROUP BY 2" for a, b in PAIRS))
def set_counts(spark, sf_dir):
    """Counts of all pairs of columns from one job, without empty cells."""
    found = adaptive.table_counts(items(spark, sf_dir), ITEMS, PAIRS)
    rows = [(f"{a}|{b}", f"{x}|{y}", int(found[a, b][i, j])) for a, b in PAIRS for i, x in enumerate(ITEMS.bins(a)) for j, y in enumerate(ITEMS.bins(b)) if found[a, b][i, j]]
    return spark.createDataFrame(rows, "col string, bin string, n long")


CHAIN = ("l_quantity", "l_returnflag", "l_linestatus")
_Q, _F, _S = (_BIN[c] for c in CHAIN)


@query("tree_shares", f"WITH r AS (SELECT {_Q} AS q, {_F} AS f, {_S} AS s FROM {CLIPPED}), qf AS (SELECT q, f, count(*)::DOUBLE AS n FROM r WHERE q IS NOT NULL AND f IS NOT NULL GROUP BY ALL), fs AS (SELECT f, s, count(*)::DOUBLE AS n FROM r WHERE f IS NOT NULL AND s IS NOT NULL GROUP BY ALL), t AS (SELECT f, sum(n) AS n FROM fs GROUP BY f) SELECT q AS quantity, qf.f AS flag, s AS status, round(qf.n * fs.n / t.n / (SELECT sum(n) FROM t), 4) AS share FROM qf JOIN fs USING (f) JOIN t USING (f) WHERE round(qf.n * fs.n / t.n / (SELECT sum(n) FROM t), 4) > 0")
def tree_shares(spark, sf_dir):
    """The fit to two exact tables that share a column: what follows quantity and status in each flag are independent."""
    counts = adaptive.table_counts(items(spark, sf_dir), ITEMS, [CHAIN[:2], CHAIN[1:]])
    model = fit({c: len(ITEMS.bins(c)) for c in CHAIN}, [Measured(names, table) for names, table in counts.items()], float(counts[CHAIN[1:]].sum()), tolerance=1e-9)
    shares = model.table(CHAIN)
    rows = [(a, b, c, float(shares[i, j, k])) for i, a in enumerate(ITEMS.bins(CHAIN[0])) for j, b in enumerate(ITEMS.bins(CHAIN[1])) for k, c in enumerate(ITEMS.bins(CHAIN[2]))]
    return spark.createDataFrame(rows, "quantity string, flag string, status string, share double").withColumn("share", F.round("share", 4)).where("share > 0")


@query("graph_drawn")
def graph_drawn(spark, sf_dir):
    """Rows drawn from the model that is fitted to a release of the line items."""
    released = stage.release(items(spark, sf_dir), ITEMS, COHORTS, n_min=50, seed=1)
    return decode.draw(spark, released, ITEMS, 2000, 7, fitted.fit_release(released, ITEMS))


@query("spanning_tree_rows")
def spanning_tree_rows(spark, sf_dir):
    return adaptive.drawn_rows(spark, adaptive.spanning_tree(items(spark, sf_dir), ITEMS, 2.0, seed=1).model, ITEMS, 2000, 7)


@query("worst_table_rows")
def worst_table_rows(spark, sf_dir):
    return adaptive.drawn_rows(spark, adaptive.worst_tables(items(spark, sf_dir), ITEMS, 2.0, rounds=10, seed=1).model, ITEMS, 2000, 7)


_POINTS = f"(SELECT {_NAMES}, count(*) AS near_rows FROM (SELECT {_POINT} FROM lineitem WHERE l_orderkey % 2 = 1) GROUP BY ALL)"
_ASKED = f"asked AS (SELECT {', '.join(IDS)}, {_POINT} FROM lineitem WHERE l_orderkey % 100 = 0)"
_FOUND = f"SELECT {', '.join(f'q.{x}' for x in _NAMES.split(', '))}, p.near_rows, round(sqrt({_FAR}), 9) AS d FROM (SELECT DISTINCT {_NAMES} FROM asked) q, {_POINTS} p"


@query("k_nearest_rows", f"WITH {_ASKED}, u AS (SELECT {_NAMES}, d, sum(near_rows) OVER (PARTITION BY {_NAMES} ORDER BY d RANGE UNBOUNDED PRECEDING) AS upto FROM ({_FOUND})), f AS (SELECT {_NAMES}, {', '.join(f'min(d) FILTER (upto >= {k}) AS d{k}' for k in (1, 5))} FROM u GROUP BY {_NAMES}) SELECT {', '.join(IDS)}, d1 AS nearest, d5 AS fifth FROM asked JOIN f USING ({_NAMES})")
def k_nearest_rows(spark, sf_dir):
    """Rows whose order is divisible by 100 against all rows of odd orders: how far the nearest and the fifth nearest lie."""
    private, other = halves(spark, sf_dir)
    found = near_points.nearest_rows(private.where("l_orderkey % 100 = 0"), other, ITEMS, 5)
    return found.select(*IDS, F.col("distances")[0].alias("nearest"), F.col("distances")[4].alias("fifth"))


@query("exact_attack", "WITH s AS (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem WHERE l_orderkey % 2 = 1), c AS (SELECT l_orderkey % 4 = 0 AS member, (s.l_quantity IS NOT NULL)::INT AS hit FROM lineitem x LEFT JOIN s USING (l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) WHERE l_orderkey % 2 = 0), n AS (SELECT count(*) FILTER (member AND hit = 1)::DOUBLE AS a, count(*) FILTER (member AND hit = 0)::DOUBLE AS b, count(*) FILTER (NOT member AND hit = 1)::DOUBLE AS c, count(*) FILTER (NOT member AND hit = 0)::DOUBLE AS d FROM c) SELECT round((a * d + (a * c + b * d) / 2) / ((a + b) * (c + d)), 9) AS auc, (a + b)::BIGINT AS positives, (c + d)::BIGINT AS negatives FROM n")
def exact_attack(spark, sf_dir):
    """Whether an exact match among the other rows tells one half of the private rows from the other."""
    private, other = halves(spark, sf_dir)
    scored = attacks.exact_scores(other, private.withColumn("member", F.col("l_orderkey") % 4 == 0), ITEMS)
    return attacks.auc_interval(scored, F.col("score"), F.col("member"), 200).select("auc", "positives", "negatives")


@query("attack_success")
def attack_success(spark, sf_dir):
    """All attacks with their intervals; the candidates are the rows whose order is divisible by 50, members by 100."""
    private, other = halves(spark, sf_dir)
    return attacks.attacked(other, private.where("l_orderkey % 100 = 0"), private.where("l_orderkey % 100 = 50"), ITEMS, IDS, seed=1, draws=500)


@query("generated_rows")
def generated_rows(spark, sf_dir):
    """Rows from a mock generator that is asked for what cohorts owe of 600, by a release of the line items."""
    released = stage.release(items(spark, sf_dir), ITEMS, COHORTS, n_min=50, seed=1)
    quotas = generation.cohort_quotas(released, ITEMS, 600, seed=1)
    return generation.generate(spark, quotas, ITEMS, shared_folder(spark), generation.exact_mock(ITEMS, 1, failing=0.1), per_call=50)


@query("transport_pairs")
def transport_pairs(spark, sf_dir):
    """Transport distance of all pairs of columns between the halves; 300 rows of each, which bounds the exact solver."""
    return transport.k_way_transport(*halves(spark, sf_dir), ITEMS, 2, IDS, most=300, seed=1)


SETS = {"all": list(combinations(_WORKLOAD, 3)), "target": workloads.target_sets(list(_WORKLOAD), ITEMS.target), "skewed": workloads.skewed_sets(list(_WORKLOAD), 6, seed=1)}
_SIDE = lambda half: f"(SELECT {', '.join(f'{x} AS {c}' for c, x in _WORKLOAD.items())} FROM lineitem WHERE l_orderkey % 2 = {half})"
_SET = lambda i, s, half: f"SELECT {i} AS i, {" || '|' || ".join(s)} AS bin, count(*) / sum(count(*)) OVER () AS p FROM {_SIDE(half)} GROUP BY 2"
_EVERY_SET = list(dict.fromkeys(s for sets in SETS.values() for s in sets))
_IN = " UNION ALL ".join(f"SELECT '{name}' AS workload, {_EVERY_SET.index(s)} AS i" for name, sets in SETS.items() for s in sets)


@query("workload_errors", f"WITH a AS ({' UNION ALL '.join(_SET(i, s, 0) for i, s in enumerate(_EVERY_SET))}), b AS ({' UNION ALL '.join(_SET(i, s, 1) for i, s in enumerate(_EVERY_SET))}), d AS (SELECT i, sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) AS d FROM a FULL JOIN b USING (i, bin) GROUP BY i) SELECT workload, count(*) AS sets, round(avg(d), 9) AS error FROM d JOIN ({_IN}) USING (i) GROUP BY workload")
def workload_errors(spark, sf_dir):
    """Errors over all triples, those with the target, and a skewed draw of them."""
    return workloads.workload_error(*halves(spark, sf_dir), ITEMS, SETS)


@query("noisy_clusters")
def noisy_clusters(spark, sf_dir):
    """How many rows lie at each of three centres found under a budget; seeded so that it can be repeated."""
    df, bounds = items(spark, sf_dir), {c: (e[0], e[-1]) for c, e in ITEMS.numeric.items()}
    found = centres.noisy_centres(df, bounds, 3, 2.0, seed=1)
    return centres.clustered(df, bounds, found).groupBy("cluster").agg(F.count("*").alias("n"))


_ONE = f"SELECT {', '.join(IDS)}, l_linestatus, l_returnflag, round(l_quantity / 50.0::DOUBLE, 4) AS s, CASE l_returnflag WHEN 'A' THEN 0.4 WHEN 'N' THEN 0.25 WHEN 'R' THEN 0.5 END AS rate FROM lineitem"


@query("labels_in_order", f"WITH r AS ({_ONE}), k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY s DESC, md5(concat_ws('|', {', '.join(IDS)}, '7')), {', '.join(IDS)}) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM r) SELECT {', '.join(IDS)}, CASE WHEN rate IS NULL THEN l_linestatus WHEN k <= floor(rate * n) + (('0x' || substr(md5('l_returnflag=' || l_returnflag || '|7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate * n - floor(rate * n))::INT THEN 'F' ELSE 'O' END AS l_linestatus FROM k")
def labels_in_order(spark, sf_dir):
    """Stated rates of each return flag given to the rows with the largest quantities."""
    rates = spark.createDataFrame([("l_returnflag=A", 0.4), ("l_returnflag=N", 0.25), ("l_returnflag=R", 0.5)], "cell string, rate double")
    scored = items(spark, sf_dir).withColumn("score", F.col("l_quantity") / 50.0)
    return propensity.relabel_in_order(scored, rates, ITEMS, ("l_returnflag",), IDS, 7).select(*IDS, "l_linestatus")


@query("covered_share", f"WITH {_ASKED}, found AS ({_FOUND}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(f'q{x}' for x in _NAMES.split(', '))} ORDER BY d, {', '.join(f'p{x}' for x in _NAMES.split(', '))}) AS k FROM (SELECT {', '.join(f'q.{x} AS q{x}, p.{x} AS p{x}' for x in _NAMES.split(', '))}, round(sqrt({_FAR}), 9) AS d FROM (SELECT DISTINCT {_NAMES} FROM asked) q, {_POINTS} p)) WHERE k = 1), c AS (SELECT DISTINCT {', '.join(f'p{x} AS {x}' for x in _NAMES.split(', '))} FROM f), g AS (SELECT {', '.join(f'q.{x}' for x in _NAMES.split(', '))}, round(sqrt({_FAR}), 9) AS d, p.near_rows FROM c q, {_POINTS} p), u AS (SELECT {_NAMES}, d, sum(near_rows) OVER (PARTITION BY {_NAMES} ORDER BY d RANGE UNBOUNDED PRECEDING) AS upto FROM g), r AS (SELECT {_NAMES}, min(d) FILTER (upto > 5) AS radius FROM u GROUP BY {_NAMES}) SELECT count(*) AS n, round(avg((f.d <= r.radius)::INT), 9) AS share FROM asked a JOIN f ON {' AND '.join(f'a.{x} = f.q{x}' for x in _NAMES.split(', '))} JOIN r ON {' AND '.join(f'r.{x} = f.p{x}' for x in _NAMES.split(', '))}")
def covered_share(spark, sf_dir):
    """How many rows whose order is divisible by 100 lie within the fifth-neighbour radius of their nearest row of odd orders."""
    private, other = halves(spark, sf_dir)
    return near_points.covered(private.where("l_orderkey % 100 = 0"), other, ITEMS, 5)
