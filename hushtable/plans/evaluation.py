"""Queries on configuration, cohorts by bands, order statistics, nearest rows and students, over line items."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from hushtable.operators import bands, closest, configure, counts, distances, students, values
from hushtable.operators.ledger import Ledger
from hushtable.plans.registry import query
from hushtable.plans.release import _band_sql, halves, items, ITEMS, IDS
from hushtable.sources.tables import read_table

BANDS = {"few": (1, 11), "some": (11, 31), "many": (31, 51)}
GROUPS = {"A": "closed", "R": "closed"}
TENTHS = [i / 10 for i in range(11)]
#: The table's size as its owner states it; counting it would tell more than the budget allows.
PUBLIC_ROWS = 60_000
MEASURED = ["l_quantity", "l_extendedprice", "l_discount"]


@query("quantiles", " UNION ALL ".join(f"SELECT '{c}' AS col, unnest(range(11))::INT AS i, round(unnest(q), 9) AS value FROM (SELECT quantile_cont({c}::DOUBLE, {TENTHS}) AS q FROM lineitem)" for c in MEASURED))
def quantiles(spark, sf_dir):
    return values.quantiles(read_table(spark, f"{sf_dir}/lineitem.parquet", MEASURED), MEASURED, 10)


def _wasserstein_sql(c, e):
    return f"""SELECT '{c}' AS col, round(sum(abs(fa / ta - fb / tb) * (coalesce(nxt, v) - v)) / {float(e[-1]) - float(e[0])!r}, 9) AS distance FROM (
        SELECT v, sum(a) OVER w AS fa, sum(b) OVER w AS fb, sum(a) OVER () AS ta, sum(b) OVER () AS tb, lead(v) OVER (ORDER BY v) AS nxt FROM (
            SELECT {c}::DOUBLE AS v, (count(*) FILTER (l_orderkey % 2 = 0))::DOUBLE AS a, (count(*) FILTER (l_orderkey % 2 = 1))::DOUBLE AS b
            FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1) WINDOW w AS (ORDER BY v ROWS UNBOUNDED PRECEDING))"""


@query("wasserstein", " UNION ALL ".join(_wasserstein_sql(c, e) for c, e in ITEMS.numeric.items()))
def wasserstein(spark, sf_dir):
    return values.wasserstein(*halves(spark, sf_dir), ITEMS)


@query("quantile_pair_distance")
def quantile_pair_distance(spark, sf_dir):
    private, other = halves(spark, sf_dir)
    return distances.k_way_distance(private, other, values.with_quantile_bins(ITEMS, private, 10), 2)


_COHORT = f"(CASE {' '.join(f"WHEN l_quantity >= {lo} AND l_quantity {'<=' if name == 'many' else '<'} {hi} THEN '{name}'" for name, (lo, hi) in BANDS.items())} ELSE 'oob' END) || ' & ' || l_returnflag"
_EVERY = [f"{b} & {f}" for b in BANDS for f in ITEMS.categorical["l_returnflag"]]


@query("banded_cohorts", f"SELECT cohort, coalesce(n, 0) AS n, coalesce(p, 0) AS positives, round(p / n, 5) AS share FROM (SELECT unnest({_EVERY}) AS cohort) LEFT JOIN (SELECT {_COHORT} AS cohort, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS p FROM lineitem WHERE {' AND '.join(f'{c} IS NOT NULL' for c in ITEMS.numeric)} GROUP BY 1) USING (cohort)")
def banded_cohorts(spark, sf_dir):
    return counts.class_balance(*bands.with_cohorts(items(spark, sf_dir), ITEMS, {"l_quantity": BANDS, "l_returnflag": None}))


@query("coarsened_rates", "SELECT 0 AS level, cell, coalesce(n, 0) AS support, coalesce(p, 0) AS positives, round(p / n, 5) AS rate FROM (SELECT unnest(['l_returnflag=closed', 'l_returnflag=N', 'l_returnflag=X']) AS cell) LEFT JOIN (SELECT 'l_returnflag=' || CASE WHEN l_returnflag IN ('A', 'R') THEN 'closed' ELSE l_returnflag END AS cell, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS p FROM lineitem GROUP BY 1) USING (cell)")
def coarsened_rates(spark, sf_dir):
    return counts.cell_rates(*bands.coarsened(items(spark, sf_dir), replace(ITEMS, levels=(("l_returnflag",),)), {"l_returnflag": GROUPS}))


_TABLE = " UNION ALL ".join([*(f"SELECT '{c}' AS col, {_band_sql(c, e)} AS bin, l_linestatus = 'F' AS positive FROM lineitem WHERE l_linestatus IN ('F', 'O')" for c, e in ITEMS.numeric.items()), "SELECT 'l_returnflag', l_returnflag, l_linestatus = 'F' FROM lineitem WHERE l_linestatus IN ('F', 'O')"])
_ALL = " UNION ALL ".join(f"SELECT '{c}' AS col, unnest([{', '.join(repr(b) for b in ITEMS.bins(c))}]) AS bin" for c in [*ITEMS.numeric, *ITEMS.categorical])


@query("contingency", f"SELECT col, bin, positive, coalesce(n, 0) AS n FROM ({_ALL}) CROSS JOIN (SELECT unnest([false, true]) AS positive) LEFT JOIN (SELECT col, bin, positive, count(*) AS n FROM ({_TABLE}) GROUP BY ALL) USING (col, bin, positive)")
def contingency(spark, sf_dir):
    return configure.contingency(items(spark, sf_dir), ITEMS)


@query("configured_rates")
def configured_rates(spark, sf_dir):
    """The rates of the levels that the procedure chooses by itself; seeded so that it can be repeated."""
    df = items(spark, sf_dir)
    plan = configure.derive(df, ITEMS, Ledger(2.0), 2.0, rows=PUBLIC_ROWS, n_records=3000, seed=1)
    df, schema, _ = configure.configured(df, ITEMS, plan)
    return counts.cell_rates(df, schema)


_N = [f"(coalesce(least(greatest({c}, {e[0]}), {e[-1]}), {e[0]})::DOUBLE - {float(e[0])!r}::DOUBLE) / {float(e[-1]) - float(e[0])!r}::DOUBLE" for c, e in ITEMS.numeric.items()]
_POINT = ", ".join([*(f"{n} AS n{i}" for i, n in enumerate(_N)), "coalesce(list_position(['A', 'N', 'R', 'X'], l_returnflag), 0) AS c0"])
_FAR = " + ".join([*(f"(q.n{i} - p.n{i}) * (q.n{i} - p.n{i})" for i in range(len(_N))), "2.0::DOUBLE * (q.c0 <> p.c0)::INT"])
_NAMES = ", ".join([*(f"n{i}" for i in range(len(_N))), "c0"])
_NEAR = lambda where: f"(SELECT {', '.join(f'q.{x}' for x in _NAMES.split(', '))}, round(sqrt(min({_FAR})), 9) AS distance FROM (SELECT DISTINCT {_NAMES} FROM asked) q, (SELECT DISTINCT {_POINT} FROM lineitem WHERE {where}) p GROUP BY ALL)"
_ASKED = f"WITH asked AS (SELECT {', '.join(IDS)}, {_POINT} FROM lineitem WHERE l_orderkey % 100 = 3)"


@query("nearest_rows", f"{_ASKED} SELECT {', '.join(IDS)}, distance FROM asked JOIN {_NEAR('l_orderkey % 2 = 0')} USING ({_NAMES})")
def nearest_rows(spark, sf_dir):
    """Of a stated hundredth of the other rows, how near the nearest private row is."""
    private, other = halves(spark, sf_dir)
    return closest.nearest(other.where("l_orderkey % 100 = 3"), private, ITEMS).select(*IDS, "distance")


@query("closer_share", f"{_ASKED} SELECT count(*) AS n, round(avg(CASE WHEN a.distance < b.distance THEN 1.0::DOUBLE WHEN a.distance = b.distance THEN 0.5 ELSE 0 END), 9) AS share FROM asked JOIN {_NEAR('l_orderkey % 4 = 0')} a USING ({_NAMES}) JOIN {_NEAR('l_orderkey % 4 = 2')} b USING ({_NAMES})")
def closer_share(spark, sf_dir):
    private, other = halves(spark, sf_dir)
    return closest.closer_share(other.where("l_orderkey % 100 = 3"), private.where("l_orderkey % 4 = 0"), private.where("l_orderkey % 4 = 2"), ITEMS)


_EVERY_ROW = f"WITH asked AS (SELECT {', '.join(IDS)}, {_POINT} FROM lineitem WHERE l_orderkey % 2 = 1)"


@query("closer_share_whole", f"{_EVERY_ROW} SELECT count(*) AS n, round(avg(CASE WHEN a.distance < b.distance THEN 1.0::DOUBLE WHEN a.distance = b.distance THEN 0.5 ELSE 0 END), 9) AS share FROM asked JOIN {_NEAR('l_orderkey % 4 = 0')} a USING ({_NAMES}) JOIN {_NEAR('l_orderkey % 4 = 2')} b USING ({_NAMES})")
def closer_share_whole(spark, sf_dir):
    """The share over every other row; `closer_share` states it of the hundredth that its SQL names."""
    private, other = halves(spark, sf_dir)
    return closest.closer_share(other, private.where("l_orderkey % 4 = 0"), private.where("l_orderkey % 4 = 2"), ITEMS)


@query("students")
def students_(spark, sf_dir):
    private, other = halves(spark, sf_dir)
    return students.students(other, private, ITEMS, seed=1)
