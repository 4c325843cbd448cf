"""Queries on whole assessments over line items, with the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushtable.operators import assess, decode, joint, select, stage
from hushtable.plans.registry import query
from hushtable.plans.release import _distance_sql, COHORTS, halves, IDS, items, ITEMS, PAIRS, SINGLES


def _order(seed):
    return f"md5(concat_ws('|', {', '.join(IDS)}, '{seed}')), {', '.join(IDS)}"


@query("permuted_target", f"WITH a AS (SELECT *, row_number() OVER (ORDER BY {_order(7)}) AS k FROM lineitem), b AS (SELECT l_linestatus, row_number() OVER (ORDER BY {_order(8)}) AS k FROM lineitem) SELECT {', '.join(f'a.{c}' for c in IDS)}, b.l_linestatus FROM a JOIN b USING (k)")
def permuted_target(spark, sf_dir):
    return assess.permuted(items(spark, sf_dir), "l_linestatus", IDS, 7).select(*IDS, "l_linestatus")


def _redrawn_sql(c, edges):
    last, u = len(edges) - 2, f"(('0x' || substr(md5(concat_ws('|', {', '.join(IDS)}, '{c}', '7')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    at = lambda ends: "CASE " + " ".join(f"WHEN {c} < {edges[i + 1]} THEN {ends[i]!r}::DOUBLE" for i in range(last)) + f" ELSE {ends[last]!r}::DOUBLE END"
    low, high = [float(e) for e in edges[:-1]], [float(e) for e in edges[1:]]
    if not all(float(e).is_integer() for e in edges):
        return f"round({at(low)} + {u} * ({at(high)} - {at(low)}), 9)"
    top = [*[e - 1 for e in high[:-1]], high[-1]]
    return f"round(least(floor({at(low)} + {u} * ({at(top)} - {at(low)} + 1)), {at(top)}), 9)"


@query("redrawn_values", f"SELECT {', '.join(IDS)}, {', '.join(f'{_redrawn_sql(c, e)} AS {c}' for c, e in ITEMS.numeric.items())} FROM lineitem")
def redrawn_values(spark, sf_dir):
    out = select.redraw(items(spark, sf_dir), ITEMS, IDS, 7)
    return out.select(*IDS, *[F.round(c, 9).alias(c) for c in ITEMS.numeric])


_MEAN = lambda rows, name: f"SELECT '{name}' AS measure, distance AS value FROM ({_distance_sql(rows)}) WHERE col = 'mean'"


@query("assessed_half", f"{_MEAN(SINGLES, 'one-way distance')} UNION ALL {_MEAN(PAIRS, 'two-way distance')} UNION ALL SELECT 'absent values', count(*)::DOUBLE FROM (SELECT unnest(['A', 'N', 'R', 'X']) AS v) WHERE v NOT IN (SELECT l_returnflag FROM lineitem WHERE l_orderkey % 2 = 1)")
def assessed_half(spark, sf_dir):
    return assess.measures(*halves(spark, sf_dir), ITEMS)


@query("jointly_drawn")
def jointly_drawn(spark, sf_dir):
    """Rows of the fitted distribution of greatest entropy, as many as a release's cohorts tell."""
    released = stage.release(items(spark, sf_dir), ITEMS, COHORTS, n_min=50, seed=1)
    n = int(released.cohorts["size"].sum())
    return decode.draw(spark, released, ITEMS, n, 7, joint.fit(released, ITEMS))
