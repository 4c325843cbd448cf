"""Queries of the release pipeline over line items: cohorts by return flag, the line status as target."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from hushtable.functions.bins import Schema
from hushtable.operators import correct, counts, decode, distances, ranks, scores, select, stage
from hushtable.plans.registry import query
from hushtable.sources import generated
from hushtable.sources.tables import read_table

ITEMS = Schema(
    numeric={"l_quantity": (1, 11, 21, 31, 41, 51), "l_discount": (0.0, 0.025, 0.055, 0.105), "l_tax": (0.0, 0.025, 0.085)},
    categorical={"l_returnflag": ("A", "N", "R", "X")},
    target="l_linestatus", positive="F", negative="O", stratify="l_returnflag",
    levels=(("l_returnflag",), ("l_quantity",), ("l_returnflag", "l_quantity")),
)
COHORTS = ["A", "N", "R", "X"]
IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
CELL = ("l_returnflag", "l_quantity")
NEEDED = [*IDS, *ITEMS.numeric, "l_returnflag", "l_linestatus"]


def items(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/lineitem.parquet", NEEDED)


def halves(spark, sf_dir):
    df = items(spark, sf_dir)
    return df.where("l_orderkey % 2 = 0"), df.where("l_orderkey % 2 = 1")


def _histogram_sql(c, edges):
    last = len(edges) - 2
    return "CASE " + " ".join(f"WHEN {c} >= {edges[i]} AND {c} {'<=' if i == last else '<'} {edges[i + 1]} THEN '{i}'" for i in range(last + 1)) + " END"


def _band_sql(c, edges):
    return "CASE " + " ".join(f"WHEN {c} {'>=' if i == 0 else '>'} {edges[i]} AND {c} <= {edges[i + 1]} THEN '{i}'" for i in range(len(edges) - 1)) + " ELSE 'nan' END"


def _cell_sql(c):
    if c not in ITEMS.numeric:
        return f"'{c}=' || {c}"
    edges = ITEMS.numeric[c]
    return "CASE " + " ".join(f"WHEN {c} < {edges[i + 1]} THEN '{ITEMS.cells(c)[i]}'" for i in range(len(edges) - 2)) + f" ELSE '{ITEMS.cells(c)[-1]}' END"


CLIPPED = "(SELECT l_returnflag, l_linestatus, " + ", ".join(f"least(greatest({c}, {e[0]}), {e[-1]}) AS {c}" for c, e in ITEMS.numeric.items()) + " FROM lineitem WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ITEMS.numeric) + ") t"
DOMAIN = " UNION ALL ".join(f"SELECT cohort, '{c}' AS col, unnest([{', '.join(repr(b) for b in ITEMS.bins(c))}]) AS bin FROM (SELECT unnest({COHORTS}) AS cohort)" for c in [*ITEMS.numeric, *ITEMS.categorical])
LONG = " UNION ALL ".join([*(f"SELECT l_returnflag AS cohort, '{c}' AS col, {_histogram_sql(c, e)} AS bin FROM {CLIPPED}" for c, e in ITEMS.numeric.items()), f"SELECT l_returnflag, 'l_returnflag', l_returnflag FROM {CLIPPED}"])
DENSE = f"SELECT d.cohort, d.col, d.bin, coalesce(c.n, 0) AS n FROM ({DOMAIN}) d LEFT JOIN (SELECT cohort, col, bin, count(*) AS n FROM ({LONG}) GROUP BY ALL) c USING (cohort, col, bin)"
BANDS = lambda where: " UNION ALL ".join([*(f"SELECT '{c}' AS col, {_band_sql(c, e)} AS bin, l_linestatus = 'F' AS positive FROM lineitem {where}" for c, e in ITEMS.numeric.items()), f"SELECT 'l_returnflag', l_returnflag, l_linestatus = 'F' FROM lineitem {where}"])
CELLS = lambda where: " UNION ALL ".join(f"SELECT {i} AS level, {" || ' & ' || ".join(_cell_sql(c) for c in level)} AS cell, l_linestatus = 'F' AS positive FROM lineitem {where}" for i, level in enumerate(ITEMS.levels))
CELL_DOMAIN = " UNION ALL ".join(
    f"SELECT {i} AS level, {" || ' & ' || ".join(f'c{k}' for k in range(len(level)))} AS cell FROM " + ", ".join(f"(SELECT unnest([{', '.join(repr(b) for b in ITEMS.cells(c))}]) AS c{k}) AS d{k}" for k, c in enumerate(level))
    for i, level in enumerate(ITEMS.levels)
)


@query("dense_histogram", DENSE)
def dense_histogram(spark, sf_dir):
    return counts.dense_histogram(items(spark, sf_dir), ITEMS, COHORTS)


@query("class_balance", f"SELECT cohort, coalesce(n, 0) AS n, coalesce(p, 0) AS positives, round(p / n, 5) AS share FROM (SELECT unnest({COHORTS}) AS cohort) LEFT JOIN (SELECT l_returnflag AS cohort, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS p FROM {CLIPPED} GROUP BY 1) USING (cohort)")
def class_balance(spark, sf_dir):
    return counts.class_balance(items(spark, sf_dir), ITEMS, COHORTS)


CENTRES = " UNION ALL ".join(f"SELECT '{c}' AS col, '{i}' AS bin, {(e[i] + e[i + 1]) / 2}::DOUBLE AS m" for c, e in ITEMS.numeric.items() for i in range(len(e) - 1))


@query("histogram_moments", f"SELECT cohort, col, round(sum(n * m) / sum(n), 3) AS mean, round(sqrt(greatest(sum(n * m * m) / sum(n) - (sum(n * m) / sum(n)) ** 2, 0)), 3) AS std FROM ({DENSE}) JOIN ({CENTRES}) USING (col, bin) GROUP BY 1, 2 HAVING sum(n) > 0")
def histogram_moments(spark, sf_dir):
    return counts.histogram_moments(items(spark, sf_dir), ITEMS, COHORTS)


@query("cell_rates", f"SELECT d.level, d.cell, coalesce(n, 0) AS support, coalesce(p, 0) AS positives, round(p / n, 5) AS rate FROM ({CELL_DOMAIN}) d LEFT JOIN (SELECT level, cell, count(*) AS n, count(*) FILTER (positive) AS p FROM ({CELLS('')}) GROUP BY 1, 2) USING (level, cell)")
def cell_rates(spark, sf_dir):
    return counts.cell_rates(items(spark, sf_dir), ITEMS)


@query("mutual_information", f"WITH r AS ({BANDS('')}), j AS (SELECT col, bin, positive, count(*) AS n FROM r GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY col, bin) AS nb, sum(n) OVER (PARTITION BY col, positive) AS nc, sum(n) OVER (PARTITION BY col) AS nt FROM j) SELECT col, round(sum(n / nt * ln(n * nt / (nb * nc))), 9) AS mi FROM x GROUP BY col")
def mutual_information(spark, sf_dir):
    return counts.mutual_information(items(spark, sf_dir), ITEMS)


def _distance_sql(rows, means="SELECT 'mean', round(avg(d), 9) FROM d"):
    """Distances between the halves of what `rows` gives for a condition, and their means."""
    side = lambda half, name: f"SELECT col, bin, count(*) / sum(count(*)) OVER (PARTITION BY col) AS {name} FROM ({rows(f'WHERE l_orderkey % 2 = {half}')}) GROUP BY 1, 2"
    return f"WITH a AS ({side(0, 'p')}), b AS ({side(1, 'q')}), d AS (SELECT col, sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2 AS d FROM a FULL JOIN b USING (col, bin) GROUP BY col) SELECT col, round(d, 9) AS distance FROM d UNION ALL {means}"


_NAMES = [*ITEMS.numeric, *ITEMS.categorical, ITEMS.target]
_BAND = {c: _band_sql(c, ITEMS.numeric[c]) if c in ITEMS.numeric else c for c in _NAMES}
SINGLES = lambda where: " UNION ALL ".join(f"SELECT '{c}' AS col, {_BAND[c]} AS bin FROM lineitem {where}" for c in _NAMES)
PAIRS = lambda where: " UNION ALL ".join(f"SELECT '{a}|{b}' AS col, {_BAND[a]} || '|' || {_BAND[b]} AS bin FROM lineitem {where}" for a, b in combinations(_NAMES, 2))


@query("one_way_distance", _distance_sql(SINGLES))
def one_way_distance(spark, sf_dir):
    return counts.one_way_distance(*halves(spark, sf_dir), ITEMS)


@query("two_way_distance", _distance_sql(PAIRS))
def two_way_distance(spark, sf_dir):
    return counts.two_way_distance(*halves(spark, sf_dir), ITEMS)


@query("conditional_error", f"WITH a AS (SELECT level, cell, avg(positive::INT) AS p FROM ({CELLS('WHERE l_orderkey % 2 = 0')}) GROUP BY 1, 2), b AS (SELECT level, cell, avg(positive::INT) AS q FROM ({CELLS('WHERE l_orderkey % 2 = 1')}) GROUP BY 1, 2) SELECT level, count(*) AS cells, round(avg(abs(p - q)), 9) AS error FROM a JOIN b USING (level, cell) GROUP BY level")
def conditional_error(spark, sf_dir):
    return counts.conditional_error(*halves(spark, sf_dir), ITEMS)


@query("absent_categories", "SELECT 'l_returnflag' AS col, v AS value FROM (SELECT unnest(['A', 'N', 'R', 'X']) AS v) WHERE v NOT IN (SELECT l_returnflag FROM lineitem)")
def absent_categories(spark, sf_dir):
    return counts.absent_categories(items(spark, sf_dir), ITEMS)


@query("noisy_histogram")
def noisy_histogram(spark, sf_dir):
    return counts.noisy_histogram(items(spark, sf_dir), ITEMS, COHORTS, 2.0, 1).select("cohort", "col", "bin", F.round("share", 6).alias("share"))


_WORKLOAD = {c: f"CASE WHEN {c} IS NULL THEN '0' " + " ".join(f"WHEN {c} < {e[i + 1]} THEN '{i}'" for i in range(len(e) - 2)) + f" ELSE '{len(e) - 2}' END" for c, e in ITEMS.numeric.items()}
_WORKLOAD |= {c: f"coalesce({c}, 'nan')" for c in [*ITEMS.categorical, ITEMS.target]}
TRIPLES = lambda where: " UNION ALL ".join(f"SELECT '{'|'.join(t)}' AS col, {" || '|' || ".join(_WORKLOAD[c] for c in t)} AS bin FROM lineitem {where}" for t in combinations(_WORKLOAD, 3))


@query("three_way_distance", _distance_sql(TRIPLES, f"SELECT 'mean', round(avg(d), 9) FROM d UNION ALL SELECT 'mean with target', round(avg(d), 9) FROM d WHERE list_contains(string_split(col, '|'), '{ITEMS.target}')"))
def three_way_distance(spark, sf_dir):
    return distances.k_way_distance(*halves(spark, sf_dir), ITEMS, 3)


_KEY = " || ' & ' || ".join(_cell_sql(c) for c in CELL)


@query("conditional_distance", f"WITH r AS (SELECT {_KEY} AS cell, l_linestatus = 'F' AS positive, l_orderkey % 2 AS half FROM lineitem), a AS (SELECT cell, count(*) AS n, avg(positive::INT) AS p FROM r WHERE half = 0 GROUP BY 1 HAVING count(*) >= 30), b AS (SELECT cell, avg(positive::INT) AS q FROM r WHERE half = 1 GROUP BY 1) SELECT cell, round(n / sum(n) OVER (), 9) AS weight, round(abs(p - coalesce(q, 0)), 9) AS distance FROM a LEFT JOIN b USING (cell)")
def conditional_distance(spark, sf_dir):
    return distances.conditional_distance(*halves(spark, sf_dir), ITEMS, CELL)


MATCH = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query("exact_matches", f"SELECT l_orderkey, l_linenumber FROM lineitem x WHERE l_orderkey % 2 = 1 AND EXISTS (SELECT 1 FROM (SELECT DISTINCT {', '.join(MATCH)} FROM lineitem WHERE l_orderkey % 2 = 0) y WHERE {' AND '.join(f'x.{c} IS NOT DISTINCT FROM y.{c}' for c in MATCH)})")
def exact_matches(spark, sf_dir):
    private, other = halves(spark, sf_dir)
    return distances.exact_matches(private, other, MATCH).select("l_orderkey", "l_linenumber")


@query("pool_coverage", "WITH s AS (SELECT l_returnflag AS cohort, count(*) AS size FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1), h AS (SELECT l_returnflag AS cohort, count(*) AS have FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1) SELECT cohort, round(size * 1000 / sum(size) OVER (), 6) AS owed, coalesce(have, 0) AS have, round(coalesce(have, 0) / (size * 1000 / sum(size) OVER ()), 6) AS ratio FROM s LEFT JOIN h USING (cohort)")
def pool_coverage(spark, sf_dir):
    private, pool = halves(spark, sf_dir)
    sizes = private.groupBy(F.col("l_returnflag").alias("cohort")).agg(F.count("*").alias("size"))
    return distances.pool_coverage(pool, sizes, "l_returnflag", 1000)


_HASH = f"md5(concat_ws('|', {', '.join(IDS)}, '7'))"


@query("holdout_split", f"SELECT {', '.join(IDS)}, row_number() OVER (PARTITION BY l_linestatus ORDER BY {_HASH}, {', '.join(IDS)}) <= floor(count(*) OVER (PARTITION BY l_linestatus) * 0.2) AS held_out FROM lineitem")
def holdout_split(spark, sf_dir):
    return ranks.holdout_split(items(spark, sf_dir), "l_linestatus", 0.2, IDS, 7).select(*IDS, "held_out")


@query("exact_sample", f"SELECT {', '.join(IDS)} FROM lineitem ORDER BY {_HASH}, {', '.join(IDS)} LIMIT 1000")
def exact_sample(spark, sf_dir):
    return ranks.sample_exactly(items(spark, sf_dir), 1000, IDS, 7).select(*IDS)


@query("apportionment", "WITH s AS (SELECT l_returnflag AS cohort, count(*) AS size FROM lineitem GROUP BY 1), e AS (SELECT *, size * 1000.0::DOUBLE / sum(size) OVER () AS x FROM s) SELECT cohort, size, (floor(x) + (row_number() OVER (ORDER BY floor(x) - x, cohort) <= 1000 - sum(floor(x)) OVER ())::INT)::BIGINT AS quota FROM e")
def apportionment(spark, sf_dir):
    sizes = items(spark, sf_dir).groupBy(F.col("l_returnflag").alias("cohort")).agg(F.count("*").alias("size"))
    return ranks.apportion(sizes, "cohort", "size", 1000)


@query("relabelled", f"WITH r AS (SELECT *, {_KEY} AS cell FROM lineitem), t AS (SELECT cell, round(avg((l_linestatus = 'F')::INT), 5) AS rate FROM r WHERE l_orderkey % 2 = 0 GROUP BY 1 HAVING count(*) >= 30), s AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {_HASH}, {', '.join(IDS)}) AS k, count(*) OVER (PARTITION BY cell) AS n FROM r WHERE l_orderkey % 2 = 1) SELECT {', '.join(IDS)}, CASE WHEN rate IS NULL THEN l_linestatus WHEN k <= floor(rate * n) + (('0x' || substr(md5(cell || '|7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < rate * n - floor(rate * n))::INT THEN 'F' ELSE 'O' END AS l_linestatus FROM s LEFT JOIN t USING (cell)")
def relabelled(spark, sf_dir):
    private, other = halves(spark, sf_dir)
    rows = correct.with_cell(private, ITEMS, CELL).groupBy("cell").agg(F.count("*").alias("n"), F.round(F.avg((F.col("l_linestatus") == "F").cast("int")), 5).alias("rate")).where("n >= 30")
    return correct.relabel(other, rows, ITEMS, CELL, IDS, 7).select(*IDS, "l_linestatus")


@query("released_cells")
def released_cells(spark, sf_dir):
    return stage.release(items(spark, sf_dir), ITEMS, COHORTS, n_min=50, seed=1).tables(spark)["cells"]


@query("selected_rows")
def selected_rows(spark, sf_dir):
    private, pool = halves(spark, sf_dir)
    released = stage.release(private, ITEMS, COHORTS, n_min=50, seed=1)
    return select.select_to_release(pool, released, ITEMS, 500, IDS, 7)


@query("rate_bounds")
def rate_bounds(spark, sf_dir):
    private, other = halves(spark, sf_dir)
    table = correct.conditional_table(private, ITEMS, ("l_quantity",), 2.0, n_min=50, seed=1)
    floor = other.withColumn("l_linestatus", F.when(ranks.unit_hash(ranks.order_key(IDS, 7)) < 0.5, "F").otherwise("O"))
    return correct.bounds(private, {"synthetic": other, "floor": floor}, table, ITEMS, ("l_quantity",), 2.0, n_min=50, seed=1)


@query("decoded_rows")
def decoded_rows(spark, sf_dir):
    return decode.decode(spark, stage.release(items(spark, sf_dir), ITEMS, COHORTS, n_min=50, seed=1), ITEMS, 500, seed=7)


_FIT = " AND ".join(f"{c} BETWEEN {e[0]} AND {e[-1]}" for c, e in ITEMS.numeric.items())


@query("parsed_rows", f"SELECT l_orderkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R', 'X') AND l_linestatus IN ('F', 'O') AND {_FIT}")
def parsed_rows(spark, sf_dir):
    """Each line item as a text of its own, with a header, and read back."""
    names = [*ITEMS.numeric, *ITEMS.categorical, ITEMS.target]
    text = F.concat(F.lit("Here it is:\n" + ",".join(names) + "\n"), F.concat_ws(",", *names), F.lit("\nthat is all"))
    return generated.parse_generated(items(spark, sf_dir).select("l_orderkey", text.alias("text")), ITEMS, key="l_orderkey")


@query("quantity_auc", "WITH c AS (SELECT l_quantity AS s, count(*) FILTER (l_linestatus = 'F') AS pos, count(*) FILTER (l_linestatus <> 'F') AS neg FROM lineitem WHERE l_quantity IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1), r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT round(sum(pos * (before + neg / 2)) / (sum(pos)::DOUBLE * sum(neg)), 9) AS auc, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives FROM r")
def quantity_auc(spark, sf_dir):
    return scores.auc(items(spark, sf_dir), F.col("l_quantity"), F.col("l_linestatus") == "F")
