"""Queries on checks, emitted counts, orders and pairings, with the SQL that states the same results."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from hushtable.functions.bins import clipped_band, selection_bin, whole
from hushtable.operators import audit
from hushtable.plans.registry import query
from hushtable.plans.release import COHORTS, halves, IDS, items, ITEMS
from hushtable.sources.tables import read_table

#: A schema that line items break: edges too narrow, a flag not declared.
NARROW = replace(ITEMS, numeric={"l_quantity": (5, 15, 30, 45), "l_tax": (0.0, 0.025, 0.085)}, categorical={"l_returnflag": ("A", "N")})
_INNER = lambda c, e: "CASE " + " ".join(f"WHEN {c} >= {x} THEN '{i}'" for i, x in reversed(list(enumerate(e[1:-1], 1)))) + " ELSE '0' END" if len(e) > 2 else "'0'"


@query("schema_problems", "SELECT * FROM (SELECT 'l_quantity' AS col, 'outside' AS problem, count(*) FILTER (l_quantity < 5 OR l_quantity > 45) AS n FROM lineitem UNION ALL SELECT 'l_returnflag', 'undeclared', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem) WHERE n > 0")
def schema_problems(spark, sf_dir):
    return audit.problems(items(spark, sf_dir), NARROW)


_EMITTED = " UNION ALL ".join([*(f"SELECT l_returnflag AS cohort, l_linestatus = 'F' AS positive, '{c}' AS col, {_INNER(c, e)} AS bin FROM lineitem" for c, e in ITEMS.numeric.items()), "SELECT l_returnflag, l_linestatus = 'F', 'l_returnflag', l_returnflag FROM lineitem"])


@query("emitted_counts", f"SELECT cohort, positive, col, bin, count(*) AS n FROM ({_EMITTED}) GROUP BY ALL")
def emitted_counts(spark, sf_dir):
    return audit.emitted_counts(items(spark, sf_dir), ITEMS, COHORTS)


@query("marginal_shift", "WITH c AS (SELECT l_returnflag AS b, count(*) FILTER (l_orderkey % 2 = 0) AS x, count(*) FILTER (l_orderkey % 2 = 1) AS y FROM lineitem GROUP BY 1) SELECT round(sum(abs(x / tx - y / ty)) / 2, 9) AS shift FROM (SELECT x, y, sum(x) OVER () AS tx, sum(y) OVER () AS ty FROM c)")
def marginal_shift(spark, sf_dir):
    return audit.marginal_shift(*halves(spark, sf_dir), ITEMS)


@query("band_rates", "SELECT CASE WHEN l_quantity >= 5 AND l_quantity < 15 THEN '0' WHEN l_quantity >= 15 AND l_quantity < 30 THEN '1' WHEN l_quantity >= 30 AND l_quantity < 45 THEN '2' ELSE 'nan' END AS band, count(*) AS n, round(avg((l_linestatus = 'F')::INT), 9) AS rate FROM lineitem GROUP BY 1")
def band_rates(spark, sf_dir):
    return audit.band_rates(items(spark, sf_dir), NARROW, "l_quantity")


@query("declared_values", "SELECT 'l_returnflag' AS col, 2 AS declared, count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A', 'N')) AS seen, count(DISTINCT l_returnflag) FILTER (l_returnflag NOT IN ('A', 'N')) AS other FROM lineitem UNION ALL SELECT 'l_linestatus', 2, count(DISTINCT l_linestatus), 0 FROM lineitem")
def declared_values(spark, sf_dir):
    return audit.distinct_seen(items(spark, sf_dir), NARROW)


@query("clipped_bands", "SELECT coalesce(CASE WHEN v >= 5 AND v <= 15 THEN '0' WHEN v > 15 AND v <= 30 THEN '1' WHEN v > 30 THEN '2' END, 'none') AS band, count(*) AS n FROM (SELECT least(greatest(l_quantity, 5), 45) AS v FROM lineitem) GROUP BY 1")
def clipped_bands(spark, sf_dir):
    band = F.coalesce(clipped_band("l_quantity", NARROW.numeric["l_quantity"]), F.lit("none"))
    return items(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("visit_numbers", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS number FROM orders")
def visit_numbers(spark, sf_dir):
    orders = read_table(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderdate"])
    return audit.numbered(orders, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("chained_join", "SELECT l_orderkey, l_linenumber, c_mktsegment, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 45")
def chained_join(spark, sf_dir):
    """Inner joins in a chain on keys, as survey tables are put together; Spark broadcasts the small ones by their size."""
    read = lambda name, *c: read_table(spark, f"{sf_dir}/{name}.parquet", list(c))
    lines = read("lineitem", "l_orderkey", "l_linenumber", "l_quantity").where("l_quantity > 45")
    out = lines.join(read("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.join(read("customer", "c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return out.join(read("nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select("l_orderkey", "l_linenumber", "c_mktsegment", "n_name")


@query("left_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def left_join(spark, sf_dir):
    orders = read_table(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey"]).groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"))
    customers = read_table(spark, f"{sf_dir}/customer.parquet", ["c_custkey"])
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("extreme_prices", "(SELECT 'worst' AS side, p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5) UNION ALL (SELECT 'best', p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 5)")
def extreme_prices(spark, sf_dir):
    return audit.extremes(read_table(spark, f"{sf_dir}/part.parquet", ["p_partkey", "p_retailprice"]), "p_retailprice", "p_partkey", 5)


@query("neutral_names", f"SELECT {', '.join(IDS)}, l_quantity AS n1, CASE l_returnflag WHEN 'A' THEN 'v1' WHEN 'N' THEN 'v2' WHEN 'R' THEN 'v3' END AS k1 FROM lineitem")
def neutral_names(spark, sf_dir):
    df = items(spark, sf_dir).select(*IDS, "l_quantity", "l_returnflag")
    return audit.renamed(df, {"l_quantity": "n1", "l_returnflag": "k1"}, {"l_returnflag": {"A": "v1", "N": "v2", "R": "v3"}})


@query("whole_numbers", "SELECT l_orderkey, l_linenumber, regexp_replace(l_quantity::VARCHAR, '^(-?\\d+)\\.0$', '\\1') AS value FROM lineitem")
def whole_numbers(spark, sf_dir):
    df = read_table(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"])
    return df.select("l_orderkey", "l_linenumber", whole(F.col("l_quantity").cast("string")).alias("value"))


@query("flag_inclusion", "SELECT l_returnflag AS cohort, " + _INNER("l_quantity", ITEMS.numeric["l_quantity"]) + "::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def flag_inclusion(spark, sf_dir):
    return items(spark, sf_dir).groupBy(F.col("l_returnflag").alias("cohort"), selection_bin(F.col("l_quantity"), ITEMS.numeric["l_quantity"]).alias("bin")).agg(F.count("*").alias("n"))
