"""Equality saturation over the lines of orders, with SQL that knows what has to come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from sumforge.operators import saturation as S
from sumforge.sources.tables import table


def _alike(names):
    """same_as: the least name in the class of each."""
    least = names.groupBy("class").agg(F.min("name").alias("same_as"))
    return names.join(least, "class")


def _graph(nodes, names, **how):
    """A graph in which each class that names ask for is followed once, however many have it; and names."""
    roots = names.select("class").distinct()
    return S.graph(nodes, roots.select(F.col("class").alias("name"), "class"), **how), names


def _found(g, names):
    """names with the classes that they have in g now."""
    now = g.names().select(F.col("name").alias("root"), F.col("class").alias("now"))
    return names.join(now, names["class"] == now["root"]).select("name", F.col("now").alias("class"))


def congruence_closure(spark, d):
    """Orders as sums of lines, a line being a part with a flag; parts of one brand are equal. Which orders are then equal?"""
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    flags = table(spark, d, "lineitem").select("l_returnflag").distinct()
    top = parts.agg(F.max("p_partkey")).first()[0] + 1
    flags = flags.select("l_returnflag", (F.ascii("l_returnflag") + top).alias("flag"))  # one letter
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), "l_returnflag").join(F.broadcast(flags), "l_returnflag").drop("l_returnflag")
    first = parts.groupBy("p_brand").agg(F.min("p_partkey").alias("v"))
    equal = parts.join(first, "p_brand").select(F.col("p_partkey").alias("u"), "v")
    nodes, names = S.sums_of_products(lines, "l_orderkey", ["l_linenumber", "part", "flag"], ("part", "flag"), equal)
    g, names = _graph(nodes, names)
    return _alike(_found(g, names)).select(F.col("name").alias("l_orderkey"), "same_as")


def _saturated(spark, d, rules):
    """Each order as the sum of tax times discount, in hundredths, saturated by rules, with the least size and depth of its class; sums and products commute."""
    hundredths = [F.round(F.col(c) * 100).cast("int").alias(n) for c, n in (("l_tax", "a"), ("l_discount", "b"))]
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *hundredths)
    g, names = _graph(*S.sums_of_products(lines, "l_orderkey", ["l_linenumber", "a", "b"], ("a", "b"), commute=True), commutes=("add", "mul"), apart=True)
    g = S.saturate(g, rules)
    if g.stopped != "saturated":
        raise RuntimeError(f"stopped by {g.stopped} after {g.rounds} rounds")
    products = g.nodes.where("op = 'mul'").select("class").distinct().withColumn("product", F.lit(True))
    rows = _alike(_found(g, names)).join(products, "class", "left")
    costs = S.least_costs(g.nodes).groupBy("class").pivot("measure", list(S.MEASURES)).agg(F.max("cost"))
    rows = rows.join(costs, "class")
    return rows.select(F.col("name").alias("l_orderkey"), "same_as", F.coalesce("product", F.lit(False)).alias("product"), "size", "depth")


def saturation_factored(spark, d):
    """a + b = b + a, a b = b a, a b + a c = a (b + c): which orders are equal, which are products, and how short they get."""
    return _saturated(spark, d, S.FACTOR)


def saturation_zeros(spark, d):
    """a + b = b + a, a b = b a, a + 0 = a, a 0 = 0."""
    return _saturated(spark, d, S.ZERO)


QUERIES = {f.__name__: f for f in (congruence_closure, saturation_factored, saturation_zeros)}

_LINES = """lines AS (SELECT l_orderkey, least(a, b) AS lo, greatest(a, b) AS hi, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, a, b) AS k
  FROM (SELECT l_orderkey, l_linenumber, round(l_tax * 100)::INT AS a, round(l_discount * 100)::INT AS b FROM lineitem))"""
#: The first two terms of a sum can be exchanged, as there is no rule that moves brackets.
_SORTED = "CASE WHEN len(terms) > 1 THEN list_concat(list_sort(terms[:2]), terms[3:]) ELSE terms END"

ORACLE_SQL = {
    "congruence_closure": """WITH orders AS (SELECT l_orderkey, list((p_brand, l_returnflag) ORDER BY l_linenumber, l_partkey, l_returnflag) AS terms FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
SELECT l_orderkey, min(l_orderkey) OVER (PARTITION BY terms) AS same_as FROM orders""",
    "saturation_factored": f"""WITH RECURSIVE {_LINES},
shared AS (
  SELECT l_orderkey, k, [lo, hi] AS common FROM lines WHERE k = 1
  UNION ALL SELECT l.l_orderkey, l.k, list_filter(s.common, lambda x: x = l.lo OR x = l.hi) FROM shared s JOIN lines l ON l.l_orderkey = s.l_orderkey AND l.k = s.k + 1 WHERE len(list_filter(s.common, lambda x: x = l.lo OR x = l.hi)) > 0),
longest AS (SELECT l_orderkey, max(k) AS k FROM shared GROUP BY l_orderkey),
orders AS (SELECT l_orderkey, count(*) AS n, list(lo || '*' || hi ORDER BY k) AS terms FROM lines GROUP BY l_orderkey)
SELECT l_orderkey, min(l_orderkey) OVER (PARTITION BY {_SORTED}) AS same_as, n = k AS product, 2 * k + 1 + 4 * (n - k) AS size, n + 1 AS depth FROM orders JOIN longest USING (l_orderkey)""",
    "saturation_zeros": f"""WITH {_LINES}, orders AS (SELECT l_orderkey, coalesce(list(lo || '*' || hi ORDER BY k) FILTER (lo > 0), []) AS terms FROM lines GROUP BY l_orderkey)
SELECT l_orderkey, min(l_orderkey) OVER (PARTITION BY {_SORTED}) AS same_as, len(terms) < 2 AND (len(terms) = 1 OR EXISTS (SELECT 1 FROM lines WHERE lo = 0)) AS product,
  CASE WHEN len(terms) = 0 THEN 1 ELSE 4 * len(terms) - 1 END::BIGINT AS size, len(terms)::BIGINT + 1 AS depth FROM orders""",
}
