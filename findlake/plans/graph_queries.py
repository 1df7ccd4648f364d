"""Graph queries over trade between nations seen as modules."""

from pyspark.sql import functions as F

from findlake.operators import graph, layers
from findlake.plans.registry import query
from findlake.plans.tables import table, trade_edges, trade_edges_sql
from findlake.session import materialize

CLOSURE_SQL = """
closure AS (
  SELECT src, dst FROM edges
  UNION
  SELECT c.src, e.dst FROM closure c JOIN edges e ON e.src = c.dst
)"""


@query(
    "dependents",
    f"""WITH RECURSIVE {trade_edges_sql()}, {CLOSURE_SQL}
SELECT DISTINCT dst AS start, src AS node FROM closure JOIN nation ON n_name = dst WHERE src <> dst AND n_nationkey % 7 = 1""",
)
def dependents(spark, sf_dir):
    edges = materialize(trade_edges(spark, sf_dir), "trade")
    changed = table(spark, sf_dir, "nation").where("n_nationkey % 7 = 1")
    starts = changed.select(F.lit("trade").alias("repo"), F.col("n_name").alias("start"), F.col("n_name").alias("node"))
    return graph.dependents(edges, starts, ["repo", "start"]).select("start", "node")


def _component_sql(across: bool = False) -> str:
    return f"""{trade_edges_sql(across)}, {CLOSURE_SQL},
mutual AS (SELECT a.src AS node, a.dst AS other FROM closure a JOIN closure b ON a.src = b.dst AND a.dst = b.src),
named AS (SELECT node, min(other) AS component, count(DISTINCT other) AS size FROM mutual GROUP BY node)"""


@query(
    "cycles",
    f"""WITH RECURSIVE {_component_sql()}
SELECT component, node, size, CASE WHEN size <= 2 THEN 'low' WHEN size = 3 THEN 'medium' ELSE 'high' END AS impact FROM named WHERE size >= 2""",
)
def cycles(spark, sf_dir):
    return graph.cycles(trade_edges(spark, sf_dir)).select("component", "node", "size", graph.cycle_impact(F.col("size")).alias("impact"))


@query(
    "cycles_dense",
    f"""WITH RECURSIVE {_component_sql(True)}
SELECT component, node, size FROM named WHERE size >= 2""",
)
def cycles_dense(spark, sf_dir):
    return graph.cycles(trade_edges(spark, sf_dir, across=True)).select("component", "node", "size")


@query(
    "shortest_cycle",
    f"""WITH RECURSIVE {_component_sql()},
walk AS (
  SELECT component, component AS here, [component] AS path, 0 AS steps FROM (SELECT DISTINCT component FROM named WHERE size >= 2)
  UNION ALL
  SELECT w.component, e.dst, list_append(w.path, e.dst), w.steps + 1
  FROM walk w JOIN edges e ON e.src = w.here JOIN named n ON n.node = e.dst AND n.component = w.component
  WHERE (w.steps = 0 OR w.here <> w.component) AND (e.dst = w.component OR NOT list_contains(w.path, e.dst))
)
SELECT component, array_to_string(min(path), '>') AS path FROM (
  SELECT component, path, rank() OVER (PARTITION BY component ORDER BY steps) AS r FROM walk WHERE steps > 0 AND here = component
) WHERE r = 1 GROUP BY component""",
)
def shortest_cycle(spark, sf_dir):
    edges = materialize(trade_edges(spark, sf_dir), "trade")
    found = graph.shortest_cycles(edges, graph.cycles(edges).select("repo", "component", "node"))
    return found.select("component", F.array_join("path", ">").alias("path"))


@query(
    "value_flow",
    f"""WITH RECURSIVE {trade_edges_sql()},
links AS (SELECT src, dst, CASE WHEN lines % 3 = 0 THEN 1 WHEN lines % 3 = 1 THEN 2 ELSE 3 END AS link FROM edges),
flow AS (
  SELECT DISTINCT src AS name, 3 AS certainty FROM edges WHERE src LIKE 'NATION_%5' OR src = 'NATION_0'
  UNION
  SELECT l.dst, least(f.certainty, l.link) FROM flow f JOIN links l ON l.src = f.name
)
SELECT name, CAST(max(certainty) AS INTEGER) AS certainty FROM flow GROUP BY name""",
)
def value_flow(spark, sf_dir):
    edges = materialize(trade_edges(spark, sf_dir).withColumn("file", F.lit("trade")), "trade")
    left = F.col("lines") % 3
    links = edges.select("repo", "file", F.col("src").alias("source"), F.col("dst").alias("name"), F.when(left == 0, 1).when(left == 1, 2).otherwise(3).alias("certainty"))
    seeds = edges.where("src LIKE 'NATION_%5' OR src = 'NATION_0'").select("repo", "file", F.col("src").alias("name"), F.lit(3).alias("certainty"))
    return graph.value_flow(seeds, links).select("name", "certainty")


LAYER_NAMES = ["core-model", "use-cases", "api gateways", "infra", "web-views", "misc", "domain ui"]


@query(
    "layer_violations",
    f"""WITH {trade_edges_sql()},
layer_of(k, layer, pos) AS (VALUES (0, 'domain', 0), (1, 'application', 1), (2, 'adapter', 2), (3, 'infrastructure', 3), (4, 'presentation', 4)),
assigned AS (SELECT n_name AS name, layer, pos FROM nation JOIN layer_of ON k = n_nationkey % 7)
SELECT e.src, e.dst, a.layer AS src_layer, b.layer AS dst_layer, sum(lines)::BIGINT AS evidence
FROM edges e JOIN assigned a ON a.name = e.src JOIN assigned b ON b.name = e.dst WHERE a.pos < b.pos GROUP BY 1, 2, 3, 4""",
)
def layer_violations(spark, sf_dir):
    edges = trade_edges(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in LAYER_NAMES])
    modules = table(spark, sf_dir, "nation").select(
        F.lit("trade").alias("repo"), F.col("n_name").alias("module"), F.element_at(names, (F.col("n_nationkey") % 7 + 1).cast("int")).alias("name")
    )
    found = layers.violations(edges.withColumn("evidence_count", F.col("lines")), layers.assign(modules))
    return found.select("src", "dst", "src_layer", "dst_layer", "evidence")
