"""Layout instances from the star-schema tables, by whole-number formulas.

``part`` gives the shapes (rectangle, right triangle, trapezoid), ``orders`` the jobs with their sheets, ``lineitem`` the
piece instances of each job and, by a running sum of widths, a layout of them. The text is plain SQL, so that Spark and
an oracle can read the same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.grid import point

PIECE = """SELECT CAST(p_partkey AS BIGINT) AS piece_id, p_name AS name, p_type AS type, CAST((20 + 3 * p_size) * 1000 AS BIGINT) AS w,
  CAST((10 + p_partkey % 41) * 1000 AS BIGINT) AS h, CAST(p_partkey % 3 AS BIGINT) AS kind FROM part"""
JOB = """SELECT CAST(o_orderkey AS BIGINT) AS job_id, o_orderstatus AS status, o_orderpriority AS priority,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN 300000 WHEN 1 THEN 600000 ELSE 2000000 END AS BIGINT) AS sheet_w,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN 300000 WHEN 1 THEN 400000 ELSE 2700000 END AS BIGINT) AS sheet_h FROM orders"""
INST = """SELECT CAST(l_orderkey AS BIGINT) AS job_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS ord,
  piece_id, name, kind, w, h, CAST(l_quantity AS BIGINT) AS qty, CAST(l_suppkey AS BIGINT) AS supp FROM lineitem JOIN piece ON l_partkey = piece_id"""
#: Pieces stand side by side and touch; a quantity above 45 pushes one 5 mm into its neighbour, one divisible by 7 lifts it by 2 mm.
LAYOUT = """SELECT job_id, ord, piece_id, kind, w, h, qty, supp,
  CAST(sum(w) OVER (PARTITION BY job_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w - CASE WHEN qty > 45 AND ord > 1 THEN 5000 ELSE 0 END AS BIGINT) AS x,
  CAST(CASE WHEN qty % 7 = 0 THEN 2000 ELSE 0 END AS BIGINT) AS y FROM inst"""
#: Candidate endpoints of jobs, with whole-number metrics.
ENDPOINT = """SELECT CAST(o_custkey AS BIGINT) AS job_id, CAST(o_orderkey AS BIGINT) AS endpoint_id, sha2(CAST(o_orderkey AS STRING), 256) AS hash,
  CAST(o_orderkey % 7 AS BIGINT) AS placed, CAST(o_totalprice AS BIGINT) AS material, CAST(o_orderkey % 4 AS BIGINT) AS cavities,
  CAST((o_orderkey * 37) % 1000 AS BIGINT) AS cavity_area, CAST(1000 + o_orderkey % 900 AS BIGINT) AS max_side, CAST((1000 + o_orderkey % 900) * (500 + (o_orderkey * 13) % 500) AS BIGINT) AS area,
  CAST(1500 + o_orderkey % 900 + (o_orderkey * 13) % 500 AS BIGINT) AS span, CAST((o_orderkey * 7) % 90 AS BIGINT) AS gap, CAST(100 + (o_orderkey * 3) % 400 AS BIGINT) AS hull,
  CAST((o_orderkey * 11) % 100 AS BIGINT) AS waste, CAST(o_orderkey % 5 AS BIGINT) AS isolated, CAST(1 + o_orderkey % 6 AS BIGINT) AS component_count, CAST(1 + (o_orderkey * 5) % 9 AS BIGINT) AS largest,
  CAST((o_orderkey * 17) % 300 AS BIGINT) AS contact, CAST((o_orderkey * 19) % 23 AS BIGINT) AS structural, CAST((o_orderkey * 29) % 11 AS BIGINT) AS dominant,
  o_orderpriority AS origin, o_orderstatus AS role FROM orders"""


def cte(*names: str) -> str:
    """WITH clause of the given relations in DuckDB's dialect."""
    text = {"piece": PIECE, "job": JOB, "inst": INST, "layout": LAYOUT, "endpoint": ENDPOINT.replace("sha2(CAST(o_orderkey AS STRING), 256)", "sha256(CAST(o_orderkey AS VARCHAR))")}
    need = {"inst": ["piece", "inst"], "layout": ["piece", "inst", "layout"]}
    order = dict.fromkeys(x for n in names for x in need.get(n, [n]))
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({text[n]})" for n in order)


class Instances:
    """The relations as DataFrames over the tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def piece(self) -> DataFrame:
        return self.spark.sql(PIECE.replace("FROM part", "FROM {part}"), part=self.table("part"))

    @property
    def job(self) -> DataFrame:
        return self.spark.sql(JOB.replace("FROM orders", "FROM {orders}"), orders=self.table("orders"))

    @property
    def inst(self) -> DataFrame:
        return self.spark.sql(INST.replace("FROM lineitem JOIN piece", "FROM {lineitem} JOIN {piece}"), lineitem=self.table("lineitem"), piece=self.piece)

    @property
    def layout(self) -> DataFrame:
        return self.spark.sql(LAYOUT.replace("FROM inst", "FROM {inst}"), inst=self.inst)

    @property
    def endpoint(self) -> DataFrame:
        # DuckDB's cast of a double rounds, halves to even; Spark's cuts
        text = ENDPOINT.replace("CAST(o_totalprice AS BIGINT)", "CAST(rint(o_totalprice) AS BIGINT)").replace("FROM orders", "FROM {orders}")
        return self.spark.sql(text, orders=self.table("orders"))


def with_ring(df: DataFrame) -> DataFrame:
    """Adds the vertices of (kind, w, h), counter-clockwise from (0, 0)."""
    z, w, h = F.lit(0).cast("long"), F.col("w"), F.col("h")
    q = F.expr("w div 4")
    rect = F.array(point(z, z), point(w, z), point(w, h), point(z, h))
    triangle = F.array(point(z, z), point(w, z), point(z, h))
    trapezoid = F.array(point(z, z), point(w, z), point(w - q, h), point(q, h))
    return df.withColumn("ring", F.when(F.col("kind") == 0, rect).when(F.col("kind") == 1, triangle).otherwise(trapezoid))
