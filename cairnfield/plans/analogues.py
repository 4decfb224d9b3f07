"""Frames of the damage-assessment model, derived from the star-schema tables.

Each has a Spark form and, under the same name in ``SQL``, a DuckDB form for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import columns as C
from cairnfield.sources.tables import table, widened

EXTENT, CELL = 10_000.0, 500.0


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return widened(table(spark, sf_dir, name))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile catalogue: customers by nation (event) and region (disaster type)."""
    nation = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    event = F.concat(F.lower("n_name"), F.lit("-"), F.lower("r_name"))
    places = nation.select("n_nationkey", event.alias("event_id"), F.lower("r_name").alias("disaster_type"))
    rows = load(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.concat("event_id", F.lit("_"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("tile_id"),
        "event_id",
        "disaster_type",
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("value"),
        F.col("c_custkey").alias("ordinal"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pixels: four logits, their truth and an event."""
    e = load(spark, sf_dir, "embeddings")
    logits = F.array(*[F.get("embedding", i).cast("double") for i in range(4)])
    return e.select("vec_id", (F.col("vec_id") % 8).alias("event_id"), (F.col("label") % 4).alias("target"), logits.alias("logits"))


def scored_buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings with three logits and their truth."""
    e = load(spark, sf_dir, "embeddings")
    logits = F.array(*[F.get("embedding", i).cast("double") for i in range(3)])
    return e.select("vec_id", (F.col("vec_id") % 8).alias("event_id"), (F.col("label") % 3).alias("target"), logits.alias("logits"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building points in metres with probabilities of intact, damaged and destroyed."""
    key = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(
        key.alias("building_id"),
        (EXTENT * C.uniform("x", key)).alias("x"),
        (EXTENT * C.uniform("y", key)).alias("y"),
        F.array(*[4 * C.uniform(f"p{i}", key) for i in range(3)]).alias("logits"),
    )
    rows = rows.withColumn("p", C.softmax(F.col("logits")))
    return rows.select(
        "building_id", "x", "y", F.col("p")[0].alias("p_intact"), F.col("p")[1].alias("p_damaged"), F.col("p")[2].alias("p_destroyed")
    )


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of population pixels with their counts."""
    key = F.col("event_id")
    return load(spark, sf_dir, "events").select(
        key.alias("pixel_id"), (EXTENT * C.uniform("px", key)).alias("x"), (EXTENT * C.uniform("py", key)).alias("y"), F.col("value")
    )


def junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road nodes: suppliers at positions rounded to millimetres."""
    key = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").select(
        key.alias("node"),
        F.col("s_nationkey").alias("nation"),
        F.round(EXTENT * C.uniform("sx", key), 3).alias("x"),
        F.round(EXTENT * C.uniform("sy", key), 3).alias("y"),
        (key % 7 == 0).alias("facility"),
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight roads: from each supplier to the next of its nation, and to one drawn at random."""
    from pyspark.sql import Window

    nodes = junctions(spark, sf_dir)
    following = F.lead("node").over(Window.partitionBy("nation").orderBy("node"))
    chain = nodes.select(F.col("node").alias("src"), following.alias("dst")).where("dst IS NOT NULL")
    n = nodes.count()
    drawn = nodes.select(F.col("node").alias("src"), F.floor(C.uniform("link", F.col("node")) * n).cast("long").alias("dst")).where("src <> dst")
    both = chain.withColumn("road_id", F.col("src") * 2).union(drawn.withColumn("road_id", F.col("src") * 2 + 1))
    a = nodes.select(F.col("node").alias("src"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = nodes.select(F.col("node").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return both.join(a, "src").join(b, "dst").select("road_id", "src", "dst", "ax", "ay", "bx", "by")


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreground pixels of a label mask: parts laid out in rows of 40, tiles of 40 rows."""
    key = F.col("p_partkey")
    rows = load(spark, sf_dir, "part").where("p_size > 25")
    return rows.select(F.floor(key / 1600).cast("long").alias("tile_id"), (F.floor(key / 40) % 40).cast("int").alias("row"), (key % 40).cast("int").alias("col"), F.lit(1).alias("label"))


def component_pixels(spark: SparkSession, sf_dir: str, place: bool = False) -> DataFrame:
    """Pixels of components: line items of an order, their class from flag and status, and logits.

    ``place``: with file and row, the order in which the table holds them.
    """
    cls = F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_linestatus") == "F", 1).otherwise(2)
    more = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if place else []
    return widened(table(spark, sf_dir, "lineitem").select("*", *more)).select(
        *["file", "row"][: len(more)],
        F.col("l_orderkey").alias("component"),
        cls.alias("label"),
        F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50).alias("logits"),
    )


def _u(tag: str, key: str) -> str:
    return f"(CAST(('0x' || substr(md5('{tag}:' || {key}), 1, 8)) AS UBIGINT) / 4294967296.0)"


def sql_uniform(tag_sql: str) -> str:
    """Of a SQL text expression."""
    return f"(CAST(('0x' || substr(md5({tag_sql}), 1, 8)) AS UBIGINT) / 4294967296.0)"


def _softmax_sql(values: str, n: int, temperature: str = "1.0") -> str:
    es = [f"exp(({values}[{i}] - list_max({values})) / {temperature})" for i in range(1, n + 1)]
    return "[" + ", ".join(f"{e} / ({' + '.join(es)})" for e in es) + "]"


softmax_sql = _softmax_sql

SQL = {
    "tiles": """tiles AS (
  SELECT lower(n_name) || '-' || lower(r_name) || '_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS tile_id,
    lower(n_name) || '-' || lower(r_name) AS event_id, lower(r_name) AS disaster_type,
    c_mktsegment AS segment, c_acctbal AS value, c_custkey AS ordinal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "pixels": """pixels AS (
  SELECT vec_id, vec_id % 8 AS event_id, label % 4 AS target,
    [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE), CAST(embedding[4] AS DOUBLE)] AS logits
  FROM embeddings)""",
    "scored_buildings": """scored_buildings AS (
  SELECT vec_id, vec_id % 8 AS event_id, label % 3 AS target,
    [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE), CAST(embedding[3] AS DOUBLE)] AS logits
  FROM embeddings)""",
    "buildings": f"""raw_buildings AS (
  SELECT o_orderkey AS building_id, {EXTENT} * {_u('x', 'o_orderkey')} AS x, {EXTENT} * {_u('y', 'o_orderkey')} AS y,
    [4 * {_u('p0', 'o_orderkey')}, 4 * {_u('p1', 'o_orderkey')}, 4 * {_u('p2', 'o_orderkey')}] AS z FROM orders),
buildings AS (
  SELECT building_id, x, y, p[1] AS p_intact, p[2] AS p_damaged, p[3] AS p_destroyed
  FROM (SELECT *, {_softmax_sql('z', 3)} AS p FROM raw_buildings))""",
    "population": f"""population AS (
  SELECT event_id AS pixel_id, {EXTENT} * {_u('px', 'event_id')} AS x, {EXTENT} * {_u('py', 'event_id')} AS y, value FROM events)""",
    "junctions": f"""junctions AS (
  SELECT s_suppkey AS node, s_nationkey AS nation, round({EXTENT} * {_u('sx', 's_suppkey')}, 3) AS x,
    round({EXTENT} * {_u('sy', 's_suppkey')}, 3) AS y, s_suppkey % 7 = 0 AS facility FROM supplier)""",
    "roads": f"""links AS (
  SELECT node AS src, lead(node) OVER (PARTITION BY nation ORDER BY node) AS dst, node * 2 AS road_id FROM junctions
  UNION ALL
  SELECT node, CAST(floor({_u('link', 'node')} * (SELECT count(*) FROM junctions)) AS BIGINT), node * 2 + 1 FROM junctions),
roads AS (
  SELECT road_id, src, dst, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by"
  FROM links JOIN junctions a ON src = a.node JOIN junctions b ON dst = b.node WHERE src <> dst)""",
    "mask": """mask AS (
  SELECT CAST(p_partkey // 1600 AS BIGINT) AS tile_id, CAST((p_partkey // 40) % 40 AS INTEGER) AS "row", CAST(p_partkey % 40 AS INTEGER) AS col
  FROM part WHERE p_size > 25)""",
    "component_pixels": """component_pixels AS (
  SELECT l_orderkey AS component, CASE WHEN l_returnflag = 'N' THEN 0 WHEN l_linestatus = 'F' THEN 1 ELSE 2 END AS label,
    [l_discount * 10, l_tax * 10, l_quantity / 50] AS logits FROM lineitem)""",
}


def with_sql(*names: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)
