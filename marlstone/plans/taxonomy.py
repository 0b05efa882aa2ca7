"""Queries of the graph operators; nations stand for a taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.labels import ground_truth
from marlstone.operators import graph, matching, metrics
from marlstone.plans.registry import query
from marlstone.session import table


def _edge(parent, child, seq) -> list:
    return [parent.alias("parent"), child.alias("child"), seq.cast("long").alias("edge_seq")]


def _n(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def inner_edges(spark: SparkSession, d: str) -> DataFrame:
    region = table(spark, d, "region").select(*_edge(F.lit("root"), _n("r", "r_regionkey"), F.col("r_regionkey")))
    nation = table(spark, d, "nation").select(*_edge(_n("r", "n_regionkey"), _n("n", "n_nationkey"), F.col("n_nationkey") + 100))
    return region.unionByName(nation)


def customer_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(*_edge(_n("n", "c_nationkey"), _n("c", "c_custkey"), F.col("c_custkey") + 1000))


def supplier_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(*_edge(_n("n", "s_nationkey"), _n("s", "s_suppkey"), F.col("s_suppkey") + 1000))


_INNER = """inner_edges AS (
  SELECT 'root' AS parent, 'r' || r_regionkey AS child, CAST(r_regionkey AS BIGINT) AS edge_seq FROM region
  UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, CAST(n_nationkey + 100 AS BIGINT) FROM nation
)"""
_CUSTOMERS = "edges AS (SELECT * FROM inner_edges UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey + 1000 FROM customer)"
_SUPPLIERS = "edges AS (SELECT * FROM inner_edges UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_suppkey + 1000 FROM supplier)"
_CLOSURE = """walks AS (
  SELECT node, node AS ancestor, 0 AS depth FROM (SELECT child AS node FROM edges UNION SELECT parent FROM edges)
  UNION ALL SELECT w.node, e.parent, w.depth + 1 FROM walks w JOIN edges e ON w.ancestor = e.child
), closure AS (SELECT node, ancestor, min(depth) AS min_depth, max(depth) AS max_depth FROM walks GROUP BY node, ancestor)"""
_COUNTS = "SELECT ancestor, CAST(count(*) AS BIGINT) AS n_nodes, CAST(max(max_depth) AS INTEGER) AS height FROM closure GROUP BY ancestor"


def _counts(closure: DataFrame) -> DataFrame:
    return closure.groupBy("ancestor").agg(F.count("*").alias("n_nodes"), F.max("max_depth").alias("height"))


@query(f"WITH RECURSIVE {_INNER}, {_CUSTOMERS}, {_CLOSURE} {_COUNTS}")
def closure_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(graph.ancestor_closure(inner_edges(spark, d).unionByName(customer_edges(spark, d))))


@query(
    "WITH RECURSIVE edges AS (SELECT DISTINCT 'root' AS parent, 'b' || p_brand AS child FROM part UNION ALL SELECT DISTINCT 'root', 't' || p_type FROM part "
    "UNION ALL SELECT 'b' || p_brand, 'p' || p_partkey FROM part UNION ALL SELECT 't' || p_type, 'p' || p_partkey FROM part), " + f"{_CLOSURE} {_COUNTS}"
)
def dag_closure_multi_parent(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    brand, kind, own = _n("b", "p_brand"), _n("t", "p_type"), _n("p", "p_partkey")
    zero = F.lit(0)
    low = part.select(*_edge(brand, own, zero)).unionByName(part.select(*_edge(kind, own, zero)))
    high = part.select(brand.alias("child")).distinct().unionByName(part.select(kind.alias("child")).distinct()).select(*_edge(F.lit("root"), F.col("child"), zero))
    return _counts(graph.ancestor_closure(high.unionByName(low)))


def _customer_pairs(spark: SparkSession, d: str) -> DataFrame:
    guess = F.when(F.col("c_custkey") % 11 != 0, F.concat(F.lit("n"), ((F.col("c_nationkey") * 7 + F.col("c_custkey")) % 25).cast("string")))
    return table(spark, d, "customer").select("c_custkey", _n("n", "c_nationkey").alias("true_node"), guess.alias("pred_node"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return graph.hierarchical_metrics(_customer_pairs(spark, d), graph.closure_arrays(graph.ancestor_closure(inner_edges(spark, d))))


_PAIRS = (
    "WITH RECURSIVE " + _INNER + ", edges AS (SELECT * FROM inner_edges), " + _CLOSURE + """, arrays AS (SELECT node, list(ancestor) AS c FROM closure GROUP BY node), pairs AS (
  SELECT c_custkey, 'n' || c_nationkey AS true_node, CASE WHEN c_custkey % 11 <> 0 THEN 'n' || ((c_nationkey * 7 + c_custkey) % 25) END AS pred_node FROM customer
), shares AS (
  SELECT c_custkey, pred_node, coalesce(len(list_intersect(t.c, p.c)) / len(p.c), 0.0) AS hp, coalesce(len(list_intersect(t.c, p.c)) / len(t.c), 0.0) AS hr
  FROM pairs LEFT JOIN arrays t ON t.node = true_node LEFT JOIN arrays p ON p.node = pred_node
), scored AS (SELECT *, CASE WHEN hp + hr > 0 THEN 2 * hp * hr / (hp + hr) ELSE 0.0 END AS hf1 FROM shares)
"""
)


@query(_PAIRS + "SELECT c_custkey, pred_node, round(hp, 9) AS hp, round(hr, 9) AS hr, round(hf1, 9) AS hf1 FROM scored")
def hier_prf_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("c_custkey", "pred_node", *[F.round(c, 9).alias(c) for c in ("hp", "hr", "hf1")])


@query(
    _PAIRS + "SELECT "
    + ", ".join(f"round(avg({c}), 9) AS {c}_all, round(coalesce(avg({c}) FILTER (WHERE pred_node IS NOT NULL), 0), 9) AS {c}_mapped" for c in ("hp", "hr", "hf1"))
    + ", CAST(count(*) AS BIGINT) AS support, CAST(count(*) FILTER (WHERE pred_node IS NULL) AS BIGINT) AS failures, round(avg(CASE WHEN pred_node IS NULL THEN 1.0 ELSE 0.0 END), 9) AS failure_rate FROM scored"
)
def hier_prf_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d).withColumn("mapped", F.col("pred_node").isNotNull())
    out = metrics.hierarchical_means(rows)
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(
    f"WITH RECURSIVE {_INNER}, {_SUPPLIERS}, {_CLOSURE}" + """, ids AS (
  SELECT 's' || a.s_suppkey AS node_a, 's' || b.s_suppkey AS node_b FROM supplier a JOIN supplier b ON b.s_suppkey = (a.s_suppkey * 3 + 1) % (SELECT count(*) FROM supplier)
), common AS (
  SELECT node_a, node_b, a.ancestor AS lcs, r.max_depth + 1 AS d, a.min_depth + b.min_depth AS s,
    row_number() OVER (PARTITION BY node_a, node_b ORDER BY r.min_depth DESC, a.ancestor) AS k
  FROM ids JOIN closure a ON a.node = node_a JOIN closure b ON b.node = node_b AND b.ancestor = a.ancestor JOIN closure r ON r.node = a.ancestor AND r.ancestor = 'root'
) SELECT node_a, node_b, lcs, round(2.0 * d / (2 * d + s), 9) AS wup FROM common WHERE k = 1"""
)
def wup_pairs(spark: SparkSession, d: str) -> DataFrame:
    supplier = table(spark, d, "supplier")
    other = (F.col("s_suppkey") * 3 + 1) % supplier.count()
    ids = supplier.select(_n("s", "s_suppkey").alias("node_a"), F.concat(F.lit("s"), other.cast("string")).alias("node_b"))
    known = supplier.select(_n("s", "s_suppkey").alias("node_b"))
    closure = graph.ancestor_closure(inner_edges(spark, d).unionByName(supplier_edges(spark, d)))
    out = graph.wu_palmer(ids.join(known, "node_b"), closure, "root")
    return out.select("node_a", "node_b", "lcs", F.round("wup", 9).alias("wup"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    nation = table(spark, d, "nation").filter(n % 4 == 0).select(
        _n("n", "n_nationkey").alias("node"), (n % 8 == 0).alias("is_nature"),
        F.when(n % 16 == 0, "biotic").when(n % 16 == 8, "abiotic").alias("life_category"), F.when(n % 12 == 0, "immaterial").alias("tangibility"),
    )
    r = F.col("r_regionkey")
    none = F.lit(None).cast("string")
    region = table(spark, d, "region").filter(r % 3 == 1).select(_n("r", "r_regionkey").alias("node"), F.lit(True).alias("is_nature"), none.alias("life_category"), F.lit("material").alias("tangibility"))
    return nation.unionByName(region)


_LABELS = """labels_ AS (
  SELECT 'n' || n_nationkey AS node, n_nationkey % 8 = 0 AS is_nature, CASE n_nationkey % 16 WHEN 0 THEN 'biotic' WHEN 8 THEN 'abiotic' END AS life_category,
    CASE WHEN n_nationkey % 12 = 0 THEN 'immaterial' END AS tangibility FROM nation WHERE n_nationkey % 4 = 0
  UNION ALL SELECT 'r' || r_regionkey, true, NULL, 'material' FROM region WHERE r_regionkey % 3 = 1
)"""


def _nearest_sql(hops: int) -> str:
    return f"WITH RECURSIVE {_INNER}, {_SUPPLIERS}, {_LABELS}" + f""", step AS (
  SELECT child AS node, parent AS nbr, 0 AS dir, edge_seq FROM edges UNION ALL SELECT parent, child, 1, edge_seq FROM edges
), walks AS (
  SELECT node AS src, node, 0 AS hops, CAST([] AS BIGINT[]) AS way FROM (SELECT child AS node FROM edges UNION SELECT parent FROM edges)
  UNION ALL SELECT src, nbr, hops + 1, list_concat(way, [dir, edge_seq]) FROM walks JOIN step USING (node) WHERE hops < {hops}
), ranked AS (
  SELECT src, w.node, hops, row_number() OVER (PARTITION BY src ORDER BY hops, way) AS k FROM walks w JOIN labels_ l ON l.node = w.node
) SELECT src AS node, ranked.node AS resolved_node, CAST(hops AS INTEGER) AS hops, is_nature, life_category, tangibility FROM ranked JOIN labels_ l ON l.node = ranked.node WHERE k = 1"""


def _nearest(spark: SparkSession, d: str, hops: int) -> DataFrame:
    edges = inner_edges(spark, d).unionByName(supplier_edges(spark, d))
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node")))
    return graph.nearest_labels(nodes, edges, _labels(spark, d), hops)


@query(_nearest_sql(0))
def nearest_label_hops0(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, 0)


@query(_nearest_sql(1))
def nearest_label_hops1(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, 1)


@query(_nearest_sql(3))
def nearest_label_hops3(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, 3)


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", F.concat(F.lit("n"), (F.col("user_id") % 50).cast("string")).alias("node"),
        F.when(e % 3 == 0, " Biotic ").when(e % 3 == 1, "abiotic").otherwise("").alias("life"), F.when(e % 5 == 0, "Material").when(e % 5 == 1, "immaterial").alias("tang"),
    )


_ANNOTATED = """WITH a AS (
  SELECT event_id, 'n' || (user_id % 50) AS node, CASE event_id % 3 WHEN 0 THEN 'biotic' WHEN 1 THEN 'abiotic' END AS life, CASE event_id % 5 WHEN 0 THEN 'material' WHEN 1 THEN 'immaterial' END AS tang FROM events
) """


@query(_ANNOTATED + "SELECT node, arg_max(tang IS NOT NULL, event_id) AS is_nature, arg_max(life, event_id) FILTER (WHERE life IS NOT NULL) AS life_category, arg_max(tang, event_id) FILTER (WHERE tang IS NOT NULL) AS tangibility FROM a GROUP BY node")
def annotation_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return graph.annotations(_annotated(spark, d), "node", "life", "tang", "event_id")


@query(
    _ANNOTATED + """SELECT node, event_id, previous, value FROM (
  SELECT node, event_id, life AS value, lag(life) OVER (PARTITION BY node ORDER BY event_id) AS previous FROM a WHERE life IS NOT NULL) WHERE previous <> value"""
)
def annotation_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return graph.annotation_conflicts(_annotated(spark, d), "node", "life", "event_id").withColumnRenamed("seq", "event_id")


def _lemmas(part: DataFrame) -> DataFrame:
    return part.select(_n("p", "p_partkey").alias("node"), F.initcap("p_name").alias("lemma"), F.col("p_partkey").alias("node_seq"), F.lit(0).alias("lemma_seq"))


@query("SELECT lower(p_name) AS lemma, arg_min('p' || p_partkey, p_partkey) AS node FROM part GROUP BY 1")
def lemma_vocab_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return graph.lemma_vocabulary(_lemmas(table(spark, d, "part")))


@query(
    """WITH vocab AS (SELECT lower(p_name) AS lemma, arg_min(p_partkey, p_partkey) AS k FROM part WHERE p_partkey % 3 = 0 GROUP BY 1),
resolved AS (SELECT p_partkey AS k, p_size % 2 = 0 AS is_nature, CASE p_size % 3 WHEN 0 THEN 'biotic' WHEN 1 THEN 'abiotic' ELSE '' END AS life FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, CASE WHEN r.k IS NOT NULL THEN 'p' || r.k END AS mapped_node, r.k IS NOT NULL AS mapped, is_nature AS map_nature,
  CASE WHEN is_nature AND life <> '' THEN life = 'biotic' END AS map_biotic
FROM part LEFT JOIN vocab v ON v.lemma = lower(p_name) LEFT JOIN resolved r ON r.k = v.k"""
)
def object_to_node(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    vocabulary = graph.lemma_vocabulary(_lemmas(part.filter(F.col("p_partkey") % 3 == 0)))
    size = F.col("p_size")
    life = F.when(size % 3 == 0, "biotic").when(size % 3 == 1, "abiotic").otherwise("")
    resolved = part.filter(F.col("p_partkey") % 2 == 0).select(_n("p", "p_partkey").alias("node"), (size % 2 == 0).alias("is_nature"), life.alias("life_category"))
    objects = part.select("p_partkey", F.concat(F.lit(" The "), F.upper("p_name"), F.lit(" ")).alias("object"))
    return matching.objects_to_nodes(objects, vocabulary, resolved).drop("object")


@query(
    """WITH scenes AS (SELECT p_partkey, replace(p_name, ' ', '/') AS name FROM part), senses AS (
  SELECT DISTINCT w AS word, p_size AS rank, w || '.n.' || p_size AS node FROM part, (SELECT unnest([split_part(p_name, ' ', 2), replace(p_name, ' ', '_')]) AS w, p_partkey AS k FROM part) WHERE k = p_partkey AND p_size > 10 AND (w NOT LIKE '%\\_%' ESCAPE '\\' OR p_size % 7 = 0)
), excluded AS (SELECT DISTINCT name FROM scenes WHERE p_partkey % 97 = 0), words AS (
  SELECT DISTINCT name, prio, CASE prio WHEN 0 THEN replace(name, '/', '_') WHEN 1 THEN split_part(name, '/', 1) ELSE split_part(name, '/', 2) END AS word FROM scenes, range(3) t(prio)
), best AS (
  SELECT name, node, row_number() OVER (PARTITION BY name ORDER BY prio, rank) AS k FROM words JOIN senses USING (word) WHERE rank % 3 = 0
) SELECT p_partkey, s.name, node FROM scenes s LEFT JOIN best b ON b.name = s.name AND k = 1 WHERE s.name NOT IN (SELECT name FROM excluded)"""
)
def scene_name_fallback(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    scenes = part.select("p_partkey", F.translate("p_name", " ", "/").alias("name"))
    words = part.filter("p_size > 10").select("p_size", F.explode(F.array(F.split_part("p_name", F.lit(" "), F.lit(2)), F.translate("p_name", " ", "_"))).alias("word"))
    senses = words.filter(~F.col("word").contains("_") | (F.col("p_size") % 7 == 0)).select("word", F.col("p_size").alias("rank"), F.concat("word", F.lit(".n."), F.col("p_size").cast("string")).alias("node")).distinct()
    allowed = senses.filter(F.col("rank") % 3 == 0).select("node")
    excluded = scenes.filter(F.col("p_partkey") % 97 == 0).select("name")
    return matching.scenes_to_nodes(scenes, senses, allowed, excluded)


@query(
    """WITH by_name AS (SELECT p_name, 'a' || min(p_partkey) AS node FROM part WHERE p_size < 3 GROUP BY 1)
SELECT p_partkey, coalesce(n.node, CASE WHEN p_partkey % 3 = 0 THEN 'b' || p_partkey END) AS node FROM part LEFT JOIN by_name n USING (p_name)"""
)
def explicit_mapping_coalesce(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    names = part.filter("p_size < 3").groupBy(F.col("p_name").alias("key")).agg(F.concat(F.lit("a"), F.min("p_partkey").cast("string")).alias("node"))
    ids = part.filter(F.col("p_partkey") % 3 == 0).select(F.col("p_partkey").cast("string").alias("key"), _n("b", "p_partkey").alias("node"))
    return matching.explicit_mapping(part.select("p_partkey", "p_name"), names.unionByName(ids), F.col("p_name"), F.col("p_partkey")).drop("p_name")


@query(
    f"WITH {_LABELS}" + """ SELECT s_suppkey, is_nature AS gt_nature, CASE WHEN is_nature THEN life_category = 'biotic' END AS gt_biotic,
  CASE WHEN is_nature THEN coalesce(tangibility = 'material', true) END AS gt_material FROM supplier JOIN labels_ ON node = 'n' || s_nationkey"""
)
def gt_from_graph(spark: SparkSession, d: str) -> DataFrame:
    classes = table(spark, d, "supplier").select("s_suppkey", _n("n", "s_nationkey").alias("node"))
    met = graph.mapped_classes(classes, _labels(spark, d), "node")
    return met.select("s_suppkey", ground_truth(F.col("is_nature"), F.col("life_category"), F.col("tangibility")).alias("g")).select("s_suppkey", "g.*")


@query(
    """WITH senses AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS word, p_size AS rank, 'n' || (p_size % 25) AS node FROM part WHERE p_size <= 20), cand AS (
  SELECT p_partkey AS id, split_part(p_name, ' ', 2) AS word, p_retailprice - 950 AS score, 'n' || (p_partkey % 25) AS pred FROM part
), sim AS (
  SELECT a.n_nationkey AS x, b.n_nationkey AS y, CASE WHEN a.n_nationkey = b.n_nationkey THEN 1.0 WHEN a.n_regionkey = b.n_regionkey THEN 2.0 / 3 ELSE 1.0 / 3 END AS wup FROM nation a, nation b
), ranked AS (
  SELECT id, s.node, row_number() OVER (PARTITION BY id ORDER BY wup DESC, rank) AS k FROM cand JOIN senses s USING (word) JOIN sim ON s.node = 'n' || x AND pred = 'n' || y WHERE score > 0
) SELECT id AS p_partkey, node FROM ranked WHERE k = 1"""
)
def text_to_node(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    senses = part.filter("p_size <= 20").select(word.alias("word"), F.col("p_size").alias("rank"), F.concat(F.lit("n"), (F.col("p_size") % 25).cast("string")).alias("node")).distinct()
    cand = part.select(F.col("p_partkey").alias("id"), F.lit(0).alias("idx"), word.alias("text"), (F.col("p_retailprice") - 950).alias("score"), F.concat(F.lit("n"), (F.col("p_partkey") % 25).cast("string")).alias("pred_node"))
    asked = cand.select(F.col("text").alias("word"), "pred_node").join(senses, "word").select("node", "pred_node").distinct()
    similarity = graph.wu_palmer(asked, graph.ancestor_closure(inner_edges(spark, d)), "root", "node", "pred_node")
    return graph.resolve_text(cand, senses, similarity.select("node", "pred_node", "wup")).withColumnRenamed("id", "p_partkey")
