"""Operators on a label DAG given as edges(parent, child, edge_seq).

Everything is a join over edge tables; loops run over hops or levels, never over
nodes. A taxonomy is small beside the rows that refer to it, yet nothing here
relies on that: adaptive execution broadcasts what is small when it runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import strip, synset_in
from marlstone.session import cut, drop_cut


def ancestor_closure(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, ancestor, min_depth, max_depth: each node (all by default) with
    itself and all its ancestors, by walks up the edges level by level.

    Diamonds are folded at every level, so paths never multiply. Walks on a cycle
    have no greatest depth: they raise ValueError.
    """
    return _closure(edges, nodes, True)


#: Levels after which a walk looks for a cycle that it may have run into.
DEEP = 32


def _closure(edges: DataFrame, nodes: DataFrame | None, look: bool) -> DataFrame:
    up = edges.select(F.col("child").alias("ancestor"), "parent").distinct()
    if nodes is None:
        nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node")))
    own = nodes.select("node").filter("node IS NOT NULL").distinct()
    found = level = cut(own.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")), "closure")
    depth = 0
    while True:
        depth += 1
        level = cut(level.join(up, "ancestor").select("node", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).distinct(), "closure")
        # A node of a cycle meets itself; one below a cycle only meets those nodes.
        size = level.agg(F.count("*").alias("n"), F.max(F.when(F.col("node") == F.col("ancestor"), F.col("node"))).alias("again")).first()
        if size.again is not None:
            raise ValueError(f"{size.again!r} is its own ancestor")
        if not size.n:
            drop_cut(level)
            break
        if look and depth % DEEP == 0:
            _closure(edges, level.select(F.col("ancestor").alias("node")), False)
        found = found.unionByName(level)
    return found.groupBy("node", "ancestor").agg(F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))


def with_root(edges: DataFrame, root: str) -> DataFrame:
    """Edges plus one to the root for each other node without a parent."""
    tops = edges.select(F.col("parent").alias("child")).distinct().join(edges.select("child").distinct(), "child", "left_anti").filter(F.col("child") != root)
    return edges.unionByName(tops.select(F.lit(root).alias("parent"), "child", F.lit(-1).cast(edges.schema["edge_seq"].dataType).alias("edge_seq")))


def closure_arrays(closure: DataFrame) -> DataFrame:
    """node and its closure as a sorted array; a closure is as long as the
    hierarchy is deep, never as the table is long."""
    return closure.groupBy("node").agg(F.sort_array(F.collect_set("ancestor")).alias("closure"))


def hierarchical_metrics(pairs: DataFrame, closures: DataFrame, truth: str = "true_node", prediction: str = "pred_node") -> DataFrame:
    """hP, hR, hF1 of each pair: shares of the closures' common part; zeros for
    a missing prediction or an unknown node."""
    t = closures.select(F.col("node").alias(truth), F.col("closure").alias("_t"))
    p = closures.select(F.col("node").alias(prediction), F.col("closure").alias("_p"))
    met = pairs.join(t, truth, "left").join(p, prediction, "left")
    shared = F.coalesce(F.size(F.array_intersect("_t", "_p")), F.lit(0)).cast("double")
    met = met.withColumn("hp", F.coalesce(F.try_divide(shared, F.size("_p")), F.lit(0.0))).withColumn("hr", F.coalesce(F.try_divide(shared, F.size("_t")), F.lit(0.0)))
    met = met.withColumn("hf1", F.coalesce(F.try_divide(2 * F.col("hp") * F.col("hr"), F.col("hp") + F.col("hr")), F.lit(0.0)))
    return met.select(*pairs.columns, "hp", "hr", "hf1")


def wu_palmer(pairs: DataFrame, closure: DataFrame, root: str, a: str = "node_a", b: str = "node_b") -> DataFrame:
    """2 d / (d1 + d2) over the common ancestor of greatest least depth, where d
    is its greatest depth plus one, and d1 and d2 add the shortest ways down to
    each node. Ties go to the smaller name. 0 without a common ancestor."""
    depth = closure.filter(F.col("ancestor") == root).select(F.col("node").alias("lcs"), F.col("min_depth").alias("_least"), F.col("max_depth").alias("_most"))
    left = closure.select(F.col("node").alias(a), F.col("ancestor").alias("lcs"), F.col("min_depth").alias("_da"))
    right = closure.select(F.col("node").alias(b), F.col("ancestor").alias("lcs"), F.col("min_depth").alias("_db"))
    ids = pairs.select(a, b).distinct()
    common = ids.join(left, a).join(right, [b, "lcs"]).join(depth, "lcs")
    best = common.groupBy(a, b).agg(F.min_by(F.struct("lcs", "_most", "_da", "_db"), F.struct(-F.col("_least"), "lcs")).alias("m")).select(a, b, "m.*")
    d = (F.col("_most") + 1).cast("double")
    best = best.select(a, b, "lcs", (2 * d / (2 * d + F.col("_da") + F.col("_db"))).alias("wup"))
    return pairs.join(best, [a, b], "left").withColumn("wup", F.coalesce("wup", F.lit(0.0)))


def neighbours(edges: DataFrame) -> DataFrame:
    """node, neighbour and the order they are visited in: parents, then
    children, each by edge_seq."""
    up = edges.select(F.col("child").alias("node"), F.col("parent").alias("neighbour"), F.lit(0).alias("dir"), "edge_seq")
    return up.unionByName(edges.select(F.col("parent").alias("node"), F.col("child").alias("neighbour"), F.lit(1).alias("dir"), "edge_seq"))


def nearest_labels(sources: DataFrame, edges: DataFrame, labels: DataFrame, max_hops: int = 3) -> DataFrame:
    """For each source node the labelled node that a breadth-first search both
    ways meets first within ``max_hops``: node, resolved_node, hops and the
    label's columns. Sources without one are left out.

    The search goes from the labels back. What a node's search meets first at
    hop h is what the first of its neighbours, in visiting order, that is
    resolved at hop h - 1 meets: so each node is resolved once, by its
    neighbours' answers, and a hop reads each edge once however many sources
    share it. Neighbours that an order doesn't tell apart go by name.
    """
    known = labels.filter("is_nature IS NOT NULL")
    step = neighbours(edges)
    found = last = known.select("node", F.col("node").alias("resolved_node"), F.lit(0).alias("hops")).distinct()
    for hop in range(1, max_hops + 1):
        met = step.join(last.select(F.col("node").alias("neighbour"), "resolved_node"), "neighbour").join(found.select("node"), "node", "left_anti")
        first = met.groupBy("node").agg(F.min_by("resolved_node", F.struct("dir", "edge_seq", "neighbour")).alias("resolved_node"))
        # Written, as a hop has two readers and each would run all hops before.
        last = cut(first.withColumn("hops", F.lit(hop)), "front")
        found = found.unionByName(last)
    of = known.withColumnRenamed("node", "resolved_node")
    own = sources.select("node").distinct().join(found, "node")
    return own.join(of, "resolved_node").select("node", "resolved_node", "hops", *[c for c in known.columns if c != "node"])


def node_in_row(levels: list[Column]) -> Column:
    """The node named in the deepest cell before the first blank one."""
    cells = F.transform(F.array(*levels), lambda c: F.nullif(strip(c.cast("string")), F.lit("")))
    depth = F.array_position(F.transform(cells, lambda c: c.isNull()), True)
    last = F.when(depth == 0, F.size(cells)).otherwise(depth - 1).cast("int")
    return synset_in(F.when(last > 0, F.try_element_at(cells, last)))


def annotations(rows: DataFrame, node: str, life: str, tangibility: str, seq: str) -> DataFrame:
    """One label a node: is_nature by the last row, the other two by the last
    row that has them (so they may outlive a later 'not nature')."""
    v = rows.select(F.col(node).alias("node"), _word(life).alias("life"), _word(tangibility).alias("tang"), F.col(seq).alias("seq")).filter("node IS NOT NULL")
    return v.groupBy("node").agg(
        F.max_by(F.col("tang").isNotNull(), "seq").alias("is_nature"),
        F.max_by("life", F.when(F.col("life").isNotNull(), F.col("seq"))).alias("life_category"),
        F.max_by("tang", F.when(F.col("tang").isNotNull(), F.col("seq"))).alias("tangibility"),
    )


def _word(name: str) -> Column:
    return F.nullif(F.lower(strip(F.col(name).cast("string"))), F.lit(""))


def annotation_conflicts(rows: DataFrame, node: str, value: str, seq: str) -> DataFrame:
    """Rows whose value differs from the one that their node had before."""
    v = rows.select(F.col(node).alias("node"), _word(value).alias("value"), F.col(seq).alias("seq")).filter("node IS NOT NULL AND value IS NOT NULL")
    before = F.lag("value").over(Window.partitionBy("node").orderBy("seq"))
    return v.withColumn("previous", before).filter(F.col("previous") != F.col("value")).select("node", "seq", "previous", "value")


def lemma_vocabulary(lemmas: DataFrame) -> DataFrame:
    """lemma -> node; of nodes with one lemma the first (node_seq, lemma_seq)."""
    norm = strip(F.lower(F.translate("lemma", "_", " ")))
    return lemmas.groupBy(norm.alias("lemma")).agg(F.min_by("node", F.struct("node_seq", "lemma_seq")).alias("node")).filter("lemma <> ''")


def resolve_text(candidates: DataFrame, senses: DataFrame, similarity: DataFrame, synonyms: DataFrame | None = None, threshold: float = 0.0) -> DataFrame:
    """candidates(id, idx, text, score, pred_node) -> id, node: candidates over
    the threshold by falling score; a known synonym stands for the predicted
    node, else the word's sense nearest to it, the first sense on ties.

    senses(word, rank, node); similarity(node, pred_node, wup)."""
    word = F.translate(F.lower(strip(F.col("text"))), " ", "_")
    ranked = candidates.filter(F.col("score") > threshold).withColumn("word", word)
    near = ranked.join(senses, "word").join(similarity, ["node", "pred_node"], "left")
    pick = F.max_by("node", F.struct(F.coalesce("wup", F.lit(0.0)), -F.col("rank")))
    hits = near.groupBy("id", "idx", "score").agg(pick.alias("node"))
    if synonyms is not None:
        same = ranked.join(synonyms.select("word").distinct(), "word").select("id", "idx", "score", F.col("pred_node").alias("node"))
        hits = same.unionByName(hits.join(same.select("id", "idx"), ["id", "idx"], "left_anti"))
    return hits.groupBy("id").agg(F.min_by("node", F.struct(-F.col("score"), "idx")).alias("node"))


def mapped_classes(classes: DataFrame, resolved: DataFrame, node: str) -> DataFrame:
    """Classes whose node resolves; the others are left out, never defaulted."""
    return classes.join(resolved.withColumnRenamed("node", node), node)
