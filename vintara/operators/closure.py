"""Lineage of any depth: everything a result rests on, when all of it was knowable, and where the chain is broken or circular."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.plans.settle import settle

#: Parents of a node that one row lists.
LONGEST = 10_000
RESOLVED, MISSING, CYCLE = "RESOLVED", "MISSING_PARENT", "CYCLE"


def close_over(edges: DataFrame, roots: DataFrame, *, child: str = "child", parent: str = "parent", root: str = "root") -> DataFrame:
    """(root, node, depth): every node that a root rests on, once, with the fewest steps to it; a root that rests on itself has a row of its own.

    Each round follows the edges of what the round before has found and drops what is known already,
    so diamonds are walked once and cycles end. Rounds are written to the checkpoint folder; their number is the
    depth of the deepest chain. Nodes without parents, mostly the greatest part, take no part in the rounds: they are kept as
    lists with their children, meet the walked nodes once at the end, and are opened only behind the exchange by root. Lists longer
    than LONGEST are cut by the nodes' hashes. The result has a row for each root and node: for a date or a status
    of every node ``resolve`` needs one row a node.
    """
    pairs = edges.select(F.col(child).alias("_c"), F.col(parent).alias("_p")).where("_c is not null and _p is not null")
    shares = (pairs.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0) // LONGEST + 1
    inner = pairs.select(F.col("_c").alias("_p")).distinct().withColumn("_more", F.lit(True))
    each = pairs.join(inner, "_p", "left").groupBy("_c", F.pmod(F.xxhash64("_p"), F.lit(shares)).alias("_share"))
    links = settle(each.agg(F.collect_set(F.when(F.col("_more"), F.col("_p"))).alias("_up"), F.collect_set(F.when(F.col("_more").isNull(), F.col("_p"))).alias("_ends")))
    up = links.select("_c", F.explode("_up").alias("_p"))
    front = settle(roots.select(F.col(root)).where(F.col(root).isNotNull()).distinct().select(root, F.col(root).alias("node")))
    walked = front.withColumn("depth", F.lit(0))
    found, depth = None, 0
    while True:
        depth += 1
        new = front.join(up, F.col("node") == F.col("_c")).select(root, F.col("_p").alias("node")).distinct()
        if found is not None:
            new = new.join(found.select(root, "node"), [root, "node"], "left_anti")
        front = settle(new)
        if front.isEmpty():
            break
        told = front.withColumn("depth", F.lit(depth))
        found, walked = told if found is None else found.unionByName(told), walked.unionByName(told)
    last = walked.join(links.where(F.size("_ends") > 0), F.col("node") == F.col("_c")).select(root, "_share", (F.col("depth") + 1).alias("depth"), "_ends")
    ends = last.repartition(root, "_share").select(root, "_share", "depth", F.explode("_ends").alias("node")).groupBy(root, "_share", "node").agg(F.min("depth").alias("depth"))
    ends = ends.select(root, "node", "depth")
    return ends if found is None else found.unionByName(ends)


def resolve(edges: DataFrame, known: DataFrame, *, child: str = "child", parent: str = "parent", node: str = "node", at: str = "available") -> DataFrame:
    """(node, at, status, height) of every node of ``edges``: when the last thing it rests on became known.

    A node without parents has its own date in ``known`` or is missing. Dates then rise by one
    aggregation a level: a node is settled when all its parents are, and only the edges to newly
    settled parents are followed, so work is in proportion to edges whatever the number of results
    above them. What is never settled rests on a cycle (status CYCLE, no date). A node over a missing one is missing
    too. Nodes with parents and a date of their own take the later of the two. Repeated edges count once, null ends are left out.
    Nodes without parents, mostly the greatest part, are met once and summed by child at once; no round moves their edges.
    """
    pairs = edges.select(F.col(child).alias("_c"), F.col(parent).alias("_p")).where("_c is not null and _p is not null")
    own = known.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("_n")).agg(F.max(at).alias("_own"))
    inner = pairs.select(F.col("_c").alias("_p")).distinct().withColumn("_more", F.lit(True))
    met = pairs.join(inner, "_p", "left").join(own.withColumnRenamed("_n", "_p"), "_p", "left")
    end = F.col("_more").isNull()
    # a row for each link to a node with parents, and one for all other parents of a child, which are settled here
    links = settle(met.groupBy("_c", F.when(~end, F.col("_p")).alias("_p")).agg(F.max(F.when(end, F.col("_own"))).alias("_at"), F.bool_or(end & F.col("_own").isNull()).alias("_lacks")))
    nodes = links.groupBy(F.col("_c").alias("_n")).agg(F.count("_p").alias("_need"), F.max("_at").alias("_at"), F.bool_or("_lacks").alias("_lacks"), F.max(F.col("_p").isNull().cast("int")).alias("_height"))
    nodes = settle(nodes.join(own, "_n", "left").select("_n", "_need", F.greatest("_own", "_at").alias("_at"), "_lacks", "_height"))
    ends = pairs.select(F.col("_p").alias("_n")).distinct().join(inner.select(F.col("_p").alias("_n")), "_n", "left_anti").join(own, "_n", "left")
    new, waiting = nodes.where("_need = 0").drop("_need"), nodes.where("_need > 0")
    done = [ends.select("_n", F.col("_own").alias("_at"), F.col("_own").isNull().alias("_lacks"), F.lit(0).alias("_height")), new]
    links = links.where("_p is not null").select("_c", "_p")
    while not waiting.isEmpty() and not new.isEmpty():
        told = links.join(new.withColumnRenamed("_n", "_p"), "_p").groupBy(F.col("_c").alias("_n")).agg(F.count(F.lit(1)).alias("_got"), F.max("_at").alias("_new_at"), F.bool_or("_lacks").alias("_new_lacks"), F.max("_height").alias("_new_height"))
        moved = waiting.join(told, "_n", "left").select(
            "_n", (F.col("_need") - F.coalesce("_got", F.lit(0))).alias("_need"), F.greatest("_at", "_new_at").alias("_at"), (F.col("_lacks") | F.coalesce("_new_lacks", F.lit(False))).alias("_lacks"), F.greatest("_height", F.col("_new_height") + 1).alias("_height")
        )
        moved = settle(moved)
        new, waiting = moved.where("_need = 0").drop("_need"), moved.where("_need > 0")
        done.append(new)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    status = F.when(F.col("_lacks"), MISSING).otherwise(RESOLVED)
    settled = out.select(F.col("_n").alias(node), F.when(~F.col("_lacks"), F.col("_at")).alias(at), status.alias("status"), F.col("_height").alias("height"))
    stuck = waiting.select(F.col("_n").alias(node), F.lit(None).cast(known.schema[at].dataType).alias(at), F.lit(CYCLE).alias("status"), F.lit(None).cast("int").alias("height"))
    return settled.unionByName(stuck)
