"""Parent-pointer trees (account groups, cost centres, product categories,
locations): transitive closure and roll-up.

The closure doubles pointers: after round k every node knows its ancestors up
to 2^k levels above and the one exactly 2^k levels above, so a chain of any
depth takes a logarithmic number of joins. Rounds end when no pointer is left;
each is checkpointed, so lineage stays short. Nodes whose chain never ends (on
a cycle, or below one) are found first and reported by ``tree_cycles``.
Roll-ups double pointers too, but carry sums instead of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.session import cut_lineage, stored


def _links(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, up): each node that has a parent row."""
    n = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"))
    return n.where("up IS NOT NULL").join(n.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up")


def _double(links: DataFrame) -> DataFrame:
    """Pointers twice as long; nodes near a root drop out."""
    return links.join(links.select(F.col("id").alias("up"), F.col("up").alias("_far")), "up").select(
        "id", F.col("_far").alias("up"))


def tree_cycles(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Nodes on a cycle or below one: their pointer still leads somewhere after more levels than there are nodes."""
    far = cut_lineage(_links(nodes, id_col, parent_col))
    total, reach = nodes.count(), 1
    while reach <= total and not far.isEmpty():
        far, reach = cut_lineage(_double(far)), reach * 2
    return far.select("id").distinct()


def tree_closure(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(ancestor_id, descendant_id, depth) for every node and each of its ancestors (depth 0 = itself).

    A node reported by ``tree_cycles`` has the pair with itself only.
    """
    cyclic = tree_cycles(nodes, id_col, parent_col)
    far = cut_lineage(_links(nodes, id_col, parent_col).join(cyclic, "id", "left_anti"))
    pairs = nodes.select(F.col(id_col).alias("ancestor_id"), F.col(id_col).alias("descendant_id"),
                         F.lit(0).alias("depth"))
    reach = 1
    while not far.isEmpty():
        # ancestors of the node that is exactly ``reach`` levels above
        above = (far.join(pairs.withColumnRenamed("descendant_id", "up"), "up")
                 .select("ancestor_id", F.col("id").alias("descendant_id"), (F.col("depth") + reach).alias("depth")))
        pairs = cut_lineage(pairs.unionByName(above))
        far, reach = cut_lineage(_double(far)), reach * 2
    return pairs


def tree_rollup(nodes: DataFrame, values: DataFrame, node_col: str, value_cols: list[str], id_col: str = "id",
                parent_col: str = "parent_id") -> DataFrame:
    """Sum values attached to nodes up to every ancestor (a node includes itself), without the closure.

    After round k a node holds the sum over its descendants less than 2^k
    levels below and a pointer 2^k levels up; each round adds the sums to the
    nodes pointed at and doubles the pointers. A round aggregates (partially)
    and joins one row a node, and there are log2(depth) of them, so a chain of a
    million nodes takes 20 rounds and no pair of nodes is formed. Only nodes
    whose pointer still leads somewhere take part in a round. Nodes on or below
    a cycle (``tree_cycles``) have their own values only. Nodes without a value
    in their subtree are left out.
    """
    own = values.groupBy(F.col(node_col).alias("id")).agg(*[F.sum(c).alias(c) for c in value_cols])
    zero = {f.name: F.lit(0).cast(f.dataType) for f in own.schema.fields if f.name in value_cols}
    ids = nodes.select(F.col(id_col).alias("id")).distinct()
    # _n counts the nodes with a value, so that a sum of zero is told from no value
    start = ids.join(own.withColumn("_n", F.lit(1).cast("bigint")), "id", "left").select(
        "id", *[F.coalesce(c, zero[c]).cast("DECIMAL(38,6)").alias(c) for c in value_cols],
        F.coalesce("_n", F.lit(0).cast("bigint")).alias("_n"))
    start = stored(start, "tree_own")
    sums, far = start, stored(_links(nodes, id_col, parent_col).distinct(), "tree_far")
    columns = [*value_cols, "_n"]
    total, reach = start.count(), 1
    while reach <= total and not far.isEmpty():
        up = (far.join(sums, "id").groupBy(F.col("up").alias("id"))
              .agg(*[F.sum(c).cast(sums.schema[c].dataType).alias(f"_up_{c}") for c in columns]))
        sums = stored(sums.join(up, "id", "left").select("id", *[
            (F.col(c) + F.coalesce(f"_up_{c}", F.lit(0))).cast(sums.schema[c].dataType).alias(c) for c in columns]),
            "tree_sums")
        far, reach = stored(_double(far), "tree_far"), reach * 2
    # pointers that still lead somewhere go round: what reached these nodes came round as well
    cyclic = far.select("id").distinct()
    result = (sums.join(cyclic, "id", "left_anti").unionByName(start.join(cyclic, "id", "left_semi"))
              if reach > total else sums)
    return result.where("_n > 0").select("id", *[F.col(c).cast("DECIMAL(30,4)").alias(c) for c in value_cols])


def account_group_balances(groups: DataFrame, accounts: DataFrame, trial_balance: DataFrame) -> DataFrame:
    """Trial-balance totals rolled up the account-group tree."""
    tb = trial_balance.join(accounts.select(F.col("id").alias("account_id"), "company_id",
                                            F.col("code").alias("account_code"), "group_id"),
                            ["company_id", "account_code"])
    return tree_rollup(groups, tb.filter(F.col("group_id").isNotNull()), "group_id",
                       ["total_debit", "total_credit"])
