"""Networks made of the ordinary tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.operators.network import FlowNetwork, spread


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def nation_networks(spark: SparkSession, sf_dir: str) -> FlowNetwork:
    """For each nation (inst): market segments 0.. and order priorities 5.. as nodes, orders as arcs.

    Orders are counted by customer before the join, which so carries a row for each group and not
    for each order; the numbering of the few segments and priorities is broadcast.
    """
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("st")).agg(F.count("*").alias("n"))
    o = orders.join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("inst"), F.col("c_mktsegment").alias("s")), F.col("o_custkey") == F.col("c_custkey"))
    o = o.groupBy("inst", "s", "p").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("st") == "F", F.col("n")).when(F.col("st") == "O", -F.col("n")).otherwise(0)).alias("t"))
    number = lambda c, base: o.select(c).distinct().withColumn(f"{c}_id", (F.row_number().over(W.orderBy(c)) - 1 + base).cast("long"))  # noqa: E731  five values
    o = o.join(F.broadcast(number("s", 0)), "s").join(F.broadcast(number("p", 5)), "p")
    arcs = o.select("inst", F.col("s_id").alias("src"), F.col("p_id").alias("dst"), F.expr("n div 8").alias("cap"), F.expr("n div 16").alias("rcap"))
    ends = o.select("inst", F.explode(F.array("s_id", "p_id")).alias("node"), "t")
    return FlowNetwork(arcs, ends.groupBy("inst", "node").agg(F.sum("t").cast("long").alias("tcap")), n_nodes=10, keys=("inst",))


def order_chains(spark: SparkSession, sf_dir: str) -> FlowNetwork:
    """For each order (inst): its line numbers as a chain of nodes; the chain's window is inside an order."""
    item = read(spark, sf_dir, "lineitem")
    sign = F.when(F.col("l_returnflag") == "A", 5).when(F.col("l_returnflag") == "N", -5).otherwise(0)
    term = item.groupBy(F.col("l_orderkey").cast("long").alias("inst"), (F.col("l_linenumber") - 1).cast("long").alias("node")).agg(F.sum("l_quantity").cast("long").alias("qty"), F.sum(sign).cast("long").alias("tcap"))
    w = W.partitionBy("inst").orderBy("node")
    chain = term.select("inst", F.col("node").alias("src"), F.lead("node").over(w).alias("dst"), "qty", F.lead("qty").over(w).alias("nq")).filter("dst IS NOT NULL")
    arcs = chain.select("inst", "src", "dst", F.expr("1 + (qty + nq) div 10").alias("cap"), F.expr("1 + (qty + nq) div 10").alias("rcap"))
    return FlowNetwork(arcs, term.select("inst", "node", "tcap"), n_nodes=7, keys=("inst",))


def supply_network(spark: SparkSession, sf_dir: str) -> FlowNetwork:
    """One network: suppliers (even nodes) and parts (odd nodes), an arc for each pair that trades.

    Suppliers with a good balance and cheap parts are sources, the others sinks. The ids of nodes have gaps.
    Few items share a pair, so they are dealt by it as they are: a sum before the shuffle would hold a whole split.
    """
    item = read(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 2).cast("long").alias("src"), (F.col("l_partkey") * 2 + 1).cast("long").alias("dst"), "l_quantity")
    supplier, part = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "part")
    arcs = spread(item, "src", "dst").groupBy("src", "dst").agg(F.expr("cast(sum(l_quantity) as bigint) div 10").alias("cap"), F.count("*").alias("rcap"))
    s = supplier.select((F.col("s_suppkey") * 2).cast("long").alias("node"), F.floor((F.col("s_acctbal") - 4500) / 10).cast("long").alias("tcap"))
    p = part.select((F.col("p_partkey") * 2 + 1).cast("long").alias("node"), (950 - F.floor("p_retailprice")).cast("long").alias("tcap"))
    return FlowNetwork(arcs, s.unionByName(p))


def supply_nodes(spark: SparkSession, sf_dir: str, terminals: DataFrame) -> int:
    """The largest id of a node in the supply network, and 1; an item without a supplier or a part is no arc."""
    item = read(spark, sf_dir, "lineitem").filter("l_suppkey IS NOT NULL AND l_partkey IS NOT NULL").agg(F.max(F.greatest(F.col("l_suppkey") * 2, F.col("l_partkey") * 2 + 1)).cast("long").alias("m"))
    most = item.unionByName(terminals.agg(F.max("node").alias("m"))).agg(F.max("m")).first()[0]
    return 0 if most is None else most + 1


def raw_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed arcs with parallel, opposite and looping ones: (src, dst, cap) from line items over 997 nodes."""
    return read(spark, sf_dir, "lineitem").select(F.expr("l_suppkey % 997").cast("long").alias("src"), F.expr("(l_partkey * 31 + l_linenumber) % 997").cast("long").alias("dst"), F.col("l_quantity").cast("long").alias("cap"))


def raw_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terminal arcs (node, from_source, cap): an order's price at its customer, from the source while it is open."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").cast("long").alias("node"), (F.col("o_orderstatus") == "O").alias("from_source"), F.floor("o_totalprice").cast("long").alias("cap"))
