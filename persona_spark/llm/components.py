"""Connected components of a link table, by large and small stars."""

from pyspark.sql import DataFrame, functions as F

from persona_spark.session import stage_table


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); the component is its smallest node.

    Each round joins links with the smallest neighbour of a node; minima are worked out on the map side, and a node
    with very many links is split by Spark's handling of skewed joins. Rounds go on until nothing changes, a
    number that grows with the logarithm of the longest path. Links without nodes, or of a node to itself, count nothing.
    """
    links = stage_table(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
            .select("l.a", "l.b")
            .filter("a <> b")
            .distinct()
        )
        links = stage_table(small, "links")
        after = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == after:
            break
        state = after
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
