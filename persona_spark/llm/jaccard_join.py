"""N-gram Jaccard join, aware of sizes: subsets of fixed size for small sets, inverted lists for large ones."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from persona_spark.llm.common import row_key, without
from persona_spark.llm.components import components
from persona_spark.llm.shingles import shingle_set, signature
from persona_spark.scale import lookup_join
from persona_spark.session import stage_table

#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Frequent shingles come last in the order of lists. As many of the most frequent ones as a table of this size holds;
#: any order finds the same links, a better one makes shorter lists.
MAX_FREQUENT = 2_000_000
FREQUENT_FROM = 5
#: Beyond this length the rough order of lists does not do: their sets are ordered by exact frequencies.
LONG_LIST = 32
#: A small set has at most so many subsets of the sizes looked at; larger sets are found by lists alone.
MAX_SUBSETS = 4_096


def least_shared(size: int) -> int:
    """Shingles that a set shares at least with any set that it links to."""
    return -(-PERCENT * size // 100)


def n_subsets(size: int) -> int:
    return sum(comb(size, c) for c in range(least_shared(size), size + 1))


def size_boundary(mean_list: float) -> int:
    """Largest size of a small set: up to it, listing all subsets costs at most what reading the lists would, that is
    the length of the prefix times the mean length of a list as its members see it."""
    size = 1
    while n_subsets(size + 1) <= min(MAX_SUBSETS, (size + 2 - least_shared(size + 1)) * (1 + mean_list)):
        size += 1
    return size


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.int64)


def narrow_sets(docs: DataFrame) -> DataFrame:
    """_id, n and sig of every row of (_id, _text)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, signatures = [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py())
                sizes.append(len(s))
                signatures.append(signature(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(signatures, pa.int64())], ["_id", "n", "sig"]
            )

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_text").mapInArrow(describe, f"_id {kind}, n long, sig long")


def _prefix(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles in the global order, one of which any linked set must hold among its own first ones, and
    how many of the set are left from each on. The order: how frequent (0 if not among the frequent), then hash."""
    length = len(s) - least_shared(len(s)) + 1
    if frequent is not None and len(frequent[0]):
        keys, counts = frequent
        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        level = np.where(keys[at] == s, counts[at], 0)
        if level.any():
            s = s[np.argsort(level, kind="stable")]
    return s[:length], len(s) - np.arange(length)


def prefix_counts(docs: DataFrame) -> DataFrame:
    """key and n: in how many sets of different content (per task) a shingle is among the first by hash."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            out = []
            for text in batch.column(0):
                s = shingle_set(text.as_py())
                sig = signature(s)
                if len(s) and sig not in seen:
                    seen.add(sig)
                    out.append(_prefix(s, None)[0])
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(out)) if out else [], pa.int64())], ["key"])

    return docs.select("_text").mapInArrow(emit, "key long").groupBy("key").agg(F.count("*").alias("n"))


def memberships(docs: DataFrame, frequent, boundary: int) -> DataFrame:
    """key, sig, n, rest: the lists that a set is in. A subset's key leaves all of the set to be shared."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = frequent.value
        seen = set()
        for batch in batches:
            keys, sigs, sizes, rests = [], [], [], []
            for text in batch.column(0):
                s = shingle_set(text.as_py())
                sig = signature(s)
                if not len(s) or sig in seen:
                    continue
                seen.add(sig)
                if len(s) <= boundary:
                    own = np.array(
                        [
                            xxhash.xxh3_64_intdigest(np.array(part, np.uint64).tobytes(), seed=len(part))
                            for size in range(least_shared(len(s)), len(s) + 1)
                            for part in combinations(s.tolist(), size)
                        ],
                        np.uint64,
                    )
                    keys.append(own)
                    rests.append(np.full(len(own), len(s)))
                    sigs.append(np.full(len(own), sig))
                    sizes.append(np.full(len(own), len(s)))
                if 100 * len(s) > PERCENT * boundary:  # it may link to a set beyond the boundary
                    own, rest = _prefix(s, order)
                    keys.append(own)
                    rests.append(rest)
                    sigs.append(np.full(len(own), sig))
                    sizes.append(np.full(len(own), len(s)))
            join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_signed(np.asarray(join(keys))), pa.int64()), *[pa.array(join(p), pa.int64()) for p in (sigs, sizes, rests)]],
                ["key", "sig", "n", "rest"],
            )

    return docs.select("_text").mapInArrow(emit, "key long, sig long, n long, rest long")


def _may_link(n1: str, rest1: str, n2: str, rest2: str) -> Column:
    """Whether two sets of a list can link if the list's shingle is the first that they share."""
    need = PERCENT * (F.col(n1) + F.col(n2))
    return (100 + PERCENT) * F.least(rest1, rest2) >= need


def whole_sets(wanted: DataFrame, docs: DataFrame, narrow: DataFrame) -> DataFrame:
    """sig and hashes of the sets `wanted`. Only one text of each is read out of all documents."""
    holders = lookup_join(
        narrow.filter("n > 0").groupBy("sig").agg(F.min("_id").alias("_id")), wanted, ["sig"], "left_semi", stage=True
    )
    texts = lookup_join(docs.select("_id", "_text"), holders, ["_id"], "inner", stage=True).dropDuplicates(["sig"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_signed(shingle_set(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["sig", "hashes"])

    return texts.select("sig", "_text").mapInArrow(shingles, "sig long, hashes array<long>")


def dense_lists(crowded: DataFrame, docs: DataFrame, narrow: DataFrame) -> DataFrame:
    """key, sig, n, rest and _in of the lists among the sets `crowded`, rarest shingles first.

    Near copies of one text have most shingles in common, and what makes them differ is rare: by exact frequencies
    it comes first, and the positions that remain tell most pairs that cannot link.
    """
    sets = stage_table(whole_sets(crowded, docs, narrow), "crowded_sets")
    rows = sets.select("sig", F.size("hashes").cast("long").alias("n"), F.explode_outer("hashes").alias("key"))
    often = rows.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1")
    by_rarity = W.partitionBy("sig").orderBy("df", "key")
    shared = rows.join(often, "key").withColumn("_at", F.row_number().over(by_rarity))
    # Shingles that no other set holds come before all of these.
    left = F.count("*").over(W.partitionBy("sig")) - F.col("_at") + 1
    least = F.ceil(PERCENT * F.col("n") / 100)
    lists = shared.withColumn("rest", left.cast("long")).filter(F.col("rest") >= least)
    lists = stage_table(lists.select(F.xxhash64(F.lit("dense"), "key").alias("key"), "sig", "n", "rest"), "dense")
    sizes = lists.groupBy("key").agg(F.count("*").alias("_in")).filter("_in > 1")
    return lists.join(sizes, "key")


def verified(pairs: DataFrame, docs: DataFrame, narrow: DataFrame) -> DataFrame:
    """The pairs (a, b) of signatures that link, counted on the whole sets."""
    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    sets = stage_table(whole_sets(wanted, docs, narrow), "sets")
    shared = F.size(F.array_intersect("h1", "h2"))
    return (
        pairs.join(sets.select(F.col("sig").alias("a"), F.col("hashes").alias("h1")), "a")
        .join(sets.select(F.col("sig").alias("b"), F.col("hashes").alias("h2")), "b")
        .filter(100 * shared >= PERCENT * (F.size("h1") + F.size("h2") - shared))
        .select("a", "b")
    )


def frequent_shingles(counts: DataFrame, most: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles with their counts, sorted by hash: at most `most`, by a count that all of them pass."""
    level = F.floor(F.log2(F.col("n"))).cast("int")
    by_level = {r.level: r.c for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect()}
    least, total = 64, 0
    for k in sorted(by_level, reverse=True):
        total += by_level[k]
        if total > most:
            break
        least = k
    rows = counts.filter(level >= least).toPandas()
    keys = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["n"].to_numpy(np.int64)[order]


def link_components(docs: DataFrame, narrow: DataFrame, counts: DataFrame) -> DataFrame:
    """(node, component) over the signatures that link to another one. Every link's two ends are in one component.

    In each list the member with the longest lists is the hub. First every member is compared with its hubs; what
    links is one component already and needs no more looking at. Then, in lists that still hold several components,
    members outside the hub's are compared with those of other components that the positions in the list
    allow. A pair that links shares a first shingle, and no filter hides it in that shingle's list.
    """
    spark = docs.sparkSession
    few = counts.agg(F.sum(F.col("n") * F.col("n")).alias("s"), F.sum("n").alias("n")).first()
    boundary = size_boundary((few.s or 0) / max(few.n or 1, 1))
    frequent = spark.sparkContext.broadcast(frequent_shingles(counts.filter(F.col("n") >= FREQUENT_FROM)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = memberships(docs, frequent, boundary).repartition(parts, "key").dropDuplicates(["key", "sig"])
    in_list = F.count("*").over(W.partitionBy("key"))
    first = stage_table(dealt.withColumn("_in", in_list).filter("_in > 1"), "lists")
    # Sets in long lists are joined among themselves once more, in an order by exact frequencies.
    crowded = first.filter(F.col("_in") > LONG_LIST).select("sig").distinct()
    dense = dense_lists(stage_table(crowded, "crowded"), docs, narrow)
    rough = first.filter(F.col("_in") <= LONG_LIST).withColumn("_dense", F.lit(False))
    lists = stage_table(rough.unionByName(dense.withColumn("_dense", F.lit(True))), "lists")
    # A set that is in many and long lists is the hub of all of them, so that a group is compared with few hubs.
    scores = lists.groupBy("sig").agg(F.sum("_in").alias("score"))
    lists = lists.drop("_in").join(scores, "sig")
    # Lists of one order with the same members: the earliest, which leaves most to share, stands for all of them. A
    # subset leaves all, so it may stand for rough lists too; a list of another order may come late for some members.
    alike = lists.groupBy("key").agg(
        F.first("_dense").alias("_dense"),
        F.count("*").alias("_n"),
        F.bit_xor(F.xxhash64("sig")).alias("_x"),
        F.min("sig").alias("_m"),
        F.sum("rest").alias("_rest"),
        F.max(F.struct("score", "sig", "n", "rest")).alias("hub"),
        F.min("n").alias("least"),
    )
    kept = alike.groupBy("_dense", "_n", "_x", "_m").agg(F.max_by(F.struct("key", "hub", "least"), "_rest").alias("k"))
    hubs = stage_table(
        kept.select("k.key", F.col("k.hub.sig").alias("hub"), F.col("k.hub.n").alias("hub_n"), F.col("k.hub.rest").alias("hub_rest"), "k.least"),
        "hubs",
    )
    members = stage_table(lists.drop("_dense").join(hubs, "key"), "members")
    first = (
        members.filter(F.col("sig") != F.col("hub"))
        .filter(_may_link("n", "rest", "hub_n", "hub_rest"))
        .select(F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b"))
        .distinct()
    )
    links = stage_table(verified(stage_table(first, "pairs"), docs, narrow), "links")
    found = stage_table(components(links), "components")

    named = members.join(found.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
        "component", F.coalesce("component", "sig")
    )
    named = stage_table(
        named.filter((100 + PERCENT) * F.col("rest") >= PERCENT * (F.col("n") + F.col("least"))), "named"
    )
    open_lists = named.groupBy("key").agg(
        F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.max_by("component", F.col("sig") == F.col("hub")).alias("hub_component"),
    ).filter("low < high").select("key", "hub_component")
    rest = stage_table(named.join(open_lists, "key"), "rest")
    outside = rest.filter(F.col("component") != F.col("hub_component"))
    others = rest.select("key", F.col("sig").alias("sig2"), F.col("n").alias("n2"), F.col("rest").alias("rest2"), F.col("component").alias("component2"))
    second = (
        outside.join(others, "key")
        .filter(F.col("component") != F.col("component2"))
        .filter(_may_link("n", "rest", "n2", "rest2"))
        .filter((100 * F.least("n", "n2") >= PERCENT * F.greatest("n", "n2")))
        .select(F.least("sig", "sig2").alias("a"), F.greatest("sig", "sig2").alias("b"))
        .distinct()
    )
    more = verified(stage_table(second, "pairs"), docs, narrow)
    known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(known.unionByName(more))


def jaccard_join(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, n_shingles, component_id and whether it is its group's first.

    `component_id` is the smallest doc_id of the rows that links lead to, copies included. Null or empty text, or text
    without words, has no set and links with nothing. Ids may be null (never a smallest) or repeated; other columns
    are left out. Equal sets are one node, known by a 64-bit hash of the set; shingles are 64-bit hashes too.
    """
    keyed = docs.select(
        row_key(text).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")
    )
    narrow = stage_table(narrow_sets(keyed), "sets_narrow")
    counts = stage_table(prefix_counts(keyed).filter("n > 1"), "prefix_counts")
    found = stage_table(link_components(keyed, narrow, counts), "components")
    placed = lookup_join(
        narrow, found.withColumnRenamed("node", "sig"), ["sig"], "left", spread=["_id"], stage=False
    ).withColumn("component", F.coalesce("component", "sig"))
    groups = (
        placed.filter("n > 0")
        .groupBy("component")
        .agg(F.min("_id.doc_id").alias("component_id"), F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    joined = lookup_join(placed, groups, ["component"], "left", spread=["_id"], stage=True)
    grouped = (F.col("n") > 0) & F.col("_first").isNotNull()
    return joined.select(
        F.col("_id.doc_id").alias("doc_id"),
        F.col("_id.text_hash").alias("text_hash"),
        F.col("n").alias("n_shingles"),
        F.when(grouped, F.col("component_id")).otherwise(F.col("_id.doc_id")).alias("component_id"),
        (~grouped | (F.col("_id") == F.col("_first"))).alias("is_first"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without those that lie in a group and are not its first by id (nulls first), then text hash.
    Rows equal in id and text stay or go together, but for one of them; columns as in `docs`."""
    return without(docs, jaccard_join(docs).filter("NOT is_first"))
