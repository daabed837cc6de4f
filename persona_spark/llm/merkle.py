"""Merkle manifest of a dataset by bitmap rank: ids of a group are merged into compressed bitmaps, ranks read off a popcount
directory give every leaf its place without sorting the leaves, and keyed slot arrays reduce several levels at a time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from persona_spark.prefix import prefix_sums
from persona_spark.scale import lookup_join, whole_div
from persona_spark.session import stage_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that become one.
FAN = 3
#: Levels reduced in one grouping, and the nodes that meet in it.
LEVELS = 5
SLOTS = FAN**LEVELS
#: Ids in a word of a bitmap.
WORD_BITS = 64

RUNG = "array<struct<before: string, after: string>>"


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Digest of all fields in order: `-` for null, else UTF-8 byte count, `:`, value."""

    def framed(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(F.concat(*map(framed, fields)))


@dataclass
class Bitmaps:
    """Per tree the ids present: `words` has a row (tree, word, bits, n, ones) for each 64 ids of which there is one; words
    without ids take no place. `ones` is the popcount directory, the rows of the tree before the word; `n` those in it."""

    words: DataFrame

    @staticmethod
    def of(leaves: DataFrame) -> Bitmaps:
        """From rows (tree, id). Partial bitmaps are merged on the map side. Null ids have a word of their own, the first."""
        one = _shifted(1, _bit())
        words = leaves.groupBy("tree", _word().alias("word")).agg(F.bit_or(one).alias("bits"), F.count("*").alias("n"))
        return Bitmaps(stage_table(prefix_sums(stage_table(words, "words"), ["tree"], ["word"], "n", "ones"), "directory"))

    def sizes(self) -> DataFrame:
        return self.words.groupBy("tree").agg(F.sum("n").alias("n_tree"))

    def ranks(self, leaves: DataFrame) -> DataFrame:
        """`leaves` (tree, id, leaf and others) with `rank`, the place in the tree by id, equal ids by leaf."""
        keyed = leaves.withColumns({"_word": _word(), "_bit": _bit()})
        words = self.words.select(F.col("tree").alias("_tree"), F.col("word").alias("_at"), "bits", "ones", "n")
        met = keyed.join(words, (F.col("tree") == F.col("_tree")) & F.col("_word").eqNullSafe(F.col("_at")))
        below = F.col("bits").bitwiseAND(F.bitwise_not(_shifted(-1, F.col("_bit"))))
        simple = met.where(F.col("n") == F.bit_count("bits"))
        placed = simple.withColumn("rank", F.col("ones") + F.bit_count(below)).select(*leaves.columns, "rank")
        crowded = self.words.where(F.col("n") > F.bit_count("bits"))
        if crowded.isEmpty():
            return placed
        # Words in which an id is repeated: its rows are numbered, whatever their number.
        rows = stage_table(met.where(F.col("n") > F.bit_count("bits")), "repeated")
        within = prefix_sums(rows.withColumn("_one", F.lit(1)), ["tree", "_word"], ["_bit", "leaf"], "_one", "_within")
        return placed.unionByName(within.withColumn("rank", F.col("ones") + F.col("_within")).select(*leaves.columns, "rank"))


def _word() -> Column:
    return F.shiftright(F.col("id"), 6)


def _bit() -> Column:
    return F.coalesce(F.col("id").bitwiseAND(WORD_BITS - 1), F.lit(0)).cast("int")


def _shifted(word: int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(word).cast("bigint"), by)


def _depth(n: Column) -> Column:
    """Levels that a block has in a tree of n nodes."""
    depth = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        depth = F.when(n <= FAN**k, k).otherwise(depth)
    return depth


def _levels(nodes: Column, depth: Column) -> Column:
    """All levels of a block, from its nodes up to its root."""

    def above(a: Column) -> Column:
        runs = F.sequence(F.lit(0), whole_div(F.size(a) - 1, FAN).cast("int"))
        return F.transform(runs, lambda i: digest(F.array_join(F.slice(a, i * FAN + 1, F.lit(FAN)), "")))

    steps = F.slice(F.array(*map(F.lit, range(LEVELS))), F.lit(1), depth)
    return F.aggregate(steps, F.array(nodes), lambda acc, _: F.concat(acc, F.array(above(F.element_at(acc, -1)))))


def _rungs(levels: Column, slot: Column, depth: Column) -> Column:
    """The siblings of a slot on the way up to the root of its block: what stands before and behind it in each run."""

    def rung(k: Column) -> Column:
        widths = F.array(*[F.lit(FAN**j) for j in range(LEVELS)])
        at = whole_div(slot, 1).cast("int")
        place = F.floor(at / F.element_at(widths, k + 1)).cast("int")
        row = F.element_at(levels, k + 1)
        first = (F.floor(place / FAN) * FAN).cast("int")
        before = F.array_join(F.slice(row, first + 1, place - first), "")
        after = F.array_join(F.slice(row, place + 2, first + FAN - place - 1), "")
        return F.struct(before.alias("before"), after.alias("after"))

    steps = F.slice(F.array(*map(F.lit, range(LEVELS))), F.lit(1), depth)
    return F.transform(steps, rung)


def _blocks(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Nodes (tree, rank, n_tree, h and carried ones) as blocks (tree, block, n_tree, depth, slots, levels): the slot array
    of a block is keyed by place, so it never holds more than SLOTS nodes."""
    slot = F.struct((F.col("rank") % SLOTS).cast("int").alias("slot"), "h", *carried)
    grouped = nodes.groupBy("tree", whole_div(F.col("rank"), SLOTS).alias("block"), "n_tree").agg(
        F.array_sort(F.collect_list(slot)).alias("slots")
    )
    depth = _depth(F.col("n_tree")).cast("int")
    out = grouped.select(
        "tree", "block", "n_tree", depth.alias("depth"),
        *([F.col("slots")] if carried else []),
        _levels(F.transform("slots", lambda s: s["h"]), depth).alias("levels"),
    )
    return stage_table(out, "blocks")


def _root() -> Column:
    return F.element_at(F.element_at("levels", -1), 1)


def _reduced(nodes: DataFrame, most: int, carried: Sequence[str] = ()) -> list[DataFrame]:
    """Blocks round by round, until every tree is one node. `most` is the size of the largest tree."""
    rounds = [_blocks(nodes, carried)]
    while most > SLOTS:
        most = -(-most // SLOTS)
        above = rounds[-1].where(F.col("n_tree") > SLOTS).select(
            "tree", F.col("block").alias("rank"), F.ceil(F.col("n_tree") / SLOTS).cast("bigint").alias("n_tree"), _root().alias("h")
        )
        rounds.append(_blocks(above))
    return rounds


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """(tree, top): the root of each tree."""
    tops = [r.where(F.col("n_tree") <= SLOTS).select("tree", _root().alias("top")) for r in rounds]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _with_paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Blocks of the first round with `path`, the siblings from the block's root up to the root of all, and `top`. `above`
    (tree, top, path) has those of each tree's root."""
    known = None
    for k in reversed(range(len(rounds))):
        block = rounds[k]
        own = lookup_join(block.where(F.col("n_tree") <= SLOTS), above, ["tree"], spread=["block"])
        if known is not None:
            own = own.unionByName(lookup_join(block.where(F.col("n_tree") > SLOTS), known, ["tree", "block"]))
        if k:
            child = F.col("block") * SLOTS + F.col("s")
            known = stage_table(
                own.withColumn("s", F.explode_outer(F.sequence(F.lit(0), F.size(F.element_at("levels", 1)) - 1))).select(
                    "tree", child.alias("block"), "top",
                    F.concat(_rungs(F.col("levels"), F.col("s"), F.col("depth")), "path").alias("path"),
                ),
                "paths",
            )
    return own


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, fields: Sequence[str] = FIELDS, tree: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per document: its key, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a tree ascend by key, nulls first, equal keys by leaf; trees ascend by their value, null first. Every FAN
    consecutive nodes become one, a shorter last run too, until one is left; the trees' roots become the root in the same
    way. proof_sha256 is the digest of all siblings from the leaf up to the root, that of the empty string if there are
    none. folded_root is worked out from `tampered` (a Column for the text as found; the text itself if not given) and the
    siblings. Repeated rows are leaves each. An empty table gives no rows. Columns other than `fields` play no part.
    """
    col = {c: F.col(f"`{c}`") for c in fields}
    honest = leaf_hash([col[c] for c in fields])
    found = honest if tampered is None else leaf_hash([tampered if c == "text" else col[c] for c in fields])
    # Non-null, in the order of the trees: null first, then bytewise.
    name = F.coalesce(F.concat(F.lit("="), col[tree].cast("string")), F.lit(""))
    leaves = stage_table(docs.select(name.alias("tree"), col[key].cast("bigint").alias("id"), honest.alias("leaf"), found.alias("found")), "leaves")

    bitmaps = Bitmaps.of(leaves.select("tree", "id"))
    sizes = stage_table(bitmaps.sizes(), "sizes")
    most = sizes.agg(F.max("n_tree")).first()[0] or 0
    ranked = lookup_join(bitmaps.ranks(leaves), sizes, ["tree"], spread=["id"])
    rounds = _reduced(ranked.withColumnRenamed("leaf", "h"), most, ("id", "found"))

    tops = stage_table(_tops(rounds), "tops")
    n_trees = tops.count()
    subroots = prefix_sums(tops.withColumn("_one", F.lit(1)), [], ["tree"], "_one", "rank").select(
        F.lit("").alias("tree"), "rank", F.lit(n_trees).cast("bigint").alias("n_tree"), F.col("top").alias("h"), F.col("tree").alias("of")
    )
    crown = _reduced(subroots, n_trees, ("of",))
    row = _tops(crown).first()  # one value
    root = row.top if row else None
    end = crown[0].sparkSession.createDataFrame([("", root)], "tree string, top string").withColumn("path", F.array().cast(RUNG))
    above = _with_paths(crown, end).select(F.explode_outer("slots").alias("s"), "levels", "depth", "path").select(
        F.col("s.of").alias("tree"), F.col("s.h").alias("top"),
        F.concat(_rungs(F.col("levels"), F.col("s.slot"), F.col("depth")), "path").alias("path"),
    )
    blocks = _with_paths(rounds, stage_table(above, "above"))

    walked = F.transform(
        "slots", lambda s: F.struct(s.alias("s"), F.concat(_rungs(F.col("levels"), s["slot"], F.col("depth")), F.col("path")).alias("path"))
    )
    proof = lambda p: digest(F.array_join(F.transform(p, lambda r: F.concat(r["before"], r["after"])), ""))
    folded = lambda h, p: F.aggregate(p, h, lambda acc, r: digest(F.concat(r["before"], acc, r["after"])))
    proven = F.transform(
        walked,
        lambda x: F.struct(
            x["s"]["id"].alias(key), x["s"]["h"].alias("leaf"), proof(x["path"]).alias("proof_sha256"), folded(x["s"]["found"], x["path"]).alias("folded_root")
        ),
    )
    return blocks.select("top", F.explode_outer(proven).alias("x")).select(
        f"x.{key}", "x.leaf", F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"), "x.proof_sha256", "x.folded_root",
        (F.col("x.folded_root") == F.lit(root).cast("string")).alias("verified"),
    )
