"""Quality classifier: interpolated modified Kneser-Ney model of characters, trained on trusted texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from persona_spark.llm.common import without
from persona_spark.scale import lookup_join
from persona_spark.session import stage_table

#: An n-gram of four characters of 16 bits each is one whole number, first character on top.
ORDER = 4
#: Documents are scored in blocks of about so many bytes of text; a block asks for each of its n-grams once.
BLOCK_BYTES = 16 << 20
#: Characters worked on at once within a task.
RUN_CHARS = 1 << 20

#: A document is rejected beyond this quantile of the log perplexity of its language's trusted texts. These are texts that
#: the model has not seen: one in HELD_OUT, told by a hash of the text, so that copies are on one side.
QUANTILE = 0.99
HELD_OUT = 4
#: A language with fewer of them takes its own median and the quantile of the distances from the median over all languages.
LEAST_HELD = 200
#: Relative error of the quantiles is one over this.
ACCURACY = 10_000

_CONTEXT = 10  # order of a row that holds the back-off weight of a context is that of the context plus this


def _fold_table() -> np.ndarray:
    table = np.arange(1 << 16, dtype=np.uint64)
    table[[9, 10, 11, 12, 13]] = 32
    table[48:58] = 48
    return table


_FOLD = _fold_table()


def codes_of(text: str) -> np.ndarray:
    """Lower-cased characters as 16-bit codes: all digits one, white space one; those beyond U+FFFF share 4,096 codes."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return _FOLD[np.where(codes > 0xFFFF, 0xE000 + (codes & 0xFFF), codes)]


def grams_of(codes: np.ndarray, order: int) -> np.ndarray:
    """The n-grams of one order as whole numbers, by the position of their last character."""
    out = np.zeros(max(len(codes) - order + 1, 0), np.uint64)
    for k in range(order):
        out = (out << np.uint64(16)) | codes[k : len(codes) - order + 1 + k]
    return out


def _runs(texts: Iterator[str]) -> Iterator[list[np.ndarray]]:
    """Codes of texts, gathered to about RUN_CHARS; a text stays whole."""
    run, size = [], 0
    for text in texts:
        codes = codes_of(text)
        run.append(codes)
        size += len(codes)
        if size >= RUN_CHARS:
            yield run
            run, size = [], 0
    if run:
        yield run


def _signed(keys: np.ndarray) -> np.ndarray:
    return keys.astype(np.uint64).view(np.int64)


def count_grams(texts: DataFrame) -> DataFrame:
    """key and n: how often each 4-gram occurs in column 0. Summed per run in the task, then by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(t.as_py() for b in batches for t in b.column(0) if t.is_valid):
            keys, n = np.unique(np.concatenate([grams_of(c, ORDER) for c in run]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(keys)), pa.array(n.astype(np.int64))], ["key", "n"])

    return texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _suffix(key: str, order: int) -> Column:
    return F.col(key).bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))


def _context(key: str) -> Column:
    return F.shiftrightunsigned(key, 16)


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts of an order from how many n-grams occur once, twice, three and four times."""
    n1, n2, n3, n4 = (counts.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), found))


def train(texts: DataFrame) -> tuple[DataFrame | None, float]:
    """The model and the probability of a character never seen.

    The model has rows (order, key, value): order 1 to 4 with the interpolated probability of a seen n-gram,
    order 10 to 13 with the back-off weight of a context of 0 to 3 characters. The highest order counts occurrences, the
    others distinct characters before an n-gram. All counts are sharded by n-gram: grouped, and joined by context and
    by suffix; the driver sees four numbers per order. No texts: no model.
    """
    counts = {ORDER: stage_table(count_grams(texts), "grams4")}
    for order in range(ORDER - 1, 0, -1):
        above = counts[order + 1]
        counts[order] = stage_table(
            above.groupBy(_suffix("key", order + 1).alias("key")).agg(F.count("*").alias("n")), f"grams{order}"
        )
    rows, lower = [], None
    unseen = 0.0
    for order in range(1, ORDER + 1):
        table = counts[order]
        few = {r.n: r.c for r in table.filter("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()}
        d1, d2, d3 = discounts(few)
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = table.groupBy(_context("key").alias("context")).agg(
            F.sum("n").alias("total"), (F.sum(discount) / F.sum("n")).alias("weight")
        )
        if order == 1:
            first = context.first()
            if first is None:
                return None, 0.0
            vocabulary = table.count() + 1
            unseen = first.weight / vocabulary
            lower = table.select("key", ((F.col("n") - discount) / first.total + unseen).alias("value"))
        else:
            seen = (
                table.withColumn("context", _context("key"))
                .withColumn("suffix", _suffix("key", order))
                .join(context, "context")
                .join(lower.select(F.col("key").alias("suffix"), F.col("value").alias("below")), "suffix")
            )
            lower = seen.select(
                "key", ((F.col("n") - discount) / F.col("total") + F.col("weight") * F.col("below")).alias("value")
            )
            rows.append(
                context.select(F.lit(_CONTEXT + order - 1).alias("order"), F.col("context").alias("key"), F.col("weight").alias("value"))
            )
        lower = stage_table(lower, f"model{order}")
        rows.append(lower.select(F.lit(order).alias("order"), "key", "value"))
    model = rows[0]
    for more in rows[1:]:
        model = model.unionByName(more)
    return model, unseen


class _Found:
    """The rows of a model that one block asked for, by order."""

    def __init__(self, order: np.ndarray, key: np.ndarray, value: np.ndarray):
        self._parts = {}
        for o in np.unique(order):
            here = order == o
            keys = key[here].view(np.uint64)
            by_key = np.argsort(keys, kind="stable")
            self._parts[int(o)] = keys[by_key], value[here][by_key]

    def get(self, order: int, keys: np.ndarray, missing: float) -> np.ndarray:
        known, values = self._parts.get(order, (np.array([], np.uint64), np.array([])))
        out = np.full(len(keys), missing)
        if len(known):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            out[hit] = values[at[hit]]
        return out

    def log_probability(self, keys: np.ndarray, order: int, unseen: float) -> np.ndarray:
        """Of the last character of each n-gram after the others: seen, or the weight of the context times the next order."""
        below = np.full(len(keys), unseen)
        for o in range(1, order + 1):
            gram = keys & np.uint64((1 << 16 * o) - 1)
            seen = self.get(o, gram, np.nan)
            if o == 1:
                backed = below
            else:
                backed = below * self.get(_CONTEXT + o - 1, gram >> np.uint64(16), 1.0)
            below = np.where(np.isnan(seen), backed, seen)
        return np.log(below)


def _asked(run: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Every n-gram and context that scoring these texts looks up."""
    grams = np.unique(np.concatenate([grams_of(c, ORDER) for c in run]))
    short = {o: [grams_of(c[:o], o) for c in run if len(c) >= o] for o in range(1, ORDER)}
    out = {ORDER: grams}
    for o in range(ORDER - 1, 0, -1):
        parts = [out[o + 1] & np.uint64((1 << 16 * o) - 1), *short[o]]
        out[o] = np.unique(np.concatenate(parts))
    contexts = {_CONTEXT + o - 1: np.unique(out[o] >> np.uint64(16)) for o in range(2, ORDER + 1)}
    return out | contexts


def _score(run: list[np.ndarray], found: _Found, unseen: float) -> np.ndarray:
    """Sum of log probabilities per text."""
    lengths = np.array([max(len(c) - ORDER + 1, 0) for c in run])
    keys, inverse = np.unique(np.concatenate([grams_of(c, ORDER) for c in run]), return_inverse=True)
    each = found.log_probability(keys, ORDER, unseen)[inverse]
    ends = np.cumsum(lengths)
    total = np.concatenate([[0.0], np.cumsum(each)])
    sums = total[ends] - total[ends - lengths]
    for i, codes in enumerate(run):
        for o in range(1, min(ORDER, len(codes) + 1)):
            sums[i] += found.log_probability(grams_of(codes[:o], o), o, unseen)[0]
    return sums


def log_perplexities(docs: DataFrame, model: DataFrame, unseen: float, carried: list[str]) -> DataFrame:
    """`carried` columns, n_chars and log_perplexity (per character; null for empty texts) of every row of `docs`,
    which holds `_text` and `_bytes`.

    Rows are dealt by a hash into blocks of bounded text, moved once and compressed; both uses of a block read the
    same shuffle. A block asks for its distinct n-grams, the requests meet the sharded model, the answers meet the block.
    """
    total = docs.agg(F.sum("_bytes")).first()[0] or 0
    blocks = int(total // BLOCK_BYTES) + 1
    dealt = docs.withColumn("_block", F.pmod(F.xxhash64(*carried, "_text"), F.lit(blocks)).cast("int"))
    kept = [f for f in dealt.schema.fields if f.name in (*carried, "_block")]
    columns = [f.name for f in kept]

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            packed = pa.array([squeeze(t.as_py().encode()) for t in batch.column(len(columns))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], packed], [*columns, "_packed"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    packed = (
        dealt.select(*columns, "_text")
        .mapInArrow(compress, f"{kinds}, _packed binary")
        .repartition(max(blocks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_block")
    )

    def unpacked(table: pa.Table) -> Iterator[str]:
        unpack = zstandard.ZstdDecompressor().decompress
        for value in table.column("_packed"):
            yield unpack(value.as_py()).decode()

    def ask(table: pa.Table) -> pa.Table:
        parts: dict[int, list[np.ndarray]] = {}
        for run in _runs(unpacked(table)):
            for order, keys in _asked(run).items():
                parts.setdefault(order, []).append(keys)
        merged = {o: np.unique(np.concatenate(p)) for o, p in parts.items()}
        order = np.concatenate([np.full(len(k), o, np.int32) for o, k in merged.items()])
        key = np.concatenate([_signed(k) for k in merged.values()])
        block = np.full(len(key), table.column("_block")[0].as_py(), np.int32)
        return pa.table({"_block": block, "order": order, "key": key})

    requests = packed.groupBy("_block").applyInArrow(ask, "_block int, order int, key long")
    answers = requests.join(model, ["order", "key"]).select("_block", "order", "key", "value")

    def score(texts: pa.Table, rows: pa.Table) -> pa.Table:
        found = _Found(*(rows.column(c).to_numpy() for c in ("order", "key", "value")))
        lengths, sums = [], []
        for run in _runs(unpacked(texts)):
            lengths += [len(c) for c in run]
            sums += _score(run, found, unseen).tolist()
        out = {c: texts.column(c) for c in carried}
        out["n_chars"] = pa.array(lengths, pa.int64())
        out["log_perplexity"] = pa.array([-s / n if n else None for s, n in zip(sums, lengths)], pa.float64())
        return pa.table(out)

    result = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept if f.name != "_block")
    return (
        packed.groupBy("_block")
        .cogroup(answers.groupBy("_block"))
        .applyInArrow(score, f"{result}, n_chars long, log_perplexity double")
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the documents that are labelled good and not toxic, and nowhere otherwise."""
    return (
        labels.groupBy("doc_id")
        .agg(F.min(F.coalesce(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int"), F.lit(0))).alias("good"))
        .filter("good = 1 AND doc_id IS NOT NULL")
        .select("doc_id")
    )


def kneser_ney(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = QUANTILE,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, lang, n_chars, perplexity, threshold, kept.

    Trained on the texts of trusted documents but one in HELD_OUT. Each language has its own threshold, a quantile over
    its trusted texts that were held out; one without any takes that over all, and without a model or texts held out all
    is kept. Null and empty texts have
    no perplexity and are kept: other rules judge them. Ids and languages may be null, rows may be repeated
    and each is scored. Other columns are left out.
    """
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"),
        F.col(lang).cast("string").alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    ).withColumn("_bytes", F.octet_length("_text").cast("long"))
    trusted = trusted_ids(labels)
    held_out = F.pmod("text_hash", F.lit(HELD_OUT)) == 0
    good = lookup_join(whole.where(~held_out).select("doc_id", "text_hash", "_text"), trusted, ["doc_id"], "left_semi", spread=["text_hash"], stage=True)
    model, unseen = train(good.select("_text"))
    carried = ["doc_id", "text_hash", "lang"]
    if model is None:
        return whole.select(
            "doc_id",
            "text_hash",
            "lang",
            F.length("_text").cast("long").alias("n_chars"),
            F.lit(None).cast("double").alias("perplexity"),
            F.lit(None).cast("double").alias("threshold"),
            F.lit(True).alias("kept"),
        )
    model = stage_table(model, "model")
    scored = stage_table(log_perplexities(whole, model, unseen, carried), "scored")
    # Which texts are trusted is told to the narrow table of results, not to the texts once more.
    fit = lookup_join(scored.filter(held_out & F.col("log_perplexity").isNotNull()), trusted, ["doc_id"], "left_semi", spread=["text_hash"], stage=True)
    fit = stage_table(fit.select("lang", "log_perplexity"), "held-out")

    def points(c: str, *at: float) -> Column:
        return F.percentile_approx(c, F.array(*map(F.lit, at)), F.lit(ACCURACY))

    own = fit.filter("lang IS NOT NULL").groupBy("lang").agg(points("log_perplexity", 0.5, quantile).alias("p"), F.count("*").alias("n"))
    own = stage_table(own, "languages")
    off = lookup_join(fit, own, ["lang"], spread=["log_perplexity"]).select((F.col("log_perplexity") - F.col("p")[0]).alias("off"))
    spread = off.agg(points("off", quantile)[0].alias("x")).first().x
    over_all = fit.agg(points("log_perplexity", quantile)[0].alias("x")).first().x
    shared = F.col("p")[0] + F.lit(spread).cast("double")
    by_lang = own.select("lang", F.when(F.col("n") >= LEAST_HELD, F.col("p")[1]).otherwise(shared).alias("_own"))
    judged = lookup_join(scored, by_lang, ["lang"], "left", spread=["doc_id", "text_hash"], stage=True)
    threshold = F.coalesce("_own", F.lit(over_all).cast("double"))
    return judged.select(
        "doc_id",
        "text_hash",
        "lang",
        "n_chars",
        F.exp("log_perplexity").alias("perplexity"),
        F.exp(threshold).alias("threshold"),
        F.coalesce(F.col("log_perplexity") <= threshold, F.lit(True)).alias("kept"),
    )


def keep_likely(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` that the classifier keeps, with the columns of `docs`."""
    return without(docs, kneser_ney(docs, labels, **settings).filter("NOT kept"))
