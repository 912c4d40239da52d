r"""Mixing sources to target weights: blocks, multinomial draws, pseudorandom index permutations.

The words of a source, its documents one after the other, are packed into blocks of fixed length. The mix is a
sequence of slots, a block each, dealt to output shards; each shard draws how many of its slots go to each source
from a multinomial distribution over what is left of the sources' quotas, so quotas are met in the end. The
slots of a source are numbered through all shards; slot j takes the block whose index is the image of
j mod (number of blocks) under a keyed permutation, a new one for each pass over the source. Blocks join the
documents' pieces by index. The last slot of a source takes only the words that its target still needs.

A source's target is its share by weight of share * all words, but `most` times its size at most; what is beyond
is shared anew by weight among the others until none is above. Sources are in order of code point, null last.

Defined cases: null text has no words; documents without words are taken 0 times; a null source is a source
of its own; an empty table gives an empty mix; repeated rows are documents each; extra columns are
ignored by mix() and kept by mixed_documents(). A run over the same rows gives the same mix.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinis.llm.common import written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 256
SLOTS_PER_SHARD = 4096
#: Groups of a source's documents, each sorted and summed by itself.
BUCKETS = 1024
#: A row of numbers for each source is held by the driver; beyond so many, make coarser sources first.
MAX_SOURCES = 10_000
#: Groups of shards that the driver draws for, at most.
GROUPS = 1024
WORD = r"[^\x20\x09-\x0D]+"
_word = re.compile(WORD)


def targets(sizes: Sequence[int], weights: Sequence[float], *, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take of each source."""
    goal, out, open_ = share * sum(sizes), [0.0] * len(sizes), [k for k, n in enumerate(sizes) if n > 0]
    while open_ and goal > 0:
        unit = goal / sum(weights[k] for k in open_)
        full = [k for k in open_ if weights[k] * unit >= most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = weights[k] * unit
            break
        for k in full:
            out[k] = most * sizes[k]
            goal -= out[k]
        open_ = [k for k in open_ if k not in set(full)]
    return out


def draws(quotas: np.ndarray, per_shard: int, seed: int) -> np.ndarray:
    """Multinomial counts of each source by shard, as a (shards, sources) array whose columns add up to the quotas."""
    left = np.array(quotas, np.int64)
    rng = np.random.default_rng(seed)
    out = []
    while total := int(left.sum()):
        need, got = min(per_shard, total), np.zeros(len(left), np.int64)
        while need:  # what a source can't give any more is drawn again from the others
            open_ = left - got
            more = np.minimum(rng.multinomial(need, open_ / open_.sum()), open_)
            got += more
            need -= int(more.sum())
        out.append(got)
        left -= got
    return np.array(out, np.int64).reshape(len(out), len(left))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Images of indices under keyed permutations of range(n): a Feistel network on 2k bits, walked until inside."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.ones(len(index), bool)
    while todo.any():
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = x >> h, x & m
        for turn in range(4):
            f = (right + k + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, left ^ ((f >> np.uint64(29)) & m)
        out[todo] = (left << h) | right
        todo[todo] = out[todo] >= n[todo].astype(np.uint64)
    return out.astype(np.int64)


def measured(documents: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, _size in words, _bucket, and hashes of the text and of what else names a row."""
    return documents.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("_bucket"), F.xxhash64("text").alias("_hash"), F.xxhash64("doc_id", "source").alias("_who"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """measured rows with _nth, the number in the source's bucket, and _start, the source's words before the document.

    The order of a source is by bucket (hash of doc_id), doc_id, text hash; running sums are made bucket by bucket.
    """
    inside = W.partitionBy("source", "_bucket").orderBy("doc_id", "_hash")
    rows = rows.withColumn("_nth", F.row_number().over(inside))
    sums = rows.groupBy("source", "_bucket").agg(F.sum("_size").alias("_n"))
    sums = sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), (F.sum("_n").over(W.partitionBy("source").orderBy("_bucket")) - F.col("_n")).alias("_start0"))
    rows = rows.withColumn("_within", F.sum("_size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("_size"))
    joined = rows.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("_start", F.col("_within") + F.col("_start0")).drop("_s", "_b", "_start0", "_within")


class Plan:
    """Targets, quotas of slots and draws of each source; its size is that of sources and shards, not of documents."""

    def __init__(self, rows: DataFrame, *, weights=WEIGHTS, share=SHARE, most=MOST, block_words=BLOCK_WORDS, per_shard=SLOTS_PER_SHARD, seed=17):
        found = rows.groupBy("source").agg(F.sum("_size").alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        self.spark, self.block_words, self.per_shard, self.seed = rows.sparkSession, block_words, per_shard, seed
        self.sources = [r["source"] for r in found]
        self.sizes = [int(r["n"]) for r in found]
        self.targets = targets(self.sizes, [weights[k % len(weights)] for k in range(len(found))], share=share, most=most)
        self.words = [round(t) for t in self.targets]
        self.blocks = [-(-n // block_words) for n in self.sizes]
        # slots: whole passes, then as many as hold the words that are left; the short last block may cost one more
        self.slots = [0 if not n else w // n * b + (0 if not w % n else min(b, -(-(w % n) // block_words) + 1)) for n, b, w in zip(self.sizes, self.blocks, self.words, strict=True)]
        # drawn for a bounded number of groups of shards here, and for the shards of a group in its task
        self.shards = -(-sum(self.slots) // (per_shard * GROUPS))
        self.draws = draws(np.array(self.slots, np.int64), max(1, self.shards) * per_shard, seed)

    def frame(self) -> DataFrame:
        rows = [(k, s, n, t) for k, (s, n, t) in enumerate(zip(self.sources, self.sizes, self.targets, strict=True))]
        return self.spark.createDataFrame(rows, "_k int, _source string, source_size long, target double")

    def slot_table(self) -> DataFrame:
        """_k (source number), block, pass, words, shard: a row for each slot, made where it is needed."""
        spark = self.spark
        held = spark.sparkContext.broadcast((self.draws, *(np.array(x, np.int64) for x in (self.sizes, self.blocks, self.words)), self.block_words, self.per_shard, self.shards, self.seed))

        def run(batches):
            counts, sizes, blocks, words, length, per_shard, shards, seed = held.value
            before = np.concatenate((np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, axis=0)))
            lasts: dict[int, np.ndarray] = {}

            def key(k, turn):
                return k * 1_000_003 + turn * 7_919 + seed

            def last_slots(turn: int) -> np.ndarray:
                """Of each source, the slot of the pass that takes its last block."""
                if turn not in lasts:
                    lasts[turn] = np.array([inverse(n - 1, n, key(k, turn)) if n else 0 for k, n in enumerate(blocks.tolist())], np.int64)
                return lasts[turn]

            for batch in batches:
                for group in batch.column("id").to_pylist():
                    first = before[group].copy()
                    for nth, own in enumerate(draws(counts[group], per_shard, seed + 1 + group)):
                        k = np.repeat(np.arange(len(own)), own)
                        slot = np.arange(len(k)) - np.repeat(np.cumsum(own) - own, own) + first[k]
                        first += own
                        n = blocks[k]
                        turn, j = slot // n, slot % n
                        block = permuted(j, n, key(k, turn))
                        short = length - (sizes[k] - (n - 1) * length)  # what the source's last block lacks
                        earlier = np.zeros(len(k), bool)
                        for t in np.unique(turn).tolist():
                            earlier |= (turn == t) & (last_slots(t)[k] < j)
                        done = turn * sizes[k] + j * length - np.where(earlier, short, 0)
                        got = np.clip(words[k] - done, 0, np.where(block == n - 1, length - short, length))
                        shard = np.full(len(k), group * shards + nth)
                        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(block), pa.array(turn), pa.array(got), pa.array(shard)], ["_k", "_block", "_pass", "_words", "_shard"])

        return spark.range(len(self.draws)).mapInArrow(run, "_k int, _block long, _pass long, _words long, _shard long")


def inverse(image: int, n: int, key: int) -> int:
    """The index whose image is given: the same network backwards."""
    half = max(1, (int(np.ceil(np.log2(max(n, 2)))) + 1) // 2)
    mask, word, x = (1 << half) - 1, (1 << 64) - 1, image
    while True:
        left, right = x >> half, x & mask
        for turn in reversed(range(4)):
            left, right = right, left
            f = (right + key + (turn + 1) * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & word
            f = (f ^ (f >> 32)) * 0xD6E8FEB86659FD93 & word
            left ^= (f >> 29) & mask
        x = (left << half) | right
        if x < n:
            return x


def _pieces(rows: DataFrame, block_words: int) -> DataFrame:
    """_k, _bucket, _nth, _block, _at (in the block), _from (in the document), _len: the parts of documents in blocks."""
    size = F.lit(block_words)
    first, last = F.floor(F.col("_start") / size), F.floor((F.col("_start") + F.col("_size") - 1) / size)
    parts = rows.where("_size > 0").select("_k", "_bucket", "_nth", "_start", "_size", F.explode(F.sequence(first, last)).alias("_block"))
    begin = F.greatest(F.col("_start"), F.col("_block") * size)
    end = F.least(F.col("_start") + F.col("_size"), (F.col("_block") + 1) * size)
    return parts.select("_k", "_bucket", "_nth", "_block", (begin - F.col("_block") * size).alias("_at"), (begin - F.col("_start")).alias("_from"), (end - begin).alias("_len"))


def _with_source(rows: DataFrame, plan: Plan) -> DataFrame:
    return rows.join(F.broadcast(plan.frame()), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")  # at most MAX_SOURCES rows


def mix(documents: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of documents."""
    sizes = written(measured(documents), "sizes")
    plan = Plan(sizes, **how)
    rows = _with_source(numbered(sizes), plan)
    slots = plan.slot_table().groupBy("_k", "_block").agg(F.collect_list("_words").alias("_takes"))  # a block is in few passes
    got = (
        _pieces(rows, plan.block_words).join(slots.hint("merge"), ["_k", "_block"])  # its size is that of the mix, though Spark thinks it small
        .select("_k", "_bucket", "_nth", F.aggregate("_takes", F.lit(0).cast("long"), lambda a, w: a + F.greatest(F.lit(0), F.least(F.col("_len"), w - F.col("_at")))).alias("n"))
        .groupBy("_k", "_bucket", "_nth").agg(F.sum("n").alias("taken"))
    )
    out = rows.join(got, ["_k", "_bucket", "_nth"], "left")
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """The mix as rows of documents, with their columns: a row for each document and pass that takes words of it.

    text has the words that the pass takes, in the document's order, with the white space that is between them; a document
    that is taken whole keeps its text as it is. n_chars, if there is one, is counted anew.
    """
    sizes = written(measured(documents), "sizes")
    plan = Plan(sizes, **how)
    rows = written(_with_source(numbered(sizes), plan), "numbered")
    spans = (
        _pieces(rows, plan.block_words).join(plan.slot_table().hint("merge"), ["_k", "_block"])
        .withColumn("_take", F.least(F.col("_len"), F.col("_words") - F.col("_at"))).where("_take > 0")
        .groupBy("_k", "_bucket", "_nth").agg(F.collect_list(F.struct("_pass", "_from", "_take")).alias("_spans"))
    )
    named = rows.join(spans, ["_k", "_bucket", "_nth"]).select("_hash", "_who", "_size", "_spans")
    whole = documents.select(F.struct("*").alias("_row"), F.xxhash64("text").alias("_hash"), F.xxhash64("doc_id", "source").alias("_who"))
    key = ["_hash", "_who"]
    if sizes.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        # rows that agree in id, source and text are told apart by a number; which is which doesn't matter
        nth = F.row_number().over(W.partitionBy(*key).orderBy(*key))
        whole, key = whole.withColumn("_copy", nth), [*key, "_copy"]
        named = rows.withColumn("_copy", nth).join(spans, ["_k", "_bucket", "_nth"]).select(*key, "_size", "_spans")
    chosen = whole.join(named.hint("shuffle_hash"), key).select("_row", "_size", "_spans")  # the only shuffle of texts
    names = documents.columns

    def run(batches):
        for batch in batches:
            take, texts = [], []
            rows = batch.column("_row")
            for k, (text, size, found) in enumerate(zip(rows.field(names.index("text")).to_pylist(), batch.column("_size").to_pylist(), batch.column("_spans").to_pylist(), strict=True)):
                for part in by_pass(text, size, found):
                    take.append(k)
                    texts.append(part)
            row = rows.take(pa.array(take, pa.int64()))
            cols = dict(zip(names, row.flatten(), strict=True))
            cols["text"] = pa.array(texts, pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t) for t in texts], pa.int64()).cast(cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return chosen.mapInArrow(run, documents.schema)


def by_pass(text: str, size: int, spans: list[dict]) -> list[str]:
    """The words that each pass takes; spans: _pass, _from (first word), _take (words)."""
    passes: dict[int, list[list[int]]] = {}
    for s in sorted(spans, key=lambda s: (s["_pass"], s["_from"])):
        own = passes.setdefault(s["_pass"], [])
        if own and own[-1][1] == s["_from"]:
            own[-1][1] += s["_take"]
        else:
            own.append([s["_from"], s["_from"] + s["_take"]])
    out, at = [], None
    for own in passes.values():
        if own == [[0, size]]:
            out.append(text)
        else:
            at = at or [m.span() for m in _word.finditer(text)]
            out.append(" ".join(text[at[a][0] : at[b - 1][1]] for a, b in own))
    return out
