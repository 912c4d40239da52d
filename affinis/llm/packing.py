"""Packing token ids into windows: minimum bin slack.

A document's ids are cut at each full window; what remains is shorter than a window, so all remainders together are
a multiset over window-1 lengths, whatever the size of the corpus. On that histogram a bitset subset-sum
dynamic program (bit s: some choice of remainders has s ids in all) finds the choice that fills a window closest to its
capacity; it is traced back to counts by length and applied as often as the counts allow. Where even the
best choice leaves slack, one more remainder is cut to fill it and its rest returns to the multiset. The last ids,
fewer than a window, fill windows of powers of two, which need no padding. The driver holds that histogram and a list
of rank intervals bounded by it; documents find their places by their rank among the remainders of their length.

Defined cases: null text counts as empty and is its end id alone; repeated rows are packed each; an empty table
gives no piece; extra columns are ignored; texts of any length are packed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinis.llm.common import written
from affinis.llm.tokens import binary, default_tokenizer, encoder

WINDOW = 2048
#: Groups that rows are dealt to for ranks and running sums; each group is sorted by itself.
BUCKETS = 4096
#: Documents that are tokenized at a time.
SOME = 512
_KEY = 1 << 48


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The counts by length whose sum is nearest to the capacity from below; longer ones are preferred."""
    reach, items, goal, mask = 1, [], 1 << capacity, (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left > 0:
            k = min(k, left)
            items.append((reach, length, k))
            reach |= (reach << (length * k)) & mask
            left, k = left - k, k * 2
        if reach & goal:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, k in reversed(items):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + k
            total -= length * k
    return chosen


def solve(histogram: dict[int, int], window: int = WINDOW) -> tuple[dict[str, np.ndarray], int]:
    """Rank intervals, sorted by (length, first rank), and the number of windows.

    Members of a length are used in rank order. An interval that places them whole puts member t at
    window base + t // each, offset + (t % each) * length. One that cuts them puts the first `head` ids at the
    offset of window base + t; the rest is member tail_rank + t of the length that is left.
    """
    counts = {n: c for n, c in histogram.items() if n > 0 and c > 0}
    used = dict.fromkeys(range(1, window), 0)
    made = {n: counts.get(n, 0) for n in used}
    out: list[tuple] = []
    base = 0
    left = sum(n * c for n, c in counts.items())
    while left:
        capacity = window if left >= window else 1 << (left.bit_length() - 1)
        chosen = fullest(counts, capacity)
        fill = sum(n * c for n, c in chosen.items())
        cut = None
        if fill < capacity:  # then each remainder that is left over is longer than the gap
            cut = max(n for n, c in counts.items() if c > chosen.get(n, 0))
        times = min(counts[n] // (c + (n == cut)) for n, c in chosen.items()) if chosen else counts[cut]
        if cut is not None and cut not in chosen:
            times = min(times, counts[cut])
        times = min(times, left // capacity)
        at = 0
        for n in sorted(chosen, reverse=True):
            out.append((n, used[n], base, chosen[n], at, 0, 0))
            used[n] += chosen[n] * times
            counts[n] -= chosen[n] * times
            at += chosen[n] * n
        if cut is not None:
            gap = capacity - fill
            out.append((cut, used[cut], base, 1, at, gap, made[cut - gap]))
            used[cut] += times
            counts[cut] -= times
            made[cut - gap] += times
            counts[cut - gap] = counts.get(cut - gap, 0) + times
        counts = {n: c for n, c in counts.items() if c}
        base += times
        left -= times * capacity
    out.sort()
    names = ("length", "rank", "base", "each", "offset", "head", "tail_rank")
    return {k: np.array([r[i] for r in out], np.int64) for i, k in enumerate(names)}, base


def place(plan: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray):
    """Yields (row number, ids of the remainder before the piece, piece length, window, offset) arrays."""
    keys = plan["length"] * _KEY + plan["rank"]
    row, done = np.flatnonzero(length), np.zeros(int((length > 0).sum()), np.int64)
    length, rank = length[row], rank[row]
    while len(row):
        k = np.searchsorted(keys, length * _KEY + rank, side="right") - 1
        t = rank - plan["rank"][k]
        head = plan["head"][k]
        each = plan["each"][k]
        yield row, done, np.where(head > 0, head, length), plan["base"][k] + t // each, plan["offset"][k] + np.where(head > 0, 0, t % each * length)
        go = head > 0
        row, done, length, rank = row[go], done[go] + head[go], length[go] - head[go], plan["tail_rank"][k][go] + t[go]


def tokenized(documents: DataFrame, *, tokenizer: str | None = None, end_id: int = 1, slots: int | None = None) -> DataFrame:
    """row_id, doc_id, n_tokens, ids (little-endian unsigned 32-bit, end id last); row_id tells rows apart."""
    path = tokenizer or default_tokenizer()
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches):
        encode, part, serial = encoder(path, slots), TaskContext.get().partitionId(), 0
        for batch in batches:
            for k in range(0, batch.num_rows, SOME):
                own = batch.slice(k, SOME)
                ids, bounds = encode.ids(own.column("text"), end_id)
                rows = np.arange(serial, serial + own.num_rows) + (part << 40)
                serial += own.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(rows), own.column("doc_id"), pa.array(np.diff(bounds)), binary(ids, bounds)], ["row_id", "doc_id", "n_tokens", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, f"row_id long, doc_id {kind}, n_tokens long, ids binary")


def positions(lengths: DataFrame, *, window: int = WINDOW, buckets: int = BUCKETS) -> DataFrame:
    """From (row_id, n_tokens): row_id and arrays of each piece's start, length, sequence_id, offset.

    Ranks and running sums are made in buckets by hash of row_id, with the sums of the buckets before added: no length
    and no group of copies is gathered in one task.
    """
    spark = lengths.sparkSession
    rows = lengths.select("row_id", (F.col("n_tokens") % window).alias("rest"), F.floor(F.col("n_tokens") / window).alias("full"), F.pmod(F.xxhash64("row_id"), F.lit(buckets)).alias("bucket"))
    by_length = rows.groupBy("rest", "bucket").agg(F.count("*").alias("n"))
    ranks = by_length.select("rest", "bucket", (F.sum("n").over(W.partitionBy("rest").orderBy("bucket")) - F.col("n")).alias("rank0"))
    by_bucket = rows.groupBy("bucket").agg(F.sum("full").alias("n"))  # at most `buckets` rows
    sums = by_bucket.select("bucket", (F.sum("n").over(W.orderBy("bucket")) - F.col("n")).alias("full0"))
    histogram = {r["rest"]: r["n"] for r in by_length.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    plan, windows = solve(histogram, window)
    placed = (
        rows.withColumn("fulls", F.sum("full").over(W.partitionBy("bucket").orderBy("row_id")) - F.col("full"))
        .withColumn("rank", F.row_number().over(W.partitionBy("bucket", "rest").orderBy("row_id")) - 1)
        .join(ranks, ["rest", "bucket"]).join(F.broadcast(sums), "bucket")
        .select("row_id", "full", "rest", (F.col("rank") + F.col("rank0")).alias("rank"), (F.col("fulls") + F.col("full0")).alias("fulls"))
    )
    held = spark.sparkContext.broadcast(plan)  # bounded by the window, not by the corpus

    def run(batches):
        kind = pa.list_(pa.int64())
        for batch in batches:
            row_id, full, rest, rank, fulls = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("row_id", "full", "rest", "rank", "fulls"))
            n = len(row_id)
            row = np.repeat(np.arange(n), full)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
            parts = [(row, nth * window, np.full(len(row), window), windows + fulls[row] + nth, np.zeros(len(row), np.int64))]
            for r, done, length, sequence, offset in place(held.value, rest, rank):
                parts.append((r, full[r] * window + done, length, sequence, offset))
            cols = [np.concatenate([p[k] for p in parts]) for k in range(5)]
            order = np.lexsort((cols[1], cols[0]))
            cuts = pa.array(np.concatenate(([0], np.cumsum(np.bincount(cols[0], minlength=n)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), *(pa.ListArray.from_arrays(cuts, pa.array(c[order], pa.int64())).cast(kind) for c in cols[1:])],
                ["row_id", "starts", "lengths", "sequences", "offsets"],
            )

    a = "array<bigint>"
    return placed.mapInArrow(run, f"row_id long, starts {a}, lengths {a}, sequences {a}, offsets {a}")


def packed(documents: DataFrame, *, tokenizer: str | None = None, end_id: int = 1, window: int = WINDOW, slots: int | None = None) -> DataFrame:
    """doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset: a row for each piece.

    Texts are tokenized once, to a written table; lengths alone are ranked; the places then join the ids by row.
    """
    ids = written(tokenized(documents, tokenizer=tokenizer, end_id=end_id, slots=slots), "ids")
    places = positions(ids.select("row_id", "n_tokens"), window=window)
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("starts", "lengths", "sequences", "offsets")}
            n = batch.column("starts").to_pylist()
            data = batch.column("ids").to_pylist()
            rows = np.repeat(np.arange(len(n)), [len(x) for x in n])
            for k in out:
                out[k] = batch.column(k).flatten()
            cut = [data[r][4 * a : 4 * (a + m)] for r, a, m in zip(rows.tolist(), out["starts"].to_pylist(), out["lengths"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows)), out["starts"], out["lengths"], pa.array(cut, pa.binary()), batch.column("n_tokens").take(pa.array(rows)), out["sequences"], out["offsets"]],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return ids.join(places, "row_id").mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def with_crc(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
