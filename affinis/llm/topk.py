r"""Exact top-k search by distributed histogram selection.

Vectors are integers floor(scale * x). For a block of queries, every candidate is scored (a matrix product in
each task); a histogram of each query's scores is summed over all tasks, the bucket that holds the kth
highest score becomes the next range, and so on until a bucket is one score wide. Then the scores above that
value, and the smallest ids among those equal to it, are kept and ranked. A task sends the highest buckets
that hold its own k highest scores, for the kth of all can't lie below them. Queries are taken in blocks of
QUERY_BLOCK, so what is broadcast is bounded; candidates are never shuffled.

Defined cases: vectors that are null or hold null, NaN or an infinity take no part, nor do rows without an id;
a shorter vector counts as padded with zeros; all finite components are exact, in doubles, 64-bit or Python's integers as
the table's largest norm asks; ranks are by exact scores, and a score beyond 64 bits is given as the nearest such integer;
each row whose id is asked for is a query by itself, repeated rows and rows that share an id too; rows with the query's id are its own
and no candidates; ties go to the smaller id; a query with fewer candidates than k gets all; an
empty table or one without queries gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from affinis.llm.common import new_path, written

QUERY_BLOCK = 4096
BUCKETS = 256
_STEP = 2048


def finite(vectors: DataFrame, *, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    fine = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return rows.where(fine)


def _integers(values: np.ndarray, scale: int, kind: str) -> np.ndarray:
    """floor(scale * x) of doubles, as doubles, 64-bit integers or Python's."""
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * values)
    if kind != "object":
        return scaled.astype(kind)
    out = np.empty(values.shape, object)
    wide = np.isinf(scaled)  # then x itself is an integer
    out[...] = np.reshape([int(x) * scale if w else int(y) for x, y, w in zip(values.ravel().tolist(), scaled.ravel().tolist(), wide.ravel().tolist(), strict=True)] or np.zeros(0), values.shape)
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scored(batches, queries: np.ndarray, ids: np.ndarray, scale: int, kind: str):
    """(candidate ids, scores with a row for each query, whether the candidate is another row than the query)."""
    step = _STEP if kind != "object" else max(1, (1 << 18) // max(1, len(ids)))
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            own = part.column("vec_id").to_numpy(zero_copy_only=False)
            scores = queries @ _integers(_matrix(part.column("v"), queries.shape[1]), scale, kind).T
            yield own, scores if kind == "object" else scores.astype(np.int64), own[None, :] != ids[:, None]


def _round(rows: DataFrame, block, low: np.ndarray, span: np.ndarray, width: np.ndarray, need: np.ndarray, buckets: int) -> list:
    """For each query that has enough candidates, the bucket of low .. low + span with the kth highest score, and the count above it."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast((*block, low, span, width, need))

    def run(batches):
        queries, ids, scale, kind, low, span, width, need = held.value
        counts = np.zeros((len(ids), buckets), np.int64)
        base = np.arange(len(ids))[:, None] * buckets
        for _, scores, other in _scored(batches, queries, ids, scale, kind):
            at = (scores - low[:, None]) // width[:, None]
            inside = other & (scores >= low[:, None]).astype(bool) & (scores - low[:, None] < span[:, None]).astype(bool)  # what is higher was counted before
            counts += np.bincount((base + np.where(inside, at, 0).astype(np.int64))[inside], minlength=counts.size).reshape(counts.shape)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], ["q", "b", "n"])

    sums = rows.mapInArrow(run, "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
    down = sums.withColumn("upto", F.sum("n").over(W.partitionBy("q").orderBy(F.col("b").desc())))
    wanted = spark.createDataFrame([(i, int(n)) for i, n in enumerate(need.tolist())], "q long, need long")
    hit = down.join(F.broadcast(wanted), "q").where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    found = hit.select("q", "b", (F.col("upto") - F.col("n")).alias("above")).collect()  # a row for each query of the block
    held.destroy()
    return found


def _block_result(rows: DataFrame, queries: np.ndarray, ids: np.ndarray, times: list[int], scale: int, kind: str, reach: np.ndarray, k: int, path: str) -> None:
    """Writes the results of a block of queries; times: the rows that each query stands for; reach: no score lies beyond."""
    spark = rows.sparkSession
    block = (queries, ids, scale, kind)
    low, span, need = -reach, 2 * reach + 1, np.full(len(ids), k, np.int64)
    open_ = np.ones(len(ids), bool)
    while open_.any():
        width = np.maximum(1, -(-span // BUCKETS))
        found = {r["q"]: (r["b"], r["above"]) for r in _round(rows, block, low, span, width, np.where(open_, need, 0), BUCKETS)}
        for i in np.flatnonzero(open_).tolist():
            if i not in found:  # fewer candidates than k: all of them
                open_[i] = False
                continue
            b, above = found[i]
            low[i] += b * width[i]
            need[i] -= above
            span[i] = width[i]
            open_[i] = width[i] > 1
    wide = max(reach.tolist()).bit_length() // 8 + 1 if kind == "object" else 0
    held = spark.sparkContext.broadcast((*block, low, need, 1 << (8 * wide - 1) if wide else 0, wide))

    def run(batches):
        queries, ids, scale, kind, low, need, shift, wide = held.value
        ties: list[list] = [[] for _ in ids]

        def table(q, c, scores):
            keys = [(shift + x).to_bytes(wide + 1, "big") for x in scores] if wide else [None] * len(scores)  # bytes that sort as the scores do
            near = [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in scores] if wide else scores
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(near, pa.int64()), pa.array(keys, pa.binary())], ["q", "vec_id", "score", "key"])

        for own, scores, other in _scored(batches, queries, ids, scale, kind):
            q, c = np.nonzero(other & (scores > low[:, None]).astype(bool))
            yield table(q, own[c], scores[q, c].tolist() if wide else scores[q, c])
            q, c = np.nonzero(other & (scores == low[:, None]).astype(bool))
            for i, start, end in zip(*_runs(q), strict=True):  # the smallest ids that can still be needed
                ties[i] = sorted([*ties[i], *own[c[start:end]].tolist()])[: int(need[i])]
        found = [(i, v, int(low[i])) for i, t in enumerate(ties) for v in t]
        if found:
            yield table(*map(list, zip(*found, strict=True)))

    best = rows.mapInArrow(run, "q long, vec_id long, score long, key binary")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.col("key").desc(), F.col("score").desc(), "vec_id"))
    asked = spark.createDataFrame([(i, int(x), n) for i, (x, n) in enumerate(zip(ids.tolist(), times, strict=True))], "q long, query_id long, n long")  # a row for each query of the block
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(asked), "q")
    ranked.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    held.destroy()


def _runs(sorted_values: np.ndarray):
    if not len(sorted_values):
        return [], [], []
    edge = np.concatenate(([0], np.flatnonzero(np.diff(sorted_values)) + 1, [len(sorted_values)]))
    return sorted_values[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist()


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose id `every` divides, the k other rows of highest inner product."""
    spark = vectors.sparkSession
    rows = written(finite(vectors), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1))
    largest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    top = rows.agg(F.max(square).alias("norm2"), F.max(F.size("v")).alias("width"), F.max(largest).alias("largest")).first()
    folder, width = new_path(spark, "topk"), max(1, top["width"] or 1)
    norm, largest = float(np.sqrt(top["norm2"] or 0.0)) * (1 + 1e-9), int(np.ceil(top["largest"] or 0.0)) * scale + 1
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("n")).orderBy("vec_id", "v")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(folder)

    def flush(some):
        raw = np.zeros((len(some), width))
        for i, r in enumerate(some):
            raw[i, : len(r["v"])] = r["v"]
        with np.errstate(over="ignore"):
            norms = np.sqrt(((np.abs(raw) * scale + 1) ** 2).sum(axis=1)) * norm
        kind = "float64" if norms.max() < 2.0**52 else "int64" if norms.max() < 2.0**61 else "object"
        queries = _integers(raw, scale, kind)
        reach = np.ceil(norms).astype(np.int64) + 1 if kind != "object" else np.array([sum(map(abs, q)) * largest + 1 for q in queries.tolist()], object)
        _block_result(rows, queries, np.array([r["vec_id"] for r in some], np.int64), [r["n"] for r in some], scale, kind, reach, k, folder)

    block: list = []
    for r in asked.toLocalIterator():  # a block at a time
        block.append(r)
        if len(block) == query_block:
            flush(block)
            block = []
    if block:
        flush(block)
    return spark.read.schema(schema).parquet(folder)
