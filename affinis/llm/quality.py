r"""Quality classifier: Naive Bayes support vectors.

n-gram indicators of a text are scaled by the log ratio of their smoothed shares in the two classes; a
linear hinge-loss model is fitted to them by dual coordinate descent. The n-grams are byte trigrams, words,
word pairs, and three patterns (a word that equals the one, the two, the three before it), hashed to
2**BITS places. Only the text enters a score.

Defined cases: null text counts as the empty text, which has no n-grams and gets the score of the model's
bias; texts of any length are scored whole; rows are scored one by one, so repeated rows get equal scores;
an empty table gives an empty result; labels of a doc_id that contradict each other are averaged (at least
one half: 1), labels without a value or an id teach nothing. Without labels every score is 0.5; with one
class only, every score is that class's (0.75 or 0.25). Extra columns are ignored by score() and kept by
keep_good().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import crc_mod, slices
from affinis.llm.linear import dual_coordinate_descent

BITS = 18
#: The most labelled documents that the model is fitted on (the documented bound), half for each class.
MAX_TRAINING_ROWS = 4000


def make_ngrams():
    """A function from UTF-8 bytes to the distinct hashed n-grams; it keeps one scratch array."""
    size = 1 << BITS
    stamp = np.zeros(size, np.int64)
    rng = np.random.default_rng(11)
    byte_code = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    place = rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
    shift = np.uint64(64 - BITS)
    mult = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    is_space = np.zeros(256, bool)
    is_space[[9, 10, 11, 12, 13, 32]] = True

    def ngrams(data: bytes) -> np.ndarray:
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            return np.zeros(0, np.int64)
        parts = []
        if len(b) >= 3:
            c = b.astype(np.uint64)
            parts.append(((c[:-2] << np.uint64(16)) | (c[1:-1] << np.uint64(8)) | c[2:]) * mult[0] >> shift)
        inside = ~is_space[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            at = np.flatnonzero(inside)
            lengths = ends - starts
            first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            within = np.arange(len(at)) - np.repeat(first, lengths)
            word = np.add.reduceat(byte_code[b[at]] * place[within & 63], first) + lengths.astype(np.uint64)
            parts.append(word * mult[1] >> shift)
            parts.append((word[:-1] * mult[2] + word[1:]) * mult[0] >> shift)
            equal = word[1:] == word[:-1]
            same2 = equal[1:] & equal[:-1]
            same3 = same2[1:] & same2[:-1]
            found = [k for k, e in enumerate((equal, same2, same3)) if e.any()]
            parts.append(np.array(found, np.uint64) * mult[1] + np.uint64(1) >> shift)
        h = np.concatenate(parts).astype(np.int64)
        order = np.arange(len(h))
        stamp[h] = order
        return h[stamp[h] == order]

    return ngrams


def _features(batches):
    ngrams = make_ngrams()
    for batch in batches:
        texts, quality, ids = batch.column("text"), batch.column("quality"), batch.column("doc_id")
        yield pa.RecordBatch.from_arrays(
            [ids, quality, pa.array([ngrams((t.as_py() or "").encode()).astype("<u4").tobytes() for t in texts], pa.binary())], ["doc_id", "quality", "grams"]
        )


def training_rows(documents: DataFrame, labels: DataFrame, *, max_rows: int = MAX_TRAINING_ROWS) -> list:
    """(doc_id, quality, n-grams) of at most max_rows labelled documents that are not held out, the same ones in each run."""
    own = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) != 1))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    )
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [own.where(F.col("quality") == k).orderBy(*by_hash).limit(max_rows // 2) for k in (0, 1)]
    ids = picked[0].unionByName(picked[1])  # bounded by max_rows, hence the broadcast
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    found = rows.mapInArrow(_features, f"doc_id {dict(documents.dtypes)['doc_id']}, quality int, grams binary").dropDuplicates(["doc_id"]).collect()
    return sorted(((r["doc_id"], r["quality"], np.frombuffer(r["grams"], "<u4").astype(np.int64)) for r in found), key=lambda r: r[0])


def fit(rows: list, *, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 20) -> tuple[np.ndarray, float]:
    """Weights by n-gram (the log-count ratio times the linear model's weight) and the bias."""
    dim = 1 << BITS
    quality = np.array([r[1] for r in rows])
    if len(set(quality.tolist())) < 2:
        return np.zeros(dim), 0.0 if not len(quality) else float(np.log(3) / 2) * (1 if quality[0] else -1)
    counts = {k: np.full(dim, smoothing) for k in (0, 1)}
    for _, k, grams in rows:
        counts[k][grams] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = [ratio[g] / np.sqrt(max(1, len(g))) for _, _, g in rows]
    w, b = dual_coordinate_descent([r[2] for r in rows], values, quality * 2 - 1, dim, cost=cost, epochs=epochs)
    return w * ratio, b


def make_scorer(weights: np.ndarray, bias: float):
    ngrams = make_ngrams()

    def score(text: str | None) -> float:
        g = ngrams((text or "").encode())
        margin = bias + (float(weights[g].sum()) / np.sqrt(len(g)) if len(g) else 0.0)
        return float(1.0 / (1.0 + np.exp(-2.0 * min(max(margin, -300.0), 300.0))))

    return score


def trained(documents: DataFrame, labels: DataFrame):
    weights, bias = fit(training_rows(documents, labels))
    return documents.sparkSession.sparkContext.broadcast((weights.astype(np.float32), bias))  # 1 MB at any input


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of documents."""
    model = trained(documents, labels)

    def run(batches):
        scorer = make_scorer(*model.value)
        for batch in batches:
            s = np.array([scorer(t.as_py()) for t in batch.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents, all their columns, that score 0.5 or more."""
    model = trained(documents, labels)

    def run(batches):
        scorer = make_scorer(*model.value)
        for batch in slices(batches):
            yield batch.filter(pa.array([scorer(t.as_py()) >= 0.5 for t in batch.column("text")], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
