r"""Near copies by SimHash and BK-trees, held to the exact Jaccard similarity of word shingles.

A document's set has the XXH64 values (UTF-8, seed 42) of its five-word shingles, A-Z in lower case. Documents whose sets
have a Jaccard similarity of at least 4/5 are linked; classes are the connected components of the links.

First the fingerprints of all documents (from the same shingles) are searched by simhash's BK-trees; what lies in one class
of a shard within RADIUS bits is proposed, and verified on the whole sets. A similarity of 4/5 can lie farther apart in any
fingerprint of 64 bits (some ten bits on average), so an exact search for the rest follows, over
all documents; it verifies only pairs that the trees have not brought into one class.

The rest is exact, not drawn: of two linked sets, each has a token among the first n - ceil(4n/5) + 1 of its own n that the other has
among its first, in any order that holds for all sets (prefix filter). The order is rare tokens first, by a table of
counts whose size is fixed; it decides how many candidates there are, never which links are found. Sets that share such a token are
candidates if their sizes and the token's places allow the similarity; candidates are verified on the whole sets.
Tokens of many sets first compare all with a few hubs, and then only sets that are not yet of one class, so that a
large class of near copies takes no pairs of all with all.

Defined cases: null text has no words, and sets without tokens are equal; fewer words than a shingle make one shingle of all;
texts are read whole; of a class the row with the smallest id stays, null ids last; rows that agree in id and text stay once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import slices, written
from affinis.llm.simhash import components, fingerprint_of, rows_of, shingle_digests, stars

SHINGLE_WORDS = 5
#: Bits in which fingerprints may differ that the BK-trees bring together.
RADIUS = 6
#: Bits of a token that choose its count.
BUCKET_BITS = 18
#: Sets of one token that are compared all with all; beyond, first with so many hubs, in so many rounds.
SMALL, HUBS, HUB_ROUNDS = 64, 8, 3
#: Rows to verify that are named by a broadcast of their 8-byte hashes; beyond, by a shuffled join.
BROADCAST_ROWS = 500_000
#: Links that one task joins to classes (16 MB of them); beyond, rounds of all tasks.
ALONE = 1 << 20
_SLICE = 4096
_MIX = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def tokens(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The set of a text, as sorted signed 64-bit integers."""
    return set_of(shingle_digests(text, width))


def set_of(digests: np.ndarray) -> np.ndarray:
    return np.unique(digests.view(">i8").astype(np.int64).ravel())


def token_prints(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, key (a hash of the set), fp (the fingerprint) for each row; and for each task, rows of part and n: how many tokens fall in each bucket.

    Sets themselves aren't kept: they take more room than the texts, and are made again where they are needed.
    """

    def run(batches):
        from xxhash import xxh64_digest

        counts, kind = np.zeros(1 << BUCKET_BITS, np.int64), None
        names = ["doc_id", "text_hash", "key", "fp", "part", "n"]
        for batch in slices(batches):
            keys, fps, kind = [], [], batch.schema.field("doc_id").type
            for t in batch.column("text"):
                digests = shingle_digests(t.as_py(), SHINGLE_WORDS)
                s = set_of(digests)
                keys.append(xxh64_digest(s.tobytes(), 42))
                fps.append(fingerprint_of(digests))
                np.add.at(counts, _buckets(s), 1)
            none = [pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.frombuffer(b"".join(keys), ">i8").astype(np.int64)), pa.array(fps, pa.int64()), *none], names)
        if counts.any():
            parts = counts.reshape(-1, _SLICE)
            none = [pa.nulls(len(parts), t) for t in (kind, pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(len(parts)), pa.int32()), pa.array(list(parts), pa.list_(pa.int64()))], names)

    return _rows(documents).select("doc_id", "text", "text_hash").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, text_hash long, key long, fp long, part int, n array<long>")


def _rows(documents: DataFrame) -> DataFrame:
    """doc_id, text, text_hash, row: a hash of id and text."""
    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).withColumn("row", F.xxhash64("doc_id", "text_hash"))


def token_sets(rows: DataFrame) -> DataFrame:
    """key, s: the sets of texts."""

    def run(batches):
        from xxhash import xxh64_digest

        for batch in slices(batches):
            sets = [tokens(t.as_py()) for t in batch.column("text")]
            keys = np.frombuffer(b"".join([xxh64_digest(s.tobytes(), 42) for s in sets]), ">i8").astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), lists], ["key", "s"])

    return rows.select("text").mapInArrow(run, "key long, s array<long>")


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def token_counts(prints: DataFrame) -> np.ndarray:
    """How many tokens of all sets fall in each bucket."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(batch.column("part").to_pylist(), batch.column("n"), strict=True):
                sums[part] = sums.get(part, 0) + n.values.to_numpy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["part", "n"])

    out = np.zeros(1 << BUCKET_BITS, np.int64).reshape(-1, _SLICE)
    for r in prints.where("part IS NOT NULL").select("part", "n").repartition("part").mapInArrow(add, "part int, n array<long>").collect():  # 64 rows
        out[r["part"]] = r["n"]
    return out.ravel()


def prefixes(documents: DataFrame, prints: DataFrame) -> DataFrame:
    """token, key, n, place, label: the first tokens of each set, rare ones first; n: the set's size."""
    held = documents.sparkSession.sparkContext.broadcast(token_counts(prints))  # 2 MB at any input

    def run(batches):
        from xxhash import xxh64_digest

        counts, seen = held.value, set()
        for batch in slices(batches):
            found: list[np.ndarray] = []
            keys, sizes = [], []
            for t in batch.column("text"):
                s = tokens(t.as_py())
                key = int.from_bytes(xxh64_digest(s.tobytes(), 42), signed=True)
                if key not in seen and len(s):
                    seen.add(key)
                    n = len(s)
                    found.append(s[np.lexsort((s, counts[_buckets(s)]))[: n + (-4 * n // 5) + 1]])
                    keys.append(key)
                    sizes.append(n)
            if found:
                many = [len(f) for f in found]
                key = pa.array(np.repeat(np.array(keys, np.int64), many))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), key, pa.array(np.repeat(np.array(sizes, np.int32), many)), pa.array(np.concatenate([np.arange(m, dtype=np.int32) for m in many])), key],
                    ["token", "key", "n", "place", "label"],
                )

    return documents.select("text").mapInArrow(run, "token long, key long, n int, place int, label long")


def candidates(members: DataFrame, step: int) -> DataFrame:
    """(a, b, null): pairs of sets to verify; (null, null, token): a token of which pairs are left to later steps."""
    by, mix = ["token", "key", "n", "place", "label"], np.uint64(_MIX[step % len(_MIX)])

    def group(key, n, place, label):
        """Positions of the pairs, and whether all are there."""
        rest = n - place
        asked = range(len(key)) if len(key) <= SMALL or step >= HUB_ROUNDS else np.argsort(key.view(np.uint64) * mix)[:HUBS].tolist()
        out = []
        for i in asked:
            fit = (label != label[i]) & (5 * np.minimum(n, n[i]) >= 4 * np.maximum(n, n[i])) & (9 * np.minimum(rest, rest[i]) >= 4 * (n + n[i]))
            if isinstance(asked, range):
                fit[:i] = False
            out += [(i, j) for j in np.flatnonzero(fit).tolist()]
        return out, isinstance(asked, range)

    def run(batches):
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
                held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            if held is None:
                continue
            token = held[0]
            edge = np.concatenate(([0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]))
            if batch is not None:  # the last token may go on
                edge = edge[:-1]
            a, b, left = [], [], []
            for k in np.flatnonzero(np.diff(edge) > 1).tolist():
                key, n, place, label = (c[edge[k] : edge[k + 1]] for c in held[1:])
                first = np.concatenate(([True], key[1:] != key[:-1]))
                key, n, place, label = key[first], n[first].astype(np.int64), place[first].astype(np.int64), label[first]
                if (label == label[0]).all():
                    continue
                found, whole = group(key, n, place, label)
                for i, j in found:
                    a.append(min(key[i], key[j]))
                    b.append(max(key[i], key[j]))
                if not whole:
                    left.append(token[edge[k]])
            if a or left:
                none = [None]
                yield pa.RecordBatch.from_arrays([pa.array(a + none * len(left), pa.int64()), pa.array(b + none * len(left), pa.int64()), pa.array(none * len(a) + left, pa.int64())], ["a", "b", "token"])
            held = [c[edge[-1] :] for c in held] if batch is not None else None

    return members.select(*by).repartition("token").sortWithinPartitions("token", "key").mapInArrow(run, "a long, b long, token long")


def _with_end(batches):
    yield from batches
    yield None


def verified(pairs: DataFrame, documents: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): the pairs whose sets have a Jaccard similarity of at least 4/5. distinct: each set's key and the row that stands for it."""
    nodes = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = written(distinct.join(nodes, "key", "left_semi").select(F.xxhash64("own.doc_id", "own.text_hash").alias("row")).distinct(), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    own = written(token_sets(_rows(documents).join(F.broadcast(wanted) if few else wanted, "row", "left_semi")), "sets").dropDuplicates(["key"])
    both = pairs.join(own.select(F.col("key").alias("a"), F.col("s").alias("x")), "a").join(own.select(F.col("key").alias("b"), F.col("s").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(9 * common >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def proposed(distinct: DataFrame) -> DataFrame:
    """(a, b): pairs of sets to verify, from the BK-trees: of equal fingerprints, and each one's with the first of its class in a shard."""
    first = written(distinct.groupBy("own.fp").agg(F.min("key").alias("first")), "fingerprints")
    near = stars(first.select("fp"), first.count(), radius=RADIUS).distinct()
    near = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    equal = distinct.select("own.fp", F.col("key").alias("x")).join(first.withColumnRenamed("first", "y"), "fp").where("x <> y")
    both = near.select("x", "y").union(equal.select("x", "y"))
    return written(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "proposed")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sets are not of one class yet."""
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("a", "b"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where("coalesce(_a, a) <> coalesce(_b, b)").select("a", "b")


def links(documents: DataFrame, prints: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b): sets of one class, enough links to connect all of it: those by fingerprint, then the rest."""
    found = written(verified(proposed(distinct), documents, distinct), "verified")
    roots = components(found, alone=ALONE)
    members, step = written(prefixes(documents, prints), "prefixes"), 0
    while True:
        out = written(candidates(members, step), "candidates")
        pairs = out.where("token IS NULL").select("a", "b").distinct()
        found = found.union(written(verified(written(apart(pairs, roots), "pairs"), documents, distinct), "verified"))
        left = out.where("token IS NOT NULL").select("token").distinct()
        if not left.limit(1).count():
            return found
        roots = components(found, alone=ALONE)
        open_ = members.drop("label").join(left, "token", "left_semi")
        members = written(open_.join(roots, open_["key"] == roots["node"], "left").select("token", "key", "n", "place", F.coalesce("root", "key").alias("label")), "prefixes")
        step += 1


def keep_one(documents: DataFrame) -> DataFrame:
    """Of each class the row of documents with the smallest id, all its columns."""
    prints = written(token_prints(documents), "prints")
    rows = prints.where("part IS NULL").select("doc_id", "text_hash", "key", "fp")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("text_hash"), F.col("fp"))).alias("own")
    distinct = written(rows.groupBy("key").agg(least), "distinct")
    roots = components(links(documents, prints, distinct), alone=ALONE)
    named = distinct.join(roots, distinct["key"] == roots["node"], "left").select("own", F.coalesce("root", "key").alias("root"))
    return rows_of(documents, rows, named.groupBy("root").agg(F.min("own").alias("first")))
