r"""Near-duplicates by SimHash and BK-trees.

A document's fingerprint has 64 bits: of the XXH64 values (UTF-8, seed 42) of its word shingles, the bits that are
set in over half of them. Documents whose fingerprints differ in at most `radius` bits are linked; classes are the
connected components of the links.

Equal fingerprints meet first, so only distinct ones are searched. The 64 bits are cut into radius + 1 + extra blocks;
fingerprints within the radius agree in at least 1 + extra blocks, so each choice of that many blocks, with their
values, is a shard in which they may meet. In a shard a BK-tree (children keyed by the integer Hamming distance to the parent,
leaves of a few fingerprints) is searched with the shard's own fingerprints, following only edges within
the radius. A shard's tree stands in the task that the shuffle sends the shard to; nothing that grows with the corpus is
broadcast. A shard of more than SHARD_LIMIT fingerprints is split into chunks, and each pair of
chunks is a task of its own. A task returns a spanning star for each class that it finds, not all pairs. The classes of
all stars together come from alternating large-star and small-star rounds, each written to the shared folder.

Defined cases: null text has no words, and its fingerprint is zero, linked like any other; fewer words than a
shingle make one shingle of all; texts are read whole; repeated rows are linked like copies; component_id is the
smallest id that isn't null (null if there is none); an empty table gives an empty result; extra columns are ignored
by classes() and kept by keep_one().
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import written

SHINGLE_WORDS = 4
RADIUS = 4
SHARD_LIMIT = 4096
LEAF = 64


def shingle_digests(text: str | None, width: int) -> np.ndarray:
    """The XXH64 values of a text's word shingles, 8 bytes each, high byte first."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()  # on bytes: A-Z and the ASCII spaces alone
    if not words:
        return np.empty((0, 8), np.uint8)
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    last = ends.tolist()
    step = min(width, len(words)) - 1
    digests = b"".join([xxh64_digest(joined[a:b], 42) for a, b in zip(starts[:n], last[step : step + n], strict=True)])
    return np.frombuffer(digests, np.uint8).reshape(-1, 8)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """As a signed 64-bit integer."""
    return fingerprint_of(shingle_digests(text, width))


def fingerprint_of(data: np.ndarray) -> int:
    n = len(data)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        counts += np.unpackbits(data[k : k + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprints(documents: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp, and a hash of the text."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(t.as_py(), width) for t in batch.column("text")], pa.int64()), batch.column("text_hash")], ["doc_id", "fp", "text_hash"])

    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, fp long, text_hash long")


class Classes:
    """Union-find over positions; the smallest position stands for its class."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def labels(self, at: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.find, at.tolist()), np.int64, len(at))


def bk_tree(fps: np.ndarray, at: np.ndarray):
    """(pivot, {distance: subtree}), or an array of positions for a leaf."""
    root: list = [None]
    todo = [(at, root, 0)]
    while todo:
        own, parent, key = todo.pop()
        if len(own) <= LEAF:
            parent[key] = own
            continue
        pivot, rest = int(own[0]), own[1:]
        d = np.bitwise_count(fps[rest] ^ fps[pivot])
        children: dict = {}
        parent[key] = (pivot, children)
        for k in np.unique(d).tolist():
            todo.append((rest[d == k], children, k))
    return root[0]


def link(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct fingerprints: the position of the first one of each one's class."""
    n = len(fps)
    classes = Classes(n)
    tree = bk_tree(fps, np.arange(n))
    todo = [(tree, np.arange(n))]
    while todo:
        node, asked = todo.pop()
        if isinstance(node, np.ndarray):
            for k in range(0, len(asked), 1024):
                some = asked[k : k + 1024]
                near = np.bitwise_count(fps[some][:, None] ^ fps[node][None, :]) <= radius
                if near.sum() > 4 * len(some):  # many are one class by now
                    near &= classes.labels(some)[:, None] != classes.labels(node)[None, :]
                for i, j in np.argwhere(near).tolist():
                    if some[i] != node[j]:
                        classes.join(int(some[i]), int(node[j]))
            continue
        pivot, children = node
        d = np.bitwise_count(fps[asked] ^ fps[pivot]).astype(np.int16)
        for i in asked[d <= radius].tolist():
            classes.join(i, pivot)
        for key, child in children.items():
            some = asked[np.abs(d - key) <= radius]
            if len(some):
                todo.append((child, some))
    return classes.labels(np.arange(n))


def blocks(count: int) -> list[tuple[int, int]]:
    """(first bit, bits) of so many blocks of a fingerprint."""
    edges = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def shard_keys(distinct: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """Choices of blocks that must agree; more blocks for more fingerprints, so that chance shards stay small."""

    def cost(extra: int) -> float:
        choices = list(combinations(blocks(radius + 1 + extra), 1 + extra))
        return sum(distinct + distinct * distinct / 2.0 ** (sum(w for _, w in c) + 12) for c in choices)

    extra = min(range(6), key=cost)
    return [list(c) for c in combinations(blocks(radius + 1 + extra), 1 + extra)]


def stars(fps: DataFrame, distinct: int, *, radius: int = RADIUS, limit: int = SHARD_LIMIT) -> DataFrame:
    """(a, b): fingerprint and the first one of its class in some shard; fps has distinct ones."""
    keys = shard_keys(distinct, radius)

    def value(choice):
        out = F.lit(0).cast("long")
        for first, bits in choice:
            out = F.shiftleft(out, bits).bitwiseOR(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1)))
        return out

    shard = F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), value(c).alias("value")) for k, c in enumerate(keys)]))
    members = fps.select("fp", shard.alias("s")).select("fp", "s.choice", "s.value")
    hot = members.groupBy("choice", "value").agg(F.count("*").alias("n")).where(F.col("n") > limit)
    parts = F.coalesce(F.ceil(F.col("n") / limit), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    dealt = (
        members.join(hot, ["choice", "value"], "left").withColumn("parts", parts).withColumn("own", own)
        .select("fp", "choice", "value", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        .select("choice", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp")
    )
    by = ["choice", "value", "x", "y"]

    def found(fp: np.ndarray):
        fp = np.unique(fp)
        if len(fp) < 2:
            return None
        if len(fp) <= LEAF and not (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius).sum() > len(fp):
            return None
        first = link(fp, radius)
        on = first != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[on].view(np.int64)), pa.array(fp[first[on]].view(np.int64))], ["a", "b"]) if on.any() else None

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in by]
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            cuts = [0, *edge.tolist(), len(fp)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(int(c[a]) for c in cols)
                if now != key:
                    if sum(map(len, held)) > 1 and (out := found(np.concatenate(held))) is not None:
                        yield out
                    held, key = [], now
                held.append(fp[a:b])
        if held and (out := found(np.concatenate(held))) is not None:
            yield out

    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def _joined(batches):
    """The same as the rounds of components(), for links that one task holds."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    a, b = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in batches]) for c in ("a", "b"))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    classes = Classes(len(nodes))
    for i, j in zip(*at.reshape(2, -1).tolist(), strict=True):
        classes.join(i, j)
    roots = nodes[classes.labels(np.arange(len(nodes)))]
    yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != roots]), pa.array(roots[nodes != roots])], ["node", "root"])


def components(edges: DataFrame, *, alone: int = 0) -> DataFrame:
    """(node, root): each node that has a link to a smaller class mate, and the smallest node of its class.

    Up to `alone` links are joined in one task, more in rounds of all tasks: the classes are the same, but rounds take some ten jobs each.
    """
    edges = written(edges.where("a <> b").distinct(), "links")
    if alone and edges.count() <= alone:
        return written(edges.coalesce(1).mapInArrow(_joined, "node long, root long"), "links")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = written(small.where("a <> b").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def class_table(prints: DataFrame, *, radius: int = RADIUS) -> DataFrame:
    """fp, first: each distinct fingerprint and the least (doc_id, text_hash) of its class, null ids last."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("text_hash"))).alias("own")
    distinct = written(prints.groupBy("fp").agg(least), "fingerprints")
    n = distinct.count()
    roots = components(stars(distinct.select("fp"), n, radius=radius))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    firsts = named.groupBy("root").agg(F.min("own").alias("first"))
    return named.join(firsts, "root").select("fp", "first")


def classes(documents: DataFrame, *, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of documents."""
    prints = written(fingerprints(documents, width), "prints")
    found = class_table(prints, radius=radius)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.select("doc_id", "fp").join(found, "fp").select("doc_id", hexed.alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_one(documents: DataFrame, *, width: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """Of each class the row of documents with the smallest id, all its columns."""
    prints = written(fingerprints(documents, width), "prints")
    return rows_of(documents, prints, class_table(prints, radius=radius))


def rows_of(documents: DataFrame, prints: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows of documents that firsts (first: doc_id, text_hash) names, all their columns; prints: these two of each row."""
    kept = written(firsts.select("first.doc_id", "first.text_hash").distinct(), "kept").select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    again = prints.join(kept, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left_semi")
    repeated = again.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    row = documents.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))
    out = row.join(kept.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h")), "left_semi")
    if repeated:  # rows that agree in id and text: one of them stays
        out = out.dropDuplicates(["_id", "_th"])
    return out.select("_row.*")
