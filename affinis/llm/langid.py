r"""Language identification: the family first, then one against one within it.

A text is the relative frequencies of its lower-case byte n-grams (2 to 4 bytes), hashed to 2**BITS places. Linear
support vector machines, one against the rest, choose the family; within a family of several languages a linear
machine for each pair votes, and the sum of the margins breaks ties, then the name. Families are those of FAMILIES;
a language that isn't there is a family by itself.

Defined cases: null texts and texts without a letter are `und` with score 0; texts are read whole; rows are
predicted one by one, so repeated rows agree; an empty table gives an empty result; if there is nothing to learn from
(no language at all) every row is `und` with score 0; with one language learned, that one is predicted with
score 1. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import crc_mod
from affinis.llm.linear import dual_coordinate_descent

BITS = 15
#: Documents of a language that are learned from, about, and twice that at most (the documented bound).
ROWS_PER_LANGUAGE = 700
#: ISO 639-1 codes of languages that are close to each other.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "malayic": ("id", "ms"),
}
_SCALE = 30.0


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang.lower().split("-")[0] in langs), f"only {lang}")


def hashed(text: str) -> np.ndarray:
    """The place of each n-gram, repeats included; a short text is padded with spaces."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    four = (three[:-1] << np.uint32(8)) | b[3:]
    shift = np.uint32(32 - BITS)
    return np.concatenate([g * np.uint32(m) >> shift for g, m in ((two, 0x9E3779B1), (three, 0x85EBCA77), (four, 0xC2B2AE3D))]).astype(np.int32)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def training_rows(documents: DataFrame, *, per_language: int = ROWS_PER_LANGUAGE) -> list:
    """(lang, places, frequencies): of each language the documents whose id has the smallest hashes, the same ones in each run."""
    own = documents.where(F.col("lang").isNotNull() & (crc_mod("doc_id", 4) != 2))
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    whole = (1 << 63) - 1
    # the share of hashes that leaves about per_language documents of each language
    limits = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(whole, int(whole * per_language / n)))])
    place = F.xxhash64("doc_id").bitwiseAND(F.lit(whole))
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            kept = [(d, p, lang, np.unique(hashed(t), return_counts=True)) for d, p, lang, t in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "place", "lang", "text")), strict=True) if has_letter(t)]
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in kept], batch.schema.field("doc_id").type), pa.array([x[1] for x in kept], pa.int64()), pa.array([x[2] for x in kept]), pa.array([x[3][0].astype("<i4").tobytes() for x in kept], pa.binary()), pa.array([x[3][1].astype("<i4").tobytes() for x in kept], pa.binary())],
                    ["doc_id", "place", "lang", "grams", "counts"],
                )

    picked = own.select("doc_id", place.alias("place"), "lang", "text").where(F.col("place") <= F.element_at(limits, F.col("lang")))
    found = picked.mapInArrow(run, f"doc_id {kind}, place long, lang string, grams binary, counts binary").dropDuplicates(["doc_id", "lang"]).collect()
    out, taken = [], {}
    for r in sorted(found, key=lambda r: (r["lang"], r["place"], str(r["doc_id"]))):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= 2 * per_language:
            n = np.frombuffer(r["counts"], "<i4").astype(np.float64)
            out.append((r["lang"], np.frombuffer(r["grams"], "<i4").astype(np.int64), _SCALE * n / n.sum()))
    return out


class Model:
    """weights: a column for each linear machine; families and pairs say which column tells what from what."""

    def __init__(self, rows: list, *, cost: float = 10.0, epochs: int = 15):
        self.langs = sorted({r[0] for r in rows})
        self.families = sorted({family_of(x) for x in self.langs})
        self.members = {f: [x for x in self.langs if family_of(x) == f] for f in self.families}
        columns, self.bias = [], []
        self.family_column, self.pair_column = {}, {}

        def learn(chosen, positive):
            w, b = dual_coordinate_descent([r[1] for r in chosen], [r[2] for r in chosen], [1 if positive(r[0]) else -1 for r in chosen], 1 << BITS, cost=cost, epochs=epochs)
            columns.append(w * _SCALE)
            self.bias.append(b)
            return len(columns) - 1

        if len(self.families) == 2:  # one machine tells both
            k = learn(rows, lambda x: family_of(x) == self.families[0])
            self.family_column = {self.families[0]: (k, 1.0), self.families[1]: (k, -1.0)}
        elif len(self.families) > 2:
            self.family_column = {f: (learn(rows, lambda x, f=f: family_of(x) == f), 1.0) for f in self.families}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                self.pair_column[(a, b)] = learn([r for r in rows if r[0] in (a, b)], lambda x, a=a: x == a)
        self.weights = np.array(columns, np.float32).T.reshape(1 << BITS, len(columns)).copy()

    def plain(self) -> dict:
        """The model as arrays, lists and dicts, which a worker can read that has no such class."""
        return {"langs": self.langs, "families": self.families, "members": self.members, "family_column": self.family_column, "pair_column": self.pair_column, "bias": self.bias, "weights": self.weights}

    def predict(self, text: str | None) -> tuple[str, float]:
        return predicted(self.plain(), text)


def predicted(model: dict, text: str | None) -> tuple[str, float]:
    """Language and score of a text by Model.plain()."""
    if not model["langs"] or not has_letter(text):
        return "und", 0.0
    bias, weights, families, pairs = model["bias"], model["weights"], model["families"], model["pair_column"]
    margin = (weights[hashed(text)].mean(axis=0, dtype=np.float64) + bias) if bias else np.zeros(0)
    sure = 1.0
    family = families[0]
    if len(families) > 1:
        by = {f: s * float(margin[k]) for f, (k, s) in model["family_column"].items()}
        family = max(families, key=lambda f: (by[f], f))
        sure = _sigmoid(2 * by[family])
    members = model["members"][family]
    votes = {x: [0, 0.0] for x in members}
    rivals: dict[str, list[float]] = {x: [] for x in members}
    for a, b in combinations(members, 2):
        m = float(margin[pairs[(a, b)]])
        votes[a if m >= 0 else b][0] += 1
        for x, own in ((a, m), (b, -m)):
            votes[x][1] += own
            rivals[x].append(own)
    lang = max(members, key=lambda x: (*votes[x], x))
    return lang, sure * _sigmoid(2 * min(rivals[lang], default=300.0))


def _sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-min(max(x, -300.0), 300.0))))


def predict(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of documents."""
    model = documents.sparkSession.sparkContext.broadcast(Model(training_rows(documents)).plain())  # 128 KB for each machine at any input

    def run(batches):
        m = model.value
        for batch in batches:
            found = [predicted(m, t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
