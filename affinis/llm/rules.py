r"""Quality rules with risk-controlled thresholds.

Each rule compares a statistic of a text with a cutoff, and a text goes if any rule rejects it. In each stratum (the
language) the labelled documents are split by a hash of doc_id. The first part proposes: for each rule the cutoff
that rejects most bad documents and few good ones, the rules in the order of the bad documents they reject. The other part, the
holdout, certifies: the first rule, the first two together, and so on, as long as the exact binomial (Clopper-Pearson)
upper bound of the share of good documents that they reject together is at most `risk`. Tests in a fixed order that stop
at the first failure need no correction among themselves; the confidence is divided over the strata (Bonferroni). So
with that confidence, in every stratum, all rules together reject at most `risk` of the good documents that pass the base rule.
Without a certified step the rules reject nothing there.

Statistics of a text, by words `[^\x20\x09-\x0D]+`: n_words; word_chars, code points in words; n_symbols,
characters of `[#*$%&|<>]`; n_dup_lines, lines (cut at \n) with a word that equal an earlier line;
n_repeat_words, words that lie in a 5-word window found twice or more in the text. The base rule fails a text
of fewer than 10 words or with more than 20% repeated words.

Defined cases: null text has no words, and so fails the base rule; texts are read whole; a null stratum is a
stratum of its own; labels of a doc_id that contradict each other are averaged (at least one half: good);
repeated rows are judged each; an empty table gives an empty result; without labels only the base rule holds.
Extra columns are ignored by verdicts() and kept by keep_good().
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import slices, written

RISK = 0.01
CONFIDENCE = 0.95
#: One labelled document in so many proposes cutoffs; the others certify them.
PROPOSING = 4
#: rule: (statistic, whether more is worse, cutoffs in thousandths for each word, the most lenient first).
RULES = {
    "symbols": ("n_symbols", True, (3000, 2000, 1500, 1000, 700, 500, 300, 200, 100, 50)),
    "repeats": ("n_repeat_words", True, (200, 150, 100, 70, 50, 30, 20, 10)),
    "lines": ("n_dup_lines", True, (200, 100, 50, 20, 10, 5)),
    "long_words": ("word_chars", True, (20000, 16000, 14000, 12000, 11000, 10000, 9000, 8000)),
    "short_words": ("word_chars", False, (1200, 1500, 2000, 2500, 3000, 3500, 4000)),
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_words = re.compile(r"[^\x20\x09-\x0D]+")
_symbols = re.compile(r"[#*$%&|<>]")


def repeated_words(words: list[str], width: int = 5) -> int:
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    codes, size = ids, len(number)
    for k in range(1, width):  # exact: windows of k+1 words by the number of their first k and the next word
        if codes[: len(ids) - k].size and size * len(number) >= 1 << 62:
            _, codes = np.unique(codes, return_inverse=True)
            size = int(codes.max()) + 1
        codes = codes[: len(ids) - k] * len(number) + ids[k:]
        size *= len(number)
    _, back, counts = np.unique(codes, return_inverse=True, return_counts=True)
    twice = counts[back] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = _words.findall(text)
    lines = [x for x in text.split("\n") if _words.search(x)]
    return len(words), sum(map(len, words)), len(_symbols.findall(text)), len(lines) - len(set(lines)), repeated_words(words)


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


def rejects(rule: str, cutoff: int, stats: dict):
    """Works on numbers and on columns."""
    name, more, _ = RULES[rule]
    return stats[name] * 1000 >= stats["n_words"] * cutoff if more else stats[name] * 1000 <= stats["n_words"] * cutoff


def tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def certified(rejected: int, good: int, risk: float, error: float) -> bool:
    """Whether the exact upper bound of the rejected share, at that error, is at most the risk."""
    if good == 0 or rejected > risk * good:
        return False
    return tail(rejected, good, risk) <= error


def stats_table(documents: DataFrame) -> DataFrame:
    kind = dict(documents.dtypes)

    def run(batches):
        for batch in batches:
            found = np.array([statistics(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(found[:, k]) for k in range(len(STATS)))], ["doc_id", "lang", *STATS])

    return documents.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {kind['doc_id']}, lang {kind['lang']}, " + ", ".join(f"{s} long" for s in STATS))


def proposed(row: dict, risk: float) -> list[tuple[str, int]]:
    """(rule, cutoff) by falling numbers of rejected bad documents, from the counts of one stratum."""
    out = []
    for rule, (_, _, cuts) in RULES.items():
        best = max(((row[f"b_{rule}_{c}"], -k, c) for k, c in enumerate(cuts) if row[f"g_{rule}_{c}"] <= risk / 2 * row["good"]), default=(0, 0, 0))
        if best[0]:
            out.append((best[0], rule, best[2]))
    return [(rule, c) for _, rule, c in sorted(out, key=lambda x: (-x[0], x[1]))]


def thresholds(stats: DataFrame, labels: DataFrame, *, risk: float = RISK, confidence: float = CONFIDENCE) -> dict[tuple, int]:
    """(stratum, rule): cutoff. The driver gathers a row of counts for each stratum, twice."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("_good"))
    passed = stats.join(own, "doc_id").where(~base_fails_column()).withColumn("_first", F.pmod(F.xxhash64("doc_id"), F.lit(PROPOSING)) == 0)
    columns = {s: F.col(s) for s in STATS}

    def count(condition, name):
        return F.sum(condition.cast("long")).alias(name)

    grid = [(r, c) for r, (_, _, cuts) in RULES.items() for c in cuts]
    counts = [count(F.col("_good") & rejects(r, c, columns), f"g_{r}_{c}") for r, c in grid] + [count(~F.col("_good") & rejects(r, c, columns), f"b_{r}_{c}") for r, c in grid]
    steps = {r["lang"]: proposed(r.asDict(), risk) for r in passed.where("_first").groupBy("lang").agg(count(F.col("_good"), "good"), *counts).collect()}
    steps = {lang: some for lang, some in steps.items() if some}
    if not steps:
        return {}
    most = max(map(len, steps.values()))
    together = [F.lit(False)] * most
    for lang, some in sorted(steps.items(), key=str):
        bad = F.lit(False)
        for k, (rule, c) in enumerate(some):
            bad = bad | rejects(rule, c, columns)
            together[k] = F.when(F.col("lang").eqNullSafe(F.lit(lang)), bad).otherwise(together[k])
    held = passed.where(~F.col("_first")).groupBy("lang").agg(count(F.col("_good"), "good"), *[count(F.col("_good") & x, f"s{k}") for k, x in enumerate(together)]).collect()
    error = (1 - confidence) / len(steps)
    out: dict[tuple, int] = {}
    for row in held:
        for k, (rule, c) in enumerate(steps.get(row["lang"], ())):
            if not certified(row[f"s{k}"], row["good"], risk, error):
                break
            out[(row["lang"], rule)] = c
    return out


def base_fails_column():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdicts(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, the statistics, base_failed, kept for each row of documents. Statistics are made once, to a written table."""
    stats = written(stats_table(documents), "rules")
    cutoffs = thresholds(stats, labels, **how)
    columns = {s: F.col(s) for s in STATS}
    bad = F.lit(False)
    for (lang, rule), c in sorted(cutoffs.items(), key=str):
        bad = bad | (F.col("lang").eqNullSafe(F.lit(lang)) & rejects(rule, c, columns))
    return stats.select("doc_id", *STATS, base_fails_column().alias("base_failed"), (~base_fails_column() & ~bad).alias("kept"))


def keep_good(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of documents, all their columns, that the base rule and the certified rules keep."""
    cutoffs = thresholds(written(stats_table(documents), "rules"), labels, **how)

    def run(batches):
        for batch in slices(batches):
            keep = []
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True):
                s = dict(zip(STATS, statistics(text.as_py()), strict=True))
                keep.append(not base_fails(s["n_words"], s["n_repeat_words"]) and not any(rejects(r, cutoffs[(lang, r)], s) for r in RULES if (lang, r) in cutoffs))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
