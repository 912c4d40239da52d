"""Quality classifier, quality rules, language ID."""

import random
import re
import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from affinis.llm import langid, linear, quality, queries, rules


def rows_of(df):
    return df.collect()


def test_descent_separates_and_meets_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5)) + np.repeat([[2.0], [-2.0]], 30, axis=0)
    y = np.repeat([1, -1], 30)
    w, b = linear.dual_coordinate_descent([np.arange(5)] * 60, list(x), y, 5, epochs=400, tolerance=1e-9)
    assert (np.sign(x @ w + b) == y).all()

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()

    best = loss(w, b)
    assert all(loss(w + rng.normal(size=5) * s, b + rng.normal() * s) >= best - 1e-6 for s in (0.3, 0.05, 0.01) for _ in range(50))


def test_quality_is_learned(spark, tiny):
    out = {r["doc_id"]: r for r in queries.op1_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    held = [(out[r["doc_id"]]["predicted"], r["quality"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(out[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in labels)
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_quality_odd(odd_documents, odd_labels, odd_rows):
    out = rows_of(quality.score(odd_documents, odd_labels))
    assert len(out) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    same = {r["score"] for r in out if r["doc_id"] == 3}
    assert len(same) == 1
    kept = rows_of(quality.keep_good(odd_documents, odd_labels))
    assert kept and kept[0].__fields__ == odd_documents.columns
    assert Counter(r["doc_id"] for r in kept) == Counter(r["doc_id"] for r in out if r["predicted"])


def test_quality_without_rows_or_labels(no_documents, odd_documents, odd_labels, no_labels):
    assert not rows_of(quality.score(no_documents, odd_labels))
    assert {r["score"] for r in rows_of(quality.score(odd_documents, no_labels))} == {0.5}
    one = odd_labels.where("quality = 0")
    assert {r["predicted"] for r in rows_of(quality.score(odd_documents, one))} == {0}


def test_ngrams_are_distinct_and_stable():
    grams = quality.make_ngrams()
    a = grams(b"one two two two three")
    assert len(a) == len(set(a.tolist())) and (grams(b"one two two two three") == a).all() and len(grams(b"")) == 0


def brute_repeats(words, k=5):
    seen = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return len({j for i in range(len(words) - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words(words):
    assert rules.repeated_words(words) == brute_repeats(words)


def test_repeated_words_large_vocabulary():
    words = [f"w{k}" for k in range(30_000)] * 2
    assert rules.repeated_words(words) == 60_000


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab#*$ \n\t\x0b é", max_size=80))
def test_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    assert rules.statistics(text) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), brute_repeats(words))


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 2, 0.3), (200, 0, 0.01), (50, 49, 0.9)):
        assert rules.tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)
    assert rules.certified(0, 2000, 0.01, 1e-4) and not rules.certified(0, 100, 0.01, 1e-4) and not rules.certified(30, 2000, 0.01, 1e-4)


def test_rules_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    out = rows_of(queries.op3_quality_rules(spark, sf))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(out) == len(texts)
    for r in out:
        s = rules.statistics(texts[r["doc_id"]])
        assert tuple(r[k] for k in rules.STATS) == s
        assert r["base_failed"] == (s[0] < 10 or 100 * s[4] > 20 * s[0]) and (not r["kept"] or not r["base_failed"])


def test_thresholds_keep_the_risk(spark):
    """Bad texts full of symbols, good ones almost without: the certified cutoff rejects the bad ones, and few good ones."""
    rows = [(i, "xx", 50, 200, 60 if i % 4 == 0 else (2 if i % 997 == 1 else 0), 0, 0) for i in range(8000)]
    stats = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(8000)], "doc_id long, quality int")
    cut = rules.thresholds(stats, labels)
    assert 0 < cut[("xx", "symbols")] <= 1200
    few = rules.thresholds(stats.where("doc_id < 200"), labels)
    assert not few


def test_all_rules_together_keep_the_risk(spark):
    """Five disjoint groups of good documents, 0.4% each, that a rule each would reject: certified rules reject 1% of fresh ones at most."""

    def rows(seed, n):
        rng, out = random.Random(seed), []
        for i in range(n):
            good, x = rng.random() < 0.8, rng.random()
            group = int(x / 0.004) if good else rng.randrange(5)
            own = [(60, 200, 0, 0), (0, 200, 0, 9), (0, 200, 9, 0), (0, 900, 0, 0), (0, 60, 0, 0)][group] if group < 5 else (0, 250, 0, 0)
            out.append((i, "xx", 50, own[1], own[0], own[2], own[3], int(good)))
        return out

    kinds = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    learned = rows(1, 25_000)
    cut = rules.thresholds(spark.createDataFrame([r[:7] for r in learned], kinds), spark.createDataFrame([(r[0], r[7]) for r in learned], "doc_id long, quality int"))
    assert 1 <= len(cut) < 5
    fresh = [dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), r[2:7], strict=True)) for r in rows(2, 50_000) if r[7]]
    assert sum(any(rules.rejects(r, c, s) for (_, r), c in cut.items()) for s in fresh) <= 0.01 * len(fresh)


def test_rules_odd(odd_documents, odd_labels, no_documents, no_labels, odd_rows):
    out = rows_of(rules.verdicts(odd_documents, odd_labels))
    assert len(out) == len(odd_rows)
    assert {r["kept"] for r in out if r["doc_id"] in (100, 101, 102, 105)} == {False}
    kept = rows_of(rules.keep_good(odd_documents, odd_labels))
    assert Counter(r["doc_id"] for r in kept) == Counter(r["doc_id"] for r in out if r["kept"]) and kept[0].__fields__ == odd_documents.columns
    assert not rows_of(rules.verdicts(no_documents, odd_labels)) and not rows_of(rules.keep_good(no_documents, no_labels))
    assert all(r["kept"] != r["base_failed"] for r in rows_of(rules.verdicts(odd_documents, no_labels)))


def test_languages_are_learned(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in queries.op6_language_id(spark, sf).collect()}
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    held = [(out[r["doc_id"]]["lang_pred"], r["lang"]) for r in truth if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(out[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in truth)
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_three_families_and_single_members():
    rng = np.random.default_rng(1)
    words = {"en": "the and of", "de": "der und von", "fr": "le et de la", "es": "el y del los", "fi": "ja on ei", "xx": "qq zz ww"}
    rows, texts = [], []
    for lang, own in words.items():
        for _ in range(40):
            text = " ".join(rng.choice(own.split(), 30))
            places, n = np.unique(langid.hashed(text), return_counts=True)
            rows.append((lang, places.astype(np.int64), langid._SCALE * n / n.sum()))
            texts.append((lang, text))
    model = langid.Model(rows)
    assert all(model.predict(t)[0] == lang for lang, t in texts)
    import pickle

    assert b"affinis" not in pickle.dumps(model.plain())  # workers need not have the package
    assert langid.family_of("xx") == "only xx" and langid.family_of("de") == langid.family_of("en")


def test_languages_odd(odd_documents, no_documents, odd_rows):
    out = rows_of(langid.predict(odd_documents))
    assert len(out) == len(odd_rows)
    assert {(r["lang_pred"], r["score"]) for r in out if r["doc_id"] in (100, 101, 102, 109)} == {("und", 0.0)}
    assert all(0 <= r["score"] <= 1 for r in out)
    assert not rows_of(langid.predict(no_documents))
    from pyspark.sql import functions as F

    assert {r["lang_pred"] for r in rows_of(langid.predict(odd_documents.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}
