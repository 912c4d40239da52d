"""Near copies of the pipeline against brute-force pairs."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from affinis.llm import nearcopies
from affinis.llm.simhash import components, fingerprint


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def brute_kept(rows):
    """The least id of each class of (id, text)."""
    sets, label = [brute_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return Counter(min((rows[k][0] for k in range(len(rows)) if label[k] == c and rows[k][0] is not None), default=None) for c in set(label))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("small", [64, 3])
def test_stage_against_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(nearcopies, "SMALL", small)
    monkeypatch.setattr(nearcopies, "HUBS", min(nearcopies.HUBS, small))
    rng = random.Random(small)
    line = " ".join(f"common{k}" for k in range(12))
    rows = []
    for _ in range(25):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice((4, 12, 60, 150)))]
        rows += [(len(rows) + k, f"{line} {edited(rng, words, rng.randrange(len(words) // 12 + 1))}") for k in range(rng.choice((1, 2, 5)))]
    words = [f"v{rng.randrange(300)}" for _ in range(100)]
    rows += [(1000 + k, edited(rng, words, rng.randrange(5))) for k in range(30)]
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "ONE  two"), (None, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, source string").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == brute_kept(rows)


def test_stage_on_given_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, tiny).collect()) == brute_kept(rows)


def test_links_joined_alone_or_in_rounds(spark, monkeypatch):
    """A chain of near copies: the same row stays, with far fewer jobs, of which the driver keeps records."""
    rng = random.Random(1)
    words, rows = [f"v{rng.randrange(300)}" for _ in range(100)], []
    for k in range(60):
        words[rng.randrange(100)] = f"e{k}"
        rows.append((k, " ".join(words)))
    docs, jobs = spark.createDataFrame(rows, "doc_id long, text string"), {}
    for alone in (0, nearcopies.ALONE):
        monkeypatch.setattr(nearcopies, "ALONE", alone)
        spark.sparkContext.setJobGroup(f"chain{alone}", "")
        assert Counter(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == brute_kept(rows)
        jobs[alone] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain{alone}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 3 * jobs[nearcopies.ALONE] < 2 * jobs[0]


def test_components_alone(spark):
    rng = random.Random(2)
    links = [(rng.randrange(-80, 80), rng.randrange(-80, 80)) for _ in range(70)] + [(-(2**63), 5), (2**63 - 1, 5), (7, 7)]
    for edges in (spark.createDataFrame(links, "a long, b long").repartition(3), spark.createDataFrame([], "a long, b long")):
        assert sorted(components(edges, alone=100).collect()) == sorted(components(edges).collect())


def test_trees_find_copies_and_sets_decide(spark, monkeypatch):
    """Without the search for the rest: what the BK-trees bring together by fingerprint, if the sets are alike."""
    rng = random.Random(3)
    none = spark.createDataFrame([], "a long, b long, token long")
    monkeypatch.setattr(nearcopies, "candidates", lambda members, step: none)
    rows = []
    for k in range(20):
        words = [f"w{rng.randrange(3000)}" for _ in range(400)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words[:-1], "end"])), (10 * k + 2, " ".join(["start", *words[1:-1], "end"]))]
    rows += [(500, "x x x x x"), (501, "x " * 8 + "y")]  # equal fingerprints, a similarity of one half
    assert fingerprint(rows[-1][1], 5) == fingerprint(rows[-2][1], 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == brute_kept(rows)
