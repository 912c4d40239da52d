"""Token files, packing, mixing."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from affinis.llm import dac, mixing, packing, queries, tokens


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aZé1!_,.'s \n\n\t\r   \u0085\x1c\u200b\u3000\u180e\u0301日²<|>", max_size=30) | st.just("a  <|endoftext|> b"), max_size=6), st.sampled_from([16, 1 << 19]))
def test_ids_of_cut_texts_are_those_of_the_whole(texts, size):
    encoder = tokens.encoder(tokens.default_tokenizer())
    before, tokens.SLICE = tokens.SLICE, size
    try:
        ids, bounds = encoder.ids(pa.array(texts, pa.string()), 7)
    finally:
        tokens.SLICE = before
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [[*encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.binary(ids, bounds).to_pylist()] == [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


def test_full_tables_are_emptied(monkeypatch, reference):
    monkeypatch.setattr(tokens, "SLOTS", 64)
    encoder = tokens.Encoder(tokens.default_tokenizer())
    rng = random.Random(3)
    for _ in range(20):
        texts = ["".join(rng.choice("abc, é") for _ in range(40)) for _ in range(2)]
        ids, _ = encoder.ids(pa.array(texts), 1)
        assert ids.tolist() == [i for t in texts for i in (*reference(t), 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300), st.integers(0, 5))
def test_codes_round_trip(ids, spread):
    ids = np.array([i >> (spread * 3) for i in ids], np.uint32)
    file = dac.TokenFile(dac.encode_file(ids, ["x"] and [7], [0]))
    assert file.tokens(0, len(ids)).tolist() == ids.tolist()
    for k in range(0, len(ids), 7):
        assert file.token(k) == ids[k] and file.tokens(k, min(5, len(ids) - k)).tolist() == ids[k : k + 5].tolist()


def test_codes_are_smaller_than_fixed_width_and_have_levels():
    rng = np.random.default_rng(0)
    ids = np.minimum(rng.zipf(1.3, 20_000), 50_000).astype(np.uint32)
    data = dac.encode_file(ids, [1], [0])
    assert len(dac.level_widths(ids)) > 1 and len(data) < 2 * len(ids)


def test_token_files(spark, tiny, reference):
    out = sorted(queries.op5_token_files(spark, tiny).collect(), key=lambda r: r["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    at = 0
    assert [r["doc_id"] for r in out] == sorted(texts)
    for r in out:
        ids = np.array([*reference(texts[r["doc_id"]]), 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_odd(spark, odd_documents, no_documents, odd_rows, reference, tmp_path):
    folder = f"file://{tmp_path}/files"
    files = dac.write(odd_documents, folder, tokens_per_file=5_000)
    assert files.count() > 4
    out = sorted(dac.read(spark, folder, files).collect(), key=lambda r: r["start"])
    expected = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert [r["doc_id"] for r in out] == [r[0] for r in expected]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in out] == [[*reference(r[1]), 2] for r in expected]
    assert [r["start"] for r in out] == np.concatenate(([0], np.cumsum([len(r["ids"]) // 4 for r in out])))[:-1].tolist()
    assert dac.round_trip(no_documents).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_places_fill_windows(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 16, 64, 2048])
    counts = {rng.randint(1, window - 1): rng.choice([1, 2, 5, 50, 1000]) for _ in range(rng.randint(0, 40))}
    plan, windows = packing.solve(counts, window)
    length = np.array([n for n, c in counts.items() for _ in range(c)], np.int64)
    rank = np.array([k for c in counts.values() for k in range(c)], np.int64)
    found, covered = defaultdict(list), np.zeros(len(length), np.int64)
    for row, done, size, at, offset in packing.place(plan, length, rank):
        for r, d, n, w, o in zip(row.tolist(), done.tolist(), size.tolist(), at.tolist(), offset.tolist(), strict=True):
            found[w].append((o, n))
            covered[r] += n
    assert (covered == length).all() and sorted(found) == list(range(windows))
    for own in found.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= window and at & (at - 1) == 0


def test_fullest_is_best():
    for seed in range(200):
        rng = random.Random(seed)
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(4)}
        capacity = rng.randint(5, 25)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        chosen = packing.fullest(counts, capacity)
        assert all(counts[n] >= c for n, c in chosen.items())
        assert sum(n * c for n, c in chosen.items()) == max(s for s in sums if s <= capacity)


def check_pieces(pieces, ids_of):
    """ids_of: list of (doc_id, ids); repeated rows are told apart by nothing, so documents are compared as multisets."""
    windows, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
        by_doc[p["doc_id"]].append(p)
    for own in windows.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    for doc_id, own in by_doc.items():
        expected = sorted((p.start, p.stop) for p in ())
        lengths = Counter(len(x) for d, x in ids_of if d == doc_id)
        assert sum(p["length"] for p in own) == sum(n * c for n, c in lengths.items()) and not expected
        assert {p["doc_tokens"] for p in own} == set(lengths)
    return windows


def test_packing(spark, tiny, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    ids = {d: np.array([*reference(t), 1], "<u4") for d, t in texts.items()}
    out = queries.op4_packing(spark, tiny).collect()
    check_pieces(out, list(ids.items()))
    for p in out:
        assert p["ids_crc32"] == zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]].tobytes())


def test_packing_odd(odd_documents, no_documents, odd_rows, reference):
    out = packing.packed(odd_documents).collect()
    ids_of = [(r[0], [*reference(r[1]), 1]) for r in odd_rows]
    check_pieces(out, ids_of)
    whole = defaultdict(list)
    for p in out:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert any(d == p["doc_id"] and x[p["start"] : p["start"] + p["length"]] == ids for d, x in ids_of)
        whole[p["doc_id"]].append((p["start"], p["length"]))
    assert sorted(whole[104])[0][0] == 0 and packing.packed(no_documents).collect() == []


def test_permutations_and_their_inverse():
    for n in (1, 2, 3, 7, 100, 1000, 4097):
        for key in (1, 5, 99):
            image = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(image.tolist()) == list(range(n))
            assert [mixing.inverse(int(image[i]), n, key) for i in range(0, n, max(1, n // 9))] == list(range(0, n, max(1, n // 9)))


def test_draws_meet_quotas():
    quotas = np.array([1000, 3, 0, 5000, 777])
    out = mixing.draws(quotas, 64, 3)
    assert (out.sum(axis=0) == quotas).all() and (out.sum(axis=1)[:-1] == 64).all() and (out >= 0).all()


def test_targets():
    assert mixing.targets([100, 100], [3, 1]) == [200.0, 100.0]
    out = mixing.targets([10, 1000, 1000, 0], [3, 1, 2, 3])
    assert out[0] == 20 and out[3] == 0 and sum(out) == pytest.approx(1.5 * 2010) and out[1] * 2 == pytest.approx(out[2])
    assert mixing.targets([], []) == [] and mixing.targets([0], [1]) == [0.0]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def check_mix(out, rows):
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.targets([sizes[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))]), strict=True))
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], len(words(r[1]))) for r in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    taken = defaultdict(int)
    for r in out:
        taken[(r["source_size"], r["target"])] += r["taken"]
    expected = defaultdict(float)
    for s in order:
        expected[(sizes[s], targets[s])] += targets[s]
    assert all(abs(taken[k] - v) <= 1 + len(order) for k, v in expected.items())


def test_mix(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    first, second = (sorted(queries.op2_mixing(spark, tiny).collect()) for _ in range(2))
    assert first == second
    check_mix(first, rows)


def test_mix_odd(odd_documents, no_documents, odd_rows):
    check_mix(mixing.mix(odd_documents).collect(), odd_rows)
    assert mixing.mix(no_documents).collect() == [] and mixing.mixed_documents(no_documents).collect() == []


def test_mixed_documents_have_the_words_taken(odd_documents, odd_rows):
    taken, got = Counter(), Counter()
    for r in mixing.mix(odd_documents).collect():
        taken[r["doc_id"]] += r["taken"]
    out = mixing.mixed_documents(odd_documents)
    assert out.columns == odd_documents.columns
    texts = defaultdict(set)
    for r in odd_rows:
        texts[r[0]].add(r[1])
    for r in out.collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert any(set(words(r["text"])) <= set(words(t)) for t in texts[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert +taken == +got


def test_small_shards_give_the_same_totals(odd_documents, odd_rows):
    check_mix(mixing.mix(odd_documents, block_words=16, per_shard=8).collect(), odd_rows)
