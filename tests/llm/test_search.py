"""SimHash classes, top-k, licences, wrappers."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash

from affinis.llm import licenses, queries, simhash, topk, wrappers


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def brute_classes(fps):
    label = list(range(len(fps)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(fps))]


def test_classes_against_brute_force(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    out = sorted(queries.op7_simhash_dedup(spark, tiny).collect(), key=lambda r: r["doc_id"])
    fps = [brute_fingerprint(r["text"]) for r in rows]
    assert [r["fingerprint"] for r in out] == [f"{f:016x}" for f in fps]
    assert [r["component_id"] for r in out] == [rows[k]["doc_id"] for k in brute_classes(fps)]
    assert len({r["component_id"] for r in out}) < len(out)


@pytest.mark.parametrize("seed", range(8))
def test_links_of_crowded_and_sparse_shards(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 700))
    centers = rng.integers(0, 1 << 63, max(1, n // 8), dtype=np.uint64)
    f = centers[rng.integers(0, len(centers), n)]
    for _ in range(6):
        f = f ^ np.where(rng.random(n) < 0.5, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    f = np.unique(f)
    expected = brute_classes([int(x) for x in f])
    assert simhash.link(f).tolist() == expected
    if seed < 2:  # the whole plan, shards split into chunks
        fps = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.stars(fps, len(f), limit=20)).collect()}
        named = [roots.get(int(x), int(x)) for x in f.view(np.int64)]
        assert Counter(Counter(named).values()) == Counter(Counter(expected).values())
        assert len({(a, b) for a, b in zip(named, expected, strict=True)}) == len(set(expected))


def test_shards_cover_every_near_pair():
    for n in (10, 10**8, 10**10):
        keys = simhash.shard_keys(n)
        rng = random.Random(n)
        for _ in range(300):
            flips = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(all(not flips >> first & ((1 << bits) - 1) for first, bits in choice) for choice in keys)


def test_dedup_odd(odd_documents, no_documents, odd_rows):
    out = simhash.classes(odd_documents).collect()
    assert len(out) == len(odd_rows)
    fps = [brute_fingerprint(r[1]) for r in odd_rows]
    label = brute_classes(fps)
    least = {}
    for k, r in zip(label, odd_rows, strict=True):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out) == Counter((r[0], f"{f:016x}", least.get(k)) for r, f, k in zip(odd_rows, fps, label, strict=True))
    kept = simhash.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    rows = kept.collect()
    assert len(rows) == len(set(label)) and Counter(r["doc_id"] for r in rows) == Counter(least.get(k) for k in set(label))
    assert simhash.classes(no_documents).collect() == [] and simhash.keep_one(no_documents).collect() == []


VECTORS = "vec_id long, embedding array<double>, label int, score string, q int"


def brute_top(rows, k=10, every=100):
    fine = [(i, [math.floor(Fraction(x) * 1024) for x in e]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for q, v in [(i, e) for i, e in fine if i % every == 0]:
        found = sorted((-sum(a * b for a, b in zip(v, e, strict=False)), i) for i, e in fine if i != q)[:k]
        out += [(q, rank, i, min(max(-s, -(2**63)), 2**63 - 1)) for rank, (s, i) in enumerate(found, start=1)]
    return out


@pytest.mark.parametrize("block", [2, 4096])
def test_top_k_against_brute_force(spark, block):
    rng = random.Random(3)
    same = [rng.gauss(0, 0.3) for _ in range(6)]
    rows = [(i, same if i % 3 == 0 else [rng.gauss(0, 0.3) for _ in range(6)], 1, "s", 2) for i in range(420)]
    rows += [(500, None, 1, "s", 2), (600, [1.0, None], 1, "s", 2), (700, [float("nan")], 1, "s", 2), (701, [float("inf")], 1, "s", 2), (None, same, 1, "s", 2), (800, [2.0, -1.0], 1, None, 2), (801, [], None, "s", 2), rows[5], rows[5]]
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    out = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, query_block=block).collect())
    assert out == sorted(brute_top(rows))


def test_top_k_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-3.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == [(0, 1, 1, 2048 * 1024), (0, 2, 2, -3072 * 1024)]
    assert topk.top_k(df.limit(0)).collect() == [] and topk.top_k(df.where("vec_id > 0")).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**20 + i), 1.0], 0, "", 0) for i in range(0, 300)]
    out = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, VECTORS), k=3).collect())
    assert out == sorted(brute_top(rows, 3))


def test_licences(spark):
    mit = licenses._MIT_BODY
    rows = [
        (1, "The MIT Licence (MIT)\n\nCopyright (c) 2020 Somebody\n\n" + mit.replace("merge,", "MERGE ,").replace("\n\n", "\n \n"), None),
        (2, "some words\nReleased under the MIT License!\nmore words", "x"), (3, "licensed under the apache licence, version 2.0", "x"), (4, "This mentions the MIT License in passing.", "x"),
        (5, None, "x"), (6, "", "x"), (None, "Licensed under CC BY-NC 4.0.", "x"), (2, "some words\nReleased under the MIT License!\nmore words", "x"), (7, "word " * 100_000 + "\nSPDX-License-Identifier: Apache-2.0", "x"),
        (8, "Released under the MIT License.\nLicensed under the ISC License.", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string").withColumnRenamed("license", "licenses")
    out = sorted(((r["doc_id"] or 0), r["licenses"], r["n_units"]) for r in licenses.scan(df).collect())
    assert out == sorted([(1, "MIT", 1), (2, "MIT", 1), (2, "MIT", 1), (3, "Apache-2.0", 1), (4, "", 0), (5, "", 0), (6, "", 0), (0, "CC-BY-NC-4.0", 1), (7, "Apache-2.0", 1), (8, "ISC,MIT", 2)])
    assert licenses.scan(df.limit(0)).collect() == []


def test_licences_of_a_given_catalogue(spark):
    body = "Anyone may do what they like.\n\nNothing is promised."
    df = spark.createDataFrame([(1, body.upper()), (2, "Released under the MIT License."), (3, "Do as you please!")], "doc_id long, text string")
    found = licenses.scan(df, (*licenses.KNOWN, ("Own", body), ("Please", "do as you please"), ("None", "***")))
    assert sorted((r["doc_id"], r["licenses"]) for r in found.collect()) == [(1, "Own"), (2, "MIT"), (3, "Please")]


def test_every_known_text_has_the_mark():
    assert all(re.search(licenses.MARK, text.lower()) for _, text in licenses.KNOWN)


def test_scores_beyond_64_bits_rank_exactly(spark):
    rows = [(i, [sign * (x + 64.0 * i), 0.5], 0, "", 0) for i, x, sign in [(0, 1e17, 1), (1, 1e17, 1), (2, 1e17, -1), (3, 1e12, 1), (100, 1e17, -1), (101, 0.25, 1), (102, 1e17, 1), (103, -1e12, 1)]]
    out = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, VECTORS), k=4).collect())
    assert out == sorted(brute_top(rows, 4)) and len(out) == 8
    assert topk._integers(np.array([1.5e308, -0.1]), 1024, "object").tolist() == [int(1.5e308) * 1024, -103]


def test_repeated_and_shared_ids(spark, tmp_path):
    """Each row is a query by itself, in the SQL too."""
    import duckdb

    rng = random.Random(9)
    rows = [(i % 150, [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    rows += [rows[0], rows[0], rows[100]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted(tuple(r) for r in topk.top_k(df, query_block=3).collect())
    assert out == sorted(brute_top(rows))
    df.write.parquet(f"{tmp_path}/v")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS FROM read_parquet('{tmp_path}/v/*.parquet')")
    assert sorted(db.sql(queries.ORACLES["op8_exact_top_k"]).fetchall()) == out


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}<script>var x='</p>';</script></head><body>{body}</body></html>"


def extracted(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    out = wrappers.main_text(df).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in out) and len(out) == len(rows)
    return {r["page_id"]: r["text"] for r in out}


def test_articles(spark):
    rng = random.Random(1)
    rows, truth = [], {}
    for k in range(30):
        paragraphs = [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randint(5, 30))) for _ in range(rng.randint(1, 6))]
        nav = "".join(f"<li><a href='#'>m{rng.randrange(99)}</a></li>" for _ in range(rng.randint(1, 5)))
        side = "<aside>related stuff</aside>" if k % 2 else ""
        body = f"<nav><ul>{nav}</ul></nav><div class='ad banner'>buy {k}</div><article><h1>Title &amp; {k}</h1>{''.join(f'<p>{p} <b>x</b>y&nbsp;z' for p in paragraphs)}</article>{side}<div id=comments><p>nice {k}</div><footer>f {k}</footer>"
        rows.append((k, f"https://host{k % 3}.example/{k}", page(body)))
        truth[k] = f"Title & {k} " + " ".join(f"{p} xy z" for p in paragraphs)
    assert extracted(spark, rows) == truth


def test_without_a_region_the_host_tells(spark):
    """No article tag and no telling class: what is the same on all pages of the host is not the page's text."""
    rng = random.Random(2)
    rows, truth = [], {}
    for k in range(12):
        text = [" ".join(f"w{rng.randrange(999)}" for _ in range(40)) for _ in range(4)]
        body = f"<div><p>Welcome to our site</p></div><div><h2>Head {k}</h2>{''.join(f'<p>{t}</p>' for t in text)}</div><div><p>All rights kept by us</p></div>"
        rows.append((k, f"http://h.example/{k}", page(body)))
        truth[k] = " ".join([f"Head {k}", *text])
    assert extracted(spark, rows) == truth


def test_pages_odd(spark):
    long = " ".join(["word"] * 60_000)
    rows = [
        (1, None, None), (2, "not a url", ""), (3, "http://a.b/x", "plain text &lt;only&gt;"), (4, "http://a.c/", "<p>un<b>closed <p>two<br>three"), (5, "http://big.example/", page(f"<article><p>{long}</p></article>")),
        (None, "http://n.example/", page("<main><p>a  b\n c</p></main>")), (6, "http://a.d/", "<article><p>x</article></div></p><p>tail"), (7, "http://a.e/", "<!-- open"), (8, "http://a.f/", "<script>never closed"), (9, "http://a.g/", page("")),
        (9, "http://a.g/", page("")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = [(r["page_id"], r["text"]) for r in wrappers.main_text(df).collect()]
    found = dict(out)
    assert len(out) == len(rows) and found[1] == found[2] == found[7] == found[8] == found[9] == ""
    assert found[3] == "plain text <only>" and found[4] == "unclosed two three" and found[5] == long and found[None] == "a b c" and found[6] == "x"
    assert wrappers.main_text(df.limit(0)).collect() == []


def test_telling_names(spark):
    """Classes of the page's frame don't hide the article; comments, forms, notices and menus go wherever they stand."""
    rows, truth = [], {}
    for k in range(8):
        body = (
            f"<div class='wrap with-sidebar'><header><h2>Site</h2></header><div class=cookie-notice>ok {k}?</div><main class='search-results'><article class='post'><header class='article-header'><h1>Head {k}</h1></header>"
            f"<p>one {k}</p><form><label>mail</label><input><button>send</button></form><ul><li>item {k}</li></ul><div class='share social'>share</div><aside>side</aside><table><tr><td>a<td>b</table></article>"
            f"<section class='comments'><article class='comment'><p>nice {k}</p></article></section></main><div id='sidebar'>side {k}</div></div><footer>end</footer>"
        )
        rows.append((k, f"http://x.example/{k}", page(body)))
        truth[k] = f"Head {k} one {k} item {k} a b"
    assert extracted(spark, rows) == truth


def test_many_rounds_of_merging(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 2)
    rows = [(k, "http://one.example/", page(f"<article><p>text {k}</p>{'<ul><li>a</li></ul>' if k % 3 else ''}</article><p>out {k}</p>")) for k in range(24)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(12)
    assert wrappers.wrappers(df).count() == 1
    assert {r["page_id"]: r["text"] for r in wrappers.main_text(df).collect()} == {k: f"text {k}" + (" a" if k % 3 else "") for k in range(24)}


def test_expression_of_a_wrapper():
    pages = [wrappers.parse(page(f"<article><h1>{a}</h1>{'<p>x</p>' * n}</article>")) for a, n in (("one", 1), ("two", 3), ("three", 0))]
    assert wrappers.expression(wrappers.induced(pages)).endswith("<article><h1>#PCDATA</h1> (<p>text</p>)+</article></body></html></page>")


def test_hidden_elements_hide_themselves_only(spark):
    rows, truth = [], {}
    for k in range(6):
        rows.append((k, "http://h.example/", page(f"<article><h1>Head {k}</h1><p>one {k}</p><p>two {k}</p></article>")))
        truth[k] = f"Head {k} one {k} two {k}"
    rows += [
        (6, "http://h.example/", page("<article><h1>Head</h1><p>one</p><p hidden>secret</p><p>two</p><p style='display: none'>secret</p></article>")),
        (7, "http://h.example/", page("<article style='display:none'><h1>Head</h1><p>secret</p></article>")),
        (8, "http://h.example/", page("<article><p>one</p><p class='a b c d e f hidden'>secret</p><p class='a b c d e f g'>two</p></article>")),
    ]
    assert extracted(spark, rows) == truth | {6: "Head one two", 7: "", 8: "one two"}


def test_templates_of_a_host_and_pages_without_a_host(spark):
    rows, truth = [], {}
    for k in range(12):
        text = f"first words {k} of this page", f"more words {k} of it"
        article = page(f"<nav>menu</nav><article><p>{text[0]}</p><p>{text[1]}</p></article>")
        plain = page(f"<nav>menu</nav><div class=story><p>{text[0]}</p><p>{text[1]}</p></div><div><p>same</p></div>")
        rows.append((k, "http://mixed.example/" if k < 8 else "//mixed.example/x", article if k % 2 else plain))
        truth[k] = " ".join(text)
    for k, (url, body) in enumerate([(None, "<article><p>a</p></article>"), ("/rel", "<div><p>b</p><p>c</p></div>"), ("rel", "<p>d</p>"), (None, "<p>e</p>"), (None, "<p>e</p>")], 20):
        rows.append((k, url, page(body)))
    assert extracted(spark, rows) == truth | {20: "a", 21: "b c", 22: "d", 23: "e", 24: "e"}


def test_deep_long_and_broken_pages_take_linear_time(spark):
    deep = "<div>" * 50_000 + "deep" + "</div>" * 50_000
    rows = [(1, "http://d.org/1", page(f"<nav>menu</nav><article>{deep}<p>end</p></article>")), (2, "http://d.org/2", page("<nav>menu</nav>" + "<section>" * 3000 + "<article><p>low</p><nav>x</nav></article>" + "<aside>" * 3000 + "ad" + "</aside>" * 3000))]
    for k, n in ((3, 20_000), (4, 15_000)):
        rows.append((k, "http://l.org/" + str(k), page("<article>" + "".join(f"<h2>a{i}</h2><p>b{i}</p>" for i in range(n)) + "</article>")))
    rows.append((5, "http://b.org/5", "<article>one" + '<a "x ' * 50_000 + "</article>"))
    out = extracted(spark, rows)
    assert out[1] == "deep end" and out[2] == "low"
    for k, n in ((3, 20_000), (4, 15_000)):
        assert out[k] == " ".join(f"a{i} b{i}" for i in range(n))
    assert out[5].startswith("one")


def best_alignment(a, b):
    """Pairs of positions by the whole table of what the rest of both lists can count."""

    def count(x, y):
        x, y = ({k.kind for k in n.kids} if n.kind == y.kind else None for n in (x, y))
        return 0 if x is None else 3 if x == y else 2 if x & y else 1

    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            c = count(a[i], b[j])
            best[i][j] = max(best[i + 1][j], best[i][j + 1], c and c + best[i + 1][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        c = count(a[i], b[j]) if i < len(a) and j < len(b) else 0
        if c and best[i][j] == c + best[i + 1][j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j >= len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


@pytest.mark.parametrize("most", [12, 60, 700])
def test_alignment_is_one_rule_at_any_length(most):
    rng = random.Random(most)

    def siblings(n, kinds):
        out = [wrappers.Node(rng.choice(kinds)) for _ in range(n)]
        for x in out:
            x.kids = [wrappers.Node(k) for k in rng.sample("uvw", rng.randrange(3))]
        return out

    for t in range(3 if most == 700 else 40):
        a = siblings(most if most == 700 else rng.randrange(most), "pqrs"[: 1 + rng.randrange(4)] + "z")
        b = list(a) if t % 3 else siblings(most, "pqrsx")
        for _ in range(rng.randrange(8)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(9)] = siblings(rng.randrange(9), "pqrsx")
        b = [wrappers.load(wrappers.dump(y)) for y in b]
        at = {id(x): k for nodes in (a, b) for k, x in enumerate(nodes)} | {id(None): None}
        assert [(at[id(x)], at[id(y)]) for x, y in wrappers.aligned(a, b)] == ([(k, k) for k in range(len(a))] if [x.kind for x in a] == [y.kind for y in b] else best_alignment(a, b))
