"""Vector search, near-duplicate join, components, URL filter and HTML extraction against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsift.llm import dom, graph, hnsw, html_text, jaccard_join, queries, topk, url_filter

R = random.Random(5)


# -- vectors


def vectors(spark, n=700, dim=16, seed=1):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in r.normal(size=dim)], "x") for i in range(n)]
    rows += [(n, None, "x"), (n + 1, [0.0] * dim, "x"), (n + 2, [float("nan")] * dim, "x"), (n + 3, [], "x"), (n + 4, rows[0][1], "x"), (n + 5, [1.0] * (dim + 1), "x")]
    rows += [(n + 6, [None] + [1.0] * (dim - 1), "x"), (None, rows[1][1], "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), rows


def test_hnsw_recall_ties_and_exact_scores(spark):
    df, rows = vectors(spark)
    got = hnsw.nearest(df, df.where("vec_id % 50 = 0 or vec_id > 695"), 10).collect()
    ok = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    found, hits, total = {}, 0, 0
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    for q, rs in found.items():
        same = [i for i in ok if i != q and len(ok[i]) == len(ok[q])]
        exact = sorted(same, key=lambda i: (np.sqrt(((ok[i] - ok[q]) ** 2).sum()), i))[:10]
        rs.sort(key=lambda r: r.rank)
        assert [r.rank for r in rs] == list(range(1, len(rs) + 1)) and len(rs) == min(10, len(same))
        for r in rs:
            assert abs(r.score - np.sqrt(((ok[r.vec_id] - ok[q]) ** 2).sum())) < 1e-12
        hits, total = hits + len({r.vec_id for r in rs} & set(exact)), total + len(exact)
    assert hits / total >= 0.9 and 700 not in found and 701 not in found and 705 not in found


def test_hnsw_small_shards_and_empty(spark):
    df, _ = vectors(spark, 40)
    assert hnsw.nearest(df.where("false"), df.where("false"), 10).count() == 0
    two = df.where("vec_id < 2")
    assert [(r.query_id, r.vec_id) for r in hnsw.nearest(two, two, 10).orderBy("query_id").collect()] == [(0, 1), (1, 0)]


def test_hnsw_graph_is_built_by_searching_it():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 24))
    layers = hnsw.build(np.arange(3000), x)
    for (above, _), (below, links) in zip(layers[1:], layers):
        assert (below[: len(above)] == above).all()
        own = links >= 0
        assert (links < len(below)).all() and own.any(1).all() and all(len(set(row[row >= 0])) == (row >= 0).sum() and i not in row for i, row in enumerate(links))
    got = hnsw.search(layers, x, x[:200], hnsw.EF)
    want = np.argsort(hnsw.distances(x[:200], x), 1, kind="stable")[:, :10]
    shares = [len(set(g[:10]) & set(w)) / 10 for g, w in zip(got, want)]
    assert np.mean(shares) >= 0.95 and min(shares) > 0


def test_hnsw_recall_with_a_third_of_the_rows_equal(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    same = np.sort(r.permutation(1500)[:500])
    x[same] = x[same[0]]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(int(same[0]), x[same[0]].tolist())] * 20
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = {}
    for row in hnsw.nearest(df, df.where("vec_id % 15 = 0").union(df.where(F.col("vec_id") == int(same[0]))).distinct(), 10).collect():
        got.setdefault(row.query_id, []).append((row.rank, row.vec_id))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        exact = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        mine = [i for _, i in sorted(found)]
        assert len(mine) == 10 and (q not in same or mine == exact)
        hits += len(set(mine) & set(exact)) / len(set(exact))
    assert len(got) >= 100 and hits / len(got) >= 0.9


def test_topk_equals_brute_force(spark):
    df, rows = vectors(spark, 300)
    got = topk.top(df, df.where("vec_id % 20 = 0"), 5).collect()
    ok = {i: np.floor(256 * np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in [i for i in ok if i % 20 == 0]:
        best = sorted((-float(ok[q] @ ok[i]), i) for i in ok if i != q and len(ok[i]) == len(ok[q]))[:5]
        want |= {(q, k, i, int(-s)) for k, (s, i) in enumerate(best, 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want
    assert topk.top(df.where("false"), df.where("false"), 5).count() == 0


def test_topk_of_products_beyond_the_exact_doubles():
    r = np.random.default_rng(4)
    x = np.floor(r.normal(size=(60, 3)) * 2.0**29)
    order = np.lexsort((np.arange(60), -(x * x).sum(1)))
    got = topk.best(np.arange(60)[order], x[order], np.arange(4), x[:4], np.eye(3), 5)
    for q in range(4):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(x[i], x[q])), i) for i in range(60) if i != q)[:5]
        mine = got[got.query_id == q]
        assert [(-s, i) for s, i in zip(mine.score.tolist(), mine.vec_id.tolist())] == want
    with pytest.raises(OverflowError):
        topk.best(np.arange(2), np.full((2, 3), 2.0**40), np.array([0]), np.full((1, 3), 2.0**40), np.eye(3), 1)


def test_topk_prunes_without_losing_ties():
    r = np.random.default_rng(2)
    x = np.floor(r.normal(size=(900, 8)) * 3 * np.linspace(8, 0.1, 900)[:, None])
    ids = np.arange(900)
    order = np.lexsort((ids, -(x * x).sum(1)))
    turn = np.linalg.svd(x, full_matrices=False)[2].T
    got = topk.best(ids[order], x[order], np.array([5, 7]), x[[5, 7]], turn, 4)
    for q in (5, 7):
        want = sorted((-(x[i] @ x[q]), i) for i in range(900) if i != q)[:4]
        mine = got[got.query_id == q]
        assert list(zip(-mine.score, mine.vec_id)) == [(s, i) for s, i in want]


# -- components and the Jaccard join


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_join(rows):
    sets = []
    for i, t in rows:
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w and i is not None else set())
    links, root = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    ids = [min((rows[b][0] for b in range(len(rows)) if root[b] == root[a]), default=None) if rows[a][0] is not None else None for a in range(len(rows))]
    return sorted(((rows[a][0], ids[a], links[a]) for a in range(len(rows))), key=str)


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[R.randrange(len(words))] = f"edit{R.randrange(1000)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [4, 128])
def test_join_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    base = [[f"w{R.randrange(400)}" for _ in range(80)] for _ in range(4)]
    texts = [edited(b, k) for b in base for k in (0, 0, 1, 1, 2, 3, 5)] + ["short one", "Short  ONE", "a", None, "", "  ", " ".join(base[0]).upper(), "x " * 5000]
    texts += [" ".join(f"u{R.randrange(9999)}" for _ in range(60)) for _ in range(10)]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows] + [(None, texts[0], 1, "n")], "doc_id long, text string, node int, bands string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(df).collect()), key=str)
    assert got == plain_join([*rows, (None, texts[0])])


def test_join_and_pipeline_stage_of_repeated_ids_with_other_texts(spark):
    import corpus_pipeline

    base = [[f"v{k}x{j}" for j in range(80)] for k in range(4)]
    near = lambda b, k: " ".join(["new%d" % k] + b[1:])
    rows = [(5, " ".join(base[0])), (5, " ".join(base[1])), (5, near(base[0], 1)), (7, near(base[0], 2)), (8, near(base[1], 3)), (3, near(base[2], 4))]
    rows += [(9, " ".join(base[2])), (9, " ".join(base[3])), (10, near(base[3], 5)), (None, " ".join(base[3])), (11, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(df).collect()), key=str)
    assert got == plain_join(rows)
    left = corpus_pipeline.keep_one_of_each_group(spark, df, "")
    assert sorted(map(tuple, left.collect()), key=str) == sorted([r for i, r in enumerate(rows) if i not in (3, 4, 6, 8)], key=str) and left.columns == df.columns


def chain(n):
    return [(k, " ".join(f"z{j}" for j in range(4 * k, 4 * k + 90))) for k in range(n)]


def test_join_of_a_chain_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    rows = chain(120)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == plain_join(rows)


def nodes_of(spark, rows):
    seen = jaccard_join.described(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(None))
    nodes = seen.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("times"), F.first("bands").alias("bands"), F.first("cells").alias("cells"))
    return graph.written(nodes.withColumn("node", F.monotonically_increasing_id()))


def pairs_met(tiles):
    """Pairs that are compared in tiles, by the sizes of their sides."""
    sides = tiles.distinct().groupBy("key", "band", "lo", "hi").agg(F.count_if(F.col("side") == F.col("lo")).alias("a"), F.count_if(F.col("side") == F.col("hi")).alias("b"))
    return sides.agg(F.sum(F.when(F.col("lo") == F.col("hi"), F.col("a") * (F.col("a") - 1) / 2).otherwise(F.col("a") * F.col("b")))).first()[0] or 0


def test_a_long_chain_compares_the_pairs_of_its_buckets_and_not_of_all_its_nodes(spark):
    nodes = nodes_of(spark, chain(4000))
    by_root, by_bucket = jaccard_join.planned(nodes, [])
    assert by_root.count() == 0
    members = {}
    for r in nodes.select("node", F.explode("bands").alias("bucket")).collect():
        members.setdefault(r.bucket, []).append(r.node)
    share = sum(len(m) * (len(m) - 1) // 2 for m in {tuple(sorted(m)) for m in members.values() if len(m) > 1})
    assert pairs_met(by_bucket) == share < 0.02 * 4000 * 3999 / 2


def test_a_dense_group_is_compared_once_and_cut_by_nodes_and_by_length(spark, monkeypatch):
    base = [f"w{j}" for j in range(300)]
    rows = [(k, " ".join(base[:k] + [f"v{k}"] + base[k + 1 :])) for k in range(290)]
    nodes = nodes_of(spark, rows)
    by_root, by_bucket = jaccard_join.planned(nodes, [])
    assert by_bucket.count() == 0 and pairs_met(by_root) == 290 * 289 // 2
    assert by_root.select("side").distinct().count() == 3 and not by_root.first().whole
    monkeypatch.setattr(jaccard_join, "CELLS", 296 * 20)
    cut, _ = jaccard_join.planned(nodes, [])
    assert cut.select("side").distinct().count() == 15 and pairs_met(cut) == 290 * 289 // 2


def test_join_keeps_ids_beside_nulls_exact_and_their_links(spark):
    import corpus_pipeline

    big = (1 << 53) + 1
    text = " ".join(f"q{j}" for j in range(80))
    rows = [(big, text), (big + 2, text + " one"), (big + 4, text + " two"), (None, text), (5, "other words in here only")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join(df).collect()), key=str)
    assert got == plain_join(rows) and (big, big, 2) in got
    left = corpus_pipeline.keep_one_of_each_group(spark, df, "")
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([big, None, 5], key=str)


def test_join_removes_the_tables_of_its_steps(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "shared_folder", lambda _: f"file://{tmp_path}")
    assert jaccard_join.join(spark.createDataFrame(chain(20), "doc_id long, text string")).count() == 20
    assert len(list(tmp_path.iterdir())) == 1  # the result's own


def test_join_of_nothing(spark):
    assert jaccard_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_keeps_similar_pairs():
    need = jaccard_join.least_matches((4, 5), 16, 192, 1e-4)
    assert need == sorted(need) and need[0] < 13 and need[-1] < 0.8 * 192
    sets = [np.unique(np.random.default_rng(k).integers(0, 2**63, 500, dtype=np.uint64)) for k in range(2)]
    near = np.unique(np.concatenate([sets[0][:470], sets[1][:20]]))
    signs = np.stack([jaccard_join.minhash(s) for s in (sets[0], near, sets[1])])
    i, j = jaccard_join.candidates(signs, signs, True)
    assert list(zip(i, j)) == [(0, 1)]


def test_pruning_and_bands_together_lose_few_pairs_at_the_threshold():
    from math import comb

    p = {0: 1.0}
    for need in jaccard_join.least_matches((4, 5), jaccard_join.STEP, 192, jaccard_join.TOLERANCE):
        q = {}
        for m, w in p.items():
            for k in range(17):
                q[m + k] = q.get(m + k, 0) + w * comb(16, k) * 0.8**k * 0.2 ** (16 - k)
        p = {m: w for m, w in q.items() if m >= need}
    assert 1 - sum(p.values()) + (1 - 0.8**6) ** 32 < 1e-4


@pytest.mark.parametrize("many", [1, 10_000])
def test_both_ways_of_verifying_agree(monkeypatch, many):
    monkeypatch.setattr(jaccard_join, "MANY_PAIRS", many)
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 5, 11, 12, 50)]
    i, j = np.triu_indices(5, 1)
    got = jaccard_join.verified(sets, sets, i, j)
    want = [len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.8 for a, b in zip(i, j)]
    assert got.tolist() == want


# -- URLs


def test_hosts_paths_and_listed_rules(spark):
    cases = [
        (None, "", "", None), ("no scheme", "", "", None), ("http://A.Example.NET/en/x?q=1", "a.example.net", "/en/x", "example.net/en/"),
        ("http://x.net", "x.net", "", None), ("http://x.net/", "x.net", "/", "net/"), ("https://example.net/de/1#f", "example.net", "/de/1", "net/"),
        ("http://Éxample.org/fr/", "Éxample.org", "/fr/", "org/fr/"), ("http://notexample.net/en/", "notexample.net", "/en/", "net/"), ("a://b://c/d", "b:", "//c/d", None),
        ("http://x.com?y=/z", "x.com", "", None), ("", "", "", None),
    ]
    df = spark.createDataFrame([(i, c[0], "h", "p", "t") for i, c in enumerate(cases)], "page_id long, url string, host string, listed string, tokens string")
    none = url_filter.mine(spark.createDataFrame([], "tokens array<string>, label int"))
    got = url_filter.judge(df, queries.URL_RULES, none).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule) for r in got] == cases and got[0].listed == "p" and got[0].tokens == "t"
    verdict = {"net/": "block", "example.com/de/": "block"}
    assert all(r.verdict == verdict.get(r.rule, "allow") for r in got)
    assert url_filter.judge(df.where("false"), queries.URL_RULES, none).count() == 0


def test_mined_rules_block_combinations(spark):
    rows = [([f"h:{h}", f"p:{p}", f"p:{i}"], int(h == "bad" and p == "x")) for i, (h, p) in enumerate([("bad", "x")] * 40 + [("bad", "y")] * 60 + [("ok", "x")] * 60)]
    rows += [(None, 1), (["h:q"], None), ([], 1)]
    mined = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label int"))
    assert {tuple(r.rule_tokens) for r in mined.collect()} == {("h:bad", "p:x")}
    urls = spark.createDataFrame([(1, "http://bad/x"), (2, "http://bad/y"), (3, "http://ok/x/bad"), (4, "http://bad/z/x"), (4, "http://bad/z/x")], "page_id long, url string")
    got = [(r.page_id, r.verdict) for r in url_filter.judge(urls, [], mined).orderBy("page_id").collect()]
    assert got == [(1, "block"), (2, "allow"), (3, "allow"), (4, "block"), (4, "block")]


def test_mined_rules_of_any_size_and_of_rare_hosts(spark):
    names = ["h:a", "h:b", "p:x"]
    rows = [([t for k, t in enumerate(names) if m >> k & 1] + [f"p:{m}"], int(m == 7)) for m in range(1, 8) for _ in range(30)]
    rows += [(["h:rare"], 1)] * 20 + [(["h:rarer"], 1)] * 19 + [([f"h:ok{i % 50}"], 0) for i in range(3000)]
    mined = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label int"))
    sets, all_tokens = set(), ["h:a", "h:b", "p:x", "p:7", "h:rare", "h:rarer"]
    for m in range(1, 1 << len(all_tokens)):
        s = {t for k, t in enumerate(all_tokens) if m >> k & 1}
        fits = [label for t, label in rows if s <= set(t)]
        if sum(fits) >= 20 and sum(fits) >= 0.6 * len(fits):
            sets.add(tuple(sorted(s)))
    least = {s for s in sets if not any(set(t) < set(s) for t in sets)}  # a set with a part that is a rule adds nothing
    assert {tuple(r.rule_tokens) for r in mined.collect()} == least and ("h:a", "h:b", "p:x") in least and ("h:rare",) in least


def test_a_long_path_that_recurs_gives_few_rules(spark):
    names = [f"p:part{chr(97 + k)}" for k in range(17)]
    rows = [(["h:host", *names], 1)] * 40 + [(["h:host", f"p:{i}"], 0) for i in range(200)] + [([names[0], names[1]], 0)] * 100 + [([names[0], f"p:y{i}"], 0) for i in range(90)]
    mined = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, label int")).collect()
    rules = {tuple(r.rule_tokens): [set(c) for c in r.choices] for r in mined}
    host = {"h:host"}
    assert rules == {("p:partc",): [set(names[2:])], ("h:host", "p:parta"): [host, {names[0]}], ("h:host", "p:partb"): [host, {names[1]}]} and len(mined) == 17


def test_a_rule_of_three_items_with_any_of_their_tokens_blocks(spark):
    two = ["p:u", "p:v"]  # always together
    bad = [["h:a", "h:b", *two, f"p:{i}"] for i in range(30)]
    fine = [[*pair, f"p:{i}"] for i in range(30) for pair in (["h:a", "h:b"], ["h:a", *two], ["h:b", *two])]
    mined = url_filter.mine(spark.createDataFrame([(t, 1) for t in bad] + [(t, 0) for t in fine], "tokens array<string>, label int"))
    assert {tuple(r.rule_tokens) for r in mined.collect()} == {("h:a", "h:b", "p:u")}
    urls = spark.createDataFrame([(1, "http://a.b/v"), (2, "http://a.b/u"), (3, "http://a.b/w"), (4, "http://a.c/u")], "page_id long, url string")
    assert [(r.page_id, r.verdict) for r in url_filter.judge(urls, [], mined).orderBy("page_id").collect()] == [(1, "block"), (2, "block"), (3, "allow"), (4, "allow")]


# -- HTML


def test_parser_settles_loose_markup():
    p = dom.parse('<p>a<b>b<br>c<p>d &amp; e&eacute;&#x41;<script>if(a<b){"</p>"}</script><ul><li>x<li>y</ul>tail<!-- no --><td>z')
    assert [t for t in p.text if t] == ["ab c", "d & eéA", "x", "y", "tail", "z"]
    for odd in ("", "<", "<<<>>>", "<a", "</x></y>", "<script>never", "<p" * 50, "a" * 10, "<div>" * 3000 + "deep"):
        assert dom.parse(odd).parent[0] == -1


def test_parser_takes_time_in_proportion_to_the_page():
    import time

    def seconds(page):
        start = time.process_time()
        dom.parse(page)
        return time.process_time() - start

    for head, tail in (("<div>", "</x>"), ("<b>", "<p></p>"), ("<div>", "<li></li>"), ("<i>", "</b>"), ("<svg><g>", "</x>"), ("<svg><g>", "<g>")):
        small, large = (min(seconds("<b><div>" + head * k + tail * k) for _ in range(2)) for k in (4_000, 32_000))
        assert large < 24 * small + 0.2, (head, tail)


def test_parser_loses_no_text_after_unclosed_elements():
    texts = lambda source: [t for t in dom.parse(source).text if t]
    for tag in ("svg", "select", "object", "video", "audio", "canvas", "template"):
        assert texts(f"<p>a<{tag}><b>gone</b></{tag}>b<p>c") == ["ab", "c"]
        assert texts(f"<div>a<{tag} x=1>gone</div><p>b</p>") == ["a", "b"]
        assert texts(f"<div>a<{tag}>gone<p>b</p><p>c</p></div>") == ["a", "b", "c"]
        assert texts(f"<div>a<{tag}>gone</div><p>b</p><{tag}><i>gone</{tag.upper()} >c") == ["a", "b", "c"]
    assert texts("<div><video><p>gone</p><script>'</video>'</script></video>a</div>") == ["a"]
    assert texts("<svg><title>gone<path/><g></svg>a<svg><foreignObject><div>gone</div></foreignObject></svg>b") == ["ab"]
    assert texts("<p>a<math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p>") == ["ax=1 b"]
    assert texts("<p>" + "\u0130" * 40 + "</p><script>1</script><p>article text</p><p>b</p>") == ["\u0130" * 40, "article text", "b"]
    assert texts("<p>a</p><script>never<p>b") == ["a"]


@pytest.fixture(scope="module")
def model():
    return html_text.train(700)


def test_main_text_of_unseen_pages(model):
    same = total = 0
    for i in range(60):
        source = html_text.Writer(77_000_000 + i).page()
        page = dom.parse(source)
        gold = "\n".join(t for t, m in zip(page.text, html_text.marked(page)) if m and t)
        got = model.texts([source.replace(html_text.Writer.MARK, "")])[0]
        same, total = same + (got == gold), total + 1
    assert same / total >= 0.85


def test_decoding_is_the_best_consistent_labelling():
    import itertools

    r = np.random.default_rng(4)
    for _ in range(30):
        parent = [-1] + [int(r.integers(0, i)) for i in range(1, 8)]
        margin = r.normal(size=8) * 2
        got = html_text.decode(parent, margin)
        value = lambda keep: sum(-np.logaddexp(0, -m if k else m) for m, k in zip(margin, keep))
        best = max(value(k) for k in itertools.product([True, False], repeat=8) if k[0] and all(not k[i] or k[parent[i]] for i in range(1, 8)))
        assert all(not got[i] or got[parent[i]] for i in range(1, 8)) and abs(value(got) - best) < 1e-9


def test_extract_nulls_empty_and_long(spark, model, monkeypatch):
    monkeypatch.setattr(html_text, "trained", lambda: model)
    body = "<article><h1>Title here</h1>" + "<p>Some words of prose, as there are many. And more.</p>" * 400 + "</article>"
    rows = [(1, None), (2, ""), (3, "<html><body><nav><a href=x>menu</a></nav>" + body + "<footer>foot &copy;</footer></body></html>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, html string")).orderBy("page_id").collect()
    assert [got[0].text, got[1].text] == ["", ""] and got[2].text.startswith("Title here\nSome words") and got[2].text.count("\n") == 400 and "menu" not in got[2].text
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
    assert got[2].page_id == 3 and F is not None
