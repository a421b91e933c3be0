"""The registered queries of the ten operators: SQL where there is some, plain versions and invariants elsewhere."""

import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from runsift.llm import html_text, quality, queries, sentence_pieces, token_counts, toxicity

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for file in os.listdir(SF):
        made.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    return made


def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got = queries.queries()[name](spark, SF).toPandas()
    res = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(got.columns)
    mine = sorted(map(repr, got[columns].astype(object).where(got[columns].notna(), None).itertuples(index=False, name=None)))
    assert mine == sorted(map(repr, res.fetchall()))


def plain_features_mean(model, words):
    """Mean over words of the mean of a word's embedding margins, one word at a time."""
    total = []
    for word in words:
        ((_, rows, weight),) = toxicity.subwords([word])
        total.append(sum(float(model.margin[r]) * w for r, w in zip(rows[0], weight[0])))
    return sum(total) / len(total) if total else 0.0


def test_op9_scores_are_those_of_a_plain_rescoring(spark):
    docs = documents()
    spark_docs, labels = (queries.table(spark, SF, n) for n in ("documents", "labels"))
    model = toxicity.fit(spark_docs, labels)
    got = queries.op9_toxicity(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and (got.predicted == (got.score >= 0.5)).all()
    for i, t in docs[["doc_id", "text"]].head(25).itertuples(index=False):
        logit = model.bias + toxicity.SCALE * plain_features_mean(model, [w for w in toxicity.bare((t or "").split()) if len(w) > 2])
        assert abs(got.score[i] - 1 / (1 + np.exp(-logit))) < 1e-4
        assert got.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_op1_ratings_are_those_of_a_plain_rescoring(spark):
    docs = documents()
    spark_docs, labels = (queries.table(spark, SF, n) for n in ("documents", "labels"))
    model = quality.fit(spark_docs, quality.grades(labels), 3)
    got = queries.op1_quality(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs) and (got.p_good >= got.p_clean).all() and (got.kept == (got.p_good >= 0.5)).all()
    for i, t in docs[["doc_id", "text"]].head(25).itertuples(index=False):
        chunks, margin = (t or "").split(), 0.0
        for c in chunks:
            ((_, both, weight),) = quality.columns([c])
            margin += sum(float(model.weights[b]) * w for b, w in zip(both[0], weight[0])) / len(chunks)
        margin = quality.SCALE * (margin + (model.weights[quality.REPEAT] * quality.repeats(chunks) if chunks else 0.0))
        tails = 1 / (1 + np.exp(model.thresholds - margin))
        assert np.allclose([got.p_good[i], got.p_clean[i]], tails, atol=1e-4) and abs(got.expected_grade[i] - tails.sum()) < 2e-4


def test_op3_finds_nine_tenths_of_the_nearest(spark):
    got = queries.op3_nearest_neighbours(spark, SF).toPandas()
    rows = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    x = np.stack(rows.embedding).astype(float)
    ids = rows.vec_id.to_numpy()
    shares = []
    for q, found in got.groupby("query_id"):
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = [i for i in ids[np.lexsort((ids, d))].tolist() if i != q][:10]
        assert found.sort_values("rank").score.is_monotonic_increasing and sorted(found["rank"]) == list(range(1, len(want) + 1))
        assert np.allclose(found.score, d[np.searchsorted(ids, found.vec_id)], rtol=1e-12)
        shares.append(len(set(found.vec_id) & set(want)) / len(want))
    assert set(got.query_id) == set(ids[ids % 100 == 0]) and np.mean(shares) >= 0.9


def test_op4_texts_and_their_lengths(spark, monkeypatch):
    got = queries.op4_html_text(spark, SF).toPandas()
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    assert sorted(got.page_id) == sorted(pages.page_id) and (got.n_chars == got.text.str.len()).all()
    # Forced to keep all or nothing, every page gives all of its text or none.
    plain = html_text.extract(spark.createDataFrame([(1, None), (1, ""), (None, "<p>")], "page_id long, html string")).collect()
    assert [r.text for r in plain] == ["", "", ""]


def test_op5_and_op10_agree_with_the_libraries(spark):
    P = pytest.importorskip("public_tokenizers")
    docs = documents()
    texts = [t if isinstance(t, str) else "" for t in docs.text]
    words, pieces = token_counts.load(P.path("word_bpe_49k.json")), token_counts.load(P.path("byte_bpe_50k.json"))
    packed = queries.op5_packing(spark, SF).toPandas()
    total = packed.groupby("doc_id").agg(n=("length", "sum"), d=("doc_tokens", "max"))
    counted = queries.op10_token_counts(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, texts):
        ids = words.encode(t, add_special_tokens=False).ids + [2]
        assert total.n[i] == total.d[i] == len(ids)
        n = len(pieces.encode(t, add_special_tokens=False).ids)
        assert tuple(counted.loc[i]) == (len(t.encode()), n, n > 1024)
    used = packed.groupby("sequence_id").length.sum()
    size = np.where([n.bit_count() == 1 for n in used], used, 4096)
    assert (used <= 4096).all() and used.sum() / size.sum() > 0.95


def test_op6_digests_are_those_of_the_library(spark):
    P, sp = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    model = sp.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = queries.op6_sentence_pieces(spark, SF).toPandas().set_index("doc_id")
    for i, t in documents()[["doc_id", "text"]].itertuples(index=False):
        ids = np.array(model.encode(t or ""), "<u4")
        assert tuple(got.loc[i]) == (len(ids), zlib.crc32(ids.tobytes()), model.decode(ids.tolist()) == (t or ""))


def test_op7_classes_hold_each_of_their_links(spark):
    got = queries.op7_jaccard_join(spark, SF).toPandas()
    assert len(got) == len(documents()) and (got.class_id <= got.doc_id).all()
    size = got.groupby("class_id").doc_id.transform("size")
    assert (got.n_links < size).all() and ((got.n_links > 0) == (size > 1)).all()


def test_queries_of_empty_tables_give_no_rows(spark, tmp_path):
    for name in ("documents", "embeddings", "pages", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name
    import corpus_pipeline

    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_tables_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    texts = ["one two three four five six " * 20, None, "", "one two three four five six " * 20, "other words here " * 30]
    docs = [(i, t, "en", "s", 1, "c", 0.5, 7) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None, None, None), (4, "a second text", "en", "s", 1, "c", 0.5, 7)] * 2
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, ids string, score double, n_tokens long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 1), (4, None, None), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op1_quality", "op6_sentence_pieces", "op7_jaccard_join", "op9_toxicity", "op10_token_counts"):
        assert queries.queries()[name](spark, str(tmp_path)).count() == len(docs), name
    packed = queries.op5_packing(spark, str(tmp_path)).toPandas()
    assert (packed.offset == 0).sum() == packed.sequence_id.nunique() and packed.doc_id.isna().sum() >= 1
    import corpus_pipeline

    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.columns == kept.columns


def test_a_mined_rule_blocks_through_the_whole_query(spark, tmp_path):
    pages = [(i, f"http://{'bad' if i % 3 == 0 else 'fine'}.com/a{i}") for i in range(300)] + [(1000, "http://www.bad.com/other"), (1001, "http://bad.org/fr/x"), (1002, None)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op2_url_filter(spark, str(tmp_path)).collect()}
    assert all(got[i] == (None, "block" if i % 3 == 0 else "allow") for i in range(300))
    assert got[1000] == (None, "block") and got[1001] == ("org/fr/", "allow") and got[1002] == (None, "allow")


def test_decoding_gives_texts_back():
    P = pytest.importorskip("public_tokenizers")
    machine = sentence_pieces.transducer(P.path("piece_bpe_32k.model"))
    for t in documents().text.head(40):
        assert machine.decode(machine.encode(t or "")) == (t or "").replace("▁", " ")
