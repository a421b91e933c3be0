"""The pipeline against its stages' plain meaning, on documents made here."""

import random

import corpus_pipeline
from runsift.llm import quality, toxicity

R = random.Random(9)


def test_stages_and_whole_run(spark, tmp_path):
    word = lambda: "".join(R.choice(["the", "er", "ond", "li", "sta"]) for _ in range(R.randint(1, 3)))
    rows, labels = [], []
    for i in range(240):
        text = " ".join(word() for _ in range(60))
        if i % 6 == 1:
            text = " ".join(w + "***" for w in text.split())
        if i % 6 == 2:
            words = text.split()
            words[::12] = ["vilescum", "worthless", "moronic", "vileness", "scumbag"][: len(words[::12])]
            text = " ".join(words)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(i % 6 != 1), int(i % 6 == 2)))
    rows += [(300, rows[0][1], "en", "s", 1), (301, rows[0][1] + " end", "en", "s", 1), (302, None, "en", None, None), (303, "", None, "s", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")

    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    plain = {i for (i, t, *_), p in zip(rows, model.score([r[1] for r in rows])) if p < 0.5}
    ids = {r.doc_id for r in kept.collect()}
    assert ids == plain and not {i for i in ids if i < 240 and i % 6 == 2} and {0, 3, 300} <= ids

    good = corpus_pipeline.drop_poor(spark, kept, sf)
    rated = quality.fit(docs, quality.grades(spark.read.parquet(f"{sf}/labels.parquet")), 3)
    plain = {i for (i, t, *_), p in zip(rows, rated.tails([r[1] for r in rows])[:, 0]) if p >= 0.5} & ids
    ids = {r.doc_id for r in good.collect()}
    assert ids == plain and not {i for i in ids if i < 240 and i % 6 == 1}

    left = corpus_pipeline.keep_one_of_each_group(spark, good, sf)
    assert {r.doc_id for r in left.collect()} == ids - {300, 301} and left.columns == docs.columns

    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == ids - {300, 301}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
