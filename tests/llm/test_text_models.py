"""Toxicity, quality, token counts, packing and SentencePiece against plain versions."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsift.llm import packing, quality, sentence_pieces, token_counts, toxicity

P = pytest.importorskip("public_tokenizers")
R = random.Random(3)
ODD = ["", " ", "  ", "a", "a  b", " lead", "trail ", "tab\tnew\nline", "é́x ｆｕｌｌ 日本語🙂", "<|endoftext|> x<|endoftext|>", "<|ENDOFTEXT|>", "x\x1cy z", "▁x ▁", "a\xa0b", "ΑΣ Σ", "--- *** ..."]
WORDS = ["the", "tion", "er", "Hello,", "under", "stone.", "wéird", "12", "don't", "...", "\n"]


def random_text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def docs_of(spark, texts):
    rows = [(i, t, "clash", "clash2") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, score string")


# -- token counts


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(P.path("byte_bpe_50k.json"), window=600, overlap=64)


def test_counts_equal_the_library_for_short_and_spliced_texts(counter):
    texts = ODD + [random_text(n) for n in (3, 50, 400, 3000)] + ["x" * 2000, "日本" * 900, "a " + "y" * 1500 + " b", " " * 900]
    want = [len(counter.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.counts(texts) == want


def test_spliced_counts_equal_the_library_on_texts_of_every_kind(counter):
    alphabets = ["日本語テキスト", "ab", "a", "!?.,'s", " ", "\n \t", "🙂é", "0123456789", "etaoin shrdlu", "don't we'll ", "<|endoftext|>", "ab<|endoftext|>日 "]
    texts = ["".join(R.choice(a) for _ in range(R.randint(601, 6000))) for a in alphabets for _ in range(6)]
    texts += ["<|endoftext|>" * 300, "x<|endoftext|>" * 200, "ab" * 2000, "aaab" * 900, " a" * 1500, "日" * 4000, "the" * 1300, "!'" * 1500]
    texts += ["".join(R.choice(alphabets) * R.randint(1, 80) for _ in range(60)) for _ in range(40)]
    for t in texts:
        assert counter.spliced(t) == len(counter.tokenizer.encode(t, add_special_tokens=False).ids), t[:60]


def test_work_on_huge_documents_is_in_proportion_to_their_length(monkeypatch):
    c, seen = token_counts.Counter(P.path("byte_bpe_50k.json"), window=4000, overlap=256), []
    tokens = c.tokens
    monkeypatch.setattr(c, "tokens", lambda text, a, b: seen.append(b - a) or tokens(text, a, b))
    for letters in ("日本語のテキスト。", "日本語のテキスト", "abcdefgh", "a", "a b"):
        for n in (40_000, 80_000):
            seen.clear()
            c.spliced("".join(R.choice(letters) for _ in range(n)))
            assert sum(seen) <= 1.3 * n, letters


def test_stable_parts_join_to_the_text():
    for t in ODD + [random_text(40)]:
        assert "".join(token_counts.stable_parts(t)) == t


def test_counts_of_nulls_empty_tables_and_repeats(spark):
    got = token_counts.count_tokens(docs_of(spark, [None, "", "a b", "a b"]), P.path("byte_bpe_50k.json"))
    assert [r.n_tokens for r in got.orderBy("doc_id").collect()] == [0, 0, 2, 2]
    assert token_counts.count_tokens(docs_of(spark, []), P.path("byte_bpe_50k.json")).count() == 0


# -- packing


def test_ids_equal_the_library():
    e = packing.Encoder(P.path("word_bpe_49k.json"))
    texts = ODD + [random_text(300)]
    for t, (ids, ends) in zip(texts, map(e.encode, texts)):
        want = e.tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert all(0 < x <= len(want) for x in ends)


def plain_best(place, penalty, size):
    """Cost of the cheapest cuts, by trying every last cut."""
    best = [0.0]
    for j in range(1, len(place)):
        best.append(min(best[i] + size - place[j] + place[i] + penalty[j] for i in range(j) if place[j] - place[i] <= size))
    return min(b + packing.tail_cost(int(place[-1] - p), size) for b, p in zip(best, place) if place[-1] - p <= size)


def cost(cuts, place, penalty, size):
    known, total = dict(zip(place.tolist(), penalty.tolist())), 0.0
    for low, high in zip(cuts, cuts[1:]):
        n = high - low
        total += 0 if n.bit_count() == 1 and high not in known else size - n
        total += known.get(high, packing.WORD_CUT)
    return total


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_as_cheap_as_trying_all(seed):
    r = np.random.default_rng(seed)
    ends = np.cumsum(r.integers(1, 60, 40))
    sentences = np.unique(r.integers(1, ends[-1], 60))
    place, penalty = packing.cut_places(ends, sentences)
    cuts = packing.best_cuts(place, penalty, 64)
    assert cuts[0] == 0 and cuts[-1] == ends[-1] and max(np.diff(cuts)) <= 64
    last = max(c for c in cuts[:-1] if c in set(place.tolist()) and ends[-1] - c <= 64 and all(x <= c or x not in set(place.tolist()) or x == ends[-1] for x in cuts))
    head = [c for c in cuts if c <= last]
    got = sum(64 - (b - a) + dict(zip(place.tolist(), penalty.tolist()))[b] for a, b in zip(head, head[1:])) + packing.tail_cost(int(ends[-1] - last), 64)
    assert got <= plain_best(place, penalty, 64) + 1e-6


def check_packed(rows, texts, size):
    tokenizer = token_counts.load(P.path("word_bpe_49k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size


def test_each_id_lies_in_one_piece(spark):
    texts = [None, "", *ODD, random_text(2000), "nosentence " * 3000, *[random_text(R.randint(1, 200)) for _ in range(60)]]
    rows = packing.pack(docs_of(spark, texts).coalesce(1), P.path("word_bpe_49k.json"), 256).collect()
    check_packed(rows, texts, 256)


def test_flushed_stream_gives_whole_documents(spark, monkeypatch):
    stream, e, texts = packing.Stream(0, 64), packing.Encoder(P.path("word_bpe_49k.json")), [random_text(n) for n in (500, 3, 40, 900, 1, 250)]
    rows = []
    for i, (ids, ends) in enumerate(map(e.encode, texts)):
        stream.add(i, ids + (2).to_bytes(4, "little"), ends)
        rows += stream.pieces(False)
    rows += stream.pieces(True)
    check_packed(packing.batch_of(rows).to_pandas().itertuples(), texts, 64)
    assert packing.pack(docs_of(spark, []), P.path("word_bpe_49k.json")).count() == 0


# -- SentencePiece


@pytest.fixture(scope="module")
def machine():
    return sentence_pieces.Transducer(P.path("piece_bpe_32k.model"))


def test_shortest_path_equals_the_library(machine):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    alphabet = ["a", "the", " ", "  ", "    ", "\n", "é", "日本", "🙂", "▁", "ing", "20", "def", "<s>", "\x00", "ß"]
    texts = ODD + ["".join(R.choice(alphabet) for _ in range(R.randint(0, 50))) for _ in range(1500)] + [" " * k + "b" for k in range(40)] + ["a" * k for k in range(40)]
    for t in texts:
        ids = machine.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(t), t
        assert machine.decode(ids) == sp.decode(sp.encode(t)), t


def test_runs_of_white_space_and_long_parts_equal_the_library(machine):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    tails = ["", "the", "if x", "日", "\n", "\x00", "t", "▁", "1"]
    texts = ["x" + " " * k + R.choice(tails) + " " * R.randint(0, 9) + R.choice(tails) for k in range(70) for _ in range(4)]
    texts += [" " * 3000, "ab" * 3000, "日本語のテキスト" * 300, "=" * 2500, "".join(R.choice("etaoinshrdlu.,") for _ in range(5000))]
    for t in texts:
        assert np.frombuffer(machine.encode(t), "<u4").tolist() == sp.encode(t), t[:80]


def message(*fields):
    """A protocol buffer message of (number, value) fields: ints, floats, bytes."""
    number = lambda n: bytes([n & 127 | 128]) + number(n >> 7) if n > 127 else bytes([n])
    out = b""
    for k, v in fields:
        if isinstance(v, bytes):
            out += number(k << 3 | 2) + number(len(v)) + v
        else:
            out += number(k << 3 | 5) + struct.pack("<f", v) if isinstance(v, float) else number(k << 3) + number(v)
    return out


def small_model(path, pieces, kind, normaliser):
    special = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows = [message((1, p.encode()), (2, s), (3, k)) for p, s, k in special + pieces]
    path.write_bytes(message(*((1, r) for r in rows), (2, message((3, kind))), (3, normaliser)))
    return str(path)


def test_normaliser_and_unigram_equal_the_library(tmp_path):
    spm = pytest.importorskip("sentencepiece")
    rules = dict(sentence_pieces.fields(spm.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]
    words = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "k", "g", "kg", "f", "i", "fi", "é", "▁▁", "."]
    pieces = [(w, -1.5 - 0.37 * i, 1) for i, w in enumerate(words)]
    odd = ["", " ", "  ", "ｆｕｌｌ  ﬁ", " ab  ab ", "e\u0301", "㎏ ab", "\u200b", "ア\u3099 ab", "日本 ab", "a\tb\nb", "abab" * 30, "\u00a0ab", "ﷺ"]
    odd += ["".join(R.choice("abkgfi .é㎏ﬁ日\u3000") for _ in range(R.randint(1, 30))) for _ in range(300)]
    for squeeze in (0, 1):
        spec = message((2, dict(sentence_pieces.fields(rules))[2]), (3, 1), (4, squeeze), (5, 1))
        path = small_model(tmp_path / f"m{squeeze}", pieces, 1, spec)
        sp, made = spm.SentencePieceProcessor(model_file=path), sentence_pieces.Transducer(path)
        for t in odd:
            assert made.normaliser(t) == sp.normalize(t), t
            assert np.frombuffer(made.encode(t), "<u4").tolist() == sp.encode(t), t


def test_encode_decode_columns(spark):
    path = P.path("piece_bpe_32k.model")
    coded = sentence_pieces.encode(docs_of(spark, ["a b", None, "", "a b"]), path, out="code")
    got = sentence_pieces.decode(coded, path, "code", "back").orderBy("doc_id").collect()
    assert [r.back for r in got] == ["a b", "", "", "a b"] and got[0].ids == "clash"
    assert sentence_pieces.digest(docs_of(spark, []), path).count() == 0


# -- classifiers


def test_toxicity_learns_words_and_their_misspellings():
    good, bad = ["house", "river", "stone", "morning", "letter", "garden"], ["scumbag", "worthless", "pathetic"]
    texts = [" ".join(R.choice(good) for _ in range(30)) for _ in range(300)]
    labels = [i % 3 == 0 for i in range(300)]
    texts = [t + f" {R.choice(bad)} {R.choice(bad)}" if y else t for t, y in zip(texts, labels)]
    model = toxicity.train(toxicity.text_bags(texts), labels)
    scores = model.score(["river stone worthless house", "river worthles pathetik house", "river stone house", "", None])
    assert scores[0] > 0.5 and scores[1] > scores[2] and scores[2] < 0.5
    assert scores[3] == scores[4] and 0 < scores[3] < 1


def test_toxicity_fit_and_score(spark):
    texts = [("bad word filth " if i % 2 else "nice calm day ") * 5 for i in range(40)] + [None, ""]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).orderBy("doc_id").collect()
    assert len(got) == 42 and all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in got[:40])
    alone = toxicity.fit(docs, labels.where("false"))
    assert {r.score for r in toxicity.score(docs, alone).collect()} == {0.5}


def test_held_out_is_crc32_of_the_id_as_text(spark):
    got = spark.range(50).select("id", toxicity.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_quality_orders_grades(spark):
    kinds = ["junk*** x&&& y***", "plain enough words here", "splendid careful prose indeed"]
    rows = [(i, kinds[i % 3] + f" {R.choice(['stone', 'river', 'leaf'])}") for i in range(90)]
    docs = spark.createDataFrame([*rows, (90, None), (91, "")], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(90)] + [(None, 1), (5, None)], "doc_id long, grade int")
    model = quality.fit(docs, ratings, 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = quality.rate(docs, model).orderBy("doc_id").collect()
    means = [np.mean([r.rated.expected_grade for r in got[:90] if r.doc_id % 3 == g]) for g in range(3)]
    assert means[0] < 0.5 and means[0] < means[1] < means[2]
    assert all(r.rated.tails[0] >= r.rated.tails[1] for r in got) and got[90].rated == got[91].rated
    one = quality.fit(docs, ratings.where("grade = 2"), 3)
    assert {round(r.rated.expected_grade, 6) for r in quality.rate(docs, one).collect()} == {2.0}


def test_quality_gradient_is_that_of_the_likelihood():
    """A model of one feature: the fit beats small changes of its weights."""
    r = np.random.default_rng(0)
    x = r.normal(size=400)
    y = np.digitize(x + r.normal(size=400) * 0.5, [-0.5, 0.8])
    rows = [(np.array([0]), np.array([v], np.float32)) for v in x]
    m = quality.train(rows, y, 3)

    def loss(w, cut):
        below = 1 / (1 + np.exp(-(np.concatenate([[-50.0], cut, [50.0]])[:, None] - w * x)))
        return -np.log((below[y + 1, range(400)] - below[y, range(400)])).mean()

    base = loss(m.weights[0], m.thresholds)
    assert base < loss(m.weights[0] * 0.5, m.thresholds) and base < loss(m.weights[0], m.thresholds + 0.5)


def test_counts_are_in_jvm_bytes(spark):
    row = docs_of(spark, ["é"]).select(F.octet_length("text").alias("n")).first()
    assert row.n == 2


# -- packing in portions


def documents_of(r, n):
    for k in range(n):
        length = r.randint(1, r.choice([10, 300, 900]))
        ends = np.unique(np.array([r.randint(0, length) for _ in range(r.choice([0, length // 20]))], np.int64))
        yield k, np.array([r.randint(0, 9) for _ in range(length)], "<u4").tobytes(), ends


def test_cuts_do_not_depend_on_when_they_are_settled():
    import random

    r = random.Random(8)
    for _ in range(60):
        size = r.choice([256, 512])
        whole, parts, got, held = packing.Stream(0, size), packing.Stream(0, size), [], 0
        for doc in documents_of(r, r.randint(1, 120)):
            whole.add(*doc)
            parts.add(*doc)
            if r.random() < 0.3:
                got += parts.pieces(False)
                held = max(held, parts.cutter.place[-1] - parts.cutter.place[0])
        assert got + parts.pieces(True) == whole.pieces(True)
    assert held < 100 * 512


def test_packing_keeps_ids_beside_nulls_exact(spark):
    P = pytest.importorskip("public_tokenizers")
    big = (1 << 53) + 1
    rows = [(big, "one two", 1), (None, "three", 2), (big + 2, None, 3), (5, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").coalesce(1)
    got = packing.pack(docs, P.path("word_bpe_49k.json")).collect()
    assert sorted({r.doc_id for r in got}, key=str) == sorted([big, None, big + 2, 5], key=str)
