"""Token files, hard negatives and vector codes against plain versions."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsift.llm import hard_negatives, simple8b, token_files, vector_codes

R = np.random.default_rng(41)


# -- Simple-8b


def lists_of_ids():
    for n in (0, 1, 3, 59, 60, 61, 4095, 4096, 4097, 30_000):
        for high in (1, 2, 3, 255, 65_535, 65_536, (1 << 20) - 1, 1 << 20, 1 << 32):
            yield R.integers(0, high, n)
        mixed = R.integers(0, 60_000, n)
        mixed[R.random(n) < 0.1] = (1 << 32) - 1
        yield mixed
        yield np.repeat(R.integers(0, 1 << 32, n // 50 + 1), R.integers(1, 300, n // 50 + 1))
        yield np.full(n, (1 << 32) - 1)


def test_segments_give_their_ids_back_whole_and_by_block():
    for ids in lists_of_ids():
        segment = simple8b.encoded(ids)
        assert (simple8b.decoded(segment) == ids).all() and len(simple8b.decoded(segment)) == len(ids)
        for b in range(0, -(-len(ids) // simple8b.BLOCK), 3):
            assert (simple8b.decoded(segment, b, b + 1) == ids[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()


def plain_words(ids):
    """(selector, ids) of each word by the rule of the docstring, one id after the other."""
    out, at = [], 0
    while at < len(ids):
        run = next((k for k in range(at, len(ids)) if ids[k] != ids[at]), len(ids)) - at
        if run >= simple8b.RUN_FROM:
            out.append((simple8b.RUN, run))
            at += run
            continue
        for s, (n, bits) in enumerate(zip(simple8b.SLOTS, simple8b.BITS)):
            if all(v < (1 << bits) - 1 or v >= simple8b.ESCAPED for v in ids[at : at + n]):
                out.append((s, len(ids[at : at + n])))
                at += n
                break
    return out


def test_words_take_as_many_ids_as_fit():
    for high in (2, 6, 200, 40_000, 1 << 21):
        ids = np.minimum(R.zipf(1.3, 1500), high)
        ids[300:420] = 7
        segment = simple8b.encoded(ids)
        n = int(np.frombuffer(segment, "<u4", 2, simple8b.HEADER.size)[1])
        words = np.frombuffer(segment, "<u8", n, simple8b.HEADER.size + 16)
        assert [int(w >> np.uint64(60)) for w in words] == [s for s, _ in plain_words(ids.tolist())]


def test_damaged_segments_and_wrong_ids_are_refused():
    segment = bytearray(simple8b.encoded(R.integers(0, 9999, 5000)))
    segment[200] ^= 1
    for bad in (bytes(segment), b"", b"S8B", b"none of these bytes"):
        with pytest.raises(ValueError):
            simple8b.decoded(bad)
    for ids in ([-1], [1 << 32]):
        with pytest.raises(ValueError):
            simple8b.encoded(np.array(ids))


# -- token files


def test_token_files_hold_the_ids_of_the_library(spark, tmp_path, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_files, "SEGMENT", 500)
    monkeypatch.setattr(token_files, "READ_BATCH", 300)
    r = random.Random(3)
    kinds = ["the cat sat. ", "don't  stop\n", "é日本語", " <|endoftext|> x", "x" * 70, " \n\t ", "1234,5 ", "👍🏽"]
    texts = ["".join(r.choice(kinds) for _ in range(r.randint(0, 40))) for _ in range(150)] + [None, "", "日本" * 40_000, "ab " * 30_000]
    big = (1 << 53) + 1
    rows = [(i * 3 % 151, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (None, None, "x", 1), (big, "one", "x", 1), (big, "two", "x", 1), (big, "two", "x", 1), (-7, "first", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, start int").repartition(3)
    token_files.write(docs, path, f"{tmp_path}/t", 2, parts=5)
    stored = token_files.read(spark, f"{tmp_path}/t")
    got = token_files.digest(stored).collect()
    tokenizer = token_files.Encoder(path).tokenizer
    plain = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, *_ in rows]
    want = sorted((i is not None, i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in plain)
    assert sorted((g.doc_id is not None, g.doc_id or 0, g.n_tokens, g.ids_crc32) for g in got) == want
    in_order = sorted(got, key=lambda g: g.start)
    assert [g.start for g in in_order] == [0, *np.cumsum([g.n_tokens for g in in_order]).tolist()[:-1]]
    names = [g.doc_id for g in in_order]
    assert names[:2] == [None, None] and names[2:] == sorted(names[2:])
    assert all(bytes(r.ids)[-4:] == (2).to_bytes(4, "little") for r in stored.collect())


def test_common_parts_are_told_by_their_letters_and_remembered_without_their_blank(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    encoder = token_files.Encoder(P.path("byte_bpe_50k.json"))
    bits = ["a", "the", "word", "é", "ß", "µ", "Ā", "λ", "漢", "12", "²", ".", ",", "'s", "'", "<", "<|endoftext|>", "|>", "!?", "\n", "\t", " ", "  ", "\x85", "\xa0", "😀", "x" * 70]
    r = random.Random(11)
    for n in range(3000):
        text = "".join(r.choice(bits if n % 2 else [*bits[:6], " ", " ", ".", "\n"]) for _ in range(r.randrange(25)))
        assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text

    class Unused:
        def fullmatch(self, part):
            raise AssertionError(f"a regular expression for {part!r}")

    fresh = token_files.Encoder(P.path("byte_bpe_50k.json"))
    monkeypatch.setattr(token_files, "PLAIN", Unused())
    text = "Words été, Ärger; words plain été!"
    assert fresh.encode(text) == np.array(fresh.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert {"été", "été,", "plain"} <= set(fresh.behind) and not set(fresh.known) - {"Words"}


def test_token_files_of_no_rows_and_of_one_text_in_most_rows(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(5, "the same text")] * 400 + [(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    token_files.write(docs.where("false"), path, f"{tmp_path}/e", 2)
    assert token_files.read(spark, f"{tmp_path}/e").count() == 0
    token_files.write(docs, path, f"{tmp_path}/s", 2, parts=8)
    assert token_files.read(spark, f"{tmp_path}/s").count() == 600
    sizes = [r.n for r in spark.read.parquet(f"{tmp_path}/s").selectExpr("part", "size(doc_ids) as n").groupBy("part").sum("n").withColumnRenamed("sum(n)", "n").collect()]
    assert len(sizes) == 8 and max(sizes) < 200  # a frequent key is in more parts than one


# -- hard negatives


def plain_negatives(rows):
    """By whole numbers of Python, every pair; rows: (vec_id, label, vector)."""
    usable = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, own, v in usable:
        if a % 50:
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), i, label) for i, label, w in usable if i != a and len(w) == len(v)]
        for p, positive, _ in sorted((s, i, label) for s, i, label in score if label == own)[:5]:
            fits = sorted((s, i) for s, i, label in score if label != own and 50 * -p <= 100 * -s <= 95 * -p)[:3]
            out += [(a, positive, k, i, -p, -s) for k, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def negatives_of(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "'x' as n", "1 as dim", "2 as block")
    return sorted(map(tuple, hard_negatives.mine(table).collect()))


@pytest.mark.parametrize("size", [(4096, 256), (16, 2)])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(hard_negatives, "ROWS", size[0])
    monkeypatch.setattr(hard_negatives, "ANCHORS", size[1])
    rows = [(int(i), int(R.integers(0, 10)) if i % 3 else 4, (R.normal(0, 0.3, 70) + 0.3).tolist()) for i in range(300)]  # 70: chunks of 32, 32 and 6
    rows += [(1000 + i, i % 3, [float(i % 5 - 2), 0.5]) for i in range(60)]  # another length, many ties
    rows += [rows[50], rows[7], rows[7]]  # a repeated anchor, a repeated candidate
    rows += [(2000, None, [1.0] * 70), (2050, 1, None), (2100, 1, []), (2150, 1, [math.nan] * 70), (2200, 1, [None, 1.0]), (None, 1, [1.0] * 70), (2250, 8, [0.0] * 70)]
    got = negatives_of(spark, rows)
    assert got == plain_negatives(rows) and len(got) > 60


def test_hard_negatives_of_large_components_and_of_no_rows(spark):
    rows = [(50 * k, k % 2, [float(3 * k + 2) * 2**17, -(2.0**16) * k, 2.0**18]) for k in range(8)]
    assert negatives_of(spark, rows) == plain_negatives(rows)
    assert negatives_of(spark, rows[:0]) == []
    with pytest.raises(Exception, match="does not fit a long"):
        negatives_of(spark, [(50, 1, [2.0**40] * 3), (100, 1, [2.0**40] * 3)])


@pytest.mark.parametrize("size", [(1, 1, 1), (64, 70 * 32, 5)])
def test_hard_negatives_of_many_parts_and_panels(spark, monkeypatch, size):
    for name, value in zip(("ROWS", "ANCHORS", "PANEL_CELLS", "PART_CELLS", "PANELS"), (16, 2, *size)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = [(int(i), int(i % 4 > 2) if i % 2 else int(i % 9), (R.normal(0, 0.3, 70) + (300 if i % 90 == 0 else 0.3)).tolist()) for i in range(400)]
    got = negatives_of(spark, rows)
    assert got == plain_negatives(rows) and len(got) > 40


def test_scores_stay_in_their_tasks(spark):
    """4,000 anchors and 4,000 rows have 16 million scores, 64 MB in four bytes each; what is shuffled is far less."""
    shuffled = lambda: sum(e.totalShuffleWrite() for e in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    table = spark.range(4000).selectExpr("id as vec_id", "id % 3 as label", "array(1.0D, id % 17 / 10.0D, id % 5 / 4.0D) as embedding")
    before = shuffled()
    found = hard_negatives.mine(table, anchor=F.lit(True)).count()
    assert found > 0 and shuffled() - before < 16e6


# -- vector codes


def plain_codes(rows):
    """The contract by whole numbers of Python; rows: (vec_id, label, vector), all of one length."""
    import hashlib

    usable = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-len(usable[0][2]) // 4)
    usable = [(i, label, v + [0] * (4 * width - len(v))) for i, label, v in usable]
    part = lambda v, p: v[p * width : (p + 1) * width]
    first = {}
    for i, _, v in sorted(((i, 0, v) for i, _, v in usable if i is not None), key=lambda r: (r[0], r[2])):
        first.setdefault(i, v)
    start = [first[i] for i in sorted(first)[:256]]
    books = [[part(v, p) for v in start] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(4):
        for p in range(4):
            groups = {}
            for _, _, v in usable:
                groups.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            for e, members in groups.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    found = [(i, label, [near(part(v, p), books[p]) for p in range(4)]) for i, label, v in usable]
    total = {}
    for _, label, n in found:
        total[label] = total.get(label, 0) + sum(d for d, _ in n)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), total[label], digest) for i, label, n in found), key=repr)


def codes_of(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "'x' as error", "1 as dim", "2 as of")
    return sorted(map(tuple, vector_codes.compress(table).collect()), key=repr)


def test_codes_equal_the_plain_version(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "STORED", 100)
    middle = R.normal(0, 1, (9, 16))
    rows = [(int(i), int(i % 4) if i % 5 else None, (middle[i % 9] + R.normal(0, 0.2, 16)).tolist()) for i in range(500)]
    rows += [rows[3], rows[3], (3, 1, rows[4][2]), (None, 2, rows[9][2]), (600, None, None), (601, 1, []), (602, 1, [None] * 16), (603, 1, [math.inf] * 16)]
    assert codes_of(spark, rows) == plain_codes(rows)


@pytest.mark.parametrize("length", [1, 3, 4, 10])
def test_codes_of_short_vectors_few_rows_and_ties(spark, length):
    rows = [(i, i % 2, [float((i + k) % 3) / 1024 for k in range(length)]) for i in range(40)]
    assert codes_of(spark, rows) == plain_codes(rows)


def test_codes_of_several_lengths_and_of_no_rows(spark):
    one = [(i, 0, R.normal(0, 1, 8).tolist()) for i in range(30)]
    two = [(100 + i, 1, R.normal(0, 1, 12).tolist()) for i in range(30)]
    assert codes_of(spark, one + two) == sorted(plain_codes(one) + plain_codes(two), key=repr)
    assert codes_of(spark, one[:0]) == []
    with pytest.raises(ValueError, match="to start a codebook from"):
        codes_of(spark, [(None, 1, [1.0, 2.0])])


def test_nearest_entries_are_exact_at_any_scale():
    for scale in (1, 50, 1 << 20, 1 << 24):
        entries = R.integers(-scale, scale + 1, (200, 16))
        entries[100:120] = entries[:20]
        x = np.concatenate([R.integers(-scale, scale + 1, (300, 16)), entries[:50] + R.integers(0, 2, (50, 16))])
        d = ((x[:, None, :] - entries[None]) ** 2).sum(2)
        code, error = vector_codes.Codebook(entries).nearest(x)
        assert (code == d.argmin(1)).all() and (error == d.min(1)).all()


def test_bounds_are_never_above_the_distance_and_leave_most_out():
    x, c = R.normal(0, 300, (400, 16)).cumsum(1).astype(np.int64), R.normal(0, 300, (256, 16)).cumsum(1).astype(np.int64)
    true = ((x[:, None, :] - c[None]) ** 2).sum(2)
    share = 1.0
    for f, g in zip(vector_codes.features(x), vector_codes.features(c)):
        bound = ((f[:, None, :] - g[None]) ** 2).sum(2)
        assert (bound <= true * (1 + 1e-9) + 1e-6).all()
        left = (bound <= true.min(1)[:, None]).mean()
        assert left <= share
        share = left
    assert share < 0.1
