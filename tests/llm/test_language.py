import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemill.llm import language
from tidemill.llm.language import ORDER, code_lengths, frozen, identify, keep_known, normal, predicted, windows_of


def _brute_bits(samples: dict, text: bytes) -> dict:
    out = {}
    for lang, s in samples.items():
        trees = [defaultdict(Counter) for _ in range(ORDER + 1)]
        data = b"\n" * ORDER + s
        for i in range(ORDER, len(data)):
            for d in range(ORDER + 1):
                trees[d][data[i - d : i]][data[i]] += 1
        data, bits = b"\n" * ORDER + text, 0.0
        for i in range(ORDER, len(data)):
            for d in range(ORDER, -1, -1):
                c = trees[d].get(data[i - d : i])
                if not c:
                    continue
                n, k = sum(c.values()), len(c)
                if data[i] in c:
                    bits += math.log2((n + k) / c[data[i]])
                    break
                bits += math.log2((n + k) / k)
            else:
                bits += 8
        out[lang] = bits
    return out


def test_code_lengths_are_exact():
    samples = {"a": b"the cat sat on the mat and the dog sat too", "b": b"der hund und die katze sind im haus"}
    counts = {}
    for k, s in samples.items():
        w, c = np.unique(windows_of(b"\n" * ORDER + s), return_counts=True)
        counts[k] = w, c.astype(float)
    trees = frozen(counts)
    texts = [b"the dog", b"die katze ist da", b"zzz \xc3\xa9", b"x", b""]
    got = code_lengths(trees, texts)
    for row, t in zip(got, texts):
        assert np.allclose(row, list(_brute_bits(samples, t).values()), atol=1e-3)
    assert predicted(trees, ["the cat", None, "123", ""])[1:] == [("und", 0.0)] * 3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: (r.lang, zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in docs.collect()}
    rows = identify(docs).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(truth[r.doc_id][1] == r.held_out and 0 <= r.score <= 1 for r in rows)
    assert sum(truth[r.doc_id][0] == r.lang_pred for r in held) / len(held) > 0.97


def test_odd_rows(odd_docs, empty_docs):
    rows = {r.doc_id: r for r in identify(odd_docs).collect()}
    assert rows[2].lang_pred == rows[3].lang_pred == rows[4].lang_pred == "und" and rows[2].score == 0
    assert identify(odd_docs).count() == odd_docs.count() and identify(empty_docs).count() == 0
    assert {r.lang_pred for r in identify(odd_docs.withColumn("lang", odd_docs.lang.substr(9, 0))).collect()} <= {"", "und"}
    kept = keep_known(odd_docs)
    assert kept.columns == odd_docs.columns and {2, 3, 4}.isdisjoint(r.doc_id for r in kept.collect())
    assert normal("AÉ") == "aé".encode()


def test_long_documents_are_learnt_from_in_pieces(spark):
    rng = np.random.default_rng(3)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(300)] for lang, letters in (("a", "abcdefgh"), ("b", "ijklmnop"))}
    make = lambda lang, n: " ".join(rng.choice(words[lang], n))
    rows = [(i, make("a", 5000), "a") for i in range(20)] + [(100 + i, make("b", 40), "b") for i in range(900)]  # all of a is long
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = 120_000
    from tidemill.llm.language import learn

    trees = learn(docs, sample)
    assert trees.languages == ["a", "b"]
    assert all(lang == r[2] for r, (lang, _) in zip(rows, predicted(trees, [r[1] for r in rows])))
    got = identify(docs, sample_bytes=sample).collect()
    assert all(r.lang_pred == ("a" if r.doc_id < 100 else "b") for r in got)
    # each language has its share, though many take part
    many = spark.createDataFrame([(i, make("ab"[i % 2], 5000), f"{'ab'[i % 2]}{i % 40}") for i in range(80)], docs.schema)
    assert len(learn(many, sample).languages) == 40


def test_sample_has_each_share(spark, monkeypatch):
    import tidemill.llm.language as m

    rows = [(i, "abc " * n, lang) for i, (n, lang) in enumerate([(9000, "long")] * 3 + [(50, "short")] * 800 + [(10, "little")] * 3)]
    seen = {}
    monkeypatch.setattr(m, "frozen", lambda counts: seen.update({k: v[1].sum() for k, v in counts.items()}))
    m.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 60_000)
    assert seen["little"] >= 120 and 20_000 <= seen["long"] <= 21_500 and 20_000 <= seen["short"] <= 21_500


def test_texts_of_no_learnt_language_go(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 300")
    rng = np.random.default_rng(4)
    noise = [(10**6 + i, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 600)), None) for i in range(20)]
    more = spark.createDataFrame(noise, "doc_id long, text string, lang string")
    for left_out in ("de", "fr"):
        given = docs.select("doc_id", "text", F.when(F.col("lang") != left_out, F.col("lang")).alias("lang")).unionByName(more)
        got = {r.doc_id for r in keep_known(given).select("doc_id").collect()}
        lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
        assert max(got) < 10**6 and sum(lang[d] == left_out for d in got) < 0.02 * len(got)
        others = [d for d, x in lang.items() if x not in (None, left_out)]
        assert sum(d in got for d in others) > 0.95 * len(others)
    one = docs.where("lang = 'en'").select("doc_id", "text", "lang").unionByName(more)
    assert max(r.doc_id for r in keep_known(one).select("doc_id").collect()) < 10**6


def test_all_stay_if_nothing_can_be_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "cast(null as string) as lang")
    with pytest.warns(UserWarning, match="no language"):
        assert keep_known(docs).count() == docs.count() > 0


def test_medians_are_exact(spark):
    import random
    import statistics

    rng = random.Random(3)
    rows = [("a", rng.gauss(2, 0.1)) for _ in range(501)] + [("b", rng.choice([1.0, 1.00001, 7.5])) for _ in range(40)] + [("c", 3.25)] + [("d", 1.0), ("d", 4.0)]
    want = {k: statistics.median(v for x, v in rows if x == k) for k in "abcd"}
    assert language.medians(spark.createDataFrame(rows, "lang string, rate double")) == want
    assert language.medians(spark.createDataFrame([], "lang string, rate double")) == {}


def test_typical_rates_read_all_held_out_texts_whole(spark):
    import numpy as np

    text = lambda i: ("the cat sat on the mat and saw a dog " * 150 if i % 3 else "zq jx vk ") + f" {i} " + "wxyzv qjk " * (i % 700)
    docs = spark.createDataFrame([(i, text(i), "en") for i in range(1500)], "doc_id long, text string, lang string")
    trees = language.learn(docs.where("doc_id < 50"))
    unseen = docs.where("doc_id >= 50")
    got = language.typical_rates(unseen, trees, spark.sparkContext.broadcast(trees))
    rates = [float(language.code_lengths(trees, [language.normal(text(i))])[0, 0]) / len(language.normal(text(i))) for i in range(50, 1500)]
    assert abs(got["en"] - float(np.median(rates))) < 1e-12
