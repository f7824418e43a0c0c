"""Edge cases of the corpus operators: empty tables, clashing names, repeated rows, ties, long texts, large numbers."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestwright.llm import ann, licenses, mixing, near_dup, packing, quality, suffix_dedup, topk, url_rules, warc
from nestwright.llm.queries import URL_RULES, tokenizer_path
from tests.llm.test_llm import DOCS, frame, prose, vectors


def top(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_scores_of_large_vectors_are_exact(spark):
    r = random.Random(4)
    x = [[float(r.randint(2**29, 2**30)) for _ in range(4)] for _ in range(60)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = top(topk.exact_top_k(df, df.where("vec_id % 20 = 0"), k=4, scale=1.0, block=8, group=2).collect())
    for q in (0, 20, 40):
        s = [(sum(int(a) * int(b) for a, b in zip(x[q], v, strict=True)), i) for i, v in enumerate(x) if i != q]
        assert got[q] == [(i, n) for n, i in sorted(s, key=lambda t: (-t[0], t[1]))[:4]]
    queries, data = np.array([[2.0**40, 3.0]]), np.array([[2.0**21, 1.0], [2.0**21, 7.0], [-(2.0**22), 1.0]])
    assert [a.tolist() for a in topk.top_products(queries, np.array([9]), data, np.array([1, 2, 3]), 2)] == [[9, 9], [2, 1], [2**61 + 21, 2**61 + 3]]
    with pytest.raises(OverflowError):
        topk.top_products(np.array([[2.0**50]]), np.array([9]), np.array([[2.0**20]]), np.array([1]), 1)


def test_top_k_shares_scores_and_prunes_clusters():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16)) * 300
    data = np.round(np.repeat(centres, 100, 0) + r.normal(size=(4000, 16)))
    queries, ids = data[::50], np.arange(0, 4000, 50)
    seen, with_floor = [], []
    plain = topk.top_products(queries, ids, data, np.arange(4000), 5, seen=seen)
    floors = np.array([plain[2][plain[0] == i].min() for i in ids], float)
    again = topk.top_products(queries, ids, data, np.arange(4000), 5, floors, with_floor)
    assert all((a == b).all() for a, b in zip(plain, again, strict=True))
    assert sum(with_floor) <= sum(seen) < 0.5 * 80 * 4000


def test_top_k_repeats_and_ties(spark):
    x = np.ones((30, 4), np.float32)
    df = vectors(spark, x, [(0, [1.0, 1.0, 1.0, 1.0], 0), (3, [2.0, 1.0, 1.0, 1.0], 0)])
    got = top(topk.exact_top_k(df, df.where("vec_id = 10"), block=4, group=1).collect())
    assert [v for v, _ in got[10]] == [3, 0, 0, 1, 2]
    assert topk.exact_top_k(df.limit(0), df).count() == 0 and topk.exact_top_k(df, df.where("false")).count() == 0


def test_additive_search_finds_vectors_of_rare_lengths(spark):
    """A length that a sample of the whole table would miss has an index of its own."""
    r = np.random.default_rng(8)
    x = [(i, [float(v) for v in r.normal(size=8)]) for i in range(400)] + [(1000 + i, [float(i), 1.0]) for i in range(3)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
    got = ann.additive_search(df, df.where("vec_id % 100 = 0"), books=2, words=16, train_rows=20).collect()
    mine = [(g.rank, g.vec_id, g.score) for g in sorted(got, key=lambda g: g.rank) if g.query_id == 1000]
    assert mine == [(1, 1001, 1.0), (2, 1002, 2.0)]


def test_additive_search_recall_of_production_parameters(spark):
    x = np.random.default_rng(6).normal(size=(3000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = vectors(spark, x)
    got = top(ann.additive_search(df, df.where("vec_id % 100 = 0")).collect())
    hits = 0
    for q in range(0, 3000, 100):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        hits += len({v for v, _ in got[q]} & set([i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]))
    assert hits >= 0.9 * 300


CLASH = {"mix_block": 1, "_mix_source": 2, "_mix_key": 3, "_mix_rank": 4, "_gone": 5, "_digest": 6, "_bytes": 7, "_first": 8, "_rid": 9, "host": 10, "rule": 11, "verdict": 12, "_url": 13, "_score": 14, "score": 15, "row": 16, "doc": 17, "tag": 18, "kept": 19, "n_licenses": 20, "_spots": 21, "length": 22, "vector": 23, "id": 24, "rank": 25}


def clashing(df):
    return df.select("*", *(F.lit(v).alias(k) for k, v in CLASH.items() if k not in df.columns))


def test_extra_columns_of_any_name(spark):
    t = prose(60, 1)
    docs = clashing(frame(spark, [t, t, prose(60, 2), None, ""]))
    pages = clashing(spark.createDataFrame([(1, "http://a.example.org/es/", "<p>")], "page_id long, url string, html string"))
    vecs = clashing(vectors(spark, np.eye(8, dtype=np.float32)))
    assert mixing.mixed_order(docs).columns == docs.columns and mixing.mixed_order(docs).count() == 5
    assert mixing.mix(docs, keep=("doc_id", "_mix_source")).select("_mix_source").distinct().collect()[0][0] == 2
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3, 4] and kept.head()["_gone"] == 5
    cut = suffix_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns and {r.doc_id: r.text for r in cut.collect()} == {0: t, 1: "", 2: prose(60, 2), 3: None, 4: ""}
    assert licenses.scan(docs, licenses.train(spark, licenses.sample_paragraphs(docs))).count() == 5
    assert warc.capture_digests(pages).head().record_type == "response"
    judged = url_rules.judge(pages, URL_RULES, [])
    assert (judged.head().host, judged.head().verdict) == ("a.example.org", "block")
    assert packing.pack(docs, tokenizer_path()).where("start = 0").count() == 5  # a row per piece
    assert quality.score(docs, quality.train([]), keep=("doc_id", "_score")).columns == ["doc_id", "_score", "score"]
    assert topk.exact_top_k(vecs, vecs.where("vec_id = 0")).count() == 5 and ann.additive_search(vecs, vecs.where("vec_id = 0"), books=2).count() == 7


def test_empty_tables(spark):
    docs, pages = spark.createDataFrame([], DOCS), spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert licenses.scan(docs, licenses.train(spark, licenses.sample_paragraphs(docs))).count() == 0
    assert warc.capture_digests(pages).count() == 0
    assert quality.score(docs, quality.fit(docs, labels)).count() == 0
    assert url_rules.judge(pages, URL_RULES, url_rules.mine(pages.withColumn("bad", F.lit(1)), "url", "bad")).count() == 0
    assert near_dup.keep_one(docs).count() == mixing.mixed_order(docs).count() == suffix_dedup.remove_repeats(docs).count() == packing.pack(docs, tokenizer_path()).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows(spark):
    t = "Released under the MIT License.\n" + prose(30, 3)
    docs = frame(spark, [t, t, t], [5, 5, 6])
    assert sorted(r.doc_id for r in packing.pack(docs, tokenizer_path()).where("start = 0").collect()) == [5, 5, 6]
    assert [r.family for r in licenses.scan(docs, licenses.train(spark, [])).collect()] == ["mit"] * 3
    pages = spark.createDataFrame([(1, "u", "y" * 200), (1, "u", "y" * 200), (2, "u", "y" * 200)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.capture_digests(pages).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert url_rules.judge(pages, URL_RULES, []).count() == 3
    assert quality.score(docs, quality.train([])).count() == 3


def test_very_long_texts(spark):
    long = prose(300_000, 8)
    near = long.split()
    near[1000:1100] = ["other"] * 100
    docs = frame(spark, [long, " ".join(near), "Licensed under CC BY 4.0.\n" * 1 + long.replace(" ", "\n")])
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(docs.where("doc_id < 2")).collect()} == {0: 0, 1: 0}
    assert {r.doc_id: r.family for r in licenses.scan(docs, licenses.train(spark, [])).collect()}[2] == "cc-by"
    pages = spark.createDataFrame([(1, "http://a/" + "x/" * 200_000, long)], "page_id long, url string, html string")
    got = warc.capture_digests(pages).head()
    assert got.payload_digest == hashlib.sha256(long.encode()).hexdigest() and got.payload_bytes == len(long)
    assert url_rules.judge(pages, URL_RULES, []).head().host == "a"


def test_quality_against_python():
    """Scores from a plain count of words and pairs; the weight of an n-gram is looked up by a text that holds it alone."""
    import math
    import re

    import pyarrow as pa

    texts = ["The cat!! the cat", "", "a a b a", "Ähm: 12 12", "x", "### ###ab c", prose(50, 4)]
    weights, bias = np.random.default_rng(1).normal(size=1 << quality.BITS).astype(np.float32) * 9, 0.3

    def at(text: str, place: int) -> float:
        return float(weights[quality.features(pa.array([text]))[0][place]])

    run = quality._score(weights, bias, quality.BITS)
    got = next(run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))).column(0).to_pylist()
    for text, score in zip(texts, got, strict=True):
        words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\s\x80-\U0010ffff]+", text)
        total = sum(at(w, 0) for w in words)
        for i, w in enumerate(words):
            total += at("x", 1) if not i else at("x x", 3) if w in words[max(0, i - 2) : i] else at(f"{words[i - 1]} {w}", 3)
        assert math.isclose(score, 1 / (1 + math.exp(-(total / (len(words) + quality.SMOOTH) + bias))), rel_tol=1e-4)


def test_licenses_against_python(spark):
    """Probabilities and similarities from the model's weights, word by word in Python."""
    import math
    import re

    model = licenses.train(spark, [prose(20, i) for i in range(40)])
    lines = [*(t for ts in licenses.TEMPLATES.values() for t in ts), "This work is licensed under something", "MIT license terms", "all rights are reserved by the GNU project"]
    got = {r.doc_id: r.licenses for r in licenses.scan(frame(spark, lines), model, least=0.0).collect()}
    for i, line in enumerate(lines):
        words = [w for w in re.split(r"[\W_]+", line.lower()) if w]
        grams = {" ".join(words[j : j + n]) for n in (1, 2, 3) for j in range(len(words) - n + 1)}
        scores = {f: (model["bias"][f] + sum(model["weights"][g].get(f, 0.0) for g in grams if g in model["weights"])) / model["temperature"] for f in model["families"]}
        family = max(scores, key=lambda f: scores[f])
        if not got[i]:  # no word of the line is needed by any family, so every score is below the unknown class's
            assert all(v < 0 for v in scores.values())
            continue
        assert got[i][0].family == family and math.isclose(got[i][0].probability, math.exp(scores[family]) / (1 + sum(map(math.exp, scores.values()))), abs_tol=1e-5)
        trigrams = [" ".join(words[j : j + 3]) for j in range(len(words) - 2)]
        mine = {g for t in licenses.TEMPLATES[family] for w in [[x for x in re.split(r"[\W_]+", t.lower()) if x]] for g in (" ".join(w[j : j + 3]) for j in range(len(w) - 2))}
        assert math.isclose(got[i][0].similarity, sum(g in mine for g in trigrams) / max(1, len(trigrams)), abs_tol=1e-4)


def test_licenses_calibrated_on_other_texts():
    train, rest = licenses.variants()
    assert not {t for _, t in train} & {t for _, t in rest} and {f for f, _ in rest} == set(licenses.TEMPLATES)


def test_wrapped_licenses(spark):
    words = licenses.TEMPLATES["mit"][2].split()
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    texts = [f"{prose(12, 1)}\n{wrapped}\n{prose(12, 2)}", f"{prose(12, 3)}\nLicensed under CC BY 4.0.\n{prose(12, 4)}", prose(30, 5)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts), licenses.train(spark, [prose(20, i) for i in range(40)])).collect()}
    assert got[0].family == "mit" and got[0].confirmed and all(v.family == "mit" for v in got[0].licenses)
    assert [(v.line, v.lines, v.family) for v in got[1].licenses] == [(1, 1, "cc-by")] and got[2].n_licenses == 0
