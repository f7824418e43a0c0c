"""Every stage of the pipeline against brute force, each judged on its own input, on a corpus of all kinds of documents."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as C
from nestwright.llm import mixing, quality
from nestwright.llm.queries import LEAST_QUALITY, tokenizer_path
from tests.llm.test_llm import DOCS, brute_repeats, lcs, prose


def corpus():
    texts = [prose(40 + i % 30, 900 + i) for i in range(90)]
    texts += ["!!! " + " ".join(w.upper() + "!!" for w in prose(30, 950 + i).split()) for i in range(30)]
    texts += [texts[3], texts[3].replace(" ", "\n"), None, "", "x"]
    for i in range(8):
        words = texts[10].split()
        words[random.Random(i).randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [f"{prose(20, 970 + i)} {texts[20]} é {prose(30, 990 + i)}" for i in range(4)]
    return texts


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 3}", None if t is None else len(t), i * 2) for i, t in enumerate(corpus())]
    docs = spark.createDataFrame(rows, DOCS + ", score int").repartition(3)
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [(i, 0 if (t or "").startswith("!!!") else 1, 0) for i, t in enumerate(corpus()) if i % 5 != 1]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    seen = [spark.read.parquet(f"{d}/documents.parquet")]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, seen[-1], str(d)).write.parquet(f"{d}/out-{k}")
        seen.append(spark.read.parquet(f"{d}/out-{k}"))
    return str(d), seen


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_classifier(spark, stages):
    d, seen = stages
    docs, kept = by_id(seen[0]), by_id(seen[1])
    weights, bias = quality.fit(seen[0], spark.read.parquet(f"{d}/labels.parquet"))
    at = lambda text, place: float(weights[quality.features(pa.array([text]))[0][place]])
    want = set()
    for i, r in docs.items():
        words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+|[^0-9A-Za-z\s\x80-\U0010ffff]+", r.text or "")
        total = sum(at(w, 0) + (at("x", 1) if not j else at("x x", 3) if w in words[max(0, j - 2) : j] else at(f"{words[j - 1]} {w}", 3)) for j, w in enumerate(words))
        if 1 / (1 + math.exp(-(total / (len(words) + quality.SMOOTH) + bias))) >= LEAST_QUALITY:
            want.add(i)
    assert set(kept) == want and all(kept[i] == docs[i] for i in kept)
    assert not any((r.text or "").startswith("!!!") for r in kept.values()) and len(kept) >= len(docs) - 30


def test_near_duplicates(stages):
    _, seen = stages
    docs, kept = by_id(seen[1]), by_id(seen[2])
    words = {i: (r.text or "").lower().split() for i, r in docs.items()}
    root = {i: i for i in docs}
    for i in sorted(docs):
        for j in sorted(docs):
            a, b = words[i], words[j]
            if j < i and root[i] != root[j] and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) > 0 and lcs(a, b) >= 0.8 * max(len(a), len(b)):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if x == old else x for k, x in root.items()}
    assert set(kept) == {i for i in docs if root[i] == i} and all(kept[i] == docs[i] for i in kept) and len(kept) < len(docs)


def test_repeated_passages(stages):
    _, seen = stages
    docs, kept = by_id(seen[2]), by_id(seen[3])
    brute = brute_repeats((i, r.text) for i, r in docs.items())
    assert set(kept) == set(docs) and sum(b[1] > 0 for b in brute.values()) >= 3
    for i, r in docs.items():
        if r.text is None or not brute[i][1]:
            assert kept[i] == r
        else:  # characters that a span covers in part stay whole, so at most three bytes more at each edge
            size = len(kept[i].text.encode())
            assert 0 <= size - (brute[i][0] - brute[i][1]) <= 6 * brute[i][2] and kept[i].n_chars == len(kept[i].text)
            assert (kept[i].doc_id, kept[i].source, kept[i].score) == (r.doc_id, r.source, r.score)


def test_mixing(spark, stages):
    d, seen = stages
    assert sorted(map(str, seen[3].collect())) == sorted(map(str, seen[4].collect())) and seen[4].columns == seen[3].columns
    placed = mixing.mix(seen[3]).toPandas().sort_values("mix_position")
    totals = placed.source.fillna("-").value_counts().to_dict()
    weights = {s: n**0.5 for s, n in totals.items()}
    slots = placed.drop_duplicates("mix_slot").source.fillna("-").tolist()
    done = dict.fromkeys(totals, 0)
    for t, s in enumerate(slots, 1):
        done[s] += 1
        if any(-(-totals[x] // 16) == done[x] for x in totals):
            break  # a source has run out
        assert all(abs(done[x] - t * weights[x] / sum(weights.values())) < 1 for x in totals)
    files = [r.doc_id for r in seen[4].collect()]
    assert sorted(files) == sorted(placed.doc_id)


def test_packing(stages):
    from tokenizers import Tokenizer

    _, seen = stages
    encode = Tokenizer.from_file(tokenizer_path()).encode
    pieces = seen[5].toPandas().sort_values(["doc_id", "start"])
    for i, r in by_id(seen[4]).items():
        ids = np.array([*encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = pieces[pieces.doc_id == i]
        assert mine.length.sum() == len(ids) and mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]]
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 4096 and s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
