"""Operators of the corpus subpackage against brute force, on small fixtures with nulls, ties, repeats and long texts."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.llm import ann, licenses, mixing, near_dup, packing, quality, suffix_dedup, text, topk, url_rules, warc
from nestwright.llm.queries import URL_RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(3)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def corpus(spark):
    line = "A common line of more than fifty bytes that very many documents hold, é. "
    texts = [None, "", "x", prose(200, 1), prose(200, 1), line + prose(60, 2), prose(60, 3) + line, "ha " * 400, "ha " * 300, prose(5000, 4), prose(40, 5) + " é" * 60]
    texts += [line + prose(30, 100 + i) for i in range(60)]
    base = prose(300, 9).split()
    for i in range(20):
        v = list(base)
        for j in random.Random(i).sample(range(300), 4):
            v[j] = "changed"
        texts.append(" ".join(v))
    return texts


# ---- 10: repeated passages -------------------------------------------------------------------------------------
def brute_repeats(rows, length=50):
    seen, out = set(), {}
    for i, t in sorted((i, (t or "").encode()) for i, t in rows):
        gone, own = bytearray(len(t)), set()
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            own.add(w)
            if w in seen:
                gone[p : p + length] = b"\1" * length
        seen |= own
        runs = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    return out


def test_repeated_spans(spark, corpus, monkeypatch):
    got = {r.doc: (r.n_bytes, r.n_removed, len(r.spans), r.kept) for r in suffix_dedup.repeated_spans(frame(spark, corpus)).collect()}
    assert got == brute_repeats(enumerate(corpus))


def test_repeats_with_null_and_equal_ids_and_kept_text(spark):
    t = prose(40, 77)
    df = frame(spark, [t, t, t, None], [1, None, 1, None])
    got = sorted((r.doc is None, r.n_removed) for r in suffix_dedup.repeated_spans(df).collect())
    assert got == [(False, 0), (False, 0), (True, 0), (True, 0)]
    out = suffix_dedup.remove_repeats(frame(spark, [t, "é" + t + "é"]).withColumn("kept", F.lit(1)))
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].text == "éé" and rows[1].n_chars == 2 and rows[0].text == t and out.columns[-1] == "kept"
    assert suffix_dedup.repeated_spans(spark.createDataFrame([], DOCS)).count() == 0


def test_longest_previous_factors():
    for seed in range(30):
        r = np.random.default_rng(seed)
        n, length = int(r.integers(1, 60)), int(r.integers(1, 12))
        windows, docs = r.integers(97, 99, (n, length)).astype(np.uint8), r.integers(0, 8, n)
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))
        want = [max([common(windows[i], windows[j]) for j in range(n) if docs[j] < docs[i]], default=0) for i in range(n)]
        assert suffix_dedup.longest_previous_factors(windows, docs).tolist() == want
        for least in (2, length):
            got = suffix_dedup.longest_previous_factors(windows, docs, least)
            assert [(g if g >= least else 0) for g in got.tolist()] == [(w if w >= least else 0) for w in want]


def test_repeats_with_more_slots_than_tasks(spark, corpus, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLOT", 1000)
    monkeypatch.setattr(suffix_dedup, "TASK", 20_000)
    got = {r.doc: (r.n_bytes, r.n_removed, len(r.spans), r.kept) for r in suffix_dedup.repeated_spans(frame(spark, corpus)).collect()}
    assert got == brute_repeats(enumerate(corpus))


def test_runs_that_share_a_gram_by_chance_are_not_followed():
    """16 equal bytes with other bytes on both sides are no 50 equal ones: nothing of such texts is cut and dealt."""
    texts = [prose(60, 500 + i) + " a few common words " + prose(60, 900 + i) for i in range(300)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array(texts), pa.array([0] * 300, pa.int32())], ["doc", "text", "tag"])
    reports = list(suffix_dedup._find(50, 16, 1, 1)(iter([docs.slice(a, 10) for a in range(0, 300, 10)])))
    followed = [row for batch in suffix_dedup._match(1)(iter(reports)) for row in batch.to_pylist()]
    assert reports and not followed


@pytest.mark.parametrize("length, k", [(50, 16), (51, 16), (18, 17), (9, 8)])
def test_repeats_of_about_the_length_at_edges_and_within(spark, length, k):
    r = random.Random(length)
    some = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    planted, texts = [some(length + d) for d in (-1, 0, 1, 7, 40)], []
    for i in range(120):
        p, q = r.choice(planted), r.choice(planted)
        cut = r.randint(0, 12)
        texts.append([p + some(80), some(80) + p, p, some(30) + p[cut:] + some(9) + q, some(5) + p + q[: len(q) - cut] + some(70)][i % 5])
    got = {x.doc: (x.n_bytes, x.n_removed, len(x.spans), x.kept) for x in suffix_dedup.repeated_spans(frame(spark, texts), length=length, k=k).collect()}
    assert got == brute_repeats(enumerate(texts), length)


def test_repeats_in_a_text_above_one_piece(spark):
    """Texts above 2**24 bytes are cut into overlapping pieces."""
    r = np.random.default_rng(5)
    long = bytes(r.integers(97, 123, (1 << 24) + 3000, dtype=np.uint8)).decode()
    shared = long[(1 << 24) - 400 : (1 << 24) + 400]
    got = {x.doc: x for x in suffix_dedup.repeated_spans(frame(spark, [shared + prose(5, 1), long])).collect()}
    assert got[1].n_removed == 800 and got[1].spans[0]["from"] == (1 << 24) - 400 and got[0].n_removed == 0


# ---- 2: near-duplicates ------------------------------------------------------------------------------------------
def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_banded_alignment():
    for s in range(40):
        r = random.Random(s)
        a, b = ([r.randint(0, 4) for _ in range(r.randint(1, 25))] for _ in range(2))
        assert near_dup.banded_lcs(a, b, 30) == lcs(a, b)
        assert near_dup.banded_lcs(a, b, 2) <= lcs(a, b)


def test_near_duplicate_classes(spark, corpus):
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(frame(spark, corpus), bucket=8).collect()}
    words = [(t or "").lower().split() for t in corpus]
    root = list(range(len(corpus)))
    for i in range(len(corpus)):
        for j in range(i):
            a, b = words[i], words[j]
            if a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and lcs(a, b) >= 0.8 * max(len(a), len(b)):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    assert [got[i] for i in range(len(corpus))] == root


def test_near_duplicates_in_dealt_buckets(spark):
    """Texts of one template share its buckets; pairs among them are found however the buckets are dealt."""
    template, texts = prose(75, 70), []
    for i in range(30):
        own = [f"own{i}x{j}" for j in range(25)]
        texts += [f"{template} {' '.join(own)}", f"{template} {' '.join(own[:-1])} other"]
    df = frame(spark, texts)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(df, sketches=3, bucket=2).collect()}
    assert got == {i: i - i % 2 for i in range(60)}


def test_near_duplicates_of_low_jaccard_in_large_buckets(spark):
    """Every pair of classes in a large bucket is compared: scattered edits leave few common runs but align to 0.8."""
    template, texts = prose(60, 71).split(), []
    for i in range(40):
        own = [f"own{i}x{j}" for j in range(60)]
        other = [w if j % 9 else f"new{i}x{j}" for j, w in enumerate(own)]
        texts += [" ".join(template + own), " ".join(template + other)]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicate_classes(frame(spark, texts), bucket=2, tile=4000).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def test_links_between_tiles():
    texts = [" ".join(prose(12, i).split()[:6] * 2 + prose(r, i + r).split()) for i in range(30) for r in (3, 4)]
    codes = [np.array([zlib.crc32(w.encode()) for w in t.split()], "<u4") for t in texts]
    rows = [(i % 2, i, i // 4, c.tobytes()) for i, c in enumerate(codes)]
    for sides in (rows, [(0, *r[1:]) for r in rows]):
        root = [r[2] for r in rows]
        for i in range(len(rows)):
            for j in range(i):
                n = max(len(codes[i]), len(codes[j]))
                if (sides[i][0] != sides[j][0] or sides is not rows) and lcs(codes[i].tolist(), codes[j].tolist()) >= 0.6 * n:
                    root = [root[j] if x == root[i] else x for x in root]
        mine = [r[2] for r in rows]
        for a, b in near_dup.links_between(sides, 0.6):
            assert mine[a] != mine[b]
            mine = [mine[b] if x == mine[a] else x for x in mine]
        assert len(set(zip(root, mine))) == len(set(root)) == len(set(mine))


def test_near_duplicates_edges(spark):
    t = prose(50, 5)
    df = frame(spark, [t, t, t, "", None], [4, None, 2, 8, 9])
    assert sorted((r.doc_id or -1, r.class_id or -1) for r in near_dup.near_duplicate_classes(df).collect()) == [(-1, -1), (2, 2), (4, 2), (8, 8), (9, 9)]
    assert sorted(r.doc_id or -1 for r in near_dup.keep_one(df).collect()) == [-1, 2, 8, 9]
    assert near_dup.near_duplicate_classes(spark.createDataFrame([], DOCS)).count() == 0


# ---- 1: mixing -----------------------------------------------------------------------------------------------------
def test_pfair_period_stays_within_a_block():
    for s in range(6):
        r = random.Random(s)
        whole = mixing.whole_weights({f"s{i}": r.random() ** 3 + 1e-3 for i in range(r.randint(1, 25))}, 256)
        done = dict.fromkeys(whole, 0)
        for t, source in enumerate(mixing.pfair_period(whole), 1):
            done[source] += 1
            assert all(abs(done[x] - t * a / 256) < 1 for x, a in whole.items())


def test_mixing_places_every_row_once(spark):
    rows = [(i, "big" if i % 3 else None if i % 2 else "small", "t") for i in range(3000)] + [(7, "big", "t")] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_text string").repartition(5)
    got = mixing.mix(df, weights={"big": 1, "small": 2, None: 1}, block=4, period=64).toPandas()
    assert len(got) == 3003 and got.mix_position.is_unique and got.mix_position.min() == 0
    slots = got.drop_duplicates("mix_slot").sort_values("mix_slot").source.fillna("-").tolist()
    first = 240  # no source has run out by then
    for t in range(1, first):
        for s, w in (("big", 0.25), ("small", 0.5), ("-", 0.25)):
            assert abs(slots[:t].count(s) - t * w) < 1
    order = mixing.mixed_order(df, weights={"big": 1, "small": 2, None: 1}, block=4, period=64)
    assert order.columns == df.columns and order.count() == 3003
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, weights={"big": 1})


def test_mixing_keeps_to_the_target_weights_over_many_periods(spark):
    """Less than one block from the weights that were asked for, not from weights rounded to a period."""
    n = 20
    df = spark.range(n * 300).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % n).alias("source"))
    got = mixing.mix(df, weights={f"s{i}": 1 for i in range(n)}, block=1).select("source", "mix_slot").toPandas()
    done = dict.fromkeys(got.source, 0)
    slots = got.sort_values("mix_slot").source.tolist()
    assert got.mix_slot.is_unique and len(slots) == n * 300
    for t, s in enumerate(slots, 1):
        done[s] += 1
        assert all(abs(x * n - t) < n for x in done.values())
    for seed in range(4):
        weights = {i: random.Random(seed * 99 + i).random() ** 2 + 1e-4 for i in range(30)}
        whole, done = mixing.exact_weights(weights), dict.fromkeys(weights, 0)
        total = sum(whole.values())
        for t, (s, k, slot) in enumerate(mixing.schedule(dict.fromkeys(weights, 10**9), weights), 1):
            assert (k, slot) == (done[s], t - 1)
            done[s] += 1
            assert all(abs(done[x] * total - t * whole[x]) < total for x in weights)
            if t == 5000:
                break


# ---- 9: packing ----------------------------------------------------------------------------------------------------
def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "Hello, World!!  it's 42", "a<|endoftext|>b <|ENDOFTEXT|>", "ÀÉ ﬁ\u2003x\x1cy", prose(9000, 2), "w" * 3000, *(prose(n, n) for n in range(1, 300, 7))]
    got = packing.pack(frame(spark, texts), tokenizer_path()).toPandas().sort_values(["doc_id", "start"])
    encode = Tokenizer.from_file(tokenizer_path()).encode
    for i, t in enumerate(texts):
        ids = [*encode(t or "", add_special_tokens=False).ids, 2]
        mine = got[got.doc_id == i]
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids) and (mine.doc_tokens == len(ids)).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length]))
    total = padded = 0
    for _, s in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        n = int(s.length.sum())
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and n <= 4096
        total, padded = total + n, padded + (0 if n & (n - 1) == 0 else 4096 - n)
    assert padded < 0.02 * total
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_path()).count() == 0


# ---- 6: quality ----------------------------------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    both = quality.score(docs.withColumn("score", F.lit(1)), model).join(labels, "doc_id").withColumn("held", quality.held_out(F.col("doc_id"))).toPandas()
    assert ((both.score >= 0.3) == (both.quality == 1))[both.held].mean() > 0.9
    empty = quality.score(frame(spark, [None, "", "x " * 30_000]), model).toPandas()
    assert empty.score.between(0, 1).all() and len(empty) == 3
    assert quality.fit(docs, labels.limit(0))[1] == 0.0


def test_features_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["Ab, cd cd", "", None, "x!! Y#"]
    index, share, at = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        alone, own, _ = quality.features(pa.array([t or ""]))
        assert index[at[i] : at[i + 1]].tolist() == alone.tolist() and np.allclose(share[at[i] : at[i + 1]], own)


def test_word_hashes_follow_words():
    import pyarrow as pa

    words, offs = text.word_hashes(pa.array(["The cat", None, "cat THE-é"]))
    assert np.diff(offs).tolist() == [2, 0, 3] and words[0] == words[3] and words[1] == words[2] and len(set(words.tolist())) == 3


# ---- 5 and 8: search -----------------------------------------------------------------------------------------------
def vectors(spark, x, extra=()):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])
    return spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + list(extra), schema).repartition(3)


ODD = [(900, None, 0), (901, [], 0), (902, [1.0, None], 0), (903, [float("nan")] * 8, 0), (904, [float("inf")] * 8, 0), (None, [0.5] * 8, 0), (950, [1.0, 2.0], 0)]


def test_exact_top_k(spark):
    x = np.round(np.random.default_rng(0).normal(size=(400, 8)), 1).astype(np.float32)
    x[100:140] = x[100]
    df = vectors(spark, x, ODD)
    got = {}
    for r in topk.exact_top_k(df, df.where("vec_id % 50 = 0"), block=64, group=4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    z = np.floor(x.astype(float) * 256)
    for q in range(0, 400, 50):
        s = z @ z[q]
        assert got[q] == [(int(i), int(s[i])) for i in np.lexsort((np.arange(400), -s)) if i != q][:5]
    assert set(got) == set(range(0, 400, 50))


def test_cover_tree_prunes_and_covers():
    r = np.random.default_rng(1)
    x = (r.normal(size=(12, 1, 4)) * 60 + r.normal(size=(12, 200, 4))).reshape(-1, 4)
    tree = topk.CoverTree(x)
    for n in range(len(tree.centre)):
        assert (np.linalg.norm(x[tree.members[n]] - x[tree.centre[n]], axis=1) <= tree.radius[n] + 1e-9).all()
        if len(tree.children[n]):
            assert sorted(np.concatenate([tree.members[c] for c in tree.children[n]])) == sorted(tree.members[n])


def test_additive_search(spark):
    x = np.random.default_rng(2).normal(size=(600, 8)).astype(np.float32)
    x[5] = 0
    df = vectors(spark, x, ODD[:6])
    hits = 0
    rows = ann.additive_search(df, df.where("vec_id % 100 = 0"), books=4, words=32).orderBy("query_id", "rank").collect()
    for q in range(0, 600, 100):
        mine = [r for r in rows if r.query_id == q]
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(600), d)) if i not in (q, 5)][:10]
        hits += len({r.vec_id for r in mine} & set(best))
        assert [r.rank for r in mine] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in mine)
    assert hits >= 0.9 * 60
    assert ann.additive_search(df.limit(0), df.limit(0)).count() == 0


# ---- 4: WARC -------------------------------------------------------------------------------------------------------
def test_warc_round_trip_and_assembly(spark, tmp_path):
    same = "x\r\n\r\nWARC/1.1\r\n" * 20
    rows = [(1, None, None), (2, "http://a\r\nb", same), (3, "u", same), (4, "u", "short"), (5, "u", "short"), (6, "", "é" * 50), (0, "z", "é" * 50), (7, "u", ""), (8, "u", "y" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {r.page_id: r for r in warc.capture_digests(pages).collect()}
    revisits = {3: 2, 6: 0}
    for i, _, html in rows:
        body = (html or "").encode()
        assert tuple(got[i][1:7]) == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if i in revisits else "response", revisits.get(i), 1, 1)
    warc.write_captures(pages, str(tmp_path / "w"))
    records = warc.read_records(spark, str(tmp_path / "w"))
    assert records.count() == 27
    full = {r.response.capture_key: bytes(r.response.payload) for r in warc.assemble(records).where("response is not null").collect()}
    assert full["2"] == same.encode() and full["3"] == b""


# ---- 7: URLs -------------------------------------------------------------------------------------------------------
def test_url_rules(spark):
    urls = ["http://a.Example.ORG/es/1", "http://example.org/en/12?x", "http://example.org/en/2", "https://b.com/fr/", "https://b.com/de/x#y", "http://x.net/p", "nothing", None, "http://org/", "http://org", "http://notorg/x", "a://b://c.org/d"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge(df, URL_RULES, []).collect()}

    def brute(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
            host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        fits = [(len(r), r, v) for v, r in URL_RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return (host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow")

    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == brute(u)


def test_mined_rules(spark):
    rows = [(f"http://bad.example.net/casino/{i}", 1) for i in range(60)] + [(f"http://h{i % 9}.example.net/news/{i}", 0) for i in range(140)] + [(None, 1)]
    rules = url_rules.mine(spark.createDataFrame(rows, "url string, bad int"), "url", "bad")
    pages = spark.createDataFrame([(1, "http://bad.example.net/casino/x"), (2, "http://h1.example.net/news/7"), (3, None)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_rules.judge(pages, [], rules).collect()} == {1: "block", 2: "allow", 3: "allow"}
    own = pages.select(url_rules.tokens(F.col("url"), url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("t"))
    for row in own.select("t", url_rules.mined_verdict(F.col("t"), rules).alias("v")).collect():  # brute force over all rules
        hits = [r for r in rules if set(r["tokens"]) <= set(row.t)]
        best = min(hits, key=lambda r: (-r["confidence"], -r["support"], r["tokens"]), default=None)
        assert row.v == (best and best["verdict"])


# ---- 3: licences ---------------------------------------------------------------------------------------------------
def test_licenses(spark):
    plain = [prose(30, i) for i in range(60)] + ["The license of the driver was valid", "General terms of use", "", None]
    notices = {"mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "licensed under CC BY-NC 4.0"}
    df = frame(spark, [*plain, *(prose(20, 500) + "\n" + n + "\n" + prose(20, 501) for n in notices.values())])
    model = licenses.train(spark, licenses.sample_paragraphs(df))
    got = {r.doc_id: r for r in licenses.scan(df, model).collect()}
    for i in range(len(plain)):
        assert got[i].n_licenses == 0 and got[i].family is None
    for i, family in enumerate(notices, len(plain)):
        assert got[i].family == family and got[i].confirmed and got[i].licenses[0].line == 1


def test_licenses_on_first_lines(spark):
    """Notices that the sample of first lines holds are found all the same."""
    plain = [prose(30, i) for i in range(60)]
    notices = {"mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3."}
    df = frame(spark, [*plain, *(n + "\n" + prose(20, 700 + i) for i in range(10) for n in notices.values())])
    sample = licenses.sample_paragraphs(df)
    assert set(notices.values()) <= set(sample)
    got = {r.doc_id: r for r in licenses.scan(df, licenses.train(spark, sample)).collect()}
    assert all(got[i].n_licenses == 0 for i in range(60))
    for i in range(60, 80):
        assert got[i].family == list(notices)[i % 2] and got[i].confirmed and got[i].licenses[0].line == 0


# ---- pipeline ------------------------------------------------------------------------------------------------------
def test_pipeline(spark, small):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["quality classifier", "near-duplicates", "repeated passages", "mixing", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs]
    for _, stage in C.STAGES[:4]:
        seen.append(stage(spark, seen[-1], small).persist())
        assert seen[-1].columns == docs.columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] < ids[0] and ids[2] < ids[1] and ids[3] == ids[2] == ids[4]
    kept = brute_repeats((r.doc_id, r.text) for r in seen[2].collect())
    assert sum(v[1] for v in kept.values()) > 0
    pieces = C.STAGES[4][1](spark, seen[4], small)
    assert {r.doc_id for r in pieces.collect()} == ids[4]
    assert C.run(spark, small).count() == pieces.count()
