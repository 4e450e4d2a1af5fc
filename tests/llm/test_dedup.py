"""Repeated strings, near-duplicates and the pipeline against brute force."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textkiln.llm import minhash_dedup, queries, substring_dedup
from textkiln.llm.common import table

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def saved(spark, tmp_path, docs):
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], DOCS)
    df.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_repeated_strings(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    passage, copy = prose(rng, 40), prose(rng, 200)
    texts = [None, "", "a" * 99, "a" * 400, "ab" * 300, copy, copy, copy[:500] + "X" + copy[501:], copy[300:] + copy[:300]]
    texts += [prose(rng, rng.randint(1, 60)) + passage + prose(rng, rng.randint(0, 60)) for _ in range(40)]
    texts += [copy] * 5 + [passage[:99], passage[:100], passage[3:103], "\n".join([passage] * 3)]
    docs = list(enumerate(texts))
    want = sorted(brute.repeated_bytes(docs))
    sf = saved(spark, tmp_path, docs)
    got = queries.op6_substring_dedup(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == want
    for most, bits in ((9, None), (2, None), (32_768, 64), (3, 64)):
        if bits:  # bitmaps so full that they let everything through
            monkeypatch.setattr(substring_dedup, "bits_for", lambda n: 64)
        out = substring_dedup.remove_repeats(table(spark, sf, "documents").withColumn("kept", F.lit(1)), most)
        got = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
        assert sorted(map(tuple, got.collect())) == want
    assert substring_dedup.remove_repeats(table(spark, sf, "documents").limit(0)).count() == 0
    odd = spark.createDataFrame([(None, copy), (3, copy), (3, copy), (2, copy + passage)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in substring_dedup.remove_repeats(odd).collect())[0] == 0


def test_longest_previous_factors():
    rng = random.Random(4)
    for letters, n in (("ab", 300), ("a", 40), ("abcd", 200), ("", 0)):
        text = "".join(rng.choice(letters) for _ in range(n))
        order = sorted(range(n), key=lambda i: text[i:])
        shared = lambda i, j: next((k for k in range(n) if text[i + k : i + k + 1] != text[j + k : j + k + 1] or i + k >= n or j + k >= n), 0)  # noqa: B023, E731
        lcp = np.array([shared(i, j) for i, j in zip(order, order[1:], strict=False)], np.int64)
        lcp = np.concatenate([np.zeros(min(1, n), np.int64), lcp])
        want = {i: max([shared(i, j) for j in range(i)], default=0) for i in range(n)}
        for least in (1, 4):
            got = dict(zip(order, substring_dedup.previous_factors(np.array(order, np.int64), lcp, least).tolist(), strict=True))
            assert all(got[i] == want[i] if want[i] >= least else got[i] <= want[i] for i in range(n))


def test_what_is_removed_comes_from_previous_factors(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    passage = prose(rng, 60)
    docs = [(i, f"{prose(rng, 30)} {passage if i % 3 else passage[: 100 + i]} {prose(rng, 30)}") for i in range(30)]
    removed = lambda sf: sum(r["n_removed"] for r in queries.op6_substring_dedup(spark, sf).collect())
    sf = saved(spark, tmp_path, docs)
    whole = removed(sf)
    monkeypatch.setattr(substring_dedup, "_local", lambda batches: (x for x in ()))
    assert removed(sf) < 0.9 * whole


def classes(docs, similarity=0.8):
    bags = []
    for _, t in docs:
        w = (t or "").split()
        bags.append(collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if (docs[i][1] or "") == (docs[j][1] or "") or both and both >= similarity * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def near_texts():
    rng = random.Random(8)
    base = prose(rng, 200).split()

    def changed(words, n):
        w = list(words)
        for i in rng.sample(range(len(w)), n):
            w[i] = prose(rng, 1) + "Z"
        return " ".join(w)

    texts = [changed(base, n) for n in [0, 1, 2, 3, 3, 3, 4, 4, 5, 5, 6, 7, 8, 9] * 4]
    chain = base
    for _ in range(6):
        chain = changed(chain, 3).split()
        texts.append(" ".join(chain))
    other = prose(rng, 120)
    texts += [other, other, other + " more", prose(rng, 30), None, "", "  ", "one", "one", "one two", "same words " * 40, "same words " * 44, "same words " * 20]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("rounds", [5, 0])
def test_near_duplicates(spark, tmp_path, monkeypatch, rounds):
    monkeypatch.setattr(minhash_dedup, "ROUNDS", rounds)
    docs = near_texts()
    got = {r["doc_id"]: r for r in queries.op7_minhash(spark, saved(spark, tmp_path, docs)).collect()}
    want = classes(docs)
    assert {d: r["class_id"] for d, r in got.items()} == want
    assert all(r["class_size"] == sum(c == r["class_id"] for c in want.values()) for r in got.values())
    texts = dict(docs)
    for d, r in got.items():
        others = {texts[x] or "" for x, c in want.items() if c == r["class_id"]} - {texts[d] or ""}
        assert (r["n_links"] > 0) == bool(others) and r["n_links"] <= len(others)


def test_texts_whose_hashes_clash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "text_key", lambda: [(F.xxhash64("text") % 2).alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")])
    df = spark.createDataFrame([(i, f"{'abcdefgh'[i % 8]} own words of this text") for i in range(16)], "doc_id long, text string")
    assert {r["class_id"]: r["class_size"] for r in minhash_dedup.near_duplicates(df).collect()} == {i: 2 for i in range(8)}


def test_near_duplicates_odd_tables(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "x"), (1, "x"), (1, "x"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h1", F.lit("clash"))
    out = sorted(((r["doc_id"] or -1, r["text"] or "", r["class_id"] or -1, r["class_size"]) for r in minhash_dedup.near_duplicates(df).collect()))
    assert out == [(-1, "a b c d e f", -1, 2), (-1, "a b c d e f", -1, 2), (-1, "x", 1, 3), (1, "x", 1, 3), (1, "x", 1, 3), (2, "", 2, 1)]
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in minhash_dedup.representatives(df).collect()) == [(-1, "a b c d e f"), (1, "x"), (2, "")]
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(6)
    items = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
    own = np.repeat([0, 1], 60)
    sig = minhash_dedup.signatures(own, np.concatenate([items, items]), np.concatenate([a, b]), 2, 8192)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.025
    n, _, c = minhash_dedup.shingles(pa.array(["a b c d e f", " a  b ", None, "x x x x x x x"]))
    assert n.tolist() == [0, 0, 1, 3] and c.tolist() == [1, 1, 1, 3]


def test_pipeline_stages(spark, tmp_path):
    docs = near_texts()
    item = "these ten words are a passage of the benchmark itself"
    docs += [(1_000 + i, f"own number {i} text\nShared LINE here") for i in range(12)] + [(2_000, f"leaks: {item} indeed"), (2_001, "123 456")]
    sf = saved(spark, tmp_path, docs)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    src = table(spark, sf, "documents")
    lang = dict(corpus_pipeline.STAGES)["language_id"](spark, src, sf)
    kept = [(d, t) for d, t in docs if t and any(c.isalpha() for c in t)]
    assert sorted(r["doc_id"] for r in lang.collect()) == sorted(d for d, _ in kept)
    lines = dict(corpus_pipeline.STAGES)["line_dedup"](spark, lang, sf)
    cut = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert cut[1_003] == "own number 3 text" and lines.columns == list(corpus_pipeline.COLUMNS)
    near = dict(corpus_pipeline.STAGES)["near_dedup"](spark, lines, sf)
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(set(classes(sorted(cut.items())).values()))
    clean = dict(corpus_pipeline.STAGES)["decontamination"](spark, near, sf)
    left = {r["doc_id"] for r in clean.collect()}
    assert left == {r["doc_id"] for r in near.collect()} - {2_000}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == left


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    odd = [(None, "words of an odd document here"), (None, None), (3, "same words in both rows"), (3, "same words in both rows"), (4, ""), (5, "words of an odd document are the same in both rows here " * 2_000)]
    rows = [(i, t, "en" if t else None, None, None) for i, t in odd]
    for name, items in (("some", [(None, "words of an odd"), (1, None)]), ("none", [])):
        sf = f"{tmp_path}/{name}"
        docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("h1", "kept", "hits", "score", "ids", "class_id")})
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        for stage, f in corpus_pipeline.STAGES:
            src = table(spark, sf, "documents")
            for df, n in ((src, {"language_id": 4, "near_dedup": 4}.get(stage, 6)), (src.limit(0), 0)):
                out = f(spark, df, sf)
                got = out.select("doc_id").distinct().count() if stage == "packing" else out.count()
                assert got == (min(n, 4) if stage == "packing" else n), stage
                assert stage == "packing" or out.columns == list(corpus_pipeline.COLUMNS)
        assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == 3


def test_pipeline_drops_noise(spark):
    identify = dict(corpus_pipeline.STAGES)["language_id"]
    rng = random.Random(1)
    clean = [(i, " ".join(rng.choice("the house and a garden of old trees is near this small river".split()) for _ in range(80)), "en", "s", 0) for i in range(200)]
    noise = [(1_000, "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(300)), "en", "s", 0)]
    got = {r["doc_id"] for r in identify(spark, spark.createDataFrame(clean + noise, DOCS), "").collect()}
    assert got == set(range(200))


def test_pipeline_language_of_documents_without_one(spark):
    identify = dict(corpus_pipeline.STAGES)["language_id"]
    texts = [None, "", "123 _ 4", "words here", "½", "é", "中文", "\u0301 ٣"]
    bare = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in identify(spark, bare, "").collect()) == [3, 4, 5, 6]
    some = [(10, "the house and the garden " * 20, "en"), (11, "das Haus und der Garten " * 20, "de"), (12, "das Haus", None), (13, "the garden", None), (14, "das Haus", "en"), (15, "12", "en")]
    got = identify(spark, spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in some], DOCS), "").collect()
    assert sorted((r["doc_id"], r["lang"]) for r in got) == [(10, "en"), (11, "de"), (12, "de"), (13, "en"), (14, "en")]


def test_rarest_shingles_lose_no_pair(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(6):
        base = prose(rng, rng.randint(6, 60)).split()
        base += base[:20] * rng.randint(0, 2)
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["x", "y", "z"])
            texts.append(" ".join(w[: rng.randint(len(w) * 3 // 4, len(w))]))
    texts = list(dict.fromkeys(texts))
    own, items, counts = minhash_dedup.shingles(pa.array(texts))
    bags = [collections.Counter() for _ in texts]
    for o, i, n in zip(own.tolist(), items.tolist(), counts.tolist(), strict=True):
        bags[o][i] = n
    close = {(i, j) for i in range(len(texts)) for j in range(i) if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total()}
    frame = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    bounds, levels = minhash_dedup._bounds(frame.select("node"), frame)
    nodes = bounds.withColumn("comp", F.col("node"))
    found = {(max(r), min(r)) for r in minhash_dedup._rarest_pairs(nodes, frame, levels, 0.8).collect()}
    assert len(close) > 30 and close <= found
    assert len(found) < len(texts) * (len(texts) - 1) / 2
