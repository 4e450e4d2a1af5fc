"""Operators and their queries against brute force, on planted fixtures and the small tables."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textkiln.llm import decontamination, knn, language_id, line_dedup, packing, pii, queries, sharding, token_counts
from textkiln.llm.common import table
from textkiln.llm.tokens import SegmentEncoder, vocabulary

from . import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n", "\n\n", "a", "é Ñ\nÜ", "x" * 30_000, "9" * 20_000, "1 " * 8_000, "a.b@" * 2_000, "+1" * 3_000, "\x1c a \x85", "𝔘𝔫𝔦 😀 a@b.de 😀", "中文 字\r\n\tx ", "A b\nA b\na B "]


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], schema)


def saved(spark, tmp_path, texts):
    frame(spark, texts).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]


def test_pii_matches_plain_patterns(spark, tmp_path, small):
    rng = random.Random(7)
    texts = [t for _, t in small] + ODD
    texts += ["".join(rng.choice("0123456789012345678901234 .-@+()abz_%\n") for _ in range(400)) for _ in range(150)]
    texts += ["a@b.c_d@e.f.g@h.i", "4111 1111 1111 1111 5", "4111-1111-1111-1111", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "+49 (30) 1234-5678 +1234", "iban DE89 3704 0044 0532 0130 00.", "DE89370400440532013001", "ssn 078-05-1120", "078-05-1120"]
    got = {r["doc_id"]: r for r in queries.op3_pii(spark, saved(spark, tmp_path, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute.pii(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == brute.sha(joined), (i, t[:200], joined, got[i]["spans"])
        assert got[i]["spans"].startswith(joined)
        assert [got[i][f"n_{k}"] for k in brute.BASE] == [sum(x[0] == k for x in want) for k in brute.BASE]
    assert got[len(texts) - 4]["spans"] == "iban:5:32" and got[len(texts) - 3]["spans"] == ""
    assert got[len(texts) - 2]["spans"] == "ssn:4:15" and got[len(texts) - 1]["spans"] == ""


def test_secrets_and_context(spark):
    key, ghp, aws = "40d78a45c418324758e099eb7cb89bc0f5fa9f62", "ghp_" + "a1B2" * 9, "AKIA" + "Z9" * 8
    texts = {
        f'x token = "{key}"### y': [("secret", key)],
        f"commit {key} of tokenizers": [],
        f"API_KEY: {key}": [("secret", key)],
        f"{ghp} and {aws}": [("secret", ghp), ("secret", aws)],
        "-----BEGIN RSA PRIVATE KEY-----\nMII": [("secret", "-----BEGIN RSA PRIVATE KEY-----")],
        "the key " + "abcdefghij" * 3 + " has no digit": [],
        "SSNs: 078-05-1120": [("ssn", "078-05-1120")],
        "lessn 078-05-1120": [],  # no word of its own
        "social security number 078-05-1120": [("ssn", "078-05-1120")],
        None: [],
    }
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, pii int")
    got = {r["text"]: [(s["kind"], s["text"]) for s in r["pii"]] for r in pii.detect(df).collect()}
    assert got == texts
    hotel = spark.createDataFrame([(1, "hotel +49 30 1234567"), (2, "tel +49 30 1234567")], "doc_id long, text string")
    assert [r["pii"][0]["score"] for r in pii.detect(hotel).orderBy("doc_id").collect()] == [0.7, 1.0]
    assert pii.detect(df.limit(0)).count() == 0


def test_every_planted_secret_is_found(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").filter("text like '%token = %'").select("doc_id", "text")
    got = pii.detect(docs).select(F.regexp_count("text", F.lit('token = "[0-9a-f]{40}"')).alias("n"), pii.count_of(F.col("pii"), "secret").alias("found")).collect()
    assert len(got) > 100 and all(r["n"] == r["found"] for r in got)


def test_many_matches_cost_in_proportion(spark):
    seconds = []
    for n in (1_000, 4_000, 16_000):
        began = time.time()
        df = spark.range(1).select(F.lit(0).alias("doc_id"), F.repeat(F.lit("ab@c.de 1.2.3.4 "), n).alias("text"))
        assert pii.detect(df).select(F.size("pii").alias("n")).first()["n"] == 2 * n
        seconds.append(time.time() - began)
    assert seconds[2] < 8 * seconds[1] + 2
    print(seconds)


def test_account_numbers_next_to_words(spark):
    de, gb, mt = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"
    other = "ZZ59 1234 5678 9012 3456"  # a code without a length of its own
    texts = {
        f"{de} The account": [de],
        "DE89370400440532013000 BIC COBADEFFXXX": ["DE89370400440532013000"],
        f"{de} Please": [de],
        f"{gb} 2024": [gb],
        f"{de} {gb} {mt} A1": [de, gb, mt],
        f"AT12 {de} 7": [de],  # a false start with as many characters as an Austrian number
        f"NO9386011117947 {mt}\n{de}, 😀 {gb}": ["NO9386011117947", mt, de, gb],
        f"{gb}X {gb[:-1]}3 A{gb} {gb}é DE89 3704 0044 0532 0130 0": [gb],
        f"{other} The {other} BIC X": [other, other],
        "DE89 3704 0044 0532 0130 01 Please": [],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detect(df).collect():
        found = [s for s in r["pii"] if s["kind"] == "iban"]
        assert [s["text"] for s in found] == texts[r["text"]], r["text"]
        assert all(r["text"][s["start"] : s["end"]] == s["text"] for s in found)


def test_decontamination(spark, small):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()] + [(900, "Short item"), (901, None), (902, "--"), (903, "a")]
    docs = small + [(10_000 + i, t) for i, t in enumerate([*ODD, "a SHORT-item, and a short item", "short", "shorter item"])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contamination(docs, items))
    for block in (1 << 20, 4_000):
        out = decontamination.contamination(d, b, block_bytes=block).collect()
        got = sorted((r["doc_id"], r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), len(r["items"]), decontamination.items_sha256(r["items"]), bool(r["hits"])) for r in out)
        assert got == want
        for r in out:
            for h, s in zip(r["hits"], r["spans"], strict=True):
                assert brute.words(r["text"][s["start"] : s["end"]]) == brute.words(r["text"])[h["start"] : h["end"]]
    assert decontamination.contamination(d, b.limit(0)).filter(F.size("hits") > 0).count() == 0


def test_line_dedup(spark, tmp_path, small):
    docs = small + [(5_000 + i, t) for i, t in enumerate(ODD * 2 + [f" Common  Line\t\nown {i}\ncommon  line" for i in range(12)])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    d.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted(brute.frequent_lines(docs))
    assert rows(queries.op9_line_dedup(spark, str(tmp_path)), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    joined = line_dedup.drop_frequent_lines(d.withColumn("kept", F.lit(1)).withColumn("k1", F.lit(1)), broadcast_keys=-1)
    assert rows(joined.withColumn("s", F.sha2("kept", 256)), "doc_id", "n_lines", "n_dropped", "s") == want
    assert line_dedup.drop_frequent_lines(d.limit(0)).count() == 0


def test_decontamination_query(spark, tmp_path, small):
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()] + [(9, "Short item"), (10, None), (100, "a b")]
    texts = [t for _, t in small] + [*ODD, "a SHORT-item, and a short item", f"so: {items[0][1]} {items[1][1]}", "b a B"]
    sf = saved(spark, tmp_path, texts)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = rows(queries.op4_decontamination(spark, sf), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(brute.contamination(list(enumerate(texts)), items))
    assert sum(r[3] > 1 for r in got) >= 1


@pytest.mark.parametrize("source", ["one file", "several files", "a union"])
def test_line_dedup_goes_through_the_runs(spark, tmp_path, monkeypatch, small, source):
    made, joined = [], []

    class Runs(line_dedup.LineRuns):
        def add(self, counts):
            before = self.rows().filter("new").count()
            super().add(counts)
            made.append([len(x) for x in self.levels])
            joined.append((before, counts.count(), self.rows().filter("new").count()))

        def counts(self, least=1):
            every = self.rows().filter("new")
            assert every.count() == every.select("k1", "k2").distinct().count()  # new in one run only
            return super().counts(least).filter(F.lit(not bypass))

    monkeypatch.setattr(line_dedup, "LineRuns", Runs)
    docs = small + [(5_000 + i, t) for i, t in enumerate([*ODD, *(f"Common line\nown {i}" for i in range(12))])]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    path = f"{tmp_path}/a b%20"
    if source == "a union":
        d.filter("doc_id % 2 = 0").write.parquet(f"{path}/documents.parquet")
        d.filter("doc_id % 2 = 1").write.mode("append").parquet(f"{path}/documents.parquet")
    else:
        d.repartition(1 if source == "one file" else 7).write.parquet(f"{path}/documents.parquet")
    bypass = False
    out = queries.op9_line_dedup(spark, path)
    assert rows(out, "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(brute.frequent_lines(docs))
    assert made == [[1], [2], [0, 1], [1, 1]]
    assert all(new < old + n for old, n, new in joined[1:]) and all(new > old for old, _, new in joined)
    bypass = True  # without what the runs say, nothing is dropped
    assert queries.op9_line_dedup(spark, path).agg(F.sum("n_dropped")).first()[0] == 0


def test_line_runs_compact_and_find_new_lines(spark):
    counts = lambda texts: line_dedup.batch_counts(spark.createDataFrame([(t,) for t in texts], "text string"), batches=1).drop("batch")
    runs = line_dedup.LineRuns(spark, fanout=2)
    for texts in (["a\nb", "b"], ["b\nc"], ["A"], ["d"]):
        runs.add(counts(texts))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert sorted(r["n"] for r in runs.counts().collect()) == [1, 1, 2, 3] and runs.rows().filter("not new").count() == 0
    assert runs.unseen(counts(["a\nz", "z"])).collect()[0]["n"] == 2


def test_sharding(spark, tmp_path, small):
    for texts in ([t for _, t in small] + ODD, ["x" * 900] * 3_000 + [None] * 50, []):
        got = queries.op10_sharding(spark, saved(spark, tmp_path, texts)).collect()
        assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
        by = {}
        for r in got:
            t = texts[r["doc_id"]] or ""
            assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 16, zlib.crc32(t.encode()))
            by.setdefault(r["shard"], []).append(r)
        for own in by.values():
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
        sums = [sum(r["size"] for r in by.get(k, [])) for k in range(40)]
        if texts:
            assert set(by) <= set(range(40)) and max(sums) - min(sums) <= max(r["size"] for r in got)


def test_shard_goes_on_from_a_kept_map(spark, tmp_path):
    docs, path = frame(spark, ["y" * (i % 97) for i in range(4_000)]), f"{tmp_path}/map"
    where = lambda out: {r["doc_id"]: r["shard"] for r in out.collect()}
    assert sharding.stored_map(spark, path) is None
    before = where(sharding.shard(docs, 8, 512, path))
    after = where(sharding.shard(docs, 9, 512, path))
    moved = [i for i in after if before[i] != after[i]]
    assert len(after) == 4_000 and 1 / 9 * 0.9 < len(moved) / 4_000 < 1 / 9 * 1.5
    heavy = docs.withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.repeat(F.lit("z"), 900)).otherwise(F.col("text")))
    out, kept = sharding.placed(heavy, 9, 512, path=path)
    again = where(out)
    sums = [r["n"] for r in out.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert max(sums) - min(sums) < 0.02 * sum(sums) and sum(after[i] != again[i] for i in again) < 2_000
    assert sharding.stored_map(spark, path).select("version").distinct().collect()[0][0] == 4 and len(sharding.folders(spark, path)) == 3
    assert {r["version"] for r in kept.select("version").collect()} == {4}
    with pytest.raises(ValueError):
        sharding.placed(docs, 9, 1024, kept)


def test_shard_map_edits_move_little(spark):
    rows_ = sharding.sized(frame(spark, ["y" * (i % 97) for i in range(4_000)]), 512)
    stats = sharding.slot_stats(rows_, 512)
    one = sharding.rebalanced(stats, sharding.first_map(stats, 8), 8)
    two = sharding.rebalanced(stats, one.select("vslot", "shard", "version"), 9)
    assert {r["version"] for r in two.select("version").collect()} == {3}
    moved = two.join(stats, "vslot").agg(F.sum(F.when(F.col("moved_from").isNotNull(), F.col("n_bytes"))) / F.sum("n_bytes")).first()[0]
    assert 1 / 9 * 0.9 < moved < 1 / 9 * 1.5


def test_differencing_is_near_equal_and_counts_rise():
    rng = random.Random(3)
    sizes = [rng.randint(1, 900) for _ in range(300)]
    sums = [sum(sizes[i] for i in w) for w in packing.differenced(sizes, 40)]
    assert max(sums) - min(sums) < 60
    assert sorted(i for w in packing.differenced(sizes, 40) for i in w) == list(range(300))
    for cut in (True, False):
        windows = packing.windows_of([1500, 1500, 1500], 2048, cut)
        assert len(windows) == 3
    assert len(packing.windows_of([1024] * 4 + [1], 2048, False)) == 3
    assert packing.windows_of([], 2048) == []
    assert packing.pieces_of(700) == [256, 256, 141, 47] and packing.pieces_of(1) == [1] and packing.pieces_of(512) == [256, 256]


def test_window_count_rises_when_capacity_is_exceeded(monkeypatch):
    tried, plain = [], packing.differenced
    monkeypatch.setattr(packing, "differenced", lambda sizes, m: tried.append(m) or plain(sizes, m))
    windows = packing.windows_of([1100] * 7, 2048, False)  # 4 windows would do by the sum
    assert tried == [4, 5, 6, 7] and len(windows) == 7
    tried.clear()
    windows = packing.windows_of([1100] * 7, 2048, True)
    assert tried[0] == 4 and len(windows) == tried[-1] and all(sum(n for _, _, n in w) <= 2048 for w in windows)
    monkeypatch.setattr(packing, "differenced", lambda sizes, m: [list(range(len(sizes)))][: m < 9] or plain(sizes, m))
    assert len(packing.windows_of([1100] * 7, 2048, True)) == 9  # whatever differencing gives, no window is over


def test_packing(spark, tmp_path, small):
    tok = SegmentEncoder(vocabulary()).tokenizer
    texts = [t for _, t in small] + ODD
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]
    pieces, seqs = {}, {}
    for r in queries.op2_packing(spark, saved(spark, tmp_path, texts)).collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    gapless = lambda parts: all(a == s for (a, _), s in zip(sorted(parts), np.cumsum([0] + [n for _, n in sorted(parts)]), strict=False))
    assert set(pieces) == set(range(len(texts))) and all(gapless(p) and sum(n for _, n in p) == len(ids[d]) for d, p in pieces.items())
    assert all(gapless(s) and sum(n for _, n in s) <= 2048 for s in seqs.values())
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_pads_little(spark):
    p = queries.op2_packing(spark, "/root/testdata/sf0.01")
    tasks = p.select(F.shiftright("sequence_id", 32)).distinct().count()
    used = p.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    padding = used.filter("log2(n) <> floor(log2(n))").agg(F.sum(2048 - F.col("n")), F.count(F.lit(1))).first()
    assert used.filter("n > 2048").count() == 0
    assert padding[0] <= padding[1] * 2 * packing.SLACK + 2 * 2048 * tasks  # the last block of a task may leave two windows


def test_segment_encoder_equals_the_tokenizer():
    e = SegmentEncoder(vocabulary(), memo=500)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aZéñ中'’s.,!-_ \n  \t0½ \x1c ") for _ in range(rng.randint(0, 40))) for _ in range(3_000)]
    texts += [" ".join("".join(rng.choice("abé.,'_9") for _ in range(rng.randint(1, 6))) for _ in range(30)) for _ in range(500)]
    flat, ends = e.encode(pa.array(texts))
    for t, a, b in zip(texts, [0, *ends[:-1]], ends, strict=True):
        assert flat[a:b].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_token_counts_follow_edits(spark, small):
    tok = SegmentEncoder(vocabulary()).tokenizer
    rng = random.Random(11)
    texts = [t for _, t in small][:80] + ODD
    edits = []
    for t in texts:
        cuts = sorted(rng.sample(range(len(t or "") + 1), min(len(t or "") // 40 * 2, 8)))
        edits.append([(a, b, rng.choice(["", " ", "x", " y z\n", "\n\n"])) for a, b in zip(cuts[::2], cuts[1::2], strict=True)])
    schema = "doc_id long, text string, tree string, edits array<struct<start:int,end:int,replacement:string>>"
    df = spark.createDataFrame([(i, t, "clash", e) for i, (t, e) in enumerate(zip(texts, edits, strict=True))], schema)
    counted = token_counts.count(df)
    for r in counted.collect():
        assert r["n_tokens"] == len(tok.encode(r["text"] or "", add_special_tokens=False).ids) and sum(r["leaf_chars"]) == len(r["text"] or "")
    for r in token_counts.recount(counted).collect():
        new = texts[r["doc_id"]] or ""
        for a, b, x in reversed(edits[r["doc_id"]]):
            new = new[:a] + x + new[b:]
        assert (r["text"] or "") == new and r["n_tokens"] == len(tok.encode(new, add_special_tokens=False).ids), r["doc_id"]
        n, t = (len(r["tree"]) + 1) // 2, r["tree"]
        assert all(t[k] == t[2 * k + 1] + t[2 * k + 2] for k in range(n - 1)) and sum(r["leaf_chars"]) == len(new)
    assert token_counts.recount(token_counts.count(df.limit(0))).count() == 0


def test_token_query_equals_the_tokenizer(spark, tmp_path, small):
    tok = SegmentEncoder(vocabulary()).tokenizer
    mixed = ["Dear a.b@c.de,\n\n\tsee  x_y@z.org now. " * 60, " lead and trail a@b.cc  ", "中文，a@b.cn。字" * 400, "tabs\tand\u00a0blanks " * 300 + "q@r.st"]
    texts = [t for _, t in small] + [t for t in ODD if t is None or len(t) < 5_000] + mixed
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    for r in queries.op5_token_counts(spark, saved(spark, tmp_path, texts)).collect():
        text, out = texts[r["doc_id"]] or "", texts[r["doc_id"]] or ""
        emails = [(a, b) for k, a, b in brute.pii(text) if k == "email"]
        for a, b in reversed(emails):
            out = out[:a] + "[email]" + out[b:]
        assert (r["n_tokens_before"], r["n_tokens"], r["n_edits"]) == (n(text), n(out), len(emails)), text[:80]
        assert r["n_reencoded_chars"] <= len(emails) * 3_000


def test_leaves_are_cut_in_any_text_and_anew_when_they_grow():
    encode = SegmentEncoder(vocabulary())
    rng = random.Random(3)
    text = "".join(rng.choice(["word", " ", "\n\n", "\t", "  ", "it's", ".", "é", "中", "7", "\u00a0", "...", "_"]) for _ in range(6_000))
    cut = token_counts.leaves_of(text, 64)
    assert "".join(cut) == text and len(cut) > 100
    assert sum(len(encode.tokenizer.encode(x, add_special_tokens=False).ids) for x in cut) == len(encode.tokenizer.encode(text, add_special_tokens=False).ids)
    (chars, counts), spent = token_counts.build(encode, pa.array([text]), 64)[0], []
    tree = token_counts.tree_of(counts)
    for i in range(40):  # one place grows; other leaves stay as they are
        edit = {"start": 1_000, "end": 1_000 + i % 3, "replacement": "some more words, and more. " * 10}
        text, chars, tree, used = token_counts.edited(encode, text, chars, tree, [edit], 64)
        spent.append(used)
        assert tree[0] == len(encode.tokenizer.encode(text, add_special_tokens=False).ids) and chars.sum() == len(text)
    assert max(spent[10:]) <= max(spent[:10]) + 64 and chars.max() < 1_000


def test_edits_that_do_not_fit_change_nothing(spark):
    bad = [[(2, 1, "x")], [(0, 3, "x"), (2, 4, "y")], [(0, 99, "x")], [(-1, 2, "x")], [(3, 4, "a"), (0, 1, "b")], [(None, 1, "x")], [None]]
    rows_ = [(i, "some text", e) for i, e in enumerate([*bad, [(0, 4, None)], None, []])]
    df = spark.createDataFrame(rows_, "doc_id long, text string, edits array<struct<start:int,end:int,replacement:string>>")
    got = {r["doc_id"]: (r["text"], r["n_edits"]) for r in token_counts.recount(token_counts.count(df)).collect()}
    assert got == {i: ("some text", None) for i in range(len(bad))} | {7: (" text", 1), 8: ("some text", 0), 9: ("some text", 0)}


def test_exact_topk(spark):
    rng = np.random.default_rng(1)
    x = [[float(v) for v in row] for row in rng.normal(size=(700, 12)).round(2)] + [[0.5] * 12] * 300
    x += [None, [None] * 12, [float("nan")] * 12, [float("inf")] * 12, [], [1.0, 2.0]]
    data = [(i, v) for i, v in enumerate(x)] + [(None, [1.0] * 12), (5, x[5])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    v = knn.integer_vectors(df)
    ok = {i: np.array([int(np.floor(1024 * float(np.float32(c)))) for c in e] + [0] * (12 - len(e)), dtype=object) for i, e in data if i is not None and e is not None and all(c is not None and np.isfinite(c) for c in e)}
    want = []
    for q in (i for i in ok if i % 50 == 0):
        best = sorted((-int(ok[q] @ y), i) for i, y in ok.items() if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    for blocks in ((4096, 1024), (64, 3)):
        got = knn.top_k(v, v.filter("vec_id % 50 = 0"), 10, 16, *blocks)
        assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want)
    assert knn.top_k(v.limit(0), v.limit(0)).count() == 0
    assert len(rows(knn.top_k(v.filter("vec_id < 4"), v.filter("vec_id < 1")), "rank")) == 3
    big = knn.integer_vectors(spark.createDataFrame([(0, [3e4, 1.0]), (1, [3e4, 2.0]), (2, [3e9, 1e9])], "vec_id long, embedding array<double>"))
    assert {r["vec_id"]: r["score"] for r in knn.top_k(big, big.filter("vec_id = 0")).collect()}[1] == 1024**2 * (9 * 10**8 + 2)


def test_topk_prunes_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24)) * 800
    x = (centres[rng.integers(0, 40, 4_000)] + rng.normal(size=(4_000, 24)) * 40).round()
    x[1_000:1_300] = x[0]  # copies
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, v array<double>")
    report = {}
    got = rows(knn.top_k(v, v.filter("vec_id % 100 = 0"), report=report), "query_id", "rank", "vec_id", "score")
    want = []
    for q in range(0, 4_000, 100):
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(4_000), -s)) if i != q][:10]
        want += [(q, n + 1, int(i), int(s[i])) for n, i in enumerate(best)]
    assert got == sorted(want)
    assert report["groups"] > 30 and report["kept"] < 0.2 * report["pairs"]


def test_topk_bounds_hold():
    rng = np.random.default_rng(5)
    for scale in (0.05, 1.0, 30.0):
        p, x, q = rng.normal(size=9), rng.normal(size=(300, 9)) * scale + 1, rng.normal(size=(200, 9))
        p /= np.linalg.norm(p)
        a, n = knn._angles(x, knn._norms(x), p[None])[:, 0], knn._norms(x)
        b, m = knn._angles(q, knn._norms(q), p[None])[:, 0], knn._norms(q)
        s = q @ x.T
        assert (s.max(1) <= knn.upper(m, b, a.min(), a.max(), n.min(), n.max())).all()
        assert (s.min(1) >= knn.lower(m, b, a.max(), n.min(), n.max())).all()


def test_topk_ranks_what_is_beyond_64_bits(spark):
    data = [(0, [3e9, 4e9]), (1, [3e9, 4e9 + 1]), (2, [3e9, 4e9 + 2]), (3, [-3e9, -4e9]), (4, [-3e9, -4e9 - 1]), (5, [1e200, 0.0]), (6, [1.0, 1.0])]
    v = spark.createDataFrame([(i, [x * 1024 for x in r]) for i, r in data], "vec_id long, v array<double>")
    got = rows(knn.top_k(v, v.filter("vec_id = 0")), "rank", "vec_id", "score")
    assert [i for _, i, _ in got] == [5, 2, 1, 6, 3, 4] and got[0][2] == got[1][2] == knn.LONG and got[-1][2] == -knn.LONG


def test_topk_of_an_id_in_several_groups(spark):
    data = [(0, [float(100 + 10 * i), 0.0]) for i in range(5)] + [(i, [float(90 - i), 0.0]) for i in range(1, 5)]
    v = spark.createDataFrame(data, "vec_id long, v array<double>")
    got = knn.top_k(v, v.filter("vec_id = 0 and v[0] = 100"), 2, 16)
    assert rows(got, "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 8900), (0, 2, 2, 8800)]


def test_language_id(spark, small):
    docs = table(spark, SF, "documents")
    model = language_id.train(docs.filter("doc_id % 2 = 0"))
    out = language_id.predict(docs.withColumn("score", F.lit("clash")), model).filter("doc_id % 2 = 1").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    odd = language_id.predict(frame(spark, ODD), model).collect()
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in odd)
    none = language_id.train(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_language_query_equals_naive_bayes(spark, tmp_path, small):
    langs = ["en", "de", "fr", None, "es", "en"]
    own = [(i, t, langs[i % 6]) for i, (_, t) in enumerate([*small[:60], *((0, t) for t in ODD if t is None or len(t) < 1_000)])]
    spark.createDataFrame(own, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    want = list(brute.languages([(t, x) for i, t, x in own if not held(i) and t is not None and x is not None], [t for _, t, _ in own]))
    got = {r["doc_id"]: r for r in queries.op8_language_id(spark, str(tmp_path)).collect()}
    for (i, t, _), (label, score) in zip(own, want, strict=True):
        assert (got[i]["held_out"], got[i]["lang_pred"]) == (held(i), label), t
        assert abs(got[i]["score"] - score) < 1e-6
    docs = table(spark, str(tmp_path), "documents").drop("score")
    one, many = (language_id.predict(docs, language_id.train(docs, block=b)) for b in (256, 1))
    near = lambda df: [(r["doc_id"], r["lang_pred"], round(r["score"], 9), r["fit"] and round(r["fit"], 9)) for r in df.orderBy("doc_id").collect()]
    assert near(one) == near(many)


def test_more_labels_than_a_block_holds(spark):
    words = [f"w{i:04d}x{i * 7919 % 1000:03d}" for i in range(600)]
    docs = spark.createDataFrame([(i, f"{w} {w} {w}", f"l{i:04d}") for i, w in enumerate(words)], "doc_id long, text string, lang string")
    out = language_id.predict(docs, language_id.train(docs)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) > 590


def test_a_long_text_is_summed_up_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    w = np.vstack([rng.normal(size=(language_id.BUCKETS, 3)), np.zeros(3)])
    texts = ["", "short one", "long " * 300, "é中", "x" * 501]
    want = language_id.log_likelihoods(w, texts)
    monkeypatch.setattr(language_id, "CELLS", 21)
    for a, b in zip(language_id.log_likelihoods(w, texts), want, strict=True):
        assert np.allclose(a, b)
    assert want[1].tolist() == [len(list(brute.gram_buckets(t))) for t in texts]
