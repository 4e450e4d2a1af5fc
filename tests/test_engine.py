"""Operators against small cases, with the traps of moving text rules to Spark."""

import base64
import datetime as dt
import hashlib
import json
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from textkiln.functions.text import fingerprint, is_blank, java_pattern, java_replacement, stripped
from textkiln.operators import codec, density, facts, ledger, lines, savings
from textkiln.plans import catalogue, runs, surface
from textkiln.sources import captures, profiles, store
from textkiln.streaming.ledger import stateful_ledger

S = lines.Stage


def value(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("o")).first()["o"]


def program(spark, text, *stages):
    return value(spark, text, lambda t: lines.run(t, stages))


def test_stages(spark):
    assert program(spark, "\x1b[1;32mok\x1b[0m 12\x1b[K tests", S("strip_ansi")) == "ok 12 tests"
    assert program(spark, "mem 3\ncpu 7\nmem 5", S("regex_drop", pattern="^cpu")) == "mem 3\nmem 5"
    out = program(spark, "a\nE1\nb\nc\nd\nE2\ne", S("smart_truncate", max_lines=4, priority_lines="^E")).split("\n")
    assert out[:4] == ["a", "E1", "E2", "e"] and out[4].startswith("... [Truncated.") and len(out) == 5
    assert len(program(spark, "p1\np2\np3", S("smart_truncate", max_lines=2, priority_lines="p")).split("\n")) == 3
    assert program(spark, "p1\np2\np3", S("smart_truncate", max_lines=2, head_ratio=1.0, priority_lines="p")).startswith("p1\np2\n...")
    assert program(spark, "a\nb\nc\nd", S("head_tail", max_lines=2, head_ratio=0.0)).startswith("c\nd\n")
    assert program(spark, "a\nb\nc\nd", S("head_tail", max_lines=2, head_ratio=1.0)).startswith("a\nb\n")
    assert program(spark, " \n", S("on_empty", fallback="f")) == " \n" and program(spark, " ", S("on_empty", fallback="f")) == "f"
    assert program(spark, "x", S("regex_drop", pattern="x"), S("on_empty")) == lines.EMPTY_OUTPUT
    assert program(spark, "", S("on_empty", fallback="f")) == "" and program(spark, None, S("strip_ansi")) is None
    assert program(spark, "test", S("regex_replace", pattern="[invalid"), S("nonsense"), S("regex_drop", enabled=False, pattern=".")) == "test"
    assert program(spark, "b\na\nb\n\n", S("line_dedup")) == "b\na\n"
    assert program(spark, "a1$", S("regex_replace", pattern=r"(?P<l>[a-z])(\d)", replacement=r"\g<l>-\2$")) == "a-1$$"
    with pytest.raises(ValueError):
        S("head_tail", max_lines=0)


def test_patterns_mean_what_python_means(spark):
    assert java_pattern("[") is None and java_pattern("") is None and java_replacement(r"$\1") == r"\$$1"
    assert program(spark, "abc\r", S("regex_keep", pattern="abc$"), S("on_empty", fallback="none")) == "none"
    assert program(spark, "é x", S("regex_keep", pattern=r"^\w\s\w$")) == "é x"
    for blank in ("", " ", "\t", " ", "　", "\x1c"):
        assert value(spark, blank, is_blank) is True
    assert value(spark, "a😀é", fingerprint).startswith("sha256:3:") and value(spark, "", fingerprint).count(":") == 1


def test_profiles(spark, tmp_path):
    clean = "On branch topic/x\nnothing to commit (use -u)\n"
    at = lambda command, text, user=None: value(spark, text, lambda t: profiles.apply(F.lit(command), t, user))
    assert at("git status", clean) == "[git status: clean]"
    build = at("cargo build --release", "Updating index\n  Compiling serde\nwarning: field is never read\nFinished in 3 s\nerror[E0308]: types")
    assert build == "warning: field is never read\nerror[E0308]: types"
    assert value(spark, "treefoo", profiles.resolve) == "tree" and value(spark, "make", profiles.resolve) is None
    file, store = tmp_path / "p.toml", profiles.TrustStore(str(tmp_path / "trust.json"))
    file.write_text('[filter.mine]\ncommand = "make"\nstages = [{name = "regex_drop", pattern = "noise"}]\n')
    with pytest.raises(ValueError, match="NOT trusted"):
        profiles.load_toml(str(file), store)
    store.trust(str(file))
    user = profiles.load_toml(str(file), store)
    assert at("make all", "noise\nx", user) == "x" and profiles.load_toml(str(tmp_path / "none.toml"), store) == {}
    file.write_text("[")
    store.trust(str(file))
    with pytest.raises(ValueError, match="Failed to parse"):
        profiles.load_toml(str(file), store)


def test_scores(spark):
    cases = {" ": 0.0, "DEF x": 1.0, "# x": 0.05, "50% |": 0.05, "x" * 60: 0.3 + 0.6, " " + "x" * 50: 0.3 + 0.5 + 0.1, "class\té": 1.0, "import\x1cx": 1.0, "x" * 200: 1.0}
    for line, want in cases.items():
        assert value(spark, line, density.score) == want, line
    log = "\n".join([f"step {i} of 31" for i in range(31)] + ["build FAILED at step 31"])
    short = value(spark, log, lambda t: density.collapse(t, 0.3)).split("\n")
    assert short[-1] == "build FAILED at step 31" and len(short) < 20 and any(x.endswith(" lines dropped] ...") for x in short)
    assert value(spark, "\n".join("abcde"), density.collapse) == "\n".join("abcde")
    assert value(spark, "\n".join(["x"] * 11), density.drop_indices) == [5, 6, 7, 8, 9, 10]
    both = spark.createDataFrame([(1, log), (2, "a\nb"), (3, None)], "id long, text string")
    far = {(r["id"], r["line_no"]) for r in density.scored_lines(both, "id").filter("not kept").collect()}
    near = {(r["id"], i) for r in both.select("id", density.drop_indices(F.col("text")).alias("d")).collect() for i in r["d"] or ()}
    assert far == near


def test_hints_lose_no_line(spark):
    rng = random.Random(3)
    words = ["ERROR", "error[", "Fa\u0131led", "pan\u0130c", "cla\u017f\u017f x", "\u212aeep", "def f", "from\u00a0x", "import\x1cy", "- a", " * b", "*c", "Compiling q", "Finished dev", "Running 3 test", "Downloading", "  Unblocking", "50%  |", "\u2593", "= = =", "x", " ", "\u3000", "Exception"]
    texts = ["".join(rng.choice([*words, " ", "\u00e9"]) for _ in range(rng.randint(0, 4))) for _ in range(1_500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    both = df.select("t", (density._kept_by_pattern(t) == t.rlike(density._KEEP)).alias("k"), (density._noise(t) == t.rlike(density._DROP)).alias("d"), stripped(t).alias("s"))
    for r in both.collect():
        assert r["k"] and r["d"] and r["s"] == r["t"].strip(), ascii(r["t"])


def test_long_documents_cost_in_proportion_to_their_lines(spark):
    seconds = {}
    stages = [S("smart_truncate", max_lines=60, priority_lines="FAILED"), S("smart_truncate", max_lines=50, priority_lines="PASSED"), S("head_tail", max_lines=40)]
    for n in (1_000, 50_000, 1_000, 5_000, 50_000):
        text = "\n".join(f"suite_{i % 97}::case_{i} " + ("FAILED" if i % 1000 == 7 else "PASSED") + f" in {i * 7 % 1000} ms" for i in range(n))
        df = spark.createDataFrame([(text,)], "t string").select("t", density.drop_indices(F.col("t")).alias("d"))
        began = time.time()
        c = codec.compress(df, "t", "d", "c")
        back = codec.expand(c, "c", codec.store(c), "e")
        row = back.select((F.col("e") == text).alias("same"), lines.run(F.col("t"), stages).alias("cut"), density.collapse(F.col("t")).alias("x"), profiles.apply(F.lit("pytest -q"), F.col("t")).alias("p")).first()
        seconds[n] = time.time() - began
        assert row["same"] and len(row["cut"].split("\n")) == 41 and len(row["p"].split("\n")) == n // 1_000
    assert seconds[50_000] < 20 * seconds[5_000] + 5 and seconds[50_000] < 30


def test_plans_grow_by_a_constant_a_stage(spark):
    df = spark.createDataFrame([("a",)], "t string")
    plan = lambda n: len(df.select(lines.run(F.col("t"), [S("smart_truncate", priority_lines="x")] * n))._jdf.queryExecution().optimizedPlan().toString())
    one, four, seven = plan(1), plan(4), plan(7)
    assert seven - four < 1.3 * (four - one)


def test_stored_tokens_are_what_zlib_makes_of_the_dropped_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", density.drop_indices(F.col("text")).alias("drops"))
    want = {}
    for r in docs.collect():
        own = r["text"].split("\n")
        raw = json.dumps({"indices": r["drops"], "lines": [own[i] for i in r["drops"]]}, separators=(",", ":"), ensure_ascii=False).encode()
        token = base64.urlsafe_b64encode(zlib.compress(raw, 9)).decode().rstrip("=")
        if r["drops"] and len(token) > 200:
            want[hashlib.sha256(token.encode()).hexdigest()] = token
    refs = catalogue.queries()["external_store_refs"](spark, "/root/testdata/sf0.001")
    assert want and {r["ref_id"]: r["token"] for r in refs.collect()} == want


def test_codec(spark):
    cases = [("\n".join(f"line {i} é" * (i % 3) for i in range(n)), d) for n in (1, 4, 5, 9) for d in ([], [0], [1, 3], [0, 2, 4], [9, 0, 0])]
    cases += [("\n".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(20)), list(range(2, 8))), ("[...2 lines compressed: irc:abc...]\nb", [1]), (None, [1]), ("a", None)]
    df = spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(cases)], "id int, text string, drops array<int>")
    c = codec.compress(df, "text", "drops")
    out = {r["id"]: r["expanded"] for r in codec.expand(c, "compressed", codec.store(c)).collect()}
    assert out == {i: t for i, (t, _) in enumerate(cases)}
    assert codec.store(c).count() >= 1
    plain = spark.createDataFrame([("no mark",), ("[...1 lines compressed: irc:zz...]",)], "compressed string")
    assert [r["expanded"] == r["compressed"] for r in codec.expand(plain).collect()] == [True, True]


def ledger_rows():
    t0, week = dt.datetime(2024, 1, 1), 604_800
    uses = [("s", 0, "a"), ("s", 1, "b"), ("s", week - 1, "a"), ("s", 2 * week - 1, "a"), ("s", 2 * week, ""), ("s", 2 * week + 1, ""), ("u", 2 * week + 2, "a")]
    return [(i, s, t0 + dt.timedelta(seconds=x), t) for i, (s, x, t) in enumerate(uses)]


def test_ledger(spark):
    df = spark.createDataFrame(ledger_rows(), "run_id long, session_id string, ts timestamp, raw_output string")
    out = {r["run_id"]: (r["turn"], r["first_turn"], r["deduped"]) for r in ledger.ledger(df, order=["ts", "run_id"]).collect()}
    assert out == {0: (1, 1, False), 1: (2, 2, False), 2: (3, 1, True), 3: (4, 4, False), 4: (5, 5, False), 5: (6, 5, True), 6: (1, 1, False)}
    odd = [(1, "s", None, "a"), (2, "s", None, "a"), (3, "s", dt.datetime(2024, 1, 1), None), (4, "s", dt.datetime(2024, 1, 1), None), (5, None, dt.datetime(2024, 1, 1), "")]
    for most in (10, 1):
        got = ledger.ledger(spark.createDataFrame(odd, "run_id long, session_id string, ts timestamp, raw_output string"), order=["run_id"], most=most)
        assert {r["run_id"]: r["first_turn"] for r in got.collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 1}
    assert ledger.ledger(df.limit(0), order=["ts"]).count() == 0


def sequential(uses, ttl, most):
    """The ledger run by run: uses are (run_id, session, seconds, fingerprint)."""
    out, state = {}, {}
    for run_id, session, now, fp in uses:
        turn, known = state.get(session, (0, {}))
        turn, known = turn + 1, {k: v for k, v in known.items() if now - v[1] < ttl}
        first = known[fp][0] if fp in known else turn
        known[fp] = (first, now)
        known = dict(sorted(known.items(), key=lambda x: -x[1][1])[:most])
        state[session] = (turn, known)
        out[run_id] = (turn, first, turn > first)
    return out


def test_entries_make_room_and_are_kept_between_calls(spark, tmp_path):
    rng = random.Random(6)
    uses, now = [], {"s": 0, "t": 0, "few": 0}
    for i in range(600):
        s = rng.choice(["s", "s", "t"]) if i % 100 else "few"
        now[s] += rng.choice([1, 2, 30, 99, 100, 101])
        uses.append((i, s, now[s], f"f{int(rng.paretovariate(0.6)) % 40}"))
    t0 = dt.datetime(2024, 1, 1)
    frame = lambda part: spark.createDataFrame([(i, s, t0 + dt.timedelta(seconds=x), f) for i, s, x, f in part], "run_id long, session_id string, ts timestamp, fingerprint string")
    told = lambda df: {r["run_id"]: (r["turn"], r["first_turn"], r["deduped"]) for r in df.collect()}
    for ttl, most in ((100, 12), (10_000, 7), (100, 1_000), (10_000, 1)):
        want = sequential(uses, ttl, most)
        assert told(ledger.ledger(frame(uses), text=None, order=["run_id"], ttl=ttl, most=most)) == want
        got, path = {}, f"{tmp_path}/{ttl}-{most}"
        for at in (0, 150, 151, 400):
            part = [u for u in uses if at <= u[0] < {0: 150, 150: 151, 151: 400, 400: 600}[at]]
            kept = store.load_entries(spark, path)
            out = ledger.ledger(frame(part), text=None, order=["run_id"], ttl=ttl, most=most, entries=kept)
            got |= told(out)
            store.save(ledger.entries_after(out, entries=kept, ttl=ttl, most=most), path)
        assert got == want, (ttl, most)
    assert len(store.versions(spark, path)) == 2


def test_legacy_entries(spark):
    files = [("s", '{"turn": 7, "fingerprints": {"a": 3, "b": {"turn": 4, "timestamp": 1704067200.5}, "c": {"turn": 1, "timestamp": 0}}}'), ("t", "broken")]
    got = ledger.legacy_entries(spark.createDataFrame(files, "session_id string, value string"), "2024-01-02 00:00:00").collect()
    assert sorted((r["session_id"], r["fingerprint"], r["first_turn"], r["turn"], r["last_use"].day) for r in got) == [("s", "a", 3, 7, 2), ("s", "b", 4, 7, 1)]
    again = spark.createDataFrame([("s", dt.datetime(2024, 1, 2, 1), "a"), ("s", dt.datetime(2024, 1, 2, 2), "c")], "session_id string, ts timestamp, fingerprint string")
    kept = ledger.legacy_entries(spark.createDataFrame(files, "session_id string, value string"), "2024-01-02 00:00:00")
    assert [(r["turn"], r["first_turn"]) for r in ledger.ledger(again, text=None, entries=kept).orderBy("turn").collect()] == [(8, 3), (9, 9)]


def test_workspace(spark, tmp_path):
    w, t = surface.Workspace(spark, f"{tmp_path}/w"), dt.datetime(2024, 1, 30)
    text = "\n".join(f"value {hashlib.sha256(bytes([i % 256, i // 256])).hexdigest()}" for i in range(200))
    run = lambda hours, *rows: w.run(spark.createDataFrame([("s", t + dt.timedelta(hours=hours), c, x) for c, x in rows], "session_id string, ts timestamp, command string, raw_output string"), order=["command"])
    first = run(0, ("make", text), ("tree", text + "\nend"))
    assert [r["deduped"] for r in first.orderBy("turn").collect()] == [False, False] and first.filter("truncated").count() == 1
    full = w.full_output(first.filter("truncated").select("full_output_path")).first()
    assert full["raw_output"] == text + "\nend"
    assert [r["expanded"] == r["filtered"] for r in w.expand(first).collect()] == [True, True]
    again = run(1, ("make", text))
    assert [(r["turn"], r["first_turn"], r["deduped"]) for r in again.collect()] == [(3, 1, True)]
    assert w.analytics("2024-01-31 00:00:00", "day").first()["runs"] == 3 and "| All | 3 | " in w.analytics("2024-01-31 00:00:00").first()["report"]
    assert w.search("nothing").count() == 0
    w.remember(spark.createDataFrame([(1, "app", "uses", "sql"), (2, "app", "uses", "orm"), (3, "b", None, "orm")], "id long, subject string, predicate string, object string"), "2024-01-01 00:00:00")
    every = w.remember(spark.createDataFrame([("app", "uses", "orm"), ("b", "is", "new")], "subject string, predicate string, object string"), "2024-01-02 00:00:00")
    assert sorted((r["subject"], r["object"], r["valid_until"] is None) for r in every.collect()) == [("app", "orm", True), ("app", "sql", False), ("b", "new", True), ("b", "orm", False)]
    assert [r["line"] for r in w.search("app ORM").collect()] == ["- app uses orm (score: 1.00)"]
    assert [r["line"] for r in w.search("b", "temporal", "2024-01-01 12:00:00").collect()] == ["- b is orm"]
    late = w.run(spark.createDataFrame([("s", t, "x", "o1", "app"), ("s", t, "y", "o2", None), ("s", dt.datetime(2023, 1, 1), "z", "o3", "app")], "session_id string, ts timestamp, command string, raw_output string, current_file string"), order=["command"])
    assert {r["command"]: r["memories_injected"] for r in late.collect()} == {"x": 1, "y": 0, "z": 0}
    assert w.analytics("2024-01-31 00:00:00", "all").first()["memories_used"] == 1
    with pytest.raises(NotImplementedError):
        w.search("x", "semantic")
    assert w.status()["status"] == "healthy"


def test_streaming_ledger_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(ledger_rows(), "run_id long, session_id string, ts timestamp, raw_output string")
    rows = df.withColumn("fingerprint", fingerprint(F.col("raw_output"))).drop("raw_output")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stateful_ledger(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(120)
    got = {(r["run_id"], r["turn"], r["first_turn"], r["deduped"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["run_id"], r["turn"], r["first_turn"], r["deduped"]) for r in ledger.ledger(df, order=["ts", "run_id"]).collect()}
    assert got == want


def test_facts(spark):
    t = dt.datetime(2024, 1, 1)
    saved = [(i, "app.py", "imports", o, t + dt.timedelta(hours=i)) for i, o in enumerate(["os", "os", "os json", "os"])] + [(9, "b.py", "uses", "fastapi", t)]
    h = facts.history(spark.createDataFrame(saved, "id long, subject string, predicate string, object string, valid_from timestamp"), order=["id"])
    assert sorted(r["id"] for r in h.collect()) == [0, 2, 3, 9] and sorted(r["id"] for r in facts.active(h).collect()) == [3, 9]
    probes = spark.createDataFrame([("app.py", t + dt.timedelta(hours=2)), ("app.py", t + dt.timedelta(hours=1))], "subject string, at timestamp")
    assert sorted((r["at"].hour, r["id"]) for r in facts.as_of(h, probes).collect()) == [(1, 0), (2, 2)]
    assert [r["id"] for r in facts.keyword_search(h, "FastAPI nothing").collect()] == [9] and facts.keyword_search(h, " ").count() == 0
    line = facts.keyword_search(h, "fastapi x").select(facts.rendered(True).alias("x")).first()["x"]
    assert line == "- b.py uses fastapi (score: 0.50)"
    assert facts.remembered(spark.createDataFrame([(None, "x")], "subject string, other string")).select("subject", "kind").first() == ("unknown", "fact")


def test_savings(spark):
    t = dt.datetime(2024, 1, 30)
    log = spark.createDataFrame([(t, 5000, 500, 1), (t, 1000, 100, 0), (t - dt.timedelta(days=300), 0, 7, 0)], "timestamp timestamp_ntz, raw_tokens long, output_tokens long, memories_used long")
    by = {r["period"]: r for r in savings.report(log, "2024-01-31 00:00:00").collect()}
    assert (by["week"]["runs"], by["week"]["saved_tokens"], by["week"]["reduction_pct"]) == (2, 5400, 90.0) and by["all"]["runs"] == 3
    none = savings.report(log.limit(0), "2024-01-31 00:00:00").collect()
    assert all(r["runs"] == 0 and r["reduction_pct"] == 0 for r in none)
    report = savings.markdown(savings.report(log, "2024-01-31 00:00:00")).first()["report"].split("\n")
    assert report[0].startswith("# ") and report[4:6] == ["| Day | 2 | 6,000 | 600 | 5,400 | 90.0% | 1 |", "| Week | 2 | 6,000 | 600 | 5,400 | 90.0% | 1 |"] and report[-1] == ""


def test_captures_and_responses(spark):
    assert value(spark, "é" * 10, lambda t: captures.capped(t, 15)) == "é" * 10 + captures.CAP_NOTICE
    assert value(spark, "timeout", lambda k: captures.exit_code(k, F.lit(0))) == -1 and value(spark, "ok", lambda k: captures.exit_code(k, F.lit(3))) == 3
    assert value(spark, "out", lambda t: captures.with_error(t, F.lit("bad"))) == "out\nbad"
    text = "\n".join(f"value {i}" for i in range(200))
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "s", t, "tree", text), (2, "s", t + dt.timedelta(1), "tree", text), (3, "s", t, "git status", "On branch x")], "id long, session_id string, ts timestamp, command string, raw_output string")
    out = {r["id"]: r for r in runs.respond(df, order=["ts", "id"]).collect()}
    assert out[1]["truncated"] and out[1]["full_output_path"].startswith("tee:") and not out[2]["truncated"]
    assert out[2]["deduped"] and out[2]["output"].startswith("[Output identical to turn #1]") and out[2]["compression_ratio"] == 0.01
    assert out[3]["output"] == "[git status: clean]" and runs.tee(runs.respond(df, order=["ts", "id"])).count() == 1
    assert runs.run_log(runs.respond(df, order=["ts", "id"])).count() == 3
