"""The library's forms on tables and folders of the caller's own: index, sources, streams."""

import json
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rillstone.operators.ingest import chunk_markdown
from rillstone.operators.retrieval import Index, contained
from rillstone.sources import files as src
from rillstone.streaming import messages as st

TEXTS = [(1, "The harbour lamps were painted"), (2, "lamps lamps and a rope"), (3, ""), (4, "ScrollView width of the DeckView"), (5, None), (6, "rope of the harbour"), (7, "rope of the harbour")]


def test_search_by_hand(spark):
    index = Index.build(spark.createDataFrame(TEXTS, "id long, text string"))
    docs = {i: Counter(w) for i, w in {1: ["harbour", "lamp", "were", "paint"], 2: ["lamp", "lamp", "rope"], 3: [], 4: ["scroll", "view", "width", "deck", "view"], 5: [], 6: ["rope", "harbour"], 7: ["rope", "harbour"]}.items()}
    mean, n = sum(sum(c.values()) for c in docs.values()) / 7, 7
    assert (index.n, index.mean) == (7, pytest.approx(mean))
    queries = spark.createDataFrame([(1, "rope rope"), (2, "lamp"), (3, "nothing known"), (4, ""), (5, "views")], "query_id long, q string")
    asked = {1: {"rope": 2}, 2: {"lamp": 1}, 5: {"view": 1}}
    expected = {}
    for q, words in asked.items():
        found = []
        for i, c in docs.items():
            s = 0.0
            for w, times in words.items():
                df = sum(w in x for x in docs.values())
                s += times * math.log(1 + (n - df + 0.5) / (df + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) if c[w] else 0
            found += [(-round(s, 6), i)] if s else []
        expected |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(sorted(found)[:2], 1)}
    got = {(r.query_id, r.rank): (r.id, r.score) for r in index.search(queries, 2).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}  # ties to the smaller id
    assert all(got[k][1] == pytest.approx(v[1], abs=2e-6) for k, v in expected.items())
    answers = {r.query_id: (r.id, r.abstain) for r in index.answer(queries, threshold=0.5).collect()}
    assert answers[3] == (None, True) and answers[4] == (None, True) and answers[1][1] is False


def test_index_is_saved_and_loaded(spark, tmp_path):
    index = Index.build(spark.createDataFrame(TEXTS, "id long, text string"))
    index.save(str(tmp_path))
    again = Index.load(spark, str(tmp_path))
    queries = spark.createDataFrame([(1, "rope harbour")], "query_id long, q string")
    assert [tuple(r) for r in again.search(queries).orderBy("rank").collect()] == [tuple(r) for r in index.search(queries).orderBy("rank").collect()]


def test_empty_index_and_queries(spark):
    none = Index.build(spark.createDataFrame([], "id long, text string"))
    queries = spark.createDataFrame([(1, "rope")], "query_id long, q string")
    assert none.search(queries).count() == 0 and none.mean == 0.0
    report = none.evaluate(queries.withColumn("expect", F.lit(None).cast("string"))).report().first()
    assert (report.in_scope, report.hit_1, report.mrr, report.min_top_score, report.passed) == (0, 0.0, 0.0, None, False)


def test_evaluation_with_misses(spark):
    index = Index.build(spark.createDataFrame(TEXTS, "id long, text string"))
    cases = [(1, "lamps", "painted"), (2, "rope", "rope of"), (3, "rope", "never there"), (4, "views", ""), (5, "unheard", None), (6, "unheard", "rope")]
    out = index.evaluate(spark.createDataFrame(cases, "query_id long, q string, expect string"))
    first = {r.query_id: r["first"] for r in out.ranks.collect()}
    assert first == {1: 2, 2: 1, 3: None, 6: None}
    report = out.report().first()
    assert (report.in_scope, report.hit_1, report.hit_3, report.hit_5, report.mrr, report.passed) == (4, 0.25, 0.5, 0.5, 0.375, False)
    misses = {(r.query_id, r["rank"], r.id) for r in out.misses().collect()}
    assert misses == {(3, 1, 6), (3, 2, 7), (3, 3, 2), (6, None, None)}
    assert {r.query_id: r.top_score > 0 for r in out.out_of_scope().collect()} == {4: True, 5: False}


def test_contained_is_contains(spark):
    texts = [(1, "one two three four five six seven eight"), (2, "xone two\nthree four five six sevenx"), (3, None), (4, "")]
    items = [(1, "one two three four five six"), (2, "two\nthree four five six seven"), (3, "five"), (4, "not here at all in any text"), (5, ""), (6, None), (7, "ne two three four five six seve")]
    got = {r.query_id for r in contained(spark.createDataFrame(items, "query_id long, q string"), spark.createDataFrame(texts, "id long, text string")).collect()}
    assert got == {i for i, q in items if q and any(q in (t or "") for _, t in texts)}


def chunked(md, least):
    """The chunker as a loop over lines."""
    out, buf, path, fence, table = [], [], [""] * 4, False, False

    def flush():
        text = "\n".join(buf).strip()
        buf.clear()
        if len(text) >= least:
            out.append((len(out) + 1, " > ".join(h for h in path if h), text))

    for line in md.splitlines():
        bare = line.strip()
        if bare.startswith("```"):
            fence = not fence
            buf.append(line)
        elif fence:
            buf.append(line)
        elif m := re.match(r"^(#{1,4})\s+(.*)", line):
            flush()
            k = len(m[1])
            path[k - 1 :] = [m[2].strip()] + [""] * (4 - k)
            table = False
        else:
            if bare.startswith("|"):
                if not table:
                    flush()
                table = True
                buf.append(line)
                continue
            if table:
                flush()
                table = False
            if line.startswith("- "):
                flush()
                buf.append(line)
            elif bare:
                buf.append(line)
            elif buf and buf[0].startswith("- "):
                buf.append(line)
            else:
                flush()
    flush()
    return out


def test_chunker_against_a_loop(spark, tmp_path):
    import random

    pieces = ["# Top", "## Sub", "### Deep ", "##### five", "- bullet one", "  - nested", "plain words here", "| a | b |", "```", "", "   ", "more text", "-no bullet", "#no heading"]
    rng = random.Random(4)
    docs = {f"d{i:03d}.md": "\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for i in range(60)} | {"w.md": "a line\u2028and another\r\nthird line", "e.md": ""}
    for name, text in docs.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    got = {}
    for r in src.chunks(spark, str(tmp_path), least=8).collect():
        got.setdefault(r.source, []).append((r.n, r.heading, r.text))
    for name, text in docs.items():
        assert sorted(got.get(name, [])) == chunked(text, 8), name


def test_sources(spark, tmp_path):
    (tmp_path / "notes.md").write_text("# Rules\n\n- a rule about harbour lamps that is long enough to stay\n")
    index = src.build_index(spark, str(tmp_path), str(tmp_path / "out"))
    assert index.n == 1 and [r.id for r in src.chunk_index(spark, str(tmp_path / "out/chunks")).collect()] == ["notes.md#1"]
    (tmp_path / "prints").mkdir()
    for name, body in {"a": json.dumps({"app": "Moor", "types": ["A"], "bundle": "com.moor"}), "b": "{broken", "c": json.dumps({"app": "Quay", "types": []})}.items():
        (tmp_path / f"prints/{name}.json").write_text(body)
    assert [r.app for r in src.registry(spark, str(tmp_path / "prints"), exclude="MOOR").collect()] == ["Quay"]
    src.register(src.registry(spark, str(tmp_path / "prints")), str(tmp_path / "reg"))
    src.register(src.registry(spark, str(tmp_path / "prints"), exclude="quay").withColumn("bundle", F.lit("new")), str(tmp_path / "reg"))
    assert {(r.app, r.bundle) for r in spark.read.parquet(str(tmp_path / "reg")).collect()} == {("Moor", "new"), ("Quay", None)}
    (tmp_path / "conf").write_text("# c\nBUILD=3\nBUILD=9\nempty=\n")
    assert src.settings(spark, str(tmp_path / "conf"), {"BUILD": "6", "empty": "x"}) == {"BUILD": "3", "empty": "x"}
    (tmp_path / "cases.json").write_text(json.dumps([{"q": "a", "expect": "x"}, {"q": "b", "expect": ""}, {"q": "c", "expect": None}]))
    assert [r.in_scope for r in src.eval_cases(spark, str(tmp_path / "cases.json")).orderBy("q").collect()] == [True, False, False]
    (tmp_path / "l.tsv").write_text("Moor\tstubs found\n")
    assert tuple(src.lessons(spark, str(tmp_path / "l.tsv")).first()) == ("Moor", "stubs found")


def test_project_folders(spark, tmp_path):
    from rillstone.operators.fingerprint import fingerprints_of

    for path, text in {"Moor/Moor.xcodeproj/project.pbxproj": "PRODUCT_BUNDLE_IDENTIFIER = com.moor.app;", "Moor/Moor/Deck.swift": "struct Deck {\n}", "Moor/README.rst": "no"}.items():
        (tmp_path / "w" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / path).write_text(text)
    (tmp_path / "w/Moor/Moor/Bad.swift").write_bytes(b"struct Fine {\n}\n// \xff\xfe\n")
    files = src.source_files(spark, str(tmp_path / "w"))
    got = fingerprints_of(spark, files).first()
    assert (got.app, got.bundle, got.types, got.files) == ("Moor", "com.moor.app", "Deck, Fine", "Bad.swift, Deck.swift")
    root = f"{tmp_path}/w/Moor"
    starts = spark.createDataFrame([(root,), (f"{root}/Moor",), (f"{tmp_path}/w",)], "path string")
    assert {r.path: r.root for r in src.project_root(files, starts).collect()} == {root: root, f"{root}/Moor": root, f"{tmp_path}/w": f"{tmp_path}/w"}


UPDATE = "update_id long, message struct<message_id: long, chat: struct<id: long>, text: string, caption: string>"


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()

    def put(name, rows):
        (inbox / name).write_text("\n".join(json.dumps(r) for r in rows))

    def run():
        stream = spark.readStream.schema(UPDATE).json(str(inbox))
        q = st.scheduled(st.routed(stream, 5), lambda b, _: b.write.mode("append").json(out), mark)
        q.awaitTermination(60)
        return sorted((r.update_id, r.route) for r in spark.read.json(out).collect())

    message = lambda i, chat, **what: {"update_id": i, "message": {"message_id": i, "chat": {"id": chat}, **what}}
    put("a.json", [message(1, 5, text="hi"), message(2, 6, text="foreign"), {"update_id": 3}, message(4, 5, text="x" * 301)])
    assert run() == [(1, "inline"), (4, "file")]
    put("b.json", [message(5, 5, caption="two\nlines"), message(6, 5)])
    assert run() == [(1, "inline"), (4, "file"), (5, "file"), (6, "empty")]  # nothing is read twice
    assert {(r.reason, r["count"]) for r in st.dropped(spark.read.schema(UPDATE).json(str(inbox)), 5).collect()} == {("foreign chat", 1), ("no message", 1)}


def test_bad_records_are_set_aside(spark):
    raw = spark.createDataFrame([('{"update_id": 1}',), ("{broken",)], "value string")
    assert [(r.update.update_id if r.update else None, r.bad) for r in st.quarantined(raw, UPDATE).collect()] == [(1, None), (None, "{broken")]


def test_latest_state_and_late_rows(spark, tmp_path):
    schema = "ts timestamp, user_id long, event_type string, event_id long"
    inbox, mark, kept = tmp_path / "in", str(tmp_path / "mark"), str(tmp_path / "kept")
    inbox.mkdir()
    for name, rows in {"a.json": [("2026-01-01T00:01:00Z", 1, "open", 1), ("2026-01-01T00:02:00Z", 2, "open", 2)], "b.json": [("2026-01-01T05:00:00Z", 1, "done", 3)], "c.json": [("2026-01-01T00:03:00Z", 1, "late", 4), ("2026-01-01T05:01:00Z", 2, "busy", 5)]}.items():
        (inbox / name).write_text("\n".join(json.dumps(dict(zip(("ts", "user_id", "event_type", "event_id"), r))) for r in rows))
        stream = spark.readStream.schema(schema).json(str(inbox))
        st.scheduled(stream, lambda b, n: st.upsert_latest(b, n, kept), mark).awaitTermination(60)
        counted = st.windowed(spark.readStream.schema(schema).json(str(inbox)))
        q = counted.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{mark}-w").option("path", f"{kept}-w").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert {(r.user_id, r.event_type) for r in st.latest_table(spark, kept, schema).read().collect()} == {(1, "done"), (2, "busy")}  # an older row doesn't win
    assert {(r.event_type, r.n) for r in spark.read.parquet(f"{kept}-w").collect()} == {("open", 2)}  # closed by the watermark; the late row is not counted


def test_views_of_the_session_stay(spark):
    from rillstone import catalog

    spark.createDataFrame([(1,)], "mine int").createOrReplaceTempView("documents")
    catalog.QUERIES["length_band_check"](spark, "/root/testdata/sf0.001").count()
    assert spark.table("documents").columns == ["mine"]
    spark.catalog.dropTempView("documents")


def test_worst_overlaps(spark):
    """Against all pairs, with copies, a name that all have, and nulls; equal sets aren't all joined."""
    import random
    from collections import defaultdict

    from rillstone.operators.similarity import worst_overlaps

    rng = random.Random(4)
    sets = {o: {0, *rng.sample(range(1, 14), rng.randrange(1, 8))} for o in range(60)} | {o: {0, 1, 2, 3} for o in range(100, 120)} | {200: set(range(14))}
    rows = [(o, p) for o, s in sets.items() for p in s for _ in range(rng.choice((1, 2)))] + [(None, 1), (None, 2), (None, 3), (300, None), (300, 1), (300, 2)]
    got = defaultdict(list)
    for r in worst_overlaps(spark.createDataFrame(rows, "o long, p long")).collect():
        got[r.a].append((r.n, r.b))
    for a, s in sets.items():
        assert sorted(got[a], reverse=True) == sorted(((len(s & t), b) for b, t in sets.items() if b != a and len(s & t) >= 3), reverse=True)[:5]
    assert set(got) <= set(sets)
