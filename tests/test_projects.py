"""Projects, jobs, messages and sounds on the fixtures, with rows worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from rillstone import catalog
from rillstone.operators import fingerprint, gates, signal
from rillstone.plans import fixtures

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return [r.asDict() for r in catalog.QUERIES[name](spark, SF).collect()]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(fixtures.FILES, "root string, path string, text string")


def test_fingerprints(spark, files):
    got = {r.app: r for r in fingerprint.fingerprints_of(spark, files).collect()}
    assert set(got) == {"Moor", "Quay", "Skiff", "Raft"}
    moor = got["Moor"]
    assert moor.types == "Cover, DeckView, Harbour, Knot, Row, Sign, TideStore"  # own names and build folders aside
    assert moor.files == "CoverArt.swift, DeckView.swift, Glyphs.swift" and moor.bundle == "com.moor.app"
    assert moor.keywords == "boats, harbour, rope, tides" and moor.first_sentence == "keep every mooring of the season at hand."
    assert moor.privacy.startswith("We keep all") and moor.review_note_chars == 520 + len("\nSupport URL: none") and moor.has_support_url
    assert got["Skiff"].types == "Deck3, Haptics, Plank2, Tide3" and not got["Skiff"].has_metadata
    assert got["Raft"].has_metadata and got["Raft"].keywords == "" and got["Raft"].bundle == ""


def test_comparison(spark, files):
    got = {(r.app, r.rule, r.severity, r.detail) for r in fingerprint.compare_projects(spark, files).collect()}
    for row in [
        ("Skiff", "blacklist", "FAIL", "Haptics"), ("Moor", "types", "warn", "3 with Raft: Harbour, Knot, TideStore"), ("Skiff", "types", "ok", ""),
        ("Quay", "files", "warn", "DeckView.swift (Moor, Skiff), TideView.swift (Skiff)"), ("Moor", "files", "ok", ""), ("Moor", "keywords", "FAIL", "3 with Quay: boats, harbour, tides"),
        ("Raft", "keywords", "warn", "unreadable"), ("Moor", "privacy", "FAIL", "verbatim from Quay"), ("Raft", "privacy", "warn", "unreadable"), ("Quay", "first sentence", "FAIL", "Moor"),
        ("Quay", "reviewer note", "FAIL", "20"), ("Moor", "reviewer note", "ok", "538"), ("Quay", "support url", "warn", ""), ("Skiff", "metadata", "warn", "none"),
        ("Moor", "bundle", "ok", "com.moor.app"),  # its own name is no collision
        ("Quay", "bundle", "warn", "com.moor with Moor"), ("Raft", "bundle", "warn", "not found"), ("Skiff", "bundle", "ok", "Skiff.Skiff"),
    ]:
        assert row in got, row
    assert not [r for r in got if r[0] == "Skiff" and r[1] in ("keywords", "privacy", "first sentence", "reviewer note", "support url")]


def test_one_project_has_an_empty_registry(spark, files):
    got = {(r.rule, r.severity) for r in fingerprint.compare_projects(spark, files.where("root = '/work/Moor'")).collect()}
    assert ("registry", "warn") in got and ("types", "ok") in got and ("privacy", "ok") in got


def test_six_shared_types_fail_and_names_stop_at_twelve(spark):
    body = "".join(f"struct T{i:02d} {{\n}}\n" for i in range(14))
    some = spark.createDataFrame([("/w/A", "A.xcodeproj/x", ""), ("/w/A", "A/a.swift", body), ("/w/B", "B.xcodeproj/x", ""), ("/w/B", "B/b.swift", body)], "root string, path string, text string")
    got = {r.app: r for r in fingerprint.compare_projects(spark, some).where("rule = 'types'").collect()}
    assert got["A"].severity == "FAIL" and got["A"].detail == "14 with B: " + ", ".join(f"T{i:02d}" for i in range(12)) + " …"


def test_gates(spark, files):
    got = {(r.app, r.rule): (r.severity, r.detail) for r in gates.check_projects(spark, files).collect()}
    quay = {"stub": "FAIL", "forced": "warn", "unfinished wording": "FAIL", "version literal": "warn", "network": "FAIL", "regional": "FAIL", "version": "FAIL", "bundle id": "ok", "permissions": "FAIL", "glyphs": "FAIL",
            "cover art": "ok", "scroll width": "warn", "art speed": "FAIL", "sheet background": "FAIL", "orientation": "warn", "labels": "warn", "preview": "FAIL", "requirements": "ok", "response": "warn",
            "response names the app": "FAIL", "response markup": "FAIL", "note heading": "ok", "support line": "warn", "build facts": "warn", "saturated": "warn", "fingerprint": "FAIL"}
    assert {k: got["Quay", k][0] for k in quay} == quay
    assert got["Quay", "sheet background"][1] == "InfoSheet" and got["Quay", "preview"][1] == "PierView"
    assert [k for (app, k), (s, _) in got.items() if app == "Moor" and s not in ("ok",) and k not in ("types", "keywords", "privacy", "first sentence", "fingerprint")] == []
    assert got["Skiff", "bundle id"] == ("FAIL", "Skiff.Skiff") and got["Skiff", "bundle id count"][0] == "warn" and got["Skiff", "scroll width"][0] == "ok"
    assert got["Raft", "scroll width"][0] == "ok" and got["Raft", "bundle id"][0] == "FAIL" and got["Raft", "response"][0] == "FAIL"


@pytest.mark.parametrize("bid,verdict", [("", "FAIL missing"), ("Moor.Moor", "FAIL default name"), ("com.YourCompany.x", "FAIL placeholder"), ("com.1x.app", "FAIL format"), ("com..app", "FAIL format"), ("com.app", "warn segments"), ("com.my-boat.app", "ok")])
def test_bundle_grammar(spark, bid, verdict):
    from rillstone.plans.dialect import SPARK

    one = spark.createDataFrame([(bid,)], "b string")
    assert one.select(F.expr(gates.bundle_grammar(SPARK, "b"))).first()[0] == verdict


def test_lifecycle(spark):
    status = {r["state"]: (r["n"], r["titles"]) for r in rows(spark, "queue_status")}
    assert status["pending"] == (3, "Tern, Gull, Auk") and status["waiting"] == (1, "Skiff-Side Two") and set(status) == {"pending", "running", "done", "failed", "waiting"}
    # Two free places of the build lane, one unmarked job; one of the fast lane; two unmarked jobs stop the mixed lane.
    assert {(r["lane"], r["job"], r["action"]) for r in rows(spark, "dispatch_actions")} == {("build", "b6", "start"), ("build", "b7", "start"), ("fast", "t2", "start"), ("mixed", "m1", "distribute"), ("mixed", "m2", "distribute")}
    assert rows(spark, "answered_jobs") == [{"job": "b3", "state": "pending", "body": "# Skiff-Side Two\n# ANSWER: use blue\nscreens"}]
    tasks = {r["job"]: r for r in rows(spark, "parsed_tasks")}
    assert tasks["t1"]["kind"] == "reject" and tasks["t1"]["request"] == "The letter" and tasks["t1"]["folder"] == "/archive/Moor" and tasks["t3"]["folder"] is None and tasks["t4"]["title"] == "Task"
    assert tasks["t2"]["folder"] == "/desk/Quay" and tasks["t2"]["workflow"] == "palette"
    assert [(r["lesson"], r["n"], r["repeats"]) for r in sorted(rows(spark, "lesson_ranking"), key=lambda r: r["place"])] == [("stubs/TODO found", 3, True), ("bundle ID", 2, False), ("no REQUIREMENTS.md", 1, False)]
    assert rows(spark, "digest_text")[0]["digest"] == "Digest\nFailed: 1\n  - Quay-Side 2\nWaiting: 1\n  - Skiff-Side Two\nRunning: Raft\nPending: 3\nRepeating:\n  - 3x stubs/TODO found"
    assert rows(spark, "proposal_counts") == [{"total": 3, "open": 2}] and {r["day"] for r in rows(spark, "days_to_digest")} == {"2026-01-02", "2026-01-03"}
    assert {(r["project"], r["path"], r["change"]) for r in rows(spark, "edit_journal")} == {("Moor", "b.kt", "changed"), ("Moor", "c.swift", "new")}
    assert [r["minute"] for r in sorted(rows(spark, "stuck_panes"), key=lambda r: r["minute"])] == [10, 30]
    assert {(r["job"], r["minutes"], r["asks"], r["bar"]) for r in rows(spark, "stage_progress")} == {("Moor", 0, True, "........"), ("Moor", 47, False, "##......"), ("Quay", 91, True, "#......."), ("Skiff", 5, True, "########")}


def test_messages(spark):
    from rillstone.operators.messages import EMPTY, TAIL

    line = {r["message_id"]: r["line"].removesuffix(TAIL) for r in rows(spark, "rendered_messages")}
    assert line[7] == "[message 7] status?" and line[8] == "[message 8] long message starting «# App», full text: inbox/8.txt"
    assert line[9] == f"[message 9] long message starting «{'x' * 80}», full text: inbox/9.txt" and line[10] == "[message 10] file: inbox/10_plan.pdf · spec attached"
    assert line[11] == "[message 11] photo: inbox/11_photo" and line[12] == f"[message 12] {EMPTY}" and 13 not in line
    assert line[14] == "[message 14] photo: inbox/14_photo · file: inbox/14_14_file" and line[15] == f"[message 15] {'y' * 300}"
    assert {(r["path"], r["text"]) for r in rows(spark, "spilled_messages")} == {("inbox/8.txt", "# App\nscreen one\n\nscreen two"), ("inbox/9.txt", "x" * 400)}
    assert {(r["reason"], r["n"]) for r in rows(spark, "dropped_updates")} == {("no message", 1), ("foreign chat", 1)}


def test_slices_join_to_the_text(spark):
    from rillstone.operators.messages import fixed_size_chunks
    from rillstone.plans.registry import ask

    docs = spark.createDataFrame([(1, "a" * 8000), (2, ""), (3, "b" * 3900)], "doc_id long, text string")
    got = sorted((r.doc_id, r.part, r.slice) for r in ask(spark, fixed_size_chunks, documents=docs).collect())
    assert [(i, len(x)) for i, _, x in got] == [(1, 3900), (1, 3900), (1, 200), (3, 3900)]


def test_sounds(spark, tmp_path):
    import wave

    bank = {r["i"]: r["v"] for r in rows(spark, "clip_bank")}
    n = [int(signal.RATE * s) for s in (0.09, 0.09, 0.18)]
    assert len(bank) == sum(n)
    phase = 0.0
    for i in range(n[0]):  # the first note by the recurrence
        phase += 2 * math.pi * 660 / signal.RATE
        t, rest = i / signal.RATE, (n[0] - i) / signal.RATE
        assert bank[i] == pytest.approx(0.5 * math.sin(phase) * min(1, t / 0.005) * (1 if rest > 0.12 else rest / 0.12), abs=2e-5)
    sizes = {r["clip"]: r["n_bytes"] for r in rows(spark, "clip_sizes")}
    assert sizes["click"] == 44 + 2 * 882 and sizes["music"] == 44 + 2 * 220_500 and len(sizes) == 6
    music = spark.createDataFrame([(0, 0.0), (2, -2.0), (1, 0.5)], "i long, v double")
    assert signal.write_wav(music, str(tmp_path / "m.wav")) == 3
    with wave.open(str(tmp_path / "m.wav")) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 2, signal.RATE) and w.readframes(3) == (0).to_bytes(2, "little") + (16383).to_bytes(2, "little") + (-32767).to_bytes(2, "little", signed=True)


def test_noise_is_the_filtered_recurrence(spark):
    from rillstone.plans.dialect import SPARK

    got = {r.i: r.v for r in spark.sql(signal.noise(SPARK, 0.02)).collect()}
    draw = lambda i: ((i * 7919 + 104_730) * 48271 % 2147483647) * 48271 % 2147483647 / 1073741823.5 - 1
    last, n = 0.0, len(got)
    for i in range(n):
        last += 0.3 * (draw(i) - last)
        t, rest = i / signal.RATE, (n - i) / signal.RATE
        assert got[i] == pytest.approx(0.5 * last * min(1, t / 0.001) * min(1, rest / 0.25), abs=1e-7)
