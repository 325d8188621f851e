"""Small tables of made-up projects, jobs, updates and logs, as SQL that both engines read.

They stand in for inputs the shared tables don't hold (source trees, queues, chat updates);
registered queries run over them, and tests state their expected rows."""

from __future__ import annotations


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        assert "'" not in v and "\\" not in v
        return f"'{v}'"
    return str(v)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A CTE of literal rows."""
    body = ", ".join("(" + ", ".join(_literal(v) for v in r) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS v_({columns}))"


def _meta(keywords: str, privacy: str, first: str, note: int, extra: str = "") -> str:
    return f"intro text\n# Keywords\n\n`{keywords}`\n## Privacy policy\nShort line.\n\n{privacy}\n\n# Description (full)\nFirst sentence:\n\n{first} It has more to say.\n\n# Reviewer note\n{'n' * note}\n{extra}"


def _pbx(bundle: str, version: str, extra: str = "") -> str:
    return f"MARKETING_VERSION = {version};\nPRODUCT_BUNDLE_IDENTIFIER = {bundle};\nPRODUCT_BUNDLE_IDENTIFIER = {bundle};\n{extra}"


_SHARED = "struct Harbour: View {\n}\nfinal class TideStore {\n}\nenum Knot {\n}\nstruct Row {\n}\n"
_TERMS = "We keep all of your boat notes on this device and never send them to anyone else at all."
_LABELS = "\n".join(f"  Text(t{i}).accessibilityLabel(t{i})" for i in range(20))

#: Projects as files: (root, path, text).
FILES = [
    ("/work/Moor", "Moor.xcodeproj/project.pbxproj", _pbx("com.moor.app", "1.2.0")),
    ("/work/Moor", "Moor/MoorApp.swift", "@main\nstruct MoorApp: App {\n  var body: some Scene {\n    WindowGroup {\n      DeckView()\n    }\n  }\n}\n"),
    ("/work/Moor", "Moor/DeckView.swift", f"struct DeckView: View {{\n{_LABELS}\n}}\n#Preview {{ DeckView() }}\n{_SHARED}"),
    ("/work/Moor", "Moor/Shared/Glyphs.swift", "enum Sign {\n  case rope\n  case buoy\n}\n"),
    ("/work/Moor", "Moor/Shared/CoverArt.swift", "struct Cover: View {\n}\n"),
    ("/work/Moor", "Moor/build/Old.swift", "struct Ignored {\n}\n"),
    ("/work/Moor", "REQUIREMENTS.md", "A log of boats.\n"),
    ("/work/Moor", "APPLE_REVIEW_RESPONSE.txt", "The app keeps notes on the device.\n"),
    ("/work/Moor", "APP_STORE_METADATA.md", _meta("Boats, Tides, harbour, rope", _TERMS, "Keep every mooring of the season at hand.", 520, "Support URL: none\n# Build facts\nx")),
    ("/work/Quay", "Quay.xcodeproj/project.pbxproj", _pbx("com.moor.quay", "0.9", "INFOPLIST_KEY_NSCameraUsageDescription = x;\nUIInterfaceOrientationLandscapeLeft\n")),
    ("/work/Quay", "Quay/QuayApp.swift", "@main\nstruct QuayApp: App {\n  WindowGroup {\n    PierView()\n  }\n}\n"),
    ("/work/Quay", "Quay/PierView.swift", f"struct PierView: View {{\n  // TODO: finish\n  let x = y as! Int\n  Text(\"beta build\")\n  let v = \"1.2.3\"\n  URLSession.shared\n  Locale.current\n  ScrollView(showsIndicators: false) {{\n  }}\n  .sheet(isPresented: on) {{\n    InfoSheet()\n  }}\n}}\n{_SHARED}"),
    ("/work/Quay", "Quay/InfoSheet.swift", "struct InfoSheet: View {\n  var body: some View {\n    Text(a).background( SeaBackground())\n  }\n}\nstruct Other: View {\n}\n"),
    ("/work/Quay", "Quay/Shared/Sea.swift", "struct SeaBackground: View {\n  Canvas().drawingGroup()\n  x.blur(radius: 2)\n}\n"),
    ("/work/Quay", "Quay/Shared/CoverArt.swift", "struct Cover2: View {\n}\n"),
    ("/work/Quay", "Quay/DeckView.swift", "protocol Plank {\n}\n"),
    ("/work/Quay", "Quay/TideView.swift", "struct TideView: View {\n}\n"),
    ("/work/Quay", "REQUIREMENTS.md", "A timer for boats.\n"),
    ("/work/Quay", "APPLE_REVIEW_RESPONSE.txt", "Quay keeps **notes**.\n1. first\n" + "x" * 3600),
    ("/work/Quay", "APP_STORE_METADATA.md", _meta("boats, tides, harbour, sails", "Nothing leaves your phone. " + _TERMS, "Keep every mooring of the season at hand.", 20)),
    ("/work/Skiff", "Skiff.xcodeproj/project.pbxproj", "PRODUCT_BUNDLE_IDENTIFIER = Skiff.Skiff;\n"),
    ("/work/Skiff", "Main.swift", "struct Haptics {\n}\nstruct SkiffApp {\n}\npublic final class Plank2 {\n}\n"),
    ("/work/Skiff", "TideView.swift", "struct Tide3: View {\n  ScrollView(.horizontal) {\n  }\n}\n"),
    ("/work/Skiff", "DeckView.swift", "struct Deck3: View {\n}\n"),
    ("/work/Raft", "notes.swift", "actor Log {\n}\nstruct Harbour: View {\n}\nenum Knot {\n}\nclass TideStore {\n}\n  ScrollView(a) {\n  frame(width: geo.size.width)\n"),
    ("/work/Raft", "APP_STORE_METADATA.md", "# About\nnothing\n"),
]


def files() -> str:
    return values("files", "root, path, text", FILES)


#: Queue entries: (job, lane, state, body, minute of last change).
JOBS = [
    ("b1", "build", "done", "# Moor Log\nFINGERPRINT ASSIGNED\nscreens", 100), ("b2", "build", "failed", "# Quay-Side 2\nscreens", 300),
    ("b3", "build", "waiting", "# Skiff-Side Two\n# ANSWER: old\nscreens", 200), ("b4", "build", "running", "# Raft\nFINGERPRINT ASSIGNED", 1000),
    ("b5", "build", "pending", "# Tern\nFINGERPRINT ASSIGNED", 1100), ("b6", "build", "pending", "#Gull\nFINGERPRINT ASSIGNED", 1050), ("b7", "build", "pending", "# Auk\nnew", 1060),
    ("b8", "build", "done", "# Old one\nFINGERPRINT ASSIGNED", 5), ("t1", "fast", "pending", "# TYPE: reject\n# PROJECT: Moor\nThe letter\n# TYPE: fix", 1010),
    ("t2", "fast", "pending", "# TYPE: recolor\n# PROJECT: Quay\nBluer", 1005), ("t3", "fast", "running", "# TYPE: fix\n# PROJECT: Nowhere\nMove it", 900),
    ("t4", "fast", "pending", "no headers", 1020), ("m1", "mixed", "pending", "# One\nx", 10), ("m2", "mixed", "pending", "# Two\nx", 11), ("m3", "mixed", "pending", "# Three\nFINGERPRINT ASSIGNED", 9),
]
CONFIG = [("parallel.build", "3"), ("parallel.fast", None), ("paused.night", "true")]
NOW = 1200  # minutes


def jobs() -> str:
    return values("jobs", "job, lane, state, body, minute", JOBS)


ANSWERS = [("Skiff_Side_Two", "use blue"), ("Nobody", "never read")]
PROJECTS = [("/desk", 1, "Quay"), ("/archive", 2, "Moor"), ("/archive", 2, "Quay"), ("/downloads", 3, "Moor")]
LESSON_LINES = [("Moor", 1, "  FAIL  stubs/TODO found"), ("Moor", 2, "  ok    no permissions"), ("Moor", 3, "  FAIL  bundle ID = com.x  "), ("Quay", 1, "  FAIL  stubs/TODO found   "), ("Quay", 2, "TOTAL: 2 FAIL, 0 warn"),
                ("Skiff", 1, "  FAIL  stubs/TODO found"), ("Skiff", 2, "  FAIL  bundle ID = y"), ("Raft", 1, "  FAIL  no REQUIREMENTS.md")]
PROPOSALS = [("2026-01-01", "ADOPTED by me\nrule"), ("2026-01-02", "draft\nADOPTED"), ("2026-01-03", "")]
SNAPSHOT = [("/work/Moor", "a.swift", "one"), ("/work/Moor", "b.kt", "two"), ("/work/Moor", "gone.swift", "x"), ("/reference/Q", "a.swift", "old")]
CURRENT = [("/work/Moor", "a.swift", "one"), ("/work/Moor", "b.kt", "two!"), ("/work/Moor", "c.swift", "new"), ("/work/Moor", ".hidden/d.swift", "h"), ("/work/Moor", "e.txt", "t"), ("/work/New", "a.swift", "first"), ("/reference/Q", "a.swift", "changed")]
STAGES = [("Moor", "start", 0, 3, False), ("Moor", "build", 47, 12, True), ("Quay", "build", 90, 6, True), ("Skiff", "build", 5, 40, False)]
PANE = [(m, "Do you want to proceed? (y/n)" if m in (5, 10, 25, 30) else "working", m) for m in (0, 5, 10, 15, 20, 25)] + [(30, "Do you want to proceed? (y/n)", 31)]
DIGESTED = [("2026-01-01", 100, 200), ("2026-01-02", 300, 200), ("2026-01-03", 50, None)]

#: Chat updates: (update_id, message_id, chat, text, caption, file_id, file_name).
UPDATES = [(1, 7, 5, "status?", None, None, None), (2, 8, 5, "# App\nscreen one\n\nscreen two", None, None, None), (3, 9, 5, "x" * 400, None, None, None), (4, 10, 5, None, "spec attached", "F1", "plan.pdf"),
           (5, 11, 5, None, None, None, None), (6, 12, 5, None, None, None, None), (7, 13, 6, "foreign", None, None, None), (8, None, None, None, None, None, None), (9, 14, 5, "", "", "F2", None), (10, 15, 5, "y" * 300, None, None, None)]
PHOTOS = [(11, 0, "small", 10), (11, 1, "big", 999), (11, 2, "same", 999), (14, 0, "unsized", None)]
