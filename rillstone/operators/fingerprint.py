"""Projects as fingerprints, and fingerprints against a registry.

Input: ``files(root, path, text)``, the files of any number of projects.  ``prints`` makes a
row for each project; ``compare`` grades every project against all others, or (``THEIRS``)
against what a stored registry holds.  A project is its root: where several roots hold an app of
one name, its column ``app`` reads ``name of root``, and none of them is an "other" of another.  Comparisons are equi-joins on one type, file, keyword, sentence or shingle, never
project against project.  Intended difference: of texts that resemble each other the most
similar one is named, not the last one read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as t
from ..functions.vocabulary import BLACKLIST, FILES_ALLOWED, GENERIC
from ..plans import fixtures
from ..plans.registry import ask, query

# Fixed value: a type's declaration at the start of a line.
DECLARED = r"(?m)^\s*(?:public |private |fileprivate |internal |open )?(?:final )?(?:indirect )?(?:struct|class|enum|actor|protocol)\s+([A-Z][A-Za-z0-9_]*)"
# Headings of the sections that are read.
KEYWORDS, PRIVACY, OPENING, NOTE = "keyword", "privacy policy|privacy text|privacy", r"first sentence|^description|description \(full\)", "review(er)? note|notes for review|app review"


def name(c: str) -> str:
    """The app's own name in a project's key."""
    return f"split_part({c}, chr(1), 1)"


def said(c: str) -> str:
    """A key, or a text with keys in it, for people to read."""
    return f"replace({c}, chr(1), ' of ')"


def _listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def projects(d) -> str:
    """CTEs ``projects(root, app)``, ``sources(app, root, path, text)`` and ``settings(app, path, text)``."""
    return f"""named AS (SELECT root, coalesce(min(nullif({d.rx_one("path", "^([^/]+)[.]xcodeproj/")}, '')), min({d.rx_one("root", "([^/]+)/?$")})) AS app FROM files GROUP BY root),
projects AS (SELECT n.root, CASE WHEN m.n > 1 THEN n.app || chr(1) || n.root ELSE n.app END AS app, n.app AS name FROM named n JOIN (SELECT lower(app) AS low, count(*) AS n FROM named GROUP BY lower(app)) m ON m.low = lower(n.app)),
dirs AS (SELECT DISTINCT root, {d.rx_one("path", "^([^/]+)/")} AS dir FROM files),
sources AS (SELECT p.app, f.root, f.path, f.text FROM files f JOIN projects p ON f.root = p.root LEFT JOIN dirs x ON x.root = f.root AND x.dir = p.name
  WHERE {d.rx("f.path", "[.]swift$")} AND NOT {d.rx("f.path", "(^|/)(build|DerivedData|[^/]*[.]xcodeproj)/")} AND (x.dir IS NULL OR substr(f.path, 1, length(p.name) + 1) = p.name || '/')),
settings AS (SELECT p.app, f.path, f.text FROM files f JOIN projects p ON f.root = p.root WHERE {d.rx("f.path", "^[^/]+[.]xcodeproj/project[.]pbxproj$")})"""


def _clean(d, c: str) -> str:
    return t.strip(d, f"translate({c}, '`*>_', '')")


def sections(d, file: str = "APP_STORE_METADATA.md") -> str:
    """CTEs ``md(app, pos, line)`` and ``body(app, sec, heading, pos, line, para)``: lines below a
    heading (those before the first one are lost) and their paragraph."""
    head = d.rx("line", r"^#{1,4}\s+")
    w = "PARTITION BY app ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""md AS (SELECT app, pos, line FROM (SELECT app, {d.numbered("ls", "line")} FROM (SELECT p.app, {t.lines(d, "f.text")} AS ls FROM files f JOIN projects p ON f.root = p.root WHERE f.path = '{file}') x) y),
ordered AS (SELECT app, pos, line, {head} AS head, sum(CASE WHEN {head} THEN 1 ELSE 0 END) OVER ({w}) AS sec FROM md),
titled AS (SELECT *, max(CASE WHEN head THEN {t.strip(d, d.rx_sub("line", "^#+", ""))} END) OVER (PARTITION BY app, sec) AS heading FROM ordered),
body AS (SELECT app, sec, heading, pos, line, sum(CASE WHEN {t.strip(d, "line")} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY app, sec ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS para FROM titled WHERE sec > 0 AND NOT head)"""


def _section(d, name: str, pattern: str) -> str:
    """CTE ``name(app, pos, line, para)``: the body below the first heading that fits."""
    return f"{name} AS (SELECT b.app, b.pos, b.line, b.para FROM body b JOIN (SELECT app, min(sec) AS sec FROM titled WHERE head AND {d.rx('heading', '(?i)' + pattern)} GROUP BY app) s ON b.app = s.app AND b.sec = s.sec)"


def _paragraphs(d, name: str, source: str) -> str:
    """CTE ``name(app, para, said, size)``: cleaned paragraphs as one line, and their length."""
    return f"""{name} AS (SELECT app, para, {d.joined(f"CASE WHEN {_clean(d, 'line')} <> '' THEN {_clean(d, 'line')} END", "' '", "pos")} AS said, max(length(whole)) AS size
  FROM (SELECT app, para, pos, line, {_clean(d, "w")} AS whole FROM (SELECT b.app, b.para, b.pos, b.line, j.w FROM {source} b JOIN (SELECT app, para, {d.joined("line", "chr(10)", "pos")} AS w FROM {source} GROUP BY app, para) j ON b.app = j.app AND b.para = j.para) x) y GROUP BY app, para)"""


def prints(d) -> str:
    """CTEs up to ``prints``, with the long forms ``types``, ``names`` and ``keywords`` beside it."""
    k = _clean(d, "line")
    first = f"CASE WHEN {d.rx('said', '[.!?]' + chr(92) + 's')} THEN {d.rx_one('said', '^(.*?[.!?])' + chr(92) + 's')} ELSE said END"
    one = lambda arr, key: f"(SELECT app, {d.each(arr)} AS {key} FROM "
    return f"""{projects(d)},
types AS (SELECT DISTINCT app, t FROM {one(d.rx_each("text", DECLARED), "t")} sources) x WHERE t <> {name('app')} AND t <> {name('app')} || 'App'),
names AS (SELECT DISTINCT app, f FROM (SELECT app, {d.rx_one("path", "([^/]+)$")} AS f FROM sources) x WHERE f <> {name('app')} || 'App.swift'),
bundles AS (SELECT app, {t.strip(d, "min(b)")} AS bundle FROM (SELECT app, {d.rx_one("text", "PRODUCT_BUNDLE_IDENTIFIER = " + chr(92) + "x22?([^" + chr(92) + "x22;]+)")} AS b FROM settings) x WHERE b <> '' GROUP BY app),
{sections(d)},
{_section(d, "kw_body", KEYWORDS)},
kw_line AS (SELECT app, said FROM (SELECT app, {k} AS said, row_number() OVER (PARTITION BY app ORDER BY pos) AS place FROM kw_body WHERE {k} LIKE '%,%' AND {k} NOT LIKE '#%' AND length({k}) <= 200) x WHERE place = 1),
keywords AS (SELECT DISTINCT app, lower({t.strip(d, "k")}) AS k FROM {one(d.split("said", "','"), "k")} kw_line) x WHERE {t.strip(d, "k")} <> ''),
{_section(d, "pr_body", PRIVACY)}, {_paragraphs(d, "pr_para", "pr_body")},
privacy AS (SELECT app, said AS privacy FROM (SELECT app, said, row_number() OVER (PARTITION BY app ORDER BY size DESC, para) AS place FROM pr_para WHERE size > 0) x WHERE place = 1),
{_section(d, "op_body", OPENING)}, {_paragraphs(d, "op_para", "op_body")},
opening AS (SELECT app, lower({first}) AS first_sentence FROM (SELECT app, said, row_number() OVER (PARTITION BY app ORDER BY para) AS place FROM op_para WHERE said <> '' AND said NOT LIKE '#%' AND {d.size(d.rx_split("said", chr(92) + "s+"))} >= 5
  AND NOT {d.rx("said", "[А-Яа-яЁё]")} AND said NOT LIKE '%:') x WHERE place = 1),
{_section(d, "no_body", NOTE)},
notes AS (SELECT app, length({_clean(d, d.joined("line", "chr(10)", "pos"))}) AS n FROM no_body GROUP BY app),
urls AS (SELECT app, max(CASE WHEN {d.rx("line", "(?i)support url")} THEN 1 ELSE 0 END) AS url FROM md GROUP BY app),
prints AS (SELECT p.app, p.root, coalesce(b.bundle, '') AS bundle, u.app IS NOT NULL AS has_metadata, coalesce(v.privacy, '') AS privacy, coalesce(o.first_sentence, '') AS first_sentence,
  CAST(coalesce(n.n, 0) AS INT) AS review_note_chars, coalesce(u.url, 0) = 1 AS has_support_url
  FROM projects p LEFT JOIN bundles b ON b.app = p.app LEFT JOIN privacy v ON v.app = p.app LEFT JOIN opening o ON o.app = p.app LEFT JOIN notes n ON n.app = p.app LEFT JOIN urls u ON u.app = p.app)"""


def _set(d, table: str, key: str) -> str:
    return f"(SELECT app, {d.joined(key, chr(39) + ', ' + chr(39), key)} AS s, count(*) AS n FROM {table} GROUP BY app)"


def fingerprint(d) -> str:
    return f"""WITH {prints(d)} SELECT {said("p.app")} AS app, p.root, p.bundle, p.has_metadata, p.privacy, p.first_sentence, p.review_note_chars, p.has_support_url,
coalesce(t.s, '') AS types, coalesce(f.s, '') AS files, coalesce(k.s, '') AS keywords FROM prints p LEFT JOIN {_set(d, "types", "t")} t ON t.app = p.app LEFT JOIN {_set(d, "names", "f")} f ON f.app = p.app LEFT JOIN {_set(d, "keywords", "k")} k ON k.app = p.app"""


#: Tables of what each project is held against: those of the projects themselves ...
OURS = {"own": "own", "names": "names", "keywords": "keywords", "sents": "sents", "sh": "sh", "prints": "prints", "pre": "pre"}
#: ... or those of a registry.
THEIRS = {k: f"their_{k}" for k in OURS}


def compare(d, b: dict = OURS) -> str:
    """CTEs up to ``graded(app, rule, severity, detail)``: every check of every project."""
    return f"{prints(d)}, {compared(d, b)}"


def compared(d, b: dict = OURS) -> str:
    """The checks alone, over tables ``prints``, ``types``, ``names``, ``keywords`` and those of ``b``."""
    other = f"lower({name('a.app')}) <> lower({name('b.app')})"
    n_apps = "(SELECT count(DISTINCT lower(" + name("b.app") + f")) FROM {b['prints']} b WHERE lower(" + name("b.app") + ") <> lower(" + name("p.app") + "))" if b is THEIRS else "count(*) OVER () - 1"
    words = d.rx_all("lower(privacy)", r"[a-z0-9\x27]+")
    dots = lambda c: f"length({c}) - length(replace({c}, '.', ''))"
    return f"""marked AS (SELECT app, {d.joined("t", "', '", "t")} AS detail FROM types WHERE t IN ({_listed(BLACKLIST)}) GROUP BY app),
own AS (SELECT app, t FROM types WHERE t NOT IN ({_listed(GENERIC)})),
met AS (SELECT a.app, b.app AS other, a.t FROM own a JOIN {b['own']} b ON a.t = b.t AND {other}),
met_n AS (SELECT app, other, count(*) AS n FROM met GROUP BY app, other HAVING count(*) >= 3),
worst AS (SELECT app, other, n FROM (SELECT app, other, n, row_number() OVER (PARTITION BY app ORDER BY n DESC, other DESC) AS place FROM met_n) x WHERE place <= 5),
shown AS (SELECT app, other, {d.joined("t", "', '", "t")} AS names FROM (SELECT m.app, m.other, m.t, row_number() OVER (PARTITION BY m.app, m.other ORDER BY m.t) AS place FROM met m JOIN worst w ON w.app = m.app AND w.other = m.other) x WHERE place <= 12 GROUP BY app, other),
file_met AS (SELECT a.app, a.f, b.app AS other, row_number() OVER (PARTITION BY a.app, a.f ORDER BY b.app) AS nth FROM names a JOIN {b['names']} b ON a.f = b.f AND {other} WHERE a.f NOT IN ({_listed(FILES_ALLOWED)})),
file_one AS (SELECT app, f, {d.joined("other", "', '", "other")} AS apps FROM file_met WHERE nth <= 3 GROUP BY app, f),
file_all AS (SELECT app, f, apps, row_number() OVER (PARTITION BY app ORDER BY f) AS place, count(*) OVER (PARTITION BY app) AS n FROM file_one),
file_said AS (SELECT app, {d.joined("f || ' (' || apps || ')'", "', '", "f")} AS detail FROM file_all WHERE n >= 2 AND place <= 8 GROUP BY app),
kw_met AS (SELECT a.app, b.app AS other, count(*) AS n, {d.joined("a.k", "', '", "a.k")} AS names FROM keywords a JOIN {b['keywords']} b ON a.k = b.k AND {other} GROUP BY a.app, b.app HAVING count(*) > 2),
sents AS (SELECT DISTINCT app, {d.each(t.sentences(d, "privacy"))} AS s FROM prints WHERE privacy <> ''),
verbatim AS (SELECT a.app, min(b.app) AS other FROM sents a JOIN {b['sents']} b ON a.s = b.s AND {other} GROUP BY a.app),
grams AS (SELECT DISTINCT app, {d.each(t.shingles(d, "w", 5))} AS s FROM (SELECT app, {words} AS w FROM prints WHERE privacy <> '') x), sh AS (SELECT g.app, g.s, n.n FROM grams g JOIN (SELECT app, count(*) AS n FROM grams GROUP BY app) n ON n.app = g.app),
sh_met AS (SELECT a.app, b.app AS other, count(*) AS c, max(a.n) AS x, max(b.n) AS y FROM sh a JOIN {b['sh']} b ON a.s = b.s AND {other} GROUP BY a.app, b.app),
alike AS (SELECT app, other, j FROM (SELECT app, other, CAST(c AS DOUBLE) / (x + y - c) AS j, row_number() OVER (PARTITION BY app ORDER BY CAST(c AS DOUBLE) / (x + y - c) DESC, other) AS place FROM sh_met) z WHERE place = 1 AND j >= 0.4e0),
opened AS (SELECT a.app, {d.joined("b.app", "', '", "b.app")} AS others FROM prints a JOIN {b['prints']} b ON a.first_sentence = b.first_sentence AND {other} WHERE a.first_sentence <> '' AND a.has_metadata GROUP BY a.app),
pre AS (SELECT app, lower(bundle) AS b, {d.rx_one("lower(bundle)", "^([^.]*[.][^.]*)")} AS p, {dots("bundle")} AS dots FROM prints WHERE bundle <> ''),
near AS (SELECT app, p, {d.joined("other", "', '", "other")} AS others FROM (SELECT a.app, a.p, b.app AS other, row_number() OVER (PARTITION BY a.app ORDER BY b.app) AS place FROM pre a JOIN {b['pre']} b ON a.p = b.p AND {other} WHERE a.p <> '' AND b.dots >= 2 AND a.p <> 'com.app' AND {d.rx_one("a.p", "[.]([^.]*)$")} <> lower(replace({name('a.app')}, '_', ''))) x WHERE place <= 4 GROUP BY app, p),
kinds AS (SELECT app, count(*) AS n_words FROM keywords GROUP BY app),
full_ AS (SELECT p.*, {n_apps} AS n_others, m.detail AS marked, w.app IS NOT NULL AS like_types, f.detail AS files_said, k.n_words, q.app IS NOT NULL AS like_words, v.other AS verbatim, a.other AS alike, o.others AS opened, n.p AS prefix, n.others AS prefixed FROM prints p
  LEFT JOIN marked m ON m.app = p.app LEFT JOIN (SELECT DISTINCT app FROM met_n) w ON w.app = p.app LEFT JOIN file_said f ON f.app = p.app LEFT JOIN kinds k ON k.app = p.app LEFT JOIN (SELECT DISTINCT app FROM kw_met) q ON q.app = p.app
  LEFT JOIN verbatim v ON v.app = p.app LEFT JOIN alike a ON a.app = p.app LEFT JOIN opened o ON o.app = p.app LEFT JOIN near n ON n.app = p.app),
graded AS ({d.findings([
    ("'blacklist'", "CASE WHEN marked IS NULL THEN 'ok' ELSE 'FAIL' END", "coalesce(marked, '')"),
    ("'types'", "CASE WHEN NOT like_types THEN 'ok' END", "''"),
    ("'files'", "CASE WHEN files_said IS NULL THEN 'ok' ELSE 'warn' END", "coalesce(files_said, '')"),
    ("'keywords'", "CASE WHEN has_metadata AND NOT like_words THEN CASE WHEN n_words IS NULL THEN 'warn' ELSE 'ok' END END", "CASE WHEN n_words IS NULL THEN 'unreadable' ELSE '' END"),
    ("'privacy'", "CASE WHEN has_metadata THEN CASE WHEN privacy = '' THEN 'warn' WHEN verbatim IS NOT NULL THEN 'FAIL' WHEN alike IS NOT NULL THEN 'warn' ELSE 'ok' END END",
     "CASE WHEN privacy = '' THEN 'unreadable' WHEN verbatim IS NOT NULL THEN 'verbatim from ' || verbatim WHEN alike IS NOT NULL THEN 'resembles ' || alike ELSE '' END"),
    ("'first sentence'", "CASE WHEN has_metadata AND first_sentence <> '' THEN CASE WHEN opened IS NULL THEN 'ok' ELSE 'FAIL' END END", "coalesce(opened, '')"),
    ("'reviewer note'", "CASE WHEN has_metadata THEN CASE WHEN review_note_chars < 500 THEN 'FAIL' ELSE 'ok' END END", f"CAST(review_note_chars AS {d.text_type()})"),
    ("'support url'", "CASE WHEN has_metadata AND NOT has_support_url THEN 'warn' END", "''"),
    ("'metadata'", "CASE WHEN NOT has_metadata THEN 'warn' END", "'none'"),
    ("'bundle'", "CASE WHEN bundle = '' OR prefix IS NOT NULL THEN 'warn' ELSE 'ok' END", "CASE WHEN bundle = '' THEN 'not found' WHEN prefix IS NOT NULL THEN prefix || ' with ' || prefixed ELSE bundle END"),
    ("'registry'", "CASE WHEN n_others < 1 THEN 'warn' END", "'empty'")], "full_")}
UNION ALL SELECT w.app, 'types', CASE WHEN w.n >= 6 THEN 'FAIL' ELSE 'warn' END, CAST(w.n AS {d.text_type()}) || ' with ' || w.other || ': ' || s.names || CASE WHEN w.n > 12 THEN ' …' ELSE '' END FROM worst w JOIN shown s ON s.app = w.app AND s.other = w.other
UNION ALL SELECT app, 'keywords', 'FAIL', CAST(n AS {d.text_type()}) || ' with ' || other || ': ' || names FROM kw_met)"""


@query
def project_fingerprints(d):
    return fingerprint(d).replace("WITH ", f"WITH {fixtures.files()}, ", 1)


@query
def project_comparison(d):
    return f"WITH {fixtures.files()}, {compare(d)} SELECT {said('app')} AS app, rule, severity, {said('detail')} AS detail FROM graded"


@query
def project_totals(d):
    """Findings by severity; any FAIL makes the exit code 1."""
    return f"WITH {fixtures.files()}, {compare(d)} SELECT {said('app')} AS app, " + ", ".join(f"CAST(sum(CASE WHEN severity = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{s.lower()}" for s in ("FAIL", "warn", "ok")) + ", max(CASE WHEN severity = 'FAIL' THEN 1 ELSE 0 END) AS exit_code FROM graded GROUP BY app"


@query
def registry_list(d):
    return f"WITH {fixtures.files()}, {prints(d)} SELECT {said('p.app')} AS app, coalesce(t.n, 0) AS n_types, p.bundle, CAST((SELECT count(*) FROM prints) AS BIGINT) AS total FROM prints p LEFT JOIN (SELECT app, count(*) AS n FROM types GROUP BY app) t ON t.app = p.app"


def fingerprints_of(spark: SparkSession, files: DataFrame) -> DataFrame:
    """A row for each project of ``files(root, path, text)``; sets are sorted lists joined by commas."""
    return ask(spark, fingerprint, files=files)


def compare_projects(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``(app, rule, severity, detail)`` of every project against all others."""
    return ask(spark, lambda d: f"WITH {compare(d)} SELECT {said('app')} AS app, rule, severity, {said('detail')} AS detail FROM graded", files=files)
