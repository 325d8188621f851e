"""Rule gates over projects: one pass over the source lines, graded findings, totals.

Input: ``files(root, path, text)``.  Line rules are conditional counts of one aggregate per
project; only the rules that need an enclosing type, lines after a match or a file's presence
have plans of their own, all equi-joins.  Findings of the fingerprint comparison are added to
a project's totals, with one more FAIL where it has any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as t
from ..functions import vocabulary as v
from ..plans import fixtures
from ..plans.dialect import DUCK
from ..plans.registry import ask, plan, query
from ..plans.tables import written
from .fingerprint import compare, compare_projects, projects, said

STRUCT = r"^ *(?:private )?struct ([A-Za-z]+) *:"
SHEET, CALLED = r"\.(sheet|fullScreenCover)\(", r"\b([A-Z][A-Za-z0-9]*)\("
NOT_SHEETS = ("Binding", "Text", "Image", "Color", "Button", "VStack", "HStack", "ZStack")
#: Line rules: name, pattern, severity of a match, finding.
LINE_RULES = [
    ("stub", v.STUBS, "FAIL"), ("forced", v.FORCED, "warn"), ("unfinished wording", v.UNFINISHED, "FAIL"), ("version literal", v.VERSION_LITERAL, "warn"),
    ("network", v.NETWORK, "FAIL"), ("regional", v.REGIONAL, "FAIL"),
]
_ID = "[A-Za-z][A-Za-z0-9-]*"


def _count(d, c: str, pattern: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN {d.rx(c, pattern)} THEN 1 ELSE 0 END), 0) AS BIGINT)"


def _lines(d, name: str, source: str, key: str = "app, path") -> str:
    return f"{name} AS (SELECT {key}, pos, line FROM (SELECT {key}, {d.numbered('ls', 'line')} FROM (SELECT {key}, {t.lines(d, 'text')} AS ls FROM {source}) x) y)"


def bundle_grammar(d, bid: str) -> str:
    """The first rule an identifier breaks: missing, Name.Name, placeholder, format, segments."""
    return f"""CASE WHEN {bid} = '' THEN 'FAIL missing' WHEN {bid} = {d.rx_one(bid, "^([^.]*)")} || '.' || {d.rx_one(bid, "^([^.]*)")} THEN 'FAIL default name'
WHEN {d.rx(bid, "(?i)^com[.]yourcompany")} THEN 'FAIL placeholder' WHEN NOT {d.rx(bid, f"^{_ID}([.]{_ID})+$")} THEN 'FAIL format'
WHEN length({bid}) - length(replace({bid}, '.', '')) < 2 THEN 'warn segments' ELSE 'ok' END"""


def version_class(d, version: str) -> str:
    return f"CASE WHEN {version} LIKE '0.%' THEN 'FAIL' WHEN {version} = '' THEN 'warn' ELSE 'ok' END"


def length_band(size: str) -> str:
    """3,500 characters fit, up to 4,096 are too near the limit."""
    return f"CASE WHEN {size} <= 3500 THEN 'ok' WHEN {size} <= 4096 THEN 'warn' ELSE 'FAIL' END"


def gates(d) -> str:
    """CTEs up to ``checked(app, rule, severity, detail)``; needs those of ``projects`` and a table ``graded``."""
    n = lambda c: f"CAST({c} AS {d.text_type()})"
    scope = d.newest(f"CASE WHEN {d.rx('line', STRUCT)} THEN {d.rx_one('line', STRUCT)} END", "PARTITION BY app, path ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    near = lambda p: f"max(CASE WHEN {d.rx('line', p)} THEN 1 ELSE 0 END) OVER (PARTITION BY app, path ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"
    shared = "path LIKE '%Shared/%'"
    bare, other = "(^|[^A-Za-z_])ScrollView[(]", "(^|[^A-Za-z_])ScrollView[^A-Za-z_]"
    setting = lambda name: d.rx_sub(d.rx_sub("line", ".*= *", ""), "[;\\x22]", "")
    response, markup = "max(CASE WHEN path = 'APPLE_REVIEW_RESPONSE.txt' THEN text END)", r"(?m)[*][*]|```|^[0-9]+[.]|^[-•]"
    has = lambda c, p: f"max(CASE WHEN path = 'APP_STORE_METADATA.md' AND {d.rx(c, p)} THEN 1 ELSE 0 END)"
    graded = lambda good, bad, given="true": f"CASE WHEN {given} THEN CASE WHEN {good} THEN 'ok' ELSE '{bad}' END END"
    rows = [(f"'{name}'", graded(f"r{i} = 0", s), n(f"r{i}")) for i, (name, _, s) in enumerate(LINE_RULES)] + [
        ("'version'", version_class(d, "coalesce(version, '')"), "coalesce(version, '')"), ("'bundle id'", f"trim(substr({bundle_grammar(d, 'bid')} || '    ', 1, 4))", "bid"),
        ("'bundle id count'", "CASE WHEN bid <> '' AND n_bid < 2 THEN 'warn' END", n("n_bid")), ("'permissions'", graded("permission = 0", "FAIL"), "''"),
        ("'glyphs'", graded("glyph_file = 1", "FAIL"), n("glyphs")), ("'cover art'", graded("cover = 1", "warn"), "''"), ("'fingerprint'", graded("print_fails = 0", "FAIL"), n("print_fails")),
        ("'scroll width'", graded("strays IS NULL", "warn"), "coalesce(strays, '')"), ("'art speed'", graded("slow = 0", "FAIL"), "''"), ("'sheet background'", graded("torn IS NULL", "FAIL"), "coalesce(torn, '')"),
        ("'orientation'", graded("landscape = 0", "warn"), "''"), ("'labels'", graded("labels >= 20", "warn"), n("labels")), ("'fixed fonts'", graded("fixed <= 20", "warn"), n("fixed")),
        ("'preview'", "CASE WHEN root_view IS NULL OR view_path IS NULL THEN 'warn' WHEN preview = 1 THEN 'ok' ELSE 'FAIL' END", "coalesce(root_view, '')"),
        ("'requirements'", graded("spec = 1", "FAIL"), "''"), ("'response'", f"CASE WHEN response IS NULL THEN 'FAIL' ELSE {length_band('length(response)')} END", n("coalesce(length(response), 0)")),
        ("'response names the app'", graded("position(lower(split_part(app, chr(1), 1)) IN lower(response)) = 0", "FAIL", "response IS NOT NULL"), "''"), ("'response markup'", graded(f"NOT {d.rx('response', markup)}", "FAIL", "response IS NOT NULL"), "''"),
        ("'metadata file'", graded("meta = 1", "warn"), "''"), ("'note heading'", graded("note = 1", "FAIL", "meta = 1"), "''"), ("'support line'", graded("url = 1", "warn", "meta = 1"), "''"),
        ("'build facts'", graded("facts = 1", "warn", "meta = 1"), "''"), ("'saturated'", graded("saturated = 0", "warn"), "''")]
    counted = ", ".join([f"{_count(d, 'line', p)} AS r{i}" for i, (_, p, _) in enumerate(LINE_RULES)])
    return f"""{_lines(d, "src", "sources")},
{_lines(d, "cfg", "settings")},
line_counts AS (SELECT app, {counted}, {_count(d, "line", "accessibilityLabel")} AS labels, {_count(d, "line", "font[(]" + "[.]system[(]size:")} AS fixed,
  CAST(coalesce(sum(CASE WHEN {shared} AND {d.rx("line", v.SLOW_ART)} THEN 1 ELSE 0 END), 0) AS BIGINT) AS slow, CAST(coalesce(sum(CASE WHEN path LIKE '%Shared/Glyphs.swift' AND {d.rx("line", "^" + chr(92) + "s+case [a-z]")} THEN 1 ELSE 0 END), 0) AS BIGINT) AS glyphs FROM src GROUP BY app),
present AS (SELECT app, max(CASE WHEN path LIKE '%Shared/Glyphs.swift' THEN 1 ELSE 0 END) AS glyph_file, max(CASE WHEN path LIKE '%Shared/CoverArt.swift' THEN 1 ELSE 0 END) AS cover FROM sources GROUP BY app),
config AS (SELECT app, coalesce(min(CASE WHEN version_place = 1 THEN version END), '') AS version, coalesce(min(CASE WHEN id_place = 1 THEN bid END), '') AS bid, count(bid) AS n_bid, max(permission) AS permission, max(landscape) AS landscape FROM (
  SELECT *, CASE WHEN version IS NOT NULL THEN row_number() OVER (PARTITION BY app ORDER BY version IS NULL, pos) END AS version_place, CASE WHEN bid IS NOT NULL THEN row_number() OVER (PARTITION BY app ORDER BY bid IS NULL, pos) END AS id_place FROM (
    SELECT app, pos, CASE WHEN line LIKE '%MARKETING_VERSION%' THEN {setting('')} END AS version, CASE WHEN line LIKE '%PRODUCT_BUNDLE_IDENTIFIER%' THEN {setting('')} END AS bid, CASE WHEN {d.rx("line", v.PERMISSION)} THEN 1 ELSE 0 END AS permission, CASE WHEN line LIKE '%UIInterfaceOrientationLandscape%' THEN 1 ELSE 0 END AS landscape FROM cfg) x) y GROUP BY app),
scrolls AS (SELECT app, count(*) AS n, {d.joined("path", "', '", "path")} AS paths FROM (SELECT app, path FROM src GROUP BY app, path HAVING {_count(d, "line", bare)} > 0 AND sum(CASE WHEN {d.rx("line", other)} AND line NOT LIKE '%.horizontal%' THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN line LIKE '%frame(width: geo.size.width%' THEN 1 ELSE 0 END) = 0) x GROUP BY app),
scoped AS (SELECT app, path, pos, line, {scope} AS inside, {near(SHEET)} AS by_sheet, {near("WindowGroup")} AS by_window FROM src),
grounds AS (SELECT DISTINCT app, inside AS ground FROM scoped WHERE {shared} AND {d.rx("inside", "(Ground|Background)$")} AND line LIKE '%.drawingGroup()%'),
sheets AS (SELECT DISTINCT app, kind FROM (SELECT app, {d.each(d.rx_each("line", CALLED))} AS kind FROM scoped WHERE by_sheet = 1) x WHERE kind NOT IN ({", ".join(f"'{x}'" for x in NOT_SHEETS)})),
defined AS (SELECT app, inside AS kind, min(path) AS path FROM scoped WHERE {d.rx("line", STRUCT)} GROUP BY app, inside),
torn AS (SELECT app, {d.joined("kind", "', '", "kind")} AS kinds FROM (SELECT DISTINCT b.app, b.inside AS kind FROM (SELECT app, path, inside, {d.rx_one("line", "[.]background[(] *([A-Za-z]+)[(][)]")} AS ground FROM scoped WHERE {d.rx("line", "[.]background[(] *[A-Za-z]+[(][)]")} AND NOT {d.rx("line", STRUCT)}) b
  JOIN sheets s ON s.app = b.app AND s.kind = b.inside JOIN defined f ON f.app = b.app AND f.kind = b.inside AND f.path = b.path JOIN grounds g ON g.app = b.app AND g.ground = b.ground) x GROUP BY app),
entry_file AS (SELECT app, min(path) AS path FROM src WHERE line LIKE '%@main%' GROUP BY app),
root_view AS (SELECT app, name FROM (SELECT s.app, {d.rx_one("s.line", "([A-Z][A-Za-z0-9_]*)[(][)]")} AS name, row_number() OVER (PARTITION BY s.app ORDER BY s.pos) AS place FROM scoped s JOIN entry_file e ON e.app = s.app AND e.path = s.path WHERE s.by_window = 1 AND {d.rx("s.line", "[A-Z][A-Za-z0-9_]*[(][)]")}) x WHERE place = 1),
view_file AS (SELECT app, kind, min(path) AS path FROM (SELECT app, path, {d.rx_one("line", "struct ([A-Za-z0-9_]+)")} AS kind FROM src WHERE line LIKE '%struct %') x GROUP BY app, kind),
previews AS (SELECT app, path, max(CASE WHEN line LIKE '%#Preview%' THEN 1 ELSE 0 END) AS shown FROM src GROUP BY app, path),
docs AS (SELECT p.app, max(CASE WHEN path = 'REQUIREMENTS.md' THEN 1 ELSE 0 END) AS spec, max(CASE WHEN path = 'REQUIREMENTS.md' AND {d.rx("text", v.SATURATED)} THEN 1 ELSE 0 END) AS saturated, {response} AS response, max(CASE WHEN path = 'APP_STORE_METADATA.md' THEN 1 ELSE 0 END) AS meta,
  {has("text", "(?mi)^#+ .*(review(er)? note|notes for review)")} AS note, {has("text", "(?i)support url")} AS url, {has("text", "(?mi)^#+ .*(build facts|build date)")} AS facts FROM files f JOIN projects p ON p.root = f.root GROUP BY p.app),
every_ AS (SELECT p.app, c.version, coalesce(c.bid, '') AS bid, coalesce(c.n_bid, 0) AS n_bid, coalesce(c.permission, 0) AS permission, coalesce(c.landscape, 0) AS landscape, coalesce(l.slow, 0) AS slow, coalesce(l.labels, 0) AS labels, coalesce(l.fixed, 0) AS fixed, coalesce(l.glyphs, 0) AS glyphs,
  {", ".join(f"coalesce(l.r{i}, 0) AS r{i}" for i in range(len(LINE_RULES)))}, coalesce(x.glyph_file, 0) AS glyph_file, coalesce(x.cover, 0) AS cover, s.paths AS strays, k.kinds AS torn, r.name AS root_view, v.path AS view_path, coalesce(w.shown, 0) AS preview, o.spec, o.saturated, o.response, o.meta, o.note, o.url, o.facts, coalesce(f.n, 0) AS print_fails
  FROM projects p LEFT JOIN config c ON c.app = p.app LEFT JOIN line_counts l ON l.app = p.app LEFT JOIN present x ON x.app = p.app LEFT JOIN scrolls s ON s.app = p.app LEFT JOIN torn k ON k.app = p.app LEFT JOIN root_view r ON r.app = p.app LEFT JOIN view_file v ON v.app = p.app AND v.kind = r.name
  LEFT JOIN previews w ON w.app = v.app AND w.path = v.path LEFT JOIN docs o ON o.app = p.app LEFT JOIN (SELECT {said('app')} AS app, count(*) AS n FROM graded WHERE severity = 'FAIL' GROUP BY {said('app')}) f ON f.app = {said('p.app')}),
checked AS ({d.findings(rows, "every_")})"""


_ALL = f"WITH {fixtures.files()}, {compare(DUCK)}, {gates(DUCK)}"
_TOTALS = "SELECT app, " + ", ".join(f"CAST(sum(CASE WHEN severity = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{s.lower()}" for s in ("FAIL", "warn")) + ", max(CASE WHEN severity = 'FAIL' THEN 1 ELSE 0 END) AS exit_code FROM {} b GROUP BY app"


def check_projects(spark: SparkSession, files: DataFrame, graded: DataFrame | None = None) -> DataFrame:
    """``(app, rule, severity, detail)`` of all gates; the comparison's findings are counted in
    and, where they aren't ``graded`` yet, made first and written."""
    graded = written(compare_projects(spark, files)) if graded is None else graded
    return ask(spark, lambda d: f"WITH {projects(d)}, {gates(d)} SELECT {said('app')} AS app, rule, severity, detail FROM checked", files=files, graded=graded)


def project_totals(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Findings of gates and comparison by severity; any FAIL makes the exit code 1."""
    graded = written(compare_projects(spark, files))
    return ask(spark, lambda d: _TOTALS.format("both_"), both_=check_projects(spark, files, graded).unionByName(graded))


@plan(f"{_ALL} SELECT app, rule, severity, detail FROM checked")
def gate_findings(spark, sf_dir):
    return check_projects(spark, spark.sql(f"WITH {fixtures.files()} SELECT * FROM files"))


@plan(f"{_ALL} " + _TOTALS.format("(SELECT app, severity FROM checked UNION ALL SELECT app, severity FROM graded)"))
def gate_totals(spark, sf_dir):
    return project_totals(spark, spark.sql(f"WITH {fixtures.files()} SELECT * FROM files"))


@query
def gate_samples(d, most: int = 5):
    """The first lines that match each line rule."""
    tests = ", ".join(f"CASE WHEN {d.rx('line', p)} THEN '{name}' END" for name, p, _ in LINE_RULES)
    rules = f"array({tests})" if d.name == "spark" else f"[{tests}]"
    return f"""WITH {fixtures.files()}, {projects(d)}, {_lines(d, "src", "sources")}, hits AS (SELECT app, path, pos, line, {d.each(rules)} AS rule FROM src)
SELECT app, rule, path, CAST(pos + 1 AS BIGINT) AS line_number, substr({t.strip(d, "line")}, 1, 110) AS line FROM (SELECT *, row_number() OVER (PARTITION BY app, rule ORDER BY path, pos) AS place FROM hits WHERE rule IS NOT NULL) x WHERE place <= {most}"""


@query
def contrast_ratio(d):
    """Contrast of grey pairs by relative luminance, with the bands 4.5 (text), 1.5 and 1.2."""
    light = lambda c: f"CASE WHEN {c} / 255e0 <= 0.04045e0 THEN {c} / 255e0 / 12.92e0 ELSE pow(({c} / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END"
    pairs = fixtures.values("pairs", "front, back", [(0, 255), (255, 255), (118, 255), (119, 255), (40, 20), (200, 180)])
    return f"""WITH {pairs}, lit AS (SELECT front, back, {light("front")} AS a, {light("back")} AS b FROM pairs), r AS (SELECT front, back, (greatest(a, b) + 0.05e0) / (least(a, b) + 0.05e0) AS ratio FROM lit)
SELECT front, back, round(ratio, 4) AS ratio, CASE WHEN ratio >= 4.5e0 THEN 'text' WHEN ratio >= 1.5e0 THEN 'shape' WHEN ratio >= 1.2e0 THEN 'faint' ELSE 'none' END AS band FROM r"""
