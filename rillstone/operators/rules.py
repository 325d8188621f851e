"""Rule gates: a table of line rules, presence and threshold checks, graded findings."""

from __future__ import annotations

from ..functions import text as t
from ..functions import vocabulary as v
from ..plans.registry import query
from .gates import bundle_grammar

#: name, pattern (of a line), what a matching line must hold (any of them; in lower case), severity,
#: least number of lines that make a finding.
RULES = [
    ("stub text", v.STUBS, ("lorem ipsum", "placeholder text", "coming soon", "not implemented", "todo:", "fixme"), "FAIL", 1),
    ("force unwrap", v.FORCED, ("!",), "warn", 1),
    ("version literal", "[0-9]+[.][0-9]+[.][0-9]+", (".",), "warn", 1),
    ("network address", "(?i)https?://|www[.]", ("://", "www."), "FAIL", 1),
    ("mail address", "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", ("@",), "FAIL", 1),
    ("license line", "(?i)licen[sc]e", ("licen",), "ok", 1),
    ("markup", "[|]", ("|",), "warn", 3),
    ("repeated marks", "[*#%&$]{3}", ("*", "#", "%", "&", "$"), "warn", 2),
]


def lines(d) -> str:
    return f"lines AS (SELECT doc_id, {d.numbered('ls', 'line')} FROM (SELECT doc_id, {t.lines(d, 'text')} AS ls FROM documents) x)"


def matches(d, pattern: str, needs: tuple, line: str = "line", low: str = "low") -> str:
    """Whether a line fits; lines without one of the literals are told by those alone."""
    held = " OR ".join(f"contains({line if n == n.upper() else low}, '{n}')" for n in needs)
    return f"(({held}) AND {d.rx(line, pattern)})"


def findings(d) -> str:
    """CTEs up to ``found(doc_id, rule, severity, n_hits, first_line)``: matching lines, not
    occurrences.  A text that lacks all literals of a rule is never tested by it, line by line."""
    held = ", ".join(f"({' OR '.join(f'contains(low_, {chr(39)}{x}{chr(39)})' for x in needs)}) AS has_{i}" for i, (_, _, needs, _, _) in enumerate(RULES))
    has = ", ".join(f"has_{i}" for i in range(len(RULES)))
    rows = [(f"'{n}'", f"CASE WHEN has_{i} AND {matches(d, p, needs)} THEN '{s}' END", str(k)) for i, (n, p, needs, s, k) in enumerate(RULES)]
    some = " OR ".join(f"has_{i}" for i in range(len(RULES)))
    return f"""asked AS (SELECT doc_id, text, {held} FROM (SELECT doc_id, text, lower(text) AS low_ FROM documents) x), lines AS (SELECT doc_id, {has}, {d.numbered('ls', 'line')} FROM (SELECT doc_id, {has}, {t.lines(d, 'text')} AS ls FROM asked WHERE {some}) x),
lowered AS (SELECT doc_id, {has}, pos, line, lower(line) AS low FROM lines), hits AS ({d.findings(rows, 'lowered', 'doc_id, pos')}), found AS (SELECT doc_id, rule, severity, count(*) AS n_hits, min(pos) AS first_line FROM hits GROUP BY doc_id, rule, severity, detail HAVING count(*) >= detail)"""


@query
def rule_findings(d):
    return f"WITH {findings(d)} SELECT doc_id, rule, severity, n_hits, CAST(first_line AS BIGINT) AS first_line FROM found"


@query
def rule_severity_totals(d):
    return f"WITH {findings(d)} SELECT doc_id, " + ", ".join(f"CAST(sum(CASE WHEN severity = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{s.lower()}" for s in ("FAIL", "warn", "ok")) + ", CASE WHEN sum(CASE WHEN severity = 'FAIL' THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END AS exit_code FROM found GROUP BY doc_id"


@query
def length_band_check(d):
    return "SELECT doc_id, length(text) AS n_chars, CASE WHEN length(text) <= 3500 THEN 'ok' WHEN length(text) <= 4096 THEN 'warn' ELSE 'FAIL' END AS severity FROM documents"


@query
def threshold_checks(d):
    """Lines that hold a word against a least (20) and a greatest (20) number."""
    return f"WITH {lines(d)} SELECT doc_id, n_labels, CASE WHEN n_labels >= 20 THEN 'ok' ELSE 'warn' END AS labels, n_fixed, CASE WHEN n_fixed > 20 THEN 'warn' ELSE 'ok' END AS fixed FROM (SELECT doc_id, CAST(sum(CASE WHEN {d.rx('line', '(?i)the')} THEN 1 ELSE 0 END) AS BIGINT) AS n_labels, CAST(sum(CASE WHEN {d.rx('line', '[0-9]')} THEN 1 ELSE 0 END) AS BIGINT) AS n_fixed FROM lines GROUP BY doc_id) x"


@query
def format_grammar_check(d):
    """Identifier grammar, first rule that fits; identifiers are page hosts."""
    host = d.rx_one("url", "^[a-z]+://([^/]+)", 1)
    return f"SELECT page_id, host, {bundle_grammar(d, 'host')} AS verdict FROM (SELECT page_id, {host} AS host FROM pages) x"


@query
def context_after_match(d):
    """Matching lines and the three that follow each."""
    return f"WITH {lines(d)} SELECT doc_id, CAST(pos AS BIGINT) AS pos, {t.strip(d, 'line')} AS line FROM (SELECT doc_id, pos, line, max(CASE WHEN {d.rx('line', '(?i)licen[sc]e')} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS near FROM lines) x WHERE near = 1"


@query
def enclosing_scope(d):
    """For each matching line the last heading-like line (one that starts with a capital and ends with a stop) above it."""
    last = "last(CASE WHEN head THEN pos END, true)" if d.name == "spark" else "last_value(CASE WHEN head THEN pos END IGNORE NULLS)"
    return f"WITH {lines(d)}, marked AS (SELECT doc_id, pos, {d.rx('line', '^[A-Z][a-z]+[.]$')} AS head, {d.rx('line', '[0-9]')} AS hit FROM lines) SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(coalesce(scope, -1) AS BIGINT) AS scope FROM (SELECT *, {last} OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM marked) x WHERE hit"
