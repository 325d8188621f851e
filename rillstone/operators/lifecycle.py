"""The life of a job: status, dispatch, answers, tasks, digest, lessons, journal, logs.

Input: ``jobs(job, lane, state, body, minute)``; a job's title is its first line without the
marks before it.  Configuration is ``config(key, value)``.
"""

from __future__ import annotations

from ..functions import text as t
from ..plans import fixtures as f
from ..plans.registry import query

STATES = ("pending", "running", "done", "failed", "waiting")
MARK = "FINGERPRINT ASSIGNED"


def title(d, body: str = "body") -> str:
    """The first line without leading marks."""
    return d.rx_sub(d.rx_one(body, "^[^\\n]*", 0), "^#\\s*", "")


def file_name(d, c: str) -> str:
    """Blanks and dashes to underlines, everything else but letters and digits out."""
    return d.rx_sub(f"translate({c}, ' -', '__')", "[^A-Za-z0-9_]", "")


def _config() -> str:
    return f.values("config", "name, setting", f.CONFIG)


@query
def queue_status(d):
    """Jobs of each state of the build lane and their titles, by name."""
    states = " UNION ALL ".join(f"SELECT '{s}' AS state" for s in STATES)
    return f"""WITH {f.jobs()}, states AS ({states}), named AS (SELECT state, job, {title(d)} AS title FROM jobs WHERE lane = 'build')
SELECT s.state, count(n.job) AS n, coalesce({d.joined("n.title", "', '", "n.job")}, '') AS titles FROM states s LEFT JOIN named n ON n.state = s.state GROUP BY s.state"""


def dispatch(d) -> str:
    """CTEs up to ``actions(lane, job, place, action)``: the oldest pending jobs of each lane
    into its free places (6 and, in the fast lane, 2 where nothing is configured); a paused
    lane does nothing; two or more jobs of a lane other than the fast one that lack the mark
    go to the distributor first, and nothing else starts."""
    return f"""{_config()},
lanes AS (SELECT lane, sum(CASE WHEN state = 'running' THEN 1 ELSE 0 END) AS busy, sum(CASE WHEN state = 'pending' AND body NOT LIKE '%{MARK}%' AND lane <> 'fast' THEN 1 ELSE 0 END) AS unmarked FROM jobs GROUP BY lane),
limits AS (SELECT l.lane, l.busy, l.unmarked, coalesce(CAST(c.setting AS INT), CASE WHEN l.lane = 'fast' THEN 2 ELSE 6 END) AS places, coalesce(p.setting, 'false') = 'true' AS paused FROM lanes l LEFT JOIN config c ON c.name = 'parallel.' || l.lane LEFT JOIN config p ON p.name = 'paused.' || l.lane),
waiting_ AS (SELECT lane, job, body, row_number() OVER (PARTITION BY lane ORDER BY minute, job) AS place FROM jobs WHERE state = 'pending'),
actions AS (SELECT w.lane, w.job, CAST(w.place AS INT) AS place, CASE WHEN m.unmarked >= 2 THEN 'distribute' ELSE 'start' END AS action FROM waiting_ w JOIN limits m ON m.lane = w.lane
  WHERE NOT m.paused AND m.places > m.busy AND CASE WHEN m.unmarked >= 2 THEN w.body NOT LIKE '%{MARK}%' ELSE w.place <= m.places - m.busy END)"""


@query
def dispatch_actions(d):
    return f"WITH {f.jobs()}, {dispatch(d)} SELECT lane, job, place, action FROM actions"


@query
def answered_jobs(d):
    """Waiting jobs whose name an answer gives (the first of equals): pending again, the
    answer in the second line instead of an older one."""
    bodies = f"waiting_ AS (SELECT job, body, {d.rx_one('body', '^[^' + chr(92) + 'n]*', 0)} AS head, translate({title(d)}, ' -', '__') AS name FROM jobs WHERE state = 'waiting')"
    rest = d.rx_sub(d.rx_sub("substr(w.body, length(w.head) + 1)", "\\n# ANSWER:[^\\n]*", ""), "^\\n", "")
    return f"""WITH {f.jobs()}, {f.values("answers", "name, answer", f.ANSWERS)}, {bodies}, first_ AS (SELECT name, min(job) AS job FROM waiting_ GROUP BY name)
SELECT w.job, 'pending' AS state, w.head || chr(10) || '# ANSWER: ' || a.answer || chr(10) || {rest} AS body FROM answers a JOIN first_ x ON x.name = a.name JOIN waiting_ w ON w.job = x.job"""


@query
def parsed_tasks(d):
    """Header and body of fast tasks, their workflow, and the first folder that holds their project."""
    bases = f.values("bases", "base, priority, project", f.PROJECTS)
    get = lambda name: t.strip(d, d.rx_one("body", f"(?m)^# {name}:[ ]*(.*)$"))
    rest = d.rx_sub("body", "(?m)^# (TYPE|PROJECT):.*(\\n|\\z)", "")
    return f"""WITH {f.jobs()}, {bases}, tasks AS (SELECT job, {get("TYPE")} AS kind, {get("PROJECT")} AS project, {t.strip(d, rest)} AS request FROM jobs WHERE lane = 'fast'),
found AS (SELECT project, base FROM (SELECT project, base, row_number() OVER (PARTITION BY project ORDER BY priority) AS place FROM bases) x WHERE place = 1)
SELECT k.job, k.kind, k.project, k.request, CASE k.kind WHEN 'reject' THEN 'information' WHEN 'review' THEN 'answer' WHEN 'recolor' THEN 'palette' ELSE '' END AS workflow,
CASE k.kind WHEN 'reject' THEN 'Reply to rejection' WHEN 'review' THEN 'Reply to reviewer' WHEN 'recolor' THEN 'Recolor' WHEN 'fix' THEN 'Targeted fix' ELSE 'Task' END AS title, b.base || '/' || k.project AS folder FROM tasks k LEFT JOIN found b ON b.project = k.project"""


def lessons(d) -> str:
    """CTEs up to ``lessons(job, lesson)``: failed lines without colour codes, mark and values."""
    plain = d.rx_sub("line", "\\x1B\\[[0-9;]*m", "")
    return f"""gate_lines AS (SELECT job, pos, {plain} AS line FROM report),
lessons AS (SELECT job, lesson FROM (SELECT job, {t.strip(d, d.rx_sub(d.rx_sub("line", "^\\s*FAIL\\s*", ""), "=.*", ""))} AS lesson FROM gate_lines WHERE line LIKE '%FAIL%' AND line NOT LIKE '%TOTAL%') x WHERE lesson <> '')"""


def _report() -> str:
    return f.values("report", "job, pos, line", f.LESSON_LINES)


@query
def lesson_ranking(d):
    """Lessons by frequency, equal ones in reverse order of their text; three or more ask for a rule."""
    return f"""WITH {_report()}, {lessons(d)}, counted AS (SELECT lesson, count(*) AS n FROM lessons GROUP BY lesson)
SELECT lesson, n, n >= 3 AS repeats, CAST(row_number() OVER (ORDER BY n DESC, lesson DESC) AS INT) AS place FROM counted"""


@query
def digest_text(d, hours: int = 16):
    """The digest of the last hours as a text: built, failed, waiting, running, pending and
    repeating lessons, each only if there is one; no row if nothing happened."""
    kept = f"state NOT IN ('done', 'failed') OR minute >= {f.NOW - 60 * hours}"
    cell = lambda s, what: f"max(CASE WHEN state = '{s}' THEN {what} END)"
    return f"""WITH {f.jobs()}, {_report()}, {lessons(d)}, counted AS (SELECT lesson, count(*) AS n FROM lessons GROUP BY lesson HAVING count(*) >= 3),
named AS (SELECT state, job, {title(d)} AS title FROM jobs WHERE lane = 'build' AND ({kept})),
states AS (SELECT state, count(*) AS n, {d.joined("title", "chr(10) || '  - '", "job")} AS titles, min(title) AS first_title FROM named GROUP BY state),
cells AS (SELECT sum(n) AS total, {cell("done", f"'Built: ' || CAST(n AS {d.text_type()}) || chr(10) || '  - ' || titles")} AS done, {cell("failed", f"'Failed: ' || CAST(n AS {d.text_type()}) || chr(10) || '  - ' || titles")} AS failed,
  {cell("waiting", f"'Waiting: ' || CAST(n AS {d.text_type()}) || chr(10) || '  - ' || titles")} AS waiting, {cell("running", "'Running: ' || first_title")} AS running, {cell("pending", f"'Pending: ' || CAST(n AS {d.text_type()})")} AS pending FROM states),
repeating AS (SELECT 'Repeating:' || chr(10) || {d.joined(f"'  - ' || CAST(n AS {d.text_type()}) || 'x ' || lesson", "chr(10)", "n DESC, lesson DESC")} AS said FROM counted HAVING count(*) > 0)
SELECT concat_ws(chr(10), 'Digest', done, failed, waiting, running, pending, (SELECT max(said) FROM repeating)) AS digest FROM cells WHERE total > 0"""


@query
def proposal_counts(d):
    """Proposed rules, and how many nobody adopted in their first line."""
    return f"WITH {f.values('proposals', 'day, body', f.PROPOSALS)} SELECT count(*) AS total, CAST(sum(CASE WHEN {d.rx_one('body', '^[^' + chr(92) + 'n]*', 0)} LIKE '%ADOPTED%' THEN 0 ELSE 1 END) AS BIGINT) AS open FROM proposals"


@query
def edit_journal(d):
    """New and changed sources of projects that have a snapshot; read-only projects, hidden
    folders and deletions aside."""
    current, snap = f.values("current_", "project, path, text", f.CURRENT), f.values("snapshot_", "project, path, text", f.SNAPSHOT)
    name = d.rx_one("c.project", "([^/]+)$")
    return f"""WITH {current}, {snap}, known AS (SELECT DISTINCT project FROM snapshot_)
SELECT {name} AS project, c.path, CASE WHEN s.path IS NULL THEN 'new' ELSE 'changed' END AS change FROM current_ c JOIN known k ON k.project = c.project LEFT JOIN snapshot_ s ON s.project = c.project AND s.path = c.path
WHERE c.project NOT LIKE '/reference/%' AND {d.rx("c.path", "[.](swift|kt)$")} AND NOT {d.rx("c.path", "(^|/)[.]")} AND (s.path IS NULL OR s.text <> c.text)"""


@query
def stage_progress(d):
    """Builds: whole minutes, whether they wait for an answer (fewer than 8 sources or no
    start file), and eight cells of progress at 34 sources."""
    return f"""WITH {f.values("stages", "job, stage, seconds, n_files, started", [(j, s, m * 61, n, o) for j, s, m, n, o in f.STAGES])}
SELECT job, stage, CAST(floor(seconds / 60) AS BIGINT) AS minutes, n_files < 8 OR NOT started AS asks, repeat('#', CAST(least(8, floor(n_files * 8 / 34)) AS INT)) || repeat('.', 8 - CAST(least(8, floor(n_files * 8 / 34)) AS INT)) AS bar FROM stages"""


@query
def stuck_panes(d):
    """A restart is due where a screen that asks is the same twice in a row; a restart, and a
    screen that doesn't ask or differs, starts over."""
    return f"""WITH {f.values("panes", "minute, last_line, shown", [(m, x, s) for m, x, s in f.PANE])}, signs AS (SELECT minute, CASE WHEN {d.rx("last_line", "(?i)do you want|proceed|[(]y/n[)]")} THEN md5(last_line) END AS sign FROM panes),
runs AS (SELECT minute, sign, sum(CASE WHEN sign = before THEN 0 ELSE 1 END) OVER (ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT minute, sign, lag(sign) OVER (ORDER BY minute) AS before FROM signs) x)
SELECT minute, sign FROM (SELECT minute, sign, row_number() OVER (PARTITION BY run ORDER BY minute) AS place FROM runs) y WHERE sign IS NOT NULL AND place % 2 = 0"""


@query
def days_to_digest(d):
    """Days whose journal is newer than what was made of it."""
    return f"WITH {f.values('days', 'day, written, made', f.DIGESTED)} SELECT day FROM days WHERE made IS NULL OR written > made"


def log_tail(d, source: str, most: int = 200_000, keep: int = 100) -> str:
    """CTEs up to ``kept(log, pos, line)``: of logs above ``most`` bytes the last lines, others whole."""
    size = "octet_length(line)" if d.name == "spark" else "strlen(line)"
    return f"sized AS (SELECT log, pos, line, sum({size} + 1) OVER (PARTITION BY log) AS bytes, row_number() OVER (PARTITION BY log ORDER BY pos DESC) AS back FROM {source}), kept AS (SELECT log, pos, line FROM sized WHERE bytes <= {most} OR back <= {keep})"


@query
def truncated_logs(d):
    """Documents as logs: those above 20,000 bytes keep their last 100 lines."""
    return f"WITH source_ AS (SELECT doc_id AS log, {d.numbered('ls', 'line')} FROM (SELECT doc_id, {t.lines(d, 'text')} AS ls FROM documents) x), {log_tail(d, 'source_', 20_000)} SELECT log, count(*) AS n_lines, CAST(min(pos) AS BIGINT) AS first_line, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM kept GROUP BY log"


@query
def spec_files(d):
    """Cleaned pages as queue entries: the file's name from the first line, pages without one out."""
    from .ingest import clean_lines

    return f"""WITH {clean_lines(d)}, spec AS (SELECT page_id, {d.joined("line", "chr(10)", "pos")} AS body FROM clean GROUP BY page_id), named AS (SELECT page_id, body, {file_name(d, d.rx_one("body", "^[^" + chr(92) + "n]*", 0))} AS name FROM spec)
SELECT page_id, 'pending/' || CAST(page_id AS {d.text_type()}) || '_' || name || '.md' AS path, name, {title(d)} AS title FROM named WHERE name <> ''"""
