"""Job lifecycle: counts by state, FIFO dispatch, lessons, digest, latest state, diffs, retention."""

from __future__ import annotations

from ..plans.registry import query

STATE = "CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'running' ELSE 'done' END"


@query
def state_counts(d):
    return f"WITH states AS (SELECT 'pending' AS state UNION ALL SELECT 'running' UNION ALL SELECT 'done' UNION ALL SELECT 'failed' UNION ALL SELECT 'waiting') SELECT s.state, count(j.o_orderkey) AS n FROM states s LEFT JOIN (SELECT o_orderkey, {STATE} AS state FROM orders) j ON s.state = j.state GROUP BY s.state"


@query
def fifo_dispatch_capacity(d, capacity: int = 6):
    """The oldest pending jobs of each lane, as many as its capacity, whatever runs elsewhere
    (lanes: priorities; the gates on running and unassigned jobs are in ``dispatch_actions``)."""
    return f"""WITH jobs AS (SELECT o_orderkey AS job, o_orderpriority AS lane, o_orderdate AS since, {STATE} AS state FROM orders)
SELECT lane, CAST(place AS INT) AS place, job FROM (SELECT job, lane, row_number() OVER (PARTITION BY lane ORDER BY since, job) AS place FROM jobs WHERE state = 'pending') q WHERE place <= {capacity}"""


@query
def lessons_frequency(d):
    """Lessons by frequency; only distinct lessons are ranked in one task."""
    kind = d.rx_one("props", '"k": *([0-9]+)', 1)
    return f"SELECT lesson, n, n >= 3 AS repeats, CAST(row_number() OVER (ORDER BY n DESC, lesson DESC) AS INT) AS place FROM (SELECT event_type || ' ' || {kind} AS lesson, count(*) AS n FROM events GROUP BY event_type || ' ' || {kind}) x"


@query
def digest_16h(d):
    """What changed in the last 16 hours of the log, by kind; nothing if nothing did."""
    return f"WITH edge AS (SELECT max({d.seconds('ts')}) AS now FROM events), recent AS (SELECT e.event_type, e.event_id FROM events e CROSS JOIN edge WHERE {d.seconds('e.ts')} >= edge.now - 57600) SELECT event_type AS section, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'repeating' ELSE 'single' END AS mark FROM recent GROUP BY event_type HAVING count(*) > 0"


@query
def latest_state(d):
    if d.name == "duck":
        return "SELECT user_id, event_type AS state, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) x WHERE place = 1"
    return "SELECT user_id, e.event_type AS state, e.event_id FROM (SELECT user_id, max_by(struct(event_type, event_id), struct(ts, event_id)) AS e FROM events GROUP BY user_id) x"


@query
def snapshot_diff(d):
    """New and changed paths against a snapshot; deletions are not reported.  Snapshot: texts of even ids, every tenth altered."""
    return """WITH snap AS (SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 2 = 0)
SELECT c.doc_id, CASE WHEN s.doc_id IS NULL THEN 'new' ELSE 'changed' END AS change FROM documents c LEFT JOIN snap s ON c.doc_id = s.doc_id WHERE s.doc_id IS NULL OR s.text <> c.text"""


@query
def retention_keep_40(d):
    return "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) x WHERE place > 40"


@query
def stuck_detector(d):
    """Restarts due: the same signature at two sightings in a row, five minutes apart or more; a
    restart starts over, so of a run of equal signatures every second sighting counts."""
    w = "PARTITION BY user_id ORDER BY ts, event_id"
    return f"""WITH seen AS (SELECT user_id, event_id, event_type, ts, {d.seconds('ts')} AS s, lag({d.seconds('ts')}) OVER ({w}) AS prior_s, lag(event_type) OVER ({w}) AS before FROM events),
runs AS (SELECT *, sum(CASE WHEN before = event_type THEN 0 ELSE 1 END) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM seen),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS place FROM runs)
SELECT user_id, event_id FROM placed WHERE place % 2 = 0 AND s - prior_s >= 300"""


@query
def quiet_gap(d):
    return f"SELECT user_id, event_id, CAST(floor((s - prior_s) / 60) AS BIGINT) AS minutes FROM (SELECT user_id, event_id, {d.seconds('ts')} AS s, lag({d.seconds('ts')}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior_s FROM events) x WHERE s - prior_s >= 600"


@query
def event_windows(d):
    """Extension: counts and sums by ten-minute windows of event time."""
    return f"SELECT event_type, CAST(floor({d.seconds('ts')} / 600) AS BIGINT) * 600 AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type, CAST(floor({d.seconds('ts')} / 600) AS BIGINT) * 600"
