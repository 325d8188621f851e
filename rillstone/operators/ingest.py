"""Pages to lines, lines to Markdown, Markdown to chunks (a state machine as windows)."""

from __future__ import annotations

from ..functions import text as t
from ..functions.vocabulary import HTML_BREAK, HTML_DROPPED, HTML_TAG, JUNK_LINES, JUNK_PARTS
from ..plans.registry import ask, query


def clean_lines(d) -> str:
    """CTEs up to ``clean(page_id, pos, line)``: blank, junk and repeated neighbours out."""
    junk = ", ".join(f"'{x}'" for x in JUNK_LINES)
    parts = " AND ".join(f"NOT contains(line, '{x}')" for x in JUNK_PARTS)
    return f"""lines AS (SELECT page_id, pos, {t.strip(d, 'raw')} AS line FROM (SELECT page_id, {d.numbered(t.html_lines(d, 'html'), 'raw')} FROM pages) x),
fit AS (SELECT page_id, pos, line FROM lines WHERE line <> '' AND line NOT IN ({junk}) AND {parts}),
clean AS (SELECT page_id, pos, line FROM (SELECT page_id, pos, line, lag(line) OVER (PARTITION BY page_id ORDER BY pos) AS before FROM fit) x WHERE before IS NULL OR before <> line)"""


@query
def html_clean_lines(d):
    return f"WITH {clean_lines(d)} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INT) AS n, line FROM clean"


@query
def html_spec_summary(d):
    name = d.rx_sub(d.rx_sub("title", "[ -]", "_"), "[^A-Za-z0-9_]", "")
    return f"""WITH {clean_lines(d)}, spec AS (SELECT page_id, count(*) AS n_lines, CAST(sum(CASE WHEN {d.rx("line", "^[0-9]+[.] ")} THEN 1 ELSE 0 END) AS BIGINT) AS n_screens, {d.joined("line", "chr(10)", "pos")} AS body FROM clean GROUP BY page_id)
SELECT page_id, n_lines, n_screens, CAST(length(body) AS BIGINT) AS n_chars, {name} AS spec_name FROM (SELECT *, {d.rx_one("body", "^[^\\n]*", 0)} AS title FROM spec) x"""


def markdown_lines(d) -> str:
    """CTE ``md(doc, pos, line)``: pages as Markdown (headings and bullets from tags)."""
    x = d.rx_sub("html", HTML_DROPPED + "|<!--.*?-->", "")
    x = d.rx_sub(x, "<h1[^>]*>", "@NL@# ")
    x = d.rx_sub(x, "<h[23][^>]*>", "@NL@## ")
    x = d.rx_sub(x, "<li[^>]*>", "@NL@- ")
    x = d.rx_sub(x, HTML_BREAK, "@NL@@NL@")
    x = f"replace({d.rx_sub(x, HTML_TAG, '')}, '@NL@', chr(10))"
    return f"md AS (SELECT page_id AS doc, pos, raw AS line FROM (SELECT page_id, {d.numbered(d.split(x, 'chr(10)'), 'raw')} FROM pages) x)"


def chunked(d, source: str = "md", least: int = 40) -> str:
    """CTEs from ``source(doc, pos, line)`` to ``chunks(doc, n, heading, text)``.

    Fences are kept and never split; headings, table borders, top-level bullets and
    blank lines outside bullets split; short chunks go before numbering."""
    w = "PARTITION BY doc ORDER BY pos"
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    last = (lambda e, f: f"last({e}, true) OVER ({w} {f})") if d.name == "spark" else (lambda e, f: f"last_value({e} IGNORE NULLS) OVER ({w} {f})")
    fence = d.rx("line", "^[ \\t]*```")
    level = f"length({d.rx_one('line', '^(#+)', 1)})"
    steps = [f"c0 AS (SELECT doc, pos, line, {fence} AS fence, sum(CASE WHEN {fence} THEN 1 ELSE 0 END) OVER ({w} {upto}) AS fs FROM {source})"]
    steps.append(f"""c1 AS (SELECT *, NOT fence AND fs % 2 = 0 AS vis, NOT fence AND fs % 2 = 0 AND {d.rx("line", "^#{1,4}[ \\t]+")} AS head,
  NOT fence AND fs % 2 = 0 AND {d.rx("line", "^[ \\t]*[|]")} AS tab, NOT fence AND fs % 2 = 0 AND {d.rx("line", "^- ")} AS bullet, NOT fence AND fs % 2 = 0 AND {t.strip(d, "line")} = '' AS blank FROM c0)""")
    steps.append(f"c2 AS (SELECT *, coalesce({last('CASE WHEN vis THEN tab END', before)}, false) AS pt FROM c1)")
    steps.append("c3 AS (SELECT *, tab AND NOT pt AS ts, vis AND NOT head AND NOT tab AND pt AS te FROM c2)")
    steps.append(f"c4 AS (SELECT *, coalesce({last('CASE WHEN bullet THEN 1 WHEN head OR ts OR te THEN 0 END', upto)}, 0) AS bm FROM c3)")
    steps.append("c5 AS (SELECT *, blank AND bm <> 1 AS pb FROM c4)")
    h = [f"sum(CASE WHEN head AND {level} < {k} THEN 1 ELSE 0 END) OVER ({w} {upto}) AS r{k}" for k in (1, 2, 3, 4)]
    steps.append(f"c6 AS (SELECT *, sum(CASE WHEN head OR ts OR te OR bullet OR pb THEN 1 ELSE 0 END) OVER ({w} {upto}) AS gid, {', '.join(h)} FROM c5)")
    names = []
    for k in (1, 2, 3, 4):
        part = f"PARTITION BY doc, r{k} ORDER BY pos {upto}"
        e = f"CASE WHEN head AND {level} = {k} THEN {t.strip(d, d.rx_sub('line', '^#+', ''))} END"
        names.append(f"last({e}, true) OVER ({part}) AS h{k}" if d.name == "spark" else f"last_value({e} IGNORE NULLS) OVER ({part}) AS h{k}")
    steps.append(f"c7 AS (SELECT doc, pos, line, gid, head, pb, {', '.join(names)} FROM c6)")
    steps.append(f"c8 AS (SELECT doc, gid, concat_ws(' > ', max(h1), max(h2), max(h3), max(h4)) AS heading, {t.strip(d, d.joined('line', 'chr(10)', 'pos'))} AS text FROM c7 WHERE NOT head AND NOT pb GROUP BY doc, gid)")
    steps.append(f"chunks AS (SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY gid) AS INT) - 1 AS n, heading, text FROM c8 WHERE length(text) >= {least})")
    return ",\n".join(steps)


def chunk_markdown(spark, lines, least: int = 40):
    """``(id, source, heading, text, n)`` of ``lines(doc, pos, line)``; ids count from 1."""
    return ask(spark, lambda d: f"WITH {chunked(d, 'lines_', least)} SELECT doc || '#' || CAST(n + 1 AS STRING) AS id, doc AS source, heading, text, n + 1 AS n FROM chunks", lines_=lines)


@query
def chunk_documents(d):
    return f"WITH {markdown_lines(d)}, {chunked(d)} SELECT doc AS page_id, n, CAST(doc AS STRING) || '#' || CAST(n AS STRING) AS chunk_id, heading, text FROM chunks".replace("AS STRING", "AS VARCHAR" if d.name == "duck" else "AS STRING")


@query
def chunk_heading_path(d):
    return f"WITH {markdown_lines(d)}, {chunked(d, least=5)} SELECT heading, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM chunks GROUP BY heading"


@query
def chunk_size_stats(d):
    """Chunks, their upper median length and the longest.  Lengths are counted first, so the
    one window without a key sorts distinct lengths only."""
    return f"""WITH {markdown_lines(d)}, {chunked(d)}, sizes AS (SELECT length(text) AS size, count(*) AS c FROM chunks GROUP BY length(text)),
upto AS (SELECT size, sum(c) OVER (ORDER BY size) AS upto, sum(c) OVER () AS n FROM sizes)
SELECT CAST(max(n) AS BIGINT) AS n_chunks, CAST(min(CASE WHEN upto > floor(n / 2) THEN size END) AS BIGINT) AS upper_median, CAST(max(size) AS BIGINT) AS longest FROM upto"""
