"""Message routing, slicing, draft assembly and the largest attachment."""

from __future__ import annotations

from ..plans import fixtures as f
from ..plans.registry import query

INLINE, SLICE = 300, 3900
LEAD, TAIL, EMPTY = "[message ", "", "nothing to read in this message"  # before the number, after the line, in place of a missing text


def rendered(d, chat: int = 5, inbox: str = "inbox", lead: str = LEAD, tail: str = TAIL, empty: str = EMPTY) -> str:
    """CTEs ``rendered(update_id, message_id, line)`` and ``spilled(path, text)`` of
    ``updates`` and ``photos``: messages of one chat as the line its reader gets.  The largest
    photo counts (no size is 0, the first of equals); long or several-lined texts go to a file
    and leave a pointer with the first 80 characters of their first line; a message without
    any part is explained."""
    path = lambda name: f"'{inbox}/' || {name}"
    number = f"CAST(message_id AS {d.text_type()})"
    first = f"substr({d.rx_one('text', '^[^' + chr(92) + 'n]*', 0)}, 1, 80)"
    inline = f"length(text) <= {INLINE} AND NOT contains(text, chr(10))"
    return f"""own AS (SELECT update_id, message_id, coalesce(nullif(text, ''), caption, '') AS text, file_id, file_name FROM updates WHERE message_id IS NOT NULL AND chat = {chat}),
biggest AS (SELECT message_id, file_id FROM (SELECT message_id, file_id, row_number() OVER (PARTITION BY message_id ORDER BY coalesce(file_size, 0) DESC, pos) AS place FROM photos) x WHERE place = 1),
parts AS (SELECT o.update_id, o.message_id, o.text, CASE WHEN b.file_id IS NOT NULL THEN 'photo: ' || {path(f"CAST(o.message_id AS {d.text_type()}) || '_photo'")} END AS photo, CASE WHEN o.file_id IS NOT NULL THEN 'file: ' || {path(f"CAST(o.message_id AS {d.text_type()}) || '_' || coalesce(o.file_name, CAST(o.message_id AS {d.text_type()}) || '_file')")} END AS file FROM own o LEFT JOIN biggest b ON b.message_id = o.message_id),
said AS (SELECT update_id, message_id, text, photo, file, CASE WHEN text = '' THEN NULL WHEN {inline} THEN text ELSE 'long message starting «' || {first} || '», full text: ' || {path(number + " || '.txt'")} END AS words FROM parts),
rendered AS (SELECT update_id, message_id, '{lead}' || {number} || '] ' || CASE WHEN coalesce(photo, file, words) IS NULL THEN '{empty}' ELSE concat_ws(' · ', photo, file, words) END || '{tail}' AS line FROM said),
spilled AS (SELECT {path(number + " || '.txt'")} AS path, text FROM parts WHERE text <> '' AND NOT ({inline}))"""


def _updates() -> str:
    return f"{f.values('updates', 'update_id, message_id, chat, text, caption, file_id, file_name', f.UPDATES)}, {f.values('photos', 'message_id, pos, file_id, file_size', f.PHOTOS)}"


@query
def rendered_messages(d):
    return f"WITH {_updates()}, {rendered(d)} SELECT update_id, message_id, line FROM rendered"


@query
def spilled_messages(d):
    return f"WITH {_updates()}, {rendered(d)} SELECT path, text FROM spilled"


@query
def dropped_updates(d, chat: int = 5):
    """What the chat filter leaves out, by reason."""
    return f"WITH {_updates()} SELECT CASE WHEN message_id IS NULL THEN 'no message' ELSE 'foreign chat' END AS reason, count(*) AS n FROM updates WHERE message_id IS NULL OR chat <> {chat} GROUP BY CASE WHEN message_id IS NULL THEN 'no message' ELSE 'foreign chat' END"


@query
def attachment_names(d):
    """A name without a dot takes the ending of the remote path."""
    remote = f.values("remote", "name, path", [("7_photo", "photos/f1.jpg"), ("8_plan.pdf", "docs/f2.bin"), ("9_file", "docs/none")])
    ending = d.rx_one("path", "([.][^./]*)$")
    return f"WITH {remote} SELECT name, CASE WHEN contains(name, '.') THEN name ELSE name || {ending} END AS saved FROM remote"


@query
def route_inline_or_file(d, inline: int = 300):
    first = d.rx_one("text", "^[^\\n]*", 0)
    return f"SELECT conv_id, turn, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN length(text) <= {inline} AND NOT contains(text, chr(10)) THEN 'inline' ELSE 'file' END AS route, CASE WHEN coalesce(text, '') = '' THEN 'message without text' WHEN length(text) <= {inline} AND NOT contains(text, chr(10)) THEN text ELSE substr({first}, 1, 80) END AS shown FROM conversations"


@query
def fixed_size_chunks(d, size: int = SLICE):
    """Texts in slices of ``size`` characters, which joined give the text again."""
    parts = d.seq("0", f"CAST(floor((length(text) - 1) / {size}) AS INT)")
    return f"SELECT doc_id, CAST(i AS INT) AS part, length(substr(text, CAST(i * {size} + 1 AS INT), {size})) AS n_chars, substr(text, CAST(i * {size} + 1 AS INT), {size}) AS slice FROM (SELECT doc_id, text, {d.each(parts)} AS i FROM documents WHERE length(text) > 0) x"


@query
def draft_assembly(d):
    """A user turn opens a draft, the turns that follow belong to it; a turn that asks a
    question closes it, and what comes before the next user turn belongs to none."""
    upto, before = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""WITH parts AS (SELECT conv_id, turn, role, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn {upto}) AS draft FROM conversations),
closed AS (SELECT conv_id, turn, text, draft, coalesce(sum(CASE WHEN role <> 'user' AND contains(text, '?') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, draft ORDER BY turn {before}), 0) AS closings FROM parts)
SELECT conv_id, CAST(draft AS BIGINT) AS draft, count(*) AS n_parts, CAST(length({d.joined("text", "chr(10)", "turn")}) AS BIGINT) AS n_chars FROM closed WHERE draft > 0 AND closings = 0 GROUP BY conv_id, draft"""


@query
def largest_by_size(d):
    """The longest turn of each conversation; the first of equals."""
    return "SELECT conv_id, turn, size FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY length(coalesce(text, '')) DESC, turn) AS place FROM conversations) x WHERE place = 1"
