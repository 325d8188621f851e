"""Text expressions as SQL fragments; every one takes a dialect and a column."""

from __future__ import annotations

from .vocabulary import EN_SUFFIXES, HTML_BREAK, HTML_DROPPED, HTML_TAG, LINE_END, RARE_LINE_END, RU_SUFFIXES, SPACES, STOP

WORD = "[A-Za-zА-Яа-яЁё0-9]+"


def camel(d, c: str) -> str:
    """A space at camelCase borders."""
    return d.rx_sub(d.rx_sub(c, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")


def raw_words(d, c: str) -> str:
    return d.rx_all(camel(d, c), WORD)


def fold(d, c: str) -> str:
    """A lower-cased word without its longest listed ending, if three letters stay."""
    cut = lambda s: d.rx_sub(c, f"^(.{{3,}}?)(?:{'|'.join(s)})$", "$1")
    return f"CASE WHEN {d.rx(c, '[а-яё]')} THEN {cut(RU_SUFFIXES)} ELSE {cut(EN_SUFFIXES)} END"


def kept(d, c: str) -> str:
    """Whether a lower-cased word is neither a stop word nor a single non-digit."""
    listed = ", ".join(f"'{w}'" for w in STOP)
    return f"(length({c}) > 1 OR {d.rx(c, '^[0-9]$')}) AND {c} NOT IN ({listed})"


def tokens(d, table: str, key: str, text: str = "text") -> str:
    """``(key, term)``: a row for each token of a table's texts."""
    return (f"SELECT {key}, {fold(d, 'w')} AS term FROM (SELECT {key}, lower(r) AS w FROM (SELECT {key}, {d.each(raw_words(d, f'coalesce({text}, {chr(39) * 2})'))} AS r FROM {table}) x) y WHERE {kept(d, 'w')}")


def term_counts(d, table: str, key: str, text: str = "text") -> str:
    """``(key, term, f)``: words are counted first, so that a text's equal words are folded once."""
    words = f"SELECT {key}, lower(r) AS w, count(*) AS c FROM (SELECT {key}, {d.each(raw_words(d, f'coalesce({text}, {chr(39) * 2})'))} AS r FROM {table}) x GROUP BY {key}, lower(r)"
    return f"SELECT {key}, {fold(d, 'w')} AS term, CAST(sum(c) AS BIGINT) AS f FROM ({words}) y WHERE {kept(d, 'w')} GROUP BY {key}, {fold(d, 'w')}"


def strip(d, c: str) -> str:
    """Without white space (of Unicode) at both ends."""
    return d.trimmed(c, SPACES)


def lines(d, c: str) -> str:
    """Lines of a text, without an empty one after the last line end; an empty text has none.
    Texts with line feeds alone, which is most of them, are split at that character."""
    split = f"CASE WHEN {d.rx(c, RARE_LINE_END)} THEN {d.rx_split(c, LINE_END)} ELSE {d.split(c, 'chr(10)')} END"
    return f"CASE WHEN coalesce({c}, '') = '' THEN {d.none()} ELSE {d.without_last_empty(split)} END"


def spaced_words(d, c: str) -> str:
    """Lower-cased runs of letters, digits and apostrophes (ASCII)."""
    return d.rx_all(f"lower({c})", "[a-z0-9\\x27]+")


def shingles(d, arr: str, n: int = 5) -> str:
    """Word n-grams of an array of words; none if it is shorter."""
    grams = d.map(d.seq("0", f"{d.size(arr)} - {n}"), "i", d.text(d.sliced(arr, "CAST(i + 1 AS INT)", str(n)), "' '"))
    return grams


def sentences(d, c: str, least: int = 8) -> str:
    """Normalised sentences of at least ``least`` words."""
    parts = d.split(f"replace({d.rx_sub(f'lower({c})', '([.!?])[ \\t\\r\\n]+', '$1@NL@')}, '@NL@', chr(1))", "chr(1)")
    normal = d.map(parts, "s", d.text(d.rx_all("s", "[a-z0-9\\x27]+"), "' '"))
    return d.keep(normal, "s", f"length(s) - length(replace(s, ' ', '')) >= {least - 1}")


def html_lines(d, c: str) -> str:
    """Lines of a page: scripts and styles out, block ends to line breaks, tags out, entities decoded."""
    x = d.rx_sub(d.rx_sub(c, HTML_DROPPED, ""), HTML_BREAK, "@NL@")
    x = f"replace({d.rx_sub(x, HTML_TAG, '')}, '@NL@', chr(10))"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return d.split(x, "chr(10)")
