"""One declarative plan, two engines: the few spellings in which Spark SQL and the
SQL of the correctness oracle differ.  ``SPARK`` is what runs; ``DUCK`` is the twin."""

from __future__ import annotations


class Spark:
    name = "spark"

    def rx_all(self, c, p):
        return f"regexp_extract_all({c}, r'{p}', 0)"

    def rx_each(self, c, p, group=1):
        return f"regexp_extract_all({c}, r'{p}', {group})"

    def rx_split(self, c, p):
        return f"split({c}, r'{p}')"

    def text_type(self):
        return "STRING"

    def none(self):
        return "CAST(array() AS ARRAY<STRING>)"

    def findings(self, rows, source, key="app"):
        """A query with a row for each of ``(rule, severity, detail)`` whose severity isn't null, of each row of ``source``: one read of it."""
        made = ", ".join(f"named_struct('rule', {r}, 'severity', {s}, 'detail', {x})" for r, s, x in rows)
        return f"SELECT {key}, r_.rule, r_.severity, r_.detail FROM (SELECT {key}, explode(array({made})) AS r_ FROM {source}) f_ WHERE r_.severity IS NOT NULL"

    def newest(self, expr, window):
        """The last value that isn't null up to a row of a window."""
        return f"last({expr}, true) OVER ({window})"

    def total(self, arr):
        return f"aggregate({arr}, 0e0, (a_, x_) -> a_ + x_)"

    def rx_one(self, c, p, group=1):
        return f"regexp_extract({c}, r'{p}', {group})"

    def rx_sub(self, c, p, r):
        return f"regexp_replace({c}, r'{p}', '{r}')"

    def rx(self, c, p):
        return f"({c} RLIKE r'{p}')"

    def each(self, arr):
        return f"explode({arr})"

    def keep(self, arr, var, body):
        return f"filter({arr}, {var} -> {body})"

    def map(self, arr, var, body):
        return f"transform({arr}, {var} -> {body})"

    def seq(self, lo, hi):
        """Integers from lo to hi, none if hi is below lo."""
        return f"filter(sequence({lo}, greatest({lo}, {hi})), i_ -> i_ <= {hi})"

    def split(self, c, sep):
        return f"split({c}, {sep})"

    def size(self, arr):
        return f"size({arr})"

    def joined(self, expr, sep, order):
        return f"listagg({expr}, {sep}) WITHIN GROUP (ORDER BY {order})"

    def sliced(self, arr, start, n):
        return f"slice({arr}, {start}, {n})"

    def text(self, arr, sep):
        return f"array_join({arr}, {sep})"

    def trimmed(self, c, chars):
        """Without any of ``chars`` at both ends."""
        return f"btrim({c}, '{chars}')"

    def without_last_empty(self, arr):
        """An array of strings without its last one if that is empty."""
        return f"transform(array({arr}), a_ -> CASE WHEN element_at(a_, -1) = '' THEN slice(a_, 1, size(a_) - 1) ELSE a_ END)[0]"

    def seconds(self, c):
        return f"unix_timestamp(CAST({c} AS TIMESTAMP))"

    def numbered(self, arr, key):
        """A row for each element with its place from 0, in a subquery's select list."""
        return f"posexplode({arr}) AS (pos, {key})"


class Duck(Spark):
    name = "duck"

    def rx_all(self, c, p):
        return f"regexp_extract_all({c}, '{p}')"

    def rx_each(self, c, p, group=1):
        return f"regexp_extract_all({c}, '{p}', {group})"

    def rx_split(self, c, p):
        return f"regexp_split_to_array({c}, '{p}')"

    def text_type(self):
        return "VARCHAR"

    def none(self):
        return "CAST([] AS VARCHAR[])"

    def findings(self, rows, source, key="app"):
        made = ", ".join(f"{{'rule': {r}, 'severity': {s}, 'detail': {x}}}" for r, s, x in rows)
        return f"SELECT {key}, r_.rule, r_.severity, r_.detail FROM (SELECT {key}, unnest([{made}]) AS r_ FROM {source}) f_ WHERE r_.severity IS NOT NULL"

    def newest(self, expr, window):
        return f"last_value({expr} IGNORE NULLS) OVER ({window})"

    def total(self, arr):
        return f"list_sum({arr})"

    def rx_one(self, c, p, group=1):
        return f"regexp_extract({c}, '{p}', {group})"

    def rx_sub(self, c, p, r):
        return f"regexp_replace({c}, '{p}', '{r.replace('$', chr(92))}', 'g')"

    def rx(self, c, p):
        return f"regexp_matches({c}, '{p}')"

    def each(self, arr):
        return f"unnest({arr})"

    def keep(self, arr, var, body):
        return f"list_filter({arr}, lambda {var}: {body})"

    def map(self, arr, var, body):
        return f"list_transform({arr}, lambda {var}: {body})"

    def seq(self, lo, hi):
        return f"generate_series({lo}, {hi})"

    def split(self, c, sep):
        return f"string_split({c}, {sep})"

    def size(self, arr):
        return f"len({arr})"

    def joined(self, expr, sep, order):
        return f"string_agg({expr}, {sep} ORDER BY {order})"

    def sliced(self, arr, start, n):
        return f"{arr}[{start}:({start}) + ({n}) - 1]"

    def text(self, arr, sep):
        return f"array_to_string({arr}, {sep})"

    def trimmed(self, c, chars):
        return f"trim({c}, '{chars}')"

    def without_last_empty(self, arr):
        return f"list_transform([{arr}], lambda a_: CASE WHEN a_[-1] = '' THEN a_[1:len(a_) - 1] ELSE a_ END)[1]"

    def seconds(self, c):
        return f"CAST(floor(epoch({c})) AS BIGINT)"

    def numbered(self, arr, key):
        return f"unnest({arr}) AS {key}, generate_subscripts({arr}, 1) - 1 AS pos"


SPARK, DUCK = Spark(), Duck()
