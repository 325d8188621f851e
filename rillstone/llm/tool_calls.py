"""Chat formatting with linked tool calls, in DataFrame functions only.

A turn's text is read as JSON where it is a JSON object:

* a call: ``{"call": {"id": .., "name": .., "arguments": {..}, "after": [ids]}}``;
* a result: ``{"result": {"id": .., "content": ..}}``;
* anything else is a plain message.

Calls and results of a conversation are hash-joined by identifier.  A result comes
after its call and a call after the results of the calls in ``after``: each turn gets
the ``level`` of its longest chain of dependencies, so ``(level, turn)`` is a
topological order of a conversation (no conversation is gathered in a task to number
it).  Arguments are checked against a table of schemas, and every turn is written as
canonical JSON: keys sorted, no white space.

``problems`` of a turn, sorted: ``orphan`` (a result without a call), ``unanswered``
(a call without a result), ``duplicate`` (an identifier used by several calls or
several results of a conversation), ``no id``, ``no name``, ``unknown tool``, ``missing:<name>``,
``unexpected:<name>``, ``type:<name>``, ``cycle`` (it depends on itself; a turn that
only comes after a circle has no such problem).  Dependencies inside a circle don't
count for levels.  Chains of any length are followed: runs of turns with one dependency
each by path doubling, turns with several in a round for each of them on a chain.

Edge cases: null texts are empty messages; null roles stay null in the JSON; invalid
JSON and JSON that isn't such an object is a message; repeated rows are kept; turns
without a conversation id are never linked; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Settled

SCHEMAS = [("search", "query", "string", True), ("search", "limit", "number", False), ("calculate", "expression", "string", True), ("fetch", "url", "string", True)]


def schema_table(spark, rows=SCHEMAS) -> DataFrame:
    return spark.createDataFrame(list(rows), "tool string, parameter string, type string, required boolean")


def _levels(edges: DataFrame) -> DataFrame:
    """``(row, level)`` of every row that can be placed, that is not in or after a circle
    of ``edges(row, before)``: the length of the longest chain before it."""
    counts = edges.groupBy("row").agg(F.count("*").alias("n"), F.min("before").alias("to"))
    roots = edges.select(F.col("before").alias("row")).distinct().join(counts, "row", "left_anti")
    # Rows with one row before them point beyond all such rows, twice as far each round.
    jumps = Settled(counts.where("n = 1").select("row", "to", F.lit(1).cast("long").alias("far"))).df
    for _ in range(jumps.count().bit_length() + 1):
        beyond = jumps.select(F.col("row").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        both = Settled(jumps.join(beyond, "to", "left").select("row", F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved"))).df
        jumps = both.drop("moved")
        if not both.where("moved").take(1):
            break
    # Rows with several: placed when all rows they point to are.
    several = edges.join(counts.where("n > 1").select("row"), "row").join(jumps.select(F.col("row").alias("before"), "to", "far"), "before", "left")
    several = Settled(several.select("row", F.coalesce("to", "before").alias("to"), (F.coalesce("far", F.lit(0)) + 1).alias("far"))).df
    placed = Settled(roots.select("row", F.lit(0).cast("long").alias("level"))).df
    at = lambda table: table.join(placed.select(F.col("row").alias("to"), "level"), "to", "left")
    while True:
        new = Settled(at(several).groupBy("row").agg(F.max(F.col("level") + F.col("far")).alias("level"), F.count_if(F.col("level").isNull()).alias("open")).where("open = 0").select("row", "level")).df
        if not new.take(1):
            break
        placed, several = Settled(placed.unionByName(new)).df, Settled(several.join(new.select("row"), "row", "left_anti")).df
    rest = at(jumps).where("level IS NOT NULL").select("row", (F.col("level") + F.col("far")).alias("level"))
    return Settled(placed.unionByName(rest)).df


def _circles(edges: DataFrame) -> DataFrame:
    """``(row, before)``: pairs that reach each other, by doubling the paths."""
    reach, known = Settled(edges.distinct()).df, -1
    while (size := reach.count()) != known:
        known = size
        further = reach.select(F.col("row"), F.col("before").alias("via")).join(reach.select(F.col("row").alias("via"), "before"), "via").select("row", "before")
        reach = Settled(reach.unionByName(further).distinct()).df
    back = reach.select(F.col("before").alias("row"), F.col("row").alias("before"))
    return Settled(reach.join(back, ["row", "before"])).df


def format_chats(conversations: DataFrame, schemas: DataFrame) -> DataFrame:
    """Per turn: ``conv_id, turn, role, kind, call_id, partner, level, valid, problems, json``."""
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    variant = F.try_parse_json(F.when(F.ltrim("text").startswith("{"), F.col("text")))
    turns = turns.withColumn("v", variant)
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    name, call, answer = get("$.call.name", "string"), get("$.call", "variant"), get("$.result", "variant")
    kind = F.when(call.isNotNull() & F.schema_of_variant(call).startswith("OBJECT"), "call").when(answer.isNotNull() & F.schema_of_variant(answer).startswith("OBJECT"), "result").otherwise("message")
    read = turns.select(F.monotonically_increasing_id().alias("row"), "conv_id", "turn", "role", "text", kind.alias("kind"), name.alias("name"),
                        F.when(kind == "call", get("$.call.id", "string")).when(kind == "result", get("$.result.id", "string")).alias("call_id"),
                        F.when(kind == "call", F.coalesce(F.to_json(get("$.call.arguments", "variant")), F.lit("{}"))).alias("arguments"),
                        F.when(kind == "call", get("$.call.after", "array<string>")).alias("after"),
                        F.when(kind == "result", F.coalesce(F.to_json(get("$.result.content", "variant")), F.lit("null"))).alias("content"))
    read = Settled(read).df
    linked = read.where("kind <> 'message' AND call_id IS NOT NULL AND conv_id IS NOT NULL").select("row", "conv_id", "kind", "call_id", "turn", "name", "arguments", "after")
    ends = linked.groupBy("conv_id", "call_id").agg(F.count_if(F.col("kind") == "call").alias("calls"), F.count_if(F.col("kind") == "result").alias("results"),
                                                    F.min(F.when(F.col("kind") == "call", F.struct("turn", "row"))).alias("call"), F.min(F.when(F.col("kind") == "result", F.struct("turn", "row"))).alias("result"))
    ends = Settled(ends).df

    # Levels: edges run from a row to one that must come first.
    first = ends.where("call IS NOT NULL AND result IS NOT NULL")
    by_id = linked.where("kind = 'result'").join(first.select("conv_id", "call_id", F.col("call.row").alias("before")), ["conv_id", "call_id"]).select("row", "before")
    needs = linked.where("kind = 'call'").select("row", "conv_id", F.explode("after").alias("call_id"))
    by_need = needs.join(first.select("conv_id", "call_id", F.col("result.row").alias("before")), ["conv_id", "call_id"]).select("row", "before")
    edges = Settled(by_id.unionByName(by_need).distinct()).df
    levels = edges.select("row", F.lit(0).cast("long").alias("level")).where("false")
    cyclic = levels.select("row")
    if edges.take(1):
        levels = _levels(edges)
        stuck = edges.join(levels, "row", "left_anti").join(levels.select(F.col("row").alias("before")), "before", "left_anti").select("row", "before")
        if stuck.take(1):
            pairs = _circles(stuck)
            cyclic = pairs.select("row").distinct()
            inside = pairs.where("row <> before")
            free = edges.where("row <> before").join(inside, ["row", "before"], "left_anti")
            levels = _levels(Settled(free).df)

    # Arguments against the schemas.
    calls = read.where("kind = 'call'").select("row", "name", "arguments")
    given = calls.select("row", "name", F.explode(F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))).alias("parameter"), "arguments")
    value = F.element_at(F.from_json("arguments", "map<string,variant>"), F.col("parameter"))
    shape = F.schema_of_variant(value)
    type_ = (F.when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object").otherwise("null"))
    given = given.select("row", "name", "parameter", type_.alias("is"))
    known = schemas.select(F.col("tool").alias("name")).distinct().withColumn("known", F.lit(True))
    expected = schemas.select(F.col("tool").alias("name"), "parameter", "type", "required")
    bad = given.join(known, "name").join(expected, ["name", "parameter"], "left").select("row", F.when(F.col("type").isNull(), F.concat(F.lit("unexpected:"), "parameter")).when(F.col("type") != F.col("is"), F.concat(F.lit("type:"), "parameter")).alias("problem"))
    asked = calls.join(expected.where("required"), "name").select("row", "parameter")
    missing = asked.join(given.select("row", "parameter"), ["row", "parameter"], "left_anti").select("row", F.concat(F.lit("missing:"), "parameter").alias("problem"))
    unknown = calls.where("name IS NOT NULL").join(known, "name", "left_anti").select("row", F.lit("unknown tool").alias("problem"))
    circle = cyclic.select("row", F.lit("cycle").alias("problem"))
    faults = bad.where("problem IS NOT NULL").unionByName(missing).unionByName(unknown).unionByName(circle).groupBy("row").agg(F.collect_set("problem").alias("faults"))

    out = read.join(ends.select("conv_id", "call_id", "calls", "results", F.col("call.turn").alias("call_turn"), F.col("result.turn").alias("result_turn")), ["conv_id", "call_id"], "left")
    out = out.join(levels, "row", "left").join(faults, "row", "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    loose = F.array_compact(F.array(
        F.when(~(F.col("kind") == "message") & F.col("call_id").isNull(), "no id"),
        F.when(is_call & F.col("name").isNull(), "no name"),
        F.when(is_result & F.col("call_id").isNotNull() & (F.coalesce("calls", F.lit(0)) == 0), "orphan"),
        F.when(is_call & F.col("call_id").isNotNull() & (F.coalesce("results", F.lit(0)) == 0), "unanswered"),
        F.when((is_call & (F.col("calls") > 1)) | (is_result & (F.col("results") > 1)), "duplicate")))
    problems = F.array_sort(F.concat(loose, F.coalesce("faults", F.array().cast("array<string>"))))
    text = lambda c: F.coalesce(F.to_json(F.col(c).cast("variant")), F.lit("null"))  # noqa: E731  a JSON string
    after = F.when(F.col("after").isNotNull(), F.concat(F.lit('"after":'), F.to_json("after"), F.lit(","))).otherwise("")
    json = (F.when(is_call, F.concat(F.lit("{"), after, F.lit('"arguments":'), "arguments", F.lit(',"id":'), text("call_id"), F.lit(',"name":'), text("name"), F.lit(',"role":'), text("role"), F.lit("}")))
            .when(is_result, F.concat(F.lit('{"content":'), "content", F.lit(',"id":'), text("call_id"), F.lit(',"role":'), text("role"), F.lit("}")))
            .otherwise(F.concat(F.lit('{"content":'), F.coalesce(F.to_json(F.coalesce("text", F.lit("")).cast("variant")), F.lit('""')), F.lit(',"role":'), text("role"), F.lit("}"))))
    return out.select("conv_id", "turn", "role", "kind", "call_id", F.when(is_call, F.col("result_turn")).when(is_result, F.col("call_turn")).alias("partner"),
                      F.coalesce("level", F.lit(0)).cast("int").alias("level"), (F.size(problems) == 0).alias("valid"), problems.alias("problems"), json.alias("json"))


def report(conversations: DataFrame) -> DataFrame:
    """Every turn of the table."""
    return format_chats(conversations, schema_table(conversations.sparkSession))
