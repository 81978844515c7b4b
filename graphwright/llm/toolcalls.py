"""Chat formatting by tool-call linking, in DataFrame operations only.

Calls and results are linked by a hash join on (conversation, identifier).  Calls
are ordered topologically: a call's level is 0 without dependencies, else one
more than the highest level it depends on, found by rounds of joins; calls on a
cycle or with a missing dependency keep a null level.  Arguments are validated
against a schema table (tool, argument, type, required) by the type they have in
their JSON, and each call is serialised with its result as canonical JSON: keys in
order at every depth, no white space, the escapes of JSON for ``"``, ``\\`` and all
characters below U+0020, numbers as Spark's variant writes them.

:func:`read_calls` reads a conversation in one of two ways.  One that holds markup (JSON
calls of an assistant or JSON results of a tool, :func:`parse_messages`) is read by its markup
alone.  A chat without any is read as tool use by :func:`turns_as_calls`: a user turn calls
the tool ``reply``, the next turn of the assistant is its result, a system turn calls
``configure`` and all user turns of its conversation depend on it.

Defined results: a call without result has a null ``result_turn`` and is
serialised with ``null``; a result without call is an orphan and gives no row; of
several results the one of the least turn (then text) is linked; of several
dependencies a level needs all; repeated calls stay separate rows; null
conversation, turn or identifier never links; null and empty texts are values of
their own (``null`` and ``""``); arguments that are no JSON object, hold a key twice or
exceed a variant are ``null`` and have the error ``arguments``; JSON with a key twice is no
markup; an empty table gives no rows; other columns are ignored.  A key of very many rows
(repeated calls, the turns of a hot conversation that depend on one call) is spread over
several places, to which its one fact is sent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.plans.durable import durable
from graphwright.plans.skew import attach, salted

#: (tool, argument, type, required): production schemas of the tools that chats are read as.
SCHEMAS = (
    ("reply", "prompt", "string", True), ("reply", "turn", "integer", True), ("reply", "min_chars", "integer", False),
    ("configure", "prompt", "string", True), ("configure", "turn", "integer", True),
)
_MAP = "map<string,variant>"


def json_string(value: Column) -> Column:
    """Canonical JSON of a string; null is ``null``."""
    wrapped = F.to_json(F.struct(value.alias("x")))
    return F.when(value.isNull(), "null").otherwise(F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))


def _key(conv: Column, call: Column) -> Column:
    """What links: conversation and identifier; null where either is."""
    return F.when(conv.isNotNull() & call.isNotNull(), F.struct(conv.alias("conv_id"), call.alias("call_id")))


def _text_of(value: Column) -> Column:
    """The string that a variant holds; null for all other types."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _object_of(value: Column) -> Column:
    """Canonical JSON of an object, also of one that is given as a JSON string; else null."""
    inner = F.try_parse_json(_text_of(value))
    either = F.when(F.schema_of_variant(value).startswith("OBJECT"), value).when(F.schema_of_variant(inner).startswith("OBJECT"), inner)
    return F.to_json(either)


def _marked(messages: DataFrame) -> DataFrame:
    """Messages with ``calls`` (array of variants) or ``result_of`` (identifier) where their text is markup."""
    base = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    looks = F.col("role").isin("assistant", "tool") & F.ltrim("text").startswith("{")
    parsed = base.withColumn("json", F.when(looks, F.try_parse_json("text")))
    calls = F.when(F.col("role") == "assistant", F.try_variant_get("json", "$.tool_calls", "array<variant>"))
    result = F.when(F.col("role") == "tool", _text_of(F.try_variant_get("json", "$.tool_call_id", "variant")))
    return parsed.withColumns({"calls": calls, "result_of": result})


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and dependencies from messages whose text is JSON.

    An assistant text ``{"tool_calls": [{"id", "name", "arguments": {...}, "depends_on": [...]}]}``
    makes calls; a tool text ``{"tool_call_id", "content"}`` makes a result, whose content is a
    string or any JSON.  Texts that are not such JSON make nothing.
    """
    base = _marked(messages)
    get = lambda name, kind="variant": F.try_variant_get("c", f"$.{name}", kind)
    calls = base.where("calls is not null").select("conv_id", "turn", F.explode("calls").alias("c"))
    calls = calls.select(
        "conv_id", "turn", _text_of(get("id")).alias("call_id"), _text_of(get("name")).alias("tool"),
        _object_of(get("arguments")).alias("arguments"), get("depends_on", "array<string>").alias("needs"),
    )
    links = calls.select("conv_id", "call_id", F.explode("needs").alias("needs"))
    content = F.try_variant_get("json", "$.content", "variant")
    results = base.where("result_of is not null").select(
        "conv_id", "turn", F.col("result_of").alias("call_id"), F.when(F.schema_of_variant(content) == "VOID", None).otherwise(F.coalesce(_text_of(content), F.to_json(content))).alias("content")
    )
    return calls.drop("needs"), results, links


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and dependencies of a chat without markup; see the module's docstring."""
    base = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    arguments = F.concat(F.lit('{"prompt":'), json_string(F.col("text")), F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"))
    tool = F.when(F.col("role") == "system", "configure").otherwise("reply")
    calls = base.where("role in ('user', 'system')").select(
        "conv_id", "turn", F.concat(F.substring("role", 1, 1), "turn").alias("call_id"), tool.alias("tool"), arguments.alias("arguments")
    )
    results = base.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("u"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    users = base.where("role = 'user' and turn is not null and conv_id is not null").select("conv_id", F.concat(F.lit("u"), "turn").alias("call_id")).distinct()
    first = base.where("role = 'system' and turn is not null and conv_id is not null").groupBy("conv_id").agg(F.min("turn").alias("t"))
    sizes = users.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    first = durable(first.join(sizes, "conv_id").select("conv_id", F.concat(F.lit("s"), "t").alias("needs"), "n"), "heads")
    links = attach(users, first, "conv_id", "n").where("needs is not null")
    return calls, results, links


def read_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and dependencies: conversations with markup by :func:`parse_messages`, the others by :func:`turns_as_calls`."""
    marked = _marked(messages).where("conv_id is not null and (calls is not null or result_of is not null)")
    marked = durable(marked.select(F.col("conv_id").alias("__conv")).distinct(), "marked")
    if marked.isEmpty():
        return turns_as_calls(messages)
    here = messages["conv_id"] == F.col("__conv")
    one, two = parse_messages(messages.join(marked, here, "left_semi")), turns_as_calls(messages.join(marked, here, "left_anti"))
    return tuple(a.unionByName(b) for a, b in zip(one, two, strict=True))


def levels(calls: DataFrame, links: DataFrame) -> DataFrame:
    """``(key, level)`` of the distinct calls that can be ordered.

    Round by round the calls all of whose dependencies have a level get the next
    one; the rounds are as many as the longest chain and the work of a round is
    proportional to the links still open.
    """
    nodes = durable(calls.select(_key(F.col("conv_id"), F.col("call_id")).alias("key")).where("key is not null").distinct(), "calls")
    waiting = links.select(_key(F.col("conv_id"), F.col("call_id")).alias("key"), _key(F.col("conv_id"), F.col("needs")).alias("needs")).distinct()
    waiting = durable(waiting.where("needs is not null").join(nodes, "key", "left_semi"), "links")
    level = durable(nodes.join(waiting.select("key").distinct(), "key", "left_anti").withColumn("level", F.lit(0)), "level")
    found, turn = level, 0
    while not waiting.isEmpty() and not level.isEmpty():
        turn += 1
        # One row for every call that others wait for, with how many do.
        asked = waiting.groupBy("needs").agg(F.count(F.lit(1)).alias("n"))
        done = durable(asked.join(level.select(F.col("key").alias("needs"), F.lit(True).alias("done")), "needs"), "done")
        left = durable(attach(waiting, done, "needs", "n").where("done is null").select("key", "needs"), "links")
        ready = waiting.select("key").distinct().join(left.select("key").distinct(), "key", "left_anti")
        level = durable(ready.withColumn("level", F.lit(turn)), "level")
        found, waiting = found.unionByName(level), left
    return found


def _typed(kind: str, value: Column) -> Column:
    """Whether a variant is of a JSON schema type."""
    shape = F.schema_of_variant(value)
    whole = shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | shape.rlike(r"^DECIMAL\(\d+,0\)$")
    return {
        "string": shape == "STRING", "integer": whole, "number": whole | shape.isin("DOUBLE", "FLOAT") | shape.startswith("DECIMAL"),
        "boolean": shape == "BOOLEAN", "array": shape.startswith("ARRAY"), "object": shape.startswith("OBJECT"),
    }[kind]


def argument_errors(arguments: Column, tool: Column, schemas=SCHEMAS) -> Column:
    """Comma-joined problems of a call: unknown tool, no argument object, missing, mistyped and unknown arguments, in schema order."""
    tools = sorted({s[0] for s in schemas})
    held = F.try_variant_get(F.try_parse_json(arguments), "$", _MAP)
    problems = [F.when(~F.coalesce(tool.isin(tools), F.lit(False)), F.lit("tool")), F.when(held.isNull(), F.lit("arguments"))]
    for name, argument, kind, required in schemas:
        here = F.map_contains_key(held, argument)
        bad = F.when(~here, F.lit(f"missing:{argument}") if required else F.lit(None).cast("string")).when(
            ~F.coalesce(_typed(kind, F.element_at(held, argument)), F.lit(False)), F.lit(f"type:{argument}")
        )
        problems.append(F.when((tool == name) & held.isNotNull(), bad))
    for name in tools:
        known = F.array(*[F.lit(s[1]) for s in schemas if s[0] == name])
        extra = F.transform(F.array_sort(F.array_except(F.map_keys(held), known)), lambda k: F.concat(F.lit("unknown:"), k))
        problems.append(F.when((tool == name) & (F.size(extra) > 0), F.array_join(extra, ",")))
    return F.concat_ws(",", *problems)


def canonical(arguments: Column, tool: Column, call_id: Column, content: Column) -> Column:
    """Canonical JSON of a call and its result; ``arguments`` is the JSON of an object."""
    body = F.coalesce(F.to_json(F.try_parse_json(arguments)), F.lit("null"))
    return F.concat(F.lit('{"arguments":'), body, F.lit(',"id":'), json_string(call_id), F.lit(',"name":'), json_string(tool), F.lit(',"result":'), json_string(content), F.lit("}"))


def link_calls(calls: DataFrame, results: DataFrame, links: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """``(conv_id, call_turn, call_id, tool, level, result_turn, valid, errors, json)``, one row per call."""
    keyed = calls.withColumns({"key": _key(F.col("conv_id"), F.col("call_id")), "__row": F.monotonically_increasing_id()})
    first = results.withColumn("key", _key(F.col("conv_id"), F.col("call_id"))).where("key is not null").groupBy("key").agg(F.min(F.struct("turn", "content")).alias("r"))
    names = keyed.where("key is not null").select("key").distinct()
    facts = names.join(first, "key", "left").join(levels(calls, links), "key", "left")
    linked = salted(keyed.where("key is not null"), facts, "key", "__row")
    lone = keyed.where("key is null").withColumns({"r": F.lit(None).cast(linked.schema["r"].dataType), "level": F.lit(None).cast("int")})
    every = linked.unionByName(lone)
    errors = argument_errors(F.col("arguments"), F.col("tool"), schemas)
    return every.select(
        "conv_id", F.col("turn").alias("call_turn"), "call_id", "tool", "level", F.col("r.turn").alias("result_turn"),
        (errors == "").alias("valid"), errors.alias("errors"), canonical(F.col("arguments"), F.col("tool"), F.col("call_id"), F.col("r.content")).alias("json"),
    )


def oracle_sql(table: str = "conversations", schemas=SCHEMAS) -> str:
    """DuckDB SQL of :func:`link_calls` over :func:`read_calls`; objects inside arguments keep the order they are written in."""
    quoted = lambda x: f"coalesce(to_json({x})::VARCHAR, 'null')"
    kinds = {"string": "('VARCHAR')", "integer": "('BIGINT', 'UBIGINT', 'HUGEINT')", "boolean": "('BOOLEAN')"}
    checks = ["CASE WHEN tool IS NULL OR tool NOT IN ({}) THEN 'tool' END".format(", ".join(sorted({f"'{s[0]}'" for s in schemas}))), "CASE WHEN args IS NULL THEN 'arguments' END"]
    for tool, name, kind, required in schemas:
        missing = f"'missing:{name}'" if required else "NULL"
        checks.append(
            f"CASE WHEN tool = '{tool}' AND args IS NOT NULL THEN CASE WHEN NOT list_contains(json_keys(args), '{name}') THEN {missing} "
            f"WHEN json_type(args, '$.{name}') NOT IN {kinds[kind]} THEN 'type:{name}' END END"
        )
    for tool in sorted({s[0] for s in schemas}):
        known = ", ".join(f"'{s[1]}'" for s in schemas if s[0] == tool)
        checks.append(f"CASE WHEN tool = '{tool}' THEN nullif(array_to_string(list_sort(list_transform(list_filter(json_keys(args), lambda k: k NOT IN ({known})), lambda k: 'unknown:' || k)), ','), '') END")
    return f"""
WITH RECURSIVE msg AS (SELECT conv_id, turn, role, text, CASE WHEN role IN ('assistant', 'tool') AND starts_with(ltrim(text), '{{') AND json_valid(text) THEN text::JSON END AS j FROM {table}),
seen AS (SELECT *, role = 'assistant' AND coalesce(json_type(j, '$.tool_calls') = 'ARRAY', false) AS calls, role = 'tool' AND coalesce(json_type(j, '$.tool_call_id') = 'VARCHAR', false) AS gives FROM msg),
marked AS (SELECT DISTINCT conv_id FROM seen WHERE (calls OR gives) AND conv_id IS NOT NULL),
tagged AS (SELECT seen.*, marked.conv_id IS NOT NULL AS is_marked FROM seen LEFT JOIN marked ON seen.conv_id = marked.conv_id),
items AS (SELECT conv_id, turn, unnest(json_extract(j, '$.tool_calls[*]')) AS c FROM tagged WHERE calls AND is_marked),
called AS (SELECT conv_id, turn, CASE WHEN json_type(c, '$.id') = 'VARCHAR' THEN c ->> '$.id' END AS call_id, CASE WHEN json_type(c, '$.name') = 'VARCHAR' THEN c ->> '$.name' END AS tool,
    CASE WHEN json_type(c, '$.arguments') = 'OBJECT' THEN c -> '$.arguments' END AS args, c FROM items
  UNION ALL SELECT conv_id, turn, CASE role WHEN 'system' THEN 's' ELSE 'u' END || turn, CASE role WHEN 'system' THEN 'configure' ELSE 'reply' END,
    ('{{"prompt":' || {quoted("text")} || ',"turn":' || coalesce(turn::VARCHAR, 'null') || '}}')::JSON, NULL FROM tagged WHERE NOT is_marked AND role IN ('user', 'system')),
answers AS (SELECT conv_id, call_id, min(row(turn, content)) AS r FROM (
    SELECT conv_id, turn, j ->> '$.tool_call_id' AS call_id, j ->> '$.content' AS content FROM tagged WHERE gives AND is_marked
    UNION ALL SELECT conv_id, turn, 'u' || (turn - 1), text FROM tagged WHERE NOT is_marked AND role = 'assistant') GROUP BY 1, 2),
heads AS (SELECT conv_id, 's' || min(turn) AS needs FROM tagged WHERE NOT is_marked AND role = 'system' AND turn IS NOT NULL GROUP BY 1),
link AS (SELECT DISTINCT conv_id, call_id, needs FROM (
    SELECT conv_id, call_id, unnest(json_extract_string(c, '$.depends_on[*]')) AS needs FROM called WHERE c IS NOT NULL
    UNION ALL SELECT called.conv_id, call_id, needs FROM called JOIN heads ON called.conv_id = heads.conv_id WHERE c IS NULL AND tool = 'reply')
  WHERE conv_id IS NOT NULL AND call_id IS NOT NULL AND needs IS NOT NULL),
node AS (SELECT DISTINCT conv_id, call_id FROM called WHERE conv_id IS NOT NULL AND call_id IS NOT NULL),
ahead(conv_id, call_id, needs) AS (SELECT * FROM link UNION SELECT ahead.conv_id, ahead.call_id, link.needs FROM ahead JOIN link ON ahead.conv_id = link.conv_id AND ahead.needs = link.call_id),
stuck AS (SELECT DISTINCT ahead.conv_id, ahead.call_id FROM ahead LEFT JOIN node ON ahead.conv_id = node.conv_id AND ahead.needs = node.call_id
  LEFT JOIN ahead again ON again.conv_id = ahead.conv_id AND again.call_id = ahead.needs AND again.needs = ahead.needs WHERE node.call_id IS NULL OR again.call_id IS NOT NULL),
free AS (SELECT conv_id, call_id FROM node ANTI JOIN stuck USING (conv_id, call_id)),
walk(conv_id, call_id, n) AS (SELECT conv_id, call_id, 0 FROM free UNION SELECT link.conv_id, link.call_id, n + 1 FROM walk JOIN link ON walk.conv_id = link.conv_id AND walk.call_id = link.needs JOIN free ON free.conv_id = link.conv_id AND free.call_id = link.call_id),
placed AS (SELECT conv_id, call_id, max(n) AS level FROM walk GROUP BY 1, 2),
judged AS (SELECT *, concat_ws(',', {", ".join(checks)}) AS errors FROM called)
SELECT judged.conv_id, judged.turn AS call_turn, judged.call_id, tool, placed.level::INTEGER AS level, answers.r[1]::BIGINT AS result_turn, errors = '' AS valid, errors,
  '{{"arguments":' || CASE WHEN args IS NULL THEN 'null' ELSE '{{' || array_to_string(list_transform(list_sort(json_keys(args)), lambda k: to_json(k)::VARCHAR || ':' || json_extract(args, '/' || k)::VARCHAR), ',') || '}}' END
    || ',"id":' || {quoted("judged.call_id")} || ',"name":' || {quoted("tool")} || ',"result":' || {quoted("answers.r[2]")} || '}}' AS json
FROM judged LEFT JOIN answers ON judged.conv_id = answers.conv_id AND judged.call_id = answers.call_id
LEFT JOIN placed ON judged.conv_id = placed.conv_id AND judged.call_id = placed.call_id"""
