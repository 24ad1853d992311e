"""Chat formatting with tool calls, by DataFrame functions only.

A message is a row (conversation, turn, role, text). Three sorts of texts are
JSON objects: a system message may declare tools, an assistant's may call
them, a tool's gives a result:

    {"tools": [{"name": "f", "parameters": {"properties": {"x": {"type": "integer"}}, "required": ["x"]}}]}
    {"content": "...", "tool_calls": [{"id": "c1", "name": "f", "arguments": {"x": 1}}]}
    {"tool_call_id": "c1", "content": "..."}

Results are hash-joined with the calls of their conversation by identifier;
where an identifier is used twice, the call that comes first has it. An
argument {"$ref": "c1"} needs the result of that call. Messages are ordered
topologically: by turn, but never before what they need. A cycle of needs
leaves the messages of its conversation where their turns put them. Arguments are checked against
the declared schema (required names, undeclared names, types; a number with a
fraction is no integer); a call without a schema is not valid. Of declarations
of one name the one of the smallest turn counts, then of the smallest JSON.
All JSON is canonical: keys sorted, no white space.

A text that isn't such an object is plain content. A null text stays null, a
null role or turn too; null turns come first, and null conversations form one
conversation. Equal messages are kept each for itself; messages with the same
turn are ordered by role and text. A conversation is written in parts of
`part_turns` turns, so that no row grows without bound and a conversation with
a third of all rows is spread over many groups. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.llm.scratch import discard, written

PART_TURNS = 256
KEY = ["conv", "turn", "role", "text"]
PRIMITIVES = {"string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}


def _object(text: Column) -> Column:
    return F.when(F.ltrim(text).startswith("{"), F.try_parse_json(text))


def _call(body: str) -> Column:
    return F.try_variant_get(F.col(body), "$.tool_calls", "array<struct<id string, name string, arguments variant>>")


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def _calls(messages: DataFrame) -> DataFrame:
    """(conv, turn, role, text, nth, id, name, arguments): arguments as canonical JSON."""
    found = messages.where("role = 'assistant'").withColumn("call", _call("body")).where("call is not null")
    found = found.select(*KEY, F.posexplode("call").alias("nth", "call"))
    # arguments that are written as a string are JSON in it
    text = F.try_variant_get("call.arguments", "$", "string")
    inner = F.when(F.schema_of_variant("call.arguments") == "STRING", F.try_parse_json(text)).otherwise(F.col("call.arguments"))
    return found.select(*KEY, "nth", F.col("call.id").alias("id"), F.col("call.name").alias("name"), F.to_json(inner).alias("arguments"))


def _schemas(messages: DataFrame) -> DataFrame:
    """(conv, name, properties, required), the first declaration of each name."""
    tools = F.try_variant_get("body", "$.tools", "array<struct<name string, parameters variant>>")
    found = messages.where("role = 'system'").select("conv", "turn", F.explode(tools).alias("tool"))
    properties = F.try_variant_get("tool.parameters", "$.properties", "map<string, struct<type string>>")
    required = F.try_variant_get("tool.parameters", "$.required", "array<string>")
    rows = found.select("conv", F.col("tool.name").alias("name"), F.struct("turn", F.to_json("tool.parameters").alias("json")).alias("place"), F.struct(properties.alias("properties"), required.alias("required")).alias("schema"))
    return rows.groupBy("conv", "name").agg(F.min_by("schema", "place").alias("schema")).select("conv", "name", F.coalesce("schema.properties", F.from_json(F.lit("{}"), "map<string, struct<type string>>")).alias("properties"), F.coalesce("schema.required", F.array().cast("array<string>")).alias("required"))


def _problems() -> Column:
    """What is wrong with the arguments of a call; columns arguments, properties, required."""
    given = F.from_json("arguments", "map<string, variant>")
    names = F.coalesce(F.map_keys(given), F.array().cast("array<string>"))
    missing = F.transform(F.filter("required", lambda n: ~F.array_contains(names, n)), lambda n: F.concat(F.lit("missing "), n))
    undeclared = F.transform(F.filter(names, lambda n: ~F.map_contains_key("properties", n)), lambda n: F.concat(F.lit("undeclared "), n))

    def wrong(n: Column) -> Column:
        wanted, found = F.element_at("properties", n)["type"], F.schema_of_variant(F.element_at(given, n))
        right = F.lit(False)
        for name, kind in PRIMITIVES.items():
            right = right | ((wanted == name) & found.startswith(kind))
        numeric = found.startswith("BIGINT") | found.startswith("DOUBLE") | found.startswith("DECIMAL")
        whole = found.startswith("BIGINT") | found.rlike(r"^DECIMAL\(\d+,0\)")  # 1.5 is none
        right = right | ((wanted == "number") & numeric) | ((wanted == "integer") & whole)
        reference = found.startswith("OBJECT<`$ref`") | found.startswith("OBJECT<$ref")
        return F.map_contains_key("properties", n) & wanted.isNotNull() & ~right & ~reference

    types = F.transform(F.filter(names, wrong), lambda n: F.concat(F.lit("type of "), n))
    checked = F.when(given.isNull(), F.array(F.lit("arguments are no object"))).otherwise(F.sort_array(F.concat(missing, undeclared, types)))
    return F.when(F.col("properties").isNull(), F.array(F.lit("no schema"))).otherwise(checked)


def _places(needs: DataFrame) -> DataFrame:
    """(conv, turn, role, text, anchor, depth) of messages that need others, from edges (conv, turn.., on: what is needed).

    A message's place is the largest (turn, steps) of all that it leads to by
    steps from need to need. Each round doubles the steps that a jump takes, so
    a chain of n needs takes about log2(n) rounds. Steps beyond the number of
    edges of a conversation are possible in a cycle only; then its messages
    keep their turns.
    """
    own = F.struct(F.col("turn").alias("anchor"), F.lit(0).cast("long").alias("depth"))
    edges = needs.select(F.struct(*KEY).alias("v"), F.col("on").alias("u")).distinct()
    jumps = written(edges, "chat-needs")
    longest = jumps.groupBy("v.conv").count().agg(F.max("count")).head()[0] or 0
    nodes = jumps.select("v.*").unionByName(jumps.select("u.*")).distinct().select(F.struct(*KEY).alias("v"), own.alias("place"))
    nodes, steps = written(nodes, "chat-places"), 1
    while steps <= 2 * longest and jumps.head(1):
        far = nodes.select(F.col("v").alias("u"), F.col("place").alias("pushed"))
        pushed = jumps.join(far, jumps["u"].eqNullSafe(far["u"])).groupBy("v").agg(F.max(F.struct(F.col("pushed.anchor").alias("anchor"), (F.col("pushed.depth") + steps).alias("depth"))).alias("pushed"))
        pushed = pushed.withColumnRenamed("v", "w")
        after = written(nodes.join(pushed, F.col("v").eqNullSafe(F.col("w")), "left").select("v", F.greatest("place", "pushed").alias("place")), "chat-places")
        onward = jumps.select(F.col("v").alias("u"), F.col("u").alias("next"))
        twice = written(jumps.join(onward, jumps["u"].eqNullSafe(onward["u"])).select("v", F.col("next").alias("u")).distinct(), "chat-needs")
        for used in (nodes, jumps):
            discard(used)
        nodes, jumps, steps = after, twice, 2 * steps
    cyclic = jumps.select(F.col("v.conv").alias("c")).distinct().withColumn("cyclic", F.lit(True))
    placed = nodes.select("v.*", "place").join(cyclic, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    place = F.when(F.col("cyclic"), own).otherwise(F.col("place"))
    return placed.select(*KEY, place["anchor"].alias("anchor"), place["depth"].alias("depth"))


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conversation, part, n_messages, n_calls, n_invalid, n_results, n_unlinked, chat): `chat` is a JSON array of messages."""
    messages = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    # only JSON objects can call, answer or declare; nothing else takes part in a join
    body = _object(F.col("text"))
    zero = [F.lit(0).alias(c) for c in ("calls", "invalid", "results", "unlinked")]
    plain = messages.where(body.isNull()).select(*KEY, F.col("turn").alias("anchor"), F.lit(0).cast("long").alias("depth"), *zero, _plain().alias("message"))
    rows = plain.unionByName(_with_tools(messages.withColumn("body", body).where("body is not null")))
    part = F.floor(F.col("anchor") / part_turns)
    ordered = F.struct("anchor", "depth", "turn", "role", "text", "message")
    numbers = [F.sum(c).cast("long").alias(f"n_{c}") for c in ("calls", "invalid", "results", "unlinked")]
    chats = rows.groupBy("conv", part.alias("part")).agg(F.count("*").alias("n_messages"), *numbers, F.sort_array(F.collect_list(ordered)).alias("messages"))
    joined = F.concat(F.lit("["), F.array_join(F.col("messages.message"), ","), F.lit("]"))
    return chats.select(F.col("conv").alias(conv_col), "part", "n_messages", "n_calls", "n_invalid", "n_results", "n_unlinked", joined.alias("chat"))


KEEP_NULLS = {"ignoreNullFields": "false"}


def _plain() -> Column:
    return F.to_json(F.struct(F.col("text").alias("content"), "role"), KEEP_NULLS)


def _with_tools(talk: DataFrame) -> DataFrame:
    """The messages that are JSON objects, linked, placed and checked."""
    calls, schemas = _calls(talk), _schemas(talk)
    results = talk.where("role = 'tool'").select(*KEY, F.try_variant_get("body", "$.tool_call_id", "string").alias("id"), F.to_json(F.try_variant_get("body", "$.content", "variant")).alias("content")).where("id is not null")
    first = calls.groupBy("conv", "id").agg(F.min_by(F.struct(*KEY), F.struct("turn", "nth", "text")).alias("on")).withColumnRenamed("conv", "c").withColumnRenamed("id", "i")
    same_call = lambda left, key: left["conv"].eqNullSafe(first["c"]) & (left[key] == first["i"])
    linked = results.join(first, same_call(results, "id"), "left").drop("c", "i")
    references = calls.select(*KEY, F.explode(F.regexp_extract_all("arguments", F.lit(r'"\$ref":"([^"]+)"'), F.lit(1))).alias("ref"))
    answers = linked.where("on is not null").groupBy("conv", "id").agg(F.min_by(F.struct(*KEY), F.struct("turn", "text")).alias("answer")).withColumnRenamed("conv", "c").withColumnRenamed("id", "i")
    waits = references.join(answers, references["conv"].eqNullSafe(answers["c"]) & (references["ref"] == answers["i"])).select(*KEY, F.col("answer").alias("on"))
    places = _places(linked.where("on is not null").select(*KEY, "on").unionByName(waits))
    s = schemas.withColumnRenamed("conv", "c").withColumnRenamed("name", "n")
    checked = calls.join(s, calls["conv"].eqNullSafe(s["c"]) & (calls["name"] == s["n"]), "left").withColumn("errors", _problems())
    shown = F.struct(F.try_parse_json("arguments").alias("arguments"), "errors", "id", "name")
    of_message = checked.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("nth", F.to_json(shown, KEEP_NULLS).alias("json"), (F.size("errors") > 0).cast("int").alias("bad")))).alias("calls"))
    # equal messages have equal calls: each is counted once a message, not once a copy
    of_message = of_message.withColumn("calls", F.array_distinct("calls"))
    unique = linked.select(*KEY, "id", "content", F.col("on").isNotNull().alias("linked")).distinct()
    rows = talk.select(*KEY)
    for side, prefix in ((of_message, "m"), (unique, "r"), (places, "p")):
        renamed = side.select(*[F.col(c).alias(f"{prefix}_{c}") for c in side.columns])
        condition = F.lit(True)
        for c in KEY:
            condition = condition & F.col(c).eqNullSafe(F.col(f"{prefix}_{c}"))
        rows = rows.join(renamed, condition, "left")
    has_calls, is_result = F.col("m_calls").isNotNull(), F.col("r_id").isNotNull()
    content = F.to_json(F.struct(F.try_variant_get(_object(F.col("text")), "$.content", "string").alias("content")), KEEP_NULLS)
    inner = F.regexp_extract(content, r"(?s)^\{(.*)\}$", 1)
    with_calls = F.concat(F.lit("{"), inner, F.lit(',"role":"assistant","tool_calls":['), F.array_join(F.col("m_calls.json"), ","), F.lit("]}"))
    with_result = F.concat(F.lit('{"content":'), F.coalesce("r_content", F.lit("null")), F.lit(',"linked":'), F.col("r_linked").cast("string"), F.lit(',"role":"tool","tool_call_id":'), F.to_json(F.struct(F.col("r_id").alias("i"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("r_id").alias("i")))) - 6), F.lit("}"))
    message = F.when(has_calls, with_calls).when(is_result, with_result).otherwise(_plain())
    count = lambda c: F.when(c, 1).otherwise(0)
    return rows.select(
        *KEY, F.coalesce("p_anchor", "turn").alias("anchor"), F.coalesce("p_depth", F.lit(0).cast("long")).alias("depth"),
        F.coalesce(F.size("m_calls"), F.lit(0)).alias("calls"), F.when(has_calls, F.aggregate("m_calls", F.lit(0), lambda n, c: n + c["bad"])).otherwise(0).alias("invalid"),
        count(is_result).alias("results"), count(is_result & ~F.col("r_linked")).alias("unlinked"), message.alias("message"),
    )
