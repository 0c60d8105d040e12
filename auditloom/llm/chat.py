"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import cut

# The names that the engine gives to types of JSON values, by the type names of JSON schemas.
TYPES = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$", "null": "^VOID$", "array": "^ARRAY", "object": "^OBJECT"}


def argument_issues(name: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with a call, as a sorted array of strings; empty if nothing is.

    schemas: for each tool a JSON schema of an object with properties (type, minLength, maxLength, minimum, maximum,
    enum), required and additionalProperties.
    """
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    found = [
        F.when(~F.coalesce(name.isin(*schemas) if schemas else F.lit(False), F.lit(False)), F.lit("unknown_tool")),
        F.when(~is_object, F.lit("arguments_not_object")),
    ]
    for tool, schema in schemas.items():
        mine = (name == tool) & is_object
        for key, rule in schema.get("properties", {}).items():
            at = F.try_variant_get(value, f"$['{key}']", "variant")
            kind, text, number = F.schema_of_variant(at), F.try_variant_get(value, f"$['{key}']", "string"), F.try_variant_get(value, f"$['{key}']", "double")
            checks = [(f"type:{key}", kind.rlike(TYPES[rule["type"]]))] if "type" in rule else []
            if "minLength" in rule:
                checks.append((f"short:{key}", F.length(text) >= rule["minLength"]))
            if "maxLength" in rule:
                checks.append((f"long:{key}", F.length(text) <= rule["maxLength"]))
            if "minimum" in rule:
                checks.append((f"small:{key}", number >= rule["minimum"]))
            if "maximum" in rule:
                checks.append((f"large:{key}", number <= rule["maximum"]))
            if "enum" in rule:
                checks.append((f"enum:{key}", text.isin(*rule["enum"])))
            found += [F.when(mine & at.isNotNull() & ~F.coalesce(ok, F.lit(False)), F.lit(what)) for what, ok in checks]
            if key in schema.get("required", ()):
                found.append(F.when(mine & at.isNull(), F.lit(f"missing:{key}")))
        if schema.get("additionalProperties") is False:
            keys = F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>"))
            found.append(F.when(mine & (F.size(keys) > 0), F.lit("additional")))
    return F.array_sort(F.array_compact(F.array(*found)))


def positions(calls: DataFrame) -> DataFrame:
    """(conv, call_id, position) of calls (conv, call_id, after: array of identifiers): the calls on the longest chain before one; null on a cycle and behind one.

    Identifiers that no call has are left out. Chains of calls that wait for one other each are contracted first, by pointer
    doubling: every round doubles the distance that a call looks back, up to its anchor, a call that waits for none or for
    several. Then only anchors are taken off in layers, those first whose anchors before them have their positions, a round a
    layer. So rounds grow with the logarithm of the longest chain and with the number of calls on a chain that wait for
    several. A conversation of any length is spread over all tasks.
    """
    own = calls.select("conv", "call_id", F.explode_outer(F.array_distinct("after")).alias("after"))
    ids = calls.select(F.col("conv").alias("_conv"), F.col("call_id").alias("_id")).distinct()
    same = lambda a, b: (F.col("conv") == F.col("_conv")) & (F.col(a) == F.col(b))
    edges = cut(own.join(ids, same("after", "_id")).select("conv", "call_id", F.col("after").alias("up")))
    waits = edges.groupBy("conv", "call_id").agg(F.count("*").alias("n"), F.min("up").alias("up"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    at = cut(calls.select("conv", "call_id").join(waits, ["conv", "call_id"], "left").select("conv", "call_id", F.when(one, F.col("up")).otherwise(F.col("call_id")).alias("to"), one.cast("long").alias("hops"), (~one).alias("there"), F.coalesce("n", F.lit(0)).alias("n")))
    for _ in range(2 + math.ceil(math.log2(max(2, at.count())))):
        if at.filter("NOT there").isEmpty():
            break
        far = at.select(F.col("conv").alias("_conv"), F.col("call_id").alias("_id"), F.col("to").alias("_to"), F.col("hops").alias("_hops"), F.col("there").alias("_there"))
        at = cut(at.join(far, same("to", "_id")).select("conv", "call_id", F.col("_to").alias("to"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_there").alias("there"), "n"))
    known = cut(at.filter("n = 0").select("conv", F.col("call_id").alias("anchor"), F.lit(0).cast("long").alias("position")))
    if not at.filter("n > 1").isEmpty():
        # what an anchor waits for, as anchors with the distance; behind a cycle there is none
        reach = at.select(F.col("conv").alias("_conv"), F.col("call_id").alias("_id"), F.when(F.col("there"), F.col("to")).alias("before"), (F.col("hops") + 1).alias("far"))
        several = at.filter("n > 1").select("conv", F.col("call_id").alias("anchor"))
        left = cut(edges.withColumnRenamed("call_id", "anchor").join(several, ["conv", "anchor"]).join(reach, same("up", "_id")).select("conv", "anchor", "before", "far"))
        while True:
            found = known.select(F.col("conv").alias("_conv"), F.col("anchor").alias("_id"), "position")
            tried = left.join(found, same("before", "_id"), "left").groupBy("conv", "anchor").agg(F.count_if(F.col("position").isNull()).alias("open"), F.max(F.col("position") + F.col("far")).alias("position"))
            layer = cut(tried.filter("open = 0").select("conv", "anchor", "position"))
            if layer.isEmpty():
                break
            known = cut(known.unionByName(layer))
            left = cut(left.join(layer.select("conv", "anchor"), ["conv", "anchor"], "left_anti"))
    found = known.select(F.col("conv").alias("_conv"), F.col("anchor").alias("_id"), F.col("position").alias("_first"))
    placed = at.filter("there").join(found, same("to", "_id")).select("conv", "call_id", (F.col("_first") + F.col("hops")).alias("position"))
    return calls.select("conv", "call_id").join(placed, ["conv", "call_id"], "left")


def in_order(linked: DataFrame) -> DataFrame:
    """Rows in topological order within their conversation, by a global range sort: a call never comes before one that it waits for; other rows come behind, by seq."""
    return linked.orderBy("conv", F.col("position").isNull(), "position", "seq", "call_id", "kind", "canonical")


def link(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call, each result without a call, each further call or result of an identifier, and each other message.

    messages: conv, seq (place in the conversation), role, content, call_id, name, arguments (JSON text), after (the
    call_id whose result a call waits for, or an array of several). A row with call_id and name is a call, one with call_id alone is the result
    of that call, any other is a message. Returned: conv, kind ('linked', 'no_result', 'orphan_result', 'repeated_call',
    'repeated_result', 'message'), call_id, seq (of the call, else of the row), position (calls on the longest chain before it;
    null off calls, on cycles and for repeated calls), n_repeats (rows that say the same call, result or message),
    issues, canonical (JSON, keys sorted at every depth, no white space, nulls written). It holds all that a row says: of a
    call after, arguments, content, id, issues, name, position, role, and its result as an object of after, arguments, content and
    role; of a message after, arguments, content, id, name and role.

    Calls and results meet by a hash join on (conv, call_id). Where an identifier repeats, the call and the result of
    the least seq, then the least content, are linked. Every other call or result of it, different in any column, has
    a row of its own with its n_repeats, and so have the rows that say the linked result once more: no row is left
    out. Null conv or seq is a value like another for messages; a call or result with a null conv links to nothing and
    is kept as a message with all its fields. Arguments that are no JSON object are an issue, not an error. Other columns are left out.
    """
    after = F.col("after") if isinstance(messages.schema["after"].dataType, T.ArrayType) else F.array_compact(F.array("after"))
    m = messages.select("conv", "seq", "role", "content", "call_id", "name", "arguments", F.array_compact(after).alias("after"))
    tied = F.col("call_id").isNotNull() & F.col("conv").isNotNull()
    is_call, is_result = tied & F.col("name").isNotNull(), tied & F.col("name").isNull()

    def told(rows: DataFrame, fields: list[str], one: str, n: str) -> tuple[DataFrame, DataFrame]:
        """(the least of each identifier, all others): rows with their count, by a digest of all that they say."""
        same = rows.select("conv", "call_id", F.struct(*fields).alias(one)).withColumn("said", F.sha2(F.to_json(one), 256)).groupBy("conv", "call_id", "said").agg(F.min(one).alias(one), F.count("*").alias(n))
        least = same.groupBy("conv", "call_id").agg(F.min(F.struct(one, n, "said")).alias("least")).select("conv", "call_id", f"least.{one}", f"least.{n}", "least.said")
        return least.drop("said"), same.join(least.select("conv", "call_id", "said"), ["conv", "call_id", "said"], "left_anti").drop("said")

    calls, more_calls = told(m.filter(is_call), ["seq", "name", "arguments", "after", "content", "role"], "call", "n")
    results, more_results = told(m.filter(is_result), ["seq", "content", "arguments", "after", "role"], "result", "n_results")
    # the order needs identifiers alone: no content goes through its rounds
    order = m.filter(is_call).groupBy("conv", "call_id").agg(F.min(F.struct("seq", "name", "arguments", "after")).alias("call")).select("conv", "call_id", F.col("call.after").alias("after"))
    # positions join first: behind a full join all content would be exchanged once more
    both = calls.join(positions(order), ["conv", "call_id"], "left").join(results, ["conv", "call_id"], "full")
    kind = F.when(F.col("call").isNull(), "orphan_result").when(F.col("result").isNull(), "no_result").otherwise("linked")
    both = both.withColumn("kind", kind)
    # n_repeats of a linked row counts its call; what says its result again is counted here
    again = both.filter("kind = 'linked' AND n_results > 1").select("conv", "call_id", "result", (F.col("n_results") - 1).alias("n_results"))
    both = both.unionByName(more_calls.withColumn("kind", F.lit("repeated_call")), allowMissingColumns=True)
    both = both.unionByName(more_results.unionByName(again).withColumn("kind", F.lit("repeated_result")), allowMissingColumns=True)
    repeated = F.col("kind").startswith("repeated")
    issues = F.when(F.col("call").isNotNull(), argument_issues(F.col("call.name"), F.col("call.arguments"), schemas)).when(repeated, F.array().cast("array<string>")).otherwise(F.array(F.lit("orphan")))
    issues = F.when(repeated, F.array_append(issues, F.lit("repeated"))).when(F.col("call").isNotNull() & F.col("position").isNull(), F.array_append(issues, F.lit("cycle"))).otherwise(issues)
    arguments = lambda c: F.coalesce(F.try_parse_json(c), F.when(c.isNotNull(), c).cast("variant"))
    flat = both.select(
        "conv", "kind", "call_id", F.coalesce("call.seq", "result.seq").alias("seq"), "position",
        F.coalesce("n", "n_results").alias("n_repeats"), issues.alias("issues"), arguments(F.col("call.arguments")).alias("arguments"),
        F.col("call.name").alias("name"), F.col("call.after").alias("after"), F.col("call.content").alias("content"), F.col("call.role").alias("role"),
        F.when(F.col("result").isNotNull(), F.struct(F.col("result.after").alias("after"), arguments(F.col("result.arguments")).alias("arguments"), F.col("result.content").alias("content"), F.col("result.role").alias("role"))).alias("result"),
    )
    body = F.struct("after", "arguments", "content", F.col("call_id").alias("id"), "issues", "name", "position", "result", "role")
    linked = flat.select("conv", "kind", "call_id", "seq", "position", "n_repeats", "issues", F.to_json(body, {"ignoreNullFields": "false"}).alias("canonical"))
    said = m.filter(~(is_call | is_result)).groupBy("conv", "seq", "role", "content", "call_id", "name", "arguments", "after").agg(F.count("*").alias("n_repeats"))
    plain = said.select(
        "conv", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), "seq", F.lit(None).cast("long").alias("position"), "n_repeats", F.array().cast("array<string>").alias("issues"),
        F.to_json(F.struct("after", arguments(F.col("arguments")).alias("arguments"), "content", F.col("call_id").alias("id"), "name", "role"), {"ignoreNullFields": "false"}).alias("canonical"),
    )
    return linked.unionByName(plain)
