"""Tool-call linking: calls meet their results, stand in dependency order and serialise canonically.

All of it is DataFrame work: an outer equi-join of calls and results by
(conversation, call id), a fix point of order stages over dependencies that
only touches calls whose dependencies come later in the text, argument checks
on variant values, and JSON with sorted keys from the variant type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

CALLS = "conv_id long, call_id string, turn long, tool string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = "tool string, param string, type string, required boolean"


def kind(value: Column) -> Column:
    """JSON type of a variant: string, number, boolean, null, array or object."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
        .when(name.startswith("ARRAY"), "array").when(name.startswith("OBJECT"), "object").otherwise("number")
    )


def order_stages(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, stage): sorting a conversation by (stage, turn, call_id) puts dependencies first.

    A call needs a later stage only behind a dependency of its own or a later
    turn; null stage for calls on or behind a cycle.  Dependencies on unknown
    calls do not count.
    """
    nodes = calls.select("conv_id", "call_id", "turn")
    edges = calls.select("conv_id", "call_id", "turn", F.explode("depends_on").alias("before")).distinct()
    edges = edges.join(nodes.select("conv_id", F.col("call_id").alias("before"), F.col("turn").alias("before_turn")), ["conv_id", "before"])
    later = F.struct("before_turn", "before") >= F.struct("turn", "call_id")
    edges = written(edges.select("conv_id", "call_id", "before", later.cast("int").alias("later")))
    limits = written(edges.groupBy("conv_id").agg(F.sum("later").alias("most")).where("most > 0"))
    stages = written(nodes.join(limits, "conv_id").select("conv_id", "call_id", F.lit(0).cast("long").alias("stage"), "most"))
    while stages.take(1):
        behind = edges.join(stages.select("conv_id", F.col("call_id").alias("before"), "stage"), ["conv_id", "before"])
        behind = behind.groupBy("conv_id", "call_id").agg(F.max(F.col("stage") + F.col("later")).alias("least"))
        raised = stages.join(behind, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.greatest("stage", F.coalesce("least", F.lit(0).cast("long"))).alias("now"), "stage", "most")
        # a stage above the number of backward steps of the conversation means a cycle; it stays at the mark
        raised = written(raised.withColumn("now", F.least("now", F.col("most") + 1)))
        if not raised.where("now <> stage").take(1):
            break
        stages = raised.select("conv_id", "call_id", F.col("now").alias("stage"), "most")
    found = stages.select("conv_id", "call_id", F.when(F.col("stage") <= F.col("most"), F.col("stage")).alias("stage"), F.lit(True).alias("checked"))
    return nodes.join(found, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.when(F.col("checked"), F.col("stage")).otherwise(F.lit(0).cast("long")).alias("stage"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result without a call.

    conv_id, call_id, tool, turn, stage (order within the conversation is
    stage, turn, call_id; null on a cycle), status (linked, unanswered or
    orphan), n_results, errors (sorted, comma-joined), json (canonical: keys
    sorted at every level, no white space).

    Of several calls with one id the first turn counts, of several results too
    (n_results tells).  errors: bad_json (arguments are no JSON object),
    missing:P and type:P for the tool's parameters, extra:P for others,
    unknown_tool without a schema, early_result if the result comes before the
    call, cycle.  Rows without conv_id or call_id are left out; null arguments
    are bad_json (and null in ``arguments_text``), null content is written as null,
    a call without a result has no content.  Empty tables give what the other side
    has.  Other columns are ignored.
    """
    first = lambda df, *names: df.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", *names)).alias("x"), F.count("*").alias("n"))
    calls = first(calls, "tool", "arguments", "depends_on").select("conv_id", "call_id", "x.*")
    results = first(results, "content").select("conv_id", "call_id", F.col("x.turn").alias("result_turn"), F.col("x.content").alias("content"), F.col("n").alias("n_results"))
    calls = written(calls)
    rules = schemas.where("tool is not null and param is not null").groupBy("tool").agg(F.sort_array(F.collect_set(F.struct("param", "type", F.coalesce("required", F.lit(False)).alias("required")))).alias("rules"))
    parsed = calls.withColumn("value", F.try_parse_json("arguments")).withColumn("object", F.coalesce(kind(F.col("value")) == "object", F.lit(False)))
    parsed = parsed.withColumn("given", F.when(F.col("object"), F.from_json("arguments", "map<string,variant>"))).join(rules, "tool", "left").join(order_stages(calls), ["conv_id", "call_id"], "left")
    has = lambda p: F.coalesce(F.map_contains_key("given", p), F.lit(False))
    checks = F.transform("rules", lambda r: F.when(r["required"] & ~has(r["param"]), F.concat(F.lit("missing:"), r["param"])).when(has(r["param"]) & (kind(F.element_at("given", r["param"])) != r["type"]), F.concat(F.lit("type:"), r["param"])))
    extra = F.transform(F.array_except(F.map_keys("given"), F.transform("rules", lambda r: r["param"])), lambda p: F.concat(F.lit("extra:"), p))
    none = F.array().cast("array<string>")
    own = F.when(~F.col("object"), F.array(F.lit("bad_json"))).when(F.col("rules").isNull(), F.array(F.lit("unknown_tool"))).otherwise(F.concat(F.array_compact(checks), extra))
    parsed = parsed.select("conv_id", "call_id", "turn", "tool", "arguments", "value", "object", "stage", F.concat(own, F.when(F.col("stage").isNull(), F.array(F.lit("cycle"))).otherwise(none)).alias("own"), F.lit(True).alias("called"))
    both = parsed.join(results, ["conv_id", "call_id"], "full")
    called, answered = F.col("called").isNotNull(), F.col("n_results").isNotNull()
    early = F.when(called & answered & (F.col("result_turn") < F.col("turn")), F.array(F.lit("early_result"))).otherwise(none)

    def body(*parts: Column) -> Column:
        """Canonical JSON of some fields in their order; nulls are written."""
        return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})

    said, names = F.col("content"), (F.col("call_id").alias("id"), F.col("tool").alias("name"))
    given, raw = F.col("value").alias("arguments"), F.col("arguments").alias("arguments_text")
    json = F.when(~called, body(said, *names)).when(F.col("object") & answered, body(given, said, *names)).when(F.col("object"), body(given, *names))
    json = json.when(answered, body(raw, said, *names)).otherwise(body(raw, *names))
    return both.select(
        "conv_id", "call_id", "tool", F.coalesce("turn", "result_turn").alias("turn"), "stage",
        F.when(called & answered, "linked").when(called, "unanswered").otherwise("orphan").alias("status"),
        F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce("own", none), early))), ",").alias("errors"),
        json.alias("json"),
    )


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain chats: every turn that is not the assistant's calls the tool of its role.

    The assistant's turn right behind it is its result, and it depends on the
    call two turns before.  Rows without conv_id or turn are left out.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("conv_id is not null and turn is not null")
    name = lambda turn: F.concat_ws(":", F.lit("call"), turn)
    asked = F.coalesce(F.col("role") != "assistant", F.lit(True))
    calls = turns.where(asked).select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.coalesce("role", F.lit("none")).alias("tool"), F.to_json(F.struct("turn", F.col("text").alias("prompt"))).alias("arguments"), F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = turns.where(~asked).select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
