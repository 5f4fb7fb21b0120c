"""Chat formatting: tool calls linked to results, ordered, checked against schemas, as canonical JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, lookup, table
from .registry import corpus_query

#: The tool of the registered query: the reply to a user's turn.
REPLY_TOOL = {
    "reply": {
        "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    }
}


def canonical(value) -> str:
    """JSON with keys in the order of their UTF-16 units, no blanks, and one form for each number."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    return json.dumps(value, ensure_ascii=False)


def parsed(text: str | None):
    """The JSON value of a text; raises ValueError where it is none, or holds NaN, Infinity or an endless number."""

    def finite(number: str) -> float:
        if not math.isfinite(value := float(number)):
            raise ValueError(number)
        return value

    if text is None:
        raise ValueError("no text")
    try:
        return json.loads(text, parse_constant=finite, parse_float=finite)
    except RecursionError as deep:
        raise ValueError("nested too deep") from deep


TYPES = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool), "null": lambda v: v is None,
}


def violation(value, schema: dict, at: str = "") -> str | None:
    """The first rule that a value breaks, as path and keyword; None if it fits.

    Known keywords: type, enum, properties, required, additionalProperties (true or false), items,
    minLength, maxLength, minimum, maximum.
    """
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(TYPES[k](value) for k in kinds):
        return f"{at}/type"
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        return f"{at}/enum"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}/minLength"
        if len(value) > schema.get("maxLength", math.inf):
            return f"{at}/maxLength"
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf):
            return f"{at}/minimum"
        if value > schema.get("maximum", math.inf):
            return f"{at}/maximum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if missing := sorted(set(schema.get("required", ())) - set(value)):
            return f"{at}/{missing[0]}/required"
        if schema.get("additionalProperties") is False and (more := sorted(set(value) - set(known))):
            return f"{at}/{more[0]}/additionalProperties"
        for name in sorted(set(known) & set(value)):
            if found := violation(value[name], known[name], f"{at}/{name}"):
                return found
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := violation(x, schema["items"], f"{at}/{i}"):
                return found
    return None


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, after) -> conv_id, call_id, depth: calls before it on the way along ``after``.

    A call that waits for none, or for a call that isn't there, has depth 0; one that waits for
    itself, through others or not, has a null depth, as have those that wait for such a call.
    Ways are followed in doubling steps; each round settles all calls within twice the depth of
    the one before, and a round that settles none has only circles left.
    """
    own = calls.select("conv_id", "call_id", "after")
    there = own.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known")).distinct()
    linked = lookup(own.where("after IS NOT NULL"), there, ["conv_id", "after"], ["call_id"])
    waiting = checkpoint(linked.select("conv_id", "call_id", F.col("after").alias("up"), F.lit(1).alias("depth")))
    free = own.join(waiting.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    settled = checkpoint(free.select("conv_id", "call_id", F.lit(0).alias("depth")))
    left = waiting.count()
    while left:
        over = waiting.unionByName(settled.withColumn("up", F.lit(None).cast(waiting.schema["up"].dataType)))
        above = over.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = checkpoint(lookup(waiting, above, ["conv_id", "up"], ["call_id"]).select("conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")))
        waiting, before = moved.where("up IS NOT NULL"), left
        left = waiting.count()
        settled = checkpoint(settled.unionByName(moved.where("up IS NULL").select("conv_id", "call_id", "depth")))
        if left == before:
            break
    return settled.unionByName(waiting.select("conv_id", "call_id", F.lit(None).cast("int").alias("depth")))


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (conv_id, call_id, turn, name, arguments, after) and results (conv_id, call_id, turn,
    content) joined on conv_id and call_id, a row for each call with or without result and for each
    result without call.

    Of calls of one id the one of least turn, then name, arguments and after counts, of results
    likewise by turn and content; rows without conv_id or id are left out, since nothing can be
    linked to them. Adds ``depth``.
    """
    key = ["conv_id", "call_id"]
    least = lambda df, *columns: df.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*key).agg(F.min(F.struct(*columns)).alias("x"))
    one_call = checkpoint(least(calls, "turn", "name", "arguments", "after").select(*key, "x.*"))
    one_result = least(results, "turn", "content").select(*key, F.col("x.turn").alias("result_turn"), F.col("x.content").alias("content"), F.lit(True).alias("answered"))
    ordered = one_call.withColumn("called", F.lit(True)).join(depths(one_call), key)
    return ordered.join(one_result, key, "full").select(*key, "turn", "name", "arguments", "after", "depth", "result_turn", "content", F.coalesce("called", F.lit(False)).alias("called"), F.coalesce("answered", F.lit(False)).alias("answered"))


def formatted(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, turn, role, text) messages, calls and results -> one row per message, call and result:
    conv_id, depth, turn, part, call_id, status, detail, json.

    In the order of (depth, turn, part) a conversation has every call behind those it waits for
    and every result (part 2) behind its call (part 1); plain messages (part 0) have depth -1 and
    their turn. The status of a call is ok, unanswered, unknown tool, malformed (arguments that
    are no JSON), invalid (``detail``: the rule of the schema that they break) or circular (it
    waits for itself; depth null); that of a result is ok or orphaned, that of a message ok.
    ``json`` is canonical; malformed arguments stay a string. Null names, arguments and contents
    are JSON nulls, an empty table gives no rows, repeated messages are a row each. A conversation
    is spread over tasks as it comes: rows carry their place instead of being gathered.
    """

    def call_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["called"]:
                    status, detail, value = "ok" if row["answered"] else "unanswered", None, row["arguments"]
                    try:
                        value = parsed(row["arguments"])
                        if row["name"] not in schemas:
                            status = "unknown tool"
                        elif detail := violation(value, schemas[row["name"]]):
                            status = "invalid"
                    except ValueError:
                        status = "malformed"
                    if row["depth"] is None:
                        status, detail = "circular", None
                    out = {"type": "call", "id": row["call_id"], "name": row["name"], "arguments": value}
                    if row["after"] is not None:
                        out["after"] = row["after"]
                    rows.append((row["depth"], row["turn"], 1, status, detail, canonical(out), row))
                if row["answered"]:
                    out = {"type": "result", "id": row["call_id"], "content": row["content"]}
                    rows.append((row["depth"], row["result_turn"], 2, "ok" if row["called"] else "orphaned", None, canonical(out), row))
            own = [(r["conv_id"], depth, turn, part, r["call_id"], status, detail, text) for depth, turn, part, status, detail, text, r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True) if own else [()] * 8, types, strict=True)], names)

    def message_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(r["conv_id"], -1, r["turn"], 0, None, "ok", None, canonical({"type": "message", "role": r["role"], "content": r["text"]})) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True) if own else [()] * 8, types, strict=True)], names)

    names = ["conv_id", "depth", "turn", "part", "call_id", "status", "detail", "json"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
    schema = "conv_id long, depth int, turn long, part int, call_id string, status string, detail string, json string"
    plain = messages.select("conv_id", "turn", "role", "text").mapInArrow(message_rows, schema)
    return linked(calls, results).mapInArrow(call_rows, schema).unionByName(plain)


def as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Messages, calls and results of plain conversations: a user's turn calls ``reply`` with its
    text, the assistant's turn right after it is the result, and each call waits for that of the
    user's last turn where that was two turns before. Everything else stays a message.
    """
    name = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    user, answer = (turns.where(F.col("role") == r) for r in ("user", "assistant"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), {"ignoreNullFields": "false"})
    before = user.select("conv_id", (F.col("turn") + 2).alias("turn"), name(F.col("turn")).alias("after")).distinct()
    calls = user.select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments")).join(before, ["conv_id", "turn"], "left")
    results = answer.select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return turns.where(F.coalesce(F.col("role"), F.lit("")).isin("user", "assistant") == F.lit(False)), calls, results


CHAT_SQL = """
WITH users AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
called AS (SELECT u.conv_id, u.turn, u.text, 'call_' || u.turn AS call_id, CASE WHEN b.turn IS NOT NULL THEN 'call_' || b.turn END AS after FROM users u LEFT JOIN users b ON b.conv_id = u.conv_id AND b.turn = u.turn - 2),
results AS (SELECT conv_id, turn, text, 'call_' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'),
depths AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS INTEGER) AS depth
    FROM (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run, turn % 2 AS odd FROM users) GROUP BY conv_id, turn, run, odd)
SELECT c.conv_id, depth, c.turn, 1 AS part, c.call_id, CASE WHEN r.call_id IS NULL THEN 'unanswered' WHEN c.text = '' THEN 'invalid' ELSE 'ok' END AS status,
    CASE WHEN c.text = '' THEN '/prompt/minLength' END AS detail,
    '{' || CASE WHEN after IS NULL THEN '' ELSE '"after":"' || after || '",' END || '"arguments":{"prompt":' || to_json(c.text) || ',"turn":' || c.turn || '},"id":"' || c.call_id || '","name":"reply","type":"call"}' AS json
    FROM called c LEFT JOIN results r USING (conv_id, call_id) LEFT JOIN depths d ON d.conv_id = c.conv_id AND d.turn = c.turn
UNION ALL SELECT r.conv_id, depth, r.turn, 2, r.call_id, CASE WHEN c.call_id IS NULL THEN 'orphaned' ELSE 'ok' END, NULL, '{"content":' || to_json(r.text) || ',"id":"' || r.call_id || '","type":"result"}'
    FROM results r LEFT JOIN called c USING (conv_id, call_id) LEFT JOIN depths d ON d.conv_id = c.conv_id AND d.turn = c.turn
UNION ALL SELECT conv_id, -1, turn, 0, NULL, 'ok', NULL, '{"content":' || to_json(text) || ',"role":"' || role || '","type":"message"}' FROM conversations WHERE role NOT IN ('user', 'assistant')
"""


@corpus_query("op3_chat", sql=CHAT_SQL)
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(*as_calls(table(spark, sf_dir, "conversations")), REPLY_TOOL)
