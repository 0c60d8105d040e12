"""The query of chat formatting, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.llm.chat import in_order, link
from auditloom.registry import Registry, read

#: What a call must look like.
SCHEMAS = {
    "reply": {
        "properties": {"text": {"type": "string", "minLength": 20}, "turn": {"type": "integer", "minimum": 0, "maximum": 6}},
        "required": ["text", "turn"],
        "additionalProperties": False,
    }
}

SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, min(text) AS text, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY ALL),
results AS (
  SELECT conv_id, turn - 1 AS turn, min(text) AS text, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL),
chain AS (
  SELECT c.conv_id, c.turn, 0 AS position FROM calls c LEFT JOIN calls b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2 WHERE b.turn IS NULL
  UNION ALL
  SELECT c.conv_id, c.turn, k.position + 1 FROM chain k JOIN calls c ON c.conv_id = k.conv_id AND c.turn = k.turn + 2),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS id_turn, c.turn AS call_turn,
         coalesce(c.turn, r.turn + 1) AS turn, k.position, coalesce(c.n, r.n) AS n_repeats, c.text AS asked, r.text AS answer,
         CASE WHEN c.turn IS NULL THEN 'orphan_result' WHEN r.turn IS NULL THEN 'no_result' ELSE 'linked' END AS kind
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.turn
  LEFT JOIN chain k ON k.conv_id = c.conv_id AND k.turn = c.turn),
judged AS (
  SELECT *, conv_id || ':' || id_turn AS call_id,
    CASE WHEN call_turn IS NULL THEN ['orphan'] ELSE list_filter([
      CASE WHEN call_turn > 6 THEN 'large:turn' END,
      CASE WHEN asked IS NULL THEN 'missing:text' END,
      CASE WHEN length(asked) < 20 THEN 'short:text' END,
      CASE WHEN call_turn < 0 THEN 'small:turn' END], lambda x: x IS NOT NULL) END AS issues
  FROM linked)
SELECT conv_id, kind, call_id, turn, CAST(position AS BIGINT) AS position, n_repeats, array_to_string(issues, ',') AS issues,
  CAST(json_object(
    'after', CASE WHEN call_turn IS NOT NULL THEN [conv_id || ':' || (call_turn - 2)] END,
    'arguments', CASE WHEN call_turn IS NULL THEN NULL WHEN asked IS NULL THEN json_object('turn', call_turn) ELSE json_object('text', asked, 'turn', call_turn) END,
    'content', NULL, 'id', call_id, 'issues', issues, 'name', CASE WHEN call_turn IS NOT NULL THEN 'reply' END, 'position', position,
    'result', CASE WHEN kind <> 'no_result' THEN json_object('after', [], 'arguments', NULL, 'content', answer, 'role', 'assistant') END, 'role', CASE WHEN call_turn IS NOT NULL THEN 'user' END) AS VARCHAR) AS canonical
FROM judged
UNION ALL
SELECT conv_id, 'message', NULL, turn, NULL, count(*), '', CAST(json_object('after', [], 'arguments', NULL, 'content', text, 'id', NULL, 'name', NULL, 'role', role) AS VARCHAR)
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant') GROUP BY conv_id, turn, text, role
"""


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations: a user's turn is a call of the tool reply that waits for the call two turns before, an assistant's turn is the result of the turn before it."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    name = lambda back: F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - back).cast("string"))
    messages = turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("seq"), "role", F.when(user, F.lit(None)).otherwise(F.col("text")).alias("content"),
        F.when(user, name(0)).when(answer, name(1)).alias("call_id"), F.when(user, F.lit("reply")).alias("name"),
        F.when(user, F.to_json(F.struct("text", "turn"))).alias("arguments"), F.when(user, name(2)).alias("after"),
    )
    done = in_order(link(messages, SCHEMAS))
    return done.select(F.col("conv").alias("conv_id"), "kind", "call_id", F.col("seq").alias("turn"), "position", "n_repeats", F.array_join("issues", ",").alias("issues"), "canonical")


def register(registry: Registry) -> None:
    registry.add("op1_chat_format", SQL)(op1_chat_format)
