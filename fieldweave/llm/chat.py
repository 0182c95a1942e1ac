r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it as context, and its own text as the
only trainable span. A conversation that does not end with an assistant turn gets one more example
over all of its turns with an empty span, so the output holds every turn.

A turn is ``### <role>: <text></turn>`` and a line feed. Control strings in texts are escaped:
``\`` as ``\b``, ``#`` as ``\h``, ``<`` as ``\l`` and, in roles, ``:`` as ``\c``; so neither ``###``
nor ``</turn>`` can occur within a text, and :func:`unescape` gives it back.

Scale: one exchange, on the conversation. A conversation is one row while it is formatted, as its
examples repeat its turns anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, SEP, CLOSE, TRAINED = "### ", ": ", "</turn>\n", "assistant"
_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
_IN_ROLES = (*_ESCAPES, (":", "\\c"))


def escape(text: Column, role: bool = False) -> Column:
    """``text`` without any control string."""
    for plain, code in _IN_ROLES if role else _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`; the backslash comes last."""
    for plain, code in reversed(_IN_ROLES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn to examples: ``conv_id, example, n_turns, text, loss_start, loss_length``.

    ``example`` counts from 0 within a conversation; ``loss_start`` and ``loss_length`` are code points
    of ``text``. Turns go by number, nulls first, ties by role and text; repeated rows stay. A null
    text or role counts as empty; a null ``conv`` is a conversation of its own. Other columns are left
    out. An empty table gives no examples.
    """
    said = rows.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("said"))
    chats = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"], role=True), F.lit(SEP)))
    bodies = F.transform("turns", lambda t: escape(t["text"]))
    chats = chats.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), heads.alias("heads"), bodies.alias("bodies"))
    parts = F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(CLOSE)))
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda done, p: F.concat(done, F.array(F.element_at(done, -1) + F.length(p))))
    chats = chats.select("conv_id", "roles", "heads", "bodies", F.array_join(parts, "").alias("whole"), ends.alias("ends"), F.size("roles").alias("n_turns"))
    trained = F.filter(F.sequence(F.lit(0), F.col("n_turns") - 1), lambda i: F.get("roles", i) == TRAINED)
    rest = F.when(F.element_at("roles", -1) == TRAINED, F.array().cast("array<int>")).otherwise(F.array(F.lit(-1)))
    examples = chats.select("*", F.posexplode(F.concat(trained, rest)).alias("example", "at"))
    last = F.col("at") < 0
    start = F.when(last, F.element_at("ends", -1)).otherwise(F.get("ends", "at") + F.length(F.get("heads", "at")))
    length = F.when(last, F.lit(0)).otherwise(F.length(F.get("bodies", "at")))
    end = F.when(last, F.element_at("ends", -1)).otherwise(F.get("ends", F.col("at") + 1))
    return examples.select("conv_id", "example", "n_turns", F.substring("whole", F.lit(1), end).alias("text"), start.alias("loss_start"), length.alias("loss_length"))


def parse_turns(text: Column) -> Column:
    """A formatted text to an array of ``(role, text)``."""
    parts = F.filter(F.split(text, CLOSE), lambda p: p != "")
    inner = F.transform(parts, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    return F.transform(inner, lambda p: F.struct(unescape(F.substring_index(p, SEP, 1)).alias("role"), unescape(F.substring(p, F.locate(SEP, p) + len(SEP), F.length(p))).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """What the formatted examples hold, read back from them, per conversation."""
    masked = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_length")))
    read = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", masked.alias("masked")))).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    loss = F.array_join(F.col("losses")["masked"], "")
    read = read.select("conv_id", parse_turns(F.col("whole")).alias("turns"), loss.alias("loss"), "formatted_chars")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """``op5_format_chats``: all conversations and conversation -7."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return digests(format_chats(rows.unionByName(more)))


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, row_number() OVER w AS nth, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(14 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
           + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))) OVER w AS upto
  FROM said
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR nth = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
