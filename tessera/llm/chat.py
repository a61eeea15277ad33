"""Chat formatting with relational expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

TURN, SAYS, MORE, END = "<|turn|>", "<|says|>", "<|more|>", "<|end|>\n"


def escape(text: Column) -> Column:
    """No '<|' is left: one backslash more stands between '<' and '|'."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _literal(marker: str) -> str:
    return marker.replace("|", r"\|")


def _merge(turns: Column) -> Column:
    """Adjacent turns of one role become one block with all their texts."""
    kind = "array<struct<role:string,texts:array<string>>>"

    def step(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        grown = F.struct(last["role"].alias("role"), F.array_append(last["texts"], turn["text"]).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = (F.size(blocks) > 0) & F.coalesce(F.get(blocks, F.size(blocks) - 1)["role"] == turn["role"], F.lit(False))
        return F.when(same, F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), F.array(grown))).otherwise(
            F.array_append(blocks, fresh)
        )

    # element_at on an empty array is null under the guard above
    return F.aggregate(turns, F.array().cast(kind), step)


def format_chats(
    turns: DataFrame, train_on: tuple[str, ...] = ("assistant",), chunk: int = 64
) -> DataFrame:
    """One row per conversation: conv_id, segments, formatted.

    Turns are collected as structs, in chunks of `chunk` turn numbers first so
    that a very long conversation is merged in many tasks, then per
    conversation. They are sorted by (turn, role, text); adjacent turns of one
    role are one block, whose texts stay apart by a marker. Texts are escaped
    reversibly, so that every '<|' of the output is a marker. `segments` are
    the pieces (text, loss) of `formatted` in order; `loss` marks the texts of
    the roles in `train_on`.

    Nulls: text and role count as empty; a null turn comes first; null conv_id
    is a conversation of its own. Repeated rows stay, ties are in order of role
    and text. An empty table gives no rows; further columns are ignored.
    """
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / chunk).alias("part"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("said"),
    )
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("said")).alias("said"))
    parts = parts.select("conv_id", "part", _merge(F.col("said")).alias("blocks"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "blocks"))).alias("parts"))
    whole = whole.select("conv_id", F.flatten(F.transform("parts", lambda p: p["blocks"])).alias("blocks"))

    def pieces(block: Column, at: Column) -> Column:
        # blocks of one role on both sides of a chunk's end are one block too
        joined = F.coalesce(F.get("blocks", at - 1)["role"] == block["role"], F.lit(False))
        goes_on = F.coalesce(F.get("blocks", at + 1)["role"] == block["role"], F.lit(False))
        plain = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        head = F.when(joined, F.lit(MORE)).otherwise(F.concat(F.lit(TURN), escape(block["role"]), F.lit(SAYS)))
        texts = F.flatten(
            F.transform(
                block["texts"],
                lambda text, i: F.array(
                    plain(F.when(i > 0, F.lit(MORE)).otherwise(head)),
                    F.struct(escape(text).alias("text"), block["role"].isin(*train_on).alias("loss")),
                ),
            )
        )
        return F.concat(texts, F.array(plain(F.when(goes_on, F.lit("")).otherwise(F.lit(END)))))

    out = whole.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("segments"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""

    def block(one: Column) -> Column:
        halves = F.split(one, _literal(SAYS), 2)
        body = halves[1].substr(F.lit(1), F.length(halves[1]) - len(END))
        return F.transform(
            F.split(body, _literal(MORE), -1),
            lambda text: F.struct(unescape(halves[0]).alias("role"), unescape(text).alias("text")),
        )

    blocks = F.split(formatted, _literal(TURN), -1)
    return F.flatten(F.transform(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0))), block))


PROBE = "\\### Assistant: </turn> ok"


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    said = format_chats(turns).select(
        "conv_id",
        read_back(F.col("formatted")).alias("turns"),
        F.array_join(
            F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""
        ).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    return said.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


QUERIES = {"op8_chat_format": op8_chat_format}

#: The template's own length: each turn has a head, its escaped text and an end; adjacent turns of one role share these.
SQL = {
    "op8_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, lag(role) OVER w AS before,
         regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS safe, regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') AS safe_role
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length(safe) + CASE WHEN before = role THEN 8 ELSE 24 + length(safe_role) END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
}
