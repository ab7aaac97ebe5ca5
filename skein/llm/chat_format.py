"""Chat formatting with DataFrame operations only: typed parts, markers, loss spans.

A turn's content is an array of typed parts. A visitor takes the parts in their order: text goes
in escaped, every image, audio or document part leaves an ordered placeholder, an attachment
reference and the number of tokens that it expands to. A conversation's turns are joined between
markers; the spans of the assistants' texts are the loss mask.

Escaping: every `<|` of a text becomes `<|\\`, with one backslash more, so that no marker or
placeholder can stand inside a text; taking one backslash off after each `<|` undoes it, since
outside of texts `<|` is never followed by a backslash.

Defined results: null or empty text is an empty part; a null role is the empty role; a null list
of parts is empty; turns of the same number are ordered by role and text, null turns come first;
rows of a null conv_id form a conversation; an unknown part type is treated as a document.
A conversation is one value, and so is put together in one task, as its digest asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import held, table

PART = "array<struct<type: string, text: string, ref: string, units: int>>"
#: Fixed values of the format.
START, END = "<|im_start|>", "<|im_end|>"
OPEN, OPEN_ESCAPED = "<|", "<|\\"
#: A line break in a role.
LINE = "<|n|>"
#: Tokens that an attachment expands to: so many per unit (image tile, second of audio, page).
EXPANDS = {"image": 256, "audio": 25, "document": 512}
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit(OPEN_ESCAPED))


def escape_role(role: Column) -> Column:
    """A role stands on one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN_ESCAPED), F.lit(OPEN))


def _tokens(part: Column) -> Column:
    per = F.lit(EXPANDS["document"])
    for kind in ("image", "audio"):
        per = F.when(part["type"] == kind, EXPANDS[kind]).otherwise(per)
    return per * F.coalesce(part["units"], F.lit(1))


def flatten_parts(parts: Column) -> tuple[Column, Column]:
    """The turn's content with placeholders, and its attachments (type, ref, tokens) in order."""
    parts = F.coalesce(parts, F.array().cast(PART))
    is_text = lambda p: F.coalesce(p["type"] == "text", F.lit(True))
    known = lambda p: F.when(p["type"].isin(*EXPANDS), p["type"]).otherwise("document")
    parts = F.filter(parts, lambda p: ~(is_text(p) & (F.coalesce(p["text"], F.lit("")) == "")))

    def show(p: Column, i: Column) -> Column:
        before = F.get(parts, i - 1)
        # two texts may make up an opening between them
        split = (i > 0) & is_text(before) & F.endswith(before["text"], F.lit("<")) & F.startswith(p["text"], F.lit("|"))
        own = F.when(split, F.concat(F.lit("|\\"), escape(F.substring(p["text"], F.lit(2), F.length(p["text"]))))).otherwise(escape(p["text"]))
        return F.when(is_text(p), own).otherwise(F.concat(F.lit("<|"), known(p), F.lit("|>")))

    shown = F.transform(parts, show)
    kept = F.filter(parts, lambda p: ~is_text(p))
    attached = F.transform(kept, lambda p: F.struct(known(p).alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    return F.array_join(shown, ""), attached


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans of characters), attachments and attachment_tokens.

    turns: conv_id, turn, role, parts. A span is (start, length), counted in characters from 0.
    """
    content, attached = flatten_parts(F.col("parts"))
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), attached.alias("attached"))
    whole = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content", "attached"))).alias("turns"))
    # each turn: its head, up to where the content starts, and the content
    pieces = F.transform("turns", lambda t: F.struct((t["role"] == LOSS_ROLE).alias("loss"), F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), t["content"].alias("content")))
    whole = whole.select("conv_id", held(pieces).alias("pieces"), F.flatten(F.transform("turns", lambda t: t["attached"])).alias("attachments"))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["content"], F.lit(END + "\n"))), "")
    lengths = F.transform("pieces", lambda p: F.struct(p["loss"].alias("loss"), F.length(p["head"]).alias("head"), F.length(p["content"]).cast("long").alias("content")))
    # where each turn begins
    total = F.expr("aggregate(l, named_struct('at', 0L, 's', cast(array() as array<bigint>)), (a, x) -> named_struct('at', a.at + x.head + x.content + %d, 's', array_append(a.s, a.at)), a -> a.s)" % (len(END) + 1))
    whole = whole.withColumn("l", held(lengths)).withColumn("formatted", held(text)).withColumn("at", held(total))
    spans = F.transform(F.filter(F.zip_with("l", "at", lambda x, at: F.struct(x["loss"].alias("loss"), (at + x["head"]).alias("start"), x["content"].alias("length"))), lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return whole.select("conv_id", "formatted", spans.alias("loss"), "attachments", tokens.alias("attachment_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, content) and loss_texts, read from the formatted text and the mask."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    body = F.transform(parts, lambda p: F.substring(p, F.lit(1), F.length(p) - len(END) - 1))
    turns = F.transform(body, lambda b: F.struct(unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substring(b, F.length(F.substring_index(b, "\n", 1)) + 2, F.length(b))).alias("content")))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", held(turns).alias("turns"), loss.alias("loss_texts"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = END + START + "assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(1).alias("units"))
    back = read_back(format_conversations(rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{END}{START}assistant ok' UNION ALL SELECT -1, 1, 'assistant', '{END}{START}assistant ok'),
own AS (SELECT *, length(replace(role, '<|', '<|\\')) + length(replace(text, '<|', '<|\\')) + {len(START) + 1 + len(END) + 1} AS size FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM own GROUP BY conv_id
"""
