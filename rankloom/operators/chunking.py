"""Chunkers: one text becomes rows (id, pos, start_line, chunk).  Splits by lines, paragraphs, sentences, token windows and
turns are built-in expressions within the row; only Python source needs its parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

TOKEN_WINDOW = 512
LEAST_CHARS = 50


def _rows(df: DataFrame, pieces: Column, *names: str) -> DataFrame:
    return df.select("id", F.posexplode(pieces).alias("pos", "p")).select("id", "pos", *(F.col(f"p.{n}").alias(n) for n in names))


def line_prefix(df: DataFrame) -> DataFrame:
    """A chunk begins at each line that starts a definition."""
    starts = lambda x: strip(x).rlike("^(def |class |function |export )")
    split = df.select("id", F.split(F.coalesce("content", F.lit("")), "\n").alias("l"))
    at = F.filter(F.transform("l", lambda x, i: F.when(starts(x) | (i == 0), i)), lambda i: i.isNotNull())
    cut = split.select("id", "l", at.alias("a"))
    pieces = F.transform("a", lambda i, k: F.struct((i + 1).alias("start_line"), F.array_join(F.slice("l", i + 1, F.coalesce(F.get("a", k + 1), F.size("l")) - i), "\n").alias("chunk")))
    return _rows(cut, pieces, "start_line", "chunk").where(strip(F.col("chunk")) != "")


def paragraphs(df: DataFrame) -> DataFrame:
    split = F.transform(F.split(F.coalesce("content", F.lit("")), "\n\n"), lambda x, i: F.struct((2 * i + 1).alias("start_line"), strip(x).alias("chunk")))
    return _rows(df, split, "start_line", "chunk").where("chunk != ''")


def sentences(df: DataFrame) -> DataFrame:
    split = F.filter(F.transform(F.split(F.coalesce("content", F.lit("")), "[.!?]+"), strip), lambda x: x != "")
    return _rows(df, F.transform(split, lambda x: F.struct(F.concat(x, F.lit(".")).alias("chunk"))), "chunk")


def token_windows(df: DataFrame, size: int = TOKEN_WINDOW) -> DataFrame:
    words = df.select("id", F.array_remove(F.split(F.coalesce("content", F.lit("")), r"(?U)\s+"), "").alias("w")).where(F.size("w") > 0)
    pieces = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(size)), lambda i: F.struct(F.array_join(F.slice("w", i + 1, F.lit(size)), " ").alias("chunk")))
    return _rows(words, pieces, "chunk")


def long_enough(df: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    return df.where(F.length(strip(F.col("chunk"))) >= least)


def turns(messages: DataFrame, assistant: str = "Claude") -> DataFrame:
    """conv_id, turn_no, chunk of messages (conv_id, turn, role, text): a user's message after another role's begins a turn;
    neighbours of one role are joined; what precedes the first user is dropped, other roles are skipped."""
    m = messages.where(F.col("role").isin("user", "assistant")).withColumn("text", strip(F.regexp_replace("text", "\n{3,}", "\n\n"))).where(F.length("text") >= 2)
    by = Window.partitionBy("conv_id").orderBy("turn")
    begins = (F.col("role") == "user") & F.coalesce(F.lag("role").over(by) != "user", F.lit(True))
    m = m.withColumn("turn_no", F.sum(begins.cast("int")).over(by)).where("turn_no > 0")
    said = lambda role: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), "\n\n")
    t = m.groupBy("conv_id", "turn_no").agg(said("user").alias("u"), said("assistant").alias("a"))
    return t.select("conv_id", "turn_no", F.when(F.col("a") != "", F.concat(F.lit("[User]: "), "u", F.lit(f"\n\n[{assistant}]: "), "a")).otherwise(F.concat(F.lit("[User]: "), "u")).alias("chunk"))


def message_text(content: Column) -> Column:
    """The text of a JSON message content: a string, or blocks of text, tool use and tool results."""
    blocks = F.from_json(content, "array<struct<type:string,text:string,name:string>>")
    one = lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", F.concat(F.lit("[Tool: "), b["name"], F.lit("]"))).when(b["type"] == "tool_result", F.lit("[Tool result]"))
    listed = F.array_join(F.filter(F.transform(blocks, one), lambda x: x.isNotNull() & (x != "")), "\n")
    return F.when(strip(content).startswith("["), listed).otherwise(content)


def dispatch(df: DataFrame) -> DataFrame:
    """Chunks of files (id, path, content) by the way their extension asks for: Python by its parser, others by lines."""
    from . import code

    python = F.col("path").endswith(".py")
    other = line_prefix(df.where(~python)).select("id", "pos", "start_line", "chunk", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("domain"))
    return code.python_chunks(df.where(python)).unionByName(other)
