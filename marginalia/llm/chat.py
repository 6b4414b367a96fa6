"""Chat formatting, in DataFrame functions only.

A turn's content is a list of typed parts. A visitor (one case for each kind of part) flattens them in
order: text is escaped, an image, audio or document part becomes a placeholder with its reference and
the number of tokens that it expands to. Turns are wrapped in marks; control strings inside texts and
roles are escaped reversibly: the three characters that could begin one are written with a backslash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of the template.
TURN, BODY, END, MEDIA = "<|turn|>", "<|body|>", "<|end|>", "<|media|>"
#: Tokens that one attachment of a kind expands to where the part does not say.
TOKENS = {"image": 256, "audio": 128, "document": 512}
TURNS_IN_BLOCK = 64

PARTS = "array<struct<type:string,text:string,ref:string,n_tokens:int>>"


def escape(x: Column) -> Column:
    """No '<' and no '[' is left, so no control string of any common template can be: reversible."""
    x = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(x, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(x: Column) -> Column:
    pieces = F.split(x, r"\\\\")
    plain = lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))
    return F.array_join(F.transform(pieces, plain), "\\")


def _visit(part: Column) -> Column:
    """What a part becomes: a struct of its flat text, its reference and its expanded tokens."""
    kind = F.coalesce(part["type"], F.lit("text"))
    tokens = F.coalesce(part["n_tokens"], *[F.when(kind == k, n) for k, n in TOKENS.items()], F.lit(0))
    media = F.concat(F.lit(MEDIA), escape(kind), F.lit(":"), escape(F.coalesce(part["ref"], F.lit(""))), F.lit(":"), tokens.cast("string"), F.lit(MEDIA))
    is_text = kind == "text"
    return F.struct(
        F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(media).alias("flat"),
        F.when(~is_text, part["ref"]).alias("ref"),
        F.when(~is_text, kind).alias("kind"),
        F.when(~is_text, tokens).alias("n_tokens"),
    )


def text_parts(text: Column) -> Column:
    """A plain text as parts."""
    null = F.lit(None).cast("string")
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.alias("ref"), F.lit(None).cast("int").alias("n_tokens")))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: str = "assistant") -> DataFrame:
    """One row for each conversation: (conv_id, formatted, loss, attachments, n_turns, n_media_tokens).

    loss: the runs under the loss mask, as (turn, start, length) in code points from the turn's own
    mark; it covers the bodies of the ``learn`` role. Turns are in order of turn, role and text (as it is
    said, not as it is escaped); ties of all three are alike, repeats stay. A null turn comes first, a null
    role or text counts as empty, null ids make a conversation. Other columns, whatever their names, are
    not read. Turns are formatted before they are moved, and joined in blocks of
    TURNS_IN_BLOCK, so that a long conversation does not meet in one task row by row. An empty table
    gives none.
    """
    seen = F.transform(F.coalesce(F.col(parts).cast(PARTS), F.array().cast(PARTS)), _visit)
    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), seen.alias("seen"))
    body = F.array_join(F.transform("seen", lambda p: p["flat"]), "")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    media = F.transform(F.filter("seen", lambda p: p["kind"].isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), p["n_tokens"].alias("n_tokens")))
    one = rows.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.col("role"),
            F.concat(head, body, F.lit(END)).alias("s"),
            F.when(F.col("role") == learn, F.length(head)).alias("start"),
            F.when(F.col("role") == learn, F.length(body)).alias("length"),
            media.alias("media"),
        ).alias("t"),
    )
    block = F.floor(F.col("t.turn") / TURNS_IN_BLOCK)
    # ties are in the order of what is said, which is read back from its escapes instead of being moved as well
    said = lambda t: unescape(F.replace(F.substring_index(t["s"], BODY, -1), F.lit(END), F.lit("")))
    keyed = F.transform("ts", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), said(t).alias("said"), t.alias("t")))
    blocks = one.groupBy("conv_id", block.alias("block")).agg(F.collect_list("t").alias("ts"))
    blocks = blocks.select("conv_id", "block", F.transform(F.sort_array(keyed), lambda k: k["t"]).alias("ts"))
    chats = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "ts"))).alias("bs"))
    ts = chats.select("conv_id", F.flatten(F.transform("bs", lambda b: b["ts"])).alias("ts"))
    runs = F.filter(F.transform("ts", lambda t, i: F.struct(i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"))), lambda r: r["start"].isNotNull())
    held = F.flatten(F.transform("ts", lambda t, i: F.transform(t["media"], lambda m: F.struct(i.alias("turn"), m["kind"].alias("kind"), m["ref"].alias("ref"), m["n_tokens"].alias("n_tokens")))))
    return ts.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["s"]), "").alias("formatted"),
        runs.alias("loss"),
        held.alias("attachments"),
        F.size("ts").cast("long").alias("n_turns"),
        F.aggregate(held, F.lit(0).cast("long"), lambda a, m: a + m["n_tokens"]).alias("n_media_tokens"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, learned array<string>, formatted): parsed from the formatted
    strings and the loss runs alone; texts unescaped."""
    segments = F.slice(F.split("formatted", F.lit(TURN.replace("|", r"\|"))), 2, F.greatest(F.lit(1), F.length("formatted")))
    cut = chats.select("conv_id", "formatted", "loss", segments.alias("segments"))
    role = lambda s: F.substring_index(s, BODY, 1)
    text = lambda s: F.replace(F.call_function("substring_index", s, F.lit(BODY), F.lit(-1)), F.lit(END), F.lit(""))
    turns = F.transform("segments", lambda s: F.struct(unescape(role(s)).alias("role"), unescape(text(s)).alias("text")))
    shift = len(TURN)
    learned = F.transform("loss", lambda r: unescape(F.substring(F.get("segments", r["turn"]), r["start"] - shift + 1, r["length"])))
    return cut.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))
