"""Chat formatting over typed content parts, in DataFrame functions only.

A message is an ordered list of parts (text, image, audio, document). A visitor
turns every part into text or into a numbered placeholder and records the
attachment it stands for with the tokens it expands to. Control strings inside
texts are escaped reversibly, so the formatted string reads back to its turns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PARTS = f"array<{PART}>"

#: Turns of one conversation that are put together before the rest joins them.
CHUNK_TURNS = 256
#: Inside raw texts, this sign and 0 stand for itself, 1 for an attachment, 2 for the end of a turn.
SIGN = "\x1f"
#: Elements of a run of a running sum: an aggregate copies what it has gathered at every step.
RUN = 128


@dataclass(frozen=True)
class ChatTemplate:
    """Markers around a turn and the token price of attachments."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    trained_role: str = "assistant"
    patch_pixels: int = 28
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 256


def text_parts(text: Column) -> Column:
    """A plain text as a message of one text part; null is empty."""
    null = F.lit(None)
    part = F.struct(
        F.lit("text").alias("type"),
        F.coalesce(text.cast("string"), F.lit("")).alias("text"),
        null.cast("string").alias("ref"),
        null.cast("int").alias("width"),
        null.cast("int").alias("height"),
        null.cast("double").alias("seconds"),
        null.cast("int").alias("pages"),
    )
    return F.array(part)


def escape_text(text: Column) -> Column:
    r"""One more backslash between ``<`` and ``|``: no marker survives inside a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    r"""As a text, and on one line: backslash and line feed become ``\\`` and ``\n``."""
    return F.replace(F.replace(escape_text(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    r"""``\\`` goes by way of a line feed, which an escaped role cannot hold, to ``\b``."""
    for old, new in (("\\\\", "\n"), ("\n", "\\b"), ("\\n", "\n"), ("\\b", "\\")):
        role = F.replace(role, F.lit(old), F.lit(new))
    return unescape_text(role)


def _expanded(part: Column, t: ChatTemplate) -> Column:
    def tiles(side: str) -> Column:
        return F.ceil(F.greatest(F.coalesce(part[side], F.lit(0)), F.lit(0)) / t.patch_pixels)

    seconds = F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0))
    pages = F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0))
    return (
        F.when(part["type"] == "image", tiles("width") * tiles("height"))
        .when(part["type"] == "audio", F.ceil(seconds * t.audio_tokens_per_second))
        .when(part["type"] == "document", pages * t.tokens_per_page)
        .otherwise(F.lit(0))
        .cast("long")
    )


def _visit(parts: Column, t: ChatTemplate) -> Column:
    """Parts -> ``(raw, files)``: one text, escaped as a whole so that no marker forms across parts, and its attachments."""
    known = F.filter(F.coalesce(parts, F.expr(f"cast(array() as {PARTS})")), lambda p: p.isNotNull())
    is_file = lambda p: F.coalesce(p["type"].isin("image", "audio", "document"), F.lit(False))
    plain = lambda p: F.replace(F.coalesce(p["text"], F.lit("")), F.lit(SIGN), F.lit(SIGN + "0"))
    return F.struct(
        escape_text(F.concat_ws("", F.transform(known, lambda p: F.when(is_file(p), SIGN + "1").otherwise(plain(p))))).alias("raw"),
        F.transform(F.filter(known, is_file), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p, t).alias("tokens"))).alias("files"),
    )


def _running(numbers: Column) -> Column:
    """``(at, out)``: the sum of a short array, and the sums before each of its elements."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(numbers, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))


def _starts(n: Column, length_at: Callable[[Column], Column]) -> Column:
    """Sums of the ``n`` lengths before each: inside runs first, then over the runs' totals.

    ``length_at`` should read a column that its projection does not compute, else
    that is computed for every element.
    """
    last = F.floor((n - 1) / RUN).cast("int")
    runs = F.transform(F.sequence(F.lit(0), last), lambda c: _running(F.transform(F.sequence(c * RUN, F.least((c + 1) * RUN, n) - 1), length_at)))
    before = _running(F.transform(runs, lambda r: r["at"]))["out"]
    whole = F.flatten(F.zip_with(runs, before, lambda r, at: F.transform(r["out"], lambda x: x + at)))
    return F.when(n > 0, whole).otherwise(F.expr("cast(array() as array<int>)"))


def format_conversations(
    messages: DataFrame,
    template: ChatTemplate = ChatTemplate(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    content_col: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens``.

    ``content_col`` is a string or an array of typed parts (``PART``); a part of
    unknown type counts as text. ``loss_spans`` has the 1-based start and the
    length in code points of every text of the trained role inside
    ``formatted``, and its turn from 0. ``attachments`` lists ``index, type, ref, tokens`` in order;
    placeholder ``<|type_index|>`` marks the place in the text.

    Turns are ordered by turn, then role, then content; null turns come first; a
    null role or content is empty; repeated rows stay, one turn each; rows whose
    conversation is null form one conversation; no rows give no rows. Long
    conversations are gathered in chunks of turns first, so the rows of a hot
    one are spread over tasks before its single output string is joined.
    """
    t = template
    content = F.col(content_col)
    is_parts = dict(messages.dtypes)[content_col].startswith("array")
    rows = messages.select(
        F.col(conv_col).alias("conv"),
        F.floor(F.col(turn_col) / CHUNK_TURNS).alias("chunk"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            (content if is_parts else text_parts(content)).cast(PARTS).alias("parts"),
        ).alias("msg"),
    )
    chunks = rows.groupBy("conv", "chunk").agg(F.array_sort(F.collect_list("msg")).alias("msgs"))
    visited = chunks.select(
        "conv",
        F.struct(
            F.col("chunk"),
            F.transform("msgs", lambda m: F.struct(m["role"].alias("role"), _visit(m["parts"], t).alias("body"))).alias("turns"),
        ).alias("piece"),
    )
    whole = visited.groupBy("conv").agg(F.array_sort(F.collect_list("piece")).alias("chunks"))
    turns = whole.select("conv", F.flatten(F.transform("chunks", lambda c: c["turns"])).alias("turns"))
    return _render(turns, t)


def _render(turns: DataFrame, t: ChatTemplate) -> DataFrame:
    files = F.flatten(F.transform("turns", lambda m: m["body"]["files"]))
    numbered = F.transform(files, lambda p, i: F.struct((i + 1).alias("index"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    marks = F.transform("attachments", lambda a: F.concat(F.lit("<|"), a["type"], F.lit("_"), a["index"].cast("string"), F.lit("|>")))
    # All texts as one, cut at the attachments, numbered through, and cut into turns again.
    between = F.split(F.concat_ws(SIGN + "2", F.transform("turns", lambda m: m["body"]["raw"])), SIGN + "1")
    filled = F.concat_ws("", F.zip_with(between, marks, lambda text, mark: F.concat(text, F.coalesce(mark, F.lit("")))))
    bodies = F.transform(F.split(filled, SIGN + "2"), lambda b: F.replace(b, F.lit(SIGN + "0"), F.lit(SIGN)))
    heads = F.transform("turns", lambda m: F.struct(m["role"].alias("role"), F.concat(F.lit(t.start), escape_role(m["role"]), F.lit("\n")).alias("head")))
    texts = F.zip_with(heads, bodies, lambda m, b: F.struct(m["role"].alias("role"), m["head"].alias("head"), b.alias("body")))
    starts = _starts(F.size("texts"), lambda i: F.length(F.get(F.col("texts"), i)["head"]) + F.length(F.get(F.col("texts"), i)["body"]) + len(t.end))
    spans = F.transform(
        F.zip_with("texts", starts, lambda m, at: F.struct((m["role"] == t.trained_role).alias("trained"), (at + F.length(m["head"]) + 1).alias("start"), F.length(m["body"]).alias("length"))),
        lambda s, i: F.struct(s["trained"].alias("trained"), s["start"].alias("start"), s["length"].alias("length"), i.alias("turn")),
    )
    return (
        turns.withColumn("attachments", numbered)
        .withColumn("texts", texts)
        .select(
            F.col("conv").alias("conv_id"),
            F.size("texts").cast("long").alias("n_turns"),
            F.concat_ws("", F.transform("texts", lambda m: F.concat(m["head"], m["body"], F.lit(t.end)))).alias("formatted"),
            F.transform(F.filter(spans, lambda s: s["trained"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), s["turn"].alias("turn"))).alias("loss_spans"),
            "attachments",
            F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
        )
    )


def _pieces(formatted: Column, t: ChatTemplate) -> Column:
    """What stands before each end mark."""
    quoted = "".join("\\" + c if c in "|<>" else c for c in t.end)
    pieces = F.split(formatted, quoted)
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def _turn(piece: Column, t: ChatTemplate) -> Column:
    inner = F.substring(piece, F.lit(len(t.start) + 1), F.length(piece))
    role = F.substring_index(inner, "\n", 1)
    text = F.substring(inner, F.length(role) + 2, F.length(inner))
    return F.struct(unescape_role(role).alias("role"), unescape_text(text).alias("text"))


def read_back(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """``formatted`` -> ``array<struct<role, text>>``, unescaped."""
    return F.transform(_pieces(formatted, template), lambda p: _turn(p, template))


def digest_conversations(formatted: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digests read back from ``format_conversations``' output.

    A span's text is cut out of the piece of its turn: a cut out of the whole
    string would read all that stands before it.
    """
    t = template
    pieces = _pieces(F.col("formatted"), t)
    starts = _starts(F.size("pieces"), lambda i: F.length(F.get(F.col("pieces"), i)) + len(t.end))

    def masked(s: Column) -> Column:
        piece = F.get(F.col("placed"), s["turn"])
        return unescape_text(F.substring(piece["text"], s["start"] - piece["at"], s["length"]))

    back = (
        formatted.withColumn("pieces", pieces)
        .withColumn("placed", F.zip_with("pieces", starts, lambda p, at: F.struct(p.alias("text"), at.alias("at"))))
        .withColumn("turns", F.transform("placed", lambda p: _turn(p["text"], t)))
        .withColumn("loss_text", F.concat_ws("", F.transform("loss_spans", masked)))
    )
    lines = F.concat_ws("", F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
