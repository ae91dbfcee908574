"""Chat formatting with Spark expressions only: turns in, one formatted string per conversation out.

Turns are sorted structs; adjacent turns of one role share a block. The template is

    <s>[ROLE]user[/ROLE]first text[TURN]next text of the same role</s><s>[ROLE]assistant[/ROLE]...</s>

with ``[TURN]`` between the turns of a block, so the turns can be read back. Control strings that
stand in a text or role get a backslash after their first character, and one more if they already
have some; that is undone exactly. ``loss_runs`` covers the formatted string with runs of
``(n_chars, loss)``; loss is true for assistant texts.

A conversation is formatted in pieces of ``CHUNK`` turn numbers, each a group of its own, and the
pieces are joined per conversation, so that escaping and sorting a conversation with a third of
all rows is spread; the string itself is one value of one row, and is joined in one place.

Defined cases: null texts and roles are empty; null turns come first; equal turns are ordered by
role, then text, and repeated rows are repeated turns; rows without a conv_id are one conversation;
an empty table gives an empty table; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.text import let, running, whole

#: Control strings of the template, and common ones of other templates, which are escaped too.
CONTROL = "/?(?:s>|ROLE\\]|TURN\\]|INST\\])"
CHUNK = 64
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])(\\\\*+)({CONTROL})", "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"([<\\[])\\\\(\\\\*+)({CONTROL})", "$1$2$3")


def _head(role: Column) -> Column:
    return F.concat(F.lit("<s>[ROLE]"), role, F.lit("[/ROLE]"))


def _lead(before: Column, role: Column) -> Column:
    """What stands before a turn: ``before`` is the role of the turn before it, null for the first."""
    return F.when(before.isNull(), _head(role)).when(before == role, F.lit("[TURN]")).otherwise(
        F.concat(F.lit("</s>"), _head(role))
    )


def _run(n_chars: Column, loss: Column) -> Column:
    return F.struct(n_chars.cast("int").alias("n_chars"), loss.alias("loss"))


def chat(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv, formatted, loss_runs)``, one row per conversation."""
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.floor(F.col(turn) / CHUNK).alias("chunk"),
        F.struct(
            F.col(turn).alias("turn"), escape(whole(F.col(role))).alias("role"),
            escape(whole(F.col(text))).alias("text"),
        ).alias("t"),
    )
    # array_sort puts nulls last inside structs too, so the order is made explicit
    key = lambda t: F.struct(t["turn"].isNotNull().alias("given"), t["turn"].alias("turn"),
                             t["role"].alias("role"), t["text"].alias("text"))
    pieces = rows.groupBy("conv", "chunk").agg(
        F.array_sort(F.collect_list(key(F.col("t")))).alias("t")
    ).select(
        "conv",
        F.struct(
            F.col("chunk").isNotNull().alias("given"), "chunk",
            F.get("t", F.lit(0))["role"].alias("first"),
            F.element_at("t", -1)["role"].alias("last"),
            F.array_join(F.transform("t", lambda x, i: F.when(i == 0, x["text"]).otherwise(
                F.concat(_lead(F.get("t", i - 1)["role"], x["role"]), x["text"])
            )), "").alias("body"),
            F.flatten(F.transform("t", lambda x, i: F.array(
                _run(F.when(i == 0, 0).otherwise(F.char_length(_lead(F.get("t", i - 1)["role"], x["role"]))), F.lit(False)),
                _run(F.char_length(x["text"]), x["role"] == LOSS_ROLE),
            ))).alias("runs"),
        ).alias("p"),
    )
    whole_conv = pieces.groupBy("conv").agg(F.array_sort(F.collect_list("p")).alias("p"))
    lead = lambda x, i: _lead(F.when(i > 0, F.get("p", i - 1)["last"]), x["first"])
    return whole_conv.select(
        F.col("conv").alias(conv),
        F.concat(
            F.array_join(F.transform("p", lambda x, i: F.concat(lead(x, i), x["body"])), ""), F.lit("</s>")
        ).alias("formatted"),
        F.filter(F.concat(
            F.flatten(F.transform("p", lambda x, i: F.concat(
                F.array(_run(F.char_length(lead(x, i)), F.lit(False))), x["runs"]
            ))),
            F.array(_run(F.lit(4), F.lit(False))),
        ), lambda r: (r["n_chars"] > 0) | r["loss"]).alias("loss_runs"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (role, text) and ``loss_text``, both read from the formatted string.

    ``loss_text`` is what lies under the mask's runs, by their offsets in the string, whoever's text
    that is. The string is cut in an encoding of four bytes a code point, where a place is found
    without reading what is before it.
    """
    blocks = F.split(F.expr("substring(formatted, 1, char_length(formatted) - 4)"), "</s>")

    def of_block(block: Column) -> Column:
        # "<s>[ROLE]" is 9 characters long; a text cannot hold "[/ROLE]", so the first one ends the role
        cut = F.split(block, "\\[/ROLE\\]")
        name = F.substring(cut[0], F.lit(10), F.char_length(cut[0]))
        return F.transform(F.split(cut[1], "\\[TURN\\]"), lambda t: F.struct(
            unescape(name).alias("role"), unescape(t).alias("text")
        ))

    def masked(wide: Column) -> Column:
        lengths = F.transform("loss_runs", lambda r: r["n_chars"])
        return let(running(lengths, lambda a, b: a + b, F.lit(0)), lambda before: F.array_join(F.transform(
            F.filter(F.transform("loss_runs", lambda r, i: F.struct(r["n_chars"].alias("n"), r["loss"].alias("loss"), F.get(before, i).alias("at"))),
                     lambda r: r["loss"]),
            lambda r: unescape(F.decode(F.substring(wide, r["at"] * 4 + 1, r["n"] * 4), "UTF-32")),
        ), ""))

    read = F.flatten(F.transform(blocks, of_block))
    return formatted.withColumns({
        "turns": read, "loss_text": let(F.encode("formatted", "UTF-32"), masked),
    })


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and hashes of what ``read_back`` finds."""
    back = read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv, F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
