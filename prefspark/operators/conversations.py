"""Conversations held as one row per turn: order checks, assembly and rendering.

A rendered conversation is one text, so a conversation has to fit in a row. It is collected
once, with a single shuffle on its id, and laid out by column expressions. The checks,
``last_query_turn`` and the functions named ``…_turns`` work on the turns themselves:
conversations too long for a row go through these, and one may hold any share of the rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions import chat
from prefspark.functions.messages import message
from prefspark.operators.joins import join_grouped
from prefspark.operators.ranking import with_group_ordinal


def last_query_turn(turns: DataFrame) -> DataFrame:
    """Per conversation the turn of its last real user question; its last turn without one."""
    asked = F.max(F.when(chat.is_query(F.col("role"), F.col("content")), F.col("turn")))
    return turns.groupBy("conv_id").agg(
        F.coalesce(asked, F.max("turn")).alias("last_query_turn")
    )


def _with_ends(turns: DataFrame, thinking: Column | None = None) -> DataFrame:
    """Each turn with the first, the last and the last asking turn of its conversation."""
    asked = F.max(F.when(chat.is_query(F.col("role"), F.col("content")), F.col("turn")))
    ends = turns.groupBy("conv_id").agg(
        F.min("turn").alias("_first"), F.max("turn").alias("_last"), asked.alias("_asked")
    )
    given = F.col("reasoning_content") if "reasoning_content" in turns.columns else F.lit(None)
    flag = F.lit(None) if thinking is None else thinking
    plain = turns.select(
        "conv_id",
        "turn",
        "role",
        "content",
        given.cast("string").alias("_reasoning"),
        flag.cast("boolean").alias("_thinking"),
    )
    return join_grouped(plain, ends, "conv_id", null_key=True)


def _pieces(ended: DataFrame, piece: Column, suffix: Column | None) -> DataFrame:
    if suffix is None:
        return ended.select("conv_id", "turn", piece.alias("piece"))
    both = F.when(F.col("turn") == F.col("_last"), F.array(piece, suffix)).otherwise(F.array(piece))
    placed = ended.select("conv_id", "turn", F.posexplode(both).alias("_place", "piece"))
    turn = (F.col("turn") + F.col("_place")).cast(ended.schema["turn"].dataType)
    return placed.select("conv_id", turn.alias("turn"), "piece")


def chatml_turns(
    turns: DataFrame, generation: bool = False, thinking: Column | None = None
) -> DataFrame:
    """``(conv_id, turn, piece)``: the ChatML layout turn by turn, without collecting any.

    The pieces of a conversation in turn order make up the text of ``render_chatml``. With
    ``generation`` one more piece, a turn behind the last one, opens the answer; ``thinking``,
    a column of the turns, is read from the last one. A column ``reasoning_content`` of the
    turns is the reasoning of those where it is not null.
    """
    after_query = F.col("turn") > F.coalesce("_asked", "_last")
    piece = chat.chatml_turn(
        F.col("role"), F.col("content"), after_query, F.col("turn") == F.col("_last"), F.col("_reasoning")
    )
    suffix = chat.chatml_suffix(F.col("_thinking")) if generation else None
    return _pieces(_with_ends(turns, thinking), piece, suffix)


def turn_tag_turns(turns: DataFrame, generation: bool = False) -> DataFrame:
    """The same for the turn-tag layout; ``alternation_violations`` tells what breaks it."""
    opening = F.when(F.col("turn") == F.col("_first"), chat.TAG_BOS).otherwise("")
    piece = F.concat(opening, chat.turn_tag_turn(F.col("role"), F.col("content")))
    return _pieces(_with_ends(turns), piece, chat.turn_tag_suffix() if generation else None)


def header_turns(
    turns: DataFrame, date_string: str = chat.DEFAULT_DATE, generation: bool = False
) -> DataFrame:
    """The same for the header layout; the first piece holds the system turn."""
    role, content = F.col("role"), F.col("content")
    is_first = F.col("turn") == F.col("_first")
    is_system = is_first & (role == "system")
    system = chat.header_system_turn(F.when(is_system, content).otherwise(""), date_string)
    opening = F.when(is_first, F.concat(F.lit(chat.HEADER_BOS), system)).otherwise("")
    turn = F.when(is_system, "").otherwise(chat.header_turn(role, content))
    piece = F.concat(opening, turn)
    return _pieces(_with_ends(turns), piece, chat.header_suffix() if generation else None)


def alternation_violations(turns: DataFrame) -> DataFrame:
    """Turns that break the user/assistant order, with the reason."""
    plain = turns.select("conv_id", "turn", "role")
    placed = with_group_ordinal(plain, ["conv_id"], "turn", "position")
    reason = F.when(
        (F.col("position") == 0) & (F.col("role") == "system"), chat.SYSTEM_FIRST
    ).when(chat.breaks_alternation(F.col("role"), F.col("position")), chat.NOT_ALTERNATING)
    return placed.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        "conv_id", "turn", "position", "role", "reason"
    )


def assemble(turns: DataFrame) -> DataFrame:
    """``(conv_id, messages)``: the turns of each conversation as an array in turn order.

    Messages have a field ``reasoning_content`` if the turns have such a column.
    """
    whole = message(F.col("role"), F.col("content"))
    if "reasoning_content" in turns.columns:
        given = F.col("reasoning_content").cast("string")
        whole = whole.withField("reasoning_content", given)
    turn = F.struct("turn", whole.alias("message"))
    ordered = F.array_sort(F.collect_list(turn))
    return (
        turns.groupBy("conv_id")
        .agg(ordered.alias("turns"))
        .select("conv_id", F.col("turns.message").alias("messages"))
    )


def _render(conversations: DataFrame, text: Column, error: Column) -> DataFrame:
    return conversations.select(
        "conv_id", F.when(error.isNull(), text).alias("text"), error.alias("error")
    )


def render_chatml(conversations: DataFrame) -> DataFrame:
    """``(conv_id, text, error)`` in the ChatML layout; error says why there is no text."""
    messages = F.col("messages")
    given = "reasoning_content" in conversations.schema["messages"].dataType.elementType.names
    return _render(conversations, chat.chatml(messages, given), chat.plain_error(messages))


def render_turn_tags(conversations: DataFrame) -> DataFrame:
    """``(conv_id, text, error)`` in the turn-tag layout, which demands alternating turns."""
    messages = F.col("messages")
    return _render(conversations, chat.turn_tags(messages), chat.alternation_error(messages))


def render_header_ids(
    conversations: DataFrame, date_string: str = chat.DEFAULT_DATE
) -> DataFrame:
    """``(conv_id, text, error)`` in the header layout, which always opens with a system turn."""
    messages = F.col("messages")
    return _render(
        conversations, chat.header_ids(messages, date_string), chat.content_error(messages)
    )
