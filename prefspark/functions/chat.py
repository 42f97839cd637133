"""Chat layouts as column expressions over an array of messages.

Each layout takes the whole conversation as one array column and returns its text, so a
table that already holds conversations is rendered without a shuffle.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions import models
from prefspark.functions.messages import bind
from prefspark.functions.text import (
    lstrip_newlines,
    rstrip_newlines,
    strip,
    strip_newlines,
)

# The markers of the three layouts.
CHATML_START, CHATML_END = "<|im_start|>", "<|im_end|>\n"
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
TOOL_OPEN, TOOL_CLOSE = "<tool_response>", "</tool_response>"
TAG_BOS, TAG_START, TAG_END = "<bos>", "<start_of_turn>", "<end_of_turn>\n"
HEADER_BOS, HEADER_END = "<|begin_of_text|>", "<|eot_id|>"
HEADER_OPEN, HEADER_CLOSE = "<|start_header_id|>", "<|end_header_id|>\n\n"
KNOWLEDGE_DATE = "Cutting Knowledge Date: December 2023\n"
DEFAULT_DATE = "26 Jul 2024"

# Roles the layouts are defined for; tool turns have no caller and are put aside.
PLAIN_ROLES = ("system", "user", "assistant")

# Reasons a conversation is put aside.
EMPTY = "conversation is empty"
UNKNOWN_ROLE = "role is not one of system, user, assistant"
NULL_CONTENT = "content is null"
SYSTEM_FIRST = "a system turn comes first"
NOT_ALTERNATING = "user and assistant turns do not alternate"


def is_query(role: Column, content: Column) -> Column:
    """A user turn that asks something, not one that only wraps a tool's answer."""
    wrapped = F.startswith(content, F.lit(TOOL_OPEN)) & F.endswith(content, F.lit(TOOL_CLOSE))
    return F.coalesce((role == "user") & ~wrapped, F.lit(False))


def breaks_alternation(role: Column, index: Column) -> Column:
    """User turns belong on even positions and no others do (positions start at 0)."""
    return (role == "user") != (index % 2 == 0)


def last_query_index(messages: Column) -> Column:
    """Position of the last user turn that asks something; the last position without one."""
    positions = F.transform(messages, lambda m, i: F.when(is_query(m["role"], m["content"]), i))
    return F.coalesce(F.array_max(positions), F.size(messages) - 1)


def reasoning_part(content: Column) -> Column:
    """The text between the think tags; empty when the turn has no closing tag."""
    before_close = rstrip_newlines(F.substring_index(content, THINK_CLOSE, 1))
    inside = lstrip_newlines(F.substring_index(before_close, THINK_OPEN, -1))
    return F.when(F.contains(content, F.lit(THINK_CLOSE)), inside).otherwise("")


def answer_part(content: Column) -> Column:
    """The text after the last closing think tag; the whole turn when there is none."""
    after_close = lstrip_newlines(F.substring_index(content, THINK_CLOSE, -1))
    return F.when(F.contains(content, F.lit(THINK_CLOSE)), after_close).otherwise(content)


def chatml_turn(
    role: Column,
    content: Column,
    shows_reasoning: Column,
    is_last: Column,
    given: Column | None = None,
) -> Column:
    """One turn of the ChatML layout.

    ``shows_reasoning`` is true after the last query. There an assistant turn carries its
    think block when it is the last turn or has reasoning to show. ``given`` is reasoning that
    stands beside the content: where it is not null, the content is not searched for any.
    """
    content = F.coalesce(content, F.lit(""))
    reasoning, answer = reasoning_part(content), answer_part(content)
    if given is not None:
        reasoning = F.coalesce(given, reasoning)
        answer = F.when(given.isNull(), answer).otherwise(content)
    think_block = F.concat(
        F.lit(THINK_OPEN + "\n"), strip_newlines(reasoning), F.lit("\n" + THINK_CLOSE + "\n\n"),
        lstrip_newlines(answer),
    )
    with_block = shows_reasoning & (is_last | (reasoning != ""))
    body = (
        F.when(role != "assistant", content).when(with_block, think_block).otherwise(answer)
    )
    return F.concat(F.lit(CHATML_START), role, F.lit("\n"), body, F.lit(CHATML_END))


def chatml(messages: Column, with_reasoning: bool = False) -> Column:
    """The ChatML layout; ``with_reasoning`` if messages have a field ``reasoning_content``."""

    def layout(bound: Column) -> Column:
        turns = F.transform(
            bound["messages"],
            lambda m, i: chatml_turn(
                m["role"],
                m["content"],
                i > bound["query"],
                i == bound["last"],
                m["reasoning_content"] if with_reasoning else None,
            ),
        )
        return F.array_join(turns, "")

    # The positions are bound first: a lambda would look for them again at every turn.
    positions = F.struct(
        messages.alias("messages"),
        last_query_index(messages).alias("query"),
        (F.size(messages) - 1).alias("last"),
    )
    return bind(positions, layout)


def turn_tag_role(role: Column) -> Column:
    return F.when(role == "assistant", "model").otherwise(role)


def turn_tag_turn(role: Column, content: Column) -> Column:
    return F.concat(
        F.lit(TAG_START), turn_tag_role(role), F.lit("\n"), strip(content), F.lit(TAG_END)
    )


def turn_tags(messages: Column) -> Column:
    turns = F.transform(messages, lambda m: turn_tag_turn(m["role"], m["content"]))
    return F.concat(F.lit(TAG_BOS), F.array_join(turns, ""))


def header_turn(role, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.concat(
        F.lit(HEADER_OPEN), role, F.lit(HEADER_CLOSE), strip(content), F.lit(HEADER_END)
    )


def header_system_turn(system: Column, date_string) -> Column:
    """The system turn the header layout always opens with; only its text is stripped."""
    date = F.lit(date_string) if isinstance(date_string, str) else date_string
    return F.concat(
        F.lit(HEADER_OPEN + "system" + HEADER_CLOSE + KNOWLEDGE_DATE + "Today Date: "),
        date, F.lit("\n\n"), strip(system), F.lit(HEADER_END),
    )


def header_ids(messages: Column, date_string=DEFAULT_DATE) -> Column:
    first = F.get(messages, F.lit(0))
    has_system = F.coalesce(first["role"] == "system", F.lit(False))
    system = F.when(has_system, first["content"]).otherwise("")
    rest = F.when(has_system, F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)
    turns = F.transform(rest, lambda m: header_turn(m["role"], m["content"]))
    return F.concat(
        F.lit(HEADER_BOS), header_system_turn(system, date_string), F.array_join(turns, "")
    )


def chatml_suffix(thinking: Column | None = None) -> Column:
    """Opens the answer; only a flag that is false adds the empty think block."""
    opening = CHATML_START + "assistant\n"
    if thinking is None:
        return F.lit(opening)
    closed = opening + THINK_OPEN + "\n\n" + THINK_CLOSE + "\n\n"
    return F.when(~thinking, closed).otherwise(opening)


def turn_tag_suffix() -> Column:
    return F.lit(TAG_START + "model\n")


def header_suffix() -> Column:
    return F.lit(HEADER_OPEN + "assistant" + HEADER_CLOSE)


def plain_error(messages: Column) -> Column:
    """Why a conversation cannot be rendered at all; null when it can."""
    unknown = F.exists(
        messages, lambda m: ~F.coalesce(m["role"].isin(*PLAIN_ROLES), F.lit(False))
    )
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, EMPTY).when(unknown, UNKNOWN_ROLE)


def content_error(messages: Column) -> Column:
    missing = F.exists(messages, lambda m: m["content"].isNull())
    return F.coalesce(plain_error(messages), F.when(missing, NULL_CONTENT))


def alternation_error(messages: Column) -> Column:
    """Why a conversation does not fit the turn-tag layout; null when it does."""
    first_role = F.get(messages, F.lit(0))["role"]
    flags = F.transform(messages, lambda m, i: breaks_alternation(m["role"], i))
    order_error = F.when(first_role == "system", SYSTEM_FIRST).when(
        F.exists(flags, lambda f: f), NOT_ALTERNATING
    )
    return F.coalesce(content_error(messages), order_error)


def render_for_model(
    messages: Column, model: Column, thinking: Column | None = None, date_string=DEFAULT_DATE
) -> Column:
    """``STRUCT<text, error>``: the layout of the model's family, opened for its answer."""
    qwen, gemma = models.is_qwen_family(model), models.is_gemma_family(model)

    def layout(bound: Column) -> Column:
        error = (
            F.when(qwen, plain_error(bound))
            .when(gemma, alternation_error(bound))
            .otherwise(content_error(bound))
        )
        text = (
            F.when(error.isNotNull(), F.lit(None).cast("string"))
            .when(qwen, F.concat(chatml(bound), chatml_suffix(thinking)))
            .when(gemma, F.concat(turn_tags(bound), turn_tag_suffix()))
            .otherwise(F.concat(header_ids(bound, date_string), header_suffix()))
        )
        return F.struct(text.alias("text"), error.alias("error"))

    return bind(messages, layout)
