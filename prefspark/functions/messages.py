"""Expressions over messages: ``STRUCT<role, content>`` and arrays of it."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions.text import to_suppressing
from prefspark.schema import CONVERSATION


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def message(role, content) -> Column:
    """One message. ``role`` may be a plain string; the content is cast, null stays null."""
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(
        role.cast("string").alias("role"), content.cast("string").alias("content")
    )


def single_message(role, content) -> Column:
    return F.array(message(role, content))


def relabel_for_suppression(messages: Column) -> Column:
    """The same messages asking for suppression in place of steering."""
    return F.transform(messages, lambda m: message(m["role"], to_suppressing(m["content"])))


def build_messages(user: Column, system: Column, system_role: Column) -> Column:
    """User message with an optional system text.

    Without a system role the system text is folded into the user turn, so that it is
    not lost. An empty or null system text leaves the user message alone.
    """
    has_system = F.coalesce(system != "", F.lit(False))
    folded = F.concat(system, F.lit("\n\n"), user)
    return (
        F.when(~has_system, single_message("user", user))
        .when(system_role, F.array(message("system", system), message("user", user)))
        .otherwise(single_message("user", folded))
    )


# Reasons a prompt value is put aside.
NULL_PROMPT = "prompt is null"
BAD_OBJECT = "prompt object lacks role or content"
BAD_ITEM = "prompt list holds an item without role and content"
EMPTY_LIST = "prompt list is empty"
# Fixed value: what may stand in front of a JSON value.
JSON_SPACE = " \t\n\r"
PROMPT_ERRORS = (NULL_PROMPT, BAD_OBJECT, BAD_ITEM, EMPTY_LIST)


def _values(entries: Column, key: str) -> Column:
    return F.filter(entries, lambda e: e["key"] == key)


def _has_message_keys(entries: Column) -> Column:
    """Key presence: a key holding a JSON null is there."""
    found = [F.size(_values(entries, key)) > 0 for key in ("role", "content")]
    return F.coalesce(found[0] & found[1], F.lit(False))


def _entries_message(entries: Column) -> Column:
    """The last one of repeated keys counts; what is no text stands as it is written."""
    return message(*(F.try_element_at(_values(entries, k), F.lit(-1))["value"] for k in ("role", "content")))


def normalise_prompt(prompt: Column) -> Column:
    """``STRUCT<messages, error>`` from a prompt of mixed shape.

    The prompt is text: a JSON object with role and content, a JSON list of such objects,
    or anything else, which becomes the content of one user message.
    """

    # JSON is told from plain text by a full parse. That refuses repeated keys, though, so
    # what it does not read may still be an object or a list. The brackets around it make
    # anything that follows a first value visible.
    wrapped = F.concat(F.lit("["), prompt, F.lit("]"))

    def only(parsed: Column) -> Column:
        return F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0)))

    def by_shape(shape: Column) -> Column:
        unread = shape.isNull() & F.startswith(F.ltrim(prompt, F.lit(JSON_SPACE)), F.lit("{"))
        unread_list = shape.isNull() & F.startswith(F.ltrim(prompt, F.lit(JSON_SPACE)), F.lit("["))
        found = F.from_json(wrapped, "array<map<string, string>>")
        items = F.from_json(wrapped, "array<array<map<string, string>>>")
        values = F.try_parse_json(wrapped)
        single = values.isNotNull() & F.try_variant_get(values, "$[1]", "variant").isNull()
        read = F.struct(
            only(F.when(_is(shape, "OBJECT") | unread, found)).alias("object"),
            only(F.when(_is(shape, "ARRAY") | unread_list, items)).alias("items"),
            F.when(_is(shape, "ARRAY"), single).otherwise(F.lit(False)).alias("single"),
        )
        return bind(read, normalise)

    def normalise(read: Column) -> Column:
        entries = F.map_entries(read["object"])
        is_object, is_list = entries.isNotNull(), read["items"].isNotNull() | read["single"]
        items = F.transform(read["items"], lambda item: F.map_entries(item))
        good_list = F.coalesce(F.forall(items, _has_message_keys), F.lit(False))
        return (
            F.when(prompt.isNull(), _put_aside(NULL_PROMPT))
            .when(is_object & ~_has_message_keys(entries), _put_aside(BAD_OBJECT))
            .when(is_object, _accepted(F.array(_entries_message(entries))))
            .when(~is_list, _accepted(single_message("user", prompt)))
            .when(F.coalesce(F.size(items) == 0, F.lit(False)), _put_aside(EMPTY_LIST))
            .when(good_list, _accepted(F.transform(items, _entries_message)))
            .otherwise(_put_aside(BAD_ITEM))
        )

    return bind(F.schema_of_variant(F.try_parse_json(prompt)), by_shape)


def _is(shape: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(shape, F.lit(kind)), F.lit(False))


def _accepted(messages: Column) -> Column:
    return F.struct(messages.alias("messages"), F.lit(None).cast("string").alias("error"))


def _put_aside(reason: str) -> Column:
    return F.struct(
        F.lit(None).cast(CONVERSATION).alias("messages"), F.lit(reason).alias("error")
    )
