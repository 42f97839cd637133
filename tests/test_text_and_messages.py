import json

import pytest
from pyspark.sql import functions as F

from prefspark.functions import messages, models, text


def T():
    return F.col("t")


@pytest.mark.parametrize(
    "value",
    ["\t x \n", "\xa0x\xa0", "\x85x\x85", "\x1cx\x1f", "　x ", "x y\n\n", "", " \n "],
)
def test_strip_is_that_of_python(one, value):
    assert one(text.strip(T()), t=value) == value.strip()


def test_strip_keeps_a_zero_width_space(one):
    assert one(text.strip(T()), t="​x​") == "​x​"


def test_strip_keeps_null(one):
    assert one(text.strip(T()), t=None) is None


def test_header_is_replaced_every_time_but_only_with_its_newline(one):
    value = "### Steering Direction\na### Steering Direction\nb### Steering Direction"
    expected = "### Suppressing Direction\na### Suppressing Direction\nb### Steering Direction"
    assert one(text.to_suppressing(T()), t=value) == expected


@pytest.mark.parametrize("reverse, word", [(False, "Steering"), (True, "Suppressing")])
def test_steered_prompt_strips_its_parts(one, reverse, word):
    got = one(text.steered_prompt_text(T(), F.col("d"), F.lit(reverse)), t=" q\n", d="\xa0d ")
    assert got == f"### Instruction\nq\n\n### {word} Direction\nd"


@pytest.mark.parametrize(
    "name, system_role, qwen",
    [
        ("google/GEMMA-2", False, False),
        ("Qwen/Qwen3", True, True),
        ("other", True, False),
        ("", True, False),
        (None, True, False),
    ],
)
def test_model_families(one, name, system_role, qwen):
    assert one(models.supports_system_role(T()), t=name) is system_role
    assert one(models.is_qwen_family(T()), t=name) is qwen


@pytest.mark.parametrize(
    "override, configured, name, expected",
    [
        ("true", "false", "x", True),
        ("false", "true", "qwen", False),
        (None, "true", "x", True),
        (None, "false", "qwen", False),
        (None, None, "qwen", True),
        (None, None, None, False),
    ],
)
def test_thinking_flag(one, override, configured, name, expected):
    flag = models.thinking_flag(
        F.col("o").cast("boolean"), F.col("c").cast("boolean"), F.col("m")
    )
    assert one(flag, o=override, c=configured, m=name) is expected


def test_thinking_configured_as_null_is_off(one):
    nothing = F.lit(None).cast("boolean")
    assert one(models.thinking_flag(nothing, nothing, T(), F.lit(True)), t="qwen") is False
    assert one(models.thinking_flag(nothing, nothing, T(), F.lit(False)), t="qwen") is True


def as_pairs(value):
    return [tuple(m) for m in value]


@pytest.mark.parametrize(
    "system, role, expected",
    [
        ("s", True, [("system", "s"), ("user", "u")]),
        ("s", False, [("user", "s\n\nu")]),
        ("", True, [("user", "u")]),
        (None, False, [("user", "u")]),
    ],
)
def test_build_messages(one, system, role, expected):
    got = one(messages.build_messages(F.lit("u"), T(), F.lit(role)), t=system)
    assert as_pairs(got) == expected


def test_message_content_is_cast_and_null_stays(one):
    assert as_pairs(one(messages.single_message("user", F.lit(5)))) == [("user", "5")]
    assert as_pairs(one(messages.single_message("user", T()), t=None)) == [("user", None)]


@pytest.mark.parametrize(
    "prompt, expected",
    [
        ("plain text", [("user", "plain text")]),
        ("{not json", [("user", "{not json")]),
        ("5", [("user", "5")]),
        ('{"role": "system", "content": "x"}', [("system", "x")]),
        ('{"role": "user", "content": 5}', [("user", "5")]),
        ('{"role": "user", "content": null}', [("user", None)]),
        (
            json.dumps([{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]),
            [("user", "a"), ("assistant", "b")],
        ),
    ],
)
def test_prompts_that_are_normalised(one, prompt, expected):
    got = one(messages.normalise_prompt(T()), t=prompt)
    assert (as_pairs(got.messages), got.error) == (expected, None)


@pytest.mark.parametrize(
    "prompt, error",
    [
        ('{"role": "user"}', messages.BAD_OBJECT),
        ("{}", messages.BAD_OBJECT),
        ("[]", messages.EMPTY_LIST),
        ('[{"role": "user", "content": "a"}, 5]', messages.BAD_ITEM),
        ('[{"role": "user", "content": "a"}, {"role": "user"}]', messages.BAD_ITEM),
        (None, messages.NULL_PROMPT),
    ],
)
def test_prompts_that_are_put_aside(one, prompt, error):
    got = one(messages.normalise_prompt(T()), t=prompt)
    assert (got.messages, got.error) == (None, error)


PROMPTS = [
    # (prompt, messages or None, error or None)
    ('{"role": "user", "content": "a", "content": "b"}', [("user", "b")], None),
    ('{"role": "x", "content": 1.0, "role": "user"}', [("user", "1.0")], None),
    ('{"role": "user", "content": null}', [("user", None)], None),
    ('{"role": "user", "content": true, "other": [1, {"a": 2}]}', [("user", "true")], None),
    ('[{"role": "user", "content": "a"}, {"content": "b", "role": "x", "role": "assistant"}]',
     [("user", "a"), ("assistant", "b")], None),
    ('{"role": "user", "content": "a"} {"role": "user", "content": "b"}', "itself", None),
    ('{"role": "user", "content": "a"}, {"role": "user", "content": "b"}', "itself", None),
    ('[{"role": "user", "content": "a"}] and more', "itself", None),
    ("{not json}", "itself", None),
    ("] [", "itself", None),
    ('"text"', "itself", None),
    ("12", "itself", None),
    ("", "itself", None),
    ("{}", None, messages.BAD_OBJECT),
    ('{"role": "user"}', None, messages.BAD_OBJECT),
    ('{"role": "user", "role": "x"}', None, messages.BAD_OBJECT),
    ("[]", None, messages.EMPTY_LIST),
    ("[1]", None, messages.BAD_ITEM),
    ("[null]", None, messages.BAD_ITEM),
    ('[[{"role": "user", "content": "a"}]]', None, messages.BAD_ITEM),
    ('[{"role": "user", "content": "a"}, {"role": "user"}]', None, messages.BAD_ITEM),
    (None, None, messages.NULL_PROMPT),
]


def test_prompts_of_every_shape(spark):
    table = spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(PROMPTS)], "i int, prompt string")
    found = table.select("i", messages.normalise_prompt(F.col("prompt")).alias("p")).orderBy("i").collect()
    for row, (prompt, expected, error) in zip(found, PROMPTS):
        got = None if row.p.messages is None else [(m.role, m.content) for m in row.p.messages]
        assert got == ([("user", prompt)] if expected == "itself" else expected), prompt
        assert row.p.error == error, prompt
