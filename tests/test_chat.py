import pytest
from pyspark.sql import functions as F

from prefspark.functions import chat
from prefspark.operators import conversations as conv
from prefspark.plans.flows import steered_prompts


def T():
    return F.col("t")


@pytest.mark.parametrize(
    "content, reasoning, answer",
    [
        ("plain", "", "plain"),
        ("<think>a</think>b", "a", "b"),
        ("<think>\n\na\n\n</think>\n\nb\n", "a", "b\n"),
        ("<think>a</think>b</think>c", "a", "c"),
        ("<think>a<think>b</think>c", "b", "c"),
        ("a</think>b", "a", "b"),
        ("<think>open", "", "<think>open"),
        ("</think>", "", ""),
    ],
)
def test_reasoning_and_answer(one, content, reasoning, answer):
    assert one(chat.reasoning_part(T()), t=content) == reasoning
    assert one(chat.answer_part(T()), t=content) == answer


@pytest.fixture
def turns(spark):
    def build(*roles_and_contents):
        rows = [(1, i, r, c) for i, (r, c) in enumerate(roles_and_contents)]
        return spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")

    return build


TOOL = "<tool_response>\nx\n</tool_response>"


@pytest.mark.parametrize(
    "contents, expected",
    [
        ([("user", "a"), ("assistant", "b"), ("user", TOOL), ("assistant", "c")], 0),
        ([("system", "a"), ("assistant", "b")], 1),
        ([("user", TOOL)], 0),
        ([("user", "a"), ("assistant", "b"), ("user", "c")], 2),
        ([("user", "<tool_response> open only"), ("assistant", "b")], 0),
    ],
)
def test_last_query(turns, contents, expected):
    df = turns(*contents)
    assert conv.last_query_turn(df).first().last_query_turn == expected
    assembled = conv.assemble(df).select(chat.last_query_index(F.col("messages")).alias("i"))
    assert assembled.first().i == expected


@pytest.mark.parametrize(
    "roles, positions",
    [
        (["user", "assistant", "user"], []),
        (["system", "user", "assistant"], [0, 1, 2]),
        (["user", "system", "user"], []),
        (["user", "user"], [1]),
        (["assistant"], [0]),
    ],
)
def test_alternation(turns, roles, positions):
    df = turns(*[(r, "x") for r in roles])
    found = sorted(r.position for r in conv.alternation_violations(df).collect())
    assert found == positions
    error = conv.assemble(df).select(chat.alternation_error(F.col("messages")).alias("e"))
    assert (error.first().e is None) == (not positions)


def rendered(render, df):
    return render(conv.assemble(df)).first()


def test_chatml(turns):
    df = turns(
        ("system", "s"),
        ("user", "q"),
        ("assistant", "<think>old</think>\n\nfirst"),
        ("user", "r"),
        ("assistant", "<think>\nwhy\n</think>\n\nsecond"),
        ("assistant", "no reason"),
        ("assistant", "last"),
    )
    assert rendered(conv.render_chatml, df).text == (
        "<|im_start|>system\ns<|im_end|>\n"
        "<|im_start|>user\nq<|im_end|>\n"
        "<|im_start|>assistant\nfirst<|im_end|>\n"
        "<|im_start|>user\nr<|im_end|>\n"
        "<|im_start|>assistant\n<think>\nwhy\n</think>\n\nsecond<|im_end|>\n"
        "<|im_start|>assistant\nno reason<|im_end|>\n"
        "<|im_start|>assistant\n<think>\n\n</think>\n\nlast<|im_end|>\n"
    )


@pytest.mark.parametrize(
    "render, pieces_of",
    [
        (conv.render_chatml, conv.chatml_turns),
        (conv.render_turn_tags, conv.turn_tag_turns),
        (conv.render_header_ids, conv.header_turns),
    ],
)
def test_pieces_make_up_the_text(spark, render, pieces_of):
    from checks import fixtures

    turns = fixtures.thinking_turns(spark, "/root/testdata/sf0.001")
    texts = {r.conv_id: r.text for r in render(conv.assemble(turns)).collect() if r.text}
    pieces = {}
    for r in sorted(pieces_of(turns).collect(), key=lambda r: r.turn):
        pieces[r.conv_id] = pieces.get(r.conv_id, "") + r.piece
    assert texts and {c: pieces[c] for c in texts} == texts


def test_chatml_writes_a_null_content_as_nothing(turns):
    df = turns(("user", None))
    assert rendered(conv.render_chatml, df).text == "<|im_start|>user\n<|im_end|>\n"


@pytest.mark.parametrize(
    "render", [conv.render_chatml, conv.render_turn_tags, conv.render_header_ids]
)
def test_tool_turns_are_put_aside(turns, render):
    row = rendered(render, turns(("user", "a"), ("tool", "b")))
    assert (row.text, row.error) == (None, chat.UNKNOWN_ROLE)


@pytest.mark.parametrize("render", [conv.render_turn_tags, conv.render_header_ids])
def test_null_content_is_put_aside(turns, render):
    row = rendered(render, turns(("user", None)))
    assert (row.text, row.error) == (None, chat.NULL_CONTENT)


def test_turn_tags(turns):
    df = turns(("user", " a\n"), ("assistant", "b"))
    assert rendered(conv.render_turn_tags, df).text == (
        "<bos><start_of_turn>user\na<end_of_turn>\n<start_of_turn>model\nb<end_of_turn>\n"
    )


def test_turn_tags_refuse_a_system_turn_and_broken_order(turns):
    row = rendered(conv.render_turn_tags, turns(("system", "s"), ("user", "a")))
    assert (row.text, row.error) == (None, chat.SYSTEM_FIRST)
    row = rendered(conv.render_turn_tags, turns(("user", "s"), ("user", "a")))
    assert (row.text, row.error) == (None, chat.NOT_ALTERNATING)


HEADER = (
    "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n"
    "Cutting Knowledge Date: December 2023\nToday Date: {}\n\n{}<|eot_id|>"
)


def test_header_ids(turns):
    user = "<|start_header_id|>user<|end_header_id|>\n\na<|eot_id|>"
    text = rendered(conv.render_header_ids, turns(("user", " a "))).text
    assert text == HEADER.format("26 Jul 2024", "") + user
    df = turns(("system", " s "), ("user", "a"))
    text = conv.render_header_ids(conv.assemble(df), "01 Jan 2025").first().text
    assert text == HEADER.format("01 Jan 2025", "s") + user


def test_turn_order_is_numeric(turns):
    df = turns(*[("user", str(i)) for i in range(12)])
    text = rendered(conv.render_chatml, df.orderBy(F.desc("turn"))).text
    assert [part.split("<")[0] for part in text.split("user\n")[1:]] == [str(i) for i in range(12)]


@pytest.mark.parametrize(
    "thinking, suffix",
    [
        ("true", "<|im_start|>assistant\n"),
        ("false", "<|im_start|>assistant\n<think>\n\n</think>\n\n"),
        (None, "<|im_start|>assistant\n"),
    ],
)
def test_chatml_suffix(one, thinking, suffix):
    assert one(chat.chatml_suffix(T().cast("boolean")), t=thinking) == suffix


def test_steered_prompts_need_no_shuffle(spark):
    requests = spark.createDataFrame(
        [("q", "d", "Qwen/x", False), ("q", "d", "gemma", True), ("q", "d", None, False)],
        "question string, direction string, model string, reverse boolean",
    )
    df = steered_prompts(requests, F.lit("sys"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    steering = "### Instruction\nq\n\n### Steering Direction\nd"
    suppressing = steering.replace("Steering", "Suppressing")
    assert [r.rendered for r in df.collect()] == [
        "<|im_start|>system\nsys<|im_end|>\n"
        f"<|im_start|>user\n{steering}<|im_end|>\n<|im_start|>assistant\n",
        f"<bos><start_of_turn>user\nsys\n\n{suppressing}<end_of_turn>\n<start_of_turn>model\n",
        HEADER.format("26 Jul 2024", "sys")
        + f"<|start_header_id|>user<|end_header_id|>\n\n{steering}<|eot_id|>"
        + "<|start_header_id|>assistant<|end_header_id|>\n\n",
    ]


def test_reasoning_beside_the_content(spark):
    rows = [
        (0, "user", "hi", None), (1, "assistant", "<think>inside</think>plain", "\ngiven\n"),
        (2, "user", "again", None), (3, "assistant", "\n\nanswer", "why"), (4, "assistant", "<think>x</think>y", ""),
    ]
    turns = spark.createDataFrame([(1, *r) for r in rows], "conv_id int, turn int, role string, content string, reasoning_content string")
    text = conv.render_chatml(conv.assemble(turns)).first()["text"]
    assert text == (
        "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<think>inside</think>plain<|im_end|>\n"
        "<|im_start|>user\nagain<|im_end|>\n<|im_start|>assistant\n<think>\nwhy\n</think>\n\nanswer<|im_end|>\n"
        "<|im_start|>assistant\n<think>\n\n</think>\n\n<think>x</think>y<|im_end|>\n"
    )
    pieces = conv.chatml_turns(turns, generation=True, thinking=F.col("turn") < 4).orderBy("turn").collect()
    assert "".join(r["piece"] for r in pieces[:-1]) == text
    assert (pieces[-1]["turn"], pieces[-1]["piece"]) == (5, "<|im_start|>assistant\n<think>\n\n</think>\n\n")


def test_generation_pieces_of_every_layout(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f" text {t} ") for c in (1, None) for t in (0, 1, 2)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string")
    messages = conv.assemble(turns)
    for layout, render, suffix in (
        (conv.chatml_turns, conv.render_chatml, chat.chatml_suffix()),
        (conv.turn_tag_turns, conv.render_turn_tags, chat.turn_tag_suffix()),
        (conv.header_turns, conv.render_header_ids, chat.header_suffix()),
    ):
        whole = {r["conv_id"]: r["t"] for r in render(messages).select("conv_id", F.concat("text", suffix).alias("t")).collect()}
        found = {}
        for r in layout(turns, generation=True).orderBy("turn").collect():
            found[r["conv_id"]] = found.get(r["conv_id"], "") + r["piece"]
        assert found == whole and len(whole) == 2
