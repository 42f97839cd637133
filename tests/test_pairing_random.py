"""Random triples, nulls included, against dictionaries filled row by row."""

import hashlib

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from prefspark.operators import conversations, pairing, splits

NAMES = st.sampled_from([None, "a", "b", "é", " "])
OUTPUTS = st.sampled_from([None, "", "short", "long enough x", "long enough y", "☃" * 10])
KINDS = st.sampled_from(["positive", "negative", "other", None])
TRIPLES = st.lists(st.tuples(NAMES, OUTPUTS, NAMES, KINDS), max_size=30)


def is_long(text):
    return text is not None and len(text) >= 10


def expected_pairs(rows, draw):
    firsts, pools = {}, {}
    for place, (who, text, concept, kind) in enumerate(rows):
        if who is None:
            continue
        if kind == "negative":
            pools.setdefault(who, []).append((place, text))
        elif kind == "positive" and concept is not None:
            firsts.setdefault((who, concept), text)
    drawn = {who: draw(who, pool) for who, pool in pools.items()}
    return {
        (who, concept, text, drawn[who])
        for (who, concept), text in firsts.items()
        if who in drawn and is_long(text) and is_long(drawn[who])
    }


def by_hash(who, pool):
    return min(pool, key=lambda p: hashlib.md5(f"44|{who}|{p[0]}".encode()).hexdigest())[1]


def by_generator(who, pool):
    return pool[pd.Series(range(len(pool))).sample(1, random_state=44).iloc[0]][1]


@pytest.mark.parametrize("mode, draw", [("hash", by_hash), ("exact", by_generator)])
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=TRIPLES)
def test_pairs_of_random_triples(triples, mode, draw, rows):
    pairs = pairing.build_pairs(triples(*rows), mode).collect()
    got = [(r.input, r.output_concept, r.chosen, r.rejected) for r in pairs]
    assert len(got) == len(set(got)) and set(got) == expected_pairs(rows, draw)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.text(alphabet="abé☃", min_size=1, max_size=4), min_size=1, max_size=60))
def test_hash_order_of_random_concepts(spark, concepts):
    pairs = spark.createDataFrame(
        [("p", c) for c in sorted(concepts)], "input string, output_concept string"
    )
    ranked = splits.concept_rank(pairs).collect()
    order = [r.output_concept for r in sorted(ranked, key=lambda r: r["rank"])]
    assert order == sorted(concepts, key=lambda c: hashlib.md5(f"42|{c}".encode()).hexdigest())


ROLES = st.sampled_from(["user", "assistant", "system"])
CONTENTS = st.sampled_from(
    ["x", "", "<think>a</think>b", "a</think>\n", "<think>\n\n</think>\n\nc",
     "<tool_response>t</tool_response>", "\n"]
)


def python_chatml(turns):
    """The layout from its description: header, turns, think blocks after the last question."""
    asked = [
        i for i, (role, text) in enumerate(turns)
        if role == "user"
        and not (text.startswith("<tool_response>") and text.endswith("</tool_response>"))
    ]
    query = max(asked, default=len(turns) - 1)
    pieces = []
    for i, (role, text) in enumerate(turns):
        if role == "assistant":
            head, found, _ = text.partition("</think>")
            thought = head.rstrip("\n").rpartition("<think>")[2].lstrip("\n") if found else ""
            text = text.rpartition("</think>")[2].lstrip("\n") if found else text
            if i > query and (thought or i == len(turns) - 1):
                block = "<think>\n" + thought.strip("\n") + "\n</think>\n\n"
                text = block + text.lstrip("\n")
        pieces.append(f"<|im_start|>{role}\n{text}<|im_end|>\n")
    return "".join(pieces)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(ROLES, CONTENTS), min_size=1, max_size=6), min_size=1,
                max_size=8))
def test_chatml_of_random_conversations(spark, talks):
    rows = [(c, i, *turn) for c, talk in enumerate(talks) for i, turn in enumerate(talk)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")
    texts = conversations.render_chatml(conversations.assemble(turns)).collect()
    assert {r.conv_id: r.text for r in texts} == dict(enumerate(map(python_chatml, talks)))
