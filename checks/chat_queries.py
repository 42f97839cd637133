"""Queries over prompts, messages and conversations."""

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.pair_queries import PAIRS
from checks.registry import query
from prefspark.functions import chat, messages, models, text
from prefspark.operators import conversations, pairing, preference
from prefspark.plans import flows

# ---------------------------------------------------------------- models and prompts


@query(f"""
  SELECT doc_id, model, NOT coalesce(contains(lower(model), 'gemma'), false) AS system_role,
         coalesce(contains(lower(model), 'qwen'), false) AS qwen
  FROM {fx.REQUESTS} r""")
def model_family_flags(spark, sf):
    model = F.col("model")
    return fx.requests(spark, sf).select(
        "doc_id",
        "model",
        models.supports_system_role(model).alias("system_role"),
        models.is_qwen_family(model).alias("qwen"),
    )


@query(f"""
  SELECT doc_id, coalesce(override, configured, contains(lower(model), 'qwen'), false)
         AS thinking
  FROM {fx.REQUESTS} r""")
def thinking_flag(spark, sf):
    flag = models.thinking_flag(F.col("override"), F.col("configured"), F.col("model"))
    return fx.requests(spark, sf).select("doc_id", flag.alias("thinking"))


@query(rf"""
  SELECT doc_id, concat(E'### Instruction\n', question, E'\n\n### Steering Direction\n',
                        direction) AS prompt
  FROM {fx.REQUESTS} r""")
def prompt_text(spark, sf):
    prompt = text.prompt_text(F.col("question"), F.col("direction"))
    return fx.requests(spark, sf).select("doc_id", prompt.alias("prompt"))


STEERED = rf"""(
  SELECT *, concat(E'### Instruction\n', trim(question, E' \t\n'), E'\n\n### ',
                   CASE WHEN reverse THEN 'Suppressing' ELSE 'Steering' END,
                   E' Direction\n', trim(direction, E' \t\n')) AS prompt
  FROM {fx.REQUESTS} r)"""


@query(f"SELECT doc_id, prompt FROM {STEERED} s")
def prompt_text_stripped(spark, sf):
    prompt = text.steered_prompt_text(F.col("question"), F.col("direction"), F.col("reverse"))
    return fx.requests(spark, sf).select("doc_id", prompt.alias("prompt"))


@query(r"""
  SELECT doc_id, replace(content, E'### Steering Direction\n', E'### Suppressing Direction\n')
         AS content
  FROM (SELECT doc_id, concat(E'### Steering Direction\n', text,
               CASE WHEN doc_id % 2 = 0 THEN E'\n### Steering Direction\nx'
                    ELSE '### Steering Direction' END) AS content FROM documents)""")
def replace_header(spark, sf):
    tail = F.when(F.col("doc_id") % 2 == 0, "\n" + text.STEERING_HEADER + "x").otherwise(
        text.STEERING_HEADER.rstrip("\n")
    )
    content = F.concat(F.lit(text.STEERING_HEADER), F.col("text"), tail)
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", text.to_suppressing(content).alias("content"))


def flat_records(records, *keep):
    """One-message lists as scalar columns."""
    columns = []
    for name in ("prompt", "chosen", "rejected"):
        first = F.get(F.col(name), F.lit(0))
        columns += [
            first["role"].alias(f"{name}_role"),
            first["content"].alias(f"{name}_content"),
            F.size(name).alias(f"{name}_size"),
        ]
    return records.select(*keep, *columns)


def flat_records_sql(pairs, keep, reverse=False):
    chosen, rejected = ("rejected", "chosen") if reverse else ("chosen", "rejected")
    prompt = "prompt"
    if reverse:
        prompt = (
            r"replace(prompt, E'### Steering Direction\n', E'### Suppressing Direction\n')"
        )
    return f"""
      SELECT {keep}'user' AS prompt_role, {prompt} AS prompt_content, 1 AS prompt_size,
             'assistant' AS chosen_role, {chosen} AS chosen_content, 1 AS chosen_size,
             'assistant' AS rejected_role, {rejected} AS rejected_content, 1 AS rejected_size
      FROM {pairs} p"""


@query(flat_records_sql(PAIRS, "input, output_concept, "))
def pair_records(spark, sf):
    pairs = pairing.build_pairs(fx.triples(spark, sf))
    return flat_records(
        preference.pair_records(pairs, "input", "output_concept"), "input", "output_concept"
    )


@query(flat_records_sql(PAIRS, "input, output_concept, ", reverse=True))
def reverse_pairs(spark, sf):
    pairs = pairing.build_pairs(fx.triples(spark, sf))
    records = preference.pair_records(pairs, "input", "output_concept")
    return flat_records(preference.reverse_preference(records), "input", "output_concept")


@query(rf"""
  SELECT doc_id, 0 AS position,
         CASE WHEN system <> '' AND gemma THEN 'user'
              WHEN system <> '' THEN 'system' ELSE 'user' END AS role,
         CASE WHEN system <> '' AND gemma THEN concat(system, E'\n\n', direction)
              WHEN system <> '' THEN system ELSE direction END AS content
  FROM (SELECT *, coalesce(contains(lower(model), 'gemma'), false) AS gemma FROM {fx.REQUESTS} r)
  UNION ALL
  SELECT doc_id, 1 AS position, 'user' AS role, direction AS content
  FROM (SELECT *, coalesce(contains(lower(model), 'gemma'), false) AS gemma FROM {fx.REQUESTS} r)
  WHERE system <> '' AND NOT gemma""")
def build_messages(spark, sf):
    built = messages.build_messages(
        F.col("direction"), F.col("system"), models.supports_system_role(F.col("model"))
    )
    exploded = fx.requests(spark, sf).select("doc_id", F.posexplode(built))
    return exploded.select("doc_id", F.col("pos").alias("position"), "col.role", "col.content")


PROMPT_SHAPES = """(
  SELECT conv_id, turn, CASE (conv_id + turn) % 6
    WHEN 0 THEN text
    WHEN 1 THEN to_json({'role': role, 'content': text})::VARCHAR
    WHEN 2 THEN to_json([{'role': role, 'content': text},
                         {'role': 'user', 'content': turn::VARCHAR}])::VARCHAR
    WHEN 3 THEN to_json({'role': role, 'contents': text})::VARCHAR
    WHEN 4 THEN '[]'
    ELSE to_json([{'role': role, 'contents': text}])::VARCHAR END AS prompt
  FROM conversations)"""


@query(f"""
  WITH v AS (SELECT *, CASE WHEN json_valid(prompt) THEN prompt END AS doc FROM {PROMPT_SHAPES} s),
  p AS (SELECT *, coalesce(json_type(doc), 'TEXT') AS shape FROM v),
  m AS (
    SELECT conv_id, turn, 0 AS position, 'user' AS role, prompt AS content,
           CAST(NULL AS VARCHAR) AS error FROM p WHERE shape NOT IN ('OBJECT', 'ARRAY')
    UNION ALL
    SELECT conv_id, turn, 0, json_extract_string(doc, '$.role'),
           json_extract_string(doc, '$.content'), NULL
    FROM p WHERE shape = 'OBJECT' AND json_exists(doc, '$.role')
                 AND json_exists(doc, '$.content')
    UNION ALL
    SELECT conv_id, turn, i, json_extract_string(doc, '$[' || i || '].role'),
           json_extract_string(doc, '$[' || i || '].content'), NULL
    FROM (SELECT *, unnest(range(json_array_length(doc)::BIGINT)) AS i FROM p WHERE shape = 'ARRAY')
    WHERE json_exists(doc, '$[0].content')
    UNION ALL
    SELECT conv_id, turn, -1, NULL, NULL, 'prompt object lacks role or content'
    FROM p WHERE shape = 'OBJECT' AND NOT json_exists(doc, '$.content')
    UNION ALL
    SELECT conv_id, turn, -1, NULL, NULL, 'prompt list is empty' FROM p WHERE prompt = '[]'
    UNION ALL
    SELECT conv_id, turn, -1, NULL, NULL, 'prompt list holds an item without role and content'
    FROM p WHERE shape = 'ARRAY' AND json_array_length(doc) > 0
                 AND NOT json_exists(doc, '$[0].content'))
  SELECT * FROM m""")
def normalise_prompts(spark, sf):
    body, role, kind = F.col("text"), F.col("role"), (F.col("conv_id") + F.col("turn")) % 6
    good = F.struct(role.alias("role"), body.alias("content"))
    numbered = F.struct(
        F.lit("user").alias("role"), F.col("turn").cast("string").alias("content")
    )
    misnamed = F.struct(role.alias("role"), body.alias("contents"))
    prompt = (
        F.when(kind == 0, body)
        .when(kind == 1, F.to_json(good))
        .when(kind == 2, F.to_json(F.array(good, numbered)))
        .when(kind == 3, F.to_json(misnamed))
        .when(kind == 4, "[]")
        .otherwise(F.to_json(F.array(misnamed)))
    )
    prompts = fx.table(spark, sf, "conversations").select(
        "conv_id", "turn", messages.normalise_prompt(prompt).alias("p")
    )
    exploded = prompts.select(
        "conv_id", "turn", F.col("p.error").alias("error"), F.posexplode_outer("p.messages")
    )
    position = F.coalesce(F.col("pos").cast("long"), F.lit(-1)).alias("position")
    return exploded.select("conv_id", "turn", position, "col.role", "col.content", "error")


# ---------------------------------------------------------------- conversations

LAST_QUERY = """coalesce(
  max(CASE WHEN role = 'user' AND NOT (starts_with(content, '<tool_response>')
                                   AND ends_with(content, '</tool_response>')) THEN turn END)
  {over}, max(turn) {over})"""


@query(f"""
  SELECT conv_id, {LAST_QUERY.format(over="")} AS last_query_turn
  FROM {fx.THINKING_TURNS} t GROUP BY conv_id""")
def last_query_turn(spark, sf):
    return conversations.last_query_turn(fx.thinking_turns(spark, sf))


VIOLATIONS = f"""(
  SELECT conv_id, turn, position, role,
         CASE WHEN position = 0 AND role = 'system' THEN 'a system turn comes first'
              ELSE 'user and assistant turns do not alternate' END AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position
        FROM {fx.TURNS} t)
  WHERE (position = 0 AND role = 'system') OR (role = 'user') <> (position % 2 = 0))"""


@query(f"SELECT * FROM {VIOLATIONS} v")
def alternation_violations(spark, sf):
    return conversations.alternation_violations(fx.turns(spark, sf))


REASONING = r"""CASE WHEN contains(content, '</think>') THEN
  ltrim(string_split(rtrim(split_part(content, '</think>', 1), E'\n'), '<think>')[-1], E'\n')
  ELSE '' END"""
ANSWER = r"""CASE WHEN contains(content, '</think>')
  THEN ltrim(string_split(content, '</think>')[-1], E'\n') ELSE content END"""


@query(f"""
  SELECT conv_id, turn, {REASONING} AS reasoning, {ANSWER} AS answer
  FROM {fx.THINKING_TURNS} t WHERE role = 'assistant'""")
def split_reasoning(spark, sf):
    content = F.col("content")
    return (
        fx.thinking_turns(spark, sf)
        .where(F.col("role") == "assistant")
        .select(
            "conv_id",
            "turn",
            chat.reasoning_part(content).alias("reasoning"),
            chat.answer_part(content).alias("answer"),
        )
    )


@query(rf"""
  SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'model' ELSE role END AS role,
         trim(concat(E'\n ', content, E'\t'), E' \t\n') AS content
  FROM {fx.TURNS} t""")
def gemma_turns(spark, sf):
    padded = F.concat(F.lit("\n "), F.col("content"), F.lit("\t"))
    return fx.turns(spark, sf).select(
        "conv_id",
        "turn",
        chat.turn_tag_role(F.col("role")).alias("role"),
        text.strip(padded).alias("content"),
    )


def chatml_turns_sql(turns):
    return rf"""(
      SELECT conv_id, turn, concat('<|im_start|>', role, E'\n',
          CASE WHEN role <> 'assistant' THEN content
               WHEN turn > query AND (turn = last OR reasoning <> '')
               THEN concat(E'<think>\n', trim(reasoning, E'\n'), E'\n</think>\n\n',
                           ltrim(answer, E'\n'))
               ELSE answer END, E'<|im_end|>\n') AS piece
      FROM (SELECT *, {REASONING} AS reasoning, {ANSWER} AS answer,
                   {LAST_QUERY.format(over="OVER (PARTITION BY conv_id)")} AS query,
                   max(turn) OVER (PARTITION BY conv_id) AS last FROM {turns} t))"""


def chatml_sql(turns):
    return f"""(
      SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS text
      FROM {chatml_turns_sql(turns)} p GROUP BY conv_id)"""


TURN_TAGS = rf"""(
  SELECT conv_id, error, CASE WHEN error IS NULL THEN concat('<bos>', body) END AS text
  FROM (SELECT conv_id, string_agg(
          concat('<start_of_turn>', CASE WHEN role = 'assistant' THEN 'model' ELSE role END,
                 E'\n', trim(content, E' \t\n'), E'<end_of_turn>\n'), '' ORDER BY turn) AS body
        FROM {fx.TURNS} t GROUP BY conv_id)
  LEFT JOIN (SELECT conv_id, min(reason) AS error FROM {VIOLATIONS} v GROUP BY conv_id)
    USING (conv_id))"""


HEADER_IDS = rf"""(
  SELECT conv_id, concat(
    '<|begin_of_text|><|start_header_id|>system<|end_header_id|>', E'\n\n',
    E'Cutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n',
    coalesce(max(CASE WHEN turn = 0 AND role = 'system' THEN trim(content, E' \t\n') END), ''),
    '<|eot_id|>',
    coalesce(string_agg(concat('<|start_header_id|>', role, E'<|end_header_id|>\n\n',
      trim(content, E' \t\n'), '<|eot_id|>'), '' ORDER BY turn)
      FILTER (NOT (turn = 0 AND role = 'system')), '')) AS text
  FROM {fx.TURNS} t GROUP BY conv_id)"""


@query(f"""
  SELECT conv_id, text FROM {chatml_sql(fx.THINKING_TURNS)} c""")
def render_chatml(spark, sf):
    assembled = conversations.assemble(fx.thinking_turns(spark, sf))
    return conversations.render_chatml(assembled).select("conv_id", "text")


@query(f"SELECT * FROM {chatml_turns_sql(fx.THINKING_TURNS)} p")
def render_chatml_turns(spark, sf):
    return conversations.chatml_turns(fx.thinking_turns(spark, sf))


@query(f"SELECT conv_id, text, error FROM {TURN_TAGS} c")
def render_turn_tags(spark, sf):
    return conversations.render_turn_tags(conversations.assemble(fx.turns(spark, sf)))


@query(rf"""
  SELECT conv_id, turn, concat(
    CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN '<bos>' ELSE '' END,
    '<start_of_turn>', CASE WHEN role = 'assistant' THEN 'model' ELSE role END,
    E'\n', trim(content, E' \t\n'), E'<end_of_turn>\n') AS piece
  FROM {fx.TURNS} t""")
def render_turn_tag_turns(spark, sf):
    return conversations.turn_tag_turns(fx.turns(spark, sf))


@query(rf"""
  SELECT conv_id, turn, concat(
    CASE WHEN first THEN concat(
      '<|begin_of_text|><|start_header_id|>system<|end_header_id|>', E'\n\n',
      E'Cutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n',
      CASE WHEN role = 'system' THEN trim(content, E' \t\n') ELSE '' END, '<|eot_id|>')
    ELSE '' END,
    CASE WHEN first AND role = 'system' THEN '' ELSE concat(
      '<|start_header_id|>', role, E'<|end_header_id|>\n\n', trim(content, E' \t\n'),
      '<|eot_id|>') END) AS piece
  FROM (SELECT *, turn = min(turn) OVER (PARTITION BY conv_id) AS first FROM {fx.TURNS} t)""")
def render_header_turns(spark, sf):
    return conversations.header_turns(fx.turns(spark, sf))


@query(f"SELECT conv_id, text FROM {HEADER_IDS} c")
def render_header_ids(spark, sf):
    rendered = conversations.render_header_ids(conversations.assemble(fx.turns(spark, sf)))
    return rendered.select("conv_id", "text")


@query(rf"""
  SELECT conv_id,
         concat(c.text, E'<|im_start|>assistant\n',
                CASE WHEN conv_id % 3 = 1 THEN E'<think>\n\n</think>\n\n' ELSE '' END) AS chatml,
         t.text || E'<start_of_turn>model\n' AS turn_tags,
         concat(h.text, E'<|start_header_id|>assistant<|end_header_id|>\n\n') AS header_ids
  FROM {chatml_sql(fx.TURNS)} c JOIN {TURN_TAGS} t USING (conv_id)
  JOIN {HEADER_IDS} h USING (conv_id)""")
def render_generation_prompt(spark, sf):
    m, kind = F.col("messages"), F.col("conv_id") % 3
    thinking = F.when(kind == 0, True).when(kind == 1, False)
    tags = F.when(chat.alternation_error(m).isNull(), chat.turn_tags(m))
    return conversations.assemble(fx.turns(spark, sf)).select(
        "conv_id",
        F.concat(chat.chatml(m), chat.chatml_suffix(thinking)).alias("chatml"),
        F.concat(tags, chat.turn_tag_suffix()).alias("turn_tags"),
        F.concat(chat.header_ids(m), chat.header_suffix()).alias("header_ids"),
    )


def _given(content):
    """Reasoning that stands beside the content of some turns."""
    return F.when(F.col("turn") % 3 == 1, F.concat(F.lit("\n"), F.substring(content, 1, 9), F.lit("\n")))


GIVEN_TURNS = rf"""(
  SELECT *, CASE WHEN turn % 3 = 1 THEN concat(E'\n', substr(content, 1, 9), E'\n') END AS given
  FROM {fx.THINKING_TURNS} t)"""
GIVEN_REASONING = f"coalesce(given, {REASONING})"
GIVEN_ANSWER = f"CASE WHEN given IS NULL THEN {ANSWER} ELSE content END"
GIVEN_PIECES = chatml_turns_sql(GIVEN_TURNS).replace(REASONING, GIVEN_REASONING).replace(ANSWER, GIVEN_ANSWER)


@query(f"SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS text FROM {GIVEN_PIECES} p GROUP BY conv_id")
def render_given_reasoning(spark, sf):
    """ChatML of turns whose reasoning stands beside their content."""
    turns = fx.thinking_turns(spark, sf).withColumn("reasoning_content", _given(F.col("content")))
    return conversations.render_chatml(conversations.assemble(turns)).select("conv_id", "text")


TAG_PIECES = rf"""
  SELECT conv_id, turn, concat(
    CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN '<bos>' ELSE '' END,
    '<start_of_turn>', CASE WHEN role = 'assistant' THEN 'model' ELSE role END,
    E'\n', trim(content, E' \t\n'), E'<end_of_turn>\n') AS piece
  FROM {fx.TURNS} t"""
HEADER_PIECES = rf"""
  SELECT conv_id, turn, concat(
    CASE WHEN turn = 0 THEN concat(
      '<|begin_of_text|><|start_header_id|>system<|end_header_id|>', E'\n\n',
      E'Cutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n',
      CASE WHEN role = 'system' THEN trim(content, E' \t\n') ELSE '' END, '<|eot_id|>') ELSE '' END,
    CASE WHEN turn = 0 AND role = 'system' THEN '' ELSE
      concat('<|start_header_id|>', role, E'<|end_header_id|>\n\n', trim(content, E' \t\n'), '<|eot_id|>') END) AS piece
  FROM {fx.TURNS} t"""


def _opened(pieces, suffix):
    return f"""
      SELECT conv_id, turn, piece FROM ({pieces}) a
      UNION ALL SELECT conv_id, max(turn) + 1, {suffix} FROM ({pieces}) b GROUP BY conv_id"""


CHATML_OPENED = _opened(
    f"SELECT * FROM {GIVEN_PIECES} p",
    r"concat(E'<|im_start|>assistant\n', CASE WHEN conv_id % 3 = 1 THEN E'<think>\n\n</think>\n\n' ELSE '' END)",
)


@query(rf"""
  SELECT 'chatml' AS layout, * FROM ({CHATML_OPENED}) c
  UNION ALL SELECT 'turn_tags', * FROM ({_opened(TAG_PIECES, r"E'<start_of_turn>model\n'")}) t
  UNION ALL SELECT 'header_ids', * FROM (
    {_opened(HEADER_PIECES, r"E'<|start_header_id|>assistant<|end_header_id|>\n\n'")}) h""")
def render_generation_turns(spark, sf):
    """All layouts turn by turn, with one more piece that opens the answer."""
    turns, kind = fx.turns(spark, sf), F.col("conv_id") % 3
    given = fx.thinking_turns(spark, sf).withColumn("reasoning_content", _given(F.col("content")))
    thinking = F.when(kind == 0, True).when(kind == 1, False)
    layouts = {
        "chatml": conversations.chatml_turns(given, True, thinking),
        "turn_tags": conversations.turn_tag_turns(turns, True),
        "header_ids": conversations.header_turns(turns, generation=True),
    }
    parts = [df.select(F.lit(name).alias("layout"), "*") for name, df in layouts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


STEERED_PROMPTS = rf"""(
  SELECT doc_id, CASE
    WHEN qwen THEN concat(
      CASE WHEN system <> '' THEN concat(E'<|im_start|>system\n', system, E'<|im_end|>\n')
           ELSE '' END,
      E'<|im_start|>user\n', prompt, E'<|im_end|>\n<|im_start|>assistant\n',
      CASE WHEN NOT thinking THEN E'<think>\n\n</think>\n\n' ELSE '' END)
    WHEN gemma THEN concat(
      E'<bos><start_of_turn>user\n',
      CASE WHEN system <> '' THEN concat(system, E'\n\n') ELSE '' END, prompt,
      E'<end_of_turn>\n<start_of_turn>model\n')
    ELSE concat(
      E'<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n',
      E'Cutting Knowledge Date: December 2023\nToday Date: 26 Jul 2024\n\n',
      coalesce(system, ''), E'<|eot_id|><|start_header_id|>user<|end_header_id|>\n\n', prompt,
      E'<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n') END AS rendered
  FROM (SELECT *, coalesce(contains(lower(model), 'qwen'), false) AS qwen,
               coalesce(contains(lower(model), 'gemma'), false) AS gemma,
               coalesce(override, configured, contains(lower(model), 'qwen'), false) AS thinking
        FROM {STEERED} s))"""


@query(f"SELECT * FROM {STEERED_PROMPTS} s")
def steered_prompts(spark, sf):
    thinking = models.thinking_flag(F.col("override"), F.col("configured"), F.col("model"))
    rendered = flows.steered_prompts(fx.requests(spark, sf), F.col("system"), thinking)
    return rendered.select("doc_id", "rendered")
