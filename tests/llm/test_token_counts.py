"""Rollups against a recount of what is there, through random batches and repeated commits."""

import random
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prefspark.llm import token_counts as C
from prefspark.shared_storage import new_table_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
SHAPE = "doc_id long, source string, lang string, tokenizer string, tokens long"


def totals(ledger):
    return {tuple(r)[:3]: tuple(r)[3:] for r in ledger.totals().collect()}


def recount(state):
    found = Counter(), Counter()
    for (_, tokenizer), (source, lang, tokens) in state.items():
        found[0][source, lang, tokenizer] += 1
        found[1][source, lang, tokenizer] += tokens
    return {k: (n, found[1][k]) for k, n in found[0].items()}


def test_counts_equal_the_libraries(docs):
    texts = [(1, "Hello  world"), (2, None), (3, ""), (4, "ñandú 漢字 <|endoftext|>")]
    versions = {"bpe": PATH, "bytes": None}
    found = {(r["doc_id"], r["tokenizer"]): r["tokens"] for r in C.count_tokens(docs(texts), versions).collect()}
    library = Tokenizer.from_file(PATH)
    for doc_id, text in texts:
        assert found[doc_id, "bpe"] == len(library.encode(text or "", add_special_tokens=False).ids)
        assert found[doc_id, "bytes"] == len((text or "").encode())


def test_random_batches_committed_again_and_again(spark):
    random.seed(6)
    ledger, state = C.Ledger(spark, new_table_path(spark, "ledger")), {}
    for batch in range(1, 5):
        ids = random.sample(range(12), 6)
        rows = [
            (i, random.choice(["s", None]), random.choice(["en", None]), t, random.randint(0, 9))
            for i in ids for t in ("a", "b") if random.random() < 0.7
        ]
        gone = random.sample(range(14), 4)
        deleted = spark.createDataFrame([(i,) for i in [*gone, gone[0], None]], "doc_id long")
        for _ in range(2 if batch % 2 else 1):
            ledger.commit(batch, spark.createDataFrame(rows, SHAPE), deleted)
        state = {k: v for k, v in state.items() if k[0] not in gone}
        state |= {(i, t): (s, l, n) for i, s, l, t, n in rows}
        assert totals(ledger) == recount(state)
        kept = {(r["doc_id"], r["tokenizer"]) for r in ledger.documents().collect()}
        assert kept == set(state)


def test_empty_ledger_and_empty_batch(spark):
    ledger = C.Ledger(spark, new_table_path(spark, "ledger"))
    assert totals(ledger) == {}
    ledger.commit(1, spark.createDataFrame([], SHAPE))
    assert totals(ledger) == {}


@pytest.mark.parametrize("rows", [[(1, "s", "l", "a", 1)] * 2, [(None, "s", "l", "a", 1)]])
def test_rows_that_cannot_be_revised_are_refused(spark, rows):
    ledger = C.Ledger(spark, new_table_path(spark, "ledger"))
    with pytest.raises(Exception, match="null or occurs twice"):
        ledger.commit(1, spark.createDataFrame(rows, SHAPE))


def test_query_equals_a_recount(spark):
    from prefspark.llm.queries import op7_token_counts

    sf_dir = "/root/testdata/sf0.001"
    library, state = Tokenizer.from_file(PATH), {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        source, text = r["source"], r["text"]
        if r["doc_id"] % 11 == 0:
            source, text = "revised", f"{text}\n{text}"
        elif r["doc_id"] % 7 == 0:
            continue
        state[r["doc_id"], "utf8_bytes"] = (source, r["lang"], len(text.encode()))
        ids = library.encode(text, add_special_tokens=False).ids
        state[r["doc_id"], "byte_bpe_50k"] = (source, r["lang"], len(ids))
    found = {tuple(r)[:3]: tuple(r)[3:] for r in op7_token_counts(spark, sf_dir).collect()}
    assert found == recount(state)


def test_repeated_and_null_ids_add_up(spark):
    random.seed(9)
    ledger, state, unnamed = C.Ledger(spark, new_table_path(spark, "ledger")), {}, []
    for batch in range(1, 5):
        rows = [
            (random.choice([None, *range(6)]), random.choice(["s", "r", None]), "en", t, random.randint(0, 9))
            for _ in range(8) for t in ("a", "b")
        ]
        rows += random.sample(rows, 4)
        gone = random.sample(range(8), 2)
        deleted = spark.createDataFrame([(i,) for i in [*gone, None]], "doc_id long")
        for _ in range(2):
            ledger.commit(batch, spark.createDataFrame(rows, SHAPE), deleted, unique=False)
        named = {(i, t) for i, _, _, t, _ in rows if i is not None}
        state = {k: v for k, v in state.items() if k[0] not in gone and k not in named}
        for i, s, l, t, n in rows:
            (unnamed if i is None else state.setdefault((i, t), [])).append((s, l, t, n))
        docs, tokens = Counter(), Counter()
        for s, l, t, n in [*unnamed, *(r for some in state.values() for r in some)]:
            docs[s, l, t] += 1
            tokens[s, l, t] += n
        assert totals(ledger) == {k: (n, tokens[k]) for k, n in docs.items()}
        assert sum(r["docs"] for r in ledger.documents().collect()) == sum(docs.values())


def test_query_counts_rows_with_null_and_repeated_ids(spark, docs, tmp_path):
    from prefspark.llm.queries import op7_token_counts

    rows = [(1, "ab", "en", "s"), (1, "ab", "en", "s"), (None, "abc", "en", "s"), (None, None, None, None)]
    rows += [(11, "x", "en", "s"), (11, "x", "en", "s"), (7, "gone", "en", "s"), (7, "gone", "de", "s")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = {tuple(r)[:3]: tuple(r)[3:] for r in op7_token_counts(spark, str(tmp_path)).collect()}
    bytes_only = {k[:2]: v for k, v in found.items() if k[2] == "utf8_bytes"}
    assert bytes_only == {("s", "en"): (3, 7), (None, None): (1, 0), ("revised", "en"): (2, 6)}


def test_a_batch_puts_only_its_own_documents_in_order(spark):
    ledger = C.Ledger(spark, new_table_path(spark, "ledger"))
    rows = [(i, "s", "en", "a", 1) for i in range(200)]
    ledger.commit(1, spark.createDataFrame(rows, SHAPE))
    asked = spark.createDataFrame([(3,), (500,)], "doc_id long")
    found = ledger.documents(before=2, ids=asked)
    assert [r["doc_id"] for r in found.collect()] == [3]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The join comes below the window, which is printed first.
    assert plan.index("Window") < plan.index("LeftSemi")
