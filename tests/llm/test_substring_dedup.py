"""Removed passages against a plain walk over all windows."""

import hashlib
import random

import pytest

from prefspark.llm import substring_dedup as S


def plain(rows):
    """(doc_id, n_words, n_removed, sha) of each row; a null id comes last."""
    number = lambda doc_id: 1 << 62 if doc_id is None else doc_id
    first = {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - 49):
            key = tuple(words[i : i + 50])
            first[key] = min(first.get(key, 1 << 62), number(doc_id))
    found = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - 49):
            if first[tuple(words[i : i + 50])] < number(doc_id):
                gone[i : i + 50] = [True] * 50
        kept = [w for w, g in zip(words, gone) if not g]
        found.append((doc_id, len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(found, key=repr)


def some_rows(seed):
    random.seed(seed)
    word = lambda: f"w{random.randint(0, 3000)}"
    passages = [[word() for _ in range(random.choice([49, 50, 51, 75, 120, 300]))] for _ in range(8)]
    rows = []
    for i in range(70):
        words = []
        for _ in range(random.randint(0, 4)):
            words += [word() for _ in range(random.randint(0, 60))]
            passage = list(random.choice(passages))
            if random.random() < 0.3:
                passage[random.randrange(len(passage))] = word()
            low = random.randint(0, 20)
            words += passage[low:]
        rows.append((i, random.choice([" ", "\n", " \t "]).join(words)))
    whole = " ".join(word() for _ in range(130))
    rows += [(90, whole), (91, whole.replace(" ", "\n")), (91, whole), (89, whole + " tail"), (92, " ".join(whole.split()[:49]))]
    rows += [(100, "a b c " * 200), (101, "b c a " * 150), (102, "a b c " * 20), (103, "x " * 60), (104, "x " * 49), (105, "y " + "x " * 55)]
    rows += [(110, None), (111, ""), (None, whole), (None, "short one"), (112, "ñ 漢字 " * 40), (113, "z ñ 漢字 " + "ñ 漢字 " * 40)]
    return rows


@pytest.mark.parametrize("seed, words, docs_in_block", [(1, 400_000, 256), (2, 130, 3)])
def test_against_all_windows(docs, monkeypatch, seed, words, docs_in_block):
    monkeypatch.setattr(S, "AUTOMATON_WORDS", words)
    monkeypatch.setattr(S, "BLOCK_DOCS", docs_in_block)
    rows = some_rows(seed)
    random.shuffle(rows)
    table = docs(rows).withColumnRenamed("lang", "id").withColumnRenamed("source", "block")
    found = [tuple(r) for r in S.repeated_words(table).collect()]
    assert sorted(found, key=repr) == plain(rows)


def test_texts_keep_what_is_left_as_it_was(docs):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (2, f"Head\n\n  of it {passage} and\ttail \n"), (3, passage), (4, "alone\n text"), (5, None)]
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in S.without_repeats(docs(rows)).collect()}
    left = "Head\n\n  of it and\ttail \n"
    assert found == {1: (passage, len(passage)), 2: (left, len(left)), 3: ("", 0), 4: ("alone\n text", 11), 5: (None, None)}


def test_common_runs():
    random.seed(4)
    for _ in range(300):
        a = "".join(random.choices("ab", k=random.randint(0, 200)))
        b = a if random.random() < 0.3 else "".join(random.choices("ab", k=random.randint(0, 200)))
        i, j = random.randint(0, len(a)), random.randint(0, len(b))
        forward = next((k for k, (x, y) in enumerate(zip(a[i:], b[j:])) if x != y), min(len(a) - i, len(b) - j))
        back = next((k for k, (x, y) in enumerate(zip(a[:i][::-1], b[:j][::-1])) if x != y), min(i, j))
        assert (S._common(a, i, b, j), S._common_back(a, i, b, j)) == (forward, back)


def test_no_documents(docs):
    assert S.repeated_words(docs([])).count() == 0
    assert S.without_repeats(docs([])).count() == 0


def test_a_common_line_does_not_join_all_blocks_with_all_passages(docs, monkeypatch):
    def asked(with_text):
        def pairs(batches):
            for part in batches:
                rows = [r for r in part.to_pylist() if r["text_key"] is None]
                yield S.pa.RecordBatch.from_pylist(
                    [{"id": r["id"], "text_key": r["block"], "n_removed": 0, "kept_sha256": "", "text": ""} for r in rows],
                    S.pa.schema([("id", "int64"), ("text_key", "int64"), ("n_removed", "int64"), ("kept_sha256", "string"), ("text", "string")]),
                )

        return pairs

    line = " ".join(f"hot{i}" for i in range(30))
    family = lambda f: f"{' '.join(f'a{f}x{i}' for i in range(40))} {line} {' '.join(f'b{f}x{i}' for i in range(40))}"
    rows = [(2 * f + copy, f"own{f}c{copy} {family(f)}") for f in range(40) for copy in (0, 1)]
    found = [tuple(r) for r in S.repeated_words(docs(rows)).collect()]
    assert sorted(found, key=repr) == plain(rows)
    monkeypatch.setattr(S, "BLOCK_DOCS", 2)
    monkeypatch.setattr(S, "_clean", asked)
    assert S._changes(docs(rows), False)[1].count() == 40


def test_a_block_holds_one_automaton_at_a_time(monkeypatch):
    alive = []

    class Counted(S.Automaton):
        now = 0

        def __init__(self, passages):
            super().__init__(passages)
            Counted.now += 1
            alive.append(Counted.now)

        def __del__(self):
            Counted.now -= 1

    monkeypatch.setattr(S, "Automaton", Counted)
    monkeypatch.setattr(S, "AUTOMATON_WORDS", 130)
    passages = [" ".join(f"p{k}x{i}" for i in range(60)) for k in range(9)]
    rows = [(0, 0, 100, 5, "start " + " between ".join(passages)), (0, 0, 3, 6, passages[0])]
    rows += [(0, 1, k, None, p) for k, p in enumerate(passages)]
    rows += [(1, 0, 4, 7, passages[5]), (1, 1, 2, None, passages[5])]
    columns = zip(("block", "role", "id", "text_key", "text"), map(list, zip(*rows)))
    found = [r for b in S._clean(True)([S.pa.RecordBatch.from_pydict(dict(columns))]) for r in b.to_pylist()]
    texts = {r["id"]: (r["text_key"], r["n_removed"], r["text"]) for r in found}
    assert texts == {100: (5, 540, "start " + "between " * 8), 3: (6, 60, ""), 4: (7, 60, "")}
    assert len(alive) == 6 and max(alive) == 1


def test_a_passage_with_more_words_than_letters(monkeypatch):
    monkeypatch.setattr(S, "_FIRST_LETTER", 0x10FFFF - 0x800 - 500)
    monkeypatch.setattr(S, "AUTOMATON_WORDS", 400)
    monkeypatch.setattr(S, "STRETCH_WINDOWS", 100, raising=False)
    shared = [b"w%d" % i for i in range(2000)]
    text = b" ".join(shared).decode()
    windows = S.gram_hashes(shared, S.WINDOW).view(S.np.int64)
    source = {"id": [1], "text": [text], "windows": [windows]}
    listed = [r for b in S._passages([S.pa.RecordBatch.from_pydict(source)]) for r in b.to_pylist()]
    assert sorted(w for r in listed for w in r["windows"]) == sorted(windows.tolist())
    rows = [(0, 0, 2, 5, f"head {text} tail"), *((0, 1, r["first"], None, r["text"]) for r in listed)]
    columns = zip(("block", "role", "id", "text_key", "text"), map(list, zip(*rows)))
    found = [r for b in S._clean(True)([S.pa.RecordBatch.from_pydict(dict(columns))]) for r in b.to_pylist()]
    assert [(r["id"], r["n_removed"], r["text"]) for r in found] == [(2, 2000, "head tail")]


def test_largest_id_and_clashing_columns(spark, docs):
    words = " ".join(f"w{i}" for i in range(70))
    last = (1 << 63) - 1
    table = docs([(5, words), (last, words + " x"), (None, words + " y")])
    found = {r["doc_id"]: r["n_removed"] for r in S.repeated_words(table).collect()}
    assert found == {5: 0, last: 70, None: 70}
    named = table.selectExpr("*", "doc_id as _id", "doc_id as _text", "doc_id as id", "doc_id as text_key")
    cut = S.without_repeats(named)
    assert cut.columns == named.columns
    assert {r["doc_id"]: (r["text"], r["_id"], r["_text"], r["id"], r["text_key"]) for r in cut.collect()} == {
        5: (words, 5, 5, 5, 5), last: ("x", last, last, last, last), None: ("y", None, None, None, None)
    }
