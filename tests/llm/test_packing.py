"""Tokens against the tokenizers library, packing against its rules and a plain best fit."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prefspark.llm import packing
from prefspark.llm.tokens import ByteBpe

PATH = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = [
    "",
    " ",
    "\n\n",
    "one two  three\n four \n five",
    " lead and trail ",
    "tab\tand nbsp   x",
    "it's we'll I'D <|endoftext|> done",
    "Größe ñandú 漢字かな 😀😀 é",
    "a" * 300,
    "1234 5678,90 --- ***",
    "x\r\ny \r\n z\x0b\x0cw\x1c q",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_ids_equal_the_library(library):
    texts = TEXTS + [" ".join(TEXTS)]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids_of(r) for r in ByteBpe(PATH).encode_all(texts)] == expected


def test_ids_of_random_texts_and_a_small_cache(library, monkeypatch):
    from prefspark.llm import tokens

    monkeypatch.setattr(tokens, "CACHED_CHUNKS", 20)
    monkeypatch.setattr(tokens, "SEGMENT_CHARS", 17)
    random.seed(3)
    letters = "abcé,.'s  \n\t12😀"
    texts = ["".join(random.choices(letters, k=random.randint(0, 80))) for _ in range(200)]
    encoder = ByteBpe(PATH)
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids_of(encoder.encode_all([text])[0]) == expected, repr(text)


def plain_best_fit(lengths, capacity):
    rooms, placed = [], []
    for length in lengths:
        fitting = [r for r in rooms if r >= length]
        if fitting:
            room = min(fitting)
            rooms[rooms.index(room)] -= length
        else:
            room = capacity
            rooms.append(capacity - length)
        placed.append(capacity - room)
    return placed, len(rooms)


def test_best_fit_equals_a_scan_over_all_bins():
    random.seed(5)
    for _ in range(50):
        capacity = random.choice([1, 2, 7, 64, 100])
        lengths = sorted((random.randint(1, capacity) for _ in range(60)), reverse=True)
        placed = packing.best_fit(lengths, capacity)
        offsets, bins = plain_best_fit(lengths, capacity)
        assert [o for _, o in placed] == offsets
        assert len({b for b, _ in placed}) == bins


def check(rows, texts, library, capacity, end):
    """Every piece is right and every sequence is filled without a gap."""
    by_place = {}
    for r in rows:
        by_place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_place.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    expected = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (low, high) in enumerate(zip(cuts, cuts[1:])):
            crc = zlib.crc32(np.array(ids[low:high], "<u4").tobytes())
            expected.append((doc_id, piece, low, high - low, crc))
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    key = lambda row: (row[0] is None, row)
    assert sorted((tuple(r[n] for n in names) for r in rows), key=repr) == sorted(expected, key=repr)


def test_pieces_and_sequences(docs, library):
    texts = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id"), (50, None)]
    texts.append((51, "long word " * 700))
    table = docs(texts).withColumnRenamed("lang", "row").withColumnRenamed("source", "piece")
    rows = packing.pack_documents(table, PATH, capacity=16).collect()
    check(rows, texts, library, 16, 2)


def test_sequences_hold_the_ids(docs, library):
    texts = [(i, t) for i, t in enumerate(TEXTS)]
    found = packing.sequences(docs(texts), PATH, capacity=64).collect()
    ids = sorted(i for r in found for i in r["ids"])
    every = [i for t in TEXTS for i in library.encode(t, add_special_tokens=False).ids + [2]]
    assert ids == sorted(every) and all(len(r["ids"]) <= 64 for r in found)


def test_no_documents(docs):
    assert packing.pack_documents(docs([]), PATH).count() == 0


def test_other_tokenizer_files_are_refused(tmp_path):
    import json

    import public_tokenizers

    from prefspark.llm.tokens import ByteBpe

    with pytest.raises(ValueError, match="no byte-level BPE file"):
        ByteBpe(public_tokenizers.path("word_bpe_49k.json"))
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        content = json.load(file)
    for change in (
        {"normalizer": {"type": "NFC"}},
        {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}},
        {"model": {**content["model"], "byte_fallback": True}},
        {"model": {**content["model"], "merges": content["model"]["merges"][::-1]}},
    ):
        path = tmp_path / "other.json"
        path.write_text(json.dumps({**content, **change}), encoding="utf-8")
        with pytest.raises(ValueError):
            ByteBpe(str(path))


def test_several_groups_share_no_sequence_and_waste_little(spark, monkeypatch):
    rng = random.Random(8)
    lengths = [rng.choice([1024, rng.randint(1, 1024), rng.randint(1, 60)]) for _ in range(3000)]
    table = spark.createDataFrame(list(enumerate(lengths)), "row long, length long")
    used = {}
    for pieces in (1 << 16, 300):
        monkeypatch.setattr(packing, "GROUP_PIECES", pieces)
        found = packing.pack(table).collect()
        assert sorted(r["row"] for r in found) == list(range(3000))
        held = {}
        for r in sorted(found, key=lambda r: r["offset"]):
            # Pieces of a sequence follow one another without a gap, in one group only.
            assert r["offset"] == held.get(r["sequence_id"], 0)
            held[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(held.values()) <= 1024
        used[pieces] = len(held), len({i >> 32 for i in held})
    assert used[1 << 16][1] == 1 and used[300][1] > 5
    # One more open sequence for each group, and a little for the smaller choice.
    least = -(-sum(lengths) // 1024)
    assert used[1 << 16][0] <= 1.02 * least and used[300][0] <= 1.02 * used[1 << 16][0] + used[300][1]
