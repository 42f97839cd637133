"""Byte-level BPE ids of whole texts, in the ids of a ``tokenizers`` JSON file."""

import functools
import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# The split before the merges that a byte-level model with ``use_regex`` makes. Fixed value.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
CACHED_CHUNKS = 400_000
SEGMENT_CHARS = 1_000_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


def _bytes_of_letters():
    """The letters that stand for bytes in such files: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _require_byte_level(content, path):
    """Refuses files that this encoder would read wrongly."""
    model, before = content["model"], content.get("pre_tokenizer") or {}
    fit = {
        "a BPE model": model.get("type") in ("BPE", None) and "merges" in model,
        "no normaliser": content.get("normalizer") is None,
        "a byte-level split": before.get("type") == "ByteLevel" and before.get("use_regex", True),
        "no space in front": not before.get("add_prefix_space", False),
        "no unknown token, dropout, prefix, suffix or byte fallback": not any(
            model.get(k)
            for k in ("unk_token", "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        ),
    }
    wrong = [what for what, holds in fit.items() if not holds]
    if wrong:
        raise ValueError(f"{path} is no byte-level BPE file of the kind read here; it lacks {wrong}")
    # Ranks are taken from the ids, so merges have to come in the order of what they make.
    vocabulary = model["vocab"]
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    made = [vocabulary["".join(pair)] for pair in pairs]
    if made != sorted(made):
        raise ValueError(f"{path} has merges in another order than the ids of what they make")


class ByteBpe:
    """Encodes texts, remembering the ids of chunks between single spaces.

    A single space between two other non-space characters always starts a new piece of the
    split, so such chunks can be encoded apart. Chunks that touch other white space are not
    remembered: their segment is encoded as it stands. Texts that hold the string of a
    special token go to the ``tokenizers`` library itself.
    """

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        _require_byte_level(content, path)
        letters = _bytes_of_letters()
        special = {t["content"] for t in content["added_tokens"]}
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in content["model"]["vocab"].items()
            if token not in special
        }
        self._path, self._special = path, special
        self._bpe = tiktoken.Encoding(
            "file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self._widths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self._widths[i] = len(token)
        self._chunks = {}

    @functools.cached_property
    def _library(self):
        return Tokenizer.from_file(self._path)

    def encode_all(self, texts):
        """For each text its ids as little-endian 32-bit numbers in one bytes object."""
        segments = [self._segments(t) for t in texts]
        self._learn({c for parts in segments for _, chunks in parts for c in chunks})
        return [
            self._by_library(t) if self._holds_special(t) else b"".join(map(self._segment, parts))
            for t, parts in zip(texts, segments)
        ]

    def _holds_special(self, text):
        return bool(text) and any(s in text for s in self._special)

    def _by_library(self, text):
        return _packed(self._library.encode(text, add_special_tokens=False).ids)

    def _segments(self, text):
        """(text, chunks after its first) of stretches that start before a single space."""
        if not text or self._holds_special(text):
            return []
        cuts, at = [0], SEGMENT_CHARS
        while at < len(text) and (found := _CUT.search(text, at)):
            cuts.append(found.start())
            at = found.start() + SEGMENT_CHARS
        cuts.append(len(text))
        pieces = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        return [(p, p.split(" ")[1:]) for p in pieces]

    def _segment(self, segment):
        """Ids of a stretch. Its first chunk has no space before it, or is empty."""
        text, chunks = segment
        known = list(map(self._chunks.__getitem__, chunks))
        first = text[: text.find(" ")] if chunks else text
        if None in known or first[-1:].isspace():
            return _packed(self._bpe.encode_ordinary(text))
        return _packed(self._bpe.encode_ordinary(first)) + b"".join(known)

    def _learn(self, wanted):
        """Encode unseen chunks in one go and cut the ids where the bytes of a chunk end."""
        unseen = wanted - self._chunks.keys()
        if len(unseen) + len(self._chunks) > CACHED_CHUNKS:
            self._chunks, unseen = {}, wanted
        safe = []
        for chunk in unseen:
            if not chunk or chunk[0].isspace() or chunk[-1].isspace():
                self._chunks[chunk] = None
            else:
                safe.append(chunk)
        if not safe:
            return
        ids = np.array(self._bpe.encode_ordinary(" " + " ".join(safe)), dtype="<u4")
        widths = np.fromiter((len(c.encode()) + 1 for c in safe), np.int64, len(safe))
        ends = np.searchsorted(np.cumsum(self._widths[ids]), np.cumsum(widths)) + 1
        raw, start = ids.tobytes(), 0
        for chunk, end in zip(safe, (ends * 4).tolist()):
            self._chunks[chunk] = raw[start:end]
            start = end


def _packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=4)
def byte_bpe(path):
    """One encoder for each file and worker process."""
    return ByteBpe(path)
