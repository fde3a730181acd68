"""Token ids of whole texts, with a cache of white-space separated words.

The vocabulary's pre-tokenizer never joins characters across white space, and its normalizer works on each
character run alone, so the ids of a text are the ids of its words one after the other. Texts that hold the
start of a special token are not lower-cased before the lookup, because those strings are matched as written.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wayfare.llm.common import kept

BATCH_BYTES = 2 << 20  # of text worked on at a time
CACHE_WORDS = 600_000  # forgotten when full; bounds the memory of a worker, never the result
# A comma or full stop after a letter and before white space is a token run of its own.
_STOP = re.compile(rb"(?<=[a-z])([,.])(?=[ \n])")
_STOPS = (b", ", b". ", b",\n", b".\n")
_KINDS = bytes(
    b"a"[0] if 97 <= b <= 122 else b","[0] if b in b",." else b" "[0] if b in b" \n" else b"?"[0] for b in range(256)
)


def byte_alphabet() -> dict[int, str]:
    """The published byte-to-character table of byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def _letters_are_one_run(path: str) -> bool:
    """Whether the file normalizes by NFC and lower case, then takes each run of letters alone, byte by byte."""
    with open(path) as f:
        whole = json.load(f)
    steps = [x["type"] for x in (whole.get("normalizer") or {}).get("normalizers", [])]
    first = (whole.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in first] != ["Split", "ByteLevel"]:
        return False
    return "|[\\p{L}]+|" in first[0]["pattern"].get("Regex", "") and not first[1]["add_prefix_space"] and not first[1]["use_regex"]


class _Ids(dict):
    """The ids of words as bytes, worked out when a word is first asked for."""

    def __init__(self, ids, most: int) -> None:
        super().__init__()
        self.ids, self.most = ids, most

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self[word] = array("I", self.ids(word)).tobytes()
        return found


class WordEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model if _letters_are_one_run(path) else None
        self.alphabet = byte_alphabet()
        self.cache = _Ids(self._ids, cache_words)

    def _ids(self, word: bytes) -> list[int]:
        text = word.decode("utf-8")
        if self.model is not None and "\u03a3" not in text:  # a capital sigma has two small forms
            low = text if text.isascii() and text.islower() else text.lower()
            # A word of letters is one run: it goes to the model as it is, without the search for runs.
            if low.isalpha() and is_normalized("NFC", text):
                if not low.isascii():
                    low = low.encode("utf-8").decode("latin-1").translate(self.alphabet)
                return [t.id for t in self.model.tokenize(low)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _split_ready(self, text: str | bytes | None) -> bytes:
        """A text whose ids are those of its white-space separated words."""
        data = text.encode("utf-8") if isinstance(text, str) else text or b""
        if b"<|" in data:
            return data
        data = data.lower()
        kinds = data.translate(_KINDS)
        if b"?, " in kinds or b",, " in kinds or kinds[:2] == b", " or b" , " in kinds:
            return _STOP.sub(rb" \1", data)
        for stop in _STOPS:  # every stop before white space follows a letter
            data = data.replace(stop, b" " + stop)
        return data

    def many(self, texts: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text ends; null and empty texts have none.

        Words are looked up once per BATCH_BYTES of text, at least one text: Arrow numbers the different ones.
        """
        ids, ends, held, size, total = [], [], [], 0, 0
        for k, text in enumerate(texts):
            held.append(self._split_ready(text))
            size += len(held[-1])
            if size >= BATCH_BYTES or k == len(texts) - 1:
                some, stops = self._looked_up(held)
                ids.append(some)
                ends.append(stops + total)
                held, size, total = [], 0, total + len(some)
        return (np.concatenate(ids), np.concatenate(ends)) if ids else (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _looked_up(self, ready: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = pc.ascii_split_whitespace(pa.array(ready, pa.large_binary()).cast(pa.large_string()))
        numbered = words.flatten().cast(pa.large_binary()).dictionary_encode()
        held = list(map(self.cache.__getitem__, numbered.dictionary.to_pylist()))
        sizes = np.array([len(x) for x in held], np.int64) // 4
        known = np.frombuffer(b"".join(held), dtype="<u4")
        word = numbered.indices.to_numpy()
        size = sizes[word]
        upto = np.append(0, np.cumsum(size))
        place = np.repeat((np.cumsum(sizes) - sizes)[word] - upto[:-1], size) + np.arange(upto[-1])
        return known[place], upto[words.offsets.to_numpy()[1:]]

    def __call__(self, text: str | bytes | None) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return self.many([text])[0].tobytes()


def encoder(path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """The encoder of a Python worker, kept from task to task."""
    return kept((WordEncoder, path, cache_words), lambda: WordEncoder(path, cache_words))


def vocabulary(name: str) -> str:
    """The place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_bpe_path() -> str:
    return vocabulary("word_bpe_49k.json")
