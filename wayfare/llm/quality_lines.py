"""Line-first cleaning: rules judge each line, failed lines go, and a document that loses too much text is rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import mapped, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SHOUT = re.compile(r"[!?]{2,}(?=[\x20\x09-\x0D]|$)")
_LETTER = re.compile(r"[^\W_]")
_NAVIGATION = re.compile(r"(?:\||»|›|>|•|·)\s*\S+.*(?:\||»|›|>|•|·)")
_BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|we use cookies|"
    r"accept (?:all )?cookies|enable javascript|javascript is disabled|subscribe to (?:our|the)|sign up for|"
    r"log ?in to|click here|read more|share (?:this|on)|follow us|back to top|skip to (?:main )?content|"
    r"lorem ipsum|©|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados",
    re.IGNORECASE,
)


class Limits:
    """Parameters of the rules."""

    symbol_share = 0.25  # of a line's words that may hold or be a symbol
    shout_share = 0.5  # of a line's words that may end in several ! or ?
    menu_words = 3  # a line of so few words without an end mark belongs to a menu ...
    menu_run = 3  # ... if it stands among so many of its kind
    lost_share = 0.5  # of a document's word characters that may go with its failed lines


def failed_lines(lines: list[str], words: list[list[str]]) -> list[str | None]:
    """For each line the name of the rule that it fails, else None. Blank lines pass."""
    out: list[str | None] = []
    for line, tokens in zip(lines, words):
        rule = None
        if tokens:
            if not _LETTER.search(line):
                rule = "punctuation"
            elif _NAVIGATION.search(line) and len(tokens) <= 30:
                rule = "navigation"
            elif len(_SYMBOL.findall(line)) > Limits.symbol_share * len(tokens) and (
                sum(1 for t in tokens if _SYMBOL.search(t)) > Limits.symbol_share * len(tokens)
            ):
                rule = "punctuation"
            elif len(tokens) > 1 and len(_SHOUT.findall(line)) > Limits.shout_share * len(tokens):
                rule = "punctuation"
            elif len(tokens) >= 6 and 2 * sum(a == b for a, b in zip(tokens, tokens[1:])) > len(tokens):
                rule = "boilerplate"  # a word said again and again
            elif len(tokens) <= 30 and _BOILERPLATE.search(line):
                rule = "boilerplate"
        out.append(rule)
    # Menus are runs of very short lines without an end mark.
    menu = [
        bool(tokens) and len(tokens) <= Limits.menu_words and line.rstrip()[-1:] not in ".!?…:;\"'”»)"
        for line, tokens in zip(lines, words)
    ]
    start = 0
    for k in range(len(lines) + 1):
        if k == len(lines) or not menu[k]:
            if k - start >= Limits.menu_run:
                out[start:k] = [r or "navigation" for r in out[start:k]]
            start = k + 1
    return out


def repeated_window_words(words: list[str], width: int = 8) -> int:
    """Words that lie in a window of `width` words found at least twice in the text, first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    if len(seen) == len(words):
        return 0
    span = 1
    while span < width:  # exact names of windows of 2, 4, ... words from pairs of names
        step = min(span, width - span)
        pairs = ids[: len(ids) - step] * np.int64(len(words) + 1) + ids[step:]
        _, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        span += step
        if len(counts) == len(pairs):
            return 0
    starts = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def judge(text: str | None) -> tuple[int, int, int, int, int, bool, bool, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, the text without failed lines."""
    text = text or ""
    lines = text.split("\n")
    by_line = [WORD.findall(line) for line in lines]
    words = [w for some in by_line for w in some]
    seen: set[str] = set()
    duplicates = 0
    for line, tokens in zip(lines, by_line):
        if tokens:
            duplicates += line in seen
            seen.add(line)
    repeat = repeated_window_words(words)
    base_failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    chars = [sum(map(len, tokens)) for tokens in by_line]
    rules = failed_lines(lines, by_line)
    lost = sum(c for c, rule in zip(chars, rules) if rule)
    cleaned = "\n".join(line for line, rule in zip(lines, rules) if not rule)
    kept = not base_failed and lost <= Limits.lost_share * sum(chars)
    symbols = len(_SYMBOL.findall(text))
    return len(words), sum(chars), symbols, duplicates, repeat, base_failed, kept, cleaned


def quality(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per row of `docs` with the counts, base_failed and kept; `with_text` adds the cleaned text.

    A null text has no words and fails like an empty one. Each row is judged alone, so ties and repeated rows get
    equal results; an empty table gives no rows. Only doc_id and text are read, so other columns cannot clash.
    """

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"]
        for batch in slices(batches):
            out = pd.DataFrame([judge(x) for x in batch["text"].tolist()], columns=names)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out if with_text else out.drop(columns="cleaned")

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean" + ", cleaned string" * with_text
    )
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), judged, schema)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns; names may clash with nothing."""
    names, types = docs.columns, docs.schema

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            yield batch[[judge(x)[6] for x in batch["text"].tolist()]][names]

    return mapped(docs, keep, types)
