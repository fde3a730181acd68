"""Benchmark decontamination with templates.

Texts become templates: numbers, units behind numbers and names are replaced by typed placeholders, other words are
lower-cased. A capital that opens a sentence is read both as a word and as a name. Windows of `WIDTH` template tokens are hash-joined with the windows of the benchmark
items. For each pair of document and item the slots are then compared, occurrence by occurrence: one value of the item
must stand for one value throughout, so a question with other numbers and names is caught and a chance likeness is not.
Windows with too few words for a template are looked for as they stand.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import kept, mapped, numbered, slices
from wayfare.session import written

WIDTH = 8
LITERALS = 0.5  # share of a window's tokens that must be words
SHIFT = 4  # places by which words put in or left out may move the rest of an occurrence
RUN = 6  # windows of an item to be found: WIDTH + RUN - 1 = 13 tokens in a row; all of them in a shorter item
RAW_LEAST = 5  # an item poor in words is looked for as it stands if it has so many tokens
PORTION = 1_000_000  # characters of the texts that a task works on at a time
FILTER_BITS = 23  # the sieve for document windows has 2**23 bits, 1 MB, whatever the benchmark holds
WORDS_KEPT = 500_000  # token cache of a worker; forgotten when full

_PUNCTUATION = re.compile(r"[\W_]+")
# Units that may follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent dollar dollars usd eur euro euros cent cents kmh mph degree degrees".split()
)
_LITERAL, _NUMBER, _NAME, _UNIT, _NONE = range(5)
PLAIN, OPEN, RAW = range(3)  # readings, see Templates
_BREAK = "\x00"
_MARKS = np.array([0, 0x51ED270B1F3A9C01, 0x2545F4914F6CDD1D, 0x6C62272E07BB0143], dtype=np.uint64)


class _Vocabulary:
    """What a white-space separated piece of text is; a line break is a piece of its own."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.words: list[str] = []
        self.hashes = np.zeros(1024, dtype=np.uint64)
        self.kinds = np.zeros(1024, dtype=np.int8)
        self.units = np.zeros(1024, dtype=bool)
        self.ends = np.zeros(1024, dtype=bool)

    def add(self, piece: str) -> int:
        import xxhash

        at = len(self.words)
        if at == len(self.hashes):
            for name in ("hashes", "kinds", "units", "ends"):
                setattr(self, name, np.resize(getattr(self, name), 2 * at))
        word = _PUNCTUATION.sub("", piece)
        low = word.lower()
        self.index[piece] = at
        self.words.append(low)
        self.hashes[at] = xxhash.xxh64_intdigest(low.encode("utf-8"), 11)
        capital = len(word) > 1 and word[0].isupper() and word[1:].islower()
        self.kinds[at] = _NONE if not word else _NUMBER if word[0].isdigit() else _NAME if capital else _LITERAL
        self.units[at] = low in UNITS
        self.ends[at] = piece == _BREAK or piece.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":")
        return at

    def indices(self, pieces: list[str]) -> np.ndarray:
        get = self.index.get
        found = [get(p, -1) for p in pieces]
        if -1 in found:
            if len(self.words) > WORDS_KEPT:
                self.clear()
            found = [self.index[p] if p in self.index else self.add(p) for p in pieces]
        return np.array(found, dtype=np.int64)


def _vocabulary() -> _Vocabulary:
    return kept(_Vocabulary, _Vocabulary)


class Templates:
    """The template tokens of many texts, one after the other, in three readings.

    A capital that opens a sentence may be an ordinary word or a name. PLAIN takes it for a word, OPEN for a name, so that
    a question keeps its windows when its first name changes or when it no longer opens a sentence. RAW takes every
    token as it stands, lower-cased. A reading is the set of tokens that are literals; the others are slots.
    """

    def __init__(self, texts: list[str | None]) -> None:
        vocabulary = _vocabulary()
        pieces, borders = [], [0]
        for text in texts:
            if text:
                pieces += text.replace("\n", f" {_BREAK} ").split()
            pieces.append(_BREAK)
            borders.append(len(pieces))
        at = vocabulary.indices(pieces)
        kinds, ends = vocabulary.kinds[at], vocabulary.ends[at]
        opening = np.concatenate([[True], ends[:-1]])[: len(at)]
        behind = np.concatenate([[False], kinds[:-1] == _NUMBER])[: len(at)]
        kinds[behind & vocabulary.units[at] & ~opening] = _UNIT
        kept = kinds != _NONE
        self.text = np.repeat(np.arange(len(texts)), np.diff(borders))[kept]
        self.first = np.searchsorted(self.text, np.arange(len(texts)))  # token that a text begins with
        self.kinds = kinds[kept]
        self._words, self._at = vocabulary.words, at[kept]
        self._hashes = vocabulary.hashes[self._at]
        words = self.kinds == _LITERAL
        self.literals = [words | ((self.kinds == _NAME) & opening[kept]), words, np.ones(len(words), dtype=bool)]

    def __len__(self) -> int:
        return len(self.kinds)

    def whole(self, width: int) -> np.ndarray:
        """Places where a window of one text starts."""
        n = max(0, len(self) - width + 1)
        return self.text[width - 1 : width - 1 + n] == self.text[:n]

    def hashes(self, reading: int, width: int) -> np.ndarray:
        """The hash of the window that starts at each place."""
        n = max(0, len(self) - width + 1)
        tokens = np.where(self.literals[reading], self._hashes, _MARKS[self.kinds])
        total = np.full(n, width, dtype=np.uint64)
        for k in range(width):
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += tokens[k : k + n]
        total ^= total >> np.uint64(31)
        return total.view(np.int64)

    def n_literals(self, reading: int, width: int) -> np.ndarray:
        n = max(0, len(self) - width + 1)
        total = np.concatenate([[0], np.cumsum(self.literals[reading])])
        return total[width : width + n] - total[:n]

    def slots(self, start: int, width: int, reading: int) -> str:
        """Place, type and value of the slots of a window."""
        literal = self.literals[reading]
        return "\x1f".join(
            f"{k}\x1e{self.kinds[start + k]}\x1e{self._words[self._at[start + k]]}" for k in range(width) if not literal[start + k]
        )


def windows_of_item(text: str | None) -> tuple[list[tuple[int, int, int, int, int, str]], tuple[int, int, int]]:
    """The windows (hash, width, key, level, at, slots) to look for, and how many different keys have a level up to 0, 1, 2.

    A key names a place of the item by its template, all capitals being names; equal places count once. Level 0 has enough
    words without the opening capitals, level 1 with them, level 2 is found as it stands only.
    """
    one = Templates([text])
    width = min(WIDTH, len(one))
    if not width:
        return [], (0, 0, 0)
    keys, needed = one.hashes(OPEN, width), LITERALS * width
    plain, opened = (one.n_literals(r, width) for r in (PLAIN, OPEN))
    level = np.where(opened >= needed, 0, np.where(plain >= needed, 1, 2))
    valid = [plain >= needed, (opened >= needed) & (opened < plain), (opened < needed) & (width >= RAW_LEAST)]
    out = []
    for reading in (PLAIN, OPEN, RAW):
        hashes = one.hashes(reading, width)
        for at in np.flatnonzero(valid[reading]).tolist():
            out.append((int(hashes[at]), width, int(keys[at]), int(level[at]), at, one.slots(at, width, reading)))
    least: dict[int, int] = {}
    for _, _, key, of, _, _ in out:
        least[key] = min(least.get(key, of), of)
    return out, tuple(sum(x <= k for x in least.values()) for k in range(3))


def windows_of_texts(texts: Templates, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(reading, starts, hashes): each reading gives the windows whose tokens differ from those of the readings before."""
    whole = texts.whole(width)
    plain, opened = (texts.n_literals(r, width) for r in (PLAIN, OPEN))
    needed = LITERALS * width
    valid = [plain >= needed, (opened >= needed) & (opened < plain), plain < width]
    for reading in (PLAIN, OPEN, RAW):
        if reading != RAW or width >= RAW_LEAST:
            starts = np.flatnonzero(whole & valid[reading])
            yield reading, starts, texts.hashes(reading, width)[starts]


def is_held(levels: list[int], n: tuple[int, int, int]) -> bool:
    """Do the found windows, given by level, hold an item with `n` windows up to each level?

    RUN windows do, or all of a shorter item. Windows that a change of names or numbers destroys need not be found, if the
    others are at least half as many as are asked for.
    """
    asked = min(RUN, n[2])
    return any(2 * n[k] >= asked and sum(x <= k for x in levels) >= min(RUN, n[k]) > 0 for k in range(3))


ITEM_WINDOWS = "item_id long, h long, width int, key long, level int, at int, slots string, n_open int, n_plain int, n_windows int"


def item_windows(items: DataFrame) -> DataFrame:
    """The windows of all items; an item shorter than a window is one window of its own width."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item_id, text in zip(batch["item_id"].tolist(), batch["text"].tolist()):
                found, n = windows_of_item(text)
                out += [(item_id, *row, *n) for row in found]
            names = [x.split()[0] for x in ITEM_WINDOWS.split(", ")]
            frame = pd.DataFrame(out, columns=names)
            frame["item_id"] = frame["item_id"].astype("Int64")
            yield frame

    return mapped(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), cut, ITEM_WINDOWS)


def _portions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slices of rows with about PORTION characters; a longer text is a slice of its own."""
    for batch in slices(batches):
        ends = batch["text"].str.len().fillna(0).cumsum()
        for _, rows in batch.groupby((ends // PORTION).astype("int64"), sort=True):
            yield rows


def _sieve(windows: DataFrame) -> np.ndarray:
    """A bit for each value of a window hash's low bits; at most 2**17 words of 64 bits reach the driver."""
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    word = F.expr(f"shiftrightunsigned(h, 6) & {(1 << (FILTER_BITS - 6)) - 1}")
    rows = windows.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for row in rows.collect():
        out[row["word"]] = row["bits"]
    return out.view(np.uint64)


def agreeing(matches: list[tuple[str, str]]) -> list[bool]:
    """For each pair of slot lists (item, document): do its values follow the mapping that most pairs follow?"""
    votes: dict[tuple[str, str], Counter] = defaultdict(Counter)
    parsed = []
    for of_item, of_doc in matches:
        a = [x.split("\x1e") for x in of_item.split("\x1f")] if of_item else []
        b = [x.split("\x1e") for x in of_doc.split("\x1f")] if of_doc else []
        pairs = [((x[1], x[2]), y[2]) for x, y in zip(a, b)] if [x[:2] for x in a] == [y[:2] for y in b] else None
        parsed.append(pairs)
        for key, value in pairs or ():
            votes[key][value] += 1
    chosen = {key: min(c.items(), key=lambda kv: (-kv[1], kv[0]))[0] for key, c in votes.items()}
    return [pairs is not None and all(chosen[key] == value for key, value in pairs) for pairs in parsed]


def held_windows(matches: list[tuple[int, int, int, str, str]]) -> dict[int, bool]:
    """Windows (key -> other values?) of the occurrence that holds most; matches are (key, at, pos, slots, doc_slots).

    An occurrence has one difference of places, or such as lie SHIFT or less apart; the whole document is judged too, as
    an item may be spread over it. Identical windows agree with each other whatever the rest says.
    """
    by_place: dict[int, list] = defaultdict(list)
    for row in matches:
        by_place[row[2] - row[1]].append(row)
    places = sorted(by_place)
    occurrences = [by_place[x] for x in places]
    cuts = [0, *(k for k in range(1, len(places)) if places[k] - places[k - 1] > SHIFT), len(places)]
    occurrences += [sum(occurrences[a:b], []) for a, b in zip(cuts[:-1], cuts[1:]) if b - a > 1]
    if len(cuts) > 2:
        occurrences.append(matches)
    best: dict[int, bool] = {}
    for rows in occurrences:
        if len(rows) < len(best):
            continue
        good = agreeing([row[3:] for row in rows])
        for kept in ([row for row, ok in zip(rows, good) if ok], [row for row in rows if row[3] == row[4]]):
            held: dict[int, bool] = {}
            for h, _, _, slots, doc_slots in kept:
                held[h] = held.get(h, True) and slots != doc_slots
            best = max(best, held, key=lambda x: (len(x), -sum(x.values())))
    return best


def contaminated(docs: DataFrame, items: DataFrame, row_id: str | None = None) -> DataFrame:
    """Pairs (doc_id, item_id, n_found, n_windows, n_changed): the document holds the item, perhaps re-parameterised.

    n_found counts the item's windows found with consistent slots in its best occurrence, n_changed those with other values. Null or
    empty texts match nothing, and so do items of fewer than RAW_LEAST tokens that are not half words. Rows are judged one by one, so repeated rows give
    repeated pairs; with `row_id` naming a unique number of the rows it is returned too. Empty tables give no pairs.
    Only doc_id and text (item_id and text) are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    windows = written(item_windows(items), "item-windows")
    sieve = spark.sparkContext.broadcast(_sieve(windows))
    widths = [int(r["width"]) for r in windows.select("width").distinct().collect()]  # at most WIDTH values

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = sieve.value
        for batch in _portions(batches):
            out = []
            rids, doc_ids = batch["rid"].tolist(), batch["doc_id"].tolist()
            texts = Templates(batch["text"].tolist())
            for width in widths:
                for reading, starts, hashes in windows_of_texts(texts, width):
                    raw = hashes.view(np.uint64)
                    word = (raw >> np.uint64(6)) & np.uint64(len(bits) - 1)
                    hit = (bits[word.astype(np.int64)] >> (raw & np.uint64(63))) & np.uint64(1)
                    for k in np.flatnonzero(hit).tolist():
                        start = int(starts[k])
                        text = texts.text[start]
                        pos = start - int(texts.first[text])
                        out.append((rids[text], doc_ids[text], int(hashes[k]), pos, texts.slots(start, width, reading)))
            frame = pd.DataFrame(out, columns=["rid", "doc_id", "h", "pos", "doc_slots"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    rid = F.col(row_id) if row_id else F.monotonically_increasing_id()
    rows = docs.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    candidates = written(mapped(rows, found, "rid long, doc_id long, h long, pos int, doc_slots string"), "window-candidates")
    matches = candidates.join(windows, "h")
    grouped = matches.groupBy("rid", "doc_id", "item_id", "n_open", "n_plain", "n_windows").agg(
        F.collect_list(F.struct("key", "level", "at", "pos", "slots", "doc_slots")).alias("m")
    )

    def checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = "rid", "doc_id", "item_id", "n_open", "n_plain", "n_windows", "m"
        for batch in batches:
            out = []
            for rid, doc_id, item_id, *n, rows in zip(*(batch[c] for c in columns)):
                held = held_windows([(r["key"], r["at"], r["pos"], r["slots"], r["doc_slots"]) for r in rows])
                level = {r["key"]: r["level"] for r in rows}  # of equal places all have one level, or the last is as good
                if is_held([level[key] for key in held], tuple(n)):
                    out.append((rid, doc_id, item_id, len(held), n[2], sum(held.values())))
            frame = pd.DataFrame(out, columns=["rid", "doc_id", "item_id", "n_found", "n_windows", "n_changed"])
            yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

    schema = "rid long, doc_id long, item_id long, n_found int, n_windows int, n_changed int"
    pairs = mapped(grouped, checked, schema)
    return pairs if row_id else pairs.drop("rid")


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns."""
    rows = written(numbered(docs, "__row"), "rows-to-clean")
    bad = contaminated(rows, items, "__row").select(F.col("rid").alias("__row")).distinct()
    return rows.join(bad, "__row", "left_anti").select(*[f"`{c}`" for c in docs.columns])
