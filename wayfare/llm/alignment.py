"""Alignment of two tokenizers: groups of tokens between the byte offsets where both end a token.

Fragments form a monoid. The fragment of a stretch of a text holds an open head (tokens up to the first offset where
both tokenizers end one), the closed groups after it, and an open tail. Two neighbours are composed by closing what
the tail of the one and the head of the other make together. It does not matter in which order neighbours are composed,
so the chunks of a very long text are worked on by many Spark tasks and reduced as a tree; closed groups leave the
tree at once, so only open ends travel upwards. The two tokenizers are cut at different places: each at the first
place of a chunk where its own tokens cannot reach across, so a chunk may open with tokens of one of them alone.

A text of one chunk is made of units (white space and the word after it) whose tokens do not depend on their
neighbours; each task learns the groups of a unit once. The numbers of documents that hold a pair of ids linked are
counted over all documents; what the commonest pairs add up to is looked up in a bounded table, all other pairs are
joined.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import mapped, mapped_arrow
from wayfare.llm.fm_index import flat_positions
from wayfare.llm.tokens import byte_alphabet
from wayfare.session import written

CHUNK = 1 << 16  # characters of a chunk; longer texts are cut
FAN = 16  # neighbouring fragments composed in one step of the tree
TEXTS = 512  # texts worked on at a time
JOINED = 4096  # units that are learned in one go
CACHE_UNITS = 400_000  # forgotten when full; bounds the memory of a worker, never the result
CACHED_LENGTH = 64  # longer units are worked out each time
HOT_PAIRS = 1_000_000  # at most so many pairs are looked up in a table held by every worker
BIG_GROUP = 1 << 14  # links of a group from which on equal ids are counted before they are multiplied

# White space and a word; a comma or full stop after a letter and before white space is a unit of its own.
_UNIT = re.compile(r"\s+(?:\S*[A-Za-z](?=[,.](?!\S))|\S+|)|[,.]")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_CUT_A = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_CUT_B = re.compile(r"(?<=\S)(?=[ \n])")


class Tokens:
    """Both tokenizers with the bytes of every token."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, vocabulary = {c: b for b, c in byte_alphabet().items()}, self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in alphabet for c in token)
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if known else token.encode("utf-8")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8")
            for i, p in enumerate(pieces)
        ]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.space_b, self.line_b = self.b.piece_to_id("▁"), self.b.piece_to_id("<0x0A>")
        names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.written = [f"{i}{c}".encode() for c in ",|" for i in names[: len(self.bytes_a)]]
        self.written += [f"{i}{c}".encode() for c in ",;" for i in names[: len(self.bytes_b)]]
        # Units hold if A splits before white space and no piece of B goes on from a word to white space or to a stop.
        with open(path_a) as f:
            first = json.load(f).get("pre_tokenizer") or {}
        self.units_hold = first.get("type") == "ByteLevel" and first.get("use_regex", True)
        self.units_hold &= not any("▁" in p.lstrip("▁") or "\n" in p or re.search("[A-Za-z][,.]", p) for p in pieces)
        self.known: dict[str, int | None] = {}
        self._forget()

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.a.encode_batch(texts, add_special_tokens=False)]

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts as they stand: B puts a space before each, so one at the front is taken off, or the ids
        of that space (and of a line break put behind it, beyond which B never reaches) are dropped."""
        found = self.b.encode([x[1:] if x[:1] == " " else x if x[:1] in ("", "\n") else "\n" + x for x in texts], num_threads=1)
        out = []
        for text, ids in zip(texts, found):
            if text == " ":
                ids = [self.space_b]
            elif text and text[0] != " ":
                front = [self.space_b] if text[0] == "\n" else [self.space_b, self.line_b]
                ids = ids[len(front) :] if ids[: len(front)] == front else [-1]
            out.append(ids)
        return out

    def spells(self, text: str, a: list[int], b: list[int]) -> tuple[bool, bool]:
        data = text.encode("utf-8")
        return (
            b"".join([self.bytes_a[i] for i in a]) == data,
            -1 not in b and b"".join([self.bytes_b[i] for i in b]) == data,
        )

    # Units

    def _forget(self) -> None:
        """Entry 0 stands for a unit that a tokenizer does not spell as it is."""
        self.known.clear()
        self.texts = [b""]
        self.counts, self.stops = np.zeros((1, 3), np.int32), np.zeros(1, np.int64)  # n_a, n_b, n_groups; last link
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def units(self, text: str) -> list[str]:
        """A space and the text, cut where neither tokenizer reaches across."""
        whole = " " + text
        if not self.units_hold:
            return [whole]
        found = _UNIT.findall(whole)
        if _OTHER_SPACE.search(whole) is None:
            return found
        out = found[:1]
        for unit in found[1:]:
            if unit[0] in " \n,.":
                out.append(unit)
            else:
                out[-1] += unit
        return out

    def _joined(self, units: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of units that follow one another, or None if the whole is not spelled as it is."""
        text = "".join(units)
        a, b = self.ids_a([text])[0], self.ids_b([text])[0]
        return (np.array(a, np.int64), np.array(b, np.int64)) if all(self.spells(text, a, b)) else None

    def _single(self, units: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The units that are spelled as they are, each encoded by itself, and their ids."""
        rows = [(u, a, b) for u, a, b in zip(units, self.ids_a(units), self.ids_b(units)) if all(self.spells(u, a, b))]
        a, b = (np.array([i for r in rows for i in r[k]], np.int64) for k in (1, 2))
        return [r[0] for r in rows], a, b

    def learn(self, units: list[str]) -> dict[str, int]:
        """The place of each unit among the entries."""
        found = dict.fromkeys(units, 0)
        # Units that may follow one another as they do in a text: one call for many of them.
        plain = [u for u in units if u[0] in " \n" and not u[-1].isspace()] if self.units_hold else []
        rest = [u for u in units if u[0] not in " \n" or u[-1].isspace()] if self.units_hold else units
        parts = []
        for k in range(0, len(plain), JOINED):
            some = plain[k : k + JOINED]
            ids = self._joined(some)
            if ids is None:
                rest += some
            else:
                parts.append((some, *ids))
        if rest:
            parts.append(self._single(rest))
        for some, a, b in parts:
            if some:
                self._enter(some, a, b, found)
        return found

    def _enter(self, units: list[str], a: np.ndarray, b: np.ndarray, found: dict[str, int]) -> None:
        ends = np.cumsum([len(u.encode("utf-8")) for u in units])
        groups = Groups.of(a, np.cumsum(self.size_a[a]), b, np.cumsum(self.size_b[b]))
        unit_of = np.searchsorted(ends, groups.ends)
        last = np.append(np.flatnonzero(unit_of[1:] != unit_of[:-1]), len(unit_of) - 1)  # the last group of each unit
        n_a, n_b = (np.diff(np.append(0, x[last])) for x in (groups.a_stops, groups.b_stops))
        which, pair, times = groups.links(len(self.bytes_b), unit_of)
        first = len(self.texts)
        self.texts += groups.texts(self.written, len(self.bytes_a), last)
        self.counts = np.concatenate([self.counts, np.column_stack([n_a, n_b, np.diff(np.append(-1, last))]).astype(np.int32)])
        self.stops = np.append(self.stops, len(self.pairs) + np.cumsum(np.bincount(which, minlength=len(units))))
        self.pairs, self.times = np.append(self.pairs, pair), np.append(self.times, times.astype(np.int32))
        found.update(zip(units, range(first, first + len(units))))

    def places(self, texts: list[list[str]]) -> list[list[int]]:
        """Entries of the units of some texts, valid until the next call; none where a unit has none."""
        if len(self.texts) > CACHE_UNITS:
            self._forget()
        get = self.known.get
        found = [[get(u) for u in units] for units in texts]
        missing = {u for units, ids in zip(texts, found) if None in ids for u, i in zip(units, ids) if i is None}
        if missing:
            more = self.learn(sorted(missing))
            self.known.update((u, i) for u, i in more.items() if len(u) <= CACHED_LENGTH)
            for units, ids in zip(texts, found):
                if None in ids:
                    ids[:] = [more[u] if i is None else i for u, i in zip(units, ids)]
        return [[] if 0 in ids else ids for ids in found]


@lru_cache(maxsize=2)
def tokens(path_a: str, path_b: str) -> Tokens:
    """One pair of tokenizers per Python worker."""
    return Tokens(path_a, path_b)


@dataclass
class Groups:
    """Closed groups: group k has the A tokens a_stops[k-1] to a_stops[k], likewise B, and ends at byte ends[k]."""

    a: np.ndarray
    b: np.ndarray
    a_stops: np.ndarray
    b_stops: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Groups:
        ends, a_last, b_last = np.intersect1d(a_ends, b_ends, assume_unique=False, return_indices=True)
        # A token may be empty (no bytes); the group then ends behind the last token that ends there.
        a_stops = np.searchsorted(a_ends, ends, side="right") if len(ends) else a_last
        b_stops = np.searchsorted(b_ends, ends, side="right") if len(ends) else b_last
        return Groups(a, b, a_stops, b_stops, ends)

    def __len__(self) -> int:
        return len(self.ends)

    def texts(self, written: list[bytes], n_a: int, last: np.ndarray) -> list[bytes]:
        """The groups as text, `a1,a2|b1;a3|b2,b3`, in one text for all groups up to each of `last`."""
        a_last, b_last = np.zeros(self.a_stops[-1], bool), np.zeros(self.b_stops[-1], bool)
        a_last[self.a_stops - 1] = b_last[self.b_stops - 1] = True
        # A group's A tokens stand behind all B tokens of earlier groups, its B tokens behind its A tokens.
        n_a_, n_b_ = np.diff(np.append(0, self.a_stops)), np.diff(np.append(0, self.b_stops))
        code = np.empty(len(a_last) + len(b_last), np.int64)
        code[np.arange(len(a_last)) + np.repeat(self.b_stops - n_b_, n_a_)] = self.a[: len(a_last)] + a_last * n_a
        n_b = (len(written) - 2 * n_a) // 2
        code[np.arange(len(b_last)) + np.repeat(self.a_stops, n_b_)] = 2 * n_a + self.b[: len(b_last)] + b_last * n_b
        parts = list(map(written.__getitem__, code.tolist()))
        stops = (self.a_stops + self.b_stops)[last].tolist()
        return [b"".join(parts[x:y])[:-1] for x, y in zip([0, *stops], stops)]

    def links(self, n_b: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, pair, times) of the links of the groups, one row per owner and pair, sorted by both."""
        if not len(self):
            return (np.zeros(0, np.int64),) * 3
        n_a_, n_b_ = np.diff(np.append(0, self.a_stops)), np.diff(np.append(0, self.b_stops))
        a_first, b_first = self.a_stops - n_a_, self.b_stops - n_b_
        size = n_a_ * n_b_
        small = np.flatnonzero(size <= BIG_GROUP)
        which, place = flat_positions(size[small])
        g = small[which]
        rows = [(owner[g], self.a[a_first[g] + place // n_b_[g]] * n_b + self.b[b_first[g] + place % n_b_[g]], np.ones(len(g), np.int64))]
        for g in np.flatnonzero(size > BIG_GROUP).tolist():
            a, times_a = np.unique(self.a[a_first[g] : self.a_stops[g]], return_counts=True)
            b, times_b = np.unique(self.b[b_first[g] : self.b_stops[g]], return_counts=True)
            pair = (a[:, None] * n_b + b).ravel()
            rows.append((np.full(len(pair), owner[g]), pair, (times_a[:, None] * times_b).ravel()))
        return summed(*(np.concatenate(x) for x in zip(*rows)))


def summed(owner: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per (owner, pair) with the sum of its times."""
    if not len(owner):
        return owner, pair, times
    order = np.lexsort((pair, owner))
    owner, pair = owner[order], pair[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1])))
    return owner[first], pair[first], np.add.reduceat(times[order], first)


_NONE = np.zeros(0, np.int64)
OPEN = ("a", "a_ends", "b", "b_ends")


@dataclass
class Fragment:
    """Head, closed groups, tail. Without an offset where both end (`cut` false) all tokens are in the head."""

    head: tuple[np.ndarray, ...] = (_NONE,) * 4
    tail: tuple[np.ndarray, ...] = (_NONE,) * 4
    cut: bool = False
    closed: list[Groups] = field(default_factory=list)


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> Fragment:
    """The fragment of the tokens of a stretch; the A and B tokens need not cover the same bytes."""
    groups = Groups.of(a, a_ends, b, b_ends)
    if not len(groups):
        return Fragment(head=(a, a_ends, b, b_ends))
    i, j, x, y = groups.a_stops[0], groups.b_stops[0], groups.a_stops[-1], groups.b_stops[-1]
    inner = Groups(a[i:], b[j:], groups.a_stops[1:] - i, groups.b_stops[1:] - j, groups.ends[1:])
    return Fragment(
        (a[:i], a_ends[:i], b[:j], b_ends[:j]), (a[x:], a_ends[x:], b[y:], b_ends[y:]), True, [inner] if len(inner) else []
    )


def whole(groups: tuple[np.ndarray, ...]) -> list[Groups]:
    """Open tokens that are closed on both sides, as groups."""
    found = Groups.of(*groups)
    return [found] if len(found) else []


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring stretches. Associative, with Fragment() as its identity."""
    open_end = left.tail if left.cut else left.head
    middle = tuple(np.concatenate([x, y]) for x, y in zip(open_end, right.head))
    if left.cut and right.cut:
        return Fragment(left.head, right.tail, True, [*left.closed, *whole(middle), *right.closed])
    between = fragment(*middle)
    if left.cut:  # the right one is open throughout
        if not between.cut:
            return Fragment(left.head, between.head, True, left.closed)
        return Fragment(left.head, between.tail, True, [*left.closed, *whole(between.head), *between.closed])
    if right.cut:  # the left one is open throughout; the middle ends where both end
        return Fragment(between.head, right.tail, True, [*between.closed, *right.closed])
    return between


def cuts(text: str, chunk: int) -> list[tuple[int, int]]:
    """Where A and where B are cut, for each chunk's start and the end: the first safe places from there on."""
    out = [(0, 0)]
    for target in range(chunk, len(text), chunk):
        last_a, last_b = out[-1]
        a, b = _CUT_A.search(text, max(target, last_a)), _CUT_B.search(text, max(target, last_b)) if last_b < len(text) else None
        out.append((a.start() if a else len(text), b.start() if b else len(text)))
    return [*out, (len(text), len(text))]


# Spark

_OPEN_SCHEMA = ", ".join(f"{side}_{x} array<long>" for side in ("head", "tail") for x in OPEN)
_FRAGMENT = f"row long, k long, at long, ok boolean, cut boolean, {_OPEN_SCHEMA}"
_PIECE = "n_a long, n_b long, n_groups long, text binary, pairs array<long>, times array<long>"
_COLUMNS = [x.split()[0] for x in f"{_FRAGMENT}, {_PIECE}".split(", ")]


def _fragment_row(row: int, k: int, ok: bool, x: Fragment) -> dict:
    sides = {f"{side}_{name}": v for side, part in (("head", x.head), ("tail", x.tail)) for name, v in zip(OPEN, part)}
    return {"row": row, "k": k, "ok": ok, "cut": x.cut, **sides}


def _piece_row(row: int, groups: Groups, tool: Tokens) -> dict:
    _, pair, times = groups.links(len(tool.bytes_b), np.zeros(len(groups), np.int64))
    counts = {"n_a": int(groups.a_stops[-1]), "n_b": int(groups.b_stops[-1]), "n_groups": len(groups)}
    (text,) = groups.texts(tool.written, len(tool.bytes_a), np.array([len(groups) - 1]))
    return {"row": row, "at": int(groups.ends[0]), **counts, "text": text, "pairs": pair, "times": times}


def _frame(rows: list[dict]) -> pd.DataFrame:
    whole_numbers = ("row", "k", "at", "n_a", "n_b", "n_groups")
    columns = {c: [r.get(c) for r in rows] for c in _COLUMNS}
    return pd.DataFrame({c: pd.Series(v, dtype="Int64" if c in whole_numbers else object) for c, v in columns.items()})


def _chunks(docs: DataFrame, chunk: int, path_a: str, path_b: str) -> DataFrame:
    """Rows of chunks of long texts: a space and the text, cut for A and for B."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units_hold = tokens(path_a, path_b).units_hold
        for batch in batches:
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"]):
                text = " " + text
                places, rows, at, done = cuts(text, chunk) if units_hold else [(0, 0), (len(text),) * 2], [], 0, 0
                for k, ((a0, b0), (a1, b1)) in enumerate(zip(places, places[1:])):
                    low = min([x for x, y in ((a0, a1), (b0, b1)) if x < y], default=a0)
                    high = max([y for x, y in ((a0, a1), (b0, b1)) if x < y], default=low)
                    at, done = at + len(text[done:low].encode("utf-8")) if low >= done else at - len(text[low:done].encode("utf-8")), low
                    rows.append((row, doc_id, k, at, text[low:high], a0 - low, a1 - low, b0 - low, b1 - low))
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    names = ["row", "doc_id", "k", "base", "part", "a0", "a1", "b0", "b1"]
    schema = "row long, doc_id long, k long, base long, part string, a0 long, a1 long, b0 long, b1 long"

    def nullable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in cut(batches):
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return mapped(docs, nullable, schema)


def _fragments(chunks: DataFrame, path_a: str, path_b: str) -> DataFrame:
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = tokens(path_a, path_b)
        for batch in batches:
            for r in batch.itertuples():
                one, two = (r.part[x:y] if y > x else "" for x, y in ((r.a0, r.a1), (r.b0, r.b1)))
                a, b = tool.ids_a([one])[0], tool.ids_b([two])[0] if two else []
                ok = tool.spells(one, a, [])[0] and tool.spells(two, [], b)[1]
                found = Fragment()
                if ok:
                    a, b = np.array(a, np.int64), np.array(b, np.int64)
                    first_a, first_b = (r.base + len(r.part[: max(x, 0)].encode("utf-8")) for x in (r.a0, r.b0))
                    found = fragment(a, first_a + np.cumsum(tool.size_a[a]), b, first_b + np.cumsum(tool.size_b[b]))
                rows = [_piece_row(r.row, g, tool) for g in found.closed]
                yield _frame([_fragment_row(r.row, r.k, ok, found), *rows])

    return mapped(chunks.repartition("row", "k"), made, f"{_FRAGMENT}, {_PIECE}")


def _reduced(fragments: DataFrame, fan: int, last: bool, path_a: str, path_b: str) -> DataFrame:
    """Compose neighbours; at the last step the ends of a text are closed too."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        ok, found = bool(rows["ok"].all()), Fragment()
        if ok:
            for r in rows.to_dict("records"):
                sides = [tuple(np.asarray(r[f"{s}_{x}"], np.int64) for x in OPEN) for s in ("head", "tail")]
                found = compose(found, Fragment(*sides, bool(r["cut"])))
            if last:
                ok = all(len(x) == 0 for x in (found.tail if found.cut else found.head))
                found = Fragment(closed=[*whole(found.head), *found.closed])
        row, k = int(rows["row"].iat[0]), int(rows["k"].iat[0]) // fan
        return _frame([_fragment_row(row, k, ok, found), *(_piece_row(row, g, tokens(path_a, path_b)) for g in found.closed)])

    names = [x for x in _COLUMNS[: _COLUMNS.index("n_a")] if x != "at"]
    keyed = fragments.select(*names, F.expr(f"k div {fan}").alias("part"))
    return keyed.groupBy("row", "part").applyInPandas(group, f"{_FRAGMENT}, {_PIECE}")


_TEXT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _short_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per text of one chunk, with its pairs."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokens(path_a, path_b)
        for full in batches:
            for at in range(0, full.num_rows, TEXTS):
                batch = full.slice(at, TEXTS)
                places = tool.places([tool.units(x) if x else [] for x in batch.column("text").to_pylist()])
                texts, lengths = tool.texts, np.array([len(x) for x in places])
                digests = [hashlib.sha256(b";".join([texts[i] for i in x])).hexdigest() if x else "" for x in places]
                flat, owner = np.array([i for x in places for i in x], np.int64), np.repeat(np.arange(len(places)), lengths)
                sums = [np.bincount(owner, weights=x, minlength=len(places)).astype(np.int64) for x in tool.counts[flat].T]
                # Equal units of a text first, then the pairs of its different units.
                owner, unit, times = summed(owner, flat, np.ones(len(flat), np.int64))
                first = tool.stops[unit - 1]
                which, place = flat_positions(tool.stops[unit] - first)
                index = first[which] + place
                owner, pair, times = summed(owner[which], tool.pairs[index], tool.times[index] * times[which])
                links = np.bincount(owner, weights=times, minlength=len(places)).astype(np.int64)
                ends = pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=len(places)))).astype(np.int32))
                columns = [batch.column("row"), batch.column("doc_id"), *(pa.array(x) for x in (*sums, links)), pa.array(digests, pa.string())]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pair, times)]
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                yield pa.RecordBatch.from_arrays(columns + lists, names=names)

    return mapped_arrow(docs, aligned, f"{_TEXT}, pairs array<long>, times array<long>")


def _digests(pieces: DataFrame) -> DataFrame:
    """The digest of each long text: its pieces in order of place, read one after the other."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state = None, None
        for batch in batches:
            done = []
            for r, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                if r != row:
                    if row is not None:
                        done.append((row, state.hexdigest()))
                    row, state = r, hashlib.sha256(text)
                else:
                    state.update(b";" + text)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.int64(), pa.string()))], names=names)
        if row is not None:
            yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "groups_sha256": pa.array([state.hexdigest()])})

    names = ["row", "groups_sha256"]
    ordered = pieces.select("row", "at", "text").repartition("row").sortWithinPartitions("row", "at")
    return mapped_arrow(ordered.select("row", "text"), read, "row long, groups_sha256 string")


def _long_texts(docs: DataFrame, path_a: str, path_b: str, chunk: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """(one row per long text, its pairs in blocks)."""
    chunks = written(_chunks(docs, chunk, path_a, path_b), "align-chunks")
    level = written(_fragments(chunks, path_a, path_b), "align-fragments")
    pieces, widest = level.filter("n_a is not null"), chunks.agg(F.max("k")).first()[0] or 0
    while True:
        last = widest < fan
        level = written(_reduced(level.filter("n_a is null"), fan, last, path_a, path_b), "align-level")
        pieces = pieces.unionAll(level.filter("n_a is not null"))
        if last:
            break
        widest //= fan
    # A text that a tokenizer does not spell as it is has no tokens.
    good = level.filter("n_a is null and ok").select("row")
    pieces = pieces.join(good, "row", "left_semi")
    sums = pieces.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups")))
    pairs = pieces.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    pairs = pairs.groupBy("row", "pairs").agg(F.sum("times").alias("times"))
    # Blocks of neighbouring pairs: at most 4,096 in a row.
    block = F.collect_list(F.struct("pairs", "times")).alias("x")
    pairs = written(pairs.groupBy("row", F.shiftright("pairs", 12).alias("block")).agg(block), "align-pairs")
    pairs = pairs.select("row", F.col("x.pairs").alias("pairs"), F.col("x.times").alias("times"))
    links = pairs.groupBy("row").agg(F.sum(F.expr("aggregate(times, 0L, (s, t) -> s + t)")).alias("n_links"))
    rows = chunks.filter("k = 0").select("row", "doc_id").join(sums, "row", "left").join(links, "row", "left")
    rows = rows.join(_digests(pieces), "row", "left").na.fill(0, ["n_a", "n_b", "n_groups", "n_links"])
    rows = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return rows, pairs


def pair_counts(pairs: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): in how many documents a pair is linked, and whether no pair of its A id is in more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, n = np.unique(batch.column("pairs").flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    counts = mapped_arrow(pairs.select("pairs"), counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("a", F.expr(f"pair div {n_b}L")), "align-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    return written(counts.join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "align-best")


def _link_sums(pairs: DataFrame, counts: DataFrame, hot_pairs: int) -> DataFrame:
    """(row, n_best, count_sum): the commonest pairs are looked up, all others joined.

    Pairs that are in more than total / hot_pairs documents are looked up; there are fewer than hot_pairs of them, as
    all counts add up to the total.
    """
    spark = pairs.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    bound = total // hot_pairs
    hot = counts.filter(F.col("n") > bound).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast([hot.column(c).to_numpy() for c in ("pair", "n", "best")])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            pair, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            is_hot = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            sums = []
            for each in (best, n):
                # Whole numbers, exact: running sums, not floats.
                run = np.append(0, np.cumsum(np.where(is_hot, times * each[at] if len(known) else 0, 0)))
                bounds = np.append(0, np.cumsum(np.bincount(owner, minlength=batch.num_rows)))
                sums.append(pa.array(run[bounds[1:]] - run[bounds[:-1]]))
            cold = ~is_hot
            ends = pa.array(np.append(0, np.cumsum(np.bincount(owner[cold], minlength=batch.num_rows))).astype(np.int32))
            rest = [pa.ListArray.from_arrays(ends, pa.array(x[cold])) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *sums, *rest], names=["row", "n_best", "count_sum", "pairs", "times"])

    schema = "row long, n_best long, count_sum long, pairs array<long>, times array<long>"
    found = written(mapped_arrow(pairs.select("row", "pairs", "times"), looked_up, schema), "align-sums")
    cold = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    cold = cold.join(counts.filter(F.col("n") <= bound), "pair")
    cold = cold.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    both = found.select("row", "n_best", "count_sum").unionAll(cold)
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(
    docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK, fan: int = FAN, hot_pairs: int = HOT_PAIRS
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (byte-level) reads a space and the text, B (pieces) puts that space itself. Null and empty texts, and texts that
    a tokenizer does not spell as they are, have no tokens: zeros and an empty digest. Repeated rows are documents of
    their own. A null doc_id stays null. An empty table gives no rows. Only doc_id and text are read, so other columns
    cannot clash.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))
    number = F.monotonically_increasing_id()
    short = given.filter(~is_long).select((number * 2).alias("row"), "*")
    texts = written(_short_texts(short, path_a, path_b), "align-texts")
    long = given.filter(is_long).select((number * 2 + 1).alias("row"), "*")
    rows, pairs = texts.drop("pairs", "times"), texts.select("row", "pairs", "times").filter("n_links > 0")
    long_rows, long_pairs = _long_texts(long, path_a, path_b, chunk, fan)
    rows, pairs = rows.unionAll(long_rows), pairs.unionAll(long_pairs)
    counts = pair_counts(pairs, len(tokens(path_a, path_b).bytes_b))
    out = rows.join(_link_sums(pairs, counts, hot_pairs), "row", "left").na.fill(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
