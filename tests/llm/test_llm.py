"""The operators for training data against brute force, and on odd inputs."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from wayfare.llm import (  # noqa: E402
    components,
    decontaminate,
    html_wrappers,
    maxent_lm,
    packing,
    quality_lines,
    queries,
    simhash,
    substring_dedup,
    token_files,
    toxicity,
    url_templates,
)
from wayfare.llm.tokens import encoder, word_bpe_path  # noqa: E402

LONG = " ".join(f"word{i % 977} and more" for i in range(30_000))
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (4, "one"),  # a repeated row
    (None, "a text without an id, long enough to have some words in it"),
    (5, LONG),
    (6, "ab" * 300),
    (7, "naïve Ünïcode ﬁ ß 中文 text. <|endoftext|> it's 3,5 km!!"),
    (8, "x" * 199),
    (9, LONG[:5000]),
]


def odd(spark):
    """Nulls, empty, very long and repeated texts, and extra columns whose names operators might use."""
    rows = [(i, t, "en", "s", None, 1, "q", "f") for i, t in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, row_id int, score string, ranges string"
    ).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


# Tokens, packing, files


def test_cached_words_give_the_tokenizers_ids(texts):
    from tokenizers import Tokenizer

    plain, ours = Tokenizer.from_file(word_bpe_path()), encoder(word_bpe_path())
    more = ["d, x. ,. a,\n.", "###, a!!, b", "１,2. x1, 2.", "\x1c a\x85b", "K İ Á", "<|ENDOFTEXT|> <|endoftext|>x"]
    more += ["ΟΔΥΣΣΕΥΣ ΣΑΣ ς İstanbul ǅ Äberie ÜÇH", "e\u0301t\u00e9 \u212b \u1e9e \u0130\u0307 ª º ʰ ⅷ Ⅷ ² x² ﬁn ΐ", "한국어 \u1112\u1161\u11ab ไทย हिन्दी ａＢ"]
    for text in [t for _, t in texts] + [t for _, t in ODD if t] + more:
        assert np.frombuffer(ours(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_plan_places_every_piece_once():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 21, 50, 100])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        bins, seen = {}, Counter()
        for r in packing.plan(counts, capacity).itertuples():
            for i in range(r.each * r.n_sequences):
                bins.setdefault(r.first_sequence + i // r.each, []).append((r.offset + i % r.each * r.length, r.length))
                seen[r.length] += 1
        assert dict(seen) == counts
        for content in bins.values():
            at = 0
            for offset, length in sorted(content):
                assert offset == at
                at += length
            assert at <= capacity


def test_reduction_never_costs_a_sequence():
    """Fixed sets plus the best packing of the rest are as good as the best packing of all."""

    def best(items, capacity):
        items = sorted(items, reverse=True)
        least = [len(items)]

        def place(k, bins):
            if len(bins) >= least[0]:
                return
            if k == len(items):
                least[0] = len(bins)
                return
            for room in set(bins):
                if bins.count(room) and room >= items[k]:
                    rest = list(bins)
                    rest.remove(room)
                    place(k + 1, [*rest, room - items[k]])
            place(k + 1, [*bins, capacity - items[k]])

        place(0, [])
        return least[0]

    rng = random.Random(8)
    for _ in range(120):
        capacity = rng.choice([10, 15, 20])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 7))]
        fixed, rest = packing.reduced(Counter(items), capacity)
        left = [x for x, n in rest.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (best(left, capacity) if left else 0) == best(items, capacity)


def test_packing_of_texts(spark):
    rows = packing.pack(odd(spark), word_bpe_path(), with_ids=True).toPandas()
    for (doc_id, _), n in Counter((i if i is not None else -1, t) for i, t in ODD).items():
        assert n >= 1
    assert len(rows[rows.piece == 0]) == len(ODD)
    plain = encoder(word_bpe_path())
    for q in rows[rows.doc_id.notna()].itertuples():
        text = next(t for i, t in ODD if i == q.doc_id)
        ids = np.append(np.frombuffer(plain(text), "<u4"), np.uint32(0)).astype("<u4")
        part = ids[q.start : q.start + q.length]
        assert zlib.crc32(part.tobytes()) == q.ids_crc32 and list(q.ids) == part.tolist()
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048


def test_common_lengths_are_numbered_in_more_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALTS", 2)
    monkeypatch.setattr(packing, "RANKED", 3)
    table = spark.createDataFrame([(i, "one two" if i % 5 else "three " * 900) for i in range(200)], "doc_id long, text string")
    rows = packing.pack(table, word_bpe_path()).toPandas()
    assert len(rows) == 200 and rows.groupby("sequence_id").length.sum().max() <= 2048
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]


def test_token_files_hold_the_ids(spark):
    rows = token_files.encode_corpus(odd(spark), word_bpe_path()).toPandas().sort_values("start")
    assert rows.start.tolist() == [0, *rows.n_tokens.cumsum().tolist()[:-1]]
    assert rows.doc_id.isna().tolist() == [True] + [False] * (len(ODD) - 1)
    assert sorted(rows.doc_id.dropna()) == list(rows.doc_id.dropna())
    for q in rows[rows.doc_id.notna()].itertuples():
        text = next(t for i, t in ODD if i == q.doc_id)
        ids = np.append(np.frombuffer(encoder(word_bpe_path())(text), "<u4"), np.uint32(2)).astype("<u4")
        assert len(ids) == q.n_tokens and zlib.crc32(ids.tobytes()) == q.ids_crc32


# Repeated strings


def removed_by_brute_force(some, length):
    raws = [(t or "").encode() for t in some]
    seen = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        mark = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                mark[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], mark.astype(int)])) == 1).sum())
        rest = np.frombuffer(raw, np.uint8)[~mark].tobytes()
        out.append((len(raw), int(mark.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeated_strings(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "MAX_SEGMENTS", hot)
    some = [(i, t[:20_000]) for i, t in texts] + [(i, t[:9000] if t else t) for i, t in ODD]
    table = spark.createDataFrame(some, "doc_id long, text string").repartition(4)
    rows = substring_dedup.dedup_substrings(table).collect()
    found = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows)
    assert found == sorted(removed_by_brute_force([t for _, t in some], 200))


def test_cleaned_texts_keep_rows_and_columns(spark):
    table = odd(spark)
    out = substring_dedup.cleaned_texts(table)
    assert out.schema == table.schema and out.count() == len(ODD)
    assert out.filter("doc_id = 9").first()["text"] == ""


# Near duplicates


def test_near_duplicates(spark, texts):
    some = texts + ODD
    rows = simhash.near_duplicates(spark.createDataFrame(some, "doc_id long, text string").repartition(3)).collect()
    expected = []
    for _, text in some:
        w = words(text)
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        hashes = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], dtype=np.uint64)
        fp = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
        expected.append(fp)
    assert sorted(f"{x:016x}" for x in expected) == sorted(r["fingerprint"] for r in rows)
    fps = np.unique(np.array(expected, dtype=np.uint64))
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        new = np.array([label[np.bitwise_count(fps ^ f) <= 2].min() for f in fps])
        if (new == label).all():
            break
        label = new
    group = dict(zip(fps.tolist(), label.tolist()))
    least = {}
    for (i, _), fp in zip(some, expected):
        if i is not None:
            least[group[fp]] = min(least.get(group[fp], i), i)
    for r in rows:
        assert r["component_id"] == least.get(group[int(r["fingerprint"], 16)])


def test_hot_groups_are_dealt_again(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    values = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    table = spark.createDataFrame(signed, "fp long")
    found = []
    for size in (4096, 20):
        edges = simhash.near_links(table, 2, size)
        found.append(sorted((r["node"], r["root"]) for r in components.components(edges).collect()))
    assert found[0] == found[1] and len(found[0]) >= 200


def test_dealing_ends_where_all_bits_are_shared(spark):
    """All settings of nine bits: the groups stay larger than the limit through several dealings."""
    table = spark.createDataFrame([(sum((v >> k & 1) << 7 * k for k in range(9)),) for v in range(512)], "fp long")
    for radius in (1, 2):
        edges = components.components(simhash.near_links(table, radius, 1)).collect()
        assert sorted(r["node"] for r in edges) == sorted(r["fp"] for r in table.collect())
        assert {r["root"] for r in edges} == {0}


def test_one_of_each_keeps_columns(spark):
    table = odd(spark)
    out = simhash.one_of_each(table)
    assert out.schema == table.schema
    assert out.filter("doc_id = 4").count() == 1 and out.filter("text is null or trim(text) = ''").count() <= 1


def test_stage_keeps_one_of_each_group_by_brute_force(spark, texts):
    """Edited copies of texts at many distances; the rows that stay are the smallest ids of the groups."""
    rng = random.Random(11)
    some = [(i, t) for i, t in texts if t and len(words(t)) < 400][:80]
    for i, t in list(some):
        for k in range(3):
            w = t.split()
            for at in rng.sample(range(len(w)), min(len(w), 1 + len(w) // rng.choice((25, 100, 400)))):
                w[at] = f"edit{i}x{k}x{at}"
            some.append((10_000 + 10 * i + k, " ".join(w)))
    some += [(90_000, ""), (90_001, None), (90_002, " \n")]
    prints = [simhash.fingerprint(t, 3, 42) for _, t in some]
    label = list(range(len(some)))
    for a in range(len(some)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(some, label):
        least[x] = min(least.get(x, i), i)
    assert 60 < len(least) < len(some) - 20
    table = spark.createDataFrame([(i, t, 1, 2) for i, t in some], "doc_id long, text string, row long, FP long").repartition(3)
    out = simhash.one_of_each(table, shingle=3, seed=42, radius=2)
    assert out.schema == table.schema
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(least.values())
    assert simhash.one_of_each(table.limit(0)).count() == 0


# Line rules


def test_base_counts(spark, texts):
    rows = quality_lines.quality(spark.createDataFrame(texts + ODD, "doc_id long, text string")).collect()
    expected = []
    for _, text in texts + ODD:
        text = text or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
        symbols = sum(text.count(c) for c in quality_lines.SYMBOLS)
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        expected.append((len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again), failed))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(expected)
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_line_rules():
    def rules(text):
        lines = text.split("\n")
        return quality_lines.failed_lines(lines, [quality_lines.WORD.findall(x) for x in lines])

    assert rules("A plain sentence, with some words.\n\nAnother one") == [None, None, None]
    assert rules("Home\nNews\nSport\nThe story begins here.") == ["navigation"] * 3 + [None]
    assert rules("Home | News | Sport") == ["navigation"]
    assert rules("-----\nAll rights reserved 2020") == ["punctuation", "boilerplate"]
    assert rules("buy### now$$$ very%%% cheap&&&") == ["punctuation"]


def test_good_labels_are_kept(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    table = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    rows = quality_lines.quality(table).join(labels, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


# Benchmark items


def test_planted_items_are_found(spark):
    items = [
        (1, "A train leaves Boston at 9 and travels 120 km in 3 hours before Maria meets it at the old station"),
        (2, "short item here"),
        (3, None),
    ]
    table = [
        (10, "Intro. " + items[0][1] + " and the end."),
        (11, "Intro. A train leaves Denver at 7 and travels 450 km in 5 hours before Anna meets it at the old station."),
        (12, "A train is late and nobody travels by it, so Maria walks to the old station."),
        (13, "We say short item here again."),
        (14, None),
        (15, ""),
    ]
    rows = decontaminate.contaminated(
        spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(10, 1), (11, 1), (13, 2)]
    assert next(r["n_changed"] for r in rows if r["doc_id"] == 11) > 0


TOM = "Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have at the end of the day?"
MARIA = "Maria walks along the long river path today."
SOLVE = "Solve 3 x + 5 = 20 and 4 y - 7 = 9 and 2 z + 1 = 11"


@pytest.mark.parametrize(
    "item, text, held",
    [
        (TOM, TOM, True),
        (TOM, "Ann has 8 apples. Ann buys 2 more apples. How many apples does Ann have at the end of the day?", True),
        (TOM, "He said that Ann has 8 apples. Ann buys 2 more apples. How many apples does Ann have at the end of the day?", True),
        (TOM, "Ann has 8 apples. Bob buys 2 more pears. Who knows what apples Eve may eat at the end of the day?", False),
        (MARIA, "It reads, Maria walks along the long river path today.", True),
        (MARIA, "It reads, Peter walks along the long river path today.", True),
        (MARIA, "maria walks along the long river path today and more", True),
        (MARIA, "Maria walks along a long river path today.", False),
        (SOLVE, f"so that {SOLVE}", True),
        (SOLVE, f"so that {SOLVE.lower()} or so", True),
        (SOLVE, "so that Solve 3 x + 5 = 21 and 4 y - 8 = 9 and 2 z + 6 = 11", False),
        ("3 + 5", "he wrote 3 + 5 on it", False),
    ],
)
def test_readings_of_an_item(spark, item, text, held):
    """An opening capital is a word or a name; windows poor in words are found as they stand, and only so."""
    docs = spark.createDataFrame([(1, f"{LONG[:3000]} {text}"), (2, text), (3, LONG[:3000])], "doc_id long, text string")
    rows = decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in rows) == ([1, 2] if held else [])


def test_questions_with_other_names_and_numbers(spark):
    """Every item is planted with other fillings, names at openings too; nothing else is found."""
    rng = random.Random(11)
    names = "Anna Peter Maria John Laura Simon Clara Victor Emma Oscar".split()
    stock = [f"{a}{b}" for a in "ba ko ri tu me la so ni".split() for b in "len rak sit mon dur pel".split()]

    def question():
        parts = []
        for _ in range(4):
            verbs = rng.sample(stock, 6)
            parts.append("{0} " + f"{verbs[0]} {verbs[1]} " + "{%d} " % rng.randint(1, 3) + f"{verbs[2]} {verbs[3]} {verbs[4]} {verbs[5]}.")
        return " ".join(parts)

    def filled(form):
        return form.format(rng.choice(names), *rng.sample(range(2, 99), 3))

    forms = [question() for _ in range(60)]
    items = [(k, filled(f)) for k, f in enumerate(forms)]
    filler = " ".join(rng.choice(stock) for _ in range(300))
    table = [(k, f"{filler[: rng.randint(0, 900)]} {filled(f)} {filler}") for k, f in enumerate(forms)]
    table += [(1000 + k, f"{filler} {filled(question())}") for k in range(60)]
    rows = decontaminate.contaminated(
        spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    planted = {(k, k) for k in range(60)}
    assert len(found & planted) >= 0.95 * len(planted) and not found - planted


def test_slots_must_agree():
    ok = [("0\x1e1\x1e5", "0\x1e1\x1e7"), ("3\x1e1\x1e5", "3\x1e1\x1e7"), ("2\x1e1\x1e5", "2\x1e1\x1e8")]
    assert decontaminate.agreeing(ok) == [True, True, False]


def test_an_item_held_twice_with_other_fillings(spark):
    item = "we know that 5 boys and 7 girls share 9 cakes with 4 friends of 6 teachers at home"
    once = "we know that 8 boys and 3 girls share 2 cakes with 1 friends of 9 teachers at home"
    again = "we know that 4 boys and 6 girls share 7 cakes with 8 friends of 2 teachers at home"
    others = " ".join(f"so that 1{k} boys and 2{k} girls share 3{k} cakes with 4{k} friends of 5{k} teachers at last" for k in range(9))
    table = [(1, f"{once} but then {again}"), (2, f"{others} {item} {others}"), (3, "we know that boys and girls share cakes")]
    rows = decontaminate.contaminated(
        spark.createDataFrame(table, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    ).collect()
    assert sorted((r["doc_id"], r["n_found"] == r["n_windows"], r["n_changed"] > 0) for r in rows) == [(1, True, True), (2, True, False)]


def test_leaks_by_brute_force(spark, sf_dir, docs, texts):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    grams = {tuple(w[i : i + 13]) for r in items.collect() for w in [words(r["text"])] for i in range(len(w) - 12)}
    expected = {i for i, t in texts for w in [words(t)] if any(tuple(w[k : k + 13]) in grams for k in range(len(w) - 12))}
    found = {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()}
    assert expected <= found
    left = decontaminate.clean_documents(docs, items)
    assert left.schema == docs.schema and {r["doc_id"] for r in left.collect()} == {i for i, _ in texts} - found


# Pages


def test_addresses_and_rules(spark):
    urls = [
        (1, "HTTP://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://b.net", "b.net", "", None, "allow"),
        (3, "http://b.net/", "b.net", "/", "net/", "block"),
        (4, None, "", "", None, "allow"),
        (5, "no address", "", "", None, "allow"),
        (6, "x://fr.org/fr/?a=/", "fr.org", "/fr/", "org/fr/", "allow"),
        (6, "x://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    ]
    pages = spark.createDataFrame([(a, b, "x") for a, b, *_ in urls], "page_id long, url string, host string")
    rows = url_templates.filter_urls(pages, queries.RULES).collect()
    found = sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in rows)
    assert found == sorted((a, c, d, e or "", f) for a, _, c, d, e, f in urls)


def test_impure_templates_are_rejected(spark):
    urls = [(k, f"http://h.example/spam/{k}") for k in range(400)] + [(1000 + k, f"http://h.example/news/{k}") for k in range(400)]
    rules = [(f"h.example/spam/{k}", "block") for k in range(10, 100)] + [(f"h.example/news/{k}", "allow") for k in range(10, 100)]
    rules = [(a, b) for a, b in rules][:180]
    rows = url_templates.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()
    verdicts = {(r["template"], r["verdict"]) for r in rows if r["rule"] is None}
    assert ("/spam/*", "block") in verdicts and ("/news/*", "allow") in verdicts and len(verdicts) == 2


def test_a_list_of_blocking_rules_only(spark):
    """Every label says block, so the prior is 1: templates without labels must pass all the same."""
    urls = [(k, f"http://good.example/news/{k}") for k in range(50)] + [(100 + k, f"http://a.net/x/{k}") for k in range(20)]
    urls += [(200 + k, f"http://h.example/spam/{k}") for k in range(60)]
    rules = [("net/", "block")] + [(f"h.example/spam/{k}", "block") for k in range(10, 20)]
    rows = url_templates.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()
    blocked = {r["page_id"] for r in rows if r["verdict"] == "block"}
    assert blocked == {i for i, _ in urls if i >= 100}


def _prose(rng, n=12):
    return " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 9))) for _ in range(n)) + "."


def test_layouts_without_an_article_element(spark):
    """Hosts of several layouts, of copies, and with repeated lines, against the texts that the pages were made of."""
    rng = random.Random(3)
    menu = "<div><ul>" + "".join(f"<li><a href='/{k}'>Section number {k} of this site</a></li>" for k in range(9)) + "</ul></div>"

    def plain(texts):
        return f"<html><body>{menu}<div><div><h1>{texts[0]}</h1>{''.join(f'<p>{x}</p>' for x in texts[1:])}</div></div></body></html>"

    def tabular(texts):
        rows = "".join(f"<tr><td><p>{x}</p></td></tr>" for x in texts)
        return f"<html><body>{menu}<section><table>{rows}</table></section><div>Made here</div></body></html>"

    def tagged(texts):
        return f"<html><body>{menu}<article><h1>{texts[0]}</h1>{''.join(f'<p>{x}</p>' for x in texts[1:])}</article></body></html>"

    def flagged(texts):  # the only article element is a comment
        return plain(texts).replace("</body>", "<div class='comments'><article><p>I do not think so.</p></article></div></body>")

    pages, expected = [], {}

    def add(host, form, texts, without=()):
        i = len(pages)
        pages.append((i, f"http://{host}/{i}", form(texts), "x", 1))
        expected[i] = "\n".join(x for x in texts if x not in without)

    for k in range(10):
        add("mixed.example", tagged if k == 4 else plain, [_prose(rng, 4), *[_prose(rng) for _ in range(1 + k % 3)]])
    same = [_prose(rng, 4), _prose(rng), _prose(rng)]
    for _ in range(6):
        add("copies.example", plain, same)
    for k in range(16):
        add("two.example", (plain, tabular)[k % 2], [_prose(rng, 4), *[_prose(rng) for _ in range(2 + k % 3)]])
    line = "Write to us if you have seen something of interest to our readers."
    for _ in range(8):
        add("lines.example", plain, [_prose(rng, 4), _prose(rng), line, _prose(rng)], without=[line])
    for _ in range(6):
        add("flagged.example", flagged, [_prose(rng, 4), _prose(rng), _prose(rng)])
    add("one.example", plain, [_prose(rng, 4), *[_prose(rng, 30) for _ in range(400)]])
    pages += [pages[0], (None, None, None, None, None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, host string, layout int").repartition(3)
    rows = html_wrappers.extract(table).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == expected.get(r["page_id"], "") and r["n_chars"] == len(r["text"]), (r["url"], r["text"])


def test_main_text_of_given_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")

    def plain(source):
        inside = re.search("<article>(.*?)</article>", source, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        return "\n".join(x for x in parts if x)

    expected = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    rows = html_wrappers.extract(pages).collect()
    assert {r["page_id"]: r["text"] for r in rows} == expected and all(r["n_chars"] == len(r["text"]) for r in rows)


def test_odd_pages(spark):
    body = "<div class='comments'><p>nice</p></div><aside>x</aside><form>f</form>"
    pages = [
        (1, "http://a/1", f"<nav>m</nav><article><h1>T</h1><p>a &amp; b<p>c  d{body}</article><footer>f</footer>"),
        (2, "http://a/2", None),
        (3, None, ""),
        (4, "http://b/4", "<script>if(a<b){x='</p>'}</script><div><p>running text of the page</p></div><style>p{}"),
        (5, "http://a/1", "<article><p title='a>b'>only <b>this</b></p><ul><li>i<li>j</ul></article>"),
    ]
    rows = html_wrappers.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    found = {r["page_id"]: r["text"] for r in rows}
    assert found == {1: "T\na & b\nc d", 2: "", 3: "", 4: "running text of the page", 5: "only this\ni\nj"}


def test_wrappers_have_optional_and_repeated_groups():
    def wrapper(source):
        return html_wrappers._tree(html_wrappers.Page(source).stream)

    first = wrapper("<div><h1>t</h1><ul><li>a</li><li>b</li></ul></div>")
    second = wrapper("<div><h1>t</h1><h2>u</h2><ul><li>a</li></ul></div>")
    both = html_wrappers.aligned(first, second)
    assert html_wrappers.as_text(both) == "<div><h1>#</h1>(<h2>#</h2>)?<ul>(<li>#</li>)+</ul></div>"
    assert html_wrappers.from_text(html_wrappers.as_text(both)) == both


def test_many_streams_of_a_host_are_aligned_in_rounds(spark):
    rng = random.Random(8)
    names = "h1 h2 p ul table section".split()
    streams = {"".join(f"<{x}>#</{x}>" for x in rng.choices(names, k=rng.randint(1, 6))) for _ in range(150)}
    rows = [("a", s, 2) for s in sorted(streams)] + [("b", "<p>#</p>", 1)]
    table = spark.createDataFrame(rows, "host string, wrapper string, n long")
    for size in (4, 1000):
        found = {r["host"]: r for r in html_wrappers._aligned_hosts(table, size).collect()}
        assert set(found) == {"a", "b"} and found["a"]["n"] == 2 * len(streams) and found["b"]["wrapper"] == "<p>#</p>"
        assert set(html_wrappers.slots(html_wrappers.from_text(found["a"]["wrapper"]))) == set(names)


# Language model and toxicity


def test_language_model(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    rows = maxent_lm.score_texts(table).collect()
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words(t), ""])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w = [*words(texts[r["doc_id"]]), ""]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[x] > 0 for x in w), n)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_grows_with_the_tokens(spark, sf_dir, monkeypatch):
    unit = maxent_lm.UNIT
    sizes = [maxent_lm.Vocabulary({}, {}, n, 1) for n in (unit // 2, unit, 8 * unit, 1000 * unit)]
    assert [v.growth for v in sizes[:3]] == [1.0, 1.0, pytest.approx(2.0)]
    assert sizes[2].feature_rows == pytest.approx(2 * maxent_lm.ROWS, abs=1)
    assert sizes[3].tasks == pytest.approx(100 * sizes[1].tasks, abs=1)  # what tasks send stays in proportion
    monkeypatch.setattr(maxent_lm, "UNIT", 500)
    monkeypatch.setattr(maxent_lm, "PER_TASK", 500)
    rows = maxent_lm.score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(math.isfinite(r["score"]) for r in rows)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_knows_the_word_before_inside_a_class(spark, monkeypatch):
    """All words in one class, all equally frequent: only the history tells a usual pair from an unusual one."""
    monkeypatch.setattr(maxent_lm, "classes_of", lambda company, known: np.r_[22, np.zeros(len(known.place) - 1, int), np.full(maxent_lm.LEAVES, 23)])
    ids = (i for i in range(10**6) if zlib.crc32(str(i).encode()) % 7 != 2)
    pairs = [(f"p{k}", f"q{k}") for k in range(40)]
    usual = [(next(ids), f"{p} {q} " * 10) for _ in range(40) for p, q in pairs]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    asked = [(p, q, other) for (p, q), (_, other) in zip(pairs, pairs[7:] + pairs[:7])]
    rows = [*usual, *zip(held, (f"{p} {q}" for p, q, _ in asked)), *zip(held[40:], (f"{p} {o}" for p, _, o in asked))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in maxent_lm.score_texts(table).collect()}
    assert sum(score[a] > score[b] + 0.3 for a, b in zip(held[:40], held[40:80])) >= 36


def test_word_tree_is_a_distribution():
    """Without weights every place has its share of its class; all places together have probability one."""
    classes = np.r_[22, np.arange(900) % 22, np.full(maxent_lm.LEAVES, 23)]
    mass = np.r_[50.0, 10_000.0 / np.arange(1, 901), np.ones(maxent_lm.LEAVES)]
    tree = maxent_lm.tree_of(classes, mass, 300)
    token, node, branch = tree.steps(np.arange(len(mass)))
    log = np.bincount(token, weights=tree.bias[node, branch])
    assert math.isclose(np.exp(log).sum(), 1.0, rel_tol=1e-5)
    assert tree.length.max() <= 4


def test_language_model_on_odd_rows(spark):
    assert maxent_lm.score_texts(odd(spark)).count() == len(ODD)


def test_maximal_segments():
    def all_maximal(scores):
        out = []

        def visit(a, b):
            best = max(((sum(scores[i:j]), -i, -j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
            if best[0] > 0:
                i, j = -best[1], -best[2]
                out.append((i, j))
                visit(a, i)
                visit(j, b)

        visit(0, len(scores))
        return sorted(out)

    rng = random.Random(2)
    lookup = {"a": 3.117, "b": 1.3713, "c": 0.9337, "d": 0.30119}
    for _ in range(300):
        text = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]
        scores = [lookup.get(t, 0.0) - toxicity.PRICE for t in text]
        n, found = toxicity.segments(" ".join(text), toxicity.Lookup(lookup))
        assert n == len(text) and sorted((a, b) for a, b, _ in found) == all_maximal(scores)


def test_toxicity_on_held_out_labels(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.1")
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(table, labels)
    rows = toxicity.score(table, model).join(labels, "doc_id").filter("held_out").collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    false = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(caught) / len(caught) > 0.9 and sum(false) / len(false) < 0.03


def test_toxicity_on_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd(spark), labels)
    assert toxicity.score(odd(spark), model, passages=True).count() == len(ODD)


# All of them


def test_odd_rows_in_row_wise_operators(spark):
    table = odd(spark)
    assert quality_lines.quality(table, with_text=True).count() == len(ODD)
    assert quality_lines.kept_documents(table).schema == table.schema
    items = spark.createDataFrame([(1, "word1 and more word2 and more word3 and more word4 and more word5")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(table, items).collect()} == {5, 9}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_templates.filter_urls(pages, queries.RULES).count() == 0
    assert html_wrappers.extract(pages).count() == 0
    assert decontaminate.contaminated(none, items).count() == 0
    assert packing.pack(none, word_bpe_path()).count() == 0
    assert substring_dedup.dedup_substrings(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert quality_lines.quality(none).count() == 0
    assert maxent_lm.score_texts(none).count() == 0
    assert token_files.encode_corpus(none, word_bpe_path()).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_pipeline(spark, sf_dir, docs, texts):
    import corpus_pipeline

    table, kept = docs, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, table = table, stage(spark, table, sf_dir)
        assert table.schema == docs.schema, name
        assert table.count() <= before.count()
        if name == "quality_rules":
            kept = {r["doc_id"] for r in table.collect()}
            assert kept == {i for i, t in texts if quality_lines.judge(t)[6]}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in table.collect()} <= kept
