"""Small CSV inputs with every known fault of front-end tracking, planted at known places.

Deterministic by session number, so the tests can say exactly what must come out.
"""

from __future__ import annotations

import csv
import hashlib
import random
from pathlib import Path

START = 1_550_016_000_000
SESSIONS, SKUS = 240, 60


def ident(kind: str, number: int) -> str:
    return hashlib.sha256(f"{kind}:{number}".encode()).hexdigest()


def browsing() -> list[list[str]]:
    log = []
    for s in range(SESSIONS):
        name, clock, events = ident("session", s), START + s * 2_700_000, []

        def add(kind, action, sku, url, at):
            events.append([name, kind, action, "" if sku is None else ident("sku", sku), str(at), ident("url", url)])

        add("pageview", "", None, s % 9, clock)
        for v in range(1 + s % 3):
            sku, at = (s * 7 + v * 11) % SKUS, clock + 20_000 * (v + 1)
            add("event_product", "detail", sku, 10 + v, at)
            add("pageview", "", None, 10 + v, at)  # the double fire: same instant, same page
        at = clock + 120_000
        if s % 4 == 0:
            add("event_product", "add", (s * 7) % SKUS, 20, at)
            if s % 8 == 0:
                add("event_product", "purchase", (s * 7) % SKUS, 21, at + 60_000)
            if s % 12 == 4:
                for _ in range(2):  # consecutive removes are copies of one another
                    add("event_product", "remove", (s * 7) % SKUS, 22, at + 30_000)
        if s % 25 == 1:  # a cart from an earlier session
            add("event_product", "purchase", s % SKUS, 23, at)
        if s % 20 == 3:  # a pause beyond the session rule
            add("pageview", "", None, 24, at + 45 * 60_000)
        if s % 30 == 5:  # a SKU no catalog knows
            add("event_product", "detail", 1000 + s, 25, at)
        if s % 15 == 2:  # a pixel fired twice
            events.append(list(events[0]))
        if s % 16 == 0:  # bought before anything was added
            add("event_product", "purchase", 5, 26, clock + 1_000)
        log += events
    random.Random(11).shuffle(log)
    return log


def search() -> list[list[str]]:
    log = []
    for q in range(180):
        shown = [ident("sku", (q * 3 + i * 7) % SKUS) for i in range(q % 6)]  # none for each sixth
        clicked = [shown[q % len(shown)]] if shown and q % 3 == 1 else []
        if q % 10 == 4:
            clicked = clicked + [ident("sku", 5000 + q)]  # a click outside the list
        session = ident("session", (q * 5) % (SESSIONS + 20))  # some never browse
        vector = "[" + ", ".join(f"{(q * 13 + i) % 17 / 8 - 1:.6f}" for i in range(8)) + "]"
        log.append([session, vector, repr(clicked) if clicked else "", repr(shown) if shown else "", str(START + q * 3_600_000)])
    return log


def catalog() -> list[list[str]]:
    listed = []
    for k in range(SKUS):
        if k % 2:
            listed.append([ident("sku", k), "", "", "", ""])
            continue
        path = "/".join(ident("category", (k + level) % 4) for level in range(1 + k % 3))
        listed.append([ident("sku", k), "[0.5, -0.25]", path, "[100.0, -3.5]", f"{1 + k % 10}.0"])
    return listed


HEADERS = {
    "browsing_train.csv": "session_id_hash,event_type,product_action,product_sku_hash,server_timestamp_epoch_ms,hashed_url",
    "search_train.csv": "session_id_hash,query_vector,clicked_skus_hash,product_skus_hash,server_timestamp_epoch_ms",
    "sku_to_content.csv": "product_sku_hash,description_vector,category_hash,image_vector,price_bucket",
}


def write(folder: Path) -> dict[str, list[list[str]]]:
    made = {"browsing_train.csv": browsing(), "search_train.csv": search(), "sku_to_content.csv": catalog()}
    for name, lines in made.items():
        with (folder / name).open("w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out)
            writer.writerow(HEADERS[name].split(","))
            writer.writerows(lines)
    return made
