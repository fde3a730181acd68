"""What must come out of the fixture's CSV lines, worked out in plain Python one session at a time."""

from __future__ import annotations

from collections import defaultdict
from datetime import UTC, datetime

STAGES = {"detail": "product_detail", "add": "add_to_cart", "remove": "remove_from_cart", "purchase": "purchase"}


def weekday_and_hour(ms: int) -> tuple[int, int]:
    moment = datetime.fromtimestamp(ms / 1000, UTC)
    return moment.isoweekday() % 7, moment.hour


def trails(lines: list[list[str]]) -> dict[str, list[dict]]:
    """session -> its events in sequence, without copies and without pageviews that a detail fired as well."""
    first, copies = {}, defaultdict(int)
    for at, line in enumerate(lines):
        first.setdefault(tuple(line), at)
        copies[tuple(line)] += 1
    doubled = {(s, ms, url) for s, _, action, _, ms, url in first if action == "detail" and url}
    out = defaultdict(list)
    for key, at in sorted(first.items(), key=lambda x: (int(x[0][4]), x[1])):
        session, kind, action, sku, ms, url = key
        if kind == "pageview" and (session, ms, url) in doubled:
            continue
        event = {"stage": STAGES.get(action, "pageview"), "sku": sku or None, "url": url or None}
        out[session].append(event | {"ms": int(ms), "at": at, "copies": copies[key], "seq": len(out[session]) + 1})
    return dict(out)


def searches(lines: list[list[str]]) -> list[dict]:
    out = []
    for session, _, clicked, shown, ms in lines:
        clicks, results = (eval(x) if x else [] for x in (clicked, shown))  # noqa: S307
        valid = [x for x in clicks if x in results]
        out.append({"session": session, "ms": int(ms), "empty": not results, "valid": valid, "phantom": len(clicks) - len(valid)})
    return out


def _skus(events: list[dict], stage: str) -> set[str]:
    return {e["sku"] for e in events if e["stage"] == stage and e["sku"]}


def session_row(events: list[dict], asked: list[dict]) -> dict:
    def first(stage):
        return next((e for e in events if e["stage"] == stage), None)

    n = {stage: sum(e["stage"] == stage for e in events) for stage in ("pageview", *STAGES.values())}
    detail, add, buy = first("product_detail"), first("add_to_cart"), first("purchase")
    # A step that never happened leaves the order unknown, but a broken earlier step settles it.
    strict_add = False if not detail else None if not add else add["seq"] > detail["seq"]
    strict_purchase = strict_add if not strict_add else None if not buy else buy["seq"] > add["seq"]
    seconds = (events[-1]["ms"] - events[0]["ms"]) / 1000
    return {
        "n_events": len(events),
        "n_pageviews": n["pageview"],
        "n_product_views": n["product_detail"],
        "n_adds": n["add_to_cart"],
        "n_removes": n["remove_from_cart"],
        "n_purchases": n["purchase"],
        "n_skus_viewed": len(_skus(events, "product_detail")),
        "n_skus_added": len(_skus(events, "add_to_cart")),
        "n_skus_purchased": len(_skus(events, "purchase")),
        "n_unique_pages": len({e["url"] for e in events if e["url"]}),
        "duration_sec_raw": seconds,
        "duration_sec_capped": min(seconds, 1800),
        "strict_detail": detail is not None,
        "strict_add": strict_add,
        "strict_purchase": strict_purchase,
        "purchase_without_add": buy is not None and add is None,
        "cart_abandoned": add is not None and buy is None,
        "cart_emptied": add is not None and buy is None and n["remove_from_cart"] >= n["add_to_cart"],
        "is_bounce": len(events) == 1,
        "sec_to_first_add": add and (add["ms"] - events[0]["ms"]) / 1000,
        "sec_to_purchase": buy and (buy["ms"] - events[0]["ms"]) / 1000,
        "had_duplicate_events": any(e["copies"] > 1 for e in events),
        "n_searches": len(asked),
        "n_zero_result_searches": sum(q["empty"] for q in asked),
        "n_valid_search_clicks": sum(len(q["valid"]) for q in asked),
        "used_search": bool(asked),
    }


def cart_row(events: list[dict], asked: list[dict], listed: dict[str, list[str]]) -> dict | None:
    """Features up to the first add and what was bought after it; None without an add."""
    place = next((k for k, e in enumerate(events) if e["stage"] == "add_to_cart"), None)
    if place is None:
        return None
    add, before, after = events[place], events[: place + 1], events[place + 1 :]
    asked = [q for q in asked if q["ms"] <= add["ms"]]
    ms, pages = add["ms"] - events[0]["ms"], {e["url"] for e in before if e["url"]}
    viewed, bought = _skus(before, "product_detail"), [e for e in after if e["stage"] == "purchase"]
    weekday, hour = weekday_and_hour(add["ms"])
    _, _, path, _, price = listed.get(add["sku"], ["", "", "", "", ""])
    return {
        "pre_n_events": len(before),
        "pre_n_pageviews": sum(e["stage"] == "pageview" for e in before),
        "pre_n_product_views": sum(e["stage"] == "product_detail" for e in before),
        "pre_n_removes": sum(e["stage"] == "remove_from_cart" for e in before),
        "pre_n_skus_viewed": len(viewed),
        "pre_n_unique_pages": len(pages),
        "pre_viewed_added_sku": int(add["sku"] in viewed),
        "pre_add_position": add["seq"],
        "pre_sec_to_add": ms / 1000,
        "pre_events_per_min": len(before) / (ms / 60_000) if ms else None,
        "pre_skus_per_page": len(viewed) / len(pages) if pages else None,
        "pre_n_searches": len(asked),
        "pre_n_zero_result": sum(q["empty"] for q in asked),
        "pre_n_search_clicks": sum(len(q["valid"]) for q in asked),
        "pre_used_search": int(bool(asked)),
        "day_of_week": weekday,
        "hour_of_day": hour,
        "is_weekend": int(weekday in (0, 6)),
        "price_bucket": float(price) if price else None,
        "price_is_unknown": int(not price),
        "category_lvl1": path.split("/")[0] if path else "(unknown)",
        "category_depth": len(path.split("/")) if path else 0,
        "purchased": int(bool(bought)),
        "purchased_added_sku": int(any(e["sku"] == add["sku"] for e in bought)),
    }
