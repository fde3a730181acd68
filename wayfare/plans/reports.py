"""The reports: report -> query -> (operator, tables it reads)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from wayfare.operators import comparison, findings, funnel, metrics, model, product, quality, search

Entry = tuple[Callable[..., DataFrame], tuple[str, ...]]

_RAW = ("raw_browsing", "raw_search", "raw_catalog")
_BROWSING, _SEARCH, _CATALOG = ("raw_browsing",), ("raw_search",), ("raw_catalog",)
_PROFILE = ("session_profile",)
_SESSIONS, _QUERIES, _PRODUCTS = ("fct_session",), ("stg_search",), ("fct_product_performance",)
_CELLS, _MEDIANS = ("session_cells",), ("session_medians",)
_CARTS = ("ml_cart_sessions",)
_SCORES, _COMPARED = ("model_scores",), ("model_comparison",)


def _fit(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda scores: comparison.of_fit(scores, name)


def _baseline(carts: DataFrame) -> DataFrame:
    return metrics.evaluate(model.baseline_scores(carts), comparison.BASELINE)


REPORTS: dict[str, dict[str, Entry]] = {
    "data_quality": {
        "dq_volume": (quality.volume, ("session_profile", *_RAW)),
        "dq_span": (quality.span, _PROFILE),
        "dq_completeness": (quality.completeness, _BROWSING),
        "dq_event_taxonomy": (quality.event_taxonomy, _BROWSING),
        "dq_consistency": (quality.consistency, _BROWSING),
        "dq_duplicates": (quality.duplicates, _PROFILE),
        "order_inversions": (quality.order_inversions, _PROFILE),
        "timestamp_collisions": (quality.timestamp_collisions, _PROFILE),
        "pdp_pairs": (quality.pdp_pairs, _PROFILE),
        "session_gaps": (quality.session_gaps, _PROFILE),
        "session_duration_stats": (quality.session_duration_stats, _PROFILE),
        "dq_orphan_skus": (quality.orphan_skus, ("raw_browsing", "raw_catalog")),
        "dq_catalog_missing": (quality.catalog_missing, _CATALOG),
        "category_depth_hist": (quality.category_depth, _CATALOG),
        "dq_funnel_integrity": (quality.funnel_integrity, _PROFILE),
        "dq_search": (quality.search_lists, _SEARCH),
        "dq_search_phantom": (quality.search_phantom, _SEARCH),
        "dq_search_sizes": (quality.search_sizes, _SEARCH),
        "dq_search_orphans": (quality.search_orphans, ("session_profile", "raw_search")),
        "dq_findings": (quality.findings, ("session_profile", *_RAW)),
    },
    "funnel": {
        "funnel_overview": (funnel.overview, _CELLS),
        "funnel_headline": (funnel.headline, _CELLS),
        "cart_abandonment": (funnel.abandonment, _CELLS + _MEDIANS),
        "conversion_by_cart_size": (funnel.by_cart_size, _CELLS),
        "session_depth": (funnel.session_depth, _CELLS + _MEDIANS),
        "timing_medians": (funnel.timing_medians, _CELLS + _MEDIANS),
        "search_influence": (funnel.search_influence, _CELLS),
        "dow_pattern": (funnel.by_weekday, _CELLS),
        "hourly_pattern": (funnel.by_hour, _CELLS),
        "hourly_extremes": (funnel.hourly_extremes, _CELLS),
        "v_funnel": (funnel.funnel_view, _CELLS),
        "funnel_findings": (findings.funnel_findings, _CELLS),
    },
    "entry": {  # the cells do not have the hour of the first event
        "entry_hours": (funnel.by_entry_hour, ("fct_session", "stg_browsing")),
    },
    "search": {
        "search_volume": (search.volume, _QUERIES),
        "position_bias": (search.position_bias, _QUERIES),
        "position_curve": (search.position_curve, _QUERIES),
        "click_rank_stats": (search.click_rank_stats, _QUERIES),
        "search_click_outcome": (search.click_outcome, ("stg_search", "stg_browsing")),
        "zero_result_impact": (search.zero_result_impact, _SESSIONS),
        "search_findings": (findings.search_findings, ("stg_search", "stg_browsing", "fct_session")),
    },
    "product": {
        "catalog_coverage": (product.coverage, ("dim_product", "fct_product_performance")),
        "coverage_by_traffic": (product.coverage_by_traffic, _PRODUCTS),
        "missingness_xtab": (product.missingness, _PRODUCTS),
        "unviewed_behaviour": (product.behaviour_by_view, _PRODUCTS),
        "category_performance": (product.category_performance, _PRODUCTS),
        "price_sensitivity": (product.price_sensitivity, _PRODUCTS),
        "price_extremes": (product.price_extremes, _PRODUCTS),
        "assortment_shape": (product.assortment_shape, _PRODUCTS),
        "demand_concentration": (product.demand_concentration, _PRODUCTS),
        "lorenz_curve": (product.lorenz_curve, _PRODUCTS),
        "v_category_performance": (product.category_view, ("fct_product_performance", "dim_product")),
        "product_findings": (findings.product_findings, _PRODUCTS),
    },
    "purchase_intent": {
        "baseline": (_baseline, _CARTS),
        "fit_logistic": (_fit(comparison.LOGISTIC), ("logistic_scores",)),
        "fit_gbt": (_fit(comparison.BOOSTING), ("boosting_scores",)),
        "leakage_demo": (model.leakage_demo, ("leaky_scores",)),
        "accounting_identity": (model.accounting_identity, _SESSIONS),
        "class_means": (model.class_means, _CARTS),
        "model_comparison": (lambda table: table, _COMPARED),
        "fitted_curves": (comparison.curves, _SCORES),
        "model_findings": (comparison.model_findings, _COMPARED),
    },
}


def run_report(name: str, tables, target: str) -> list[str]:
    """Write every table of a report as one CSV folder under `target`; returns the folders."""
    folders = []
    for query, (operator, needs) in REPORTS[name].items():
        folder = f"{target}/{name}/{query}"
        operator(*[tables[t] for t in needs]).write.mode("overwrite").option("header", True).csv(folder)
        folders.append(folder)
    return folders
