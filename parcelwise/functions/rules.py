"""Comparison and classification rules as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelwise.functions.arrays import when_list

# Comparison classes, best first; the rank is the position.
CLASSES = ("exact", "strong", "representative", "context_only", "unavailable")
DEFAULT_CLASSES = ("exact", "strong", "representative")

# Wedge arithmetic counts twelve months a year.
MONTHS = 12


@dataclass(frozen=True)
class PeriodLimits:
    """Largest month distance of each period class (fixed default values)."""

    near: int = 6
    representative: int = 18
    context: int = 36


def class_rank(c: Column, unknown: int = 99) -> Column:
    out = F.when(c == CLASSES[0], 0)
    for i, name in enumerate(CLASSES[1:], 1):
        out = out.when(c == name, i)
    return out.otherwise(unknown)


def period_class(months: Column, limits: PeriodLimits = PeriodLimits()) -> Column:
    return (
        F.when(months == 0, "same_month")
        .when(months <= limits.near, "near")
        .when(months <= limits.representative, "representative_window")
        .when(months <= limits.context, "context_only")
        .otherwise("too_far")
    )


# The sentences of the reasons in this and the next functions.
def period_reasons(months: Column, limits: PeriodLimits = PeriodLimits()) -> Column:
    kind = period_class(months, limits)
    return when_list(
        (months > 0, F.concat(F.lit("observation periods differ by "), months.cast("string"), F.lit(" month(s)"))),
        (kind == "representative_window", "periods differ materially but remain useful for scale"),
        (kind == "context_only",
         f"periods differ by more than {limits.representative} months (orientation only)"),
        (kind == "too_far",
         f"periods differ by more than {limits.context} months — no defensible non-historical comparison"),
    )


def all_units(scope: Column, bedroom: Column) -> Column:
    return (F.coalesce(scope, F.lit("")) == "all_units") & bedroom.isNull()


def impossible_request(scope: Column, bedroom: Column, requested: Column) -> Column:
    """An all-unit measure cannot answer a bedroom request."""
    return all_units(scope, bedroom) & requested.isNotNull()


def scope_kind(t_scope: Column, t_bedroom: Column, m_scope: Column, m_bedroom: Column) -> Column:
    t_all, m_all = all_units(t_scope, t_bedroom), all_units(m_scope, m_bedroom)
    m_specific = m_bedroom.isNotNull() | (F.coalesce(m_scope, F.lit("")) == "bedroom_specific")
    return (
        F.when(t_bedroom == m_bedroom, "same_bedroom")
        .when(t_all & m_all, "all_unit_vs_all_unit")
        .when(t_all & m_specific, "development_wide_vs_representative_bedroom")
        .when(t_scope.eqNullSafe(m_scope) & ~m_specific & t_bedroom.isNull(), "all_unit_vs_all_unit")
        .otherwise("incompatible")
    )


def _scope_text(scope: Column, bedroom: Column) -> Column:
    tail = F.when(bedroom.isNull(), "").otherwise(F.concat(F.lit("/"), bedroom.cast("string"), F.lit("BR")))
    return F.concat(F.coalesce(scope, F.lit("None")), tail)


def scope_reasons(t_scope: Column, t_bedroom: Column, m_scope: Column, m_bedroom: Column) -> Column:
    kind = scope_kind(t_scope, t_bedroom, m_scope, m_bedroom)
    both_all = all_units(t_scope, t_bedroom) & all_units(m_scope, m_bedroom)
    wide = kind == "development_wide_vs_representative_bedroom"
    return when_list(
        (kind == "same_bedroom",
         F.concat(F.lit("same bedroom scope ("), t_bedroom.cast("string"), F.lit("BR)"))),
        ((kind == "all_unit_vs_all_unit") & both_all, "all-unit actual vs all-unit market measure"),
        ((kind == "all_unit_vs_all_unit") & ~both_all,
         F.concat(F.lit("comparable unit scope ("), F.coalesce(t_scope, F.lit("None")), F.lit(")"))),
        (wide, "tenant observation is development-wide"),
        (wide & m_bedroom.isNotNull(),
         F.concat(F.lit("market observation is "), m_bedroom.cast("string"), F.lit("BR-specific"))),
        (wide & m_bedroom.isNull(), "market observation is bedroom-specific"),
        (kind == "incompatible",
         F.concat(F.lit("unit scopes differ (tenant="), _scope_text(t_scope, t_bedroom),
                  F.lit(", market="), _scope_text(m_scope, m_bedroom), F.lit(")"))),
    )


def _definition(c: Column) -> Column:
    return F.lower(F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(c))


def gross_net_ok(tenant: Column, market: Column) -> Column:
    t, m = _definition(tenant), _definition(market)
    return (t == "unknown") | (m == "unknown") | (t == m)


def gross_net_reasons(tenant: Column, market: Column, utility: Column | None = None) -> Column:
    t, m = _definition(tenant), _definition(market)
    both = F.concat(F.lit("(tenant="), t, F.lit(", market="), m, F.lit(")"))
    mismatch = ~gross_net_ok(tenant, market)
    partial = (t != m) & ((t == "unknown") | (m == "unknown"))
    pairs = [
        (t == "unknown", "tenant gross/net definition is unknown"),
        (m == "unknown", "market gross/net definition is unknown"),
        (mismatch, F.concat(F.lit("gross/net mismatch "), both)),
        (partial, F.concat(F.lit("gross/net partially unknown "), both, F.lit(" — not inferred"))),
    ]
    if utility is not None:
        pairs.append((~mismatch & (F.coalesce(utility, F.lit("")) != ""),
                      F.concat(F.lit("tenant utility basis: "), utility)))
    return when_list(*pairs)


# What each measure basis discloses.
BASIS_TEXTS = {
    "asking": "market geography is a named neighborhood rather than the exact development footprint",
    "regulatory_market_benchmark": "market comparator is HUD SAFMR (regulatory gross-rent benchmark), not median asking rent",
    "index": "market comparator is Zillow ZORI (typical observed market-rent index), not median asking rent and not bedroom-specific",
}


def basis_reasons(basis: Column, area_id: Column, sources: dict[str, str] = BASIS_TEXTS) -> Column:
    """Disclosures that come with a measure basis, then the one for areas that are ZIP codes."""
    by_zip = F.startswith(F.coalesce(area_id, F.lit("")), F.lit("zcta:"))
    zip_text = F.concat(
        F.lit("market geography is ZIP/ZCTA "), F.split(area_id, ":").getItem(1),
        F.lit(" rather than the exact development footprint"))
    pairs = [(basis == name, text) for name, text in sources.items()]
    pairs.append((basis.isin("regulatory_market_benchmark", "index") & by_zip, zip_text))
    return when_list(*pairs)


def quality_class(period: Column, scope: Column, gross_ok: Column, basis: Column, contains: Column) -> Column:
    """Class of a subject/market pair; the first line that holds decides.

    ``contains`` is the caller's statement that the market area contains the subject; an asking basis never
    counts as direct geography, so only a regulatory benchmark can be exact.
    """
    exact = (
        (period == "same_month") & gross_ok & (basis == "regulatory_market_benchmark")
        & F.coalesce(contains, F.lit(False))
    )
    return (
        F.when(period == "too_far", "unavailable")
        .when(period == "context_only", "context_only")
        .when(scope.isin("development_wide_vs_representative_bedroom", "incompatible"), "representative")
        .when(period == "representative_window", "representative")
        .when((scope == "same_bedroom") & exact, "exact")
        .otherwise("strong")
    )


def wedge(tenant: Column, market: Column) -> dict[str, Column]:
    """Difference, annual difference and share below; the caller rejects invalid inputs first."""
    return {
        "monthly_wedge": market - tenant,
        "annual_wedge": (market - tenant) * MONTHS,
        "pct_below": F.lit(1.0) - F.try_divide(tenant, market),
    }


def wedge_inputs_ok(tenant: Column, market: Column) -> Column:
    return F.coalesce((market > 0) & (tenant >= 0), F.lit(False))


# Source keys and the marks that identify them in artifact or observation ids.
SOURCE_MARKS = (
    ("hud_safmr", "regulatory_market_benchmark", "hud-safmr", "hud"),
    ("zori", "index", "zori", "zori"),
    ("renthop", "asking", "renthop", "renthop"),
)


def market_source(basis: Column, observation_id: Column, artifact_id: Column) -> Column:
    basis, oid, art = (F.coalesce(c, F.lit("")) for c in (basis, observation_id, artifact_id))
    out = F
    for key, b, in_artifact, in_id in SOURCE_MARKS:
        out = out.when((basis == b) | art.contains(in_artifact) | oid.contains(in_id), key)
    return out.otherwise(F.when(basis != "", basis).otherwise("unknown"))


def source_from_id(comparison_id: Column) -> Column:
    cid = F.coalesce(comparison_id, F.lit(""))
    return (
        F.when(cid.contains("hud-safmr") | cid.contains("hud_safmr"), "hud_safmr")
        .when(cid.contains("zori"), "zori")
        .when(cid.contains("renthop"), "renthop")
    )


def sign_label(x: Column) -> Column:
    return F.when(x > 0, "positive").when(x < 0, "negative").when(x == 0, "zero")


def direction_change(reference: Column, current: Column) -> Column:
    """How the sign of a difference moved from a reference to the current value."""
    ref, cur = sign_label(reference), sign_label(current)
    return (
        F.when(ref == cur, "unchanged").when(ref == "zero", "emerged").when(cur == "zero", "neutralized")
        .otherwise("reversed")
    )


def scale_change(reference: Column, current: Column) -> Column:
    ref, cur = F.abs(reference), F.abs(current)
    return F.when(cur > ref, "increased").when(cur < ref, "decreased").otherwise("unchanged")


def intervals_overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Null when a bound is missing or not finite."""
    known = F.lit(True)
    for c in (a_low, a_high, b_low, b_high):
        known = known & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(known, (a_low <= b_high) & (b_low <= a_high))


# Building-code regimes and the exclusive groups built from them.
REGIMES = {
    "05": "public_housing", "32": "rent_stabilized", "90": "rent_controlled", "97": "other_regulated",
    "80": "unregulated",
}
REGULATED = ("rent_stabilized", "rent_controlled", "other_regulated")


def regime(code: Column) -> Column:
    out = F
    for key, name in REGIMES.items():
        out = out.when(code == key, name)
    return out.otherwise("unknown")


def group_issues(eligible: Column, regime_name: Column, assisted: Column, voucher: Column) -> Column:
    yes_voucher = voucher == "yes"
    return when_list(
        (eligible & ((assisted == "not_applicable") | (voucher == "not_applicable")),
         "renter_assistance_not_applicable"),
        (eligible & (assisted == "no") & yes_voucher, "voucher_conflicts_with_no_assistance"),
        (eligible & (regime_name == "public_housing") & yes_voucher,
         "public_housing_voucher_overlap_requires_review"),
    )


def primary_group(eligible: Column, regime_name: Column, assisted: Column, voucher: Column) -> Column:
    """One exclusive label per row; contradictory answers are unknown, never unassisted."""
    clash = (
        (assisted == "not_applicable") | (voucher == "not_applicable")
        | ((voucher == "yes") & ((assisted == "no") | (regime_name == "public_housing")))
    )
    return (
        F.when(~eligible, "ineligible")
        .when(clash, "unknown")
        .when(regime_name == "public_housing", "public_housing")
        .when(voucher == "yes", "section8_voucher")
        .when(regime_name.isin(*REGULATED), regime_name)
        .when(assisted == "yes", "other_or_unspecified_assistance")
        .when((regime_name == "unregulated") & (assisted == "no") & (voucher == "no"), "unassisted_market")
        .otherwise("unknown")
    )


def section_of(header: Column, secondary: tuple[str, ...] = ("LLC", "MIXED FINANCE")) -> Column:
    hit = F.lit(False)
    for mark in secondary:
        hit = hit | F.upper(header).contains(mark)
    return F.when(hit, "secondary").otherwise("primary")


def parse_confidence(required_id: Column, optional_count: Column) -> Column:
    return F.when(F.coalesce(required_id, F.lit("")) == "", "low").when(optional_count.isNull(), "medium").otherwise("high")


def bedroom_label(bedroom: Column) -> Column:
    return F.when(bedroom == 0, "Studio").otherwise(F.concat(bedroom.cast("string"), F.lit("BR")))


def market_label(basis: Column, source: Column, artifact: Column, bedroom: Column, scope: Column) -> Column:
    basis, source, artifact = (F.coalesce(c, F.lit("")) for c in (basis, source, artifact))
    benchmark = (basis == "regulatory_market_benchmark") | (source == "hud_safmr") | artifact.contains("hud-safmr")
    index = (basis == "index") | (source == "zori") | artifact.contains("zori")
    asking = (source == "renthop") | artifact.contains("renthop")
    return (
        F.when(benchmark & bedroom.isNotNull(), F.concat(F.lit("Market "), bedroom_label(bedroom), F.lit(" (HUD)")))
        .when(benchmark, "Market (HUD)")
        .when(index, "Market all-units (ZORI)")
        .when(asking, "Market (RentHop)")
        .when(bedroom.isNotNull(), F.concat(F.lit("Market "), bedroom_label(bedroom)))
        .when(scope == "all_units", "Market all-units")
        .otherwise("Market rent")
    )


# Wording for how a market number was measured.
MEASURED = {
    "asking": "measured (listing median)",
    "regulatory_market_benchmark": "measured (regulatory benchmark)",
    "index": "measured (observed-rent index)",
}


def measured_label(present: Column, basis: Column) -> Column:
    out = F.when(~present, "unknown")
    for key, text in MEASURED.items():
        out = out.when(basis == key, text)
    return out.otherwise("measured")


def metric_value(metric: str) -> Column:
    """Value of one of the six plotted metrics from a metric row."""
    columns = {
        "pct-below": "pct_below", "monthly-wedge": "monthly_wedge", "annual-wedge": "annual_wedge",
        "market-rent": "market_value", "actual-rent": "tenant_value",
    }
    if metric == "quality":
        return F.when(F.col("class_ordinal") >= 0, F.col("class_ordinal")).cast("double")
    return F.col(columns[metric]).cast("double")
