"""Thresholds and vocabularies. Every one is a parameter; the defaults are the domain's own values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PriceRule:
    """Hard limits and warning limits for the sale price of one property type."""

    minimum: float
    maximum: float
    warn_below: float
    warn_above: float


# Sale-price limits per property type (AED).
PRICE_RULES = {
    "Unit": PriceRule(50_000, 100_000_000, 200_000, 50_000_000),
    "Villa": PriceRule(200_000, 400_000_000, 500_000, 100_000_000),
    "Townhouse": PriceRule(100_000, 100_000_000, 300_000, 30_000_000),
    "Land": PriceRule(100_000, 500_000_000, 500_000, 200_000_000),
    "Building": PriceRule(500_000, 1_000_000_000, 2_000_000, 500_000_000),
}

# Price per square metre limits (AED).
SQM_RULE = PriceRule(100, 150_000, 500, 80_000)

# Room codes of the warehouse feed.
ROOM_LABELS = {
    "s": "Studio",
    "S": "Studio",
    "studio": "Studio",
    "7+": "7+ B/R",
}

# Unit type of the warehouse feed -> property type; anything else is "Unit".
PROPERTY_TYPES = {
    "Apartment": "Unit",
    "Hotel Apartment": "Unit",
    "Townhouse": "Townhouse",
    "Villa": "Villa",
    "Land": "Land",
    "Whole Building": "Building",
    "Park": "Land",
    "Resort": "Building",
}

# Sale sequence -> sale type; anything else is "Unknown".
SALE_TYPES = {"Offplan": "Off-Plan", "ReSale": "Existing"}

# Unit types accepted as valid, and the lowest accepted price per property type.
RELIABLE_UNIT_TYPES = ("Apartment", "Townhouse", "Villa")
MINIMUM_PRICES = {"Unit": 50_000, "Townhouse": 100_000, "Villa": 100_000}

# Spellings of the supply list's property types; anything else is "Other".
SUPPLY_PROPERTY_TYPES = {
    "Apartment": "Apartment",
    "Apartments": "Apartment",
    "Residential building": "Apartment",
    "Residential Building": "Apartment",
    "Residential": "Apartment",
    "Residential Tower": "Apartment",
    "Villa": "Villa",
    "Villas": "Villa",
    "Townhouse": "Townhouse",
    "Townhouses": "Townhouse",
    "Mixed-use": "Mixed Use",
    "Mixed Use": "Mixed Use",
    "Mixed-Use": "Mixed Use",
    "Mixed use": "Mixed Use",
    "Hotel": "Hotel",
    "Hotel Apartment": "Hotel Apartment",
    "Hotel Apartments": "Hotel Apartment",
    "Serviced Apartments": "Serviced Apartment",
    "Serviced Apartment": "Serviced Apartment",
    "Office": "Office",
    "Offices": "Office",
    "Retail": "Retail",
    "Shopping Mall": "Retail",
    "Commercial": "Commercial",
    "Land": "Land",
    "Plot": "Land",
    "Community": "Community",
    "Master Community": "Community",
    "Warehouse": "Commercial",
    "Industrial": "Commercial",
}

# Project status by lower-case spelling; an unknown status keeps its own text.
SUPPLY_STATUSES = {
    "completed": "Completed",
    "handed over": "Completed",
    "under construction": "Under Construction",
    "launched": "Launched",
    "on hold": "On Hold",
    "cancelled": "Cancelled",
    "under cancellation": "Cancelled",
}

# Canonical developer names.
SUPPLY_DEVELOPERS = {
    "Damac Properties": "DAMAC Properties",
    "Union properties": "Union Properties",
    "Five Holdings": "FIVE Holdings",
    "Al Manal Development Fzco": "Al Manal Development FZCO",
    "Abdulrazzq Ali Almadani": "ABDULRAZZQ ALI ALMADANI",
}

# Canonical height classes; "MI" has none.
SUPPLY_HEIGHT_CLASSES = {
    "Mid-Rise (5-12 floors)": "Mid-Rise",
    "Mid-rise": "Mid-Rise",
    "High-rise": "High-Rise",
    "High-Rise (13-39 floors)": "High-Rise",
    "Low-rise": "Low-Rise",
    "Low-Rise (1-4 floors)": "Low-Rise",
    "Single Famliy (Villa/Townhouse)": "Villa/Townhouse",
    "Single Family (Villa/Townhouse)": "Villa/Townhouse",
    "Skyscraper (40 floors+)": "Skyscraper",
    "Super Tall": "Supertall",
}
SUPPLY_NO_HEIGHT_CLASS = ("MI", "None", "")

# Phrases that published text must not contain.
SPECULATIVE_PHRASES = (
    "expected to",
    "projected to",
    "will likely",
    "is expected",
    "according to experts",
    "industry sources",
    "it is believed",
    "forecast",
    "prediction",
)

# Expected click-through rate by search position; elsewhere OTHER_CTR.
EXPECTED_CTR = {1: 0.28, 2: 0.15, 3: 0.11, 4: 0.08, 5: 0.06, 6: 0.05, 7: 0.04, 8: 0.03, 9: 0.03, 10: 0.02}
OTHER_CTR = 0.01

# Words of a page description that count as a call to action.
CALL_TO_ACTION_WORDS = ("discover", "explore", "find", "learn", "get", "start", "view")

# Words ignored when titles and queries are compared.
TITLE_STOP_WORDS = ("in", "the", "a", "for", "and", "or", "to", "of")

# Fixed value: marker for growth from a zero base.
INFINITE_GROWTH = 999999.0

SEGMENTS = ("affordable", "mid_market", "mid_luxury", "luxury", "ultra_luxury")

# Supply/demand balance. The labels are given by the domain; the cut-points between them are this
# library's own choice (no published ones exist): a ratio of 1.81 and of 2.8 must read "Slightly
# Oversupplied", and saturation alerts start above 3.
BALANCE_LABELS = (
    "Severely Undersupplied",
    "Undersupplied",
    "Balanced",
    "Slightly Oversupplied",
    "Oversupplied",
    "Severely Oversupplied",
)
BALANCE_EDGES = (0.3, 0.7, 1.3, 3.0, 10.0)
NO_BALANCE = "Insufficient Data"


@dataclass(frozen=True)
class MarketConfig:
    """Thresholds one deployment of the library works with."""

    luxury_price: float = 5_000_000
    ultra_luxury_price: float = 10_000_000
    segment_edges: tuple[float, ...] = (1_000_000, 3_000_000, 5_000_000, 10_000_000)
    band_edges: tuple[float, ...] = (2_000_000, 5_000_000, 10_000_000)
    report_band_edges: tuple[float, ...] = (1_000_000, 2_000_000, 5_000_000, 10_000_000, 20_000_000)
    minimum_quality: float = 0.7
    price_rules: dict[str, PriceRule] = field(default_factory=lambda: dict(PRICE_RULES))
    minimum_prices: dict[str, float] = field(default_factory=lambda: dict(MINIMUM_PRICES))
    other_minimum_price: float = 10_000
    years: tuple[int, int] = (2002, 2025)
    metrics_from_year: int = 2020
