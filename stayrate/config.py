"""Column names and parameters of the churn question, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Layout:
    """Names of the columns that the operators work on.

    The defaults are fixed values: they have to equal the names in the CSV
    files and feature tables that users already have.
    """

    id: str = "id"
    label: str = "churn"
    price_date: str = "price_date"
    price_prefix: str = "price_"
    periods: tuple[str, ...] = ("off_peak", "peak", "mid_peak")
    kinds: tuple[str, ...] = ("var", "fix")
    period_pairs: tuple[tuple[str, str], ...] = (
        ("off_peak", "peak"),
        ("peak", "mid_peak"),
        ("off_peak", "mid_peak"),
    )
    first_last_features: dict[str, str] = field(
        default_factory=lambda: {
            "price_off_peak_var": "offpeak_diff_dec_january_energy",
            "price_off_peak_fix": "offpeak_diff_dec_january_power",
        }
    )
    date_columns: tuple[str, ...] = (
        "date_activ",
        "date_end",
        "date_modif_prod",
        "date_renewal",
    )
    tenure: str = "tenure"
    # Feature name -> (date column, sign): months before the reference date
    # count up, months to the contract end count down.
    month_features: dict[str, tuple[str, int]] = field(
        default_factory=lambda: {
            "months_activ": ("date_activ", 1),
            "months_to_end": ("date_end", -1),
            "months_modif_prod": ("date_modif_prod", 1),
            "months_renewal": ("date_renewal", 1),
        }
    )
    flag_columns: tuple[str, ...] = ("has_gas",)
    category_columns: tuple[str, ...] = ("channel_sales", "origin_up")
    log_columns: tuple[str, ...] = (
        "cons_12m",
        "cons_gas_12m",
        "cons_last_month",
        "forecast_cons_12m",
        "forecast_cons_year",
        "forecast_discount_energy",
        "forecast_meter_rent_12m",
        "forecast_price_energy_off_peak",
        "forecast_price_energy_peak",
        "forecast_price_pow_off_peak",
    )
    redundant_columns: tuple[str, ...] = ("num_years_antig", "forecast_cons_year")
    histogram_columns: tuple[str, ...] = (
        "cons_12m",
        "cons_last_month",
        "net_margin",
        "pow_max",
    )
    mean_columns: tuple[str, ...] = (
        "cons_12m",
        "cons_last_month",
        "net_margin",
        "pow_max",
        "nb_prod_act",
        "num_years_antig",
    )
    density_columns: tuple[str, ...] = (
        "cons_12m",
        "cons_last_month",
        "forecast_price_energy_peak",
    )
    # Years with the company, and the columns by which customers are cut into thirds.
    seniority: str = "num_years_antig"
    segment_columns: dict[str, str] = field(
        default_factory=lambda: {"size": "pow_max", "usage": "cons_12m", "age": "num_years_antig"}
    )
    index_artefact: str = "Unnamed: 0"

    def price_column(self, period: str, kind: str) -> str:
        return f"{self.price_prefix}{period}_{kind}"

    @property
    def price_columns(self) -> list[str]:
        return [self.price_column(p, k) for k in self.kinds for p in self.periods]

    @property
    def spreads(self) -> dict[str, tuple[str, str]]:
        """Spread name -> the two price columns whose difference it is."""
        return {
            f"{a}_{b}_{k}": (self.price_column(a, k), self.price_column(b, k))
            for k in self.kinds
            for a, b in self.period_pairs
        }


@dataclass(frozen=True)
class Settings:
    """Parameters of the feature and model jobs; the defaults are fixed values."""

    reference_date: date = date(2016, 1, 1)
    min_category_count: int = 100
    # The feature table has a column per frequent category up to this number (or as
    # ``wide_categories`` says); beyond it the columns stay text, and models use vectors.
    max_categories: int = 1000
    wide_categories: bool | None = None
    histogram_bins: int = 50
    log_bins: int = 30
    # Tenures with the highest churn rate that the feature job lists.
    top_tenures: int = 5
    test_share: float = 0.25
    folds: int = 5
    seed: int = 42
    trees: int = 1000
    # The original forest grows without a depth limit; 30 is Spark's maximum.
    max_depth: int = 30
    # Smallest share of the training weight in a node; bounds the leaves at any number of rows.
    least_node_weight: float = 1e-5
    thresholds: tuple[float, ...] = (0.2, 0.3, 0.4, 0.5, 0.6)
    price_feature_pattern: str = "price|peak"
    top_features: int = 20
    report_features: int = 5
    retention_rows: int = 100
    # Months up to the last price that count as recent.
    recent_months: int = 3
