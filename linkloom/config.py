"""Configuration of a match run: defaults, merge and validation."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from .functions.similarity import Metrics, Rules

STRATEGIES = ("GREEDY_1_1", "TOP_1", "ALL_CANDIDATES")
MATCH_TYPES = ("EXACT", "FUZZY", "NUMERIC_DELTA")
CALENDARS = ("AUTO", "CE", "BE")


@dataclass(frozen=True)
class SecondaryField:
    """A further pair of columns to compare; a weight of 0 or less counts as 0.10."""

    name: str
    field_src: str
    field_dest: str
    match_type: str = "EXACT"
    weight: float = 0.10
    is_mandatory: bool = False


@dataclass(frozen=True)
class ColumnMapping:
    """Which columns of the two inputs are names, identifiers and dates."""

    source_names: tuple[str, ...] = ("customer_name", "name", "raw_name", "company_name")
    dest_names: tuple[str, ...] = ("customer_name", "name", "raw_name", "company_name")
    source_ref: str = "reference_id"
    dest_ref: str = "customer_id"
    source_date: str = "transaction_date"
    dest_date: str = "transaction_date"
    source_type: str = "transaction_type"
    source_calendar: str = "AUTO"
    dest_calendar: str = "AUTO"
    secondary: tuple[SecondaryField, ...] = ()


@dataclass(frozen=True)
class MatchConfig:
    """All knobs of a run. 0 or an empty text for margin, floor, strategy and alternatives means the default."""

    auto_match_threshold: float = 0.90
    review_threshold: float = 0.70
    date_tolerance_days: int = 30
    name_weight: float = 0.85
    date_weight: float = 0.15
    metrics: Metrics = Metrics()
    mapping: ColumnMapping = field(default_factory=ColumnMapping)
    max_candidates_per_src: int = 50
    margin_threshold: float = 0.05
    exact_match_floor: float = 0.99
    assignment_strategy: str = "GREEDY_1_1"
    emit_unmatched: bool = True
    max_alternatives_per_source: int = 5
    calibration_enabled: bool = False
    cross_script_auto_threshold: float = 0.84
    no_distinctive_overlap_cap: float = 0.85
    distinctive_overlap_min_weight: float = 0.30
    max_posting_ratio: float = 0.05
    max_postings: int = 2000

    def __post_init__(self) -> None:
        for name in ("max_candidates_per_src", "margin_threshold", "exact_match_floor", "assignment_strategy", "max_alternatives_per_source"):
            value = getattr(self, name)
            if not value or name == "max_candidates_per_src" and value < 0:
                object.__setattr__(self, name, type(self).__dataclass_fields__[name].default)

    def rules(self) -> Rules:
        """What the pair score needs of it."""
        return Rules(self.metrics, self.name_weight, self.date_weight, self.date_tolerance_days, self.no_distinctive_overlap_cap, self.distinctive_overlap_min_weight)

    def merge(self, changes: dict) -> MatchConfig:
        """A configuration with the changes, which are checked; unknown keys and values out of range raise an error."""
        known = {f.name for f in fields(self)}
        if odd := sorted(set(changes) - known):
            raise ValueError(f"unknown configuration keys: {', '.join(odd)}")
        changes = dict(changes)
        if isinstance(changes.get("metrics"), dict):
            changes["metrics"] = self.metrics._replace(**changes["metrics"])
        return replace(self, **changes).checked()

    def checked(self) -> MatchConfig:
        shares = ("auto_match_threshold", "review_threshold", "name_weight", "date_weight", "margin_threshold", "exact_match_floor", "cross_script_auto_threshold", "no_distinctive_overlap_cap", "distinctive_overlap_min_weight")
        for name in shares:
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if self.review_threshold > self.auto_match_threshold:
            raise ValueError("review_threshold is above auto_match_threshold")
        if self.name_weight + self.date_weight > 1 + 1e-9:
            raise ValueError("name_weight and date_weight sum to more than 1")
        if self.date_tolerance_days < 0:
            raise ValueError("date_tolerance_days must not be negative")
        if self.assignment_strategy not in STRATEGIES:
            raise ValueError(f"assignment_strategy must be one of {', '.join(STRATEGIES)}")
        return self
