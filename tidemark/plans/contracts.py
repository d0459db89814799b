"""Declarations that gate a dataset: feature contracts, the feature registry, adjustment status, data quality.

Verdicts rank OK < SUSPECT < REJECTED; the worst reason decides, and every reason is kept.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, fields
from typing import Any

from ..schema import PanelError
from .fingerprints import short_id

OK, SUSPECT, REJECTED = "OK", "SUSPECT", "REJECTED"
VERDICTS = (OK, SUSPECT, REJECTED)

# Vocabularies of declarations.
AVAILABILITY = ("point_in_time", "lagged")
ADJUSTMENT = ("not_applicable", "pit_safe", "back_adjusted", "unknown")
CUTOFF_RULES = ("prior_bar", "same_bar", "asof_available_at")
NULL_POLICIES = ("preserve",)
CLEAN_STATUSES = ("full", "complete", "none_needed", "not_applicable", "not_required")
SURVIVORSHIP = ("unknown", "partial", "controlled")
CORPORATE_ACTIONS = ("none", "partial", "clean")
PIT_STATUS = ("none", "best_effort", "guaranteed")
DATA_FEEDS = ("iex", "sip-historical", "sip-realtime")
# Name tokens that a mechanical feature must not carry (contract), or must not carry before alpha research (registry).
CONTRACT_TOKENS = ("alpha", "signal", "prediction", "score", "weight", "target", "order", "trade", "position", "rank", "momentum", "rsi", "macd")
REGISTRY_TOKENS = ("alpha", "signal", "edge", "rsi", "macd", "momentum", "rank", "zscore", "factor", "score", "forecast", "prediction", "weight")
PHASE, PHASES = "4D", ("4C", "4D")


class ContractError(PanelError):
    """A declaration is malformed or unsafe."""


def token_hits(name: str, tokens: Iterable[str]) -> list[str]:
    parts = set(name.lower().split("_")) | {name.lower()}
    return sorted(parts & set(tokens))


def worst(severities: Iterable[str]) -> str:
    return max(severities, key=VERDICTS.index, default=OK)


def reason(code: str, severity: str, message: str) -> dict[str, str]:
    return {"code": code, "severity": severity, "message": message}


def _one_of(value: Any, allowed: Sequence[Any], what: str) -> None:
    if value not in allowed:
        raise ContractError(f"{what} must be one of {list(allowed)}, not {value!r}")


def _text(value: Any, what: str) -> None:
    if not isinstance(value, str) or not value.strip():
        raise ContractError(f"{what} must be a non-empty string")


def _whole(value: Any, least: int, what: str) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ContractError(f"{what} must be an integer of at least {least}")


def _build(kind: type, value: Any):
    """An instance, or one made from a mapping; for contracts also from a bare name."""
    if isinstance(value, kind):
        return value
    if isinstance(value, str) and kind is FeatureSpec:
        return kind(value)
    if not isinstance(value, Mapping):
        raise ContractError(f"cannot make a {kind.__name__} of {type(value).__name__}")
    unknown = set(value) - {f.name for f in fields(kind)}
    if unknown:
        raise ContractError(f"unknown keys {sorted(unknown)}")
    return kind(**value)


@dataclass(frozen=True)
class FeatureSpec:
    """How one feature column may be used."""

    name: str
    price_level: bool = False
    adjustment: str = "not_applicable"
    availability: str = "point_in_time"
    lag_bars: int = 0
    required: bool = True
    description: str = ""

    def __post_init__(self) -> None:
        _text(self.name, "feature name")
        if self.name != self.name.strip():
            raise ContractError(f"feature name {self.name!r} has white space around it")
        _one_of(self.availability, AVAILABILITY, f"{self.name}: availability")
        _one_of(self.adjustment, ADJUSTMENT, f"{self.name}: adjustment")
        _whole(self.lag_bars, 1 if self.availability == "lagged" else 0, f"{self.name}: lag_bars")
        if self.price_level and self.adjustment == "not_applicable":
            raise ContractError(f"{self.name}: a price level needs an adjustment policy")
        if not self.price_level and self.adjustment in ("pit_safe", "back_adjusted"):
            raise ContractError(f"{self.name}: only price levels are adjusted")

    @property
    def safety(self) -> str:
        if not self.price_level:
            return "safe"
        return {"back_adjusted": "rejected", "unknown": "suspect"}.get(self.adjustment, "safe")


def normalize_specs(specs: Sequence[Any]) -> tuple[FeatureSpec, ...]:
    found = tuple(_build(FeatureSpec, s) for s in specs or ())
    if not found:
        raise ContractError("at least one feature spec is needed")
    if len({s.name for s in found}) < len(found):
        raise ContractError("feature specs repeat a name")
    for s in found:
        if hits := token_hits(s.name, CONTRACT_TOKENS):
            raise ContractError(f"{s.name} reads like a model output: {hits}")
    return found


def classify(specs: Sequence[FeatureSpec]) -> dict[str, list[str]]:
    return {k: sorted(s.name for s in specs if s.safety == k) for k in ("safe", "suspect", "rejected")}


def assert_acceptable(specs: Sequence[FeatureSpec]) -> list[str]:
    """Names of suspect features; rejected ones are an error."""
    groups = classify(specs)
    if groups["rejected"]:
        raise ContractError(f"back-adjusted price levels are not point-in-time safe: {groups['rejected']}")
    return groups["suspect"]


def availability_table(specs: Sequence[FeatureSpec]) -> list[dict]:
    keys = ("name", "price_level", "adjustment", "availability", "lag_bars", "required")
    return sorted(({k: getattr(s, k) for k in keys} | {"safety_class": s.safety} for s in specs), key=lambda r: r["name"])


@dataclass(frozen=True)
class RegistryConfig:
    unknown_adjustment: str = SUSPECT
    unsafe_price_level: str = SUSPECT
    phase: str = PHASE

    def __post_init__(self) -> None:
        for v in (self.unknown_adjustment, self.unsafe_price_level):
            _one_of(v, (SUSPECT, REJECTED), "configured verdict")
        _text(self.phase, "phase")


@dataclass(frozen=True)
class FeatureDefinition:
    """Registered metadata of one feature; nothing is computed from it."""

    name: str
    family: str
    description: str
    dtype: str
    source: str
    availability: str = "point_in_time"
    feature_cutoff_rule: str = "prior_bar"
    requires_adjusted_price: bool = False
    adjustment_safety: str = "not_applicable"
    pit_safe: bool = False
    uses_future_data: bool = False
    null_policy: str = "preserve"
    is_alpha_like: bool = False
    allowed_in_phase: tuple[str, ...] = PHASES
    version: int = 1

    def __post_init__(self) -> None:
        object.__setattr__(self, "allowed_in_phase", tuple(self.allowed_in_phase))
        for k in ("name", "family", "description", "dtype", "source"):
            _text(getattr(self, k), k)
        if self.name != self.name.strip():
            raise ContractError(f"feature name {self.name!r} has white space around it")
        for k, allowed in (("availability", AVAILABILITY), ("feature_cutoff_rule", CUTOFF_RULES), ("adjustment_safety", ADJUSTMENT), ("null_policy", NULL_POLICIES)):
            _one_of(getattr(self, k), allowed, f"{self.name}: {k}")
        for k in ("requires_adjusted_price", "pit_safe", "uses_future_data", "is_alpha_like"):
            _one_of(getattr(self, k), (True, False), f"{self.name}: {k}")
        _whole(self.version, 1, f"{self.name}: version")
        if not self.allowed_in_phase:
            raise ContractError(f"{self.name}: no phase is allowed")
        if self.availability == "lagged" and self.feature_cutoff_rule == "same_bar":
            raise ContractError(f"{self.name}: a lagged feature cannot cut off at the same bar")

    def to_spec(self) -> FeatureSpec:
        level = self.requires_adjusted_price
        return FeatureSpec(self.name, level, self.adjustment_safety if level else "not_applicable", self.availability, int(self.availability == "lagged"))

    def to_dict(self) -> dict:
        return asdict(self) | {"allowed_in_phase": sorted(self.allowed_in_phase)}


def judge(definition: Any, config: RegistryConfig | None = None) -> dict:
    """name, verdict and all reasons of one definition."""
    d, config = _build(FeatureDefinition, definition), config or RegistryConfig()
    level = d.requires_adjusted_price
    rules = [
        ("uses_future_data", REJECTED, d.uses_future_data, "declares future data"),
        ("alpha_like_feature", REJECTED, d.is_alpha_like, "is declared alpha-like"),
        ("phase_not_allowed", REJECTED, config.phase not in d.allowed_in_phase, f"is not allowed in phase {config.phase}"),
        ("alpha_like_name", REJECTED, bool(token_hits(d.name, REGISTRY_TOKENS)), f"has alpha-like tokens {token_hits(d.name, REGISTRY_TOKENS)}"),
        ("back_adjusted_price_level", REJECTED, level and d.adjustment_safety == "back_adjusted", "uses back-adjusted prices"),
        ("ambiguous_adjustment", config.unknown_adjustment, d.adjustment_safety == "unknown", "has unknown adjustment safety"),
        ("undeclared_price_level_safety", config.unsafe_price_level, level and d.adjustment_safety not in ("back_adjusted", "unknown") and not (d.adjustment_safety == "pit_safe" and d.pit_safe), "is a price level without a point-in-time declaration"),
        ("not_declared_pit_safe", SUSPECT, not d.pit_safe, "is not declared point-in-time safe"),
    ]
    reasons = [reason(code, severity, f"{d.name} {message}") for code, severity, broken, message in rules if broken]
    return {"name": d.name, "verdict": worst(r["severity"] for r in reasons), "reasons": reasons}


class FeatureRegistry:
    """Definitions by name, without repeats."""

    def __init__(self, definitions: Sequence[Any] = ()):
        found = [_build(FeatureDefinition, d) for d in definitions]
        self._by_name = {d.name: d for d in found}
        if len(self._by_name) < len(found):
            raise ContractError("definitions repeat a name")

    def names(self) -> list[str]:
        return sorted(self._by_name)

    def __contains__(self, name: str) -> bool:
        return name in self._by_name

    def __getitem__(self, name: str) -> FeatureDefinition:
        if name not in self._by_name:
            raise ContractError(f"{name} is not registered")
        return self._by_name[name]

    def list(self) -> list[dict]:
        return [self[n].to_dict() for n in self.names()]


def definitions_id(definitions: Sequence[Any]) -> str:
    """fs-…: equal for any order, different for any changed value or version."""
    found = [_build(FeatureDefinition, d) for d in definitions]
    if len({d.name for d in found}) < len(found):
        raise ContractError("definitions repeat a name")
    return short_id("fs", sorted((d.to_dict() for d in found), key=lambda x: x["name"]))


def judge_set(definitions: Sequence[Any], config: RegistryConfig | None = None) -> dict:
    """feature_set_id, verdict, verdicts of all, and the contract's own view when nothing is rejected yet."""
    found = [_build(FeatureDefinition, d) for d in definitions]
    if not found:
        raise ContractError("a feature set needs a definition")
    each = [judge(d, config) for d in found]
    reasons = [r for v in each for r in v["reasons"]]
    rejected = sorted(v["name"] for v in each if v["verdict"] == REJECTED)
    if not rejected:
        try:
            assert_acceptable(normalize_specs([d.to_spec() for d in found]))
        except ContractError as e:
            reasons.append(reason("data_contract_rejection", REJECTED, str(e)))
            rejected = sorted(d.name for d in found)
    return {
        "feature_set_id": definitions_id(found),
        "verdict": worst(r["severity"] for r in reasons),
        "per_feature": each,
        "rejected": rejected,
        "suspect": sorted(v["name"] for v in each if v["verdict"] == SUSPECT),
        "reasons": reasons,
    }


def export_table(definitions: Sequence[Any], config: RegistryConfig | None = None) -> list[dict]:
    keys = ("name", "family", "version", "availability", "feature_cutoff_rule", "requires_adjusted_price", "adjustment_safety", "pit_safe", "uses_future_data", "is_alpha_like", "null_policy")
    found = [_build(FeatureDefinition, d) for d in definitions]
    return sorted(({k: getattr(d, k) for k in keys} | {"verdict": judge(d, config)["verdict"]} for d in found), key=lambda r: r["name"])


def declared_adjustment(declaration: Mapping | None) -> tuple[str | None, str | None]:
    """(corporate_actions_status, adjustment_status) word for word, also from under data_declaration; nothing is inferred."""
    if declaration is None:
        return None, None
    if not isinstance(declaration, Mapping):
        raise ContractError("a data declaration is a mapping")
    inner = declaration.get("data_declaration")
    inner = inner if isinstance(inner, Mapping) else declaration
    values = inner.get("corporate_actions_status"), inner.get("adjustment_status", inner.get("price_adjustment"))
    return tuple(None if v is None else str(v) for v in values)


def adjustment_is_ambiguous(*statuses: str | None) -> bool:
    """Absent, or any status that is not plainly clean."""
    given = [s.strip().lower() for s in statuses if s is not None]
    return not given or any(s not in CLEAN_STATUSES for s in given)


@dataclass(frozen=True)
class DataDeclaration:
    """Quality of a dataset as declared; tier 2 needs controlled survivorship and guaranteed point-in-time data."""

    data_declaration_id: str
    tier: int
    universe_source: str
    universe_id: str
    survivorship_bias_status: str
    corporate_actions_status: str
    pit_status: str
    data_feed: str
    date_range: tuple[dt.date, dt.date]
    known_gaps: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        _one_of(self.tier, (0, 1, 2), "tier")
        for k, allowed in (("survivorship_bias_status", SURVIVORSHIP), ("corporate_actions_status", CORPORATE_ACTIONS), ("pit_status", PIT_STATUS), ("data_feed", DATA_FEEDS)):
            _one_of(getattr(self, k), allowed, k)
        if self.date_range[1] < self.date_range[0]:
            raise ContractError("date_range ends before it starts")
        if self.tier == 2 and (self.survivorship_bias_status != "controlled" or self.pit_status != "guaranteed"):
            raise ContractError("tier 2 needs controlled survivorship and guaranteed point-in-time data")

    @classmethod
    def load(cls, value: Mapping) -> DataDeclaration:
        return _build(cls, dict(value.get("data_declaration", value)))

    def to_dict(self) -> dict:
        return asdict(self) | {"date_range": [d.isoformat() for d in self.date_range], "known_gaps": list(self.known_gaps)}

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump({"data_declaration": self.to_dict()}, sort_keys=False, allow_unicode=True)
