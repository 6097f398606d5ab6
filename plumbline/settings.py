"""Rules, thresholds and feature lists.

Every operator takes these as parameters; the defaults below are the ones a
user gets without any configuration.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any


@dataclass(frozen=True)
class Rule:
    """What one feature may contain. Bounds are inclusive; None means open."""

    feature: str
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] = ()


# Default feature lists and validation rules.
NUMERIC_FEATURES = ("age", "purchase_amount", "session_duration", "page_views")
CATEGORICAL_FEATURES = ("device_type",)
DEFAULT_RULES = (
    Rule("user_id"),
    Rule("age", low=0, high=120),
    Rule("purchase_amount", low=0.0),
    Rule("session_duration", low=0),
    Rule("page_views", low=0),
    Rule("device_type", allowed=("mobile", "desktop", "tablet")),
    Rule("timestamp", low=0),
)


# Default thresholds, sizes and seeds.
@dataclass(frozen=True)
class PhaseSettings:
    warmup_windows: int = 5
    calibrate_windows: int = 5
    calibrate_percentile: float = 99.0
    count_incomplete: bool = False
    # Calibrate windows of a lower validity rate do not count and give no score to the threshold.
    validity_floor: float | None = None


@dataclass(frozen=True)
class MmdSettings:
    components: int = 200
    sigma: float | None = None
    #: None: the bandwidth takes every warm-up row; a number: only that many, with the lowest key hash.
    sample_size: int | None = None
    seed: int = 42


@dataclass(frozen=True)
class DriftSettings:
    min_rows: int = 10
    ks_significance: float = 0.05
    chi2_significance: float = 0.05
    psi_bins: int = 10
    psi_epsilon: float = 1e-4
    psi_warning: float = 0.1
    psi_alert: float = 0.2
    null_rate_delta: float = 0.05


@dataclass(frozen=True)
class ModelSettings:
    warmup_windows: int = 3
    window_batches: int = 10
    rows_per_batch: int = 100
    score_significance: float = 0.05
    label_z: float = 2.5
    accuracy_drop: float = 0.05
    min_rows: int = 10
    min_class_rows: int = 5

    @property
    def window_rows(self) -> int:
        return self.window_batches * self.rows_per_batch


@dataclass(frozen=True)
class AlertSettings:
    enabled: bool = True
    required_consecutive: int = 2
    cooldown_seconds: float = 120.0
    reset_on_good: bool = True
    kept_alerts: int = 50
    kept_metrics: int = 200


@dataclass(frozen=True)
class Settings:
    rules: tuple[Rule, ...] = DEFAULT_RULES
    numeric: tuple[str, ...] = NUMERIC_FEATURES
    categorical: tuple[str, ...] = CATEGORICAL_FEATURES
    phases: PhaseSettings = field(default_factory=PhaseSettings)
    mmd: MmdSettings = field(default_factory=MmdSettings)
    drift: DriftSettings = field(default_factory=DriftSettings)
    model: ModelSettings = field(default_factory=ModelSettings)
    alerts: AlertSettings = field(default_factory=AlertSettings)
    # The per-feature reference is the first calibrate window alone instead of all warm-up windows.
    single_window_reference: bool = False


def rules_from_mapping(features: Mapping[str, Mapping[str, Any]]) -> tuple[Rule, ...]:
    """Rules from the ``{feature: {nullable, min, max, allowed_values}}`` form."""
    return tuple(
        Rule(
            name,
            nullable=bool(spec.get("nullable", False)),
            low=spec.get("min"),
            high=spec.get("max"),
            allowed=tuple(spec.get("allowed_values") or ()),
        )
        for name, spec in features.items()
    )


def _overlay(defaults, section: Mapping[str, Any], names: Mapping[str, str]):
    given = {ours: section[theirs] for theirs, ours in names.items() if theirs in section}
    return replace(defaults, **given)


def settings_from_mapping(config: Mapping[str, Any]) -> Settings:
    """Settings from a nested configuration mapping (as read from YAML)."""
    base = Settings()
    drift = config.get("drift", {})
    rules = config.get("validation", {}).get("features")
    drift_sections = (
        ("ks", {"significance_level": "ks_significance"}),
        ("chi_squared", {"significance_level": "chi2_significance"}),
        ("psi", {"n_bins": "psi_bins", "warning_threshold": "psi_warning", "alert_threshold": "psi_alert"}),
        ("null_rate", {"drift_threshold": "null_rate_delta"}),
    )
    thresholds = base.drift
    for section, names in drift_sections:
        thresholds = _overlay(thresholds, drift.get(section, {}), names)
    alerts = config.get("alerts", {})
    return Settings(
        rules=rules_from_mapping(rules) if rules else base.rules,
        numeric=tuple(drift.get("numeric_features", base.numeric)),
        categorical=tuple(drift.get("categorical_features", base.categorical)),
        phases=_overlay(
            base.phases,
            config.get("warmup", {}),
            {
                "window_batches": "warmup_windows",
                "calibration_batches": "calibrate_windows",
                "calibration_percentile": "calibrate_percentile",
                "validity_floor": "validity_floor",
            },
        ),
        mmd=_overlay(base.mmd, drift.get("rff_mmd", {}), {"n_components": "components", "sigma": "sigma"}),
        drift=thresholds,
        single_window_reference=bool(drift.get("single_window_reference", base.single_window_reference)),
        model=_overlay(
            base.model,
            config.get("model_monitoring", {}),
            {
                "performance_window_batches": "window_batches",
                "prediction_drift_threshold": "score_significance",
            },
        ),
        alerts=_overlay(
            _overlay(base.alerts, alerts, {"enabled": "enabled"}),
            alerts.get("hysteresis", {}),
            {"required_consecutive": "required_consecutive", "cooldown_seconds": "cooldown_seconds"},
        ),
    )


def settings_from_yaml(path: str) -> Settings:
    """Settings from a YAML file; needs PyYAML, which is optional."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML settings needs the PyYAML package") from missing
    with open(path, encoding="utf-8") as handle:
        return settings_from_mapping(yaml.safe_load(handle) or {})
