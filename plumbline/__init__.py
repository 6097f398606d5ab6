"""Feature quality, drift and model monitoring as Spark DataFrame operators."""

from plumbline.settings import (  # noqa: F401
    AlertSettings,
    DriftSettings,
    MmdSettings,
    ModelSettings,
    PhaseSettings,
    Rule,
    Settings,
    settings_from_mapping,
    settings_from_yaml,
)
