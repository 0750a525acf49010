"""Detector parameters, configuration files and model tags.  All of this is small and lives on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class DetectorConfig:
    """Thresholds of detection and alerting; 0 switches the two single-file alerts off."""

    z_threshold: float = 5.0
    contamination: float = 0.05
    n_trees: int = 200
    max_samples: int = 256
    training_cap: int = 50_000
    seed: int = 42
    file_alert_n_channels: int = 1
    alert_consecutive_n: int = 1
    single_file_alert_n_channels: int = 0
    single_file_alert_max_z: float = 0.0
    use_trigger: bool = True
    use_lvds: bool = True
    use_trigger_config: bool = True
    use_daq_config: bool = True
    exclude_features: tuple[str, ...] = ()
    poll_interval: float = 5.0
    sample_fraction: float = 1.0
    test_seed: int = 42

    def __post_init__(self) -> None:
        if not 0 < self.contamination <= 0.5:
            raise ValueError("contamination must be in (0, 0.5]")
        if not 0 < self.sample_fraction <= 1:
            raise ValueError("sample_fraction must be in (0, 1]")
        if self.alert_consecutive_n < 1:
            raise ValueError("alert_consecutive_n must be at least 1")


#: What a production deployment sets on top of the defaults.
SHIPPED = {"z_threshold": 6.0, "contamination": 0.01, "alert_consecutive_n": 3, "single_file_alert_n_channels": 5, "single_file_alert_max_z": 15.0}


def parsed(text: str, is_json: bool):
    """The value of a JSON text, or of a YAML one where a YAML library is installed."""
    if is_json:
        return json.loads(text or "null")
    import yaml

    return yaml.safe_load(text)


def read_mapping(path: str | Path) -> dict:
    """A flat YAML or JSON file."""
    return parsed(Path(path).read_text(), str(path).endswith(".json")) or {}


def load_config(path: str | Path | None = None, **overrides) -> tuple[DetectorConfig, dict]:
    """(config, unknown keys): defaults, then the file's ``base`` (one level), then its own keys, then overrides."""
    values: dict = {}
    if path is not None:
        own = read_mapping(path)
        base = own.pop("base", None)
        if base:
            values |= {k: v for k, v in read_mapping(Path(path).parent / base).items() if k != "base"}
        values |= own
    values |= {k: v for k, v in overrides.items() if v is not None}
    known = {f.name for f in fields(DetectorConfig)}
    if "exclude_features" in values:
        values["exclude_features"] = tuple(values["exclude_features"] or ())
    return DetectorConfig(**{k: v for k, v in values.items() if k in known}), {k: v for k, v in values.items() if k not in known}


def disable(config: DetectorConfig, **off: bool) -> DetectorConfig:
    """A feature is used where the configuration says so and the command line does not switch it off."""
    return replace(config, **{k: getattr(config, k) and not v for k, v in off.items()})


def metadata(effective: DetectorConfig, configured: DetectorConfig, **more) -> dict:
    """The effective values, and those of them that differ from the configured ones."""
    now, was = asdict(effective), asdict(configured)
    return now | more | {"overrides": {k: v for k, v in now.items() if was[k] != v}}


def tag_of(base: str, config: DetectorConfig, quality: str | None = None) -> str:
    """A model tag with a suffix for each choice that differs from the usual."""
    return base + "".join(
        f"_{name}"
        for name, wanted in (
            (quality, quality is not None),
            ("noTrigger", not config.use_trigger),
            ("noLVDS", not config.use_lvds),
            ("ignoreTriggerConfig", not config.use_trigger_config),
            ("ignoreDAQConfig", not config.use_daq_config),
        )
        if wanted
    )


def check_arguments(modes: dict[str, object], fraction: float = 1.0) -> str:
    """The one mode that is given; several or none, and a fraction outside (0, 1], are errors."""
    given = [k for k, v in modes.items() if v not in (None, False, "")]
    if len(given) != 1:
        raise ValueError(f"exactly one of {', '.join(modes)} is needed, not {', '.join(given) or 'none'}")
    if not 0 < fraction <= 1:
        raise ValueError("a fraction must be in (0, 1]")
    return given[0]
