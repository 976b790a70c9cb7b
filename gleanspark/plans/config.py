"""Configuration of an analysis: defaults, precedence, limits, and the key of its stored result."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Setting:
    """How a value that someone gave is read: a number in a range, whole or not, from a number or from digits; else nothing."""

    low: float
    high: float = math.inf
    whole: bool = True
    digits: bool = True
    default: Any = None
    #: Numbers over ``high`` count as ``high`` instead of being refused.
    clipped: bool = False

    def read(self, given: Any) -> Any:
        if isinstance(given, str) and self.digits and given.strip().isdigit():
            given = int(given)
        if type(given) not in (int, float) or not math.isfinite(given):
            return None
        number = int(given) if self.whole else given
        if number > self.high and self.clipped:
            return self.high
        return number if self.low <= number <= self.high else None


#: Ranges and defaults.  The tier is read by ``resolve_tier``; the number of topics counts in manual mode.
SETTINGS = {
    "tier": Setting(0, digits=False, default=0),
    "min_review_words": Setting(1, default=5),
    "merge_threshold": Setting(0, 1, whole=False, digits=False, default=0.80),
    "maxReviews": Setting(1),
    "n_topics": Setting(2, 20, clipped=True),
}
TIERS_AS_TEXT = {"0": 0, "1": 1}


def resolve_tier(requested: Any, settings: dict | None = None, detected: int = 0) -> int:
    """The first usable of: the tier asked for, the saved one (which may be what was detected), the default."""
    saved = (settings or {}).get("tier")
    sources = [requested, detected if saved == "auto" else saved, SETTINGS["tier"].default]
    return next(t for s in sources if (t := TIERS_AS_TEXT.get(s) if isinstance(s, str) else SETTINGS["tier"].read(s)) is not None)


#: How the number of topics is found: the first rule that holds for (configuration, tier) decides.
MODES: list[tuple[Callable[[dict, int], bool], str]] = [
    (lambda c, tier: tier >= 1, "auto"),
    (lambda c, tier: c.get("topicCountMode") == "auto", "auto"),
    (lambda c, tier: c.get("topicCountMode") == "manual", "manual"),
    (lambda c, tier: SETTINGS["n_topics"].read(c.get("n_topics")) is not None, "manual"),
]


def resolve_mode(config: dict, tier: int) -> str:
    return next((mode for holds, mode in MODES if holds(config, tier)), "auto")


def asked_filter(config: dict) -> dict:
    """The parts of the filter that say something."""
    return {k: v for k, v in (config.get("filter") or {}).items() if v is not None and v != ""}


def resolve_config(config: dict, settings: dict | None = None, detected: int = 0) -> dict:
    """All settings with usable values, whatever was given; what has neither value nor default is left out."""
    tier = resolve_tier(config.get("tier"), settings, detected)
    decided = {"tier": tier, "topicCountMode": resolve_mode(config, tier), "filter": asked_filter(config) or None}
    for name, setting in SETTINGS.items():
        if name not in decided:
            value = setting.read(config.get(name))
            decided[name] = setting.default if value is None else value
    if decided["topicCountMode"] == "auto":
        decided["n_topics"] = None
    others = {k: v for k, v in config.items() if k not in decided}
    return others | {k: v for k, v in decided.items() if v is not None}


def _plain(value: Any) -> Any:
    """Whole floats as whole numbers, as JSON writers without a float type have them."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value


def config_hash(config: dict) -> str:
    """MD5 over JSON with sorted keys; the number of topics counts only where it is set by hand."""
    parts = {k: config.get(k) for k in ("tier", "topicCountMode", "maxReviews", "min_review_words", "merge_threshold")}
    parts["filter"] = asked_filter(config)
    if config.get("topicCountMode") == "manual" and isinstance(config.get("n_topics"), int):
        parts["n_topics"] = config["n_topics"]
    return hashlib.md5(json.dumps(_plain(parts), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def load_settings(path: str, default: dict | None = None) -> dict:
    """Settings from a JSON file, or the default where there is none that can be read."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return dict(default or {})
    return found if isinstance(found, dict) else dict(default or {})


def save_settings(path: str, settings: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings, f, indent=2, ensure_ascii=False)
