"""Risk configuration: defaults, and merging of settings given as JSON."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# The default weights, thresholds and windows.
WEIGHTS = {
    "validPhone": 9.0, "partialPhone": 2.5, "mixedForm": 3.0, "noiseDigitsRemoved": 0.45, "weirdnessFlags": 0.9, "intentHits": 1.1, "handle": 2.6, "upi": 8.5,
    "riskyUrl": 3.2, "digitPressure": 0.35, "zeroWidthCount": 0.8, "offPlatformFloor": 3.6, "address": 4.2, "email": 8.5, "confusablesFolded": 0.4,
}
SAFETY_WEIGHTS = {"hostilitySev0": 0.6, "hostilitySev1": 3.5, "hostilitySev2": 4.0, "hostilitySev3": 9.0, "extortion": 8.0, "extortionImplied": 4.5, "scamlink": 7.0}
MODIFIERS = {"stage": {"pre_booking": 1.0, "post_booking": 0.35}, "role": {"guest": 1.0, "host": 1.25}}
BANDS = {"low": 3.0, "high": 8.0}
SESSION = {"fragmentBufferSize": 10, "lastMessagesSize": 5, "fragmentWindowMs": 1_800_000, "digitPressureHalfLifeMs": 3_600_000, "windowedRescanMessages": 3}
POLICY = {"blockCooldownThreshold": 3, "blockCooldownWindowMs": 600_000}
FAIL_MODE = {"pre_booking": "closed", "post_booking": "open"}
CLASSIFIER = {"allow": 0.3, "block": 0.85}
COSTS = {"inPerMillion": 0.05, "outPerMillion": 0.08, "inTokens": 320, "outTokens": 60}


@dataclass
class RiskConfig:
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    safetyWeights: dict = field(default_factory=lambda: dict(SAFETY_WEIGHTS))
    modifiers: dict = field(default_factory=lambda: copy.deepcopy(MODIFIERS))
    bands: dict = field(default_factory=lambda: dict(BANDS))
    session: dict = field(default_factory=lambda: dict(SESSION))
    policy: dict = field(default_factory=lambda: dict(POLICY))
    failMode: dict = field(default_factory=lambda: dict(FAIL_MODE))
    #: First-party domains, which are never reported.
    allowlist: tuple[str, ...] = ()
    #: Reproduce quirks of the original tokenizer instead of the intended behaviour.
    compat: bool = False


def load(text: str | None = None, env: Mapping[str, str] | None = None) -> RiskConfig:
    """Defaults, overlaid section by section; keys that begin with $ are comments. FAIL_MODE_PRE_BOOKING in env wins."""
    config = RiskConfig()
    for section, values in (json.loads(text) if text else {}).items():
        if section.startswith("$") or not hasattr(config, section):
            continue
        current = getattr(config, section)
        if isinstance(current, dict):
            current.update({k: v for k, v in values.items() if not k.startswith("$")})
        else:
            setattr(config, section, tuple(values) if isinstance(values, list) else values)
    mode = (os.environ if env is None else env).get("FAIL_MODE_PRE_BOOKING")
    if mode in ("open", "closed"):
        config.failMode["pre_booking"] = mode
    return config


def parse_env(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments and anything else are skipped, matching quotes are taken off."""
    out = {}
    for line in text.splitlines():
        key, sep, value = line.strip().partition("=")
        key, value = key.strip(), value.strip()
        if not sep or not key.isidentifier():
            continue
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[key] = value
    return out
