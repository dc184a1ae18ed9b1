"""Which features vary inside a group, and limits for loading."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from .errors import LimitExceeded, MalformedConfig

CONFIG_BYTES = 64 * 1024


@dataclass(frozen=True)
class LoadOptions:
    """Input caps; whatever is beyond one raises LimitExceeded.

    They also bound what scoring broadcasts: a model of max_nodes nodes takes
    about 60 bytes a node.
    """

    max_file_bytes: int = 1 << 30
    max_trees: int = 100_000
    max_nodes: int = 16_000_000
    max_depth: int = 4_096
    max_features: int = 1 << 20
    max_categories: int = 64_000_000
    max_config_bytes: int = CONFIG_BYTES


@dataclass(frozen=True)
class GroupingConfig:
    """Feature roles. Features outside varying_features are constant inside a group."""

    n_features: int
    varying_features: tuple[int, ...]
    mono_inc_features: tuple[int, ...] = ()
    mono_dec_features: tuple[int, ...] = ()
    max_group_width: int | None = None

    def __post_init__(self):
        def whole(x):
            return isinstance(x, int) and not isinstance(x, bool)

        if not whole(self.n_features) or self.n_features < 1:
            raise MalformedConfig(f"n_features={self.n_features!r}")
        if self.max_group_width is not None and (not whole(self.max_group_width) or self.max_group_width < 1):
            raise MalformedConfig(f"max_group_width={self.max_group_width!r}")
        for name in ("varying_features", "mono_inc_features", "mono_dec_features"):
            given = list(getattr(self, name))
            if not all(whole(f) and 0 <= f < self.n_features for f in given):
                raise MalformedConfig(f"{name} is out of range: {given}")
            if len(set(given)) != len(given):
                raise MalformedConfig(f"{name} repeats a feature: {given}")
            object.__setattr__(self, name, tuple(sorted(given)))
        up, down = set(self.mono_inc_features), set(self.mono_dec_features)
        if up & down:
            raise MalformedConfig(f"increasing and decreasing: {sorted(up & down)}")
        if loose := (up | down) - set(self.varying_features):
            raise MalformedConfig(f"monotone but not varying: {sorted(loose)}")

    @property
    def constant_features(self) -> tuple[int, ...]:
        varying = set(self.varying_features)
        return tuple(f for f in range(self.n_features) if f not in varying)

    @classmethod
    def from_json(cls, text: str | bytes, options: LoadOptions = LoadOptions()) -> "GroupingConfig":
        """From the JSON form; keys other than the five known ones are ignored."""
        raw = text.encode() if isinstance(text, str) else text
        if len(raw) > options.max_config_bytes:
            raise LimitExceeded(f"configuration of {len(raw)} bytes")
        try:
            found = json.loads(raw)
        except (ValueError, RecursionError) as e:
            raise MalformedConfig(str(e)) from e
        if not isinstance(found, dict) or "n_features" not in found or "varying_features" not in found:
            raise MalformedConfig("n_features and varying_features are required")
        known = {k: found[k] for k in cls.__dataclass_fields__ if found.get(k) is not None}
        for k, v in known.items():
            if k.endswith("_features") and k != "n_features":
                if not isinstance(v, list):
                    raise MalformedConfig(f"{k} is no list")
                known[k] = tuple(v)
        return cls(**known)

    def to_json(self) -> str:
        return json.dumps({k: getattr(self, k) for k in self.__dataclass_fields__})


@dataclass
class ConfigBuilder:
    """Collects roles step by step; build() validates them."""

    width: int | None = None
    widest: int | None = None
    varying_set: list[int] | None = None
    inc: list[int] = field(default_factory=list)
    dec: list[int] = field(default_factory=list)

    def n_features(self, n: int) -> "ConfigBuilder":
        self.width = n
        return self

    def max_group_width(self, n: int) -> "ConfigBuilder":
        self.widest = n
        return self

    def varying(self, *features: int) -> "ConfigBuilder":
        self.varying_set = [*(self.varying_set or []), *features]
        return self

    def increasing(self, *features: int) -> "ConfigBuilder":
        self.inc += features
        return self

    def decreasing(self, *features: int) -> "ConfigBuilder":
        self.dec += features
        return self

    def build(self) -> GroupingConfig:
        if self.width is None or self.varying_set is None:
            raise MalformedConfig("n_features and the varying features have to be declared")
        return GroupingConfig(self.width, tuple(self.varying_set), tuple(self.inc), tuple(self.dec), self.widest)
