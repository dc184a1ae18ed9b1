"""Switches of the plans. None changes a result; they are for measuring what each part is worth."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    #: The heavier branch of a split is tested first.
    heavy_first: bool = True
    #: Sums of trees are projected in small methods, outside whole-stage codegen.
    small_methods: bool = True
    #: Trees without varying splits are summed on the entities.
    entity_sums: bool = True
    #: Equal constant predicates of all trees are decided once for an entity.
    shared_predicates: bool = True

    @property
    def label(self) -> str:
        """all-on, or what is switched off."""
        return "+".join(f"no-{f.name.replace('_', '-')}" for f in fields(self) if not getattr(self, f.name)) or "all-on"

    @classmethod
    def ablations(cls) -> tuple["Options", ...]:
        """Everything on, and each switch off by itself."""
        return (cls(), *(cls(**{f.name: False}) for f in fields(cls)))
