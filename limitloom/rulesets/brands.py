"""Brand codes are data of the portfolio, so rules that name a brand take them from here."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Brands:
    """``core`` is the house brand, ``partner`` the co-brand that gets no reactive offer.

    ``cut_group`` assigns each brand code to a behaviour-cut group of
    :data:`limitloom.rulesets.cuts.BEHAVIOUR_CUTS`. ``blocking_decreases`` are the portfolio's own
    strategy codes of decreases that block an increase.
    """

    core: str
    partner: str
    cut_group: Mapping[str, str] = field(default_factory=dict)
    blocking_decreases: tuple[str, ...] = ()

    @property
    def offered(self) -> tuple[str, str]:
        return (self.partner, self.core)
