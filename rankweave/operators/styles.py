"""How contests are won: flags of a win by its style, their rates, and what they say about an entrant's style."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.functions.numbers import weighted_blend
from rankweave.operators.history import Feature
from rankweave.operators.relative import clip01

KINDS = ("inside", "slip", "turn", "turn_slip", "chase")
BLENDED = ("inside", "slip", "turn", "turn_slip")
#: Shares of the rates of entrant and place, of the entrant and of the place at a site; a rate that isn't there gives its share up.
BLEND = {"entity_place": 0.45, "entity": 0.25, "place": 0.30}


def win_flags(style: str = "style", rank: str = "outcome_rank", kinds: Sequence[str] = KINDS) -> dict[str, Column]:
    """won_x: 1 for the winner of a contest won in style x, 0 for all others and where the style is unknown."""
    return {f"won_{k}": F.coalesce((F.col(style) == k) & (F.col(rank) == 1), F.lit(False)).cast("int") for k in kinds}


def rates(name: str, window: int, least: int, kinds: Sequence[str] = KINDS) -> list[Feature]:
    """The share of rows before that were won in each style."""
    return [Feature(f"{name}_{k}", f"won_{k}", window, least) for k in kinds]


def blended() -> dict[str, Column]:
    """flow_x of the blended styles, and the attack score from outside, from rates named as in BLEND."""
    flow = {f"flow_{k}": weighted_blend([(f"{name}_{k}", w) for name, w in BLEND.items()]) for k in BLENDED}
    return {**flow, "attack_style": clip01(flow["flow_turn"] + flow["flow_turn_slip"]), "slip_style": clip01(flow["flow_slip"])}
