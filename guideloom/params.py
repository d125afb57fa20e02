"""Search parameters and their checks."""

from __future__ import annotations

from dataclasses import dataclass

LONGEST_SPACER = 32


@dataclass(frozen=True)
class SearchParams:
    """Parameters of a search, with the defaults of the tool's command line."""

    pam: str = "NGG"
    alt_pam: str = "NAG"
    spacer_length: int = 20
    direction: str = "up"  # up: the PAM follows the spacer; down: it precedes it
    max_mismatch: int = 4
    max_indel: int = 2
    dust_threshold: int = 12
    iupac: bool = False  # expand codes of several bases on both strands; else they are literal on + and any base on -

    def __post_init__(self):
        if not self.pam:
            raise ValueError("pam must not be empty")
        if self.direction not in ("up", "down"):
            raise ValueError("direction must be up or down")
        if not 1 <= self.spacer_length <= LONGEST_SPACER:
            raise ValueError(f"spacer_length must be within 1..{LONGEST_SPACER}")
        for name in ("max_mismatch", "max_indel", "dust_threshold"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")

    @property
    def upstream(self) -> bool:
        return self.direction == "up"

