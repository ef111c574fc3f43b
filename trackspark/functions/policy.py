"""What a match needs, by the length of its gap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GapPolicy:
    """Margins over the runner-up and appearance thresholds for short, medium and long gaps; None means not set."""

    min_margin: float = 0.05
    winner_margin: float | None = None
    short_gap: int | None = None
    long_gap: int | None = None
    short_margin: float | None = None
    long_margin: float | None = None
    use_appearance: bool = False
    min_appearance: float | None = None
    short_appearance: float | None = None
    long_appearance: float | None = None
    require_short_appearance: bool = False
    require_long_appearance: bool = False

    def by_gap(self) -> bool:
        """Whether any setting depends on the gap; a long-gap limit or requirement alone does not make it so."""
        given = (self.short_gap, self.short_appearance, self.long_appearance, self.short_margin, self.long_margin)
        return self.require_short_appearance or any(v is not None for v in given)

    def bucket(self, gap: Column) -> Column:
        """``short`` up to the short limit, ``long`` beyond the long one, else ``medium``."""
        short = F.lit(False) if self.short_gap is None else gap <= self.short_gap
        long = F.lit(False) if self.long_gap is None else gap > self.long_gap
        return F.when(short, "short").when(long, "long").otherwise("medium")

    def _choose(self, gap: Column, short, long, medium) -> Column:
        if not self.by_gap():
            return F.lit(medium)
        bucket = self.bucket(gap)
        return F.when(bucket == "short", F.lit(short)).when(bucket == "long", F.lit(long)).otherwise(F.lit(medium))

    def margin(self, gap: Column) -> Column:
        """Margin that the best candidate needs, never below ``min_margin``."""
        pick = lambda own: max(self.min_margin, next((v for v in (own, self.winner_margin) if v is not None), self.min_margin))
        return self._choose(gap, pick(self.short_margin), pick(self.long_margin), pick(None))

    def margin_at(self, gap: int) -> float:
        """``margin`` of one gap as a number."""
        own = None
        if self.by_gap() and self.short_gap is not None and gap <= self.short_gap:
            own = self.short_margin
        elif self.by_gap() and self.long_gap is not None and gap > self.long_gap:
            own = self.long_margin
        configured = self.winner_margin if own is None else own
        return self.min_margin if configured is None else max(self.min_margin, configured)

    def appearance(self, gap: Column) -> tuple[Column, Column]:
        """Least appearance similarity (null: none) and whether a match must reach it."""
        base = self.min_appearance
        short, long = (base if v is None else v for v in (self.short_appearance, self.long_appearance))
        needs = lambda level, asked: self.use_appearance and asked and level is not None
        least = self._choose(gap, short, long, base).cast("double")
        return least, self._choose(gap, needs(short, self.require_short_appearance), needs(long, self.require_long_appearance), needs(base, True))
