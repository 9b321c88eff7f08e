"""Column roles of a series table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class SeriesSpec:
    """Names the columns that make up a panel of series.

    ``tie`` lists columns that make the row order unique when several rows of a
    series share a timestamp. Without it rows are ordered by their whole content,
    so the order is the same on every run.
    """

    ts: str = "ts"
    y: str = "y"
    group: tuple[str, ...] = ()
    tie: tuple[str, ...] = ()
    features: tuple[str, ...] = field(default=())

    def __post_init__(self):
        for name in ("group", "tie", "features"):
            value = getattr(self, name)
            if isinstance(value, str):
                object.__setattr__(self, name, (value,))
            else:
                object.__setattr__(self, name, tuple(value))

    @property
    def by(self) -> list[str]:
        return list(self.group)

    def with_target(self, y: str) -> "SeriesSpec":
        return replace(self, y=y)
