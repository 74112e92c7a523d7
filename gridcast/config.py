"""Window configurations, split fractions and screening parameters."""

from __future__ import annotations

from dataclasses import dataclass

#: Steps of a day at each granularity.
PER_DAY = {"day": 1, "hour": 24, "10min": 144}


@dataclass(frozen=True)
class WindowConfig:
    """Days of input and days to forecast."""

    input_days: int
    output_days: int

    @property
    def name(self) -> str:
        return f"{self.input_days}-{self.output_days}"

    def size(self, granularity: str) -> tuple[int, int]:
        """Steps of input and of output at a granularity."""
        return self.input_days * PER_DAY[granularity], self.output_days * PER_DAY[granularity]


WINDOWS = {w.name: w for w in (WindowConfig(7, 1), WindowConfig(7, 2), WindowConfig(14, 1), WindowConfig(14, 3), WindowConfig(30, 7))}

#: Shares of train and validation; the rest is test.
TRAIN_SHARE, VALIDATION_SHARE = 0.6, 0.1
#: Offset between window starts, by split.
STEPS = {"train": 5, "val": 5, "test": 1}
#: Least rows of an entity, quantiles and fence width of the outlier test.
MIN_HISTORY, LOW_QUANTILE, HIGH_QUANTILE, FENCE = 260, 0.2, 0.8, 1.5
#: Entities left out by hand.
EXCLUDED = ("243",)
#: Floor of metric denominators.
EPSILON = 1e-7


def check_shares(train: float, validation: float, test: float | None = None) -> tuple[float, float, float]:
    """The three shares, or ValueError where they don't add up to 1."""
    test = 1.0 - train - validation if test is None else test
    if abs(train + validation + test - 1.0) > 1e-8:
        raise ValueError("the shares of train, validation and test must add up to 1")
    return train, validation, test
