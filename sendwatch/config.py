"""Periods and job parameters.

The reference hard-codes literal bounds for one month of traffic (period 1,
used for training) and the following month (period 2, scored). Each job keeps
the boundary *style* of its reference query (closed timestamp range, open date
range, lower bound only, ...); the dates themselves are parameters. The
defaults below place the periods on the driver's event data (2024-01-01 ..
2024-01-30, 2024-01-01 is a Monday).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Period:
    """A calendar period given by its first and last day (both inclusive)."""

    first: dt.date
    last: dt.date

    @staticmethod
    def of(first: str, last: str) -> "Period":
        return Period(dt.date.fromisoformat(first), dt.date.fromisoformat(last))

    def shift_first(self, days: int) -> dt.date:
        return self.first + dt.timedelta(days=days)

    def next_month_start(self) -> dt.date:
        """First day of the month after ``first`` (the half-open upper bound
        of a calendar-month window)."""
        y, m = self.first.year, self.first.month
        return dt.date(y + (m == 12), m % 12 + 1, 1)


@dataclass(frozen=True)
class Params:
    # the single-month jobs (account rates, message profile, weekly tables)
    month: Period = field(default_factory=lambda: Period.of("2024-01-01", "2024-01-30"))
    # feature periods: period 1 trains, period 2 is scored
    period1: Period = field(default_factory=lambda: Period.of("2024-01-01", "2024-01-15"))
    period2: Period = field(default_factory=lambda: Period.of("2024-01-16", "2024-01-30"))
    # suspensions counted for the month and per feature period
    suspensions_month: Period = field(default_factory=lambda: Period.of("2024-01-08", "2024-01-30"))
    suspensions_p1: Period = field(default_factory=lambda: Period.of("2024-01-08", "2024-01-15"))
    suspensions_p2: Period = field(default_factory=lambda: Period.of("2024-01-16", "2024-01-30"))
    # messages before an AUP suspension are read from 7 days before the
    # suspension range, before a FRAUD suspension from one year before
    aup_lookback_days: int = 7
    fraud_lookback_days: int = 366
    # messages counted up to and including the suspension day: [day - 7, day]
    suspension_window_days: int = 7
    # reference dates replacing NOW() / the fixed age cut-off
    ages_as_of: dt.date = dt.date(2024, 1, 31)
    tickets_as_of: dt.date = dt.date(2024, 1, 30)
    # rolling ticket window: [monday(as_of) - 89 weeks, that + 90 weeks)
    ticket_weeks_back: int = 89
    ticket_weeks_span: int = 90
    # outlier gate of the feature tables (strict inequalities)
    min_attempted: int = 1000
    min_delivered: int = 1
    # test account excluded from the ISV crosswalk
    sentinel_account_id: int = -1
    # part of the name that marks an account with a default name
    default_name_marker: str = "Default"
    # train/test split: MD5 prefix of the account id modulo 10 under 7 trains
    split_buckets: int = 10
    train_buckets: int = 7


DEFAULT_PARAMS = Params()
