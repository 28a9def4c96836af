from datetime import datetime

import pytest

from hyperstar.errors import ArgumentError
from hyperstar.plans.calendar import Calendar

DAY, HOUR = ["year", "month", "day"], ["year", "month", "day", "hour"]


@pytest.mark.parametrize(
    ("word", "now", "units", "path"),
    [
        ("today", datetime(2012, 3, 1), DAY, [2012, 3, 1]),
        ("tomorrow", datetime(2012, 3, 1), DAY, [2012, 3, 2]),
        ("yesterday", datetime(2012, 3, 1), DAY, [2012, 2, 29]),
        ("weekago", datetime(2012, 3, 1), DAY, [2012, 2, 23]),
        ("3weeksago", datetime(2012, 3, 1), DAY, [2012, 2, 9]),
        ("monthago", datetime(2012, 3, 12), DAY, [2012, 2, 12]),
        ("12monthsago", datetime(2012, 3, 12), DAY, [2011, 3, 12]),
        ("monthforward", datetime(2012, 3, 12), DAY, [2012, 4, 12]),
        ("12monthsforward", datetime(2012, 3, 12), DAY, [2013, 3, 12]),
        ("lastweek", datetime(2012, 3, 1, 10, 30), HOUR, [2012, 2, 20, 0]),
        ("last3weeks", datetime(2012, 3, 1, 10, 30), HOUR, [2012, 2, 6, 0]),
        ("lastmonth", datetime(2012, 3, 12), HOUR, [2012, 2, 1, 0]),
        ("last12months", datetime(2012, 3, 12), HOUR, [2011, 3, 1, 0]),
        ("nextmonth", datetime(2012, 3, 12), HOUR, [2012, 4, 1, 0]),
        ("next12months", datetime(2012, 3, 12), HOUR, [2013, 3, 1, 0]),
        ("lastquarter", datetime(2012, 3, 12), HOUR, [2011, 10, 1, 0]),
        ("lastyear", datetime(2012, 3, 12), HOUR, [2011, 1, 1, 0]),
    ],
)
def test_relative(word, now, units, path):
    assert Calendar().named_relative_path(word, units, now) == path


def test_month_ends_and_weekdays():
    assert Calendar().named_relative_path("monthago", DAY, datetime(2012, 3, 31)) == [2012, 2, 29]
    assert Calendar().path(datetime(2012, 3, 4), ["quarter", "weekday"]) == [1, 6]
    assert Calendar("sunday").path(datetime(2012, 3, 4), ["weekday"]) == [0]
    assert Calendar("sunday").truncate(datetime(2012, 3, 7), "week") == datetime(2012, 3, 4)


def test_since_start():
    assert Calendar().since_period_start("year", "day", datetime(2012, 2, 1)) == 31
    assert Calendar().since_period_start("day", "minute", datetime(2012, 2, 1, 2, 3)) == 123


def test_unknown():
    with pytest.raises(ArgumentError):
        Calendar().named_relative_path("soon", DAY)
    with pytest.raises(ArgumentError):
        Calendar("noday")
    with pytest.raises(ArgumentError):
        Calendar().path(datetime(2012, 1, 1), ["era"])
