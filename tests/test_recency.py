import random
from datetime import datetime, timedelta

import pytest

from joblume.functions import recency

NOW = datetime(2024, 1, 15, 12)


def python_moment(text):
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
    except ValueError:
        return None


def test_iso_moment_is_fromisoformat(apply):
    rng = random.Random(4)
    dates = ["2024-01-15", "20240115", "2024-W03-1", "2024W031", "2024-W03", "2024W03", "2024-02-30", "2024-13-01", "2024-1-5",
             "2024", "2024-01", "2020-W53-5", "2021-W53-1", "2024-W00-1", "2024-W03-8", "bad", "", "9999-12-31", "0001-01-01"]
    seps = ["T", " ", "x"]
    clocks = ["", "12", "12:30", "1230", "12:30:45", "123045", "12:30:45.5", "12:30:45.123456", "12:30:45.1234567", "12:30:45,25",
              "24:00", "12:60", "12:30:60", "1:30", "123045.5", "12:3045"]
    zones = ["", "Z", "+00:00", "-03:00", "+0530", "-03", "+23:59", "+24:00", "z", "+05:30:15"]
    texts = dates + [rng.choice(dates[:9]) + rng.choice(seps) + rng.choice(clocks) + rng.choice(zones) for _ in range(3000)]
    texts = [t for t in texts if t]
    got = apply(texts, recency.iso_moment)
    wrong = [(t, g, python_moment(t)) for t, g in zip(texts, got) if g != python_moment(t)]
    assert not wrong, "\n".join(map(str, wrong[:40]))


def test_offset_is_dropped_or_converted(apply):
    assert apply(["2024-01-15T12:00:00-03:00"], recency.iso_moment) == [datetime(2024, 1, 15, 12)]
    assert apply(["2024-01-15T12:00:00-03:00", "2024-01-15T12:00:00Z"], lambda c: recency.iso_moment(c, True)) == \
        [datetime(2024, 1, 15, 15), datetime(2024, 1, 15, 12)]


def test_exactly_36_hours_is_fresh(apply):
    moments = [NOW - timedelta(hours=36), NOW - timedelta(hours=36, microseconds=1), NOW + timedelta(days=400)]
    fresh = apply(moments, lambda c: recency.is_recent_moment(c, recency.now_column(NOW)), "timestamp_ntz")
    assert fresh == [True, False, True]


@pytest.mark.parametrize("text, fresh", [
    ("2 meses", True), ("30+ days", True), ("1 day", True), ("02 days", True), ("0 days", True), ("há 1 mês", False),
    ("2 days", False), ("10 dias", False), ("1 Week ago", False), ("semanas", False), ("anos", False), ("ano", False),
    ("yearly", True), ("Just now", True), ("", True), (None, True), ("2  days", False), ("2 days", False), ("12 horas", True),
    ("méses", True), ("X2 days", True), ("-2 dias", False)])
def test_relative(apply, text, fresh):
    assert apply([text], recency.is_recent_text) == [fresh]


def test_extra_patterns(apply):
    assert apply(["2 meses", "30+ days"], lambda c: recency.is_recent_text(c, r"\bmeses\b|\d\+ days")) == [False, False]
