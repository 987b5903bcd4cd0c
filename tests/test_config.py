from datetime import timedelta

import pytest

from spanfold.config import AggConfig, Limits
from spanfold.functions.time import interval_label

H, M, S = timedelta(hours=1), timedelta(minutes=1), timedelta(seconds=1)


@pytest.mark.parametrize(
    ("given", "message"),
    [
        ({"data_dir": ""}, "data directory is required"),
        ({"sink": None}, "processor is required"),
        ({"partitions": 0}, "partitions must be greater than zero"),
        ({"intervals": ()}, "at least one aggregation interval is required"),
        ({"intervals": (H, M)}, "aggregation intervals must be in ascending order"),
        ({"intervals": (10 * S, 15 * S)}, "aggregation intervals must be a factor of lowest interval"),
        ({"intervals": (S / 2,)}, "aggregation interval less than one second is not supported"),
        ({"intervals": (20 * H,)}, "aggregation interval greater than 18 hours is not supported"),
    ],
)
def test_errors(given, message):
    with pytest.raises(ValueError, match=message):
        AggConfig(Limits.same(1), **given)


def test_labels():
    assert [interval_label(s) for s in (1, 59, 60, 600, 3600)] == ["1s", "59s", "1m", "10m", "60m"]
