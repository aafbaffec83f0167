import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from specmill.session import local_session  # noqa: E402
from specmill.sources.rules import load_rules  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session(
        4, "specmill-tests", **{"spark.checkpoint.dir": folder, "spark.sql.shuffle.partitions": "2"}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rules():
    return load_rules()


def number(value, unit):
    return {"value": value, "unit": unit}


@pytest.fixture
def good():
    """A reply that validates without a problem."""
    return {
        "manufacturer": "Nordlicht Messtechnik AG",
        "part_number": "NL-770/B",
        "sensor_type": "level",
        "supply_voltage_min": number(9, "V DC"),
        "supply_voltage_max": number(36, "V DC"),
        "output_signal": "IO-Link",
        "operating_temp_min": number(-15, "C"),
        "operating_temp_max": number(65, "C"),
        "measuring_range": "0.2 to 6 m",
        "ip_rating": "IP68",
        "response_time": number(450, "ms"),
        "weight": number(310, "g"),
    }


def dumps(reply):
    return json.dumps(reply)
