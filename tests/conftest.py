import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from jobmarket.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def places(spark):
    """(regions, provinces, municipalities) of a small country."""
    schema = "code string, description string"
    regions = [
        ("010000000", "Region I (Ilocos Region)"),
        ("030000000", "Region III (Central Luzon)"),
        ("040000000", "Region IV-A (CALABARZON)"),
        ("070000000", "Region VII (Central Visayas)"),
        ("130000000", "National Capital Region (NCR)"),
        ("150000000", "Autonomous Region in Muslim Mindanao (ARMM)"),
    ]
    provinces = [
        ("012800000", "Ilocos Norte"),
        ("035400000", "Pampanga"),
        ("043400000", "Laguna"),
        ("072200000", "Cebu"),
        ("133900000", "City of Manila"),
        ("137602000", "City Of Makati"),
        ("137603000", "San Juan"),
        ("153800000", "Maguindanao"),
    ]
    municipalities = [
        ("012801000", "Santa Rosa"),
        ("043428000", "City Of Santa Rosa"),
        ("072217000", "Cebu City (Capital)"),
        ("072230000", "Mandaue City"),
        ("035401000", "Angeles City"),
        ("035402000", "Peñablanca"),
        ("012805000", "San Juan"),
        ("990101000", "Lost Town"),
    ]
    return tuple(spark.createDataFrame(t, schema) for t in (regions, provinces, municipalities))


@pytest.fixture(scope="session")
def lookup(places):
    from jobmarket import build_location_lookup

    return build_location_lookup(*places)
