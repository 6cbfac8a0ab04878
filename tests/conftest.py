import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from trendlake.session import local_session

    s = local_session(8, "trendlake-tests")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def points(spark):
    """Rows of four years, three artists and a hot artist-year that holds a third of them."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        hot = i % 3 == 0
        year = 2001 if hot else 2000 + int(rng.integers(0, 4))
        artist = "hot" if hot else f"a{int(rng.integers(0, 12))}"
        rows.append((i, year, artist, *[float(v) for v in rng.normal(size=3)]))
    return spark.createDataFrame(rows, "id long, year int, artist string, u double, v double, w double")
