import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from brinewave.session import get_session

    session = get_session(
        "tests",
        "local[4]",
        {
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def archive(tmp_path):
    """Two stations at 240 Hz: one with contiguous files and an empty one, one with a gap."""
    import numpy as np

    from brinewave.sources.wav import encode_pcm16

    rng = np.random.default_rng(3)
    signals = {}

    def put(station, stamp, n):
        folder = tmp_path / "data" / station
        folder.mkdir(parents=True, exist_ok=True)
        x = rng.integers(-3000, 3000, n)
        (folder / f"{stamp}.wav").write_bytes(encode_pcm16(x, 240))
        signals[(station, stamp)] = x

    put("NORTH", "20200101_000000", 240 * 300)
    put("NORTH", "20200101_000500", 240 * 300)
    (tmp_path / "data" / "NORTH" / "20200101_001000.wav").write_bytes(b"")
    put("SOUTH", "20200101_000000", 240 * 200)
    put("SOUTH", "20200101_000500", 240 * 130 + 17)
    return str(tmp_path / "data"), signals
