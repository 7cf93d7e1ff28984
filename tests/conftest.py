import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewatch.schema import FLOW_FIELDS  # noqa: E402
from tidewatch.session import local_session  # noqa: E402

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{
        "spark.sql.shuffle.partitions": "4",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_flows(spark):
    """Flows from short dicts: ``at`` seconds after T0, everything else zero or a plain default."""
    defaults = {"split": "d", "src_ip": "192.168.10.5", "dst_ip": "8.8.8.8", "src_port": 40000, "dst_port": 80, "protocol": 6,
                "label": "BENIGN", "attempted": False, "stage": 0}
    schema = "split string, " + ", ".join(f"{n} {t.simpleString()}" for n, t in FLOW_FIELDS)
    kinds = {n: t.simpleString() for n, t in FLOW_FIELDS}

    def build(rows):
        out = []
        for row in rows:
            full = {n: (0.0 if kinds[n] == "double" else 0) for n in kinds} | defaults | {k: v for k, v in row.items() if k != "at"}
            full["ts"] = T0 + timedelta(seconds=row.get("at", 0))
            out.append(tuple(full[n] for n in ["split", *kinds]))
        return spark.createDataFrame(out, schema)

    return build


@pytest.fixture(scope="session")
def make_stages(spark):
    def build(stages, split="d"):
        return spark.createDataFrame([(split, w, s) for w, s in enumerate(stages)], "split string, w bigint, stage int")

    return build


@pytest.fixture(scope="session")
def make_scores(spark):
    def build(scores, split="d", y=None):
        y = y or [0] * len(scores)
        return spark.createDataFrame([(split, w, float(s), int(v)) for w, (s, v) in enumerate(zip(scores, y))],
                                     "split string, w bigint, score double, y int")

    return build
