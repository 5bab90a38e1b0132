import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tripletide.runtime import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("test tables are not here")
    return SMALL


FACT = "seq bigint, batch_id int, s_name string, s_type string, s_id string, pred string, o_name string, o_type string, o_id string, conf double, doc string, text string, status string"


@pytest.fixture(scope="session")
def make_facts(spark):
    """Facts from (seq, s, s_type, pred, o, o_type[, conf, doc, text]); ids are the names."""

    def make(*rows, batch=1, status="accepted"):
        out = []
        for r in rows:
            seq, s, st, p, o, ot, *rest = r
            conf, doc, text = (rest + [None] * 3)[:3]
            out.append((seq, batch, s, st, s, p, o, ot, o, conf, doc, text, status))
        return spark.createDataFrame(out, FACT)

    return make
