import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import builder

    shared = tmp_path_factory.mktemp("shared")
    s = (
        builder("tests").master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.autoBroadcastJoinThreshold", "256k").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def _plain(v):
    return round(v, 8) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def same_rows(duck):
    from collections import Counter

    def check(df, sql):
        cols = sorted(df.columns)
        got = Counter(repr([_plain(v) for v in r]) for r in df.select(*cols).collect())
        r = duck.execute(sql)
        names = [d[0] for d in r.description]
        order = sorted(range(len(names)), key=names.__getitem__)
        assert [names[i] for i in order] == cols
        want = Counter(repr([_plain(row[i]) for i in order]) for row in r.fetchall())
        assert got == want, (list((got - want))[:3], list((want - got))[:3])

    return check
