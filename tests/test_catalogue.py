import math
from pathlib import Path

import duckdb
import pytest

from loomline.plans import catalogue, forms


SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalogue.QUERIES | forms.QUERIES, catalogue.ORACLES | forms.ORACLES


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) and math.isfinite(r[i]) else r[i] for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    got, want = plain(map(tuple, df.collect()), df.columns), plain(want.fetchall(), names)
    assert got == want
    assert want, "the query finds nothing"
