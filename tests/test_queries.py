import math

import duckdb
import pytest

from evigraph import queries as Q

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    def opened(folder):
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return c

    return opened


#: On the fifteen users of the smallest tables every path of the flow graph exists, which is too much for SQL.
LARGER = {"circular_flows": "/root/testdata/sf0.01"}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql_agrees(spark, duck, name):
    folder = LARGER.get(name, FOLDER)
    frame = Q.queries()[name](spark, folder)
    columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    answer = duck(folder).execute(Q.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in answer.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_intake_writes_its_file_in_parts_in_order(spark, monkeypatch):
    from evigraph import queries as Q

    written = []
    ingest = Q.adapters.ingest
    monkeypatch.setattr(Q.adapters, "ingest", lambda s, folder, o: (written.append(s.read.text(f"{folder}/*").inputFiles()), ingest(s, folder, o))[1])
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        got = {r.key: r.pos for r in Q.queries()["intake_comms"](spark, "/root/testdata/sf0.001").where("kind = 'communicated'").collect()}
    finally:
        spark.conf.unset(coalesce)
    assert len(written[0]) > 1
    keys = [f"comms:V{r.event_id}" for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id % 4 > 0").orderBy("event_id").collect()]
    assert got == {k: i for i, k in enumerate(keys)}
