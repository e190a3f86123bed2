import pytest
from pyspark.sql import functions as F

from evigraph import engine
from evigraph.cli import main, parser
from evigraph.investigate import Investigation
from evigraph.sources import synthetic
from evigraph.sources.adapters import merge_by_key
from evigraph.operators.blocking import blocking_keys
from evigraph.streaming import candidate_stream, keyed_stream, normalized_stream


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    synthetic.generate(spark, folder, 99, 80, 25)
    return engine.run(spark, folder)


def test_quality_bands(run):
    total = run.evaluation().where("entity_type = 'overall'").first()
    assert total.precision == 1.0 and total.recall > 0.85
    stats = run.resolution.total()
    assert stats["entities"] < stats["records"] / 2 and run.graph.dangling == 0


def test_seeds_and_findings(run):
    rows = run.graph.entities.join(run.seeds.withColumnRenamed("node", "id"), "id").collect()
    assert rows and all(len(r.sources) > 1 for r in rows)
    assert {r.kind for r in run.findings.collect()} >= {"circular_flow", "structuring", "shared_registration"}
    assert any(len(c.kinds) >= 2 and c.people for c in run.cases.collect())


def test_ring_ranks_high(run):
    ring = {r.entity_id for r in run.labelled.where(F.col("truth_id").isin([f"P{i:06d}" for i in range(6)])).collect()}
    view = Investigation(run)
    assert len([r for r in view.top_risk("person", 10).collect() if r.id in ring]) >= 4
    text = view.dossier("watch:W000000")
    assert "records by source" in text and "natreg" in text and "officer_of" in text
    assert "hops" in view.connect("natreg:R000000", "natreg:R000001") and "case 0" in view.case_report()
    assert view.engine.query("find person where flags.watchlisted = true limit 50").count() == run.seeds.count()


def test_artifacts(run, spark, tmp_path):
    run.save(f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/evaluation").count() == 5 and spark.read.json(f"file://{tmp_path}/out/findings").count() == run.findings.count()


def test_generator_is_deterministic(spark):
    dice = synthetic.Dice(7)
    one, two = (synthetic.people(spark, 40, dice).repartition(n).orderBy("p").collect() for n in (1, 5))
    assert one == two and one != synthetic.people(spark, 40, synthetic.Dice(8)).orderBy("p").collect()


def test_key_merge(spark):
    rows = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "", 5), ("a", 3, "z", None), ("b", 1, None, None)], "k string, o int, s string, n int")
    assert {tuple(r) for r in merge_by_key(rows, ["k"], "o").collect()} == {("a", "z", 5), ("b", None, None)}


def test_missing_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        engine.run(spark, f"file://{tmp_path}")


def test_command_line(capsys):
    assert main(["ontology"]) == 0 and "person" in capsys.readouterr().out
    assert vars(parser().parse_args(["connect", "a", "b"]))["hops"] == 4
    with pytest.raises(SystemExit):
        parser().parse_args(["dance"])


def test_stream(spark, tmp_path):
    from evigraph.ontology import default_ontology

    person = default_ontology().entity("person")
    spark.createDataFrame([("a:1", "a", "Dr Bob Li", "08/03/1974")], "key string, source string, full_name string, dob string").write.parquet(f"file://{tmp_path}/in")
    raw = spark.readStream.schema("key string, source string, full_name string, dob string").parquet(f"file://{tmp_path}/in")
    query = keyed_stream(normalized_stream(raw, person).withColumns({c: F.lit(None).cast("string") for c in ("email", "phone", "national_id")}), person).writeStream.format("memory").queryName("keys").start()
    query.processAllAvailable()
    query.stop()
    assert {r.block for r in spark.sql("SELECT block FROM keys").collect()} == {"name_sound:R163L000", "name_letters:beilor", "born:1974-03-08"}


def test_arriving_records_meet_stored_ones(spark, tmp_path):
    from evigraph.ontology import default_ontology

    person, shape = default_ontology().entity("person"), "key string, source string, full_name string, dob string"
    empty = {c: F.lit(None).cast("string") for c in ("email", "phone", "national_id")}
    known = spark.createDataFrame([(0, "b:0", "b", "robert li", "1974-03-08"), (1, "b:1", "b", "jane roe", "1980-01-01"), *[(k, f"b:{k}", "b", f"person {k}", "1999-09-09") for k in range(2, 9)]], "pos long, " + shape)
    stored = blocking_keys(known.withColumn("dob", F.to_date("dob")).withColumns(empty), person)
    spark.createDataFrame([("a:1", "a", "Dr Bob Li", "08/03/1974"), ("a:2", "a", "Ann Other", "09/09/1999")], shape).write.parquet(f"file://{tmp_path}/in")
    raw = spark.readStream.schema(shape).parquet(f"file://{tmp_path}/in")
    met = candidate_stream(keyed_stream(normalized_stream(raw, person).withColumns(empty), person), stored, max_block=5)
    query = met.writeStream.format("memory").queryName("met").start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.sql("SELECT DISTINCT key, pos FROM met").collect()} == {("a:1", 0)}  # the block of 1999-09-09 is too large
