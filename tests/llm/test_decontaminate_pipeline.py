import random

import numpy as np
import pytest
from evigraph.llm import decontaminate as D

import corpus_pipeline
from tests.llm.conftest import words

ITEM = "item_id long, text string"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_bit_parallel_lcs():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([bytes([rng.choice(b"abcde")]) for _ in range(rng.randint(1, 40))] for _ in range(2))
        assert D.lcs(D.word_masks(a), len(a), b) == slow_lcs(a, b)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(6)
    vocabulary = [words(rng, 1) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(12, 60)) + ". " + text(6) + ".") for k in range(60)]
    docs, truth = [], set()
    for i in range(600):
        body = text(rng.randint(20, 400)).split()
        if i % 5 == 0:
            k = rng.randrange(60)
            ws = items[k][1].split()
            if i % 10 == 0:  # a paraphrase: one word in eight replaced, one dropped
                ws = [rng.choice(vocabulary) if rng.random() < 0.12 else w for w in ws]
                ws.pop(rng.randrange(len(ws)))
            at = rng.randrange(len(body))
            body[at:at] = ws
            truth.add((i, k))
        docs.append((i, " ".join(body)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM), truth


def test_recall_of_copies_and_paraphrases(planted):
    docs, items, truth = planted
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    assert len(got & truth) / len(truth) >= 0.95 and len(got - truth) <= 1
    kept = {r.doc_id for r in D.drop_contaminated(docs, items).collect()}
    assert kept == set(range(600)) - {i for i, _ in got}


def test_query_blocks_do_not_change_the_result(planted, monkeypatch):
    docs, items, truth = planted
    monkeypatch.setattr(D, "QUERY_BLOCK", 20)
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    assert len(got & truth) / len(truth) >= 0.95


def test_svd_finds_the_leading_directions(spark, monkeypatch):
    monkeypatch.setattr(D, "SPAN", 8)
    rng = np.random.default_rng(2)
    a = rng.normal(size=(120, 4)) @ rng.normal(size=(4, 50)) + 0.01 * rng.normal(size=(120, 50))
    entries = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(120) for j in range(50)], "row long, term int, value float")
    got = {r.term: np.frombuffer(r.vector, dtype=np.float32) for r in D.randomised_svd(entries, 120, 4).collect()}
    basis = np.stack([got[j] for j in range(50)])
    assert np.allclose(basis.T @ basis, np.eye(4), atol=1e-3)
    assert np.linalg.norm(a - a @ basis @ basis.T) / np.linalg.norm(a) < 0.01


def test_vectors_come_to_the_driver_once_and_as_arrow(spark, planted, monkeypatch):
    docs, items, _ = planted
    passages = [p for r in items.collect() for p in D.passages_of(r.item_id, r.text)]
    hashed = D.hashed_texts(docs)
    idf, count = D.inverse_frequencies(hashed)
    frame, made, as_rows = type(docs), [], []
    create, collect = type(spark).createDataFrame, frame.collect
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: made.append(list(getattr(data, "column_names", []))) or create(self, data, *a, **b))
    monkeypatch.setattr(frame, "collect", lambda self: as_rows.append([c for c, kind in self.dtypes if kind == "binary"]) or collect(self))
    where, latent = D._space(hashed, count, passages, idf)
    assert where.max() + 1 == len(latent) > 100 and not any(made) and not any(as_rows)


def exact_search(docs, items):
    """Every pair that the checks accept, over all passages of all texts, without any candidate search."""
    found = set()
    for item, text in items:
        for p in D.passages_of(item, text):
            for doc, body in docs:
                ws = D.words_of(body or "")
                if any(p.check(ws, a, a + 2 * D.BLOCK) for a in range(0, len(ws), D.BLOCK)):
                    found.add((doc, item))
    return found


def test_recall_against_exact_search(spark, planted, monkeypatch):
    monkeypatch.setattr(D, "SAMPLE_DOCS", 300)
    monkeypatch.setattr(D, "RANK", 40)  # fewer directions than items
    docs, items, _ = planted
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id < 200").collect()]
    want = exact_search(rows, [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs.where("doc_id < 200"), items).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 30


def test_the_space_is_fit_on_every_passage(spark, planted, monkeypatch):
    monkeypatch.setattr(D, "SAMPLE_DOCS", 50)  # fewer than documents
    monkeypatch.setattr(D, "RANK", 24)
    monkeypatch.setattr(D, "SPAN", 16)
    monkeypatch.setattr(D, "CELLS", 20_000)  # several passes
    monkeypatch.setattr(D, "SOME_WORDS", 5000)
    rng = random.Random(3)
    texts = [r.text for r in planted[0].collect()] + ["", None, "one", "so so so " * 40, " ".join(rng.choice("abc") for _ in range(100))]
    items = [p for k, r in enumerate(planted[1].collect()[:20]) for p in D.passages_of(k, r.text + " so so a b")]
    hashed = D.hashed_texts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    idf, count = D.inverse_frequencies(hashed)
    where, latent = D._space(hashed, count, items, idf)
    active = np.flatnonzero(where)
    rows = []
    for t in texts:
        hashes = D.term_hashes(D.words_of(t or ""))
        for a in range(0, max(len(hashes) - D.BLOCK, min(len(hashes), 1)), D.BLOCK):
            rows.append(hashes[a : a + 2 * D.BLOCK])

    def dense(hashes):
        row = np.bincount(hashes, minlength=D.BUCKETS) * idf.astype(np.float64)
        return (row / np.linalg.norm(row))[active]

    assert len(rows) == count > len(texts)
    every, mine = np.array([dense(r) for r in rows]), np.array([dense(D.term_hashes(p.words)) for p in items])
    want = 50 / count * every.T @ every
    got = np.zeros_like(want)
    for r in D.passage_products(hashed, where, idf, 50 / count, len(active)).collect():
        a = r["at"] * 16
        part = np.frombuffer(r.part, dtype=np.float32).reshape(-1, len(active) - a)
        got[a : a + len(part), a:] += part
    assert np.allclose(got + got.T, want, atol=1e-5)
    want += D.WEIGHT**2 * mine.T @ mine
    basis = latent[where[active]] / idf[active][:, None]
    assert np.allclose(basis.T @ basis, np.eye(24), atol=1e-3)
    assert np.trace(basis.T @ want @ basis) > 0.99 * np.linalg.eigvalsh(want)[-24:].sum()


def test_short_items_are_found_in_long_texts(spark):
    rng = random.Random(8)
    vocabulary = [words(rng, 1) for _ in range(2000)]
    items = [(n, " ".join(rng.sample(vocabulary, n))) for n in range(1, 16)] + [(20 + k, " ".join(rng.sample(vocabulary, 30))) for k in range(20)]
    items[0] = (1, "zebrafish")
    docs = [(k, " ".join([*rng.choices(vocabulary, k=200), *(text.split() if k % 2 else []), *rng.choices(vocabulary, k=200)])) for k, (_, text) in enumerate(items)]
    want = exact_search(docs, items)
    got = {(r.doc_id, r.item_id) for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEM)).collect()}
    assert {(k, i) for k, (i, _) in enumerate(items) if k % 2} <= got <= want and len(got) >= 0.9 * len(want)


def test_odd_tables(spark, odd, empty, clashing, planted):
    _, items, _ = planted
    more = items.unionByName(spark.createDataFrame([(None, None), (70, ""), (71, "two words"), (72, "é " * 300)], ITEM))
    assert D.contaminated(clashing, more).columns[:2] == ["doc_id", "item_id"]
    D.contaminated(odd, more).collect()
    assert D.contaminated(empty, more).count() == 0 and D.contaminated(odd, items.limit(0)).count() == 0
    assert D.drop_contaminated(odd, items).count() == odd.count() and D.drop_contaminated(empty, items).count() == 0


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {r.doc_id for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder).cache()
        ids = [r.doc_id for r in now.collect()]
        assert now.columns == docs.columns and set(ids) <= seen and len(ids) == len(set(ids)), name
        assert all(r.n_chars == len(r.text) for r in now.collect()) or name == "toxicity"
        seen = set(ids)
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.collect()} == seen and len(seen) > 120


def test_pipeline_takes_odd_rows(spark, odd, empty, clashing, tmp_path):
    folder = f"file://{tmp_path}"
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    packed = []
    for frame in (odd, empty, clashing):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            before, now = now, stage(spark, now, folder).cache()
            now.count()
            assert name == "packing" or now.columns == before.columns
        packed.append(sorted(map(str, now.collect())))
    assert packed[0] == packed[2] and not packed[1]  # other columns change nothing
