import itertools
import pathlib
import random

from evigraph.llm import packing


def cost(bounds, histogram):
    return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())


def test_boundaries_are_optimal():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {rng.randint(0, 60): rng.randint(1, 30) for _ in range(9)}
        for k in (1, 2, 3, 4, 20):
            got = packing.optimal_boundaries(histogram, k)
            lengths = sorted(histogram)
            best = min(cost((*c, lengths[-1]), histogram) for m in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], m))
            assert got == sorted(set(got)) and len(got) <= k and cost(got, histogram) == best
    assert packing.optimal_boundaries({}) == []


def test_every_token_once_and_batches_fill_in_order(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 3, 9, 25, 70])))) for i in range(300)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), max_len=20, buckets=3, token_budget=60).collect()
    for i, t in rows:
        mine = sorted((r.piece, r.start_token, r.n_tokens) for r in out if r.doc_id == i)
        assert sum(n for *_, n in mine) == len(t.split()) and [s for _, s, _ in mine] == [20 * k for k in range(len(mine))]
    for b in {r.bucket for r in out}:
        group = sorted((r for r in out if r.bucket == b), key=lambda r: (r.doc_id, r.piece))
        fit = max(1, 60 // max(b, 1))
        assert [(r.batch, r.slot) for r in group] == [divmod(k, fit) for k in range(len(group))]
        assert all(r.n_tokens <= b for r in group)


def test_odd_tables(odd, empty, clashing):
    out = packing.pack(odd)
    assert out.where("n_tokens = 0").count() >= 3
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in odd.collect()}
    assert packing.pack(empty).count() == 0 and packing.pack(clashing).count() == out.count()


def test_text_ids_and_vocabulary_lengths(spark):
    rows = [(f"doc-{i:04d}", "w " * (i % 30)) for i in range(200)] + [(None, "a b")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id string, text string"), max_len=20, buckets=3, token_budget=60).collect()
    for b in {r.bucket for r in out}:
        group = sorted((r for r in out if r.bucket == b), key=lambda r: (r.doc_id or "", r.piece))
        assert [(r.batch, r.slot) for r in group] == [divmod(k, max(1, 60 // max(b, 1))) for k in range(len(group))]
    files = sorted(pathlib.Path("/opt/tokenizers").rglob("*tokenizer*.json"))
    if files:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(str(files[0]))
        model.encode_special_tokens = True
        frame = spark.createDataFrame([(1, "Some words, more words."), (2, None), (3, "é漢 " * 50)], "doc_id long, text string")
        got = {r.doc_id: r.n_tokens for r in packing.vocabulary_lengths(frame, str(files[0])).collect()}
        assert got == {r.doc_id: len(model.encode(r.text or "", add_special_tokens=False).ids) for r in frame.collect()}
