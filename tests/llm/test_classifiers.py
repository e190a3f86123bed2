import itertools
import random

import numpy as np
import pytest
from evigraph.llm import quality, toxicity
from evigraph.llm.labelled import training_rows

from tests.llm.conftest import words


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(500):
        bad, toxic = i % 4 == 0, i % 5 == 0
        ws = words(rng, 60).split()
        if toxic:
            ws.insert(rng.randrange(60), rng.choice(["gruntlehead", "snarkface"]))
        text = " ".join(w.upper() + "!!" for w in ws) if bad else "\n".join(" ".join(ws[k : k + 20]).capitalize() + "." for k in range(0, 60, 20))
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("run", "target"), [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_held_out_accuracy(corpus, run, target):
    docs, labels = corpus
    rows = run(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert 120 < len(held) < 220 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r[target] for r in held]) > 0.95


def test_training_sample_is_bounded_and_has_no_held_out_rows(corpus):
    import zlib

    docs, labels = corpus
    ids = sorted(r.doc_id for r in training_rows(docs, labels, "toxic", 50).collect())
    assert len(ids) == 50 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)
    assert ids == sorted(r.doc_id for r in training_rows(docs.repartition(9), labels.repartition(5), "toxic", 50).collect())


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_odd_tables(corpus, odd, empty, clashing, run):
    _, labels = corpus
    for frame in (odd, clashing):
        rows = run(frame, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in rows)
    assert run(empty, labels).count() == 0 and {r.score for r in run(odd, labels.limit(0)).collect()} == {0.5}
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


def test_machine_learns_a_pair_that_no_weight_can():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array(sorted({*([11] if a else []), *([22] if b else []), *(100 + rng.choice(200, 8, replace=False))})))
        y.append(float(a == b))
    machine = toxicity.fit_machine(rows, np.array(y))
    both = [machine.active.get(k) for k in (11, 22)]
    assert None not in both and abs(machine.vectors[both[0]] @ machine.vectors[both[1]]) > 0.5


def exclusive_or(spark, n=3000, seed=1):
    """Documents whose label is that two words are both there or both not, among many other words."""
    rng = random.Random(seed)
    vocabulary = [words(rng, 1) for _ in range(1500)]
    docs, labels = [], []
    for i in range(n):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        ws = rng.sample(vocabulary, 40) + ["zebra"] * a + ["quartz"] * b
        rng.shuffle(ws)
        docs.append((i, " ".join(ws)))
        labels.append((i, int(a == b)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_training_learns_a_pure_interaction(spark):
    docs, labels = exclusive_or(spark)
    machine = toxicity.train(docs, labels)
    rows = toxicity.score(docs, machine).join(labels, "doc_id").withColumn("held", toxicity.held_out()).collect()
    for part in (True, False):
        assert np.mean([(r.score >= 0.5) == r.toxic for r in rows if r.held == part]) > 0.95


def test_no_table_as_long_as_the_features_comes_to_the_driver(spark, monkeypatch):
    got, sums = [], toxicity.Dealt.sums

    def seen(self, work, length, select=None):
        out = sums(self, work, length, select)
        got.append((length, out.size))
        return out

    monkeypatch.setattr(toxicity, "PIECE", 4096)
    monkeypatch.setattr(toxicity.Dealt, "sums", seen)
    machine = toxicity.train(*exclusive_or(spark, n=600))
    long = [n for length, n in got if length > toxicity.PIECE // 4]
    assert machine.active and max(length for length, _ in got) > toxicity.BUCKETS
    assert len(long) > 2 and max(long) < toxicity.BUCKETS // 100  # 1,502 words


def test_training_takes_every_labelled_row(spark, monkeypatch):
    import zlib

    for name, value in (("PIECE", 64), ("PAIR_CELLS", 300), ("HELD_BYTES", 0), ("STEPS", 4)):  # all sums are made by tasks, in pieces
        monkeypatch.setattr(toxicity, name, value)
    rng = random.Random(5)
    vocabulary = [words(rng, 1) for _ in range(80)]
    texts, marks = [], []
    for i in range(14_000):
        a, b, c = (rng.random() < 0.5 for _ in range(3))
        texts.append(" ".join(rng.sample(vocabulary, 4) + ["zzz"] * a + ["qqq"] * b + ["ggg"] * (c and i % 50 == 0)))
        marks.append(int(a == b or (c and i % 50 == 0)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    machine = toxicity.train(docs, spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int"))
    usable = [i for i in range(14_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    found = [toxicity.text_words(texts[i]) for i in usable]
    rows = [np.array(sorted({f for w in ws for f in toxicity.word_features(w)})) for ws in found]
    stems = [np.array(sorted({toxicity.stem_feature(w) for w in ws})) for ws in found]
    y = np.array([float(marks[i]) for i in usable])
    want = toxicity.fit_machine(rows, y, stems)
    assert len(usable) > 9000 and {toxicity.stem_feature(w) for w in ("zzz", "qqq", "ggg")} <= set(want.active)
    assert set(machine.active) == set(want.active) and machine.bias == pytest.approx(want.bias, abs=1e-3)
    for f, k in want.active.items():
        at = machine.active[f]
        assert machine.weights[at] == pytest.approx(want.weights[k], abs=1e-3) and np.allclose(machine.vectors[at], want.vectors[k], atol=1e-3)
    # the pairs, one by one
    left = y - y.mean()
    have = {f: np.array([f in set(s.tolist()) for s in stems]) for f in {f for s in stems for f in s.tolist()}}
    clear = set()
    for f, g in itertools.combinations(have, 2):
        some = left[have[f] & have[g]]
        if abs(some.sum()) >= toxicity.PAIR_EVIDENCE and abs(some.sum()) >= toxicity.PAIR_Z * np.sqrt((some**2).sum()):
            clear |= {f, g}
    data = toxicity.Held(toxicity._rows(rows, stems, y, np.ones(len(y))))
    names = np.unique(np.concatenate(rows))
    assert len(clear) > 2 and set(toxicity.paired_terms(data, names, names[:0], np.array([np.log(y.mean() / (1 - y.mean()))])).tolist()) == clear


def test_op3_equals_a_slow_scorer(corpus):
    docs, labels = corpus
    machine = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.toxicity(docs, labels).collect()[:60]:
        terms = {f for w in toxicity._WORD.findall(texts[r.doc_id].lower()) for f in toxicity.word_features(w)}
        at = [machine.active[f] for f in terms if f in machine.active]
        margin = machine.bias + sum(machine.weights[i] for i in at) + sum(machine.vectors[i] @ machine.vectors[j] for i, j in itertools.combinations(at, 2))
        assert r.score == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9) and r.predicted == int(r.score >= 0.7)


def test_op2_equals_enumeration_over_the_states_of_short_documents(spark, corpus):
    docs, labels = corpus
    field = quality.train(docs, labels)
    texts = ["One good line of text here.\nANOTHER LINE!!! | | 99\nand a third", "x", "", None, "a b c d e f.\n\n!!! !!! 7 7 7 7\nThe end of it."]
    rows = quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field).collect()
    for r in rows:
        x, weight = quality.document_features((texts[r.doc_id] or "").encode())
        emit = np.clip(field.emit(x), -30, 30)
        total, good = 0.0, np.zeros(len(emit))
        for states in itertools.product((0, 1), repeat=len(emit)):
            p = np.exp(sum(e for e, s in zip(emit, states, strict=True) if s) + sum(field.move[a, b] for a, b in itertools.pairwise(states)))
            total += p
            good += p * np.array(states)
        mean = (good / total * weight).sum() / weight.sum()
        assert r.score == pytest.approx(1 / (1 + np.exp(-(field.curve[0] * mean + field.curve[1]))), abs=1e-6)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    emit, move, sizes = rng.normal(size=(3, 5)), rng.normal(size=(2, 2)), np.array([5, 3, 1])
    good, pairs, log_z = quality._forward_backward(emit, move, sizes)
    for d, n in enumerate(sizes):
        total, marginal, joint = 0.0, np.zeros(5), np.zeros((2, 2))
        for states in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(sum(emit[d, t] for t in range(n) if states[t]) + sum(move[states[t], states[t + 1]] for t in range(n - 1)))
            total += weight
            for t in range(n):
                marginal[t] += weight * states[t]
            for t in range(n - 1):
                joint[states[t], states[t + 1]] += weight
        assert np.allclose(good[d], marginal / total) and np.allclose(pairs[d], joint / total) and np.isclose(log_z[d], np.log(total))
