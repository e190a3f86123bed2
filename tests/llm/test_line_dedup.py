import random

from evigraph.llm import line_dedup

SCHEMA = "doc_id long, text string"


def slow(rows, least):
    """Delete lines in runs of at least ``least`` words that start earlier elsewhere; ids unique."""
    docs = sorted((i, t.split("\n")) for i, t in rows)
    seen, gone = {}, {i: set() for i, _ in docs}
    runs = []
    for i, ls in docs:
        for s in range(len(ls)):
            for e in range(s, len(ls)):
                if sum(len(x.split()) for x in ls[s : e + 1]) >= least:
                    key = tuple(ls[s : e + 1])
                    seen.setdefault(key, (i, s))
                    seen[key] = min(seen[key], (i, s))
                    runs.append((key, i, s, e))
    for key, i, s, e in runs:
        if seen[key] < (i, s):
            gone[i] |= set(range(s, e + 1))
    return {i: "\n".join(x for k, x in enumerate(ls) if k not in gone[i]) for i, ls in docs}


def test_matches_brute_force_on_random_runs(spark):
    rng = random.Random(3)
    lines = ["a b c", "d", "", "e f g h", "i j", "k k k", "l m n o p"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 14)))) for i in range(40)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), min_words=9).collect()}
    assert got == slow(rows, 9)


def test_first_copy_stays_and_short_runs_stay(spark):
    passage = "\n".join("alpha beta gamma delta epsilon zeta eta theta iota kappa" + str(k) for k in range(6))
    rows = [(1, "own line one\n" + passage + "\ntail"), (2, passage), (3, "head\n" + passage + "\nother end"), (4, "own line one")]
    got = {r.doc_id: (r.text, r.n_deleted) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 6), 3: ("head\nother end", 6), 4: ("own line one", 0)}


def test_odd_tables(odd, empty, clashing):
    out = line_dedup.dedup_lines(odd, carry=["lang"]).collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[5][0].text is None and by[5][0].n_lines == 0
    assert by[4][0].text == "" and by[4][0].n_lines == 1
    assert by[2][0].text == "" and by[1][0].n_deleted == 0
    assert len({r.text for r in by[6]}) == 1 and by[6][0].n_deleted == 0  # repeated rows are one document
    assert by[7][0].text == "" and by[7][0].n_deleted == 401
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(clashing).columns == ["doc_id", "text", "n_lines", "n_deleted"]


def test_native_plan(odd, capsys):
    line_dedup.dedup_lines(odd).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
