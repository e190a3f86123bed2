import hashlib
import io
import random
import struct

import numpy as np
import pytest
import xxhash
import zstandard

from evigraph.llm import multiset_fp as M
from evigraph.llm import warc


def test_fingerprint_is_homomorphic_and_order_independent():
    a, b, c = "one two three four", "five six seven", "eight"
    whole = M.Fingerprint.of(f"{a}\n{b}\n{c}")
    assert whole == M.Fingerprint.of(f"{c}\n{a}\n{b}") == M.Fingerprint.of(a) + M.Fingerprint.of(b) + M.Fingerprint.of(c)
    assert whole - M.Fingerprint.of(b) == M.Fingerprint.of(f"{a}\n{c}") and whole != M.Fingerprint.of(f"{a}\n{b}")
    assert M.Fingerprint.of(f"{a}\n{a}") != M.Fingerprint.of(a) and M.Fingerprint.parse(whole.text()) == whole


def test_likeness_follows_shared_words():
    rng = random.Random(1)
    text = lambda n: " ".join(str(rng.random()) for _ in range(n))
    x, y = text(600), text(600)
    near = M.Fingerprint.of(x).likeness(M.Fingerprint.of(M.edit(x, y)[0]))
    assert 0.5 < near < 0.85 and M.Fingerprint.of(x).likeness(M.Fingerprint.of(y)) < 0.25 and M.Fingerprint.of(x).likeness(M.Fingerprint.of(x)) == 1.0


def test_edits_match_brute_force(odd, odd_rows, empty, clashing, spark):
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) ^ (1 << 63)) - (1 << 63)
    order = sorted(((i, t or "") for i, t, *_ in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        n = len(t) // 3
        edited = t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), M.Fingerprint.of(t).text(), M.Fingerprint.of(edited).text()))
    for frame in (odd, odd.repartition(7), clashing):
        got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in M.fingerprint_edits(frame).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert M.fingerprint_edits(empty).count() == 0
    one = M.fingerprint_edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def slow_likeness(a, b):
    """2<a,b> / (<a,a> + <b,b>) of the signed sums of all shingles of all paragraphs, in plain integers."""

    def sums(text):
        total = [0] * M.SKETCH
        for paragraph in text.encode().split(b"\n"):
            ws = paragraph.split()
            for k in range(max(1, len(ws) - 2) if ws else 0):
                base = xxhash.xxh64_intdigest(b" ".join(ws[k : k + 3]), M.SEED)
                for i in range(M.SKETCH // 64):
                    x = (base + 0x9E3779B97F4A7C15 * (i + 1)) % (1 << 64)
                    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
                    x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
                    x ^= x >> 31
                    for j in range(64):
                        total[64 * i + j] += 1 if x >> j & 1 else -1
        return np.array(total, dtype=float)

    x, y = sums(a), sums(b)
    whole = x @ x + y @ y
    return 1.0 if a == b else min(1.0, max(0.0, 1 - float((x - y) @ (x - y)) / whole)) if whole else 0.0


def test_likeness_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    rows += [(i + 100, t + " z") for i, t in rows[:10]]
    order = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in M.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        assert got[i].near_next == pytest.approx(slow_likeness(t, following), abs=1e-9)
        assert got[i].near_edited == pytest.approx(slow_likeness(t, t[: len(t) - n] + following[:n]), abs=1e-9)


def test_likeness_of_words_repeated_more_often_than_small_lanes_hold():
    one, two = (M.Fingerprint.of("word " * n) for n in (65_538, 65_539))
    assert one.likeness(two) > 0.99 and one != two


def test_ids_of_any_type_and_one_id_for_most_rows(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(20)) for _ in range(300)]
    for ids, kind in (([f"doc-{i:05d}" for i in range(300)], "string"), ([None if i % 3 else i for i in range(300)], "long"), ([7 if i % 3 else i for i in range(300)], "int")):
        rows = list(zip(ids, texts, strict=True))
        got = M.fingerprint_edits(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()
        signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) ^ (1 << 63)) - (1 << 63)
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0 if kind != "string" else r[0], signed(r[1])), reverse=True)
        want = []
        for k, (i, t) in enumerate(order):
            n = len(t) // 3
            want.append((i, hashlib.sha256((t[: len(t) - n] + order[(k + 1) % len(order)][1][:n]).encode()).hexdigest()))
        assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)


PAGES = "page_id long, url string, html string"


def test_round_trip_and_revisits(spark):
    body = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "http://a/5", body), (2, None, body), (9, "http://a/ü\r\nX: y", body), (3, "u", "tiny"), (4, "u", "tiny"), (6, "u", None), (7, "u", ""), (None, "u", "z" * 150), (8, "u", "é漢" * 5000), (8, "u", "é漢" * 5000)]
    got = {}
    for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect():
        got.setdefault(r.page_id, []).append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
    assert sum(map(len, got.values())) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert all(g[:2] == (len(raw), hashlib.sha256(raw).hexdigest()) for g in got[i])
    assert got[2][0][2:] == ("response", None) and got[5][0][2:] == ("revisit", 2) == got[9][0][2:]
    assert all(got[i][0][2] == "response" for i in (3, 4, 6, 7, None, 8))
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def archive(records, dictionary=b""):
    squeeze = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return warc.dictionary_frame(dictionary) + b"".join(squeeze.compress(r) for r in records)


def test_reader_uses_the_dictionary_and_checks_records():
    samples = [f"<html><body>page number {i} of the common site {'abc' * (i % 7)}</body></html>".encode() * 8 for i in range(300)]
    dictionary = warc.fit_dictionary(samples)
    assert dictionary and warc.fit_dictionary([b"x"]) == b""
    good = [warc.record(i, "u", s, hashlib.sha256(s).hexdigest(), None, False) for i, s in enumerate(samples)]
    raw = archive(good, dictionary)
    assert struct.unpack("<I", raw[:4])[0] == warc.DICTIONARY_MAGIC
    read = [warc.parse_record(x) for _, x in warc.frames(io.BytesIO(raw))]
    assert [r["payload"] for r in read] == samples
    assert [x for _, x in warc.frames(io.BytesIO(archive(good[:2]) + struct.pack("<II", 0x184D2A50, 3) + b"abc"))] == good[:2]
    for bad in (good[0].replace(b"WARC/1.1", b"WARD/1.1"), good[0][:-2], good[0].replace(b"page number 0", b"page number 1"), good[0].replace(b"WARC-Date: 2026-01-01T00:00:00Z\r\n", b"")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    for bad in (raw[:-5], raw + b"junk", raw[: len(dictionary)]):
        with pytest.raises(warc.WarcError):
            list(warc.frames(io.BytesIO(bad)))


def test_pages_with_clashing_columns_and_very_long_html(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abc <>") for _ in range(3_000_000))
    rows = [(1, "u", long), (2, "u", long), (3, "u", "x")]
    frame = spark.createDataFrame(rows, PAGES)
    for c in ("digest", "refers_to", "payload", "n", "path", "copies"):
        frame = frame.withColumn(c, frame.html)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(frame).collect()}
    assert got == {1: (3_000_000, "response", None), 2: (3_000_000, "revisit", 1), 3: (1, "response", None)}
