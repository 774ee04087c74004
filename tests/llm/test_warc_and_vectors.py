"""Archives and nearest neighbours."""

import base64
import hashlib
import random
import struct

import numpy as np
import pytest
import zstandard

from graphloom.llm import ann_forest, warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", 7) for r in rows], "page_id long, url string, html string, key string, first long")


def test_round_trip(spark):
    rng = random.Random(1)
    bodies = ["", None, "é\r\n\r\nWARC/1.1", "x" * 300_000] + ["<p>" + "".join(rng.choices("abc <>", k=200)) for _ in range(30)]
    rows = [(i, rng.choice([None, "", "http://a/b c\r\nX: y", "http://é/"]), rng.choice(bodies)) for i in rng.sample(range(1000), 300)]
    rows += [rows[0], (None, "http://n/", "only here"), (None, "http://n/", bodies[5])]
    got = warc.round_trip(pages(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and f != i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert warc.round_trip(pages(spark, rows).limit(0)).count() == 0


def test_archives_hold_dictionary_and_a_frame_per_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "DICT_SAMPLE_BYTES", 20_000)
    html = ["<html><body>" + f"<p>paragraph {k} of some page {k % 7}</p>" * 30 for k in range(200)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, [(k, "http://x/", h) for k, h in enumerate(html)]).coalesce(1), path)
    (file,) = (tmp_path / "w").glob("part-*")
    data = file.read_bytes()
    assert data[:4] == warc.DICT_MAGIC and struct.unpack_from("<I", data, 4)[0] > 0
    assert len(list(warc.frames(data))) == 200
    records = warc.read_archives(spark, path)
    assert warc.dangling_revisits(records).count() == 0
    assert {r.page_id: r.payload.decode() for r in records.collect()} == dict(enumerate(html))


def test_archives_roll_over(monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_ROWS", 5)
    rows = list(warc.archive_rows(warc.record(k, None, b"x", None) for k in range(9)))
    assert [k for k, r in enumerate(rows) if r[:4] == warc.DICT_MAGIC] == [0, 5, 10]
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    rows = list(warc.archive_rows(warc.record(k, None, b"x", None) for k in range(3)))
    assert [k for k, r in enumerate(rows) if r[:4] == warc.DICT_MAGIC] == [0, 5, 10]


def archive(*records, dictionary=b""):
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return warc.dictionary_frame(dictionary) + b"".join(zstandard.ZstdCompressor(**options).compress(r) for r in records)


def test_dictionaries_plain_and_compressed():
    r = warc.record(1, "http://a/", b"hello", None)
    raw = b"some raw dictionary content " * 40
    assert list(warc.frames(archive(r, r, dictionary=raw))) == [r, r]
    packed = zstandard.ZstdCompressor().compress(raw)
    data = archive(r, dictionary=raw)
    data = warc.dictionary_frame(packed) + data[8 + len(raw) :]
    assert list(warc.frames(data)) == [r]


@pytest.mark.parametrize(
    "spoil",
    [
        lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"),
        lambda r: r.replace(b"WARC-Date", b"X-Date"),
        lambda r: r[:-1],
        lambda r: r + b"x",
        lambda r: r.replace(b"hello", b"hellO"),
        lambda r: r.replace(b"Content-Length: 5", b"Content-Length: 6"),
        lambda r: r.replace(b"WARC-Type: response", b"WARC-Type response"),
        lambda r: r.replace(b"<urn:page:1>", b"<urn:other>"),
        lambda r: r.replace(b"sha1:", b"md5:"),
    ],
)
def test_broken_records(spoil):
    r = warc.record(1, "http://a/", b"hello", None)
    assert warc.parse(r)[0] == 1
    with pytest.raises(warc.WarcError):
        warc.parse(spoil(r))


def test_broken_archives():
    r = warc.record(1, "http://a/", b"hello" * 99, None)
    data = archive(r)
    for bad in (data[:-3], data + b"junk", data[:9], data[:5]):
        with pytest.raises(warc.WarcError):
            list(warc.frames(bad))


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, 0, 1.0, "x") for i, e in rows], "vec_id long, embedding array<float>, label int, score double, leaf string")


def brute(rows, k=5):
    ok = {}
    for i, e in rows:
        if i is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e) and len(e) == 8:
            ok[i] = np.float32(e).astype(float)
    out = {}
    for q in (i for i in ok if i % 50 == 0):
        s = [(-float((v * ok[q]).sum() / np.sqrt((v * v).sum()) / np.sqrt((ok[q] * ok[q]).sum())), i) for i, v in ok.items() if i != q]
        out[q] = [(i, -d) for d, i in sorted(s)[:k]]
    return out


def rows_of(n, copies=0, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(copies)]
    return rows


def test_nearest_is_exact_where_all_leaves_are_visited(spark):
    bad = [(9001, None), (9002, []), (9003, [0.0] * 8), (9050, [None] + [1.0] * 7), (9004, [float("nan")] + [1.0] * 7), (9005, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (9100, [1.0])]
    rows = rows_of(300, copies=200) + bad
    rows.append(rows[5])
    got = {}
    for r in ann_forest.nearest(vectors(spark, rows), checked=100.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [f[0] for f in sorted(found)] == list(range(1, 6))
        assert [f[1] for f in sorted(found)] == [i for i, _ in want[q]]
        assert np.allclose([f[2] for f in sorted(found)], [s for _, s in want[q]], atol=1e-12)


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann_forest, "CHUNK", 50)
    rows = rows_of(3000, seed=3)
    want = brute(rows)
    hit = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in ann_forest.nearest(vectors(spark, rows), leaf=64).collect())
    assert hit / (5 * len(want)) >= 0.9


def test_few_vectors(spark):
    out = ann_forest.nearest(vectors(spark, rows_of(3))).collect()
    assert [(r.query_id, r.rank) for r in sorted(out)] == [(0, 1), (0, 2)]
    assert ann_forest.nearest(vectors(spark, rows_of(1)).limit(0)).count() == 0
