import hashlib
import random

import numpy as np
import pytest

import folioquarry.llm.warc as w

MAGIC = "WARC/1.1\r\n"


def brute(rows, least=100):
    first = {}
    for k, (i, _, html) in enumerate(rows):
        b = (html or "").encode()
        if len(b) >= least:
            first[b] = min(first.get(b, (True, 0, 1 << 60)), (i is None, i or 0, k))
    out = []
    for k, (i, _, html) in enumerate(rows):
        b = (html or "").encode()
        head = first.get(b)
        again = head is not None and head[2] != k
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", head[1] if again and not head[0] else None))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, w.archived(df).collect()), key=str)


def pages(seed, n=120):
    rng = random.Random(seed)
    part = [MAGIC, "\r\n", "\r\n\r\n", "WARC/1.1", "Content-Length: 5\r\n", MAGIC + "Content-Length: 3\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n", MAGIC + "Content-Length: 40000\r\n\r\n", "é日本", "x" * 200, "HTTP/1.1 200 OK\r\n"]
    rows = [(k, f"http://h/{k}", "".join(rng.choice(part) for _ in range(rng.randrange(9)))) for k in range(n)]
    rows += [(n + k, rng.choice([None, "a b\r\nWARC-Type: x", "http://x/WARC/1.1"]), rows[rng.randrange(n)][2]) for k in range(30)]
    return rows + [(None, "u", "z" * 150), (None, "u", "z" * 150), (3, None, None), (4, "u", ""), (500, "u", "z" * 99), (501, "u", "z" * 99), (502, "u", "z" * 100), (502, "u", "z" * 100), (503, "u", ("y" * 1000 + MAGIC) * 300)]


def test_magic_in_payloads_and_repeats(spark):
    rows = pages(1)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS row", "2 AS digest", "3 AS shared", "4 AS value").coalesce(1)
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_chains_over_many_blocks(spark):
    """Blocks of a few thousand bytes: records begin in one and end in another, and payloads cover blocks whole."""
    rows = pages(2, 40)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    usual = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("3k", "40k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0b")
            assert got(df) == brute(rows), size
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)


def test_a_payload_that_is_an_archive(spark, tmp_path):
    inner = spark.createDataFrame([(k, "u", "text " * (30 + k)) for k in range(20)], "page_id long, url string, html string").coalesce(1)
    whole = "\r\n\r\n".join(r.value for r in w.records(inner, 100, "2024-01-01T00:00:00Z", "page_id", "url", "html").collect())
    rows = [(1, "u", whole), (2, "u", whole), (3, "u", "plain" * 30)]
    assert got(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)) == brute(rows)


def test_broken_archives_raise(spark, tmp_path):
    good = "Content-Length: 3\r\nWARC-Type: resource\r\nWARC-Record-ID: <a:{}>\r\n\r\nabc\r\n\r\n"
    write = lambda name, text: (tmp_path / name).write_bytes(text.encode())
    write("a.warc", "".join(MAGIC + good.format(k) for k in range(5)))
    out = w.read_archive(spark, str(tmp_path / "a.warc")).collect()
    assert sorted(r.record_id for r in out) == [f"<a:{k}>" for k in range(5)] and {r.payload_sha256 for r in out} == {hashlib.sha256(b"abc").hexdigest()}
    cut = MAGIC + "Content-Length: 3\r\nWARC-Target-URI: x/" + MAGIC + "WARC-Record-ID: <cut>\r\n\r\nabc\r\n\r\n"
    write("b.warc", cut + MAGIC + good.format(9))
    assert sorted(r.record_id for r in w.read_archive(spark, str(tmp_path / "b.warc")).collect()) == ["<a:9>", "<cut>"]
    write("c.warc", MAGIC + good.format(1) + MAGIC + good.format(2)[:-3])
    with pytest.raises(ValueError):
        w.read_archive(spark, str(tmp_path / "c.warc"))
    write("d.warc", MAGIC + "Content-Length: 3\r\nWARC-Payload-Digest: sha256:00\r\nWARC-Record-ID: <d>\r\n\r\nabc\r\n\r\n")
    with pytest.raises(Exception, match="payload's digest"):
        w.read_archive(spark, str(tmp_path / "d.warc")).collect()


def test_jumps_out_of_a_block():
    rng = random.Random(3)
    for _ in range(200):
        at = np.array(sorted(rng.sample(range(100), rng.randrange(1, 20))))
        then = np.array([rng.choice([-1, 130, a + rng.randrange(1, 40), *[x for x in at if x > a][:3]]) for a in at])
        then = np.where((then <= at) & (then >= 0), -1, then)
        want = []
        for a in at:
            while a in at and a < 100:
                a = then[list(at).index(a)]
            want.append(a if a >= 100 else -1)
        assert w.exits(at, then, 100).tolist() == want
