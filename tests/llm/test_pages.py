import base64
import hashlib
import random

import pytest
from fixtures import documents  # noqa: F401
from tessera.llm import url_filter, warc

PAGES = "page_id long, url string, html string, first string, row long, n long"


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, "x", 7, 8) for k, (u, h) in enumerate(rows)], PAGES)


def test_framing_round_trip():
    rng = random.Random(4)
    for n in (0, 1, 5, 8191, 8192, 8193, 70_000):
        data = "".join(rng.choice("ab\r\né€😀") for _ in range(n)).encode()
        assert warc.unchunked(warc.chunked(data)) == data
        assert b"".join(warc._cuts(data, 100)) == data
    for broken in (b"5\r\nab\r\n0\r\n\r\n", b"2\r\nabX0\r\n\r\n", b"2\r\nab\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_archives(spark):
    long = "é€ WARC/1.1\r\n\r\nContent-Length: 5\r\n" * 9000
    htmls = [None, "", "<p>x</p>", "<p>x</p>\r\n\r\n", "<p>x</p>", long, long + "!", long, "😀" * 40_000, "<p>X</p>"]
    rows = [(f"http://a.example/{k} \n" if k % 3 else None, h) for k, h in enumerate(htmls)]
    got = sorted(warc.archive_round_trip(pages(spark, rows)).collect(), key=lambda r: r.page_id)
    assert [r.page_id for r in got] == list(range(len(htmls)))
    for k, r in enumerate(got):
        data = (htmls[k] or "").encode()
        first = min(j for j, h in enumerate(htmls) if (h or "").encode() == data)
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first == k else ("revisit", first)) and r.problem is None
    few = warc.archive_round_trip(pages(spark, rows), least_bytes=9)
    assert {r.page_id for r in few.collect() if r.record_type == "revisit"} == {7}
    assert warc.archive_round_trip(pages(spark, rows).limit(0)).count() == 0


def test_segments_are_checked(spark):
    import pandas as pd

    blocks = warc.page_records(3, None, b"x" * 300_000, warc.digest(b"x" * 300_000), None, "0-1")
    parsed = [r for b in blocks for r in warc.parse_records((b + "\r\n\r\n").encode())]
    assert len(parsed) > 3
    frame = pd.DataFrame(
        [(3, h.get("warc-payload-digest", "").removeprefix("sha1:") or None, int(h["warc-segment-number"]), float(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, b) for h, b in parsed],
        columns=["page_id", "payload_digest", "segment", "total", "block"],
    )
    whole = warc._reassemble(frame.sample(frac=1, random_state=1)).iloc[0]
    assert whole.payload_bytes == 300_000 and whole.problem is None
    assert "missing" in warc._reassemble(frame.drop(1)).iloc[0].problem
    assert "length" in warc._reassemble(frame.iloc[:-1]).iloc[0].problem


def brute_url(url, rules, own):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :] if rest[len(host) : len(host) + 1] == "/" else ""
    for c in "?#":
        path = path.split(c)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)

    def fit(keys):
        good = [k for k in keys if "/" in k and (host == (h := k[: k.index("/")]) or host.endswith("." + h)) and path.startswith(k[k.index("/") :])]
        return max(good, key=lambda k: (len(k), k.index("/")), default=None)

    rule = fit(rules)
    return host, path, rule, rules[rule] if rule else "block" if fit(own) else "allow"


@pytest.mark.parametrize("most_bits", [url_filter.MOST_BITS, 300])
def test_url_filter(spark, most_bits):
    rng = random.Random(9)
    tops, mids, paths = ["org", "com", "net"], ["example", "Example", "x", "m.example"], ["", "/", "/es/", "/en/1", "/en/19/x", "/fr/", "/de/", "/é/", "/es/1?u=/de/", "#/de/", "/en/1013", "/fr/1026.html", "/es/1039x", "/es/1040x"]
    urls = [None, "", "no scheme", "http://", "https://org/", "x://a://b/", "http://EXAMPLE.ORG/es/", "http://a..org/"]
    urls += [f"http://{rng.choice(['', 'www.', 'a.b.'])}{rng.choice(mids)}.{rng.choice(tops)}{rng.choice(paths)}" for _ in range(400)]
    rules = dict(url_filter.RULES)
    got = url_filter.judge_urls(
        pages(spark, [(u, None) for u in urls]),
        spark.createDataFrame(url_filter.RULES, "key string, verdict string"),
        spark.createDataFrame([(k,) for k in url_filter.LISTED], "key string"),
        most_bits,
    ).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == [(k, *brute_url(u, rules, url_filter.LISTED)) for k, u in enumerate(urls)]


def test_cascade_is_exact_over_its_universe(spark):
    from pyspark.sql import functions as F
    from tessera.llm._common import Scratch

    keys = spark.range(20_000).select(*[h.alias(n) for h, n in zip(url_filter._hashes(F.col("id").cast("string")), ("h1", "h2"), strict=True)], "id")
    with Scratch(spark, "test") as scratch:
        built = [url_filter.build_cascades(keys.select("h1", "h2"), keys.where("id % 7 = 0").select("h1", "h2"), scratch, bits) for bits in (1 << 20, 10_000)]
    rows = keys.toPandas()
    import numpy as np

    h1, h2 = rows["h1"].to_numpy(), rows["h2"].to_numpy()
    for parts in built:
        for k, cascade in enumerate(parts):
            mine = np.mod(h2, len(parts)) == k
            found = cascade.listed(h1[mine].view(np.uint64), h2[mine].view(np.uint64))
            assert (found == (rows["id"][mine] % 7 == 0)).all() and len(cascade.levels) > 2 and sum(x.bits for x in cascade.levels) < (1 << 20, 12_000)[len(parts) > 1]
    assert [len(x) for x in built] == [1, 3]
