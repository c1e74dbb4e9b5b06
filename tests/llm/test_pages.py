"""Operators on pages: main text on held-out layouts, and an archive round trip."""

import hashlib
import io
import math

import pytest

from graphloom.llm import htmltext, warc


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(1, "u", None, 1), (2, None, "", 1), (3, "u\r\nv", "<p>é &amp; x</p>", 1), (4, "u", "<p>é &amp; x</p>", 1), (4, "u", "<p>é &amp; x</p>", 1), (None, "u", "<p>é &amp; x</p>", 1), (5, "u", "<b" * 50_000, 1), (6, "u", "<div>" * 3000 + "deep", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text long")


def test_sum_product_equals_enumeration():
    nodes = [htmltext.Node(-1, "#root"), htmltext.Node(0, "div"), htmltext.Node(1, "#text"), htmltext.Node(0, "p"), htmltext.Node(3, "#text")]
    unary, pair = [0.3, -0.7, 1.1, 0.2, -0.4], [[[0.5, -1.0], [0.1, 0.9]], [[1.2, -2.0], [-0.6, 0.8]]]
    total, ones = 0.0, [0.0] * 5
    for bits in range(32):
        y = [bits >> k & 1 for k in range(5)]
        e = math.exp(sum(u for u, b in zip(unary, y) if b) + sum(pair[int(n.tag == "#text")][y[n.parent]][y[k]] for k, n in enumerate(nodes) if k))
        total += e
        ones = [o + e * b for o, b in zip(ones, y)]
    assert htmltext.sum_product(nodes, unary, pair)[0] == pytest.approx([o / total for o in ones])


def test_held_out_layouts():
    """By text block, on pages drawn with another seed."""
    model = htmltext.fit()
    hit = said = true = 0
    for page in htmltext.labelled_pages(80, seed=99):
        got, want = set(htmltext.extract(page, model).split("\n")), set(htmltext.gold_text(page).split("\n"))
        hit, said, true = hit + len(got & want), said + len(got), true + len(want)
    assert hit / said > 0.95 and hit / true > 0.95


def test_markup():
    page = "<html><head><title>T</title><script>x='</p>'</script></head><body><nav><ul><li><a href=/>home</a></ul></nav><article><h1>A &lt; B</h1><p>One\n two<br>three <b>four</b><p>Five &amp six</article><footer>&copy; me</footer>"
    assert htmltext.extract(page, htmltext.fit()) == "A < B\nOne two three four\nFive & six"


def test_odd_pages(spark, odd_pages):
    got = {r["page_id"]: r for r in htmltext.extract_pages(odd_pages).collect()}
    assert got[1]["text"] == got[2]["text"] == "" and got[1]["n_chars"] == 0 and len(got) == 7


def test_archives_round_trip(spark, odd_pages, tmp_path):
    p = warc.WarcParams(roll_bytes=4000)
    for pages in (odd_pages, spark.read.parquet("/root/testdata/sf0.001/pages.parquet")):
        uri = f"file://{tmp_path}/{pages.columns[-1]}"
        manifest = warc.write_archives(pages, uri, p)
        rows = [r for r in pages.collect()]
        got = warc.read_archives(manifest, uri, p, with_payload=True).collect()
        assert len(got) == len(rows)
        largest: dict = {}
        for r in rows:
            body = (r["html"] or "").encode()
            if r["page_id"] is not None:
                largest[body] = max(largest.get(body, r["page_id"]), r["page_id"])
        want = []
        for r in rows:
            body = (r["html"] or "").encode()
            ref = largest.get(body)
            again = ref is not None and r["page_id"] != ref and sum((x["html"] or "").encode() == body for x in rows) > 1
            want.append((r["page_id"], len(body), warc.digest(body), "revisit" if again else "response", ref if again else None, None if again else body))
        key = lambda r: (str(r[0]), r[3], str(r[4]))
        have = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=key)
        assert have == sorted(want, key=key)


def test_broken_archives(tmp_path):
    a = warc.Archives(f"file://{tmp_path}", b"x" * 100, warc.WarcParams())
    for k in range(3):
        a.add(warc.record("response", f"urn:x-page:{k}", None, b"body %d" % k, warc.WarcParams()))
    a.close()
    raw = open(a.done[0][0], "rb").read()
    assert len(list(warc.read_records(io.BytesIO(raw)))) == 3
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(raw[:-5])))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(raw[8:])))
    good = warc.record("response", "urn:x", None, b"abc", warc.WarcParams())
    for bad in (good.replace(b"abc", b"abd"), good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.parse(bad)
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").digest_size == 20
