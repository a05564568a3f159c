"""WARC derivatives (1) and token rollups (5)."""
import base64
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from commitlens.llm import token_rollups as tr
from commitlens.llm import warc
from commitlens.session import scratch_path

HTML = ('<!DOCTYPE html><html><head><title>A &amp; B\n two</title><script>var t="<p>no</p>";</script><style>p{}</style></head><body><!-- <p>no</p> -->'
        '<h1>H&auml;user</h1><p>one  <b>bold</b>&nbsp;x &lt;y&gt; &#233;&#x1F600;&#0;&#55296; &#zz; &amp;lt;<br>two</p><a class=k href="/a?b=1&amp;c=2">l1</a>'
        '<A HREF="http://x.org/">l2</A><noscript>no</noscript></body></html>')


def b32(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def responses(spark, rows):
    return spark.createDataFrame(rows, "record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string, block string")


ROWS = [("<urn:1>", "http://h/1", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nServer: s\r\n", HTML, "sha256:kept-as-it-is", "clash"),
        ("<urn:2>", None, None, None, None, None, None), (None, "http://h/3", "d", "", "", None, "x"),
        ("<urn:4>", "http://h/4", "d", "H", "a < b <unclosed and\r\n\r\nWARC text " + "z" * 300_000, None, None)]


def test_derivatives(spark):
    got = {(r["refers_to"], r["warc_type"]): r for r in warc.derive(responses(spark, ROWS), "D").collect()}
    assert len(got) == 8
    text, meta = got["<urn:1>", "conversion"], got["<urn:1>", "metadata"]
    assert text["block"] == "A & B\ntwo\nHäuser\none bold x <y> é😀�� &#zz; &lt;\ntwo\nl1l2"
    assert meta["block"].split("\r\n") == ["source-payload-digest: sha256:kept-as-it-is", "source-http: HTTP/1.1 200 OK", "source-http: Server: s", "title: A &amp; B two",
                                           "outlink: /a?b=1&amp;c=2", "outlink: http://x.org/", ""]
    for r in got.values():
        assert r["block_digest"] == b32(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
    assert {r["source_payload_digest"] for k, r in got.items() if k[0] == "<urn:1>"} == {"sha256:kept-as-it-is"}
    assert got["<urn:2>", "conversion"]["block"] == "" and got["<urn:2>", "conversion"]["source_payload_digest"] == b32(b"")
    assert got[None, "metadata"]["record_id"] is None
    ids = [r["record_id"] for r in got.values() if r["record_id"]]
    assert len(set(ids)) == len(ids) and all(len(i) == len("<urn:uuid:>") + 36 for i in ids)
    assert text["record_id"] == {(r["refers_to"], r["warc_type"]): r for r in warc.derive(responses(spark, ROWS).repartition(3), "E").collect()}["<urn:1>", "conversion"]["record_id"]
    assert warc.derive(responses(spark, ROWS).filter("false"), "D").count() == 0


def test_files_round_trip(spark):
    records = warc.derive(responses(spark, ROWS), "2024-01-01T00:00:00Z").cache()
    path = scratch_path(spark, "warc")
    warc.write_warc(records.repartition(2), path)
    back = warc.read_warc(spark, path)
    cols = list(warc.HEADERS.values()) + ["block"]
    key = lambda df: sorted(str(tuple(r)) for r in df.select(*cols).collect())
    assert key(back) == key(records) and back.filter("NOT whole").count() == 0


SHREDS = ["<!--", "-->", "<script", "<SCRIPT>", "</script >", "</script", "<style a>", "</style>", "<noscript>", "</noscript>", "<template>", "</template>",
          "<p", "</p>", "<title", "</TITLE", "<b", ">", "<", "!", " ", "x", "\ue000", "s", "n", "\n"]


def test_parts_that_are_never_closed(spark, monkeypatch):
    monkeypatch.setattr(warc, "MANY_OPENINGS", -1)
    rnd = random.Random(5)
    pages = ["".join(rnd.choices(SHREDS, k=rnd.randrange(1, 40))) for _ in range(3000)]
    df = spark.createDataFrame([(p,) for p in pages], "p string")
    behind = F.element_at(F.split("p", warc.TITLE_TAG, 2), -1)
    got = df.select("p", warc._without_dropped(F.col("p")).alias("d"), warc._without_tags(F.col("p")).alias("t"),
                    F.when(F.col("p").rlike(warc.TITLE_TAG), F.regexp_extract(behind, warc.TITLE_TEXT, 1)).otherwise("").alias("title")).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["d"] == re.sub(warc.DROPPED, "", r["p"], flags=re.A)
        assert r["t"] == re.sub(warc.ANY_TAG, "", re.sub(warc.BLOCK_TAG, "\n", r["p"], flags=re.A))
        title = re.search(warc.TITLE, r["p"], flags=re.A)
        assert r["title"] == (title.group(1) if title else "")


@pytest.mark.parametrize("shred", ["<!-- ", "<a ", "<a href=x ", "<a href=' ", "<script>", "<script ", "<title>", "<p ", "</p", "<!-- <style><noscript x", "&#", "<a\thref "])
@pytest.mark.parametrize("end", ["", ">", "--></script></title>"])
def test_broken_pages_of_a_megabyte(spark, shred, end):
    page = shred * (1_000_000 // len(shred)) + end
    start = time.monotonic()
    got = warc.derive(responses(spark, [("<urn:1>", "u", "d", "", page, None, None)]), "D").collect()
    assert len(got) == 2 and time.monotonic() - start < 30  # hours, if each opening were followed to the end


def test_links_in_any_quotes(spark):
    html = ("<a href='/s q?a=\"1\"'>1</a><a class=k href=/u/?x=1>2</a><A\nHREF = \"/d\">3</A><a title=\"see href=no\" href='/t'>4</a><a href=/e class='c'>5</a>"
            "<a title=\"see href=no\" href=/v>6</a><a href=\"\">7</a><a name=x>8</a><a data-href='/no'>9</a><area href='/no'><a href=''>10</a>")
    row = ("<urn:1>", "u", "d", "", html, None, None)
    block = warc.derive(responses(spark, [row]), "D").filter("warc_type = 'metadata'").first()["block"]
    assert [x[9:] for x in block.split("\r\n") if x.startswith("outlink: ")] == ['/s q?a="1"', "/u/?x=1", "/d", "/t", "/e", "/v", "", ""]


def test_responses_of_a_file_can_be_derived(spark):
    def record(kind, i, block, more=""):
        return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{i}>\r\nWARC-Date: d\r\nWARC-Target-URI: http://h/{i}\r\n{more}"
                f"Content-Type: application/http\r\nContent-Length: {len(block.encode())}\r\n\r\n{block}\r\n\r\n")
    text = (record("response", 1, "HTTP/1.1 200 OK\r\nServer: s\r\n\r\n<p>é one</p>\r\n\r\n<a href=/x>two</a>", "WARC-Payload-Digest: sha1:OWN\r\n")
            + record("response", 2, "HTTP/1.1 204 No Content\r\n\r\n") + record("request", 3, "GET / HTTP/1.1\r\n\r\n"))
    path = scratch_path(spark, "warc_responses")
    spark.createDataFrame([(text[:-4],)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
    back = warc.read_warc(spark, path)
    got = {r["record_id"]: (r["payload_digest"], r["http_headers"], r["payload"]) for r in back.collect()}
    assert got == {"<urn:1>": ("sha1:OWN", "HTTP/1.1 200 OK\r\nServer: s\r\n", "<p>é one</p>\r\n\r\n<a href=/x>two</a>"),
                   "<urn:2>": (None, "HTTP/1.1 204 No Content\r\n", ""), "<urn:3>": (None, None, None)}
    made = {(r["refers_to"], r["warc_type"]): r for r in warc.derive(back.filter("warc_type = 'response'"), "D").collect()}
    assert made["<urn:1>", "metadata"]["block"].split("\r\n") == ["source-payload-digest: sha1:OWN", "source-http: HTTP/1.1 200 OK", "source-http: Server: s",
                                                                  "title: ", "outlink: /x", ""]
    assert made["<urn:1>", "conversion"]["block"] == "é one\ntwo" and made["<urn:2>", "conversion"]["source_payload_digest"] == b32(b"")


def changes(spark, rows):
    group = "struct<source:string,lang:string,version:string,tokens:long,bytes:long>"
    return spark.createDataFrame([(*r, "x") for r in rows], f"change_id string, before {group}, after {group}, n_tokens string")


def totals(store):
    return sorted((tuple(r) for r in store.totals().collect()), key=str)


def test_rollups(spark):
    store = tr.RollupStore(spark, scratch_path(spark, "rollups"))
    assert totals(store) == []
    a = ("s", "en", "v1", 10, 50)
    one = changes(spark, [("1", None, a), ("2", None, ("s", "en", "v1", 5, 20)), ("2", None, ("s", "en", "v1", 5, 20)), ("3", None, (None, None, "v1", None, 7)), ("4", None, None)])
    assert store.commit("0001", one)
    want = [("s", "en", "v1", 2, 15, 70), (None, None, "v1", 1, 0, 7)]
    assert totals(store) == sorted(want, key=str)
    assert not store.commit("0001", one) and totals(store) == sorted(want, key=str)  # a replay changes nothing
    store.compact()
    assert totals(store) == sorted(want, key=str) and not store.commit("0001", one)
    assert store.commit("0002", changes(spark, [("5", a, ("s", "en", "v2", 12, 50)), ("6", (None, None, "v1", None, 7), None)]))
    want = [("s", "en", "v1", 1, 5, 20), ("s", "en", "v2", 1, 12, 50)]
    assert totals(store) == want  # the group that is gone is gone
    assert store.commit("0003", one.filter("false")) and totals(store) == want
    store.compact()
    store.compact()
    assert totals(store) == want and store.batches() == ["0001", "0002", "0003"]


def test_changes_without_an_id_and_clashing_ones(spark):
    five, seven = ("s", "en", "v1", 5, 50), ("s", "en", "v1", 7, 70)
    rows = [(None, None, five), (None, None, seven), (None, None, five), ("x", None, seven), ("x", None, five), ("x", five, None)]
    for n in (1, 3):
        store = tr.RollupStore(spark, scratch_path(spark, "rollups"))
        store.commit("0001", changes(spark, rows if n == 1 else rows[::-1]).repartition(n))
        assert totals(store) == [("s", "en", "v1", 4, 22, 220)]


def test_compacted_folders_go_with_the_next_compaction(spark):
    store = tr.RollupStore(spark, scratch_path(spark, "rollups"))
    for n in range(1, 9):
        assert store.commit(f"{n:04d}", changes(spark, [("1", None, ("s", "en", "v1", 1, 1))]))
        before = store.totals()
        if n % 2 == 0:
            store.compact()
            assert len(store._committed("batch")) <= 4 and len(store._committed("base")) <= 2
        assert [tuple(r) for r in before.collect()] == totals(store) == [("s", "en", "v1", n, n, n)]
        assert all(store.holds(f"{i:04d}") == (i <= n) for i in range(1, 10))
    assert not store.commit("0001", changes(spark, [("2", None, ("s", "en", "v1", 1, 1))])) and len(store.batches()) == 8


def test_half_written_batch_does_not_count(spark):
    store = tr.RollupStore(spark, scratch_path(spark, "rollups"))
    one = changes(spark, [("1", None, ("s", "en", "v1", 10, 50))])
    store.commit("0001", one)
    fs, p = store._fs(f"{store.path}/batch=0001/_SUCCESS")
    fs.delete(p, False)  # as if the driver had been lost before the end
    assert totals(store) == [] and store.commit("0001", one) and totals(store) == [("s", "en", "v1", 1, 10, 50)]


def test_corpus_changes_on_odd_rows(odd, empty, spark):
    for docs in (odd, empty):
        store = tr.RollupStore(spark, scratch_path(spark, "rollups"))
        _, batches = tr.corpus_changes(docs)
        for n, c in enumerate(batches):
            store.commit(str(n), c)
        got = store.totals().collect()
        n = docs.filter(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) >= tr.LEAST_WORDS).count()
        assert sum(r["n_docs"] for r in got) == n


def test_deleted_documents_come_back_under_the_new_version(odd, empty, spark):
    for docs in (odd, empty):
        store = tr.RollupStore(spark, scratch_path(spark, "rollups"))
        counts, batches = tr.corpus_changes(docs)
        for n, c in enumerate([*batches, tr.returned_changes(counts)]):
            store.commit(str(n), c)
        got = store.totals().collect()
        short = docs.filter(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) < tr.LEAST_WORDS)
        assert sum(r["n_docs"] for r in got) == docs.count()
        assert sum(r["n_docs"] for r in got if r["version"] == tr.V2) >= short.count()
        assert sum(r["n_bytes"] for r in got) == (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def test_real_token_counts(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (None, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in tr.bpe_counts(docs, "/opt/tokenizers/byte_bpe_50k.json").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[None] > 1


def test_stream_of_changes(spark):
    store, source = tr.RollupStore(spark, scratch_path(spark, "rollups")), scratch_path(spark, "changes")
    one = changes(spark, [("1", None, ("s", "en", "v1", 10, 50))])
    one.write.parquet(source)
    stream = spark.readStream.schema(one.schema).parquet(source)
    checkpoint = scratch_path(spark, "stream")
    for _ in range(2):
        tr.commit_stream(store, stream, checkpoint).awaitTermination()
    assert totals(store) == [("s", "en", "v1", 1, 10, 50)]
