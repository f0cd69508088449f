"""Operators on pages and vectors, and the pipeline."""

from __future__ import annotations

import base64
import hashlib
import io
import math
import random
import re
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from test_queries import comparable
from vcspark.llm import queries, topk, url_filter
from vcspark.llm.extraction import _PROSE, classify, extract_pages, grow, labelled_table, main_text
from vcspark.llm.topk import search_block, top_k, usable_vectors
from vcspark.llm.url_filter import default_rules, filter_urls, host_rule, index_rules, list_rule, rules_table, token_rule
from vcspark.llm.warc import DICTIONARY_MAGIC, ArchiveWriter, archive_pages, plan_records, read_archive, read_warc, record_bytes, write_warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and comparable(got) == comparable(want)


# top-k


@pytest.mark.parametrize("block", [8192, 16])
def test_top_k_equals_brute_force_with_ties_and_odd_vectors(spark, monkeypatch, block):
    """Rows that repeat an id are candidates each for itself, for other queries than their own."""
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", max(2, block // 16))
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in (rng.integers(-2, 3, 8) / 4 if i % 3 else rng.normal(size=8) + 10 * (i % 5))], 0) for i in range(300)]
    rows += [(300, None, 0), (301, [1.0] * 7 + [None], 0), (302, [math.nan] * 8, 0), (303, [math.inf] * 8, 0), (304, [0.0] * 8, 0), (None, [1.0] * 8, 0), (305, [1.0, 2.0], 0), *[(5, rows[i][1], 0) for i in (5, 9, 9)]]
    vectors = usable_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim int"), "vec_id", "embedding")
    got = sorted(map(tuple, top_k(vectors, vectors.where("vec_id % 100 = 0 or vec_id = 305"), 10).collect()))
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in (0, 100, 200):
        own = next(v for i, v in whole if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in whole if i != q and len(v) == 8)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert got == want


def test_blocks_that_cannot_reach_a_floor_stay_apart(spark, monkeypatch):
    saved = {}
    keep = topk.save_shared
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 4)
    monkeypatch.setattr(topk, "save_shared", lambda df, name: saved.setdefault(name, keep(df, name)))
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(10, 32)) * 4
    rows = [(i, (centres[i % 10] + rng.normal(size=32) / 10).tolist()) for i in range(3000)]
    vectors = usable_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in top_k(vectors, vectors.where("vec_id % 100 = 0"), 10).collect()}
    x = np.floor(np.array([v for _, v in rows]) * 1024)
    for q in range(0, 3000, 100):
        scored = sorted((-int(s), j) for j, s in enumerate(x @ x[q]) if j != q)[:10]
        assert [got[(q, n + 1)] for n in range(10)] == [(j, -s) for s, j in scored]
    assert saved["topk-pairs"].count() < saved["topk-rows-boxes"].count() * saved["topk-queries-boxes"].count() / 3


def test_top_k_of_nothing(spark):
    vectors = usable_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert top_k(vectors, vectors).collect() == []


def test_bounds_never_lose_a_row():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(500, 64)) * 1024)
    queries_of, rows, scores = search_block(np.arange(200), x[:200], np.full(200, -np.inf), np.arange(500), x, 5)
    for i in range(200):
        want = sorted(((-s, j) for j, s in enumerate(x @ x[i]) if j != i))[:5]
        assert list(zip((-scores[queries_of == i]).tolist(), rows[queries_of == i].tolist())) == want


# URL filters


def test_urls(spark):
    urls = [None, "", "no address", "http://", "HTTP://Example.ORG/es/x?y#z", "https://a.example.org/en/1x", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/1", "http://x.com/de", "ftp://notexample.org?casino", "http://a.net/best-casino/1", "http://a.net/casinos", "x://a.com:80/fr/", "http://com/fr/é"]
    rows = [(i, u, "mine", "mine") for i, u in enumerate(urls)] + [(4, urls[4], "mine", "mine")]
    got = filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule string").select("page_id", "url"))
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert Counter(r.page_id for r in got.collect())[4] == 2
    assert by[0] == by[1] == by[2] == by[3] == ("", "", None, "allow")
    assert by[4] == ("example.org", "/es/x", "example.org/es/", "block") and by[5] == ("a.example.org", "/en/1x", "example.org/en/1", "block")
    assert by[6][2:] == ("org/", "allow") and by[7][2:] == ("com/fr/", "allow") and by[8][2:] == ("com/de/", "block") and by[9][2:] == (None, "allow")
    assert by[10] == ("notexample.org", "", None, "allow") and by[11][2:] == (None, "block") and by[12][2:] == (None, "allow") and by[13] == ("a.com:80", "/fr/", None, "allow")
    assert by[14][2] == "com/fr/"


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = rules_table(spark, [host_rule("block", "shop.com", "/ads/x"), token_rule("block", "spam")])
    addresses = spark.createDataFrame([("shop.com/a",), ("www.shop.com/ads/",), ("b.com/",)], "host_path string")
    assert {(r.rule, r.token) for r in index_rules(rules, addresses).collect()} == {("shop.com/ads/x", "ads"), ("*spam*", "spam")}


def list_lines(pick):
    word = lambda: "".join(pick.choice("abcde") for _ in range(pick.randint(1, 3)))
    shapes = [lambda: f"||{word()}.com^", lambda: f"||{word()}.{word()}.org/{word()}", lambda: f"/{word()}/*{word()}.", lambda: f"^{word()}^", lambda: f"|{word()}.com/{word()}|", lambda: word() + word(), lambda: f"@@||{word()}.com/{word()}^", lambda: f".{word()}/{word()}|"]
    return [pick.choice(shapes)() for _ in range(1500)]


def list_verdict(lines, address):
    """By trying every line."""
    best = "allow"
    for line in lines:
        body = line.removeprefix("@@")
        pattern = re.escape(body.strip("|")).replace(r"\*", ".*").replace(r"\^", r"(?:[^A-Za-z0-9_.%-]|$)")
        start = r"^(?:[^/]*\.)?" if body.startswith("||") else "^" if body.startswith("|") else ""
        if re.search(f"(?i){start}{pattern}{'$' if body.endswith('|') else ''}", address):
            if line.startswith("@@"):
                return "allow"
            best = "block"
    return best


@pytest.mark.parametrize("limit", [200_000, 10])
def test_filter_list_equals_trying_every_rule(spark, monkeypatch, limit):
    """With the index broadcast, and joined by token."""
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", limit)
    pick = random.Random(4)
    lines = [x for x in dict.fromkeys(list_lines(pick)) if len(x) > 4]
    word = lambda: "".join(pick.choice("abcdeXY9-_.") for _ in range(pick.randint(1, 4)))
    urls = [f"http://{word()}{pick.choice(['.com', '.org', ''])}/{word()}/{word()}" for _ in range(400)] + ["http://a.com/" + "b/" * 300, None]
    rules = rules_table(spark, [r for r in map(list_rule, lines) if r])
    got = {r.page_id: r for r in filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    want = [list_verdict(lines, got[i].host + got[i].path) for i in range(len(urls))]
    assert [got[i].verdict for i in range(len(urls))] == want and 10 < want.count("block") < 380


def test_lines_that_are_no_address_rules():
    assert [list_rule(x) for x in ("", "! note", "[Adblock]", "a.com##.ad", "ads$script")] == [None] * 5


def test_url_plan_has_no_python(spark, capsys):
    filter_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), default_rules(spark)).explain()
    assert "Python" not in capsys.readouterr().out


# WARC

PAGES = [(1, "http://a.org/é %", "<p>á"), (2, None, "<p>á"), (3, "x\r\nInjected: 1", None), (4, "u", ""), (5, "v", "<p>other\r\n\r\nline"), (6, "w", "y" * 3_000_000), (None, "n", "<p>á"), (7, "t", "z"), (7, "t", "z")]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "mine") for p in PAGES], "page_id long, url string, html string, sha1 string").drop("sha1")
    files = write_warc(plan_records(pages), f"file://{tmp_path}/out", date="2025-01-01T00:00:00Z")
    records = read_warc(files).collect()
    got = {(r.page_id, r.record_type): r for r in records}
    assert len(records) == len({r.record_id for r in records}) == len(PAGES) == sum(r.records for r in files.collect())
    assert got[(2, "response")].payload == "<p>á".encode() and got[(1, "revisit")].refers_to == 2 and got[(None, "revisit")].refers_to == 2
    assert got[(4, "response")].payload == b"" and got[(3, "revisit")].refers_to == 4 and got[(3, "revisit")].url == "x\r\nInjected: 1"
    assert got[(5, "response")].payload == "<p>other\r\n\r\nline".encode() and len(got[(6, "response")].payload) == 3_000_000
    assert got[(1, "revisit")].payload_digest == base64.b32encode(hashlib.sha1("<p>á".encode()).digest()).decode() and got[(1, "revisit")].url == "http://a.org/é %"
    for path in (tmp_path / "out").glob("*.warc.zst"):
        first = next(read_archive(path.open("rb")))
        assert first["record_type"] == "warcinfo"


def test_no_pages(spark):
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_small_payloads_can_all_be_responses(spark):
    pages = spark.createDataFrame([(1, "a", "ab"), (2, "b", "ab")], "page_id long, url string, html string")
    assert {r.record_type for r in archive_pages(pages, least_bytes=3).collect()} == {"response"}


def test_dictionary_leads_and_helps():
    records = [record_bytes(i, f"http://e.org/{i}", (f"<html><head><title>Page {i}</title></head><body class=x>" + "<p>shared text of many pages</p>" * 3 + f"{i * 7919}").encode(), "D", b"x", 1, None, "2025-01-01T00:00:00Z") for i in range(3000)]
    records.insert(100, record_bytes(9999, None, random.Random(1).randbytes(5_000_000), "D", b"x", 1, None, "2025-01-01T00:00:00Z"))
    out = io.BytesIO()
    writer = ArchiveWriter(out)
    for r in records:
        writer.add(r)
    writer.finish()
    data = out.getvalue()
    assert struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC == 0x184D2A5D
    skipped = struct.pack("<II", 0x184D2A50, 3_000_000) + bytes(3_000_000)
    want = [*range(100), 9999, *range(100, 3000)]
    assert [r["page_id"] for r in read_archive(io.BytesIO(data))] == want
    assert [r["page_id"] for r in read_archive(io.BytesIO(skipped + data + skipped + data))] == want + want
    assert len(data) - 5_000_000 < (sum(map(len, records)) - 5_000_000) / 3
    with pytest.raises(ValueError, match="ends within"):
        list(read_archive(io.BytesIO(data[:-5])))


# extraction

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><div class="site-header">Some site</div>
<div id="cookieConsent">We use cookies</div><article class="commentary"><h1>Head &amp; line</h1><p>First&nbsp;  text
 goes <b>on</b>.<br>And on.<p>Second &lt;one&gt;</p><script>var a = "<p>no</p>";</script><ul><li>item</ul>
<section class="comment-list"><p>I disagree with this</p></section></article><form><p>Sign up</p></form><footer>(c)</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Head & line\nFirst text goes on. And on.\nSecond <one>\nitem"
    assert main_text(None) == main_text("") == main_text("<p>") == ""


def test_wrappers_with_odd_names_keep_their_text():
    body = f"<h1>A title</h1><p>{_PROSE[3]}</p><p>Short end.</p>"
    want = f"A title\n{_PROSE[3]}\nShort end."
    assert main_text(f"<nav><a href=/>Home</a></nav><div class='post tags-a'><article>{body}</article></div>") == want
    assert main_text(f"<article><div class='notice-of-meeting'>{body}</div></article><footer>(c)</footer>") == want
    assert main_text(f"<body><div id=newsletter-page>{body}</div></body>") == want


def test_menus_at_any_depth_are_left_out():
    for depth in (10, 520, 50_000):
        assert main_text("<div>" * depth + "<nav><p>Menu of the page</p></nav><article><p>Text of it.</p></article>") == "Text of it."


def test_pages_without_an_article():
    page = f"<div><a href=1>Home</a> <a href=2>Sport</a></div><div class=cookies><p>{_PROSE[0]}</p></div><div><h1>On wells</h1><p>{_PROSE[7]}</p><p>{_PROSE[1]}</p></div><div class='reader-comments'><p>{_PROSE[2]}</p></div><div><a href=3>Terms of use</a></div>"
    assert main_text(page) == f"On wells\n{_PROSE[7]}\n{_PROSE[1]}"


def test_extraction_of_pages_keeps_articles_only(spark):
    import html
    import re

    for r in queries.op9_extract_html(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>)", r.html, re.S)[1]
        want = re.split(r"</?(?:h1|p)>", article)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in want]
        assert r.text.replace(" ", "") == "\n".join(b for b in blocks if b).replace(" ", "") and r.n_chars == len(r.text)


def test_extract_edges(spark):
    pages = spark.createDataFrame([(1, None, None, 9), (1, None, None, 9), (None, "u", "<p>" * 3000, 9), (3, "v", "<div" * 2000, 9), (4, "w", "<article><p>" + "long " * 200_000, 9)], "page_id long, url string, html string, n_chars long")
    got = extract_pages(pages).collect()
    assert Counter(r.page_id for r in got) == {1: 2, None: 1, 3: 1, 4: 1} and max(r.n_chars for r in got) == 999_999


def test_tree_fits_unseen_labels():
    x, y = labelled_table()
    rng = np.random.default_rng(0)
    order = rng.permutation(len(y))
    train, test = order[: len(y) * 3 // 4], order[len(y) * 3 // 4 :]
    assert (classify(grow(x[train], y[train]), x[test]) == y[test]).mean() >= 0.8
    assert (classify(grow(x, y), x) == y).mean() >= 0.95


# pipeline


def test_stages_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF)
        if name != "pack":
            assert kept.columns == docs.columns
        seen[name] = [r.doc_id for r in kept.select("doc_id").collect()]
    assert len(seen["language_id"]) > 0.8 * docs.count()
    from test_llm_documents import near_rows, normalised

    texts = {r.doc_id: r.text for r in docs.collect()}
    first = {}
    for i in sorted(seen["language_id"]):
        first.setdefault(normalised(texts[i]), i)
    assert sorted(seen["exact_dedup"]) == sorted(first.values())
    assert sorted(seen["near_dedup"]) == [r[0] for r in near_rows([(i, texts[i]) for i in seen["exact_dedup"]], 5) if r[3]]
    assert max(Counter(seen["mix_sources"]).values()) <= 3 and set(seen["mix_sources"]) <= set(seen["near_dedup"])
    assert set(seen["pack"]) == set(seen["mix_sources"])


def test_pipeline_of_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, 0), (None, "some words in a text of no id", "en", "a", 1), (2, "", "en", "a", 0), (3, "some words of the third text", "en", "b", 3), (3, "some words of the third text", "en", "b", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_with_odd_column_names(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    odd = docs.withColumn("my col", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("rule", F.lit("x")).withColumn("tick`s", F.lit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, odd, "")
        assert kept.columns == odd.columns and kept.count() > 0


#: Pages unlike the labelled ones in words and number of blocks; all of their text is main text.
SHORT_PAGES = [
    ("<p>One short para.</p>", "One short para."), ("<div><h1>Q</h1><p>Yes.</p><p>It works if you try it on another day.</p></div>", "Q\nYes.\nIt works if you try it on another day."),
    ("<html><body>plain</body></html>", "plain"), ("<h1>Title</h1>", "Title"), ("<div><div><p>Two of them</p></div><p>here.</p></div>", "Two of them\nhere."),
    ("<h1>Sold out</h1><p>We are sorry.</p><p>New tickets come in May.</p>", "Sold out\nWe are sorry.\nNew tickets come in May."), ("<p>a<p>b<p>c<p>d", "a\nb\nc\nd"),
    ("<table><tr><td>one</td><td>two</td></tr></table>", "one\ntwo"), ("<p>See <a href=x>this</a> for all of the details on it.</p>", "See this for all of the details on it."),
    ("<nav><a href=1>Home</a></nav><p>Back soon.</p>", "Back soon."), ("<h2>Hours</h2><ul><li>Monday: nine to five<li>Sunday: closed</ul>", "Hours\nMonday: nine to five\nSunday: closed"),
    ("<p>It rained all day.</p><footer>Imprint</footer>", "It rained all day."), ("<article><p>Ok.</p></article>", "Ok."), ("<main>Nothing here</main><aside>Ads</aside>", "Nothing here"),
]


@pytest.mark.parametrize(("page", "text"), SHORT_PAGES)
def test_short_pages_stay_whole(page, text):
    assert main_text(page) == text


def test_tree_fits_unseen_pages():
    """Trees grown without a fifth of the labelled pages, on the blocks of those pages."""
    from vcspark.llm.blocks import blocks_of
    from vcspark.llm.extraction import LABELLED, features

    good = total = 0
    for part in range(5):
        tables = [(features(b), np.array([x.text[0] == "+" for x in b])) for b in map(blocks_of, LABELLED)]
        seen = [t for i, t in enumerate(tables) if i % 5 != part]
        tree = grow(np.concatenate([x for x, _ in seen]), np.concatenate([y for _, y in seen]))
        for x, y in tables[part::5]:
            good += (classify(tree, x) == y).sum()
            total += len(y)
    assert good / total > 0.85
