"""Which languages are learned: those with enough rows in the whole corpus, however many rows or languages there are."""

from __future__ import annotations

import random

import corpus_pipeline
from vcspark.llm.langid import LEAST_ROWS, identify_documents, identify_pages

SCHEMA = "doc_id long, text string, lang string, source string"


def _text(pick: random.Random, first: int, letters: int) -> str:
    word = lambda: "".join(chr(first + pick.randrange(letters)) for _ in range(pick.randint(2, 7)))
    return " ".join(word() for _ in range(30))


def test_a_rare_language_is_learned_among_many_rows(spark):
    """Ten Greek rows among 40,000, one of which a uniform sample of 4000 would hold."""
    pick = random.Random(5)
    latin = [_text(pick, 97, 26) for _ in range(200)]
    rows = [(i, latin[i % 200], "en", "s") for i in range(40_000)] + [(10**6 + i, _text(pick, 0x3B1, 24), "el", "s") for i in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    got = identify_documents(docs).where("doc_id >= 1000000").collect()
    assert [r.detected_lang for r in got] == ["el"] * 10
    assert corpus_pipeline.language_id(spark, docs, "").where("lang = 'el'").count() == 10


def test_more_than_64_languages_are_learned(spark):
    pick = random.Random(6)
    names = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)]
    rows = [(i * 100 + j, _text(pick, 0x4E00 + 40 * i, 40), n, "s") for i, n in enumerate(names) for j in range(LEAST_ROWS)]
    got = identify_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.detected_lang == r.lang for r in got)


def test_languages_of_few_rows_are_not_rejected(spark):
    """A text that fits none of the learned languages keeps the one that it declares."""
    pick = random.Random(9)
    rows = [(i, _text(pick, 97, 26), "en", "s") for i in range(200)] + [(1000, _text(pick, 0x10A0, 40), "ka", "s"), (1001, _text(pick, 0x530, 40), None, "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.detected_lang for r in identify_documents(docs).where("doc_id >= 1000").collect()}
    assert got == {1000: "ka", 1001: "und"}
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").where("doc_id >= 1000").collect()] == [1000]


def test_priors_decide_weak_texts_and_no_others(spark):
    """A few words that two languages share go by host, address and markup; a long text goes by its words."""
    pick = random.Random(10)
    shared = ["".join(pick.choice("abcdefgh") for _ in range(4)) for _ in range(30)]
    own = {x: ["".join(pick.choice(letters) for _ in range(5)) for _ in range(60)] for x, letters in (("de", "ijklmnop"), ("nl", "mnopqrst"))}
    body = lambda x, n, m: " ".join([pick.choice(own[x]) for _ in range(n)] + [pick.choice(shared) for _ in range(m)])
    page = lambda i, x, text, declared: (i, f"http://www.host-{x}.{x}/{i}", f"<html{f' lang={declared}' if declared else ''}><body><p>{text}</p></body></html>")
    rows = [page(i, x, body(x, 40, 20), x) for i, x in enumerate(["de", "nl"] * 300)]
    rows += [page(10_000 + i, x, body(x, 0, 3), None) for i, x in enumerate(["de", "nl"] * 20)]
    rows += [page(20_000 + i, x, body({"de": "nl", "nl": "de"}[x], 60, 0), None) for i, x in enumerate(["de", "nl"] * 20)]
    got = {r.page_id: r for r in identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    weak, strong = [got[10_000 + i] for i in range(40)], [got[20_000 + i] for i in range(40)]
    assert all(r.lang == r.suffix for r in weak) and sum(r.text_lang != r.lang for r in weak) >= 5
    assert all(r.lang != r.suffix for r in strong)
    assert max(r.prob for r in weak) < 1 and len({r.prob for r in weak}) > 3


def test_repeated_keys_leave_no_language_short(spark):
    """All rows of a language may have one key, whose hash is above the first threshold."""
    pick = random.Random(7)
    rows = [(None if lang == "en" else 7, _text(pick, first, 24), lang, "s") for lang, first in (("en", 97), ("el", 0x3B1)) for _ in range(300)]
    got = identify_documents(spark.createDataFrame(rows, SCHEMA), max_rows=20).collect()
    assert len(got) == 600 and all(r.detected_lang == r.lang for r in got)
