"""Sets of tables behind a pointer, counted copies, broken JSON and merged layers against plain code."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from vcspark import plans
from vcspark.operators import extraction
from vcspark.sources import commits, copies

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def a_set(spark, root):
    jobs = spark.createDataFrame([(1, "queued", 0), (2, "queued", 5), (3, "queued", 0), (None, "lost", 0)], "job_id long, status string, revision long")
    scenes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "job_id long, `a b.c` string")
    tracks = spark.createDataFrame([], "job_id long, n array<int>")
    return commits.create_set(spark, root, {"jobs": jobs, "scenes": scenes, "tracks": tracks}, "job_id", buckets=4)


def test_a_set_is_replaced_as_one(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    first = a_set(spark, root)
    made = {"scenes": spark.createDataFrame([(1, "new"), (9, "not named")], "job_id long, `a b.c` string"), "tracks": spark.createDataFrame([(1, [1]), (1, [1])], "job_id long, n array<int>")}
    finished = spark.createDataFrame([(1, 0), (2, 4), (7, 0), (None, 0)], "job_id long, revision long")
    second, refused = commits.finish_jobs(spark, root, "jobs", made, finished, {"status": F.when(F.col("status") == "queued", "done").otherwise(F.col("status"))}, first)
    assert second == 2 and rows(refused) == [(2, 4), (7, 0), (None, 0)]
    assert rows(commits.read_committed(spark, root, "scenes")) == [(1, "new"), (2, "c"), (None, "n")]
    assert rows(commits.read_committed(spark, root, "tracks")) == [(1, [1]), (1, [1])]
    assert rows(commits.read_committed(spark, root, "jobs")) == [(1, "done", 1), (2, "queued", 5), (3, "queued", 0), (None, "lost", 0)]
    assert rows(commits.read_committed(spark, root, "scenes", first)) == [(1, "a"), (1, "b"), (2, "c"), (None, "n")]


def test_buckets_without_a_key_keep_their_folders(spark, tmp_path):
    root = f"file://{tmp_path}/set"
    wide = spark.range(200).withColumnRenamed("id", "job_id")
    commits.create_set(spark, root, {"t": wide}, "job_id", buckets=8)
    commits.replace_keys(spark, root, {"t": wide.limit(0)}, wide.where("job_id = 17"), 1)
    before, after = (commits._state(spark, root, n)["tables"]["t"]["parts"] for n in (1, 2))
    assert sum(before[b] != after[b] for b in before) == 1
    assert [r[0] for r in commits.read_committed(spark, root, "t").orderBy("job_id").collect()] == [i for i in range(200) if i != 17]


def test_a_stop_between_tables_leaves_the_old_state(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/set"
    first = a_set(spark, root)
    old = {n: rows(commits.read_committed(spark, root, n)) for n in ("jobs", "scenes", "tracks")}
    stage, names = commits._stage, []

    def stopping(spark, root, name, *rest):
        names.append(name)
        if len(names) == 2:
            raise OSError("lost")
        return stage(spark, root, name, *rest)

    monkeypatch.setattr(commits, "_stage", stopping)
    made = {"scenes": spark.createDataFrame([(1, "new")], "job_id long, `a b.c` string")}
    finished = spark.createDataFrame([(1, 0)], "job_id long, revision long")
    with pytest.raises(OSError):
        commits.finish_jobs(spark, root, "jobs", made, finished, {"status": F.lit("done")}, first)
    assert names == ["scenes", "jobs"] and commits.head(spark, root) == first
    assert {n: rows(commits.read_committed(spark, root, n)) for n in old} == old
    monkeypatch.setattr(commits, "_stage", stage)
    assert commits.finish_jobs(spark, root, "jobs", made, finished, {"status": F.lit("done")}, first)[0] == 2
    assert (1, "new") in rows(commits.read_committed(spark, root, "scenes"))


def test_of_two_writers_one_gets_a_conflict(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/set"
    first = a_set(spark, root)
    keys = spark.createDataFrame([(1,)], "job_id long")
    stage = commits._stage

    def overtaken(*args):
        monkeypatch.setattr(commits, "_stage", stage)
        commits.replace_keys(spark, root, {"scenes": spark.createDataFrame([(1, "other")], "job_id long, `a b.c` string")}, keys, first)
        return stage(*args)

    monkeypatch.setattr(commits, "_stage", overtaken)
    mine = {"scenes": spark.createDataFrame([(1, "mine")], "job_id long, `a b.c` string")}
    with pytest.raises(commits.Conflict):
        commits.replace_keys(spark, root, mine, keys, first)
    assert rows(commits.read_committed(spark, root, "scenes")) == [(1, "other"), (2, "c"), (None, "n")]
    with pytest.raises(commits.Conflict):
        commits.replace_keys(spark, root, mine, keys, first)
    assert commits.replace_keys(spark, root, mine, keys, 2) == 3


def test_copies_are_compared(spark, tmp_path):
    t = spark.createDataFrame([(1, [1.0, 2.0], {"b": 1, "a": 2}), (2, None, None), (2, [3.0], {})], "id long, `my v` array<double>, m map<string,int>")
    empty = spark.createDataFrame([], "id long, v array<float>")
    target = f"file://{tmp_path}/copy"
    got = rows(copies.copy_tables(spark, {"t": t, "empty": empty}, target, {"t": ["my v"], "empty": ["v"]}))
    assert got == sorted([("empty", None, 0, 0, None, None, None, None, True), ("empty", "v", 0, 0, None, None, None, None, True), ("t", None, 3, 3, None, None, None, None, True), ("t", "my v", 2, 2, 1, 1, 2, 2, True)], key=repr)
    with pytest.raises(ValueError, match="already: t"):
        copies.copy_tables(spark, {"t": t, "new": t}, target)
    assert not (tmp_path / "copy" / "new").exists()


def test_a_damaged_copy_is_seen(spark):
    t = spark.createDataFrame([(1, "x", [1.0, 2.0]), (2, None, [3.0, 4.0])], "id long, s string, v array<double>")
    source = copies.measure(t, ["v"])
    same = lambda target: [r[-1] for r in copies.compare_copy(spark, "t", source, target, ["v"])]
    assert same(t.orderBy(F.desc("id"))) == [True, True]
    assert same(t.where("id = 1")) == [False, False]
    assert same(t.withColumn("v", F.slice("v", 1, F.col("id").cast("int")))) == [False, False]
    assert same(t.withColumn("s", F.lit("x"))) == [False, True]
    assert same(t.unionByName(t.where("id = 2"))) == [False, False]


def anything(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 5)
    if kind < 5:
        return [rng.randrange(-99, 99), 'a"\\{[é,', True, None, "x, y]"][kind]
    if kind == 5:
        return [anything(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f'k"{i}': anything(rng, depth + 1) for i in range(rng.randrange(4))}


def kept(part, whole) -> bool:
    """Whether ``part`` is ``whole`` with things missing at the end."""
    if isinstance(part, dict) and isinstance(whole, dict):
        return list(part) == list(whole)[: len(part)] and all(kept(part[k], whole[k]) if i == len(part) - 1 else part[k] == whole[k] for i, k in enumerate(part))
    if isinstance(part, list) and isinstance(whole, list):
        return len(part) <= len(whole) and part[:-1] == whole[: len(part)][:-1] and (not part or kept(part[-1], whole[len(part) - 1]))
    return part == whole


def test_every_cut_of_a_json_text_is_salvaged():
    rng = random.Random(7)
    for n in range(150):
        value = {"a": anything(rng), "b": [anything(rng) for _ in range(3)]}
        text = json.dumps(value, ensure_ascii=bool(n % 2), indent=n % 3 or None)
        assert json.loads(extraction.salvaged_json(f"x = {text}; y = [1]")) == value
        last = -1
        for end in range(1, len(text)):
            part = json.loads(extraction.salvaged_json(text[:end]))
            assert kept(part, value)
            size = len(json.dumps(part))
            assert size >= last  # a longer text gives no less
            last = size


def test_salvage_of_other_breaks():
    cut = extraction.salvaged_json
    assert cut("") is None and cut("no json") is None and cut('"a": 1}') is None
    assert [cut(x) for x in ("{", '{"a": 1, }', "[1, [2, 3,],]", '{"a": [1, 2}', '{"a": {"b": 1}, "c', "[12, 3", '["a\\')] == ["{}", '{"a": 1 }', "[1, [2, 3]]", '{"a": [1]}', '{"a": {"b": 1}}', "[12]", "[]"]
    assert len(cut("[" * 50_000)) == 100_000


def test_truncated_pages_give_their_fields():
    page = '<h1>Dom</h1><script type="application/ld+json">{"@type": "Product", "name": "Shoe", "color": "red", "offers": {"price": 9, "priceCurrency": "EU'
    assert list(extraction.layers_of(page)) == [("json_ld", "title", "Shoe"), ("json_ld", "price", "9"), ("json_ld", "color", "red"), ("dom", "title", "Dom")]
    assert list(extraction.layers_of('<script type="application/ld+json">' + "[" * 100_000 + "</script>")) == []


def plain_merge(says):
    """One key's rows (layer, pos, field, value, confidence, snippet) in one pass."""
    order = lambda r: (extraction.LAYERS.index(r[0]) if r[0] in extraction.LAYERS else len(extraction.LAYERS), r[0], r[1], r[3])
    fields, evidence = {}, {}
    for r in sorted((r for r in says if r[3] is not None and r[3].strip() and (r[2], r[3]) != ("product_type", "unknown")), key=order):
        if r[2] not in fields:
            sure = extraction.TRUST.get(r[0], 0.0) if r[4] is None else r[4]
            fields[r[2]], evidence[r[2]] = r[3], (*order(r)[:3], r[2], r[0], (r[3] if r[5] is None else r[5])[:240], sure)
    total = sum(evidence[f][-1] for f in [*extraction.ESSENTIAL, *extraction.DESIRABLE] if f in evidence)
    return fields, [e[3:] for e in sorted(evidence.values())], round(total / 9, 2)


def merged(df, keys):
    return {tuple(r[k] for k in keys): (r.fields, [tuple(e) for e in r.evidence], r.confidence) for r in df.collect()}


def test_merge_equals_a_plain_pass(spark):
    rng = random.Random(3)
    fields = [*extraction.ESSENTIAL, *extraction.DESIRABLE, "sku", "product_type"]
    says = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([*extraction.LAYERS, "other", "zebra"]), rng.randrange(3), rng.choice(fields), rng.choice([None, "", " ", "unknown", "x", "y" * 300]), rng.choice([None, None, 0.5]), rng.choice([None, "s" * 250])) for _ in range(250)]
    says = list({r[:5]: r for r in says}.values())  # equal rows with unequal evidence have no order
    df = spark.createDataFrame([(9, "dom", 0, "title", " ", None, None), *says], "`a b` long, layer string, pos int, field string, value string, confidence double, snippet string")
    got = merged(extraction.merge_layers(df.withColumnRenamed("a b", "id"), ["id"]), ["id"])
    want = {(k,): plain_merge([r[1:] for r in says if r[0] == k]) for k in {r[0] for r in says}}
    assert got == {k: v for k, v in want.items() if v[0]}
    assert extraction.merge_layers(df.limit(0), ["`a b`"]).count() == 0


def test_page_products_equal_a_plain_pass(spark):
    got = merged(plans.QUERIES["page_products"](spark, SF), ["page_id"])
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        says = [(layer, n, field, value, None, None) for n, (layer, field, value) in enumerate(extraction.layers_of(r.html or ""))]
        if (one := plain_merge(says))[0]:
            want[(r.page_id,)] = one
    assert got == want


def test_html_layers_query_lists_what_each_page_says(spark):
    got = sorted((r.page_id, r.pos, r.layer, r.field, r.value) for r in plans.QUERIES["html_layers"](spark, SF).collect())
    want = sorted((r.page_id, n, *says) for r in spark.read.parquet(f"{SF}/pages.parquet").collect() for n, says in enumerate(extraction.layers_of(r.html or "")))
    assert got == want


def test_page_ids_stay_exact_beside_null(spark):
    pages = spark.createDataFrame([(None, "u", "<h1>a</h1>"), (2**53 + 1, None, "<h1>b</h1>"), (3, "w", None)], "page_id long, url string, html string")
    assert {(r.page_id, r.url, r.value) for r in extraction.page_layers(pages).collect()} == {(None, "u", "a"), (2**53 + 1, None, "b")}
