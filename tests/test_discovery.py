"""Discovery in rounds against a plain best-first walk."""

from __future__ import annotations

import random
import re

import pytest

from vcspark import plans
from vcspark.operators import frontier
from vcspark.plans import discovery

SF = "/root/testdata/sf0.001"


def points(url, depth, kind, hints):
    plain = re.sub(r"(?i)sitemaps?|site_?maps?", "", url).lower()
    local = not hints or any(h.lower() in url.lower() for h in hints)
    return 100 * bool(re.search(r"(^|[^a-z])(products?|productos?|artikel|articles?|items?|catalog|pdp)([^a-z]|$)", plain)) + 40 * local + 10 * (kind == "category") + 5 * depth


def sitemap(url):
    return bool(re.search(r"(?i)\.xml(\.gz)?([?#]|$)", url) or re.search(r"(?i)sitemap", re.sub(r"[?#].*", "", url.split("://", 1)[-1].partition("/")[2])))


def walk(seeds, documents, hints, width, depth, budget):
    """Requests of each site in order: pop the best, read, queue; ``width`` of them are popped before any is read."""
    out = {}
    for site in {s for s, _, _ in seeds}:
        queue, known, done = [], set(), []
        for url, place in sorted({(u, p) for s, u, p in seeds if s == site}, key=lambda x: (x[1], x[0])):
            if url not in known:
                known.add(url)
                kind = "sitemap" if sitemap(url) else "category"
                queue.append((-points(url, 0, kind, hints), 0, place, url, 0, kind))
        number = 0
        while queue and len(done) < budget:
            number += 1
            queue.sort()
            now, queue = queue[:width][: budget - len(done)], queue[width:] if width <= budget - len(done) else queue
            met = {}
            for _, _, _, url, at, kind in now:
                done.append((url, at, kind))
                links, onward = documents.get(url, ([], []))
                further = [x for x in links if sitemap(x)] if kind == "sitemap" and at < depth else onward if kind == "category" and at + 1 < depth else []
                whole = links if kind == "sitemap" else onward
                for i, link in enumerate(whole):
                    if link in further and link not in known:
                        met.setdefault(link, (len(done) * 2**32 + i, at + 1, kind))
            for link, (place, at, kind) in met.items():
                known.add(link)
                queue.append((-points(link, at, kind, hints), number, place, link, at, kind))
        out[site] = done
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    names = ["products", "news", "items", "about", "sitemap", "catalog"]
    seeds, documents = [], {}
    for site in ("a.org", "b.com", "c.net"):
        urls = [f"https://{site}/{rng.choice(['en', 'es'])}/{rng.choice(names)}-{i}.xml" for i in range(40)] + [f"https://{site}/list/{rng.choice(names)}/{i}" for i in range(25)]
        for url in urls:
            if rng.random() < 0.9:
                documents[url] = (rng.choices(urls, k=rng.randint(0, 9)) + [f"https://{site}/p/{rng.randrange(99)}"], rng.choices(urls[40:], k=rng.randint(0, 2)))
        seeds += [(site, u, i) for i, u in enumerate([*rng.sample(urls[:40], 2), *rng.sample(urls[40:], 2)])]
    return [*seeds, seeds[0]], documents


def frames(spark, made):
    return spark.createDataFrame(made[0], "site string, url string, place int"), spark.createDataFrame([(u, *x) for u, x in made[1].items()], "url string, links array<string>, next array<string>")


def got(spark, root):
    out = {}
    for r in sorted(frontier.requests(spark, root).collect(), key=lambda r: (r.site, r.nth)):
        out.setdefault(r.site, []).append((r.url, r.depth, r.kind))
    return out


@pytest.mark.parametrize(("width", "budget"), [(1, 6), (5, 23)])
def test_walk_equals_best_first(spark, made, tmp_path, width, budget):
    seeds, documents = frames(spark, made)
    root = f"file://{tmp_path}/walk"
    assert frontier.discover(seeds, documents, root, ["/en/"], width, 3, budget)
    want = walk(*made, ["/en/"], width, 3, budget)
    assert got(spark, root) == want and max(map(len, want.values())) == budget


def test_walk_goes_on_where_it_stopped(spark, made, tmp_path):
    seeds, documents = frames(spark, made)
    root = f"file://{tmp_path}/walk"
    assert not frontier.discover(seeds, documents, root, [], 6, 3, 30, rounds=2)
    stopped = got(spark, root)
    documents.sparkSession.range(1).write.parquet(f"{root}/taken-3/half")  # a round that broke off between its tables
    assert frontier.discover(seeds, documents, root, [], 6, 3, 30)
    want = walk(*made, [], 6, 3, 30)
    assert got(spark, root) == want and all(want[s][: len(x)] == x for s, x in stopped.items())
    assert frontier.discover(seeds, documents, root, [], 6, 3, 30) and got(spark, root) == want


def test_empty_walk(spark, tmp_path):
    seeds = spark.createDataFrame([], "site string, url string, place int")
    documents = spark.createDataFrame([(None, None, None)], "url string, links array<string>, next array<string>")
    assert frontier.discover(seeds, documents, f"file://{tmp_path}/walk")
    assert frontier.requests(spark, f"file://{tmp_path}/walk").count() == 0


def test_discovery_query_equals_the_walk(spark):
    seeds, documents = discovery.documents(spark, SF)
    rows = {r.url: (r.links, r.next) for r in documents.collect()}
    done = walk([tuple(r) for r in seeds.collect()], rows, discovery.HINTS, frontier.WIDTH, frontier.MAX_DEPTH, frontier.MAX_REQUESTS)
    want = {}
    for site, requests in done.items():
        for nth, (url, _, _) in enumerate(requests, 1):
            for link in rows.get(url, ([], []))[0]:
                if re.search(r"/[0-9]+([/?#]|$)", link):
                    want.setdefault((site, re.sub(r"[?#].*$|/$", "", link)), nth)
    found = {(r.site, r.url): r.nth for r in plans.QUERIES["discovered_products"](spark, SF).collect()}
    assert found == want and len(found) > 20
