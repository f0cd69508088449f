"""Main text of web pages: flat blocks classified by a decision tree.

Each block is described by its words and link density and those of its neighbours, and
by the elements around it: inside an article or main element (1), outside of it on a
page that has one (-1), or on a page without (0); in an element that holds other things
than main text; in one whose class or id hints at that, and how small a part of the
page it is; heading; list or table item. The first question is whether the page is short
and has no article element: what is short elsewhere is all that such a page has, so its
branch is grown from labelled short pages. The rest of the tree is grown here from a small labelled
table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vcspark.llm.blocks import Block, blocks_of
from vcspark.llm.textops import batches

FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "inside article", "aside", "heading", "item", "hint")

#: Prose for the labelled table, from short to long.
_PROSE = [
    "The harbour was quiet when we came in, and only two boats had their lamps lit.",
    "In the spring of that year the council voted, by a narrow margin, to rebuild the old bridge with stone from the quarry upriver.",
    "Heat the oil, add the onions and cook them slowly until they are soft and golden; this takes about twenty minutes and can't be hurried.",
    "Researchers compared the growth of seedlings under red and blue light and found that, within three weeks, those under blue light had thicker stems but fewer leaves.",
    "She had promised her brother a letter each month, and for eleven years she kept that promise, even from places where no post was ever collected.",
    "Version four drops support for the old file format, so projects that still rely on it should be converted with the tool that comes with the release before anyone upgrades.",
    "The second half began much like the first, with long spells of possession and no shots, until a free kick in the seventieth minute changed everything for the visitors.",
    "Most of the valley's wells were dug by hand before 1850, some of them forty metres deep, and a map of them was drawn only when the railway company needed water for its engines.",
]
_ADVERTS = ["Buy two pairs now and get the third one free, only this week and only in our shop.", "The best mattress that you will ever sleep on, with a hundred nights to try it out at home.", "Win a holiday for two by the sea when you order before Friday."]
_REMARKS = ["I could not agree less with what is said here, my own wells were dug by machine.", "Great read, thanks a lot!", "Has anybody tried this with butter in place of oil? Mine came out rather dry, I am afraid.", "First."]
_NOTICES = ["We use cookies to improve what you see here, and by going on you agree to it in every way.", "Sign up for the letter that we send each week to all who care about boats.", "Your browser is out of date and some parts of this page may not work as they should."]


def _main(*numbers: int) -> str:
    return "".join(f"<p>+{_PROSE[n % len(_PROSE)]}</p>" for n in numbers)


def _long(*numbers: int) -> str:
    return "<p>+" + " ".join(_PROSE[n % len(_PROSE)] for n in numbers) + "</p>"


def _other(texts: list[str], *numbers: int) -> str:
    return "".join(f"<p>-{texts[n % len(texts)]}</p>" for n in numbers)


#: The labelled table: pages whose blocks begin with + (main text) or - (anything else).
LABELLED = [
    # articles between menus, adverts, notices and footers
    f"<nav><ul><li><a href=/>-Home</a><li><a href=/b>-News of the day</a></ul></nav><div class=ad>-{_ADVERTS[0]}</div><article><h1>+The old bridge</h1>{_long(1, 2, 3)}<p>+Short.<p>+One two three four five six.{_main(4)}<p>+See <a href=x>this page</a> for more of it.</article><footer>-(c) Harbour News, all rights reserved, some words more of a footer.</footer>",
    f"<header><a href=/>-Harbour News</a><p>-Stories from the coast since 1871</header><main><h2>+Onions</h2>{_long(2, 5)}<ul><li>+two onions<li>+a spoon of olive oil</ul><p>+Serve warm.</main><aside><p>-{_PROSE[6]}</aside>",
    f"<article>{_main(3)}<p>+Yes.<div class='share'>-Share this</div>{_long(4, 6)}<section class='comments'><h3>-Comments</h3>{_other(_REMARKS, 0, 1)}</section></article>",
    f"<article><h1>+Wells of the valley</h1>{_main(7)}<p>+So it was.</p><div id=comments>{_other(_REMARKS, 0, 1, 2, 3, 0, 2)}</div></article><footer>-About us</footer>",
    f"<article><h1>+Second half</h1>{_main(6)}<ol class=comment-list><li>-{_REMARKS[0]}<li>-{_REMARKS[2]}<li>-{_REMARKS[1]}</ol></article>",
    f"<article><header><h1>+Headline here</h1></header>{_main(5)}<blockquote>+A few quoted words.</blockquote><table><tr><td>+seedlings<td>+three weeks</table><footer>-Filed under things</footer></article><div role=navigation><a href=x>-older</a></div>",
    f"<main><article><p>+Word.<p>+Two words.{_main(0)}<p>+<a href=q>A linked line</a>{_main(1)}</article><div class='newsletter'>{_other(_NOTICES, 1)}</div></main><footer>{_other(_PROSE, 2)}</footer>",
    "<ul class=menu><li><a href=1>-a</a></ul><article><p>+Only this.</article><footer>-(c)</footer>",
    f"<div class=ad>-{_ADVERTS[1]}</div><article><h1>+Title</h1></article><div class=ads>-Short ad</div>",
    f"<article><h1>+Title</h1>{_main(4)}<p>+Last words.</article>",
    "<article><p>+Last words.</article>",
    f"<main>{_long(0, 1, 2, 3)}</main>",
    "<article><h2>+One</h2><p>+Two.<p>+Three.<p>+Four.<ul><li>+five<li>+<a href=6>six</a></ul><p>+seven</article>",
    f"<div><a href=1>-Home</a></div><article>{_main(3)}<p>+<a href=2>All of this is a link to some page</a></article>",
    f"<div>-{_PROSE[4]}</div><article>{_main(5)}</article><div>-{_PROSE[1]} {_PROSE[6]}</div><p>-Read on tomorrow when there is more to be said.</p>",
    f"<p>-A word of welcome to all who come by.</p><main><h1>+On it goes</h1><p>+Short one.</main><p>-{_PROSE[2]}</p>",
    # wrappers whose names only look like something else
    f"<body><div class='post tags-a'><article><h1>+Seedlings</h1>{_main(3, 4)}<p>+The end.</article></div><footer>-Imprint</footer></body>",
    f"<article><h1>+A meeting</h1><div class='notice-of-meeting'>{_main(1, 6, 7)}<p>+All are welcome.</p></div></article><nav><a href=1>-Back</a></nav>",
    f"<div class='widget-page'><h1>+How to cook onions</h1>{_long(2, 3)}{_main(5)}<p>+Done.</p></div>",
    f"<div id=share-your-story><h1>+A promise</h1>{_main(4, 0, 7)}</div><div class=share><a href=1>-Tell a friend</a></div>",
    f"<article class=sponsored><h1>+A title</h1>{_main(6)}<p>+Fine.</p></article><div class=sponsor>{_other(_ADVERTS, 2)}</div>",
    # boxes inside of articles
    f"<article><h1>+Boats</h1>{_main(0)}<div class=advert>{_other(_ADVERTS, 0)}</div>{_main(5)}<div class=related><a href=1>-More on boats</a> <a href=2>-Harbours</a></div><p>+They sailed.</p></article>",
    f"<article><h1>+Release notes</h1><div class=notice>{_other(_NOTICES, 2)}</div>{_main(5, 3)}<p>+Enjoy.</p><div class=tags>-release software</div></article>",
    f"<main><div class='cookie-consent'>{_other(_NOTICES, 0)}</div><h1>+Wells</h1>{_main(7, 1)}<div class='reader-replies'>{_other(_REMARKS, 2, 3)}</div></main>",
    f"<article><h1>+A bridge of stone</h1>{_main(1)}<aside><a href=1>-Read also: boats</a></aside>{_main(3)}<p>+More soon.</p><nav><a href=2>-Previous part</a></nav><footer><a href=3>-bridges</a> <a href=4>-stone</a></footer></article>",
    f"<main><nav><ul><li><a href=1>-Home<li><a href=2>-Coast</ul></nav><h1>+Lamps</h1>{_main(0, 4)}<p>+<a href=5>A link that belongs here</a></p><form><button>-Send</button><p>-Your name</p></form></main>",
    f"<article>{_main(2)}<ul><li>+<a href=1>oil</a><li>+<a href=2>onions</a></ul><div role=complementary><a href=3>-Our cook books</a><p>-{_ADVERTS[1]}</p></div></article>",
    # pages without an article
    f"<div id=cookie-notice>{_other(_NOTICES, 0)}</div><div id=content><h1>+Title of it</h1>{_long(1, 2)}{_main(3)}<p>+Nine words make up this one short closing paragraph.</div><form>{_other(_NOTICES, 1)}</form>",
    f"<div><a href=a>-one</a> <a href=b>-two</a></div><div><a href=c>-more links of this kind</a></div>{_long(3, 4, 5)}{_main(6)}<div><a href=d>-next page</a></div><div>-All rights reserved</div>",
    f"<table><tr><td><a href=/>-Start</a><td><a href=/1>-Part one</a></table><div>{_long(4, 1)}{_long(7, 0)}</div><div class=sidebar>{_other(_PROSE, 6)}<p>-Old news</div>",
    f"<div>-Menu</div><div>-Log in</div><h1>+The heading of a page</h1>{_long(0, 5)}<h2>+Part two</h2>{_long(2, 6)}<div><a href=1>-tag one</a> <a href=2>-tag two</a></div>",
    f"<body>{_long(6, 2)}{_main(1)}</body>",
    _main(2),
    f"<body><h1>+Title of the page</h1>{_long(7, 3)}<p>+A sentence of ten words that still belongs to it.</body>",
    f"<div>-Menu</div><div>-Search</div><div>-Log in</div><div>{_long(3, 5)}</div><div>-Imprint</div><div>-Contact</div>",
    f"<div><a href=1>-Home</a><a href=2>-Shop for things</a></div><div>{_long(5, 0)}{_main(6)}</div><div><a href=3>-Terms of use and other things to know</a></div>",
    f"<div><a href=1>-Latest</a> <a href=2>-Sport</a> <a href=3>-Weather on the coast</a></div><div><h1>+A narrow margin</h1>{_main(1, 6, 4)}<p>+The vote was taken at noon.</p></div><div class=comments>{_other(_REMARKS, 0, 1, 2)}</div><div>-Contact</div>",
    f"<div class=banner>-{_ADVERTS[2]}</div><div><h2>+Boats and lamps</h2>{_main(0, 7, 3)}</div><div class=newsletter>-{_NOTICES[1]}</div>",
]

#: Words of a page without an article element up to which it counts as short.
SHORT_PAGE = 100
#: Labelled short pages.
LABELLED_SHORT = [
    "<p>+One short line.</p>",
    "<body><p>+Yes.</p></body>",
    "<div>+Closed today.</div>",
    "<div><h1>+Is it open?</h1><p>+Yes.</p><p>+It opens at nine if the weather is fine.</p></div>",
    "<h1>+Moved</h1><p>+We are next door now.</p>",
    "<p>+First line.</p><p>+Second line.</p>",
    f"<h2>+Answer</h2><p>+No.</p>{_main(0)}",
    "<div><a href=1>-Home</a> <a href=2>-News</a></div><p>+Nothing to see here yet.</p>",
    "<ul><li><a href=1>-Start</a><li><a href=2>-Contact</a></ul><h1>+Not found</h1><p>+There is no such page.</p>",
    "<p>+Hello.</p><footer>-Imprint</footer>",
    f"<h1>+Lamps</h1><p>+Two.</p>{_main(3)}",
    "<table><tr><td>+oil<td>+three spoons</table>",
    "<div><p>+A</p><p>+B</p><p>+C</p></div>",
    f"<div class=cookie>{_other(_NOTICES, 0)}</div><p>+A single line.</p>",
    f"<nav><a href=1>-Home</a></nav>{_main(2)}<aside>-Old news</aside>",
    f"<div><a href=1>-one</a> <a href=2>-two</a></div>{_main(0, 1)}<div class=comments>{_other(_REMARKS, 1)}</div>",
    "<h2>+Times</h2><ul><li>+Monday: noon<li>+Tuesday: never</ul><div><a href=1>-Imprint</a></div>",
    f"<p>+See <a href=x>this</a> for more of it.</p><form><p>-{_NOTICES[1]}</p></form>",
]


def features(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    words = np.array([b.words for b in blocks], float)
    density = np.array([b.linked / b.words for b in blocks], float)
    out = np.zeros((n, len(FEATURES)))
    out[:, 0], out[:, 1] = words, density
    if n:
        out[1:, 2], out[1:, 3], out[:-1, 4], out[:-1, 5] = words[:-1], density[:-1], words[1:], density[1:]
        outside = -1 if any(b.inside for b in blocks) else 0
        out[:, 6:] = [(1 if b.inside else outside, b.aside, b.heading, b.item, b.hint) for b in blocks]
    return out


def labelled_table(pages: list[str] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the pages' blocks."""
    x, y = [], []
    for page in pages:
        blocks = blocks_of(page)
        x.append(features(blocks))
        y += [b.text[0] == "+" for b in blocks]
    return np.concatenate(x), np.array(y)


Tree = tuple[int, float, "Tree", "Tree"] | bool


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9) -> Tree:
    """A decision tree by Gini impurity; ties go to the earlier feature."""
    if depth == 0 or y.all() or not y.any():
        return bool(y.mean() >= 0.5)
    best: tuple[float, int, float] | None = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            a, b = y[left], y[~left]
            impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best is None:
        return bool(y.mean() >= 0.5)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def classify(tree: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x), bool)
    out[left], out[~left] = classify(tree[2], x[left]), classify(tree[3], x[~left])
    return out


@lru_cache(maxsize=1)
def default_tree() -> Tree:
    return grow(*labelled_table())


@lru_cache(maxsize=1)
def short_tree() -> Tree:
    return grow(*labelled_table(LABELLED_SHORT))


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """The blocks of main text in page order, joined by newlines."""
    blocks = blocks_of(page or "")
    short = not any(b.inside for b in blocks) and sum(b.words for b in blocks) <= SHORT_PAGE
    chosen = tree if tree is not None else short_tree() if short else default_tree()
    good = classify(chosen, features(blocks)) if blocks else []
    return "\n".join(b.text for b, g in zip(blocks, good) if g)


def extract_pages(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages`` (page_id, url, html).

    Null html gives an empty text. Pages are read whole. Repeated rows come back as
    often as they came; other columns are not read. ``n_chars`` counts code points.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows in batches(part, "html"):
                texts = [main_text(h, tree) for h in rows.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
