"""HTML extraction [operator 2]: consensus host paths.

Each page is parsed once for votes: its containers are scored by the text they
hold outside links, and the best one's path of tags and generalised classes is
the page's vote for its host. Spark counts the votes. Each page is then parsed
again and cut out by the paths that won on its host: its own best container
where the host accepts that path, else the host's first choice where the page
has it, else its own best.

Markup that is no article on any page (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) is recognised by tag,
role, and classes that say nothing else, and dropped in both passes; headings in
an article's own header stay. A class that only has such a word in it
(`section-header`, `share-price`) proves nothing: its elements are suspects.
Suspects don't speak for a container, but inside the chosen one they go only if
the host's pages agree that they are no article: their path stands in
LEAST_PLACES places or more, and half of these repeat a text or half of the text
is links. Where a page has no better container than its body, suspects without
such votes go, too.

Null html gives the empty text; a null url is a host of its own; very long
pages are read whole; repeated rows get repeated results; an empty table gives
no rows; extra columns are ignored. Votes are summed before the shuffle, so a
host with a third of all pages is one row for each task. The winners are
broadcast only while there are at most BROADCAST_HOSTS of them; beyond that
they are joined by host, where Spark splits a hot host.
"""

from __future__ import annotations

import hashlib
import html as markup
import re
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import by_batch, staged, table

BROADCAST_HOSTS = 50_000
ACCEPTED_SHARE = 0.2
#: Places of a suspect's path from which on a host's pages can say what it is.
LEAST_PLACES = 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
DROPPED_TAGS = frozenset("head nav header footer aside form button select option datalist noscript template dialog menu svg math object canvas audio video".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CONTAINERS = frozenset("html body main article section div td blockquote center fieldset details".split())
#: Element to the elements it ends when they are open, and where the search stops.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup social share sharing related recommended recommendations comment comments commentlist disqus respond reply replies widget pager pagination toolbar login search alert skip paywall".split()
)
ARTICLE_DROPPED_WORDS = frozenset("ad ads advert advertisement sponsored promo comment comments reply teaser related recommended".split())
#: Of these a word at the start or end of a class is enough.
CERTAIN_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored comment comments commentlist disqus respond reply replies cookie cookies consent gdpr breadcrumb breadcrumbs".split())
GOOD_WORDS = frozenset("article content post entry story text body main page".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ENDLESS = re.compile("<[!?]")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS, _DIGITS = re.compile(r"[a-z0-9]+"), re.compile(r"\d+")


class Page(NamedTuple):
    """Nodes are the blocks that may hold text, numbered in page order."""

    #: Path of each node by its number in `known`, which has (path above, label) of each path.
    paths: list[int]
    known: dict[tuple[int, str], int]
    #: Last node inside each node.
    ends: list[int]
    tags: list[str]
    good: list[bool]
    suspects: list[int]
    #: (node, text, its length without links)
    blocks: list[tuple[int, str, int]]

    def path(self, node: int) -> str:
        """Labels from the root on."""
        above = {number: key for key, number in self.known.items()}
        at, labels = self.paths[node], []
        while at >= 0:
            at, label = above[at]
            labels.append(label)
        return ">".join(reversed(labels))

    def number(self, path: str) -> int | None:
        at = -1
        for label in path.split(">"):
            at = self.known.get((at, label))
            if at is None:
                return None
        return at


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): markup.unescape((v or "").strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)}


def _unwanted(tag: str, attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element is no article for certain, and whether it is a suspect."""
    if tag in DROPPED_TAGS:
        return True, False
    if not attributes or tag in ("html", "body", "main"):
        return False, False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in DROPPED_ROLES or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True, False
    bad = ARTICLE_DROPPED_WORDS if tag == "article" else DROPPED_WORDS
    suspect = False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = _WORDS.findall(name)
        if words and (words[0] in bad or words[-1] in bad) and not {"with", "has", "no", "without"} & set(words):
            if {words[0], words[-1]} & bad & CERTAIN_WORDS or all(w in bad or w.isdigit() for w in words):
                return True, False
            suspect = True
    return False, suspect


class _Open:
    """The open elements, with the places of each tag and of blocks, so that nothing is searched for."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.nodes: list[int] = [-1]

    def push(self, tag: str, node: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.stack))
        if node >= 0:
            self.nodes.append(node)
        self.stack.append((tag, node))

    def pop(self) -> tuple[str, int]:
        tag, node = self.stack.pop()
        self.places[tag].pop()
        if tag in BLOCK_TAGS:
            self.blocks.pop()
        if node >= 0:
            self.nodes.pop()
        return tag, node

    def last(self, tags) -> int:
        """Place of the innermost element with one of the tags, or -1."""
        if tags is BLOCK_TAGS:
            return self.blocks[-1] if self.blocks else -1
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)


def parse_page(html: str) -> Page:
    """One pass; its time grows with the page, whatever is left open or nested."""
    page = Page([], {}, [], [], [], [], [])
    opened = _Open()
    pieces: list[str] = []
    links = linked = 0
    #: Where in the stack text was last dropped or taken up again, in turns.
    turns: list[int] = []
    own_header = False

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                page.blocks.append((opened.nodes[-1], text, max(0, len(text) - linked)))
            pieces.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links
        if opened.last(BLOCK_TAGS) >= depth:
            flush()
        while len(opened.stack) > depth:
            tag, node = opened.pop()
            if node >= 0:
                page.ends[node] = len(page.paths) - 1
            links -= tag == "a"
        while turns and len(opened.stack) <= turns[-1]:
            turns.pop()

    def close(names: tuple[str, ...], stops) -> None:
        place = opened.last(names)
        if place >= 0 and place >= opened.last(stops):
            pop_to(place)

    def say(text: str) -> None:
        nonlocal linked
        if text and len(turns) % 2 == 0:
            text = markup.unescape(text) if "&" in text else text
            pieces.append(text)
            if links:
                linked += len(text)

    at, size, last_end = 0, len(html), html.rfind(">")
    while at < size:
        if at > last_end:  # no more tags; a comment needs no end
            rest = _ENDLESS.search(html, at)
            say(html[at : rest.start() if rest else size])
            break
        found = _TOKEN.search(html, at)
        if not found:
            say(html[at:])
            break
        say(html[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        if found[1] or found[4]:
            if tag == "br":
                say(" ")
            elif tag in BLOCK_TAGS:
                close((tag,), ())
            else:
                close((tag,), BLOCK_TAGS)
            continue
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}[^>]*>", re.I).search(html, at, last_end + 1)
            at = over.end() if over else size
            continue
        if tag in BLOCK_TAGS:
            close(("p",), BLOCK_TAGS)
            if tag in ENDS:
                close(*ENDS[tag])
            flush()
        if tag in VOID:
            if tag == "br":
                say(" ")
            continue
        raw = found[3] or found[6] or ""
        attributes = _attributes(raw) if raw.strip(" /\n\t\r") else {}
        suspect = False
        if len(turns) % 2 == 0:
            unwanted, suspect = _unwanted(tag, attributes)
            if unwanted:
                if tag in BLOCK_TAGS:
                    flush()
                own_header = tag == "header" and opened.last(("article",)) >= 0
                turns.append(len(opened.stack))
        elif own_header and tag in HEADINGS:
            turns.append(len(opened.stack))
        node = -1
        if tag in BLOCK_TAGS and len(turns) % 2 == 0:
            node, up = len(page.paths), opened.nodes[-1]
            classes = sorted(_DIGITS.sub("#", c) for c in attributes.get("class", "").lower().replace(">", " ").split())
            page.paths.append(page.known.setdefault((page.paths[up] if up >= 0 else -1, ".".join([tag, *classes])), len(page.known)))
            page.ends.append(-1)
            page.tags.append(tag)
            if suspect:
                page.suspects.append(node)
            page.good.append(bool(GOOD_WORDS & set(_WORDS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))))
        if not raw.endswith("/") or tag in BLOCK_TAGS or tag == "a":
            opened.push(tag, node)
            links += tag == "a"
    flush()
    pop_to(0)
    return page


def _inside(page: Page, nodes: list[int]) -> np.ndarray:
    """Which nodes are in any of some nodes."""
    inside = np.zeros(len(page.paths) + 2, np.int64)
    for n in nodes:
        inside[n] += 1
        inside[page.ends[n] + 1] -= 1
    return np.cumsum(inside) > 0


def best_container(page: Page) -> int:
    """The container with most text outside links and suspects, weighed by what its tag and class promise; the innermost of equals; -1 without any."""
    held, suspect = np.zeros(len(page.paths) + 1), _inside(page, page.suspects)
    for node, _, size in page.blocks:
        if node >= 0 and not suspect[node]:
            held[node + 1] += size
    sums = np.cumsum(held)
    best, top = -1, 0.0
    for node, tag in enumerate(page.tags):
        if tag in CONTAINERS:
            prior = 1.5 if tag in ("article", "main") else 0.7 if tag in ("html", "body") else 1.25 if page.good[node] else 1.0
            score = prior * (sums[page.ends[node] + 1] - sums[node])
            if score > 0 and score >= top:
                best, top = node, score
    return best


def suspect_texts(page: Page) -> list[tuple[str, str, int, int]]:
    """(path, text, its length, how much of that is links) of each suspect that is in no other."""
    outer: list[int] = []
    for n in page.suspects:
        if not outer or n > page.ends[outer[-1]]:
            outer.append(n)
    own: list[list[tuple[str, int]]] = [[] for _ in outer]
    for node, text, size in page.blocks if outer else []:
        k = bisect_right(outer, node) - 1
        if k >= 0 and node <= page.ends[outer[k]]:
            own[k].append((text, size))
    return [(page.path(n), "\n".join(t for t, _ in x), sum(len(t) for t, _ in x), sum(len(t) - size for t, size in x)) for n, x in zip(outer, own, strict=True)]


def cut_out(page: Page, winner: str | None, accepted: list[str] | None, boilerplate: list[str] | None = None) -> str:
    best = best_container(page)
    if best < 0:
        return "\n".join(text for _, text, _ in page.blocks)
    path = page.paths[best]
    if winner and path not in {page.number(x) for x in accepted or ()}:
        won = page.number(winner)
        path = path if won is None else won
    voted = {page.number(x) for x in boilerplate or ()}
    found = _text(page, [n for n, p in enumerate(page.paths) if p == path], voted)
    return found or _text(page, [best], voted)


def _text(page: Page, nodes: list[int], voted: set[int | None]) -> str:
    """The blocks inside any of the nodes, without suspects that are voted out, or all of them in a whole body."""
    whole = any(page.tags[n] in ("html", "body") for n in nodes)
    inside, out = _inside(page, nodes), _inside(page, [n for n in page.suspects if whole or page.paths[n] in voted])
    return "\n".join(text for node, text, _ in page.blocks if node >= 0 and inside[node] and not out[node])


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, places, texts, size, linked) over all pages: votes for a container's path, and of a suspect's path its places, distinct texts, length and links."""

    def step(batch: pa.RecordBatch):
        out = []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = parse_page(html or "")
            best = best_container(page)
            if best >= 0:
                out.append((host, page.path(best), None, 0, 0))
            out += [(host, path, hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), size, linked) for path, text, size, linked in suspect_texts(page)]
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.string()] * 3 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["host", "path", "digest", "size", "linked"])

    rows = by_batch(pages.select(host_of().alias("host"), "html"), step, "host string, path string, digest string, size bigint, linked bigint")
    texts = rows.groupBy("host", "path", "digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("linked").alias("linked"))
    suspect = F.col("digest").isNotNull()
    none = F.lit(0).cast("long")
    return texts.groupBy("host", "path").agg(
        F.sum(F.when(suspect, none).otherwise(F.col("n"))).alias("votes"), F.sum(F.when(suspect, F.col("n")).otherwise(none)).alias("places"), F.count("digest").alias("texts"), F.sum("size").alias("size"), F.sum("linked").alias("linked")
    )


def host_winners(votes: DataFrame) -> DataFrame:
    """(host, winner, accepted, boilerplate): the path with most votes, all with ACCEPTED_SHARE of the host's votes, and those of suspects that are no article."""
    best = F.max(F.when(F.col("votes") > 0, F.struct("votes", "path"))).alias("top")
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"), best)
    out = (F.col("places") >= LEAST_PLACES) & ((2 * F.col("texts") <= F.col("places")) | (2 * F.col("linked") >= F.col("size")))
    accepted = F.when((F.col("votes") > 0) & (F.col("votes") >= ACCEPTED_SHARE * F.col("total")), F.col("path"))
    both = votes.join(total, "host").select("host", "top", accepted.alias("a"), F.when(out, F.col("path")).alias("b")).where("a IS NOT NULL OR b IS NOT NULL")
    return both.groupBy("host").agg(F.first("top.path").alias("winner"), F.array_sort(F.collect_set("a")).alias("accepted"), F.array_sort(F.collect_set("b")).alias("boilerplate"))


def extract_main_text(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """pages(page_id, url, html) to (page_id, url, text, n_chars)."""
    winners = staged(host_winners(host_votes(pages)), "winners")
    known = pages.select("page_id", "url", "html", host_of().alias("host"))
    small = winners.count() <= broadcast_hosts
    joined = known.join(F.broadcast(winners) if small else winners, "host", "left").select("page_id", "url", "html", "winner", "accepted", "boilerplate")

    def step(batch: pa.RecordBatch):
        texts = [cut_out(parse_page(html or ""), *found) for html, *found in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return by_batch(joined, step, "page_id bigint, url string, text string, n_chars bigint")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
