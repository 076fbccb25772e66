"""Main text of web pages: the paths that a host's pages agree on say where it stands.

A page is read once into blocks of text and the containers around them. Containers are scored: text
outside links, less the further up it lies, more for elements and class names that articles have. The
best one votes, by its generalised path (tags and class names from the body down, digits as ``#``),
for its host. The votes are counted in Spark; the paths with a twentieth of a host's votes, twenty at
most, are its consensus. Then every page is read again and its text taken from the winning path that it
holds; a page without any, or without a host, falls back to its own best container.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left out wherever
they lie, known by their tag, role, or a word in a class name or id.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import rows_out, slices
from annalist.scratch import materialize

#: A path with less of its host's votes than this share is no consensus.
QUORUM = 0.05
#: Text counts this much less with each container further up; siblings of a winner with more of it in links are left out.
FADES, LINKED = 0.8, 0.3
#: Elements nested more deeply stand beside each other, as in browsers.
DEPTH = 512

TAG = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)(?:>|\Z)|<[!?/](?:[^>]*+)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

CONTAINERS = frozenset("article blockquote body center div main section td".split())
BLOCKS = CONTAINERS | frozenset(
    "address aside caption dd details dialog dir dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li menu nav ol optgroup "
    "option p pre search select summary table tbody tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup; only the first two kinds below are texts at all, and those are not of the page's body.
RAW = frozenset("textarea title iframe noembed noframes script style xmp".split())
NEVER = frozenset("aside audio button canvas datalist dialog footer iframe menu nav noscript object search select svg template video".split())
MAYBE = frozenset("form header".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: An opening tag closes the open element of these names, unless one of the others lies between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)), "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}

#: Words of class names and ids. Reader comments are never part of an article; the others may also name a wrapper around one.
COMMENTS = re.compile(r"(?:^|-)(?:comments?|commentlist|commentary|disqus|respond|replies)(?:-|$)")
APART = re.compile(
    r"(?:^|-)(?:ads?|adsbygoogle|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promos|promotion|alert|banner|consent|cookie|cookies|disclaimer|gdpr|notice|notification|"
    r"modal|overlay|paywall|popup|snackbar|toast|aside|sidebar|related|recommended|recommendations|widget|widgets|breadcrumb|breadcrumbs|menu|nav|navbar|navigation|pager|pagination|"
    r"skip|toc|toolbar|topbar|footer|copyright|header|masthead|login|newsletter|search|signup|subscribe|subscription|share|sharing|social)(?:-|$)"
)
WRAPS = re.compile(r"^(?:has|no|not|with|without|is)-|-(?:with|without|no|has)-")
ARTICLE = re.compile(r"(?:^|-)(?:article|blog|body|content|entry|main|post|story|text)(?:-|$)")
HUMP, DIGITS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])"), re.compile(r"\d+")


def words_of_name(name: str) -> str:
    """A class name or id, in small letters with a hyphen between its words."""
    return HUMP.sub("-", name).replace("_", "-").lower()


def generalised(name: str) -> str:
    """A class name as it stands in a path: numbers are alike, and names mixed of digits and letters, as machines make them, too."""
    plain = DIGITS.sub("#", name.lower())
    return "*" if plain.count("#") > 1 else plain


class Page:
    """The blocks of a page, in its order, and the containers around them."""

    def __init__(self, source: str):
        self.known: dict[str, str] = {}  # equal paths are one string
        self.path, self.parent, self.tag, self.weight, self.node_apart = ["body"], [-1], ["body"], [0.5], [None]
        self.blocks: list[tuple[int, str, int, int | None, bool]] = []  # node, text, characters in links, what sets it apart, heading
        self.apart: list[list] = []  # [kind, the one around it, whether an article lies inside]
        self.stack: list[tuple[str, int, int | None]] = [("body", 0, None)]  # tag, node, what sets it apart
        self.pieces: list[str] = []
        self.linked, self.link_depth = 0, 0  # characters in links so far, depth of the stack at an open link
        self.read(source)
        self.end_block()

    # Reading ----------------------------------------------------------------------------------------

    def read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = TAG.search(source, at)
            self.text(source[at : found.start() if found else end])
            if not found:
                return
            at = found.end()
            if found[2] is None:
                continue
            tag = found[2].lower()
            if found[1]:
                self.close(tag)
            elif tag in RAW:
                stop = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(source, at)
                at = stop.start() if stop else end
            else:
                self.open(tag, found[3])

    def text(self, text: str) -> None:
        if text:
            plain = html.unescape(text) if "&" in text else text
            self.pieces.append(plain)
            if self.link_depth:
                self.linked += len("".join(plain.split()))

    def end_block(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            tag, node, apart = self.stack[-1]
            self.blocks.append((node, text, self.linked, apart, tag in HEADINGS))
        self.pieces, self.linked = [], 0

    def pop_to(self, depth: int) -> None:
        self.end_block()
        del self.stack[depth:]
        if self.link_depth > depth:
            self.link_depth = 0

    def close_open(self, names: tuple, bounds: tuple) -> None:
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] in names:
                return self.pop_to(depth)
            if self.stack[depth][0] in bounds:
                return None

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link_depth = 0
        if tag in ("body", "html"):
            return self.end_block()
        bounds = () if tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot") else ("td", "th")
        if tag in BLOCKS:
            self.end_block()
        if tag in BLOCKS or self.stack[-1][2] is not None:
            self.close_open((tag,), bounds)

    def open(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return self.end_block()
        if tag == "br":
            self.pieces.append(" ")
            return
        block = tag in BLOCKS
        if block:
            self.end_block()
            self.close_open(("p", *HEADINGS) if tag in HEADINGS else ("p",), ("td", "th", "table", "button"))
            if tag in CLOSES:
                self.close_open(*CLOSES[tag])
        if tag in VOID or len(self.stack) >= DEPTH:
            return
        _, node, around = self.stack[-1]
        names, kind = [], "never" if tag in NEVER else tag if tag in MAYBE else None
        if attributes and not attributes.isspace():
            names, marked = self.names(tag, attributes)
            kind = "never" if "never" in (kind, marked) else kind or marked
        if tag in ("article", "main") and kind is None:
            up = around
            while up is not None:
                self.apart[up][2] = True
                up = self.apart[up][1]
        if tag == "a":
            self.link_depth = len(self.stack)
        if kind:
            self.apart.append([kind, around, False])
            around = len(self.apart) - 1
        if not (block or kind or around is not None):
            return
        if tag in CONTAINERS or kind:
            plain = [generalised(c) for c in names]
            path = ".".join([f"{self.path[node]}>{tag}", *sorted(set(plain))])
            self.path.append(self.known.setdefault(path, path))
            self.parent.append(node)
            self.tag.append(tag)
            likely = any(ARTICLE.search(words_of_name(c)) for c in names)
            self.weight.append(2.0 if tag == "article" else 1.6 if tag == "main" else 0 if tag not in CONTAINERS else 1.3 if likely else 1.0)
            self.node_apart.append(around)
            node = len(self.path) - 1
        self.stack.append((tag, node, around))

    @staticmethod
    def names(tag: str, attributes: str) -> tuple[list[str], str | None]:
        """An element's class names, and whether its attributes set it apart: never or maybe."""
        found = {}
        for name, *values in ATTRIBUTE.findall(attributes):
            found.setdefault(name.lower(), html.unescape("".join(values)))
        classes = found.get("class", "").split()
        style = found.get("style", "").replace(" ", "").lower()
        hidden = ("hidden" in found and found["hidden"].lower() != "until-found") or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
        if hidden or found.get("role", "").lower() in ROLES:
            return classes, "never"
        marks = [words_of_name(c) for c in [*classes, *found.get("id", "").split()]]
        marks = [m for m in marks if not WRAPS.search(m)]
        if tag != "main" and any(COMMENTS.search(m) for m in marks):
            return classes, "never"
        if tag not in ("main", "article") and tag not in HEADINGS:
            if any(APART.search(m) for m in marks):
                return classes, "header" if any(m.endswith("header") and ARTICLE.search(m) for m in marks) else "maybe"
        elif tag == "article" and any(APART.search(m) and not ARTICLE.search(m) for m in marks):
            return classes, "maybe"
        return classes, None

    # Judging ----------------------------------------------------------------------------------------

    def left_out(self, apart: int | None, heading: bool, inside: int | None = None, strict: bool = True) -> bool:
        """Whether something set apart is no part of the text; what lies around the node ``inside`` does not count.

        ``strict`` False passes over what a class name alone says.
        """
        until = None if inside is None else self.node_apart[inside]
        while apart is not None and apart != until:
            kind, up, article = self.apart[apart]
            in_article = kind == "header" and heading and bool(inside)  # a title's, not the page's
            if kind == "never" or (strict and not article and not in_article):
                return True
            apart = up
        return False

    def scores(self, strict: bool = True) -> tuple[list[float], list[float]]:
        """Of every container its score, and the share of its text in links."""
        n = len(self.path)
        near, whole, links = [0.0] * n, [0] * n, [0] * n
        for node, text, linked, apart, heading in self.blocks:
            if not self.left_out(apart, heading, strict=strict):
                near[node] += max(0, len(text) - linked)
                whole[node] += len(text)
                links[node] += linked
        for node in range(n - 1, 0, -1):
            up = self.parent[node]
            near[up] += FADES * near[node]
            whole[up] += whole[node]
            links[up] += links[node]
        shares = [min(1.0, links[i] / whole[i]) if whole[i] else 0.0 for i in range(n)]
        return [near[i] * self.weight[i] * (1 - shares[i]) for i in range(n)], shares

    def best(self) -> int | None:
        """The container with the highest score; the one around it, if that adds little but headings. None without a text."""
        for strict in (True, False):
            scores, _ = self.scores(strict)
            top = max(range(len(scores)), key=lambda i: (scores[i], -i))
            if scores[top] > 0:
                break
        else:
            return None
        while self.parent[top] > 0 and self.weight[self.parent[top]]:
            up = self.parent[top]
            mine, more, headed = 0, 0, False
            for node, text, _, apart, heading in self.blocks:
                if not self.left_out(apart, heading, up, strict) and self.within(node, up):
                    inner = self.within(node, top)
                    mine += len(text) if inner else 0
                    headed |= heading and not inner
                    more += 0 if inner or heading else len(text)
            if not headed or 20 * more > mine:
                break
            top = up
        return top

    def within(self, node: int, container: int) -> bool:
        while node > container:
            node = self.parent[node]
        return node == container

    def chosen(self, votes: dict[str, int]) -> list[int]:
        """The containers to take the text from: those on the path with most votes and score, or the page's own best.

        Votes count squared, so a page's own score decides only between paths that its host uses about as often.
        """
        scores, shares = self.scores()
        reach: dict[str, float] = {}
        for node, path in enumerate(self.path):
            if path in votes and self.weight[node] and scores[node] > 0:
                reach[path] = max(reach.get(path, 0), scores[node])
        if reach:
            path = max(sorted(reach), key=lambda p: votes[p] ** 2 * reach[p])
            found = [i for i, p in enumerate(self.path) if p == path and scores[i] > 0]
            top = max(found, key=lambda i: (scores[i], -i))
            return [i for i in found if i == top or shares[i] < LINKED]
        own = self.best()
        return [] if own is None else [own]

    def main_text(self, votes: dict[str, int]) -> str:
        out = []
        taken = self.chosen(votes)
        for strict in (True, False):  # what class names say is passed over only where nothing else is left
            for node, text, _, apart, heading in self.blocks:
                inside = next((c for c in taken if self.within(node, c)), None)
                if inside is not None and not self.left_out(apart, heading, inside, strict):
                    out.append(text)
            if out:
                break
        return "\n".join(out)


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to a slash, question mark or hash, in small letters; empty where there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def sources(pages: DataFrame, html_col: str) -> Column:
    return F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html")


def consensus(pages: DataFrame, quorum: float = QUORUM, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, paths): the paths with at least ``quorum`` of a host's votes, as a map from path to votes."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hosts, paths = [], []
            for host, body in zip(*(c.to_pylist() for c in batch.columns)):
                page = Page(body.decode("utf-8", "replace"))
                best = page.best()
                if best is not None:
                    hosts.append(host)
                    paths.append(page.path[best])
            yield rows_out({"host": pa.string(), "path": pa.string()}, {"host": hosts, "path": paths})

    read = pages.select(host_of(F.col(url_col)).alias("host"), sources(pages, html_col)).filter("host != ''")
    votes = materialize(read.mapInArrow(vote, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("votes")), "votes")
    cast = votes.groupBy("host").agg(F.sum("votes").alias("cast"))
    winning = votes.join(cast, "host").filter(F.col("votes") >= quorum * F.col("cast"))
    return winning.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("path", "votes"))).alias("paths"))


TEXT = {"page_id": pa.int64(), "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}


def extract(pages: DataFrame, quorum: float = QUORUM, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its main text, blocks joined by a line break.

    Character references are decoded once, white space inside a block (no-break spaces and ``<br>``
    too) is one space, blocks are trimmed, empty ones left out.

    Null and empty pages have an empty text. Pages without a host (null url, or no ``://``) neither
    vote nor follow. Equal scores go to the container further up or earlier, equal votes and scores
    to the smaller path. Repeated rows vote and are reported each; null ids stay; an empty table
    gives no rows; very long pages are read whole; malformed UTF-8 becomes U+FFFD; unclosed and stray
    tags are read as browsers do; columns other than the three named are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in TEXT}
            for page_id, url, body, paths in zip(*(c.to_pylist() for c in batch.columns)):
                text = Page(body.decode("utf-8", "replace")).main_text(dict(paths or ()))
                for k, v in zip(TEXT, (page_id, url, text, len(text))):
                    out[k].append(v)
            yield rows_out(TEXT, out)

    held = materialize(consensus(pages, quorum, url_col, html_col), "consensus")
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), sources(pages, html_col), host_of(F.col(url_col)).alias("host"))
    # The table of hosts is small or the join is split where a host is hot: nothing is gathered by host.
    return read.join(held, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(run, "page_id long, url string, text string, n_chars long")
