"""Main text of web pages by consensus host paths.

1. Each page's containers (article, main, section, div, td, body) are scored by how much of the page's good text (outside menus, headers, footers,
   sidebars, notices, adverts, forms, comments, scripts and styles; links count against) they hold. A page's own container is the outermost article or
   main that holds COVERAGE of it, or else the deepest container that holds all of it, so that nothing inside is lost. A page votes for
   its own container by its generalised path: tags and classes from the body down, digits removed.
2. Spark sums the votes for each host and path; the path with most wins the host.
3. Every page is extracted again by its host's path. A page whose own container is an article or main uses that whole; so does a page on which the
   path holds less than AGREES of what its own container holds, where blocks that stand REPEATS times or more on the page don't count.

Winners are one row a host. They are broadcast up to a checked number of hosts; beyond it, pages and winners meet in a join on host and a
salt, so that no host's pages go to one task.

A menu, header, sidebar or the like is told by its tag, role, or a class or id. Tags and roles, and names of nothing but listed and neutral words (related-posts,
user-feedback), leave an element out unless it holds more than half of its article's good text, or of the page's where there is no article (reader comments: all but a tenth).
A name that has a listed word first or last among others (search-algorithms, form-content) only raises doubt: the element stays if it reads as prose (PROSE words at least,
less than half of its characters in links) and doesn't repeat. An element repeats if its host has it by the same path on three pages or more with at most half as many
different texts; Spark counts that along with the votes. Flags (has-sidebar) say nothing. What encloses the page's largest article or main is never left out, unless it is
hidden. Headings in the header element of an article or main belong to it, at any depth; if an article or main holds no h1, the last h1 before it that isn't left out
comes first. Time is linear in a page's length, however deep it nests.

Defined results: null and empty html give the empty text; a null url has no host, such pages use their own container; broken markup is read as browsers
do as far as blocks go (open elements end where an outer one ends; what is cut off within a tag is dropped). White space in a block becomes one space,
blocks are joined by one newline, empty blocks are dropped. Repeated rows give repeated results, an empty table none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, stored

#: Most hosts whose winning paths are broadcast; a path longer than PATH_CHARS characters stands as its digest, which tells different paths apart as well.
BROADCAST_HOSTS, PATH_CHARS = 20_000, 300
#: Share of the good text that an article must hold to be the page's own container, the least share of the own container's text for the host's path to
#: count, and how often a block stands on a page at least to be no part of that share.
COVERAGE, AGREES, REPEATS = 0.7, 0.7, 3
#: Elements by what they mean for the text.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
LEFT_OUT = {"nav", "header", "footer", "aside", "form", "button", "select", "svg", "math", "object", "audio", "video", "canvas", "dialog", "menu", "head"}
WHOLE = {"article", "main"}
CONTAINERS = {"article", "main", "section", "div", "td", "body"}
BLOCKS = CONTAINERS | LEFT_OUT | set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr th caption figure figcaption hr address details summary fieldset html center hgroup search".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_ITSELF = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
LEFT_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
LEFT_OUT_WORDS = set(
    "nav navbar navigation menu submenu header masthead topbar footer foot sidebar side rail widget widgets ad ads adv advert advertisement adverts adsbygoogle banner promo promotion "
    "sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond reply replies discussion feedback breadcrumb breadcrumbs pagination pager form search toolbar skip copyright legal disclaimer".split()
)
COMMENT_WORDS = set("comment comments commentlist disqus respond reply replies discussion feedback".split())
#: Words that say nothing of what an element holds, beside listed ones.
NEUTRAL_WORDS = set("user users reader readers visitor post posts page site main top bottom left right inner outer list lists item items box block area section wrap wrapper container panel bar btn button buttons links link icons icon group row col column module unit slot region primary secondary global local js".split())
#: The least words of a doubtful element that reads as prose; the shares of its article's good text above which a named element, and one of comments, is no such thing.
PROSE, MOST, MOST_COMMENTS = 12, 0.5, 0.9
#: What is known of an element that may be left out.
DOUBTFUL, NAMED, COMMENTS = 1, 2, 3
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: A class with one of these words says something of what it is on, not what it is: has-sidebar, no-comments, with-ads.
FLAG_WORDS = set("has have no not non with without is show hide enable enabled disable disabled".split())
#: Elements that are left out whatever stands in them; the other ones of LEFT_OUT stay where they enclose the page's article or most of its text.
ALWAYS_OUT = {"button", "select", "svg", "math", "object", "audio", "video", "canvas"}
SPLIT_WORDS = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"\d+")


#: The region of what never counts.
GONE = -1


def named_out(attributes: dict[str, str]) -> int:
    """What a class or id says of its element: 0 (nothing), DOUBTFUL, NAMED or COMMENTS."""
    out = 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w for w in SPLIT_WORDS.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w and not w.isdigit()]
        if words and (words[0] in LEFT_OUT_WORDS or words[-1] in LEFT_OUT_WORDS and not FLAG_WORDS.intersection(words)):
            sure = all(w in LEFT_OUT_WORDS or w in NEUTRAL_WORDS for w in words)
            out = max(out, (COMMENTS if COMMENT_WORDS.intersection(words) else NAMED) if sure else DOUBTFUL)
    return out


class Page:
    """Blocks of good text with the container each stands in, and the containers with their paths."""

    def __init__(self, source: str, repeated: frozenset | set = frozenset()) -> None:
        self._repeated = repeated  # paths of doubtful elements that repeat on this page's host
        self.paths: list[str] = ["body"]
        self.parents: list[int] = [-1]
        self.tags: list[str] = ["body"]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        self.titles: list[int] = []  # blocks that are an h1
        self._outer: list[int] = [-1]  # regions: what may be left out, each with the one around it; 0 is the page
        self._why: list[int] = [0]  # of each region: DOUBTFUL, NAMED or COMMENTS
        self.region_paths: list[str] = [""]
        self._stands_in: list[int] = [0]  # the container around each region
        self._found: list[tuple[int, int, str, int, bool]] = []  # region, container, text, characters in links, whether an h1
        self._headers: set[int] = set()  # regions that the header of an article or main opened
        self._regions: list[int] = [0]  # of each container
        self._stack: list[tuple[str, int, int, int, int]] = [("body", 0, 0, 0, 0)]  # tag, region or GONE, container, depths of the nearest container and block
        self._open_at: defaultdict[str, list[int]] = defaultdict(list)  # depths of the open elements of each tag
        self._buffer: list[str] = []
        self._links = 0
        self._at, self._title = (0, 0), False
        self._read(source)
        self._flush()
        kept = self._kept()
        counted = [f for f in self._found if kept[f[0]]]
        self.blocks = [(c, text, links) for _, c, text, links, _ in counted]
        self.titles = [i for i, f in enumerate(counted) if f[4]]

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join(html.unescape("".join(self._buffer)).split())
            if text:
                self._found.append((*self._at, text, self._links, self._title))
            self._buffer, self._links = [], 0

    def _text(self, text: str) -> None:
        if text:
            _, region, container, *_ = self._stack[-1]
            if region != self._at[0]:
                self._flush()
            self._at = (region, container)
            if region == GONE:
                return
            self._buffer.append(text)
            self._title = bool(self._open_at["h1"])
            if self._open_at["a"]:
                self._links += len(text)

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            tag = self._stack.pop()[0]
            self._open_at[tag].pop()
            if tag in BLOCKS:
                self._flush()

    def _last(self, tags) -> int:
        """The depth of the innermost open element of these tags, or 0."""
        return max((self._open_at[t][-1] for t in tags if self._open_at[t]), default=0)

    def _close(self, tag: str) -> None:
        depth = self._last((tag,))
        if depth and (tag in BLOCKS or depth >= self._stack[-1][3]):
            self._pop_to(depth)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            depth = self._stack[-1][4]
            if depth and (self._stack[depth][0] == "p" or self._stack[depth][0] in HEADINGS and tag in HEADINGS):  # a block ends an open paragraph
                self._pop_to(depth)
            if tag in CLOSES_ITSELF:
                depth = self._last({"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,)))
                if depth and depth > self._last(CLOSES_ITSELF[tag]):
                    self._pop_to(depth)
        if tag == "body" or tag == "html":
            return
        _, region, container, in_container, in_block = self._stack[-1]
        around = region
        label = tag
        found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        if tag in HEADINGS and region in self._headers:
            region = self._outer[region]  # an article's own heading stands in its header
        role = found.get("role", "").lower()
        if tag in ALWAYS_OUT or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in "".join(found.get("style", "").lower().split()):
            region = GONE
        elif region != GONE and (why := NAMED if tag in LEFT_OUT or role in LEFT_OUT_ROLES else named_out(found) if found and tag not in WHOLE else 0):
            self._outer.append(region)
            self._why.append(max(why, named_out(found)) if why == NAMED and found else why)
            self.region_paths.append(f"{self.paths[container]}/{tag}." + ".".join(sorted(DIGITS.sub("", f"{found.get('class', '')} {found.get('id', '')}").lower().split())))
            self._stands_in.append(container)
            region = len(self._outer) - 1
            if tag == "header" and any(self._open_at[t] for t in WHOLE):
                self._headers.add(region)
        if tag in CONTAINERS and region != GONE:
            names = sorted(w for w in DIGITS.sub("", found.get("class", "")).lower().split() if w)
            label = ".".join([tag, *names])
            path = f"{self.paths[container]}/{label}"
            self.paths.append(path if len(path) <= PATH_CHARS else "#" + hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest())
            self.parents.append(container)
            self.tags.append(tag)
            self._regions.append(region)
            container = len(self.paths) - 1
        if tag not in VOID and (tag in BLOCKS or tag == "a" or region != around or self._open_at[tag]):  # other inline elements mean nothing for the text
            depth = len(self._stack)
            self._stack.append((tag, region, container, depth if tag in CONTAINERS else in_container, depth if tag in BLOCKS else in_block))
            self._open_at[tag].append(depth)

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = TAG.search(source, at)
            if m is None:
                self._text(source[at:])
                return
            if m.start() > at:
                self._text(source[at : m.start()])
            at, tag = m.end(), m.group(2)
            if tag is None:
                if source.startswith("<![CDATA[", m.start()):
                    self._text(html.escape(m.group()[9:].removesuffix("]]>"), quote=False))
                continue
            tag = tag.lower()
            if m.group(1):
                if tag in BLOCKS:
                    self._flush()
                self._close(tag)
            elif tag in RAW:
                close = re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I).search(source, at)
                at = close.end() if close else end
            else:
                self._open(tag, m.group(3))
                if tag == "br":
                    self._text(" ")
                elif tag in ("td", "th"):
                    self._text(" ")

    def _reads_as_prose(self, region: int, words: list[int], good: list[int], linked: list[int]) -> bool:
        return words[region] >= PROSE and good[region] > linked[region] and self.region_paths[region] not in self._repeated

    def _kept(self) -> list[bool]:
        """For each region whether it counts: by its share of its article's text (of the page's, where no article is), by how it reads, or because it encloses the
        article or main that holds the most text."""
        n_regions = len(self._outer)
        kept = [True] + [False] * (n_regions - 1)
        if n_regions == 1:
            return kept
        articles: list[int] = []  # of each container the innermost article or main
        for c, tag in enumerate(self.tags):
            articles.append(c if tag in WHOLE else articles[self.parents[c]] if c else -1)
        (inside, words, good, linked), total = ([0] * n_regions for _ in range(4)), [0] * len(self.tags)
        for r, c, text, links, _ in self._found:
            n = max(0, len(text) - 2 * links)
            inside[r] += n
            words[r] += text.count(" ") + 1
            good[r] += len(text) - links
            linked[r] += links
            total[c] += n
        for c in range(len(total) - 1, 0, -1):
            total[self.parents[c]] += total[c]
        for r in range(n_regions - 1, 0, -1):
            for x in (inside, words, good, linked):
                x[self._outer[r]] += x[r]
        stays = [True]
        for r in range(1, n_regions):
            article = articles[self._stands_in[r]]
            of = total[article] if article >= 0 else total[0]
            if self._why[r] == DOUBTFUL:
                stays.append(self._reads_as_prose(r, words, good, linked))
            else:
                stays.append(inside[r] > (MOST_COMMENTS if self._why[r] == COMMENTS else MOST) * of)
        held = Counter()
        for r, c, text, links, _ in self._found:
            article = articles[c]
            if article >= 0:
                own = self._regions[article]
                while r != own and r > 0 and stays[r]:  # regions within the article, each inside the one before
                    r = self._outer[r]
                if r == own:
                    held[article] += max(0, len(text) - 2 * links)
        most = max(held, key=lambda c: (held[c], -c), default=-1)
        if most >= 0 and held[most]:
            at = self._regions[most]
            while at > 0:
                kept[at], at = True, self._outer[at]
        for r in range(1, n_regions):
            kept[r] = kept[r] or kept[self._outer[r]] and stays[r] and (articles[self._stands_in[r]] >= 0 or not any(held.values()))
        return kept

    def doubtful(self) -> dict[str, str]:
        """The paths of doubtful elements with a digest of their texts."""
        seen: dict[str, object] = {}
        for r, _, text, *_ in self._found:
            if r > 0 and self._why[r] == DOUBTFUL:
                seen.setdefault(self.region_paths[r], hashlib.blake2b(digest_size=12)).update(text.encode("utf-8", "surrogatepass") + b"\n")
        return {path: h.hexdigest() for path, h in seen.items()}

    def weights(self, but: set[str] | frozenset = frozenset()) -> list[int]:
        """Good characters in each container's subtree, without the blocks in but; links count against."""
        own = [0] * len(self.paths)
        for c, text, links in self.blocks:
            if text not in but:
                own[c] += max(0, len(text) - 2 * links)
        for c in range(len(own) - 1, 0, -1):
            own[self.parents[c]] += own[c]
        return own

    def best(self, weights: list[int]) -> int:
        """The page's own container: the outermost article or main with COVERAGE of the good text, or else the deepest container with all of it."""
        if not weights[0]:
            return 0
        at, shared = 0, 0
        for c in range(1, len(weights)):  # parents come before children
            if weights[c] >= COVERAGE * weights[0] and self.parents[c] == at:
                if self.tags[c] in WHOLE:
                    return c
                at = c
                shared = c if weights[c] == weights[0] and self.parents[c] == shared else shared
        return shared

    def unrepeated(self) -> list[int]:
        """weights() without the blocks that stand REPEATS times or more on the page."""
        counts = Counter(text for _, text, _ in self.blocks)
        return self.weights({text for text, n in counts.items() if n >= REPEATS})

    def text(self, roots: set[int]) -> str:
        inside = []
        for c in range(len(self.paths)):
            inside.append(c in roots or self.parents[c] >= 0 and inside[self.parents[c]])
        held = [i for i, (c, *_) in enumerate(self.blocks) if inside[c]]
        if len(roots) == 1 and self.tags[min(roots)] in WHOLE and held and not any(inside[self.blocks[i][0]] for i in self.titles):
            held = [i for i in self.titles if i < held[0]][-1:] + held
        return "\n".join(self.blocks[i][1] for i in held)


def own_vote(page: Page) -> tuple[str, float]:
    weights = page.weights()
    best = page.best(weights)
    return page.paths[best], weights[best] / weights[0] if weights[0] else 0.0


def vote(source: str) -> tuple[str, float]:
    """The generalised path that a page votes for, and the vote's weight: the share of good text it holds."""
    return own_vote(Page(source))


def extract(source: str, path: str | None, repeated: frozenset | set = frozenset()) -> str:
    """The text under the host's path, or under the page's own container where that path holds too little here. ``repeated``: what its host has on many pages."""
    page = Page(source, repeated)
    weights = page.weights()
    best = page.best(weights)
    roots = {c for c, p in enumerate(page.paths) if p == path} if path and page.tags[best] not in WHOLE else set()
    counted = page.unrepeated() if roots else weights
    if sum(counted[c] for c in roots if page.parents[c] not in roots) < AGREES * counted[best] or not roots:
        roots = {best}
    return page.text(roots)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, repeated: the path with the highest sum of votes for each host, ties to the path that sorts first, and the paths of doubtful elements that repeat."""

    def run(hosts, sources):
        out = {"host": [], "path": [], "weight": [], "digest": []}
        for host, source in zip(hosts.to_pylist(), sources.to_pylist()):
            page = Page(source)
            for path, weight, digest in [(*own_vote(page), None), *((p, 0.0, d) for p, d in page.doubtful().items())]:
                for name, x in zip(out, (host, path, weight, digest)):
                    out[name].append(x)
        return out

    votes = map_columns(pages.select(host_of(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("h")).where("host <> ''"), run, "host string, path string, weight double, digest string", 500)
    counted = votes.groupBy("host", "path", "digest").agg(F.sum(F.round(F.col("weight") * 1000).cast("long")).alias("votes"), F.count("*").alias("n"))
    paths = counted.groupBy("host", "path", F.col("digest").isNotNull().alias("doubt")).agg(F.sum("votes").alias("votes"), F.sum("n").alias("n"), F.count("*").alias("texts"))
    best = F.min_by(F.when(~F.col("doubt") & (F.col("votes") > 0), F.col("path")), F.when(~F.col("doubt") & (F.col("votes") > 0), F.struct(-F.col("votes"), F.col("path"))))
    repeats = F.col("doubt") & (F.col("n") >= 3) & (2 * F.col("texts") <= F.col("n"))
    return paths.groupBy("host").agg(best.alias("path"), F.collect_list(F.when(repeats, F.col("path"))).alias("repeated"))


def extract_main(pages: DataFrame, salts: int = 64) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    winners = stored(host_paths(pages), "host-paths")
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("h"))
    if winners.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(ids, urls, paths, repeated, sources):
        texts = [extract(s, p, frozenset(r or ())) for s, p, r in zip(sources.to_pylist(), paths.to_pylist(), repeated.to_pylist())]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_columns(joined.select("page_id", "url", "path", "repeated", "h"), run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long", 500)
