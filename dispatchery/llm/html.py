"""Main text of pages by consensus host paths.

Every page scores its containers and votes for their generalised paths of tags and classes, once a
path. Spark adds the votes of each host's pages, and each page is read again at its host's winning
path and at paths beside it that hold a fair share of its votes, or at its own where it has no such
path. An article in several parts is read whole. Votes are summed before the shuffle.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hosts whose winners are broadcast at most; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
#: Hundredths of the best path's votes, or of the best container's score, that make one beside it a part of the same text.
FAIR = 30

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
#: Attributes from left to right, each with its value, so that names are never found inside values.
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp svg math noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body center".split())
DROPPED = frozenset("nav footer aside button select option input label fieldset menu dialog head canvas audio video object".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
EDGES = frozenset("ul ol dl table body html article section div td".split())
#: A class that names what an element has beside its text (page-with-sidebar, has-banner, no-comments) says nothing of the element.
BESIDE = re.compile(r"(?:^|(?<=[\s_-]))(?:has|with|without|no|is-not)[_-]\S*+", re.I)
#: Share of a doubted element's text, and characters, that the rest of the page stays below where the element must be the article.
LITTLE, LEAST = 0.25, 400
#: Longer paths are written with a digest of what they begin with.
LONG_PATH = 1000
#: Words of a class or id that speak against a part of a page, and for one.
AGAINST = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notices?|alerts?|nav\w*|menus?|topbar|toolbar|"
    r"side-?bar\w*|widgets?|footer\w*|foot|header\w*|masthead|bread-?crumbs?|comments?\w*|respond|repl(?:y|ies)|disqus\w*|discussion|share\w*|sharing|social\w*|"
    r"related|recommend\w*|newsletter|subscri\w*|pop-?up|modal|overlay|login|sign-?up|search\w*|pagination|pager|hidden|skip\w*|disclaimer)(?:$|[\s_-])",
    re.I,
)
FOR = re.compile(r"article|content|post|entry|story|main|text|body", re.I)


class Part:
    """An element: its tag, generalised path, parent, score, and whether it counts as something else than the article.

    `box` is the innermost container around it, itself included; `first` and `last` number the elements it spans.
    """

    __slots__ = ("tag", "path", "up", "score", "off", "good", "box", "first", "last", "in_article", "doubt")

    def __init__(self, tag: str, path: str, up: Part | None, off: bool, good: bool, first: int = 0):
        self.tag, self.path, self.up, self.off, self.good = tag, path, up, off, good
        self.score, self.first, self.last = 0.0, first, None
        self.box = self if tag in CONTAINERS else up.box if up is not None else None
        self.in_article = tag in ("article", "main") or (up is not None and up.in_article)
        self.doubt: Doubt | None = up.doubt if up is not None else None


class Doubt:
    """An element that its names or its tag speak against: the text in it and in the articles it holds, and what it stands in."""

    __slots__ = ("number", "up", "chars", "article_chars")

    def __init__(self, number: int, up: Doubt | None):
        self.number, self.up, self.chars, self.article_chars = number, up, 0, 0


def digest(path: str) -> str:
    return hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


class Page:
    """One reading of a page: its containers with scores, and its text blocks in order with the element each stands in.

    Elements named like something else than the article are left out. Where one of them turns out to hold what must
    be the article, the page is read again with that one trusted.
    """

    def __init__(self, source: str):
        trusted: set[int] = set()
        while True:
            self._start(trusted)
            self._read(source)
            self._flush()
            self._end(0)
            more = self._mistaken()
            if more is None:
                return
            trusted.add(more)

    def _start(self, trusted: set[int]) -> None:
        self.root = Part("", "", None, False, False)
        self.parts: list[Part] = []
        self.blocks: list[tuple[str, Part]] = []
        self._stack, self._held, self._open_tags = [self.root], [], Counter()
        self._elements, self._trusted, self._doubts = 0, trusted, []
        self._seen, self._seen_articles = 0, 0

    def _mistaken(self) -> int | None:
        """The doubted element that has to be trusted: it holds the page's only article, or all but a little of its text."""
        best = None
        for doubt in self._doubts:
            whole = self._seen_articles == 0 and doubt.article_chars > self._seen
            if whole or (doubt.chars and self._seen < LITTLE * doubt.chars and self._seen < LEAST):
                if best is None or doubt.chars > best.chars:
                    best = doubt
        return best.number if best else None

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            found = TOKEN.search(source, at)
            stop = found.start() if found else end
            if stop > at:
                self._text(source[at:stop])
            if not found:
                return
            at = found.end()
            if not found["tag"]:
                continue
            tag = found["tag"].lower()
            if found["end"]:
                self._close(tag)
                continue
            self._open(tag, found["rest"])
            if tag in RAW:
                close = None
                if not found["rest"].endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    at = close.end() if close else (end if tag in ("script", "style", "textarea") else at)
                self._close(tag)

    def _text(self, text: str) -> None:
        part = self._stack[-1]
        self._held.append((text, part))
        size = len(text) if not text.isspace() else 0
        if not part.off:
            self._seen += size
            self._seen_articles += size if part.in_article else 0
        elif size:
            doubt = part.doubt
            while doubt is not None:
                doubt.chars += size
                doubt.article_chars += size if part.in_article else 0
                doubt = doubt.up

    def _flush(self) -> None:
        """End a block: what was gathered becomes one for each part it stands in."""
        if not self._held:
            return
        held, self._held = self._held, []
        text = " ".join(html.unescape("".join(t for t, part in held if not part.off)).split())
        if not text:
            return
        links = sum(len(t) for t, part in held if not part.off and self._within(part, "a"))
        at = next(part for t, part in held if not part.off and t.strip())
        while at.tag and at.tag not in BLOCKS and at.tag != "td":
            at = at.up
        self.blocks.append((text, at))
        worth = max(0.0, len(text) - 2.0 * links)
        share, near = 1.0, at.box
        while near is not None and share > 0.05:
            near.score += worth * share * (1.5 if near.good else 1.0)
            share *= 0.4
            near = near.up.box

    @staticmethod
    def _within(part: Part, tag: str) -> bool:
        for _ in range(6):
            if part is None or part.tag in BLOCKS:
                return False
            if part.tag == tag:
                return True
            part = part.up
        return False

    def _open(self, tag: str, rest: str) -> None:
        if tag in BLOCKS or tag in ("td", "th"):
            if tag in BLOCKS:
                self._flush()
            else:
                self._text(" ")
            self._imply(tag)
        elif tag == "br" or tag in VOID:
            self._text(" ")
        if tag in VOID:
            return
        up, names, words = self._stack[-1], "", ""
        hard, doubted = tag in DROPPED, tag == "form"
        self._elements += 1
        if rest and not rest.isspace():
            for name, value in ATTRIBUTE.findall(rest):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id"):
                    words += f" {value}"
                    names += "".join(sorted(f".{c}" for c in re.sub(r"\d+", "#", value).split())) if name == "class" else ""
                elif name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"):
                    hard = True
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    hard = True
        if tag not in ("html", "body", "main") and words and tag not in HEADINGS and AGAINST.search(BESIDE.sub("", words)):
            doubted = True
        # A page's header goes; of one inside an article its headings stay.
        off = up.off or hard or tag == "header" or (doubted and self._elements not in self._trusted)
        if tag in HEADINGS and not hard and not doubted and up.tag == "header" and up.up is not None and not up.up.off and up.up.in_article:
            off = False
        good = tag in ("article", "main") or bool(words and FOR.search(words))
        path = up.path
        if tag in BLOCKS or tag == "td":
            step = f"{tag}{names}" if len(names) < LONG_PATH // 2 else f"{tag}#{digest(names)}"
            path = f"{up.path}/{step}" if len(up.path) + len(step) < LONG_PATH else f"#{digest(up.path)}/{step}"
        part = Part(tag, path, up, off, good, self._elements)
        if hard or tag == "header":
            part.doubt = None
        elif off and doubted and (not up.off or up.doubt is not None):
            part.doubt = Doubt(self._elements, up.doubt)
            self._doubts.append(part.doubt)
            # An article counts for a doubted element only if it stands within.
            part.in_article = False
        self._stack.append(part)
        self._open_tags[tag] += 1
        if tag in CONTAINERS:
            self.parts.append(part)

    def _imply(self, tag: str) -> None:
        """Close what the start of a block closes: an open paragraph or heading, or an earlier item of the same list or row."""
        closes = CLOSES.get(tag, set())
        if not any(self._open_tags[t] for t in (*closes, *(("p",) if tag in BLOCKS else ()), *(HEADINGS if tag in HEADINGS else ()))):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            name = self._stack[i].tag
            if name in closes or (tag in BLOCKS and name == "p") or (tag in HEADINGS and name in HEADINGS):
                self._pop(i)
                if name == "td" and tag == "tr":
                    continue
                if name in closes and tag != "tr":
                    return
            elif name in EDGES:
                return

    def _pop(self, i: int) -> None:
        if any(p.tag in BLOCKS for p in self._stack[i:]):
            self._flush()
        self._end(i)

    def _end(self, i: int) -> None:
        for part in self._stack[i:]:
            part.last = self._elements
            self._open_tags[part.tag] -= 1
        del self._stack[i:]

    def _close(self, tag: str) -> None:
        if not self._open_tags[tag]:
            if tag == "p":
                self._flush()
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag == tag:
                self._pop(i)
                return
            if tag not in BLOCKS and self._stack[i].tag in BLOCKS:
                return  # an inline end tag doesn't reach out of its block

    def shares(self) -> dict[str, float]:
        """Share of each path in the page's score; of containers with one path the best counts."""
        best: dict[str, float] = {}
        for part in self.parts:
            if part.score > 0:
                best[part.path] = max(part.score, best.get(part.path, 0.0))
        total = sum(best.values())
        return {path: score / total for path, score in best.items()}

    def text(self, path: str | None, beside: list[str] | None = None) -> str:
        """Blocks of the containers with that path or those beside it, or with the page's own best path; of the whole page if it has no container.

        Of an article they stand in all blocks belong to the text. Elsewhere what lies between the
        parts does, what stands in no other container around them, and in `main` containers of a fair share.
        """
        picks = self._at({path, *(beside or ())}) if path and self._at({path}) else []
        if not picks and (shares := self.shares()):
            own = max(shares, key=lambda p: shares[p])
            picks = self._at({own, *(p for p in shares if beside_of(p) == beside_of(own) and 100 * shares[p] >= FAIR * shares[own])})
        if not picks:
            return "\n".join(text for text, _ in self.blocks)
        top = self._common(picks)
        home = top
        while home is not None and home.tag not in ("article", "main"):
            home = home.up
        if home is not None and home.tag == "article":
            return "\n".join(text for text, part in self.blocks if self._below(part, home))
        inside = [i for i, (_, part) in enumerate(self.blocks) if any(self._below(part, p) for p in picks)]
        spine: set[Part] = set()
        for part in picks:
            while part is not None and part not in spine:
                spine.add(part)
                part = part.up
        least = FAIR / 100 * max(p.score for p in picks) if home is not None else None
        around = home or (top.up if len(picks) == 1 else top)
        kept = []
        for i, (text, part) in enumerate(self.blocks):
            if inside[0] <= i <= inside[-1]:
                kept.append(text)
            elif self._below(part, around) and (home is not None or len(picks) > 1 or part.tag in HEADINGS) and self._joins(part, around, spine, least):
                kept.append(text)
        return "\n".join(kept)

    def _at(self, paths: set[str]) -> list[Part]:
        return [p for p in self.parts if p.path in paths and p.score > 0]

    @classmethod
    def _common(cls, parts: list[Part]) -> Part:
        top = parts[0]
        for part in parts[1:]:
            while not cls._below(part, top):
                top = top.up
        return top

    def _joins(self, part: Part, around: Part, spine: set[Part], least: float | None) -> bool:
        """Whether a block in `around` stands in no container but those around the picks, or in one that is worth `least`."""
        outer = best = None
        while part is not around:
            if part.tag in CONTAINERS and part not in spine:
                outer, best = part, max(part.score, best or 0.0)
            part = part.up
        return outer is None or least is not None and best >= least

    @staticmethod
    def _below(part: Part, top: Part) -> bool:
        return top.first <= part.first <= top.last


def beside_of(path: str) -> str:
    """The path of what an element stands in: elements with the same one are beside each other."""
    return path.rpartition("/")[0]


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def winners(pages: DataFrame) -> DataFrame:
    """(host, path, beside): of each host the path with the most votes, and the paths beside it that have a fair share of these.

    Equal votes go to the path that sorts first.
    """
    from dispatchery.llm.runs import Run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                votes: dict[tuple[str | None, str], int] = {}
                for host, source in zip(batch.column(0).slice(start, 256).to_pylist(), batch.column(1).slice(start, 256).to_pylist()):
                    for path, share in Page(source or "").shares().items():
                        votes[host, path] = votes.get((host, path), 0) + round(share * 1e6)
                hosts, paths = [h for h, _ in votes], [p for _, p in votes]
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes.values(), pa.int64())], ["host", "path", "votes"])

    votes = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(run, "host string, path string, votes long")
    summed = Run(pages.sparkSession, "votes").keep(votes.groupBy("host", "path").agg(F.sum("votes").alias("votes")))
    won = summed.groupBy("host").agg(F.min_by(F.struct("path", "votes"), F.struct(-F.col("votes"), "path")).alias("__won"))
    small = won.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    near = summed.join(F.broadcast(won) if small else won, "host")
    within = lambda path: F.regexp_extract(path, r"(?s)^(.*)/", 1)
    fair = (within(F.col("path")) == within(F.col("__won.path"))) & (F.col("path") != F.col("__won.path")) & (100 * F.col("votes") >= FAIR * F.col("__won.votes"))
    beside = near.where(fair).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("beside"))
    return won.select("host", F.col("__won.path").alias("path")).join(F.broadcast(beside) if small else beside, "host", "left")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, one row each.

    A null or empty page has an empty text. A null page_id or url is passed on (null urls vote as
    one host), repeated rows are read alike, other columns are ignored, an empty table gives no rows.
    """
    from dispatchery.llm.runs import Run

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    won = Run(pages.sparkSession, "html").keep(winners(rows))
    small = won.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    aimed = rows.withColumn("host", host_of(F.col("url"))).join(F.broadcast(won) if small else won, "host", "left").select("page_id", "url", "html", "path", "beside")
    schema = rows.select("page_id", "url").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = [Page(s or "").text(p, b) for s, p, b in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return aimed.mapInArrow(run, schema).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
