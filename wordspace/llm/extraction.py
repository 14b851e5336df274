"""The main text of web pages.

The events of the standard library's parser cut a page into lines, one per block element.
Each line has a text-to-tag ratio; the ratios are smoothed with a Gaussian and split in
two clusters by a threshold, after Weninger, Hsu and Han (2010). The lines of the upper
cluster outside of boilerplate show where the content is:
in the innermost division that holds nearly all their text, or in the article elements
around them if those hold as much. What stands there, short lines too but no menus, is
the text.

Boilerplate are elements and roles that say so. Class names and ids are evidence only: a part
with such a name is left out unless it holds much of the upper cluster's text. Parts named for what
readers say are left out however much they hold, if any text stands beside them.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spread of the smoothing, in lines.
SIGMA = 1.0
#: Share of the upper cluster's text that the region has to hold, marked as article or not.
HELD = 0.8
#: Share of link text from which a line of the lower cluster in such a region is a menu.
LINKED = 0.6
#: Share and characters of the upper cluster's text from which a part is content whatever its name.
SMALL, LEAST = 1 / 3, 100

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr "
    "math semantics mrow mstyle mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mpadded "
    "mmultiscripts mprescripts menclose mphantom merror".split()
)
SKIPPED = frozenset("head script style noscript template iframe object svg annotation annotation-xml canvas audio video select textarea button datalist".split())
AROUND = frozenset("nav aside footer form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words in class names and ids of parts around the content.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|breadcrumbs?|sidebar|side|aside|rail|footer|foot|header|masthead|topbar|banner|"
    r"cookies?|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|paywall|"
    r"promo|promotion|sponsor|sponsored|ad|ads|advert|adverts|advertisement|advertising|adsense|social|share|sharing|follow|"
    r"related|recommended|recommendations|trending|popular|teaser|comments?|commentlist|commentary|respond|replies|reply|disqus|"
    r"discussion|widget|widgets|toolbar|pagination|pager|login|search|skip|skiplink|copyright|legal|disclaimer|tags|taglist|"
    r"hidden|sr-only|visually-hidden)(?:$|[\s_-]|\d)"
)
#: Words in the names of what readers say about the content.
READERS = re.compile(
    r"(?:^|[\s_-])(?:comments?|commentlist|commentary|respond|responses|replies|reply|disqus|discussions?)(?:$|[\s_\d]|-(?!open|closed|enabled|disabled|allowed))"
)
BESIDE = ("has-", "no-", "with-", "without-", "is-")
#: Elements whose names do not make them boilerplate.
UNNAMED = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
HEADINGS = frozenset(("h1", "h2"))
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th pre blockquote figure figcaption".split())
#: Elements that an open paragraph or item ends at.
ITEMS = frozenset("p li dt dd tr td th option".split())


class Lines(HTMLParser):
    """Collects ``lines``: (text, tags before and in it, link characters, open elements, around, heading)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.words, self.tags, self.linked, self.links = [], [], 0, 0, 0
        self.open, self.number, self.articles, self.leaves, self.named, self.readers = [], 0, [], set(), set(), set()
        self.skipping, self.around, self.in_article = 0, 0, 0

    def _end_line(self):
        text = " ".join("".join(self.words).split())
        if text:
            heading = any(e[0] in HEADINGS for e in self.open)
            # Of a header inside the article, its headings are part of it.
            around = self.around > 0 or not heading and any(e[0] == "header" for e in self.open)
            self.lines.append((text, self.tags, self.linked, tuple(e[1] for e in self.open), around, heading))
            self.tags = 0
        self.words, self.linked = [], 0

    def _is_around(self, tag, attrs):
        if tag in AROUND or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        if (attrs.get("role") or "").lower() in ROLES:
            return True
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.I):
            return True
        return False

    def _is_named(self, tag, attrs, what=NAMES):
        if tag in UNNAMED:
            return False
        names = CAMEL.sub("-", f"{attrs.get('class') or ''} {attrs.get('id') or ''}").lower().split()
        # "has-sidebar" is the name of what stands beside one.
        return any(what.search(name) for name in names if not name.startswith(BESIDE))

    def _push(self, tag, attrs):
        self.number += 1
        skipped = tag in SKIPPED
        around = not skipped and (self._is_around(tag, attrs) or tag == "header" and not self.in_article)
        article = tag in ("article", "main") or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articleBody"
        article = article and not around and not self.around
        self.open.append((tag, self.number, skipped, around, article))
        self.skipping += skipped
        self.around += around
        if not skipped and self._is_named(tag, attrs):
            self.named.add(self.number)
        if not skipped and self._is_named(tag, attrs, READERS):
            self.named.add(self.number)
            self.readers.add(self.number)
        if tag in LEAVES:
            self.leaves.add(self.number)
        if article and not self.in_article:
            self.articles.append(self.number)
        self.in_article += article

    def _pop(self):
        tag, _, skipped, around, article = self.open.pop()
        self.skipping -= skipped
        self.around -= around
        self.in_article -= article

    def handle_starttag(self, tag, attrs):
        if self.skipping and tag != "body":
            # Only what can hold its own kind has to be counted.
            if tag not in VOID and any(e[0] == tag and e[2] for e in self.open):
                self._push(tag, {})
            return
        self.tags += 1
        if tag in INLINE:
            self.links += tag == "a"
            if tag == "img":
                return
            attrs = dict(attrs)
            if tag != "a" and attrs and (self._is_around(tag, attrs) or self._is_named(tag, attrs)):
                self._end_line()
                self._push(tag, attrs)
            return
        self._end_line()
        if tag in VOID:
            return
        if tag == "body":
            while self.open and self.open[-1][0] != "html":
                self._pop()
        if self.open and self.open[-1][0] in ITEMS and (tag == self.open[-1][0] or self.open[-1][0] == "p"):
            self._pop()
        self._push(tag, dict(attrs))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs)
            if tag == "a":
                self.handle_endtag(tag)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += not self.skipping
        if tag == "a":
            self.links = max(0, self.links - 1)
        found = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if found is None:
            return
        if not self.skipping:
            self._end_line()
        if tag in ITEMS and any(e[0] in ("article", "main", "section", "div", "table", "ul", "ol", "dl") for e in self.open[found + 1 :]):
            return
        while len(self.open) > found:
            self._pop()

    def handle_data(self, data):
        if not self.skipping:
            self.words.append(data)
            if self.links:
                self.linked += len(data)

    def close(self):
        super().close()
        self._end_line()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian, its ends weighed anew."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(ratios, reach)
    weight = np.convolve(np.pad(np.ones(ratios.size), reach), kernel, "valid")
    return np.convolve(padded, kernel, "valid") / weight


def threshold(values: np.ndarray) -> float:
    """The middle between the means of two clusters."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        middle = (low + high) / 2
        upper = values > middle
        if not upper.any() or upper.all():
            return middle
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _holding(lines: list, some: list[int], share: float) -> set[int]:
    """The elements that hold a share of the text of some lines."""
    held: dict[int, int] = {}
    for i in some:
        for element in lines[i][3]:
            held[element] = held.get(element, 0) + len(lines[i][0])
    needed = share * sum(len(lines[i][0]) for i in some)
    return {element for element, n in held.items() if n >= needed}


def _hold(elements: set[int], lines: list, some: list[int], share: float) -> bool:
    """Whether elements hold together a share of the text of some lines."""
    held = sum(len(lines[i][0]) for i in some if not elements.isdisjoint(lines[i][3]))
    return held >= share * sum(len(lines[i][0]) for i in some)


def _without_readers(lines: list, inside: list[int], named: set[int], readers: set[int]) -> list[int]:
    """The lines of ``inside`` that are not in a part for what readers say.

    Such a part stays only if next to nothing is left without it: outside of all named parts but
    those around it.
    """
    # The innermost named part of each line, and how much text that is no link each has of its own.
    own: dict[int, int] = {}
    chains: dict[int, list[int]] = {}
    for i in inside:
        chain = [e for e in lines[i][3] if e in named]
        last = chain[-1] if chain else 0
        own[last] = own.get(last, 0) + max(0, len(lines[i][0]) - lines[i][2])
        for at, element in enumerate(chain):
            if element in readers:
                chains.setdefault(element, chain[:at])
    out = {e for e, around in chains.items() if own.get(0, 0) + sum(own.get(a, 0) for a in around) >= LEAST}
    return [i for i in inside if out.isdisjoint(lines[i][3])]


def _outside(lines: list, upper: np.ndarray, named: set[int], articles: set[int], readers: set[int]) -> list[int]:
    """The lines outside of boilerplate; at least one unless elements and roles leave none.

    Named parts are looked at from the smallest on, each for its share of what is left. Where
    an article element stands outside of all of them, a part has to outweigh it.
    """
    inside = [i for i, line in enumerate(lines) if not line[4]]
    inside = _without_readers(lines, inside, named, readers) if readers else inside
    core = {i for i in inside if upper[i]} or set(inside)
    size = {i: len(lines[i][0]) for i in inside}
    members: dict[int, list[int]] = {}
    for i in inside:
        for element in named.intersection(lines[i][3]):
            members.setdefault(element, []).append(i)
    if not members:
        return inside
    marked = any(not articles.isdisjoint(lines[i][3]) and named.isdisjoint(lines[i][3]) for i in inside)
    all_core, all_text, gone = sum(size[i] for i in core), sum(size.values()), set()
    weights = {e: (sum(size[i] for i in own), -e) for e, own in members.items()}
    for element in sorted(members, key=weights.get):
        if not all_core:
            core, all_core = set(inside) - gone, all_text
        own = [i for i in members[element] if i not in gone]
        held, text = sum(size[i] for i in own if i in core), sum(size[i] for i in own)
        share = HELD if marked else SMALL
        content = held >= LEAST and held >= share * all_core and text >= share / 2 * all_text
        if not content and (marked or held < HELD * all_core or text < HELD * all_text):
            gone.update(own)
            all_core, all_text = all_core - held, all_text - text
    return [i for i in inside if i not in gone]


def main_text(html: str | None) -> str:
    """The main text of one page, empty if it has none."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    values = smoothed(np.array([len(line[0]) / max(1, line[1]) for line in lines]))
    limit = threshold(values)
    inside = _outside(lines, values >= limit, parser.named, set(parser.articles), parser.readers)
    if not inside:
        return ""
    core = [i for i in inside if values[i] >= limit] or inside
    regions = {e for i in core for e in lines[i][3]} & set(parser.articles)
    marked = bool(regions) and _hold(regions, lines, core, HELD) and _hold(regions, lines, inside, HELD / 2)
    if not marked:
        # Elements are numbered as they open, so the last that holds enough is the innermost.
        regions = {max(_holding(lines, core, HELD) & _holding(lines, inside, HELD / 2) - parser.leaves, default=0)}
    out = []
    for i in inside:
        text, _, linked, opened, _, heading = lines[i]
        menu = linked > LINKED * len(text) and values[i] < limit and not heading
        if not menu and (regions == {0} or not regions.isdisjoint(opened) or heading and not marked):
            out.append(text)
    return " ".join(out)


def extract(pages: DataFrame, keys: list[str] | None = None, html: str = "html") -> DataFrame:
    """``(keys, text, n_chars)`` per row of ``pages``; null html is empty, and repeated rows stay apart."""
    keys = ["page_id", "url"] if keys is None else keys
    rows = pages.select(*(F.col(k).alias(f"key{i}") for i, k in enumerate(keys)), F.col(html).alias("html"))
    names = [*rows.columns[:-1], "text", "n_chars"]

    def task(batches):
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            columns = batch.columns[:-1]
            columns += [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "".join(f"{c.name} {c.dataType.simpleString()}, " for c in rows.schema.fields[:-1])
    found = rows.mapInArrow(task, kinds + "text string, n_chars bigint")
    return found.toDF(*keys, "text", "n_chars")
