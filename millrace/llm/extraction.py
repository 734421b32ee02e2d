"""Main text of web pages by consensus paths of their hosts.

1. Every page is read once; its articles and mains are credited with the text of their
   blocks, without links and boilerplate, as shares of the page, and the lowest container
   around all text outside of them with that text. A container stands for its generalised
   path: tags and classes from the root, digits left out.
2. Shares are summed per host and path in Spark, as whole numbers, so the sum does not
   depend on order. The path with most is the host's; ties go to the longer path.
3. Every page is read again, and the blocks of all containers on its host's path are its
   text. A page without such a container, or without a host, uses its own best path; so
   does a page with text outside of a host's path that is no article or main.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left
out by tag, role, or a class or id that is a word for one or ends in it; scripts and
styles are not text, words in drawings, formulas, objects and noscript are, and so is what
a style hides. A form or such a name around most of a page's text is its layout
and stays. Names of headings, of inline elements and inside code say nothing. An article's own
header element goes with its title, as a header.

A page is read in time linear in its length, however deep it is nested and wherever its
tags, quotes and comments are left open.

Defined results: null or empty html, and pages without text, give the empty string. A
null or hostless url takes no part in a vote. Repeated rows vote and are extracted each.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.sizing import broadcast_if_small
from millrace.llm.batches import flat_rows, map_rows
from millrace.session import checkpointed

# Kinds of HTML elements, and words that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title".split())
FOREIGN = frozenset("svg math".split())
OPTIONS = frozenset("option optgroup".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt"
    " ruby s samp small span strike strong sub sup time tt u var"
    " svg math object noscript select option optgroup button".split()
)
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
JUNK_TAGS = frozenset("head nav header footer aside dialog menu".split())
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment"
    " comments consent cookie cookies discuss disqus footer footnav gdpr header masthead menu menus"
    " modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo"
    " promotion recommended related replies respond share sharing sidebar signup social sponsor"
    " sponsored subscribe toolbar widget".split()
)
FLOW = (LEAVES | JUNK_TAGS) - {"head"} | frozenset(
    "html body main article section div form blockquote center figure fieldset table thead tbody tfoot tr td th ul ol dl".split()
)
REPLIES = frozenset("comment comments discuss disqus replies respond".split())
HAVING = frozenset("has have with without no".split())
PROSE = frozenset("p pre blockquote".split())
ROOTS = frozenset("html body main article".split())
BOUNDS = frozenset("article main".split())

_START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|([!?/]))")
_QUOTE = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Tags:
    """The tags of a page from left to right, each looked at a bounded number of times.

    `next(at)` gives (begin, end, closing, name, attributes) of the first tag, comment or
    declaration from `at` on; these last two have no name. A quoted > does not end a tag,
    unless its quotes or the page are broken: then the first > does, and if no tag of the
    rest could end otherwise, so do all. Nothing after the last > of a page is a tag.
    """

    def __init__(self, html):
        self.html, self.last, self.quoted = html, html.rfind(">"), True
        self.single, self.double = html.rfind("'"), html.rfind('"')

    def _end(self, at):
        plain = self.html.find(">", at)
        k = at
        while self.quoted:
            found = _QUOTE.search(self.html, k)
            if not found:
                # No > outside of quotes up to the end, from here or any later place.
                self.quoted = False
                break
            k = found.end()
            if found[0] == ">":
                return k
            if k > (self.single if found[0] == "'" else self.double):
                break
            k = self.html.find(found[0], k) + 1
        return plain + 1

    def next(self, at):
        while found := _START.search(self.html, at):
            if found.start() > self.last:
                # A comment that is never closed runs to the end.
                if self.html.startswith("<!--", found.start()):
                    return found.start(), len(self.html), False, None, ""
                return None
            if found[2]:
                end = self._end(found.end())
                return found.start(), end, bool(found[1]), found[2].lower(), self.html[found.end() : end - 1]
            if self.html.startswith("<!--", found.start()):
                end = self.html.find("-->", found.start() + 4)
                return found.start(), len(self.html) if end < 0 else end + 3, False, None, ""
            end = self.html.find(">", found.end())
            if end > found.end():
                return found.start(), end + 1, False, None, ""
            at = found.end()
        return None


def _attributes(text):
    out = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def _is_junk(attributes):
    return attributes.get("role", "").lower() in JUNK_ROLES


def _named(tag, attributes):
    """The word of boilerplate that a whole class or id is, or has as its last part."""
    if tag in ROOTS and "article" != tag or tag in HEADINGS:
        return None
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [x for x in _SPLIT.split(_CAMEL.sub(" ", name).lower()) if x]
        # has-sidebar and the like name what is beside the text, or is not there.
        if parts and parts[-1] in JUNK_WORDS and not (len(parts) > 1 and parts[-2] in HAVING):
            return parts[-1]
    return None


class Page:
    """Elements and text blocks of one page.

    `paths`, `tags` and `parents` describe elements, `blocks` are (element, text, length
    of text outside links) of what is not boilerplate, in page order. `marks` has the word
    of forms and of elements with a name of boilerplate, until `_settle`. A path is a
    number for (path of the parent, tag, classes); `key` writes it out. `_open` is the stack
    of open (element, tag, is junk), and `_at` where in it each tag stands, so that no
    step walks over the stack, however deep a page is nested.
    """

    def __init__(self, html):
        self.paths, self.tags, self.parents = [0], ["html"], [-1]
        self.blocks, self.marks = [], {}
        self._numbers, self._path_of, self._keys = {}, [(-1, "html", "")], {0: "000000000:html:"}
        self._open, self._at = [], defaultdict(list)
        self._push(0, "html", False)
        self._parts, self._links, self._link = [], 0, 0
        html = html or ""
        tags, unclosed, at = _Tags(html), set(), 0
        while True:
            found = tags.next(at)
            self._text(html[at : found[0] if found else len(html)])
            if not found:
                break
            _, at, closing, tag, attributes = found
            if not tag:
                continue
            if closing:
                self._end(tag)
                continue
            self._begin(tag, attributes)
            if tag in RAW and not (attributes.endswith("/") and self._in_foreign()):
                close = None
                if tag not in unclosed:
                    close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
                # Only scripts and styles without an end are no text up to the end of the page.
                if close or tag in ("script", "style"):
                    at = close.end() if close else len(html)
                else:
                    unclosed.add(tag)
        self._flush()
        self._settle()

    def _push(self, element, tag, junk):
        place = len(self._open)
        self._open.append((element, tag, junk))
        self._at[tag].append(place)
        if tag not in INLINE:
            self._at["block"].append(place)

    def _cut(self, place):
        """Closes what stands in the stack from `place` on."""
        while len(self._open) > place:
            tag = self._open.pop()[1]
            self._at[tag].pop()
            if tag not in INLINE:
                self._at["block"].pop()

    def _last(self, *tags):
        """The highest place in the stack of one of `tags`; 0 for none, as the root is there."""
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=0)

    def _path(self, parent, tag, kind):
        step = (self.paths[parent], tag, kind)
        number = self._numbers.get(step)
        if number is None:
            number = self._numbers[step] = len(self._path_of)
            self._path_of.append(step)
        return number

    def key(self, path):
        """A path as text: how many characters its tags and classes have, its last tag, and
        a digest of all of them. Longer paths sort behind shorter ones."""
        if path in self._keys:
            return self._keys[path]
        line = []
        while path not in self._keys:
            line.append(path)
            path = self._path_of[path][0]
        length, _, digest = self._keys[path].split(":")
        for path in reversed(line):
            _, tag, kind = self._path_of[path]
            name = f"{tag}.{kind}" if kind else tag
            length = int(length) + 1 + len(name)
            digest = hashlib.md5(f"{digest}>{name}".encode("utf-8", "surrogatepass")).hexdigest()
            self._keys[path] = f"{length:09d}:{tag}:{digest}"
        return self._keys[line[0]]

    def _settle(self):
        """Drops the blocks of marked elements, but for a mark on most of the page's text:
        of its paragraphs, or, for forms and pages without paragraphs, of everything. The
        name of reader comments stays a mark if no article or main heading is inside."""
        if not self.marks:
            return
        prose, everything, headed = ([0] * len(self.paths) for _ in range(3))
        for element, _, length in self.blocks:
            everything[element] += length
            prose[element] += length if self.tags[element] in PROSE else 0
        for element in range(len(self.paths) - 1, -1, -1):
            # An article may be a reader's comment itself.
            _, tag, kind = self._path_of[self.paths[element]]
            comment = ("comment" in tag or "comment" in kind) and element not in self.marks
            headed[element] |= self.tags[element] in ("article", "main", "h1") and not comment
            if element:
                for sums in (prose, everything):
                    sums[self.parents[element]] += sums[element]
                headed[self.parents[element]] |= headed[element]
        junk = [False] * len(self.paths)
        for element in range(1, len(self.paths)):
            word = self.marks.get(element)
            marked = False
            if word:
                held = everything if word == "form" or not prose[0] else prose
                marked = 2 * held[element] <= held[0] or word in REPLIES and not headed[element]
            junk[element] = marked or junk[self.parents[element]]
        self.blocks = [b for b in self.blocks if not junk[b[0]]]

    def _text(self, text):
        if text and not self._open[-1][2]:
            text = entities.unescape(text) if "&" in text else text
            self._parts.append(text)
            if self._link:
                self._links += len(text)

    def _flush(self):
        text = " ".join("".join(self._parts).split())
        if text:
            self.blocks.append((self._open[-1][0], text, max(0, len(text) - self._links)))
        self._parts, self._links = [], 0

    def _in_foreign(self):
        return self._last(*FOREIGN) > 0

    def _begin(self, tag, attributes):
        if tag in RAW:
            return
        top, _, junk = self._open[-1]
        if tag in FOREIGN:
            # In a line of text; its own elements are not containers.
            if not attributes.endswith("/"):
                self._push(top, tag, junk or _is_junk(_attributes(attributes)))
            return
        if self._in_foreign() and tag not in INLINE and tag not in VOID:
            if tag not in FLOW:
                if tag == "text":
                    self._parts.append(" ")
                return
            # Left open: a block of the page ends it.
            while self._open[-1][1] in INLINE:
                self._cut(len(self._open) - 1)
        if tag in OPTIONS:
            # Choices of a form; the next one, a block or any other end tag ends them.
            if self._open[-1][1] == "option":
                self._cut(len(self._open) - 1)
            self._push(self._open[-1][0], tag, True)
            return
        if tag not in INLINE and tag not in VOID:
            self._end_options()
        if tag == "a":
            self._link += 1
        if tag == "button":
            # Its label is no text; the line around it goes on.
            self._push(self._open[-1][0], tag, True)
            return
        if tag in INLINE and not attributes and tag != "code":
            return
        if tag in VOID:
            if tag == "br":
                self._parts.append(" ")
            elif tag == "hr":
                self._flush()
            return
        attributes = _attributes(attributes) if attributes.strip(" /") else {}
        top, _, junk = self._open[-1]
        if tag in INLINE:
            if junk or _is_junk(attributes):
                self._push(top, tag, True)
            elif tag == "code":
                self._push(top, tag, False)
            return
        self._flush()
        # A block ends an open paragraph; a list item or cell ends one of its kind.
        if tag in ("td", "th"):
            self._close_one(("td", "th"), ("tr", "table"))
        elif tag in ("li", "tr", "dt", "dd"):
            self._close_one((tag,) if tag not in ("dt", "dd") else ("dt", "dd"), ("ul", "ol", "table", "dl"))
        else:
            self._close_one(("p",), ("td", "th", "li", "table", "article", "section", "div", "blockquote"))
        parent, _, junk = self._open[-1]
        if junk or tag in JUNK_TAGS or _is_junk(attributes):
            self._push(parent, tag, True)
            return
        word = "form" if tag == "form" else _named(tag, attributes)
        if word and not self._last("pre", "code"):
            self.marks[len(self.paths)] = word
        kind = " ".join(sorted(re.sub(r"\d+", "", attributes.get("class", "")).lower().split()))
        path = self.paths[parent] if tag == "html" else self._path(parent, tag, kind)
        self._push(len(self.paths), tag, False)
        self.paths.append(path)
        self.tags.append(tag)
        self.parents.append(parent)

    def _close_one(self, tags, barriers):
        place = self._last(*tags)
        if place > self._last(*barriers):
            self._cut(place)

    def _end_options(self):
        while self._open[-1][1] in OPTIONS:
            self._cut(len(self._open) - 1)

    def _end(self, tag):
        if tag not in OPTIONS:
            self._end_options()
        if tag not in INLINE and tag not in FLOW and self._in_foreign():
            return
        if tag == "a":
            self._link = max(0, self._link - 1)
        place = self._last(tag)
        # An inline end tag does not end blocks.
        if place and not (tag in INLINE and place < self._last("block")):
            if tag not in INLINE:
                self._flush()
            self._cut(place)
        elif tag == "p" or tag not in INLINE and tag not in VOID:
            self._flush()

    def _containers(self):
        """For each element: the outermost article around it, else the innermost main, else
        itself, or what is around it where it is a paragraph or the like."""
        article, main, plain = [0], [0], [0]
        for e in range(1, len(self.tags)):
            tag, up = self.tags[e], self.parents[e]
            article.append(article[up] or (e if tag == "article" else 0))
            main.append(e if tag == "main" else main[up])
            plain.append(plain[up] if tag in LEAVES else e)
        return [a or m or p for a, m, p in zip(article, main, plain, strict=True)]

    def _lowest(self, elements):
        """The lowest element around all of `elements`."""
        held = [0] * len(self.tags)
        for e in elements:
            held[e] += 1
        for e in range(len(held) - 1, -1, -1):
            if held[e] == len(elements):
                return e
            held[self.parents[e]] += held[e]

    def credits(self):
        """path -> share of the page's text, in thousandths."""
        credit, rest, length_of_rest = defaultdict(int), [], 0
        containers = self._containers()
        for element, _, length in self.blocks:
            if length:
                container = containers[element]
                if self.tags[container] in BOUNDS:
                    credit[self.paths[container]] += length
                else:
                    rest.append(container)
                    length_of_rest += length
        if rest:
            credit[self.paths[self._lowest(rest)]] += length_of_rest
        total = sum(credit.values())
        return {self.key(p): round(1000 * c / total) for p, c in credit.items()}

    def best(self):
        credit = self.credits()
        return max(credit, key=lambda p: (credit[p], p), default=None)

    def main_text(self, path):
        """Text on the host's `path`, or on the page's own best path where there is no such
        container or, outside articles and mains, not all of the own path's text is in it."""
        inside = self._inside(path)
        if inside is None or path.split(":")[1] not in BOUNDS:
            own = self._inside(self.best())
            if inside is None or own and any(own[e] and not inside[e] for e, _, length in self.blocks if length):
                inside = own
        return "\n\n".join(t for e, t, _ in self.blocks if inside[e]) if inside else ""

    def _inside(self, path):
        """Whether each element is in a container on `path`, or None if there is none."""
        if path is None:
            return None
        last = path.split(":")[1]
        same = {p for p in set(self.paths) if self._path_of[p][1] == last and self.key(p) == path}
        if not same:
            return None
        inside = [p in same for p in self.paths]
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.parents[i]]
        return inside


def _host(url):
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def consensus_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the container path that the pages of each host agree on most."""
    rows = pages.select("html", _host("url").alias("host")).where("host is not null")

    def prepare():
        def work(htmls, hosts):
            out = [[], [], []]
            for html, host in zip(htmls, hosts, strict=True):
                for path, share in Page(html).credits().items():
                    for column, value in zip(out, (host, path, share), strict=True):
                        column.append(value)
            return out

        return work

    votes = flat_rows(rows, ["html", "host"], T.StructType.fromDDL("host string, path string, share long"), prepare)
    sums = votes.groupBy("host", "path").agg(F.sum("share").alias("share"))
    best = sums.groupBy("host").agg(F.max(F.struct("share", "path")).alias("m"))
    return best.select("host", F.col("m.path").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """`page_id`, `url`, `text` and `n_chars` of every page."""
    paths = broadcast_if_small(checkpointed(consensus_paths(pages)))
    rows = pages.select("page_id", "url", "html", _host("url").alias("host")).join(paths, "host", "left")
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def prepare():
        def work(htmls, paths):
            texts = []
            for html, path in zip(htmls, paths, strict=True):
                texts.append(Page(html).main_text(path))
            return texts, [len(t) for t in texts]

        return work

    return map_rows(rows, ["html", "path"], fields, prepare, keep=["page_id", "url"])
