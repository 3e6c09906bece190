"""HTML extraction: main text by line-block distribution.

A page is cut into lines at block-level tags. Markup that never holds an article (scripts, menus, footers, forms,
and elements whose class or id is advert, sidebar, comments and the like) leaves empty lines, so it shows as a gap.
Each line weighs its text length, and the weights are summed over a window of WINDOW lines. Text begins where
the sum surges to the threshold (SURGE characters, or the page's highest sum if that is lower) and ends where it dives to zero:
these spans are what is kept, on every page. Elements only set the weights:
- where lines of `article` or `main` elements have text, these lines weigh all their text and the others nothing.
- elsewhere link text weighs nothing (headings weigh whole).

The span with the most text is the core. The other spans that surge are kept if they are in an article or in the core's container (the
innermost element around it, wider as long as that holds no menu, header or footer). So are spans that don't surge if
nothing but skipped markup parts them from kept text, and, on pages without articles, whatever stands between kept lines
or follows with text of its own in the container: paragraphs of links inside the text are part of it, lists of links aren't.

Markup is read by a tokenizer that only moves forward, and places in the stack of open elements are looked up by name, so time
grows with the page's length whatever its depth. Elements end where HTML ends them: end tags of paragraphs, list items, table
cells and so on may be left out. An unclosed element that would be skipped ends where an article begins, and isn't skipped if it
runs around most of the text. Classes, ids and roles are told by whole names; an element that holds all articles of its page is
never skipped, nor is a form around most of the text; in an article, headings keep their text whatever their class, paragraphs unless
they are adverts.

Edge cases: null and empty pages, and pages without text, give an empty text. Broken markup (unclosed elements or
quotes, elements nested deeply, a page cut off in mid-tag) is read as far as it goes. Repeated rows give equal rows, an empty table none; rows
are read one by one, whole pages. Only key, url and page are read, so clashing names do no harm.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tallybook.llm.batches import map_rows

WINDOW = 3
#: Characters in a window from which text is taken to begin.
SURGE = 86
#: A form or an unclosed menu around at least this share of a page's text is its frame, not a part of it.
MOST = 0.5

# Elements by their part in a page.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
APART = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "header", "noscript", "template", "svg", "object", "canvas"}
FRAME = {"nav", "footer", "header", "menu", "head"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav",
    "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main"}
#: What a start tag ends: elements of the first set, up to the nearest of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Words that may stand beside a marked one in the same class; others (has-sidebar, nav-fixed) tell of a page's layout.
BESIDE = r"(?:site|page|post|article|main|primary|secondary|top|bottom|inline|box|block|bar|list|section|buttons?|links?|form|item|inner|slot|unit|text|image|[0-9]+)"
_WORD = (
    r"(?:ads?|adverts?|advertisements?|adsense|banners?|sponsor(?:ed|s)?|promo(?:tion)?s?|side-?bars?|comments?|replies|disqus|respond|cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modals?|overlay|"
    r"nav(?:bar|igation)?|menus?|bread-?crumbs?|footers?|masthead|site-?header|page-?header|social|share|sharing|related|recommend(?:ed|ations)?|newsletter|subscribe|subscription|signup|login|search|pagination|pager|widgets?|toolbar|skip-?link|complementary|contentinfo)"
)
MARKED = re.compile(rf"(?:{BESIDE}[-_]+)*{_WORD}(?:[-_]+(?:{_WORD}|{BESIDE}))*[0-9]*")
_ADVERT = re.compile(rf"(?:{BESIDE}[-_]+)*(?:ads?|adverts?|advertisements?|adsense|banners?|sponsor(?:ed|s)?|cookies?|consent|gdpr|newsletter|subscribe)(?:[-_]+(?:{_WORD}|{BESIDE}))*[0-9]*")
PARAGRAPHS = {"p", "blockquote", "pre"}
_REMARKS = re.compile(r"comment|reply|related|promo|(?<![a-z])ads?(?![a-z])")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_BETWEEN = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*+")
_EQUALS = re.compile(r"\s*+=\s*+")
_PLAIN = re.compile(r"[^\s>]*+")
_SPACE = re.compile(r"\s+")
_UNSEEN = re.compile(r"display\s*:\s*none")


class _Reader:
    """Tags and texts of a page in order; every step moves forward."""

    def __init__(self, page: str):
        self.page, self.spent = page, set()

    def find(self, what: str, at: int) -> int:
        """Like str.find, but what wasn't found once isn't looked for again."""
        if what in self.spent:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.spent.add(what)
        return found

    def tag(self, at: int) -> tuple[str, dict[str, str], bool, int] | None:
        """Name, attributes, whether it closes itself, and the end of the tag whose name begins at a place; None if cut off."""
        page, begin = self.page, at
        name = _NAME.match(page, at)
        at, attributes, alone = name.end(), {}, False
        if page[at : at + 1] == ">":
            return name[0].lower(), attributes, False, at + 1
        while True:
            to = _BETWEEN.match(page, at).end()
            alone, at = page[at:to].rstrip().endswith("/"), to
            if at >= len(page):
                return None
            if page[at] == ">":
                return name[0].lower(), attributes, alone, at + 1
            key = _ATTRIBUTE.match(page, at)
            at, value = key.end(), ""
            if equals := _EQUALS.match(page, at):
                at = equals.end()
                quote = page[at : at + 1]
                if quote in ("'", '"'):
                    end = self.find(quote, at + 1)
                    if end < 0:  # a quote that is never closed: the tag ends at its first >
                        end = self.find(">", begin)
                        return None if end < 0 else (name[0].lower(), attributes, False, end + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    plain = _PLAIN.match(page, at)
                    value, at = plain[0], plain.end()
            attributes.setdefault(key[0].lower(), value)

    def events(self) -> Iterator[tuple]:
        """("text", text), ("open", name, attributes, alone) and ("close", name)."""
        page, at = self.page, 0
        while at < len(page):
            to = page.find("<", at)
            if to < 0:
                to = len(page)
            if to > at:
                yield "text", page[at:to]
            following = page[to + 1 : to + 2]
            if to >= len(page):
                return
            if page.startswith("<!--", to):
                end = self.find("-->", to + 4)
                at = end + 3 if end >= 0 else len(page)
            elif page.startswith("<![CDATA[", to):
                end = self.find("]]>", to + 9)
                at = end + 3 if end >= 0 else len(page)
            elif following and following in "!?":
                end = self.find(">", to)
                at = end + 1 if end >= 0 else len(page)
            elif following.isascii() and following.isalpha() or following == "/" and page[to + 2 : to + 3].isascii() and page[to + 2 : to + 3].isalpha():
                closing = following == "/"
                found = self.tag(to + 1 + closing)
                if found is None:
                    return
                name, attributes, alone, at = found
                if closing:
                    yield "close", name
                    continue
                yield "open", name, attributes, alone
                if name in RAW and not alone:
                    end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(page, at)
                    at = end.start() if end else len(page)
            else:
                yield "text", "<"
                at = to + 1


class _Element:
    """An element of a page: its place in the tree (`enter` and `leave` number the tags), and how many characters of text it holds."""

    __slots__ = ("article", "attributes", "before", "enter", "explicit", "framed", "held", "leave", "name", "names", "parent", "within")

    def __init__(self, name: str, attributes: dict[str, str], parent: _Element | None, before: int, enter: int):
        self.name, self.attributes, self.parent, self.before, self.enter, self.leave = name, attributes, parent, before, enter, enter
        self.names = [x for key in ("class", "id", "role", "aria-label") if key in attributes for x in entities.unescape(attributes[key]).lower().split()]
        self.article = name in MAIN and not any(_REMARKS.search(x) for x in self.names)
        self.explicit, self.framed, self.held, self.within = False, False, 0, int(self.article)

    def around(self, other: _Element | None) -> bool:
        return other is not None and self.enter <= other.enter <= self.leave


def parsed(page: str) -> list[tuple]:
    """The page as ("text", text), ("open", element) and ("close", element); elements left open are closed where HTML says."""
    out, stack, chars = [], [_Element("", {}, None, 0, 0)], 0
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a name are

    def close(to: int, explicit: bool = False) -> None:
        while len(stack) > to:
            element = stack.pop()
            if stack:
                places[element.name].pop()
                stack[-1].within += element.within
            element.held, element.leave = chars - element.before, len(out)
            element.explicit = explicit and len(stack) == to
            out.append(("close", element))

    def last(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def place(names: set[str], barriers: set[str]) -> int:
        """Where the innermost open element of these names is; 0 if there is none, or a barrier is further in."""
        at = last(names)
        return at if at and at >= last(barriers) else 0

    for event in _Reader(page).events():
        if event[0] == "text":
            chars += len(event[1].strip())
            out.append(event)
        elif event[0] == "open":
            _, name, attributes, alone = event
            if name in BLOCKS and (at := place({"p"}, {"td", "th", "table", "button"})):
                close(at)
            if name in HEADINGS and stack[-1].name in HEADINGS:
                close(len(stack) - 1)
            if name in ENDS and (at := place(*ENDS[name])):
                close(at)
            if name == "a" and (at := place({"a"}, BLOCKS)):
                close(at)
            element = _Element(name, attributes, stack[-1], chars, len(out))
            out.append(("open", element))
            if name in VOID or alone and (name not in BLOCKS or name in RAW):
                element.leave = len(out)
                out.append(("close", element))
                continue
            places.setdefault(name, []).append(len(stack))
            stack.append(element)
        else:
            name = event[1]
            at = place({name}, set() if name in BLOCKS else {"td", "th", "table", "article", "main", "body"})
            if at:
                close(at, True)
    close(0)
    return out


def _skipped(element: _Element, articles: int, chars: int, inside: bool) -> bool:
    """Whether an element holds no article text."""
    name, attributes = element.name, element.attributes
    if name in RAW or attributes and ("hidden" in attributes or _UNSEEN.search(attributes.get("style", "").lower())):
        return True
    wraps = articles > 0 and element.within == articles
    if name in MAIN:
        return not element.article
    if name in ("html", "body", ""):
        return False
    most = element.held >= MOST * chars
    if not element.explicit and not articles and most and name != "head":
        return False  # a menu that is never closed runs around the text that follows it
    if inside and name in HEADINGS:
        return False
    if any((_ADVERT if inside and name in PARAGRAPHS else MARKED).fullmatch(x) for x in element.names) and not wraps:
        return True
    if name == "form":
        return not wraps and (articles > 0 or not most)
    return name in APART and not (name == "header" and inside)


class _Line:
    """A line: text, its length without link text, the article it is in (None: none), its container, whether only skipped markup is before it, and whether it is an entry of a list of links."""

    __slots__ = ("article", "container", "joined", "listed", "plain", "text")

    def __init__(self, text: str, plain: int, article: _Element | None, container: _Element | None, joined: bool, listed: bool = False):
        self.text, self.plain, self.article, self.container, self.joined, self.listed = text, plain, article, container, joined, listed


#: Elements that don't count as containers: they are lines, or lists of lines.
_LINES = HEADINGS | {"p", "li", "ul", "ol"}


def page_lines(page: str) -> list[_Line]:
    """The lines of a page; empty ones stand for markup that holds no article text."""
    events = parsed(page)
    articles = sum(1 for kind, x in events if kind == "open" and x.article)
    chars = sum(len(x.strip()) for kind, x in events if kind == "text")
    lines: list[_Line] = []
    parts: list[str] = []
    state = {"plain": 0, "joined": False}
    path, holders, article, skipping, links, heading, entries = [], [], None, None, 0, 0, 0

    def finish() -> None:
        if not parts:
            return
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            lines.append(_Line(text, state["plain"], article, holders[-1] if holders else None, state["joined"], entries > 0 and not state["plain"]))
            state["joined"] = False
        parts.clear()
        state["plain"] = 0

    for kind, what in events:
        if skipping is not None:
            if kind == "close" and what is skipping:
                skipping = None
                continue
            if not (kind == "open" and what.article and not skipping.explicit and skipping.name not in RAW):
                continue
            skipping = None  # an unclosed element ends where an article begins
        if kind == "text":
            plain = entities.unescape(what)
            parts.append(plain)
            if not links or heading:
                state["plain"] += len(_SPACE.sub(" ", plain).strip())
        elif kind == "open":
            if _skipped(what, articles, chars, article is not None):
                block = what.name in BLOCKS
                if block or what.name in APART and not article:
                    finish()
                    state["joined"] = what.name not in FRAME and (state["joined"] or bool(lines) and lines[-1].text != "")
                    if not lines or any(x.text for x in lines[-WINDOW:]):
                        lines.extend(_Line("", 0, article, None, False) for _ in range(WINDOW))
                    if what.name in FRAME:
                        holder = what
                        while holder is not None and not holder.framed:
                            holder.framed, holder = True, holder.parent
                if what.name not in VOID:
                    skipping = what
                continue
            if what.name == "br":
                parts.append(" ")
            elif what.name in BLOCKS:
                finish()
                links = 0
                if what.article and article is None:
                    article = what
                heading += what.name in HEADINGS
            elif what.name == "a":
                links += 1
            if what.name not in VOID:
                path.append(what)
                entries += what.name == "li"
                if what.name in BLOCKS and what.name not in _LINES:
                    holders.append(what)
        else:
            listed = what in path[-1:] and path.pop().name == "li"
            if what.name in BLOCKS:
                finish()
                if what is article:
                    article = None
                heading = max(0, heading - (what.name in HEADINGS))
            elif what.name == "a":
                links = max(0, links - 1)
            entries -= listed
            if what in holders[-1:]:
                holders.pop()
    finish()
    return lines


def window_sums(lengths: list[int]) -> list[int]:
    """The sum of each line's and the following WINDOW - 1 lines' lengths."""
    padded = lengths + [0] * WINDOW
    return [sum(padded[k : k + WINDOW]) for k in range(len(lengths))]


def spans_of(lengths: list[int], surge: int) -> list[tuple[int, int, bool]]:
    """(begin, end, surges) of the runs between dives to zero; a run surges if a window of it reaches the threshold."""
    sums, spans, begin, high = window_sums(lengths), [], None, 0
    for k, total in enumerate([*sums, 0]):
        if total == 0:
            if begin is not None:
                spans.append((begin, k, high >= surge))
            begin, high = None, 0
        elif begin is not None or lengths[k]:
            begin = k if begin is None else begin
            high = max(high, total)
    return spans


def weights(lines: list[_Line]) -> tuple[list[int], bool]:
    """What each line counts in the distribution, and whether articles decide it."""
    of_articles = [len(x.text) if x.article is not None else 0 for x in lines]
    return (of_articles, True) if any(of_articles) else ([x.plain for x in lines], False)


def main_text(page: str | None) -> str:
    """The main text of a page: its lines between surge and dive, joined by newlines."""
    lines = page_lines(page or "")
    lengths, in_articles = weights(lines)
    surge = max(1, min(SURGE, max(window_sums(lengths), default=0)))
    spans = spans_of(lengths, surge)
    surging = [s for s in spans if s[2]]
    if not surging:
        return ""
    begin, end, _ = core = max(surging, key=lambda s: (sum(lengths[s[0] : s[1]]), -s[0]))
    around = None if in_articles else _container(lines[begin:end])
    within = [bool(x.text) and (x.article is not None if in_articles else around is None or around.around(x.container)) for x in lines]
    held = [s for s in surging if s == core or all(within[k] for k in range(s[0], s[1]) if lengths[k])]
    kept = {k for s in held for k in range(s[0], s[1])}
    # Short spans that only skipped markup parts from kept ones, onward and backward.
    for pairs in (list(zip(spans, spans[1:])), list(zip(spans, spans[1:]))[::-1]):
        for (a, b, _), (c, d, _) in pairs:
            if (a in kept) != (c in kept) and lines[c].joined and within[a] and within[c] and not any(lines[k].text for k in range(b, c)):
                kept.update(range(a, b), range(c, d))
    if not in_articles:
        # What the text's own container holds between kept lines, and what follows with text of its own.
        home = lines[begin].container if around is None else around
        own = [bool(x.text) and (x.container is home if around is None else within[k]) for k, x in enumerate(lines)]
        final = max([k for k in kept if lines[k].text] + [k for s in spans for k in range(s[0], s[1]) if own[k] and lengths[k] and k > begin])
        kept.update(k for k in range(min(kept), final) if own[k] and not lines[k].listed)
        kept.add(final)
    return "\n".join(lines[k].text for k in sorted(kept) if lines[k].text and not (in_articles and lines[k].article is None))


def _container(lines: list[_Line]) -> _Element | None:
    """The innermost element around all lines, wider as long as that holds no part of the page's frame."""
    at = None
    for line in lines:
        if line.text:
            at = at or line.container
            while at is not None and not at.around(line.container):
                at = at.parent
            if at is None:
                return None
    while at is not None and at.parent is not None and at.parent.name not in ("body", "html", "") and not at.parent.framed:
        at = at.parent
    return None if at is None or at.name in ("body", "html", "") else at


def _row(page_id: int, url: str | None, page: str | None) -> Iterator[tuple]:
    text = main_text(page)
    yield page_id, url, text, len(text)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return map_rows(pages.select(page_id, url, page), _row, "page_id bigint, url string, text string, n_chars bigint")
