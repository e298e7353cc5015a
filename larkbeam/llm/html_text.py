"""The main text of a page by scoring its tree.

Blocks of text pass points to the elements around them, for being there, for
their length and for their commas: all to the parent, half to its parent, and
less further up. Links take points away. The element with the most points is the
article, or the article or main around it. Where there is none, whatever stands
beside it or beside what is around it belongs to it, unless it is mostly links.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from larkbeam.llm.batches import map_batches

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)")
_COMMENT_END = re.compile(r"(?<=<!)--?-?>|--!?>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
    "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: The share of a text in links from which on it is taken for a menu.
_LINKED = 0.25
_DROPPED = {
    "nav", "header", "footer", "aside", "form", "button", "select", "option", "label", "head", "script", "style",
    "noscript", "template", "iframe", "object", "embed", "svg", "math", "textarea", "title", "dialog", "menu", "canvas",
    "audio", "video", "map", "input",
}
_KEPT = {"html", "body", "article", "main"}
_DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "form", "menu", "menubar", "toolbar"}
_DROPPED_NAMES = re.compile(
    r"(?:ad|ads|adv|advert\w*|adsense|adbox|adslot|banner|sponsor\w*|promo\w*|cookies?|cookiebar|consent|gdpr|notices?|alerts?|"
    r"popup|modal|overlay|sidebar\w*|side|rail|menus?|nav|navbar|navigation|topbar|breadcrumbs?|toc|share|sharing|social|comments?|"
    r"commentlist|disqus|discussion|replies|reply|respond|footer|foot|header|masthead|related|recommend\w*|trending|"
    r"newsletter|subscribe|subscription|signup|login|search|widgets?|pagination|pager|skip|hidden|copyright|legal)",
    re.I,
)
#: What may stand beside such a name in a class, as in site-header or related-posts; not has, no, with, article or content.
_BESIDE = re.compile(
    r"site|page|main|primary|secondary|global|top|bottom|left|right|mobile|desktop|sticky|fixed|list|box|bar|block|slot|unit|area|"
    r"section|container|wrapper|wrap|inner|outer|links?|icons?|buttons?|btns?|posts?|items?|stories|form|policy|thread|\d+",
    re.I,
)
#: Names that an article's own parts have too: within one, they count only where there is no prose.
_AMBIGUOUS = re.compile(
    r"search|legal|discussion|side|rail|header|toc|replies|reply|respond|login|overlay|banner|copyright|trending|"
    r"side\w*(?<!bar)|skip|pager|signup|alerts?|menus?|foot",
    re.I,
)
#: Letters outside links from which on a part is taken for prose.
_PROSE = 40
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TALK = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|discussion|replies|reply|respond)(?:$|[\s_-])", re.I)
#: What a start tag ends, up to the nearest of the elements that stand around it.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_SCOPES = {"article", "body", "button", "div", "footer", "form", "header", "html", "li", "main", "nav", "section", "table", "td", "th", "ul", "ol", "aside", "blockquote"}


@dataclass(eq=False)
class Element:
    tag: str
    attributes: dict[str, str]
    parent: Element | None
    children: list[Element | str] = field(default_factory=list)
    score: float = 0.0
    letters: int = 0
    linked: int = 0
    size: int = 0
    pruned: bool = False

    def names(self) -> str:
        return f"{self.attributes.get('class', '')} {self.attributes.get('id', '')}"

    def named(self, within: bool = False) -> bool:
        """Whether a class or the id is a name of what surrounds a text.

        ``within`` an article, a name that its own parts may have too does not count.
        """
        if not self.attributes or self.tag in _KEPT or self.tag in _HEADINGS:
            return False
        for name in self.names().split():
            parts = [p for p in re.split("[_-]+", name) if p]
            known = [bool(_DROPPED_NAMES.fullmatch(p)) for p in parts]
            if any(known) and all(k or _BESIDE.fullmatch(p) for k, p in zip(known, parts)):
                if not within or any(k and not _AMBIGUOUS.fullmatch(p) for k, p in zip(known, parts)):
                    return True
        return False

    def within(self, tags: set[str]) -> bool:
        e = self.parent
        while e is not None and e.tag not in tags:
            e = e.parent
        return e is not None

    def dropped(self) -> bool:
        if self.tag in _DROPPED and not (self.tag == "header" and self.within({"article"})):
            return True
        a = self.attributes
        if not a or self.tag in _KEPT:
            return False
        if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in _DROPPED_ROLES:
            return True
        style = a.get("style", "").replace(" ", "").lower()
        return "display:none" in style or "visibility:hidden" in style


def _attributes(text: str) -> dict[str, str]:
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}
    if re.search(r"(?:^|\s)hidden(?:\s|$)", _ATTRIBUTE.sub(" ", text), re.I):
        found["hidden"] = ""
    return found


def parse(page: str) -> Element:
    """The tree of a page, however badly it is nested."""
    root = at = Element("html", {}, None)
    open_: dict[str, int] = {}
    i, n = 0, len(page)

    def close(to: Element) -> Element:
        nonlocal at
        while at is not to:
            open_[at.tag] -= 1
            at = at.parent
        return at

    while i < n:
        start = page.find("<", i)
        if start < 0:
            start = n
        if start > i:
            at.children.append(page[i:start])
        if start == n:
            break
        if page.startswith("<!--", start):
            m = _COMMENT_END.search(page, start + 2)  # an empty one may end with its own hyphens
            i = m.end() if m else n
            continue
        if page.startswith("<![CDATA[", start):
            end = page.find("]]>", start)
            i = n if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            i = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, start) or _LOOSE.match(page, start)
        if not m:
            at.children.append("<")
            i = start + 1
            continue
        i = m.end()
        tag = m[2].lower()
        if m[1]:
            if open_.get(tag):
                e = at
                while e.tag != tag:
                    e = e.parent
                close(e)
                open_[tag] -= 1
                at = e.parent
            continue
        if tag in _BLOCK and open_.get("p"):
            e = at
            while e is not root and e.tag != "p" and e.tag not in _SCOPES:
                e = e.parent
            if e.tag == "p":
                close(e)
                open_["p"] -= 1
                at = e.parent
        if tag in _ENDS and any(open_.get(t) for t in _ENDS[tag][0]):
            ended, around = _ENDS[tag]
            e = at
            while e is not root and e.tag not in ended and e.tag not in around:
                e = e.parent
            if e.tag in ended:
                close(e)
                open_[e.tag] -= 1
                at = e.parent
        new = Element(tag, _attributes(m[3]) if "=" in m[3] or "hidden" in m[3] else {}, at)
        at.children.append(new)
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, i)
            stop = page.find(">", end.start()) if end else -1
            i = n if stop < 0 else stop + 1
            continue
        at = new
        open_[tag] = open_.get(tag, 0) + 1
    return root


def prune(root: Element) -> None:
    """Marks what is no part of any text.

    A class or an id does not count around the largest article or main, nor around more than half of the page's text, unless
    an article or main beside it has a quarter as much, or it names comments.
    """
    left, stack = [], [root]
    while stack:
        e = stack.pop()
        e.pruned = e is not root and e.dropped()
        if not e.pruned:
            left.append(e)
            stack.extend(c for c in e.children if isinstance(c, Element))
    for e in reversed(left):
        e.size += sum(len(c.strip()) for c in e.children if isinstance(c, str))
        if e.parent is not None:
            e.parent.size += e.size
    core = max((e for e in left if e.tag in ("article", "main") and e.size), key=lambda e: e.size, default=None)
    around, e = set(), core
    while e is not None:
        around.add(id(e))
        e = e.parent
    for e in left:
        if e is not root and id(e) not in around and e.named():
            # what prose names in an article is a part of it
            if e.within({"article"} if core is not None and core.tag == "article" else {"main"}) and not e.named(within=True) and _prose(e):
                continue
            beside = core is not None and (4 * core.size >= e.size or bool(_TALK.search(e.names())))
            e.pruned = beside or 2 * e.size <= root.size


def _prose(e: Element) -> bool:
    """Whether an element has text outside links, of some length."""
    size, stack = 0, [e]
    while stack and size < _PROSE:
        for child in stack.pop().children:
            if isinstance(child, str):
                size += len(child.strip())
            elif not child.pruned and child.tag != "a":
                stack.append(child)
    return size >= _PROSE


def _walk(root: Element) -> Iterator[tuple[Element | str, bool, bool]]:
    """Texts and elements left, in page order: each element before and after its content."""
    stack: list[tuple[Element | str, bool, bool]] = [(root, True, False)]
    while stack:
        node, before, linked = stack.pop()
        yield node, before, linked
        if isinstance(node, Element) and before:
            stack.append((node, False, linked))
            inside = linked or node.tag == "a"
            for child in reversed(node.children):
                if isinstance(child, str):
                    stack.append((child, True, inside))
                elif not child.pruned:
                    stack.append((child, True, inside))


def blocks(root: Element) -> list[tuple[Element, str, int]]:
    """Each run of text in one block: the element, the text, and how much of it is in links."""
    out: list[tuple[Element, str, int]] = []
    holders: list[Element] = [root]
    parts: list[str] = []
    in_links = 0

    def end() -> None:
        nonlocal in_links
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((holders[-1], text, min(len(text), in_links)))
        parts.clear()
        in_links = 0

    for node, before, linked in _walk(root):
        if isinstance(node, str):
            parts.append(node)
            in_links += len(node.strip()) if linked else 0
        elif node.tag in _BLOCK:
            end()
            if before:
                holders.append(node)
            elif len(holders) > 1:
                holders.pop()
        elif node.tag == "br" and before:
            parts.append(" ")
    end()
    return out


def _scored(found: list[tuple[Element, str, int]]) -> list[Element]:
    """Elements around blocks, with points and the letters in them."""
    seen: dict[int, Element] = {}
    for holder, text, linked in found:
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        # a block's own element stands for the text; points go to those around it
        e = holder.parent if holder.tag not in _KEPT | {"div", "section", "td"} and holder.parent else holder
        inside = holder
        while inside is not e:
            inside.letters += len(text)
            inside.linked += linked
            inside = inside.parent
        level = 0
        while e is not None:
            seen.setdefault(id(e), e)
            e.letters += len(text)
            e.linked += linked
            if level < 6:
                e.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            level += 1
            e = e.parent
    return list(seen.values())


def _density(e: Element) -> float:
    return e.linked / e.letters if e.letters else 0.0


def _is_in(e: Element | None, other: Element) -> bool:
    while e is not None and e is not other:
        e = e.parent
    return e is other


def _headline(found: list[tuple[Element, str, int]], best: Element) -> set[int]:
    """The last h1 before an article, if it has none itself."""
    places = [i for i, (holder, _, _) in enumerate(found) if _is_in(holder, best)]
    heads = [i for i, (holder, _, _) in enumerate(found) if holder.tag == "h1"]
    if not places or any(_is_in(found[i][0], best) for i in heads):
        return set()
    return {id(found[i][0]) for i in [i for i in heads if i < places[0]][-1:]}


def main_text(page: str | None) -> str:
    """The article's blocks in page order, one to a line; empty if there is none."""
    root = parse(page or "")
    prune(root)
    found = blocks(root)
    around = _scored(found)
    if not around:
        return ""
    own = {id(e): e.score * (1 - _density(e)) * (1.5 if e.tag in ("article", "main") else 1) for e in around}
    best = max(around, key=lambda e: own[id(e)])
    if best.parent is not None and best.tag not in _KEPT:
        # an article or main around it holds the whole
        e = best.parent
        while e is not None and e.tag not in ("article", "main"):
            e = e.parent
        best = e or best
    e = best
    while best.tag == "article" and e is not None:
        best, e = (e, None) if e.tag == "main" else (best, e.parent)
    chosen, path_up = {id(best)}, set()
    if best.tag in ("article", "main"):
        chosen |= _headline(found, best)
    if best.tag not in _KEPT:
        least = max(2.0, 0.2 * own[id(best)])
        e = best
        while e.parent is not None:
            beside = [c for c in e.parent.children if c is not e]
            path_up.add(id(e.parent))
            while beside:
                c = beside.pop()
                if isinstance(c, str) or c.pruned or not c.letters:
                    continue
                if _density(c) < _LINKED or own.get(id(c), 0) >= least:
                    chosen.add(id(c))
                elif c.tag in ("div", "section", "center"):
                    # its own text, and what in it is not mostly links
                    path_up.add(id(c))
                    beside.extend(c.children)
            e = e.parent
    out = []
    inside: dict[int, bool] = {}
    for holder, text, linked in found:
        if id(holder) not in inside:
            e, path = holder, []
            while e is not None and id(e) not in inside and id(e) not in chosen:
                path.append(id(e))
                e = e.parent
            known = e is not None and (id(e) in chosen or inside[id(e)])
            inside.update(dict.fromkeys([*path, id(holder)], known))
        if inside[id(holder)] or id(holder) in path_up and linked < _LINKED * len(text):
            out.append(text)
    return "\n".join(out)


def extracted(df: DataFrame, keep: list[str], page: str) -> DataFrame:
    """``text`` and ``n_chars``, the main text of every page and its code points, beside ``keep``.

    A null page counts as empty and has an empty text, as has a page without
    text. Repeated rows give equal rows. Other columns are ignored.
    """

    def work() -> Callable[[list], list[tuple]]:
        return lambda pages: [(t, len(t)) for t in map(main_text, pages)]

    return map_batches(df, keep, page, work, "text string, n_chars long")
