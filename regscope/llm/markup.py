"""A forgiving reader of HTML: the blocks of a page, the tree of its elements and what their names say of their role."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape

# Element and class names, as web pages use them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li listing main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset(
    "applet aside audio button canvas datalist dialog fieldset footer form head iframe map math menu nav noembed noframes noscript object "
    "script search select style svg template textarea title video xmp".split()
)
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adsense adslot advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment commentform commentlist comments "
    "consent cookie cookies copyright disclaimer disqus footer footnav gdpr legal lightbox login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification notifications overlay pager pagination paywall poll popup promo promotion promotions recommended related respond rss share sharing sidebar sidenav "
    "signin signup skip social sponsor sponsored sponsors subscribe subscription submenu survey taboola toast toolbar topbar trending widget widgets".split()
)
HEADER_WORDS = frozenset("header hdr sitehead topnav".split())
VOIDING_WORDS = frozenset("free has is no with without".split())
MAIN_NAMES = frozenset(
    "article article-body article-content article-text articlebody blog-post content content-body entry entry-content main main-content maincontent page-content "
    "post post-body post-content postbody story story-body".split()
)
CONTAINERS = frozenset("dir div dl figure ol section table ul".split())  # what may be a template's part inside an article

NONE, NOISE, CLASS_NOISE, HEADER, MAIN, NAMED = range(6)
CLOSES = {
    "li": (("li",), ("ul", "ol", "dir", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "caption"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot", "caption"), ("table",)), "thead": (("tbody", "thead", "tfoot", "caption"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "caption"), ("table",)),
}
SCOPE = frozenset("html table td th caption button object template".split())
CELLS = ("td", "th")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
OTHER_BLOCKS = BLOCKS - {"p", *HEADINGS}
DEEPEST = 32  # in a style tree, elements below are part of their ancestor at this depth

ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")  # a tag as it should be
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
ENDS = {tag: re.compile(f"</{tag}(?=[\\s/>])", re.I) for tag in RAW}


@dataclass(slots=True)
class Element:
    parent: int
    tag: str
    label: str
    role: int
    depth: int
    closed: bool = False
    children: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)


@dataclass(slots=True)
class Page:
    elements: list[Element]
    #: blocks in page order: an element and its collapsed text, or -1 and the raw (element, text) parts of several elements
    blocks: list[tuple[int, str | list[tuple[int, str]]]]


def named(value: str) -> int:
    """What the class or identifier names of an element say."""
    found = NONE
    for name in value.split():
        words = [w for w in re.split(r"[^a-z0-9]+", HUMP.sub("-", name).lower()) if w]
        if VOIDING_WORDS.intersection(words):
            continue
        if NOISE_WORDS.intersection(words):
            return CLASS_NOISE
        if HEADER_WORDS.intersection(words):
            found = HEADER
        elif found == NONE and "-".join(words) in MAIN_NAMES:
            found = NAMED
    return found


def role_of(tag: str, attributes: dict[str, str]) -> int:
    role = attributes.get("role", "").strip().lower()
    if tag in ("html", "body"):
        return NONE
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return NOISE
    says = named(f"{attributes.get('class', '')} {attributes.get('id', '')}") if "class" in attributes or "id" in attributes else NONE
    if tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop", "").lower() == "articlebody":
        # an article's own classes also tell what else the page has; only a plain name makes it a comment or an advert
        plain = [w for w in (attributes.get("class", "") + " " + attributes.get("id", "")).lower().split() if w in NOISE_WORDS or w in ("reader-comment", "user-comment", "teaser")]
        return CLASS_NOISE if plain else MAIN
    if tag in NOISE_TAGS or role in NOISE_ROLES:
        return NOISE
    return HEADER if tag == "header" and says != CLASS_NOISE else says


PLAIN_ROLES = {t: role_of(t, {}) for t in BLOCKS | NOISE_TAGS}
PLAIN_INLINE = frozenset("a abbr b big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())


def attributes_of(inside: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(inside):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def label_of(tag: str, attributes: dict[str, str]) -> str:
    """Tag, classes and identifier, digits left out, so that numbered elements of a template are one."""
    classes, own = " ".join(sorted(attributes.get("class", "").split())), attributes.get("id", "")
    return re.sub(r"\d+", "#", f"{tag}.{classes}#{own}") if classes or own else tag


def read_page(html: str) -> Page:
    """The elements and blocks of a page. Work grows with the length of the page, whatever it holds; nothing is cut."""
    elements: list[Element] = []
    blocks: list[tuple[int, str | list[tuple[int, str]]]] = []
    stack: list[int] = []
    words: list[tuple[int, str]] = []  # of the open block
    opened: dict[str, int] = {}
    last = {q: html.rfind(q) for q in "\"'"}

    def flush() -> None:
        nonlocal words
        owner = words[0][0]
        if len(words) == 1 or all(w[0] == owner for w in words):
            if text := " ".join("".join([w[1] for w in words]).split()):
                blocks.append((owner, text))
        else:
            blocks.append((-1, words))
        words = []

    def push(tag: str, attributes: dict[str, str], role: int) -> None:
        parent = stack[-1] if stack else -1
        depth = elements[parent].depth + 1 if stack else 0
        label = label_of(tag, attributes) if attributes else tag
        if stack:
            children = elements[parent].children  # runs of equal ones count once
            if not children or children[-1] != label:
                children.append(label)
        elements.append(Element(parent, tag, label, role, depth))
        stack.append(len(elements) - 1)
        opened[tag] = opened.get(tag, 0) + 1

    def pop_to(place: int, closed: bool) -> None:
        elements[stack[place]].closed = closed
        while len(stack) > place:
            opened[elements[stack.pop()].tag] -= 1

    def open_at(tags: tuple[str, ...], limits: tuple[str, ...] | frozenset[str]) -> int:
        for place in range(len(stack) - 1, -1, -1):
            tag = elements[stack[place]].tag
            if tag in tags:
                return place
            if tag in limits:
                break
        return -1

    def say(text: str) -> None:
        if "&" in text:
            text = unescape(text)
        if not stack:
            push("body", {}, NONE)
        words.append((stack[-1], text))

    def tag_end(start: int) -> int:
        """Where the odd tag at ``start`` ends: at the first > outside quotes, where a quote that nothing closes doesn't count.
        The start itself if it is no tag, -1 if nothing ends it."""
        name = NAME.match(html, start)
        if not name:
            return html.find(">", start) if html.startswith(("<!", "<?", "</"), start) else start
        place = name.end()
        while True:
            end = html.find(">", place)
            quote = min((q for q in (html.find(x, place, end if end >= 0 else size) for x in "\"'") if q >= 0), default=-1)
            if end < 0 or quote < 0 or quote >= last[html[quote]]:
                return end
            place = html.find(html[quote], quote + 1) + 1

    at, size = 0, len(html)
    while at < size:
        start = html.find("<", at)
        if start < 0:
            say(html[at:])
            break
        if start > at:
            say(html[at:start])
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        plain = TAG.match(html, start)
        if plain:
            at = plain.end()
            closing, tag, inside = plain.groups()
            tag = tag.lower()
        else:
            end = tag_end(start)
            if end == start:
                say("<")
                at = start + 1
                continue
            if end < 0:
                break  # a tag that the page's end cuts off
            at = end + 1
            name = NAME.match(html, start)
            if not name:
                continue
            tag, closing, inside = name[1].lower(), html[start + 1] == "/", html[name.end() : end]
        if closing:
            if not opened.get(tag) and tag not in BLOCKS:
                continue
            if tag in BLOCKS:
                if words:
                    if tag in CELLS:
                        words.append((stack[-1], " "))
                    else:
                        flush()
                if stack and elements[stack[-1]].tag == tag:
                    found = len(stack) - 1
                elif opened.get(tag) or tag in HEADINGS:
                    found = open_at(HEADINGS if tag in HEADINGS else (tag,), SCOPE - {tag})
                else:
                    continue
            else:
                found = open_at((tag,), BLOCKS)
            if found >= 0:
                pop_to(found, True)
            continue
        if tag in RAW:
            ended = ENDS[tag].search(html, at)
            close = html.find(">", ended.end()) if ended else -1
            at = size if close < 0 else close + 1
            continue
        if tag in PLAIN_INLINE and not inside:
            continue
        attributes = attributes_of(inside) if inside else {}
        if tag == "br":
            if words:
                words.append((stack[-1], " "))
            continue
        if tag in VOID:
            if tag == "hr" and words:
                flush()
            elif tag == "img" and stack:
                elements[stack[-1]].links.append("src:" + attributes.get("src", ""))
            continue
        role = role_of(tag, attributes) if attributes else PLAIN_ROLES.get(tag, NONE)
        if tag in BLOCKS:
            if tag in ("html", "body") and opened.get(tag):
                continue
            if words:
                if tag in CELLS:
                    words.append((stack[-1], " "))
                else:
                    flush()
            if opened.get("p") and (found := open_at(("p",), OTHER_BLOCKS)) >= 0:  # an open paragraph has no block above it
                pop_to(found, False)
            if tag in HEADINGS:
                tags, limits = HEADINGS, OTHER_BLOCKS
            else:
                tags, limits = CLOSES.get(tag, ((), ()))
            if tags and (found := open_at(tags, limits)) >= 0:
                pop_to(found, False)
            if tag not in ("html", "body") and not stack:
                push("body", {}, NONE)
            push(tag, attributes, role)
        elif tag in NOISE_TAGS or role in (NOISE, CLASS_NOISE, MAIN):
            if not inside.endswith("/"):
                if not stack:
                    push("body", {}, NONE)
                push(tag, attributes, role)
        elif tag == "a" and stack and "href" in attributes:
            elements[stack[-1]].links.append("href:" + attributes["href"])
    if words:
        flush()
    return Page(elements, blocks)


def collapse(text: str) -> str:
    return " ".join(text.split())


def own_texts(page: Page) -> None:
    """Give each element the texts that stand directly in it."""
    for owner, said in page.blocks:
        if owner >= 0:
            page.elements[owner].texts.append(said)
            continue
        held: dict[int, list[str]] = {}
        for element, text in said:
            held.setdefault(element, []).append(text)
        for element, parts in held.items():
            if text := collapse("".join(parts)):
                page.elements[element].texts.append(text)


def main_elements(page: Page) -> tuple[list[bool], bool]:
    """Which elements belong to the main text by their roles, and whether the page names its main part.

    An article or a main part counts first, then elements whose names say content, then the whole page. What a noise role
    holds is out, but a noise element that nothing closes, or that has only its class name against it, doesn't take an
    article with it if the page has no other.
    """
    elements = page.elements
    noise, strict = [False] * len(elements), [False] * len(elements)
    for k, e in enumerate(elements):
        above = e.parent
        noise[k] = e.role in (NOISE, CLASS_NOISE) or (above >= 0 and noise[above])
        strict[k] = (e.role == NOISE and e.closed) or (above >= 0 and strict[above])
    said = [False] * len(elements)
    for owner, text in page.blocks:
        if owner >= 0:
            said[owner] = True
        else:
            for k, part in text:
                said[k] = said[k] or not (part.isspace() or not part)
    below = said.copy()
    for k in range(len(elements) - 1, -1, -1):
        if below[k] and elements[k].parent >= 0:
            below[elements[k].parent] = True
    named_main = True
    chosen = [k for k, e in enumerate(elements) if e.role == MAIN and not noise[k] and below[k]]
    holds = [False] * len(elements)  # an article
    for k in reversed(range(len(elements))):
        if elements[k].parent >= 0 and (holds[k] or (elements[k].tag == "article" and elements[k].role == MAIN and not noise[k] and below[k])):
            holds[elements[k].parent] = True
    chosen = [k for k in chosen if elements[k].tag == "article" or not holds[k]]
    if not chosen:
        chosen = [k for k, e in enumerate(elements) if e.role == MAIN and not strict[k] and below[k]]
    if not chosen:
        chosen = [k for k, e in enumerate(elements) if e.role == NAMED and not noise[k] and below[k]]
    if not chosen:
        chosen, named_main = [k for k, e in enumerate(elements) if e.parent < 0], False
    picked, inside = set(chosen), [False] * len(elements)
    for k, e in enumerate(elements):
        up = e.parent
        if k in picked:
            inside[k] = True
        elif up >= 0 and inside[up]:
            inside[k] = e.role not in (NOISE, CLASS_NOISE) and (named_main or e.role != HEADER)
    return inside, named_main


def hashed(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Keys:
    """Keys of paths of labels; a path's key is made once per task."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}

    def key(self, parent: int, label: str) -> int:
        found = self.known.get((parent, label))
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[parent, label] = hashed(f"{parent} {label}")
        return found

    def of(self, page: Page) -> list[int]:
        out: list[int] = []
        for e in page.elements:
            out.append(out[e.parent] if e.depth > DEEPEST else self.key(out[e.parent] if e.parent >= 0 else 0, e.label))
        return out


@dataclass(slots=True)
class TreeRows:
    """Pages' shares of their sites' style trees, in columns. A row of kind 0 has a node's style (the sequence of its children)
    and its share of its parent's children; one of kind 1 has a content feature (a text, a link's or an image's address) of
    the leaf that stands for a node's own content. Elements of one path are one node."""

    key: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    value: list[str] = field(default_factory=list)
    share: list[float] = field(default_factory=list)

    def row(self, *values: object) -> None:
        for column, value in zip((self.key, self.parent, self.depth, self.kind, self.value, self.share), values, strict=True):
            column.append(value)

    def add(self, page: Page, keys: Keys) -> None:
        own_texts(page)
        at = keys.of(page)
        nodes: dict[int, list] = {}  # parent, depth, how often, children with own content, how often own content, styles, features
        for k, e in zip(at, page.elements, strict=True):
            node = nodes.get(k)
            if node is None:
                node = nodes[k] = [at[e.parent] if e.parent >= 0 else 0, e.depth, 0, 0, 0, [], []]
            if e.texts or e.links:
                node[6] += e.texts
                node[6] += e.links
                node[3] += 1
                node[4] += 1
            if e.depth <= DEEPEST:
                node[2] += 1
                if e.parent >= 0:
                    nodes[node[0]][3] += 1
                if e.depth < DEEPEST:
                    node[5].append(" ".join(e.children))
        for k, (parent, depth, often, children, own, styles, features) in nodes.items():
            self.row(k, parent, depth, 0, styles[0] if len(styles) == 1 else "|".join(dict.fromkeys(styles)), often / nodes[parent][3] if parent in nodes else 1.0)
            if own:
                leaf = keys.key(k, "own content")
                self.row(leaf, k, depth + 1, 0, "", own / children)
                features = dict.fromkeys(features)
                n = len(features)
                self.key += [leaf] * n
                self.parent += [k] * n
                self.depth += [depth + 1] * n
                self.kind += [1] * n
                self.value += features
                self.share += [0.0] * n


def removable(page: Page, keys: Keys) -> list[int]:
    """Keys of the branches that :func:`main_text` would remove if they were low."""
    inside, named_main = main_elements(page)
    if not named_main:
        at = keys.of(page)
        return sorted({k for k, own in zip(at, inside, strict=True) if own} | {keys.key(k, "own content") for k, own in zip(at, inside, strict=True) if own})
    held = [k for k, e in enumerate(page.elements) if inside[k] and e.tag in CONTAINERS and e.parent >= 0 and inside[e.parent]]
    if not held:
        return []
    at = keys.of(page)
    tops = [k for k, e in enumerate(page.elements) if inside[k] and not (e.parent >= 0 and inside[e.parent])]  # asked too, as a low main part keeps all
    return sorted({at[k] for k in held + tops})


def main_text(page: Page, low: frozenset[int] | set[int], keys: Keys) -> str:
    """The blocks of the main text, joined by line feeds, without the branches whose keys are ``low``.

    Inside a named main part only containers can be a template's branch, and only where the part itself is not low: pages
    that are all copies of each other say nothing of a template.
    """
    inside, named_main = main_elements(page)
    if low:
        at, gone, kept = keys.of(page), [False] * len(page.elements), [False] * len(page.elements)
        for k, e in enumerate(page.elements):
            up = e.parent
            top = inside[k] and not (up >= 0 and inside[up])
            kept[k] = (top and at[k] in low) or (up >= 0 and kept[up])  # of a low main part everything stays
            gone[k] = (up >= 0 and gone[up]) or (at[k] in low and not (named_main and (top or kept[k] or e.tag not in CONTAINERS)))
            if gone[k]:
                inside[k] = False
        if not named_main:
            leaf = [keys.key(k, "own content") in low for k in at]
            inside = [x and not y for x, y in zip(inside, leaf, strict=True)]
    out = []
    for owner, text in page.blocks:
        if owner < 0:
            text = collapse("".join([part for element, part in text if inside[element]]))
            if text:
                out.append(text)
        elif inside[owner]:
            out.append(text)
    return "\n".join(out)
