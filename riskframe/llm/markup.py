"""Blocks of text of an HTML page, each with the zone it stands in."""

from __future__ import annotations

import html
import re

# Zones: page furniture, text outside any declared container, a main container, an article.
CHROME, OPEN, MAIN, ARTICLE = 0, 1, 2, 3

# Elements by what they mean for the text.
RAW = "script style noscript template svg math iframe object canvas audio video textarea select title".split()
FURNITURE = frozenset("nav footer aside head form button dialog menu datalist fieldset label input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = HEADINGS | FURNITURE | frozenset(
    "html body main article section header div p ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address details summary hr".split()
)
# An opening tag that ends an open element of the same kind of list or row.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CONTAINERS = frozenset("div section ul ol dl table article main aside header nav td body html".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
# A class or id names furniture if it is one of these words, ends in one ("site-footer"), or starts
# with one and ends in a word for a part of a page ("share-buttons"); "side-effects" does not.
_ALWAYS = (
    r"ads?|advert(?:s|isement|ising)?|sponsor(?:ed|s)?|promo(?:s|tion)?|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|cookies?|"
    r"consent|gdpr|notices?|alert|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|"
    r"comments?|replies|disqus|popup|modal|overlay|pagination|toolbar"
)
_OUTSIDE = r"header|masthead|footer|banner|side|search"
_PARTS = (
    r"list|links?|items?|box|bar|buttons?|icons?|area|section|container|wrapper|wrap|inner|widget|block|panel|posts?|stories|slot|unit|"
    r"form|left|right|top|bottom|toggle|overlay|banner|notice|thread|feed|menu|content"
)


def _furniture(words: str) -> re.Pattern:
    return re.compile(rf"(?:[\w-]*[_-])?(?:{words})|(?:{words})(?:[_-](?:{_PARTS}))+", re.IGNORECASE)


# Inside an article a header, footer or banner belongs to it.
FURNITURE_NAMES = {True: _furniture(_ALWAYS), False: _furniture(f"{_ALWAYS}|{_OUTSIDE}")}
HIDDEN_STYLE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
# Headings below which readers write.
COMMENTS = re.compile(
    r"(?:\d+\s+)?(?:reader |user |reader's )?(?:comments?|responses?|replies|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?:?|"
    r"leave a (?:reply|comment)|join the discussion",
    re.IGNORECASE,
)
ARTICLE_NAMES = re.compile(r"article-?body|article-?content|post-?(?:body|content)|entry-?content|story-?body", re.IGNORECASE)

_RAW = "|".join(RAW)
_TOKENS = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|"
    r"<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")


def attributes_of(text: str) -> dict[str, str]:
    """Attribute names, lower case, with their values; of a repeated one the first."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return out


def _zone(tag: str, attributes: str, zone: int) -> int:
    """Zone inside an element that opens in `zone`."""
    if zone == CHROME or tag in FURNITURE:
        return CHROME
    found = attributes_of(attributes) if attributes else {}
    names = [*found.get("class", "").split(), *found.get("id", "").split()]
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or role in FURNITURE_ROLES:
        return CHROME
    if HIDDEN_STYLE.search(found.get("style", "")):
        return CHROME
    named = tag not in HEADINGS and tag not in ("html", "body", "article", "main")
    if named and any(map(FURNITURE_NAMES[zone == ARTICLE].fullmatch, names)):
        return CHROME
    if tag == "header":
        # an article's own header is its text, one of a page is not
        return ARTICLE if zone == ARTICLE else CHROME
    if tag == "article" or found.get("itemprop", "").lower() == "articlebody" or any(map(ARTICLE_NAMES.fullmatch, names)):
        return ARTICLE
    if tag == "main" or role == "main":
        return max(zone, MAIN)
    return zone


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of every block that has text, in page order.

    Character references are decoded; white space inside a block, line breaks included, becomes
    one space. Unclosed and crossed elements end with what encloses them. Text of furniture inside a
    block is left out of it. Below a heading that announces comments, all is furniture up to the next
    heading of its rank or the end of what holds it.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    parts: list[tuple[int, str]] = []
    at, zone, muted, heading = 0, OPEN, None, None

    def flush() -> None:
        nonlocal muted, heading
        if not parts:
            return
        kept = [p for p in parts if p[0] != CHROME and p[1]]
        text = " ".join(html.unescape("".join(t for _, t in kept)).split())
        own = max((z for z, _ in kept), default=CHROME) if text else CHROME
        text = text or " ".join(html.unescape("".join(t for _, t in parts)).split())
        parts.clear()
        if not text:
            return
        if heading is not None:
            rank, depth = heading
            if muted is not None and rank <= muted[0]:
                muted = None
            if rank > 1 and COMMENTS.fullmatch(text):
                muted = (rank, depth)
        out.append((CHROME if muted is not None else own, text))

    def leave(depth: int) -> None:
        nonlocal zone, muted, heading
        del stack[depth:]
        zone = stack[-1][1] if stack else OPEN
        if muted is not None and len(stack) < muted[1]:
            muted = None
        heading = None

    page = page or ""
    for m in _TOKENS.finditer(page):
        parts.append((zone, page[at : m.start()]))
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1] and m[1].lower() in BLOCKS:
                flush()
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag == "br":
            parts.append((zone, " "))
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if any(t in CONTAINERS for t, _ in stack[depth + 1 :]) and tag not in CONTAINERS and tag not in FURNITURE:
                        break
                    leave(depth)
                    break
            continue
        if tag in BLOCKS and tag != "hr" and any(t == "p" for t, _ in stack):
            depth = max(i for i, (t, _) in enumerate(stack) if t == "p")
            if not any(t in CONTAINERS for t, _ in stack[depth + 1 :]):
                leave(depth)
        if tag in ENDS:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ENDS[tag]:
                    leave(depth)
                    break
                if stack[depth][0] in CONTAINERS - {"td"}:
                    break
        if tag in VOID:
            continue
        zone = _zone(tag, attributes, zone)
        if tag in HEADINGS:
            heading = (int(tag[1]), len(stack))
        stack.append((tag, zone))
    parts.append((zone, page[at:]))
    flush()
    return out
