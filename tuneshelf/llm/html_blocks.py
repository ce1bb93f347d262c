"""Tolerant HTML reading: text blocks with the branch of elements that holds them."""

from __future__ import annotations

import hashlib
import html as _html
import re
from typing import NamedTuple

#: Elements that begin and end a block of text.
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody
td tfoot th thead tr ul""".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is not shown as running text.
UNSEEN = frozenset("""head script style noscript template button select textarea title iframe object svg canvas
audio video map dialog datalist math xmp noembed noframes""".split())
#: Elements that hold no main text, whatever is inside; a form marks like a class word, as it may hold the whole page.
ASIDE = frozenset("nav footer aside menu".split())
#: Words in a class, id or role that mark menus, notices, adverts, comments and the like.
MARKS = frozenset("""ad ads advert adverts advertisement advertising adbox adsense banner banners breadcrumb breadcrumbs comment comments
complementary consent contentinfo cookie cookies copyright discussion disqus footer form hidden login masthead menu menubar modal nav
navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted promotion recommended related
replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget
widgets""".split())
#: First parts of class and id names that mark readers' comments, and endings that only say whether there are any.
TALK = ("comment", "disqus", "discussion", "replies", "reply")
TALK_STATE = ("open", "opened", "closed", "enabled", "disabled", "on", "off", "count", "link", "links", "status", "allowed")
#: Elements of running text: inside an article a word on them says nothing.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote figure figcaption pre table td th tr dl dt dd hgroup em strong b i code q".split())
MAIN = frozenset("article main".split())
#: A start tag that closes an open element of the same group, up to the element in the second place.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
          "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
          "option": (("option",), ("select", "datalist")), "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",))}
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:_-]*)")
_ATTR = re.compile(r"""\b(class|id|role|style|aria-hidden|itemprop|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}
_NO_MARKUP = re.compile(r"[0-9]+")
CACHE = 50_000
DEPTH = 512  # open elements; deeper ones count as part of the deepest, as in browsers (no text is lost)
BRANCH = 64  # outermost block elements that a block's branch names


class Block(NamedTuple):
    text: str
    branch: tuple[int, ...]  # hashed paths of the elements around it, outermost first
    unseen: bool
    main: bool
    mark: int = 0  # hashed path of the outermost element that marks it as boilerplate
    firm: bool = False  # marked by an element's kind, not by words


class _Open(NamedTuple):
    tag: str
    path: int
    unseen: bool
    main: bool
    mark: int
    firm: bool
    talk: bool
    children: list  # the last child's label and a hash of the sequence of labels


_looks: dict[tuple[str, str], tuple[str, bool, bool, bool, bool, bool]] = {}
_paths: dict[tuple[int, str], int] = {}


def _is_talk(name: str) -> bool:
    parts = [t.lower() for t in _TOKEN.findall(name)]
    return bool(parts) and parts[0] in (*TALK, "comments") and parts[-1] not in TALK_STATE


def _look(tag: str, attrs: str) -> tuple[str, bool, bool, bool, bool, bool]:
    """Label of an element (tag, classes and id without numbers), and whether it is unseen,
    whether words mark it as boilerplate, whether whole names do, whether it is a main part,
    and whether it holds readers' comments."""
    if tag == "a" or not attrs or attrs.isspace():
        return tag, tag in UNSEEN, tag == "form", tag == "form", tag in MAIN, False
    known = _looks.get((tag, attrs))
    if known:
        return known
    label, unseen, marked, main = [tag], tag in UNSEEN, tag == "form", tag in MAIN
    whole, talk = marked, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            label += [("." if name == "class" else "#") + x for x in sorted(_NO_MARKUP.sub("0", value).split())]
        if name in ("class", "id", "role") and tag not in ("body", "html"):
            marked |= any(t.lower() in MARKS for t in _TOKEN.findall(value))
            whole |= any(t.lower() in MARKS for t in value.split())
            talk |= any(_is_talk(t) for t in value.split())
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            unseen = True
        main |= (name == "role" and value.lower() == "main") or (name == "itemprop" and value == "articleBody")
    if len(_looks) >= CACHE:
        _looks.clear()
    _looks[tag, attrs] = out = ("".join(label), unseen, marked, whole, main, talk)
    return out


def _path(parent: int, label: str) -> int:
    out = _paths.get((parent, label))
    if out is None:
        if len(_paths) >= CACHE:
            _paths.clear()
        digest = hashlib.blake2b(f"{parent}/{label}".encode(), digest_size=8).digest()
        _paths[parent, label] = out = int.from_bytes(digest, "little", signed=True)
    return out


def _tag_end(page: str, at: int) -> int:
    """End of an unusual tag at ``at`` (quotes may hold angle brackets); -1 if it has none."""
    close = page.find(">", at)
    if close < 0:
        return -1
    piece = page[at:close]
    for quote in "\"'":
        if piece.count(quote) % 2:
            other = page.find(quote, close)
            if 0 <= other < at + 10_000:  # a quote that is never closed ends with its tag
                again = page.find(">", other)
                return again + 1 if again >= 0 else close + 1
    return close + 1


def read(page: str | None, styles: list | None = None) -> list[Block]:
    """The text blocks of a page in order, white space folded, references decoded.
    ``styles`` receives (path, hash of its sequence of child labels) of each element that ends;
    0 for one without elements."""
    out: list[Block] = []
    if not page:
        return out
    stack: list[_Open] = [_Open("", 0, False, False, 0, False, False, ["", 0])]
    words: list[str] = []

    def flush():
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                top = stack[-1]
                # the block belongs to the nearest block element; inline ones do not split branches
                branch = [e.path for e in stack[1:] if e.tag in BLOCK][:BRANCH]
                out.append(Block(text, tuple(branch), top.unseen, top.main, top.mark, top.firm))

    def pop_to(depth: int):
        while len(stack) > depth:
            if styles is not None and stack[-1].tag in BLOCK:
                styles.append((stack[-1].path, stack[-1].children[1]))
            stack.pop()

    def add(text: str):
        words.append(_html.unescape(text) if "&" in text else text)

    pos, n = 0, len(page)
    while pos < n:
        at = page.find("<", pos)
        if at < 0:
            add(page[pos:])
            break
        if at > pos:
            add(page[pos:at])
        m = _TAG.match(page, at)
        if m is None:
            nxt = page[at + 1: at + 2]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                pos = end + 3 if end >= 0 else n
            elif nxt and nxt in "!?":
                end = page.find(">", at)
                pos = end + 1 if end >= 0 else n
            elif nxt and (nxt.isalpha() or nxt == "/") and (name := _NAME.match(page, at + 1)):
                end = _tag_end(page, at)
                if end < 0:  # a tag that never ends: the rest is no text
                    break
                m, pos = name, end
                closing, tag, attrs = nxt == "/", name[1].lower(), page[name.end(): end - 1]
            else:
                words.append("<")
                pos = at + 1
            if m is None:
                continue
        else:
            closing, tag, attrs, pos = m[1] == "/", m[2].lower(), m[3], m.end()
        if tag == "br":
            words.append(" ")
            continue
        block = tag in BLOCK
        if block:
            flush()
        if closing:
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == tag:
                    if not block and any(e.tag in BLOCK for e in stack[d + 1:]):
                        break  # an inline end does not close blocks
                    if stack[d].unseen != stack[d - 1].unseen or stack[d].mark != stack[d - 1].mark:
                        flush()
                    pop_to(d)
                    break
            continue
        if block and tag not in ("html", "body", "head"):
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag == "p":
                    pop_to(d)
                    break
                if stack[d].tag in BLOCK:
                    break
        if tag in CLOSES:
            same, bound = CLOSES[tag]
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag in bound:
                    break
                if stack[d].tag in same:
                    pop_to(d)
                    break
        if tag == "body" and stack[-1].tag == "head":
            pop_to(len(stack) - 1)
        label, unseen, marked, whole, main, talk = _look(tag, attrs)
        top = stack[-1]
        if top.main:  # inside an article only whole names tell, and not on running text
            marked = (whole and tag not in RUNNING) or (talk and tag not in RUNNING)
        # a site's header; an article's own header holds its title
        firm = tag in ASIDE or (tag == "header" and not top.main)
        mark = top.mark
        # readers' comments: no article among them is the page's, nor is one inside the page's article
        talk = top.talk or (talk and (top.main or not main) and tag not in RUNNING)
        if main and not top.firm and not talk:
            marked, mark = False, 0  # no word overrides an article or main part, be it on it or around it
        elif (firm or marked or talk) and not mark:
            mark = _path(top.path, label)
        if (unseen and not top.unseen) or mark != top.mark:
            flush()
        if block and top.children[0] != label:  # runs of equal children count once
            top.children[:] = label, _path(top.children[1], label)
        if tag in VOID or attrs.endswith("/"):
            if tag == "hr":
                words.append(" ")
            continue
        if tag in RAW:
            end = _END[tag].search(page, pos)
            pos = end.end() if end else n
            continue
        if len(stack) >= DEPTH:
            continue
        path = _path(top.path, label) if block else top.path
        stack.append(_Open(tag, path, top.unseen or unseen, top.main or (main and not talk), mark, top.firm or firm, talk, ["", 0] if block else top.children))
    flush()
    pop_to(1)
    return out
