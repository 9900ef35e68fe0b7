"""Pages as sequences of leaf blocks: runs of text that no block element interrupts, each with the path of elements above it."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Elements of HTML by how they lie in the flow of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr picture q rp rt ruby s samp small source span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes noscript object svg template xmp".split())
TEXT_ONLY = frozenset("textarea title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: Elements that end an open one of their kind, and those that keep it from reaching farther.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "optgroup": ("select",)}

_TOKEN = re.compile(r"""[^<]+|<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|</?[A-Za-z][^>]*\Z|<""", re.S)
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])hidden(?![\w-])|display\s*:\s*none""", re.I)
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for x in (*RAW, *TEXT_ONLY)}


class Leaf(NamedTuple):
    path: tuple[str, ...]  # elements and the words of their classes, ids and roles, outermost first
    text: str
    linked: int  # characters that are links


def words_of(attributes: str) -> list[str]:
    """Words of classes, ids and roles, in lower case and without a plural s."""
    found = []
    for groups in _NAMED.findall(attributes):
        for name in _NAME.findall("".join(groups)):
            name = name.lower()
            found.append("." + (name[:-1] if len(name) > 3 and name[-1] == "s" and name[-2] != "s" else name))
    if _HIDDEN.search(attributes):
        found.append(".hidden")
    return found


def leaves(page: str) -> list[Leaf]:
    """Leaf blocks of a page in order; scripts, styles and comments have none, and nothing else is left out.

    Any text is a page: elements that aren't closed end where HTML ends them (a p at the next block, all others at the
    end of an element around them), ends without a beginning count for nothing, and an open comment or script lasts to the end.
    """
    found: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    path: tuple[str, ...] = ()
    linked, inside, at = 0, False, 0
    known: dict[tuple[str, str], tuple[str, ...]] = {}

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Leaf(path, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop(depth: int):
        nonlocal path
        del stack[depth:]
        path = stack[-1][1] if stack else ()

    def end(kinds: tuple[str, ...], within: tuple[str, ...]):
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in kinds:
                pop(k)
            elif stack[k][0] in within:
                return

    match = _TOKEN.match
    while token := match(page, at):
        at = token.end()
        name = token[2]
        if name is None:
            text = token[0]
            if text[0] != "<" or text == "<":
                text = html.unescape(text) if "&" in text else text
                parts.append(text)
                linked += len(text) * inside
            continue
        name, closing = name.lower(), token[1]
        if name in INLINE:
            if name == "a":
                inside = not closing
            elif name in ("br", "img"):
                parts.append(" ")
            continue
        flush()
        if closing:
            inside = False
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                pop(depth)
            continue
        if name in RAW:
            over = _END[name].search(page, at)
            at = over.end() if over else len(page)
            continue
        if name in CLOSES_P:
            end(("p",), ("button", "caption", "html", "marquee", "table", "td", "th"))
        if name in ENDS:
            end(ENDS[name], HOLDS[name])
        if name in VOID:
            continue
        key = (name, token[3])
        if key not in known:
            known[key] = (name, *words_of(token[3]))
        if name in TEXT_ONLY:
            over = _END[name].search(page, at)
            text, at = page[at : over.start() if over else len(page)], over.end() if over else len(page)
            text = " ".join(html.unescape(text).split())
            if text:
                found.append(Leaf((*path, *known[key]), text, 0))
            continue
        if len(stack) < 512:  # as browsers do, deeper elements are no further level
            path = (*path, *known[key])
            stack.append((name, path))
    flush()
    return found
