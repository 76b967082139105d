"""Leaf blocks of an HTML page: runs of text between block-level tags, with the
tags, classes and ids around them. Copes with unclosed, crossed and cut-off tags;
every tag is handled in constant time, however many elements are open."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
REPEATS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}

# comment | raw-text element | tag | declaration | tag cut off by the end
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*+>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)()[^>]*+>|<[!?][^>]*+>|<[a-zA-Z/!?][^>]*+\Z""",
    re.S | re.I)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


def named(attributes: str) -> set[str]:
    """Lower-case words of class, id and role."""
    return {w for m in _NAMED.finditer(attributes) for w in _PART.findall((m[1] or m[2] or m[3] or "").lower())}


class Block:
    __slots__ = ("text", "around", "tag", "linked")

    def __init__(self, text: str, around: tuple[str, ...], tag: str, linked: float):
        self.text, self.around, self.tag, self.linked = text, around, tag, linked


def blocks(page: str | None, known: frozenset | None = None) -> list[Block]:
    """Blocks in page order. ``around`` names the tags (``t:``) and the class, id
    and role words (``c:``) of all ancestors, as far as they are in ``known``."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack by tag
    solid = [-1]  # places of the elements that are not inline
    depth: Counter = Counter()  # how many open elements give a name
    text: list[str] = []
    linked = size = links = 0

    def flush():
        nonlocal linked, size
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                tag = stack[solid[-1]][0] if len(solid) > 1 else ""
                out.append(Block(words, tuple(sorted(n for n, k in depth.items() if k > 0)), tag, linked / max(size, 1)))
            text.clear()
        linked = size = 0

    def pop_to(at: int):
        nonlocal links
        while len(stack) > at:
            tag, names = stack.pop()
            opened[tag].pop()
            if tag not in INLINE:
                solid.pop()
            links -= tag == "a"
            for n in names:
                depth[n] -= 1
                if not depth[n]:
                    del depth[n]

    def closes(tag: str) -> int | None:
        """Place in the stack of the open element that a start tag ends."""
        if tag not in INLINE and len(solid) > 1 and stack[solid[-1]][0] == "p":
            return solid[-1]
        if tag in REPEATS and opened[tag]:
            at = opened[tag][-1]
            if all(not opened[t] or opened[t][-1] < at for t in REPEATS[tag]):
                return at
        return None

    at = 0
    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run = page[at:m.start()]
            text.append(run)
            size += len(run)
            linked += len(run) * (links > 0)
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[0].startswith("<!") or m[1]:
                text.append(" ")
            continue
        end = bool(m[2] or m[5])
        if tag in INLINE:
            if tag in VOID:
                text.append(" ")
                continue
        else:
            flush()
        if end:
            # an inline end tag does not close the blocks around it
            if opened[tag] and (tag not in INLINE or opened[tag][-1] > solid[-1]):
                pop_to(opened[tag][-1])
        elif tag not in VOID:
            k = closes(tag)
            if k is not None:
                pop_to(k)
            names = [f"t:{tag}"] if tag not in INLINE else []
            attributes = m[4] or ""
            if attributes and "=" in attributes:
                names += [f"c:{w}" for w in named(attributes)]
            if known is not None:
                names = [n for n in names if n in known]
            depth.update(names)
            opened[tag].append(len(stack))
            if tag not in INLINE:
                solid.append(len(stack))
            stack.append((tag, tuple(names)))
            links += tag == "a"
    if at < len(page):
        text.append(page[at:])
        size += len(page) - at
    flush()
    return out
