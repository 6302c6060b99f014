"""Pages as sequences of leaf blocks: text between block-level tags, with its tag path."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

#: Elements that break a line (fixed values of the HTML standard); all others are inline.
BLOCK_TAGS = frozenset("""address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol option p pre
search section select summary table tbody td tfoot th thead title tr ul video audio canvas object""".split())
#: Elements without content or end tag (fixed values of the HTML standard).
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is plain characters up to the end tag, or to the page's end without one (HTML standard); not text of the page.
RAW_TAGS = frozenset("script style textarea iframe title".split())
#: Elements whose content is markup but not text of the page. Without an end tag they hold nothing.
HIDDEN_TAGS = frozenset("template noscript svg object select".split())
#: Start tags that end an open paragraph (fixed values of the HTML standard).
_ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5
h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt""".split())

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>?|[^<]++|<""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
_NAME = re.compile(r"[a-z]+")


def _path_words(tag: str, attributes: str) -> tuple[str, ...]:
    if not attributes or "=" not in attributes:
        return (tag,)
    found = [n for m in _NAMES.finditer(attributes) for n in _NAME.findall((m[1] or m[2] or m[3] or "").lower())]
    return (tag, *("." + n for n in found))


def _hidden_ends(html: str, at: int, tag: str) -> dict[int, int]:
    """Where each closed ``tag`` element from ``at`` on starts and ends. An end tag
    closes the last open start tag, so unclosed ones have no entry."""
    pattern = re.compile(rf"""<!--.*?(?:--!?>|\Z)|<(/?){tag}(?=[\s/>])(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)|([^>]*+))>""", re.I | re.S)
    ends: dict[int, int] = {}
    opened: list[int] = []
    for m in pattern.finditer(html, at):
        if m[1] is None:
            continue
        if m[1]:
            if opened:
                ends[opened.pop()] = m.end()
        elif not _empty_svg(tag, m[2] or m[3] or ""):
            opened.append(m.start())
    return ends


def _empty_svg(tag: str, attributes: str) -> bool:
    """Whether a hidden element is over with its start tag: only foreign elements have the self-closing form."""
    return tag == "svg" and attributes.endswith("/")


class Path:
    """An open element below its parent's path; blocks share paths, so a block costs no more the deeper it stands."""

    __slots__ = ("parent", "words", "size")

    def __init__(self, parent: "Path | None", words: tuple[str, ...]):
        self.parent, self.words, self.size = parent, words, (parent.size if parent else 0) + len(words)

    def all_words(self) -> tuple[str, ...]:
        parts, at = [], self
        while at is not None:
            parts.append(at.words)
            at = at.parent
        return tuple(w for words in reversed(parts) for w in words)


def inherited(paths: list[Path], start, step) -> list:
    """``step(value of the parent, own words)`` of every path, from ``start`` for the empty one; each path is visited once."""
    known: dict[int, object] = {}
    for path in paths:
        chain, at = [], path
        while at is not None and id(at) not in known:
            chain.append(at)
            at = at.parent
        value = start if at is None else known[id(at)]
        for at in reversed(chain):
            value = known[id(at)] = step(value, at.words)
    return [known[id(p)] for p in paths]


def blocks(html: str) -> list[tuple[tuple[str, ...], str]]:
    """``leaf_blocks`` with the paths written out as tuples of words."""
    return [(path.all_words(), text) for path, text in leaf_blocks(html)]


def leaf_blocks(html: str) -> list[tuple[Path, str]]:
    """(path, text) of every non-empty block in page order. A path word is an
    open element's tag or, after a dot, a word of its class, id or role.

    Character references are decoded and white space becomes single spaces.
    Unclosed, misnested and cut-off markup is read to its end; only the content of
    ``RAW_TAGS`` and of closed ``HIDDEN_TAGS`` is left out."""
    out: list[tuple[Path, str]] = []
    root = path = Path(None, ())
    stack: list[tuple[str, Path]] = []
    opened: Counter[str] = Counter()  # tags on the stack
    parts: list[str] = []
    hidden: dict[str, dict[int, int]] = {}
    at, size = 0, len(html)

    def close(k: int):
        for tag, _ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]

    def flush():
        nonlocal parts
        text = " ".join("".join(parts).split())
        if text:
            out.append((path, text))
        parts = []

    while at < size:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                if not parts:
                    path = stack[-1][1] if stack else root
                parts.append(unescape(m[0]))
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        if closing:
            if tag in BLOCK_TAGS:
                flush()
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in RAW_TAGS:
            if tag in BLOCK_TAGS:
                flush()
            end = re.compile(rf"</{re.escape(tag)}\s*+[^>]*+>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        if tag in HIDDEN_TAGS:
            if tag in BLOCK_TAGS:
                flush()
            if not _empty_svg(tag, m[3] or m[6] or ""):
                if tag not in hidden:
                    hidden[tag] = _hidden_ends(html, m.start(), tag)
                at = hidden[tag].get(m.start(), at)
            continue
        if tag in BLOCK_TAGS:
            flush()
        if tag in _ENDS_P:
            same = ("p", "li", "dd", "dt") if tag in ("li", "dd", "dt") else ("p",)
            for k in range(len(stack) - 1, -1, -1) if any(opened[t] for t in same) else ():
                if stack[k][0] in same:
                    close(k)
                    break
                if stack[k][0] in BLOCK_TAGS and stack[k][0] != "p":
                    break
        if tag not in VOID_TAGS and not (m[3] or m[6] or "").endswith("/"):
            stack.append((tag, Path(stack[-1][1] if stack else root, _path_words(tag, m[3] or m[6] or ""))))
            opened[tag] += 1
    flush()
    return out
