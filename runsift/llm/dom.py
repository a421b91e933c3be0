"""A tolerant HTML parser that keeps what text extraction needs: elements, their attribute words and text runs.

A page becomes parallel lists, parents before children.  Text runs are nodes of their own, with
the tag "#text": a run is all inline text between two block borders of one block element, its
character references decoded and its white space turned into single spaces.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; nothing of it is kept, up to the end tag or the end of the page.
RAW = frozenset("script style noscript iframe textarea title noframes xmp".split())
#: Elements whose content is parsed and dropped.
DROPPED = frozenset("template svg select object audio video canvas".split())
MATHML = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics annotation annotation-xml".split()
)
#: HTML elements inside which SVG holds text of its own.
SVG_TEXT = frozenset(["foreignobject", "desc", "title"])
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var button picture".split()
) | MATHML
CLOSES_P = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: tag -> (open elements of these names that it ends, the elements that shield them)
ENDS_OPEN = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
END_TAG = {tag: re.compile(rf"</{tag}(?:[\s/>]|\Z)", re.I | re.A) for tag in RAW | DROPPED}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Page:
    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    words: list[tuple[str, ...]] = field(default_factory=list)
    #: Of text runs: the text, and how many of its characters are in links; of elements '' and 0.
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, parent: int, tag: str, words=(), text="", linked=0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(words)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


def attribute_words(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = []
    for _, a, b, c in NAMES.findall(attributes):
        found += [w.lower() for w in WORD.findall(a or b or c)]
    return tuple(found)


def parse(source: str) -> Page:
    """Nodes of a page; node 0 is the root.  Any text gives a page; unclosed and stray tags are settled as browsers mostly do.

    A dropped element ends at its end tag or with an element around it; one without an end tag, and
    an svg outside its text elements, also at the next start of a block element.
    The time is in proportion to the page: open elements are found by name, not by looking down the stack.
    """
    page = Page()
    stack = [(page.add(-1, "html"), "html")]
    block, border = [0], [0]  # block elements that are open, and their depths
    depths: dict[str, list[int]] = {}  # tag -> depths of the open elements of that name, without the root
    run: list[str] = []
    hidden: list[str] = []  # the dropped element that the parser is in, and those open in it
    inside: Counter[str] = Counter()  # how often each tag is in hidden
    ends: dict[str, int] = {}  # tag -> place of its next end tag, as last looked up
    linked, in_link, at, closed = 0, 0, 0, True

    def close_run() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                page.add(block[-1], "#text", (), text, min(linked, len(text)))
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal in_link
        while len(stack) > depth:
            _, tag = stack.pop()
            depths[tag].pop()
            if tag not in INLINE:
                close_run()
                block.pop()
                border.pop()
            elif tag == "a":
                in_link = max(0, in_link - 1)

    def push(node: int, tag: str) -> None:
        depths.setdefault(tag, []).append(len(stack))
        stack.append((node, tag))

    def deepest(*tags: str) -> int:
        """Depth of the innermost open element of these names; 0 if there is none."""
        return max((d[-1] for d in map(depths.get, tags) if d), default=0)

    def leave(tag: str | None) -> None:
        """Ends the hidden element of this name and all in it; all that is hidden for None."""
        while hidden:
            last = hidden.pop()
            inside[last] -= 1
            if last == tag:
                break

    def take(text: str) -> None:
        nonlocal linked
        if text and not hidden:
            text = html.unescape(text) if "&" in text else text
            run.append(text)
            if in_link:
                linked += len(text.strip())

    def next_end(tag: str) -> int:
        """Place of the tag's next end tag; the length of the source if there is none."""
        if ends.get(tag, -1) < at:
            m = END_TAG[tag].search(source, at)
            ends[tag] = m.start() if m else len(source)
        return ends[tag]

    while True:
        m = TOKEN.search(source, at)
        if not m:
            take(source[at:])
            break
        take(source[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        alone = attributes.rstrip().endswith("/")
        if closing:
            if inside[tag]:
                leave(tag)
                continue
            depth = deepest(tag)
            if depth and (tag not in INLINE or depth > border[-1]):
                leave(None)
                pop_to(depth)
            continue
        if tag in RAW and not alone and not (inside["svg"] and next_end(tag) == len(source)):
            at = source.find(">", next_end(tag)) + 1 or len(source)
            continue
        if hidden:
            breaks = not closed or hidden[0] == "svg" and not any(inside[t] for t in SVG_TEXT)
            if not (breaks and tag in CLOSES_P):
                if not alone and tag not in VOID:
                    hidden.append(tag)
                    inside[tag] += 1
                continue
            leave(None)
        if tag in RAW:
            continue
        if tag in DROPPED:
            if not alone:
                hidden.append(tag)
                inside[tag] += 1
                closed = next_end(tag) < len(source)
            continue
        if tag in VOID:
            if tag == "br":
                run.append(" ")
            elif tag == "hr":
                close_run()
            continue
        if tag == "html" or tag in ("body", "head") and deepest(tag):
            continue
        if tag in CLOSES_P and stack[border[-1]][1] == "p":
            pop_to(border[-1])
        if tag in ENDS_OPEN:
            ended, shield = ENDS_OPEN[tag]
            depth = deepest(*ended)
            if depth > deepest(*shield):
                pop_to(depth)
        if tag in INLINE or tag not in CLOSES_P and tag not in ("body", "head", "html", "caption", "legend"):
            push(-1, tag if tag in INLINE else "span")
            in_link += tag == "a"
            continue
        if tag == "body" and stack[-1][1] == "head":
            pop_to(len(stack) - 1)
        close_run()
        node = page.add(block[-1], tag, attribute_words(attributes))
        border.append(len(stack))
        push(node, tag)
        block.append(node)
    pop_to(1)
    close_run()
    return page
