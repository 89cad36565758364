"""Pages as trees of block elements and runs of inline text, and the features of their nodes."""

from __future__ import annotations

import html
import re

import numpy as np

# Fixed values of the HTML standard: elements by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Their text is never a page's text.
SILENT = frozenset("script style title textarea xmp iframe noembed noframes noscript template select button object svg math canvas audio video datalist".split())
#: A paragraph that is open ends where one of these begins.
ENDS_P = BLOCKS - frozenset("body caption html legend tbody td tfoot th thead tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What begins an item ends an open one of these, up to the list or table that holds both.
ITEMS = {
    "li": ("li", "ul ol menu dir"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th caption", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th caption", "table"),
    "thead": ("tbody thead tfoot tr td th caption", "table"),
    "tfoot": ("tbody thead tfoot tr td th caption", "table"),
}
ITEMS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ITEMS.items()}
#: End tags of other elements don't reach beyond these.
BARRIERS = frozenset("td th caption table html".split())

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", re.I)
_PART = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")
_MARKS = re.compile(r"[.,;:!?…。、]")
_END = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in SILENT}

#: Words in class, id, role, itemprop and aria-label, by what they say of an element; longer ones count as beginnings and endings too.
GROUPS = {
    "content": "article articlebody body content copy entry main post prose story text",
    "title": "headline title heading",
    "menu": "menu nav navbar navigation tabs toolbar breadcrumb breadcrumbs pagination pager skip",
    "header": "header masthead topbar banner branding logo site",
    "footer": "footer colophon copyright bottom legal imprint contentinfo",
    "side": "aside sidebar rail widget related recommended recommendations more teaser promo trending popular complementary",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall message warning toast",
    "ad": "ad ads adv advert advertisement advertising sponsor sponsored banner outbrain taboola dfp",
    "form": "form search login register input feedback contact survey",
    "comment": "comment comments commentlist disqus reply replies respond response responses discussion thread reviews",
    "share": "share sharing social follow facebook twitter like",
    "meta": "meta byline author date time tags tag category categories info",
}
TAGS = {
    "article": "article", "main": "main", "section": "section", "div": "div center", "p": "p", "head": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu dir",
    "item": "li dt dd", "table": "table thead tbody tfoot tr caption", "cell": "td th", "quote": "blockquote pre", "figure": "figure figcaption", "nav": "nav",
    "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset legend search", "dialog": "dialog details summary", "address": "address",
}
_GROUP_BIT = {name: 1 << i for i, name in enumerate(GROUPS)}
_WORD_BIT: dict[str, int] = {}
for _name, _words in GROUPS.items():
    for _word in _words.split():
        _WORD_BIT[_word] = _WORD_BIT.get(_word, 0) | _GROUP_BIT[_name]
_LONG = [(x, b) for x, b in _WORD_BIT.items() if len(x) > 4]
_TAG_BIT = {tag: 1 << (len(GROUPS) + i) for i, tags in enumerate(TAGS.values()) for tag in tags.split()}
BITS = len(GROUPS) + len(TAGS)
#: Classes that mark the truth in pages made for training; they are no features.
MAIN, OFF = "tw-main", "tw-off"
CACHE = 50_000
_attributes: dict[str, tuple[int, int]] = {}


def _said(attributes: str) -> tuple[int, int]:
    """Bits of what the attributes say; whether they mark the truth (1: main, -1: not)."""
    known = _attributes.get(attributes)
    if known is None:
        bits = truth = 0
        for _, value in _ATTRIBUTE.findall(attributes):
            truth = 1 if MAIN in value else -1 if OFF in value else truth
            for word in _PART.findall(value.replace(MAIN, "").replace(OFF, "")):
                word = word.lower()
                bits |= _WORD_BIT.get(word, 0)
                for x, b in _LONG:
                    if word.startswith(x) or word.endswith(x):
                        bits |= b
        if len(_attributes) > CACHE:
            _attributes.clear()
        known = _attributes[attributes] = bits, truth
    return known


class Tree:
    """Nodes of pages in document order: elements, and runs (the inline text between two block boundaries).

    ``text`` is a run's text with references decoded and white space as one blank, None
    for elements; ``end`` is the place after a node's last descendant; ``own`` and
    ``above`` are bits of what tag and attributes say of a node and of its ancestors.
    """

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.end: list[int] = []
        self.own: list[int] = []
        self.above: list[int] = []
        self.depth: list[int] = []
        self.text: list[str | None] = []
        self.linked: list[int] = []
        self.truth: list[int] = []
        self.pages: list[int] = []

    def _node(self, parent: int, own: int, text: str | None, linked: int, truth: int) -> int:
        i = len(self.parent)
        self.parent.append(parent)
        self.end.append(i + 1)
        self.own.append(own)
        self.above.append(self.above[parent] | self.own[parent] if parent >= 0 else 0)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.text.append(text)
        self.linked.append(linked)
        self.truth.append(truth or (self.truth[parent] if parent >= 0 else 0))
        return i

    def add(self, page: str) -> None:
        """Parse a page; its nodes begin at a root of no tag."""
        root = self._node(-1, 0, None, 0, 0)
        self.pages.append(root)
        stack, names = [root], [""]
        open_: dict[str, int] = {}
        held: list[str] = []
        linked, link = 0, 0  # characters in links of the run; height of the stack at the open link, or 0

        def flush() -> None:
            nonlocal linked
            if held:
                text = " ".join("".join(held).split())
                if text:
                    self._node(stack[-1], 0, text, min(linked, len(text)), 0)
                held.clear()
                linked = 0

        def close(height: int) -> None:
            nonlocal link
            flush()
            while len(stack) > height:
                self.end[stack.pop()] = len(self.parent)
                open_[names.pop()] -= 1
            if link > height:
                link = 0

        def find(wanted: frozenset | tuple, stop: frozenset) -> int:
            for i in range(len(names) - 1, 0, -1):
                if names[i] in wanted:
                    return i
                if names[i] in stop:
                    return 0
            return 0

        def said(text: str) -> None:
            nonlocal linked
            if "&" in text:
                text = html.unescape(text)
            held.append(text)
            if link:
                linked += len(text)

        at, search = 0, _TOKEN.search
        while True:
            m = search(page, at)
            if m is None:
                break
            start = m.start()
            if start > at:
                said(page[at:start])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name == "a":
                    link = 0
                elif name in BLOCKS and open_.get(name) and (i := find((name,), BARRIERS - {name} if name not in ("table", "html", "body") else frozenset())):
                    close(i)
                continue
            if name in SILENT:
                if not m[3].endswith("/") or name not in ("svg", "math"):
                    end = _END[name].search(page, at)
                    at = end.start() if end else len(page)
                continue
            if name == "br" or name == "wbr":
                held.append(" " if name == "br" else "")
                continue
            if name == "a":
                link = len(stack)
                continue
            if name not in BLOCKS:
                if name == "head" or name in VOID:
                    continue
                continue
            if name in ("html", "body") and open_.get(name):
                continue
            if name in ENDS_P and open_.get("p") and (i := find(("p",), BARRIERS)):
                close(i)
            if name in ITEMS:
                inner, outer = ITEMS[name]
                while (i := find(inner, outer)) > 0:
                    close(i)
            if name[0] == "h" and name[1:].isdigit() and names[-1][:1] == "h" and names[-1][1:].isdigit():
                close(len(stack) - 1)
            flush()
            if name == "hr":
                continue
            bits, truth = _said(m[3]) if m[3] else (0, 0)
            stack.append(self._node(stack[-1], bits | _TAG_BIT.get(name, 0), None, 0, truth))
            names.append(name)
            open_[name] = open_.get(name, 0) + 1
        if at < len(page):
            said(page[at:])
        close(1)
        self.end[root] = len(self.parent)


#: Numeric features in order; what tag and attributes say of a node and of its ancestors follows, a feature a bit.
NUMBERS = (
    "run depth chars words link_density char_share chars_per_node mark_density paragraphs headings items runs place siblings before after "
    "parent_chars parent_links parent_share prev_chars prev_links prev_marks next_chars next_links next_marks page_chars page_nodes sibling_mean".split()
)


def features(tree: Tree) -> np.ndarray:
    """A row a node: its size, density, place and siblings, and what is said of it and above it."""
    n = len(tree.parent)
    parent, end, own, above = np.array(tree.parent), np.array(tree.end), np.array(tree.own, np.int64), np.array(tree.above, np.int64)
    run = np.array([x is not None for x in tree.text])
    roots = np.array(tree.pages)
    page = np.repeat(np.arange(len(roots)), np.diff(np.append(roots, n)))
    at = np.arange(n)

    def below(values: np.ndarray) -> np.ndarray:
        """Sum over each node's subtree."""
        total = np.concatenate([[0], np.cumsum(values)])
        return (total[end] - total[at]).astype(np.float64)

    own_chars = np.array([len(x) if x else 0 for x in tree.text])
    own_words = np.array([x.count(" ") + 1 if x else 0 for x in tree.text])
    own_marks = np.array([len(_MARKS.findall(x)) if x else 0 for x in tree.text])
    chars, words, marks, links = below(own_chars), below(own_words), below(own_marks), below(np.array(tree.linked))

    def tagged(tag: str) -> np.ndarray:
        return below((own & _TAG_BIT[tag] != 0) & ~run)

    sent = np.concatenate([[0], np.cumsum(own_chars)])[:-1]
    whole = np.maximum(chars[roots][page], 1)
    up = np.maximum(parent, 0)
    density, mark = links / np.maximum(chars, 1), marks / np.maximum(words, 1)
    order = np.lexsort((at, parent, page))
    same = np.concatenate([[False], (parent[order][1:] == parent[order][:-1]) & (parent[order][1:] >= 0)])
    before, after = np.full(n, -1), np.full(n, -1)
    before[order[1:]] = np.where(same[1:], order[:-1], -1)
    after[order[:-1]] = np.where(same[1:], order[1:], -1)
    begin = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    place = np.empty(n)
    place[order] = np.arange(n) - begin
    siblings = np.bincount(up, minlength=n)[up]
    together = np.bincount(up, chars, n)[up]

    def beside(who: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.where(who >= 0, values[who], -1.0)

    log = np.log1p
    numbers = [
        run, np.array(tree.depth), log(chars), log(words), density, chars / whole, log(chars / (end - at)), mark, log(tagged("p")), log(tagged("h1")), log(tagged("li")), log(below(run)),
        place / np.maximum(siblings - 1, 1), log(siblings), (sent - sent[roots][page]) / whole, (sent - sent[roots][page] + chars) / whole,
        log(chars[up]), density[up], chars / np.maximum(chars[up], 1), beside(before, log(chars)), beside(before, density), beside(before, mark),
        beside(after, log(chars)), beside(after, density), beside(after, mark), log(whole), log(np.diff(np.append(roots, n))[page]), log(together / siblings),
    ]
    bits = 1 << np.arange(BITS, dtype=np.int64)
    return np.column_stack([np.column_stack(numbers).astype(np.float32), (own[:, None] & bits != 0).astype(np.float32), (above[:, None] & bits != 0).astype(np.float32)])
