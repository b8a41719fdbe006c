"""A small tree of a page's blocks, and the features of its nodes.

Nodes are the elements that form blocks, and runs of text between block boundaries; all other elements, known or not, dissolve
into the runs, with the share of their characters that links hold. Tags may be unclosed, stray or unbalanced. The source is
read once from left to right; what a tag, quote, comment or script leaves open ends with the page, as in browsers.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_IN_TAG = re.compile(r"""[^>=]*+(?:>|=\s*+(["']?))""")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_TOKEN = re.compile(r"[^\W\d_A-Z]+|[A-Z][^\W\d_A-Z]*")

#: Elements whose content is no text at all, up to their end tag.
RAW = frozenset("script style title iframe noembed noframes template".split())
GROUPS = {
    "paragraph": "p blockquote pre figcaption dd dt",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "item": "li",
    "list": "ul ol dl menu",
    "table": "table tbody thead tfoot tr td th caption",
    "box": "div section center figure details summary hr",
    "article": "article",
    "main": "main",
    "nav": "nav",
    "header": "header",
    "footer": "footer address",
    "aside": "aside dialog",
    "form": "form fieldset button legend textarea select datalist optgroup option",
    "root": "html body head",
    "text": "#text",
}
_GROUP = {t: i for i, ts in enumerate(GROUPS.values()) for t in ts.split()}
#: Elements that an opening tag of the same group closes; any block closes a paragraph.
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, **dict.fromkeys(sorted(_HEADINGS - {"p"}), _HEADINGS)}
#: Blocks that an element within them can't close: all but those named above.
_SCOPES = frozenset(_GROUP) - frozenset(CLOSES)
#: Attribute tokens by what they tell of: the words that page authors use for each part of a page, in some languages. Longer
#: words count by these beginnings: comment, kommentar, navig, werb, publi, sponsor, footer, header, sidebar, newsletter.
TOKENS = {
    "menu": "nav navbar navigation navig menu breadcrumb breadcrumbs crumbs pager pagination toc tabs topbar skip sitemap",
    "edge": "header masthead footer colophon copyright legal bottom top logo branding kopfzeile entete cabecera",
    "side": "sidebar side aside widget rail secondary complementary related recommended popular trending tags meta author bio seitenleiste",
    "notice": "notice alert cookie cookies consent banner gdpr popup modal overlay warning message announcement toast hinweis aviso",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted dfp taboola outbrain werb anzeige publi reklame",
    "talk": "comment comments commentlist reply replies respond disqus discussion thread reader readers feedback reviews kommentar coment opiniones",
    "form": "form search login signup subscribe newsletter register contact share sharing social follow suche",
    "main": "article content contents post entry story body main text page maincontent articlebody prose hentry blog artikel inhalt contenido contenu",
}
_KIND = {t: i for i, ts in enumerate(TOKENS.values()) for t in ts.split()}
_BEGIN = {t: _KIND[t] for t in "comment kommentar coment navig werb publi sponsor footer header sidebar newsletter".split()}
FEATURES = (
    *(f"is_{g}" for g in GROUPS), *(f"own_{t}" for t in TOKENS), *(f"above_{t}" for t in TOKENS),
    "in_nav", "in_header", "in_footer", "in_aside", "in_form", "in_article", "in_list",
    "depth", "place", "siblings", "same_tag", "same_shape", "log_text", "log_own_page_share", "link_share", "words_a_block", "blocks", "tags_a_char", "stops",
    "sibling_text", "parent_text", "before", "after", "article_on_page", "paragraphs", "paragraph_siblings", "parent_paragraph_text", "is_box_text",
)
_ABOVE = {"nav": 0, "header": 1, "footer": 2, "address": 2, "aside": 3, "dialog": 3, **dict.fromkeys("form select datalist textarea button fieldset".split(), 4), "article": 5, "main": 5, "li": 6}


class Page:
    """Nodes in page order: tag, parent (-1 for the root), own attribute kinds and shape, and the text and linked characters of runs."""

    def __init__(self, source: str):
        self.tag, self.parent, self.kinds, self.shape, self.text, self.linked = ["#root"], [-1], [0], [0], [""], [0]
        stack, scopes, count = [0], [0], {}
        links, run, linked, at, n = 0, [], 0, 0, len(source)

        def flush() -> None:
            nonlocal run, linked
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self._add("#text", stack[-1], "", text, min(linked, len(text)))
                run, linked = [], 0

        def put(piece: str) -> None:
            nonlocal linked
            if piece:
                piece = html.unescape(piece)
                run.append(piece)
                if links:
                    linked += len(piece)

        def cut(k: int) -> None:
            for node in stack[k:]:
                count[self.tag[node]] -= 1
            del stack[k:]
            while scopes[-1] >= k:
                scopes.pop()

        while at < n:
            begin = source.find("<", at)
            if begin < 0:
                put(source[at:])
                break
            put(source[at:begin])
            next_ = source[begin + 1 : begin + 2]
            if next_ in ("!", "?"):
                end = source.find("-->", begin + 2) if source.startswith("<!--", begin) else source.find(">", begin)
                at = n if end < 0 else end + (3 if source.startswith("<!--", begin) else 1)
                continue
            closing = next_ == "/"
            m = _NAME.match(source, begin + 1 + closing)
            if m is None:
                if closing and begin + 2 < n:  # a stray end without a name
                    end = source.find(">", begin)
                    at = n if end < 0 else end + 1
                else:
                    put("<")
                    at = begin + 1
                continue
            name, own, at = m[0].lower(), m.end(), m.end()
            while True:  # to the end of the tag, past quoted values
                m = _IN_TAG.match(source, at)
                if m is None:
                    at = n + 1
                    break
                at = m.end()
                if m[1] is None:
                    break
                if m[1]:
                    at = source.find(m[1], at) + 1
                    if not at:
                        at = n + 1
                        break
            if at > n:
                break
            attributes = source[own : at - 1]
            if name in RAW:
                if not closing:
                    m = _END[name].search(source, at)
                    at = source.find(">", m.end()) + 1 if m else 0
                    if not at:
                        break
                continue
            if name not in _GROUP:
                if name == "br":
                    run.append(" ")
                elif name == "a":
                    links = 0 if closing else 1
                continue
            flush()
            links = 0
            if closing:
                if count.get(name):
                    k = len(stack) - 1
                    while self.tag[stack[k]] != name:
                        k -= 1
                    cut(k)
                continue
            if name in ("html", "body", "head") and count.get(name):
                continue
            if name == "body" and self.tag[stack[-1]] == "head":
                cut(len(stack) - 1)
            shut = CLOSES.get(name, ())
            for k in range(scopes[-1] + 1, len(stack)):
                if self.tag[stack[k]] in shut or self.tag[stack[k]] == "p":
                    cut(k)
                    break
            node = self._add(name, stack[-1], attributes, "", 0)
            if name != "hr":
                count[name] = count.get(name, 0) + 1
                if name in _SCOPES:
                    scopes.append(len(stack))
                stack.append(node)
        flush()

    def _add(self, tag: str, parent: int, attributes: str, text: str, linked: int) -> int:
        kinds, shape = self._attributes(attributes) if "=" in attributes else (0, 0)
        self.tag.append(tag)
        self.parent.append(parent)
        self.kinds.append(kinds)
        self.shape.append(shape)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    @staticmethod
    def _attributes(source: str) -> tuple[int, int]:
        """What the tokens of class, id and role tell of, and a number that equal values share."""
        bits, values = 0, []
        for m in _ATTRIBUTE.finditer(source):
            value = m[1] or m[2] or m[3] or ""
            values.append(value)
            for t in _TOKEN.findall(value):
                t = t.lower()
                k = _KIND.get(t)
                if k is None and len(t) > 4:
                    k = next((_BEGIN[t[:i]] for i in range(4, min(len(t), 10) + 1) if t[:i] in _BEGIN), None)
                if k is not None:
                    bits |= 1 << k
        return bits, zlib.crc32("\0".join(values).encode("utf-8", "replace"))

    def features(self) -> np.ndarray:
        """A row a node: one pass down the tree and one up, the rest over whole columns (nodes are in page order)."""
        n, parent = len(self.tag), np.maximum(np.array(self.parent), 0)
        depth, above, inside, end = [0] * n, [0] * n, [0] * n, list(range(1, n + 1))
        for i in range(1, n):
            p = self.parent[i]
            depth[i] = depth[p] + 1
            above[i] = above[p] | self.kinds[p]
            k = _ABOVE.get(self.tag[p])
            inside[i] = inside[p] if k is None else inside[p] | 1 << k
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if end[p] < end[i]:
                end[p] = end[i]
        end, own = np.array(end), np.arange(n)

        def below(values) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return (total[end] - total[own]).astype(float)

        group = np.array([_GROUP.get(t, -1) for t in self.tag])
        length = np.array([len(t) for t in self.text])
        chars, linked, blocks = below(length), below(self.linked), below(length > 0)
        words, stops = below([t.count(" ") + 1 if t else 0 for t in self.text]), below([sum(map(t.count, ".,;!?:")) if t else 0 for t in self.text])
        in_paragraph = (group == 0) | (group == 1)
        paragraph_text = below(np.where((length > 0) & in_paragraph[parent], length, 0))
        tags = below(np.ones(n))
        children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(1, int)
        order = np.argsort(parent[1:], kind="stable") + 1
        place = np.zeros(n)
        place[order] = np.arange(n - 1) - (np.cumsum(children) - children)[parent[order]]
        shape = np.array(self.shape, np.int64)

        def alike(values: np.ndarray) -> np.ndarray:
            _, which, many = np.unique(np.stack([parent, values], axis=1), axis=0, return_inverse=True, return_counts=True)
            return many[which.ravel()]

        codes = {t: i for i, t in enumerate(dict.fromkeys(self.tag))}
        code = np.array([codes[t] for t in self.tag], np.int64)
        before = np.concatenate([[0], np.cumsum(length)])[:-1]
        total, around = max(1.0, chars[0]), np.maximum(1, children[parent])
        paragraphs = np.bincount(parent[in_paragraph], minlength=n)
        bits = lambda values, k: np.array(values)[:, None] >> np.arange(k) & 1
        on_page = any(t in ("article", "main") for t in self.tag)
        rest = (
            depth, place / around, around, alike(code) / around, alike(code << 32 | shape) * (shape > 0), np.log1p(chars), np.log(chars / total + 1e-6), linked / np.maximum(1, chars), words / np.maximum(1, blocks), blocks, tags / (chars + 1), stops / np.maximum(1, words),
            (chars[parent] - chars) / np.maximum(1, around - 1), np.log1p(chars[parent]), before / total, 1 - (before + chars) / total, np.full(n, on_page), paragraphs, paragraphs[parent], np.log1p(paragraph_text[parent]), (length > 0) & ~in_paragraph[parent],
        )
        return np.column_stack([group[:, None] == np.arange(len(GROUPS)), bits(self.kinds, len(TOKENS)), bits(above, len(TOKENS)), bits(inside, 7), *rest]).astype(float)

    def decode(self, margins: np.ndarray) -> list[str]:
        """The texts of the runs that belong, if no node may belong whose parent doesn't.

        The best such choice by summed log-odds: from the leaves up, a subtree is worth its node's log-odds and what its
        worthwhile children add; from the root down, a child belongs if its parent does and it is worth something.
        """
        worth = margins.astype(float).tolist()
        for i in range(len(worth) - 1, 0, -1):
            if worth[i] > 0:
                worth[self.parent[i]] += worth[i]
        kept = [True] + [False] * (len(worth) - 1)
        for i in range(1, len(worth)):
            kept[i] = kept[self.parent[i]] and worth[i] > 0
        return [t for t, k in zip(self.text, kept, strict=True) if t and k]


_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in sorted(RAW)}
