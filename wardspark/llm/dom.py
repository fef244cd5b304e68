"""A small HTML reader: block elements and blocks of text, with features, as parallel lists."""

from __future__ import annotations

import html
import re

#: Fixed values of HTML: elements without content, with raw text, and inline ones; lists of choices; what ends an open svg or math.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i img input ins kbd label mark q ruby rt rp s samp "
    "small span strike strong sub sup time tt u var wbr br noscript iframe object svg math".split()
)
FOREIGN = frozenset(("svg", "math"))
CHOICES = frozenset("select datalist optgroup option".split())
HTML_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr li main menu nav ol p pre section select datalist table tbody td tfoot th thead tr ul".split()
)
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("optgroup", "option")}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select", "datalist", "optgroup"), "optgroup": ("select", "datalist")}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+)|<",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PART = re.compile(r"[A-Za-z]+")
SPACE = re.compile(r"\s+")
#: An attribute value without quotes takes a slash at its end; it then does not close the element.
VALUE_SLASH = re.compile(r"=\s*[^\s\"'>]*/\Z")


def closes_itself(attributes: str) -> bool:
    return attributes.endswith("/") and not VALUE_SLASH.search(attributes)


class Page:
    """Nodes of a page in document order: parent (-1 for the root), feature names, and text or None."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.features: list[list[str]] = [["root"]]
        self.text: list[str | None] = [None]
        self.tags: list[str] = ["#root"]
        self._names: list[list[str]] = [[]]
        self._open: list[tuple[str, int]] = [("#root", 0)]  # tag and its node; inline elements have their block's
        self._parts: list[str] = []
        self._linked = 0
        self._links = 0
        self._foreign = 0
        self._read(source)
        self._end_block()

    def _read(self, source: str) -> None:
        at = 0
        while True:
            m = TOKEN.search(source, at)
            if not m:
                return
            at = m.end()
            tag = m[2]
            if m[4] is not None:
                self._add(m[4])
            elif tag is None:
                if m[0] == "<":
                    self._add("<")
            elif m[1]:
                self._close(tag.lower())
            else:
                tag = tag.lower()
                if tag in RAW:
                    # HTML ignores the slash of these; only inside an image or formula it ends them
                    if not (self._foreign and closes_itself(m[3])):
                        end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                        at = end.end() if end else len(source)
                    continue
                self._start(tag, m[3])

    def _add(self, text: str) -> None:
        text = html.unescape(text) if "&" in text else text
        self._parts.append(text)
        if self._links:
            self._linked += len(text)

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._parts.append(" ")
            return
        if tag in VOID and tag in INLINE:
            return
        if closes_itself(attributes) and (tag in CHOICES or tag in ("noscript", "iframe", "object", "svg", "math", "template", "xmp")):
            return
        if self._foreign and tag not in INLINE:
            if tag not in HTML_BLOCKS:
                return  # only the text of an image or formula counts
            self._cut(next(i for i, (name, _) in enumerate(self._open) if name in FOREIGN))
        node = self._open[-1][1]
        if tag in INLINE:
            if tag == "a":
                self._links += 1
            self._foreign += tag in FOREIGN
            self._open.append((tag, node))
            return
        self._end_block()
        if tag in VOID:
            return
        if tag not in CHOICES:
            self._close_open(("p",), ("#root",) if tag != "p" else ("#root",), blocks=True)
        if tag not in ("option", "optgroup"):
            self._end_choices()
        if tag in SELF_CLOSING:
            self._close_open(SELF_CLOSING[tag], BARRIER.get(tag, ()), blocks=False)
        names = [w.lower() for a in ATTRIBUTE.finditer(attributes) for w in (a[1], *NAME_PART.findall(a[2] or a[3] or a[4] or ""))] if attributes else []
        names = [n for n in names if n not in ("class", "id", "role", "style", "itemprop")]
        parent = self._open[-1][1]
        self._node(parent, tag, names, None)
        self._open.append((tag, len(self.parent) - 1))

    def _close_open(self, tags: tuple[str, ...], barriers: tuple[str, ...], blocks: bool) -> None:
        """End an open element of one of ``tags``, if nothing in ``barriers`` (or, for ``blocks``, no other block) is between."""
        for i in range(len(self._open) - 1, 0, -1):
            tag = self._open[i][0]
            if tag in tags:
                self._cut(i)
                return
            if tag in barriers or (blocks and tag not in INLINE):
                return

    def _end_choices(self) -> None:
        """End open lists of choices, which hold nothing but choices."""
        first = None
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] in CHOICES:
                first = i
            elif self._open[i][0] not in INLINE:
                break
        if first is not None:
            self._cut(first)

    def _cut(self, i: int) -> None:
        self._links -= sum(tag == "a" for tag, _ in self._open[i:])
        self._foreign -= sum(tag in FOREIGN for tag, _ in self._open[i:])
        del self._open[i:]

    def _close(self, tag: str) -> None:
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] == tag:
                if tag not in INLINE:
                    self._end_block()
                self._cut(i)
                return
            if tag in INLINE and self._open[i][0] not in INLINE:
                return

    def _end_block(self) -> None:
        if not self._parts:
            return
        text = SPACE.sub(" ", "".join(self._parts)).strip()
        linked, self._parts, self._linked = self._linked, [], 0
        if text:
            self._leaf(text, linked)

    def _node(self, parent: int, tag: str, names: list[str], text: str | None) -> None:
        features = [f"t:{tag}", f"pt:{self.tags[parent]}>{tag}", *(f"c:{n}" for n in names), *(f"tc:{tag}.{n}" for n in names)]
        features.append("named" if names else "plain")
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        self.tags.append(tag)
        self._names.append(names)

    def _leaf(self, text: str, linked: int) -> None:
        parent = self._open[-1][1]
        tag = self.tags[parent]
        words = text.count(" ") + 1
        size = min(6, words.bit_length())
        share = min(3, int(3.99 * linked / max(1, len(text))))
        marks = text.count(".") + text.count(",")
        features = [f"x:{tag}", f"n:{size}", f"l:{share}", f"xn:{tag}:{size}", f"m:{min(4, marks)}", f"ln:{share}:{size}"]
        features += [f"xc:{n}" for n in self._names[parent]]
        if "©" in text or "copyright" in text.lower():
            features.append("copyright")
        self.parent.append(parent)
        self.features.append(features)
        self.text.append(text)
        self.tags.append("#text")
        self._names.append([])
