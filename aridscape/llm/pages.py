"""Main text of HTML pages by tag-path ratios.

Text is added up by tag path (block tags with their first class, and links). A path
whose text comes in long, punctuated pieces gets a high ratio; ratios of text length
and of punctuation are each smoothed over the paths in page order, fused by their
product and compared with their spread. The lowest element that holds all of the text on
paths above the threshold is the article. All of its text is taken, also on other paths,
and so is what leads up to it from a heading on, save parts that are boilerplate by
their tag, role or class and paths that are mere link lists.

Defined results: null or empty html gives an empty text; unclosed and crossed tags
are repaired as browsers do for paragraphs and list items; a page without a path
above the threshold keeps all text that is not boilerplate; a null ``page_id`` or
``url`` is carried along; repeated rows are read one by one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|[\"'][^>]*(?:>|\Z)|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is read as plain text up to their own end tag.
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img rb rp rt ruby".split()
)
_BOILERPLATE = frozenset(
    "head script style noscript template title nav footer aside form fieldset button select option textarea input menu dialog iframe object embed svg canvas audio video map".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status note".split())
_WORDS = frozenset(
    """nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer masthead banner ad ads advert adverts advertising advertisement adsense sponsor
    sponsored sponsors promo promos promotion promoted popup modal overlay cookie cookies consent gdpr notice notices notification notifications alert alerts newsletter
    subscribe subscription signup signin login share shares sharing social related recommended recommendation recommendations trending comment comments commentlist
    disqus respond reply replies discussion pagination pager toolbar widget widgets copyright legal disclaimer skip search form teaser teasers outbrain taboola""".split()
)
_LAYOUT = frozenset("with has no without open close closed enable enabled disable disabled".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An open element of the values' kinds ends where one of the keys begins, up to the bound.
_CLOSES = {
    **{t: frozenset(["p"]) for t in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()},
    "li": frozenset(["p", "li"]),
    "dt": frozenset(["p", "dt", "dd"]),
    "dd": frozenset(["p", "dt", "dd"]),
    "tr": frozenset(["p", "tr", "td", "th"]),
    "td": frozenset(["p", "td", "th"]),
    "th": frozenset(["p", "td", "th"]),
    "option": frozenset(["option"]),
}
_BOUNDS = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"])}
_SCOPE = frozenset("html body div article section main aside nav header footer table td th blockquote form figure".split())


class _Element:
    __slots__ = ("tag", "parent", "path", "out", "article", "mass", "size")

    def __init__(self, tag: str, parent: _Element | None, path: str, out: bool, article: bool):
        self.tag, self.parent, self.path, self.out, self.article = tag, parent, path, out, article
        self.mass = self.size = 0


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTRIBUTE.finditer(text)}


def _boilerplate_name(value: str) -> bool:
    words = [w.lower() for w in _PART.findall(value)]
    return any(w in _WORDS and not (i and words[i - 1] in _LAYOUT) for i, w in enumerate(words))


def _open(tag: str, attributes: str, parent: _Element | None) -> _Element:
    out = bool(parent and parent.out) or tag in _BOILERPLATE
    article = bool(parent and parent.article) or tag in ("article", "main")
    if tag == "header" and not article:
        out = True
    name = tag
    if attributes and not attributes.isspace():
        found = _attributes(attributes)
        kind = found.get("class", "").split()
        if tag not in _INLINE and kind:
            name = f"{tag}.{kind[0]}"
        if tag not in ("html", "body", "article", "main"):
            out = out or _boilerplate_name(" ".join(kind)) or _boilerplate_name(found.get("id", ""))
        out = out or found.get("role", "").lower() in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        style = found.get("style", "").lower().replace(" ", "")
        out = out or "display:none" in style or "visibility:hidden" in style
    if parent is None:
        path = name
    elif tag in _INLINE and tag != "a":
        path = parent.path
    else:
        path = f"{parent.path}/{name}"
    return _Element(tag, parent, path, out, article)


def _pieces(page: str) -> tuple[list[tuple[_Element, int, str]], _Element]:
    """Text pieces with their element and block number, in page order."""
    root = _Element("#", None, "", False, False)
    here, block, at = root, 0, 0
    out: list[tuple[_Element, int, str]] = []

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            out.append((here, block, entities.unescape(raw) if "&" in raw else raw))
        elif raw:
            out.append((here, block, " "))

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                out.append((here, block, " "))
                continue
            seek = here
            while seek is not root and seek.tag != tag:
                if tag in _INLINE and seek.tag not in _INLINE:
                    seek = root
                    break
                seek = seek.parent
            if tag not in _INLINE:
                block += 1
            if seek is not root:
                here = seek.parent
            continue
        if tag == "br":
            out.append((here, block, " "))
            continue
        if tag not in _INLINE:
            block += 1
            closes = _CLOSES.get(tag)
            if closes:
                bound, seek, last = _BOUNDS.get(tag, _SCOPE), here, None
                while seek is not root and seek.tag not in bound:
                    if seek.tag in closes:
                        last = seek
                    seek = seek.parent
                if last is not None:
                    here = last.parent
        if tag in _VOID:
            continue
        child = _open(tag, m[3], here)
        if tag in _RAW:
            end = re.compile(f"</{tag}\\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if not m[3].endswith("/") or tag not in ("svg", "path", "use"):
            here = child
    return out, root


def main_text(page: str | None) -> str:
    """The article's blocks, one per line."""
    if not page:
        return ""
    pieces, root = _pieces(page)
    kept = [p for p in pieces if not p[0].out]
    paths: dict[str, list[float]] = {}
    blocks_seen: set = set()
    for element, block, text in kept:
        stats = paths.setdefault(element.path, [0.0, 0.0, 0.0])
        stats[0] += len(text.strip())
        stats[1] += len(_PUNCTUATION.findall(text))
        if (element.path, block) not in blocks_seen:
            blocks_seen.add((element.path, block))
            stats[2] += 1
    order = list(paths)
    length = _smoothed([paths[p][0] / paths[p][2] for p in order])
    stops = _smoothed([paths[p][1] / paths[p][2] for p in order])
    score = dict(zip(order, (a * (b + 0.1) for a, b in zip(length, stops))))
    threshold = _spread(list(score.values()))
    rich = {p for p in order if score[p] >= threshold}
    # the innermost element with all of the text on rich paths
    for element, _, text in kept:
        size = len(text.strip())
        mass = size if element.path in rich else 0
        while element is not None:
            element.size += size
            element.mass += mass
            element = element.parent
    total, top = root.mass, root
    while True:
        best = max((c for c in _children(kept, top)), key=lambda e: e.mass, default=None)
        if best is None or best.tag in _LEAVES or best.mass < total or best.mass == 0:
            break
        top = best
    lists = _link_lists(kept, paths, score, threshold)
    start, begin = _lead(pieces, top, lists)
    lines: list[str] = []
    last = None
    for at, (element, block, text) in enumerate(pieces):
        if element.out or element.path in lists or not (start <= at < begin or _inside(element, top)):
            continue
        if block != last:
            lines.append("")
            last = block
        lines[-1] += text
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


#: Elements that are a piece of an article, never the article.
_LEAVES = _INLINE | _HEADINGS | frozenset("p li td th tr dt dd pre blockquote ul ol dl table tbody thead tfoot figure figcaption".split())


def _lead(pieces, top: _Element, lists: set[str]) -> tuple[int, int]:
    """First piece of the earliest heading before ``top`` with neither boilerplate nor
    link lists between, and first piece of ``top``."""
    begin = next((at for at, p in enumerate(pieces) if not p[0].out and _inside(p[0], top)), 0)
    start = begin
    for at in range(begin - 1, -1, -1):
        element, _, text = pieces[at]
        if text.isspace():
            continue
        if element.out or element.path in lists:
            break
        while element.parent is not None and element.tag not in _HEADINGS:
            element = element.parent
        if element.tag in _HEADINGS:
            start = at
    return start, begin


def _inside(element: _Element | None, top: _Element) -> bool:
    while element is not None:
        if element is top:
            return True
        element = element.parent
    return False


def _children(kept, top: _Element):
    seen = set()
    for element, _, _ in kept:
        while element is not None and element.parent is not top:
            element = element.parent
        if element is not None and id(element) not in seen:
            seen.add(id(element))
            yield element


def _smoothed(values: list[float]) -> list[float]:
    out = []
    for i, v in enumerate(values):
        around = ([values[i - 1]] if i else []) + ([values[i + 1]] if i + 1 < len(values) else [])
        out.append((2 * v + sum(around)) / (2 + len(around)))
    return out


def _spread(values: list[float]) -> float:
    if len(values) < 2:
        return 0.0
    mean = sum(values) / len(values)
    return min((sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5, max(values))


def _link_lists(kept, paths, score, threshold) -> set[str]:
    """Link paths of several pieces below the threshold whose blocks hold little but the link."""
    whole: dict[int, list[int]] = {}
    for element, block, text in kept:
        mine = whole.setdefault(block, [0, 0])
        size = len(text.strip())
        mine[0] += size
        mine[1] += size if "/a" in element.path else 0
    bare: dict[str, list[int]] = {}
    for element, block, text in kept:
        if element.path.endswith("/a"):
            mine = bare.setdefault(element.path, [0, 0])
            mine[0] += 1
            mine[1] += whole[block][1] >= 0.8 * whole[block][0]
    return {p for p, (n, alone) in bare.items() if n >= 3 and alone >= 0.8 * n and paths[p][1] < n}


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
