"""Main-text extraction by tag-path ratios.

Each page is cut into text nodes with their root-to-leaf tag path (block-level tags with their
classes). For every path the text length, punctuation, link text and number of blocks are summed.
A path's length and punctuation for each block are its ratios; they are smoothed with those of the paths
next to it in page order, as far as these share ancestors, and fused with the share of link text
and what names and elements say. Paths whose score reaches HIGH of the best one are content. In
the element that holds them all, so are those whose weight (what link text and names leave of a
score) reaches LOW, however short they are, and beside it whole branches that read like it. Nodes are kept by their paths.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, claim

# Element names of HTML and common names of page furniture.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title", "textarea", "select", "button", "math", "audio", "video"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "option"}
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "main", "body", "div", "nav", "aside", "td", "form", "header", "footer", "blockquote"}
FURNITURE = {"nav", "aside", "footer", "form", "menu", "dialog"}
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu sidebar breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login comment comments disqus replies respond related recommended recommendations share sharing social widget pagination pager copyright skip".split()
)
NEUTRAL_WORDS = set("area article bar block blog body bottom box boxes button buttons center col column container content footer group header holder inner item items left link links list main outer page panel post posts right row section site story text thread top unit wrap wrapper".split())
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？：；]")
#: A comment, a tag (with whole quoted values, else up to the next >), or other markup.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*>|</[^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Weights of a path's own ratio and of each neighbour's.
OWN, NEXT = 0.5, 0.25
#: Factors of an article or main element, of a name that furniture has, and of link text only.
ELEMENT, NAMED, LINKED = 4.0, 0.02, 0.1
#: The share of the best score that makes a path content by itself, and the weight that does in the element that holds such paths.
HIGH, LOW = 0.5, 0.25
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"li", "dd", "dt", "td", "pre", "blockquote"}
#: Text beside the container is content from this share of its mean block length, or as a sentence of so many characters.
SHARE, SENTENCE = 0.25, 40

Path = tuple[str, ...]
#: Block, path, text, and whether it is link text.
Node = tuple[int, Path, str, bool]


def attributes(text: str) -> dict[str, str]:
    """Names and values in a start tag; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), "".join(values).lower())
    return out


def furniture_name(names: str) -> bool:
    """Whether a class or id is a name of furniture: a whole word, or joined with neutral words only."""
    for token in names.split():
        words = [w.rstrip("0123456789") for w in re.split(r"[-_]+", token)]
        if any(w in FURNITURE_WORDS for w in words) and all(w in FURNITURE_WORDS or w in NEUTRAL_WORDS or not w for w in words):
            return True
    return False


def _left_out(tag: str, own: dict[str, str], in_article: bool) -> bool:
    """Elements that are furniture by what they are, and what isn't shown."""
    if tag in SKIPPED or tag in FURNITURE or tag == "header" and not in_article:
        return True
    return tag not in ("html", "body") and (own.get("hidden") in ("", "hidden") or own.get("role") in FURNITURE_ROLES)


def text_nodes(page: str) -> list[Node]:
    """The text nodes outside furniture elements, in page order. A step named like furniture ends in "!"."""
    out: list[Node] = []
    stack: list[tuple[str, bool, str]] = []  # tag, whether it or what it is in is left out, path step
    block, at, n = 0, 0, len(page)
    dead, path, linked = False, (), False

    def settle() -> None:
        nonlocal dead, path, linked
        dead = stack[-1][1] if stack else False
        path = tuple(s[2] for s in stack if s[2])
        linked = any(s[0] == "a" for s in stack)

    while at < n:
        found = TOKEN.search(page, at)
        stop = found.start() if found else n
        if stop > at and not dead:
            out.append((block, path, page[at:stop], linked))
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            if not dead:
                out.append((block, path, " ", linked))
            continue
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    settle()
                    break
            block += tag in BLOCKS
            continue
        if tag in BLOCKS:
            block += 1
            # what this start tag ends by implication
            kinds = OWN_KIND.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in kinds:
                    del stack[k:]
                    settle()
                    break
                if stack[k][0] in SCOPES:
                    break
        if tag in VOID or found[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else n
            continue
        own = attributes(found[3]) if found[3] else {}
        out_now = dead or _left_out(tag, own, any(s[0] in ("article", "main") for s in stack))
        named = bool(own) and tag not in ("html", "body", "article", "main") and furniture_name(f"{own.get('class', '')} {own.get('id', '')}")
        step = ""
        if tag in BLOCKS or named:
            names = " ".join(sorted(own.get("class", "").split()))
            step = (f"{tag}.{names}" if names else tag) + "!" * named
        stack.append((tag, out_now, step))
        settle()
    return out


def _tag(step: str) -> str:
    return step.rstrip("!").split(".")[0]


def _shared(a: Path, b: Path) -> int:
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def path_scores(nodes: list[Node]) -> dict[Path, tuple[float, float]]:
    """The fused score of each path that has text, and its weight. In an article or main element links don't lessen the weight."""
    sums: dict[Path, list[int]] = {}  # characters, punctuation, link characters, blocks
    order: list[Path] = []
    last = None
    for block, path, text, linked in nodes:
        body = text.strip()
        if not body:
            continue
        own = sums.setdefault(path, [0, 0, 0, 0])
        own[0] += len(body)
        own[1] += len(PUNCTUATION.findall(body))
        own[2] += len(body) * linked
        if (block, path) != last:
            own[3] += 1
            order.append(path)
            last = (block, path)
    ratio = {p: (s[0] / s[3], s[1] / s[3]) for p, s in sums.items()}
    # neighbours in page order: pairs of paths and how often they meet
    meet: dict[tuple[Path, Path], int] = {}
    for p, q in zip(order, order[1:]):
        meet[p, q] = meet.get((p, q), 0) + 1
    near = {p: [0.0, 0.0] for p in sums}
    for (p, q), n in meet.items():
        like = _shared(p, q) / max(len(p), len(q), 1)
        for x, y in ((p, q), (q, p)):
            for i in (0, 1):
                near[x][i] += n * like * ratio[y][i]
    out = {}
    for p, (chars, _, links, blocks) in sums.items():
        length, marks = (OWN * ratio[p][i] + NEXT * near[p][i] / blocks for i in (0, 1))
        linked, named = 1 - (1 - LINKED) * links / chars, NAMED if any(step.endswith("!") for step in p) else 1.0
        inside = any(_tag(step) in ("article", "main") for step in p)
        out[p] = sqrt(length * (1 + marks)) * linked * named * (ELEMENT if inside else 1), named * (1 if inside else linked)
    return out


def container(paths: set[Path]) -> Path:
    """The path of the deepest element that holds the parents of all of them."""
    parents = [next((p[: k + 1] for k in range(len(p) - 1, -1, -1) if _tag(p[k]) in ("article", "main")), p[:-1]) for p in sorted(paths)]
    first = parents[0]
    for other in parents[1:]:
        first = first[: _shared(first, other)]
    return first


def content_paths(nodes: list[Node]) -> set[Path]:
    """The paths whose nodes are content."""
    scores = path_scores(nodes)
    if not scores:
        return set()
    best = max(score for score, _ in scores.values())
    seeds = {p for p, (score, _) in scores.items() if score >= HIGH * best}
    root = container(seeds)
    light = {p for p, (_, weight) in scores.items() if weight < LOW}
    inside = {p for p in scores if p[: len(root)] == root and p not in light}
    return seeds | inside | beside([n for n in nodes if n[1] not in light], root)


def beside(nodes: list[Node], root: Path) -> set[Path]:
    """The paths in the branches of the container's ancestors that hold content too.

    Where the container is in an article or main element, only branches inside that are looked at.
    """
    k = len(root)
    outer = next((i for i, step in enumerate(root) if _tag(step) in ("article", "main")), -1)
    held: set[Path] = set()
    branches: dict[Path, dict[Path, list]] = {}
    length, blocks = 0, set()
    for block, path, text, linked in nodes:
        size = len(text.strip())
        if not size:
            continue
        if path[:k] == root:
            length += size
            blocks.add(block)
        else:
            j = _shared(path, root)
            if j > outer:
                sums = branches.setdefault(path[: j + 1], {}).setdefault(path, [0, 0, set(), 0])
                sums[0] += size
                sums[1] += len(PUNCTUATION.findall(text))
                sums[2].add(block)
                sums[3] += size * linked
    mean = length / max(len(blocks), 1)
    for paths in branches.values():
        if 2 * sum(s[3] for s in paths.values()) > sum(s[0] for s in paths.values()):
            continue
        for path, (size, marks, own, links) in paths.items():
            each, tags = size / len(own), {_tag(step) for step in path}
            if 2 * links <= size and (tags & (HEADINGS | LISTS) or each >= SHARE * mean or each >= SENTENCE and marks >= len(own)):
                held.update(paths)
                break
    return held


def extract(page: str | None) -> str:
    """The main text of one page; empty for a null or empty page and one without text."""
    if not page:
        return ""
    nodes = text_nodes(page.replace("\0", " "))
    held = content_paths(nodes)
    kept: list[tuple[int, str]] = [(block, text) for block, path, text, _ in nodes if path in held]
    out: list[str] = []
    last, parts = None, []
    for block, text in [*kept, (None, "")]:
        if block != last:
            body = " ".join(html.unescape("".join(parts)).split())
            if body:
                out.append(body)
            last, parts = block, []
        parts.append(text)
    return "\n".join(out)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, url, text and n_chars of every page; rows stay as they are otherwise.

    Null html gives an empty text; repeated rows are extracted each; other columns are ignored.
    Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pages")
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return bounded_batches(pages).select(id_col, url_col, html_col).mapInArrow(run, f"{id_col} {kind}, {url_col} string, text string, n_chars bigint")
