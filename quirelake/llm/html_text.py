"""Main text of web pages by tree scoring.

A page is read in one pass into its block elements. Paragraphs pass points for their length and their commas to the
containers above them: all to the nearest, half to the next, less further up. A container's points, with a little for its
kind and its class, are discounted by the share of its text that stands in links. The best container is kept, or the
article around it, with those of its siblings that score like it or read like its paragraphs; what is in them and is no
menu, header, footer, sidebar, notice, advert, form, script, style or reader comment is the text, whole and in page order.

Work is linear in a page: elements that cannot close are found by counters, points and totals move up in one backward pass.
Spark deals the pages; a task holds a batch of at most ARROW_ROWS of them.

Pages by their defined results:
- A null or empty page, or one with nothing but what is left out, has an empty text.
- White space is Unicode's, also where a reference stands for it; a line break element is white space, not a block's end.
- Broken markup is read as browsers do: unclosed paragraphs and items end at the next, unclosed comments and scripts at the
  page's end; a tag whose quote is never closed ends at its next `>`.
- Rows are results of their own: repeated rows repeat, null ids and urls stay. Columns beyond the three are never read.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quirelake.llm.common import lean, small_batches, with_columns_of

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption caption td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Left out whatever their class; header only outside of an article.
OUT = frozenset("nav footer aside form dialog menu template button select svg canvas object audio video map search header fieldset".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
#: Elements in which a paragraph is not ended by what is inside.
SCOPES = frozenset("table td th caption button object template".split())
# Words of class names and ids.
OUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner sidebar sidebars nav navbar navigation topnav subnav menu menus breadcrumb breadcrumbs footer foot masthead header topbar comment comments commentlist disqus respond replies social share sharing related recommended recommendations newsletter subscribe subscription signup login popup modal overlay cookie cookies consent gdpr notice notices alert alerts widget widgets pager pagination toolbar skip rss outbrain taboola aside".split())
OUT_STARTS = ("advert", "sponsor", "comment", "cookie", "sidebar", "breadcrumb", "newsletter", "navbar", "navig")
GOOD_WORDS = frozenset("article body content entry hentry main page post text blog story column".split())
#: Class names that leave an article or main element out.
OUT_ARTICLE = re.compile(r"(comment|reply|ad|advert|promo|related|teaser|sponsored)s?([-_](body|item|content|card|box|list|post|\d+))?")

TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
COMMENT_END = re.compile(r"--!?>")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

#: Points: of a paragraph of at least LONG characters; for each HUNDRED of them, to at most MOST; for each comma.
LONG, HUNDRED, MOST = 25, 100, 3
KINDS = {"article": 25, "main": 10, "div": 5, "section": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "form": -3, "address": -3, "table": -3}
CLASS_POINTS = 25
#: Levels above a paragraph's container that get points.
LEVELS = 5
#: Siblings: share of the best score, and the least; a paragraph of more characters with fewer links.
SIBLING_SHARE, SIBLING_LEAST, SIBLING_LONG, SIBLING_LINKS = 0.2, 10.0, 80, 0.25
#: A container of as many links and more of its text in them is a menu.
MENU_LINKS, MENU_SHARE = 3, 0.9
COMMAS = re.compile("[,،、，]")


class _Page:
    """Block elements in page order, parents first, and the texts that stand in them."""

    def __init__(self) -> None:
        self.tag, self.up, self.out, self.points = ["body"], [-1], [False], [0]
        self.texts: list[tuple[int, str, int, int]] = []  # element, text, characters in links, links


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is left out, and its class's points."""
    out = tag in OUT and not (tag == "header" and in_article)
    points = 0
    if not attributes:
        return out, points
    for name, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        name = name.lower()
        if name in ("class", "id"):
            if tag in ("article", "main", "body", "html"):
                out |= tag != "body" and tag != "html" and any(OUT_ARTICLE.fullmatch(c) for c in value.split())
                continue
            words = set(re.findall("[a-z]+", value))
            good = bool(words & GOOD_WORDS)
            out |= (bool(words & OUT_WORDS) or any(w.startswith(OUT_STARTS) for w in words)) and not (in_article and tag in ("header", "hgroup") or tag in HEADINGS)
            points += CLASS_POINTS * good
        elif name == "role":
            out |= value in OUT_ROLES and not (in_article and value == "banner")
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and INVISIBLE.search(value):
            out = True
    return out, points


def _read(page: str) -> _Page:
    """One pass over the markup; see the module's head for what it does with broken markup."""
    tree = _Page()
    stack: list[tuple[str, int, bool, int]] = []  # name, block element, left out inside a block, open paragraph below
    open_: Counter[str] = Counter()
    block, silent, links, paragraph = 0, 0, 0, -1
    parts: list[str] = []
    linked = marks = 0
    tags, at, end = TAG, 0, len(page)

    def flush() -> None:
        nonlocal parts, linked, marks
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tree.texts.append((block, text, min(linked, len(text)), marks))
        parts, linked, marks = [], 0, 0

    def say(text: str) -> None:
        nonlocal linked
        if not silent:
            text = references.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text.strip())

    def pop(to: int) -> None:
        """Closes the elements from the stack's place to on."""
        nonlocal block, silent, links, paragraph
        while len(stack) > to:
            name, own, quiet, below = stack.pop()
            open_[name] -= 1
            if name in BLOCK:
                flush()
                block = tree.up[own]
            silent -= quiet
            links -= name == "a"
            if name in SCOPES:
                paragraph = below
            elif name == "p" and paragraph >= len(stack):
                paragraph = -1

    while at < end:
        i = page.find("<", at)
        if i != at:
            say(page[at : i if i >= 0 else end])
        if i < 0:
            break
        if page.startswith("<!--", i):
            found = COMMENT_END.search(page, i + 4) if not page.startswith((">", "->"), i + 4) else re.compile("-?>").match(page, i + 4)
            at = found.end() if found else end
            continue
        found = tags.match(page, i)
        if not found and tags is TAG and page[i + 1 : i + 2].isalpha() and "=" in page[i:]:
            tags = PLAIN_TAG  # a quote that is never closed: quotes are ordinary from here on
            found = tags.match(page, i)
        if not found:
            if page[i + 1 : i + 2] in ("!", "?", "/"):
                at = (page.find(">", i) + 1) or end
            else:
                say("<")
                at = i + 1
            continue
        at = found.end()
        closes, name, attributes = found[1], found[2].lower(), found[3]
        if closes:
            if name == "p" and not open_["p"]:
                flush()
            elif open_[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                pop(k)
            continue
        if name in RAW:
            found = RAW_END[name].search(page, at)
            at = found.end() if found else end
            continue
        if name == "br" or name == "hr":
            flush() if name == "hr" else say(" ")
            continue
        if name in ("html", "body", "head") or name in VOID:
            continue
        if name in BLOCK:
            if paragraph >= 0 and name not in ("caption",):
                pop(paragraph)
            while tree.tag[block] in ENDS.get(name, ()) and stack:
                k = len(stack) - 1
                while stack[k][0] not in BLOCK:
                    k -= 1
                pop(k)
            flush()
            out, points = _marks(name, attributes, open_["article"] > 0)
            tree.tag.append(name)
            tree.up.append(block)
            tree.out.append(out)
            tree.points.append(points)
            block, quiet = len(tree.tag) - 1, False
        else:
            quiet = _marks(name, attributes, False)[0]
        if attributes.endswith("/") and name not in BLOCK:
            continue
        stack.append((name, block, quiet, paragraph))
        open_[name] += 1
        silent += quiet
        if name == "a":
            links += 1
            marks += not silent
        if name in SCOPES:
            paragraph = -1
        elif name == "p":
            paragraph = len(stack) - 1
    pop(0)
    flush()
    return tree


def main_text(page: str | None) -> str:
    """The page's text; see the module's head."""
    if not page:
        return ""
    tree = _read(page)
    n = len(tree.tag)
    tag, up = tree.tag, tree.up
    # an element around an article that is not left out itself stays
    holds = [tag[i] in ("article", "main") and not tree.out[i] for i in range(n)]
    inside_out = [False] * n
    for i in range(1, n):  # an article in comments is a comment
        inside_out[i] = inside_out[up[i]] or (tree.out[i] and tag[i] not in ("form", "div", "section", "header", "fieldset"))
    holds = [h and not inside_out[i] for i, h in enumerate(holds)]
    for i in range(n - 1, 0, -1):
        holds[up[i]] |= holds[i]
    out = [False] * n
    for i in range(1, n):
        own = tree.out[i] and not (holds[i] and not _comments(tree, i))
        out[i] = out[up[i]] or own
    scores, chars, linked, links = [0.0] * n, [0] * n, [0] * n, [0] * n
    for v, text, in_links, marks in tree.texts:
        chars[v] += len(text)
        linked[v] += in_links
        links[v] += marks
        if out[v]:
            continue
        points = (len(text) >= LONG) + min(len(text) / HUNDRED, MOST) + len(COMMAS.findall(text))
        w = up[v] if tag[v] in PARAGRAPHS and v else v
        for level in range(LEVELS):
            scores[w] += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            w = up[w]
            if w < 0:
                break
    for i in range(n - 1, 0, -1):
        chars[up[i]] += chars[i]
        linked[up[i]] += linked[i]
        links[up[i]] += links[i]
    density = [linked[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
    final = [(scores[i] + KINDS.get(tag[i], 0) + tree.points[i]) * (1 - density[i]) if scores[i] > 0 and not out[i] else float("-inf") for i in range(n)]
    best = max(range(n), key=final.__getitem__)
    if final[best] == float("-inf"):
        return ""
    while tag[best] in ("tr", "tbody", "thead", "tfoot") and not out[up[best]]:
        best = up[best]  # rows are a table's
    inner, w = best, best
    while w >= 0:
        if tag[w] == "article" and not out[w]:
            best = w
        w = up[w]
    kept = [False] * n
    kept[best] = True
    if best:
        least = max(SIBLING_LEAST, SIBLING_SHARE * max(final[inner], 0))
        for i in range(1, n):
            if up[i] == up[best] and not out[i] and chars[i]:
                if tag[best] == "article":
                    kept[i] |= tag[i] == "article" and final[i] >= least
                else:
                    kept[i] |= final[i] >= least or tag[i] in HEADINGS and not links[i] or tag[i] == "p" and chars[i] > SIBLING_LONG and density[i] < SIBLING_LINKS
    roots = list(kept)
    for i in range(1, n):
        menu = not roots[i] and tag[i] in ("ul", "ol", "div", "section", "table", "dl") and links[i] >= MENU_LINKS and density[i] > MENU_SHARE
        kept[i] = (kept[i] or kept[up[i]]) and not menu and not out[i]
    return "\n".join(text for v, text, _, _ in tree.texts if kept[v])


def _comments(tree: _Page, i: int) -> bool:
    """Whether an element that is left out stays so though it holds an article: navigation and the like do."""
    return tree.tag[i] in ("nav", "footer", "aside", "dialog", "menu", "template")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as page_id, url, text, n_chars (code points)."""
    small_batches(pages.sparkSession)
    rows = with_columns_of(pages, page_id=T.LongType(), url=T.StringType(), html=T.StringType())
    return rows.mapInArrow(lean(_texts), "page_id long, url string, text string, n_chars long")
