"""The main text of a web page by the distribution of text over its lines."""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import map_texts

#: Lines in a sliding window; lines are blocks of the page, or empty where blocks end without text.
WINDOW = 3
#: Text in a window surges where it reaches this share of the page's typical line, and dives below it.
SURGE = 0.25
#: What a character outside an element that marks the article weighs, on pages that have one.
OUTSIDE = 0.1
#: What ends a sentence: a line of plain sentences far from the large text may belong to it.
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$").search

#: Comments, elements whose content is not text, and tags; the rest is text.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(script|style|noscript|template|iframe|svg|title|textarea|select|button|object)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)
    |<[/!?]?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>
    |<[/!?]?[a-zA-Z][^>]*+(?:>|\Z)""",
    re.S | re.I | re.X,
)
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)")
HINT = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Elements that don't end the line they stand in.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr"
    " math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements around the article, and words in class, id or role that mark such parts.
ASIDE = frozenset("nav footer aside form menu dialog".split())
#: Of these some frameworks put one around the whole page; around an article they are no sign.
WRAPPERS = frozenset("form menu dialog".split())
_WORDS = (
    r"(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|complementary|contentinfo|cookies?|consent|disqus|footer|gdpr"
    r"|login|masthead|menu|nav|navbar|navigation|newsletter|notice|notification|pagination|popup|promo|promoted|related|replies|respond|search|share|sharing|sidebar"
    r"|signup|skip|social|sponsor(?:ed)?|subscribe|teasers?|toolbar|widget)"
)
ASIDE_WORDS = re.compile(rf"(?<!\S){_WORDS}(?!\S)", re.I)
#: A part of a name is weaker evidence: names of pages that have or lack such a part don't count.
ASIDE_PARTS = re.compile(rf"(?<!\S)(?!(?:no|not|with|without|has|have|hide|show|is)[_-])(?:\S*[_-])?{_WORDS}(?:[_-]\S*)?(?!\S)", re.I)
MAIN = frozenset(("article", "main"))
#: Names of articles that aren't the page's.
OWN_ARTICLES = re.compile(r"(?<!\S)(?:comments?|teasers?|promo|promoted|related|sponsor(?:ed)?|advert(?:isement)?)(?!\S)", re.I)
#: A header of the page is left out, one inside the article isn't.
HEADER = "header"


def wrapped(page: str) -> bool:
    """Whether an article or main stands in a form, menu or dialog."""
    if not any(f"<{w}" in page.lower() for w in WRAPPERS):
        return False
    open_, found = 0, False
    for m in re.finditer(r"<(/?)(form|menu|dialog|article|main)\b", page, re.I):
        if m.group(2).lower() in MAIN:
            found = found or open_ > 0 and not m.group(1)
        else:
            open_ = max(0, open_ + (-1 if m.group(1) else 1))
    return found


def page_lines(page: str, parts_count: bool = True, reopened: bool = False, wrappers: bool = True) -> list[tuple[str, bool, bool, float]]:
    """Lines of text in page order: the text, whether it is beside the article, whether in it, the share in links.

    With ``parts_count`` a part of a class name marks what is beside the
    article; without ``wrappers`` a form, menu or dialog doesn't. With ``reopened`` an article inside an element so marked is none
    the less an article; inside elements that are never around one it isn't.

    Markup is stripped; every element that is not inline ends a line. White
    space inside a line becomes one space. Where an element ends without text
    the line is empty. Time is in proportion to the page.
    """
    lines: list[tuple[str, bool, bool, float]] = []
    parts: list[str] = []
    # Open elements; where those of each name, those around no article by their kind or name, and articles are.
    depth, names, off, named_off, mains = 0, {}, [], [], []
    words = ASIDE_PARTS if parts_count else ASIDE_WORDS

    def state() -> tuple[bool, bool]:
        since = mains[-1] if reopened and mains else 0
        return bool(off) or bool(named_off) and named_off[-1] >= since, bool(mains)

    def closed_from(k: int) -> None:
        """Elements from the k-th on are closed."""
        nonlocal depth
        for stack in (off, named_off, mains, *[names[n] for n in set(order[k:])]):
            while stack and stack[-1] >= k:
                stack.pop()
        del order[k:]
        depth = k

    order: list[str] = []
    beside, inside, in_link, linked = False, False, False, 0

    def close_line() -> None:
        nonlocal in_link, linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        # More empty lines than a window has tell nothing more.
        if text or any(x[0] for x in lines[-WINDOW:]):
            lines.append((text, beside, inside, min(1.0, linked / len(text)) if text else 0.0))
        in_link, linked = False, 0

    at = 0
    for found in MARKUP.finditer(page):
        parts.append(page[at : found.start()])
        linked += len(parts[-1].strip()) * in_link
        at = found.end()
        tag = found.group()
        if found.group(1) or not (named := NAME.match(tag)):
            continue
        name = named.group(2).lower()
        if name in INLINE:
            if name == "a":
                in_link = not named.group(1)
            elif name == "br":
                parts.append(" ")
            continue
        close_line()
        if named.group(1):
            if names.get(name):
                closed_from(names[name][-1])
        elif name not in VOID and not tag.endswith("/>"):
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and order and order[-1] == name:
                closed_from(depth - 1)  # their end tags may be left out
            hints = " ".join("".join(x) for x in HINT.findall(tag))
            # Comments and teasers are often articles of their own.
            named = hints and name not in ("body", "html") and (name not in MAIN and words.search(hints) or name in MAIN and OWN_ARTICLES.search(hints))
            if named:
                named_off.append(depth)
            if name in ASIDE and (wrappers or name not in WRAPPERS) or (name == HEADER and not mains):
                off.append(depth)
            if name in MAIN and not named:
                mains.append(depth)
            names.setdefault(name, []).append(depth)
            order.append(name)
            depth += 1
        beside, inside = state()
    parts.append(page[at:])
    close_line()
    return lines


def line_blocks(weights: list[float], least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Runs of lines between surge and dive points.

    Weights are summed over ``window`` lines from each line on. The sum surges
    where it reaches ``least`` and dives where it falls below; the lines of the
    windows between the two are a run.
    """
    sums, total = [], 0.0
    padded = [0.0] * (window - 1) + list(weights) + [0.0] * (window - 1)
    for k, w in enumerate(padded):
        total += w - (padded[k - window] if k >= window else 0.0)
        if k >= window - 1:
            sums.append(total)  # of the window that ends with the k-th padded line
    runs: list[tuple[int, int]] = []
    for k, total in enumerate(sums):
        if total >= least - 1e-9 and total > 0:
            a, b = max(0, k - window + 1), min(len(weights), k + 1)
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], b)
            else:
                runs.append((a, b))
    return runs


def main_text(page: str | None) -> str:
    """Lines of the article joined by newlines; "" for a page without one.

    A line weighs what it has of text outside links. Windows of lines sum these
    weights; the sums surge and dive at a share of the page's typical line, the
    mean in which each line counts by its weight. Of the lines between, those
    that are mostly links are left out. A line elsewhere is kept if it ends like
    a sentence and is no link.

    Tags change weights: lines beside the article weigh nothing. Where the page
    marks an article that holds text, its lines weigh a typical line more, so
    each makes its windows surge, and text outside it weighs OUTSIDE of its
    length: sentences there are kept where windows of them alone surge, as
    where only the first part of a long text is marked.

    Parts of class names only count where most of the page isn't lost by them,
    and an article inside an element named as if beside it is taken where it
    holds more text than all else.
    """
    if not page:
        return ""
    size = lambda found: sum(len(x[0]) for x in found)
    plain = lambda found: [x for x in found if not x[1]]
    wrappers = not wrapped(page)
    lines = page_lines(page, wrappers=wrappers)
    if 2 * size(plain(lines)) < size(lines):
        others = page_lines(page, parts_count=False, wrappers=wrappers)
        if size(plain(others)) > 2 * size(plain(lines)):
            lines = others
    if not any(x[2] and x[0] for x in plain(lines)) and any(x[2] for x in lines):
        others = page_lines(page, parts_count=False, reopened=True, wrappers=wrappers)
        if size(x for x in plain(others) if x[2]) > size(plain(lines)):
            lines = others
    own = [0.0 if x[1] else len(x[0]) * (1 - x[3]) for x in lines]
    text = [w if 2 * w > len(x[0]) else 0.0 for w, x in zip(own, lines, strict=True)]
    inside = [bool(x[0]) and x[2] and not x[1] for x in lines]
    if any(inside):
        # Marked: each line of the article surges by itself, others only where much text stands together.
        length = [float(len(x[0])) if i else 0.0 for x, i in zip(lines, inside, strict=True)]
        typical = sum(w * w for w in length) / sum(length)
        weights = [typical + w if i else OUTSIDE * t for w, t, i in zip(length, text, inside, strict=True)]
        least = SURGE * typical
        held = {k for a, b in line_blocks(weights, least) for k in range(a, b) if inside[k]}
        apart = [0.0 if i else w for w, i in zip(weights, inside, strict=True)]
        held |= {k for a, b in line_blocks(apart, least) for k in range(a, b) if apart[k] and SENTENCE(lines[k][0])}
    else:
        typical = sum(w * w for w in own) / (sum(own) or 1.0)
        held = {k for a, b in line_blocks(own, SURGE * typical) for k in range(a, b) if text[k]}
        held |= {k for k, x in enumerate(lines) if text[k] and x[3] == 0 and SENTENCE(x[0])}
    return "\n".join(lines[k][0] for k in sorted(held))


def extract_main_text(
    df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url"
) -> DataFrame:
    """``id_col``, ``url_col``, text and n_chars (code points) of each page.

    A null or empty page has the text "". Broken markup never fails: what opens
    and doesn't close ends with the page. Each row is read by itself, whole,
    however long; repeated rows and ids give a row each, an empty table an
    empty one, and nothing is shuffled.
    """

    def make():
        def extract(pages: list[str | None]) -> list[pa.Array]:
            texts = [main_text(p) for p in pages]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return extract

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_texts(df, html_col, make, fields, [id_col] + ([url_col] if url_col else []))
