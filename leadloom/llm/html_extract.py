"""HTML extraction: a first pass of block rules, then ambiguous blocks inherit from their nearest decided neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.markup import Attributes, tokens
from leadloom.llm.common import small_batches

#: Elements that begin and end blocks; all others run inside a block.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
 form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th
 thead title tr ul""".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text at all.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements that hold no article text, and those that do so only outside an article.
ASIDE = frozenset("nav footer aside form button select dialog menu svg canvas object audio video math map datalist head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Class and id names of parts beside the article.
MARKS = frozenset("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments cookie cookies
 consent disqus footer gdpr login menu menubar nav navbar navigation newsletter notice notices notification pager
 pagination paywall popup promo promoted promotion reply replies respond sidebar
 signin signup sponsor sponsored subscribe subscription toolbar masthead topbar sitemap copyright""".split())
#: Names that long prose inside an article outweighs.
WEAK_MARKS = frozenset("modal overlay recommended recommendations related search share sharing skip social widget widgets".split())
#: Only outside an article: its own header carries its title.
OUTER_MARKS = frozenset(["header"])
#: Last words of a name that say nothing of the part: the word before them is its head ("related-posts", "ad-box").
HOLDERS = frozenset("""area articles bar block bottom box button buttons container content group holder inner item items left link links list
 main module outer panel posts right row section slot stories text title top unit wrap wrapper zone""".split())
#: First words of names that tell of a state of the page ("has-sidebar").
STATES = frozenset("has is js no with without".split())
#: Beginnings of run-together names such as commentlist or sidebarleft.
MARK_STARTS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "newsletter", "sidebar", "sponsor", "subscri")
COMMENT_MARKS = frozenset("comment comments reply replies respond disqus ad ads advert advertisement sponsored promo related".split())
#: How surely an element stands beside the article.
PLAIN, WEAK, SURE = 0, 1, 2
#: Open elements that the start of a block ends: a paragraph always, and what cannot hold the new one.
ENDS = {"p": frozenset(["p"]), "li": frozenset(["p", "li"]), "dd": frozenset(["p", "dd", "dt"]), "dt": frozenset(["p", "dd", "dt"]),
        "option": frozenset(["option"]), "td": frozenset(["p", "td", "th"]), "th": frozenset(["p", "td", "th"]), "tr": frozenset(["p", "td", "th", "tr"])}
#: Frequent function words.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with be by this at from or an have not they which you were but his her their been has had will would can who what all there when we he she i no if so do",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch man ich wir",
    "fr": "le la les de des du et en un une est que qui dans pour pas au sur par plus avec il elle ne se ce sont aux ou son sa ses mais comme on nous vous ils cette être a été ont leur",
    "es": "el la los las de del y en un una es que por con no para se su al lo como más o pero sus le ha si sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde",
}
STOPS = frozenset(w for words in STOP_WORDS.values() for w in words.split())

_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    text: str
    linked: int  # characters of the text inside links
    beside: int  # PLAIN, WEAK or SURE: how surely the element around it holds no article text
    scope: int  # number of the article or main element around it, 0 without
    heading: bool


@dataclass(frozen=True)
class Rules:
    """First pass: a block is bad beside the article or, outside one, with too many links; good if long and rich in
    stop words."""

    most_linked: float = 0.4
    long_enough: int = 70
    stop_density: float = 0.12


def head_word(name: str) -> str:
    """The word that names the part: the last that is no mere holder; empty for names of states."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or (len(parts) > 1 and parts[0] in STATES):
        return ""
    return next((p for p in reversed(parts) if p not in HOLDERS), "")


def _beside(tag: str, attributes: Attributes, inside: bool) -> int:
    if tag in ASIDE or (tag == "header" and not inside):
        return SURE
    if not attributes:
        return PLAIN
    values = {k: v or "" for k, v in attributes}
    if "hidden" in values or values.get("aria-hidden") == "true":
        return SURE
    if "display:none" in values.get("style", "").replace(" ", "").lower():
        return SURE
    if values.get("role", "").lower() in ROLES:
        return SURE
    if tag in ("html", "body", "main"):
        return PLAIN
    heads = {head_word(n) for k in ("class", "id") for n in values.get(k, "").split()}
    begins = any(h.startswith(MARK_STARTS) for h in heads)
    if tag == "article":
        return SURE if begins or heads & COMMENT_MARKS else PLAIN
    if begins or heads & MARKS or (not inside and heads & OUTER_MARKS):
        return SURE
    return WEAK if heads & WEAK_MARKS else PLAIN


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order. One pass over tags; whatever is no tag is text, so no page can fail.

    Every step pops or pushes once, so a page costs its length however its tags are nested or left open.
    """
    out: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, int, str, int, int]] = []  # tag, beside, tag that brought it, scope, open links
    open_at: dict[str, list[int]] = {}  # places in the stack by tag
    places: list[int] = []  # of the block elements in the stack
    scopes = breaks = 0
    nothing = ("", PLAIN, "", 0, 0)

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            linked = sum(len(" ".join(x.split())) for x in links)
            _, beside, _, scope, _ = stack[-1] if stack else nothing
            out.append(Block(text, min(linked, len(text)), beside, scope, bool(places) and stack[places[-1]][0] in HEADINGS))
        parts.clear()
        links.clear()

    def close(tag: str) -> None:
        while stack:
            top = stack.pop()[0]
            open_at[top].pop()
            if top in BLOCKS:
                places.pop()
            if top == tag:
                return

    def add(text: str) -> None:
        nonlocal breaks
        parts.append(text)
        if stack and stack[-1][4]:
            links.append(text)
        if not text.isspace():
            breaks = 0

    for kind, value, *rest in tokens(page, RAW):
        if kind == "text":
            add(value)
        elif kind == "end":
            at = open_at.get(value)
            if not at:
                continue
            if value in BLOCKS:
                flush()
                close(value)
            elif at[-1] > (places[-1] if places else -1):
                close(value)  # an end tag of a running element does not end blocks
        elif kind == "start" and value not in RAW:
            tag, (attributes, closed) = value, rest
            if tag == "br":
                breaks += 1
                add(" ") if breaks < 2 else flush()
                continue
            if tag in BLOCKS:
                flush()
                while places and stack[places[-1]][0] in ENDS.get(tag, ENDS["p"]):
                    close(stack[places[-1]][0])
            if tag in VOID or (closed and tag not in BLOCKS):
                continue
            _, beside, cause, scope, in_link = stack[-1] if stack else nothing
            if tag in ("article", "main") and not _beside(tag, attributes, True):
                if cause in ("nav", "header", "form"):
                    beside, cause = PLAIN, ""  # left open before, or around the whole page
                scopes += 1
                scope = scope or scopes
            own = _beside(tag, attributes, bool(scope))
            if own > beside:
                beside, cause = own, tag
            if tag in BLOCKS:
                places.append(len(stack))
            open_at.setdefault(tag, []).append(len(stack))
            stack.append((tag, beside, cause, scope, in_link + (tag == "a")))
    flush()
    return out


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOPS for w in words) / len(words) if words else 0.0


def first_pass(b: Block, rules: Rules, leading: bool) -> bool | None:
    """Bad, good or undecided (None). leading: the page's article holds its main text.

    A surely marked block is bad. Long prose with many stop words and few links is good; outside a leading article that
    evidence and the place cancel out. Blocks of an article are never bad for their links (lists of references).
    """
    linked = b.linked / len(b.text)
    prose = len(b.text) >= rules.long_enough and linked <= rules.most_linked and stop_density(b.text) >= rules.stop_density
    if b.beside:
        return b.beside == WEAK and bool(b.scope) and prose
    if b.scope:
        return True if prose else None
    if linked > rules.most_linked and not b.heading:
        return False
    if len(b.text) < 200 and ("©" in b.text or b.text.lower().startswith("copyright")):
        return False
    return True if prose and not leading else None


def inherited(found: list[Block], first: list[bool | None], i: int, before, after, leading: bool, rules: Rules) -> bool:
    """Label of the undecided block i from its nearest decided neighbours, (place, label) or None each."""
    b = found[i]
    if b.heading and after:
        return after[1]
    if b.heading and not b.scope and b.linked / len(b.text) > rules.most_linked:
        return False
    near = sorted((abs(i - n[0]), not n[1]) for n in (before, after) if n)
    return not near[0][1] if near else bool(b.scope) or not leading


def classify(found: list[Block], rules: Rules = Rules(), second: bool = True) -> list[bool]:
    """Whether each block belongs to the main text.

    First pass: bad (False), good (True) or undecided. Second pass: an undecided block takes the label of its nearest
    decided neighbours in its own article or main element (outside of these: on the page); when the two sides differ,
    the nearer one counts, and the good one at equal distance; a heading takes the label of the decided block after
    it. Marked parts of an article do not hand their label on. Where nothing is decided, blocks of an article are
    good, and outside they are if no article leads; on a page with neither an article nor a good block, only long
    ones without links are. ``second=False`` leaves undecided blocks out.

    Articles and main elements that hold less text than the good blocks outside them are teasers: then they count for
    nothing. The stop words are those of English, German, French and Spanish; a page in another language has no good
    block in the first pass and so follows its article, or the rule for pages without one.
    """
    held = sum(len(b.text) for b in found if b.scope and not b.beside)
    outside = sum(len(b.text) for b in found if not b.scope and first_pass(b, rules, False))
    if held and outside > held:
        found = [replace(b, scope=0) for b in found]
    leading = any(b.scope and not b.beside for b in found)
    first = [first_pass(b, rules, leading) for b in found]
    if not second:
        return [bool(f) for f in first]
    before: list[tuple[int, bool] | None] = [None] * len(found)
    after: list[tuple[int, bool] | None] = [None] * len(found)
    for order, nearest in ((range(len(found)), before), (range(len(found) - 1, -1, -1), after)):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            b = found[i]
            nearest[i] = last.get(b.scope)
            if first[i] is not None and (first[i] or not (b.scope and b.beside)):
                last[b.scope] = (i, first[i])
    out = [inherited(found, first, i, before[i], after[i], leading, rules) if f is None else f for i, f in enumerate(first)]
    if not leading and not any(out):
        out = [f is None and not b.linked and len(b.text) >= rules.long_enough for f, b in zip(first, found)]
    return out


def main_text(page: str, rules: Rules = Rules()) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, good in zip(found, classify(found, rules)) if good)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (empty if none), n_chars.

    A null html counts as empty. The parser reads whole pages in one pass and takes any input; text is never cut.
    Row-local: repeated rows give a row each, an empty table none.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            columns = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return small_batches(slim).mapInArrow(run, "page_id long, url string, text string, n_chars long")
