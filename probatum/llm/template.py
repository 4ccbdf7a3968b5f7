"""Main text of web pages by deducing the template that pages of a host share.

Every page is read into tokens: its elements by path, and its blocks of text. A token's occurrence vector says how often it
stands on each page of the host; tokens with equal vectors form an equivalence class. Vectors are compared by count,
total and the exclusive or of a hash per page, so they are built by plain aggregation and a host of any size is never gathered. The class
of the page itself is the root of the template; a class found on at least half of the pages is nested in it if its
elements lie within elements of the class above. Elements of the template bound slots; blocks with the same text on most pages
belong to the template, not to a slot.

The slot that holds the article is chosen per host: the template's innermost element that is marked as an article, else the innermost that
holds nearly all text that varies. Pages that lack it, and hosts with a single page, are read by their own marks. In the chosen part,
menus, headers and footers of pages, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out, and everything
else is kept: blocks of an element marked as an article stay even if other pages repeat them. A class or id names such a part if all its
words do (``cookie-notice``, ``comments-area``); within an article only containers are left out by it, no headings or paragraphs, nor a section that
opens with a heading and whose name may be a topic (``discussion``). Where just a word of it does (``side-effects``), a
container goes only if most pages of the host repeat its text.

Null, empty or text-free html gives an empty text. A null url is a host of its own. Repeated rows get a row each. Html that is cut off or
leaves elements open is read to its end.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatum.llm.common import durable

# Fixed values of HTML: elements without content, of raw text, that break lines, and that never are main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|iframe|textarea|svg|math|object|canvas|select|title"
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("nav footer aside form head menu button dialog fieldset datalist audio video map".split())
# Words in class and id that name what is not the article; a page's own header counts only outside an article.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted nav navbar "
                  "navigation menu breadcrumb breadcrumbs footer foot sidebar side aside widget widgets rail cookie cookies consent gdpr notice "
                  "notices alert popup modal overlay newsletter subscribe subscription signup login paywall form search share sharing social "
                  "related recommended recommendations teaser teasers comment comments commentlist reply replies respond discussion disqus "
                  "pagination pager toolbar skip masthead topbar copyright disclaimer".split())
# Words that may stand beside those in one class or id and add nothing; names that may also be what a section of an article is about.
BESIDE = frozenset("container area list box wrapper wrap block section slot unit bar button buttons link links item items group inner outer left right "
                   "top bottom header site page main global primary secondary content post posts article articles story stories icon icons tools row col "
                   "column panel the".split())
TOPICS = frozenset("discussion side notice notices search alert advertising advertisement promotion cookies consent gdpr copyright disclaimer subscription "
                   "navigation menu form foot rail skip respond widget widgets recommendations sharing sponsors".split())
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd tr td th tbody thead tfoot caption figcaption blockquote pre address".split()) | INLINE
HEADED = re.compile(r"\s*(?:<(?:header|hgroup|div|a|span)\b[^>]*>\s*)*<h[1-6]\b", re.I)
OUTSIDE = frozenset("header head top".split())
MARKS = frozenset("article main content post entry story articlebody maincontent".split())
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note".split())
# An open element that the start of another ends.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot body div section article main aside nav header footer form".split())
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
PAGE = "#page"


class Block:
    """A block of text with the path of its element and what the elements around it say of it."""

    __slots__ = ("text", "path", "article", "out", "doubtful")

    def __init__(self, text: str, path: str, article: bool, out: bool, doubtful: bool):
        self.text, self.path, self.article, self.out, self.doubtful = text, path, article, out, doubtful


class Reader:
    """Reads one page into blocks and elements. Elements are (name, path, in an article, left out)."""

    def __init__(self):
        self.kinds: dict[tuple[str, str], tuple[str, bool, bool, bool, str, bool]] = {}

    def kind(self, name: str, more: str) -> tuple[str, bool, bool, bool, str, bool]:
        """(label for paths, marks an article, is left out, is left out outside articles, its name, is doubtful) of a start tag.

        The name is "" if class and id name nothing to be left out, "topic" if a section may be about it, else "part".
        """
        known = self.kinds.get((name, more))
        if known is None:
            if len(self.kinds) > 50_000:
                self.kinds.clear()
            marks, label, hidden, whole = set(), name, False, []
            role = ""
            for attribute, *values in ATTRIBUTE.findall(more) if more.strip() else ():
                attribute, value = attribute.lower(), "".join(values)
                if attribute in ("class", "id"):
                    marks.update(w.lower() for w in WORDS.findall(value))
                    if attribute == "class" or name not in TEXTUAL - INLINE:  # headings and the like have ids made of their text
                        whole += [{w.lower() for w in WORDS.findall(token)} for token in value.split()]
                    if attribute == "class" and value:
                        label = f"{name}.{' '.join(sorted(value.split()))}"
                elif attribute == "role":
                    role = value.strip().lower()
                elif attribute == "hidden" or attribute == "aria-hidden" and value.lower() == "true" or attribute == "style" and "display:none" in value.replace(" ", "").lower():
                    hidden = True
            out = hidden or name in LEFT_OUT or role in ROLES_OUT
            named, doubtful = "", False
            if name not in ("article", "main", "body", "html"):
                parts = [words & NAMES for words in whole if words & NAMES and words <= NAMES | BESIDE]
                named = ("topic" if all(words <= TOPICS for words in parts) else "part") if parts else ""
                doubtful = not named and name not in TEXTUAL and bool(marks & NAMES)
            article = name in ("article", "main") or role in ("main", "article") or (name in ("div", "section", "td") and bool(marks & MARKS))
            outside = name == "header" or (name not in ("body", "html", "h1", "h2", "h3", "p") and bool(marks & OUTSIDE))
            if name == "article" and any(words & {"comment", "comments", "reply", "teaser", "related", "promo", "ad"} and words <= NAMES | BESIDE for words in whole):
                out = True
            known = self.kinds[name, more] = (label, article and not out and not named, out, outside, named, doubtful)
        return known

    def read(self, text: str | None) -> tuple[list[Block], dict[str, int]]:
        """Blocks in page order, and how often each path opens."""
        blocks: list[Block] = []
        opened: dict[str, int] = defaultdict(int)
        stack: list[tuple[str, str, bool, bool, bool]] = [("", "", False, False, False)]
        parts: list[str] = []
        at = 0

        def flush() -> None:
            if parts:
                words = entities.unescape("".join(parts)).split()
                parts.clear()
                if words:
                    blocks.append(Block(" ".join(words), *next(x for x in reversed(stack) if x[0] not in INLINE)[1:]))

        def close(upto: int) -> None:
            del stack[upto:]

        for found in MARKUP.finditer(text or ""):
            start = found.start()
            if start > at and not stack[-1][3]:
                parts.append(text[at:start])
            at = found.end()
            name = found["name"]
            if name is None:
                continue
            name = name.lower()
            if name in INLINE:
                if name == "br":
                    parts.append(" ")
                elif found["end"]:
                    if stack[-1][0] == name:
                        stack.pop()
                else:
                    _, _, out, _, named, _ = self.kind(name, found["more"])
                    if (out or named and not stack[-1][2]) and name not in ("img", "wbr"):
                        stack.append((name, stack[-1][1], stack[-1][2], True, stack[-1][4]))
                continue
            flush()
            if found["end"]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                    if name not in HOLDERS and stack[i][0] in HOLDERS:
                        break
                continue
            while len(stack) > 1 and (stack[-1][0] in ENDED_BY.get(name, ()) or stack[-1][0] == "p" or stack[-1][0] in INLINE):
                stack.pop()
            if name in ("html", "body") and any(x[0] == name for x in stack):
                continue
            if name == "body":
                close(2 if len(stack) > 1 and stack[1][0] == "html" else 1)
            label, article, out, outside, named, doubtful = self.kind(name, found["more"])
            if name in ("article", "main"):  # neither stands in a menu or a page's header: those were left open
                close(next((i for i, x in enumerate(stack) if x[0] in ("nav", "header", "menu")), len(stack)))
            _, path, within, already, doubt = stack[-1]
            if named and not (within and (name in TEXTUAL or name == "section" and named == "topic" and HEADED.match(text, at))):
                out = True
            if name in ("article", "main") and already and all(x[0] == "form" for x in stack if x[3] and x[0] in LEFT_OUT):
                already = False  # a form around the whole page
            path = f"{path}/{label}"
            opened[path] += 1
            if name not in VOID and not found["more"].endswith("/"):
                stack.append((name, path, within or article, already or out or (outside and not within), doubt or doubtful))
        if text and at < len(text) and not stack[-1][3]:
            parts.append(text[at:])
        flush()
        return blocks, opened


def page_tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per host and token, summed over a batch: pages, occurrences, exclusive or of the pages' hashes, varying text in it."""
    reader = Reader()
    for frame in frames:
        seen: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        for page, host, text in zip(frame["page"].tolist(), frame["host"], frame["html"]):
            blocks, opened = reader.read(text)
            counts = dict(opened)
            counts[PAGE] = 1
            held: dict[str, int] = defaultdict(int)
            for block in blocks:
                if block.out:
                    continue
                path = block.path
                while path:
                    held[path] += len(block.text)
                    path = path.rpartition("/")[0]
                mark = f"={xxhash.xxh64_hexdigest(block.text)}"
                counts[mark] = counts.get(mark, 0) + 1
            for token, n in counts.items():
                sums = seen[host, token]
                sums[0] += 1
                sums[1] += n
                sums[2] ^= xxhash.xxh64_intdigest(f"{page} {n}") >> 1
                sums[3] += held.get(token, 0)
        yield pd.DataFrame([(*key, *sums) for key, sums in seen.items()], columns=["host", "token", "pages", "times", "mark", "chars"])


TOKENS = "host string, token string, pages long, times long, mark long, chars long"


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """(host, token, pages, times, mark, chars): one row per token of a host, its vector in three numbers."""
    return pages.mapInPandas(page_tokens, TOKENS).groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum("times").alias("times"), F.bit_xor("mark").alias("mark"), F.sum("chars").alias("chars"))


def deduce_templates(vectors: DataFrame, least: int = 3) -> DataFrame:
    """(host, classes, shared): the equivalence classes on at least half of a host's pages, from the root inwards, and its shared blocks.

    Only tokens on half of the pages are gathered: a page holds each, so they are no more than twice the tokens of one page.
    """
    whole = vectors.where(F.col("token") == PAGE).select("host", F.col("pages").alias("all"))
    frequent = vectors.join(whole, "host").where((F.col("all") >= least) & (2 * F.col("pages") >= F.col("all")))
    classes = (frequent.where(F.col("token").startswith("/") | (F.col("token") == PAGE)).groupBy("host", "pages", "times", "mark")
               .agg(F.array_sort(F.collect_list(F.struct("token", "chars"))).alias("tokens")))
    shared = frequent.where(F.col("token").startswith("=")).groupBy("host").agg(F.collect_set(F.substring("token", 2, 16)).alias("shared"))
    by_host = classes.groupBy("host").agg(F.array_sort(F.collect_list(
        F.struct((-F.col("pages")).alias("order"), "times", "mark", "tokens"))).alias("classes"))
    return by_host.join(shared, "host", "left").select("host", "classes", F.coalesce("shared", F.array().cast("array<string>")).alias("shared"))


def article_slot(classes) -> str:
    """The path of the template's element that holds the article, "" if the template does not show one.

    A class is nested if each of its elements lies in an element of the classes above it, the root's lying in the page.
    """
    held, above = {}, {""}
    for one in classes:
        paths = [(t["token"], t["chars"]) for t in one["tokens"] if t["token"].startswith("/")]
        nested = [(p, n) for p, n in paths if p.rpartition("/")[0] in above or any(p.startswith(f"{q}/") for q, _ in paths)]
        if -one["order"] == one["times"]:  # once on each page: these bound slots
            held.update(nested)
        above.update(p for p, _ in nested)
    marked = [p for p in held if re.match(r"(article|main)\b", p.rpartition("/")[2])]
    if marked:
        return max(marked, key=lambda p: (held[p], len(p)))
    slot = ""
    while True:
        inner = [p for p in held if p.rpartition("/")[0] == slot or (slot == "" and p.count("/") == 1)]
        best = max(inner, key=lambda p: (held[p], p), default=None)
        if best is None or not held[best] or (slot and held[best] < 0.9 * held[slot]):
            return slot
        slot = best


def main_text(blocks: list[Block], slot: str, shared: frozenset[str]) -> str:
    """The blocks of the article in page order, joined by an empty line."""
    blocks = [b for b in blocks if not (b.doubtful and xxhash.xxh64_hexdigest(b.text) in shared)]
    within = [b for b in blocks if not b.out and slot and (b.path == slot or b.path.startswith(f"{slot}/"))]
    chosen = [b for b in within if b.article]
    if not chosen:
        chosen = [b for b in blocks if b.article and not b.out]
    if not chosen:
        rest = within or [b for b in blocks if not b.out]
        chosen = [b for b in rest if xxhash.xxh64_hexdigest(b.text) not in shared] or rest
    return "\n\n".join(b.text for b in chosen)


def slots(templates: DataFrame) -> DataFrame:
    """(host, slot, shared): where each host's article is, and its repeated blocks."""

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"host": frame["host"], "slot": [article_slot(c) for c in frame["classes"]], "shared": frame["shared"]})

    return templates.mapInPandas(choose, "host string, slot string, shared array<string>")


def extract_articles(pages: DataFrame, least: int = 3, few_hosts: int = 10_000) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"(?s)^(?:.*?://)?([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", host.alias("host"))
    vectors = durable(occurrence_vectors(rows.select(F.coalesce("page_id", F.lit("")).alias("page"), "host", "html")), "page-tokens")
    known = durable(slots(deduce_templates(vectors, least)), "templates")
    joined = rows.join(F.broadcast(known) if known.count() <= few_hosts else known, "host", "left")

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, sets = Reader(), {}
        for frame in frames:
            texts = []
            for name, slot, shared, text in zip(frame["host"], frame["slot"], frame["shared"], frame["html"]):
                if name not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[name] = frozenset(shared) if slot is not None else frozenset()
                texts.append(main_text(reader.read(text)[0], slot or "", sets[name]))
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts})

    found = joined.select("page_id", "url", "host", "html", "slot", "shared").mapInPandas(extract, "page_id string, url string, text string")
    return found.select(F.col("page_id").cast(pages.schema["page_id"].dataType).alias("page_id"), "url", "text",
                        F.length("text").cast("long").alias("n_chars"))
