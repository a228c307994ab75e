"""Main text of web pages by template deduction over the pages of a host.

A page is a sequence of tokens: opening and closing tags, each told apart by the path of elements that it stands in, and
texts. Spark sums, per host and token, the pages it occurs in and a fingerprint of its occurrence vector (how often it
occurs in each page); equal pages of a host count once, so that copies do not pass for a template. Tokens with equal
fingerprints form an equivalence class. A text that 80% of the pages hold is part of the template if other tokens share
its class, and only under its own path: a menu's text may be a headline elsewhere. The frame is made of the elements that
occur once in 80% of the pages. Classes are not ordered or nested by position; nesting is that of the paths.

What is left are the slots: texts that differ from page to page. The main element is the smallest one of the frame that
holds all words of the slots, over all pages of the host, and all its slots are main text but for parts that serve other
ends: menus, footers and so on by their element, lists of links by their text, and small parts by their class, id or role. A
name marks nothing that holds more than half of a page's words, unless an article or main element stands beside it. A host with fewer than
MIN_PAGES different pages has no template; its pages are laid out by their own words. Side texts that differ from page to
page and bear no such name stay in the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlake.llm.common import slices
from firmlake.session import settle

MIN_PAGES = 8
FRAME = 0.8  # of a host's pages hold the tokens of a class in the frame
CONSTANT = 0.8  # of a host's pages hold a text of the template
MINOR = 0.5  # of a page's words at most lie in a part that its name sets aside

#: Fixed names of HTML: elements without content, with raw text, that do not break a line, and that never hold main text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr img".split()
)
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot option".split())  # elements whose end may be left out
ASIDE = frozenset("head nav header footer aside button select menu dialog canvas audio video object".split()) | RAW
#: Fixed words that name parts of a page which are not its text, and words that may follow them for the part as a whole.
SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer "
    "header login masthead menu modal nav navbar navigation newsletter notice notices popup promo promos promotion related replies reply share "
    "sharing sidebar signup social sponsor sponsored sponsors subscribe toolbar widget widgets".split()
)
PART_NAMES = frozenset("area bar block box container content form group holder inner item items link links list panel section slot thread unit wrap wrapper".split())
DENIED = frozenset("no not has with without hide hidden".split())  # "no-comments" says that there are none
_WORD = re.compile(r"[A-Za-z]+")
LINKS = 3  # so many parts in a row that are links only are a menu
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.DOTALL
)
_CLASS = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)


_SIGN = re.compile("[>!~]")  # signs of paths
_ARTICLE = re.compile(r">(?:article|main)(?![^.>~!])")


def side_names(names: list[str]) -> tuple[bool, bool]:
    """Do names (of classes, ids and roles) say that an element is no part of the text, and does one of them as a whole?

    A name says so if its last word is a listed one, or all words after the listed one stand for a part of the page:
    ``reader-comments`` and ``comments-list`` do, ``comments-on-policy`` and ``share-of-market`` do not.
    """
    some = whole = False
    for name in " ".join(names).split():
        words = [w.lower() for w in _WORD.findall(re.sub("([a-z])([A-Z])", r"\1 \2", name))]
        at = next((k for k, w in enumerate(words) if w in SIDE_NAMES), None)
        if at is not None and not DENIED & set(words[:at]) and (words[-1] in SIDE_NAMES or set(words[at + 1 :]) <= PART_NAMES):
            some = True
            whole |= len(words) == 1
    return some, whole


def parse(page: str | None) -> list[tuple[str, str, bool, bool]]:
    """The page's texts in order: path of block elements, text as written, whether a new block begins, whether it is a link's.

    Paths name elements with their classes; an element that serves other ends is marked by an exclamation mark, one whose
    names only say so (or a form, which may hold the whole page) by a tilde, or two if a whole name does. Headers within an article belong to it.
    """
    page = page or ""
    out: list[tuple[str, str, bool, bool]] = []
    stack: list[tuple[str, str]] = []  # element and path
    at, broken, path, linked = 0, True, "", False
    while at < len(page):
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            out.append((path, page[at:end], broken, linked))
            broken = False
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in INLINE:
            linked = linked if name != "a" else not m[1]
            continue
        broken = True
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
        elif name not in VOID and not m[3].endswith("/"):
            if name in LOOSE and stack and stack[-1][0] == name:
                stack.pop()
            if name != "p":
                names = [a or b or c for _, a, b, c in _CLASS.findall(m[3])]
                within = any(x in ("article", "main") for x, _ in stack)
                if within:
                    names = [x for x in names if "header" not in x.lower()]
                some, whole = side_names(names)
                if name in ASIDE and not (within and name == "header"):
                    mark = "!"
                else:
                    mark = "~" if name == "form" or some and name not in ("html", "body", "main") else ""
                    mark += mark if whole else ""
                kind = ".".join(x for k, a, b, c in _CLASS.findall(m[3]) if k.lower() == "class" for x in _SIGN.sub("_", a or b or c).split())
                stack.append((name, f"{stack[-1][1] if stack else ''}>{name}{'.' + kind if kind else ''}{mark}"))
        path = stack[-1][1] if stack else ""
    return out


def _clean(texts: list[tuple[str, str, bool, bool]]) -> list[tuple[str, str, int]]:
    """(path, text, links) of each block; links is 0 if words of the block stand outside of links."""
    out: list[list] = []
    for path, text, new, linked in texts:
        if new or not out:
            out.append([path, [], 0, False])
        out[-1][1].append(text)
        if any(map(str.isalnum, text)):
            out[-1][2] += linked
            out[-1][3] |= not linked
    clean = [(path, " ".join(html.unescape("".join(parts)).split()), 0 if other else links) for path, parts, links, other in out]
    return [x for x in clean if x[1]]


def blocks(texts: list[tuple[str, str, bool, bool]]) -> list[tuple[str, str]]:
    """(path, text) of each block: references decoded, white space made one blank, blocks without text left out."""
    return [(path, text) for path, text, _ in _clean(texts)]


def page_blocks(page: str | None) -> list[tuple[str, str]]:
    """The blocks of a page without its menus: neighbouring blocks outside of articles whose words are links only, LINKS of them or more.

    A page that has nothing but links keeps them.
    """
    clean = _clean(parse(page))
    kept: list[tuple[str, str]] = []
    run: list[tuple[str, str]] = []
    links = 0
    for path, text, n in [*clean, ("", "", 0)]:
        if n and not _ARTICLE.search(path):
            run.append((path, text))
            links += n
            continue
        kept += run if links < LINKS else []
        run, links = [], 0
        kept += [(path, text)] if text else []
    return kept or [(path, text) for path, text, _ in clean]


def closed(found: list[tuple[str, str]]) -> set[str]:
    """The elements of a page that their names set aside: those with a minor share of its words.

    Where an article or main element stands beside it, a name that is a listed word as a whole needs no minor share.
    """
    under, total, beside, holding = Counter(), 0, False, set()
    for path, text in found:
        if "!" not in path:
            words = len(text.split())
            total += words
            marked = [p for p in prefixes(path) if p.endswith("~")]
            under.update(dict.fromkeys(marked, words))
            if _ARTICLE.search(path):
                beside |= not marked
                holding.update(marked)
    return {p for p, n in under.items() if n <= MINOR * total or beside and p.endswith("~~") and p not in holding}


def is_open(path: str, shut: set[str], main: str = "") -> bool:
    """Whether nothing below the main element sets the path aside."""
    return "!" not in path[len(main) :] and not (shut and any(p in shut and len(p) > len(main) for p in prefixes(path)))


def _code(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _text_code(path: str, text: str) -> int:
    return _code(f"{path}\x00{text}")


def prefixes(path: str) -> list[str]:
    """The elements that a path runs through, from the page itself (the empty path) on."""
    parts = path.split(">")
    return [">".join(parts[: k + 1]) for k in range(len(parts))]


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page and token: how often, the fingerprint's summand, and the words under it (an element) or in it (a text), but for those set aside."""
    for batch in slices(batches):
        rows: list[tuple] = []
        for host, page in zip(*(batch.column(k).to_pylist() for k in range(2))):
            own = page_blocks(page)
            elements, under, texts = Counter(), Counter(), Counter()
            seen: set[str] = set()
            last, shut = None, closed(own)
            for path, text in own:
                words = len(text.split()) if is_open(path, shut) else 0
                for p in prefixes(path):
                    under[p] += words
                    if last is None or not (last + ">").startswith(p + ">"):
                        elements[p] += 1
                last = path
                texts[path, text] += 1
                seen.add(path)
            number = xxhash.xxh3_64_intdigest(page)
            for p, n in elements.items():
                rows.append((host, p, None, 1, n, _code(f"{number} {n}"), under[p]))
            for (p, t), n in texts.items():
                rows.append((host, p, _text_code(p, t), 1, n, _code(f"{number} {n}"), n * len(t.split()) if is_open(p, shut) else 0))
        columns = list(zip(*rows)) if rows else [[]] * 7
        kinds = (pa.string(), pa.string(), *[pa.int64()] * 5)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "path", "text_code", "pages", "times", "print", "words"])


def host_of(url):
    """Host name in lower case; the empty text where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def deduce(pages: DataFrame) -> DataFrame:
    """``host, main, constants``: the path of each host's main element, and the codes of the template's texts."""
    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(host_of(F.col("url")).alias("host"), source.alias("html")).distinct()
    tokens = rows.mapInArrow(_tokens, "host string, path string, text_code long, pages long, times long, print long, words long")
    whole = F.col("print").cast("decimal(38,0)")  # a sum of fingerprints must not overflow
    summed = settle(
        tokens.groupBy("host", "path", "text_code").agg(
            F.sum("pages").alias("pages"), F.sum("times").alias("times"), F.sum(whole).alias("print"), F.sum("words").alias("words")
        ).where("text_code is null or pages > 1"), "tokens",
    )
    digests = pages.select(host_of(F.col("url")).alias("host"), F.sha2(source.cast("binary"), 256).alias("digest")).distinct()
    counts = digests.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    # Equal occurrence vectors: one equivalence class. Its size tells chance from template.
    classes = summed.groupBy("host", "pages", "times", "print").agg(
        F.collect_list(F.when(F.col("text_code").isNull(), F.struct("path", "words"))).alias("elements"),
        F.collect_list(F.when(F.col("text_code").isNotNull(), F.struct("path", "text_code", "words"))).alias("texts"),
    )
    valid = classes.join(settle(counts, "hosts"), "host").withColumn("size", F.size("elements") + F.size("texts"))
    frame = valid.where((F.col("times") == F.col("pages")) & (F.col("pages") >= FRAME * F.col("n")))
    frame = frame.select("host", F.explode("elements").alias("e")).select("host", F.col("e.path").alias("path"), F.col("e.words").alias("words"))
    constant = valid.where((F.col("pages") >= CONSTANT * F.col("n")) & (F.col("size") > 1)).select("host", F.explode("texts").alias("t"))
    constant = settle(constant.select("host", "t.path", "t.text_code", "t.words"), "constants")
    # Words of the slots under each element of the frame: all words less those of the template's texts there.
    fixed = constant.alias("c").join(frame.alias("f"), F.expr("c.host = f.host and (c.path = f.path or startswith(c.path, f.path || '>'))"))
    fixed = fixed.groupBy("f.host", "f.path").agg(F.sum("c.words").alias("fixed"))
    free = frame.join(fixed, ["host", "path"], "left")
    free = free.select("host", "path", (F.col("words") - F.coalesce("fixed", F.lit(0))).alias("words")).where("words > 0")
    most = free.groupBy("host").agg(F.max("words").alias("most"))
    depth = F.size(F.split("path", ">"))
    deep = free.join(most, "host").where(F.col("words") == F.col("most")).groupBy("host").agg(
        F.max(F.struct(depth.alias("d"), F.col("words"), F.col("path"))).alias("m")
    )
    texts = constant.groupBy("host").agg(F.collect_set("text_code").alias("constants"))
    return settle(deep.join(texts, "host", "full").select("host", F.col("m.path").alias("main"), "constants"), "templates")


def main_text(page: str | None, main: str | None, constants: frozenset) -> str:
    found = page_blocks(page)
    if main is None or not any(p == main or p.startswith(main + ">") for p, _ in found):
        main = ""  # no template, or a page that does not follow it: the whole page
    kept, shut = [], closed(found)
    for path, text in found:
        inside = path == main or path.startswith(main + ">")
        if inside and is_open(path, shut, main) and _text_code(path, text) not in constants:
            kept.append(text)
    return " ".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets: dict[str, frozenset] = {}  # of the hosts at hand: their rows repeat the same list
        width = batch.num_columns
        out = []
        hosts, pages, mains = (batch.column(width - k).to_pylist() for k in (4, 3, 2))
        lists = batch.column(width - 1)
        for k, (host, page, main) in enumerate(zip(hosts, pages, mains)):
            if host not in sets:
                sets[host] = frozenset(lists[k].as_py() or ())
            own = sets[host]
            out.append(main_text(page, main, own))
        yield pa.record_batch(
            [*batch.columns[: width - 4], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
            names=[*batch.schema.names[: width - 4], "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null or empty html, and a page without main text, give the empty text. Pages without a host in their URL share the
    template of the empty host. Unclosed elements end with what holds them; an unfinished tag or comment at the end of a
    page is left out. Repeated rows are kept, other columns are not.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("_host"), F.col("html").cast("string").alias("_html"))
    joined = rows.join(deduce(pages).withColumnRenamed("host", "_of"), F.col("_host") == F.col("_of"), "left")
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return joined.select("page_id", "url", "_host", "_html", "main", "constants").mapInArrow(_extract, f"{kinds}, text string, n_chars long")
