"""Accounts filings: facts from XBRL and inline XBRL documents, resolved into one wide row per filing and period.

A document is taken apart where its archive entry is unpacked. All its facts are at hand there, so the best fact of each
column is picked there too, and one row per report period leaves the task; nothing is shuffled before the rows of a load
are made unique. ``resolve_tags`` answers the same question for facts that come as a table.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlake.functions.dates import filing_date
from firmlake.functions.filing import name_facts, number
from firmlake.functions.hashing import row_hash
from firmlake.schemas import COUNT_TAGS, FINANCIAL_DATA, FINANCIAL_HASH, MONEY_TAGS, TEXT_TAGS, conform
from firmlake.sources.archives import dicts, list_entries, read_archives, read_entries
from firmlake.sources.tags import candidates, tag_dictionary

XBRL_EXTENSIONS = ["xml", "xbrl"]
IXBRL_EXTENSIONS = ["html", "htm"]
SOURCE = "bulk_xbrl"

PLACE = ["archive", "entry", "pos", "inner_pos"]
PERIODS = (
    "archive string, entry string, pos long, inner_pos long, company_number string, reject string, period string, "
    "start string, n_facts int, found map<string, struct<raw string, factor double>>"
)
PERIOD_FIELDS = pa.schema(
    [("archive", pa.string()), ("entry", pa.string()), ("pos", pa.int64()), ("inner_pos", pa.int64()), ("company_number", pa.string()),
     ("reject", pa.string()), ("period", pa.string()), ("start", pa.string()), ("n_facts", pa.int32()),
     ("found", pa.map_(pa.string(), pa.struct([("raw", pa.string()), ("factor", pa.float64())])))]
)
ROWS_PER_BATCH = 5_000
KNOWN_TAGS = 1 << 14  # openings and names kept as they were read: filings of one program repeat them
KNOWN_SHAPES = 1 << 8  # orders of a period's tags
NOWHERE = (None, None)
# A number as ``functions.filing.number`` reads one: separators may stand anywhere in it.
PLAIN_NUMBER = re.compile(r"S*(?:[+-]S*)?(?:D(?:\.[\dS]*)?|\.S*D)(?:[eE]S*(?:[+-]S*)?D)?".replace("D", r"\d[\dS]*").replace("[\\dS]", r"[\d, \t\r\n]").replace("S", r"[, \t\r\n]"), re.ASCII)

# Elements of an XBRL document that are structure and not facts.
STRUCTURE = {
    "context", "schemaRef", "unit", "entity", "identifier", "period", "startDate", "endDate", "instant", "segment",
}

CONTEXT_END = re.compile(r"<(?:\w+:)?(?:endDate|instant)\s*>([^<]+)<", re.I)
IDENTIFIER = re.compile(r"<(?:xbrli:)?identifier[^>]*>([^<]+)</", re.I)
OPENS, CLOSES = re.compile(r"<(?:\w+:)?"), re.compile(r"</(?:\w+:)?")
PREFIX = 256  # longest text between a "<" and a local name
# How the elements that are read usually begin, by their local names in lower case.
USUAL = {"context": "<xbrli:context", "nonfraction": "<ix:nonFraction", "nonnumeric": "<ix:nonNumeric"}
AFTER_NAME = {"", " ", "\t", "\r", "\n"}
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}  # for texts that grow when all their letters are lowered
ATTRIBUTE = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
INNER_TAG = re.compile(r"<[^>]*>")


@lru_cache(KNOWN_TAGS)
def _local(tag: str) -> str:
    return tag.split("}" if "}" in tag else ":", 1)[-1].lower()


def _attributes(opening: str) -> dict[str, str]:
    return {name.lower(): a or b for name, a, b in ATTRIBUTE.findall(opening)}


def _factor(attributes: dict[str, str]) -> float:
    """What an inline number is multiplied with according to its sign and scale."""
    scale = attributes.get("scale", "0")
    power = int(scale) if re.fullmatch(r"-?\d{1,2}", scale) else 0
    return (-1.0 if attributes.get("sign") == "-" else 1.0) * 10.0**power


@lru_cache(KNOWN_TAGS)
def _heading(opening: str, is_text: bool) -> tuple[tuple | None, bool]:
    """Head of a fact by its opening, none without name or context, and whether the name comes before the context."""
    attributes = _attributes(opening)
    order = list(attributes)
    tag, context = attributes.get("name"), attributes.get("contextref")
    if not tag or not context:
        return None, False
    return (tag, context, is_text, 1.0 if is_text else _factor(attributes)), order.index("name") < order.index("contextref")


@lru_cache(KNOWN_TAGS)
def _id(opening: str) -> str | None:
    return _attributes(opening).get("id")


@lru_cache(KNOWN_TAGS)
def _side(mark: str) -> int:
    """What stands between a ``<``, itself included, and a local name: 1 begins an opening, 2 a closing, 0 neither."""
    return 1 if OPENS.fullmatch(mark) else 2 if CLOSES.fullmatch(mark) else 0


def _elements(text: str, low: str, name: str, closed: bool):
    """(opening, content) of the elements of one local name; ``low`` is the text in lower case.

    An element ends with the first closing of its name; openings before that belong to its content. One without a closing
    is none, and neither is a self-closed one if ``closed`` says so. The text is looked through once, whatever it holds.
    """
    at, shut = 0, name + ">"
    while (begin := low.find(name, at)) >= 0:
        at = begin + len(name)
        if _side(low[low.rfind("<", begin - PREFIX if begin > PREFIX else 0, begin) : begin]) != 1:
            continue
        end = text.find(">", at)
        if end < 0:
            return
        after, last = low[at], text[end - 1]
        if (closed and last == "/") or after.isalnum() or after == "_":
            continue
        start = low.find(shut, end + 1)
        while start >= 0 and _side(low[(stop := low.rfind("<", max(end + 1, start - PREFIX), start)) : start]) != 2:
            start = low.find(shut, start + 1)
        if start < 0:
            return
        yield text[at:end], text[end + 1 : stop]
        at = start + len(name)


def _cut(text: str, low: str, name: str, closed: bool):
    """What ``_elements`` gives, cut out at one go where the name stands in usual openings and closings only and no element
    holds another one or lacks its closing. Any other text is left to ``_elements``."""
    usual = USUAL[name]
    shut = f"</{usual[1:]}>"
    chunks = text.split(usual)
    found, names = [], 0
    for k in range(1, len(chunks)):
        opening, end, rest = chunks[k].partition(">")
        if not end or opening[:1] not in AFTER_NAME:
            break
        if closed and opening[-1:] == "/":
            names += 1
            continue
        content, end, _ = rest.partition(shut)
        if not end:
            break
        names += 2
        found.append((opening, content))
    # Every name must be one of these, but for references to contexts: a name that goes on is no element.
    if names != low.count(name) - (low.count("contextref") if name == "context" else 0):
        return _elements(text, low, name, closed)
    return found


def _plain(content: str) -> str:
    return (INNER_TAG.sub("", content) if "<" in content else content).strip()


def _read_inline(body: bytes):
    """(company, context id -> (end, start), facts) of an inline document.

    Facts are (head, content) with the head (tag, context, is text, factor), in the order in which later ones replace earlier
    ones: numbers whose name comes before the context, the other numbers, texts. Empty, self-closed elements are not facts.
    """
    text = body.decode("utf-8", "ignore")
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(LOWER)
    company = IDENTIFIER.search(text)
    contexts, early, late = {}, [], []
    for opening, content in _cut(text, low, "context", False):
        end, name = CONTEXT_END.search(content), _id(opening)
        if name and end:
            contexts[name] = (end[1].strip(), None)
    for opening, content in _cut(text, low, "nonfraction", True):
        head, name_first = _heading(opening, False)
        if head:
            (early if name_first else late).append((head, _plain(content)))
    for opening, content in _cut(text, low, "nonnumeric", True):
        head, _ = _heading(opening, True)
        if head:
            late.append((head, _plain(content)))
    return (company[1].strip() if company else None), contexts, early + late


@lru_cache(KNOWN_TAGS)
def _element(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _read_xbrl(body: bytes):
    """The same of an XBRL document, whose facts may be numbers or texts."""
    contexts, facts, company, registered = {}, [], None, None
    for e in ET.fromstring(body).iter():
        name, text = _element(e.tag), (e.text or "").strip()
        if name == "context" and e.get("id"):
            inner: dict[str, str | None] = {}
            for x in e.iter():
                inner.setdefault(_element(x.tag), x.text)
            end = inner.get("endDate") or inner.get("instant")
            if end:
                contexts[e.get("id")] = (end.strip(), inner.get("startDate"))
        elif name == "identifier" and company is None and len(text) == 8 and (text.isdigit() or text[:2].isalpha()):
            company = text
        elif name == "CompaniesHouseRegisteredNumber" and registered is None and text:
            registered = text
        if text and name and name not in STRUCTURE:
            facts.append(((e.tag, e.get("contextRef"), None, 1.0), text))
    return company or registered, contexts, facts


def _is_number(text: str) -> bool:
    """Is it a number as ``functions.filing.number`` reads one?"""
    return (text.isascii() and text.isdigit()) or PLAIN_NUMBER.fullmatch(text) is not None


def _choice(heads: tuple[tuple, ...], numbers: tuple[bool, ...], accepted: dict) -> tuple[int, list[str], list[int]]:
    """Number of facts that some column takes, the columns, and which fact is the best of each.

    The facts of one period in order, by their heads and by whether they are numbers. Candidates go by being a number, then
    by priority; among equal ones the tag seen first counts, with the last value it was given. Number columns take numbers
    only, text columns take any text; a number element whose content is no number is no fact.
    """
    tags: dict[tuple, list] = {}
    for n, ((tag, _, is_text, _), is_number) in enumerate(zip(heads, numbers)):
        if is_number or is_text is not False:
            seen = tags.setdefault((_local(tag), tag, is_number), [n, 0, n])
            seen[1:] = seen[1] + 1, n
    count, best = 0, {}
    for (local, _, is_number), (first, times, last) in tags.items():
        for column, priority, numeric in accepted[local]:
            if is_number or not numeric:
                count += times
                rank = (not is_number, priority, first)
                if column not in best or rank < best[column][0]:
                    best[column] = (rank, last)
    return count, list(best), [last for _, last in best.values()]


def _rows(e: dict, body: bytes | None, accepted: dict, choose, apply_sign_scale: bool):
    """One row per report period of a document, or one with a reject reason; its facts are (columns, contents, factors).

    A filing whose name tells its period gives that one record in any case, another filing one record for every period
    with a number, be it one that no column takes.
    """
    place = (e["archive"], e["entry"], e["pos"], e["inner_pos"])
    company, named = name_facts(e["entry"] or "")
    reject, contexts, facts = e["reject"], {}, []
    if reject is None:
        try:
            is_xbrl = e["extension"] in XBRL_EXTENSIONS
            found, contexts, facts = _read_xbrl(body) if is_xbrl else _read_inline(body)
            company = company or found
            reject = None if company else "no company number"
        except Exception as error:  # whatever one document fails with costs that document only
            reject = f"document: {error}"
    if reject is not None:
        yield (*place, company, reject, None, None, None, None)
        return
    if named:
        opened = [named.isoformat()]
    else:
        ends = set()
        for (_, context, is_text, _), raw in facts:
            end = contexts.get(context, NOWHERE)[0]
            if end is not None and not is_text and end not in ends and _is_number(raw):
                ends.add(end)
        opened = sorted(ends)
    periods: dict[str, list] = {end: [] for end in opened}
    for fact in facts:
        head = fact[0]
        if _local(head[0]) in accepted:
            own = periods.get(contexts.get(head[1], NOWHERE)[0])
            if own is not None:
                own.append(fact)
    starts: dict[str, str] = {}
    for end, start in contexts.values():
        if start:
            starts[end] = max(starts.get(end, ""), start.strip())
    for end, own in periods.items():
        numbers = tuple([not head[2] and _is_number(raw) for head, raw in own])
        count, columns, chosen = choose(tuple([head for head, _ in own]), numbers)
        factors = [own[k][0][3] if apply_sign_scale else 1.0 for k in chosen]
        yield (*place, company, None, end, starts.get(end), count, (columns, [own[k][1] for k in chosen], factors))


def period_converter(apply_sign_scale: bool = False, dictionary: dict[str, list[str]] | None = None):
    """Turns entries into Arrow batches of PERIODS."""
    accepted = candidates(dictionary)

    def batch(rows):
        *columns, found = zip(*rows) if rows else ([] for _ in PERIOD_FIELDS)
        arrays = [pa.array(c, f.type) for c, f in zip(columns, PERIOD_FIELDS)]
        ends, names, raws, factors = [], [], [], []
        for best in found:
            ends.append(None if best is None else len(names))
            if best is not None:
                names += best[0]
                raws += best[1]
                factors += best[2]
        values = pa.StructArray.from_arrays([pa.array(raws, pa.string()), pa.array(factors, pa.float64())], fields=list(PERIOD_FIELDS.field("found").type.item_type))
        offsets = pa.array([*ends, len(names)], pa.int32())
        arrays.append(pa.MapArray.from_arrays(offsets, pa.array(names, pa.string()), values, type=PERIOD_FIELDS.field("found").type))
        return pa.RecordBatch.from_arrays(arrays, schema=PERIOD_FIELDS)

    def convert(documents):
        # Filings of one program have the same tags in the same order: which fact is best is found out once.
        choose = lru_cache(KNOWN_SHAPES)(lambda heads, numbers: _choice(heads, numbers, accepted))
        rows = []
        for e, body in documents:
            rows.extend(_rows(e, body, accepted, choose, apply_sign_scale))
            if len(rows) >= ROWS_PER_BATCH:
                yield batch(rows)
                rows = []
        yield batch(rows)

    return convert


def document_periods(documents: DataFrame, apply_sign_scale: bool = False, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """Periods of documents that are rows already: archive, entry, pos, inner_pos, extension, body and reject."""
    convert = period_converter(apply_sign_scale, dictionary)
    rows = documents.select(*PLACE, "extension", "body", "reject")
    return rows.mapInArrow(lambda batches: convert((e, e["body"]) for b in batches for e in dicts(b)), PERIODS)


def resolve_tags(
    facts: DataFrame, keys: list[str], dictionary: DataFrame | None = None, carry: dict[str, str] | None = None
) -> DataFrame:
    """Best fact of every column per group: ``(keys, column, raw, value, facts)``.

    Candidate tags go by priority; among equal ones the tag seen first counts, with the last value it was given. Number
    columns take numbers only, text columns take any text. ``facts`` has the keys, n, tag, local, raw and value. Tags
    outside the dictionary are dropped before anything is shuffled; a NULL tag gives a row with NULL column, so that its
    group survives. ``carry`` names further columns and how to sum them up (min or max). ``tag_dictionary`` and
    ``read_tag_dictionary`` give frames that are broadcast; any other one is joined as its size calls for.
    """
    known = tag_dictionary(facts.sparkSession) if dictionary is None else dictionary
    known = known.withColumnRenamed("tag", "local")
    carried = [F.expr(f"{how}({c})").alias(c) for c, how in (carry or {}).items()]
    is_number = F.col("value").isNotNull()
    rows = facts.join(known, "local", "left").where(
        F.col("tag").isNull() | (F.col("column").isNotNull() & (~F.col("numeric") | is_number))
    )
    per_tag = rows.groupBy(*keys, "column", "priority", "local", "tag", is_number.alias("is_number")).agg(
        F.min("n").alias("first_n"), F.max_by(F.struct("raw", "value"), "n").alias("last"),
        F.count("tag").alias("facts"), *carried,
    )
    best = F.min_by("last", F.struct(~F.col("is_number"), "priority", "first_n"))
    found = per_tag.groupBy(*keys, "column").agg(best.alias("best"), F.sum("facts").alias("facts"), *carried)
    return found.select(*keys, "column", "best.raw", "best.value", "facts", *(carry or {}))


def wide_records(periods: DataFrame) -> DataFrame:
    """One row per filing and report period with a column per dictionary entry: a projection of PERIODS."""

    def raw(column: str):
        return F.expr(f"try_element_at(found, '{column}').raw")

    def value(column: str):
        factor = F.expr(f"try_element_at(found, '{column}').factor")
        plain = number(raw(column))
        return F.when(factor == 1, plain).otherwise((plain.cast("double") * factor).try_cast("decimal(38,6)"))

    rows = periods.withColumn("period_end", F.try_to_date("period", "yyyy-MM-dd")).where("reject is not null or period_end is not null")
    start = F.coalesce(filing_date(raw("period_start")), F.try_to_date("start", "yyyy-MM-dd"))
    return rows.select(
        *PLACE, "company_number", "period_end", "n_facts", "reject", start.alias("period_start"),
        *[value(c).try_cast("decimal(15,2)").alias(c) for c in MONEY_TAGS],
        *[value(c).try_cast("int").alias(c) for c in COUNT_TAGS],
        *[raw(c).alias(c) for c in TEXT_TAGS if c != "period_start"],
        F.lit(SOURCE).alias("source"), F.lit("{}").alias("raw_data"),
    )


def records(periods: DataFrame) -> DataFrame:
    """Table rows of the periods; rows with a ``reject`` reason stand for documents that gave no record."""
    wide = wide_records(periods)
    extra = [wide.schema[c] for c in (*PLACE, "n_facts", "reject")]
    rows = conform(wide, T.StructType([*FINANCIAL_DATA.fields, *extra]))
    return rows.withColumn("data_hash", row_hash(rows, FINANCIAL_HASH))


def parse_documents(documents: DataFrame, apply_sign_scale: bool = False, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    return records(document_periods(documents, apply_sign_scale, dictionary))


def list_filings(paths: DataFrame) -> DataFrame:
    """The filings of the accounts archives in column ``path``, unread."""
    return list_entries(paths, XBRL_EXTENSIONS + IXBRL_EXTENSIONS)


def read_listed(listing: DataFrame, apply_sign_scale: bool = False, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """Records and rejects of listed filings."""
    convert = period_converter(apply_sign_scale, dictionary)
    return records(read_entries(listing, convert, PERIODS, XBRL_EXTENSIONS + IXBRL_EXTENSIONS))


def read_financials(paths: DataFrame, apply_sign_scale: bool = False, dictionary: dict[str, list[str]] | None = None) -> DataFrame:
    """Records and rejects of the accounts archives in column ``path``.

    ``dictionary`` replaces the built-in one: column -> candidate tags, the better ones first.
    """
    convert = period_converter(apply_sign_scale, dictionary)
    return records(read_archives(paths, convert, PERIODS, XBRL_EXTENSIONS + IXBRL_EXTENSIONS))
