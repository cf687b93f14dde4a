"""Documents to page-anchored chunks and back to typed blocks.

A document is a row with an array of pages (or of its chunks), so nothing is shuffled. Furniture, blocks and types are array
expressions; the cutting of pages and the joining of overlapping texts are small helpers in Python over Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequential import LEAST_OVERLAP, MOST_OVERLAP, lifted, without_overlap

#: Sizes in characters.
WINDOW, OVERLAP, SMALL, CARRIED, LOOK_BACK, PATH = 4000, 600, 250, 40, 200, 120
#: Headers, furniture, and disclaimers with what ends them.
HEADER = r'(?mdU)^\s*([IVX]+\.|[A-Z]\.|Option \d+[.:])\s+([A-Z0-9"(].{1,119})$'
FURNITURE = (
    r"(?iU)^\s*Contains Nonbinding Recommendations\s*$",
    r"(?iU)^\s*Draft\s*[-–—]\s*Not for Implementation\s*$",
    r"(?U)^\s*Recommended\s+[A-Z][a-z]{2,8}\.?\s+\d{4}\b.{0,120}?\s\d{1,3}\s*$",
)
DISCLAIMERS = (
    "This draft guidance, when finalized",
    "guidance documents do not establish legally enforceable responsibilities",
    "do not have the force and effect of law",
)
DISCLAIMER_ENDS = r"[^\S\n]*(?:Active Ingredient|[IVX]+\.\s|[A-Z]\.\s|Option \d)"
_LINES = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]"
_SENTENCE_END = re.compile(r"[.!?:]['\")\]]?\s")


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _let(value: Column, f) -> Column:
    return F.transform(F.array(value), f)[0]


def line_key(line: Column) -> Column:
    """What makes lines of different pages the same: the text without a page number at its end."""
    return F.regexp_replace(_strip(line), r"(?U)\s+\d{1,3}$", "")


def without_furniture(pages: Column) -> Column:
    """Pages without repeated lines (on three fifths of the pages, three at least), fixed furniture and disclaimers."""
    lines = F.transform(pages, lambda p: F.split(p, _LINES, -1))
    keys = F.array_sort(F.flatten(F.transform(lines, lambda page: F.array_distinct(F.filter(F.transform(page, line_key), lambda k: k != "")))))
    need = F.greatest(F.lit(3), F.ceil(F.size(pages) * 0.6).cast("int"))

    def repeated(v: Column) -> Column:
        # of sorted keys one is repeated if the same key is need - 1 places further on
        some = F.transform(F.sequence(F.lit(1), F.size(v["keys"]) - v["need"] + 1), lambda i: F.when(v["keys"][i - 1] == v["keys"][i + v["need"] - 2], v["keys"][i - 1]))
        return F.when(F.size(v["keys"]) >= v["need"], F.array_distinct(F.array_compact(some))).otherwise(F.array().cast("array<string>"))

    fixed = lambda x: reduce(lambda a, b: a | b, (x.rlike(p) for p in FURNITURE))
    said = "|".join(re.escape(d) for d in DISCLAIMERS).replace(r"\ ", " ")
    disclaimer = rf"(?m)^[^\n]*(?:{said})[^\n]*(?:\n(?![^\S\n]*$)(?!{DISCLAIMER_ENDS})[^\n]*)*\n?"

    def clean(v: Column) -> Column:
        kept = F.transform(v["lines"], lambda page: F.array_join(F.filter(page, lambda x: ~F.array_contains(v["repeated"], line_key(x)) & ~fixed(x)), "\n"))
        return F.transform(kept, lambda p: F.regexp_replace(p, disclaimer, ""))

    found = _let(F.struct(keys.alias("keys"), need.alias("need")), repeated)
    return _let(F.struct(lines.alias("lines"), found.alias("repeated")), clean)


SECTION = "struct<path:string,body:string>"


def sections(page: Column) -> Column:
    """array<struct<path, body>>: a page cut at its headers; what stands before the first has no path of its own."""
    mark = lambda g: F.regexp_extract_all(page, F.lit(HEADER), F.lit(g))
    path = F.zip_with(mark(1), mark(2), lambda m, h: F.substring(F.concat(F.rtrim(m, F.lit(".")), F.lit(" "), _strip(h)), 1, PATH))
    gaps = F.split(page, HEADER, -1)
    bodies = F.zip_with(gaps, F.concat(F.array(F.lit("")), mark(0)), lambda gap, hit: F.concat(hit, gap))
    cut = F.zip_with(F.concat(F.array(F.lit(None).cast("string")), path), bodies, lambda p, b: F.struct(p.alias("path"), _strip(b).alias("body")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("path"), page.alias("body")))
    return F.when(page.rlike(HEADER), F.filter(cut, lambda s: s["body"] != "")).otherwise(whole)


def merged(parts: Column) -> Column:
    """Sections under SMALL characters go into the next one of the page, the last of them into the one before."""
    none = F.lit(None).cast(SECTION)
    start = F.struct(F.array().cast(f"array<{SECTION}>").alias("out"), none.alias("held"))
    both = lambda a, b: F.concat(a, F.lit("\n"), b)

    def step(a: Column, x: Column) -> Column:
        held = a["held"]
        has_text = held["path"].isNotNull() & (F.length(_strip(F.regexp_replace(held["body"], r"^[^\n]*\n?", ""))) >= CARRIED)
        one = F.when(held.isNull(), x).otherwise(F.struct(F.when(has_text | x["path"].isNull(), held["path"]).otherwise(x["path"]).alias("path"), both(held["body"], x["body"]).alias("body")))
        put = lambda y: F.when(F.length(y["body"]) < SMALL, F.struct(a["out"].alias("out"), y.alias("held"))).otherwise(F.struct(F.concat(a["out"], F.array(y)).alias("out"), none.alias("held")))
        return _let(one.cast(SECTION), put)

    def done(a: Column) -> Column:
        last = F.try_element_at(a["out"], F.lit(-1))
        grown = F.struct(last["path"].alias("path"), both(last["body"], a["held"]["body"]).alias("body"))
        return F.when(a["held"].isNull(), a["out"]).when(F.size(a["out"]) == 0, F.array(a["held"])).otherwise(F.concat(F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(grown)))

    return F.aggregate(parts, start, step, done)


def windows(body: str, size: int = WINDOW, overlap: int = OVERLAP) -> list[str]:
    """Overlapping windows that end at a sentence, else a space, within the last LOOK_BACK characters, and start at a word."""
    ends = [m.end() for m in _SENTENCE_END.finditer(body)]
    begins = [m.start() for m in _SENTENCE_END.finditer(body)]
    spaces = [m.start() for m in re.finditer(" ", body)]
    out, at = [], 0
    while at + size < len(body):
        hard = at + size
        floor = max(at + 1, hard - LOOK_BACK)
        sentence, space = bisect_right(ends, hard) - 1, bisect_left(spaces, hard) - 1
        if sentence >= 0 and begins[sentence] >= floor:
            stop = ends[sentence]
        else:
            stop = spaces[space] + 1 if space >= 0 and spaces[space] >= floor else hard
        out.append(body[at:stop])
        at = max(stop - overlap, at + 1)
        word = bisect_left(spaces, at)
        if not body[at - 1].isspace() and word < len(spaces) and spaces[word] < stop:
            at = spaces[word] + 1
    return [*out, body[at:]]


_HEADER = re.compile(HEADER.removeprefix("(?mdU)"), re.MULTILINE)


def page_chunks(text: str | None, path: str | None) -> tuple[list[tuple[str | None, str]], str | None]:
    """((path, text) of one page's chunks, the path that goes on) after pages that left path: chunks() for pages that come one by one."""
    if not (text or "").strip():
        return [], path
    marks = list(_HEADER.finditer(text))
    starts = [0, *(m.start() for m in marks), len(text)]
    own = [None, *(f"{m[1].rstrip('.')} {m[2].strip()}"[:PATH] for m in marks)]
    parts = [(p, body.strip()) for p, a, b in zip(own, starts, starts[1:]) if (body := text[a:b]).strip()] if marks else [(None, text)]
    joined: list[tuple[str | None, str]] = []
    held = None
    for p, body in ((p or path, body) for p, body in parts):
        if held:
            spoken = held[0] is not None and len(held[1].partition("\n")[2].strip()) >= CARRIED
            p, body = held[0] if spoken or p is None else p, f"{held[1]}\n{body}"
        held = (p, body) if len(body) < SMALL else None
        if not held:
            joined.append((p, body))
    if held:
        joined[-1:] = [(joined[-1][0], f"{joined[-1][1]}\n{held[1]}")] if joined else [held]
    return [(p, w.strip()) for p, body in joined for w in windows(body) if w.strip()], parts[-1][0] or path


def chunks(pages: Column, strip: bool = False) -> Column:
    """array<struct<page, section_path, text>> of an array of pages. A section's path goes on over page breaks, a chunk never
    does; blank pages and null pages hold nothing."""
    pages = F.transform(F.coalesce(pages, F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")))
    pages = without_furniture(pages) if strip else pages
    parts = F.transform(pages, lambda p, i: F.struct((i + 1).cast("int").alias("page"), sections(p).alias("parts"), _strip(p).alias("text")))
    parts = F.filter(parts, lambda p: p["text"] != "")
    lasts = lambda v: F.transform(v, lambda p: F.try_element_at(p["parts"], F.lit(-1))["path"])

    def inherited(v: Column) -> Column:
        before = lambda i: F.try_element_at(F.filter(F.slice(v["lasts"], 1, i), lambda x: x.isNotNull()), F.lit(-1))
        own = lambda p, path: merged(F.transform(p["parts"], lambda s: F.struct(F.coalesce(s["path"], path).alias("path"), s["body"].alias("body")).cast(SECTION)))
        return F.transform(v["parts"], lambda p, i: F.struct(p["page"].alias("page"), own(p, before(i)).alias("parts")))

    whole = _let(parts, lambda v: _let(F.struct(v.alias("parts"), lasts(v).alias("lasts")), inherited))
    flat = F.flatten(F.transform(whole, lambda p: F.transform(p["parts"], lambda s: F.struct(p["page"].alias("page"), s["path"].alias("section_path"), s["body"].alias("body")))))
    return flat


def chunked(documents: DataFrame, strip: bool = False, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """documents: keys, pages (array) -> keys, page, section_path, ordinal, text. Pages are cut one after another by page_chunks(), in the
    partitions where they are; what it gives are chunked_by_columns()' rows in half the time."""
    pages = F.transform(F.coalesce("pages", F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")))
    rows = documents.select(*keys, (without_furniture(pages) if strip else pages).alias("pages"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for row, texts in enumerate(batch.column(len(keys)).to_pylist()):
                path, before = None, len(found)
                for number, page in enumerate(texts, 1):
                    made, path = page_chunks(page, path)
                    found += [(number, p, len(found) - before + i, t) for i, (p, t) in enumerate(made)]
                at += [row] * (len(found) - before)
            columns = list(zip(*found)) if found else [()] * 4
            own = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keys))]
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*own, *made], names=[*keys, "page", "section_path", "ordinal", "text"])

    return rows.mapInArrow(run, f"{kinds}, page int, section_path string, ordinal int, text string")


def chunked_by_columns(documents: DataFrame, strip: bool = False, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """chunked() by array expressions, but for the windows of long bodies."""
    cut = lifted(lambda bodies: [windows(b) for b in bodies], "array<array<string>>")
    rows = documents.select(*keys, chunks(F.col("pages"), strip).alias("_s"))
    rows = rows.withColumn("_w", cut(F.transform("_s", lambda s: s["body"])))
    made = F.flatten(F.zip_with("_s", "_w", lambda s, w: F.transform(w, lambda t: F.struct(s["page"].alias("page"), s["section_path"].alias("section_path"), _strip(t).alias("text")))))
    return rows.select(*keys, F.posexplode(F.filter(made, lambda c: c["text"] != "")).alias("ordinal", "c")).select(*keys, "c.page", "c.section_path", "ordinal", "c.text")


# --- blocks of a document, from its chunks -----------------------------------------------------------------------------

#: Bounds of blocks, and the slack and least width of the rule that tells full lines from short ones.
MOST_BLOCKS, MOST_CHARS, SLACK, LEAST_WIDTH = 600, 8000, 8, 40
#: Dates, block headings, labels with their rest, numbered lines, list items, and lines that begin with a page number.
MONTH = r"(?U)^\s*(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\s*$"
BLOCK_HEAD = r"(?U)^\s*(?:[IVX]+\.|[A-Z]\.|Option \d+[.:])\s+\S"
LABEL = r"(?U)^\s*([A-Z][A-Za-z0-9 ,/()'\-]{1,60}):\s*"
NUMBERED, ITEM, PAGED = r"(?U)^\s*\d{1,2}\.\s+\S", r"(?U)^\s*[•·●*–—-]\s+\S", r"(?U)^\s*\d{1,2}\s+(?=[A-Z(\d])"
BLOCK = "struct<type:string,page:int,text:string>"


def page_texts(rows: list[dict]) -> list[dict]:
    """Texts by page from chunks in order of page and ordinal, without the overlaps of neighbours."""

    def extend(text: str, more: str) -> str:
        more = more if not text else without_overlap(text, more, LEAST_OVERLAP, MOST_OVERLAP).lstrip()
        return "\n".join(x for x in (text, more) if x.strip())

    ordered = sorted((r["page"], r["ordinal"], (r["text"] or "").strip("\n")) for r in rows)
    return [{"page": p, "text": reduce(extend, (t for *_, t in group), "")} for p, group in groupby(ordered, lambda r: r[0])]


def text_width(lengths: Column) -> Column:
    """The 90th percentile of line lengths, by truncated index; 0 without lines."""
    return F.coalesce(F.try_element_at(F.array_sort(lengths), (F.floor((F.size(lengths) - 1) * 0.9) + 1).cast("int")), F.lit(0))


def blocks(pages: Column) -> Column:
    """array<struct<type, page, text>> of pages (array<struct<page, text>>): lines that go on are joined, types told by form."""
    squeeze = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    lines = F.filter(F.flatten(F.transform(pages, lambda p: F.transform(F.split(p["text"], _LINES, -1), lambda x: F.struct(p["page"].alias("page"), squeeze(x).alias("text"))))), lambda x: x["text"] != "")

    def described(v: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            t, before = x["text"], F.when(i > 0, v["lines"][i - 1]["text"])
            starts = reduce(lambda a, b: a | b, (t.rlike(p) for p in (BLOCK_HEAD, LABEL, MONTH, NUMBERED, ITEM, PAGED)))
            kind = F.when(i == 0, "title").when(t.rlike(MONTH) | t.rlike(PAGED), "meta").when(t.rlike(BLOCK_HEAD) | t.rlike(LABEL + "$"), "h2").otherwise("p")
            full = before.rlike(r"[.:;!?]$") | (before.rlike(LABEL) & ~before.endswith(","))
            ended = (v["width"] >= LEAST_WIDTH) & (F.length(before) < v["width"] - SLACK) & t.rlike(r"^\p{Lu}") & full
            return F.struct(kind.alias("type"), x["page"].alias("page"), t.alias("text"), (starts | F.coalesce(ended, F.lit(False))).alias("starts"))

        return F.transform(v["lines"], one)

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        same_page = (x["page"] == last["page"]) | ((last["type"] == "p") & ~last["text"].rlike(r"[.:?!]\s*$"))
        goes_on = ~x["starts"] & ~last["type"].isin("title", "h2") & ~last["text"].rlike(MONTH) & same_page & (F.length(last["text"]) < MOST_CHARS)
        longer = F.struct(last["type"].alias("type"), last["page"].alias("page"), F.concat(last["text"], F.when(last["text"].endswith("-"), "").otherwise(" "), x["text"]).alias("text"))
        new = F.struct(x["type"].alias("type"), x["page"].alias("page"), x["text"].alias("text"))
        return F.when(F.coalesce(goes_on, F.lit(False)), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(out, F.array(new))).cast(f"array<{BLOCK}>")

    width = lambda v: text_width(F.transform(v, lambda x: F.length(x["text"])))
    known = _let(lines, lambda v: _let(F.struct(v.alias("lines"), width(v).alias("width")), described))
    return F.slice(F.aggregate(known, F.array().cast(f"array<{BLOCK}>"), step), 1, MOST_BLOCKS)


def rebuilt_documents(chunks: DataFrame) -> DataFrame:
    """chunks: doc_id, page, ordinal, text -> doc_id and blocks in reading order."""
    one = F.struct(F.coalesce("page", F.lit(1)).alias("page"), F.coalesce("ordinal", F.lit(0)).alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"))
    rows = chunks.groupBy("doc_id").agg(F.collect_list(one).alias("rows"))
    pages = rows.select("doc_id", lifted(page_texts, "array<struct<page:int,text:string>>")("rows").alias("pages"))
    return pages.select("doc_id", blocks(F.col("pages")).alias("blocks"))
