"""Deficiency detection over layout documents: pages -> tables, blocks; oracles, checklists, tiering, sections, layout.

A document is a row: doc_id, filename, toc, pages: array<struct<page_number, height, blocks, tables, figures>>."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import squeeze
from ..functions.numbers import collapse_near, inline_limit, limit, measured, satisfies
from ..operators.sets import deduplicated_findings, union_all
from ..operators.windows import carried

BLOCK = "struct<text:string,role:string,page:int,reading_order:int,bbox:array<double>>"
TABLE = "struct<kind:string,title:string,page:int,bbox:array<double>,n_cols:int,headers:array<string>,rows:array<array<string>>,pairs:array<struct<label:string,value:string>>>"
DOCUMENT = f"doc_id long, filename string, pages array<struct<page_number:int,height:double,blocks:array<{BLOCK}>,tables:array<{TABLE}>>>"
FAULT = ["doc_id", "title", "evidence", "page", "table_ref", "evidence_class", "tier", "severity", "confidence", "source"]


def _tables(docs: DataFrame) -> DataFrame:
    p = docs.select("doc_id", F.posexplode("pages").alias("_p", "page"))
    return p.select("doc_id", F.col("page.page_number").alias("page_number"), F.posexplode("page.tables").alias("_t", "t"), "_p")


def _fault(rows: DataFrame, source: str, title: Column, evidence: Column, page: Column, ref: Column, **fixed) -> DataFrame:
    return rows.select("doc_id", title.alias("title"), evidence.alias("evidence"), page.cast("int").alias("page"), F.substring(F.coalesce(ref, F.lit("")), 1, 80).alias("table_ref"), *(F.lit(v).alias(k) for k, v in fixed.items()), F.lit(source).alias("source")).select(*FAULT)


#: Words of limit and result columns.
LIMIT_WORDS, RESULT_WORDS = ("limit", "acceptance", "specification", "criteria", "spec"), ("result", "observed", "found", "obtained")
VERIFIED = {"evidence_class": "code_verified", "tier": "verified", "severity": "high"}


def _column_of(headers: Column, words: tuple[str, ...]) -> Column:
    """1-based index of the first header that contains one of the words, null if none does."""
    hit = F.transform(headers, lambda h: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(F.coalesce(h, F.lit(""))), w)))
    return F.nullif(F.array_position(hit, True), F.lit(0)).cast("int")


def result_against_limit(docs: DataFrame) -> DataFrame:
    """Rows of grids whose result cell violates their limit cell."""
    t = _tables(docs).filter("t.kind = 'grid'").withColumns({"_l": _column_of(F.col("t.headers"), LIMIT_WORDS), "_r": _column_of(F.col("t.headers"), RESULT_WORDS)}).filter("_l is not null and _r is not null")
    r = t.select("*", F.explode("t.rows").alias("row")).withColumns({"_lim": limit(F.try_element_at("row", F.col("_l"))), "_val": measured(F.try_element_at("row", F.col("_r")))})
    bad = r.filter((F.size("row") >= F.greatest("_l", "_r")) & (satisfies(F.col("_val"), F.col("_lim")) == F.lit(False)))
    label = F.trim(F.coalesce(F.try_element_at("row", F.lit(1)), F.lit("")))
    said = F.concat(label, F.lit(": result "), F.try_element_at("row", F.col("_r")), F.lit(" vs limit "), F.try_element_at("row", F.col("_l")))
    return _fault(bad, "oracle:result_vs_limit", F.concat(F.lit("Result out of specification"), F.when(label != "", F.concat(F.lit(" for "), label)).otherwise("")), said, F.col("t.page"), F.col("t.title"), confidence=0.95, **VERIFIED)


def inline_violations(docs: DataFrame) -> DataFrame:
    """Cells 'value (limit)' whose value violates the limit."""
    c = _tables(docs).filter("t.kind = 'grid'").select("*", F.explode("t.rows").alias("row")).select("*", F.explode("row").alias("cell")).withColumn("v", inline_limit(F.col("cell")))
    bad = c.filter(satisfies(F.col("v.value"), F.col("v.limit")) == F.lit(False))
    return _fault(bad, "oracle:value_vs_inline_limit", F.concat(F.lit("Result out of specification -- "), F.trim(F.coalesce(F.try_element_at("row", F.lit(1)), F.lit("")))), squeeze(F.col("cell")), F.col("t.page"), F.col("t.title"), confidence=0.95, **VERIFIED)


def page_texts(docs: DataFrame, titles: bool = False) -> DataFrame:
    """doc_id, page, text: blocks but headers and footers, then the tables' cells or pairs."""
    p = docs.select("doc_id", F.explode("pages").alias("p"))
    body = F.transform(F.filter("p.blocks", lambda b: ~F.coalesce(b["role"], F.lit("")).isin("page_header", "page_footer")), lambda b: F.coalesce(b["text"], F.lit("")))
    pairs = lambda t: F.array_join(F.transform(t["pairs"], lambda x: F.concat_ws(" ", x["label"], x["value"])), " ")
    cells = lambda t: F.array_join(F.transform(t["rows"], lambda r: F.array_join(r, " ", "")), " ")
    title = lambda t: F.coalesce(t["title"], F.lit("")) if titles else F.lit("")
    tables = F.transform("p.tables", lambda t: F.concat_ws(" ", title(t), F.when(t["kind"] == "key_value", F.coalesce(pairs(t), F.lit(""))).otherwise(F.coalesce(cells(t), F.lit("")))))
    return p.select("doc_id", F.col("p.page_number").alias("page"), F.array_join(F.concat(body, tables), " ").alias("text"))


#: Fixed value: a named threshold with its value and unit.
AET = r"(?i)\baet\b[^\d]{0,45}?(\d+(?:\.\d+)?)\s*[µμu]?\s*g\s*/\s*(g|patch)"


def conflicting_thresholds(docs: DataFrame) -> DataFrame:
    """A threshold stated with several values (beyond 1 %) in one unit."""
    p = page_texts(docs)
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(AET), F.lit(1)).alias("v"), F.regexp_extract_all("text", F.lit(AET), F.lit(2)).alias("u"))
    v = p.select("doc_id", "page", F.explode(found).alias("x")).select("doc_id", "page", F.round(F.col("x.v").cast("double"), 3).alias("v"), F.concat(F.lit("ug/"), F.lower("x.u")).alias("unit"))
    g = v.groupBy("doc_id", "unit").agg(F.collect_set("v").alias("vs"), F.min("page").alias("page")).withColumn("vs", collapse_near(F.col("vs"))).filter(F.size("vs") >= 2)
    said = F.concat(F.array_join(F.transform("vs", lambda x: x.cast("string")), ", "), F.lit(" "), F.col("unit"))
    return _fault(g, "oracle:cross_reference_aet", F.lit("AET stated with conflicting values across the document"), said, F.col("page"), F.lit(""), confidence=0.9, **VERIFIED)


#: What a validation report addresses, components of a closure, and wording of a commitment.
VALIDATION = {
    "specificity": ("specificity",), "linearity": ("linearity",), "limit of detection (LOD)": ("limit of detection", "lod"), "limit of quantitation (LOQ)": ("limit of quantitation", "loq"),
    "precision": ("precision", "repeatability"), "accuracy / recovery": ("accuracy", "recovery"), "robustness / ruggedness": ("robustness", "ruggedness"), "system suitability": ("system suitability",),
    "solution stability": ("solution stability", "stability of standard", "stability of sample", "stability of analytical"),
}
COMPONENTS = ("backing film", "release liner", "pouch")
COMMITMENT = r"(?i)commit|continue\s+to\s+monitor|ongoing\s+monitor|monitor[a-z ]{0,30}shelf\s*life|monitor[a-z ]{0,30}through\s+the\s+proposed"
CHECKED = {"evidence_class": "checklist", "tier": "corroborated"}


def document_texts(docs: DataFrame) -> DataFrame:
    t = page_texts(docs, titles=True).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("x"))
    return t.select("doc_id", F.lower(F.array_join(F.transform("x", lambda r: r["text"]), "\n")).alias("text"))


def missing_validation(docs: DataFrame) -> DataFrame:
    """Elements of a validation report that its text never mentions."""
    each = F.array(*(F.struct(F.lit(e).alias("element"), F.array(*map(F.lit, k)).alias("keys")) for e, k in VALIDATION.items()))
    rows = document_texts(docs).select("doc_id", "text", F.explode(each).alias("e")).filter(~F.exists("e.keys", lambda k: F.contains("text", k)))
    return _fault(rows, "checklist:validation", F.concat(F.lit("Validation parameter not addressed: "), "e.element"), F.concat(F.lit("No mention of "), "e.element"), F.lit(0), F.lit(""), severity="medium", confidence=0.6, **CHECKED)


def extractables_reports(docs: DataFrame) -> DataFrame:
    head = F.substring("text", 1, 3000)
    return docs.join(document_texts(docs).filter(F.contains(head, F.lit("extractable")) & F.contains(head, F.lit("leachable"))).select("doc_id"), "doc_id", "left_semi")


def uncovered_components(docs: DataFrame) -> DataFrame:
    """Components without a USP <88> row while others of the same (stitched by title) grid have one."""
    t = _tables(docs).filter("t.kind = 'grid'")
    key = F.coalesce(F.nullif(F.lower(squeeze(F.col("t.title"))), F.lit("")), F.concat(F.lit("__page_"), F.col("page_number").cast("string")))
    r = t.select("doc_id", key.alias("key"), F.col("page_number").alias("page"), "t.title", "_p", "_t", F.posexplode("t.rows").alias("_r", "row"))
    low = F.lower(F.array_join("row", " ", ""))
    said = F.coalesce(*(F.when(F.contains(low, F.lit(c)), c) for c in reversed(COMPONENTS)))
    r = r.withColumns({"_o": F.struct("_p", "_t", "_r"), "_g": F.struct("doc_id", "key"), "component": said, "_88": low.rlike(r"<\s*88\s*>")})
    r = carried(r, "_g", ["_o"], "component").filter("component is not null")
    n = r.groupBy("doc_id", "key", "component").agg(F.bool_or("_88").alias("has"), F.min("page").alias("page"), F.first("title").alias("title"))
    n = n.withColumn("_any", F.max(F.col("has").cast("int")).over(Window.partitionBy("doc_id", "key"))).filter("_any = 1 and not has")
    return _fault(n, "checklist:usp88_coverage", F.concat(F.lit("USP <88> not performed for "), F.initcap("component")), F.concat(F.lit("USP <88> absent for "), "component"), F.col("page"), F.col("title"), severity="high", confidence=0.7, **CHECKED)


def missing_commitment(docs: DataFrame) -> DataFrame:
    rows = document_texts(docs).filter(~F.col("text").rlike(COMMITMENT))
    return _fault(rows, "checklist:leachable_commitment", F.lit("No commitment to continue leachable monitoring"), F.lit("No commitment language found"), F.lit(0), F.lit(""), severity="medium", confidence=0.6, **CHECKED)


ORACLES = (result_against_limit, inline_violations, conflicting_thresholds)


def detected(docs: DataFrame, validation: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """All oracles and checklists (validation: doc_ids of validation sections), and other findings, tiered and deduplicated."""
    reports = extractables_reports(docs)
    found = [o(docs) for o in ORACLES] + [uncovered_components(reports), missing_commitment(reports)]
    if validation is not None:
        found.append(missing_validation(docs.join(validation.select("doc_id"), "doc_id", "left_semi")))
    rows = union_all(*found).withColumns({"section": F.lit(None).cast("string"), "precedents": F.array().cast("array<string>"), "position": F.monotonically_increasing_id()})
    return deduplicated_findings(tiered(rows if more is None else rows.unionByName(more, allowMissingColumns=True), docs))


def _solid(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")


def tiered(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings that neither an oracle nor a checklist made: quote-anchored if their evidence (4 characters without spaces) stands
    in the document, else model judgment; with precedents corroborated (0.6 or 0.5), without advisory (0.4 or 0.3)."""
    blob = document_texts(docs).select("doc_id", _solid(F.col("text")).alias("_b"))
    j = findings.join(blob, "doc_id", "left")
    soft = ~F.col("evidence_class").isin("code_verified", "checklist") | F.col("evidence_class").isNull()
    e = _solid(F.col("evidence"))
    held = (F.length(e) >= 4) & F.coalesce(F.instr(F.col("_b"), e) > 0, F.lit(False))
    known = F.size(F.coalesce("precedents", F.array().cast("array<string>"))) > 0
    return j.withColumns({
        "evidence_class": F.when(soft, F.when(held, "quote_anchored").otherwise("model_judgment")).otherwise(F.col("evidence_class")),
        "tier": F.when(soft, F.when(known, "corroborated").otherwise("advisory")).otherwise(F.col("tier")),
        "confidence": F.when(soft, F.when(known, F.when(held, 0.6).otherwise(0.5)).otherwise(F.when(held, 0.4).otherwise(0.3))).otherwise(F.col("confidence")),
    }).drop("_b")


def challenged(findings: DataFrame, verdicts: DataFrame, docs: DataFrame, most: int = 20) -> DataFrame:
    """verdicts: finding_id, refuted, counter_evidence. The first most soft findings: refuted with evidence that stands in the
    document, confidence times 0.4 and advisory; else plus 0.1, 0.9 at most."""
    soft = F.col("evidence_class").isin("model_judgment", "quote_anchored")
    n = F.when(soft, F.row_number().over(Window.partitionBy("doc_id", soft).orderBy("position")))
    j = findings.withColumn("_n", n).join(verdicts, "finding_id", "left").join(document_texts(docs).select("doc_id", _solid(F.col("text")).alias("_b")), "doc_id", "left")
    asked = F.coalesce(F.col("_n") <= most, F.lit(False)) & F.col("refuted").isNotNull()
    e = _solid(F.col("counter_evidence"))
    grounded = F.col("refuted") & (F.length(e) >= 4) & F.coalesce(F.instr(F.col("_b"), e) > 0, F.lit(False))
    return j.withColumns({
        "confidence": F.when(asked & grounded, F.round(F.col("confidence") * 0.4, 2)).when(asked, F.least(F.round(F.col("confidence") + 0.1, 2), F.lit(0.9))).otherwise(F.col("confidence")),
        "tier": F.when(asked & grounded, "advisory").otherwise(F.col("tier")),
    }).select(findings.columns)


def sections_of_finding(findings: DataFrame, sections: DataFrame) -> DataFrame:
    """finding_id, section_id: by the number of a table referred to, or by headings that contain each other. sections: doc_id,
    section_id, heading, tables (titles)."""
    number = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)table\s*(\d+)", 1), F.lit(""))
    t = sections.select("doc_id", "section_id", F.explode("tables").alias("t")).select("doc_id", "section_id", number(F.col("t")).alias("_n"))
    a = findings.select("doc_id", "finding_id", number(F.col("table_ref")).alias("_n")).join(t, ["doc_id", "_n"]).select("finding_id", "section_id")
    f = findings.filter("section <> ''").select("doc_id", "finding_id", F.lower("section").alias("_s"))
    b = f.join(sections.filter("heading <> ''").select("doc_id", "section_id", F.lower("heading").alias("_h")), "doc_id").filter("instr(_h, _s) > 0 or instr(_s, _h) > 0").select("finding_id", "section_id")
    return a.union(b).distinct()


#: Domains of findings with their keywords, the default three, the cap, and aliases of stored types.
DOMAINS = {
    "method-validation": ("validation", "linearity", "specificity", "system suitability", "lod", "loq"), "impurities": ("impurit", "related compound", "related substance"),
    "elemental-impurities": ("elemental", "q3d", "metal"), "residual-solvents": ("residual solvent", "q3c"), "stability": ("stability",), "dissolution": ("dissolution", "ivrt", "in-vitro"),
    "container-closure": ("leachable", "extractable", "container", "closure", "e&l", "e & l"), "specification": ("specification", "acceptance criteria", "assay", "coa"),
}
FALLBACK, MOST_DOMAINS = ("specification", "method-validation", "impurities"), 8
ALIASES = {
    "specification/coa": "specification", "specification": "specification", "description/compostion": "specification", "method/valdn": "method-validation", "method/validation": "method-validation",
    "impurities": "impurities", "elemental impurities": "elemental-impurities", "stability": "stability", "dissolution": "dissolution", "in-vitro study": "dissolution", "be": "dissolution",
    "container/closure": "container-closure", "extractable / leachable": "container-closure", "leachable": "container-closure", "manufacturing process/ scale-up": "manufacturing-process",
    "in-process controls": "manufacturing-process", "administrative/ facilities": "manufacturing-process", "pdr-qbd (development report)": "development", "characterization/justification": "development",
    "excipients": "development", "anda batch/ reconciliation / 32r": "batch-data",
}


def domains(text: Column, picked: Column | None = None) -> Column:
    """Domains picked that are known, else those whose keywords occur, else the default; distinct, in order, capped."""
    low = F.lower(text)
    hits = F.array_compact(F.array(*(F.when(F.exists(F.array(*map(F.lit, k)), lambda w: F.contains(low, w)), d) for d, k in DOMAINS.items())))
    hits = F.when(F.size(hits) > 0, hits).otherwise(F.array(*map(F.lit, FALLBACK)))
    if picked is not None:
        own = F.filter(picked, lambda d: d.isin(*DOMAINS, "manufacturing-process", "development", "batch-data"))
        hits = F.when(F.size(own) > 0, own).otherwise(hits)
    return F.slice(F.array_distinct(hits), 1, MOST_DOMAINS)


def normal_type(raw: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))[F.lower(F.trim(raw))], F.lit(""))


# --- sections and layout ---------------------------------------------------------------------------------------------------


def headings(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """blocks: doc_id, position, page, text, n_lines; toc: doc_id, number, title, page. Anchors of the table of contents if two can
    be placed, else headings by numbering. doc_id, position, number, title."""
    number = F.regexp_extract("text", r"^\s*(\d+(?:\.\d+){0,3})\.?\s+\S", 1)
    b = blocks.withColumn("number", number)
    anchored = toc.join(b.select("doc_id", "position", "page", "number"), ["doc_id", "number", "page"]).groupBy("doc_id", "number").agg(F.min("position").alias("position"), F.first("title").alias("title"))
    enough = anchored.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n >= 2").select("doc_id")
    title = F.trim(F.regexp_extract("text", r"^\s*\d+(?:\.\d+){0,3}\.?\s+(.*)$", 1))
    plausible = F.forall(F.split("number", r"\."), lambda p: p.cast("int") <= 50)
    shaped = b.filter((F.col("number") != "") & (F.length("text") <= 120) & (F.col("n_lines") <= 2) & plausible).withColumn("title", title).filter(~F.col("title").rlike(r"^[\d.,\s%<>()-]+$") & F.regexp_extract("title", r"[A-Za-z]", 0).rlike("[A-Z]"))
    geometry = shaped.groupBy("doc_id", "number").agg(F.min("position").alias("position"), F.min_by("title", "position").alias("title")).join(enough, "doc_id", "left_anti")
    return anchored.join(enough, "doc_id", "left_semi").unionByName(geometry).select("doc_id", "position", "number", "title")


def sectioned(blocks: DataFrame, heads: DataFrame, preamble: int = 200, group: int = 5) -> DataFrame:
    """Sections: doc_id, section, heading, first and last page, text, group. Text before the first heading is kept if it is longer
    than preamble; groups are of five."""
    j = blocks.join(heads.select("doc_id", "position", F.concat_ws(" ", "number", "title").alias("heading")), ["doc_id", "position"], "left")
    j = carried(j, "doc_id", ["position"], "heading")
    start = F.sum(F.coalesce((F.col("_h") == 1).cast("int"), F.lit(0))).over(Window.partitionBy("doc_id").orderBy("position"))
    j = j.join(heads.select("doc_id", "position", F.lit(1).alias("_h")), ["doc_id", "position"], "left").withColumn("section", start)
    s = j.groupBy("doc_id", "section").agg(F.coalesce(F.max("heading"), F.lit("Main Content")).alias("heading"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n").alias("text"))
    s = s.filter((F.col("section") > 0) | (F.length("text") > preamble))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("section")) - 1
    return s.withColumn("group_id", F.concat(F.lit("group_"), F.floor(n / group).cast("string")))


def stitched(tables: DataFrame, heights: DataFrame) -> DataFrame:
    """tables: doc_id, table_id, page, kind, title, n_cols, x0, y0, x1, y1. The logical table (first fragment's table_id) of each:
    a grid goes on the next page without a title, with as many columns at the same edges, from a page's bottom to a top."""
    w = Window.partitionBy("doc_id").orderBy("page", F.coalesce("y0", F.lit(0.0)), "table_id")
    t = tables.join(heights, ["doc_id", "page"], "left")
    prev = {c: F.lag(c).over(w) for c in ("page", "kind", "n_cols", "x0", "x1", "y1", "height")}
    goes_on = (
        (F.col("kind") == "grid") & (prev["kind"] == "grid") & (F.col("page") == prev["page"] + 1) & (F.coalesce("title", F.lit("")) == "") & (F.col("n_cols") > 0) & (F.col("n_cols") == prev["n_cols"])
        & (F.abs(prev["x0"] - F.col("x0")) <= 20) & (F.abs(prev["x1"] - F.col("x1")) <= 20) & (F.coalesce(prev["height"], F.lit(0.0)).eqNullSafe(F.lit(0.0)) | (prev["y1"] >= prev["height"] * 0.8))
        & (F.coalesce(F.col("height"), F.lit(0.0)).eqNullSafe(F.lit(0.0)) | (F.col("y0") <= F.col("height") * 0.3))
    )
    t = t.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_g", F.sum("_new").over(w))
    return t.withColumn("logical_id", F.first("table_id").over(Window.partitionBy("doc_id", "_g").orderBy("page", F.coalesce("y0", F.lit(0.0)), "table_id"))).drop("_new", "_g", "height")


#: Layout thresholds in units (median line height).
PARAGRAPH_GAP, SHORT_LINE, INDENT, LINE_OVERLAP, COLUMN_GAP, SPLIT_GAP = 0.5, 2.0, 1.2, 0.4, 1.6, 1.3


def paragraphs(lines: DataFrame) -> DataFrame:
    """lines: doc_id, page, line_id, text, x0, y0, x1, y1, style -> block numbers: a gap, a short line, an indent or another style
    starts a block (gaps and islands)."""
    place = Window.partitionBy("doc_id", "page")
    w = place.orderBy("y0", "x0", "line_id")
    x = lines.filter("trim(text) <> ''").withColumns({"_u": F.median(F.col("y1") - F.col("y0")).over(place), "_right": F.max("x1").over(place)})
    new = (F.col("y0") - F.lag("y1").over(w) > PARAGRAPH_GAP * F.col("_u")) | (F.lag("x1").over(w) < F.col("_right") - SHORT_LINE * F.col("_u")) | (F.col("x0") > F.lag("x0").over(w) + INDENT * F.col("_u")) | ~F.col("style").eqNullSafe(F.lag("style").over(w))
    return x.withColumn("_n", F.coalesce(new.cast("int"), F.lit(1))).withColumn("block", F.sum("_n").over(w) - 1).drop("_n", "_u", "_right")


#: Labels with a colon, and short capitalised ones without; the least share of them in a key-value line.
COLON_LABEL, PLAIN_LABEL, LABEL_SHARE = r"^[A-Za-z][^:]{0,40}:", r"^[A-Z][A-Za-z/]*(?: [A-Za-z/]+){1,4}$", 0.4
#: Least columns of a grid, least pairs of a list of keys and values, longest caption.
GRID_COLUMNS, KEY_PAIRS, CAPTION = 3, 2, 200
MADE = "struct<kind:string,title:string,pairs:array<struct<label:string,value:string>>,headers:array<string>,rows:array<array<string>>>"


def _is_label(c: Column) -> Column:
    return c.rlike(COLON_LABEL) | c.rlike(PLAIN_LABEL)


def text_lines(regions: DataFrame) -> DataFrame:
    """regions: doc_id, page, text, x0, y0, x1, y1 -> a row per line of a page: line, y0, y1, cells (text and centre, from left
    to right), unit (the page's median region height) and kv (whether it reads as keys and values). A region belongs to the
    line above if they share LINE_OVERLAP of the lower one's height."""
    box = F.struct(((F.col("y0") + F.col("y1")) / 2).alias("mid"), *("x0", "y0", "x1", "y1", "text"))
    page = regions.filter(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(box)).alias("r"))
    heights = F.array_sort(F.transform("r", lambda r: r["y1"] - r["y0"]))
    page = page.withColumn("unit", heights[F.floor(F.size("r") / 2).cast("int")])
    kind = "array<struct<y0:double,y1:double,r:array<struct<x0:double,x1:double,text:string>>>>"

    def step(lines: Column, r: Column) -> Column:
        last = F.try_element_at(lines, F.lit(-1))
        shared = F.least(r["y1"], last["y1"]) - F.greatest(r["y0"], last["y0"])
        low = F.least(r["y1"] - r["y0"], last["y1"] - last["y0"])
        one = F.array(F.struct(r["x0"].alias("x0"), r["x1"].alias("x1"), r["text"].alias("text")))
        grown = F.struct(F.least(last["y0"], r["y0"]).alias("y0"), F.greatest(last["y1"], r["y1"]).alias("y1"), F.concat(last["r"], one).alias("r"))
        joins = last.isNotNull() & F.coalesce((low > 0) & (shared / F.when(low > 0, low) >= LINE_OVERLAP), F.lit(False))
        return F.when(joins, F.concat(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(lines, F.array(F.struct(r["y0"].alias("y0"), r["y1"].alias("y1"), one.alias("r"))))).cast(kind)

    lines = page.select("doc_id", "page", "unit", F.posexplode(F.aggregate("r", F.array().cast(kind), step)).alias("line", "l"))
    cells = F.transform(F.array_sort("l.r"), lambda r: F.struct(F.trim(r["text"]).alias("text"), ((r["x0"] + r["x1"]) / 2).alias("centre")))
    lines = lines.select("doc_id", "page", "unit", "line", "l.y0", "l.y1", cells.alias("cells"))
    first, second = F.col("cells")[0]["text"], F.try_element_at("cells", F.lit(2))["text"]
    colons = F.size(F.filter("cells", lambda c: c["text"].rlike(COLON_LABEL)))
    return lines.withColumn("kv", F.coalesce((F.size("cells") == 2) & _is_label(first) & ~_is_label(second), F.lit(False)) | (colons / F.size("cells") >= LABEL_SHARE))


def reconstructed(regions: DataFrame) -> DataFrame:
    """regions: doc_id, page, text, x0, y0, x1, y1 -> doc_id, page, tables (key_value pairs or a grid), prose.

    Runs of lines of several cells are islands between lines of one cell; a gap of SPLIT_GAP units or a change between
    key-value and grid lines cuts them into segments. A segment becomes what most of its lines read as, else the other kind,
    else prose. The columns of a grid are islands of centres at most COLUMN_GAP units apart. The line of one cell before a run
    is the caption of its first table."""
    where = ["doc_id", "page"]
    by_line = Window.partitionBy(*where).orderBy("line")
    x = text_lines(regions)
    single = F.size("cells") < 2
    x = x.withColumn("run", F.sum(single.cast("int")).over(by_line)).withColumn("single", single)
    in_run = Window.partitionBy(*where, "run", "single")
    cut = (F.col("y0") - F.lag("y1").over(in_run.orderBy("line")) > SPLIT_GAP * F.col("unit")) | (F.col("kv") != F.lag("kv").over(in_run.orderBy("line")))
    x = x.withColumns({"segment": F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(in_run.orderBy("line"))})
    many = x.filter("not single")
    place = [*where, "run", "segment"]
    # keys and values: a colon label takes its tail or the next cell, a plain one the next cell, if that is no label
    said = F.transform("cells", lambda c: c["text"])

    def pair(c: Column, i: Column) -> Column:
        after = F.try_element_at(said, i + 2)
        value = F.when(~_is_label(after), after)
        tail = F.trim(F.regexp_replace(c, COLON_LABEL, ""))
        made = lambda label, v: F.struct(label.alias("label"), v.alias("value"))
        return F.when(c.rlike(COLON_LABEL), made(F.trim(F.substring_index(c, ":", 1)), F.coalesce(F.nullif(tail, F.lit("")), value, F.lit("")))).when(_is_label(c) & value.isNotNull(), made(c, value))

    pairs = F.array_compact(F.transform(said, pair))
    seg = many.groupBy(*place).agg(
        F.min("line").alias("first"), F.count("*").alias("n"), (F.sum(F.col("kv").cast("int")) * 2 >= F.count("*")).alias("mostly_kv"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", pairs.alias("p")))), lambda v: v["p"])).alias("pairs"),
        F.transform(F.array_sort(F.collect_list(F.struct("line", F.array_join(said, " ").alias("t")))), lambda v: v["t"]).alias("texts"),
    )
    # a grid: islands of centres, every cell in the column of the nearest mean
    cell = many.select(*place, "line", "unit", F.posexplode("cells").alias("at", "c")).select(*place, "line", "unit", "at", "c.text", "c.centre")
    across = Window.partitionBy(*place).orderBy("centre", "line", "at")
    far = (F.col("centre") - F.lag("centre").over(across) > COLUMN_GAP * F.col("unit")).cast("int")
    cell = cell.withColumn("far", F.coalesce(far, F.lit(0))).withColumn("column", F.sum("far").over(across))
    mids = cell.groupBy(*place, "column").agg(F.avg("centre").alias("mid")).groupBy(*place).agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "mid"))), lambda v: v["mid"]).alias("mids"))
    nearest = F.array_min(F.transform("mids", lambda m, i: F.struct(F.abs(m - F.col("centre")).alias("d"), i.alias("i"))))["i"]
    put = cell.join(mids, place).withColumn("column", nearest)
    texts = put.groupBy(*place, "line", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda v: v["text"]), " ").alias("text"))
    used = texts.groupBy(*place).agg(F.array_sort(F.collect_set("column")).alias("columns"))
    row = texts.groupBy(*place, "line").agg(F.map_from_entries(F.collect_list(F.struct("column", "text"))).alias("by_column"))
    grid = row.join(used, place).groupBy(*place).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", F.transform("columns", lambda c: F.coalesce(F.col("by_column")[c], F.lit(""))).alias("row")))), lambda v: v["row"]).alias("grid"))
    seg = seg.join(grid, place)
    is_pairs, is_grid = F.size("pairs") >= KEY_PAIRS, F.size(F.col("grid")[0]) >= GRID_COLUMNS
    kind = F.when(F.col("n") >= 2, F.when(F.col("mostly_kv"), F.when(is_pairs, "key_value").when(is_grid, "grid")).otherwise(F.when(is_grid, "grid").when(is_pairs, "key_value")))
    seg = seg.withColumn("kind", kind)
    # captions and prose go by the run, whose number is that of the line of one cell before it
    captions = x.filter("single").select(*where, "run", "line", F.array_join(said, " ").alias("caption"))
    order = F.row_number().over(Window.partitionBy(*where, "run").orderBy("first"))
    tables = seg.filter("kind is not null").withColumn("nth", order).join(captions.drop("line"), [*where, "run"], "left")
    title = F.when((F.col("nth") == 1) & (F.col("caption") != "") & (F.length("caption") <= CAPTION), F.col("caption"))
    grids = F.col("kind") == "grid"
    made = F.struct("kind", title.alias("title"), F.when(~grids, F.col("pairs")).alias("pairs"), F.when(grids, F.col("grid")[0]).alias("headers"), F.when(grids, F.slice("grid", 2, F.size("grid"))).alias("rows")).cast(MADE)
    tables = tables.groupBy(*where).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", made.alias("t")))), lambda v: v["t"]).alias("tables"))
    prose = captions.select(*where, "line", F.array("caption").alias("texts")).unionByName(seg.filter("kind is null").select(*where, F.col("first").alias("line"), "texts"))
    prose = prose.groupBy(*where).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", "texts"))), lambda v: v["texts"])).alias("prose"))
    out = x.select(*where).distinct().join(tables, where, "left").join(prose, where, "left")
    return out.select(*where, F.coalesce("tables", F.array().cast(f"array<{MADE}>")).alias("tables"), F.coalesce("prose", F.array().cast("array<string>")).alias("prose"))
