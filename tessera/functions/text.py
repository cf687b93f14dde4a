"""Token sets, citations, lexicons and normal forms of text, as Column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import squeeze

#: A source token and page inside a bracket, a bracket, and the heading of the trailing list.
PAIR = r"(?i)((?:PSG_|OB_)?\d{3,})\s*,\s*p\.\s*(\d+)"
BRACKET = r"\[([^\[\]]+)\]"
TRAILER = r"\n\s*Sources:\s*\n"
#: Structured source tokens by kind.
STRUCTURED = {
    "spl": r"^SPL_([A-Za-z0-9._-]+)#([0-9]+-[0-9])$",
    "ob": r"^OB_(\d{6})/(\d{1,4})$",
    "obpat": r"^OBPAT_([A-Za-z0-9,*-]+)$",
    "obexcl": r"^OBEXCL_([A-Za-z0-9*-]+)$",
}
#: Words whose loss can turn an answer into its opposite.
MATERIAL = ("not", "required", "prohibited", "approved", "except", "only", "unless", "may", "must")
#: Words that report what a source says.
ASSERTING = (
    "acceptable", "according", "advise", "advises", "allows", "calls", "establishes", "exempt", "exemption", "exempts",
    "expected", "expects", "indicates", "instructs", "mandates", "no", "notes", "permits", "prohibition", "prohibits",
    "recommend", "recommendation", "recommendations", "recommended", "recommending", "recommends", "require", "requirement",
    "requirements", "requires", "requiring", "say", "says", "sets", "shall", "should", "specified", "specifies", "specify",
    "stated", "states", "suggests", "waive", "waived", "permitted", "exempted", "waives",
)
#: Asserting words that are mere topics in a heading or label.
TOPICS = ("recommended", "recommendation", "recommendations", "requirement", "requirements", "specified", "notes", "stated")


def _or(*words: str) -> str:
    return rf"(?i)\b(?:{'|'.join(words)})\b"


def tokens(c: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\p{L}\p{N}]+")), lambda t: t != "")


def content_tokens(c: Column) -> Column:
    """Distinct lower-case ASCII words of more than two characters."""
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+")), lambda t: F.length(t) > 2)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(claim: Column, passage: Column) -> Column:
    """The fraction of the claim's content tokens that the passage holds, to three places; 0 for no tokens."""
    return F.when(F.size(claim) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(claim, passage)) / F.size(claim), 3))


def line_form(c: Column) -> Column:
    """Words rejoined over line-end hyphens, ASCII white space squeezed, no spaces at the ends; case and characters stay as they are."""
    joined = F.regexp_replace(c, r"[-\u00AD][ \t]*\r?\n[\t\n\f\r ]*", "")
    return F.regexp_replace(F.regexp_replace(joined, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+\z", "")


def quoted_exactly(quote: Column, page: Column) -> Column:
    """Whether a page holds a quote, both in line_form; an empty quote stands nowhere."""
    return (line_form(quote) != "") & F.contains(line_form(page), line_form(quote))


def fact_form(c: Column) -> Column:
    """Lower case, hyphens as spaces, squeezed."""
    return squeeze(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("-"), F.lit(" ")))


def contains_all(text: Column, facts: Column) -> Column:
    return F.forall(facts, lambda f: F.instr(fact_form(text), fact_form(f)) > 0)


def contains_none(text: Column, facts: Column) -> Column:
    return ~F.exists(facts, lambda f: F.instr(fact_form(text), fact_form(f)) > 0)


def without_trailer(c: Column) -> Column:
    return F.element_at(F.split(c, TRAILER, 2), 1)


def citations(c: Column) -> Column:
    """array<struct<short_name, page>> of every citation, in order; a bracket may hold several."""
    bodies = F.regexp_extract_all(c, F.lit(BRACKET), F.lit(1))
    pairs = F.flatten(F.transform(bodies, lambda b: F.arrays_zip(F.regexp_extract_all(b, F.lit(PAIR), F.lit(1)).alias("short_name"), F.regexp_extract_all(b, F.lit(PAIR), F.lit(2)).alias("page"))))
    return F.transform(pairs, lambda p: F.struct(p["short_name"].alias("short_name"), p["page"].cast("int").alias("page")))


def has_citation(c: Column) -> Column:
    return F.size(citations(c)) > 0


_CITING = r"\[(?=[^\[\]]*(?i:(?:PSG_|OB_)?\d{3,})\s*,\s*(?i:p)\.\s*\d)[^\[\]]+\]"


def without_citations(c: Column) -> Column:
    """Brackets that cite are removed; other brackets stay."""
    return F.regexp_replace(c, _CITING, "")


def allowed_citations(c: Column, allowed: Column) -> Column:
    """Every citing bracket keeps its pairs that are in allowed (array<struct<short_name, page>>); none left, none stays."""
    gaps, hits = F.split(c, _CITING, -1), F.regexp_extract_all(c, F.lit(_CITING), F.lit(0))

    def keep(hit: Column) -> Column:
        good = F.filter(citations(hit), lambda p: F.array_contains(allowed, p))
        said = F.array_join(F.transform(good, lambda p: F.concat(p["short_name"], F.lit(", p."), p["page"].cast("string"))), "; ")
        return F.when(F.size(good) == 0, "").otherwise(F.concat(F.lit("["), said, F.lit("]")))

    return F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda x: F.array(x["g"], F.coalesce(keep(x["h"]), F.lit(""))))), "")


def structured_token(c: Column) -> Column:
    """struct<kind, parts> of a structured source token, else null."""
    raw, out = F.trim(c), None
    for kind, pattern in STRUCTURED.items():
        n = pattern.count("(")
        part = F.struct(F.lit(kind).alias("kind"), F.array(*(F.regexp_extract(raw, pattern, g + 1) for g in range(n))).alias("parts"))
        out = F.when(raw.rlike(pattern), part) if out is None else out.when(raw.rlike(pattern), part)
    return out


def _first_word(c: Column, words: tuple[str, ...]) -> Column:
    found = F.regexp_extract(c, _or(*words), 0)
    return F.when(found != "", F.lower(found))


def material_word(c: Column) -> Column:
    """The first word that makes dropping the text material, else null; 'May 2026' is a month."""
    return _first_word(F.regexp_replace(F.coalesce(c, F.lit("")), r"\bMay\b(?=\s+\d)", ""), MATERIAL)


def asserting_word(c: Column, label: bool = False) -> Column:
    """The first word that reports what a source says, else null; in a label, topic words don't count."""
    body = F.coalesce(c, F.lit(""))
    return _first_word(F.regexp_replace(body, _or(*TOPICS), " ") if label else body, ASSERTING)


def claim_text(c: Column) -> Column:
    """One line without a leading bullet and without citations; no space before punctuation."""
    flat = F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), r"^[-*•]\s+", "")
    return F.trim(F.regexp_replace(squeeze(without_citations(flat)), r"\s+([.,;:])", "$1"))


def marked_before_stop(c: Column) -> Column:
    """Numeric marker groups after a sentence's end move before it: 'x. [1]' becomes 'x [1].'"""
    return F.regexp_replace(c, r"([.!?])[ \t]*((?:\[\d+(?:\s*,\s*\d+)*\])+)(?=\s|$)", " $2$1")


def marker_numbers(c: Column, most: Column) -> Column:
    """The distinct numbers in numeric markers between 1 and most, zero-based, in order of appearance."""
    found = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1)), lambda g: F.transform(F.split(g, ","), lambda n: F.trim(n).cast("int"))))
    return F.transform(F.filter(F.array_distinct(found), lambda n: (n >= 1) & (n <= most)), lambda n: n - 1)


#: Abbreviations that don't end a sentence.
ABBREVIATIONS = ("e.g", "i.e", "cf", "vs", "approx", "no", "fig", "figs", "sec", "secs", "tbl", "ref", "refs", "eq", "ca", "dr", "mr", "mrs", "ms", "prof")


def sentences(c: Column) -> Column:
    """array<string>: text cut behind stops, and joined again where the stop was an abbreviation's. Null has none."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)(?<=[.!?])\s+"), lambda p: p.rlike(r"(?U)\S"))
    joins = lambda a, b: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat_ws(" ", F.element_at(a, -1), b)))

    def goes_on(left: Column, right: Column) -> Column:
        word = F.lower(F.regexp_extract(left, r"([A-Za-z][A-Za-z.]*)\.$", 1))
        # "Ph. Eur." goes on, "... at this pH." doesn't
        return F.when(word == "ph", F.lower(F.ltrim(right)).startswith("eur")).otherwise(F.contains(word, F.lit(".")) | word.isin(*ABBREVIATIONS))

    def step(a: Column, b: Column) -> Column:
        return F.when(F.coalesce(goes_on(F.try_element_at(a, F.lit(-1)), b), F.lit(False)), joins(a, b)).otherwise(F.concat(a, F.array(b)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def json_part(c: Column) -> Column:
    """The JSON inside noisy text: a fenced block, else from the first brace (or bracket) to the last, else all."""
    text = F.trim(c)
    fence = F.regexp_extract(text, r"(?s)```(?:[^\n]{0,19}\n)?(.*)```", 1)
    brace, bracket = F.regexp_extract(text, r"(?s)\{.*\}", 0), F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.when(fence != "", F.trim(fence)).when(brace != "", brace).when(bracket != "", bracket).otherwise(text)


#: What the question classifiers look for.
SUMMARY_WORDS = ("summary", "summarize", "summarise", "overview", "brief")
COMPARING = (r"\b(?:compare|comparison|versus|vs)\b", "difference between", "differences between", "compared to", "compared with")
FILLER = r"^(?:(?:ok(?:ay)?|alright|right|got\s+it|thanks|thank\s+you|cool|sure|hmm+|well)\b[\s,.:;-]*)+"
GREETING = ("hi", "hello", "hey", "good", "morning", "afternoon", "evening", "thanks", "thank", "you", "okay", "ok", "there", "bye")


def is_summary_request(c: Column) -> Column:
    return F.arrays_overlap(tokens(c), F.array(*map(F.lit, SUMMARY_WORDS)))


def is_comparison(c: Column) -> Column:
    return F.lower(c).rlike("|".join(COMPARING))


def is_social(c: Column) -> Column:
    """Words, and all of them pleasantries."""
    t = tokens(c)
    return (F.size(t) > 0) & F.forall(t, lambda w: w.isin(*GREETING))


def is_follow_up(c: Column, pronouns: tuple[str, ...] = ("it", "its", "that", "those", "these", "this", "they", "them")) -> Column:
    """Opens with a conjunction once fillers are gone, or is short and refers back."""
    q = F.regexp_replace(F.lower(F.trim(c)), FILLER, "")
    t = tokens(q)
    return q.rlike(r"^(?:and|so|then|but|what about|how about)\b") | (F.arrays_overlap(t, F.array(*map(F.lit, pronouns))) & (F.size(t) <= 8))


def unresolved_kind(c: Column, known_elsewhere: Column) -> Column:
    return F.when(is_social(c), "converse").when(known_elsewhere, "product_not_covered").otherwise("need_product")


def contains_phrase(c: Column, phrases: tuple[str, ...]) -> Column:
    """Closed-set phrase match on lower-cased text (meta, change and scope-warning requests)."""
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.instr(F.lower(c), p) > 0)
