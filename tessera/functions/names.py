"""Product and ingredient names, application numbers and dosage forms, as Column expressions.

Every function takes and gives Columns (no UDF), so that Catalyst compiles them with the rest of the query.
Null names behave as empty ones unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of salts, hydrates and counter-ions, which a stripped name leaves out.
SALTS = (
    "hydrochloride", "hcl", "sulfate", "sulphate", "bitartrate", "tartrate", "citrate", "phosphate", "fumarate", "succinate",
    "mesylate", "dimesylate", "tosylate", "besylate", "sodium", "potassium", "calcium", "magnesium", "monohydrate", "dihydrate",
    "trihydrate", "anhydrous", "chloride", "bromide", "iodide", "acetate", "gluconate", "lactate", "carbonate", "bicarbonate",
)
#: Separators between the ingredients of one product.
SEPARATOR = r"(?i)[;/]|(?:\s+and\s+)|(?:\s*,\s*)"
#: Application types and their one-letter forms.
APPLICATION_TYPES = ("NDA", "ANDA", "BLA")
ONE_LETTER = {"N": "NDA", "A": "ANDA", "B": "BLA"}
#: Words that make a dosage form clinically distinct, and their abbreviations.
MODIFIERS = ("extended", "delayed", "sustained", "controlled", "modified", "chewable", "disintegrating", "effervescent", "sublingual", "buccal")
ABBREVIATIONS = {"er": "extended", "xr": "extended", "xl": "extended", "dr": "delayed", "sr": "sustained", "cr": "controlled", "odt": "disintegrating"}


def squeeze(c: Column) -> Column:
    """Runs of white space (of any script) become one space; none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def filled(c: Column) -> Column:
    """Null for empty text, so that coalesce() passes on to the next value."""
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first value that isn't empty after squeezing."""
    return F.coalesce(*(filled(squeeze(c)) for c in columns))


def ingredients(name: Column) -> Column:
    """Ingredient strings of a product name, in order, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), SEPARATOR), F.trim), lambda p: p != "")


def _plain(part: Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(part, r"\([^)]*\)", " ")))


def canonical_name(name: Column) -> Column:
    """Lower case, no parentheses, ingredients sorted and joined by '; '."""
    parts = F.filter(F.transform(ingredients(name), _plain), lambda p: p != "")
    return F.array_join(F.array_sort(parts), "; ")


def _without_salts(part: Column) -> Column:
    return F.array_join(F.filter(F.split(part, " "), lambda t: (t != "") & ~t.isin(*SALTS)), " ")


def stripped_name(name: Column) -> Column:
    """canonical_name without salt words; empty if nothing else was there."""
    parts = F.transform(F.transform(ingredients(name), _plain), _without_salts)
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), "; ")


def is_combination(name: Column) -> Column:
    return F.size(ingredients(name)) > 1


def component_keys(name: Column) -> Column:
    """Canonical and stripped keys of every ingredient, distinct, none empty."""
    parts = F.transform(ingredients(name), _plain)
    return F.filter(F.array_distinct(F.concat(parts, F.transform(parts, _without_salts))), lambda k: k != "")


def names_match(canonical: Column, stripped: Column, other_normalized: Column, other_raw: Column) -> Column:
    """Equal canonical names, or equal stripped names that aren't empty; an empty query matches nothing."""
    same = F.coalesce(other_normalized, F.lit("")) == canonical
    return (F.coalesce(canonical, F.lit("")) != "") & (same | ((F.coalesce(stripped, F.lit("")) != "") & (stripped_name(other_raw) == stripped)))


def application_number(raw: Column) -> Column:
    """'NDA######' for prefixed numbers (long or one-letter), six digits for bare ones, null where none can be read."""
    text = F.upper(F.regexp_replace(raw, "[^A-Za-z0-9]", ""))
    kind, number = (F.regexp_extract(text, r"^(NDA|ANDA|BLA|[NAB])0*(\d{1,6})$", g) for g in (1, 2))
    long = kind
    for letter, name in ONE_LETTER.items():
        long = F.when(kind == letter, name).otherwise(long)
    digits = F.regexp_replace(text, "[^0-9]", "")
    bare = F.when((digits == "") | (F.length(F.regexp_replace(digits, "^0+", "")) > 6), None).otherwise(F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits))
    return F.when(raw.isNull() | (raw == ""), None).when(number != "", F.concat(long, F.lpad(number, 6, "0"))).otherwise(bare)


def application_candidates(raw: Column) -> Column:
    """All forms under which a number may be stored: its own if prefixed, else every prefix and the bare digits."""
    number = application_number(raw)
    every = F.array(*(F.concat(F.lit(p), number) for p in APPLICATION_TYPES), number)
    return F.when(number.isNull(), F.array().cast("array<string>")).when(number.rlike("^[A-Z]"), F.array(number)).otherwise(every)


def bare_application_number(raw: Column) -> Column:
    return F.regexp_replace(application_number(raw), "^[A-Z]+", "")


def ndc(raw: Column) -> Column:
    return filled(F.regexp_replace(raw, "[^0-9-]", ""))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))


def has_token(listed: Column, token: Column, width: int = 6) -> Column:
    """Exact membership of a zero-padded token in a comma-joined list; never a substring."""
    return F.coalesce(F.array_contains(F.transform(F.split(listed, ","), lambda t: F.lpad(F.trim(t), width, "0")), token), F.lit(False))


def form_tokens(form: Column) -> Column:
    """Words of a dosage form of more than two characters."""
    return F.filter(F.array_distinct(F.split(F.lower(F.replace(F.coalesce(form, F.lit("")), F.lit(","), F.lit(" "))), r"\s+")), lambda t: F.length(t) > 2)


def form_modifiers(form: Column) -> Column:
    """Sorted release and administration modifiers of a dosage form; abbreviations are spelled out."""
    words = F.split(F.lower(F.replace(F.coalesce(form, F.lit("")), F.lit(","), F.lit(" "))), r"\s+")
    alias = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda t: F.coalesce(alias[t], t)), lambda t: t.isin(*MODIFIERS))))


def forms_match(want: Column, have: Column) -> Column:
    """Whether a requested form fits a listed one: contained or a shared word, and equal modifiers; unknown fits."""
    unknown = (F.coalesce(want, F.lit("")) == "") | (F.coalesce(have, F.lit("")) == "")
    near = (F.instr(F.lower(have), F.lower(want)) > 0) | F.arrays_overlap(form_tokens(want), form_tokens(have))
    return unknown | (near & (form_modifiers(want) == form_modifiers(have)))


def attributes_compatible(a: Column, b: Column) -> Column:
    """Either side unknown, or one (squeezed, lower case) begins with the other."""
    x, y = (F.coalesce(F.lower(squeeze(v)), F.lit("")) for v in (a, b))
    return (x == "") | (y == "") | x.startswith(y) | y.startswith(x)


def match_key(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def contains_either_way(a: Column, b: Column, least: int = 4) -> Column:
    """One match key holds the other, and the one held has at least so many characters."""
    x, y = match_key(a), match_key(b)
    held = F.when(F.instr(x, y) > 0, y).when(F.instr(y, x) > 0, x)
    return (x != "") & (y != "") & F.coalesce(F.length(held) >= least, F.lit(False))


def labeler(title: Column) -> Column:
    """The bracketed suffix of a listing's title, null where there is none."""
    return filled(squeeze(F.regexp_extract(squeeze(title), r"\[([^\[\]]+)\]\s*$", 1)))


def verifies_name(submitted: Column, candidate: Column) -> Column:
    """Whether a submitted brand name is verified by a candidate: equal, canonically or stripped equal, or contained
    (four characters at least). A submitted name of under three characters is an error."""
    want, have = (F.lower(squeeze(F.coalesce(v, F.lit("")))) for v in (submitted, candidate))
    held = F.when(F.instr(have, want) > 0, want).when(F.instr(want, have) > 0, have)
    yes = (have != "") & (
        (want == have)
        | ((canonical_name(submitted) != "") & (canonical_name(submitted) == canonical_name(candidate)))
        | ((stripped_name(submitted) != "") & (stripped_name(submitted) == stripped_name(candidate)))
        | F.coalesce(F.length(held) >= 4, F.lit(False))
    )
    return F.when(F.length(want) < 3, F.raise_error(F.lit("the name is too short to be verified")).cast("boolean")).otherwise(yes)


def file_stem(name: Column) -> Column:
    """A safe stem for a file name."""
    return F.coalesce(filled(F.btrim(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), F.lit("_"))), F.lit("psg"))


def document_file_name(number: Column, ingredient: Column) -> Column:
    stem = F.coalesce(filled(F.trim(F.regexp_replace(ingredient, "[^A-Za-z0-9]+", " "))), F.lit("PSG"))
    return F.when(number.rlike(r"^\d+$"), F.concat(F.lit("PSG_"), number, F.lit(" "), stem, F.lit(".docx"))).otherwise(F.concat(stem, F.lit(" PSG.docx")))


def citation_label(short_name: Column, number: Column, name: Column) -> Column:
    """An explicit label, else PSG_<number>, else the name with underscores, else PSG."""
    return F.coalesce(filled(short_name), F.concat(F.lit("PSG_"), filled(number)), F.replace(filled(name), F.lit(" "), F.lit("_")), F.lit("PSG"))
