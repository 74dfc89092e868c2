"""Column expressions on text: normal forms, tokens, measures of shape, validator vocabulary.

Character classes are spelt out (ASCII plus what is named) so that results do not depend on a regex
dialect. Null text gives null unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values that results depend on.
LIGATURES = [("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"')]
BLANKED = "\u2013\u2014\u2212\u2265\u2264\u2021\u2020\xa0"
MISSING = ["", "nan", "none", "null", "<na>", "n/a"]
DOT_LEADER = r"\.{6,}|(?:\.[ \t]){6,}"
REFERENCE_SECTION = r"(?i)^\s*(references|bibliography|acknowledg|disclosure|conflict of interest)"
CITATION = r"(?im)\bet al\.?|doi:\s*\S+|\b\d{4};\s*\d+\s*[\(:]|\bAvailable at:|\[Accessed\b|(?:^|\s)\d{1,4}\s+[A-Z][a-z]+ [A-Z]{1,3}[,.]"
BOILERPLATE = r"(?i)all rights reserved|subject to notice of rights|terms-and\s*conditions|\(reprinted\)\s*jama|clinical review & education"
RECOMMENDATION = r"(?i)\bwe recommend\b|\bwe suggest\b|\brecommends?\b|\bshould be offered\b|\boffer\b|\bconsider\b|\bdo not offer\b|\brecommendation\b\s*\d|\b\d\.\d\.\d+\b|\b(grade|level)\s*[a-d1-2]\b"
CLINICAL = r"(?i)\d+(?:\.\d+)?\s*(?:cm|mm)|\bultraso|\bscreen|\bsurveillance\b|\bevar\b|\brupture\b|\baneurysm repair\b|\bsmoking\b"
NUMERIC = r"(?i)(?:[≥≤<>~≈]\s*)?\d+(?:[.,]\d+)?(?:\s*[–−\-]\s*\d+(?:[.,]\d+)?)?(?:\s*(?:%|cm|mm|kg|years?|yrs?|months?|weeks?|days?|hours?))?"
CRITICAL = r"(?i)[≥≤%]|cm|mm|years?|yrs?|months?|weeks?|\d+[.,]\d+|\d+\s*[–\-]\s*\d+"
LEXICAL = r"\d+(?:\.\d+)?|[a-z]+(?:'[a-z]+)?"
CONTENT = r"[a-z0-9][a-z0-9./-]*"
STOP_WORDS = (
    "a an the and or but in on at to for of with by from as is are was were be been has have had do does did not no nor "
    "that this these those it its which who whom when where how what if than then so also both each any all more most such "
    "other may should would could will can must shall there their they them we our he she his her i my you your about above "
    "after although among because between during however including rather therefore thus while whereas whether per via within "
    "without based note see given further nevertheless nonetheless being"
).split()
STANCE = r"recommend\w*|indicat\w*|advis\w*|consider\w*|offer\w*|warrant\w*|benefi\w*|justifi\w*|appropriate|support\w*|perform\w*|use[ds]?|repair\w*|treat\w*|screen\w*|operat\w*|requir\w*|need\w*|necessary|suitab\w*|eligib\w*|prefer\w*"
NEGATED_STANCE = rf"(?i)\b(?:not|no|never|cannot|nor|without|nolonger)\b(?:\s+\S+){{0,4}}?\s+(?:{STANCE})\b"
NEGATIVE = r"(?i)\b(?:contraindicat\w*|inadvisab\w*|unnecessar\w*|unsuitab\w*|ineligib\w*|discourag\w*|harmful|avoid\w*|refrain\w*|withhold\w*|forbidden|unrecommended|not\s+recommended|shouldn'?t|mustn'?t|can'?t|don'?t|doesn'?t)\b"
POSITIVE = r"(?i)\b(?:recommend\w*|indicated|advis\w*|consider\w*|offer\w*|warrant\w*|benefic\w*|benefit\w*|appropriate|should|shall|must|can|may\s+be\s+(?:used|offered|considered))\b"
# Quotation marks and ligatures as they are compared, dashes, signs that become blanks.
QUOTES = [("‘", "'"), ("’", "'"), ("‚", "'"), ("‛", "'"), ("“", '"'), ("”", '"'), ("„", '"'), ("‟", '"'), ("´", "'"), ("`", "'")]
JOINED_LETTERS = [("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st")]
DASHES = "‐‑‒–—―−﹘﹣－"
SIGNS = "≥≤‡†\xa0"
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200d}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
RANGE_E = r"\b(\d+)\s*e\s*(\d+)\b"
# Numbers spelt out; unit, the unit it is compared in, and the factor; intervals named by a word, in months.
NUMBER_WORDS = [("one", 1), ("two", 2), ("three", 3), ("four", 4), ("five", 5), ("six", 6), ("seven", 7), ("eight", 8), ("nine", 9), ("ten", 10), ("eleven", 11), ("twelve", 12)]
UNITS = [
    ("mm", "mm", 1.0), ("millimetre", "mm", 1.0), ("millimeter", "mm", 1.0), ("millimetres", "mm", 1.0), ("millimeters", "mm", 1.0),
    ("cm", "mm", 10.0), ("centimetre", "mm", 10.0), ("centimeter", "mm", 10.0), ("centimetres", "mm", 10.0), ("centimeters", "mm", 10.0),
    ("month", "month", 1.0), ("months", "month", 1.0), ("year", "month", 12.0), ("years", "month", 12.0), ("week", "week", 1.0), ("weeks", "week", 1.0),
    ("day", "day", 1.0), ("days", "day", 1.0), ("%", "%", 1.0), ("percent", "%", 1.0), ("mg", "mg", 1.0), ("g", "mg", 1000.0), ("mcg", "mg", 0.001),
]
_UNIT = "|".join(sorted((u for u, _, _ in UNITS), key=lambda u: (-len(u), u)))
MEASUREMENT = rf"(\d+(?:\.\d+)?)\s*({_UNIT})\b"
MEASURED_RANGE = rf"(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*({_UNIT})\b"
INTERVALS = [(r"\bannual\w*\b|\bevery\s+year\b|\byearly\b|\bper\s+year\b", 12.0), (r"\bsix\s+month\w*\b|\bbi[-\s]?annual\w*\b|\bhalf[-\s]?yearly\b", 6.0)]
# Suffixes in the order in which they are tried; negations; words that bring nothing new into a text.
SUFFIXES = ("ations", "ation", "ements", "ement", "ingly", "edly", "ing", "ies", "ied", "ed", "es", "ly", "s")
NEGATIONS = ["not", "no", "never", "against", "contraindicated", "unrecommended", "unsupported", "discouraged"]
EVIDENCE_WORDS = """guideline guidelines recommend recommended recommendation suggest suggested state stated report reported
indicate indicated advise advised consider considered decline declines according evidence clinical patient patients population
populations manage management threshold thresholds diameter diameters aneurysm aneurysms aortic aorta abdominal repair repairs
surveillance imaging image screen screening modality modalities interval intervals elective electively surgical surgery
asymptomatic symptomatic unruptured ruptured rupture maximum minimum larger smaller greater measure measured measurement follow
outcome outcomes risk benefit source sources document documents section passage passages context corpus answer question proposal
proposals propose proposed record records recorded note noted notes describe described mention mentioned adopt adopted agree
agreement disagree disagreement conclude conclusion finding findings statement position positions apply applies based
insufficient sufficient examine examined usable similar similarity retrieval retrieved specific general provide require required
offer offered perform performed treat treatment therapy prefer preference committee issue issued raise raised write writing
strong negative positive believe support supported level grade class women male female adult adults year years month months week
weeks size growth rate case cases study studies trial trials review data result results practice people person cannot should
diagnosis diagnostic trigger triggers value values""".split()
QUALIFIERS = """above below against across beyond before after during unless until since among around under over through toward
towards upon versus regarding concerning explicitly implicitly specifically particularly especially notably typically usually
generally commonly frequently rarely always often sometimes approximately roughly nearly almost merely simply clearly directly
indirectly currently previously subsequently respectively accordingly additionally moreover furthermore instead otherwise
likewise similarly together overall entirely itself themselves onwards alone least prior later earlier first second third
third-party every explicit""".split()


def squashed(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0b\f\r\x{a0}]+", " "))


def present(text: Column) -> Column:
    """Null where the text is missing or a null spelt as text."""
    return F.when(F.lower(F.trim(text)).isin(MISSING), F.lit(None).cast("string")).otherwise(text)


def compared(text: Column) -> Column:
    """The frozen form in which texts are tested: ligatures and quotes expanded, dashes and signs blank,
    lower case, white space collapsed."""
    for a, b in LIGATURES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return squashed(F.lower(F.translate(text, BLANKED, " " * len(BLANKED))))


@cache
def compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """What compatibility normalisation does to single characters: characters that become one other, what these
    become, and characters that become several or none. From the interpreter's Unicode data."""
    one, to, more = [], [], []
    for c in map(chr, range(0xA0, 0x10000)):
        if not "\ud800" <= c <= "\udfff" and (n := unicodedata.normalize("NFKC", c)) != c:
            if len(n) == 1:
                one.append(c), to.append(n)
            else:
                more.append((c, n))
    return "".join(one), "".join(to), more


@cache
def _unsettled() -> str:
    """A short pattern of the characters of which a text in compatibility form may have to be made anew: all but those
    of the usual alphabets and marks that such a form leaves alone."""
    usual = [*range(0xA0), *range(0xA0, 0x180), *range(0x391, 0x3CA), *range(0x400, 0x460), *range(0x2010, 0x2023), *range(0x2030, 0x203B)]
    kept = [c for c in usual if unicodedata.is_normalized("NFKC", chr(c)) and not unicodedata.combining(chr(c))]
    out, first = [], kept[0]
    for a, b in zip(kept, [*kept[1:], -1]):
        if b != a + 1:
            out.append(f"\\x{{{first:x}}}-\\x{{{a:x}}}")
            first = b
    return "[^" + "".join(out) + "]"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Compatibility form; only texts with a character that it concerns leave the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(_unsettled()), text)), text)


def matched(text: Column) -> Column:
    """The form in which quotes are looked for: quotation marks straight, ligatures and wide forms expanded, any dash
    a hyphen, ``30 e 39`` as ``30-39``, signs blank, lower case, white space (with or without width) collapsed."""
    text = F.translate(F.replace(text, F.lit("\xa0"), F.lit(" ")), "".join(a for a, _ in QUOTES), "".join(b for _, b in QUOTES))
    for a, b in JOINED_LETTERS:
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(F.translate(nfkc(text), DASHES, "-" * len(DASHES)), RANGE_E, "$1-$2")
    return F.trim(F.regexp_replace(F.lower(F.translate(text, SIGNS, " " * len(SIGNS))), BLANK, " "))


def matches_loosely(a: Column, b: Column) -> Column:
    """Whether one text in matched form is in the other; blank and null texts match nothing."""
    return F.coalesce((a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)), F.lit(False))


def lexical_tokens(text: Column) -> Column:
    """Words and decimal numbers, lower case, no stop words removed."""
    for a, b in LIGATURES[:5]:
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.translate(text, "".join(a for a, _ in LIGATURES[5:]), "".join(b for _, b in LIGATURES[5:]))
    return F.regexp_extract_all(F.lower(text), F.lit(LEXICAL), F.lit(0))


def content_tokens(form: Column) -> Column:
    """Distinct tokens, of a text in ``matched`` form, of at least two characters that are no stop words."""
    found = F.regexp_extract_all(form, F.lit(CONTENT), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(F.filter(found, lambda x: F.length(x) >= 2), stop)


#: A token in one of its suffixes' alternatives, the first that leaves four characters, and what is left of it.
_STEM, _LEFT = "(?m)^(?:" + "|".join(f"(.{{4,}}){s}" for s in SUFFIXES) + ")$", "".join(f"${i}" for i in range(1, len(SUFFIXES) + 1))


def stem(token: Column) -> Column:
    """The token without the first of the suffixes that leaves four characters."""
    return F.regexp_replace(token, _STEM, _LEFT)


def stems(tokens: Column) -> Column:
    """The distinct stems of an array of tokens, all at once."""
    return F.array_distinct(F.split(stem(F.array_join(tokens, "\n")), "\n"))


def alnum_share(text: Column) -> Column:
    """Letters and digits among the characters that are not white space; null for none."""
    compact = F.regexp_replace(text, r"[ \t\n\x0b\f\r\x{a0}]+", "")
    return F.length(F.regexp_replace(compact, r"[^\p{L}\p{N}]", "")) / F.nullif(F.length(compact), F.lit(0))


def content_type(text: Column, section: Column) -> Column:
    """What a passage is: clinical, reference, toc, boilerplate or title_only; the first rule that holds.
    Null and blank texts are boilerplate."""
    body = F.trim(F.coalesce(text, F.lit("")))
    compact = F.length(F.regexp_replace(body, r"[ \t\n\x0b\f\r]+", ""))
    leaders = F.aggregate(F.regexp_extract_all(body, F.lit(DOT_LEADER), F.lit(0)), F.lit(0), lambda n, x: n + F.length(F.regexp_replace(x, r"[^.]", "")))
    rest = squashed(F.regexp_replace(F.regexp_replace(body, BOILERPLATE, " "), r"(?i)page\s*\d+\s*of\s*\d*|https?://\S+|www\.\S+", " "))
    return (
        F.when(F.length(body) == 0, "boilerplate")
        .when(leaders / F.greatest(compact, F.lit(1)) >= 0.10, "toc")
        .when((compact >= 20) & (alnum_share(body) < 0.20), "boilerplate")
        .when(body.rlike(RECOMMENDATION) & body.rlike(CLINICAL), "clinical")
        .when(F.coalesce(section, F.lit("")).rlike(REFERENCE_SECTION), "reference")
        .when(F.size(F.regexp_extract_all(body, F.lit(CITATION), F.lit(0))) >= 3, "reference")
        .when(body.rlike(BOILERPLATE) & (F.length(rest) < 200) & ~rest.rlike(CLINICAL), "boilerplate")
        .when((F.length(squashed(body)) < 200) & ~squashed(body).rlike(CLINICAL), "title_only")
        .otherwise("clinical")
    )


def extraction_status(text: Column, least: int = 80) -> Column:
    """ok, low_text, corrupted or image_only, by what a page's text holds. Null text is image_only."""
    raw = F.coalesce(text, F.lit(""))
    n = F.length(F.trim(raw))
    lost = F.length(raw) - F.length(F.replace(raw, F.lit("�"), F.lit("")))
    toc = F.size(F.regexp_extract_all(raw, F.lit(r"\.{5,}"), F.lit(0))) >= 4
    filled = F.filter(F.split(raw, "\n"), lambda x: F.length(F.trim(x)) > 0)
    rows = F.size(F.filter(filled, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2))
    table = (rows >= 3) | (rows / F.greatest(F.size(filled), F.lit(1)) >= 0.4)
    sized = F.when(n < least, "low_text").otherwise("ok")
    return (
        F.when(n == 0, "image_only")
        .when((lost >= 12) & (lost / n > 0.02), "corrupted")
        .when(toc | table, sized)
        .when((n >= 80) & (1 - alnum_share(raw) >= 0.65), "corrupted")
        .otherwise(sized)
    )


def numeric_tokens(text: Column) -> Column:
    """Numbers with their signs, ranges and units, in the form in which they are compared."""
    folded = squashed(F.translate(text, "–−", "--"))
    found = F.regexp_extract_all(folded, F.lit(NUMERIC), F.lit(0))
    plain = lambda x: F.replace(F.lower(F.trim(x)), F.lit(" "), F.lit(""))
    return F.transform(found, lambda x: F.replace(F.replace(plain(x), F.lit("≥"), F.lit(">=")), F.lit("≤"), F.lit("<=")))


def novel_stems(tokens: Column, known: Column, ignored: tuple[str, ...] = (*EVIDENCE_WORDS, *QUALIFIERS)) -> Column:
    """Stems of the ``tokens`` of five letters and more that no token of ``known`` shares and that are not those of the
    ``ignored`` words."""
    words = F.regexp_extract_all(F.array_join(tokens, "\n"), F.lit(r"(?m)^\p{L}{5,}$"), F.lit(0))
    skip = F.array(*[F.lit(w) for w in dict.fromkeys(["", *(stem_of(w) for w in ignored)])])
    return F.array_except(F.array_except(stems(words), stems(known)), skip)


def stem_of(word: str) -> str:
    """``stem`` of a plain string."""
    return next((word[: -len(s)] for s in SUFFIXES if len(word) - len(s) >= 4 and word.endswith(s)), word)


def quantities(form: Column) -> Column:
    """Quantities of a text in ``matched`` form, in comparable units: distinct structs of unit and value. Numbers may be
    spelt out, ranges give both ends, and some intervals are words; numbers without a unit don't count."""
    for word, n in NUMBER_WORDS:
        form = F.regexp_replace(form, rf"\b{word}\b", str(n))
    unit = F.create_map(*[F.lit(x) for u, c, _ in UNITS for x in (u, c)])
    factor = F.create_map(*[F.lit(x) for u, _, f in UNITS for x in (u, f)])

    def found(pattern: str, value: int, of: int) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(form, F.lit(pattern), F.lit(value)).alias("v"), F.regexp_extract_all(form, F.lit(pattern), F.lit(of)).alias("u"))
        return F.transform(both, lambda x: F.struct(unit[x["u"]].alias("unit"), F.round(x["v"].cast("double") * factor[x["u"]], 4).alias("value")))

    named = [F.when(form.rlike(p), F.struct(F.lit("month").alias("unit"), F.lit(m).alias("value"))) for p, m in INTERVALS]
    intervals = F.filter(F.array(*named), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(found(MEASURED_RANGE, 1, 3), found(MEASURED_RANGE, 2, 3), found(MEASUREMENT, 1, 2), intervals))


def polarity(form: Column) -> Column:
    """negative, positive, or null, of a text in ``matched`` form; a negated stance dominates."""
    s = form
    return F.when(s.rlike(NEGATIVE) | s.rlike(NEGATED_STANCE), "negative").when(s.rlike(POSITIVE), "positive")


def slug(text: Column, length: int = 80) -> Column:
    """Letters and digits joined by underscores."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""), 1, length)


def token_estimate(text: Column) -> Column:
    """A rough number of tokens for budgets."""
    return (F.floor(F.length(text) / 3.5) + 256).cast("long")
