"""Text normalisation as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mis-decoded sequences, longest first.
MOJIBAKE = (
    ("â€™", "'"), ("â€œ", '"'), ("â€¢", "•"), ('â€"', "-"), ("â€", '"'),
    ("Ã©", "é"), ("Ã¨", "è"), ("Ãª", "ê"), ("Ã«", "ë"), ("Ã¡", "á"), ("Ã ", "à"),
    ("Ã¢", "â"), ("Ã£", "ã"), ("Ã±", "ñ"), ("Ãº", "ú"), ("Ã¼", "ü"), ("Ã§", "ç"),
)
# Misspellings.
TYPOS = (
    ("recieve", "receive"), ("seperate", "separate"), ("occured", "occurred"), ("definately", "definitely"),
    ("acheive", "achieve"), ("wierd", "weird"), ("tomm?orow", "tomorrow"), ("embarass", "embarrass"),
    ("maintance", "maintenance"), ("pronounciation", "pronunciation"), ("rhythm", "rhythm"),
    ("occassion", "occasion"), ("commited", "committed"), ("goverment", "government"),
    ("labratory", "laboratory"), ("neccessary", "necessary"), ("publically", "publicly"),
)
# Abbreviations; they count only with a word character right after the dot.
ABBREVIATIONS = (
    ("St", "Street"), ("Ave", "Avenue"), ("Blvd", "Boulevard"), ("Dr", "Drive"), ("Ln", "Lane"), ("Rd", "Road"),
    ("Inc", "Inc"), ("Corp", "Corp"), ("Ltd", "Ltd"), ("Co", "Co"), ("Dept", "Department"),
    ("Jan", "January"), ("Feb", "February"), ("Mar", "March"), ("Apr", "April"), ("Jun", "June"),
    ("Jul", "July"), ("Aug", "August"), ("Sep", "September"), ("Oct", "October"), ("Nov", "November"),
    ("Dec", "December"),
)
# Tokens with a standard spelling.
TOKENS = {
    "True": ("true", "yes", "1", "t", "y"),
    "False": ("false", "no", "0", "f", "n"),
    "Enabled": ("enabled", "active", "on"),
    "Disabled": ("disabled", "inactive", "off"),
}
# Column-name hints for casing.
TITLE_NAMES = ("name", "first", "last", "person", "customer", "address", "city", "state", "country")
LOWER_NAMES = ("email", "mail")


def fix_encoding(text: Column) -> Column:
    fixed = text
    for bad, good in MOJIBAKE:
        fixed = F.replace(fixed, F.lit(bad), F.lit(good))
    return F.when(text.contains("â€") | text.contains("Ã"), fixed).otherwise(text)


def squeeze(text: Column) -> Column:
    """Trim and collapse white space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _replace_words(text: Column, words, tail: str) -> Column:
    for word, new in words:
        text = F.regexp_replace(text, rf"(?U)\b{word}{tail}\b", new)
    return text


def fix_typos(text: Column) -> Column:
    """Tried only on texts that hold one of the misspellings."""
    some = F.lit(False)
    for word, _ in TYPOS:
        for spelling in sorted({word.replace("m?", ""), word.replace("?", "")}):
            some = some | text.contains(spelling)
    return F.when(some, _replace_words(text, TYPOS, "")).otherwise(text)


def expand_abbreviations(text: Column) -> Column:
    """Tried only on texts with a word character right after a dot."""
    some = text.rlike(r"\.[\p{L}\p{N}_]")
    return F.when(some, _replace_words(text, ABBREVIATIONS, r"\.")).otherwise(text)


def title_case(text: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), ""
    )


def case_by_name(text: Column, name: str) -> Column:
    lowered = name.lower()
    if any(hint in lowered for hint in TITLE_NAMES):
        return title_case(text)
    return F.lower(text) if any(hint in lowered for hint in LOWER_NAMES) else text


def strip_special(text: Column) -> Column:
    """Keep letters, digits, underscore, space and . - @ , ; : ' and double quotes."""
    return F.regexp_replace(text, r"""[^\p{L}\p{N}_\s.\-@,;:'"]""", "")


def standard_tokens(text: Column) -> Column:
    known = F.create_map(*[F.lit(x) for new, words in TOKENS.items() for w in words for x in (w, new)])
    longest = max(len(w) for words in TOKENS.values() for w in words)
    return F.when(F.length(text) <= longest, F.coalesce(F.element_at(known, F.lower(text)), text)).otherwise(text)


def steps(name: str) -> list[tuple[str, Callable[[Column], Column]]]:
    """The normalisation steps of a column, in order."""
    return [
        ("encoding and whitespace", lambda text: squeeze(fix_encoding(text))),
        ("typos", fix_typos),
        ("abbreviations", expand_abbreviations),
        ("casing and special characters", lambda text: strip_special(case_by_name(text, name))),
        ("tokens", standard_tokens),
    ]


# Words dropped or shortened before values are compared.
COMPARE_WORDS = (
    ("inc", ""), ("llc", ""), ("ltd", ""), ("corp", ""), ("company", ""), ("street", "st"), ("avenue", "ave"),
    ("road", "rd"), ("boulevard", "blvd"), ("mister", "mr"), ("mrs", ""), ("miss", "ms"), ("doctor", "dr"),
    ("incorporated", ""), ("limited", ""),
)


def comparable(text: Column) -> Column:
    """Folded form in which near-equal values are compared."""
    text = F.regexp_replace(squeeze(F.lower(text)), r"[^\p{L}\p{N}_\s]", "")
    for word, short in COMPARE_WORDS:
        text = F.regexp_replace(text, rf"(?U)\b{word}\b", short)
    return F.regexp_replace(text, r"^\s+|\s+$", "")
