"""Text column builders. Everything here stays inside the JVM: no Python per row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the plain letters they fold to.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿß"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyys"

# Characters that count as white space around a text.
BLANKS = " \t\n\r\f"

# HTML entities and their characters.
ENTITIES = [
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&#xF3;", "ó"),
    ("&#xE1;", "á"),
    ("&#xE9;", "é"),
    ("&#xED;", "í"),
    ("&#xFA;", "ú"),
    ("&#xF1;", "ñ"),
    ("&#xC1;", "Á"),
    ("&#xC9;", "É"),
    ("&#xCD;", "Í"),
    ("&#xD3;", "Ó"),
    ("&#xDA;", "Ú"),
    ("&#x2019;", "'"),
    ("&#x201C;", '"'),
    ("&#x201D;", '"'),
]

PARAGRAPH_BREAK = "\n{2,}"


def strip(col: Column) -> Column:
    """Trim every kind of white space (``trim`` alone only removes spaces)."""
    return F.btrim(col, F.lit(BLANKS))


def replace(col: Column, *pairs: tuple[str, str]) -> Column:
    """Apply regex replacements left to right."""
    for pattern, replacement in pairs:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def fold(col: Column) -> Column:
    """Lower case without accents; one character in, one character out."""
    return F.translate(F.lower(col), ACCENTED, PLAIN)


def normalise(col: Column) -> Column:
    """Matching form: folded, punctuation as space, single spaces, trimmed."""
    return strip(replace(fold(col), ("[¿?¡!.,;:]", " "), (r"\s+", " ")))


def normalise_literal(text: str) -> str:
    """The matching form of a constant."""
    plain = text.lower().translate(str.maketrans(ACCENTED, PLAIN))
    return " ".join(re.sub("[¿?¡!.,;:]", " ", plain).split())


def tokens(col: Column) -> Column:
    """Array of folded alphanumeric words in text order."""
    return F.filter(F.split(fold(col), "[^a-z0-9]+"), lambda w: w != "")


def estimate_tokens(col: Column) -> Column:
    """Token estimate used for sizing chunks: a quarter of the characters, rounded up."""
    return F.ceil(F.length(col) / 4).cast("int")


def article_label(col: Column) -> Column:
    """Article number as written, with single spaces."""
    return F.regexp_replace(strip(col), r"\s+", " ")


def html_to_text(html: Column) -> Column:
    """Markup to text: block ends become line breaks, other tags a space, entities their character."""
    text = replace(
        html,
        (r"(?is)<script.*?</script>", ""),
        (r"(?is)<style.*?</style>", ""),
        (r"(?i)<br\s*/?>", "\n"),
        (r"(?i)</p>", "\n\n"),
        (r"(?i)</div>", "\n"),
        (r"<[^>]+>", " "),
    )
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return strip(replace(text, (r"\s{4,}", "\n\n"), (r"[ \t]{3,}", " ")))
