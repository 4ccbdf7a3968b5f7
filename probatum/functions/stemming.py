"""Spanish stems of a table of terms, by the published suffix-stripping rules for Spanish. JVM expressions only.

Suffixes count where they lie in a region of the word: R1 follows the first consonant after a vowel, R2 is the same within R1, RV follows the
next vowel (second letter a consonant), the next consonant (two vowels in front) or the third letter. Rules are applied to distinct terms, a
vocabulary's worth of rows, each step in a projection of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Vowels, and the suffixes of each step of the Spanish rules.
VOWELS = "aeiouáéíóúü"
PRONOUNS = "me se sela selo selas selos la le lo las les los nos"
BEFORE_PRONOUN = "iéndo ándo ár ér ír iendo ando ar er ir"
PLAIN_SUFFIXES = ("anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos "
                  "imiento imientos")
AGENT_SUFFIXES = "adora ador ación adoras adores aciones ante antes ancia ancias"
Y_VERBS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos"
SHORT_VERBS = "en es éis emos"
VERBS = ("arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
         "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían "
         "aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais "
         "arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos")
ACUTE, PLAIN = "áéíóú", "aeiou"


def any_of(suffixes: str) -> str:
    return "(?:" + "|".join(suffixes.split()) + ")"


# What each suffix of the standard step needs, in the order of their names: the region it must lie in, what takes its place, and what goes besides.
STANDARD = [
    ("plain", any_of(PLAIN_SUFFIXES)), ("agent", any_of(AGENT_SUFFIXES)), ("logia", "logías?"), ("ucion", "(?:ución|uciones)"), ("encia", "encias?"), ("amente", "amente"),
    ("mente", "mente"), ("idad", "idad(?:es)?"), ("iva", "iv[ao]s?"),
]


def _tail(word: Column, suffix: str) -> Column:
    """The longest end of a word that is one of the suffixes, or an empty text: a match that must reach the end starts as early as it can."""
    return F.regexp_extract(word, f"({suffix})$", 1)


def _without(word: Column, tail: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.length(tail))


def _inside(word: Column, tail: Column, region: str) -> Column:
    """Whether an end of the word lies in a region, given by the letters in front of it."""
    return (F.length(tail) > 0) & (F.length(word) - F.length(tail) >= F.col(region))


def _drop(word: Column, suffix: str, region: str = "r2") -> Column:
    tail = _tail(word, suffix)
    return F.when(_inside(word, tail, region), _without(word, tail)).otherwise(word)


def _regions(terms: DataFrame) -> DataFrame:
    v, c = f"[{VOWELS}]", f"[^{VOWELS}]"
    w = F.col("word")

    def after(pattern: str) -> Column:
        found = F.length(F.regexp_extract(w, pattern, 0))
        return F.when(found > 0, found).otherwise(F.length(w))

    rv = (F.when(w.rlike(f"^.{c}"), after(f"^.{c}+{v}")).when(w.rlike(f"^{v}{v}"), after(f"^{v}{v}+{c}")).otherwise(F.least(F.lit(3), F.length(w))))
    return terms.withColumns({"r1": after(f"^{c}*{v}+{c}"), "r2": after(f"^{c}*{v}+{c}+{v}+{c}"), "rv": rv})


def stem_terms(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """``terms`` with a column ``stem``. Terms are lower-cased first; a missing term has no stem."""
    columns = terms.columns
    rows = _regions(terms.withColumn("word", F.lower(term_col)))
    # attached pronouns
    w = F.col("word")
    pronoun = _tail(w, any_of(PRONOUNS))
    rows = rows.withColumn("pronoun", pronoun)
    base = _without(w, F.col("pronoun"))
    verb, yendo = _tail(base, any_of(BEFORE_PRONOUN)), base.endswith("uyendo") & (F.length(base) - 5 >= F.col("rv"))
    bare = F.concat(_without(base, verb), F.translate(verb, ACUTE, PLAIN))
    rows = rows.withColumn("word", F.when((F.length("pronoun") > 0) & _inside(base, verb, "rv"), bare).when((F.length("pronoun") > 0) & yendo, base).otherwise(w))
    # standard suffixes
    rows = rows.withColumn("tail", _tail(w, "|".join(s for _, s in STANDARD)))
    tail, rest = F.col("tail"), _without(w, F.col("tail"))
    fits = lambda region: F.length(rest) >= F.col(region)
    kind = {name: tail.rlike(f"^(?:{suffix})$") for name, suffix in STANDARD}
    after_iv = F.when(_inside(rest, _tail(rest, "iv"), "r2"), _drop(_drop(rest, "iv"), "at")).otherwise(_drop(rest, "os|ic|ad"))
    done = (F.when(F.length("tail") == 0, F.lit(None))
            .when(kind["amente"] & fits("r1"), after_iv)
            .when(kind["amente"] | ~fits("r2"), F.lit(None))
            .when(kind["plain"], rest).when(kind["agent"], _drop(rest, "ic")).when(kind["logia"], F.concat(rest, F.lit("log")))
            .when(kind["ucion"], F.concat(rest, F.lit("u"))).when(kind["encia"], F.concat(rest, F.lit("ente")))
            .when(kind["mente"], _drop(rest, "ante|able|ible")).when(kind["idad"], _drop(rest, "abil|ic|iv")).otherwise(_drop(rest, "at")))
    rows = rows.withColumn("standard", done)
    # verbs, where no standard suffix went
    region = F.substring(w, F.col("rv") + 1, F.length(w))
    rows = rows.withColumns({"y": _tail(region, any_of(Y_VERBS)), "verb": _tail(region, any_of(f"{SHORT_VERBS} {VERBS}"))})
    cut, short = _without(w, F.col("verb")), F.col("verb").isin(*SHORT_VERBS.split())
    gone = F.when(short & cut.endswith("gu"), _without(cut, F.lit("u"))).otherwise(cut)
    y_cut = _without(w, F.col("y"))
    rows = rows.withColumn("word", F.coalesce("standard", F.when((F.length("y") > 0) & y_cut.endswith("u"), y_cut).otherwise(gone)))
    # what is left at the end
    region = F.substring(w, F.col("rv") + 1, F.length(w))
    rows = rows.withColumn("tail", _tail(region, "os|a|o|á|í|ó|e|é"))
    rest = _without(w, F.col("tail"))
    gu = F.col("tail").isin("e", "é") & rest.endswith("gu") & (F.length(rest) - 1 >= F.col("rv"))
    rows = rows.withColumn("word", F.when(gu, _without(rest, F.lit("u"))).otherwise(rest))
    return rows.select(*columns, F.translate(w, ACUTE, PLAIN).alias("stem"))
