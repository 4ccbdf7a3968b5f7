"""Quality rules as a ledger of bitmasks.

:func:`ledger` measures every document and evaluates every rule once; a row keeps the measurements and one ``long`` in which bit i
says that rule i failed. Policies are versions: each names the rules that reject, so that applying one is ``failed & mask != 0`` and never
reads a text again. :func:`ablation` shows what each rule does to each policy by counting masks, the text long gone.

A missing or empty text has no words and fails every rule that needs some. Rows that repeat a doc_id are judged separately. DataFrame functions
only; a document is one row and nothing is shuffled to judge it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# (name, what fails): the order gives the bits, so new rules go to the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    ("repeated_lines", "n_lines > 1 and 100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "n_words > 0 and 100 * n_upper > 60 * n_letters and n_letters > 0"),
    ("exclamations", "10 * n_marks > 5 * n_words"),
    ("no_letters", "100 * n_letters < 40 * word_chars"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "word_length"],
    "v2": [name for name, _ in RULES],
}
CURRENT = "v2"


def mask_of(policy: str) -> int:
    return sum(1 << BIT[name] for name in POLICIES[policy])


def _doubled(h: Column, gap: int) -> Column:
    """Hashes of runs of ``2 * gap`` words from those of ``gap`` words."""
    rest = F.slice(h, gap + 1, F.greatest(F.size(h) - gap, F.lit(0)))
    return F.filter(F.zip_with(h, rest, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))), lambda x: x.isNotNull())


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the measurements of each text."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = (text.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
             .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != ""))
             .withColumn("bare", F.translate("text", SPACES, "")))
    found = found.select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.length("bare").cast("long").alias("word_chars"),
        (F.length("bare") - F.length(F.translate("bare", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("bare") - F.length(F.translate("bare", "!?", ""))).cast("long").alias("n_marks"),
        F.length(F.regexp_replace("bare", r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("bare", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    measures = [c for c in found.columns if c != "words"]
    found = found.select(*measures, F.transform("words", lambda w: F.xxhash64(w)).alias("h1"))
    for gap, name, last in ((1, "h2", "h1"), (2, "h4", "h2"), (4, "h8", "h4")):
        found = found.select(*measures, _doubled(F.col(last), gap).alias(name))
    # only texts in which some window repeats are sorted: (hash, place), neighbours compared, and the places put in order
    placed = F.when(F.size("h8") > F.size(F.array_distinct("h8")),
                    F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    found = found.select(*measures, placed.alias("runs"))
    pairs = F.zip_with(F.slice("runs", 1, F.size("runs") - 1), F.slice("runs", 2, F.size("runs") - 1),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    places = F.when(F.col("runs").isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.array_compact(pairs)))))
    found = found.select(*measures, places.alias("places"))
    gaps = F.zip_with(F.slice("places", 1, F.size("places") - 1), F.slice("places", 2, F.size("places") - 1),
                      lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size("places") > 1, F.aggregate(gaps, F.lit(WINDOW), lambda total, x: total + x)).otherwise(0)
    return found.select(*measures, covered.cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, measurements, failed): every rule evaluated once, its result in one bit."""
    bits = [F.when(F.expr(test), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, test) in enumerate(rules)]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured(docs).withColumn("failed", failed)


def apply_policy(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with the verdict of a policy and the rules that decided it."""
    hit = F.col("failed").bitwiseAND(F.lit(mask_of(policy)))
    return book.withColumn("kept", hit == 0).withColumn("rejected_by", hit)


def ablation(book: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """(policy, rule, failed, alone, kept_without, kept, docs): per policy and rule, how many documents fail it, fail only it, and would be
    kept without it. Masks are counted first, so at most 2**rules rows go on."""
    masks = book.groupBy("failed").count()
    out = None
    for policy in policies or list(POLICIES):
        own = F.col("failed").bitwiseAND(F.lit(mask_of(policy)))
        for name in POLICIES[policy]:
            bit = F.lit(1 << BIT[name])
            one = masks.agg(
                F.sum(F.when(own.bitwiseAND(bit) != 0, F.col("count")).otherwise(0)).alias("failed"),
                F.sum(F.when(own == bit, F.col("count")).otherwise(0)).alias("alone"),
                F.sum(F.when((own == 0) | (own == bit), F.col("count")).otherwise(0)).alias("kept_without"),
                F.sum(F.when(own == 0, F.col("count")).otherwise(0)).alias("kept"),
                F.sum("count").alias("docs"),
            ).select(F.lit(policy).alias("policy"), F.lit(name).alias("rule"), "*")
            out = one if out is None else out.unionByName(one)
    return out
