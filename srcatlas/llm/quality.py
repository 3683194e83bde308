"""Operator 8: line-first quality rules, in DataFrame functions only.

Every line of a text is judged on its own (sentence punctuation, navigation, boilerplate,
shouting, symbols, lines repeated).  Failing lines are removed, and a document is kept if
enough words survive and its base counts pass.

Defined cases: a null text is an empty text, has all counts 0 and is rejected; a null doc_id
is carried through; repeated rows are judged each on their own; extra columns of the input
are ignored by `quality_report` and carried by `quality_filter`, which removes the failing lines
of the documents that it keeps (lines without a word stay).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE_CLASS = r"[ \t\n\x0B\f\r]"
SYMBOLS = "#*$%&|<>"
#: Fixed phrases (lower case) that mark a line as site or licence boilerplate.
BOILERPLATE = (
    "all rights reserved", "licensed under", "this work is licensed", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "use cookies", "javascript", "lorem ipsum", "sign up for", "log in",
    "subscribe to our", "click here", "share this", "read more",
)

#: Production parameters.
RULES = {
    "min_words": 20,  # base rule
    "max_repeat_percent": 30,  # base rule: words in repeated windows
    "window": 8,  # words of a repeated window
    "max_line_symbol_percent": 50,  # symbols to words of a line
    "max_line_shout_percent": 50,  # words ending in !! to words of a line
    "max_line_separator_percent": 20,  # words that are only a separator, as in menus
    "max_boilerplate_chars": 200,  # longer lines are neither boilerplate nor headings
    "min_unpunctuated_words": 10,  # shorter lines must end in a mark
    "stutter": r"(?:^| )(\S+)(?: \1){4}(?: |$)",  # a word five times in a row
    "min_kept_percent": 40,  # words that must survive the line rules
}


def _squeezed(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, SPACE_CLASS + "+", " "), F.lit(" "))


def _count_words(text: Column) -> Column:
    return F.size(F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), SPACE_CLASS + "+"))


def line_fails(line: Column, rules: dict = RULES) -> Column:
    """True for a line that a rule rejects; lines without a word never count.

    Costly tests stand behind cheap ones: most lines hold no symbol at all, and only short
    lines can be boilerplate or lack their final mark.
    """
    words = _count_words(line)
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    separators = F.length(line) - F.length(F.translate(line, "|»›•", ""))
    low = F.lower(line)
    boiler = F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | low.contains(phrase)
    ends = line.rlike(r"""[.!?:;,…。]["')\]»”]*[ \t\n\x0B\f\r]*$""")
    return (
        (line.rlike(r"[#*$%&|<>»›•]") & ((symbols * 100 > words * rules["max_line_symbol_percent"]) | (separators * 100 > words * rules["max_line_separator_percent"])))
        | (line.contains("!!") & (shouts * 100 > words * rules["max_line_shout_percent"]))
        | ((F.length(line) < rules["max_boilerplate_chars"]) & (boiler | ((words < rules["min_unpunctuated_words"]) & ~ends)))
        | line.rlike(rules["stutter"])
    )


def _measure(docs: DataFrame, text: str, rules: dict) -> DataFrame:
    """Counts as columns prefixed q_; the steps are separate projections so that none is evaluated twice."""
    w = rules["window"]
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("q_text", t).withColumn("q_flat", _squeezed(F.col("q_text")))
    df = df.withColumn("q_words", F.when(F.col("q_flat") == "", F.array().cast("array<string>")).otherwise(F.split("q_flat", " ")))
    df = df.withColumns(
        {
            "n_words": F.size("q_words").cast("long"),
            "word_chars": (F.length("q_flat") - F.greatest(F.size("q_words") - 1, F.lit(0))).cast("long"),
            "n_symbols": F.when(
                F.col("q_text").rlike(r"[#*$%&|<>]"), F.length("q_text") - F.length(F.translate("q_text", SYMBOLS, ""))
            )
            .otherwise(0)
            .cast("long"),
            "q_lines": F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")),
            "q_hash": F.transform("q_words", lambda x: F.xxhash64(x)),
        }
    )
    # The fingerprint of the window at each position; positions too near the end have none.
    df = df.withColumn(
        "q_win",
        F.when(
            F.col("n_words") > w,
            F.expr(f"transform(sequence(1, size(q_hash) - {w - 1}), i -> xxhash64({', '.join(f'q_hash[i + {k}]' for k in range(-1, w - 1))}))"),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Few texts repeat a window; only those sort (fingerprint, position) pairs.
    df = df.withColumn(
        "q_sorted",
        F.when(
            F.size(F.array_distinct("q_win")) < F.size("q_win"),
            F.expr("array_sort(transform(q_win, (h, i) -> struct(h AS h, i AS i)))"),
        ),
    )
    df = df.withColumn(
        "q_at",
        F.when(
            F.col("q_sorted").isNotNull(),
            F.expr(
                "array_sort(transform(filter(q_sorted, (x, k) -> (k > 0 AND x.h = q_sorted[k - 1].h)"
                " OR (k + 1 < size(q_sorted) AND x.h = q_sorted[k + 1].h)), x -> x.i))"
            ),
        ),
    )
    df = df.withColumn(
        "n_repeat_words",
        F.coalesce(
            F.expr(f"aggregate(transform(q_at, (p, k) -> if(k + 1 < size(q_at), least({w}, q_at[k + 1] - p), {w})), 0L, (a, x) -> a + x)"),
            F.lit(0).cast("long"),
        ),
    )
    df = df.withColumn("n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
    df = df.withColumn("q_good", F.filter("q_lines", lambda x: ~line_fails(x, rules)))
    df = df.withColumn(
        "kept_words",
        F.aggregate("q_good", F.lit(0).cast("long"), lambda a, x: a + _count_words(x)),
    )
    df = df.withColumn(
        "base_failed",
        (F.col("n_words") < rules["min_words"])
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules["max_repeat_percent"]),
    )
    return df.withColumn(
        "kept", ~F.col("base_failed") & (F.col("kept_words") * 100 >= F.col("n_words") * rules["min_kept_percent"])
    )


REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")


def quality_report(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: dict = RULES) -> DataFrame:
    """Per document: the base counts, the words that survive the line rules, and the verdict."""
    return _measure(docs.select(key, text), text, rules).select(key, *REPORT)


def clean_text(docs: DataFrame, text: str = "text", rules: dict = RULES) -> DataFrame:
    """The documents with failing lines removed from the text; line order is kept."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    good = F.filter(lines, lambda x: (~x.rlike(r"[^ \t\n\x0B\f\r]")) | ~line_fails(x, rules))
    return docs.withColumn(text, F.array_join(good, "\n"))


def quality_filter(docs: DataFrame, text: str = "text", rules: dict = RULES, length: str = "n_chars") -> DataFrame:
    """The documents kept, without their failing lines, with their own columns only, whatever these are named.

    A column `length` is computed again from the text that is left.
    """
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row"), F.col(f"`{text}`").alias("q_in"))
    # The id keeps the optimiser from moving the filter below the counts, which would repeat them.
    judged = _measure(inner, "q_in", rules).select("q_row", "q_in", "kept", F.monotonically_increasing_id().alias("q_id"))
    clean = clean_text(judged.where("kept AND q_id >= 0"), "q_in", rules)
    new = {text: F.col("q_in")} | {f.name: F.length("q_in").cast(f.dataType) for f in docs.schema if f.name == length}
    return clean.select(*[new.get(c, F.col(f"q_row.`{c}`")).alias(c) for c in docs.columns])
