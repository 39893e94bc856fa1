"""Line-first quality rules, in DataFrame expressions only.

Each line is judged by its punctuation, navigation marks and boilerplate phrases; failing lines go, and a document
that loses too much of its text, or fails the rules for whole documents, is rejected. There is no shuffle and no
Python: a document is judged inside its row. Arrays that are used more than once are bound once with ``let``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitebrief.llm.common import SPACE

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
# Phrases of notices and page furniture, and the ends of sentences.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie", "javascript",
    "lorem ipsum", "click here", "read more", "sign up", "log in", "subscribe", "share on", "skip to content",
    "follow us", "add to cart", "powered by", "page not found",
)
SENTENCE_END = r"""[.!?…。！？:;][\x22')\]»”’]*$"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value that is used several times, so that it is evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_in(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(words: Column, size: int = 3) -> Column:
    """Number of words inside ``size``-word windows that are found twice or more, the first included.

    Windows are sorted by hash (64 bits) and position; neighbours with equal hashes repeat. Their positions, in order,
    cover as many words each as there are up to the next one, ``size`` at most. Time is n log n for any text.
    """
    def positions(windows: Column) -> Column:
        last = F.size(windows)
        same = lambda a, b: F.coalesce(F.get(windows, a)["h"] == F.get(windows, b)["h"], F.lit(False))
        repeated = F.filter(windows, lambda w, i: ((i > 0) & same(i, i - 1)) | ((i + 1 < last) & same(i, i + 1)))
        return F.sort_array(F.transform(repeated, lambda w: w["p"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(size)), F.lit(size)))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap)

    def sorted_windows(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - size)
        each = F.transform(starts, lambda p: F.struct(F.xxhash64(*[F.get(w, p + k) for k in range(size)]).alias("h"), p.alias("p")))
        return F.sort_array(each)

    some = lambda w: let(sorted_windows(w), lambda s: let(positions(s), covered))
    return let(words, lambda w: F.when(F.size(w) >= size, some(w)).otherwise(F.lit(0).cast("bigint")))


def line_fails(line: Column) -> Column:
    """The rules for one line with words: no sentence end, navigation, boilerplate, symbols.

    Words are counted by their gaps; a short line has ten words at most. Long lines of plain prose never fail.
    """
    def rules(x: Column) -> Column:
        words = F.length(x) - F.length(F.translate(x, BLANKS, "")) + 1
        short = words <= 10
        low = F.lower(x)
        boilerplate = short & F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda p: F.contains(low, p))
        marks = F.length(x) - F.length(F.translate(x, "|»›·•>", ""))
        symbols = F.length(x) - F.length(F.translate(x, SYMBOLS, ""))
        return (boilerplate | ((marks >= 2) & (marks * 4 >= words)) | (symbols * 10 >= F.length(x))
                | (short & ~F.rlike(x, F.lit(SENTENCE_END))))
    return let(F.btrim(line, F.lit(BLANKS)), rules)


def clean_lines(lines: Column) -> Column:
    """The lines that pass; lines without a word go with them."""
    return F.filter(lines, lambda line: ~line_fails(line))


def measure(documents: DataFrame, text: str = "text", max_loss: float = 0.5) -> DataFrame:
    """Adds the rules' figures, ``base_failed``, ``cleaned`` (what is left of the text) and ``kept``.

    ``kept``: the base rules hold and the lines removed hold no more than ``max_loss`` of the word characters. A null
    or empty text has no words and fails. Repeated rows are judged alike; columns of these names are replaced.
    """
    out = documents.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    # The rows below are kept apart by a generator over one element, so that no expression is evaluated twice.
    out = out.withColumn("_w", F.explode(F.array(words_in(F.col("_text")))))
    with_word = F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_lines", F.explode(F.array(with_word)))
    chars = lambda text: F.length(F.translate(text, BLANKS, "")).cast("bigint")
    out = out.withColumn("_good", F.explode(F.array(clean_lines(F.col("_lines")))))
    out = out.withColumn("_m", F.explode(F.array(F.struct(
        F.size("_w").cast("bigint").alias("n_words"),
        chars(F.col("_text")).alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_w")).alias("n_repeat_words"),
        chars(F.array_join("_good", "\n")).alias("left_chars")))))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "left_chars")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    lost = F.col("left_chars") < (1 - max_loss) * F.col("word_chars")
    return (out.withColumns({n: F.col("_m")[n] for n in names})
            .withColumns({"base_failed": failed, "kept": ~failed & ~lost, "cleaned": F.array_join("_good", "\n")})
            .drop("_text", "_w", "_lines", "_good", "_m"))


def quality_table(documents: DataFrame) -> DataFrame:
    """The contract's digest: one row per row of ``documents``; an empty table gives no rows."""
    return measure(documents.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "left_chars")


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that pass, with their columns as they were (a filter: texts are not rewritten).

    Null and empty texts go; repeated rows pass or go together; other columns, whatever their names, stay; an empty table
    stays empty.
    """
    names = documents.columns
    return measure(documents.select(F.struct(*names).alias("_row"), F.col("text"))).filter("kept").select("_row.*")
