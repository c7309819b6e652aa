"""Fill-in-middle transformation by escaped marker injection.

A delimiter that the escaped text cannot hold is appended to every unit by one
``regexp_replace``; counting it gives the number of units, ``substring_index``
the first or last so many of them. What is cut is freed of delimiters and
unescaped, and prefix, suffix and middle are put together around the markers.
Built-in functions only; a row depends on no other, so that nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import clean_text

#: A unit: a word with the white space before it, or white space that ends the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Prefix, suffix and middle are announced by these.
MARKERS = ("<P>", "<S>", "<M>")
#: Neither is white space, so that escaping leaves units what they were.
DELIMITER, ESCAPE = "\x02", "\x01"
#: The delimiter and the escape sign in an escaped text.
ESCAPED = {ESCAPE: ESCAPE + "e", DELIMITER: ESCAPE + "d"}


def escape(text: Column) -> Column:
    """The text without any delimiter; the escape sign goes first."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED[ESCAPE])), F.lit(DELIMITER), F.lit(ESCAPED[DELIMITER]))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPED[DELIMITER]), F.lit(DELIMITER)), F.lit(ESCAPED[ESCAPE]), F.lit(ESCAPE))


def inject(text: Column) -> Column:
    """The escaped text with a delimiter after each unit."""
    return F.regexp_replace(escape(text), f"({UNIT})", f"$1{DELIMITER}")


def unit_count(marked: Column) -> Column:
    return (F.length(marked) - F.length(F.replace(marked, F.lit(DELIMITER), F.lit("")))).cast("long")


def units(marked: Column, start: Column, end: Column) -> Column:
    """Units ``start`` to ``end``, the latter not included, as they stood in the text."""
    first = F.call_function("substring_index", marked, F.lit(DELIMITER), end.cast("int"))
    cut = F.call_function("substring_index", first, F.lit(DELIMITER), (start - end).cast("int"))
    return F.when(start < end, unescape(F.replace(cut, F.lit(DELIMITER), F.lit("")))).otherwise("")


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from a digest of the seed and the decimal key; a null key draws as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text, rebuilt from an output and its form alone."""
    p, s, m = markers
    tail = lambda mark: F.substring_index(output, mark, -1)
    head = lambda text, mark: F.substring_index(text, mark, 1)
    middle = tail(m)
    psm = F.concat(head(tail(p), s), middle, head(tail(s), m))
    spm = F.concat(head(tail(p), m), middle, head(tail(s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, markers: Sequence[str] = MARKERS) -> DataFrame:
    """Training texts whose middle comes last, ``rate`` of a hundred documents, and the others as they are.

    Columns: the key, ``n`` (units), ``form`` (``plain``, ``psm`` or ``spm``, the
    last for ``spm_rate`` of a hundred transformed ones), ``prefix``, ``middle``,
    ``suffix`` (null if plain) and ``output``. Null and empty texts, and those that
    hold a marker, stay plain. Cuts depend on the key and the seed alone, so
    repeated rows get equal results; null keys are cut alike. An empty table gives
    none. Other columns, also of these names, are ignored. Texts of any length are
    taken whole; one row holds some copies of its text.
    """
    if len(set(markers)) < 3 or any(a in b for a in markers for b in markers if a != b) or any(m[:1] in m[1:] or not m for m in markers):
        raise ValueError("three markers are needed of which none holds another one or its own first sign again")
    p, s, m = (F.lit(x) for x in markers)
    h1, h2, h3, h4 = draws(F.col("_key"), seed)
    rows = docs.select(F.col(key).alias("_key"), clean_text(text).alias("_text"))
    plain = (F.col("_text") == "") | (h3 % 100 >= rate)
    for mark in (p, s, m):
        plain = plain | F.contains(F.col("_text"), mark)
    rows = rows.withColumns({"_form": F.when(plain, "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm"), "_marked": inject(F.col("_text"))})
    rows = rows.withColumn("n", unit_count(F.col("_marked")))
    rows = rows.withColumns({"_lo": F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)), "_hi": F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1))})
    cut = lambda a, b: F.when(F.col("_form") != "plain", units(F.col("_marked"), a, b))
    rows = rows.withColumns({"prefix": cut(F.lit(0), F.col("_lo")), "middle": cut(F.col("_lo"), F.col("_hi")), "suffix": cut(F.col("_hi"), F.col("n"))})
    a, b, c = F.col("prefix"), F.col("middle"), F.col("suffix")
    output = F.when(F.col("_form") == "psm", F.concat(p, a, s, c, m, b)).when(F.col("_form") == "spm", F.concat(s, c, p, a, m, b)).otherwise(F.col("_text"))
    return rows.select(F.col("_key").alias(key), "n", F.col("_form").alias("form"), "prefix", "middle", "suffix", output.alias("output"))


def digests(outputs: DataFrame, key: str = "doc_id", markers: Sequence[str] = MARKERS) -> DataFrame:
    """Lengths of the parts, digest of each output, and of the text that is rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return outputs.select(
        key, "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"), markers)).alias("restored_sha256"),
    )
