r"""Fill-in-the-middle: each text is cut into lines and two of its cuts move the middle to the end, all in DataFrame functions.

`regexp_count` gives the number n of units (lines). A pattern of the row's own then takes prefix, middle and suffix apart in one match:
`\A((?:unit){a}+)((?:unit){b-a}+)(.*)\z`, whose possessive groups are counted without backtracking and without recursion, so the work is
linear in the text, however many lines it has. The replacement of that one match is the output.

Defined cases: a null text is an empty one; an empty text, a text that holds a marker, and a text beyond `rate` stay plain (null
prefix_chars and middle_chars). A null doc_id draws as an empty doc_id. Rows of one doc_id draw alike; equal rows give equal rows; an
empty table gives an empty one. Columns other than doc_id and text are left behind, so no name clashes. Long texts are never cut short:
one row is one expression, with the memory of a few copies of its text. Cuts may fall on 0 and n, so any part may be empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only

#: A line with its end, or a last one without; the three markers.
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The unit again, in a form that never gives back what it took.
_ONCE = r"(?:[^\n]*+\n|[^\n]++)"


def _number(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as an unsigned integer, k from 0."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def _literal(*markers: str) -> str:
    return "|".join(rf"\Q{m}\E" for m in markers)


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form alone."""
    psm = rf"(?s)\A\Q{PREFIX}\E(.*?)\Q{SUFFIX}\E(.*?)\Q{MIDDLE}\E(.*)\z"
    spm = rf"(?s)\A\Q{SUFFIX}\E(.*?)\Q{PREFIX}\E(.*?)\Q{MIDDLE}\E(.*)\z"
    return F.when(form == "psm", F.regexp_replace(output, psm, "$1$3$2")).when(form == "spm", F.regexp_replace(output, spm, "$2$3$1")).otherwise(output)


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output); rate and spm_rate are percentages of texts.

    The cuts and the form come from the sha256 of `seed:doc_id`, so that a row gives the same result whenever and wherever it runs.
    """
    rows = only(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.select("doc_id", "text", F.regexp_count("text", F.lit(UNIT)).cast("bigint").alias("n"), digest.alias("_digest"))
    cuts = [F.pmod(_number(F.col("_digest"), k), F.col("n") + 1) for k in (0, 1)]
    plain = (F.col("text") == "") | F.col("text").rlike(_literal(PREFIX, SUFFIX, MIDDLE)) | (_number(F.col("_digest"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_number(F.col("_digest"), 3) % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    counted = lambda k: F.concat(F.lit(f"({_ONCE}{{"), k.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), counted(F.col("a")), counted(F.col("b") - F.col("a")), F.lit(r"((?s).*)\z"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    rows = rows.select("doc_id", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order)).alias("output"))
    # A text without markers cannot make one with its neighbours: a marker starts with "<", ends with ">", and holds neither inside.
    at = lambda marker: F.instr("output", marker)
    before = F.when(F.col("form") == "psm", at(SUFFIX) - 1 - len(PREFIX)).when(F.col("form") == "spm", at(MIDDLE) - at(PREFIX) - len(PREFIX))
    after = F.when(F.col("form") != "plain", F.char_length("output") - at(MIDDLE) + 1 - len(MIDDLE))
    return rows.select("doc_id", "n", "form", before.cast("bigint").alias("prefix_chars"), after.cast("bigint").alias("middle_chars"), "output")
