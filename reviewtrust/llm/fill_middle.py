"""Fill-in-the-middle transformation by regular expressions with counted quantifiers.

A text is a run of units (by default its lines). ``regexp_count`` gives their number n; hashes of the document id draw two
cuts and a form. The pattern of a row has the cuts as counts, ``((?:unit){a}+)((?:unit){b-a}+)(rest)``, so one match captures prefix,
middle and suffix, and the replacement writes them in the form's order. Quantifiers and units are possessive: the
matcher walks the text once and keeps no places to go back to, however long the text is.

Rows are transformed where they are read: no shuffle, no Python. A null text counts as the empty one, which stays plain (n = 0), and so
does any text that holds a mark. A null doc_id draws as the empty string would. Repeated rows give equal rows; an empty
table gives none; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewtrust.llm.common import text_of

#: A line with its end, or what follows the last one. Possessive, which changes no match.
LINE = r"[^\n]*+\n|[^\n]++"
#: Prefix, suffix, middle.
MARKS = ("<P>", "<S>", "<M>")


def draws(doc_id: Column, seed: int, number: int = 4) -> list[Column]:
    """The first 32-bit numbers of the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(number)]


def _literal(mark: str) -> str:
    """A mark as replacement text."""
    return re.sub(r"([\\$])", r"\\\1", mark)


def _quoted(mark: str) -> str:
    """A mark as pattern."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in mark)


def fill_middle(
    docs: DataFrame,
    unit: str = LINE,
    marks: tuple[str, str, str] = MARKS,
    rate: int = 100,
    suffix_first: int = 50,
    seed: int = 7,
) -> DataFrame:
    """doc_id, text, n, form, ``output`` of every row, and the numbers of characters of its prefix and middle.

    ``rate`` percent of the texts are transformed, ``suffix_first`` percent of these with the suffix before the
    prefix (form spm, else psm); all others are plain, and have null numbers.
    """
    p, s, m = marks
    h1, h2, h3, h4 = draws(docs["doc_id"], seed)
    text = text_of(docs)
    drawn = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        text.alias("text"),
        F.regexp_count(text, F.lit(unit)).cast("bigint").alias("n"),
        h1.alias("h1"),
        h2.alias("h2"),
        ((text == "") | F.contains(text, F.lit(p)) | F.contains(text, F.lit(s)) | F.contains(text, F.lit(m)) | (h3 % 100 >= rate)).alias("plain"),
        (h4 % 100 < suffix_first).alias("spm"),
    )
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cut = drawn.select(
        "doc_id",
        "text",
        "n",
        F.when(F.col("plain"), "plain").when(F.col("spm"), "spm").otherwise("psm").alias("form"),
        F.concat(
            F.lit(rf"(?s)\A((?:{unit}){{"), F.least(a, b).cast("string"), F.lit(rf"}}+)((?:{unit}){{"),
            F.abs(a - b).cast("string"), F.lit(r"}+)(.*+)\z"),
        ).alias("pattern"),
    )
    p_, s_, m_ = map(_literal, marks)
    order = F.when(F.col("form") == "spm", f"{s_}$3{p_}$1{m_}$2").otherwise(f"{p_}$1{s_}$3{m_}$2")
    done = cut.select(
        "doc_id",
        "text",
        "n",
        "form",
        F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", F.col("pattern"), order)).alias("output"),
    )
    # The text holds no mark, so the first one of each kind is where the parts meet.
    chars, at_p, at_s, at_m = F.char_length("output"), *(F.locate(x, F.col("output")) for x in marks)
    prefix = F.when(F.col("form") == "spm", at_m - at_p - len(p)).when(F.col("form") == "psm", at_s - at_p - len(p))
    return done.select(
        "*",
        prefix.cast("bigint").alias("prefix_chars"),
        F.when(F.col("form") != "plain", chars - at_m - len(m) + 1).cast("bigint").alias("middle_chars"),
    )


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text again, from output and form alone."""
    p, s, m = map(_quoted, marks)
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z"), F.lit("$2$3$1"))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
