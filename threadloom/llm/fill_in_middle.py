r"""Fill-in-the-middle by escaped marker injection, in built-in functions.

A delimiter and an escape character, both no white space, are escaped in the text, so tokens stay where they were; regexp_replace
appends the delimiter to every token; the delimiters are the token count; ``substring_index`` takes the parts by rank, from the left
and from the right; delimiters go, escapes are undone, and the parts are put together. A token is white space with the word
after it, or trailing white space. Cuts and form depend on hashes of seed and id alone.

A null text is empty; empty texts and texts that hold one of the marks stay plain, as their parts could not be told
apart again. A null id is hashed as the empty text. Repeated rows are treated alike; extra columns, with any names, are not read.
A row holds about five copies of its text at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"\x20\x09-\x0D"
TOKEN = f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PERCENT, SPM_PERCENT = 42, 50, 80
_DELIMITER, _ESCAPE = "\x1f", "\x1e"


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    return _replaced(_replaced(text, _ESCAPE, _ESCAPE + "e"), _DELIMITER, _ESCAPE + "d")


def restored_part(part: Column) -> Column:
    """A part of marked text as it was."""
    return _replaced(_replaced(_replaced(part, _DELIMITER, ""), _ESCAPE + "d", _DELIMITER), _ESCAPE + "e", _ESCAPE)


def _index(text: Column, mark: str, rank: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(mark), rank.cast("int"))


def draws(id_: str, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, text, n, form, prefix, middle, output) of every row of ``docs`` (doc_id, text); prefix and middle are null if plain.

    ``percent`` of the texts that can are transformed, ``spm_percent`` of these with the suffix first.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws("doc_id", seed)
    marked = F.regexp_replace(escaped(F.col("text")), TOKEN, "$0" + _DELIMITER)
    rows = rows.withColumn("marked", marked)
    n = F.length("marked") - F.length(_replaced(F.col("marked"), _DELIMITER, ""))
    rows = rows.withColumn("n", n.cast("long"))
    first, second = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    holds = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        holds = holds | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | holds | (h3 % 100 >= percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "low": F.least(first, second), "high": F.greatest(first, second)})
    moved, upto = F.col("form") != "plain", _index(F.col("marked"), _DELIMITER, F.col("high"))
    parts = {
        "prefix": F.when(moved, restored_part(_index(F.col("marked"), _DELIMITER, F.col("low")))),
        "middle": F.when(moved, restored_part(_index(upto, _DELIMITER, F.col("low") - F.col("high")))),
        "suffix": F.when(moved, restored_part(_index(F.col("marked"), _DELIMITER, F.col("high") - F.col("n") - 1))),
    }
    rows = rows.select("doc_id", "text", "n", "form", *[v.alias(k) for k, v in parts.items()])
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "spm", spm).when(F.col("form") == "psm", psm).otherwise(F.col("text"))
    return rows.select("doc_id", "text", "n", "form", "prefix", "middle", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. Marks end in a letter and ">", so none can arise where a part meets one."""
    body = F.substring(output, 4, 2**31 - 1)
    tail = F.substring_index(body, MIDDLE, -1)
    head = F.substring_index(body, MIDDLE, 1)
    spm = F.concat(F.substring_index(head, PREFIX, -1), tail, F.substring_index(head, PREFIX, 1))
    psm = F.concat(F.substring_index(head, SUFFIX, 1), tail, F.substring_index(head, SUFFIX, -1))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 (of the text rebuilt from the output)."""
    made = transform(docs)
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
