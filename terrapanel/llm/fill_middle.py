"""Fill-in-the-middle forms of documents by marked units, in DataFrame functions only.

A text is escaped (``ESCAPE`` and ``CUT`` get a two-sign form), ``regexp_replace`` puts a ``CUT`` after every unit, and the
``CUT`` signs are counted.  Prefix, middle and suffix are runs of units by rank, taken with ``substring_index``; the parts
lose their ``CUT`` signs and are unescaped.  Where the middle begins and ends, and the form, follow from the SHA-256 of
seed and id, so every run and every engine draws the same.  ``restored`` puts the exact text together again from output
and form alone: a document that holds a marker stays plain, and no marker can begin within another, so each is found.

One projection without shuffle or Python; a row's memory is a small multiple of its text.

Defined cases: null text counts as empty; an empty text is plain; a null id draws as the empty string; repeated rows get the
same form (the draw knows nothing but the id); very long texts are cut like any other; an empty table gives an empty
result; columns other than the named ones are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_UNDER, SEED = 90, 20, 1
ESCAPE, CUT = "\x1b", "\x1f"
#: units of the escaped text; none may part the two signs of an escape
UNITS = {
    "character": rf"(?s){ESCAPE}?.",
    "word": r"\s*\S+\s*\z|\s*\S+|\s+\z",
    "line": r"[^\n]*\n|[^\n]+\z",
}


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(CUT), F.lit(ESCAPE + "c"))


def unescaped(part: Column) -> Column:
    """The text of a part, with its CUT signs taken away."""
    bare = F.replace(part, F.lit(CUT), F.lit(""))
    return F.when(bare.contains(ESCAPE), F.replace(F.replace(bare, F.lit(ESCAPE + "c"), F.lit(CUT)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))).otherwise(bare)


def marked(whole: Column, unit: str = "character") -> Column:
    """An escaped text with a CUT after each unit."""
    return F.regexp_replace(whole, UNITS[unit], f"$0{CUT}")


def n_units(cut: Column, whole: Column) -> Column:
    """The CUT signs of a marked text: escaped texts hold none, and each is one byte."""
    return (F.octet_length(cut) - F.octet_length(whole)).cast("long")


def units(cut: Column, n: Column, start: Column, end: Column) -> Column:
    """The text of units [start, end) of a marked text of n units."""
    head = F.call_function("substring_index", cut, F.lit(CUT), end.cast("int"))
    # up to the end of the text its last CUT is a piece of its own, which takes one more rank from the right
    part = F.when(end == n, F.call_function("substring_index", cut, F.lit(CUT), (start - n - 1).cast("int"))).otherwise(F.call_function("substring_index", head, F.lit(CUT), (start - end).cast("int")))
    return F.when(start >= end, "").otherwise(unescaped(part))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of the SHA-256 of seed and id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text from output and form."""

    def between(begin: str, stop: str | None = None) -> Column:
        head = F.substring_index(output, stop, 1) if stop else output
        return F.substring_index(head, begin, -1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "character", seed: int = SEED, plain_from: int = PLAIN_FROM, spm_under: int = SPM_UNDER) -> DataFrame:
    """doc_id, text, n (units), form, prefix, middle, suffix (null if plain) and output of every document."""
    out = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    out = out.withColumns({"whole": escaped(F.col("text")), "h1": h1, "h2": h2, "h3": h3, "h4": h4})
    out = out.withColumn("cut", marked(F.col("whole"), unit)).withColumn("n", n_units(F.col("cut"), F.col("whole")))
    holds = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = F.when((F.col("text") == "") | holds | (F.col("h3") % 100 >= plain_from), "plain").when(F.col("h4") % 100 < spm_under, "spm").otherwise("psm")
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    out = out.withColumns({"form": form, "a": F.least(one, two), "b": F.greatest(one, two)})
    shaped = F.col("form") != "plain"
    part = lambda start, end: F.when(shaped, units(F.col("cut"), F.col("n"), start, end))
    out = out.withColumns({"prefix": part(F.lit(0), F.col("a")), "middle": part(F.col("a"), F.col("b")), "suffix": part(F.col("b"), F.col("n"))})
    psm = F.concat(F.lit(PREFIX), F.col("prefix"), F.lit(SUFFIX), F.col("suffix"), F.lit(MIDDLE), F.col("middle"))
    spm = F.concat(F.lit(SUFFIX), F.col("suffix"), F.lit(PREFIX), F.col("prefix"), F.lit(MIDDLE), F.col("middle"))
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return out.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
    CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= {PLAIN_FROM} THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < {SPM_UNDER} THEN 'spm' ELSE 'psm' END AS form
  FROM h
),
p AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, substr(text, 1, least(x, y)) AS pre, substr(text, least(x, y) + 1, greatest(x, y) - least(x, y)) AS mid, substr(text, greatest(x, y) + 1) AS suf FROM d)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid WHEN 'spm' THEN '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
