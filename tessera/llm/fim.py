"""Fill-in-the-middle rewriting of documents by relational units.

A text is cut into units (white space and the word after it).  Units are rows:
matches are exploded with their ordinals, a window sums their lengths, the
document's two cut requests join the unit they fall on, and an aggregate turns
that into two offsets, by which the text is cut.  Only documents that are to be
cut go through this; all of it runs on one exchange of their texts.

Rows are known by id and a hash of their text, and by the input partition they
come from, so that equal rows, however many, are dealt over as many groups as
there are partitions.  Equal rows that meet in a group share ordinals; the
running sum over ordinals is then a multiple of the true one and is divided by
the number of rows.

Defined results: a null text is empty, an empty text is plain and has 0 units;
a null id counts as an empty one; a text that holds a marker is plain; rows
that repeat give a row each; further columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed patterns: white space with the word that follows it, or white space alone.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = MARKERS = "<P>", "<S>", "<M>"
ROW = ["__id", "__hash", "__part"]
#: Grouping by the id as it is, too, keeps it in every branch of the plan, so that they share one exchange.
GROUP = [*ROW, "id"]


@dataclass(frozen=True)
class FimConfig:
    """Shares in whole per cent: of documents that are cut, and of these of suffix-first ones."""

    seed: int = 42
    rate: int = 50
    spm_rate: int = 80


def _draw(id_text: Column, seed: int, k: int) -> Column:
    """The k-th number of 32 bits that a document draws; always the same for its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def output(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """The rewritten text of a document that is cut."""
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))


def restored(out: Column, form: Column) -> Column:
    """The original text, from a rewritten one and its form: no part of a cut text holds a marker."""
    head, middle = F.substring_index(out, MIDDLE, 1), F.substring_index(out, MIDDLE, -1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        body = F.substring(head, len(first) + 1, 1 << 30)
        return F.substring_index(body, second, 1), F.substring_index(body, second, -1)

    prefix, suffix = parts(PREFIX, SUFFIX)
    later, earlier = parts(SUFFIX, PREFIX)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(earlier, middle, later))
        .otherwise(out)
    )


def fill_in_middle(docs: DataFrame, cfg: FimConfig = FimConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs``.

    ``n`` is the number of units, ``form`` is plain, psm or spm; lengths count
    code points and are null where the form is plain.
    """
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), text.alias("text"), id_text.alias("__id"), F.xxhash64(text, F.col(id_col).isNull()).alias("__hash"), F.spark_partition_id().alias("__part")
    )
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.contains(F.col("text"), F.lit(m))
    stays = (F.col("text") == "") | (_draw(F.col("__id"), cfg.seed, 2) % 100 >= cfg.rate) | marked
    plain = rows.where(stays).select(
        "id", "text", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"), F.lit("plain").alias("form"),
        F.lit(None).cast("long").alias("prefix_chars"), F.lit(None).cast("long").alias("middle_chars"), F.col("text").alias("output"),
    )

    whole = rows.where(~stays).repartition(*ROW)
    found = whole.join(_offsets(whole, cfg.seed), ROW)
    lo, hi = F.col("__lo"), F.col("__hi")
    form = F.when(_draw(F.col("__id"), cfg.seed, 3) % 100 < cfg.spm_rate, "spm").otherwise("psm")
    part = lambda start, length: F.substring("text", start.cast("int"), length.cast("int"))
    cut = found.select(
        "id", "text", "n", form.alias("form"), lo.alias("prefix_chars"), (hi - lo).alias("middle_chars"),
        output(form, part(F.lit(1), lo), part(lo + 1, hi - lo), part(hi + 1, F.length("text"))).alias("output"),
    )
    return plain.unionByName(cut)


def _offsets(whole: DataFrame, seed: int) -> DataFrame:
    """``(*ROW, n, __lo, __hi)``: how many code points lie before the two cuts of each group of equal rows."""
    units = whole.select(*GROUP, F.posexplode(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).alias("__at", "__unit"))
    units = units.select(*GROUP, (F.col("__at") + 1).cast("long").alias("__ordinal"), F.length("__unit").cast("long").alias("__length"))
    # up to and with all rows of this ordinal: that of m equal rows is m times one's
    upto = Window.partitionBy(*GROUP).orderBy("__ordinal").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = units.select(*ROW, "__ordinal", F.sum("__length").over(upto).alias("__sum"), F.count("*").over(upto).alias("__rows"))
    summed = summed.select(*ROW, "__ordinal", F.expr("__sum * __ordinal div __rows").alias("__end"))
    counts = units.groupBy(*GROUP).agg(F.max("__ordinal").alias("n"))
    cuts = [_draw(F.col("__id"), seed, k) % (F.col("n") + 1) for k in (0, 1)]
    # a request for each document: its cuts as ordinals of the last unit before them
    requests = counts.select(*ROW, "n", F.least(*cuts).alias("__first"), F.greatest(*cuts).alias("__second"))
    met = summed.hint("merge").join(requests, ROW).where(F.array_contains(F.array(F.lit(1).cast("long"), "__first", "__second"), F.col("__ordinal")))
    ends = lambda cut: F.coalesce(F.max(F.when(F.col("__ordinal") == F.col(cut), F.col("__end"))), F.lit(0).cast("long"))
    # the first unit always meets, so documents whose cuts are both 0 have a row too
    return met.groupBy(*ROW).agg(F.max("n").alias("n"), ends("__first").alias("__lo"), ends("__second").alias("__hi"))
