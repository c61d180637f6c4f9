"""Fill-in-middle transformation: prefix, middle and suffix of a text are caught by one match of a pattern made for its row.

A unit is one code point, `.` with line ends included. regexp_count gives the number of units n, in two steps: whole blocks
of BLOCK units, and then the units of what the blocks leave, so that no list of single letters is made of a long text. Two
cuts a <= b come from hashes of the doc_id; the pattern of a row is unit{a}, unit{b-a} and the rest, all possessive, so a
match never goes back. The replacement puts the groups between the markers in the order of the row's form. DataFrame
functions only; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.llm.common import free_name, table

#: The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units that are counted as one block.
BLOCK = 256
_UNIT = "(?s)."


def units(text: Column) -> Column:
    """Code points of a text by counting matches."""
    rest = F.regexp_extract(text, f"(?s)\\A(?:.{{{BLOCK}}})*+(.*+)\\z", 1)
    return (F.regexp_count(text, F.lit(f"{_UNIT}{{{BLOCK}}}+")) * BLOCK + F.regexp_count(rest, F.lit(_UNIT))).cast("long")


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of eight digits of the hex sha256 of seed:doc_id. A null id counts as ''."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output added (columns of these names are replaced).

    form: plain (empty texts, texts that hold a marker, and plain_percent % of the rest; output is the text), spm
    (spm_percent % of the others: suffix first) or psm. The chars are null for plain. Null texts count as empty; rows that
    repeat a doc_id and its text give the same result.
    """
    own = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")
    name = lambda x: free_name(own, x)
    whole, first, last, h3, h4, end = map(name, ("whole", "first", "last", "h3", "h4", "end"))
    h = draws(F.col("doc_id"), seed)
    out = own.withColumn(whole, F.coalesce("text", F.lit(""))).withColumns({"n": units(F.col(whole)), first: h[0], last: h[1], h3: h[2], h4: h[3]})
    cut = [F.pmod(F.col(c), F.col("n") + 1) for c in (first, last)]
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(whole, F.lit(m))
    plain = (F.col(whole) == "") | marked | (F.pmod(h3, F.lit(100)) >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.pmod(h4, F.lit(100)) < spm_percent, "spm").otherwise("psm")
    out = out.withColumns({"form": form, "prefix_chars": F.least(*cut), end: F.greatest(*cut)})
    out = out.withColumn("middle_chars", F.col(end) - F.col("prefix_chars"))
    pattern = F.concat(F.lit(f"\\A({_UNIT}{{"), F.col("prefix_chars"), F.lit(f"}}+)({_UNIT}{{"), F.col("middle_chars"), F.lit(f"}}+)({_UNIT}*+)\\z"))
    dealt = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    made = F.when(F.col("form") == "plain", F.col(whole)).otherwise(F.regexp_replace(F.col(whole), pattern, dealt))
    out = out.withColumn("output", made)
    cut_or_none = {c: F.when(F.col("form") != "plain", F.col(c)) for c in ("prefix_chars", "middle_chars")}
    return out.withColumns(cut_or_none).drop(whole, first, last, h3, h4, end)


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form."""
    part = "(.*?)"
    psm = F.regexp_replace(output, F.lit(f"(?s)\\A{PREFIX}{part}{SUFFIX}{part}{MIDDLE}(.*+)\\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(f"(?s)\\A{SUFFIX}{part}{PREFIX}{part}{MIDDLE}(.*+)\\z"), F.lit("$2$3$1"))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    out = fill_in_middle(docs).withColumn("again", restored(F.col("output"), F.col("form")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(F.col("again")).alias("restored_sha256"))


_HEX = "('0x' || substr(s, {at}, 8))::bigint"

ORACLE = f"""
with d as (select doc_id, coalesce(text, '') t, length(coalesce(text, ''))::bigint n, sha256('1:' || coalesce(doc_id::varchar, '')) s from documents),
h as (select doc_id, t, n, {", ".join(f"{_HEX.format(at=8 * k + 1)} h{k + 1}" for k in range(4))} from d),
c as (select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from h),
p as (select *, substring(t, 1, a) p, substring(t, a + 1, b - a) m, substring(t, b + 1) s from c)
select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256
from p
"""
