"""Operator 2: quality rules from cross-document line frequency.

Only DataFrame functions run here. Lines are normalised (ends stripped, white
space collapsed, lower case) and hashed; for each host (source) the distinct
documents of each line are counted. A line is above the limits if at least
MIN_DOCS documents of the host and at least MIN_SHARE of the host's documents
have it. Such lines are removed; a document that keeps fewer than MIN_WORDS words
or less than MIN_KEPT of its words is depleted and rejected, and so is one that
fails the base rules (too few words, too many words in repeated triples).

Scale: each text is read and split once; its figures and the hashes of its lines
are written to the shared folder, and all that follows reads those. Counting
needs one shuffle of (host, hash, doc_id) rows, pre-aggregated before each exchange,
so a line that a third of all documents have is spread by doc_id first; only lines
above the limits are joined back. Text never shuffles. Repeated triples are found
within the row, by sorting an array of hashes.

Defined cases: null text counts as empty; very long texts and lines are one row
like others; a null source is a host of its own; a null doc_id is one document for
line counts; repeated rows with equal doc_id, host and text count once and each get a
row, whatever their order; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import written
from plumbline.llm.mixing import WORD_GAP

MIN_DOCS = 30
MIN_SHARE = 0.01
MIN_WORDS = 50
MIN_KEPT = 0.5
MAX_REPEAT_PERCENT = 50
#: The counted symbols, and white space as in WORD_GAP.
SYMBOLS, BLANK = "#*$%&|<>", " \t\n\x0b\x0c\r"


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, host, text_key, the base figures, and lines (array of hash and words of each line that has a word) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select("doc_id", F.col("source").alias("host"), text.alias("t")).select(
        "doc_id",
        "host",
        F.xxhash64("t").alias("text_key"),
        F.split("t", WORD_GAP, -1).alias("parts"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "").alias("solid"),
    )
    ends = F.when(F.element_at("parts", 1) == "", 1).otherwise(0), F.when((F.size("parts") > 1) & (F.element_at("parts", -1) == ""), 1).otherwise(0)
    normal = F.transform("solid", lambda x: F.lower(F.trim(F.regexp_replace(x, WORD_GAP, " "))))
    step = step.select(
        "doc_id",
        "host",
        "text_key",
        "n_symbols",
        (F.size("solid") - F.size(F.array_distinct("solid"))).cast("bigint").alias("n_dup_lines"),
        F.char_length(F.array_join("parts", "")).cast("bigint").alias("word_chars"),
        (F.size("parts") - ends[0] - ends[1]).alias("n"),
        (ends[0] + 1).alias("from"),
        "parts",
        F.transform(normal, lambda x: F.struct(F.xxhash64(x).alias("h"), (F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words"))).alias("lines"),
    )
    step = step.withColumn("w", F.slice("parts", F.col("from"), F.col("n"))).drop("parts")
    at = F.col("w")
    triples = F.transform(F.slice("w", F.lit(1), F.greatest(F.col("n") - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(at, i + 1), F.get(at, i + 2)).alias("h"), i.alias("p")))
    step = step.withColumn("s", F.sort_array(triples)).drop("w")
    m = F.greatest(F.size("s") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("s", F.lit(2), m), F.slice("s", F.lit(1), m), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    step = step.withColumn("d", F.filter(pairs, lambda x: x.isNotNull())).drop("s")
    step = step.withColumn("p", F.sort_array(F.array_distinct(F.flatten("d")))).drop("d")
    k = F.greatest(F.size("p") - 1, F.lit(0))
    gaps = F.zip_with(F.slice("p", F.lit(2), k), F.slice("p", F.lit(1), k), lambda q, p: F.least(q - p, F.lit(3)))
    repeated = F.when(F.size("p") > 0, F.aggregate(gaps, F.lit(3), lambda acc, x: acc + x)).otherwise(0).cast("bigint")
    return step.select("doc_id", "host", "text_key", F.col("n").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated.alias("n_repeat_words"), "lines")


def frequent_lines(described: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, h, n_docs) of the lines above the limits."""
    one = F.struct("doc_id")
    hosts = described.groupBy(F.col("host").alias("of")).agg(F.count_distinct(one).alias("host_docs"))
    lines = described.select("doc_id", "host", F.explode("lines.h").alias("h"))
    counts = lines.groupBy("host", "h").agg(F.count_distinct(one).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n_docs") >= F.col("host_docs") * min_share).select("host", "h", "n_docs")


def quality_rules(docs: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, min_words: int = MIN_WORDS, min_kept: float = MIN_KEPT) -> DataFrame:
    """A row for each row of docs: doc_id, base figures, removed_words, base_failed, kept."""
    described = written(describe(docs.select("doc_id", "source", "text")), "described")
    hot = frequent_lines(described, min_docs, min_share)
    lines = described.select("doc_id", "text_key", "host", F.posexplode("lines").alias("i", "line"))
    removed = (
        lines.alias("l").join(hot.alias("r"), F.col("l.host").eqNullSafe(F.col("r.host")) & (F.col("l.line.h") == F.col("r.h")), "left_semi")
        .groupBy("doc_id", "text_key", "host", "i").agg(F.max("line.words").alias("words"))
        .groupBy("doc_id", "text_key", "host").agg(F.sum("words").alias("removed"))
    )
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_key") == F.col("r.text_key")) & F.col("l.host").eqNullSafe(F.col("r.host"))
    out = described.drop("lines").alias("l").join(removed.alias("r"), same, "left").select("l.doc_id", "l.n_words", "l.word_chars", "l.n_symbols", "l.n_dup_lines", "l.n_repeat_words", F.coalesce("r.removed", F.lit(0)).cast("bigint").alias("removed_words"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= min_words) & (left >= F.col("n_words") * min_kept))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


ORACLE = r"""
with docs as (select doc_id, source, coalesce(text, '') as text from documents),
words as (select doc_id, text, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from docs),
triples as (
  select doc_id, unnest(range(1, len(w) - 1)) as p, w from words where len(w) >= 3),
keyed as (select doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] as k from triples),
twice as (select doc_id, p, count(*) over (partition by doc_id, k) as c from keyed),
covered as (select doc_id, count(distinct q) as n from (select doc_id, unnest([p, p + 1, p + 2]) as q from twice where c >= 2) group by doc_id),
lines as (select doc_id, source, unnest(string_split(text, chr(10))) as line from docs),
solid as (select *, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) as k from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
dups as (select doc_id, count(*) - count(distinct line) as n from solid group by doc_id),
hosts as (select source, count(distinct doc_id) as n from docs group by source),
hot as (
  select s.source, s.k from solid s join hosts h on s.source is not distinct from h.source
  group by s.source, s.k, h.n having count(distinct s.doc_id) >= 30 and count(distinct s.doc_id) >= h.n * 0.01),
removed as (
  select s.doc_id, sum(len(regexp_extract_all(s.k, '[^\x20\x09-\x0D]+'))) as n
  from solid s join hot on s.source is not distinct from hot.source and s.k = hot.k group by s.doc_id),
figures as (
  select w.doc_id, len(w.w)::bigint as n_words, length(array_to_string(w.w, ''))::bigint as word_chars,
         length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(d.n, 0)::bigint as n_dup_lines,
         coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(r.n, 0)::bigint as removed_words
  from words w left join dups d using (doc_id) left join covered c using (doc_id) left join removed r using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from figures)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_words - removed_words >= 50 and n_words - removed_words >= n_words * 0.5 as kept, removed_words from judged
"""
