"""Quality rules on lines that many documents of a host share, with DataFrame functions only.

Lines are normalised (lower case, digits as 0, white space as one blank) and hashed; their
distinct documents are counted per host.  A line in more documents of its host than both limits
allow (a number, and a share of the host's documents) is removed from all of them; a document
that loses more than half of its characters that way is depleted and rejected, as is one that
fails the base rules (too few words, or too many of them in repeated three-word windows).

Only hashes are exchanged, by host, line and document first and by host and line once counted,
so neither a common line nor a large host gathers in one task.  A host has at most (lines of a
document on average) / (the share) lines above the limits, however large it is, so these go
into one array per host.  The arrays are broadcast if they measure ``broadcast_limit`` bytes at
most; beyond that they are joined by host, the documents of a host dealt over several salts.
Texts are not moved in the first case.  Both passes and all rules work within a row.

Defined results: a null text has no words and no lines and fails the base rules.  Rows of equal
text are one document when lines are counted, so copies, repeated rows and null ids do not make
a line common.  A null host is a host of its own.  Lines without a word are never counted.
Columns other than those added are passed on; the added ones replace columns of the same name.
Repeated windows are found by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import unpacked, whole_row
from .decontaminate import once

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Base rules: least number of words, most words in repeated windows (percent).
LEAST_WORDS, MOST_REPEATED, WINDOW = 50, 50, 3
#: Documents of a host that may share a line: so many, or this share of the host's if that is more.
DOCUMENTS, SHARE = 10, 0.02
#: Least part of its characters that a document must keep.
LEAST_KEPT = 0.5
BROADCAST_LIMIT, SALTS = 64 << 20, 32


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(terms: Column) -> Column:
    """Words within windows that the text holds twice or more, the first included."""

    def windows(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(
            starts,
            lambda i: F.struct(
                F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]).alias("code"), i.alias("at")
            ),
        )

    def twice(ordered: Column) -> Column:
        def same(i: Column, x: Column) -> Column:
            return F.coalesce(F.get(ordered, i)["code"] == x["code"], F.lit(False))

        found = F.filter(ordered, lambda x, i: same(i - 1, x) | same(i + 1, x))
        return F.sort_array(F.transform(found, lambda x: x["at"]))

    def covered(starts: Column) -> Column:
        gaps = F.transform(
            starts,
            lambda s, i: F.coalesce(F.least(F.get(starts, i + 1) - s, F.lit(WINDOW)), F.lit(WINDOW)),
        )
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    hashes = F.transform(terms, lambda w: F.xxhash64(w))
    any_twice = once(hashes, lambda h: once(F.sort_array(windows(h)), lambda o: once(twice(o), covered)))
    return F.when(F.size(terms) >= WINDOW, any_twice).otherwise(F.lit(0).cast("long"))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return once(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def base_rules(text: Column) -> Column:
    """Struct of the base figures of a text."""
    whole = F.coalesce(text, F.lit(""))
    figures = once(
        words(whole),
        lambda terms: F.struct(
            F.size(terms).cast("long").alias("n_words"),
            F.aggregate(terms, F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
            repeated_words(terms).alias("n_repeat_words"),
        ),
    )
    return F.struct(
        figures["n_words"].alias("n_words"),
        figures["word_chars"].alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        repeated_lines(whole).alias("n_dup_lines"),
        figures["n_repeat_words"].alias("n_repeat_words"),
    )


def normalised(line: Column) -> Column:
    blank = F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")
    return F.trim(F.regexp_replace(F.lower(blank), "[0-9]", "0"))


def line_codes(text: Column) -> Column:
    """(code, chars) of every line of the text in order; code is null without a word."""
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line: once(
            normalised(line),
            lambda n: F.struct(
                F.when(n != "", F.xxhash64(n)).alias("code"), F.char_length(n).cast("long").alias("chars")
            ),
        ),
    )


def common_lines(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", documents: int = DOCUMENTS, share: float = SHARE
) -> DataFrame:
    """(host, code, n): lines in more distinct documents of their host than the limits allow."""
    text = F.col(f"`{text_col}`")
    lines = F.filter(F.array_distinct(F.transform(line_codes(text), lambda x: x["code"])), lambda c: c.isNotNull())
    told = docs.where(text.isNotNull()).select(
        F.col(f"`{host_col}`").alias("host"),
        F.xxhash64(text, F.char_length(text)).alias("document"),
        F.explode(F.concat(lines, F.array(F.lit(None).cast("long")))).alias("code"),
    )
    # a null code stands for the document itself
    counted = cut_lineage(
        told.distinct().groupBy("host", "code").agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > documents) | F.col("code").isNull())
    )
    hosts = counted.where("code is null").select(F.col("host").alias("_host"), F.col("n").alias("in_host"))
    often = counted.where("code is not null").join(hosts, F.col("host").eqNullSafe(F.col("_host")))
    return often.where(F.col("n") > F.col("in_host") * share).select("host", "code", "n")


def with_common(
    docs: DataFrame, lines: DataFrame, host_col: str, broadcast_limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """(row, common): every row with the codes of its host's common lines, null if there are none."""
    by_host = lines.groupBy(F.col("host").alias("_host")).agg(F.collect_list("code").alias("common"))
    by_host = cut_lineage(by_host)
    size = F.sum(F.size("common") * 8 + F.coalesce(F.octet_length(F.col("_host").cast("string")), F.lit(0)) + 64)
    rows = docs.select(whole_row(docs))
    same = F.col("row").getField(host_col).eqNullSafe(F.col("_host"))
    if (by_host.agg(size).first()[0] or 0) <= broadcast_limit:
        return rows.join(F.broadcast(by_host), same, "left").select("row", "common")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    copies = by_host.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, same & (F.col("_salt") == F.col("_part")), "left").select("row", "common")


def judged(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    documents: int = DOCUMENTS,
    share: float = SHARE,
    least_kept: float = LEAST_KEPT,
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """All rows with the base figures, base_failed, n_chars_removed, kept and cleaned.

    ``cleaned`` is the text without the lines removed, null for a null text.
    """
    lines = common_lines(docs, host_col, text_col, documents, share)
    text = F.col("row").getField(text_col)
    nothing = F.array().cast("array<bigint>")

    def removal(own: Column) -> Column:
        hit = F.array_intersect(F.transform(own, lambda x: x["code"]), F.coalesce("common", nothing))
        return once(
            hit,
            lambda codes: F.struct(
                _total(F.filter(own, lambda x: F.array_contains(codes, x["code"]))).alias("removed"),
                _total(own).alias("chars"),
                F.transform(own, lambda x: F.coalesce(F.array_contains(codes, x["code"]), F.lit(False))).alias("out"),
            ),
        )

    found = with_common(docs, lines, host_col, broadcast_limit).select(
        "row", base_rules(text).alias("base"), once(line_codes(text), removal).alias("cut")
    )
    base, cut = F.col("base"), F.col("cut")
    failed = (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * base["n_words"])
    kept_lines = F.filter(F.split(text, "\n"), lambda line, i: ~F.get(cut["out"], i))
    figures = {n: base[n] for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {
        "base_failed": failed,
        "n_chars_removed": cut["removed"],
        "kept": ~failed & (cut["chars"] - cut["removed"] >= cut["chars"] * least_kept),
        "cleaned": F.when(cut["removed"] > 0, F.array_join(kept_lines, "\n")).otherwise(text),
    }
    told = found.select("row", F.struct(*[c.alias(n) for n, c in figures.items()]).alias("told"))
    return unpacked(told, docs.columns, **{n: F.col("told").getField(n) for n in figures})


def _total(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["chars"])


def clean(docs: DataFrame, host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """The documents kept, without their hosts' common lines; columns as in ``docs``."""
    rows = docs.select(whole_row(docs), F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").alias("text"))
    found = judged(rows, "host", "text", **limits).where("kept")
    return unpacked(found, docs.columns, **{text_col: F.col("cleaned")})


ORACLE = """
WITH d AS MATERIALIZED (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS terms
  FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(terms[i:i + 2], ' ') AS win
  FROM (SELECT doc_id, terms, unnest(range(1, len(terms) - 1)) AS i FROM d)),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 3)) AS p
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM w) WHERE k > 1)
  GROUP BY 1),
l AS MATERIALIZED (
  SELECT doc_id, source, text, line,
         trim(regexp_replace(lower(regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g')), '[0-9]', '0', 'g')) AS code
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY 1),
bad AS (
  SELECT source, code FROM (SELECT source, code, count(DISTINCT text) AS k FROM l WHERE code <> '' GROUP BY 1, 2)
  JOIN hosts USING (source) WHERE k > 10 AND k > n * 0.02),
cut AS (
  SELECT doc_id, sum(length(l.code)) AS chars, coalesce(sum(length(l.code)) FILTER (bad.code IS NOT NULL), 0) AS removed
  FROM l LEFT JOIN bad USING (source, code) GROUP BY 1),
b AS (
  SELECT doc_id, len(terms) AS n_words, CAST(list_sum(list_transform(terms, lambda x: length(x))) AS BIGINT) AS word_chars,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         coalesce(CAST(removed AS BIGINT), 0) AS n_chars_removed, coalesce(chars, 0) AS chars
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cut USING (doc_id))
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, n_chars_removed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND chars - n_chars_removed >= chars * 0.5 AS kept
FROM b
"""
