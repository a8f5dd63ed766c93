"""Benchmark decontamination with DataFrame functions only.

The benchmark's items are cut into windows of ``n`` words (an item of fewer words is one
window).  Every document is scanned once, which counts its words too.  A window of k words holds
a whole block at one of every ``stride(k)`` words, wherever it begins; so the 64-bit hashes of
these blocks alone, for the lengths that occur, are probed in a broadcast hash join with all
blocks of the benchmark's windows.  Where one is known, the windows around it are probed with
those of the benchmark.  Hits are verified on the words.  If the benchmark's windows are larger
than ``broadcast_limit`` bytes, the same joins are left to a shuffle, where adaptive execution
splits frequent blocks.  Long documents are scanned in segments that overlap by a window.  Of the
texts only those with candidates are exchanged; the keys of these documents are broadcast, up to
``broadcast_limit`` bytes.

Defined results: a null text has no words, as has one without a word character; it has no
hits.  Items without words have no window.  Items with equal windows are all counted.  Rows
are identified by id and text, so that a repeated row, or an id used for several texts, gets
the hits of its own text; null ids are compared as equal.  Other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import unpacked, whole_row

#: A word of the original text, and the characters between words.  The characters that end a word
#: are listed one by one: Java looks these up in a table, but tries ranges one after the other.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
WORD_WITH_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*" + WORD
GAP_AT_END = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$"
WINDOW, SEGMENT = 10, 4_000
BROADCAST_LIMIT = 64 << 20
#: Over how many keys the rows of the documents themselves are dealt, should blocks be joined by shuffle.
OWN_BLOCKS = 1_024
#: Bytes of a document's key in memory.
KEY_BYTES = 128


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; a text without other letters takes the faster built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array())


def window_codes(hashes: Column, size: int) -> Column:
    """(start, size, code) of all runs of ``size`` words; none if there are fewer words."""
    starts = F.when(
        F.size(hashes) >= size, F.sequence(F.lit(1), F.size(hashes) - (size - 1))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda i: F.struct(
            i.alias("start"),
            F.lit(size).alias("size"),
            F.xxhash64(F.lit(size), *[F.get(hashes, i + (k - 1)) for k in range(size)]).alias("code"),
        ),
    )


def stride(size: int) -> int:
    """Of a document's blocks for windows of ``size`` words, one in so many is probed."""
    return (size + 1) // 2


def block(hashes: Column, start: Column, size: int) -> Column:
    """The code of the block at ``start``: as many words as a window holds wherever it begins."""
    length = size - stride(size) + 1
    return F.xxhash64(F.lit(size), *[F.get(hashes, start + (k - 1)) for k in range(length)])


def known_blocks(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """Distinct (size, block) of the windows: every block a document may meet them by."""
    hashes = word_hashes(F.split("window", " "))
    none = F.array().cast("array<bigint>")
    every = F.lit(None).cast("array<bigint>")
    for size in sizes:
        blocks = [block(F.col("hashes"), F.lit(i + 1), size) for i in range(stride(size))]
        every = F.when(F.col("size") == size, F.array(*blocks)).otherwise(every)
    found = windows.select("size", hashes.alias("hashes"))
    return found.select("size", F.explode(F.coalesce(every, none)).alias("block")).distinct()


def surroundings(hashes: Column, size: int) -> Column:
    """(size, block, before, hashes) of the blocks probed for windows of ``size`` words.

    ``hashes`` are those of all words of the windows that hold the block, ``before`` is how many
    words lie before these.
    """
    step = stride(size)
    last = F.size(hashes) - (size - step)
    starts = F.when(F.size(hashes) >= size, F.sequence(F.lit(1), last, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )

    def around(i: Column) -> Column:
        first = F.greatest(i - (step - 1), F.lit(1))
        return F.struct(
            F.lit(size).alias("size"),
            block(hashes, i, size).alias("block"),
            (first - 1).alias("before"),
            F.slice(hashes, first, i - first + size).alias("hashes"),
        )

    return F.transform(starts, around)


def word_hashes(terms: Column) -> Column:
    return F.transform(terms, lambda w: F.xxhash64(w))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def run(terms: Column, start: Column, size: Column) -> Column:
    """The words of a window as one string."""
    return F.array_join(F.slice(terms, start, size), " ")


def item_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct (item_id, size, code, window)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("terms")).withColumn(
        "hashes", word_hashes(F.col("terms"))
    )
    by_size = F.array().cast("array<struct<start:int,size:int,code:bigint>>")
    for size in range(1, n):
        by_size = F.when(F.size("terms") == size, window_codes(F.col("hashes"), size)).otherwise(by_size)
    by_size = F.when(F.size("terms") >= n, window_codes(F.col("hashes"), n)).otherwise(by_size)
    return (
        items.select("item_id", "terms", F.explode(by_size).alias("w"))
        .select(
            "item_id", "w.size", "w.code",
            run(F.col("terms"), F.col("w.start"), F.col("w.size")).alias("window"),
        )
        .distinct()
    )


def text_key(text: Column) -> Column:
    return F.xxhash64(text, F.char_length(text))


def keys_of(found: DataFrame, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(_found_id, _found_text) of the documents of ``found``, marked for broadcast if they are few."""
    keys = found.select(F.col("doc_id").alias("_found_id"), F.col("_text").alias("_found_text")).distinct()
    return keys.hint("broadcast") if found.count() * KEY_BYTES <= broadcast_limit else keys


def scanned(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_limit: int = BROADCAST_LIMIT
) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """What one pass over the texts finds: a row per document with doc_id, _text and n_words,
    and the candidates (doc_id, _text, found); then the windows of the items, and whether these
    may be broadcast by name."""
    found_in = item_windows(benchmark, n)
    distinct = found_in.select("size", "code", "window").distinct()
    owners = F.sum(F.octet_length(F.coalesce(F.col("item_id").cast("string"), F.lit(""))) + 64)
    measured = (
        found_in.groupBy("size", "code", "window")
        .agg(F.count("*").alias("n"), owners.alias("owned"))
        .agg(
            F.collect_set("size").alias("sizes"),
            F.sum(F.octet_length("window") + 64).alias("bytes"),
            F.sum(F.octet_length("window") * F.col("n") + F.col("owned")).alias("named_bytes"),
        )
        .first()
    )
    sizes = sorted(measured["sizes"])
    small = (measured["bytes"] or 0) <= broadcast_limit
    named_small = (measured["named_bytes"] or 0) <= broadcast_limit
    # blocks of size 0 are the rows of the documents themselves
    itself = docs.sparkSession.range(OWN_BLOCKS).select(F.lit(0).alias("size"), F.col("id").alias("block"))
    blocks = known_blocks(distinct, sizes).unionByName(itself)
    around = "array<struct<size:int,block:bigint,before:int,hashes:array<bigint>>>"

    def segments_of(hashes: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - 1, F.lit(0)), F.lit(SEGMENT))
        return F.transform(
            cuts,
            lambda c: F.struct(
                c.alias("before"), F.slice(hashes, c + 1, F.lit(SEGMENT + n - 1)).alias("hashes"),
                F.when(c == 0, F.size(hashes)).alias("n_words"),
            ),
        )

    segments = docs.select(
        "doc_id",
        text_key(F.col("text")).alias("_text"),
        F.explode(once(word_hashes(words(F.col("text"))), segments_of)).alias("s"),
    )
    counted = F.struct(
        F.lit(0).alias("size"), F.pmod(F.col("_text"), F.lit(OWN_BLOCKS)).cast("bigint").alias("block"),
        F.col("s.n_words").alias("before"),
        F.array().cast("array<bigint>").alias("hashes"),
    )
    own = F.when(F.col("s.n_words").isNotNull(), F.array(counted)).otherwise(F.array()).cast(around)
    every = F.concat(own, *[surroundings(F.col("s.hashes"), size) for size in sizes])
    met = cut_lineage(
        segments.select("doc_id", "_text", F.col("s.before").alias("offset"), F.explode(every).alias("b"))
        .select("doc_id", "_text", "offset", "b.*")
        .join(blocks.hint("broadcast") if small else blocks, ["size", "block"], "left_semi")
        .drop("block")
    )
    rows = met.where("size = 0").select("doc_id", "_text", F.col("before").cast("long").alias("n_words"))
    near = F.array().cast("array<struct<start:int,size:int,code:bigint>>")
    for size in sizes:
        near = F.when(F.col("size") == size, window_codes(F.col("hashes"), size)).otherwise(near)
    candidates = cut_lineage(
        met.where("size > 0")
        .select("doc_id", "_text", (F.col("offset") + F.col("before")).alias("before"), F.explode(near).alias("w"))
        .select(
            "doc_id", "_text", (F.col("before") + F.col("w.start")).alias("start"), "w.size", "w.code"
        )
        .join(F.broadcast(distinct) if small else distinct, ["size", "code"])
        .groupBy("doc_id", "_text")
        .agg(F.collect_set(F.struct("start", "size", "window")).alias("found"))
    )
    return rows, candidates, found_in, named_small


def hits(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, broadcast_limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Per document with hits: doc_id, _text, covered word positions (from 1), item ids."""
    _, candidates, found_in, named_small = scanned(docs, benchmark, n, broadcast_limit)
    return verified_hits(docs, candidates, found_in, named_small, broadcast_limit)


def verified_hits(
    docs: DataFrame, candidates: DataFrame, found_in: DataFrame, named_small: bool,
    broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """The hits of the candidates that hold word by word."""
    texts = docs.select(
        F.col("doc_id").alias("_id"), F.col("text"), text_key(F.col("text")).alias("_key")
    )
    wanted = F.col("_id").eqNullSafe(F.col("_found_id")) & (F.col("_key") == F.col("_found_text"))
    texts = texts.join(keys_of(candidates, broadcast_limit), wanted, "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))
    verified = candidates.join(texts, same).withColumn(
        "found",
        once(
            words(F.col("text")),
            lambda terms: F.filter(
                "found", lambda h: run(terms, h["start"], h["size"]) == h["window"]
            ),
        ),
    )
    hit = cut_lineage(
        verified.select("doc_id", "_text", F.explode("found").alias("h"))
        .select("doc_id", "_text", "h.start", "h.size", "h.window")
        .distinct()
    )
    positions = F.sequence("start", F.col("start") + F.col("size") - 1)
    covered = hit.groupBy("doc_id", "_text").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(positions)))).alias("covered")
    )
    named = found_in.select("item_id", "window")
    items = (
        hit.select("doc_id", "_text", "window")
        .distinct()
        .join(F.broadcast(named) if named_small else named, "window")
        .groupBy("doc_id", "_text")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    same = covered["doc_id"].eqNullSafe(items["doc_id"]) & (covered["_text"] == items["_text"])
    return covered.join(items, same).select(covered["doc_id"], covered["_text"], "covered", "items")


def with_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` as ``row``, with covered and items (null without hits)."""
    found = hits(docs, benchmark, n)
    rows = docs.select(whole_row(docs))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (
        text_key(F.col("row.text")) == F.col("_text")
    )
    return rows.join(found, same, "left").select("row", "covered", "items")


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Per document: words, words hit, items with occurring windows."""
    rows, candidates, *items_of = scanned(docs, benchmark, n)
    found = verified_hits(docs, candidates, *items_of)
    rows = rows.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_key"), "n_words")
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("_text"))
    n_hit = F.when(F.col("covered").isNull(), F.lit(0)).otherwise(F.size("covered")).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(found, same, "left").select(
        F.col("_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Only the documents without hit."""
    found = keys_of(cut_lineage(hits(docs, benchmark, n).select("doc_id", "_text")))
    rows = docs.select(whole_row(docs))
    same = F.col("row.doc_id").eqNullSafe(F.col("_found_id")) & (
        text_key(F.col("row.text")) == F.col("_found_text")
    )
    return unpacked(rows.join(found, same, "left_anti"), docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """All documents, without the words hit and the gap before each of them."""
    pieces = F.regexp_extract_all("row.text", F.lit(WORD_WITH_GAP), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.array_contains("covered", i + 1))
    cut = F.concat(F.array_join(kept, ""), F.regexp_extract("row.text", GAP_AT_END, 0))
    text = F.when(F.col("covered").isNull(), F.col("row.text")).otherwise(cut)
    return unpacked(with_hits(docs, benchmark, n), docs.columns, text=text)


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS terms
  FROM benchmark),
bs AS (
  SELECT item_id, least(len(terms), 10) AS size, terms,
         unnest(range(1, greatest(len(terms) - 9, 1) + 1)) AS i
  FROM b WHERE len(terms) > 0),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(terms[i:i + size - 1], ' ') AS w FROM bs),
sizes AS (SELECT DISTINCT size FROM bw),
ds AS (
  SELECT doc_id, terms, size, unnest(range(1, len(terms) - size + 2)) AS i
  FROM d, sizes WHERE len(terms) >= size),
dw AS (
  SELECT doc_id, size, i, array_to_string(terms[i:i + size - 1], ' ') AS w FROM ds),
hit AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw USING (size, w)),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit),
np AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(terms) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN np USING (doc_id) LEFT JOIN it USING (doc_id)
"""
