"""Fill-in-the-middle transformation of texts, cut at line ends.

The lines of a text are the units of an indexable skip list.  Every link of its lanes carries
two widths: how many units and how many code points it skips.  Both cuts are given as ranks
of units; descending from the longest links to single units, adding up the widths, gives the
code points before a rank exactly, without going through the units one by one.  The parts are
then put together by column functions: ``<P>prefix<S>suffix<M>middle`` (form ``psm``) or
``<S>suffix<P>prefix<M>middle`` (``spm``).  :func:`restored` rebuilds the text from the output
and the form alone.

The draws come from the SHA-256 of seed and id, so a row gives the same result wherever and
however often it is computed.

Defined results: a null text counts as empty.  An empty text, one that holds a marker, and one
that the share leaves out stay as they are, with form ``plain`` and null lengths.  A null id
draws like an empty one; repeated rows give equal rows.  Whole texts are cut, one at a time,
in memory for themselves only.  Columns other than those added are passed on; the added ones
replace columns of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unpacked, whole_row

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Links of a lane that one link of the lane above skips.
FAN = 8


class SkipList:
    """Units in order below express lanes; a link is (units, code points) skipped."""

    def __init__(self, chars: np.ndarray) -> None:
        """chars: code points of each unit."""
        self.lanes = [(np.ones(len(chars), np.int64), chars)]
        while len(self.lanes[-1][0]) > FAN:
            starts = np.arange(0, len(self.lanes[-1][0]), FAN)
            self.lanes.append(tuple(np.add.reduceat(widths, starts) for widths in self.lanes[-1]))

    def __len__(self) -> int:
        return len(self.lanes[0][0])

    def before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        node = units = chars = 0
        for skipped, lengths in reversed(self.lanes):
            while node < len(skipped) and units + skipped[node] <= rank:
                units += int(skipped[node])
                chars += int(lengths[node])
                node += 1
            node *= FAN  # the same place, one lane below
        return chars


def lines_of(text: str) -> SkipList:
    """Lines with their line ends, the last one possibly without."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1]).astype(np.int64)
    starts = starts[starts < len(data)]
    if not len(starts):
        return SkipList(np.zeros(0, np.int64))
    first_bytes = (data & 0xC0) != 0x80
    return SkipList(np.add.reduceat(first_bytes, starts, dtype=np.int64))


def cut(text: str | None, one: int, other: int) -> tuple[int, int, int]:
    """Units, and the code points before the earlier and the later cut."""
    units = lines_of(text or "")
    ranks = sorted((one % (len(units) + 1), other % (len(units) + 1)))
    return len(units), units.before(ranks[0]), units.before(ranks[1])


def cut_all(texts: pa.Array, ones: pa.Array, others: pa.Array) -> pa.Array:
    found = [cut(t.as_py(), a.as_py(), b.as_py()) for t, a, b in zip(texts, ones, others)]
    kinds = (("n", pa.int64()), ("first", pa.int32()), ("second", pa.int32()))
    columns = [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(kinds)]
    return pa.StructArray.from_arrays(columns, [name for name, _ in kinds])


def draws(id_col: Column, seed: int) -> list[Column]:
    """The first four groups of eight digits of the hash, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    share: int = 100,
    spm_share: int = 50,
    seed: int = 7,
) -> DataFrame:
    """Add n (units), form, prefix_chars, middle_chars and output; shares are in percent."""
    row = F.col("row")
    text = F.coalesce(row.getField(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(row.getField(id_col), seed)
    cut_udf = F.arrow_udf(cut_all, "n long, first int, second int")
    cuts = docs.select(whole_row(docs)).select("row", cut_udf(text, h1, h2).alias("cuts"))
    first, second = F.col("cuts.first"), F.col("cuts.second")
    prefix, middle = F.substr(text, F.lit(1), first), F.substr(text, first + 1, second - first)
    suffix = F.substr(text, second + 1)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    left_out = (text == "") | marked | (h3 % 100 >= share)
    form = F.when(left_out, "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")
    output = (
        F.when(left_out, text)
        .when(h4 % 100 < spm_share, F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    )
    return unpacked(
        cuts,
        docs.columns,
        n=F.col("cuts.n"),
        form=form,
        prefix_chars=F.when(~left_out, first.cast("long")),
        middle_chars=F.when(~left_out, (second - first).cast("long")),
        output=output,
    )


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form: each marker occurs once, as texts with markers stay plain."""

    def between(left: str, right: str | None) -> Column:
        rest = F.substr(output, F.instr(output, left) + len(left))
        return rest if right is None else F.substr(rest, F.lit(1), F.instr(rest, right) - 1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u
  FROM documents),
r AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS a,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS pre,
         array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
         array_to_string(u[greatest(a, b) + 1:], '') AS suf
  FROM r)
SELECT doc_id, len(u) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
