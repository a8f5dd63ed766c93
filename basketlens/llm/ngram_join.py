"""Jaccard join of documents on word n-grams, and its components.

Equal sets are joined first, by a 128-bit digest.  Distinct sets meet in tiles: sizes are cut
into bands, and within a band the space of n-gram hashes is cut into more parts than two linked
sets of the band can differ in elements.  Linked sets then agree in a whole part that is not
empty, so the tile (band, part, hash of the part's elements) holds them both, and a passage
that many documents share makes no tile unless it fills a whole part.  Below ``RARE_BELOW`` percent
parts would hold few elements each, and a common passage would fill them; there the tiles of a set
are its rarest elements instead, as many as two linked sets cannot both miss, in an order that puts
the elements frequent in a bounded sample last.  Tiles hang their sets on one of
them; the components of these candidate links are compared within a task: sizes, then the
bit counts of hashed bitmaps (which bound the overlap from above), then the sorted arrays.
Pairs that are connected already are passed over, so a group of near copies takes few
comparisons and only spanning links leave the task.

A candidate component that is too large for a task is cut into chunks.  Each chunk is joined
within and with some common pivots; what then isn't in the component's largest part meets
all chunks, by size and bitmap first, and with its text where these leave it a partner.

Defined results: null texts and texts without words have an empty set and are linked with
nothing.  Equal sets are linked.  Rows that share an id are one document, linked by it; a
row with a null id gets the component of its set if another row with an id has that set, else
null.  Other columns are not read.  An empty table gives no rows.  Texts of any length are
read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import about, unpacked, whole_row
from .graph import components
from .shingles import STEP, WordHashes, mixed, rolled, stepped

WORDS, PERCENT = 3, 90
BAND_RATIO = 1.6
#: Sets and n-grams of one comparing task; pivots of a larger candidate component.
CHUNK_SETS, CHUNK_GRAMS, PIVOTS = 3_000, 4_000_000, 8
#: Bytes of a row of the list of candidates in memory, and up to which size it is broadcast.
MEMBER_BYTES, BROADCAST_LIMIT = 64, 64 << 20
#: Bits of the largest bitmap of a set.
LARGEST_MAP = 1 << 14
#: Below this percentage tiles are single rare elements.
RARE_BELOW = 85
#: Documents that the frequent elements are counted in, and how many of these are kept.
SAMPLE_DOCS, MOST_COMMON = 16_384, 262_144
#: Partitions tried for sets that leave many parts empty.
LEVELS = 6


def bands(largest: int, percent: int) -> list[tuple[int, int, int, int, int]]:
    """(lowest, highest size at home, highest size of a guest, parts, spare) of every band.

    Two linked sets of a band agree in ``spare + 1`` parts at least.  ``spare`` is what the
    smallest sets of the band can be expected to leave empty, if that is possible.
    """
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * BAND_RATIO) - 1)
        guest = high * 100 // percent
        least = (100 - percent) * (high + guest) // (100 + percent) + 1
        spare = least // 4
        for wanted in range(spare):
            empty = (least + wanted) * math.exp(-low / (least + wanted))
            if empty + 3 * math.sqrt(empty) <= wanted:
                spare = wanted
                break
        out.append((low, high, guest, least + spare, spare))
        low = high + 1
    return out


class Tiles:
    """The tiles a set belongs to: one for each part that holds elements.

    A set that leaves more parts empty than the band spares also takes the tiles of another
    partition, and so on; after the last one, all such sets of the band share a tile.
    """

    def __init__(self, percent: int) -> None:
        self.percent, self.bands, self.largest = percent, [], 0

    def _in_band(self, grams: np.ndarray, band: int, parts: int, spare: int) -> list[np.ndarray]:
        found = []
        edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        for level in range(LEVELS):
            values = grams if not level else np.sort(mixed(grams + stepped(level)))
            ends = np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])
            with np.errstate(over="ignore"):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values + STEP))])
                place = np.arange(parts, dtype=np.uint64) + np.uint64((band * LEVELS + level) << 32)
                keys = mixed((sums[ends[1:]] - sums[ends[:-1]]) + mixed(place * STEP))
            full = ends[1:] > ends[:-1]
            found.append(keys[full])
            if parts - int(full.sum()) <= spare:
                return found
        return [*found, mixed(np.array([stepped(band + 1)], dtype=np.uint64))]

    def of(self, grams: np.ndarray) -> np.ndarray:
        n = len(grams)
        if n > self.largest:
            self.largest = 2 * n
            self.bands = bands(self.largest, self.percent)
        found = [
            keys
            for band, (low, high, guest, parts, spare) in enumerate(self.bands)
            if low <= n <= max(high, guest)
            for keys in self._in_band(grams, band, parts, spare)
        ]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


class RareTiles:
    """The tiles a set belongs to: its rarest elements, once for each band it takes part in.

    Linked sets have ``percent`` of the larger one in common at least, so the elements a set
    keeps when those it can miss are left over, the rarest first, can't all differ.  That holds
    for any order of the elements which is the same for all sets; it only has to be a good one
    to keep the tiles small.
    """

    def __init__(self, percent: int, common: np.ndarray, counts: np.ndarray) -> None:
        self.percent, self.common, self.counts = percent, common, counts
        self.bands, self.largest = [], 0

    def of(self, grams: np.ndarray) -> np.ndarray:
        n = len(grams)
        if n > self.largest:
            self.largest = 2 * n
            self.bands = bands(self.largest, self.percent)
        if not n:
            return np.empty(0, np.uint64)
        count = np.zeros(n, np.int64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, grams), len(self.common) - 1)
            count = np.where(self.common[at] == grams, self.counts[at], 0)
        keys = mixed(grams)
        rarest = keys[np.lexsort((keys, count))][: n - -(-n * self.percent // 100) + 1]
        with np.errstate(over="ignore"):
            found = [
                mixed(rarest + stepped(band + 1))
                for band, (low, high, guest, _, _) in enumerate(self.bands)
                if low <= n <= max(high, guest)
            ]
        return np.unique(np.concatenate(found))


def common_grams(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams of a bounded sample of documents, sorted, and in how many they are."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                sets = [gram_set(hashes, t.as_py() or "", words) for t in batch.column("text")[at : at + 100]]
                grams, counts = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.view(np.int64)), pa.array(counts.astype(np.int64))], ["gram", "n"]
                )

    sample = about(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), SAMPLE_DOCS, "doc_id")
    counted = (
        sample.select(F.col("text").cast("string").alias("text"))
        .mapInArrow(split, "gram long, n long")
        .groupBy("gram")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .orderBy(F.col("n").desc(), "gram")
        .limit(MOST_COMMON)
    ).toArrow()
    grams = counted.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return grams[order], counted.column("n").to_numpy()[order]


def gram_set(hashes: WordHashes, text: str, words: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.unique(rolled(hashes.of(text), words))


def digest(grams: np.ndarray) -> tuple[int, int]:
    data = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
    return (
        int.from_bytes(data[:8], "big", signed=True),
        int.from_bytes(data[8:], "big", signed=True),
    )


def described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n and digest (hi, lo; null for an empty set) of every row."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, hi, lo = [], [], []
            for value in batch.column("text"):
                grams = gram_set(hashes, value.as_py() or "", words)
                a, b = digest(grams) if len(grams) else (None, None)
                n.append(len(grams))
                hi.append(a)
                lo.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in (n, hi, lo)]],
                ["doc_id", "n", "hi", "lo"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(describe, "doc_id long, n long, hi long, lo long")


def posted(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(tile, doc_id) of the tiles of every row with an id, combined within batches.

    Of the documents of a batch that share a tile only the first is posted there; each other
    one is tied to it by a tile of their own.  So copies do not gather in the tiles they share.
    """
    rare = common_grams(docs, words) if percent < RARE_BELOW else None

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tiles = WordHashes(), RareTiles(percent, *rare) if rare else Tiles(percent)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = np.array(part.column("doc_id").to_pylist(), dtype=np.int64)
                keys = [tiles.of(gram_set(hashes, t.as_py() or "", words)) for t in part.column("text")]
                owners = np.repeat(ids, [len(k) for k in keys])
                found, owners = combined(np.concatenate(keys).view(np.int64), owners)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(owners)], ["tile", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.where("doc_id IS NOT NULL").mapInArrow(post, "tile long, doc_id long")


def heads(tiles: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by tile: which are the first of their tile, and each row's first owner."""
    first = np.concatenate([[True], tiles[1:] != tiles[:-1]])[: len(tiles)]
    return first, owners[first][np.cumsum(first) - 1]


def combined(tiles: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((owners, tiles))
    tiles, owners = tiles[order], owners[order]
    first, head = heads(tiles, owners)
    pairs = np.unique(np.stack([head, owners], 1)[owners != head], axis=0)
    with np.errstate(over="ignore"):
        ties = mixed(pairs[:, 0].view(np.uint64) + mixed(pairs[:, 1].view(np.uint64) * STEP)).view(np.int64)
    return np.concatenate([tiles[first], ties, ties]), np.concatenate([owners[first], pairs[:, 0], pairs[:, 1]])


def hung(tiles: DataFrame) -> DataFrame:
    """Distinct (u, v): every document of a tile, and the lowest one of the tile.

    One exchange and one sorted pass that remembers the tile it is in.
    """

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = head = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at, owners = (batch.column(c).to_numpy() for c in ("tile", "doc_id"))
            _, lowest = heads(at, owners)
            if at[0] == tile:
                lowest = np.where(at == tile, head, lowest)
            tile, head = at[-1], lowest[-1]
            pairs = np.unique(np.stack([lowest, owners], 1)[owners != lowest], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = tiles.repartition(parts, "tile").sortWithinPartitions("tile", "doc_id")
    return placed.mapInArrow(hang, "u long, v long").distinct()


class Joiner:
    """Compares sets and keeps track of what is connected."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int) -> None:
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        self.ids = [ids[i] for i in order]
        self.sets = [sets[i] for i in order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.percent = percent
        self.parent = list(range(len(ids)))
        self.links: list[tuple[int, int]] = []
        first: dict[int, int] = {}
        for i, doc in enumerate(self.ids):
            self.union(i, first.setdefault(doc, i))
        self.bits = max(64, 1 << int(2 * (self.sizes.max() if len(ids) else 1)).bit_length())
        self.bits = min(self.bits, LARGEST_MAP)
        self.maps = np.stack([parity_map(s, self.bits) for s in self.sets]) if ids else None

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        self.parent[self.root(i)] = self.root(j)

    def linked(self, i: int, j: int) -> bool:
        a, b = self.sets[i], self.sets[j]
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        shared = int((b[at] == a).sum())
        return 100 * shared >= self.percent * (len(a) + len(b) - shared)

    def compare(self, i: int, others: np.ndarray) -> None:
        """Link set i with those of the sets ``others`` (not smaller) that aren't connected."""
        roots = np.array([self.root(int(j)) for j in others])
        others = others[roots != self.root(i)]
        if not len(others):
            return
        differing = np.bitwise_count(self.maps[others] ^ self.maps[i]).sum(axis=1, dtype=np.int64)
        total = self.sizes[others] + self.sizes[i]
        # overlap <= (total - differing) / 2, union = total - overlap
        most = (total - differing) // 2
        for j in others[100 * most >= self.percent * (total - most)]:
            j = int(j)
            if self.root(i) != self.root(j) and self.linked(i, j):
                self.union(i, j)
                self.links.append((self.ids[i], self.ids[j]))

    def all_pairs(self, mine: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Spanning links of all sets; with ``mine``, of pairs with one of these sets only."""
        last = np.searchsorted(self.sizes, self.sizes * 100 // self.percent, side="right")
        for i in range(len(self.ids)):
            others = np.arange(i + 1, last[i])
            if mine is not None and not mine[i]:
                others = others[mine[i + 1 : last[i]]]
            # near ones first: copies are found soon, and the rest is passed over
            for at in range(0, len(others), 512):
                self.compare(i, others[at : at + 512])
        return self.links


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys, of input sorted by them."""
    run, current = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current and run:
                yield run
                run = []
            current = key
            run.append(row)
    if run:
        yield run


def join_groups(rows: DataFrame, keys: list[str], words: int, percent: int) -> DataFrame:
    """Spanning links (u, v) within each group of texts.

    ``side`` is 0 for rows that only meet rows of side 1, 1 for rows that meet all.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for group in groups_of(batches, keys):
            if len(group) < 2 or not any(r["side"] for r in group):
                continue
            order = {}
            for r in group:
                order.setdefault((r["doc_id"], r["text"]), []).append(r)
            unique = list(order)
            joiner = Joiner(
                [d for d, _ in unique], [gram_set(hashes, t or "", words) for _, t in unique], percent
            )
            side = {d: 0 for d, _ in unique}
            known: dict[int, int] = {}
            at_id = {d: i for i, d in enumerate(joiner.ids)}
            for (d, _), same in order.items():
                side[d] = max(side[d], *(r["side"] for r in same))
                root = same[0]["root"]
                if root is not None:
                    joiner.union(at_id[d], at_id[known.setdefault(root, d)])
            mine = np.array([side[d] == 1 for d in joiner.ids])
            links = joiner.all_pairs(None if mine.all() else mine)
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*links)], ["u", "v"]
                )

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(parts, *keys).sortWithinPartitions(*keys)
    return sorted_rows.select(*keys, "doc_id", "text", "side", "root").mapInArrow(
        join, "u long, v long"
    )


def parity_map(grams: np.ndarray, bits: int) -> np.ndarray:
    """Parity of the elements hashed to each bit: maps differ in no more bits than the sets
    differ in elements."""
    spot = (grams & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(spot, minlength=bits) & 1 == 1, bitorder="little").view(np.uint64)


def folded(maps: np.ndarray, bits: int) -> np.ndarray:
    """Maps of ``bits`` bits from larger ones, whose bits lie modulo ``bits``."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, bits // 64), axis=1)


def sketched(texts: DataFrame, words: int) -> DataFrame:
    """doc_id, n and the bitmap (between 4 and 8 bits an element, 2 KB at most) of every text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, maps = [], []
            for value in batch.column("text"):
                grams = gram_set(hashes, value.as_py() or "", words)
                bits = min(max(64, 1 << (4 * len(grams)).bit_length()), LARGEST_MAP)
                sizes.append(len(grams))
                maps.append(parity_map(grams, bits).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())],
                ["doc_id", "n", "map"],
            )

    return texts.mapInArrow(sketch, "doc_id long, n long, map binary")


def partnered(sizes: np.ndarray, maps: list[bytes], side: np.ndarray, roots: np.ndarray, percent: int) -> np.ndarray:
    """Which sets have a partner by the bound of their bitmaps.

    Sets are ordered by size, so the smaller one of a pair has the smaller map.  Pairs of
    one root, and pairs without a set of side 1, don't count.
    """
    found = np.zeros(len(sizes), dtype=bool)
    widths = np.array([8 * len(m) for m in maps])
    last = np.searchsorted(sizes, sizes * 100 // percent, side="right")
    for bits in np.unique(widths):
        mine = np.flatnonzero(widths == bits)
        start, end = mine[0], max(last[mine])
        level = np.empty((end - start, bits // 64), dtype=np.uint64)
        for width in np.unique(widths[start:end]):
            at = np.flatnonzero(widths[start:end] == width)
            rows = np.frombuffer(b"".join(maps[start + i] for i in at), np.uint64).reshape(len(at), -1)
            level[at] = folded(rows, int(bits))
        for i in mine:
            others = np.arange(i + 1, last[i])
            others = others[(roots[others] != roots[i]) & ((side[others] == 1) | (side[i] == 1))]
            if not len(others):
                continue
            differing = np.bitwise_count(level[others - start] ^ level[i - start]).sum(axis=1, dtype=np.int64)
            total = sizes[others] + sizes[i]
            most = (total - differing) // 2
            near = others[100 * most >= percent * (total - most)]
            found[near] = True
            found[i] |= len(near) > 0
    return found


def with_partners(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """The rows (keys, doc_id, side, root) that may be linked with another of their group.

    rows: keys, doc_id, side, root, n, map.  Of each set one row at most comes out, never a
    pair; a group holds a chunk and a block of sets, without their texts.
    """
    names = [*keys, "doc_id", "side", "root"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, keys):
            if not any(r["side"] for r in group):
                continue
            group.sort(key=lambda r: (r["n"], r["doc_id"]))
            found = partnered(
                np.array([r["n"] for r in group]),
                [r["map"] for r in group],
                np.array([r["side"] for r in group]),
                np.array([r["root"] for r in group]),
                percent,
            )
            kept = {tuple(r[c] for c in names) for r, near in zip(group, found) if near}
            if kept:
                columns = zip(*sorted(kept))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], names
                )

    kinds = [pa.int64(), *[pa.int32()] * (len(keys) - 1), pa.int64(), pa.int32(), pa.int64()]
    types = [f"{k} {'int' if i else 'long'}" for i, k in enumerate(keys)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select(*names, "n", "map").repartition(parts, *keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(find, ", ".join([*types, "doc_id long, side int, root long"]))


def links(docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """Spanning links (u, v) of the distinct sets; sets: doc_id, n."""
    # the lowest document with a set stands for it; copies only lead from one to another
    ids = sets.select(F.col("doc_id").alias("vertex")).distinct()
    found = components(hung(posted(docs, words, percent)))
    grouped = cut_lineage(found.join(ids, "vertex", "left_semi"))
    sized = grouped.join(sets.select(F.col("doc_id").alias("vertex"), "n"), "vertex")
    counted = sized.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("grams"))
    chunks = F.greatest(
        F.ceil(F.col("sets") / CHUNK_SETS), F.ceil(F.col("grams") / CHUNK_GRAMS)
    ).cast("int")
    spread = counted.where("sets > 1").select("root", chunks.alias("chunks"))
    members = cut_lineage(
        grouped.join(spread, "root").select(
            F.col("vertex").alias("doc_id"),
            F.col("root").alias("component"),
            "chunks",
            F.pmod(F.xxhash64("vertex"), F.col("chunks")).cast("int").alias("chunk"),
        )
    )
    # texts go straight to their group if the list of who goes where can be sent to them
    listed = members.count() * MEMBER_BYTES <= BROADCAST_LIMIT
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(members) if listed else members, "doc_id"
    )
    plain = texts.withColumns({"side": F.lit(1), "root": F.lit(None).cast("long")})
    large = texts.where("chunks > 1")
    if not spread.where("chunks > 1").limit(1).count():
        return join_groups(plain, ["component", "chunk"], words, percent)

    # pivots, the same for all chunks of a component
    chosen = members.where("chunks > 1").where(
        F.pmod(F.xxhash64("doc_id", F.lit("pivot")), F.col("chunks") * CHUNK_SETS) < PIVOTS
    )
    pivots = (
        large.join(chosen.select("doc_id"), "doc_id", "left_semi")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumns({"side": F.lit(1), "root": F.lit(None).cast("long")})
    )
    near = cut_lineage(
        join_groups(plain.unionByName(pivots), ["component", "chunk"], words, percent)
    )
    # what is not in the largest part of its component meets all chunks
    roots = components(near).withColumnRenamed("vertex", "doc_id")
    placed = cut_lineage(
        large.drop("text").join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    )
    parts = placed.groupBy("component", "root").count()
    largest = parts.groupBy("component").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    stragglers = placed.join(largest, "component").where("root <> main").drop("main")
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    n_blocks = stragglers.groupBy("component").agg(
        F.ceil(F.count("*") / CHUNK_SETS).cast("int").alias("blocks")
    )
    home = (
        placed.join(n_blocks, "component")
        .select("doc_id", "component", "chunk", "root", blocks)
        .withColumn("side", F.lit(0))
    )
    away = (
        stragglers.join(n_blocks, "component")
        .select(
            "doc_id",
            "component",
            F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
            "root",
            F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("blocks")).cast("int").alias("block"),
        )
        .withColumn("side", F.lit(1))
    )
    # bitmaps meet first; texts follow for the sets that the bitmaps leave a partner
    places = ["component", "chunk", "block"]
    maps = sketched(large.select("doc_id", "text"), words).distinct()
    needed = cut_lineage(with_partners(home.unionByName(away).join(maps, "doc_id"), places, percent))
    listed = needed.count() * MEMBER_BYTES <= BROADCAST_LIMIT
    wanted = needed.select("doc_id").distinct()
    again = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(wanted) if listed else wanted, "doc_id", "left_semi"
    )
    meeting = again.distinct().join(needed, "doc_id")
    rest = join_groups(meeting, places, words, percent)
    return near.unionByName(rest)


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id."""
    rows = cut_lineage(described(docs, words))
    sets = cut_lineage(
        rows.where("n > 0 AND doc_id IS NOT NULL")
        .groupBy("hi", "lo")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    )
    found = links(docs, sets, words, percent)
    # an id with several texts joins their sets
    same = rows.where("n > 0").select("doc_id", "hi", "lo").join(
        sets.select("hi", "lo", F.col("doc_id").alias("rep")), ["hi", "lo"]
    )
    again = same.where("doc_id <> rep").select("doc_id", "rep").join(
        sets.select("doc_id").distinct(), "doc_id", "left_semi"
    )
    every = found.unionByName(again.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    roots = components(every)
    named = sets.select("hi", "lo", "doc_id").join(
        roots.withColumnRenamed("vertex", "doc_id"), "doc_id", "left"
    )
    named = named.select("hi", "lo", F.coalesce("root", "doc_id").alias("component_id"))
    return rows.select("doc_id", "n", "hi", "lo").join(named, ["hi", "lo"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, with all columns.

    Rows without an id and documents without words are kept; of rows that share an id one is
    kept, the one with the longest text (ties: the first in order).
    """
    joined = join(docs.select("doc_id", "text"), words, percent).where("doc_id IS NOT NULL")
    kept = (
        joined.groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min("component_id").alias("_component"))
        .where("_id = _component")
        .select("_id")
    )
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("_id"))
    first = Window.partitionBy("_id").orderBy(F.length("row.text").desc_nulls_last(), "row.text")
    named = (
        rows.join(kept, "_id", "left_semi")
        .withColumn("n", F.row_number().over(first))
        .where("n = 1")
    )
    return unpacked(named.unionByName(rows.where("_id IS NULL").withColumn("n", F.lit(1))), docs.columns)
