"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one vocabulary token can be the last token of its
BPE encoding.  The table of these last tokens is filled from left to right: of the
tokens that are a suffix of the prefix, the valid one is that which stays apart from
the last token of the remaining prefix.  The encoding is read back from the end.  As a
prefix's entry never depends on later bytes, appending is exact and an edit only
recomputes the table from the edited byte on (:class:`PrefixTable`).

A text is cut into pieces by the vocabulary's pattern and each piece is encoded on its
own, without special tokens.

Defined results: a null text has null ids from :func:`encode_ids` and counts as empty in
:func:`encode_digest`; an empty text has no ids.  Rows are independent, so repeated
rows, extra columns and empty tables need no care; a text of any length is encoded
whole, in time linear in its length.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEVER = 1 << 30
#: Entries a worker remembers before it forgets all; the results do not depend on it.
PIECES_KEPT = 250_000
PAIRS_KEPT = 500_000


#: Characters of texts whose pieces are looked up together.
CHARS_AT_ONCE = 500_000


def together(texts: pa.Array) -> Iterator[list[str | None]]:
    """Runs of texts of about CHARS_AT_ONCE characters, each run at least one text."""
    run, size = [], 0
    for value in texts:
        text = value.as_py()
        run.append(text)
        size += len(text or "")
        if size >= CHARS_AT_ONCE:
            yield run
            run, size = [], 0
    if run:
        yield run


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines)]
    tokens = [b""] * (1 + max(rank for rank, _ in pairs))
    for rank, token in pairs:
        tokens[rank] = token
    return tokens


def ascii_pattern(pattern: str) -> str | None:
    """The pattern for ASCII texts, in classes that the standard library knows (and is
    faster at); None if it uses others."""
    classes = {"\\p{L}": "A-Za-z", "\\p{N}": "0-9", "\\s": "\\t-\\r ", "\\S": None}
    out, inside, at = [], False, 0
    for m in re.finditer(r"\\p\{\w+\}|\\.|[\[\]]", pattern):
        out.append(pattern[at : m.start()])
        at, found = m.end(), m[0]
        if found in "[]":
            inside = found == "["
        elif found == "\\S" and not inside:
            found = "[^\\t-\\r ]"
        elif classes.get(found):
            found = classes[found] if inside else f"[{classes[found]}]"
        elif found[1].isalnum():
            return None
        out.append(found)
    return "".join([*out, pattern[at:]])


class Vocabulary:
    """Tokens, how each came about, and which neighbours stay apart."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.tokens = tokens
        self.pattern = pattern
        self.ranks = {token: rank for rank, token in enumerate(tokens) if token}
        self.left, self.right = self._last_merges()
        self.below, self.path = self._suffix_trie()
        self._start()

    def _start(self) -> None:
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.apart: dict[int, bool] = {}
        self.find = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pieces", "apart", "find", "find_ascii")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def _last_merges(self) -> tuple[list[int], list[int]]:
        """The two tokens that each token was merged from; -1 for single bytes."""
        ranks = self.ranks
        left, right = [-1] * len(self.tokens), [-1] * len(self.tokens)
        for rank, token in enumerate(self.tokens):
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = min(
                    (ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                )
                if best >= rank:
                    raise ValueError(f"token {rank} is not made of lower ranks")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                left[rank], right[rank] = ranks[parts[0]], ranks[parts[1]]
        return left, right

    def _suffix_trie(self) -> tuple[list[dict[int, int]], list[tuple]]:
        """Trie over reversed tokens, and the tokens on the way to each node, longest first."""
        below: list[dict[int, int]] = [{}]
        path: list[tuple] = [()]
        for rank in sorted(range(len(self.tokens)), key=lambda r: len(self.tokens[r])):
            token = self.tokens[rank]
            node = 0
            for byte in reversed(token):
                step = below[node].get(byte)
                if step is None:
                    step = below[node][byte] = len(below)
                    below.append({})
                    path.append(path[node])
                node = step
            if token:
                path[node] = ((rank, len(token)), *path[node])
        return below, path

    def stays_apart(self, first: int, second: int) -> bool:
        """Whether BPE of both tokens' bytes gives just these two tokens again.

        Looks at all moments of the merging: tokens x and y touch at the border from the
        birth of the younger until one of them is merged away.  A merge of both within that
        time would cross the border; of equal ranks, the one further left is done first.
        """
        key = first << 20 | second
        known = self.apart.get(key)
        if known is not None:
            return known
        tokens, ranks, left, right = self.tokens, self.ranks, self.left, self.right
        x, y, x_until, y_until = first, second, NEVER, NEVER
        result = True
        while True:
            merged = ranks.get(tokens[x] + tokens[y], NEVER)
            if merged < x_until and merged <= y_until and merged < NEVER:
                result = False
                break
            if x > y:
                if left[x] < 0:
                    break
                x_until, x = x, right[x]
            else:
                if left[y] < 0:
                    break
                y_until, y = y, left[y]
        if len(self.apart) >= PAIRS_KEPT:
            self.apart.clear()
        self.apart[key] = result
        return result

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Append to ``last`` (one entry per prefix) until it covers all of ``data``."""
        below, path, apart = self.below, self.path, self.apart
        for end in range(len(last), len(data)):
            node = below[0].get(data[end], 0)
            at = end - 1
            while at >= 0:
                step = below[node].get(data[at])
                if step is None:
                    break
                node = step
                at -= 1
            for token, size in path[node]:
                before = end - size
                if before < 0:
                    break
                known = apart.get(last[before] << 20 | token)
                if known or (known is None and self.stays_apart(last[before], token)):
                    break
            else:
                raise ValueError("a byte is missing in the vocabulary")
            last.append(token)
        return last

    def read_back(self, last: list[int]) -> list[int]:
        ids, at = [], len(last) - 1
        while at >= 0:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        ids.reverse()
        return ids

    def learn(self, pieces) -> None:
        """Remember the encodings of ``pieces``.

        They are taken in byte order: neighbours then share a prefix, and its entries of the
        table stay as they are.
        """
        tokens, known, last, previous = self.tokens, self.pieces, [], b""
        for data, piece in sorted((p.encode("utf-8", "surrogatepass"), p) for p in pieces):
            shared, most = 0, min(len(data), len(previous))
            while shared < most and data[shared] == previous[shared]:
                shared += 1
            del last[shared:]
            self.extend(data, last)
            ids, at = [], len(data) - 1
            while at >= 0:
                ids.append(last[at])
                at -= len(tokens[last[at]])
            known[piece] = tuple(ids[::-1])
            previous = data

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        if self.find is None:
            import regex

            self.find = regex.compile(self.pattern).findall
            plain = ascii_pattern(self.pattern)
            self.find_ascii = re.compile(plain).findall if plain else self.find
        cut = [self.find_ascii(t) if t.isascii() else self.find(t) for t in texts]
        needed = set().union(*cut)
        if len(self.pieces) + len(needed) > PIECES_KEPT:
            self.pieces.clear()
        self.learn(needed.difference(self.pieces))
        known = self.pieces.__getitem__
        return [list(chain.from_iterable(map(known, pieces))) for pieces in cut]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """Encoding of one piece that can be appended to and edited."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.vocabulary.extend(self.data, self.last)

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Put ``data`` in place of the bytes from ``start`` to ``end``."""
        self.data = self.data[:start] + data + self.data[end:]
        del self.last[start:]
        self.vocabulary.extend(self.data, self.last)

    def ids(self, end: int | None = None) -> list[int]:
        """Encoding of the whole piece, or of its first ``end`` bytes."""
        return self.vocabulary.read_back(self.last[:end])


@functools.lru_cache(maxsize=4)
def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(read_ranks(path), pattern)


def shipped(spark: SparkSession, path: str, pattern: str):
    """The vocabulary as a broadcast; its size is that of the vocabulary file."""
    return spark.sparkContext.broadcast(load_vocabulary(path, pattern))


def encode_ids(spark: SparkSession, path: str, pattern: str) -> Callable[[Column], Column]:
    """Column function: text -> token ids."""
    sent = shipped(spark, path, pattern)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.int32())
        found = [pa.array([], kind)]
        for run in together(texts):
            ids = sent.value.encode_all([t or "" for t in run])
            found.append(pa.array([i if t is not None else None for t, i in zip(run, ids)], kind))
        return pa.concat_arrays(found)

    return ids


def decode_ids(spark: SparkSession, path: str, pattern: str) -> Callable[[Column], Column]:
    """Column function: token ids -> bytes."""
    sent = shipped(spark, path, pattern)

    @F.arrow_udf("binary")
    def data(ids: pa.Array) -> pa.Array:
        decode = sent.value.decode
        return pa.array([None if x is None else decode(x) for x in ids.to_pylist()], pa.binary())

    return data


def encode_digest(spark: SparkSession, path: str, pattern: str) -> Callable[[Column], Column]:
    """Column function: text -> number and digest of its ids, digest of the decoded ids.

    Encodes and decodes in one pass, so that the ids need not leave the worker.
    """
    sent = shipped(spark, path, pattern)
    kind = pa.struct(
        [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    )

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pa.Array) -> pa.Array:
        vocabulary, rows = sent.value, []
        for run in together(texts):
            for ids in vocabulary.encode_all([t or "" for t in run]):
                decimal = " ".join(map(str, ids)).encode()
                data = vocabulary.decode(ids)
                rows.append(
                    (
                        len(ids),
                        hashlib.sha256(decimal).hexdigest(),
                        hashlib.sha256(data).hexdigest(),
                    )
                )
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.StructArray.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, kind)], fields=list(kind)
        )

    return digest


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    digest = encode_digest(docs.sparkSession, path, pattern)
    return docs.select("doc_id", digest(F.col("text")).alias("found")).select("doc_id", "found.*")
