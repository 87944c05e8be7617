"""Byte-level BPE by a segment tree of pair ranks, and its inverse."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import CHUNK, documents, small_batches

#: Chunks and pieces of text whose ids a worker remembers, in two generations: when the young one is full the old one goes. That
#: costs time and never changes a result.
CHUNKS, PIECES = 150_000, 500_000


class Memory:
    """A bounded dictionary that forgets what has not been used for long."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str) -> tuple[int, ...] | None:
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key: str, value: tuple[int, ...]) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    """Encodes and decodes by a table of byte strings and their ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes = {v: k for k, v in ranks.items()}
        self.decimal = {v: str(v) for v in ranks.values()}
        self.match = regex.compile(pattern)
        #: above every rank; and the ranks of all pairs of bytes
        self.none = max(ranks.values()) + 1
        self.two = [ranks.get(bytes((a, b)), self.none) for a in range(256) for b in range(256)]
        self.chunks = Memory(CHUNKS)
        self.pieces = Memory(PIECES)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern.

        Leaf i of the segment tree holds the rank of the pair that begins at byte i, with i below it, so that the root is
        the leftmost pair of least rank. A merge changes the leaves of the two live neighbours and clears one more.
        """
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        none = self.none * n
        two = self.two
        leaves = [two[a << 8 | b] * n + i for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False))]
        leaves += [none] * ((1 << (n - 2).bit_length()) - n + 1)
        tree = [leaves]
        while len(leaves) > 1:
            leaves = list(map(min, leaves[::2], leaves[1::2]))
            tree.append(leaves)
        after, before, root = list(range(1, n + 2)), list(range(-1, n + 1)), tree[-1]
        while root[0] < none:
            i = root[0] % n
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            changed = []
            if j < n - 1:
                changed.append((j, none))
            if i:
                p = before[i]
                r = get(piece[p:k])
                changed.append((p, none if r is None else r * n + p))
            r = get(piece[i : after[k]]) if k < n else None
            changed.append((i, none if r is None else r * n + i))
            for at, value in changed:
                for level in tree:
                    if level[at] == value:
                        break
                    level[at] = value
                    if level is root:
                        break
                    other = level[at ^ 1]
                    if other < value:
                        value = other
                    at >>= 1
        ranks, out, i = self.ranks, [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def chunk(self, text: str) -> tuple[int, ...]:
        ids: list[int] = []
        pieces = self.pieces
        for m in self.match.findall(text):
            got = pieces.get(m)
            if got is None:
                got = self.merge(m.encode("utf-8", "surrogatepass"))
                if len(m) <= 64:
                    pieces.put(m, tuple(got))
            ids += got
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text. Matches of the pattern never span the edges of its chunks, so chunks are encoded apart."""
        chunks, ids = self.chunks, []
        young = chunks.young
        for c in CHUNK.findall(text):
            got = young.get(c)
            if got is None:
                got = chunks.get(c)
                if got is None:
                    got = self.chunk(c)
                    if len(c) <= 64:
                        chunks.put(c, got)
                young = chunks.young
            ids += got
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file: lines of base64 bytes and a rank."""
    with open(path, "rb") as f:
        return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def _tables(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, to: str = "ids") -> DataFrame:
    """docs and a column of token ids (array of int) for the whole column text. Null and empty texts give no ids.

    path names a rank file that every worker can read, pattern the split of a text; columns other than text are passed
    through, and a column named as to is replaced. Repeated rows and ties make no difference; no rows, no rows.
    """
    path, pattern = _tables(path, pattern)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(text: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series([c.encode(x or "") for x in text], dtype=object)

    return docs.withColumn(to, ids(F.col("text")))


def decode(tokens: DataFrame, path: str | None = None, pattern: str | None = None, ids: str = "ids", to: str = "bytes") -> DataFrame:
    """tokens and a binary column of what the ids stand for; null ids give empty bytes."""
    path, pattern = _tables(path, pattern)

    @F.pandas_udf(T.BinaryType())
    def back(column: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series([c.decode(() if x is None else x) for x in column], dtype=object)

    return tokens.withColumn(to, back(F.col(ids)))


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row (doc_id, n_tokens, ids_sha256, decoded_sha256) per row of docs (doc_id, text), encoded and decoded in one pass.

    ids_sha256 is the SHA-256 of the decimal ids joined by commas, decoded_sha256 that of the decoded bytes; null text
    and empty text have no ids. Ids are decoded, never the text repeated; very long texts are encoded whole; ties and repeated
    rows get the same digests; an empty table gives no rows. Other columns are not read.
    """
    path, pattern = _tables(path, pattern)
    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    @F.pandas_udf(schema)
    def digest(text: pd.Series) -> pd.DataFrame:
        c = codec(path, pattern)
        rows = []
        for x in text:
            ids = c.encode(x or "")
            rows.append((len(ids), hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest(F.col("text")).alias("d")).select("doc_id", "d.*")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
