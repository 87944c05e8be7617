"""Lexical retrieval packing: seeds take their best unused BM25 neighbours into their window."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import documents, small_batches, written

WINDOW = 1024
#: Id that ends a document.
STOP = 0
#: Tokens of a shard of the index, in the mean.
SHARD_TOKENS = 2_000_000
K1, B = 1.2, 0.75
#: Terms that more than one document in DENSE of a shard holds are scored as rows of a matrix, the others by postings.
DENSE = 8
#: Neighbours that are ranked at first; the others follow when these are used.
FIRST = 64
#: Widths of the projected documents, of which a bounded sample sets the borders of the shards.
WIDTH, SAMPLE = 256, 1 << 16
#: Borders cut the sample into at least so many leaves for a shard.
LEAVES = 4
_ROWS = 256


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of byte strings of a tokenizer file, where it is plain byte-level BPE whose ids follow the order of its merges; else None.

    For such a file merging the pair of least rank and applying the merges in order are the same.
    """
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    vocab, special = model["vocab"], {t["content"] for t in spec.get("added_tokens", ())}
    pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    made = [vocab["".join(x)] for x in pairs]
    # a byte that prints stands for itself, the others for the characters from 256 on
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    byte = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(prints))}
    if made != sorted(made) or len(set(made)) != len(made) or any(t not in byte and t not in special and vocab[t] < 256 for t in vocab):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a tokenizer file.

    Where byte_ranks() allows it, tiktoken's merger runs over the file's own merges, which gives the same ids several times faster.
    Texts that hold a special token, and other kinds of file, go through the library as they are.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.special = path, [t["content"] for t in spec.get("added_tokens", ())]
        self.size = max([len(spec["model"]["vocab"]), *(t["id"] + 1 for t in spec.get("added_tokens", ()))])
        ranks, self.merger = byte_ranks(spec), None
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            # with no special token at all it looks for the empty one at every character; this one is never allowed, so texts that hold it are text
            self.merger = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<\0none\0>": max(ranks.values()) + 1})

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, without special tokens of the tokenizer's own."""
        if self.merger is None or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.merger.encode_to_numpy(text, disallowed_special=()).astype("<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


_TOKENS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])


def token_table(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n, ids): ids of each whole text and STOP, as unsigned 16-bit integers where all ids fit, else 32-bit. Null text: empty."""

    def tokens(batches):
        e = encoder(path)
        kind = "<u2" if e.size <= 1 << 16 else "<u4"
        stop = np.array([STOP], kind)
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                ids = [np.concatenate((e.encode(x or "").astype(kind), stop)) for x in b.column(1).slice(at, _ROWS).to_pylist()]
                yield pa.record_batch([b.column(0).slice(at, _ROWS), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tokens, _TOKENS)


def _ids(row: bytes, n: int) -> np.ndarray:
    return np.frombuffer(row, "<u2" if len(row) == 2 * n else "<u4")


def _frequencies(batches):
    """Documents that hold each id, summed over a partition; -1: documents, -2: ids."""
    held, docs, ids = np.zeros(0, np.int64), 0, 0
    for b in batches:
        for n, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            u = np.unique(_ids(raw.as_py(), n)[:-1]).astype(np.int64)
            if len(u) and u[-1] >= len(held):
                held = np.concatenate((held, np.zeros(int(u[-1]) + 1 - len(held), np.int64)))
            held[u] += 1
            docs, ids = docs + 1, ids + n
    some = np.nonzero(held)[0]
    yield pa.record_batch([pa.array(np.concatenate((some, [-1, -2]))), pa.array(np.concatenate((held[some], [docs, ids])))], ["id", "n"])


class Index:
    """A BM25 inverted index over one shard's documents, with frequencies of the whole corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, counts, sizes = [], [], []
        for x in docs:
            t, c = np.unique(x[:-1], return_counts=True)
            terms.append(t.astype(np.int64))
            counts.append(c)
            sizes.append(len(t))
        owner = np.repeat(np.arange(len(docs)), sizes)
        term, tf = np.concatenate(terms), np.concatenate(counts)
        length = np.array([len(x) - 1 for x in docs])
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / max(mean, 1)))).astype(np.float32)
        self.n, self.starts, self.terms = len(docs), np.concatenate(([0], np.cumsum(sizes))), term
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = owner[order], weight[order]
        self.edges = np.searchsorted(term[order], np.arange(len(idf) + 1))
        often = np.nonzero(np.diff(self.edges) * DENSE > self.n)[0]
        self.row = np.full(len(idf), -1)
        self.row[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.n), np.float32)
        for i, t in enumerate(often):
            self.matrix[i, self.doc[self.edges[t] : self.edges[t + 1]]] = self.weight[self.edges[t] : self.edges[t + 1]]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all different terms of the seed."""
        asked = self.terms[self.starts[seed] : self.starts[seed + 1]]
        rows = self.row[asked]
        often = np.zeros(len(self.matrix), np.float32)
        often[rows[rows >= 0]] = 1
        score = often @ self.matrix
        for t in asked[rows < 0].tolist():
            a, b = self.edges[t], self.edges[t + 1]
            score[self.doc[a:b]] += self.weight[a:b]
        return score

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """The unused documents that share a term with the seed, best first."""
        score = self.scores(seed)
        score[used] = 0
        some = np.nonzero(score)[0]
        value = score[some]
        if len(some) > FIRST:
            # all that are as good as the last of the first, so that ties keep their order
            top = value >= np.partition(value, len(value) - FIRST)[len(value) - FIRST]
            yield from some[top][np.argsort(-value[top], kind="stable")].tolist()
            some, value = some[~top], value[~top]
        yield from some[np.argsort(-value, kind="stable")].tolist()


@lru_cache(maxsize=1)
def _signs(size: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2, (size, WIDTH), np.int8) * np.int8(2) - np.int8(1)


def projected(ids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The document's terms, by their weight, as a unit vector of WIDTH random sums; zero without terms."""
    t, c = np.unique(ids[:-1], return_counts=True)
    v = ((1 + np.log(c)) * idf[t]).astype(np.float32) @ _signs(len(idf))[t].astype(np.float32)
    return v / max(float(np.sqrt(v @ v)), 1e-9)


class Borders:
    """A tree of halvings that leaves documents of like content in one shard.

    Each node parts the sample by the line between two means. Leaves lie in the order of the tree, and consecutive ones share a shard, by their share
    of the sample's tokens; a leaf that is larger than a shard is dealt to several by a hash.
    """

    def __init__(self, x: np.ndarray, tokens: np.ndarray, shards: int):
        self.shards, self.nodes, self.leaves = shards, [], []
        self.way = np.zeros((0, WIDTH), np.float32)
        ways: list[np.ndarray] = []
        total, done = max(float(tokens.sum()), 1.0), 0.0
        rnd = np.random.default_rng(3)
        # (rows, node to hang on, side)
        stack: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
        while stack:
            rows, over, side = stack.pop()
            parted = self._parted(x[rows].astype(np.float32), rnd) if tokens[rows].sum() * shards * LEAVES > total else None
            if parted is None:
                share = float(tokens[rows].sum()) / total
                me = ~len(self.leaves)
                self.leaves.append((done, share))
                done += share
            else:
                way, at, right = parted
                me = len(self.nodes)
                ways.append(way)
                self.nodes.append([at, 0, 0])
                stack += [(rows[right], me, 2), (rows[~right], me, 1)]
            if over >= 0:
                self.nodes[over][side] = me
        if ways:
            self.way = np.array(ways, np.float32)

    @staticmethod
    def _parted(x: np.ndarray, rnd) -> tuple[np.ndarray, float, np.ndarray] | None:
        if len(x) < 2:
            return None
        a = x[rnd.integers(len(x))]
        a, b = x[np.argmin(x @ a)], a
        for _ in range(8):
            right = x @ (a - b) > (a @ a - b @ b) / 2
            if right.all() or not right.any():
                return None
            a, b = x[right].mean(axis=0), x[~right].mean(axis=0)
        way = a - b
        along = x @ way
        at = float(np.clip((a @ a - b @ b) / 2, *np.quantile(along, (0.1, 0.9))))
        right = along > at
        return None if right.all() or not right.any() else (way, at, right)

    def shard(self, v: np.ndarray, part: float) -> int:
        """The shard of a projected document; part, from 0 to 1, is its place in a leaf that several shards hold."""
        node = 0 if self.nodes else -1
        while node >= 0:
            at, low, high = self.nodes[node]
            node = high if float(self.way[node] @ v) > at else low
        start, share = self.leaves[~node]
        return min(int((start + share * (part if share * self.shards > 1 else 0.5)) * self.shards), self.shards - 1)


def fill(docs: list[np.ndarray], index: Index, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset). A document that overflows its window goes on in the next and is its seed:
    the window takes the best neighbours of its seed in turn, or the next unused document where no neighbour is left."""
    used, pieces = np.zeros(len(docs), bool), []
    sequence, offset, turn = 0, 0, 0
    near = None
    left = len(docs)
    while left:
        k = -1
        for x in near or ():
            if not used[x]:
                k = x
                break
        if k < 0:
            while used[turn]:
                turn += 1
            k = turn
            near = None
        used[k] = True
        left -= 1
        start, n, first = 0, len(docs[k]), sequence
        while start < n:
            m = min(window - offset, n - start)
            pieces.append((k, start, m, sequence, offset))
            start, offset = start + m, offset + m
            if offset == window:
                sequence, offset = sequence + 1, 0
        if (near is None or sequence != first) and left:
            near = index.neighbours(k, used)
    return pieces


_PIECES = T.StructType([*(T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])
_PIECES_ARROW = pa.schema([*((n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def _dealt(tokens: DataFrame, shared, shards: int, n_docs: int) -> DataFrame:
    """tokens and the shard of each document, by its content."""
    if shards == 1:
        return tokens.withColumn("shard", F.lit(0).cast("long"))
    place = F.xxhash64("doc_id", F.crc32("ids"))
    cut = T.StructType([T.StructField("n", T.LongType()), T.StructField("place", T.LongType()), T.StructField("v", T.BinaryType())])

    def sampled(batches):
        idf, _ = shared.value
        for b in batches:
            v = [projected(_ids(raw.as_py(), n), idf).astype("<f2").tobytes() for n, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(v, pa.binary())], ["n", "place", "v"])

    # as many rows as SAMPLE in the mean, of 512 bytes each
    want = min(n_docs, SAMPLE, 32 * LEAVES * shards + 1024)
    drawn = tokens.select("n", "ids", place.alias("place")).where(F.pmod(F.xxhash64("place"), F.lit(1 << 20)) < -(-want * (1 << 20) // n_docs))
    sample = drawn.mapInArrow(sampled, cut).toArrow().sort_by([("place", "ascending"), ("n", "ascending")])
    x = np.frombuffer(b"".join(sample.column("v").to_pylist()), "<f2").reshape(-1, WIDTH)
    borders = tokens.sparkSession.sparkContext.broadcast(Borders(x, sample.column("n").to_numpy(), shards))

    def sharded(batches):
        (idf, _), tree = shared.value, borders.value
        for b in batches:
            parts = (b.column(3).to_numpy() / 2.0**64 + 0.5).tolist()
            k = [tree.shard(projected(_ids(raw.as_py(), n), idf), p) for n, raw, p in zip(b.column(1).to_pylist(), b.column(2), parts, strict=True)]
            yield pa.record_batch([*b.columns[:3], pa.array(k, pa.int64())], ["doc_id", "n", "ids", "shard"])

    return tokens.select("doc_id", "n", "ids", place.alias("place")).mapInArrow(sharded, T.StructType([*_TOKENS, T.StructField("shard", T.LongType())]))


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, ids: bool = False) -> DataFrame:
    """Pieces of documents (doc_id, text) in sequences of at most window tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and with ids the piece's ids as little-endian unsigned 32-bit integers.

    The inverted index is sharded by content, with document frequencies of the whole corpus: documents of like terms share a shard, exact copies too.
    Each shard retrieves by all terms of a seed and fills by itself, and leaves one sequence unfilled at most; neighbours in other shards are not met. A null or empty text is one token, the end; very long texts run over many sequences;
    ties in score go to the smaller place in the shard, which is by doc_id and ids; repeated rows are packed as often as they
    occur; an empty table gives no rows. Columns other than doc_id and text are not read.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    small_batches(docs.sparkSession)
    tokens = written(token_table(docs, path), "tokens", "snappy")
    held = tokens.select("n", "ids").mapInArrow(_frequencies, T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])).groupBy("id").agg(F.sum("n").alias("n"))
    # as many rows as the vocabulary has ids, and two
    counts = {r["id"]: r["n"] for r in held.collect()}
    n_docs, n_ids = counts.pop(-1, 0), counts.pop(-2, 0)
    df = np.zeros(max(counts, default=0) + 1)
    df[list(counts)] = list(counts.values())
    shared = docs.sparkSession.sparkContext.broadcast((np.log(1 + (n_docs - df + 0.5) / (df + 0.5)), n_ids / max(n_docs, 1)))
    shards = max(1, -(-n_ids // shard_tokens))

    def packed(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("doc_id", "n", "ids")), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
        arrays = [_ids(raw, n) for _, n, raw in rows]
        idf, mean = shared.value
        out: dict[str, list] = {n: [] for n in _PIECES_ARROW.names}
        for k, start, length, sequence, offset in fill(arrays, Index(arrays, idf, mean), window):
            piece = arrays[k][start : start + length].astype("<u4").tobytes()
            row = (rows[k][0], start, length, zlib.crc32(piece), rows[k][1], shard << 32 | sequence, offset, piece if ids else None)
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return pa.table([pa.array(out[f.name], f.type) for f in _PIECES_ARROW], schema=_PIECES_ARROW)

    pieces = _dealt(tokens, shared, shards, n_docs).groupBy("shard").applyInArrow(packed, _PIECES)
    return pieces if ids else pieces.drop("ids")


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
