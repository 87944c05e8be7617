"""An interpolated modified Kneser-Ney bigram model of any number of texts, counted and scored in shards; no task holds the whole of it.

Documents are dealt into batches by their ids. Batches with learned texts send these texts' different bigrams, once each, to shards, which add them up to the model: a shard has
contexts, what follows them, and how many contexts each of its words has followed anywhere. Then each batch asks shards for its bigrams and words, and is measured by the answers.

Texts and what they ask for take more room while they are shuffled than the model does. So batches go in PASSES, one after another, and what a pass shuffles is gone before the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import meanwhile, small_batches, thrifty, written
from factloom.llm.lm import _FREQUENT, BATCH_BYTES, BLOCK, HOT, SHARE, Local, _forty, _frequent, _middle, _pack, _unpack

#: Every batch is in one pass; all rows are counted and measured, whatever their number.
PASSES = 4
_NONE = np.zeros(0, np.uint64)


def _schemas(longs: tuple[str, ...], binaries: tuple[str, ...], more: tuple[str, ...] = ()) -> tuple[T.StructType, pa.Schema]:
    fields = [*((n, T.LongType(), pa.int64()) for n in longs), *((n, T.BinaryType(), pa.binary()) for n in binaries), *((n, T.LongType(), pa.int64()) for n in more)]
    return T.StructType([T.StructField(n, k) for n, k, _ in fields]), pa.schema([(n, k) for n, _, k in fields])


_ASK, _ASK_ARROW = _schemas(("batch", "shard"), ("ctx", "held", "followers", "counts"))
#: A row of a shard's contexts and what follows them, with the numbers of bigrams of count 1 to 4 and of all; or of words (ctx) and their continuation counts, without held.
_MODEL, _MODEL_ARROW = _schemas(("shard",), ("ctx", "held", "followers", "counts"), tuple(f"n{i}" for i in range(1, 6)))
_ANSWER, _ANSWER_ARROW = _schemas(("batch", "shard"), ("followed", "counts", "continued"))
_WORDS = T.StructType([T.StructField("word", T.LongType()), T.StructField("k", T.LongType())])
#: Columns that documents are given meanwhile.
BATCH, HELD_OUT = "__kn batch", "__kn held out"


def _unforty(raw: bytes) -> np.ndarray:
    f = np.zeros((len(raw) // 5, 8), np.uint8)
    f[:, :5] = np.frombuffer(raw, np.uint8).reshape(5, -1).T
    return f.view(np.uint64).ravel()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _packed(a: np.ndarray) -> bytes:
    """Counts, in as few bytes each as the largest needs."""
    kind = np.min_scalar_type(int(a.max(initial=0)))
    return bytes([kind.itemsize]) + _pack(a.astype(kind))


def _unpacked(b: bytes) -> np.ndarray:
    return _unpack(b[1:], f"u{b[0]}").astype(np.int64)


def _keys(owner: np.ndarray, held: np.ndarray, followers: bytes) -> np.ndarray:
    """Bigrams as one number each: their context's number (owner, with held bigrams each) and 40 bits of the word."""
    return np.repeat(owner, held).astype(np.uint64) << np.uint64(40) | _unforty(followers)


def _summing(table: pa.Table) -> pa.Table:
    """Adds up a shard's bigrams over all batches: the shard's contexts and what follows them, and how often its words follow different ones here."""
    shard, cols = table.column("shard")[0].as_py(), {n: table.column(n).to_pylist() for n in ("ctx", "held", "followers", "counts")}
    ctx, held = [np.frombuffer(x, np.uint64) for x in cols["ctx"]], [_unpacked(x) for x in cols["held"]]
    contexts, c_at = np.unique(np.concatenate(ctx), return_inverse=True)
    if len(contexts) >= 1 << 24:
        raise ValueError("too many contexts in a shard: make batches smaller")
    owners = np.split(c_at, np.cumsum([len(x) for x in ctx])[:-1])
    found, p_at = np.unique(np.concatenate([_keys(*x) for x in zip(owners, held, cols["followers"], strict=True)]), return_inverse=True)
    c = np.bincount(p_at, np.concatenate([_unpacked(x) for x in cols["counts"]]), len(found)).astype(np.int64)
    word = found & np.uint64((1 << 40) - 1)
    of = np.bincount((found >> np.uint64(40)).astype(np.int64), minlength=len(contexts))
    words, k = np.unique(word, return_counts=True)
    many = [*(int((c == i).sum()) for i in range(1, 5)), len(c)]
    return _table([(shard, contexts.tobytes(), _packed(of), _forty(word << np.uint64(12)).tobytes(), _packed(c), *many), (shard, words.tobytes(), None, None, _packed(k), *[0] * 5)], _MODEL_ARROW)


def _words(batches):
    """(word, k) of the rows of continuation counts."""
    for b in batches:
        for words, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            yield pa.record_batch([pa.array(np.frombuffer(words, np.int64)), pa.array(_unpacked(counts))], ["word", "k"])


def _listed(table: pa.Table) -> pa.Table:
    """The continuation counts of a shard's words as one row."""
    word, k = table.column("word").to_numpy(), table.column("k").to_numpy()
    order = np.argsort(word)
    return _table([(table.column("shard")[0].as_py(), word[order].tobytes(), None, None, _packed(k[order]), *[0] * 5)], _MODEL_ARROW)


def _sought(sorted_keys: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The values of keys, 0 for those not there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, values[at], 0)


def _answering(asks: pa.Table, model: pa.Table) -> pa.Table:
    """Answers each batch's asking of a shard, in its order: how its contexts are followed (bigrams in all, and of count 1, 2 and more), its bigrams' counts, and its words' continuation counts."""
    contexts = found = words = _NONE
    c = k = np.zeros(0, np.int64)
    for r in model.to_pylist():
        if r["held"] is None:
            words, k = np.frombuffer(r["ctx"], np.uint64), _unpacked(r["counts"])
        else:
            contexts, c = np.frombuffer(r["ctx"], np.uint64), _unpacked(r["counts"])
            found = _keys(np.arange(len(contexts)), _unpacked(r["held"]), r["followers"])
    of = (found >> np.uint64(40)).astype(np.int64)
    # the last one is that of contexts which are not there
    followed = np.stack([np.bincount(of, v, len(contexts) + 1).astype(np.int64) for v in (c, c == 1, c == 2, c > 2)])
    number = np.arange(1, len(contexts) + 1)
    rows = []
    for batch, shard, ctx, held, followers in zip(*(asks.column(n).to_pylist() for n in ("batch", "shard", "ctx", "held", "followers")), strict=True):
        x = np.frombuffer(ctx, np.uint64)
        owner = _sought(contexts, number, x) - 1
        owner[owner < 0] = len(contexts)
        rows.append((batch, shard, _packed(followed[:, owner].ravel()), _packed(_sought(found, c, _keys(owner, _unpacked(held), followers))), _packed(_sought(words, k, _middle(x)))))
    return _table(rows, _ANSWER_ARROW)


def _by_count(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c == 1, d[0], np.where(c == 2, d[1], d[2]))


def _flagged(table: pa.Table, ids: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are learned and which set thresholds: of each trusted id one row that has a text, the least."""
    good, first = set(ids.column("doc_id").to_pylist()), {}
    texts = table.column("text").to_pylist()
    for i, (k, x) in enumerate(zip(table.column("doc_id").to_pylist(), texts, strict=True)):
        if x is not None and k in good and (k not in first or x < texts[first[k]]):
            first[k] = i
    mine = np.zeros(table.num_rows, bool)
    mine[list(first.values())] = True
    held = np.array(table.column(HELD_OUT).to_pylist(), bool)
    return mine & ~held, mine & held


def _asks(batch: int, local: Local, shards: int, hot: np.ndarray, counted: bool) -> pa.Table:
    rows = []
    for shard, ctx, _, grams in local.asked(shards, hot):
        held = np.bincount(np.searchsorted(ctx, local.grams[grams] // local.n), minlength=len(ctx))
        rows.append((batch, shard, local.hash[ctx].tobytes(), _packed(held), _forty(local.hash[local.grams[grams] % local.n]).tobytes(), _packed(local.gram_count[grams]) if counted else None))
    return _table(rows, _ASK_ARROW)


def _learning(shards: int, shared):
    """What a batch's learned texts hold."""

    def ask(table: pa.Table, ids: pa.Table) -> pa.Table:
        learns = _flagged(table, ids)[0] if table.num_rows else np.zeros(0, bool)
        if not learns.any():
            return _ASK_ARROW.empty_table()
        texts = table.column("text").filter(pa.array(learns)).to_pylist()
        return _asks(table.column(BATCH)[0].as_py(), Local(texts, np.ones(len(texts), bool), _NONE, False), shards, shared.value, True)

    return ask


def _asking(shards: int, shared):
    def ask(table: pa.Table) -> pa.Table:
        local = Local(table.column("text").to_pylist(), np.zeros(table.num_rows, bool), _NONE, False)
        return _asks(table.column(BATCH)[0].as_py(), local, shards, shared.value, False)

    return ask


def _measures(local: Local, shards: int, hot: np.ndarray, answers: dict, numbers: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Mean surprise and mean square, in log10, of the tokens of each text of a batch."""
    d, low_d, bigrams, continued, spared = numbers
    followed, c, k = np.zeros((local.n, 4)), np.zeros(len(local.grams), np.int64), np.zeros(local.n, np.int64)
    for shard, ctx, home, grams in local.asked(shards, hot):
        r = answers[shard]
        followed[ctx] += _unpacked(r["followed"]).reshape(4, -1).T
        c[grams] = _unpacked(r["counts"])
        k[ctx[home]] = _unpacked(r["continued"])[home]
    low = np.where(k > 0, (k - _by_count(k, low_d)) / bigrams, 0) + spared / bigrams / (continued + 1)
    total = np.maximum(followed[:, 0], 1)
    back = np.where(followed[:, 0] > 0, followed[:, 1:] @ np.array(d) / total, 1)
    u, w = local.grams // local.n, local.grams % local.n
    surprise = -np.log10(np.where(c > 0, c - _by_count(c, d), 0) / total[u] + back[u] * low[w])
    x = surprise[local.gram_at]
    n = len(local.lengths)
    return tuple(np.bincount(local.doc, v, n) / (local.lengths - 1) for v in (x, x * x))


def measured(docs: DataFrame, good: DataFrame, held: Column, discounts: Callable, to: tuple[str, str, str, str], batch_bytes: int = BATCH_BYTES, block_tokens: int = BLOCK) -> list[Callable[[bool], DataFrame]]:
    """docs and, in columns named to, each whole text's tokens, mean surprise and mean square in log10 under the model of the trusted ids (good: doc_id, different) where held is false,
    and whether the row is one of those ids where held is true.

    The rows come in parts, each row in one, as functions that make a part, with texts or without the column text; a part should be written before the next is made. With a meanwhile() around
    each, what it shuffled and wrote is gone by then.
    All trusted texts are learned, whole; of rows of one id that with the least text. A null text is no trusted one and is measured as empty. Without trusted texts all surprises are 0;
    an empty table gives no rows; other columns pass through. discounts gives three discounts from the numbers of n-grams that occur once to four times.
    """
    spark = docs.sparkSession
    small_batches(spark)
    found = docs.select("text", F.lit(True)).mapInArrow(lambda batches: _frequent(batches, HOT, block_tokens, False), _FREQUENT)
    frequent = written(found.groupBy("hash").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "frequent")
    whole = frequent.where("hash is null").first()
    tokens, size = (whole["n"], whole["size"]) if whole else (0, 0)
    shards, parts = max(1, -(-size // (batch_bytes * SHARE))), max(1, -(-size // batch_bytes))
    passes = min(PASSES, parts)
    # at most 2 * HOT words and pairs pass
    hot = frequent.where(F.col("hash").isNotNull() & (F.col("n") * 2 * HOT >= tokens)).select("hash").toArrow().column("hash").to_numpy().astype(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(hot)
    kind = docs.schema["doc_id"].dataType
    lot = F.when(F.col("doc_id").isNull(), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).otherwise(F.xxhash64("doc_id"))
    dealt = docs.withColumns({BATCH: F.pmod(lot, F.lit(parts)), HELD_OUT: F.coalesce(held, F.lit(False))})
    of_pass = lambda rows, i: rows.where(F.col(BATCH) % passes == i)
    ids = good.select(F.col("doc_id").cast(kind).alias("doc_id")).where("doc_id is not null").distinct()
    ids = written(ids.withColumn(BATCH, F.pmod(F.xxhash64("doc_id"), F.lit(parts))), "trusted")
    slim = dealt.select("doc_id", "text", BATCH, HELD_OUT)
    with meanwhile(spark):
        learn = lambda i: of_pass(slim, i).groupBy(BATCH).cogroup(of_pass(ids, i).groupBy(BATCH)).applyInArrow(thrifty(_learning(shards, shared)), _ASK)
        learned = reduce(DataFrame.unionByName, [written(learn(i), "learned") for i in range(passes)])
        sums = written(learned.groupBy("shard").applyInArrow(thrifty(_summing), _MODEL), "model", stays=True)
    model = sums.where("held is not null")
    n = model.agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(1, 6)]).first()
    continued = written(sums.where("held is null").select("ctx", "counts").mapInArrow(_words, _WORDS).groupBy("word").agg(F.sum("k").alias("k")), "continued")
    times = lambda on: F.coalesce(F.sum(on.cast("long")), F.lit(0))
    m = continued.agg(*[times(F.col("k") == i) for i in (1, 2, 3, 4)], F.count("*"), times(F.col("k") > 2)).first()
    d, low_d = discounts(list(n[:4])), discounts(list(m[:4]))
    numbers = (d, low_d, n[4], m[4], m[0] * low_d[0] + m[1] * low_d[1] + m[5] * low_d[2])
    # a word's continuation count is with the shard that has it as a context
    by_word = written(continued.withColumn("shard", F.pmod("word", F.lit(shards))).groupBy("shard").applyInArrow(thrifty(_listed), _MODEL), "by_word")
    told = model.unionByName(by_word).select("shard", "ctx", "held", "followers", "counts")
    # trusted ids go with the answers, as one row for a batch
    listed = ids.groupBy(F.col(BATCH).alias("batch")).agg(F.collect_list("doc_id").alias("ids"))

    def part(i: int, texts: bool) -> DataFrame:
        both = listed.where(F.col("batch") % passes == i)
        if n[4]:
            asked = of_pass(dealt, i).select("text", BATCH).groupBy(BATCH).applyInArrow(thrifty(_asking(shards, shared)), _ASK)
            # written, so that what was asked is gone before texts are shuffled again
            answers = written(asked.select("batch", "shard", "ctx", "held", "followers").groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(thrifty(_answering), _ANSWER), "answers")
            both = answers.withColumn("ids", F.lit(None).cast(T.ArrayType(kind))).unionByName(both, allowMissingColumns=True)
        stay = [k for k, f in enumerate(docs.schema) if texts or f.name.lower() != "text"]
        schema = T.StructType([*(docs.schema[k] for k in stay), *(T.StructField(x, k) for x, k in zip(to, (T.LongType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True))])
        learned = bool(n[4])

        def measure(table: pa.Table, sums: pa.Table) -> pa.Table:
            size = table.num_rows
            tokens, mean, square, sets = np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size, bool)
            if size:
                rows = sums.to_pylist()
                ids = [k for r in rows for k in r["ids"] or ()]
                _, sets = _flagged(table, pa.table({"doc_id": pa.array(ids, table.schema.field("doc_id").type)}))
                local = Local(table.column("text").to_pylist(), np.zeros(size, bool), _NONE, False)
                tokens = local.lengths - 1
                if learned:
                    mean, square = _measures(local, shards, shared.value, {r["shard"]: r for r in rows if r.get("shard") is not None}, numbers)
            return pa.table([*(table.columns[k] for k in stay), *(pa.array(x) for x in (tokens, mean, square, sets))], names=schema.names)

        return of_pass(dealt, i).groupBy(BATCH).cogroup(both.groupBy("batch")).applyInArrow(thrifty(measure), schema)

    return [lambda texts=True, i=i: part(i, texts) for i in range(passes)]
