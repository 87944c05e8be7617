"""Spelling variants: the words of a corpus grouped by a trie self-join with active-node sets.

Two words at distance one agree but for one place of the longer of them. In the trie of all words of that length, and those shorter by one, a
part is a subtree below a common prefix, cut off before a common suffix: it answers for the pairs whose place lies in the window between the two.
The first parts are halves of each length, so a word is in four of them, and whichever holds more words than fit a task is halved again,
until its window is one place wide and no more words than letters fit in. So every pair has one part that answers for it, and no part is large.

In a part the windows' texts make a trie. A node's active set is the nodes within one edit of it; a child's set comes from its parent's, and where a
word ends the words that end at its active nodes are its near words.
"""

from __future__ import annotations

import binascii
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import checkpointed, documents, joined_by_size, small_batches, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A run loses a letter where this divides its hash.
EDITED = 199
#: Words have so many code points and occurrences at least; a form occurs so many times as often as its word.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
#: Different words that a task counts before it hands them on.
HELD = 200_000
#: Words of a part of the trie.
PART = 2_000

_COUNTED = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


def runs(doc_id: int | None, text: str | None) -> Counter:
    """The edited runs of a text and how often each occurs; a run that loses its only letter is gone."""
    out = Counter()
    crc = binascii.crc32
    head = crc(f"{'' if doc_id is None else doc_id}:".encode())
    # bytes are lower-cased from A to Z alone
    lower = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    for run, n in Counter(RUN.findall(lower)).items():
        h = crc(run.encode(), head)
        if h % EDITED == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        out[run] += n
    return out


def _counting(least: int):
    def count(batches):
        held = Counter()
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                held.update(runs(doc_id, text))
                if len(held) >= HELD:
                    yield _frame(held, least)
                    held = Counter()
        yield _frame(held, least)

    return count


def _frame(held: Counter, least: int) -> pd.DataFrame:
    kept = [(w, n) for w, n in held.items() if len(w) >= least]
    return pd.DataFrame({"word": pd.Series([w for w, _ in kept], dtype=object), "n": pd.Series([n for _, n in kept], dtype="int64")})


def vocabulary(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """(word, n) of the edited runs of docs (doc_id, text) of at least so many letters and occurrences; counts are added up in each task before they are shuffled."""
    small_batches(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.mapInPandas(_counting(letters), _COUNTED).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class _Node:
    """A trie node: children by letter, and the number of the word that ends here."""

    __slots__ = ("children", "word")

    def __init__(self):
        self.children: dict[str, _Node] = {}
        self.word = -1


def near_in(texts: list[str], width: int, seam: str = "") -> list[list[int]]:
    """For each of the different texts, the others at distance one, but for pairs of the shorter length among themselves.

    The texts are width letters long or one less. All stand before the same letter, seam; a pair whose longer text only adds that letter at its end
    differs later, behind the seam, and belongs to the part that has that place.
    """
    root = _Node()
    for k, t in enumerate(texts):
        node = root
        for c in t:
            down = node.children.get(c)
            if down is None:
                down = node.children[c] = _Node()
            node = down
        node.word = k
    out: list[list[int]] = [[] for _ in texts]
    # (node, its active set without itself)
    stack = [(root, list(root.children.values()))]
    while stack:
        node, active = stack.pop()
        mine = node.word
        if mine >= 0:
            a = texts[mine]
            for m in active:
                if m.word < 0:
                    continue
                b = texts[m.word]
                if len(a) == len(b):
                    if len(a) < width:
                        continue
                elif seam:
                    long, short = (a, b) if len(a) > len(b) else (b, a)
                    if long[-1] == seam and long.startswith(short):
                        continue
                out[mine].append(m.word)
        brothers = node.children
        for c, child in brothers.items():
            # one letter other, one letter more, one letter less, and what was one edit off and goes on with the same letter
            found = {id(x): x for x in brothers.values() if x is not child}
            for x in child.children.values():
                found[id(x)] = x
            found[id(node)] = node
            for m in active:
                x = m.children.get(c)
                if x is not None and x is not child:
                    found[id(x)] = x
            stack.append((child, list(found.values())))
    return out


_NEAR = T.StructType([T.StructField("word", T.StringType()), T.StructField("n_near", T.LongType()), T.StructField("form", T.StringType()), T.StructField("form_n", T.LongType())])


def _joining(batches):
    """Near words of each word in its part, counted, with the most frequent; rows come part by part."""
    key, part = None, []

    def joined(part: list[tuple]) -> list[tuple]:
        width, seam, rows = *part[0][3:], []
        for (word, *_), near in zip(part, near_in([p[2] for p in part], width, seam), strict=True):
            if near:
                n, form = min((-part[k][1], part[k][0]) for k in near)
                rows.append((word, len(near), form, -n))
        return rows

    for pdf in batches:
        rows = []
        for k, *row in pdf[["key", "word", "n", "middle", "width", "seam"]].itertuples(index=False):
            if k != key and part:
                rows += joined(part)
                part = []
            key = k
            part.append(row)
        yield pd.DataFrame(rows, columns=_NEAR.names)
    if part:
        yield pd.DataFrame(joined(part), columns=_NEAR.names)


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (word, n, size, low, high) with the key of their part: the prefix before its window, the suffix after it, and what they are cut from."""
    rest = F.col("size") - F.col("high")
    long = F.char_length("word")
    prefix, suffix = F.col("word").substr(F.lit(1), F.col("low")), F.col("word").substr(long - rest + 1, rest)
    rows = rows.withColumn("width", F.col("high") - F.col("low")).withColumn("middle", F.col("word").substr(F.col("low") + 1, long - rest - F.col("low"))).withColumn("seam", F.substring(suffix, 1, 1))
    # the lengths stand first, so that the two texts can be told apart
    return rows.withColumn("key", F.concat_ws(" ", "size", "low", "high", prefix, suffix))


def _halves(rows: DataFrame) -> DataFrame:
    mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    two = F.array(F.struct(F.col("low").alias("low"), mid.alias("high")), F.struct(mid.alias("low"), F.col("high").alias("high")))
    return rows.withColumn("w", F.explode(two)).select("word", "n", "size", "w.low", "w.high")


def parts(words: DataFrame, most: int = PART) -> DataFrame:
    """words (word, n) in parts of the trie: (key, word, n, middle, width, seam), four rows a word and more only where a part held more than most words; parts of one word are left out.

    Each round halves the windows of parts that are too large, so there are as many as the logarithm of the longest word's length.
    """
    both = F.explode(F.array(F.char_length("word"), F.char_length("word") + 1))
    rows = _halves(words.select("word", "n", both.alias("size")).withColumns({"low": F.lit(0), "high": F.col("size")}))
    done = None
    while True:
        keyed = written(_keyed(rows), "parts")
        held = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "held")
        total = keyed.count()
        each = written(joined_by_size(keyed, held.withColumn("words", F.col("n")), ["key"], total), "counted")
        full = (F.col("words") > most) & (F.col("high") - F.col("low") > 1)
        good = each.where(~full).select("key", "word", "n", "middle", "width", "seam")
        done = good if done is None else done.unionByName(good)
        if each.where(full).isEmpty():
            return done
        rows = _halves(each.where(full).select("word", "n", "size", "low", "high"))


def near_words(words: DataFrame, most: int = PART) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n) that have near words: how many, and the most frequent (ties: the smallest in code-point order) with its count."""
    dealt = parts(words, most).repartition("key").sortWithinPartitions("key", "word")
    found = dealt.mapInPandas(_joining, _NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", (-F.col("b.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): from each word along forms to the last. Forms are more frequent than their words, so there are no cycles; each round doubles the way."""
    ways = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        total = ways.count()
        held = checkpointed(ways.groupBy("root").agg(F.count("*").alias("n")))
        onward = checkpointed(held.join(ways.select(F.col("word").alias("root"), F.col("root").alias("next")), "root").select("root", "next", "n"))
        if onward.isEmpty():
            return ways
        went = joined_by_size(ways, onward, ["root"], total)
        ways = checkpointed(ways.join(went.select("word"), "word", "left_anti").unionByName(went.select("word", F.col("next").alias("root"))))


def grouped(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, times: int = TIMES, most: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text): form is the near word of largest count if that is times the word's own, root the last form from it.

    A null or empty text has no words, a null doc_id hashes as the empty text; very long texts and words are read whole, repeated rows count as often, ties of forms go to the
    smallest in code-point order. Only doc_id and text are read, whatever else docs has; no rows, no rows.
    """
    words = written(vocabulary(docs, letters, occurrences), "words")
    near = words.join(near_words(words, most).withColumnRenamed("form", "best").withColumnRenamed("form_n", "best_n"), "word", "left")
    enough = F.col("best_n") >= times * F.col("n")
    out = near.select("word", F.when(enough, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best_n")).alias("form_n"))
    out = written(out, "near")
    last = roots(out.where("form is not null"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(documents(spark, sf_dir))
