"""Fill-in-middle examples by ropes of lines.

A text is a rope: a balanced tree whose leaves hold pieces of it and whose nodes cache how many lines end below them and how many code points they
hold. The tree is split at two line ranks, the three parts and the sentinels are concatenated in a new order, and no text is copied until the result is
read off its leaves. The inverse makes a rope of the output, splits it at the sentinels by code points and concatenates the parts in their first order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import documents, free, small_batches

#: Code points of a leaf.
LEAF = 1024
#: Per cent of texts that are rearranged, and of these per cent that begin with the suffix.
RATE, SPM = 100, 50
SEED = 7
#: Sentinels before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(slots=True)
class Rope:
    """A leaf has text and no sides; lines counts the line ends, chars the code points, depth the levels below."""

    lines: int
    chars: int
    depth: int
    text: str | None = None
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.text is None:
                stack += (node.right, node.left)
            else:
                yield node.text

    def __str__(self) -> str:
        return "".join(self.leaves())

    def last(self) -> str:
        node = self
        while node.text is None:
            node = node.right
        return node.text

    def units(self) -> int:
        """Lines, the last one counted also where nothing ends it."""
        return self.lines + (self.chars > 0 and not self.last().endswith("\n"))


def leaf(text: str) -> Rope:
    return Rope(text.count("\n"), len(text), 0, text)


EMPTY = leaf("")


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.lines + b.lines, a.chars + b.chars, max(a.depth, b.depth) + 1, None, a, b)


def _level(a: Rope, b: Rope) -> Rope:
    """A node over a and b, whose depths differ by two at most, turned so that those of its sides differ by one."""
    if a.depth > b.depth + 1:
        inner = a.right
        if a.left.depth >= inner.depth:
            return _node(a.left, _node(inner, b))
        return _node(_node(a.left, inner.left), _node(inner.right, b))
    if b.depth > a.depth + 1:
        inner = b.left
        if b.right.depth >= inner.depth:
            return _node(_node(a, inner), b.right)
        return _node(_node(a, inner.left), _node(inner.right, b.right))
    return _node(a, b)


def concat(a: Rope, b: Rope) -> Rope:
    """One rope of both, in steps as many as their depths differ by."""
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.depth > b.depth + 1:
        return _level(a.left, concat(a.right, b))
    if b.depth > a.depth + 1:
        return _level(concat(a, b.left), b.right)
    return _node(a, b)


def rope(text: str, size: int = LEAF) -> Rope:
    """A balanced rope of text."""
    level = [leaf(text[i : i + size]) for i in range(0, len(text), size)] or [EMPTY]
    while len(level) > 1:
        level = [_node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _line_end(text: str, rank: int) -> int:
    at = 0
    for _ in range(rank):
        at = text.index("\n", at) + 1
    return at


def split(node: Rope, rank: int, by: str = "lines") -> tuple[Rope, Rope]:
    """The rope before and after the first rank lines, or with by="chars" code points; all of it is before where it has fewer or just so many.

    So a last line without an end counts as one: nothing is left behind it.
    """
    if rank <= 0:
        return EMPTY, node
    if rank > getattr(node, by):
        return node, EMPTY
    if node.text is not None:
        at = rank if by == "chars" else _line_end(node.text, rank)
        return leaf(node.text[:at]), leaf(node.text[at:])
    held = getattr(node.left, by)
    if rank <= held:
        a, b = split(node.left, rank, by)
        return a, concat(b, node.right)
    a, b = split(node.right, rank - held, by)
    return concat(node.left, a), b


def rearranged(text: str, first: int, second: int, spm: bool, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> tuple[Rope, int, int]:
    """(output, code points of the prefix, of the middle): text cut after its first lines and second lines, first being the smaller."""
    head, suffix = split(rope(text), second)
    prefix, middle = split(head, first)
    p, s, m = map(leaf, marks)
    order = (s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle)
    return reduce(concat, order), prefix.chars, middle.chars


def restored(output: str, form: str, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> str:
    """The text that output was made of. A rearranged text holds no sentinel of its own, so the first of each is the one put in."""
    if form == "plain":
        return output
    p, s, m = marks
    left, parts, at = rope(output), [], 0
    # each part lies between its sentinel and the next
    for mark in (p, m) if form == "spm" else (s, m):
        found = output.index(mark, at)
        part, left = split(left, found - at, "chars")
        parts.append(part)
        at = found
    first, second, middle = (split(x, len(k), "chars")[1] for x, k in zip((*parts, left), (s, p, m) if form == "spm" else (p, s, m), strict=True))
    prefix, suffix = (second, first) if form == "spm" else (first, second)
    return str(concat(concat(prefix, middle), suffix))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned numbers of 32 bits from the seed and the id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


_MADE = T.StructType([T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])


def infilled(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), to: str = "fim") -> DataFrame:
    """docs and a struct (n, form, prefix_chars, middle_chars, output) for the whole column text, in a column named to, which replaces one of that name.

    n counts lines. The form is plain, and output the text itself, where text is null (as if empty), empty or holds a sentinel, or the draw of its doc_id
    says so; then the two lengths are null. Otherwise it is psm or spm. The cuts are drawn from doc_id and the number of lines alone, so repeated rows, and equal texts of
    one id, get the same output and ties cannot arise; a null doc_id draws as the empty text. Very long texts are cut whole. Other columns pass through, whatever
    their names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(_MADE)
    def made(text: pd.Series, h1: pd.Series, h2: pd.Series, h3: pd.Series, h4: pd.Series) -> pd.DataFrame:
        rows = []
        for x, a, b, c, d in zip(text, h1, h2, h3, h4, strict=True):
            x = x or ""
            n = x.count("\n") + (x != "" and x[-1] != "\n")
            if not x or any(k in x for k in marks) or c % 100 >= rate:
                rows.append((n, "plain", None, None, x))
                continue
            first, second = sorted((a % (n + 1), b % (n + 1)))
            form = "spm" if d % 100 < spm else "psm"
            out, p, m = rearranged(x, first, second, form == "spm", marks)
            rows.append((n, form, p, m, str(out)))
        return pd.DataFrame(rows, columns=_MADE.names).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.withColumn(to, made(F.col("text"), *draws(F.col("doc_id"), seed)))


def restore(made: DataFrame, output: str = "output", form: str = "form", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), to: str = "restored") -> DataFrame:
    """made and the text that each output (a column or field, with its form) was made of, in a column named to; a null output gives the empty text."""
    small_batches(made.sparkSession)

    @F.pandas_udf(T.StringType())
    def back(out: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([restored(x or "", k or "plain", marks) for x, k in zip(out, kind, strict=True)], dtype=object)

    return made.withColumn(to, back(F.col(output), F.col(form)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    fim, text = free(docs, "fim", "restored")
    out = restore(infilled(docs, to=fim), f"{fim}.output", f"{fim}.form", to=text)
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", f"{fim}.n", f"{fim}.form", f"{fim}.prefix_chars", f"{fim}.middle_chars", digest(f"{fim}.output").alias("output_sha256"), digest(text).alias("restored_sha256"))


ORACLE = {
    "op11_fill_in_middle": f"""
with units as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as u,
         sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as h
  from documents),
drawn as (
  select doc_id, text, u, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4
  from units),
formed as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= {RATE} then 'plain'
              when h4 % 100 < {SPM} then 'spm' else 'psm' end as form
  from drawn),
cut as (
  select *, array_to_string(u[:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from formed)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
         else '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m end) as output_sha256, sha256(text) as restored_sha256
from cut
""",
}
