"""HTML pages shredded into nodes, text atoms, links and table cells, by the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.sources.scratch import small_batches

# Elements without an end tag, and those whose text is not shown.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style template noscript".split())
#: A start tag that ends an open element of one of these names.
CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "h1": ("p",), "h2": ("p",), "ul": ("p",), "table": ("p",), "div": ("p",)}
MAX_NODES = 200_000


class _Shredder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.stack: list[int] = []
        self.kids: list[dict] = [{}]
        self.cut = False

    def handle_starttag(self, tag, attrs):
        if len(self.nodes) >= MAX_NODES:
            self.cut = True
            return
        while self.stack and self.nodes[self.stack[-1]][2] in CLOSES.get(tag, ()):
            self._pop()
        parent = self.stack[-1] if self.stack else -1
        count = self.kids[-1]
        count[tag] = count.get(tag, 0) + 1
        path = (self.nodes[parent][3] + " > " if parent >= 0 else "") + f"{tag}:nth-of-type({count[tag]})"
        node = len(self.nodes)
        self.nodes.append([node, parent, tag, path, dict(attrs), []])
        if tag not in VOID:
            self.stack.append(node)
            self.kids.append({})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and not self.cut:
            self._pop()

    def _pop(self):
        self.stack.pop()
        self.kids.pop()

    def handle_endtag(self, tag):
        if not self.cut and any(self.nodes[n][2] == tag for n in self.stack):
            while self.nodes[self.stack[-1]][2] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if self.stack and data.strip() and not self.cut:
            self.nodes[self.stack[-1]][5].append(" ".join(data.split()))


def shred(html: str | None) -> list[dict]:
    """Nodes in document order, MAX_NODES at most, of which the last has the tag #cut where a page has more: node, parent (-1: none), tag, path, href, text of the node itself, hidden, section (the node of the last heading before it)."""
    parser = _Shredder()
    parser.feed(html or "")
    parser.close()
    hidden: set[int] = set()
    section, out = None, []
    for node, parent, tag, path, attrs, text in parser.nodes:
        if tag in HIDDEN or parent in hidden:
            hidden.add(node)
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            section = node
        out.append({"node": node, "parent": parent, "tag": tag, "path": path, "href": attrs.get("href"), "rowspan": attrs.get("rowspan"), "colspan": attrs.get("colspan"), "html_id": attrs.get("id"), "html_class": attrs.get("class"), "data_id": attrs.get("data-id"), "text": " ".join(text), "hidden": node in hidden, "section": section})
    if parser.cut:
        out.append(dict.fromkeys(out[-1]) | {"node": len(out), "parent": -1, "tag": "#cut", "path": "#cut", "text": "", "hidden": True})
    return out


NODE = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("node", "parent")]
    + [T.StructField(n, T.StringType()) for n in ("tag", "path", "href", "rowspan", "colspan", "html_id", "html_class", "data_id", "text")]
    + [T.StructField("hidden", T.BooleanType()), T.StructField("section", T.IntegerType())]
)


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per element of each page."""

    @F.pandas_udf(T.ArrayType(NODE))
    def shredded(column: pd.Series) -> pd.Series:
        return pd.Series([shred(x) for x in column], dtype=object)

    small_batches(pages.sparkSession)
    return pages.select(key, F.explode(shredded(F.col(html))).alias("n")).select(key, "n.*")


def span(value: str | None, most: int = 1000) -> int | None:
    """A cell's span: 1 where none is given, null, which grid() reports, where it is not a number or more than most."""
    if value is None:
        return 1
    return int(value) if value.strip().isdigit() and int(value) <= most else None


def grid(cells: list[tuple[int, int, int | None, int | None]], rows: int) -> tuple[list[tuple], list[str]]:
    """Columns of a table's cells (row, cell, rowspan, colspan), in order, beside those that reach down from above; a rowspan of 0 reaches the end.
    Also the issues: spans that are not numbers, and cells that overlap."""
    taken: set[tuple[int, int]] = set()
    out, issues = [], []
    for row, cell, down, across in cells:
        if down is None or across is None or across == 0:
            issues.append(f"span:{cell}")
        down, across = 1 if down is None else down or rows - row, across or 1
        column = 0
        while (row, column) in taken:
            column += 1
        slots = {(r, c) for r in range(row, min(row + down, rows)) for c in range(column, column + across)}
        if slots & taken:
            issues.append(f"overlap:{cell}")
        taken |= slots
        out.append((cell, row, column, down, across))
    return out, issues


def references(found: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, kind, name, value) of nodes(): anchors with a data id, typed by its prefix; list items with their depth; footnotes; and pairs of th and td in one row."""
    refs = found.where("tag = 'a' and data_id is not null").select(key, F.lit("reference").alias("kind"), F.regexp_extract("data_id", "^([a-z]+)-", 1).alias("name"), F.col("data_id").alias("value"))
    depth = F.regexp_count("path", F.lit(r"(^| > )(ol|ul):"))
    items = found.where("tag = 'li' and not hidden").select(key, F.lit("item"), depth.cast("string"), "text")
    notes = found.where(F.array_contains(F.split("html_class", " "), "footnote")).select(key, F.lit("footnote"), "html_id", "text")
    td = found.where("tag = 'td'").groupBy(key, "parent").agg(F.min_by("text", "node").alias("text"))
    meta = found.where("tag = 'th'").groupBy(key, "parent").agg(F.min_by("text", "node").alias("name")).join(td, [key, "parent"]).select(key, F.lit("meta"), "name", "text")
    return refs.union(items).union(notes).union(meta)


def chapters(found: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, chapters, paragraphs, unrepresented) of pages in the chapter template, from nodes(): headings of chapters, numbered paragraphs, and visible texts of the
    body that belong to neither, nor to a list, table or footnote."""
    classes = F.coalesce(F.split("html_class", " "), F.array())
    chapter, paragraph = (F.col("tag") == "h2"), (F.col("tag") == "p") & F.array_contains(classes, "paragraph")
    stands = chapter | paragraph | F.col("tag").isin("li", "th", "td") | F.array_contains(classes, "footnote")
    loose = (F.col("text") != "") & ~F.col("hidden") & F.col("path").contains("body:")
    # sorted by path, what lies below a node comes right after it, so one way through a page's nodes is enough
    ways = F.array_sort(F.collect_list(F.when(stands | loose, F.struct(F.concat("path", F.lit(" > ")).alias("way"), stands.alias("stands")))))
    none = F.struct(F.lit(None).cast("string").alias("top"), F.lit(0).cast("long").alias("n"))

    def step(state, x):
        below = F.coalesce(F.startswith(x["way"], state["top"]), F.lit(False))
        return F.when(below, state).when(x["stands"], F.struct(x["way"].alias("top"), state["n"].alias("n"))).otherwise(F.struct(state["top"].alias("top"), (state["n"] + 1).alias("n")))

    pages = found.groupBy(key).agg(F.count_if(chapter).alias("chapters"), F.count_if(paragraph).alias("paragraphs"), ways.alias("ways"))
    return pages.select(key, "chapters", "paragraphs", F.aggregate("ways", none, step, lambda state: state["n"]).alias("unrepresented"))


#: Profiles of pages and the element, by tag and class, that tells each.
PROFILES = {"chapters": ("div", "chapter"), "article": ("article", None), "register": ("table", "meta")}


def profile(found: DataFrame, profiles: dict[str, tuple[str, str | None]] = PROFILES, key: str = "page_id") -> DataFrame:
    """(key, profile, issue): the one profile whose element a page holds; none, or more than one, is an issue."""
    classes = F.coalesce(F.split("html_class", " "), F.array())
    holds = {n: (F.col("tag") == tag) & (F.lit(True) if c is None else F.array_contains(classes, c)) for n, (tag, c) in profiles.items()}
    names = F.array_compact(F.array(*[F.when(F.max(h), F.lit(n)) for n, h in holds.items()]))
    got = found.groupBy(key).agg(names.alias("names"))
    one = F.size("names") == 1
    return got.select(key, F.when(one, F.get("names", F.lit(0))).alias("profile"), F.when(~one, F.when(F.size("names") == 0, "none").otherwise("several")).alias("issue"))
