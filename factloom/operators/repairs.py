"""Sequential repairs of blocks in reading order; each is a fold over one document's blocks, which are few."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = ("seq", "id", "kind", "page_index", "x0", "y0", "x1", "y1", "level", "text")
OUT = T.StructType(
    [T.StructField("document_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]
    + [T.StructField("level", T.IntegerType()), T.StructField("parent", T.LongType()), T.StructField("sibling", T.IntegerType())]
)


def repaired(blocks: DataFrame, repairs: list[Callable[[list[dict]], list[dict]]]) -> DataFrame:
    """Blocks after the repairs in turn: (document_id, id, place, kind, text, level, parent, sibling)."""
    docs = blocks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*ITEM))).alias("items"))

    def run(batches):
        for pdf in batches:
            rows = []
            for document, items in zip(pdf["document_id"], pdf["items"], strict=True):
                held = [x.asDict() if hasattr(x, "asDict") else dict(x) for x in items]
                for repair in repairs:
                    held = repair(held)
                rows += [(document, b["id"], i, b["kind"], b["text"], b["level"], b.get("parent"), b.get("sibling")) for i, b in enumerate(held)]
            out = pd.DataFrame(rows, columns=OUT.fieldNames())
            yield out.astype({"level": "Int32", "parent": "Int64", "sibling": "Int32"})

    return docs.mapInPandas(run, OUT)


def x_overlap(a: dict, b: dict) -> float:
    """Shared width as a part of the narrower box."""
    return max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])) / max(1e-9, min(a["x1"] - a["x0"], b["x1"] - b["x0"]))


def local_inversions(blocks: list[dict], share: float = 0.35, lines: float = 3.0) -> list[dict]:
    """A block moves before those on its page that stand below it in its column within a few lines."""
    out: list[dict] = []
    for b in blocks:
        at = len(out)
        while at:
            a = out[at - 1]
            high = max(a["y1"] - a["y0"], b["y1"] - b["y0"])
            if a["page_index"] != b["page_index"] or b["y0"] >= a["y0"] or a["y0"] - b["y0"] > lines * high or x_overlap(a, b) < share:
                break
            at -= 1
        out.insert(at, b)
    return out


#: Share of the narrower of two blocks that both must span to stand in one column.
COLUMN = 0.35


def in_column(a: dict, b: dict) -> bool:
    narrow = min(a["x1"] - a["x0"], b["x1"] - b["x0"])
    return min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]) >= COLUMN * max(narrow, 1)


def anchored_inserts(blocks: list[dict]) -> list[dict]:
    """Recovered blocks (kind list) stand after the block of their column that is nearest above them on the page, or before the first one of the column; where the page has none in the column,
    before the first block that lies lower, or else after the page's last."""
    kept = [b for b in blocks if b["kind"] != "list"]
    for r in (b for b in blocks if b["kind"] == "list"):
        same = [(i, b) for i, b in enumerate(kept) if b["page_index"] == r["page_index"]]
        column = [(i, b) for i, b in same if in_column(b, r)]
        above = [(r["y0"] - b["y0"], -i, i) for i, b in column if b["y0"] <= r["y0"]]
        lower = [i for i, b in same if (b["y0"], b["x0"]) > (r["y0"], r["x0"])]
        if above:
            at = min(above)[2] + 1
        elif column:
            at = column[0][0]
        else:
            at = lower[0] if lower else same[-1][0] + 1 if same else len(kept)
        kept.insert(at, r)
    return kept


def table_score(a: dict, b: dict) -> float:
    """How well table b goes on table a over a page's edge."""
    near = max(0.0, 1 - abs(a["x0"] - b["x0"]) / 250)
    wide = min(a["x1"] - a["x0"], b["x1"] - b["x0"]) / max(a["x1"] - a["x0"], b["x1"] - b["x0"], 1e-9)
    return 0.4 * near + 0.3 * wide + 0.3 * (a["level"] == b["level"])


def cross_page_tables(blocks: list[dict], sure: float = 0.88) -> list[dict]:
    """A table that goes on a table of another page is joined to it; what is joined is compared again."""
    out: list[dict] = []
    last = None
    for b in blocks:
        if b["kind"] == "table" and last is not None and last["page_index"] != b["page_index"] and table_score(last, b) >= sure:
            last["text"] += "\n" + b["text"]
            last["page_index"] = b["page_index"]
            continue
        if b["kind"] == "table":
            last = b
        out.append(b)
    return out


def template_family(blocks: list[dict]) -> list[dict]:
    """Each block's kind with its family, which is told by a heading's level and carried on until the next heading; other levels are plain."""
    family = "plain"
    for b in blocks:
        if b["kind"] == "heading":
            family = {1: "numbered", 2: "table", 3: "list"}.get(b["level"], "plain")
        b["kind"] = f"{family}/{b['kind']}"
    return blocks


def rectangles(cells: list[tuple[int, int]], open_right: set, open_below: set) -> list[tuple[int, int, int, int, bool]]:
    """Cells (row, column) joined where the rule between them is missing: (row, column, rows, columns, whole), whole where they fill a rectangle."""
    root = {c: c for c in cells}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for r, c in cells:
        for other, missing in (((r, c + 1), open_right), ((r + 1, c), open_below)):
            if (r, c) in missing and other in root:
                a, b = sorted((find((r, c)), find(other)))
                root[b] = a
    groups: dict = {}
    for c in cells:
        groups.setdefault(find(c), []).append(c)
    out = []
    for g in groups.values():
        rows, cols = [r for r, _ in g], [c for _, c in g]
        h, w = max(rows) - min(rows) + 1, max(cols) - min(cols) + 1
        out.append((min(rows), min(cols), h, w, h * w == len(g)))
    return sorted(out)


def flattened(tree: dict, path: str = "0") -> list[tuple]:
    """(owner, relation, target, path, low, high) of a tree of groups {"id", "quantity", "items"} and leaves {"id"}."""
    out = []
    low, high = tree.get("quantity") or (len(tree["items"]),) * 2
    for i, x in enumerate(tree["items"]):
        at = f"{path}.{i}"
        out.append((tree["id"], "group" if "items" in x else "leaf", x["id"], at, low, high))
        if "items" in x:
            out += flattened(x, at)
    return out


# ---- the assembly of a document


def edge_duplicates(blocks: list[dict]) -> list[dict]:
    """A text that lies inside a table of its page and says nothing that the table does not goes."""
    tables = [b for b in blocks if b["kind"] == "table"]

    def doubled(b: dict) -> bool:
        return b["kind"] != "table" and any(
            t["page_index"] == b["page_index"] and t["x0"] <= b["x0"] and b["x1"] <= t["x1"] and min(t["y1"], b["y1"]) - max(t["y0"], b["y0"]) > 0 and b["text"] in t["text"] for t in tables
        )

    return [b for b in blocks if not doubled(b)]


def bottom_notes(blocks: list[dict], height: float = 720.0) -> list[dict]:
    """Numbered paragraphs and items low on a page become footnotes, by their place or as a rising run of two or more."""
    low: dict[int, list[tuple[int, dict]]] = {}
    for b in blocks:
        m = re.match(r"([1-9]\d*)\s+\S", b["text"].strip())
        if m and b["kind"] in ("paragraph", "list") and b["y0"] >= 0.69 * height:
            low.setdefault(b["page_index"], []).append((int(m.group(1)), b))
    for notes in low.values():
        notes.sort(key=lambda n: n[1]["y0"])
        rising = len(notes) >= 2 and all(x[0] < y[0] for x, y in zip(notes, notes[1:], strict=False))
        for _, b in notes:
            if rising or b["y0"] >= 0.84 * height:
                b["kind"] = "footnote"
    return blocks


def profile_tables(blocks: list[dict]) -> list[dict]:
    """A table at the head of a page with as many columns and the same edges as the one that ends the page before goes on it, whatever else its score."""
    out: list[dict] = []
    for b in blocks:
        last = out[-1] if out else None
        if last is not None and b["kind"] == last["kind"] == "table" and b["page_index"] == last["page_index"] + 1 and b["level"] == last["level"] and abs(b["x0"] - last["x0"]) <= 2 and abs(b["x1"] - last["x1"]) <= 2:
            last |= {"text": last["text"] + "\n" + b["text"], "page_index": b["page_index"], "y1": b["y1"]}
            continue
        out.append(b)
    return out


def paragraphs(blocks: list[dict], sure: float = 0.82) -> list[dict]:
    """A paragraph that goes on the one before it is joined to it; what is joined is compared again."""
    out: list[dict] = []
    for b in blocks:
        last = out[-1] if out else None
        if last is not None and b["kind"] == last["kind"] == "paragraph" and not last["text"].rstrip().endswith((".", ":", "?", "!")):
            left = max(0.0, 1 - abs(last["x0"] - b["x0"]) / 200)
            if 0.4 * (last["page_index"] == b["page_index"]) + 0.3 * left + 0.3 * (1.0 if b["y0"] >= last["y0"] else 0.4) >= sure:
                word = last["text"].rsplit(" ", 1)[-1]
                whole = last["text"][:-1] + b["text"] if word.endswith("-") and word.count("-") == 1 and "://" not in word else f"{last['text']} {b['text']}"
                last |= {"text": whole, "x1": max(last["x1"], b["x1"]), "y1": max(last["y1"], b["y1"])}
                continue
        out.append(b)
    return out


def inline_na(blocks: list[dict]) -> list[dict]:
    """A heading N/A is the value of the heading right before it, so it becomes a paragraph."""
    for a, b in zip(blocks, blocks[1:], strict=False):
        if a["kind"] == b["kind"] == "heading" and b["text"].strip() == "N/A":
            b |= {"kind": "paragraph", "level": None}
    return blocks


def subheadings(blocks: list[dict]) -> list[dict]:
    """A short paragraph without a full stop that stands right before a list is a heading below the last one."""
    level = 0
    for a, b in zip(blocks, [*blocks[1:], None], strict=True):
        if a["kind"] == "heading":
            level = a["level"]
        elif a["kind"] == "paragraph" and b is not None and b["kind"] == "list" and len(a["text"]) <= 80 and not a["text"].rstrip().endswith("."):
            a |= {"kind": "heading", "level": level + 1}
    return blocks


def captions(blocks: list[dict]) -> list[dict]:
    """A paragraph that begins like a caption belongs to the table or figure next to it, the one before first."""
    for i, b in enumerate(blocks):
        if b["kind"] == "paragraph" and re.match(r"(?:figure|fig\.|table)\s+\d", b["text"], re.I):
            near = [blocks[j] for j in (i - 1, i + 1) if 0 <= j < len(blocks) and blocks[j]["kind"] in ("table", "figure") and blocks[j]["page_index"] == b["page_index"]]
            if near:
                b |= {"kind": "caption", "parent": near[0]["id"]}
    return blocks


def list_hierarchy(blocks: list[dict]) -> list[dict]:
    """An item's parent is the last item of a lesser level in its list; a level is at most one more than the item's before."""
    open_: list[dict] = []
    for b in blocks:
        if b["kind"] != "list":
            open_ = []
            continue
        b["level"] = min(b["level"] or 1, (open_[-1]["level"] if open_ else 0) + 1)
        while open_ and open_[-1]["level"] >= b["level"]:
            open_.pop()
        if open_:
            b["parent"] = open_[-1]["id"]
        open_.append(b)
    return blocks


def heading_hierarchy(blocks: list[dict]) -> list[dict]:
    """A heading is at most one level below the one above it; what has no parent yet gets the last heading, a heading the last of a lesser level."""
    open_: list[dict] = []
    for b in blocks:
        if b["kind"] == "heading":
            b["level"] = min(b["level"] or 1, (open_[-1]["level"] if open_ else 0) + 1)
            while open_ and open_[-1]["level"] >= b["level"]:
                open_.pop()
        if b.get("parent") is None and open_:
            b["parent"] = open_[-1]["id"]
        if b["kind"] == "heading":
            open_.append(b)
    return blocks


def sibling_orders(blocks: list[dict]) -> list[dict]:
    """Children of a parent are counted from 0 in reading order."""
    held: dict = {}
    for b in blocks:
        p = b.get("parent")
        b["sibling"] = held[p] = held.get(p, -1) + 1
    return blocks


#: The repairs of a document in the order in which they are made.
ASSEMBLY = [edge_duplicates, bottom_notes, profile_tables, paragraphs, cross_page_tables, inline_na, subheadings, captions, list_hierarchy, heading_hierarchy, sibling_orders]
