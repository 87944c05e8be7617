"""What kind of text a unit is: normative wording, scope of rules, genres, windows of time, statements, code and formulas.

Sentences are read as words, by the small grammar of this package; spans are in code points.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.grammar import Word, either, found, maybe, phrase, read, span, then, where
from factloom.functions.semantics import ANALYSIS, analyse, column_of, exemptions

# Words that make a text normative.
NORMATIVE = ("shall", "must", "required", "prohibited", "should", "may not", "skal", "må", "plikt", "forbudt", "kan ikke")
# Words that a statement is read at.
MODALS = ("shall not", "must not", "may not", "shall", "must", "should", "may", "required to", "prohibited from")
# What applicability is said of; what it is said to hold for; and words that leave a text open.
RULES = ("requirement", "requirements", "standard", "standards", "criteria", "criterion", "provision", "provisions", "rule", "rules")
REACHES = ("to", "for", "within", "when", "unless", "regardless")
OPEN = (
    "example", "hypothetical", "ask", "asks", "asked", "say", "says", "said", "report", "reported", "describe", "describes", "described",
    "formerly", "previously", "historically", "proposed", "proposal", "draft", "might", "could", "would",
)
# Units of a threshold, months of a date, what is referred to, and openings of conditions and exceptions.
UNITS = ("%", "mg", "kg", "g", "ml", "l", "°c", "kpa", "mpa", "bar", "day", "days", "hour", "hours", "year", "years")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
REFERRED = ("section", "clause", "annex", "appendix", "table", "figure", "fig.")
CONDITIONS = ("if", "when", "where", "provided that")
EXCEPTIONS = ("unless", "except", "except where", "except when", "except for")
# Numbers in words, and lengths of time.
NUMBERS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
PERIODS = ("day", "days", "week", "weeks", "month", "months", "year", "years")

QUOTES = "\"“”‘’"

_count = where(lambda w: w.isdigit() or w in NUMBERS)
_length = then(_count, maybe(phrase("-")), phrase(*PERIODS))
_cycles = phrase("production cycle", "production cycles")
WINDOWS = {
    "first": then(phrase("first"), _length),
    "rolling": either(
        then(maybe(then(phrase("over", "within"), maybe(phrase("the")))), phrase("any", "rolling", "previous", "past", "prior", "last"), _length, maybe(phrase("period"))),
        then(phrase("over", "within"), maybe(phrase("the")), _count, maybe(phrase("-")), phrase("month", "months", "year", "years"), maybe(phrase("period"))),
    ),
    "every": either(then(phrase("every", "each", "per"), _length), phrase("per day", "per week", "per month", "monthly", "weekly", "daily", "quarterly")),
    "annual": phrase("annually", "yearly", "per year", "each year", "every year", "annual target", "annual targets"),
    "cycle": either(
        then(phrase("each of the previous", "each of previous", "each of the prior", "each of prior"), _count, _cycles),
        then(maybe(phrase("during", "for", "over")), phrase("the most recent"), maybe(phrase("complete")), _cycles),
        then(phrase("during", "for", "over"), phrase("each", "the"), maybe(phrase("complete")), _cycles),
    ),
}

_is, _not = phrase("is", "are"), maybe(phrase("not"))
_scope = either(
    then(phrase(*RULES), either(then(_is, _not, phrase("applicable")), phrase("does not apply", "do not apply", "apply", "applies")), phrase(*REACHES)),
    then(_is, _not, phrase("exempt from"), maybe(phrase("the")), phrase(*RULES)),
)
_normative, _modal, _open = phrase(*NORMATIVE), phrase(*MODALS), phrase(*OPEN)


def normative(text: str) -> list[dict]:
    words = read(text)
    return [span(text, words, i, j) for i, j in found(_normative, words)]


def _sentences(words: list[Word], text: str) -> list[tuple[int, int]]:
    """(first, after) of the words of each sentence: up to a closing mark before space, or a line end."""
    out, first = [], 0
    for k, w in enumerate(words):
        closes = w.low in ".!?" and (w.end == len(text) or text[w.end].isspace())
        if closes or w.low == "\n":
            out.append((first, k + 1))
            first = k + 1
    return [*out, (first, len(words))]


def scopes(text: str) -> list[dict]:
    """Where the text says what rules apply to.

    None where quotes, questions or reported speech leave the whole open, or a line begins with which or whether; none in a sentence that asks which or whether.
    """
    words = read(text)
    asks = [k for k, w in enumerate(words) if w.low in ("which", "whether")]
    if any(w.low in QUOTES or w.low == "?" for w in words) or next(found(_open, words), None) or any(k == 0 or words[k - 1].low == "\n" for k in asks):
        return []
    out = []
    for a, b in _sentences(words, text):
        if not any(a <= k < b for k in asks):
            out += [span(text, words, a + i, a + j) for i, j in found(_scope, words[a:b])]
    return out


def windows(text: str) -> list[dict]:
    """Windows of time with their kind: first N, rolling, every N, annual, cycle; of two that overlap the one that begins first, or else the longer."""
    words = read(text)
    every = sorted(((i, -j, kind) for kind, rule in WINDOWS.items() for i, j in found(rule, words)))
    out, at = [], 0
    for i, j, kind in every:
        if i >= at:
            out.append(span(text, words, i, -j) | {"kind": kind})
            at = -j
    return out


def _clause(text: str, words: list[Word], opening: tuple[str, ...]) -> str | None:
    """What follows the first opening, up to the end of its clause."""
    for _, j in found(phrase(*opening), words):
        end = next((w.start for w in words[j:] if w.low in ".;\n"), len(text))
        rest = text[words[j - 1].end : end].strip()
        if rest:
            return rest
    return None


def _threshold(text: str, words: list[Word]) -> str | None:
    """The first number with a unit, and the comparison sign before it."""
    for k, w in enumerate(words):
        if not w.low.isdigit() or (k and words[k - 1].end == w.start and words[k - 1].low in ".,"):
            continue
        j, last = k, w
        if k + 2 < len(words) and words[k + 1].low in ".," and words[k + 1].start == w.end and words[k + 2].low.isdigit() and words[k + 2].start == words[k + 1].end:
            j, last = k + 2, words[k + 2]
        # the degree sign is a mark, the letter after it a word
        unit = words[j + 1 : j + 3]
        low = unit[0].low if unit else ""
        if low == "°" and len(unit) == 2:
            low, unit = low + unit[1].low, unit[1:]
        if low not in UNITS:
            continue
        a = k
        while a and words[a - 1].low in "<>≤≥=":
            a -= 1
        return text[words[a].start : unit[0].end if unit else last.end]
    return None


def _date(text: str, words: list[Word]) -> str | None:
    """The first date, as 2024-05-01 or 1 May 2024."""
    for k in range(len(words)):
        five = words[k : k + 5]
        lows = [w.low for w in five]
        if len(five) == 5 and lows[1] == lows[3] == "-" and [len(x) if x.isdigit() else 0 for x in lows[::2]] == [4, 2, 2] and five[4].end - five[0].start == 10:
            return text[five[0].start : five[4].end]
        if len(five) > 2 and lows[0].isdigit() and len(lows[0]) <= 2 and lows[1] in MONTHS and lows[2].isdigit() and len(lows[2]) == 4:
            return text[five[0].start : five[2].end]
    return None


def _references(text: str, words: list[Word]) -> list[str]:
    """Named parts of a document with their labels: what stands together after the name and begins with a letter or digit."""
    out = []
    for i, j in found(phrase(*REFERRED), words):
        k = j
        while k < len(words) and (words[k].low[0].isalnum() if k == j else words[k].start == words[k - 1].end and (words[k].low[0].isalnum() or words[k].low in ".-_")):
            k += 1
        if k > j and words[j].start > words[j - 1].end:
            out.append(text[words[i].start : words[k - 1].end])
    return out


def statements(text: str) -> list[dict]:
    """A statement at each modal word: who, must or may, does what to what; and the first condition, exception, threshold, date and all references of the text."""
    words = read(text)
    shared = {
        "condition": _clause(text, words, CONDITIONS), "exception": _clause(text, words, EXCEPTIONS), "threshold": _threshold(text, words), "date": _date(text, words),
        "refs": _references(text, words),
    }
    out = []
    for i, j in found(_modal, words):
        said = span(text, words, i, j)
        # who: what the sentence has before the modal word
        first = next((k + 1 for k in range(i - 1, -1, -1) if words[k].low == "."), 0)
        entity = text[words[first].start : said["start"]].strip(" ,:;\n") if first < i else ""
        k = j
        while k < len(words) and words[k].low in ",:;\n":
            k += 1
        k = max(phrase("be")(words, k), k)
        action, after = None, said["end"]
        if k < len(words) and words[k].low[0].isalpha() and words[k].low[0].isascii():
            m = k + 1
            # a word with hyphens is one action
            while m < len(words) and words[m].start == words[m - 1].end and (words[m].low == "-" or words[m].low[0].isalnum()):
                m += 1
            action, after = text[words[k].start : words[m - 1].end], words[m - 1].end
        rest = text[after:].strip(" ,:;\n" if action is None else " ,:;")
        digest = hashlib.sha256(f"{said['start']}:{text}".encode()).hexdigest()
        out.append({"start": said["start"], "entity": entity or None, "modality": said["text"].lower(), "action": action, "object": rest or None, **shared, "digest": digest})
    return out


_S, _I = T.StringType(), T.IntegerType()
SPAN = T.ArrayType(T.StructType([T.StructField("start", _I), T.StructField("end", _I), T.StructField("text", _S)]))
WINDOW = T.ArrayType(T.StructType([T.StructField("start", _I), T.StructField("end", _I), T.StructField("kind", _S), T.StructField("text", _S)]))
STATEMENT = T.ArrayType(T.StructType([T.StructField("start", _I), *(T.StructField(n, _S) for n in ("entity", "modality", "action", "object", "condition", "exception", "threshold", "date")), T.StructField("refs", T.ArrayType(_S)), T.StructField("digest", _S)]))


def normative_spans(text: Column) -> Column:
    return column_of(SPAN, normative, text)


def scope_spans(text: Column) -> Column:
    return column_of(SPAN, scopes, text)


def window_spans(text: Column) -> Column:
    return column_of(WINDOW, windows, text)


def statement_rows(text: Column) -> Column:
    return column_of(STATEMENT, statements, text)


#: Everything that is read from a sentence, with its windows of time, references and exemptions.
EXEMPTION = T.ArrayType(T.StructType([T.StructField("start", _I), T.StructField("end", _I), T.StructField("denied", T.BooleanType()), T.StructField("text", _S)]))
BUNDLE = T.StructType([*ANALYSIS.fields, T.StructField("windows", WINDOW), T.StructField("references", T.ArrayType(_S)), T.StructField("exemptions", EXEMPTION)])


def bundle(text: str) -> dict:
    return analyse(text) | {"windows": windows(text), "references": _references(text, read(text)), "exemptions": exemptions(text)}


def bundle_of(text: Column) -> Column:
    return column_of(BUNDLE, bundle, text)


_asked = then(phrase("for"), maybe(phrase("any")), phrase("questions", "queries"), phrase("regarding", "about", "on"))
_contact = phrase("please contact")


def _is_contact(text: str) -> bool:
    """One sentence that names whom to ask, by mail, and says nothing else."""
    words = read(text)
    i = _asked(words, 0)
    comma = next((k for k in range(i + 1, len(words)) if words[k].low in ",.!?;\n"), -1) if i > 0 else -1
    if comma < 0 or words[comma].low != ",":
        return False
    j = _contact(words, comma + 1)
    address = text[words[j].start :].rstrip(".") if 0 < j < len(words) else ""
    name, at, host = address.partition("@")
    return bool(name and at and "." in host) and not any(c.isspace() for c in address) and host.rpartition(".")[2].isalpha() and len(host.rpartition(".")[2]) > 1


def _is_citation(text: str) -> bool:
    """Author and initials at the front; journal, volume, pages and a link at the end; a year that ends a sentence between them."""
    parts = text.split()
    if parts and parts[0].isdigit():
        parts = parts[1:]
    if len(parts) < 6 or not parts[-1].startswith(("http://", "https://")):
        return False
    author, initial = parts[0], parts[1]
    if not (author.endswith(",") and author[0].isupper() and len(author) > 2 and re.fullmatch(r"(?:[A-Z]\.)+", initial)):
        return False
    year = next((k for k, p in enumerate(parts[2:-1], 2) if re.fullmatch(r"(?:19|20)[0-9]{2}[a-z]?\.", p)), 0)
    tail = " ".join(parts[year + 1 : -1])
    title, dot, journal = tail[:-1].rpartition(". ")
    # a journal's name, its volume with or without a number, and pages
    volume, comma, pages = journal.rpartition(", ")
    name = volume.rstrip("0123456789() ")
    return bool(year and dot and title and comma and tail.endswith(".")) and name[:1].isupper() and any(map(str.isdigit, volume[len(name) :])) and re.fullmatch(r"[0-9]+ ?[–-] ?[0-9]+", pages) is not None


def genre(text: Column) -> Column:
    """support_contact or bibliographic_reference where the whole text is one; null otherwise."""

    def named(x: str) -> str | None:
        x = x.strip()
        return "support_contact" if _is_contact(x) else "bibliographic_reference" if _is_citation(x) else None

    return column_of(_S, named, text)


# Labels of context, labels of formal lines, and how a modal word is defined.
LABELS = ("rationale", "how do i interpret this requirement?")
FORMAL = ("indicator", "requirement", "required client actions", "required cab actions", "required auditor actions")
DEFINES = ("denotes", "means", "indicates", "is used to express")


def _defines(text: str) -> bool:
    """Whether the whole text says what a quoted modal word means."""
    words = read(text.strip())
    if len(words) < 5 or words[0].low not in QUOTES + "'" or words[1].low not in ("shall", "must", "should", "may") or words[2].low not in QUOTES + "'":
        return False
    j = phrase(*DEFINES)(words, 3)
    return 0 < j < len(words) and all(w.low not in ".!?" for w in words[j:-1])


def _formal(lines: Column) -> Column:
    """Whether some line opens with a clause number of three places or more, or a formal label."""

    def opens(line: Column) -> Column:
        low = F.lower(F.ltrim(line))
        label = F.rtrim(F.substring_index(low, ":", 1))
        number = F.split(F.substring_index(low, " ", 1), r"\.")
        counted = (F.size(number) >= 3) & low.contains(" ") & F.forall(F.slice(number, 1, F.size(number) - 1), lambda p: p.rlike("^[0-9]+$")) & F.element_at(number, -1).rlike("^[0-9]+[a-z]?$")
        return counted | (low.contains(":") & label.isin(*FORMAL))

    return F.exists(lines, opens)


#: Which signal decides what, in order; the number of a rule is its place, from 1.
CASCADE = (
    ("assembled", "context"), ("accounted", "context"), ("mixed", "undetermined"), ("labelled", "context"), ("row", "requirement"), ("normative", "requirement"), ("scoped", "requirement"),
    ("numbered", "requirement"), ("defined", "context"), ("heading", "context"), ("genre", "context"),
)


def classification(kind: Column, title: Column, body: Column, ancestor: Column | None = None) -> tuple[Column, Column, Column, Column]:
    """(class, rule, text, spans): requirement, context or undetermined by the first signal of CASCADE that holds, or undetermined by the rule after it where
    none does; the text that was read, and its normative spans.

    ancestor is the title of the nearest heading above. A body that defines a modal word is left out of the text.
    """
    defined = column_of(T.BooleanType(), _defines, body)
    parts = F.array(F.trim(title), F.when(~defined, F.trim(body)))
    text = F.array_join(F.filter(parts, lambda p: F.length(p) > 0), "\n")
    spans = normative_spans(text)
    low, named = F.lower(F.trim(body)), [F.lower(F.trim(c)) for c in (title, ancestor) if c is not None]
    # what is left of the body after a label that stands at its front
    after = F.coalesce(*[F.when(low.startswith(x), F.substring(F.trim(body), len(x) + 1, 1 << 30)) for x in LABELS])
    opened = F.coalesce(low.startswith(LABELS[1]) | F.ltrim(after).rlike("^[:–—-]") | F.ltrim(after, F.lit(" ")).startswith("\n"), F.lit(False))
    labelled = reduce(lambda a, b: a | F.coalesce(b.isin(*LABELS), F.lit(False)), named, opened)
    lines = F.split(F.coalesce(F.when(opened, after), body, F.lit("")), "\n")
    standard = kind.isin("standard_principle", "standard_indicator")
    pairs = F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.lower(F.trim(F.substring_index(x, ":", 1))))
    row = (F.get(pairs, F.lit(0)) == "indicator") & (F.get(pairs, F.lit(1)) == "requirement") & F.forall(F.slice(F.split(body, "\n"), 1, 2), lambda x: F.length(F.trim(F.element_at(F.split(x, ":", 2), -1))) > 0)
    signals = {
        "assembled": kind == "source_table_assembly", "accounted": kind == "coverage", "mixed": labelled & (_formal(lines) | standard | row), "labelled": labelled, "row": row,
        "normative": F.size(spans) > 0, "scoped": F.size(scope_spans(text)) > 0, "numbered": standard, "defined": defined & (text == ""), "heading": kind.isin("source_heading", "source_title"), "genre": genre(text).isNotNull(),
    }
    held = F.filter(F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(c).alias("class"), F.coalesce(signals[s], F.lit(False)).alias("holds")) for i, (s, c) in enumerate(CASCADE, 1)]), lambda r: r["holds"])
    first = F.get(held, F.lit(0))
    return F.coalesce(first["class"], F.lit("undetermined")), F.coalesce(first["rule"], F.lit(len(CASCADE) + 1)), text, spans


# Words that lines of a language begin with, and words that stand anywhere in it.
PYTHON = ("def", "class", "import")
SHELL = ("cd", "curl", "grep", "awk", "sed")
SQL = ("select", "insert", "update", "delete", "create table")
JAVASCRIPT = ("const", "let", "var", "function", "=>", "console.log")


def _language(code: str) -> str | None:
    lines = [line.split() for line in code.splitlines()]
    opens = [line[0] for line in lines if len(line) > 1]
    if any(w in PYTHON for w in opens) or any(x[:1] == ["from"] and x[2:3] == ["import"] or x[:2] == ["if", "__name__"] or x[:1] == ["if__name__"] for x in lines):
        return "python"
    if code.strip().startswith("{") and code.strip().endswith("}"):
        return "json"
    commands = [x[1] if x[0] == "sudo" else x[0] for x in lines if len(x) > (1 + (x[0] == "sudo"))]
    if any(w in SHELL for w in commands) or any(x and x[0].startswith("#!") and " ".join(x).endswith("sh") for x in lines):
        return "shell"
    words = read(code)
    if next(found(phrase(*SQL), words), None):
        return "sql"
    # marks between words stand apart
    exact = [code[w.start : w.end] for w in words]
    if any(w in JAVASCRIPT for w in exact) or any(x in code for x in JAVASCRIPT if not x.isalpha()):
        return "javascript"
    return None


def code_language(text: Column) -> Column:
    """The language whose signature a snippet has, in the order Python, JSON, shell, SQL, JavaScript; null where none has."""
    return column_of(_S, _language, text)


# Operators that TeX knows by name, environments of several rows, and signs of a bound evaluation.
OPERATORS = (
    "arccos", "arcsin", "arctan", "cos", "cosh", "cot", "coth", "csc", "det", "dim", "exp", "gcd", "hom", "inf", "ker", "lg", "lim", "liminf", "limsup", "ln", "log", "max", "min", "Pr",
    "sec", "sin", "sinh", "sup", "tan", "tanh",
)
ROWS = ("aligned", "aligned*", "align", "align*", "split", "gathered")
_TEX = re.compile(r"\\[A-Za-z]+|\\.|\s+|.", re.S)


def _group(tex: list[str], i: int) -> int:
    """The place after the group that opens at i; i where none does or it does not close."""
    depth = 0
    for k in range(i, len(tex)):
        depth += (tex[k] == "{") - (tex[k] == "}")
        if depth == 0:
            return k + 1 if k > i else i
    return i


def _rewritten(tex: list[str]) -> list[str]:
    """One pass over the signs of a formula; an escaped sign is a sign of its own and never taken for what it hides."""
    out, i, listed = [], 0, "\\ldots" in tex
    while i < len(tex):
        sign = tex[i]
        if sign == "\\operatorname":
            a = i + 1 + (tex[i + 1 : i + 2] == ["*"])
            b = _group(tex, a)
            letters = [t for t in tex[a + 1 : b - 1] if not t.isspace()]
            if b > a + 2 and len(letters) > 1 and all(len(x) == 1 for x in letters) and len(letters) < b - a - 2 and "".join(letters) in OPERATORS:
                out.append("\\" + "".join(letters))
                i = b
                continue
        if sign == "_" and tex[i + 1 : i + 4] == ["{", "_", "{"]:
            inner, outer = _group(tex, i + 3), _group(tex, i + 1)
            if outer == inner + 1 and inner > i + 5 and not {"{", "}"} & set(tex[i + 4 : inner - 1]):
                out += ["_", *tex[i + 3 : inner]]
                i = outer
                continue
        if sign in ("\\sup", "\\inf") and tex[i + 1 : i + 2] == ["_"]:
            out += ["\\mathop{", sign, "}\\limits"]
        elif listed and sign in "[]":
            out.append("\\left\\lbrack " if sign == "[" else " \\right\\rbrack")
        else:
            out.append(sign)
        i += 1
    return out


def _formula(tex: str) -> str:
    signs = _rewritten(_TEX.findall(tex.strip()))
    # a pair of braces around a whole environment of rows
    inner = "".join(signs[1:-1]).strip() if signs and _group(signs, 0) == len(signs) else ""
    name = inner.removeprefix("\\begin{").partition("}")[0]
    text = inner if inner.startswith("\\begin{") and name in ROWS and inner.endswith("\\end{%s}" % name) else "".join(signs)
    # a dashed rule that was read as a cell of every row of a matrix
    head, opened, rest = text.partition("\\begin{bmatrix}")
    body, closed, tail = rest.partition("\\end{bmatrix}")
    rows = body.split("\\\\")
    if opened and closed and len(rows) > 1 and all("\\vdots" in r for r in rows):
        text = head + opened + "\\\\".join(r.replace("&\\vdots&", "&").replace("\\vdots&", "&") for r in rows) + closed + tail
    # brackets with both bounds are an evaluation
    ends = [text.find(close, k) + len(close) for close in ("\\right)_{", "\\Bigg]_{") for k in range(len(text)) if text.startswith(close, k)]
    if any("}^{" in text[a:] and text.index("}", a) == text.find("}^{", a) > a and "}" in text[text.index("}^{", a) + 3 :] for a in ends):
        text = text.replace("\\left(", "\\Bigg[").replace("\\right)", "\\Bigg]")
    return text


def plain_formula(tex: Column) -> Column:
    r"""TeX without what recognisers add: spelled-out operators, doubled subscripts, bare \sup and \inf with bounds, brackets of listed indices, braces around rows, dashed
    rules in matrices, round brackets of evaluations. Escaped brackets stay."""
    return column_of(_S, _formula, tex)
