"""Personal data: fixed patterns, and what a linear-chain conditional random field finds besides.

The field labels the tokens of a text with the beginning, inside or outside of a kind. Its features are the shapes of a token and of those around it and
the words that its small labelled table knows; it is trained by gradient ascent on the regularised log-likelihood and decoded by Viterbi, many chains at a time in numpy.

A chain is a zone of the text: the code points within REACH of a digit, an at sign, an at or dot written out, or a title. Outside of zones nothing is labelled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import documents, free, small_batches
from factloom.llm.pii_labelled import SENTENCES

#: Kinds in the order of spans that begin together; the fixed patterns know the first four.
KINDS = ("email", "ip", "card", "phone", "name")
#: The patterns' parts. A run of digits cannot match from its middle what it does not match from its start, so each is tried once.
_LOCAL_SET = "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123)))) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

#: Code points of a zone on either side of what makes it.
REACH = 64
#: Tokens before and after that a token's features look at.
AROUND = 4
#: Tokens that are decoded together, in the mean.
TOKENS = 200_000
_MARK = re.compile(r"[0-9@]|\b(?:dot|DOT|AT|Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora?|[Nn]ame)\b|[\[({](?:at|dot|arroba|arobase|punkt|punto|point)[\])}]")
_TOKEN = re.compile(r"\n+|[^\W\d_]+|[0-9]+|[^\s]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterable[tuple[str, int, int]]:
    """An address is found at its at sign: what may stand before goes back as far as it can, to the end of the address before at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL_SET))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and without overlap in each kind; a match that fails its test is dropped and not tried again."""
    out = list(_emails(text))
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def zones(text: str) -> list[tuple[int, int]]:
    """The stretches of text within REACH of a mark, those that meet made one."""
    out: list[list[int]] = []
    for m in _MARK.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def tokens(text: str, a: int, b: int) -> list[tuple[str, int, int, bool]]:
    """(token, start, end, whether space goes before) between a and b: letters, digits, line ends and single marks."""
    out, last = [], a
    for m in _TOKEN.finditer(text, a, b):
        out.append((m.group(), m.start(), m.end(), m.start() > last))
        last = m.end()
    return out


def _digits(shape: str) -> bool:
    return shape[0] == "d" and shape[1:2].isdigit()


def _shape(token: str) -> str:
    if token[0] == "\n":
        return "line"
    if token[0] in "0123456789":
        n = len(token)
        return f"d{min(n, 20)}" + ("s" if n <= 3 and int(token) <= 255 else "L" if 12 <= n <= 19 and luhn(token) else "")
    if token[0].isalpha():
        size = len(token) if len(token) <= 3 else "6" if len(token) <= 6 else "long"
        return ("X" if token.isupper() else "Xx" if token[0].isupper() else "x") + str(size)
    return token if token.isascii() else "mark"


#: Words that announce a kind.
CUES = {
    "phone": ("call", "phone", "telephone", "tel", "telefon", "tél", "téléphone", "teléfono", "ring", "mobile", "fax", "cell", "dial", "handy", "text", "móvil", "rufnummer", "appelez", "llame"),
    "card": ("card", "credit", "visa", "mastercard", "amex", "debit", "kreditkarte", "kartennummer", "karte", "carte", "tarjeta", "crédito"),
    "email": ("mail", "email", "e-mail", "contact", "write", "courriel", "correo", "schreiben", "écrivez", "escriba", "reach", "send"),
    "ip": ("host", "ip", "ping", "server", "address", "traffic", "client", "adresse", "dirección"),
    "at": ("at", "arroba", "arobase"),
    "dot": ("dot", "punkt", "punto", "point"),
    "name": ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "mme", "monsieur", "madame", "señor", "señora", "name"),
}
_CUE_OF = {w: k for k, words in CUES.items() for w in words}

LABELS = ("O", *(f"{side}-{k}" for k in KINDS for side in "BI"))
_BEGIN, _INSIDE = np.arange(1, len(LABELS), 2), np.arange(2, len(LABELS), 2)
#: An inside follows its own beginning or inside alone.
_ALLOWED = np.ones((len(LABELS), len(LABELS)), bool)
_ALLOWED[:, _INSIDE] = False
_ALLOWED[_BEGIN, _INSIDE] = _ALLOWED[_INSIDE, _INSIDE] = True
_NEVER = np.float32(-1e9)


def _fitting(key: str) -> np.ndarray:
    """0 for the labels that a token of this key can have, _NEVER for the others. A word that announces a kind is in none, but mail may be part of an address."""
    *known, shape = key.split("|") if key != "|" else (key,)
    digits, word = _digits(shape), shape[0] in "xX" and len(shape) > 1
    linking = "at" in known or "dot" in known
    addressed, word = word, word and (linking or not set(known) & CUES.keys())
    begin = {"email": digits or word or shape == "_", "ip": digits, "card": digits, "phone": digits or shape in "+(", "name": word and shape[0] == "X"}
    inside = {
        "email": digits or (addressed and (word or "email" in known)) or shape in ".@_%+-()[]{}", "ip": digits or shape in ".[](){}" or "dot" in known, "card": digits or shape in "-./", "phone": digits or shape in "()-./",
        "name": word or shape in "'.-",
    }
    out = np.zeros(len(LABELS), np.float32)
    for i, k in enumerate(KINDS):
        out[1 + 2 * i], out[2 + 2 * i] = 0 if begin[k] else _NEVER, 0 if inside[k] else _NEVER
    return out


class Field:
    """words: those that have a feature of their own; atoms: numbers of the features; weights: by place around the token and feature, scores of the labels;
    moves: scores from label to label. Tokens are told apart by their types alone, and there are only so many shapes, so the table of types stays small."""

    def __init__(self, words: frozenset[str], atoms: dict[tuple, int], weights: np.ndarray, moves: np.ndarray):
        self.words, self.atoms, self.weights, self.moves = words, atoms, weights, moves
        self.types: dict[tuple[str, bool], int] = {}
        # what stands beyond a chain's ends
        self.rows = [np.zeros(weights.shape[::2], np.float32)]

    def number(self, key: tuple[str, bool]) -> int:
        k = self.types.get(key)
        if k is None:
            k = self.types[key] = len(self.rows)
            at = [self.atoms[a] for a in _atoms(key) if a in self.atoms]
            row = self.weights[:, at].sum(1, dtype=np.float32)
            row[AROUND] += _fitting(key[0])
            self.rows.append(row)
        return k

    def types_of(self, chain: list[tuple[str, int, int, bool]]) -> list[int]:
        return [self.number((_key(t, self.words), space)) for t, _, _, space in chain]

    @property
    def emissions(self) -> np.ndarray:
        return np.stack(self.rows, 1)

    def decode(self, chains: list[list[int]]) -> list[np.ndarray]:
        """The likeliest labels of each chain of types, by Viterbi: all chains take their k-th step together."""
        order = sorted(range(len(chains)), key=lambda k: -len(chains[k]))
        lengths = np.array([len(chains[k]) for k in order])
        emissions = self.emissions
        scores = [_emitted(emissions, np.array(chains[k], np.int64)) for k in order]
        most = int(lengths.max(initial=0))
        going = np.searchsorted(-lengths, -np.arange(1, most + 1), "right")
        best = np.stack([s[0] for s in scores]) if scores else np.zeros((0, len(LABELS)), np.float32)
        best[:, _INSIDE] = _NEVER
        flat, first = (np.concatenate(scores), np.concatenate(([0], np.cumsum(lengths)[:-1]))) if scores else (np.zeros((0, len(LABELS)), np.float32), lengths)
        back = []
        for k in range(1, most):
            m = going[k]
            reach = best[:m, :, None] + self.moves
            back.append(reach.argmax(1).astype(np.int8))
            best[:m] = reach.max(1) + flat[first[:m] + k]
        out = np.zeros(len(flat), np.int8)
        now = best.argmax(1)
        for k in range(most - 1, -1, -1):
            m = going[k]
            out[first[:m] + k] = now[:m]
            if k:
                now[:m] = np.take_along_axis(back[k - 1], now[:m, None], 1)[:, 0]
        answer: list[np.ndarray] = [np.zeros(0, np.int8)] * len(chains)
        for k, a, n in zip(order, first, lengths, strict=True):
            answer[k] = out[a : a + n]
        return answer


def _key(token: str, words: frozenset[str]) -> str:
    w = token.lower()
    shape = _shape(token)
    cue = _CUE_OF.get(w)
    return (f"={w}|" if w in words else "") + (f"{cue}|" if cue else "") + shape


def _emitted(emissions: np.ndarray, types: np.ndarray) -> np.ndarray:
    """Label scores of each place of a chain; type 0 stands beyond its ends."""
    padded = np.concatenate((np.zeros(AROUND, np.int64), types, np.zeros(AROUND, np.int64)))
    return sum(emissions[o][padded[o : o + len(types)]] for o in range(2 * AROUND + 1))


def labelled(spark: SparkSession, sentences: tuple[str, ...] = SENTENCES) -> DataFrame:
    """The small labelled table: (text, spans of kind, start and end)."""
    rows = []
    for s in sentences:
        text, spans, at = "", [], 0
        for m in re.finditer(r"\[(%s)\|((?:[^\[\]]|\[[^\]|]*\])*)\]" % "|".join(KINDS), s):
            text += s[at : m.start()]
            found = m.group(2).strip()
            spans.append((m.group(1), len(text), len(text) + len(found)))
            text, at = text + m.group(2), m.end()
        rows.append((text + s[at:], spans))
    return spark.createDataFrame(rows, "text string, spans array<struct<kind: string, start: int, end: int>>")


def _word(rng: np.random.Generator, like: str) -> str:
    """Some word in the case of another."""
    out = "".join(map(chr, rng.integers(97, 123, int(rng.integers(2, 9)))))
    return out.upper() if like.isupper() and len(like) > 1 else out.capitalize() if like[0].isupper() else out


def _number(rng: np.random.Generator, like: str, kind: str | None) -> str:
    """Some number: parts of addresses stay parts of addresses, groups of cards keep their length, groups of telephone numbers nearly so."""
    if kind == "ip":
        return str(rng.integers(0, 256))
    n = len(like) + (int(rng.integers(-1, 2)) if (kind == "phone" and len(like) > 2) or (kind is None and len(like) < 12) else 0)
    return "".join(map(str, rng.integers(0, 10, max(1, n))))


def varied(text: str, spans: list[tuple[int, int, str]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, str]]]:
    """A row of the labelled table with other numbers, and other words but for those that announce a kind; outside of spans half of the words stay."""
    out, places, last = "", {}, 0
    for token, a, b, _ in tokens(text, 0, len(text)):
        out, last = out + text[last:a], b
        kind = next((k for x, y, k in spans if x <= a and b <= y), None)
        fresh = token
        if token.isalpha() and token.lower() not in _CUE_OF and (kind is not None or rng.random() < 0.5):
            fresh = _word(rng, token)
        elif token.isascii() and token.isdigit():
            fresh = _number(rng, token, kind)
        places[a], places[b] = len(out), len(out) + len(fresh)
        out += fresh
    return out, [(places[a], places[b], k) for a, b, k in spans]


def train(table: DataFrame, steps: int = 60, rate: float = 0.2, decay: float = 0.003, variants: int = 2) -> Field:
    """A field from a small labelled table (text, spans of kind, start, end), each row one chain, and variants of it with other words and numbers; it is collected, so it has to be small.

    A null or empty text teaches nothing, spans that overlap an earlier one are passed over, repeated rows count as often; an empty table gives a field that finds nothing.
    """
    rows = [(r["text"], sorted((s["start"], s["end"], s["kind"]) for s in r["spans"] or [])) for r in table.collect() if (r["text"] or "").strip()]
    seen = Counter(t.lower() for x, _ in rows for t in {t for t, *_ in tokens(x, 0, len(x))} if t.isalpha())
    rng = np.random.default_rng(11)
    rows += [varied(x, spans, rng) for _ in range(variants) for x, spans in rows]
    chains = [tokens(x, 0, len(x)) for x, _ in rows]
    words = frozenset(w for w, n in seen.items() if n > 1)
    keys = sorted({(_key(t, words), space) for c in chains for t, _, _, space in c})
    types = {k: i + 1 for i, k in enumerate(keys)}
    atoms = {a: i for i, a in enumerate(sorted({a for k in keys for a in _atoms(k)}, key=repr))}
    if not rows:
        return Field(words, atoms, np.zeros((2 * AROUND + 1, 0, len(LABELS)), np.float32), np.where(_ALLOWED, 0, _NEVER).astype(np.float32))
    table_of = np.zeros((len(keys) + 1, len(atoms)), np.float32)
    fitting = np.zeros((len(keys) + 1, len(LABELS)))
    for k, i in types.items():
        fitting[i] = _fitting(k[0])
        for a in _atoms(k):
            table_of[i, atoms[a]] = 1
    most = max(map(len, chains))
    seq = np.zeros((len(chains), most), np.int64)
    gold = np.zeros((len(chains), most), np.int64)
    held = np.zeros((len(chains), most), bool)
    for i, (c, (_, spans)) in enumerate(zip(chains, rows, strict=True)):
        seq[i, : len(c)] = [types[_key(t, words), space] for t, _, _, space in c]
        held[i, : len(c)] = True
        at = -1
        for a, b, kind in spans:
            if a < at:
                continue
            inside = [k for k, (_, x, y, _) in enumerate(c) if x >= a and y <= b]
            gold[i, inside] = 2 + 2 * KINDS.index(kind)
            gold[i, inside[:1]] = 1 + 2 * KINDS.index(kind)
            at = b
    padded = np.pad(seq, ((0, 0), (AROUND, AROUND)))
    theta = {"e": np.zeros((2 * AROUND + 1, len(atoms), len(LABELS))), "m": np.zeros((len(LABELS), len(LABELS)))}
    mean, square = {k: np.zeros_like(v) for k, v in theta.items()}, {k: np.zeros_like(v) for k, v in theta.items()}
    for step in range(1, steps + 1):
        emissions = table_of @ theta["e"]
        emissions[AROUND] += fitting
        moves = np.where(_ALLOWED, theta["m"], _NEVER)
        scores = sum(emissions[o][padded[:, o : o + most]] for o in range(2 * AROUND + 1))
        excess, pairs = _expected(scores, moves, held)
        np.subtract.at(excess, (np.nonzero(held)[0], np.nonzero(held)[1], gold[held]), 1)
        both = held[:, 1:]
        np.subtract.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        down = {"e": np.empty_like(theta["e"]), "m": pairs}
        for o in range(2 * AROUND + 1):
            by_type = np.zeros((len(table_of), len(LABELS)))
            np.add.at(by_type, padded[:, o : o + most][held], excess[held])
            down["e"][o] = table_of.T @ by_type
        for k in theta:
            g = down[k] + decay * len(chains) * theta[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            theta[k] -= rate * (1 - step / (steps + 1)) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Field(words, atoms, theta["e"].astype(np.float32), np.where(_ALLOWED, theta["m"], _NEVER).astype(np.float32))


def _atoms(key: tuple[str, bool]) -> list[tuple]:
    """The features of a token type: its word, what it announces, its shape with and without the space, what kind of token it is and about how long."""
    k, space = key
    *known, shape = k.split("|") if k != "|" else (k,)
    digits = _digits(shape)
    kind = "digits" if digits else "letters" if shape[0] in "xX" and len(shape) > 1 else "mark"
    out = [(k, space), (shape,), (shape, space), (kind, space), *((x,) for x in known)]
    if digits:
        n = int(re.sub("[a-zL]", "", shape))
        out += [(f"digits {1 if n < 2 else 2 if n < 4 else 3 if n < 6 else 4 if n < 12 else 5}", space), *([("small",)] if shape.endswith("s") else [])]
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _expected(scores: np.ndarray, moves: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often the field expects each label at each place, and each move in all, by the forward and backward sums; held marks the places that chains have."""
    n, most, size = scores.shape
    start = np.zeros(size)
    start[_INSIDE] = _NEVER
    forward, backward = np.zeros_like(scores), np.zeros_like(scores)
    forward[:, 0] = scores[:, 0] + start
    for k in range(1, most):
        on = _logsum(forward[:, k - 1, :, None] + moves, 1) + scores[:, k]
        forward[:, k] = np.where(held[:, k, None], on, forward[:, k - 1])
    for k in range(most - 2, -1, -1):
        on = _logsum(moves[None] + (scores[:, k + 1] + backward[:, k + 1])[:, None, :], 2)
        backward[:, k] = np.where(held[:, k + 1, None], on, 0)
    whole = _logsum(forward[:, -1], 1)
    each = np.where(held[:, :, None], np.exp(forward + backward - whole[:, None, None]), 0)
    pairs = np.zeros((size, size))
    for k in range(1, most):
        on = np.exp(forward[:, k - 1, :, None] + moves + (scores[:, k] + backward[:, k])[:, None, :] - whole[:, None, None])
        pairs += np.where(held[:, k, None, None], on, 0).sum(0)
    return each, pairs


#: What a name follows, and the signs of an address as they are written out.
_TITLED = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora?)\.?|\b[Nn]ame(?: is|:)) ?\Z")
_AT = re.compile(r" ?[\[({] ?(?:at|arroba|arobase|@) ?[\])}] ?| at | ?@ ?", re.IGNORECASE)
_DOT = re.compile(r" ?[\[({] ?(?:dot|punkt|punto|point) ?[\])}] ?| dot ", re.IGNORECASE)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _sound(kind: str, text: str, before: str) -> bool:
    """Whether a labelled span can be of its kind at all, after what is before it."""
    if "\n" in text:
        return False
    digits = _NO_DIGIT.sub("", text)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "card":
        return 12 <= len(digits) <= 19 and any(_CUE_OF.get(w) == "card" for w in re.findall(r"[^\W\d_]+", before.lower()))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "email":
        return _ADDRESS.fullmatch(_DOT.sub(".", _AT.sub("@", text))) is not None
    return text[0].isupper() and _TITLED.search(before) is not None


def spans(texts: list[str], field: Field) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, by pattern) of each text, in order: the fixed patterns' spans, and those of the field that meet none of them."""
    out = [[(*s, True) for s in base(x)] for x in texts]
    chains, types, size = [], [], 0

    def decoded() -> None:
        for (k, chain), labels in zip(chains, field.decode(types), strict=True):
            if labels.any():
                _add(out[k], texts[k], chain, labels)

    for k, x in enumerate(texts):
        for a, b in zones(x):
            chain = tokens(x, a, b)
            if chain:
                chains.append((k, chain))
                types.append(field.types_of(chain))
                size += len(chain)
            if size >= TOKENS:
                decoded()
                chains, types, size = [], [], 0
    decoded()
    return [sorted(s, key=lambda s: (s[1], KINDS.index(s[0]))) for s in out]


def _add(found: list[tuple[str, int, int, bool]], text: str, chain: list, labels: np.ndarray) -> None:
    fixed = [s for s in found if s[3]]
    begins = np.nonzero(labels % 2 == 1)[0].tolist()
    for i in begins:
        j = i + 1
        while j < len(labels) and labels[j] == labels[i] + 1:
            j += 1
        kind, a, b = KINDS[(labels[i] - 1) // 2], chain[i][1], chain[j - 1][2]
        if _sound(kind, text[a:b], text[max(0, a - 32) : a]) and not any(s < b and a < e for _, s, e, _ in fixed):
            found.append((kind, a, b, False))


_FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def found(docs: DataFrame, field: Field, to: str = "pii") -> DataFrame:
    """docs and the spans (kind, start, end, base) of the whole column text, in code points, in a column named to, which replaces one of that name.

    base marks the spans of the fixed patterns, which stay whatever the field says; the field adds those that meet none of them. A null text is empty and has none; very
    long texts are searched whole; spans that begin together stand in the order of KINDS; repeated rows have the same spans. Other columns pass through, whatever
    their names; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf(_FOUND)
    def search(text: pd.Series) -> pd.Series:
        every = spans([x or "" for x in text], shared.value)
        return pd.Series([[{"kind": k, "start": a, "end": b, "base": p} for k, a, b, p in s] for s in every], dtype=object)

    return docs.withColumn(to, search(F.col("text")))


def masked(docs: DataFrame, pii: str = "pii") -> DataFrame:
    """docs with each span of the column pii replaced in text by its kind between angle brackets; of spans that overlap the first is named, a null text stays null."""
    state = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        head = F.concat(s["done"], F.col("text").substr(s["at"] + 1, x["start"] - s["at"]), F.lit("<"), x["kind"], F.lit(">"))
        return F.struct(F.when(fresh, head).otherwise(s["done"]).alias("done"), F.greatest(s["at"], x["end"]).alias("at"))

    text = F.aggregate(pii, state, step, lambda s: F.concat(s["done"], F.col("text").substr(s["at"] + 1, F.char_length("text"))))
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), text))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    (pii,) = free(docs, "pii")
    out = found(docs, train(labelled(spark)), pii)
    fixed = F.filter(pii, lambda s: s["base"])
    of = lambda k: F.size(F.filter(fixed, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select("doc_id", *map(of, KINDS[:4]), F.sha2(joined(fixed).cast("binary"), 256).alias("base_sha256"), joined(F.col(pii)).alias("spans"), (F.size(pii) - F.size(fixed)).cast("long").alias("n_added"))
