"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. The field labels the tokens of each document that has some: tokens inside base spans are observed,
tokens without a digit or ``@`` are certainly nothing, the others are open. Neighbouring tokens share a potential (the chain), and so do
successive tokens with the same digits or the same name before ``@``, however far apart (the skips). Loopy message passing then carries labels
to repeats that the patterns miss: a number without its ``+``, with other separators, or run together with another one.
What a token's shape says and how labels follow each other is counted over all documents; both tables are of fixed size.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.arrow import map_blocks, text_columns

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0 is nothing, then the kinds
AGREE = 4.0  # log weight of equal labels at both ends of a skip
SURE = 0.5  # an open token is reported when its label has more than this probability
ROUNDS, CLOSE, DAMPING = 30, 1e-4, 0.3
_OBSERVED = 50.0

# The base patterns of the contract, with possessive repeats where giving back could not help.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_TELLING = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")


def _luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + n % 2), 10)) for n, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Every ``@`` is tried with the characters before it, so long runs without one are not searched again and again."""
    found, end, at, after = [], 0, text.find("@"), 0
    while at >= 0:
        before = text[max(end, after):at]
        local = len(before) - len(before.rstrip(_LOCAL))
        host = _DOMAIN.match(text, at) if local else None
        if host:
            found.append((at - local, host.end()))
            end = host.end()
        after = at + 1
        at = text.find("@", after)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``kind, start, end`` by kind and start, in code points; matches that fail their check are dropped."""
    spans = [(0, s, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        spans += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 < m.end() - m.start():
                digits = "".join(_DIGITS.findall(m[0]))
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    spans.append((2, *m.span()))
        spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return spans


def shape_of(token: str) -> int:
    """One of 1,344 shapes: digits (20 and more alike), dots (3 and more alike), and whether letters, ``@``, ``+`` and hyphens occur."""
    digits = min(20, sum(map(len, _DIGITS.findall(token))))
    flags = [any(c.isalpha() for c in token), "@" in token, "+" in token, "-" in token]
    return (digits * 4 + min(3, token.count("."))) * 16 + sum(f << n for n, f in enumerate(flags))


def form_of(token: str) -> str | None:
    """What similar tokens have in common: the name before ``@``, else three digits or more; ``None`` if there is neither."""
    name, sign, _ = token.partition("@")
    if sign and name:
        return "@" + name.strip(".,;:!?()[]<>\"'").lower()
    digits = "".join(_DIGITS.findall(token))
    return digits if len(digits) >= 3 else None


@dataclass
class Tokens:
    """The open and observed tokens of a text: ``places`` count all its tokens, ``labels`` are -1 where open."""

    spans: list[tuple[int, int]]
    places: list[int]
    shapes: list[int]
    labels: np.ndarray
    chain: np.ndarray
    skips: np.ndarray


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> Tokens:
    """Tokens with a digit or ``@``, or inside a base span, and the edges between them.

    Edges of a form join each token to the next with it, so a form that fills a document makes no more edges than tokens.
    """
    order = sorted(base, key=lambda s: (s[1], s[0]))
    spans, places, shapes, labels, forms, ahead, open_spans = [], [], [], [], [], 0, []
    for place, m in enumerate(_TOKEN.finditer(text)):
        while ahead < len(order) and order[ahead][1] < m.end():
            open_spans.append(order[ahead])
            ahead += 1
        open_spans = [s for s in open_spans if s[2] > m.start()]
        token = m[0]
        if open_spans or _TELLING.search(token):
            spans.append(m.span())
            places.append(place)
            shapes.append(shape_of(token))
            labels.append(min((k for k, _, _ in open_spans), default=-2) + 1)
            forms.append(form_of(token))
    chain = [(n - 1, n) for n in range(1, len(places)) if places[n] == places[n - 1] + 1]
    skips, last = [], {}
    for n, form in enumerate(forms):
        if form is not None:
            if form in last:
                skips.append((last[form], n))
            last[form] = n
    pairs = lambda edges: np.array(edges, np.int64).reshape(-1, 2)
    return Tokens(spans, places, shapes, np.array(labels, np.int64), pairs(chain), pairs(skips))


@dataclass
class Field:
    """Log potentials: of labels per shape, and of the labels of neighbours."""

    unary: dict[int, np.ndarray]
    chain: np.ndarray


def _count(rows: list[tuple]) -> list[tuple]:
    seen = Counter()
    for _, text in rows:
        if not _TELLING.search(text):
            continue
        tokens = tokens_of(text, base_spans(text))
        labels = np.maximum(tokens.labels, 0)
        seen.update(("shape", s, int(n)) for s, n in zip(tokens.shapes, labels, strict=True))
        seen.update(("chain", int(labels[a]), int(labels[b])) for a, b in tokens.chain)
    return [(*key, n) for key, n in seen.items()]


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Counts over all documents, a token being labelled by the base span it touches; at most 6,745 rows come to the driver."""
    counted = map_blocks(text_columns(df, id_col, text_col), _count, "what string, a int, b int, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    shapes, chain = {}, np.full((LABELS, LABELS), 0.5)
    for what, a, b, n in counted.collect():
        if what == "chain":
            chain[a, b] += n
        else:
            shapes.setdefault(a, np.full(LABELS, 0.5))[b] += n
    unary = {shape: np.log(n / n.sum()) for shape, n in shapes.items()}
    expected = chain.sum(1, keepdims=True) * chain.sum(0, keepdims=True) / chain.sum()
    return Field(unary, np.clip(np.log(chain / expected), -3.0, 3.0))


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis))


def marginals(unary: np.ndarray, edges: np.ndarray, potentials: np.ndarray) -> np.ndarray:
    """Label probabilities per node by loopy sum-product; exact where the edges have no cycle.

    ``potentials[e, i, j]`` is the log weight of labels ``i, j`` at the ends of edge ``e``. Messages start even, move in step and are damped;
    they stop when none changes by more than ``CLOSE`` or after ``ROUNDS`` rounds, twice the nodes if those are fewer.
    """
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    weight = np.concatenate([potentials, potentials.transpose(0, 2, 1)])
    back = np.roll(np.arange(len(source)), len(edges))
    message = np.zeros((len(source), LABELS))
    belief = unary.copy()
    for _ in range(ROUNDS if len(edges) else 0):
        sent = _log_sum((belief[source] - message[back])[:, :, None] + weight, 1)
        sent -= sent.max(1, keepdims=True)
        change = np.abs(sent - message).max()
        message = (1 - DAMPING) * sent + DAMPING * message
        belief = unary.copy()
        np.add.at(belief, target, message)
        if change < CLOSE:
            break
    return np.exp(belief - _log_sum(belief, 1)[:, None])


_AGREEMENT = np.diag([0.0] + [AGREE] * (LABELS - 1))


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """The spans that the field adds: neighbouring open tokens of one label, without the marks around them. None touches a base span."""
    if not base:
        return []
    tokens = tokens_of(text, base)
    is_open = tokens.labels < 0
    if not is_open.any() or not len(tokens.skips):
        return []
    unknown = np.log([1 - 0.1 * (LABELS - 1)] + [0.1] * (LABELS - 1))
    unary = np.stack([field.unary.get(s, unknown) for s in tokens.shapes])
    seen = np.flatnonzero(~is_open)
    unary[seen] = -_OBSERVED
    unary[seen, tokens.labels[seen]] = 0.0
    potentials = np.concatenate([np.broadcast_to(field.chain, (len(tokens.chain), LABELS, LABELS)), np.broadcast_to(_AGREEMENT, (len(tokens.skips), LABELS, LABELS))])
    chance = marginals(unary, np.concatenate([tokens.chain, tokens.skips]), potentials)
    label = np.where(is_open & (chance.max(1) > SURE), chance.argmax(1), 0)
    found, previous = [], None
    for n in np.flatnonzero(label):
        start, end = tokens.spans[n]
        core = [m.span() for m in re.finditer(r"[^\W_]+", text[start:end])]
        if not core:
            continue
        start, end = start + core[0][0], start + core[-1][1]
        if previous is not None and label[n] == label[previous] and tokens.places[n] == tokens.places[previous] + 1 and label[n] == KINDS.index("phone") + 1:
            found[-1] = (found[-1][0], found[-1][1], end)
        else:
            found.append((int(label[n]) - 1, start, end))
        previous = n
    return found


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def personal_data(df: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``: one row per row of ``df``.

    Null and empty texts have no spans. Repeated rows and null ids are rows like others. Texts of any length are scanned in linear
    time and never shuffled. Columns other than id and text are ignored, whatever their names. An empty table gives no rows.
    """
    field = train(df, id_col, text_col) if field is None else field

    def block(rows: list[tuple]) -> list[tuple]:
        made = []
        for doc_id, text in rows:
            base = base_spans(text)
            more = added_spans(text, base, field)
            kinds = [k for k, _, _ in base]
            digest = hashlib.sha256(shown(base).encode()).hexdigest()
            made.append((doc_id, *(kinds.count(k) for k in range(len(KINDS))), digest, shown(base + more), len(more)))
        return made

    return map_blocks(text_columns(df, id_col, text_col), block,
                      "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
