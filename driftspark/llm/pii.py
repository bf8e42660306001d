"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find the base spans. The random field, trained from the small labelled table in ``pii_examples``,
tags the words around digits and at-signs and adds spans that the patterns leave out, such as phone numbers
without a country code. Its sequences are the words that hold a digit or an at-sign with their neighbours; they
are padded into batches and decoded by Viterbi in numpy.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm.common import extended, free_name, map_batches
from driftspark.llm.optimize import minimize
from driftspark.llm.pii_examples import EXAMPLES
from driftspark.runtime import col

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{mark}-{kind}" for kind in KINDS for mark in "BI"))
PENALTY = 0.05
# Words of context on either side of a word that holds a digit or an at-sign.
CONTEXT = 2
# Sequences that are decoded together.
BATCH = 1024
FORBIDDEN = -1e6

_EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can only start where a run of digits does: from inside the run it would end at the same place.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for n, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + n % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns by start, then kind in the order of ``KINDS``; time is linear in the text."""
    found = []
    end = 0
    at = text.find("@")
    while at >= 0:
        host = _EMAIL_HOST.match(text, at)
        start = at
        while host and start > end and _EMAIL_LOCAL.match(text, start - 1):
            start -= 1
        if host and start < at:
            end = host.end()
            found.append(Span("email", start, end))
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # A number of more than three digits is only small if it starts with zeros.
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(Span("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(Span("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                found.append(Span("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def sequences(text: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end) around digits and at-signs."""
    if not _MARK.search(text):
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    wanted = [n for n, (a, b) in enumerate(words) if _MARK.search(text, a, b)]
    runs: list[list[int]] = []
    for n in wanted:
        if runs and n - CONTEXT <= runs[-1][1] + CONTEXT + 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return [words[max(a - CONTEXT, 0) : b + CONTEXT + 1] for a, b in runs]


# Words whose identity counts as a feature.
CUES = frozenset(
    "call tel phone mobile number fax contact ring reach email mail write send address host server ip ping card visa"
    " pay charge version order page room section chapter year key token secret isbn serial invoice at in on of".split()
)


def shape(word: str) -> str:
    """Runs of letters as a or A, digits as d and their count up to nine; other marks as they are."""
    out = re.sub(r"[0-9]+", lambda m: f"d{min(len(m.group()), 9)}", word)
    out = re.sub(r"[^\W\d_]+", lambda m: "A" if m.group()[:1].isupper() else "a", re.sub(r"d(?=\d)", "\x00", out))
    return out.replace("\x00", "d")[:24]


def word_features(words: list[str]) -> list[list[str]]:
    shapes = [shape(w) for w in words]
    cues = [w.lower().strip(".,:;!?()\"'") for w in words]
    cues = [c if c in CUES else "" for c in cues]
    rows = []
    for n, word in enumerate(words):
        digits = len(_DIGIT.findall(word))
        before = shapes[n - 1] if n else "<"
        after = shapes[n + 1] if n + 1 < len(words) else ">"
        cue = next((c for c in reversed(cues[max(n - 3, 0) : n]) if c), "")
        rows.append(
            [
                "bias",
                "s" + shapes[n],
                "n%d" % min(digits, 20),
                "l" + word[0] if not word[0].isalnum() else "l",
                "at" if "@" in word else "no",
                "c" + cues[n],
                "p" + before,
                "f" + after,
                "k" + cue,
                "k%s,%s" % (cue, "d" if digits else "w"),
                "dots%d" % word.strip(".,").count("."),
                "hex" if digits and re.search(r"[0-9][A-Za-z]|[A-Za-z][0-9]", word) and "@" not in word else "nohex",
                "eq" if before == "=" else "",
            ]
        )
    return rows


class Model(NamedTuple):
    index: dict[str, int]
    emission: np.ndarray
    transition: np.ndarray


def _allowed() -> np.ndarray:
    """Whether a tag may follow another; the last row is the start of a sequence."""
    ok = np.zeros((len(TAGS) + 1, len(TAGS)), bool)
    for b, tag in enumerate(TAGS):
        for a in range(len(TAGS) + 1):
            ok[a, b] = tag[0] != "I" or (a < len(TAGS) and TAGS[a][2:] == tag[2:] and TAGS[a][0] in "BI")
    return ok


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(examples: list[str], penalty: float = PENALTY) -> Model:
    """Maximum penalized likelihood over the examples' sequences."""
    rows, tags = [], []
    for line in examples:
        text, spans = "", []
        for part in re.split(r"(\[(?:%s):[^\]]*\])" % "|".join(KINDS), line):
            if m := re.fullmatch(r"\[(\w+):(.*)\]", part):
                spans.append((m[1], len(text), len(text) + len(m[2])))
                text += m[2]
            else:
                text += part
        for run in sequences(text):
            rows.append(word_features([text[a:b] for a, b in run]))
            own = []
            for a, b in run:
                inside = next(((k, s) for k, s, e in spans if a < e and b > s), None)
                own.append("O" if inside is None else f"{'B' if a <= inside[1] else 'I'}-{inside[0]}")
            tags.append([TAGS.index(t) for t in own])
    index: dict[str, int] = {}
    for row in rows:
        for word in row:
            for name in word:
                index.setdefault(name, len(index))
    padded, mask = _pad(rows, index)
    gold = np.zeros(mask.shape, int)
    for n, own in enumerate(tags):
        gold[n, : len(own)] = own
    count, longest = mask.shape
    width, k = len(index), len(TAGS)
    allowed = _allowed()
    seq = np.arange(count)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        emission = np.vstack([x[: width * k].reshape(width, k), np.zeros(k)])
        transition = np.where(allowed, x[width * k :].reshape(k + 1, k), FORBIDDEN)
        scores = emission[padded].sum(axis=2)
        forward = np.zeros((longest, count, k))
        forward[0] = scores[:, 0] + transition[k]
        for t in range(1, longest):
            step = _logsum(forward[t - 1][:, :, None] + transition[None, :k], 1) + scores[:, t]
            forward[t] = np.where(mask[:, t, None], step, forward[t - 1])
        norm = _logsum(forward[-1], 1)
        backward = np.zeros((longest, count, k))
        d_scores, d_transition = np.zeros_like(scores), np.zeros((k + 1, k))
        for t in range(longest - 1, -1, -1):
            d_scores[:, t] = np.exp(forward[t] + backward[t] - norm[:, None]) * mask[:, t, None]
            if t:
                ahead = backward[t] + scores[:, t]
                joint = forward[t - 1][:, :, None] + transition[None, :k] + ahead[:, None, :] - norm[:, None, None]
                d_transition[:k] += (np.exp(joint) * mask[:, t, None, None]).sum(axis=0)
                step = _logsum(transition[None, :k] + ahead[:, None, :], 2)
                backward[t - 1] = np.where(mask[:, t, None], step, backward[t])
        d_transition[k] += d_scores[:, 0].sum(axis=0)
        score = 0.0
        for t in range(longest):
            on = mask[:, t]
            before = gold[:, t - 1] if t else np.full(count, k)
            score += (scores[seq, t, gold[:, t]] + transition[before, gold[:, t]])[on].sum()
            np.add.at(d_transition, (before[on], gold[on, t]), -1)
            d_scores[seq[on], t, gold[on, t]] -= 1
        d_emission = np.zeros((width + 1, k))
        for f in range(padded.shape[2]):
            np.add.at(d_emission, padded[:, :, f].ravel(), d_scores.reshape(-1, k))
        gradient = np.concatenate([d_emission[:width].ravel(), np.where(allowed, d_transition, 0).ravel()])
        return float(norm.sum() - score + penalty / 2 * (x @ x)), gradient + penalty * x

    x = minimize(loss, np.zeros(width * k + (k + 1) * k), iterations=60)
    emission = np.vstack([x[: width * k].reshape(width, k), np.zeros(k)])
    return Model(index, emission, np.where(allowed, x[width * k :].reshape(k + 1, k), FORBIDDEN))


def _pad(rows: list[list[list[str]]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, rows))
    width = len(rows[0][0])
    padded = np.full((len(rows), longest, width), len(index), np.int64)
    mask = np.zeros((len(rows), longest), bool)
    for n, row in enumerate(rows):
        mask[n, : len(row)] = True
        for t, names in enumerate(row):
            padded[n, t] = [index.get(name, len(index)) for name in names]
    return padded, mask


@cache
def default_model() -> Model:
    return fit(EXAMPLES)


def viterbi(scores: np.ndarray, mask: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best tags of padded sequences; what lies behind a sequence's end is no tag of it."""
    count, longest, k = scores.shape
    best = scores[:, 0] + transition[k]
    back = np.zeros((longest, count, k), np.int64)
    for t in range(1, longest):
        step = best[:, :, None] + transition[None, :k]
        origin = step.argmax(axis=1)
        moved = np.take_along_axis(step, origin[:, None, :], 1)[:, 0] + scores[:, t]
        on = mask[:, t, None]
        back[t] = np.where(on, origin, np.arange(k))
        best = np.where(on, moved, best)
    path = np.zeros((count, longest), np.int64)
    path[:, -1] = best.argmax(axis=1)
    for t in range(longest - 1, 0, -1):
        path[:, t - 1] = np.take_along_axis(back[t], path[:, t, None], 1)[:, 0]
    return path


def _tags(rows: list[list[list[str]]], model: Model) -> list[np.ndarray]:
    """Tags of sequences, decoded in batches of like length."""
    out: list[np.ndarray] = [np.zeros(0, int)] * len(rows)
    order = sorted(range(len(rows)), key=lambda n: len(rows[n]))
    at = 0
    while at < len(order):
        # A batch of long sequences holds fewer of them.
        size = max(1, min(BATCH, 50_000 // len(rows[order[at]])))
        own = order[at : at + size]
        while len(rows[own[-1]]) > 2 * len(rows[own[0]]) + 8:
            own = own[: max(1, len(own) // 2)]
        padded, mask = _pad([rows[n] for n in own], model.index)
        path = viterbi(model.emission[padded].sum(axis=2), mask, model.transition)
        for n, tags in zip(own, path, strict=True):
            out[n] = tags[: len(rows[n])]
        at += len(own)
    return out


def _plausible(kind: str, part: str) -> bool:
    digits = "".join(_DIGIT.findall(part))
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not re.search(r"[^\d\x20().+/-]", part)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return bool(re.fullmatch(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", part))
    return bool(re.fullmatch(r"[^@\s]+@[^@\s]+", part)) and any(c.isalpha() for c in part)


def find(texts: list[str | None], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text. An added span touches no base span."""
    texts = [text or "" for text in texts]
    runs = [(n, run) for n, text in enumerate(texts) for run in sequences(text)]
    rows = [word_features([texts[n][a:b] for a, b in run]) for n, run in runs]
    found: list[tuple[list[Span], list[Span]]] = [(base_spans(text), []) for text in texts]
    for (n, run), tags in zip(runs, _tags(rows, model), strict=True):
        t = 0
        while t < len(tags):
            tag = TAGS[tags[t]]
            if tag[0] != "B":
                t += 1
                continue
            last = t
            while last + 1 < len(tags) and TAGS[tags[last + 1]] == "I-" + tag[2:]:
                last += 1
            start, end = run[t][0], run[last][1]
            part = texts[n][start:end]
            part = part.rstrip(".,;:!?\"'*#$%&|<>")
            part_end = start + len(part)
            lead = len(part) - len(part.lstrip("\"'<*#$%&|"))
            span = Span(tag[2:], start + lead, part_end)
            if _plausible(span.kind, texts[n][span.start : span.end]) and not any(
                span.start < b.end and b.start < span.end for b in found[n][0]
            ):
                found[n][1].append(span)
            t = last + 1
    return found


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def _spans_type() -> pa.DataType:
    return pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    )


def with_spans(docs: DataFrame, name: str, text_column: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` and an array of all spans (kind, start, end in code points, base) by start, then kind.

    Null and empty texts have none; every text is read whole.
    """
    at = docs.columns.index(text_column)
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for base, more in find(batch.column(at).to_pylist(), shared.value):
            both = [(s, True) for s in base] + [(s, False) for s in more]
            both.sort(key=lambda x: (x[0].start, KINDS.index(x[0].kind)))
            rows.append([{"kind": s.kind, "start": s.start, "end": s.end, "base": b} for s, b in both])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _spans_type())], [*batch.schema.names, name])

    return map_batches(docs, add, extended(docs, **{name: SPANS}))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_column: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in angle brackets; texts without spans, null ones
    included, stay as they are. Of overlapping spans the first one names the place of them all."""
    name = free_name(docs, "spans")
    marked = with_spans(docs, name, text_column, model)
    text, spans = col(text_column), F.col(name)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))
    walked = F.aggregate(
        spans,
        start,
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(
                F.concat(
                    s["done"],
                    F.substring(text, s["at"] + 1, x["start"] - s["at"]),
                    F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")),
                ).alias("done"),
                x["end"].alias("at"),
            ),
        ).otherwise(F.struct(s["done"].alias("done"), F.greatest(s["at"], x["end"]).alias("at"))),
        lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    new = F.when(F.size(spans) > 0, walked).otherwise(text).alias(text_column)
    return marked.select(*[new if c == text_column else col(c) for c in docs.columns])
