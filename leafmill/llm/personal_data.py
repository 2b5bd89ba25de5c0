"""Personal data by weak supervision.

Candidates are found by patterns, strict ones (the base) and loose ones. Four labelers vote
on each: the form, a gazetteer (domains, issuers, dialling codes, address ranges), the words
before it, and the characters beside it. Expectation-maximisation estimates, from the counts
of vote patterns over all documents, how reliable each labeler is; a logistic regression is
fitted to the posteriors and decides on each candidate. Base spans always stay.

A vote pattern is one of a few hundred codes, so the driver sees that many counts whatever
the corpus; candidates stay in the row of their document, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import Batches, shared_table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "".join(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123)])) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Greedy runs can't be matched from their middle if they aren't from their start, so the
# possessive forms find the same as the plain ones, in linear time.
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE_PHONE = re.compile(r"(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}")

#: Gazetteers and context words (own choice).
_DOMAINS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "us", "it", "nl", "ch", "at", "be"}
_FOR = {
    0: ("mail", "email", "e-mail", "contact", "write", "reach"),
    1: ("ip", "address", "host", "server", "login", "from"),
    2: ("card", "visa", "mastercard", "amex", "credit", "payment", "paid"),
    3: ("phone", "tel", "telephone", "call", "mobile", "fax", "cell"),
}
_AGAINST = ("version", "release", "build", "order", "invoice", "isbn", "page", "id", "no", "number", "serial")
_BEFORE = re.compile(r"[A-Za-z-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap, walking from one ``@`` to the next."""
    out, low, at = [], 0, text.find("@")
    while at >= 0:
        before = text[low:at]
        start = low + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        low = domain.end() if domain else at + 1
        at = text.find("@", low)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the strict patterns find."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """Candidates beside the base: masked addresses, local numbers, failed cards and addresses."""
    out = []
    if "at)" in text or "at]" in text:
        out += [(0, *m.span()) for m in _LOOSE_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        out += [(3, *m.span()) for m in _LOOSE_PHONE.finditer(text)]
        out += [(1, *m.span()) for m in _IP.finditer(text)]
        out += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= m.end() - m.start() <= 40]
    return out


def votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, int, int, int]:
    """Of the form, the gazetteer, the context and the neighbours: 1 for, -1 against, 0 none."""
    span = text[start:end]
    digits = "".join(c for c in span if c in "0123456789")
    form = 1 if base else -1 if kind in (1, 2) else 0
    if kind == 0:
        known = 1 if re.split(r"[.\]) ]", span)[-1].lower() in _DOMAINS else 0
    elif kind == 1:
        first = int(span.split(".")[0][:9])
        known = -1 if first in (0, 10, 127) or first >= 224 else 1
    elif kind == 2:
        issued = digits[0] == "4" or "51" <= digits[:2] <= "55" or digits[:2] in ("34", "35", "37", "65") or digits[:4] == "6011"
        known = 1 if issued and len(digits) in (13, 15, 16, 19) else -1
    else:
        known = 1 if digits[:1] not in ("", "0") and (base or digits[0] not in "01") else -1
    words = [w.lower() for w in _BEFORE.findall(text[max(0, start - 30) : start])][-4:]
    context = 1 if any(w in _FOR[kind] for w in words) else -1 if any(w in _AGAINST for w in words[-2:]) else 0
    beside = text[max(0, start - 1) : start] + text[end : end + 1]
    glued = any(c.isalnum() or c in "_/=:@" for c in beside)
    return form, known, context, -1 if glued else 1


def code_of(kind: int, base: bool, vote: Sequence[int]) -> int:
    code = kind * 2 + base
    for v in vote:
        code = code * 3 + v + 1
    return code


def decode(code: int) -> tuple[int, bool, list[int]]:
    vote = []
    for _ in range(4):
        code, v = divmod(code, 3)
        vote.append(v - 1)
    return code // 2, bool(code % 2), vote[::-1]


def candidates(text: str | None) -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, base, code) by kind, then start; loose ones only where no base span is."""
    if not text:
        return []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    out = [(k, a, b, True, code_of(k, True, votes(text, k, a, b, True))) for k, a, b in base]
    loose = sorted(loose_spans(text), key=lambda s: (s[1], -s[2]))
    i, reach = 0, 0
    for k, a, b in loose:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if a >= reach and not (i < len(taken) and taken[i][0] < b):
            out.append((k, a, b, False, code_of(k, False, votes(text, k, a, b, False))))
            reach = b
    return sorted(out)


def reliabilities(codes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of each vote pattern by expectation-maximisation over the labelers."""
    parts = [decode(int(c)) for c in codes]
    kinds = np.array([p[0] for p in parts])
    vote = np.array([p[2] for p in parts]) + 1
    posterior = np.clip(0.5 + 0.2 * (vote - 1).sum(1), 0.05, 0.95)  # the majority, at first
    for _ in range(rounds):
        log = np.zeros((len(codes), 2))
        for c, share in ((0, 1 - posterior), (1, posterior)):
            weight = counts * share
            prior = (np.bincount(kinds, weight, len(KINDS)) + 1) / (np.bincount(kinds, counts, len(KINDS)) + 2)
            log[:, c] = np.log(prior[kinds])
            for j in range(vote.shape[1]):
                table = np.bincount(vote[:, j], weight, 3) + 1
                log[:, c] += np.log(table / table.sum())[vote[:, j]]
        posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return posterior


def fit(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Codes that the final classifier accepts."""
    if not len(codes):
        return codes
    target = reliabilities(codes, counts)
    parts = [decode(int(c)) for c in codes]
    x = np.array([[1.0, *(k == i for i in range(1, 4)), *(v == 1 for v in vote), *(v == -1 for v in vote)] for k, _, vote in parts])
    weight = np.sqrt(counts / counts.max())  # frequent patterns do not drown the rest
    beta = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of the ridge-penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(beta)),
                               x.T @ (weight * (target - p)) - 0.05 * beta)
        beta += step
    return codes[x @ beta > 0]


_SPANS = pa.list_(
    pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32())])
)
SPANS_SQL = "array<struct<kind: int, start: int, end: int, base: boolean, code: int>>"


def _find(batches: Batches):
    names = ("kind", "start", "end", "base", "code")
    for rows in batches:
        found = [[dict(zip(names, s, strict=True)) for s in candidates(t)] for t in rows.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(found, _SPANS)], names=["row", "spans"])


def find(docs: DataFrame, carry: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Every document with its personal data: ``row`` (struct of ``carry``) and ``spans``.

    Spans are (kind, start, end, base, code) by kind and start, in code points, ends
    exclusive; kinds are numbered as in ``KINDS``, kinds may overlap. Null and empty texts have
    none; repeated rows are judged each for itself; an empty table gives no rows; carried
    columns may have any names.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(text_col).cast("string").alias("text"))
    found = shared_table(
        rows.mapInArrow(_find, f"row {rows.schema['row'].dataType.simpleString()}, spans {SPANS_SQL}"), "personal"
    )
    seen = found.select(F.explode("spans.code").alias("code")).groupBy("code").count().collect()  # a few hundred codes
    accepted = fit(np.array([r["code"] for r in seen], np.int64), np.array([r["count"] for r in seen], float))
    known = F.array(*(F.lit(int(c)) for c in accepted)).cast("array<int>")
    return found.withColumn("spans", F.filter("spans", lambda s: s["base"] | F.array_contains(known, s["code"])))


def spelled(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def _redact(batches: Batches):
    for rows in batches:
        out = []
        for text, spans in zip(rows.column("text").to_pylist(), rows.column("spans").to_pylist(), strict=True):
            pieces, at = [], 0
            for s in sorted(spans or (), key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    pieces += [text[at : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                at = max(at, s["end"])
            out.append("".join([*pieces, text[at:]]) if spans else text)
        yield pa.RecordBatch.from_arrays(
            [rows.column("row"), rows.column("spans"), pa.array(out, pa.string())], names=["row", "spans", "redacted"]
        )


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """``find``'s rows, whose ``row`` has the text, with ``redacted``: each span replaced by its kind.

    Overlapping spans become one mark, that of the first. Texts without spans stay as they are.
    """
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    return found.withColumn("text", F.col("row").getField(text_col)).mapInArrow(
        _redact, f"row {kinds['row']}, spans {kinds['spans']}, redacted string"
    )
