"""Personal data by weak supervision.

Base spans follow fixed patterns (email, ip, card, phone) and always stay.
Further candidates are wide: whatever could be meant as personal data, most of it not. Of kind email what stands
around an "@" or a written-out "at"; of ip dotted numbers of two to eight parts, also with brackets around the dots, and
groups of version 6; of card runs of 12 to 25 digits, with or without separators; of phone groups of 6 to 15 digits; and, a kind of its own,
secret: runs of letters and digits of eight or more, as keys and passwords are. Labelers (strict pattern,
gazetteer, words around, shape, surroundings, marks) vote yes, no or nothing on every
candidate. Expectation-maximisation over the counts of vote patterns estimates
each labeler's reliability per kind, and its posteriors are the soft labels of
a final logistic span classifier. Its features are of the span itself and the characters beside it
(length, shares of digits and capitals, variety, groups, checksum, neighbouring
characters), not the votes; candidates it accepts are added.

Votes and features are small discrete tuples, so the corpus is summed up as
counts per tuple: all candidates of all texts count, and what reaches the
driver is bounded by the number of tuples. Spans are kept between the two steps
as checkpointed rows without texts.

Edge cases: null and empty texts have no spans; spans are code points with an
exclusive end; a match that fails its check is dropped and not retried; long
texts are read whole in linear time; repeated rows give equal results; without
candidates nothing is trained; an empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, extend, fit_logistic, logistic, map_chunks, texts_of

KINDS = ("email", "ip", "card", "phone")
#: With the kind that has loose candidates only; it comes last in order.
ALL_KINDS = (*KINDS, "secret")
# Gazetteers and context words of the labelers.
DOMAINS = frozenset("com org net edu gov io co uk de fr es eu info biz us ca mail example gmail yahoo".split())
CONTEXT = {
    "email": frozenset("email e-mail mail contact write reach address correo courriel".split()),
    "ip": frozenset("ip host server address login connect ping network".split()),
    "card": frozenset("card visa mastercard amex credit payment pay debit account tarjeta karte carte".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax contact whatsapp dial telefon telefono".split()),
    "secret": frozenset("password passwd pwd token secret key apikey api auth bearer credential access passwort contraseña".split()),
}
SECRET_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xox", "AIza")
AGAINST = frozenset("version isbn issn id no number page pages total price sum order section".split())

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"\x20?[\(\[\{]\x20?at\x20?[\)\]\}]\x20?|\x20at\x20", re.IGNORECASE)
_SPELT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\x20?[\(\[\{]\x20?dot\x20?[\)\]\}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63})+", re.IGNORECASE)
_WIDE_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?@\x20?[A-Za-z0-9.-]{2,64}")
_WIDE_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{1,4}\)?(?:[\x20./-][0-9]{1,5}){1,5}(?![0-9A-Za-z-])")
_WIDE_DOTTED = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,5}(?:\.[0-9]{1,5}){1,7}(?![0-9A-Za-z])")
_BRACKETED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\(\[\{]\x20?(?:\.|dot)\x20?[\)\]\}]\x20?[0-9]{1,3}){3}(?![0-9.])", re.IGNORECASE)
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_WIDE_CARD = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20./_-]?[0-9]){11,24}(?![0-9A-Za-z])")
_KEY = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{8,}")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    return found


def _addresses(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        place = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                found.append((place, place + size))
            place += size + 1
    return found


def _numbers(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    cards, phones = [], []
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m.group()) if m.end() - m.start() < 64 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            cards.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                phones.append(m.span())
    return cards, phones


_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind as listed in ``KINDS``."""
    spans = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [("ip", *s) for s in _addresses(text)] if "." in text else []
        cards, phones = _numbers(text)
        spans += [("card", *s) for s in cards] + [("phone", *s) for s in phones]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def loose_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates that meet no base span."""
    found = []
    low_at = "at" in text or "AT" in text or "At" in text
    if low_at:
        free = 0
        for m in _AT.finditer(text):
            start = m.start()
            # matches stand apart, so each walks over the word before it only
            while start > free and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            domain = _SPELT.match(text, m.end()) if start < m.start() else None
            if domain:
                found.append(("email", start, domain.end()))
                free = domain.end()
    if "@" in text:
        found += [("email", *m.span()) for m in _WIDE_AT.finditer(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for p in (_WIDE_DOTTED, _BRACKETED_IP, _IP6) for m in p.finditer(text)]
        found += [("card", *m.span()) for m in _WIDE_CARD.finditer(text)]
        found += [("phone", *m.span()) for m in _WIDE_PHONE.finditer(text) if 6 <= sum(c.isdigit() for c in m.group()) <= 15]
        for m in _KEY.finditer(text):
            digits = sum(c.isdigit() for c in m.group())
            if digits and any(c.isalpha() for c in m.group()):
                found.append(("secret", *m.span()))
    if not found:
        return []
    starts = np.array([s for _, s, _ in taken] or [0])
    ends = np.maximum.accumulate(np.array([e for _, _, e in taken] or [0]))
    kept = []
    for kind, start, end in found:
        before = int(np.searchsorted(starts, end, side="left"))
        if before == 0 or ends[before - 1] <= start:
            kept.append((kind, start, end))
    return kept


def evidence(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[str, str]:
    """The votes (y, n or - per labeler) and the feature values of a candidate."""
    span = text[start:end]
    before = [w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])][-4:]
    after = [w.lower() for w in _WORD.findall(text[end : end + 24])][:2]
    digits = sum(c.isdigit() for c in span)
    digit_run = re.sub(r"[^0-9]", "", span)
    near = CONTEXT[kind]
    named = any(w in near for w in before) or any(w in near for w in after)
    edge = (text[start - 1] if start else " ") + (text[end] if end < len(text) else " ")
    glued = edge[0].isalnum() or edge[1].isalnum()
    if kind == "email":
        ends_in = re.split(r"[^A-Za-z0-9]+", span.lower())
        gazetteer = ends_in[-1] in DOMAINS
        marked = "@" in span or any(c in span for c in "([{")
        # plain words around "at" and "dot" are prose unless something says that an address follows
        shape = len(ends_in) >= 3 and len(ends_in[-1]) in (2, 3, 4, 5, 6) and (marked or named)
    elif kind == "ip":
        lead = re.match(r"[0-9]+", span)
        gazetteer = ":" in span or lead is None or 0 < int(lead.group()[:4]) < 255
        parts = re.findall(r"[0-9]+", span) if ":" not in span else span.split(":")
        shape = len(parts) == 8 if ":" in span else len(parts) == 4 and all(int(p[:4]) <= 255 and not (len(p) > 1 and p[0] == "0") for p in parts)
        marked = span.count(".") == 3 or span.count(":") == 7 or len(re.findall(r"dot", span, re.IGNORECASE)) == 3
    elif kind == "card":
        gazetteer = span[0] in "3456"
        shape = digits in (14, 15, 16, 19)
        marked = luhn(re.sub(r"[^0-9]", "", span))
    elif kind == "secret":
        low, letters = span.lower(), sum(c.isalpha() for c in span)
        gazetteer = span.startswith(SECRET_STARTS)
        # letters and digits mixed throughout, as words with a number behind them aren't
        changes = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
        shape = len(span) >= 16 and changes >= 4 and digits >= 3
        marked = edge[0] in "=\"':" or (span.isupper() and letters >= 8) or all(c in "0123456789abcdef" for c in low)
    else:
        groups = [g for g in re.split(r"[^0-9]+", span) if g]
        gazetteer = span.startswith("+") or span.startswith("(")
        shape = 9 <= digits <= 15 and len(groups) >= 2
        marked = len(set(re.sub(r"[0-9()+]", "", span).strip())) <= 2
    against = any(w in AGAINST for w in before[-2:]) or edge[0] in "$€£#="
    if kind == "secret":
        against = "/" in span or "--" in span or span.count("-") > 3
    # of the fixed pattern's form, but failing its check
    failed = (
        (kind == "card" and _CARD.fullmatch(span) and not (14 <= digits <= 19 and luhn(digit_run)))
        or (kind == "ip" and _DOTTED.fullmatch(span))
        or (kind == "phone" and span[0] == "+")
        or (kind == "email" and "@" in span)
    )
    votes = (
        "y" if strict else "n" if failed else "-",
        "y" if gazetteer else "-" if kind == "secret" else "n",
        "y" if named else "n" if kind == "email" and not marked else "-",
        "y" if shape else "n",
        "n" if against or glued else "-",
        "y" if marked else "n",
    )
    numbers = re.findall(r"[0-9]+", span)
    features = (
        int(12 <= digits <= 19 and luhn(digit_run)),
        int(len(numbers) == 4 and all(int(x[:4]) <= 255 for x in numbers)),
        min(digits, 24), min(len(span), 48) // 4, 8 * digits // len(span), 8 * sum(c.isupper() for c in span) // len(span),
        min(8, len(set(span)) // 3), min(8, len(re.findall(r"[0-9A-Za-z]+", span))), min(4, len(set(re.sub(r"[0-9A-Za-z]+", "", span)))),
        min(12, sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))),
        int(span[0] in "+("), int(edge[0] in "=\"':"), int(glued), min(8, span.count(":")),
        int(bool(re.search(r"[A-Za-z]{2,}", span))), int(9 <= digits <= 15), int(14 <= digits <= 19),
    )
    return "".join(votes), ",".join(map(str, features))


def estimate(patterns: list[tuple[str, str, int]], rounds: int = 200) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """EM over (votes, features, count) of one kind: posterior per votes, P(yes | true), P(yes | false) per labeler.

    A labeler that abstains says nothing. Counts start from the majority of the
    votes; a weak prior keeps rates inside (0, 1) and says that labelers beat chance.
    """
    totals: dict[str, int] = {}
    for votes, _, n in patterns:
        totals[votes] = totals.get(votes, 0) + n
    names = sorted(totals)
    n = np.array([totals[v] for v in names], dtype=np.float64)
    yes = np.array([[c == "y" for c in v] for v in names], dtype=np.float64)
    no = np.array([[c == "n" for c in v] for v in names], dtype=np.float64)
    p = (yes.sum(axis=1) + 0.5) / (yes.sum(axis=1) + no.sum(axis=1) + 1)
    true = false = np.full(yes.shape[1], 0.5)
    for _ in range(rounds):
        w1, w0 = (n * p)[:, None], (n * (1 - p))[:, None]
        true = ((w1 * yes).sum(axis=0) + 8) / ((w1 * (yes + no)).sum(axis=0) + 10)
        false = ((w0 * yes).sum(axis=0) + 2) / ((w0 * (yes + no)).sum(axis=0) + 10)
        share = float(((n * p).sum() + 1) / (n.sum() + 2))
        ratio = np.log(share / (1 - share)) + yes @ np.log(true / false) + no @ np.log((1 - true) / (1 - false))
        fresh = 1 / (1 + np.exp(-np.clip(ratio, -30, 30)))
        if np.abs(fresh - p).max() < 1e-9:
            break
        p = fresh
    return dict(zip(names, p.tolist())), true, false


def train(counts: list[tuple[str, str, str, int]], rounds: int = 200) -> tuple[dict[tuple[str, str], float], dict[str, dict]]:
    """Score of the final classifier for every (kind, features) seen, and the labelers' reliabilities. Without ``rounds`` of
    expectation-maximisation the labelers' majority takes the place of its posteriors."""
    scores, reliability = {}, {}
    for kind in ALL_KINDS:
        own = [(votes, features, n) for k, votes, features, n in counts if k == kind]
        if not own:
            continue
        posterior, true, false = estimate(own, rounds)
        reliability[kind] = {"yes_if_true": true.tolist(), "yes_if_false": false.tolist()}
        x = np.array([[float(v) for v in f.split(",")] for _, f, _ in own])
        x /= np.maximum(x.max(axis=0), 1)
        weight = np.array([float(n) for _, _, n in own])
        w = fit_logistic(x, np.array([posterior[v] for v, _, _ in own]), weight * min(1.0, 1e6 / weight.sum()), 0.02)
        for (_, features, _), score in zip(own, logistic(x, w)):
            scores[kind, features] = float(score)
    return scores, reliability


def candidates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with kinds, starts, ends, strict, votes, features: arrays over a text's candidates."""
    types = {"kinds": pa.string(), "starts": pa.int32(), "ends": pa.int32(), "strict": pa.bool_(), "votes": pa.string(), "features": pa.string()}
    added = "kinds array<string>, starts array<int>, ends array<int>, strict array<boolean>, votes array<string>, features array<string>"

    def make():
        def work(piece: pa.RecordBatch) -> pa.RecordBatch:
            columns: dict[str, list] = {name: [] for name in types}
            for raw in texts_of(piece):
                text = raw.decode("utf-8", errors="replace")
                base = base_spans(text)
                rows = [(*s, True) for s in base] + [(*s, False) for s in loose_spans(text, base)]
                seen = [evidence(text, *row) for row in rows]
                for name, values in zip(types, ([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], [e[0] for e in seen], [e[1] for e in seen])):
                    columns[name].append(values)
            arrays = [pa.array(columns[name], pa.list_(kind)) for name, kind in types.items()]
            return pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *arrays], [*keep, *types])

        return work

    return map_chunks(docs.select(*dict.fromkeys((*keep, "text"))), make, extend(docs.select(*keep).schema, added))


def find_personal_data(docs: DataFrame, threshold: float = 0.5, rounds: int = 200) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans, n_added, n_secret and n_rejected (candidates that the classifier turned down); it
    learns from all candidates, in at most ``rounds`` of expectation-maximisation."""
    found = checkpoint(candidates(docs.select("doc_id", "text")))
    each = found.where(F.size("kinds") > 0).select(F.explode(F.arrays_zip("kinds", "votes", "features")).alias("c"))
    counts = each.groupBy("c.kinds", "c.votes", "c.features").agg(F.count("*").alias("n")).collect()
    scores, _ = train([tuple(r) for r in counts], rounds)
    accepted = {key for key, score in scores.items() if score >= threshold}
    schema = extend(
        found.select("doc_id").schema,
        "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_secret bigint, n_rejected bigint",
    )

    def finish(batches):
        for batch in batches:
            rows = [batch.column(n).to_pylist() for n in ("kinds", "starts", "ends", "strict", "features")]
            out: list[list] = [[] for _ in range(9)]
            for spans in zip(*rows):
                spans = sorted(zip(*spans), key=lambda s: (s[1], ALL_KINDS.index(s[0])))
                base = [f"{k}:{a}:{b}" for k, a, b, strict, _ in spans if strict]
                every = [f"{k}:{a}:{b}" for k, a, b, strict, f in spans if strict or (k, f) in accepted]
                for column, kind in zip(out, KINDS):
                    column.append(sum(1 for k, *_, strict, _ in spans if strict and k == kind))
                out[4].append(hashlib.sha256(",".join(base).encode()).hexdigest())
                out[5].append(",".join(every))
                out[6].append(len(every) - len(base))
                out[7].append(sum(1 for x in every if x.startswith("secret:")))
                out[8].append(len(spans) - len(every))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 3
            arrays = [pa.array(values, kind) for values, kind in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], schema.fieldNames())

    return found.mapInArrow(finish, schema)
