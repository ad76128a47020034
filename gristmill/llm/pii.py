"""Personal data: base formats, and further spans chosen among candidates by boosted trees.

High-recall generators propose overlapping spans: every stretch of up to six digit groups that could be a telephone number, a card
number, an IP address or a social-security-like number, account numbers, IPv6 addresses, spelled-out e-mail addresses. Trees
boosted on features of format and context score them; scores are calibrated, each kind has a threshold at which it is
precise on examples not fitted, and of overlapping candidates the likeliest is taken.

The trees learn from candidates of the documents, of which a check tells whether they are personal (Luhn, octets up to 255, the
number of digits, the account number's modulus: whether a base span, or a valid account number, is exactly the candidate). The checks are hidden
from the features, so the trees have to go by format and context, and find what the base patterns miss, such as a telephone number that
runs into another number. Kinds that the documents lack are learned from examples generated with a fixed seed. Documents whose
crc32(id as text) mod 4 is 2 are never fitted on; ``quality`` measures precision and recall there. Base spans always
stay and candidates that overlap one are dropped.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted
from .common import per_row

# Kinds in the order of results.
BASE = ("email", "ip", "card", "phone")
ADDED = ("phone_like", "card_like", "ip_like", "ssn", "iban", "ipv6", "email_spelled")
KINDS = BASE + ADDED

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base formats, by kind, then start; every search is linear in the text."""
    out, pos, last = [], 0, 0
    at = text.find("@")
    while at >= 0:
        from_ = max(pos, last)
        start = from_ + len(text[from_:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
            pos = found.end()
        last = at + 1
        at = text.find("@", max(last, pos))
    for m in CHAIN.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts = [(p.start(), p.end()) for p in re.finditer("[0-9]+", m.group())]
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(v := m.group()[a:b].lstrip("0")) <= 3 and int(v or 0) <= 255 for a, b in four):
                out.append((1, m.start() + four[0][0], m.start() + four[3][1]))
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40:
            digits = re.sub("[^0-9]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


PHONE_LIKE, CARD_LIKE, IP_LIKE, SSN, IBAN, IPV6, SPELLED = range(4, 11)
#: At most about so many documents are drawn for fitting, and so many candidates of each.
SAMPLE = 20_000
PER_DOCUMENT = 200
#: Runs of digit groups, one sign or bracket apart; and patterns of the other kinds, with what must occur in the text.
RUN = re.compile(r"[0-9]++(?:[)]?[ ./-]?[ (]?[0-9]++)*+")
PATTERNS = {
    IBAN: ("", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    IPV6: (":", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9a-fA-F]{1,4}::?){3,7}[0-9a-fA-F]{1,4}(?![0-9A-Za-z:])")),
    SPELLED: ("dot", re.compile(r"[A-Za-z0-9._-]{1,64} ?[\[( ]at[\]) ] ?[A-Za-z0-9-]{1,64}(?: ?[\[( ]dot[\]) ] ?[A-Za-z0-9-]{1,64}){1,3}")),
}
# Words that stand near personal data or near plain numbers.
NEAR = re.compile(r"\b(?:tel|phone|call|fax|mobile|cell|telefon|handy|appel|llame|tfno|ssn|social|security|iban|account|konto|compte|cuenta|bank|ipv6|addr|address|host|mail|e-mail|email|contact|kontakt|contacto)\b", re.I)
PLAIN = re.compile(r"\b(?:version|order|invoice|isbn|page|chapter|date|price|total|build|item|serial|part|no|nr|year|eur|usd|sku|ratio|score|results?)\b|[$€£#]", re.I)


def _number_kinds(sizes: list[int], signs: str) -> list[int]:
    """What a stretch of digit groups of these sizes, with these signs between, could be."""
    n, out = sum(sizes), []
    if 7 <= n <= 15:
        out.append(PHONE_LIKE)
    if 13 <= n <= 19 and not signs.strip(" -"):
        out.append(CARD_LIKE)
    if len(sizes) == 4 and signs == "..." and max(sizes) <= 3:
        out.append(IP_LIKE)
    if sizes == [3, 2, 4] and signs == "--":
        out.append(SSN)
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all proposals; a run of n digit groups has at most 6 n stretches."""
    found = []
    for run in RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", run.group())]
        at = run.start()
        for i in range(len(groups)):
            start = at + groups[i][0]
            start -= text[start - 1 : start] == "("
            start -= text[start - 1 : start] == "+"
            for j in range(i, min(len(groups), i + 6)):
                end = at + groups[j][1]
                signs = "".join(text[at + a : at + b] for (_, a), (b, _) in zip(groups[i:j], groups[i + 1 : j + 1]))
                found += [(kind, start, end) for kind in _number_kinds([b - a for a, b in groups[i : j + 1]], signs)]
    for kind, (must, pattern) in PATTERNS.items():
        if not must or must in text:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return found


def _valid_account(span: str) -> bool:
    number = re.sub("[^A-Za-z0-9]", "", span[4:] + span[:4])
    return int("".join(str(int(c, 36)) for c in number)) % 97 == 1


def labels(text: str, found: list[tuple[int, int, int]]) -> list[int | None]:
    """Of each candidate whether a check says it is personal; None where none can say."""
    base = {(k, a, b) for k, a, b in base_spans(text)}
    same = {PHONE_LIKE: 3, CARD_LIKE: 2, IP_LIKE: 1}
    # Where a base pattern matches but its check fails, the whole is not personal, but a part may still be: no label there.
    failed = [(m.start(), m.end()) for p in (PHONE, CARD) for m in p.finditer(text) if not any((k, m.start(), m.end()) in base for k in (2, 3)) and m.end() - m.start() >= 10]
    out: list[int | None] = []
    for kind, a, b in found:
        if kind in same:
            good = (same[kind], a, b) in base
            out.append(1 if good else None if any(x < b and a < y and (x, y) != (a, b) for x, y in failed) else 0)
        else:
            out.append(int(_valid_account(text[a:b])) if kind == IBAN else None)
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format and context of a span; none of the checks that give the labels."""
    span = text[start:end]
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    groups = [len(g) for g in re.findall("[0-9]+", span)]
    digits = sum(groups)
    near, plain = [m.end() for m in NEAR.finditer(before)], [m.end() for m in PLAIN.finditer(before)]
    signs = [c for c in span if not c.isalnum()]
    close = re.search(r"[0-9)][ ./-]?\(?$", before)
    return [
        kind, end - start, digits, len(groups), max(groups, default=0), min(groups, default=0), len(set(signs)), len(set(span)) / max(1, len(span)),
        float(span[:1] == "0"), float(span[:1] == "+"), float(span[:1] == "("), float("(" in span), float("/" in span), float("." in span), float("-" in span), float(" " in span),
        float(before[-1:].isalnum() or before[-1:] in tuple(".,-/")), float(after[:1] in tuple("%/-") or after[:1].isalnum()), float(close is not None),
        float(re.match(r"[)]?[ ./-]?\(?[0-9]", after) is not None), 41 - (len(before) - near[-1]) if near else 0, 41 - (len(before) - plain[-1]) if plain else 0,
        float("::" in span), sum(c in "abcdefABCDEF" for c in span), float("(at)" in span or "[at]" in span), float(len(groups) == 3 and groups[0] == 4 and groups[1] <= 2),
        groups[0] if groups else 0, groups[-1] if groups else 0, float("+" in before[-24:]),
    ]


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, is personal, kind) of candidates in generated sentences whose personal spans are known."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("er", "an", "tion", "de", "ou", "sch", "ez", "ing")) for _ in range(r.randint(1, 3)))

    def iban():
        body = "".join(r.choice("0123456789" if r.random() < 0.8 else "ABCDEFGHIJ") for _ in range(r.choice((12, 14, 18, 20))))
        code = r.choice(("DE", "FR", "ES", "GB", "IT", "NL"))
        check = 98 - int("".join(str(int(c, 36)) for c in body + code + "00")) % 97
        text = f"{code}{check:02d}{body}"
        return " ".join(text[i : i + 4] for i in range(0, len(text), 4)) if r.random() < 0.5 else text

    hexes = lambda k: ":".join(f"{r.getrandbits(16):x}" for _ in range(k))
    own = [
        ("tel", lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}"), ("call", lambda: f"+{digits(2)} {digits(3)} {digits(4)}-{digits(3)}"), ("tel", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"), ("phone", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"), ("call", lambda: f"0{digits(3)} {digits(7)[:5]} {digits(3)}"), ("telefon", lambda: f"0{digits(2)}/{digits(4)} {digits(3)}"), ("mobile", lambda: f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"),
        ("ssn", lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"), ("iban", iban), ("account", iban), ("ipv6 address", lambda: hexes(8)), ("host", lambda: f"{hexes(4)}::{hexes(1)}"),
        ("mail", lambda: f"{word()} (at) {word()} (dot) com"), ("contact", lambda: f"{word()}.{word()} [at] {word()} [dot] org"), ("contact", lambda: f"{word()} at {word()} dot net"),
    ]
    other = [
        ("date", lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 31):02d}"), ("date", lambda: f"{r.randint(1, 31):02d}/{r.randint(1, 12):02d}/{r.randint(1900, 2030)}"), ("version", lambda: f"{digits(2)}.{digits(2)}.{digits(3)}"), ("price", lambda: f"{digits(3)}.{digits(2)}"), ("order", lambda: f"{digits(4)}-{digits(4)}"),
        ("part", lambda: f"{digits(5)}-{digits(2)}"), ("results", lambda: " ".join(digits(r.randint(2, 4)) for _ in range(r.randint(2, 5)))), ("isbn", lambda: f"978-{digits(2)}-{digits(4)}-{digits(3)}"), ("serial", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"), ("sku", lambda: "AB12" + "".join(r.choice("ABCDEFGH0123456789") for _ in range(12))),
        ("total", lambda: f"{digits(3)} {digits(3)} {digits(3)}"), ("score", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}:{digits(2)}"), ("", lambda: f"{word()} at {word()} dot {word()}ing the line"), ("", lambda: f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}"), ("", lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}"),
    ]
    rows, labels, kinds = [], [], []
    for _ in range(n):
        mine = r.random() < 0.5
        cue, make = r.choice(own if mine else other)
        cue = cue if r.random() < (0.75 if mine else 0.5) else ""
        head = f"{' '.join(word() for _ in range(r.randint(0, 6)))} {cue}{r.choice((': ', ' ', ' = ')) if cue else ' '}"
        span = make()
        text = f"{head}{span}{r.choice(('', '.', ',', ' ' + word(), ' ' + digits(r.randint(1, 12))))} {word()}"
        for kind, a, b in candidates(text):
            rows.append(features(text, kind, a, b))
            labels.append(mine and abs(a - len(head)) <= 1 and abs(b - len(head) - len(span)) <= 1)
            kinds.append(kind)
    return np.array(rows, float), np.array(labels, float), np.array(kinds)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _labelled(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, y, x) of the documents' candidates that have a label, at most ``PER_DOCUMENT`` of each document, spread over it."""

    def make():
        def work(texts):
            rows = []
            for t in texts:
                found = candidates(t or "")
                if found:
                    own = [(c, y) for c, y in zip(found, labels(t, found)) if y is not None]
                    rows += [(c[0], y, features(t, *c)) for c, y in own[:: -(-len(own) // PER_DOCUMENT) or 1]]
            cols = list(zip(*rows)) or [[], [], []]
            return pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.float64()))

        return work

    return per_row(docs.select(F.col(text_col).alias("text")), "kind int, y int, x array<double>", make)


def _collected(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    got = sorted((list(r.x), r.y, r.kind) for r in rows.collect())
    return np.array([x for x, _, _ in got], float).reshape(len(got), len(features("", SSN, 0, 0))), np.array([y for _, y, _ in got], float), np.array([k for _, _, k in got], np.int64)


def fitted(real: tuple, seed: int = 11, precise: float = 0.98) -> tuple[Boosted, dict[int, float]]:
    """Trees, and per kind the least calibrated probability at which examples not fitted are ``precise``; real: (features, label, kind)."""
    made = _examples(6000, seed)
    x, y, kinds = made if not len(real[1]) else tuple(np.concatenate(c) for c in zip(made, real))
    part = np.random.default_rng(seed).permutation(len(y)) % 4
    trees = Boosted().fit(x[part < 2], y[part < 2])
    trees.calibrate(x[part == 2], y[part == 2])
    p, y, kinds = trees.probability(x[part == 3]), y[part == 3], kinds[part == 3]
    least = {}
    for kind in range(len(BASE), len(KINDS)):
        own = kinds == kind
        good = [t for t in np.unique(p[own]) if t >= 0.5 and y[own & (p >= t)].mean() >= precise]
        least[kind] = float(min(good, default=2.0))
    return trees, least


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Boosted, dict[int, float]]:
    """Fits on the candidates of about ``sample`` documents that are not held out, drawn by a hash of id and text.

    The driver receives features of at most ``PER_DOCUMENT`` candidates of each. Without documents the generated examples alone are used.
    """
    rows = docs.where(~held_out(id_col)).where(F.col(text_col).rlike("[0-9]"))
    n = rows.count()
    draw = F.pmod(F.xxhash64(id_col, text_col, F.lit(9)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return fitted(_collected(_labelled(rows.where(draw < min(1.0, sample / max(1, n))), text_col)))


def quality(docs: DataFrame, trees: Boosted, least: dict[int, float], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict[str, tuple[float, float, int, int]]:
    """(precision, recall, positive candidates, candidates) of each kind among the candidates with a label of about ``sample`` held-out documents."""
    rows = docs.where(held_out(id_col))
    draw = F.pmod(F.xxhash64(id_col, text_col, F.lit(9)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    x, y, kinds = _collected(_labelled(rows.where(draw < min(1.0, sample / max(1, rows.count()))), text_col))
    taken = trees.probability(x) >= np.array([least.get(k, 2.0) for k in kinds.tolist()])
    ratio = lambda a, b: float(a / b) if b else 0.0
    return {KINDS[k]: (ratio((taken & (y == 1))[own].sum(), taken[own].sum()), ratio((taken & (y == 1))[own].sum(), y[own].sum()), int(y[own].sum()), int(own.sum())) for k in np.unique(kinds).tolist() for own in [kinds == k]}


def all_spans(text: str, trees: Boosted, least: dict[int, float]) -> tuple[list, list]:
    """(base spans, base and added spans), each by kind, then start."""
    base = base_spans(text)
    found = candidates(text)
    if found:
        taken = np.array(sorted((a, b) for _, a, b in base)).reshape(-1, 2)
        longest = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
        free = []
        for c in found:
            k = int(np.searchsorted(taken[:, 0], c[2]))
            if not k or longest[k - 1] <= c[1]:
                free.append(c)
        p = trees.probability(np.array([features(text, *c) for c in free], float).reshape(len(free), -1)) if free else []
        added, edge = [], -1
        ranked = sorted(((c, q) for c, q in zip(free, p) if q >= least[c[0]]), key=lambda x: (x[0][1], -x[1], x[0]))
        for c, q in ranked:
            if c[1] >= edge:
                added.append((c, q))
                edge = c[2]
            elif q > added[-1][1] and (len(added) < 2 or c[1] >= added[-2][0][2]):
                added[-1] = (c, q)
                edge = c[2]
        return base, sorted(base + [c for c, _ in added])
    return base, base


def listed(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[Boosted, dict[int, float]] | None = None) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    ``model`` is what ``learn`` returns; without one it is learned from ``docs``. n_added and n_spans count the added and all spans. Counts and base_sha256 are of the base spans, spans lists base and added ones; positions are code points. A
    null text counts as empty and has no span. Repeated rows are reported each; a null id stays null. Very long
    texts are searched whole. Other columns are ignored; an empty table gives an empty result.
    """
    trees, least = model or learn(docs, id_col, text_col)

    def make():
        def work(ids, texts):
            found = [all_spans(t or "", trees, least) for t in texts]
            counts = np.array([np.bincount([k for k, _, _ in b], minlength=4)[:4] for b, _ in found], np.int64).reshape(-1, 4)
            return ids, *counts.T.copy(), [hashlib.sha256(listed(b).encode()).hexdigest() for b, _ in found], [listed(s) for _, s in found], np.array([len(s) - len(b) for b, s in found], np.int64), np.array([len(s) for _, s in found], np.int64)

        return work

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return per_row(rows, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long", make).withColumnRenamed("id", id_col)
