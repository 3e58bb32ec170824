"""Personal data: fixed patterns, and candidates that boosted trees accept.

Generators propose overlapping spans with high recall: runs of numbers by groups, spelled-out addresses, account numbers,
dates, addresses of version 6. Trees boosted on labelled candidates, made here from templates in four languages, judge each by its
format (digits, groups, marks, checksums) and its context (words before and after). Scores are calibrated on examples of
their own, and each kind has the lowest threshold that keeps its precision there. Of overlapping candidates the best stays.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Kinds in the order in which spans are listed; the first four have fixed patterns.
KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "birth_date")
BASE = 4
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]+")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is looked at once: before it stands a run that no match has taken, after it a domain."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the fixed patterns find, by kind and start; time is linear in the text."""
    out = [(0, s, e) for s, e in _emails(text)]
    if "." in text:
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _only_digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m.group())) <= 15]
    return out


_RUN = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9])++")
_AT = re.compile(r"\x20?[(\[{]at[)\]}]\x20?|\x20at\x20", re.IGNORECASE)
_BEFORE_AT = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,63}){1,4}", re.IGNORECASE)
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_DATE = re.compile(r"([0-9]{1,2})([./-])([0-9]{1,2})\2([0-9]{4})|([0-9]{4})-([0-9]{2})-([0-9]{2})")


def _day(s: str) -> bool:
    m = _DATE.fullmatch(s)
    if not m:
        return False
    a, b, year = (int(m[1]), int(m[3]), int(m[4])) if m[1] else (int(m[6]), int(m[7]), int(m[5]))
    return 1 <= a <= 31 and 1 <= b <= 31 and min(a, b) <= 12 and 1900 <= year <= 2099


def proposals(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, start and end of the run that it is cut from) of all candidates; they overlap.

    Of a run of number groups each stretch of up to eight is looked at, so their number is linear in the text.
    """
    out = []
    for run in _RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [(m.start(), m.end()) for m in _DIGITS.finditer(text, run.start(), run.end())]
        for i in range(len(groups)):
            n = 0
            for j in range(i, min(len(groups), i + 8)):
                n += groups[j][1] - groups[j][0]
                start, end = groups[i][0], groups[j][1]
                if n > 19:
                    break
                if i == 0 and text[run.start()] in "+(":
                    start = run.start()
                elif text[start - 1 : start] == "(" and ")" in text[start:end]:
                    start -= 1
                own = (start, end, run.start(), run.end())
                whole = text[start:end]
                if 13 <= n <= 19 and whole[0] in "23456" and luhn(_only_digits(whole)):
                    out.append((2, *own))
                if 7 <= n <= 15:
                    out.append((3, *own))
                if n == 9 and j - i == 2:
                    out.append((5, *own))
                if j - i == 2 and _day(whole):
                    out.append((6, *own))
    for m in _AT.finditer(text):
        before = _BEFORE_AT.search(text[max(0, m.start() - 64) : m.start()])
        after = _AFTER_AT.match(text, m.end())
        if before and after:
            start = m.start() - len(before.group())
            out.append((0, start, after.end(), start, after.end()))
    out += [(4, m.start(), m.end(), m.start(), m.end()) for m in _IBAN.finditer(text)]
    if ":" in text:
        out += [(1, m.start(), m.end(), m.start(), m.end()) for m in _IP6.finditer(text)]
    return out


#: Words that speak for a kind, and words that speak for other numbers; fixed values.
_FOR = {
    0: "email mail e-mail contact write courriel correo kontakt reach adresse escriba",
    1: "ip ipv6 address host server client adresse login from dirección",
    2: "card visa mastercard amex credit debit karte kreditkarte carte tarjeta payment pay paid crédito cvv",
    3: "phone tel telephone call mobile cell fax telefon handy anruf rufen ruf téléphone portable appelez appeler teléfono móvil llame llamar contact whatsapp sms number nummer numéro número",
    4: "iban account konto kontonummer compte cuenta bank bic virement überweisung transfer",
    5: "ssn social security tax insurance id passport identity sozialversicherung sécurité seguridad dni",
    6: "born birth birthday dob geboren geburtsdatum geb né née naissance nacido nacida nacimiento age",
}
_AGAINST = "order invoice isbn issn version release price total amount pages page article item sku tracking reference ref serial model build part ticket bestellung rechnung commande facture pedido factura artikel published updated deadline due time range section figure table population"
_FOR = {k: frozenset(v.split()) for k, v in _FOR.items()}
_AGAINST = frozenset(_AGAINST.split())
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")
FEATURES = 28


def features(text: str, kind: int, start: int, end: int, run_start: int, run_end: int) -> list[float]:
    """What the trees see of a candidate."""
    s = text[start:end]
    digits = _only_digits(s)
    groups = [len(g) for g in _DIGITS.findall(s)] or [0]
    before = _WORD.findall(text[max(0, start - 48) : start].lower())[::-1]
    after = _WORD.findall(text[end : end + 24].lower())
    near = lambda words, known: next((1 / (1 + i) for i, w in enumerate(words) if w in known), 0.0)
    number = int(_only_digits("".join(str(ord(c) - 55) if c.isalpha() else c for c in s[4:] + s[:4])) or 0) if kind == 4 else 0
    marks = [c for c in s if not c.isalnum()]
    return [
        *(float(kind == k) for k in range(len(KINDS))), float(len(digits)), float(len(groups)), float(max(groups)), float(min(groups)), float(groups[0]), float(s.count("-")), float(s.count(" ")), float(s.count(".")), float(s.count("/")), float(s[0] == "("),
        float(digits[:1] == "0"), float(kind == 2 or luhn(digits)) if digits else 0.0, float(number % 97 == 1), float((start, end) == (run_start, run_end)), float(len(set(marks))), len(set(digits)) / max(1, len(digits)),
        near(before, _FOR[kind]), near(after, _FOR[kind]), near(before, _AGAINST), near(after[:2], _AGAINST), float(text[start - 1 : start] in tuple("#$€£") or text[end : end + 1] in tuple("%€$£") and end < len(text)),
    ]


class Boosted:
    """Trees of three levels, boosted for logistic loss over quantile bins, and a logistic calibration of their sum."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, rate: float = 0.25, least: int = 8, depth: int = 3):
        self.rate, self.depth, self.trees, self.scale = rate, depth, [], (1.0, 0.0)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
        score = np.zeros(len(y))
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node, split = np.zeros(len(y), np.int64), []
            for level in range(depth):
                chosen = [self._best(binned, edges, g, h, node == n, least) for n in range(2**level)]
                split.append(chosen)
                right = np.zeros(len(y), bool)
                for n, (f, edge) in enumerate(chosen):
                    at = node == n
                    right[at] = x[at, f] > edge
                node = node * 2 + right
            sums = [np.bincount(node, w, 2**depth) for w in (g, h)]
            values = sums[0] / (sums[1] + 1.0)
            self.trees.append((split, values))
            score += rate * values[node]

    @staticmethod
    def _best(binned, edges, g, h, at, least) -> tuple[int, float]:
        best, out = 1e-9, (0, np.inf)
        rows, gs, hs = binned[at], g[at], h[at]
        for f, e in enumerate(edges):
            if len(e) < 1 or len(rows) < 2 * least:
                continue
            sums = [np.cumsum(np.bincount(rows[:, f], w, len(e) + 1))[:-1] for w in (gs, hs, None)]
            all_g, all_h, n = gs.sum(), hs.sum(), len(rows)
            gain = sums[0] ** 2 / (sums[1] + 1) + (all_g - sums[0]) ** 2 / (all_h - sums[1] + 1) - all_g**2 / (all_h + 1)
            gain[(sums[2] < least) | (n - sums[2] < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, out = gain[k], (f, float(e[k]))
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.zeros(len(x))
        for split, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for chosen in split:
                f, edge = np.array([c[0] for c in chosen]), np.array([c[1] for c in chosen])
                node = node * 2 + (x[np.arange(len(x)), f[node]] > edge[node])
            score += self.rate * values[node]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Scale and shift of the sum, by Newton steps on examples that the trees were not grown on."""
        s, w = self.raw(x), np.array([1.0, 0.0])
        a = np.stack([s, np.ones(len(s))], 1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-a @ w))
            w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * (w - [1, 0]))
        self.scale = (float(w[0]), float(w[1]))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * self.raw(x) + self.scale[1])))


#: Templates of labelled examples; {} is the place of what is labelled, fixed values.
_PHRASES = {
    0: ["you can write to {} at any time", "email: {}", "Kontakt: {} oder im Büro", "courriel {} pour toute question", "correo: {}", "mail me, {} works"],
    1: ["login from {} was refused", "the server at {} answered", "IP {}", "adresse ip {} bloquée", "host {} is down"],
    2: ["card {} exp 09/27", "paid with visa {} today", "Kreditkarte {}", "carte {} refusée", "tarjeta {} caducada"],
    3: ["call me on {} tomorrow", "Tel. {}", "Telefon: {}", "phone {} or fax", "téléphone : {} le soir", "appelez le {}", "mi teléfono es {}", "mobile {}", "contact us, {} from nine", "llame al {} hoy", "Handy {} abends"],
    4: ["IBAN {}", "bank account {} in our name", "Konto {} bei der Bank", "virement au compte {}", "cuenta {} del banco", "{}"],
    5: ["SSN {}", "social security number {} on file", "his ssn is {}", "tax id {}"],
    6: ["born on {} in", "date of birth: {}", "DOB {}", "geboren am {} in", "né le {} à", "nacida el {} en", "Geburtsdatum: {}"],
}
_OTHER = [
    "order {} was sent", "invoice {} is due", "ISBN {}", "version {} is out", "the price is {} in all", "pages {} to the end", "article {}", "tracking {} from the shop", "reference {} in the table", "Rechnung {} vom", "facture {} du mois",
    "pedido {} enviado", "the meeting on {} was short", "published {} by", "between {} and later", "total {}", "serial {} of the model", "it ran for {} steps", "seen at {} again", "{}", "and {} the of", "in {} le de", "ticket {} closed", "updated {}", "ratio {} holds", "room {} upstairs",
]
_FILL = "the of and in to is that for on with by from le la des un et les der die und das nicht el los una para con tion ment ung erin ouble anted warm river stone letter wind".split()


def _number(rng: np.random.Generator, shape: str) -> str:
    return "".join(str(rng.integers(10)) if c == "9" else str(rng.integers(1, 10)) if c == "8" else c for c in shape)


def _checked(rng: np.random.Generator, n: int) -> str:
    body = rng.choice(["4", "51", "55", "34", "37", "6011"]) + "".join(map(str, rng.integers(0, 10, n)))
    body = body[: n - 1]
    return next(body + d for d in "0123456789" if luhn(body + d))


def _spaced(s: str, by: int, mark: str) -> str:
    return mark.join(s[i : i + by] for i in range(0, len(s), by))


def _made(rng: np.random.Generator, kind: int) -> str:
    """A string of a kind that no fixed pattern finds."""
    if kind == 0:
        name, host = _number(rng, str(rng.choice(["anna.kel99", "j.doe", "info", "m_berg9", "luis99"]))), rng.choice(["example", "mail9", "post-box", "corp"])
        at, dot = rng.choice([" at ", " (at) ", "[at]", "(at)", " [at] "]), rng.choice([" dot ", ".", "[dot]", " (dot) "])
        at, dot = (at, " dot ") if at == " at " else (at, dot)
        return f"{name}{at}{_number(rng, host)}{dot}{rng.choice(['com', 'org', 'de', 'fr'])}"
    if kind == 1:
        parts = [f"{rng.integers(65536):x}" for _ in range(8)]
        return ":".join(parts) if rng.random() < 0.5 else ":".join(parts[:3]) + "::" + ":".join(parts[4 : 5 + rng.integers(3)])
    if kind == 2:
        s = _checked(rng, int(rng.choice([13, 15, 16, 16, 16])))
        return _spaced(s, 4, str(rng.choice([" ", "-", ""]))) if len(s) != 13 and rng.random() < 0.7 else s + (" " + s if rng.random() < 0.5 else "")
    if kind == 3:
        return _number(rng, str(rng.choice(["(899) 899-9999", "899-899-9999", "899.899.9999", "0899 8999999", "0899/8999999", "089 8999 9999", "08 89 99 99 99", "0899 89 99 99", "899 89 99 99", "(089) 8999 9999", "899 9999"])))
    if kind == 4:
        country, n = (("DE", 18), ("FR", 23), ("ES", 20), ("GB", 18), ("NL", 14))[rng.integers(5)]
        body = "".join(map(str, rng.integers(0, 10, n)))
        check = 98 - int("".join(str(ord(c) - 55) for c in country).join([body, "00"])) % 97
        return _spaced(f"{country}{check:02d}{body}", 4, " ") if rng.random() < 0.6 else f"{country}{check:02d}{body}"
    if kind == 5:
        return _number(rng, "899-89-9999")
    day, month, year = rng.integers(1, 29), rng.integers(1, 13), rng.integers(1930, 2011)
    return [f"{day}.{month}.{year}", f"{month:02d}/{day:02d}/{year}", f"{year}-{month:02d}-{day:02d}", f"{day:02d}-{month:02d}-{year}"][rng.integers(4)]


def _unlike(rng: np.random.Generator) -> str:
    """A number, date or mark that is nobody's."""
    if rng.random() < 0.1:  # a tenth of all numbers have a right check digit
        s = _checked(rng, 16)
        return s if rng.random() < 0.5 else _spaced(s, 4, " ")
    shape = rng.choice(["8999999", "89999999", "899999999999", "899-9-89-899999-9", "8999 8999", "8.99.9", "899,999", "8999-8999", "99:99:99", "9:9", "8 999 999", "89 999 999", "899 999 999 999", "8999999999999999", "8999 9999 9999 9999", "89999-99", "899/999/99", "8/99/9999999", "899-99-9999", "899.899.999", "88 89 88 89 89 88", "8999 8999 8999"])
    return _number(rng, str(shape)) if rng.random() < 0.75 else str(rng.choice([_made(rng, 6), "me at example.com", "look at www.example.org", "AB12 CDEF GHIJ KLMN", "std::vector::at", "GB99 NORTH WIND 2020 EAST"]))


def examples(rng: np.random.Generator, n: int) -> Iterator[tuple[str, int | None, int, int]]:
    """Text, kind, start and end of what it holds; kind is None where it holds nothing personal."""
    for _ in range(n):
        kind = int(rng.integers(2 * len(KINDS)))
        kind = kind if kind < len(KINDS) else None
        own = _made(rng, kind) if kind is not None else _unlike(rng)
        frames = _OTHER if kind is None else _PHRASES[kind]
        head, tail = (" ".join(rng.choice(_FILL, rng.integers(1, 9))) for _ in range(2))
        frame = frames[rng.integers(len(frames))]
        start = len(head) + 1 + frame.index("{}")
        end = start + len(own)
        if kind == 2 and (half := own.split(" ")) and len(half) == 2 and half[0] == half[1]:
            end = start + len(half[0])
        yield f"{head} {frame.format(own)} {tail}", kind, start, end


def _labelled(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of the candidates of ``n`` examples."""
    x, y, kinds = [], [], []
    for text, kind, start, end in examples(rng, n):
        twice = text[start:end] + " " + text[start:end]
        gold = {(kind, start, end)} | ({(kind, end + 1, 2 * end - start + 1)} if text.startswith(twice, start) else set())
        for c in proposals(text):
            x.append(features(text, *c))
            y.append(float(c[:3] in gold))
            kinds.append(c[0])
    return np.array(x), np.array(y), np.array(kinds)


@lru_cache(maxsize=2)
def trained(seed: int = 5, sample: int = 5000, precision: float = 0.98) -> tuple[Boosted, tuple[float, ...]]:
    """The trees, grown on ``sample`` made-up examples, and each kind's threshold, from as many others."""
    rng = np.random.default_rng(seed)
    x, y, _ = _labelled(rng, sample)
    model = Boosted(x, y)
    x, y, kinds = _labelled(rng, sample)
    model.calibrate(x, y)
    p, out = model(x), []
    for k in range(len(KINDS)):
        order = np.argsort(-p[kinds == k], kind="stable")
        score, good = p[kinds == k][order], np.cumsum(y[kinds == k][order])
        fine = np.flatnonzero(good / np.arange(1, len(good) + 1) >= precision) if len(good) else []
        out.append(max(0.5, float(score[fine[-1]])) if len(fine) else 2.0)
    return model, tuple(out)


def more_spans(text: str, base: list[tuple[int, int, int]], model: Boosted, thresholds: tuple[float, ...]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of accepted candidates: the best first, longer and earlier ones of equal score, without overlap among them or with ``base``."""
    found = proposals(text)
    if not found:
        return []
    p = model(np.array([features(text, *c) for c in found]))
    taken = sorted((s, e) for _, s, e in base)
    # Base spans of different kinds may overlap: the furthest end so far bounds them all.
    starts, ends, far = [s for s, _ in taken], [], 0
    for _, e in taken:
        far = max(far, e)
        ends.append(far)
    kept: list[tuple[int, int]] = []
    out = []
    for i in sorted(range(len(found)), key=lambda i: (-p[i], found[i][1] - found[i][2], found[i][1], found[i][0])):
        kind, start, end = found[i][:3]
        if p[i] < thresholds[kind]:
            continue
        k = bisect.bisect_left(starts, end)
        if k and ends[k - 1] > start:
            continue
        k = bisect.bisect_left(kept, (end,))
        if k and kept[k - 1][1] > start:
            continue
        bisect.insort(kept, (start, end))
        out.append((kind, start, end))
    return out


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, found (array of kind, start, end, base), and the columns named in ``keep``, for each row.

    Positions are code points of the whole text, ends exclusive; ``found`` is by kind in KINDS order, then start; base marks
    what a fixed pattern found. A null or empty text has no span; repeated rows get equal spans; other columns are left
    out. There is no shuffle, and the trees are trained once, on the driver, from made-up examples alone.
    """
    bounded_batches(docs.sparkSession)
    model, thresholds = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                base = base_spans(text) if text else []
                more = more_spans(text, base, model, thresholds) if text else []
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, kind)], [*batch.schema.names[1:], "found"])

    first = [c for c in docs.columns if c in ("doc_id", *keep)]
    base = docs.select(F.col("text").cast("string").alias("__text"), *first)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[1:])
    return base.mapInArrow(run, f"{kinds}, found array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts and a hash of what the fixed patterns found, the number of further spans, and all spans as text, beside doc_id."""
    base = F.filter("found", lambda s: s["base"])
    count = lambda k: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    more = F.size(F.filter("found", lambda s: ~s["base"])).cast("long").alias("n_more")
    return found.select("doc_id", *map(count, KINDS[:BASE]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), more)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in text replaced by a mark of its kind, and n_chars, if there is one, counted again.

    Overlapping spans are one, of the first one's kind. All rows stay; texts without personal data and null texts are unchanged.
    """
    bounded_batches(docs.sparkSession)
    model, thresholds = trained()

    def clean(text: str | None) -> str | None:
        base = base_spans(text) if text else []
        spans = sorted((s, e, k) for k, s, e in base + more_spans(text, base, model, thresholds)) if text else []
        out, at = [], 0
        for s, e, k in spans:
            if e > at:
                if s >= at:
                    out += [text[at:s], f"<{KINDS[k]}>"]
                at = e
        return "".join([*out, text[at:]]) if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
