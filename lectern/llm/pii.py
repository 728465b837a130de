"""Personal data: labelers vote on spans, EM weighs the labelers, a classifier decides.

Patterns, gazetteers and contexts propose and judge candidate spans.  A first pass writes every candidate's
votes and features; how often each combination of votes occurs is counted (their number is bounded by the
labelers, not by the data).  Expectation-maximisation on those counts estimates each
labeler's reliability and each kind's rate.  A logistic classifier of spans is then fitted to the
posteriors, on SAMPLE_SPANS spans of each kind at most: it sees the votes, the span itself (the shape and variety of its
characters, its length) and the words around it, so it also judges spans that labelers abstain from.  A second pass
applies it.  Matches of the four base patterns that pass their checks are always reported; the
classifier only adds spans.

Texts without a digit, an "@", a ":" or "=" and without a title hold no candidate; they are told by a
JVM expression and never reach Python.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "national_id", "person")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that could begin inside a run of digits also begins at its first digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key)['\"]?\x20?[:=]\x20?[\"']?([A-Za-z0-9_+/=.-]{8,})")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,128}(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9-])")
_PERSON = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20((?:[A-Z][a-z]{1,20}\x20)?[A-Z][a-z]{1,20})(?![A-Za-z])")

_KEY = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9])"
)
#: What every candidate needs somewhere in its text: an @, a digit, what a secret is set with, letters that may be a hash; or a key or a titled name,
#: which are only looked for where one of these beginnings stands.
AT_ONCE = "[0-9@=:]|[a-f]{32}"
WORTH_A_LOOK = "|".join([AT_ONCE, _KEY.pattern, _PERSON.pattern])
KEY_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "AIza", "eyJ")
TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Sr")

#: Gazetteers: given names, endings of mail domains, calling codes, lengths of IBANs by country.
GIVEN = frozenset(
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george edward "
    "ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel frank gregory raymond alexander patrick jack dennis peter "
    "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa margaret betty sandra ashley dorothy kimberly emily donna michelle carol amanda melissa "
    "deborah stephanie rebecca laura sharon cynthia kathleen amy angela anna ruth brenda pamela nicole katherine helen emma olivia noah liam sophia mia charlotte amelia "
    "hans klaus juergen wolfgang ursula petra sabine monika heike julia stefan andreas jean pierre michel philippe marie nathalie isabelle claire luc camille jose antonio manuel "
    "francisco juan carlos luis javier miguel carmen maria ana pilar isabel pablo sofia lucia".split()
)
DOMAINS = frozenset("com org net edu gov mil int info biz io co ai app dev me tv de fr es uk eu it nl be at ch pl se no dk fi ie pt gr cz hu ro ru ua tr us ca mx br ar cl au nz jp kr cn in sg hk za il".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98 212 213 234 254 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 966 971 972".split())
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "BA": 20, "BE": 16, "BG": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "KW": 30, "KZ": 20, "LB": 28,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29,
}
#: Words that announce a kind, and words that deny one.
ANNOUNCE = {
    "email": ("mail", "contact", "@"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "secret": ("token", "secret", "password", "key"),
    "iban": ("iban", "account", "bank"),
    "national_id": ("ssn", "social security", "national id"),
    "person": ("name", "dear", "contact"),
}
DENY = ("version", "isbn", "sha", "checksum", "commit", "order", "serial", "figure", "page", "$")
LABELERS = ("pattern", "check", "gazetteer", "before", "after", "shape")
LOOK = 24
#: Numbers that hashed features of a span fall into; spans of a kind that the classifier is fitted on, and how often a feature has to occur in them.
FEATURES, SAMPLE_SPANS, LEAST_SEEN = 1 << 13, 5_000, 5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return found


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the four base patterns: those that pass their checks, and those that fail."""
    good, bad = [], []
    if "@" in text:
        good += [("email", a, b) for a, b in emails(text)]
    if not re.search("[0-9]", text):
        return good, bad
    for m in _IP.finditer(text):
        ok = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
        (good if ok else bad).append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        n = sum(map(str.isdecimal, m[0]))
        if n > 9:
            (good if 13 <= n <= 19 and luhn(_digits(m[0])) else bad).append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            (good if 9 <= sum(map(str.isdecimal, m[0])) <= 15 else bad).append(("phone", *m.span()))
    return good, bad


def candidates(text: str) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """Candidate spans with a vote (1, 0 or -1) of every labeler; base matches among them."""
    good, bad = base_spans(text)
    spans = [(k, a, b, 1, 1) for k, a, b in good] + [(k, a, b, 1, -1) for k, a, b in bad]
    if "=" in text or ":" in text:
        spans += [("secret", *m.span(1), 1, 0) for m in _SECRET.finditer(text)]
    spans += [("secret", *m.span(), 1, 1) for m in _KEY.finditer(text) if not any(k == "secret" and a < m.end() and m.start() < b for k, a, b, _, _ in spans)]
    taken = {(a, b) for k, a, b, _, _ in spans if k == "secret"}
    spans += [("secret", *m.span(), 0, 0) for m in _HEX.finditer(text) if m.span() not in taken]
    if re.search("[0-9]", text):
        spans += [("iban", *m.span(), 1, 1 if mod97(m[0]) else -1) for m in _IBAN.finditer(text)]
        spans += [("national_id", *m.span(), 1, 1 if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000" else -1) for m in _NATIONAL.finditer(text)]
        inside = [(a, b) for k, a, b, _, _ in spans if k == "phone"]
        spans += [("phone", *m.span(), 0, 0) for m in _LOCAL_PHONE.finditer(text) if not any(a <= m.start() < b for a, b in inside)]
    spans += [("person", *m.span(1), 1, 0) for m in _PERSON.finditer(text)]
    return [(kind, a, b, (pattern, check, *_context(text, kind, a, b))) for kind, a, b, pattern, check in spans]


def _context(text: str, kind: str, start: int, end: int) -> tuple[int, int, int, int]:
    """Votes of the gazetteer, the words before, the words after, and the shape."""
    span, before, after = text[start:end], text[max(0, start - LOOK) : start].lower(), text[end : end + LOOK].lower()
    if kind == "email":
        listed = 1 if span.rpartition(".")[2].lower() in DOMAINS else 0
    elif kind == "person":
        listed = 1 if any(w.lower() in GIVEN for w in span.split()) else 0
    elif kind == "card":
        d = _digits(span)
        issued = d[0] == "4" or "51" <= d[:2] <= "55" or "2221" <= d[:4] <= "2720" or d[:2] in ("34", "35", "36", "37", "38", "65") or d[:4] == "6011"
        listed = 1 if issued else -1
    elif kind == "phone" and span[0] == "+":
        d = _digits(span)
        listed = 1 if any(d[:k] in CALLING for k in (1, 2, 3)) else -1
    elif kind == "iban":
        size = IBAN_SIZES.get(span[:2])
        listed = -1 if size is None else 1 if len(span.replace(" ", "")) == size else 0
    elif kind == "ip":
        listed = -1 if span.startswith("0") or any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else 0
    else:
        listed = 0
    told = 1 if any(w in before for w in ANNOUNCE[kind]) else -1 if any(w in before for w in DENY) else 0
    follows = -1 if after[:1] in ("%", "€") or after[:2] in (" %", " €") else 0
    if kind == "secret":
        variety = len(set(span)) / min(len(span), 24)
        mixed = bool(re.search("[0-9]", span)) and bool(re.search("[A-Za-z]", span))
        shape = 1 if mixed and variety > 0.4 else -1
    elif kind in ("card", "iban", "national_id"):
        shape = -1 if len(set(_digits(span))) < 3 else 0
    else:
        shape = 0
    return listed, told, follows, shape


def expectation_maximisation(kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each combination, rates by kind, and P(vote | class) by labeler.

    kinds are indices, votes -1, 0 or 1 in (combination, labeler), counts how often each
    occurs.  Starts from the majority of the votes; counts are smoothed so that nothing is certain.
    Base matches that pass their checks anchor the classes: they are true throughout.
    """
    sure = (kinds < len(BASE)) & (votes[:, 0] == 1) & (votes[:, 1] == 1)
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    posterior = np.where(sure, 1.0, 1 / (1 + np.exp(-1.5 * votes.sum(axis=1))))
    # What is believed of labelers beforehand: assent is likelier for true spans, dissent for false ones.
    prior = np.array([[3.0, 5.0, 2.0], [0.5, 5.0, 4.5]])
    rate, reliability = np.zeros(len(KINDS)), np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        table = np.einsum("cn,nlv->lcv", weight, one_hot) + prior
        reliability = table / table.sum(axis=2, keepdims=True)
        for k in range(len(KINDS)):
            own = kinds == k
            rate[k] = (weight[1, own].sum() + 1) / (weight[:, own].sum() + 2)
        logs = np.einsum("nlv,lcv->cn", one_hot, np.log(reliability))
        odds = logs[1] - logs[0] + np.log(rate[kinds] / (1 - rate[kinds]))
        fresh = np.where(sure, 1.0, 1 / (1 + np.exp(-np.clip(odds, -30, 30))))
        if np.abs(fresh - posterior).max() < 1e-9:
            posterior = fresh
            break
        posterior = fresh
    return posterior, rate, reliability


_RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]")
_TOKENS = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]")


def span_features(kind: str, text: str, start: int, end: int, votes: tuple[int, ...]) -> list[int]:
    """Numbers of what is seen of a span: its kind, votes, shape, length, variety, and the words around it."""
    span = text[start:end]
    kinds = {"A": "A", "a": "a", "0": "0", " ": " "}
    shape = "".join(kinds["A" if r[0].isupper() and r[0].isascii() else "a" if r[0].islower() and r[0].isascii() else "0" if r[0].isdigit() else " "] if r[0].isalnum() and r[0].isascii() or r[0].isspace() else r for r in _RUNS.findall(span[:64]))
    token = lambda t: "0" if t[0].isdigit() else t.lower()[:12]
    before = [token(t) for t in _TOKENS.findall(text[max(0, start - LOOK) : start])[-2:]]
    after = [token(t) for t in _TOKENS.findall(text[end : end + LOOK])[:1]]
    seen = ["kind", f"size{min(len(span), 64).bit_length()}", f"shape{shape[:24]}", f"variety{int(8 * len(set(span)) / min(len(span), 24))}"]
    seen += [f"vote{k}{v}" for k, v in enumerate(votes) if v]
    seen += [f"before{k}{t}" for k, t in enumerate(reversed(before))] + [f"after{t}" for t in after]
    return [zlib.crc32(f"{kind} {x}".encode()) % FEATURES for x in seen]


def fit_classifier(features: list[list[int]], posterior: np.ndarray, decay: float = 1e-3, rounds: int = 300, rate: float = 0.1) -> np.ndarray:
    """Logistic regression on soft labels, by Adam; features that are rare among the spans have no weight."""
    if not features:
        return np.zeros(FEATURES)
    flat, row = np.concatenate([np.array(f, np.int64) for f in features]), np.repeat(np.arange(len(features)), [len(f) for f in features])
    common = np.bincount(flat, minlength=FEATURES) >= min(LEAST_SEEN, len(features))
    keep = common[flat]
    flat, row = flat[keep], row[keep]
    b, m, v = np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(FEATURES)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, b[flat], len(features)), -30, 30)))
        slope = np.bincount(flat, (posterior - p)[row], FEATURES) / len(features) - decay * b
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        b = b + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return np.where(common, b, 0)


def _bodies(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    holds = lambda heads: reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in heads])
    worth = text.rlike(AT_ONCE) | (holds(KEY_HEADS) & text.rlike(_KEY.pattern)) | (holds(TITLES) & text.rlike(_PERSON.pattern))
    return docs.select(F.col(id_column).cast("long").alias("id"), F.when(worth, text).alias("body"))


def train_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> np.ndarray:
    """Weights of the span classifier, from the votes on all candidates of all texts.

    Null texts and those without candidates give none; without any candidate all weights are zero.  Repeated rows count as often
    as they stand there.
    """

    def propose(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                for kind, a, b, votes in candidates(text) if text else ():
                    rows.append((KINDS.index(kind), votes, span_features(kind, text, a, b, votes), zlib.crc32(text[max(0, a - LOOK) : b + LOOK].encode()) / 2**32))
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["kind", "votes", "features", "draw"])

    rows = materialize(_bodies(docs, id_column, text_column).mapInArrow(propose, "kind int, votes array<int>, features array<int>, draw double"), "pii-candidates")
    found = rows.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()  # combinations of votes: at most 8 * 3 ** 6
    if not found:
        return np.zeros(FEATURES)
    kinds, votes, counts = np.array([r.kind for r in found]), np.array([r.votes for r in found]), np.array([r.n for r in found])
    posterior, _, _ = expectation_maximisation(kinds, votes, counts)
    believed = {(k, *v): p for k, v, p in zip(kinds.tolist(), votes.tolist(), posterior.tolist(), strict=True)}
    # Of each kind the spans whose draw, a hash of what stands there, is low enough: some SAMPLE_SPANS in all.
    total = np.bincount(kinds, counts, len(KINDS))
    rates = F.array(*[F.lit(float(min(1.0, SAMPLE_SPANS / max(n, 1)))) for n in total])
    sample = rows.where(F.col("draw") <= F.get(rates, F.col("kind"))).orderBy("draw", "kind", "votes", "features").limit(2 * SAMPLE_SPANS * len(KINDS)).collect()
    return fit_classifier([r.features for r in sample], np.array([believed[r.kind, *r.votes] for r in sample]))


def _shown(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (KINDS.index(s[0]), *s[1:])))


def decide(text: str, weights: np.ndarray, threshold: float = 0.5) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans of a text, and the spans that the classifier adds."""
    base, added = [], []
    for kind, a, b, votes in candidates(text):
        if kind in BASE and votes[:2] == (1, 1):
            base.append((kind, a, b))
        elif 1 / (1 + np.exp(-weights[span_features(kind, text, a, b, votes)].sum())) > threshold:
            added.append((kind, a, b))
    return base, added


def find_pii(docs: DataFrame, weights: np.ndarray, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans (all spans).

    Offsets are code points, ends exclusive.  Null text is empty and has no spans (the
    digest is that of the empty string).  Very long texts are searched whole; patterns take time in proportion.  Rows are
    independent: repeated rows, null ids and extra columns change nothing; an empty table gives an empty result.
    """
    names = ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"]
    nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)
    kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())

    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                base, added = decide(text, weights, threshold) if text else ([], [])
                if not base and not added:
                    found.append(nothing)
                    continue
                every = set(base + added)
                found.append((*(sum(k == kind for k, _, _ in base) for kind in BASE), hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(every), len(every)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)]], names=names)

    return _bodies(docs, id_column, text_column).mapInArrow(run, "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
