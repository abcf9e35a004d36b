"""Personal data by weak supervision.

One scan of the whole texts finds the base spans (email, ip, card, phone by fixed rules) and
looser candidates: addresses with "at" and "dot", local phone numbers, other card lengths and
unchecked card numbers, secrets after a key word, and known first names with a second name.
Labelers vote on each candidate (yes, no or nothing): its form, its check (Luhn, ranges,
counts), gazetteers (top-level domains, issuer and country prefixes, names), the words before
it, and its edges.

Votes of all documents are counted by pattern; there are a few thousand patterns at most,
whatever the input.  Expectation-maximisation over these counts estimates each labeler's
reliability and each pattern's probability.  On these soft labels a logistic classifier of
spans is trained, over a sample of spans of stated size drawn by hash; besides the votes it
sees marks of the span and the words beside it, on which no labeler votes, so it tells apart
spans that the labelers can't.  It decides on all candidates.  Base spans stay.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ["email", "ip", "card", "phone", "secret", "name"]
LABELERS = ["form", "check", "gazetteer", "context", "edges"]
YES, NO, NONE = "1", "0", "-"

# Gazetteers and key words of the labelers.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu us ca au jp cn in br ru ch se no fi dk pl pt at be".split())
FIRST_NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah "
    "Charles Karen Christopher Nancy Daniel Lisa Matthew Margaret Anthony Betty Mark Sandra Donald Ashley Steven Kimberly Paul Emily "
    "Andrew Donna Joshua Michelle Hans Peter Klaus Ursula Jean Marie Pierre Sophie Juan Carmen Antonio Isabel".split()
)
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38")
PHONE_PREFIXES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "82", "86", "91")
CUES = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "master", "credit", "pay"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell"),
    "secret": ("key", "token", "password", "secret"),
    "name": ("name", "mr", "mrs", "ms", "dr", "dear"),
}
AGAINST = ("version", "isbn", "order", "item", "figure", "section", "page", "part no")

_DIGIT = re.compile(r"[0-9]")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_MAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{1,63})+", re.I)
_LOOSE_PHONE = re.compile(r"(?<![\w+])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])")
_AT = re.compile(r"[\[(]at[\])]", re.I)
_SECRET = re.compile(r"""(?i:token|password|passwd|api_?key|secret)["']?\s{0,3}[=:]\s{0,3}["']?([A-Za-z0-9_+/=-]{8,})""")
_SECRET_WORD = re.compile(r"[=:]")
_LAST_WORD, _NEXT_WORD = re.compile(r"(\w+)\W*\Z"), re.compile(r"\W*(\w+)")

#: Bins of the words beside a span, and spans that the classifier is fitted on: about so many.
BINS, FIT_SPANS = 64, 30_000
MARKS = ["log_length", "digits", "upper", "other", "distinct", "vowels", "runs", "line_start", "quoted"]


@dataclass(frozen=True)
class Gazetteers:
    """Tables of the gazetteer labeler; give larger ones where they are at hand."""

    first_names: frozenset[str] = FIRST_NAMES
    top_domains: frozenset[str] = TOP_DOMAINS
    card_prefixes: tuple[str, ...] = CARD_PREFIXES
    phone_prefixes: tuple[str, ...] = PHONE_PREFIXES

    @cached_property
    def name(self) -> re.Pattern:
        return re.compile(rf"\b(?:{'|'.join(map(re.escape, sorted(self.first_names)))}) [A-Z][a-z]+\b") if self.first_names else re.compile(r"(?!)")


DEFAULT = Gazetteers()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Start and end of the base spans by kind, leftmost and non-overlapping, in linear time."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS[:4]}
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL_BACK.match(text, start - 1, start):
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, after)):
            out["email"].append((start, m.end()))
            done = after = m.end()
        elif start < at:
            done = max(done, start)
        at = text.find("@", after)
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(_small(p) for p in m.group().split("."))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and _is_card(m.group())]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _is_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def candidates(text: str, base: dict[str, list[tuple[int, int]]], known: Gazetteers = DEFAULT) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, is base) of all spans to judge; loose ones never touch a base span."""
    out = [(k, a, z, True) for k in KINDS[:4] for a, z in base[k]]
    taken = sorted((a, z) for _, a, z, _ in out)
    starts, reach = [a for a, _ in taken], list(accumulate((z for _, z in taken), max))

    def put(kind: str, a: int, z: int) -> None:
        before = bisect_left(starts, z)  # base spans that start before this one ends
        if not before or reach[before - 1] <= a:
            out.append((kind, a, z, False))

    if _AT.search(text):
        for m in _LOOSE_MAIL.finditer(text):
            put("email", *m.span())
    if _DIGIT.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= sum(map(str.isdigit, m.group())) <= 19:
                put("card", *m.span())
        for m in _LOOSE_PHONE.finditer(text):
            put("phone", *m.span())
    if _SECRET_WORD.search(text):
        for m in _SECRET.finditer(text):
            put("secret", *m.span(1))
    for m in known.name.finditer(text):
        put("name", *m.span())
    return out


def pattern(text: str, kind: str, a: int, z: int, base: bool, known: Gazetteers = DEFAULT) -> str:
    """Kind, the labelers' votes in the order of LABELERS, and a length class."""
    span = text[a:z]
    digits = "".join(c for c in span if "0" <= c <= "9")
    form, check, gazetteer = YES if base else NO, NONE, NONE
    if kind == "email":
        check = YES if base else NO
        gazetteer = YES if re.split(r"[^A-Za-z0-9]+", span.rstrip("])"))[-1].lower() in known.top_domains else NO
    elif kind == "ip":
        check = YES
        gazetteer = NO if span.split(".")[0].lstrip("0") in ("", "127") else NONE
    elif kind == "card":
        check = YES if luhn(digits) else NO
        gazetteer = YES if digits.startswith(known.card_prefixes) else NO
    elif kind == "phone":
        check = YES if 8 <= len(digits) <= 15 else NO
        gazetteer = YES if base and digits.startswith(known.phone_prefixes) else NONE
    elif kind == "secret":
        form = YES if re.fullmatch(r"[0-9a-f]{16,}|[A-Za-z0-9_+/=-]{20,}", span) else NONE
        check = YES if len(set(span)) >= 8 and digits and len(span) >= 12 else NO
    else:
        form, gazetteer = NONE, YES
    before = text[max(0, a - 40) : a].lower()
    context = YES if any(c in before for c in CUES[kind]) else NO if any(c in before for c in AGAINST) else NONE
    edges = NO if (a and text[a - 1].isalnum()) or (z < len(text) and text[z].isalnum()) else YES
    size = "s" if z - a < 12 else "m" if z - a < 24 else "l"
    return f"{kind}|{form}{check}{gazetteer}{context}{edges}|{size}"


def marks(text: str, a: int, z: int) -> tuple[list[float], int, int]:
    """The marks of a span as named in MARKS, and the bins of the words before and after it."""
    span = text[a:z]
    n, letters = len(span), sum(map(str.isalpha, span))
    before, after = text[max(0, a - 24) : a], text[z : z + 24]
    bin_of = lambda m: zlib.crc32(m.group(1).lower().encode("utf-8", "replace")) % BINS if m else 0
    return (
        [
            float(np.log1p(n)),
            sum("0" <= c <= "9" for c in span) / n,
            sum(map(str.isupper, span)) / n,
            sum(not c.isalnum() for c in span) / n,
            len(set(span)) / n,
            sum(c in "aeiouAEIOU" for c in span) / max(1, letters),
            float(np.log1p(len(re.findall(r"[0-9]+|[^\W\d_]+", span)))),
            float(not before or before[-1] == "\n"),
            float(bool(before and after) and before[-1] in "\"'([{<" and after[0] in "\"')]}>"),
        ],
        bin_of(_LAST_WORD.search(before)),
        bin_of(_NEXT_WORD.match(after)),
    )


def reliabilities(counts: dict[str, int], steps: int = 50) -> tuple[dict[str, float], np.ndarray]:
    """Probability of each pattern, and each labeler's (sensitivity, specificity), by EM.

    Each kind has a prior of its own; labelers are independent given the truth.  It starts
    from the share of yes among the votes.
    """
    names = sorted(counts)
    if not names:
        return {}, np.full((len(LABELERS), 2), 0.5)
    n = np.array([counts[p] for p in names], dtype=float)
    kind = np.array([KINDS.index(p.split("|")[0]) for p in names])
    votes = np.array([[{YES: 1, NO: 0, NONE: -1}[v] for v in p.split("|")[1]] for p in names])
    cast = votes >= 0
    q = np.clip((np.where(cast, votes, 0).sum(1) + 0.5) / (cast.sum(1) + 1.0), 0.02, 0.98)
    rel = np.full((len(LABELERS), 2), 0.5)
    for _ in range(steps):
        prior = np.array([((n * q)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        for j in range(len(LABELERS)):
            c = cast[:, j]
            yes = votes[c, j] == 1
            rel[j] = (
                ((n * q)[c] * yes).sum() + 4 * 0.8
            ) / ((n * q)[c].sum() + 4), (((n * (1 - q))[c] * ~yes).sum() + 4 * 0.8) / ((n * (1 - q))[c].sum() + 4)
        yes, no = votes == 1, votes == 0
        log = np.log(prior / (1 - prior))[kind]
        log = log + yes @ np.log(rel[:, 0] / (1 - rel[:, 1])) + no @ np.log((1 - rel[:, 0]) / rel[:, 1])
        new = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            q = new
            break
        q = new
    return dict(zip(names, q.tolist(), strict=True)), rel


def _design(names: list[str]) -> np.ndarray:
    rows = []
    for p in names:
        kind, votes, size = p.split("|")
        rows.append(
            [float(kind == k) for k in KINDS] + [float(v == x) for v in votes for x in (YES, NO)] + [float(size == s) for s in "sml"]
        )
    return np.array(rows).reshape(len(names), -1)


@dataclass
class SpanClassifier:
    """Log odds of a span: of its pattern, plus its marks times ``marks``, plus those of its two bins."""

    patterns: dict[str, float]
    marks: np.ndarray
    before: np.ndarray
    after: np.ndarray


def span_classifier(names: list[str], soft: dict[str, float], sample: list[tuple[str, list[float], int, int]], ridge: float = 1.0, steps: int = 40) -> SpanClassifier:
    """A ridge logistic classifier trained on the soft labels of a sample of (pattern, marks, bin, bin).

    names are the patterns that it will have to judge, in the sample or not.
    """
    d, m = _design(["|".join((KINDS[0], "-" * len(LABELERS), "s"))]).shape[1], len(MARKS)
    if not sample:
        return SpanClassifier(dict.fromkeys(names, 0.0), np.zeros(m), np.zeros(BINS), np.zeros(BINS))
    x = np.zeros((len(sample), d + m + 2 * BINS))
    x[:, :d] = _design([s[0] for s in sample])
    raw = np.array([s[1] for s in sample], dtype=float)
    mean, scale = raw.mean(0), raw.std(0) + 1e-6
    x[:, d : d + m] = np.clip((raw - mean) / scale, -6, 6)
    at = np.arange(len(sample))
    x[at, d + m + np.array([s[2] for s in sample])] = 1
    x[at, d + m + BINS + np.array([s[3] for s in sample])] = 1
    y, w = np.array([soft[s[0]] for s in sample]), np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    slopes = w[d : d + m] / scale
    of_pattern = _design(names) @ w[:d] - mean @ slopes if names else []
    return SpanClassifier(dict(zip(names, map(float, of_pattern), strict=True)), slopes, w[d + m : d + m + BINS], w[d + m + BINS :])


_SPAN = pa.struct(
    [("o", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("pattern", pa.string()), ("base", pa.bool_())]
    + [("marks", pa.list_(pa.float64())), ("before", pa.int32()), ("after", pa.int32())]
)
_SPAN_SQL = "array<struct<o: int, start: bigint, end: bigint, kind: string, pattern: string, base: boolean, marks: array<double>, before: int, after: int>>"


def scanned(docs: DataFrame, id_col: str, text_col: str, known: Gazetteers = DEFAULT) -> DataFrame:
    """doc_id and the array of judged spans of each row of docs, by kind and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t in b.column(1):
                text = t.as_py() or ""
                spans = candidates(text, base_spans(text), known)
                spans.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
                own = []
                for k, a, z, base in spans:
                    m, before, after = marks(text, a, z)
                    own.append({"o": KINDS.index(k), "start": a, "end": z, "kind": k, "pattern": pattern(text, k, a, z, base, known), "base": base, "marks": m, "before": before, "after": after})
                found.append(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(_SPAN))], names=["doc_id", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, found {_SPAN_SQL}")


def personal_data(
    docs: DataFrame, least: float = 0.5, known: Gazetteers = DEFAULT, fit_spans: int = FIT_SPANS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, spans_at.

    One row per row of docs, repeated rows and null ids too; null and empty texts have no
    spans.  Counts and base_sha256 are of base spans; spans lists all as kind:start:end, in
    code points, by kind and start.  spans_at holds the same as structs.  The classifier is
    fitted on about ``fit_spans`` spans drawn by hash, and a span stays at a probability of
    ``least``; ties at it stay.
    """
    rows = cut(scanned(docs, id_col, text_col, known))
    each = rows.select("doc_id", F.explode("found").alias("s"))
    counts = {r["pattern"]: r["n"] for r in each.groupBy(F.col("s.pattern").alias("pattern")).agg(F.count("*").alias("n")).collect()}
    share = min(1.0, fit_spans / max(1, sum(counts.values())))
    drawn = F.pmod(F.xxhash64(F.lit("spans"), "doc_id", "s.kind", "s.start", "s.end"), F.lit(1 << 30)) < share * (1 << 30)
    sample = sorted((r.pattern, list(r.marks), r.before, r.after) for r in each.filter(drawn).select("s.pattern", "s.marks", "s.before", "s.after").collect())
    model = span_classifier(sorted(counts), reliabilities(counts)[0], sample)
    of_pattern = F.create_map(*[F.lit(x) for p in sorted(model.patterns) for x in (p, model.patterns[p])]) if counts else F.create_map(F.lit(""), F.lit(0.0))
    numbers = lambda x: F.array(*[F.lit(float(v)) for v in x])
    slopes, before, after = numbers(model.marks), numbers(model.before), numbers(model.after)
    line = float(np.log(least / (1 - least))) if 0 < least < 1 else float("inf") if least >= 1 else float("-inf")

    def odds(s):
        own = F.aggregate(F.zip_with(s["marks"], slopes, lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x)
        return of_pattern[s["pattern"]] + own + F.get(before, s["before"]) + F.get(after, s["after"])

    base = F.filter("found", lambda s: s["base"])
    kept = F.filter("found", lambda s: s["base"] | (odds(s) >= line))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    judged = rows.select(
        "doc_id", *[count(k) for k in KINDS[:4]], F.sha2(said(base), 256).alias("base_sha256"), F.size(base).alias("n_base"),
        F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans_at"),
    )
    return judged.select(
        "doc_id", *[f"n_{k}" for k in KINDS[:4]], "base_sha256", said("spans_at").alias("spans"),
        (F.size("spans_at") - F.col("n_base")).cast("long").alias("n_added"), "spans_at",
    )
