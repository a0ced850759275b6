"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadtrace.llm.storage import small_batches

#: Base kinds in the order of the digest, then the kinds that the method adds.
BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "card_short", "secret")
#: Characters on either side of a span in which context words count.
CONTEXT = 40
THRESHOLD = 0.5

# The shape of each kind.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A start inside a run of digits cannot match where the run's start fails, so only run starts are tried (linear time).
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|[A-Za-z0-9_\-]{20,}={0,2})(?![A-Za-z0-9])")

# Score of a confirmed span and the words that raise it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "card_short": 0.4, "secret": 0.2}
#: What a secret's characters add.
SECRET_MIX, SECRET_PREFIX = 0.35, 0.5
WORDS = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "transfer"),
    "card_short": ("card", "visa", "amex", "credit", "debit", "payment"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "key", "bearer", "credential", "credentials"),
}
#: Public prefixes of keys that services hand out.
_PREFIX = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abp]-|AIza|npm_|hf_|eyJ)")
_CONTEXT = {k: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, w)) + r")(?![a-z])", re.IGNORECASE) for k, w in WORDS.items()}


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str):
    """Leftmost non-overlapping: for each @ the run of allowed characters before it, up to the last match's end."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and (c := text[start - 1]).isascii() and (c.isalnum() or c in "._%+-"):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            last = at = m.end()
        else:
            last, at = at + 1, at + 1
        at = text.find("@", at)


def _mix(secret: str) -> float:
    """What the characters of a proposed secret add to its score: a public prefix, or upper case, lower case and digits in turn, as in no word or title."""
    own = secret[m.end() :] if (m := _PREFIX.match(secret)) else secret
    if sum(own.count(c) for c in "-_") > 1:
        return 0.0
    if m and any(c.isdigit() for c in own):
        return SECRET_PREFIX
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(own, own[1:], strict=False))
    return SECRET_MIX if turns >= 4 and any(c.isupper() for c in own) and any(c.islower() for c in own) else 0.0


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    own = SCORES[kind] + (_mix(text[start:end]) if kind == "secret" else 0)
    return min(1.0, own + 0.4 * any(_CONTEXT[kind].search(x) for x in near))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", s, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def added_spans(text: str) -> list[tuple[str, int, int]]:
    """Proposals beyond the base kinds that their checksum, if there is one, confirms."""
    if not _DIGIT.search(text):
        return []
    out = []
    for m in _IBAN.finditer(text):
        for stop in range(m.end(), m.start() + 14, -1):  # a following word of capitals may have been taken along
            if stop == m.end() or text[stop] == " ":
                own = text[m.start() : stop].replace(" ", "")
                if 15 <= len(own) <= 34 and mod97(own):
                    out.append(("iban", m.start(), stop))
                    break
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := re.sub(r"[\x20-]", "", m[0])) <= 15 and luhn(d):
            out.append(("card_short", *m.span()))
    for m in _SECRET.finditer(text):
        if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]):
            out.append(("secret", *m.span()))
    return out


def spans_of(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """All spans with scores: base ones always, added ones from ``threshold`` on; by kind as listed, then start."""
    out = [(k, s, e, _score(text, k, s, e)) for k, s, e in base_spans(text)]
    out += [x for k, s, e in added_spans(text) if (x := (k, s, e, _score(text, k, s, e)))[3] >= threshold]
    return out


SPAN = "array<struct<kind: string, start: int, end: int, score: double>>"


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` in ``doc`` (struct), and ``spans`` in code points, end exclusive.

    A null or empty text has none; repeated rows each get their own; whole texts are searched in linear time.
    """
    small_batches(docs.sparkSession)
    rank = {k: i for i, k in enumerate((*BASE, *ADDED))}

    def search(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            found = []
            for t in batch.column("text").to_pylist():
                own = sorted(spans_of(t, threshold), key=lambda x: (rank[x[0]], x[1])) if t else []
                found.append([{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in own])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found, kind)], names=["doc", "spans"])

    rows = docs.select("text", F.struct("*").alias("doc"))
    return rows.mapInArrow(search, f"doc {rows.schema['doc'].dataType.simpleString()}, spans {SPAN}")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of ``find_pii``'s rows, then n_iban, n_card_short, n_secret and n_any (all spans)."""
    said = lambda keep: f"array_join(transform({keep}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in (*BASE, *ADDED)]
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), *counts[: len(BASE)],
        F.expr(f"sha2({said(f'filter(spans, s -> s.kind in ({base}))')}, 256)").alias("base_sha256"),
        F.expr(said("spans")).alias("spans"),
        *counts[len(BASE):], F.size("spans").cast("long").alias("n_any"),
    )
