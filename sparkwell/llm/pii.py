"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, address schemes, plus
signs, digits and identifier cues. At each anchor a deterministic parser expands
to both sides and validates what it finds: mail domain, octets, check digits,
digit counts. A parser does not start inside what its kind has already covered,
and a run that failed is remembered, so each kind passes over a text at most a
few times, whatever the cues.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean_text, column_name, pieces, release_memory

#: Kinds in the order of reports; the first four are the base ones.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "secret")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")
IBAN_CUES = ("iban",)

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")

_DIGIT_RUN = re.compile(r"[0-9]*")
_LABEL_RUN = re.compile(r"[A-Za-z0-9-]*")
_PHONE_RUN = re.compile(r"[0-9 ().-]*")
_URL_RUN = re.compile(r"[^\s<>\"'`|]*")
_SECRET_RUN = re.compile(r"[A-Za-z0-9_\-+/=.]*")
_QUOTE_RUN = re.compile(r"[ \t\"']*")
_IBAN_LEAD = re.compile(r"[ :=#]*")
_LAST_DIGIT = re.compile(r".*[0-9]", re.DOTALL)
_LAST_LETTER = re.compile(r".*[A-Za-z]", re.DOTALL)

Span = tuple[str, int, int]


def _run(text: str, at: int, allowed: re.Pattern) -> int:
    """End of the run of allowed characters that starts at ``at``."""
    return allowed.match(text, at).end()


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Around an at-sign; the local part does not reach back over ``floor``."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL_RUN)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(text) and text[end] == "." and (more := _run(text, end + 1, _LABEL_RUN)) > end + 1:
        end, labels = more, labels + 1
    return (start, end) if labels else None


def _ips(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Addresses in the chain of dotted numbers that starts at ``at``, four numbers each, and the end of the chain."""
    runs = [(at, _run(text, at, _DIGIT_RUN))]
    while (end := runs[-1][1]) + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGITS:
        runs.append((end + 1, _run(text, end + 1, _DIGIT_RUN)))
    found = []
    for i in range(0, len(runs) - 3, 4):
        parts = [text[a:b].lstrip("0") for a, b in runs[i : i + 4]]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((runs[i][0], runs[i + 3][1]))
    return found, runs[-1][1]


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _card(text: str, at: int) -> tuple[tuple[int, int] | None, int]:
    """The chain of digits with single spaces or hyphens between; valid if it has 13 to 19 digits and the check digit is right."""
    n, end, parts = len(text), at, []
    while True:
        stop = _run(text, end, _DIGIT_RUN)
        parts.append(text[end:stop])
        end = stop
        if end + 1 < n and text[end] in " -" and text[end + 1] in _DIGITS:
            end += 1
            continue
        break
    size = sum(map(len, parts))
    return ((at, end) if 13 <= size <= 19 and luhn("".join(parts)) else None), end


def _phone(text: str, at: int) -> tuple[tuple[int, int] | None, int]:
    """From a plus sign to the last digit of the run of digits, spaces, dots, hyphens and brackets."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None, at + 1
    end = _run(text, at + 2, _PHONE_RUN)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= at + 3:
        return None, at + 1
    digits = sum(c in _DIGITS for c in text[at:end])
    return ((at, end) if 9 <= digits <= 15 else None), end


def _url(text: str, at: int, scheme_end: int) -> tuple[int, int] | None:
    end = _run(text, scheme_end, _URL_RUN)
    while end > scheme_end and text[end - 1] in ".,;:!?)]}":
        end -= 1
    return (at, end) if end > scheme_end else None


#: Two letters, two digits, 11 to 30 letters or digits, with single spaces anywhere between.
_IBAN = re.compile(r"[A-Za-z] ?[A-Za-z] ?[0-9] ?[0-9](?: ?[A-Za-z0-9]){11,30}")
_IBAN_DIGITS = {ord(c): str(int(c, 36)) for c in _ALNUM}


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """After a cue: two letters, two digits, 11 to 30 letters or digits in groups; the remainder by 97 must be 1."""
    start = _run(text, at, _IBAN_LEAD)
    m = _IBAN.match(text, start)
    if m is None:
        return None
    body = m[0]
    for end in [*(k for k, c in enumerate(body) if c == " " and k >= 15), len(body)]:
        if end == len(body) and start + end < len(text) and text[start + end] in _ALNUM:
            break
        kept = body[:end].replace(" ", "")
        if len(kept) >= 15 and int((kept[4:] + kept[:4]).translate(_IBAN_DIGITS)) % 97 == 1:
            return start, start + end
    return None


class _Secrets:
    """Values after cues of one text: an equals sign or colon, then 16 characters or more with letters and digits, perhaps in quotes.

    The last run of such characters is remembered with its last digit and letter,
    so that further cues inside it are settled without another pass.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.first, self.end, self.digit, self.letter = 0, 0, -1, -1

    def after(self, at: int, floor: int) -> tuple[int, int] | None:
        """The value after a cue that ends at ``at``; none that starts before ``floor``."""
        text = self.text
        start = _run(text, at, _QUOTE_RUN)
        if start >= len(text) or text[start] not in "=:":
            return None
        start = _run(text, start + 1, _QUOTE_RUN)
        if start < floor:
            return None
        if not self.first <= start < self.end:
            self.first, self.end = start, _run(text, start, _SECRET_RUN)
            last = [x.match(text, start, self.end) for x in (_LAST_DIGIT, _LAST_LETTER)]
            self.digit, self.letter = (m.end() - 1 if m else -1 for m in last)
        mixed = self.digit >= start and self.letter >= start
        return (start, self.end) if self.end - start >= 16 and mixed else None


def anchors() -> ahocorasick.Automaton:
    """Automaton over all anchors; its values are (kind of anchor, length)."""
    out = ahocorasick.Automaton()
    for word in ("@", "+", *sorted(_DIGITS)):
        out.add_word(word, ("digit" if word in _DIGITS else word, 1))
    for kind, words in (("scheme", SCHEMES), ("iban", IBAN_CUES), ("secret", SECRET_CUES)):
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                out.add_word(form, (kind, len(word)))
    out.make_automaton()
    return out


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[Span]:
    """All spans, in the order of ``KINDS``, then of their start; code points, end exclusive. Of one kind none overlap."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    reach = dict.fromkeys((*KINDS, "digits"), 0)

    def keep(kind: str, span: tuple[int, int] | None) -> None:
        if span is not None and span[0] >= reach[kind]:
            found[kind].append(span)
            reach[kind] = span[1]

    digits, mails, pluses = reach["digits"], 0, 0
    card_reach, secrets = 0, _Secrets(text)
    for last, (anchor, size) in automaton.iter(text):
        at = last + 1 - size
        if anchor == "digit":
            if at >= digits:  # the first digit of a dotted chain
                spans, digits = _ips(text, at)
                for span in spans:
                    keep("ip", span)
            if at >= card_reach:
                span, card_reach = _card(text, at)
                keep("card", span)
        elif anchor == "@":
            if span := _email(text, at, mails):
                keep("email", span)
                mails = span[1]
        elif anchor == "+":
            if at >= pluses:
                span, pluses = _phone(text, at)
                keep("phone", span)
        elif anchor == "scheme":
            if at >= reach["url"]:
                keep("url", _url(text, at, last + 1))
        elif anchor == "iban":
            if last + 1 >= reach["iban"]:
                keep("iban", _iban(text, last + 1))
        else:
            keep("secret", secrets.after(last + 1, reach["secret"]))
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def _join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_REPORT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = anchors()
    kinds = (*(pa.int64(),) * 5, pa.string(), pa.string())
    names = [f.split()[0] for f in _REPORT.split(", ")]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            spans = find_spans(text.as_py() or "", automaton)
            base = [s for s in spans if s[0] in BASE]
            rows.append((doc, *(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of their spans, and all spans.

    A null or empty text has no spans; repeated rows get equal results, an empty
    table none, and texts of any length are read whole, in proportion to it. No row depends on another and nothing is
    shuffled. Columns of other names are ignored.
    """
    out = docs.select(F.col(key).cast("long").alias("doc_id"), clean_text(text).alias("text")).mapInArrow(_report, _REPORT)
    return out if key == "doc_id" else out.withColumnRenamed("doc_id", key)


def _redacted(column: str, length: str | None):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in (part for whole in batches for part in pieces(whole, whole.schema.get_field_index(column))):
            i = batch.schema.get_field_index(column)
            texts = batch.column(i).to_pylist()
            clean = [t if not t else redact(t, find_spans(t, automaton)) for t in texts]
            if length is not None:
                k = batch.schema.get_field_index(length)
                sizes = [n if a is None or a == b else len(b) for a, b, n in zip(texts, clean, batch.column(k).to_pylist(), strict=True)]
                batch = batch.set_column(k, batch.schema.field(k), pa.array(sizes, batch.schema.field(k).type))
            yield batch.set_column(i, batch.schema.field(i), pa.array(clean, batch.schema.field(i).type))
        release_memory()

    return apply


def redact_pii(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with personal data in ``text`` replaced by the name of its kind in brackets.

    Null texts stay null. Where a text changes, the column ``length``, if there is
    one of an integer type, becomes its new number of characters. Columns are found
    as the session resolves names; repeated rows stay, an empty table gives none.
    """
    integers = ("tinyint", "smallint", "int", "bigint")
    length = column_name(docs, length) if length else None
    length = length if dict(docs.dtypes).get(length) in integers else None
    return docs.mapInArrow(_redacted(column_name(docs, text), length), docs.schema)
