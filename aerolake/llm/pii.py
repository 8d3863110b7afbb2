"""Personal data: expressions propose spans, checksums confirm them, context adjusts their score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Spans of the added kinds need this score; the base kinds stay whatever theirs is.
THRESHOLD = 0.6
#: Code points on either side of a span in which a context word counts.
CONTEXT = 48
_CONTEXT_GAIN = 0.35

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: As `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)` finds, but linear on long runs of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})")
#: Characters of an account number, by country.
_IBAN_SIZES = {
    size: names.split()
    for size, names in {
        15: "NO",
        16: "BE",
        18: "DK FI FO GL NL",
        19: "MK SI",
        20: "AT BA EE KZ LT LU XK",
        21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "PT",
        26: "IS TR",
        27: "FR GR IT MC SM",
        28: "AL AZ BY CY DO GT HU LB PL SV",
        29: "BR EG PS QA UA",
        30: "JO KW MU",
        31: "MT SC",
        32: "LC",
    }.items()
}
_IBAN_SIZE = {name: size for size, names in _IBAN_SIZES.items() for name in names}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ANY = re.compile(r"[0-9@]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an account number: letters count from 10, the first four places go last."""
    plain = iban.replace(" ", "")
    rest = 0
    for c in plain[4:] + plain[:4]:
        value = int(c, 36)
        rest = (rest * (100 if value > 9 else 10) + value) % 97
    return rest == 1


def _is_card(text: str) -> bool:
    return len(text) <= 37 and 12 <= len(digits := _digits(text)) <= 19 and luhn(digits)


def _is_ip(text: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in text.split("."))


def _is_phone(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def _is_ssn(text: str) -> bool:
    return text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        done = found.end() if found else at + 1
        if found:
            yield start, done
        at = text.find("@", done)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: of the country's length, else as long as can be, that pass the check and end a word."""
    done = 0
    for head in _IBAN.finditer(text):
        if head.start() < done:
            continue
        ends, at, n = {}, head.end(), 4
        while n < 34:
            at += text[at : at + 1] == " "
            if not (c := text[at : at + 1]) or not ("A" <= c <= "Z" or "0" <= c <= "9"):
                break
            at, n = at + 1, n + 1
            after = text[at : at + 1]
            if n >= 15 and not (after.isascii() and after.isalnum()):
                ends[n] = at
        usual = _IBAN_SIZE.get(head[0][:2])
        for n in sorted(ends, key=lambda n: (n != usual, -n)):
            if mod97(text[head.start() : ends[n]]):
                done = ends[n]
                yield head.start(), done
                break


def _all(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


@dataclass(frozen=True)
class Kind:
    name: str
    propose: Callable[[str], Iterator[tuple[int, int]]]
    valid: Callable[[str], bool]
    score: float
    words: tuple[str, ...]
    base: bool = True


KINDS = (
    Kind("email", _emails, lambda _: True, 0.65, ("mail", "contact", "write")),
    Kind("ip", _all(_IP), _is_ip, 0.6, ("ip", "address", "server", "host")),
    Kind("card", _all(_CARD), _is_card, 0.65, ("card", "credit", "visa", "payment")),
    Kind("phone", _all(_PHONE), _is_phone, 0.6, ("phone", "call", "tel", "mobile", "fax")),
    Kind("iban", _ibans, mod97, 0.65, ("iban", "account", "bank", "transfer"), base=False),
    Kind("ssn", _all(_SSN), _is_ssn, 0.4, ("ssn", "social", "security", "tax"), base=False),
)
_ORDER = {kind.name: n for n, kind in enumerate(KINDS)}


def spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, base) by start, then kind; code points, end exclusive."""
    if not _ANY.search(text):
        return []
    found = []
    for kind in KINDS:
        for start, end in kind.propose(text):
            if not kind.valid(text[start:end]):
                continue
            around = f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT]}"
            score = min(1.0, kind.score + _CONTEXT_GAIN * any(w in kind.words for w in re.findall(r"[a-z]+", around.lower())))
            if kind.base or score >= THRESHOLD:
                found.append((kind.name, start, end, round(score, 2), kind.base))
    return sorted(found, key=lambda s: (s[1], _ORDER[s[0]], s[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
_NAMES = [_SPAN.field(i).name for i in range(_SPAN.num_fields)]


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[dict(zip(_NAMES, s)) for s in spans(t.as_py())] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(_SPAN))], ["doc_id", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of each row of `docs`, whole texts; spans by start, then kind.

    Null and empty texts have no spans. Repeated rows are judged each by itself. Spans of
    different kinds may overlap; within a kind they never do.
    """
    common.ready(docs.sparkSession)
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double, base: boolean>>"
    return common.texts(docs).mapInArrow(_span_batches, schema)


def redacted(text: str) -> str:
    """The text with every span, or run of overlapping spans, replaced by its first kind's label."""
    out, at = [], 0
    for kind, start, end, *_ in spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if at else text


def _redact_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [None if t is None else redacted(t) for t in batch.column("text").to_pylist()]
        column = batch.schema.get_field_index("text")
        yield batch.set_column(column, batch.schema.field(column), pa.array(text, batch.schema.field(column).type))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with the personal data in its texts replaced by labels; other columns and null texts as they are."""
    common.ready(docs.sparkSession)
    return docs.mapInArrow(_redact_batches, docs.schema)
