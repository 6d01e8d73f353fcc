"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, schemes and identifier cues. A small
deterministic parser then expands each anchor to its span and validates it. The four base kinds equal the leftmost
non-overlapping matches of their patterns:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([\\x20-]?[0-9])+, 12 to 19 digits that pass Luhn's test
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 9 to 15 digits

Two kinds come on top: ``url``, an address with a user part (scheme://user@host), and ``account``, the value that
follows an identifier cue in any case, after up to two link words and in groups if it is an IBAN or a number.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache
from string import ascii_letters, digits

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catsim.llm.storage import bounded, column, doc_type, id_and_text

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
#: Cues whose values people write in groups, and the others.
NUMBERED = ("account", "acct", "iban", "passport", "ssn")
CUES = (*NUMBERED, "password", "secret", "token", "api_key", "api-key", "apikey")
#: Words between a cue and its value, at most two of them.
LINK = re.compile(r"[ :=#\"'_-]{1,6}(?:number|num|no|nr|id|is)(?![A-Za-z0-9])\.?")
MIN_VALUE, MIN_DIGITS, MAX_DIGITS = 8, 4, 19
MIN_IBAN, MAX_IBAN = 15, 34
_LOCAL = frozenset(ascii_letters + digits + "._%+-")
_LABEL = frozenset(ascii_letters + digits + "-")
_PHONE = frozenset(" ()." + digits + "-")
_DIGITS = frozenset(digits)
_SCHEME = frozenset(ascii_letters + digits + "+.-")
_VALUE = frozenset(ascii_letters + digits + "_-")
_URL_END = frozenset(" \t\n\v\f\r\"'<>()")
#: The only letter whose lower case is longer.
_TWO = "\u0130"
#: Code points that the automaton reads at a time.
BLOCK = 1 << 20
Span = tuple[str, int, int]


@cache
def anchors():
    """The automaton, built once in a Python process."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for key, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((d, "digit") for d in digits)]:
        found.add_word(key, kind)
    for cue in CUES:
        found.add_word(cue, "cue")
    found.make_automaton()
    return found


def _run(text: str, at: int, chars: frozenset) -> int:
    while at < len(text) and text[at] in chars:
        at += 1
    return at


def _emails(text: str, ats: array) -> Iterator[Span]:
    done = 0
    for at in ats:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        label = _run(text, at + 1, _LABEL)
        if start == at or label == at + 1:
            continue
        end = label
        while end < len(text) and text[end] == "." and (more := _run(text, end + 1, _LABEL)) > end + 1:
            end = more
        if end > label:
            done = end
            yield "email", start, end


def _ips(text: str, starts: array, ends: array) -> Iterator[Span]:
    k = 0
    while k + 3 < len(starts):
        if all(starts[n + 1] == ends[n] + 1 and text[ends[n]] == "." for n in range(k, k + 3)):
            parts = [text[starts[n] : ends[n]].lstrip("0") for n in range(k, k + 4)]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                yield "ip", starts[k], ends[k + 3]
            k += 4
        else:
            k += 1


def luhn(number: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(number)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _cards(text: str, starts: array, ends: array) -> Iterator[Span]:
    k = 0
    while k < len(starts):
        last, count = k, ends[k] - starts[k]
        while last + 1 < len(starts) and starts[last + 1] == ends[last] + 1 and text[ends[last]] in " -":
            last += 1
            count += ends[last] - starts[last]
        if 12 <= count <= 19 and luhn("".join(text[starts[n] : ends[n]] for n in range(k, last + 1))):
            yield "card", starts[k], ends[last]
        k = last + 1


def _phones(text: str, pluses: array) -> Iterator[Span]:
    for at in pluses:
        if at + 1 < len(text) and text[at + 1] in _DIGITS:
            end = _run(text, at + 2, _PHONE)
            while end > at + 2 and text[end - 1] not in _DIGITS:
                end -= 1
            if end > at + 3 and 9 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                yield "phone", at, end


def _urls(text: str, schemes: array) -> Iterator[Span]:
    done = end = 0
    for last in schemes:
        at, host = last - 2, last + 1
        start = at
        while start > done and text[start - 1] in _SCHEME:
            start -= 1
        # Addresses of one run of characters share its end, so that the run is walked once.
        end = max(end, host)
        while end < len(text) and text[end] not in _URL_END:
            end += 1
        slash = text.find("/", host, end)
        last = end if slash < 0 else slash
        if start < at and text[start] in ascii_letters and host < text.find("@", host, last) < last - 1:
            done = end
            yield "url", start, end


def iban(value: str) -> bool:
    """Whether a value without spaces has an IBAN's form and checksum."""
    if not (MIN_IBAN <= len(value) <= MAX_IBAN and re.fullmatch(r"[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]+", value)):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _grouped(text: str, start: int, end: int) -> int:
    """The end of the value at ``start`` whose first group ends at ``end`` and whose groups lie single spaces apart.

    The longest groups that make an IBAN, or else groups of two digits or more, the first of which may be up to three
    capitals, of eight characters or more and at most 19 digits in all; without such groups, ``end``.
    """
    joined, best, numbers = text[start:end], 0, end
    size, count, at = len(joined), sum(c in _DIGITS for c in joined), end
    plain = count >= 2 and not any(c in ascii_letters for c in joined) or size <= 3 and joined.isupper()
    while text[at : at + 1] == " " and (more := _run(text, at + 1, _VALUE)) > at + 1 and len(joined) <= MAX_IBAN:
        group = text[at + 1 : more]
        joined += group
        if iban(joined):
            best = more
        inside = sum(c in _DIGITS for c in group)
        plain = plain and inside >= 2 and not any(c in ascii_letters for c in group) and count + inside <= MAX_DIGITS
        if plain:
            numbers, size, count = more, len(joined), count + inside
        at = more
    return best or (numbers if size >= MIN_VALUE else end)


def _accounts(text: str, low: str, cues: array) -> Iterator[Span]:
    done = 0
    for last in cues:
        at = start = last + 1
        for _ in range(2):
            if link := LINK.match(low, start):
                start = link.end()
        after = start
        while start < len(text) and start - after < 6 and text[start] in " :=#\"'":
            start += 1
        if start < done or at == start or start == after and text[start - 1] != ".":
            continue
        end = _run(text, start, _VALUE)
        if end > start and low.endswith(NUMBERED, 0, at):
            end = _grouped(text, start, end)
        if end - start >= MIN_VALUE and sum(c in _DIGITS for c in text[start:end]) >= MIN_DIGITS:
            done = end
            yield "account", start, end


def _lower(text: str) -> str:
    """A text in lower case, of equal length: the one letter that would become two stays."""
    return _TWO.join(part.lower() for part in text.split(_TWO))


def _anchors_of(low: str) -> Iterator[tuple[int, str]]:
    """(last code point, kind) of each anchor. The automaton copies what it reads, so it gets a block at a time and keeps its state."""
    found = anchors().iter("")
    for at in range(0, len(low), BLOCK):
        found.set(low[at : at + BLOCK])
        yield from found


def find_spans(text: str) -> list[Span]:
    """All spans of a text as (kind, start, end) in code points, end exclusive, by start and then kind as in `KINDS`.

    Besides the spans, memory is the text, its lower case, four bytes an anchor and eight bytes a run of digits.
    """
    at = {kind: array("I") for kind in ("at", "plus", "scheme", "cue")}
    starts, ends = array("I"), array("I")
    low = _lower(text)
    for last, kind in _anchors_of(low):
        if kind != "digit":
            at[kind].append(last)
        elif ends and ends[-1] == last:
            ends[-1] = last + 1
        else:
            starts.append(last)
            ends.append(last + 1)
    found = [
        *_emails(text, at["at"]),
        *_ips(text, starts, ends),
        *_cards(text, starts, ends),
        *_phones(text, at["plus"]),
        *_urls(text, at["scheme"]),
        *_accounts(text, low, at["cue"]),
    ]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def span_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of ``docs``.

    A null or empty text has no spans; a very long one takes time in proportion to its length. Spans that start together
    are in the order of `KINDS`. Rows are independent, so repeated rows give equal results; columns other than doc_id and
    text are ignored; an empty table gives no rows.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = [find_spans(t) if t else [] for t in batch.column(1).to_pylist()]
            base = [[s for s in spans if s[0] in BASE] for spans in found]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE]
            shas = pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base], pa.string())
            names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, shas, pa.array([_joined(s) for s in found], pa.string())], names)

    schema = f"doc_id {doc_type(docs)}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return id_and_text(docs).mapInArrow(find, schema)


def issued(number: str) -> bool:
    """Whether a card number starts as payment cards do: 3 to 6, or 2221 to 2720."""
    return number[0] in "3456" or "2221" <= number[:4] <= "2720"


def redact(text: str) -> str:
    """A text with each span replaced by its kind; of spans that overlap, the first names the whole.

    A tenth of all long numbers pass Luhn's test by chance, so a card is replaced only if it starts as cards do.
    """
    out, at = [], 0
    for kind, start, end in find_spans(text):
        if kind == "card" and not issued("".join(c for c in text[start:end] if c in _DIGITS)):
            continue
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_chars``, where it exists, counted anew.

    Null stays null and an empty text empty; very long texts, spans that overlap and equal rows are as in `span_digests`
    and `redact`; all other columns, whatever their names, and the number of rows are unchanged.
    """

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redact(t) if t else t)

    done = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*map(column, docs.columns))
