"""Personal data by anchor expansion.

An Aho-Corasick automaton runs over every whole text once and finds anchors: at-signs, `://` and `mailto:`, a plus or a
point before a digit, and cues of identifiers (account, IBAN, ...). Small local parsers expand each anchor to the left and
right and check what they find, so the cost is linear in the text whatever it holds; the plain patterns are quadratic
on long runs of their own characters. Numbers of cards have no anchor but their digits; they are found by one linear scan.

Base kinds (leftmost, non-overlapping per kind, failing matches dropped without a second try):
`email`, `ip` (four parts of at most 255), `card` (14 to 19 digits, Luhn), `phone` (+, 10 to 15 digits).
Kinds the anchors add: `address` (a URL with a user part or an IPv4 host, from its scheme to the end of its host and port),
`mailbox` (an address at an at-sign with letters beyond ASCII, which the base pattern misses), `iban` (mod 97) and
`account` (an identifier with at least four digits right after its cue).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "mailbox", "iban", "account")
# fixed values: words that announce an identifier of a person
CUES = ("account number", "account no", "account", "acct", "bank account", "konto", "kontonummer", "passport", "passport no", "ssn", "social security number", "driver license", "tax id", "customer id")
_DIGITS = "0123456789"
_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + _DIGITS
_LOCAL = _ASCII + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PARTS = re.compile(r"(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}")  # shorter runs of digits are no cards; a run that has fewer has no part with more
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WIDE_LOCAL = re.compile(r"[\w.%+-]*\Z")
_WIDE_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_HOST = re.compile(r"(?P<user>[^\s/?#@<>\"']*@)?(?P<host>\[[0-9A-Fa-f:.]+\]|[\w.-]+)(?::[0-9]{1,5})?")
_FOUR = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}\Z")
_IBAN = re.compile(r"[ \t:#=]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:[:#=]|is|no\.?|number|nr\.?)){0,2}[ \t]*([A-Za-z]{0,3}[0-9](?:[ -]?[A-Za-z0-9]){3,33})")
_WORST = 256  # widest stretch that the parsers of added kinds look at

Span = tuple[int, str, int]


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    found.add_word("://", ("scheme", 3))
    for d in _DIGITS:
        found.add_word("+" + d, ("plus", 2))
        found.add_word("." + d, ("point", 2))
    for cue, kind in (("iban", "iban"), *((c, "cue") for c in CUES)):
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    """Luhn check of a string of ASCII digits."""
    return (sum(map(int, digits[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


class _Emails:
    """Leftmost non-overlapping addresses: what an at-sign can reach to the left ends at the match or at-sign before."""

    def __init__(self, text: str):
        self.text, self.floor = text, 0

    def at(self, place: int) -> tuple[int, int] | None:
        floor, self.floor = self.floor, max(self.floor, place + 1)
        start = floor + len(self.text[floor:place].rstrip(_LOCAL)) if floor < place else place
        found = _DOMAIN.match(self.text, place + 1) if start < place else None
        if found:
            self.floor = found.end()
            return start, found.end()
        return None

    def wide(self, place: int, floor: int) -> tuple[int, int] | None:
        """A mailbox with letters of any script, where the base pattern sees none or only a part."""
        left = self.text[max(floor, place - _WORST): place]
        local = _WIDE_LOCAL.search(left)
        right = _WIDE_DOMAIN.match(self.text, place + 1, place + 1 + _WORST)
        if not local.group() or not right:
            return None
        start = place - len(local.group())
        return None if self.text[start: right.end()].isascii() else (start, right.end())


def _addresses(text: str, end: int) -> tuple[int, int] | None:
    """The address whose `://` ends at `end`, if it names a user or an IPv4 host."""
    scheme = text[max(0, end - 3 - 16): end - 3]
    name = scheme[len(scheme.rstrip(_ASCII + "+-.")):].lstrip(_DIGITS + "+-.")
    host = _HOST.match(text, end, end + _WORST)
    if not name or not host:
        return None
    user = host.group("user")
    four = _FOUR.match(host.group("host"))
    if (user and user != "@") or (four and all(int(p) <= 255 for p in host.group("host").split("."))):
        return end - 3 - len(name), host.end()
    return None


def spans_of(text: str) -> list[Span]:
    """(start, kind, end) of everything found, ordered by start, then kind as in KINDS; code points, end exclusive."""
    out: list[Span] = []
    emails = _Emails(text)
    after_four = after_phone = after_iban = after_account = after_mailbox = after_address = 0
    for last, (kind, size) in _ANCHORS.iter(text):
        start = last + 1 - size
        if kind == "at":
            floor = emails.floor
            found = emails.at(start)
            if found:
                out.append((found[0], "email", found[1]))
            wide = emails.wide(start, max(floor, after_mailbox))
            if wide:
                out.append((wide[0], "mailbox", wide[1]))
                after_mailbox = wide[1]
        elif kind == "point":
            if start < after_four or not start or text[start - 1] not in _DIGITS:
                continue
            # a chain of numbers: from its first digits through all points; every four of its parts are one match
            first = after_four + len(text[after_four:start].rstrip(_DIGITS))
            after_four = _PARTS.match(text, start).end()
            parts = text[first:after_four].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k: k + 4]
                length = sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                    out.append((first, "ip", first + length))
                first += length + 1
        elif kind == "plus":
            found = _PHONE.match(text, start) if start >= after_phone else None
            if found:
                after_phone = found.end()
                if 10 <= sum(map(found.group().count, _DIGITS)) <= 15:
                    out.append((start, "phone", found.end()))
        elif kind == "scheme":
            found = _addresses(text, last + 1) if start >= after_address else None
            if found:
                out.append((found[0], "address", found[1]))
                after_address = found[1]
        elif start and text[start - 1].isalnum() or text[last + 1: last + 2].isalpha():
            continue  # a cue is a word of its own
        elif kind == "iban":
            found = _IBAN.match(text, last + 1, last + 1 + _WORST) if start >= after_iban else None
            if found:
                whole = found.group(1)
                # spaced groups may be followed by other words in capitals: the longest valid end counts
                for cut in range(len(whole), 14, -1):
                    packed = whole[:cut].replace(" ", "")
                    if whole[cut - 1] != " " and 15 <= len(packed) <= 34 and (cut == len(whole) or whole[cut] == " ") and _mod97(packed):
                        out.append((found.start(1), "iban", found.start(1) + cut))
                        after_iban = found.start(1) + cut
                        break
        else:
            found = _ACCOUNT.match(text, last + 1, last + 1 + _WORST) if start >= after_account else None
            if found:
                value = found.group(1)
                words = value.split(" ")
                while len(words) > 1 and not any(d in words[-1] for d in _DIGITS):
                    words.pop()  # words that follow the identifier
                value = " ".join(words)
                if sum(map(value.count, _DIGITS)) >= 4:
                    out.append((found.start(1), "account", found.start(1) + len(value)))
                    after_account = found.start(1) + len(value)
    for found in _CARD.finditer(text):
        digits = found.group().replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            out.append((found.start(), "card", found.end()))
    order = {kind: n for n, kind in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], order[s[1]], s[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
BATCH_BYTES = 8 << 20


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns
        found, at, size = [], 0, 0
        for k in range(batch.num_rows):
            text = texts[k].as_py() or ""
            found.append([{"kind": kind, "start": start, "end": end} for start, kind, end in spans_of(text)])
            size += len(text) + 64
            if size > BATCH_BYTES or k + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([ids.slice(at, k + 1 - at), pa.array(found, _SPANS)], names=["id", "spans"])
                found, at, size = [], k + 1, 0


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (id, spans array<struct<kind, start, end>>), ordered by start, then kind as in KINDS.

    Positions are code points, ends exclusive. A null or empty text has no spans; null and repeated ids are kept as they
    are; other columns are not read; an empty table gives an empty table. A text is worked off whole, in linear time.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scan, f"id {kind}, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id", id_col)


def _joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def personal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and a digest of the base kinds, and all
    spans as text `kind:start:end` joined by commas; see personal_spans."""
    found = personal_spans(docs, id_col, text_col)
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(kind) for kind in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(id_col, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with every stretch covered by spans replaced by the kind of its first span in angle brackets."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for text in batch.column(1).to_pylist():
                pieces, at = [], 0
                for start, kind, end in spans_of(text or ""):
                    if start >= at:
                        pieces += [text[at:start], f"<{kind}>"]
                    at = max(at, end)
                done.append(None if text is None else "".join(pieces) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], names=["id", "text"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(mask, f"id {kind}, text string").toDF(id_col, text_col)
