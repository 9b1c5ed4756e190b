"""Personal data spans with offset-preserving deobfuscation.

Base detectors read the text as it stands. A chain of transducers then undoes disguises
(confusable characters, invisible characters, spelled digits, bracketed or spelled "at" and
"dot"), keeping for every output character the source span it came from; the same detectors read
the normalised text, and what they find is mapped back to source characters. Spans count code
points, the end exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.llm.common import slices, text_or_empty

#: Kinds in the order in which spans are listed; fixed values.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits matches from its first digit or not at all, so later starts need no trial.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each run of local characters before an at sign, if a domain follows; linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """What the plain detectors find, by kind and then start."""
    out: list[Span] = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(n := p.lstrip("0")) <= 3 and int(n or "0") <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


#: Cyrillic and Greek letters that look like Latin ones, and their Latin forms; fixed values.
CONFUSABLES = dict(
    zip(
        "АВСЕНІЈКМОРЅТХУаеіјорѕсухһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιανρ",
        "ABCEHIJKMOPSTXYaeijopscyxhdqwABEZHIKMNOPTYXoiavp",
        strict=True,
    )
)
#: Characters that show nothing; fixed values.
INVISIBLE = "­​‌‍⁠﻿"
#: Words for digits; fixed values.
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_WIDE = "！-～"
_STRANGE = re.compile(f"[{''.join(CONFUSABLES)}{INVISIBLE}{_WIDE}٠-٩۰-۹०-९․﹒﹫⁰-₉\U0001d7ce-\U0001d7ff]")
_WORD = "|".join(DIGIT_WORDS)
_SPELLED = re.compile(rf"(?<![A-Za-z])(?:plus[\s-]+)?(?:{_WORD})(?:[\s,.-]{{1,3}}(?:{_WORD})(?![A-Za-z])){{3,}}", re.IGNORECASE)
_ONE_WORD = re.compile(rf"(plus)|({_WORD})", re.IGNORECASE)
_BRACKET_AT = re.compile(r"[ \t]{0,3}[\[({<][ \t]{0,3}(?:at|@)[ \t]{0,3}[\])}>][ \t]{0,3}", re.IGNORECASE)
_BRACKET_DOT = re.compile(r"[ \t]{0,3}[\[({<][ \t]{0,3}(?:dot|\.)[ \t]{0,3}[\])}>][ \t]{0,3}", re.IGNORECASE)
# A name, not an article or pronoun, follows an "at" that stands for the sign. The domain's dots may be plain, spelled or bracketed.
_ANY_DOT = r"(?:\.|[ \t]{1,3}dot[ \t]{1,3}|[ \t]{0,3}[\[({<][ \t]{0,3}(?:dot|\.)[ \t]{0,3}[\])}>][ \t]{0,3})"
_WORD_AT = re.compile(
    r"(?<=[A-Za-z0-9_%+-])[ \t]{1,3}at[ \t]{1,3}(?!(?:the|an?|this|that|these|those|my|your|his|her|its|our|their|every|each|any|some)[ \t])"
    rf"(?=([A-Za-z0-9-]{{1,63}}(?:{_ANY_DOT}[A-Za-z0-9-]{{1,63}}){{1,9}}))",
    re.IGNORECASE,
)
_WORD_DOT = re.compile(r"(?<=[A-Za-z0-9])[ \t]{1,3}dot[ \t]{1,3}(?=[A-Za-z0-9])", re.IGNORECASE)
_DOT_WORD = re.compile(r"(?<![A-Za-z])dot(?![A-Za-z])", re.IGNORECASE)


#: The words in every case; a whole copy in lower case takes far more memory than the text.
_DOT_CASES, _AT_CASES = (["".join(c) for c in product(*zip(w, w.upper(), strict=True))] for w in ("dot", "at"))


class Tape:
    """A text with the source span of every character, kept as runs: a run either copies the source from some place
    on, or all its characters come from one source span."""

    def __init__(self, text: str):
        #: Of each run: its place in the text, its source, and the source's width (0 for a copy).
        self.text, self.at, self.source, self.width = text, [0], [0], [0]

    def span(self, i: int) -> tuple[int, int]:
        """The source span of one character."""
        run = bisect_right(self.at, i) - 1
        if self.width[run]:
            return self.source[run], self.source[run] + self.width[run]
        start = self.source[run] + i - self.at[run]
        return start, start + 1

    def rewrite(self, pattern: re.Pattern, outputs) -> None:
        """Replace matches. ``outputs(match)`` gives ``(string, from, to)`` parts; every character of
        a part comes from its source span."""
        text, old, done, length = [], self.text, 0, 0
        runs: tuple[list, list, list] = ([], [], [])

        def add(source: int, width: int) -> None:
            at, sources, widths = runs
            if not (at and width == widths[-1] == 0 and sources[-1] + length - at[-1] == source):
                for column, value in zip(runs, (length, source, width), strict=True):
                    column.append(value)

        def copy(a: int, b: int) -> None:
            nonlocal length
            run = bisect_right(self.at, a) - 1
            while a < b:
                end = min(b, self.at[run + 1]) if run + 1 < len(self.at) else b
                add(self.source[run] + (0 if self.width[run] else a - self.at[run]), self.width[run])
                length += end - a
                a, run = end, run + 1

        for m in pattern.finditer(old):
            text.append(old[done : m.start()])
            copy(done, m.start())
            for string, a, b in outputs(m):
                start, end = self.span(a)[0], self.span(b - 1)[1]
                if string:
                    text.append(string)
                    add(start, 0 if len(string) == end - start == 1 else end - start)
                    length += len(string)
            done = m.end()
        if done:
            text.append(old[done:])
            copy(done, len(old))
            self.text = "".join(text)
            self.at, self.source, self.width = runs if runs[0] else ([0], [0], [0])


def _plain(c: str) -> str:
    """What a strange character stands for; nothing for one that shows nothing."""
    if c in INVISIBLE:
        return ""
    if (plain := CONFUSABLES.get(c)) is not None:
        return plain
    digit = unicodedata.digit(c, None)
    return str(digit) if digit is not None else unicodedata.normalize("NFKC", c)


#: Strange characters that stand for one character each; the others shorten or lengthen the text.
_SINGLE = {ord(c): _plain(c) for c in map(chr, range(0x20000)) if _STRANGE.match(c) and len(_plain(c)) == 1}


def _digits(m: re.Match) -> list[tuple[str, int, int]]:
    return [
        ("+" if w.group(1) else DIGIT_WORDS[w.group().lower()], m.start() + w.start(), m.start() + w.end())
        for w in _ONE_WORD.finditer(m.group())
    ]


#: Words before an "at" that stands for a place, as do all in -ed and -ing; no name is among them.
_PROSE = frozenset(
    "look looks see seen find found meet met me us you him her them it is are was were be been here there work works live lives stay read more news shop buy sold "
    "available online info information details page pages site sites website home down back over up out and or not just only also even".split()
)


def _spoken_at(m: re.Match) -> list[tuple[str, int, int]]:
    """An at sign for a spoken "at", unless prose reads the same: a word of no name before it and a domain with plain dots
    alone behind it ("look at site.org")."""
    name = re.search(r"[A-Za-z0-9._%+-]*\Z", m.string[max(0, m.start() - 64) : m.start()]).group().lower()
    prose = name.isalpha() and (name in _PROSE or name.endswith(("ed", "ing")))
    if prose and re.fullmatch("[A-Za-z0-9.-]+", m.group(1)):
        return [(c, i, i + 1) for i, c in enumerate(m.group(), m.start())]
    return [("@", m.start(), m.end())]


def deobfuscate(text: str) -> Tape | None:
    """The normalised text with its map to the source; None where no disguise occurs."""
    strange = not text.isascii() and _STRANGE.search(text) is not None
    spelled = _SPELLED.search(text) is not None
    bracket = _BRACKET_AT.search(text) or _BRACKET_DOT.search(text)
    dots = any(w in text for w in _DOT_CASES) and _DOT_WORD.search(text) is not None
    at = any(w in text for w in _AT_CASES) and _WORD_AT.search(text) is not None
    if not (strange or spelled or bracket or dots or at):
        return None
    tape = Tape(text)
    if strange:
        tape.text = tape.text.translate(_SINGLE)
        tape.rewrite(_STRANGE, lambda m: [(_plain(m.group()), m.start(), m.end())])
    tape.rewrite(_SPELLED, _digits)
    whole = lambda c: lambda m: [(c, m.start(), m.end())]
    tape.rewrite(_BRACKET_AT, whole("@"))
    tape.rewrite(_WORD_AT, _spoken_at)  # before the dots, which tell prose from a disguise
    tape.rewrite(_BRACKET_DOT, whole("."))
    tape.rewrite(_WORD_DOT, whole("."))
    return None if tape.text == text else tape


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that only the normalised text shows, in source offsets.

    A disguise in part of a value may leave a shorter base span inside it, so only what one base
    span of the kind covers wholly is not added; a longer span stands beside the base span.
    """
    base = base_spans(text)
    tape = deobfuscate(text)
    if tape is None:
        return base, []
    # Base spans of a kind are in order and apart, so the last one that starts no later is the only one that can cover.
    taken = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}
    added = []
    for kind, s, e in base_spans(tape.text):
        a, b = tape.span(s)[0], tape.span(e - 1)[1]
        i = bisect_right(taken[kind], a, key=lambda x: x[0]) - 1
        if i < 0 or taken[kind][i][1] < b:
            added.append((kind, a, b))
    return base, added


#: Bytes of text that a task redacts at once.
SLICE = 1 << 20
_SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,value:string>>"
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("value", pa.string())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate(KINDS)}
    for batch in (part for whole in batches for part in slices(whole)):
        rows = []
        for text in batch.column("text").to_pylist():
            base, added = all_spans(text)
            spans = [(*s, True) for s in base] + [(*s, False) for s in added]
            spans.sort(key=lambda s: (order[s[0]], s[1], s[2]))
            rows.append([{"kind": k, "start": a, "end": b, "base": own, "value": text[a:b]} for k, a, b, own in spans])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(_ARROW_SPAN))], ["doc_id", "spans"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, base, value) of every row, by kind and start.

    Null text counts as empty and has no spans; a null id stays null; repeated rows are each
    answered; other columns are ignored. Overlapping spans of different kinds all stay. The work
    grows with the text, and with the logarithm of its disguises for each of them; beside the text a
    few copies of it and some bytes a disguise are held.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(
        _find, f"doc_id long, spans {_SPANS}"
    )


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_text(text: str) -> str:
    """The text with each span (overlaps merged) replaced by its kind in angle brackets."""
    base, added = all_spans(text)
    if not base and not added:
        return text
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b in base + added):
        if a >= at:
            out.append(text[at:a] + f"<{kind.upper()}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced in the text; null text stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, at, SLICE)):
            texts = [None if t is None else redact_text(t) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
