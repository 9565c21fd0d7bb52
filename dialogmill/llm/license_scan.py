"""Licence scans by template markup.

A template's words, its optional regions and its replaceable ones are compiled into an automaton over words. A text is accepted
where the automaton reads a row of its words from start to end, so the mandatory wording must match word for word, and only optional regions may
be missing and replaceable ones differ. Places are leftmost and longest and don't overlap.

A text is first turned into lower-cased words set apart by single blanks. An automaton runs only around the places of its anchor, the longest
row of words that every accepted text must hold, as far to both sides as its template can reach, so a text costs a few searches, and time is
linear in its length. Beside the templates' labels, phrases are counted at all their places.

The score is the mandatory words of the largest accepted template over the words of the text: 1 if the text is that licence and nothing
else, 0 if none is accepted.

Nulls: a null text counts as the empty text: no words, no labels, score 0. Texts are scanned whole, whatever their length. Repeated rows give
equal rows; an empty table gives an empty result; extra columns are ignored. No labels are an empty string.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.common import prepare_python, table
from dialogmill.llm.license_templates import PHRASES, TEMPLATES

#: Letters A-Z become small; ASCII digits, small letters and all bytes of other characters stay; the rest are blanks.
_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))
_MARK = re.compile(r"<<(beginOptional|endOptional|var;most=\d+)>>")


def canonical(text: str | None) -> bytes:
    """The words, each between single blanks; a lone blank if there are none."""
    out = b" " + (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS) + b" "
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


def parse(template: str) -> list:
    """A template as a list of words (bytes), numbers (so many words of any kind, at most) and lists (optional)."""
    stack: list[list] = [[]]
    for i, part in enumerate(_MARK.split(template)):
        if i % 2 == 0:
            stack[-1] += canonical(part).split()
        elif part == "beginOptional":
            stack.append([])
        elif part == "endOptional":
            if len(stack) == 1:
                raise ValueError("an optional region ends before it begins")
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            stack[-1].append(int(part.rpartition("=")[2]))
    if len(stack) > 1:
        raise ValueError("an optional region doesn't end")
    return stack[0]


def _longest(items: list) -> int:
    return sum(_longest(x) if isinstance(x, list) else x if isinstance(x, int) else 1 for x in items)


class Automaton:
    """What a template accepts, as states with steps by a word; state 0 is before the first one, ``end`` after the last."""

    def __init__(self, label: str, template: str):
        self.label, self.items = label, parse(template)
        if not any(isinstance(x, bytes) for x in self.items):
            raise ValueError(f"the template of {label} has no mandatory word")
        self.by_word: list[dict[bytes, list[int]]] = [{}]
        self.by_any: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]  # steps without a word
        self.end = self._add(self.items, 0)
        self._closed = [self._closure(s) for s in range(len(self.free))]

    def _state(self) -> int:
        for x in (self.by_any, self.free):
            x.append([])
        self.by_word.append({})
        return len(self.free) - 1

    def _add(self, items: list, at: int) -> int:
        for x in items:
            if isinstance(x, bytes):
                to = self._state()
                self.by_word[at].setdefault(x, []).append(to)
            elif isinstance(x, int):
                to, here = self._state(), at
                self.free[here].append(to)
                for _ in range(x):
                    after = self._state()
                    self.by_any[here].append(after)
                    self.free[after].append(to)
                    here = after
            else:
                to, inner = self._state(), self._state()
                self.free[at] += [inner, to]
                self.free[self._add(x, inner)].append(to)
            at = to
        return at

    def _closure(self, state: int) -> list[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return sorted(seen)

    @cached_property
    def mandatory(self) -> int:
        return sum(isinstance(x, bytes) for x in self.items)

    @cached_property
    def _anchor(self) -> tuple[int, int]:
        """(first item, items) of the longest row of mandatory words."""
        best, at = (0, 0), None
        for i, x in enumerate([*self.items, None]):
            if isinstance(x, bytes):
                at = i if at is None else at
                best = max(best, (i + 1 - at, -at))
            else:
                at = None
        return -best[1], best[0]

    @cached_property
    def anchor(self) -> bytes:
        at, n = self._anchor
        return b" " + b" ".join(self.items[at : at + n]) + b" "

    @cached_property
    def reach(self) -> tuple[int, int]:
        """The most words before the anchor's first word, and from that on."""
        at, _ = self._anchor
        return _longest(self.items[:at]), _longest(self.items[at:])

    def places(self, words: Sequence[bytes]) -> list[tuple[int, int]]:
        """(first, after last) of the places where words are accepted: leftmost, longest, without overlap."""
        out, at, n = [], 0, len(words)
        while at < n:
            active: dict[int, int] = {}  # state -> the earliest start that reaches it
            best = None
            while at < n:
                word, after = words[at], {}
                starts = active.items() if best else [*active.items(), (0, at)]
                for state, begin in starts:
                    if best and begin > best[0]:
                        continue
                    for s in self._closed[state]:
                        for to in (*self.by_word[s].get(word, ()), *self.by_any[s]):
                            if after.get(to, begin) >= begin:
                                after[to] = begin
                at += 1
                ended = [begin for s, begin in after.items() if self.end in self._closed[s]]
                if ended and (best is None or min(ended) <= best[0]):
                    best = (min(ended), at)
                active = after
                if best and not any(begin <= best[0] for begin in active.values()):
                    break
            if best:
                out.append(best)
                at = best[1]
        return out


def found_at(words: bytes, phrase: bytes) -> list[int]:
    """The bytes of ``words`` at which a phrase between blanks begins."""
    out, at = [], words.find(phrase)
    while at >= 0:
        out.append(at)
        at = words.find(phrase, at + 1)
    return out


class Scanner:
    """Phrases and templates against one text at a time."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]]):
        self.automata = [Automaton(*t) for t in templates]
        self.phrases = [(canonical(p), label) for p, label in phrases]

    def scan(self, text: str | None) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans [(label, first, after last)]."""
        words = canonical(text)
        n = words.count(b" ") - 1
        hits = [(label, at) for p, label in self.phrases if p in words for at in found_at(words, p)]
        anchored = [a for a in self.automata if a.anchor in words]
        if not hits and not anchored:
            return n, 0, None, None, "", "", 0.0, []
        blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
        starts = np.searchsorted(blanks, [at for _, at in hits]) if hits else []
        spans, most = [], 0
        for a in anchored:
            before, after = a.reach
            own, windows = np.searchsorted(blanks, found_at(words, a.anchor)), []
            for lo, hi in zip(np.maximum(own - before, 0).tolist(), np.minimum(own + after, n).tolist(), strict=True):
                if windows and lo <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], hi)
                else:
                    windows.append([lo, hi])
            for lo, hi in windows:
                at = a.places(words[blanks[lo] : blanks[hi]].split())
                spans += [(a.label, lo + x, lo + y) for x, y in at]
                most = max(most, a.mandatory) if at else most
        base = sorted({label for label, _ in hits})
        labels = sorted({*base, *(x[0] for x in spans)})
        return n, len(hits), int(min(starts)) if hits else None, int(max(starts)) if hits else None, ",".join(base), ",".join(labels), most / n, sorted(spans, key=lambda x: (x[1], x[2], x[0]))


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("after", pa.int64())]))
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPAN]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,after:long>>"


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """The columns of ``SCHEMA`` for every row of ``docs`` (doc_id, text); spans are the accepted places, in words."""
    prepare_python(docs.sparkSession)
    templates, phrases = list(templates), list(phrases)
    Scanner(templates, phrases)  # a template that can't be compiled is an error here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                cols = list(zip(*(scanner.scan(t.as_py()) for t in part.column(1)), strict=True))
                cols[-1] = [[{"label": a, "first": b, "after": c} for a, b, c in x] for x in cols[-1]]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True))], names=["doc_id", *_NAMES])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def load_templates(rows: DataFrame, most: int = 2000) -> list[tuple[str, str]]:
    """(label, template) from a table with these columns; more than ``most`` rows are an error."""
    got = rows.select("label", "template").where("label IS NOT NULL AND template IS NOT NULL").orderBy("label", "template").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} templates")
    return [(r["label"], r["template"]) for r in got]


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def _pattern(items: list) -> str:
    """Items as a regular expression over words that are each followed by a blank."""
    return "".join(f"{x.decode()} " if isinstance(x, bytes) else f"([^ ]+ ){{0,{x}}}" if isinstance(x, int) else f"({_pattern(x)})?" for x in items)


def op13_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> str:
    """Templates as regular expressions over the words."""
    forms = ", ".join(f"('{label}', ' {_pattern(parse(t))}', {Automaton(label, t).mandatory})" for label, t in templates)
    base = ", ".join(f"('{label}', '{p}')" for p, label in phrases)
    return f"""
WITH forms(label, pattern, mandatory) AS (VALUES {forms}), phrases(label, phrase) AS (VALUES {base}
), texts AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id::BIGINT AS doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents
), places AS (
  SELECT k, p.label, unnest(list_filter(range(len(words)), lambda i: words[(i + 1)::INT:(i + len(string_split(p.phrase, ' ')))::INT] = string_split(p.phrase, ' '))) AS place
  FROM texts, phrases p WHERE contains(' ' || array_to_string(words, ' ') || ' ', ' ' || p.phrase || ' ')
), base AS (SELECT k, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY k
), accepted AS (
  SELECT k, list(DISTINCT f.label) AS labels, max(f.mandatory) AS most FROM texts, forms f WHERE regexp_matches(' ' || array_to_string(words, ' ') || ' ', f.pattern) GROUP BY k
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(a.labels, [])))), ','), '') AS labels, coalesce(most::DOUBLE / len(words), 0) AS score
FROM texts t LEFT JOIN base b ON t.k = b.k LEFT JOIN accepted a ON t.k = a.k"""


OP13_SQL = op13_sql()
