"""License scans: SPDX-style templates compiled into token automata, and a base scan for fixed phrases.

A template becomes a nondeterministic automaton over words. Literal words must match exactly, optional regions
may be skipped as a whole, replaceable regions take any words within their bounds. The automaton is run from
every place where the template's leading literal words stand, its states kept as the bits of one integer;
a text is accepted when the final state is reached, so all mandatory wording has matched.

Words are maximal runs of 0-9, a-z (A-Z lower-cased) and characters from U+0080 on. Edge cases: null and empty
texts have no words, no labels and score 0; a phrase may overlap another; repeated rows each get their row;
texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame

from tallybook.llm.batches import map_rows
from tallybook.llm.license_templates import NOTICE, TEMPLATES

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>|([^\s<]+)")


def word_list(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Automaton:
    """A template's states: bit i stands before element i; the last bit accepts."""

    def __init__(self, template: str):
        self.on_word: dict[bytes, int] = {}
        self.on_any, elements, self.skips, open_at = 0, 0, [], []
        lead, leading = [], True
        for mark, low, high, word in _MARK.findall(template):
            if word:
                self.on_word[word.encode()] = self.on_word.get(word.encode(), 0) | 1 << elements
                elements += 1
                if leading:
                    lead.append(word.encode())
            elif mark == "beginOptional":
                open_at.append(elements)
            elif mark == "endOptional":
                self.skips.append((open_at.pop(), elements))
            else:
                for k in range(int(high)):
                    if k >= int(low):
                        self.skips.append((elements, elements + 1))
                    self.on_any |= 1 << elements
                    elements += 1
            leading = leading and bool(word)
        self.skips.sort()
        self.lead, self.final, self.start = lead, 1 << elements, self._closed(1)

    def _closed(self, states: int) -> int:
        for begin, end in self.skips:
            if states >> begin & 1:
                states |= 1 << end
        return states

    def accepts(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted run of words from `at`, or -1."""
        states, end = self.start, -1
        while states:
            if states & self.final:
                end = at
            if at == len(words):
                break
            states = self._closed((states & (self.on_word.get(words[at], 0) | self.on_any)) << 1)
            at += 1
        return end


@cache
def automata() -> dict[str, Automaton]:
    return {name: Automaton(template) for name, template in TEMPLATES.items()}


def places(joined: bytes, phrase: bytes) -> Iterator[int]:
    """Word positions where a phrase stands in ` w1 w2 ... wn `."""
    needle, found, words, seen = b" " + phrase + b" ", joined.find(b" " + phrase + b" "), 0, 0
    while found >= 0:
        words += joined.count(b" ", seen, found)
        seen = found
        yield words
        found = joined.find(needle, found + 1)


def scan(text: str | None) -> tuple:
    """n_words, base places [(word, label)], accepted templates [(label, first, end)]."""
    words = word_list(text)
    joined = b" " + b" ".join(words) + b" "
    base = [(at, label) for phrase, label in PHRASES.items() for at in places(joined, phrase.encode())]
    accepted = []
    for label, automaton in automata().items():
        for at in places(joined, b" ".join(automaton.lead)):
            if (end := automaton.accepts(words, at)) >= 0:
                accepted.append((label, at, end))
    return len(words), sorted(base), accepted


def _row(doc_id: int, text: str | None) -> Iterator[tuple]:
    n_words, base, accepted = scan(text)
    base_labels, labels = {x for _, x in base}, {x for x, _, _ in accepted}
    score = 1.0 if any(not x.endswith("-notice") for x in labels) else NOTICE if labels else 0.5 if base else 0.0
    yield (
        doc_id, n_words, len(base), base[0][0] if base else None, base[-1][0] if base else None,
        ",".join(sorted(base_labels)), ",".join(sorted(base_labels | labels)), score, [f"{x}:{a}-{b}" for x, a, b in accepted],
    )


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base phrases and accepted templates (`spans`: label:first-end in words) of every document."""
    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<string>"
    return map_rows(docs.select(doc_id, text), _row, schema)
