"""License scans: template markup compiled to token automata.

A template is a line of words with two kinds of markup. `[[ ... ]]` encloses words that
may be missing, `<<n-m>>` stands for n to m replaceable words (a name, a year, a
version). Everything else is mandatory. A template becomes an automaton over tokens;
a text matches where the automaton accepts a run of its words, so mandatory wording
has to be there word for word and only marked regions may differ.

The scan is local to a row and linear in its words: an automaton starts only at
words that some template can begin with.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.common import ddl
from ledgerloom.llm.toxicity import plain_words

# Phrases of the base scan and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: label -> templates. Each begins with a mandatory or optional word, never with a gap.
TEMPLATES = {
    "notice:apache": [
        "licensed under [[the]] apache license [[version <<1-2>>]]",
        "licensed under [[the terms of]] [[the]] apache [[software]] license",
    ],
    "notice:bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted",
        "[[released]] under the bsd [[<<1-1>> clause]] license",
    ],
    "notice:cc-by": ["licensed under [[a]] [[creative commons]] cc by <<1-1>> 0"],
    "notice:cc-by-nc": ["licensed under [[a]] [[creative commons]] cc by nc [[<<1-1>> 0]]"],
    "notice:cc-by-sa": ["licensed under [[a]] [[creative commons]] cc by sa [[<<1-1>> 0]]"],
    "notice:copyright": ["[[copyright <<1-8>>]] all rights reserved"],
    "notice:gpl": [
        "[[this work is]] licensed under the [[terms of the]] [[gnu]] general public license"
        " [[version <<1-1>>]]",
    ],
    "notice:mit": [
        "[[released]] under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ],
}


@dataclass(frozen=True)
class Automaton:
    """Arcs per state as (word or None for any, next state); free moves are folded in."""

    arcs: tuple[tuple[tuple[bytes | None, int], ...], ...]
    accepting: frozenset[int]
    starts: frozenset[bytes]


def compile_template(template: str) -> Automaton:
    """States are the places between the template's tokens; an optional region may be
    stepped over and a gap's surplus words too."""
    tokens, skips, opened = [], [], []
    for part in template.replace("[[", " [[ ").replace("]]", " ]] ").split():
        if part == "[[":
            opened.append(len(tokens))
        elif part == "]]":
            skips.append((opened.pop(), len(tokens)))
        elif part.startswith("<<"):
            least, most = map(int, part.strip("<>").split("-"))
            start = len(tokens)
            tokens += [None] * most
            skips += [(k, start + most) for k in range(start + least, start + most)]
        else:
            tokens.append(part.encode())
    if opened:
        raise ValueError(f"region without an end: {template}")
    free = {k: {k} for k in range(len(tokens) + 1)}
    for start in range(len(tokens), -1, -1):
        for a, b in skips:
            if a == start:
                free[start] |= free[b]
    arcs = tuple(
        tuple(sorted(((tokens[k], k + 1) for k in free[s] if k < len(tokens)), key=lambda x: x[1]))
        for s in range(len(tokens) + 1)
    )
    starts = [word for word, _ in arcs[0]]
    if None in starts or not starts:
        raise ValueError(f"a template begins with a word: {template}")
    accepting = frozenset(s for s in free if len(tokens) in free[s])
    if 0 in accepting:
        raise ValueError(f"nothing in the template is mandatory: {template}")
    return Automaton(arcs, accepting, frozenset(starts))


def longest_match(found: list[bytes], start: int, machine: Automaton) -> int:
    """Words that the automaton accepts from `start` on, at most; 0 for none."""
    states, best, at = {0}, 0, start
    while states and at < len(found):
        word = found[at]
        states = {to for s in states for want, to in machine.arcs[s] if want is None or want == word}
        at += 1
        if states & machine.accepting:
            best = at - start
    return best


class Scanner:
    def __init__(self, templates=None, phrases=None):
        templates = TEMPLATES if templates is None else templates
        phrases = PHRASES if phrases is None else phrases
        self.phrases = [(tuple(p.encode().split()), name) for p, name in phrases.items()]
        self.begin: dict[bytes, list] = {}
        for label, several in templates.items():
            for template in several:
                machine = compile_template(template)
                for word in machine.starts:
                    self.begin.setdefault(word, []).append((label, machine))
        self.anchors = frozenset(self.begin) | {p[0] for p, _ in self.phrases}

    def scan(self, text: str | None):
        """(n words, phrase places, their labels, template matches (label, first, length))."""
        found = plain_words(text)
        places, base, matches = [], set(), []
        if self.anchors.isdisjoint(found):
            return len(found), places, base, matches
        anchors = self.anchors
        for at in [i for i, word in enumerate(found) if word in anchors]:
            for phrase, name in self.phrases:
                if found[at] == phrase[0] and tuple(found[at : at + len(phrase)]) == phrase:
                    places.append(at)
                    base.add(name)
            for label, machine in self.begin.get(found[at], ()):
                if length := longest_match(found, at, machine):
                    matches.append((label, at, length))
        return len(found), places, base, matches


RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, matches array<struct<label:string,first_word:int,n_words:int>>"
)


def scan_licenses(docs: DataFrame, text: str = "text", templates=None, phrases=None) -> DataFrame:
    """docs plus n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ with A-Z in lower case. n_base counts the
    places where the words of a phrase stand consecutively, first_word and last_word are
    the smallest and largest start (null without any). labels adds the labels of
    matching templates. matches holds every accepted run, the longest per start and
    template. score is 1 - (1 - e) ... over the distinct labels, where a template
    gives the evidence e = 0.8 and a phrase 0.5. Null and empty texts have no words
    and score 0. Input columns named like new ones are replaced.
    """
    machine = Scanner(templates, phrases)
    names = [part.split(" ")[0] for part in RESULT.split(", ")]
    base = docs.drop(*names)
    columns = base.columns
    at = columns.index(text)
    match = pa.struct([("label", pa.string()), ("first_word", pa.int32()), ("n_words", pa.int32())])

    def run(batches):
        for batch in batches:
            rows = [machine.scan(t) for t in batch.column(at).to_pylist()]
            made = [
                pa.array([n for n, _, _, _ in rows], pa.int64()),
                pa.array([len(p) for _, p, _, _ in rows], pa.int64()),
                pa.array([min(p, default=None) for _, p, _, _ in rows], pa.int64()),
                pa.array([max(p, default=None) for _, p, _, _ in rows], pa.int64()),
                pa.array([",".join(sorted(b)) for _, _, b, _ in rows]),
                pa.array([",".join(sorted(b | {m[0] for m in ms})) for _, _, b, ms in rows]),
                pa.array(
                    [
                        1 - 0.5 ** len(b) * 0.2 ** len({m[0] for m in ms})
                        for _, _, b, ms in rows
                    ],
                    pa.float64(),
                ),
                pa.array(
                    [
                        [{"label": a, "first_word": f, "n_words": n} for a, f, n in ms]
                        for _, _, _, ms in rows
                    ],
                    pa.list_(match),
                ),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*columns, *names])

    return base.mapInArrow(run, ddl(base, RESULT))


def pattern(template: str) -> str:
    """The template as a regular expression over words that each end in one blank,
    for engines that have expressions but no automata (used by the SQL check)."""
    out = []
    for part in template.replace("[[", " [[ ").replace("]]", " ]] ").split():
        if part == "[[":
            out.append("(?:")
        elif part == "]]":
            out.append(")?")
        elif part.startswith("<<"):
            least, most = part.strip("<>").split("-")
            out.append(f"(?:[^ ]+ ){{{least},{most}}}")
        else:
            out.append(f"{part} ")
    return "".join(out)
