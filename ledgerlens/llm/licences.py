"""Licence scans by sentence rules.

A text is cut into sentences. Each is normalised (lower case; letters, digits and the signs of versions only) and looked
up, from each of its lines on, as notices often follow each other without a full stop: known licence sentences have identifiers, some with a parameter such as a version. The identifiers of a text, in
order, are then matched against ordered rules, longest evidence first; a rule names the licence that its sequence of
identifiers means. Identifiers that no rule takes are reported too, as a licence that isn't known, and so are sentences
that put something under a licence without being known. Marks of comments at the ends of lines count as blanks.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Wordings of public licences and of their usual notices. Each has an identifier and a pattern for one
#: normalised sentence; a group in the pattern is the identifier's parameter.
SENTENCES = (
    ("spdx", r"spdx-license-identifier [a-z0-9.+-]+"),
    ("copyright", r"(?:\(c\) )?copyright (?:\(c\) )?\d{4}.*"),
    ("rights", r"all rights reserved"),
    ("mit-title", r"(?:the )?mit license(?: \(mit\))?"),
    ("mit-released", r"(?:this \w+ is )?(?:released|licensed|distributed|available) under the (?:terms of the )?mit license"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*"),
    ("mit-notice", r"the above copyright notice and this permission notice (?:\(including the next paragraph\) )?shall be included in all copies or substantial portions of the software"),
    ("as-is", r"(?:the|this) software is provided as is without warranty of any kind.*"),
    ("no-liability", r"in no event shall the (?:authors or copyright holders|copyright holders? (?:or|and) contributors|regents .*) be liable for any .*"),
    ("isc-grant", r"permission to use copy modify and/?(?: )?or distribute this software for any purpose with or without fee is hereby granted.*"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", r"(?:\d\.? )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", r"(?:\d\.? )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer .*"),
    ("bsd-endorse", r"(?:\d\.? )?neither the name of .* nor the names of (?:its|their) contributors may be used to endorse or promote products .*"),
    ("bsd-as-is", r"this software is provided by the (?:copyright holders|authors?|regents) and contributors as is and any express or implied warranties .*"),
    ("apache-licensed", r"(?:this \w+ is )?licensed under the apache license version ([0-9.]+).*"),
    ("apache-comply", r"you may not use this (?:file|software) except in compliance with the license"),
    ("apache-obtain", r"you may obtain a copy of the license at.*"),
    ("apache-unless", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis .*"),
    ("gpl-licensed", r"(?:this \w+ is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu general public license(?: as published by the free software foundation)? version ([0-9.]+)(?: of the license)?( or \(?at your option\)? any later version)?"),
    ("gpl-free", r"this (?:program|library|file) is free software you can redistribute it and/?(?: )?or modify it under the terms of the gnu (general|lesser general|affero general) public license as published by the free software foundation either version ([0-9.]+) of the license or \(at your option\) any later version"),
    ("gpl-hope", r"this (?:program|library|file) is distributed in the hope that it will be useful but without any warranty .*"),
    ("gpl-details", r"see the gnu (?:lesser |affero )?general public license for more details"),
    ("gpl-received", r"you should have received a copy of the gnu (?:lesser |affero )?general public license along with this (?:program|library|file).*"),
    ("lgpl-licensed", r"(?:this \w+ is )?(?:released|licensed|distributed) under the (?:terms of the )?gnu lesser general public license version ([0-9.]+)"),
    ("mpl-subject", r"this source code form is subject to the terms of the mozilla public license v\.? ?([0-9.]+)"),
    ("cc", r"(?:this \w+ is )?licensed under (?:a |the )?(?:cc|creative commons) (by|by-sa|by-nd|by-nc|by-nc-sa|by-nc-nd) ([0-9.]+)(?: license)?"),
    ("cc0", r"(?:this \w+ is )?(?:released|dedicated|licensed) (?:under|to the public domain under) cc0 ([0-9.]+)(?: universal)?"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
)
#: Ordered rules. ``?`` marks a sentence that may be missing. The first rule that fits at a place wins, and
#: ``{}`` in a licence takes the parameters of the rule's sentences.
RULES = (
    ("mit-text", "MIT", ("mit-title?", "copyright?", "rights?", "mit-grant", "mit-notice?", "as-is?", "no-liability?")),
    ("bsd-3-text", "BSD-3-Clause", ("copyright?", "rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is?", "no-liability?")),
    ("bsd-2-text", "BSD-2-Clause", ("copyright?", "rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is?", "no-liability?")),
    ("isc-text", "ISC", ("copyright?", "isc-grant", "as-is?", "no-liability?")),
    ("apache-header", "Apache-{}", ("copyright?", "apache-licensed", "apache-comply", "apache-obtain?", "apache-unless?")),
    ("apache-notice", "Apache-{}", ("apache-licensed",)),
    ("gpl-header", "{}-{}-or-later", ("copyright?", "gpl-free", "gpl-hope?", "gpl-details?", "gpl-received?")),
    ("gpl-notice", "GPL-{}-{}", ("gpl-licensed",)),
    ("lgpl-notice", "LGPL-{}-only", ("lgpl-licensed",)),
    ("mpl-notice", "MPL-{}", ("mpl-subject",)),
    ("cc-notice", "CC-{}-{}", ("cc",)),
    ("cc0-notice", "CC0-{}", ("cc0",)),
    ("unlicense", "Unlicense", ("unlicense",)),
    ("mit-notice", "MIT", ("mit-released",)),
    ("spdx-tag", "{}", ("spdx",)),
)
#: How the parameters of a sentence are written in a licence's name.
FAMILY = {"general": "GPL", "lesser general": "LGPL", "affero general": "AGPL"}
UNKNOWN = "unknown"
#: Sentences that say nothing about a licence by themselves.
WEAK = {"copyright", "rights", "mit-title"}
MATCHES = "rule string, licence string, start long, length long, sentences array<string>"


def _lined(name: str, pattern: str) -> tuple[str, re.Pattern, bool]:
    """The pattern for text whose lines are kept: a blank may be a line's end, and the sentence ends with a line (but not
    before "or ..."). A last ``.*`` is no part of it; it says that the sentence may go on."""
    open_end = pattern.endswith(".*")
    end = "" if open_end else r"(?=[ ./-]*(?:\n(?!or[ \n])|\Z))"
    return name, re.compile(pattern.removesuffix(".*").replace(" ", "[ \n]") + end, re.S), open_end


_PATTERNS = [_lined(name, pattern) for name, pattern in SENTENCES]
#: Every pattern holds one of these, so that texts and sentences without any need no look-up.
_HINT = re.compile(r"licen[sc]e|copyright|permission|redistribut|software|rights reserved|liable|public domain|neither the name|under cc|warranty", re.I)
_END = re.compile(r"(?<=[.!?;])\s+(?=[A-Z0-9\"'(©*#/-]*[A-Z])|(?<!\s)\s*\n\s*\n\s*")
#: Marks of comments, lists and quotations at the beginning of a line, marks at its end, and lines of signs only.
_MARKS = (re.compile(r"""^[ \t]*(?:(?:/\*+!?|\*+/|\(\*+|<!--+|//+!?|\*+\)?|\#+!?|--+>?|-(?=[ \t])|;+|%+|!+|>+|\|+|\"{3}|'{3}|\.\\"|@?(?:dnl|rem)\b)[ \t]*)+""", re.M | re.I),
          re.compile(r"(?<![*#|-])(?:[*#|]++[/)]?|--+>?)[ \t\r]*$", re.M), re.compile(r"^[^\w\n]+$", re.M))
#: A sentence that puts something under a licence, whichever.
_LIKE = re.compile(r"(?:(?:this|these|the|all|it|code)(?:[ \n][^ \n]+){0,8}?[ \n](?:is|are|may[ \n]be|can[ \n]be)[ \n](?:also[ \n])?)?"
                   r"(?:dual-)?(?:licen[sc]ed|(?:re)?distributed|released|available|covered|governed)[ \n](?:under|by)[ \n](?:[^ \n]+[ \n]){0,12}?licen[sc]es?(?![a-z])")
_LINE, _WORD, _LEAD = re.compile(r"[^\n]+"), re.compile(r"[A-Za-z0-9.+()/-]+"), re.compile(r"[ ./-]*")

#: The identifier of licence sentences that aren't known.
LIKE = "licence-like"
Identity = tuple[str, tuple[str, ...]]


def _parameters(name: str, found: tuple) -> tuple[str, ...]:
    version = lambda v: v.strip(".") if "." in v.strip(".") else v.strip(".") + ".0"
    if name == "gpl-licensed":
        return version(found[0]), "or-later" if found[1] else "only"
    if name == "gpl-free":
        return FAMILY[found[0]], version(found[1])
    if name == "cc":
        return found[0].upper(), version(found[1])
    return tuple(version(v) for v in found if v)


def uncommented(text: str) -> str:
    """The text with blanks for the marks of comments; every other sign stays where it is."""
    for marks in _MARKS:
        text = marks.sub(lambda m: " " * len(m.group()), text)
    return text


def _spans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _END.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


class _Lines:
    """A sentence's lines: ``plain`` holds them normalised (lower case, with a space for any run of other signs than those
    of versions and names), ``begins`` where each begins there, and ``words`` (begin there, start in the text) of each word."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.ends, self.begins, self.words, self.plain = text, [], [], [], ""
        lines, size = [], 0
        for m in _LINE.finditer(text, start, end):
            own = [(w.start(), w.group().lower()) for w in _WORD.finditer(text, m.start(), m.end())]
            self.begins.append(size)
            self.ends.append(m)
            for at, word in own:
                self.words.append((size, at))
                size += len(word) + 1
            lines.append(" ".join(word for _, word in own))
            size += not own
        self.plain = "\n".join(lines)

    def span(self, first: int, last: int) -> tuple[int, int]:
        """(start, end) of lines in the text, without white space around them."""
        a, b = self.ends[first].start(), self.ends[last].end()
        part = self.text[a:b]
        return a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())

    def like(self, at: int) -> int | None:
        """The last line of the words at ``at`` that put something under a licence."""
        m = _LIKE.match(self.plain, _LEAD.match(self.plain, at).end())
        return bisect_right(self.begins, m.end() - 1) - 1 if m else None

    def known(self, at: int) -> tuple[Identity, int, bool] | None:
        """(identity, last line, whether it may go on) of the known licence sentence that begins at ``at`` of ``plain``."""
        at = _LEAD.match(self.plain, at).end()
        for name, pattern, open_end in _PATTERNS:
            if m := pattern.match(self.plain, at):
                values = _parameters(name, m.groups())
                if name == "spdx":  # as it is written there
                    begin, start = self.words[bisect_right(self.words, (m.end() - 1, len(self.text))) - 1]
                    values = (self.text[start:start + m.end() - begin].rstrip("."),)
                return (name, values), bisect_right(self.begins, m.end() - 1) - 1, open_end
        return None


def _known(lines: _Lines) -> Iterator[tuple[int, int, int, Identity, bool]]:
    """(first line, start in the text, last line, identity, whether it may go on) of known licence sentences.

    One begins at a line's beginning and may run over lines, or follows in the line of a copyright.
    """
    i, n = 0, len(lines.begins)
    while i < n:
        if (found := lines.known(lines.begins[i])) is None:
            i += 1
            continue
        identity, last, open_end = found
        yield i, lines.span(i, i)[0], last, identity, open_end
        i = last + 1
        if identity[0] == "copyright":
            begin, end = lines.begins[last], lines.begins[last + 1] if last + 1 < n else len(lines.plain) + 1
            for at, start in lines.words[bisect_right(lines.words, (begin, len(lines.text))):bisect_right(lines.words, (end - 1, len(lines.text)))]:
                if (found := lines.known(at)) and found[0][0] not in WEAK:
                    yield last, start, found[1], found[0], found[2]
                    i = found[1] + 1
                    break


def sentences(text: str) -> Iterator[tuple[int, int, Identity | None]]:
    """(start, end, identity) of the text's sentences. A sentence is taken apart where a line begins a known one; one that
    may go on (a copyright, say) goes on until then. What isn't known is taken line by line. Sentences without a letter are
    passed over."""
    for start, end in _spans(text):
        if not _HINT.search(text, start, end):
            if any(map(str.isalpha, text[start:end])):
                yield start, end, None
            continue
        lines = _Lines(text, start, end)
        found, i, n = [*_known(lines)], 0, len(lines.begins)
        for k, (first, at, last, identity, open_end) in enumerate(found):
            yield from _unknown(lines, i, first)
            following = found[k + 1] if k + 1 < len(found) else (n, None)
            i = last + 1
            if open_end:
                i = max(i, following[0])
                if identity[0] in WEAK:  # it does not go on over what names a licence
                    i = next((j for j in range(last + 1, i) if (to := lines.like(lines.begins[j])) is not None and to < i), i)
                last = max(last, i - 1)
            stop = lines.span(last, last)[1]
            if following[1] is not None and following[1] < stop:  # in the same line
                stop = at + len(text[at:following[1]].rstrip())
            yield at, stop, identity
        yield from _unknown(lines, i, n)


def _unknown(lines: _Lines, first: int, end: int) -> Iterator[tuple[int, int, Identity | None]]:
    for i in range(first, end):
        a, b = lines.span(i, i)
        if (to := lines.like(lines.begins[i])) is not None and to < end:
            yield a, lines.span(end - 1, end - 1)[1], (LIKE, ())
            return
        if any(map(str.isalpha, lines.text[a:b])):
            yield a, b, None


def _fit(rule: tuple[str, ...], names: list[str]) -> int:
    """How many identifiers from the first on the rule takes; 0 if it does not fit."""
    at = 0
    for step in rule:
        if at < len(names) and names[at] == step.rstrip("?"):
            at += 1
        elif not step.endswith("?"):
            return 0
    return at


def scan(text: str | None) -> Iterator[tuple[str | None, str, int, int, list[str]]]:
    """(rule, licence, start, length, identifiers) of every match, in order of the text."""
    if not text or not _HINT.search(text):
        return
    run: list[tuple[int, int, Identity]] = []
    for start, end, known in [*sentences(uncommented(text)), (0, 0, None)]:
        if known:
            run.append((start, end, known))
            continue
        at = 0  # the run of known sentences has ended
        while at < len(run):
            names = [k[0] for _, _, k in run[at:]]
            rule, licence, took = next(((r, l, n) for r, l, steps in RULES if (n := _fit(steps, names))), (None, UNKNOWN, 1))
            part = run[at:at + took]
            if rule or names[0] not in WEAK:
                values = [v for _, _, k in part for v in k[1]]
                yield rule, licence.format(*values), part[0][0], part[-1][1] - part[0][0], names[:took]
            at += took
        run = []


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each licence found in each document: its id, rule, licence, start and length in code points, sentences.

    ``licence`` is ``unknown`` and ``rule`` null for licence sentences that fit no rule. Null and empty texts, and an empty
    table, give no rows. Null and repeated ids keep their rows. Other columns are not read.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *match) for i, text in enumerate(batch.column(1)) for match in scan(text.as_py())]
            which, rule, licence, start, length, names = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(rule, pa.string()), pa.array(licence, pa.string()), pa.array(start, pa.int64()),
                                              pa.array(length, pa.int64()), pa.array(names, pa.list_(pa.string()))], ["id", "rule", "licence", "start", "length", "sentences"])

    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(find, f"id {kind}, {MATCHES}").withColumnRenamed("id", id_col)
