"""License scans by template markup.

A template is the wording of a license with marked regions: optional ones may be left out, replaceable ones stand for
any few words. It is compiled into an automaton over words. A place in a text matches if the automaton accepts the
words from there on, which is the case only if every mandatory word stands where it must.

Words are runs of ASCII letters, digits and characters beyond ASCII, with A to Z in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from touchline.llm import wordings
from touchline.llm.common import python_workers, table

#: Phrases that are looked for in any case, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_ITEM = "<<var;min=0;max=1>>"  # the number of a clause, or nothing
_BSD = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: {_ITEM} Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. {_ITEM} Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. <<third>> THIS SOFTWARE IS PROVIDED BY <<var;min=1;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL <<var;min=1;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_THIRD = f"""{_ITEM} Neither the name of <<var;min=1;max=12>> nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""


def _header(name: str, version: str) -> str:
    """The header that the FSF's licenses give for source files, from "free software" to "for more details"."""
    return f"""free software: you can redistribute it and/or modify it under the terms of
the GNU {name} Public License as published by the Free Software Foundation, <<beginOptional>>either <<endOptional>>
version {version} of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>.
<<var;min=1;max=8>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details."""


# Wordings of licenses and of the notices that name them, with the marked regions.
TEMPLATES = {
    "mit-notice": "<<beginOptional>>This <<var;min=1;max=3>> is <<endOptional>><<beginOptional>>available <<endOptional>>"
    "<<beginOptional>>distributed <<endOptional>>released under the MIT License",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;min=1;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0<<beginOptional>> (the \"License\")<<endOptional>>",
    "gpl-3-notice": "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License"
    "<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either "
    "<<endOptional>>version 3<<beginOptional>> of the License<<endOptional>>",
    "gpl-notice": "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License",
    "cc-by-nc-notice": "Licensed under <<beginOptional>>a <<endOptional>>CC BY-NC 4.0",
    "mpl-2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc-text": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for
any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;min=1;max=12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO
THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;min=1;max=12>> BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-text": _BSD.replace("<<third>>", ""),
    "bsd-3-text": _BSD.replace("<<third>>", _THIRD),
    "gpl-2-header": _header("General", "2"),
    "gpl-3-header": _header("General", "3"),
    "lgpl-2.1-header": _header("Lesser General", "2.1"),
    "lgpl-3-header": _header("Lesser General", "3"),
    "agpl-3-header": _header("Affero General", "3"),
    "lgpl-notice": "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU Lesser General Public License",
    "agpl-notice": "licensed under the <<beginOptional>>terms of the <<endOptional>>GNU Affero General Public License",
    "apache-2-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at <<var;min=4;max=10>> Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "mpl-2-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at <<var;min=1;max=2>>mozilla.org/MPL/2.0""",
    "cc-by-notice": "licensed under <<beginOptional>>a <<endOptional>>CC BY 4.0",
    "cc-by-sa-notice": "licensed under <<beginOptional>>a <<endOptional>>CC BY-SA 4.0",
    "cc-by-name": "Creative Commons Attribution <<beginOptional>>License <<endOptional>>4.0",
    "cc-by-sa-name": "Creative Commons Attribution-ShareAlike <<beginOptional>>License <<endOptional>>4.0",
    "cc-by-nc-name": "Creative Commons Attribution-NonCommercial <<beginOptional>>License <<endOptional>>4.0",
    "cc0-notice": "CC0 1.0 Universal",
    "unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "rights-reserved": "Copyright <<beginOptional>>(c) <<endOptional>><<var;min=1;max=8>> All rights reserved",
    "apache-2-text": wordings.APACHE_2,
    "mpl-2-text": wordings.MPL_2,
    "gpl-2-text": wordings.GPL_2,
    "gpl-3-text": wordings.GPL_3,
    "lgpl-2.1-text": wordings.LGPL_2_1,
    "lgpl-3-text": wordings.LGPL_3,
    "cc0-text": wordings.CC0_1,
}

# Creative Commons licenses and their versions. NoDerivatives was NoDerivs before version 4.0.
_CREATIVE_COMMONS = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
_VERSIONS = ("2.0", "2.5", "3.0", "4.0")


def _named(name: str, version: str) -> str:
    full = name if version == "4.0" else name.replace("NoDerivatives", "NoDerivs")
    return f"Creative Commons {full} <<beginOptional>>License <<endOptional>>{version}"


TEMPLATES |= {
    f"cc-{kind.lower()}-{version}": f"CC {kind} {version}" for kind in _CREATIVE_COMMONS for version in _VERSIONS
}
TEMPLATES |= {
    f"cc-{kind.lower()}-{version}-name": _named(name, version) for kind, name in _CREATIVE_COMMONS.items() for version in _VERSIONS
}

# Identifiers in source files. Both the "only" and the "or later" forms of an identifier begin with it.
_IDENTIFIERS = """MIT Apache-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 BSD-2-Clause BSD-3-Clause ISC Unlicense
CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 Zlib BSL-1.0
EPL-2.0 0BSD""".split()
TEMPLATES |= {f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in _IDENTIFIERS}

_MARK = re.compile(r"<<(beginOptional|endOptional|var;min=(\d+);max=(\d+))>>")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Words of a text, in UTF-8. No byte of a character beyond ASCII is an ASCII byte."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def parse(template: str) -> list[tuple]:
    """``("word", w)``, ``("optional", parts)`` and ``("any", least, most)`` in order."""
    stack: list[list[tuple]] = [[]]
    at = 0
    for mark in _MARK.finditer(template):
        stack[-1] += [("word", w) for w in words(template[at : mark.start()])]
        at = mark.end()
        if mark[1] == "beginOptional":
            stack.append([])
        elif mark[1] == "endOptional":
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        else:
            stack[-1].append(("any", int(mark[2]), int(mark[3])))
    stack[-1] += [("word", w) for w in words(template[at:])]
    return stack[0]


class Automaton:
    """States with a word, or any word, that leads to the next state, and with states that may be skipped to."""

    def __init__(self, template: str) -> None:
        self.word: list[bytes | None] = []  # None: any word
        self.skips: list[list[int]] = []
        self._add(parse(template))
        self.final = len(self.word)
        self.skips.append([])
        self.start = self._closed({0})
        self.first = {self.word[s] for s in self.start if s < self.final}
        self._after: dict[int, frozenset[int]] = {}

    def _add(self, parts: list[tuple]) -> None:
        for kind, *rest in parts:
            if kind == "word":
                self.word.append(rest[0])
                self.skips.append([])
            elif kind == "any":
                least, most = rest
                begin = len(self.word)
                self.word += [None] * most
                self.skips += [[begin + most] if k >= least else [] for k in range(most)]
            else:
                begin = len(self.word)
                self._add(rest[0])
                self.skips[begin].append(len(self.word))

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def _follow(self, state: int) -> frozenset[int]:
        if state not in self._after:
            self._after[state] = self._closed({state + 1})
        return self._after[state]

    def accepts(self, text: list[bytes], at: int) -> bool:
        """Whether some of the words from ``at`` on are a wording of the template."""
        states = self.start
        while self.final not in states:
            if at == len(text):
                return False
            word = text[at]
            states = frozenset().union(*[self._follow(s) for s in states if self.word[s] is None or self.word[s] == word])
            if not states:
                return False
            at += 1
        return True


@cache
def _tables() -> tuple[dict[str, Automaton], dict[bytes, list[str]], frozenset[bytes], list[tuple[list[bytes], str]]]:
    automata = {label: Automaton(t) for label, t in TEMPLATES.items()}
    begins: dict[bytes, list[str]] = {}
    for label, automaton in automata.items():
        for word in automaton.first:
            if word is None:
                raise ValueError(f"the template {label} begins with any word")
            begins.setdefault(word, []).append(label)
    phrases = [(words(p), label) for p, label in PHRASES.items()]
    # Every wording holds each of its template's mandatory words, so the longest of them tells where to look at all.
    needed = {max((w for kind, w, *_ in parse(t) if kind == "word"), key=len) for t in TEMPLATES.values()}
    return automata, begins, frozenset(needed | {max(p, key=len) for p, _ in phrases}), phrases


def scan(text: str | None) -> tuple:
    """``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``n_templates``.

    The score is 1 where a template's wording stands, one half where only a phrase does, else 0.
    """
    automata, begins, needed, phrases = _tables()
    found = words(text)
    if needed.isdisjoint(found):
        return len(found), 0, None, None, "", "", 0.0, 0
    places, base, matched, n_matched = [], set(), set(), 0
    for at, word in enumerate(found):
        for phrase, label in phrases:
            if word == phrase[0] and found[at : at + len(phrase)] == phrase:
                places.append(at)
                base.add(label)
        for label in begins.get(word, ()):
            if automata[label].accepts(found, at):
                matched.add(label)
                n_matched += 1
    return (
        len(found),
        len(places),
        min(places, default=None),
        max(places, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(base | matched)),
        1.0 if matched else 0.5 if base else 0.0,
        n_matched,
    )


_COLUMNS = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("n_templates", pa.int64()),
    ]
)


def license_labels(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row the key and what ``scan`` finds. A null or empty text has no words and no labels; nothing is shuffled."""
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[n] for r in rows], f.type) for n, f in enumerate(_COLUMNS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_COLUMNS.names])

    types = {"int64": "long", "string": "string", "double": "double"}
    rows = docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text")
    return rows.mapInArrow(run, ", ".join(["doc_id long", *[f"{f.name} {types[str(f.type)]}" for f in _COLUMNS]]))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document."""
    return license_labels(table(spark, sf_dir, "documents")).drop("n_templates")


def _pattern(parts: list[tuple]) -> str:
    """A template as a regular expression over words that each follow a space."""
    out = ""
    for kind, *rest in parts:
        if kind == "word":
            out += " " + rest[0].decode()
        elif kind == "any":
            out += f"(?: [^ ]+){{{rest[0]},{rest[1]}}}"
        else:
            out += f"(?:{_pattern(rest[0])})?"
    return out


def _condition(parts: list[tuple]) -> str:
    """Whether the words hold a template: a plain search where it has no marked region, else a regular expression."""
    if all(kind == "word" for kind, *_ in parts):
        return f"contains(s, '{_pattern(parts)} ')"
    longest = max((rest[0] for kind, *rest in parts if kind == "word"), key=len).decode()
    return f"contains(s, ' {longest} ') and regexp_matches(s, '{_pattern(parts)} ')"


def _oracle() -> str:
    base = " union all ".join(
        f"select r, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {p.count(' ')}] = {p.split(' ')})) - 1 as place,"
        f" '{label}' as label from docs"
        for p, label in PHRASES.items()
    )
    marked = ", ".join(f"case when {_condition(parse(t))} then '{label}' end" for label, t in TEMPLATES.items())
    return rf"""
with docs as materialized (
  select r, doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as s from (
    select row_number() over () as r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents)
), base as ({base}
), bases as (
  select r, count(*) as n, min(place) as first, max(place) as last, list(distinct label) as labels from base group by r
), judged as (
  select doc_id, w, n, first, last, coalesce(labels, []) as b,
         list_filter([{marked}], lambda x: x is not null) as m
  from docs left join bases using (r)
)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_base, first::bigint as first_word,
       last::bigint as last_word, array_to_string(list_sort(b), ',') as base_labels,
       array_to_string(list_sort(list_distinct(list_concat(b, m))), ',') as labels,
       case when len(m) > 0 then 1.0 when len(b) > 0 then 0.5 else 0.0 end::double as score
from judged
"""


ORACLE = _oracle()
