"""License scans: template-markup matching.

A template is wording with markup: `<<beginOptional>>...<<endOptional>>` may be absent and `<<var;max=N>>` stands for
0 to N words of any kind. It compiles to a token automaton. The longest run of mandatory words outside all markup is
its anchor: where an anchor stands in a text, the automaton of what follows it runs forward and that of what precedes
it runs backward; both must accept, so mandatory wording matches exactly, word for word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import common

#: Base phrases and their labels (fixed values of the contract).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label and wording; public license texts and notices, whole (fixed values). A version is mandatory where it makes the label.
TEMPLATES = (
    ("mit", "<<beginOptional>>released<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    (
        "mit",
        "<<beginOptional>>MIT License<<endOptional>> <<beginOptional>>Copyright <<var;max=20>><<endOptional>> Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;max=8>> (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0<<beginOptional>> (the \"License\"); you may not use this file except in compliance with the License<<beginOptional>>. You may obtain a copy of the License at <<var;max=12>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.<<endOptional>><<endOptional>>",
    ),
    ("gpl-3.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version 3<<beginOptional>>.0<<endOptional>><<beginOptional>> or <<beginOptional>>any<<endOptional>> later <<beginOptional>>version<<endOptional>><<endOptional>>"),
    ("gpl-2.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version 2<<beginOptional>>.0<<endOptional>><<beginOptional>> or <<beginOptional>>any<<endOptional>> later <<beginOptional>>version<<endOptional>><<endOptional>>"),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or <<beginOptional>>(at your option) <<endOptional>>any later version.",
    ),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or <<beginOptional>>(at your option) <<endOptional>>any later version.",
    ),
    (
        "lgpl-2.1",
        "This <<var;max=1>> is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or <<beginOptional>>(at your option) <<endOptional>>any later version.",
    ),
    (
        "lgpl-3.0",
        "This <<var;max=1>> is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or <<beginOptional>>(at your option) <<endOptional>>any later version.",
    ),
    (
        "agpl-3.0",
        "This <<var;max=1>> is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or <<beginOptional>>(at your option) <<endOptional>>any later version.",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.<<beginOptional>> If a copy of the MPL was not distributed with this file, You can obtain one at <<var;max=8>><<endOptional>>"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> CC BY-SA 4.0"),
    (
        "isc",
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND <<var;max=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<var;max=12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "bsd-3-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1. <<endOptional>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2. <<endOptional>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<beginOptional>>3. <<endOptional>>Neither the name of <<var;max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY <<var;max=12>> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
)

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;max=(\d+))>>")


def words_of(text: str) -> list[bytes]:
    """Lower-cased words: runs of a-z, 0-9 and bytes beyond ASCII."""
    return text.encode().translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Automaton:
    """States 0..accept; steps: (state, word or None for any) -> next; free: moves that take no word."""

    steps: dict
    free: dict
    accept: int

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for t in self.free.get(todo.pop(), ()):
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def longest(self, words: list[bytes], start: int, direction: int) -> int | None:
        """How many words from `start` on, in this direction, the longest accepted run has; None if none is."""
        states, taken = self.closure({0}), 0
        best = 0 if self.accept in states else None
        while states and 0 <= (i := start + direction * taken) < len(words):
            states = {t for s in states for t in (*self.steps.get((s, words[i]), ()), *self.steps.get((s, None), ()))}
            states, taken = self.closure(states), taken + 1
            if self.accept in states:
                best = taken
        return best


@dataclass(frozen=True)
class Template:
    label: str
    anchor: tuple[bytes, ...]
    before: Automaton
    after: Automaton

    def match(self, words: list[bytes], at: int) -> tuple[int, int] | None:
        """The span that the template takes with its anchor at this word."""
        back = self.before.longest(words, at - 1, -1)
        ahead = None if back is None else self.after.longest(words, at + len(self.anchor), 1)
        return None if ahead is None else (at - back, at + len(self.anchor) + ahead)


def _parse(wording: str) -> list:
    """Items in order: a word, an int (any words, up to that many) or a list (an optional region)."""
    stack: list[list] = [[]]
    at = 0
    for m in [*_MARKUP.finditer(wording), None]:
        stack[-1] += words_of(wording[at : m.start() if m else None])
        if m is None:
            break
        at = m.end()
        if m[2]:
            stack[-1].append(int(m[2]))
        elif m[1] == "beginOptional":
            stack.append([])
        else:
            inner = stack.pop()
            if not stack:
                raise ValueError("endOptional without a beginOptional")
            stack[-1].append(inner)
    if len(stack) > 1:
        raise ValueError("beginOptional without an endOptional")
    return stack[0]


def _automaton(items: list, backward: bool = False) -> Automaton:
    steps: dict = {}
    free: dict = {}
    n = 0

    def build(items: list, state: int) -> int:
        nonlocal n
        for x in reversed(items) if backward else items:
            start = state
            if isinstance(x, list):
                state = build(x, state)
                free.setdefault(start, []).append(state)
            elif isinstance(x, int):
                ends = [start]
                for _ in range(x):
                    n += 1
                    steps.setdefault((state, None), []).append(n)
                    ends.append(state := n)
                n += 1
                for s in ends:
                    free.setdefault(s, []).append(n)
                state = n
            else:
                n += 1
                steps.setdefault((state, x), []).append(n)
                state = n
        return state

    return Automaton(steps, free, build(items, 0))


def compile_template(label: str, wording: str) -> Template:
    """Splits the wording around its anchor and compiles both sides."""
    items = _parse(wording)
    runs, start = [], None
    for i, x in enumerate([*items, []]):
        if isinstance(x, bytes):
            start = i if start is None else start
        elif start is not None:
            runs.append((start, i))
            start = None
    if not runs:
        raise ValueError("a template needs mandatory words")
    a, b = max(runs, key=lambda r: sum(map(len, items[r[0] : r[1]])))
    b = min(b, a + 8)
    return Template(label, tuple(items[a:b]), _automaton(items[:a], backward=True), _automaton(items[b:]))


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase (with a space on each side) starts in the joined words."""
    out, p, seen, at = [], joined.find(phrase), 0, 0
    while p >= 0:
        seen += joined.count(b" ", at, p)
        at = p
        out.append(seen)
        p = joined.find(phrase, p + 1)
    return out


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases = [(b" %b " % p.encode(), label) for p, label in phrases]
        self.templates = [compile_template(*t) for t in templates]
        self.anchors = [b" %b " % b" ".join(t.anchor) for t in self.templates]

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
        words = words_of(text)
        joined = b" %b " % b" ".join(words)
        places, base = [], set()
        covered: set[int] = set()
        for phrase, label in self.phrases:
            if found := _places(joined, phrase):
                places += found
                base.add(label)
                k = phrase.count(b" ") - 1
                covered.update(i + j for i in found for j in range(k))
        labels, spans = set(base), []
        for template, anchor in zip(self.templates, self.anchors, strict=True):
            for at in _places(joined, anchor):
                if span := template.match(words, at):
                    labels.add(template.label)
                    spans.append((template.label, *span))
                    covered.update(range(*span))
        score = len(covered) / len(words) if words else 0.0
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score is the share of the words that stand in base phrases or matched templates. spans lists label:start-end of
    each match. Null and empty texts have no words, empty labels, null places and score 0. Very long texts are scanned
    whole. Rows are independent: ties and repeated rows give repeated results, an empty table none; other columns are
    ignored.
    """

    def make():
        scanner = Scanner()

        def work(texts: list[str]) -> list[list]:
            rows = [scanner.scan(t) for t in texts]
            columns = [list(c) for c in zip(*rows, strict=True)]
            columns[-1] = [";".join(f"{label}:{a}-{b}" for label, a, b in sorted(s)) for s in columns[-1]]
            return columns

        return work

    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    return common.map_texts(docs, ["doc_id"], made, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string", make)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
