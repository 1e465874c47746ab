"""Language identification by cross-parsing entropy.

A sample of labelled text gives each language a suffix automaton. A text is parsed against it greedily into the
longest phrases that the sample holds; the fewer phrases, the closer the language. With ``c`` phrases over ``n``
characters and a sample of ``N`` characters the cross-parsing entropy is ``c * log2(N) / n`` bits a character; the
language with the least wins. Phrases end at word boundaries, so a word's phrase counts depend on the word alone and
are found once per worker; a text of any length is then a sum over its words.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.llm.common import crc_rest, python_workers, table

#: The sample of one language: at most this many labelled rows, each with at most this many characters, which begin
#: where the row's hash says; and at most this many languages, those with the most rows.
SAMPLE_ROWS = 60
SAMPLE_ROW_CHARS = 2_000
SAMPLE_LANGUAGES = 500
#: In the stage, a text of this many letters or more goes if the phrases of its best language have fewer on average.
LEAST_LETTERS = 50
LEAST_PHRASE = 1.5
#: Words whose phrase counts a worker remembers.
KNOWN_WORDS = 400_000

UNKNOWN = "und"

_RUNS = re.compile(r"[^\W\d_]+")


class SuffixAutomaton:
    """The smallest automaton of all substrings of the words added."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self._link = [-1]
        self._length = [0]

    def _state(self, length: int, link: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self._length.append(length)
        self._link.append(link)
        return len(self.next) - 1

    def _divide(self, state: int, letter: str, target: int) -> int:
        """The part of ``target`` that is no longer than the path through ``state``, as a state of its own."""
        part = self._state(self._length[state] + 1, self._link[target], dict(self.next[target]))
        self._link[target] = part
        while state >= 0 and self.next[state].get(letter) == target:
            self.next[state][letter] = part
            state = self._link[state]
        return part

    def add(self, word: str) -> None:
        last = 0
        for letter in word:
            known = self.next[last].get(letter)
            if known is not None:
                whole = self._length[known] == self._length[last] + 1
                last = known if whole else self._divide(last, letter, known)
                continue
            new = self._state(self._length[last] + 1, 0, {})
            state = last
            while state >= 0 and letter not in self.next[state]:
                self.next[state][letter] = new
                state = self._link[state]
            if state >= 0:
                target = self.next[state][letter]
                whole = self._length[target] == self._length[state] + 1
                self._link[new] = target if whole else self._divide(state, letter, target)
            last = new

    def phrases(self, word: str) -> int:
        """Greedy longest matches that cover the word; a letter that occurs nowhere is a phrase."""
        count = state = 0
        for letter in word:
            following = self.next[state].get(letter)
            if following is None:
                count += state != 0
                following = self.next[0].get(letter, -1)
                if following < 0:
                    count += 1
                    following = 0
            state = following
        return count + (state != 0)


def letters(run: str) -> str:
    """The letters of a run of word characters, which may hold other numerals than digits."""
    return run if run.isalpha() else "".join(c for c in run if c.isalpha())


def words(text: str) -> list[str]:
    return _RUNS.findall(text.lower())


class Parser:
    """Phrase counts of words for each language, in the order of ``names``."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.names = sorted(samples)
        self.automata, bits = [], []
        for name in self.names:
            automaton = SuffixAutomaton()
            seen: dict[str, None] = {}
            for text in samples[name]:
                seen |= dict.fromkeys(w for run in words(text) if (w := letters(run)))
            for word in seen:
                automaton.add(f" {word} ")
            self.automata.append(automaton)
            bits.append(math.log2(2 + sum(len(word) + 1 for word in seen)))
        self.bits = np.array(bits)
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.costs = np.zeros((1024, len(self.names) + 1), np.int64)

    def _place(self, run: str) -> int:
        word = letters(run)
        at = self.places[run] = len(self.places)
        if at == len(self.costs):
            self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
        if word:
            self.costs[at, :-1] = [a.phrases(f" {word} ") for a in self.automata]
            self.costs[at, -1] = len(word)
        return at

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language, and by how much its entropy is below the second best."""
        return self.parse(text)[:2]

    def parse(self, text: str | None) -> tuple[str, float, float, int]:
        """The language, by how much its entropy is below the second best, from 0 to 1, the letters of a phrase on
        average, and the letters in all."""
        found = words(text or "")
        if len(self.places) > KNOWN_WORDS:
            self._forget()
        known, place = self.places.get, self._place
        at = [known(w, -1) for w in found]
        if -1 in at:
            at = [place(w) if (k := known(w)) is None else k for w in found]
        sums = self.costs[at].sum(0) if at else self.costs[0] * 0
        if not sums[-1] or not self.names:
            return UNKNOWN, 0.0, 0.0, int(sums[-1])
        entropy = sums[:-1] * self.bits / sums[-1]
        order = np.argsort(entropy, kind="stable")
        phrase = float(sums[-1] / max(1, sums[order[0]]))
        if len(order) == 1:
            return self.names[0], 1.0, phrase, int(sums[-1])
        best, second = entropy[order[0]], entropy[order[1]]
        return self.names[order[0]], float(1 - best / second) if second > 0 else 0.0, phrase, int(sums[-1])


_parsers: dict[str, Parser] = {}


def sample(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> dict[str, list[str]]:
    """Per language, ``SAMPLE_ROWS`` rows drawn by hash, of a long row a stretch from anywhere in it, also by hash.

    The rows of each language are counted, then a share of them is drawn that holds ten times the rows needed, so
    what is shuffled and sent to the driver is bounded by the number of languages, and that by ``SAMPLE_LANGUAGES``.
    """
    named = labelled.where(F.col(lang).isNotNull()).withColumn("sample_lang", F.col(lang).cast("string"))
    largest = named.groupBy("sample_lang").count().orderBy(F.desc("count"), "sample_lang").limit(SAMPLE_LANGUAGES)
    counts = {r[0]: r[1] for r in largest.collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, min(1.0, 10 * SAMPLE_ROWS / n))])
    h = F.xxhash64(F.col(key).cast("string"), F.length(text))
    begin = F.pmod(F.xxhash64(h), F.greatest(F.length(text) - SAMPLE_ROW_CHARS, F.lit(0)) + 1).cast("int")
    # A stretch that begins or ends within a word leaves that word out.
    stretch = F.substring(F.col(text), begin + 1, F.lit(SAMPLE_ROW_CHARS))
    stretch = F.when(begin > 0, F.regexp_replace(stretch, r"^\S+\s", "")).otherwise(stretch)
    cut = begin + SAMPLE_ROW_CHARS < F.length(text)
    drawn = named.where(F.pmod(h, F.lit(1 << 40)) < share[F.col("sample_lang")] * (1 << 40)).select(
        F.col("sample_lang").alias("lang"),
        F.when(cut, F.regexp_replace(stretch, r"\s\S+$", "")).otherwise(stretch).alias("text"),
        h.alias("h"),
    )
    usable = drawn.where(F.col("text").rlike(r"\p{L}"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    out: dict[str, list[str]] = {}
    for row in usable.withColumn("k", rank).where(F.col("k") <= SAMPLE_ROWS).collect():
        out.setdefault(row["lang"], []).append(row["text"])
    return {name: sorted(texts) for name, texts in out.items()}


def identify(docs: DataFrame, samples: dict[str, list[str]], text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry``, ``lang_pred``, ``score``, ``phrase`` (letters of one, on average) and ``letters``.

    A text that is null or has no letter gives ``und`` and 0, as does any text without a sample. Texts of any length are
    parsed whole; repeated rows have a result each; only ``carry`` of the other columns is read. Ties go to the first
    language by name. The samples are bounded, so is what is broadcast; each worker builds the automata once.
    """
    spark = docs.sparkSession
    python_workers(spark)
    shared = spark.sparkContext.broadcast(samples)
    key = uuid.uuid4().hex

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if key not in _parsers:
                _parsers.clear()
                _parsers[key] = Parser(shared.value)
            parser = _parsers[key]
            results = [parser.parse(t) for t in batch.column("judged_text").to_pylist()]
            columns = [c for name, c in zip(batch.schema.names, batch.columns, strict=True) if name != "judged_text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns,
                    *[pa.array([r[k] for r in results], t) for k, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.int64()))],
                ],
                names=[*[n for n in batch.schema.names if n != "judged_text"], "lang_pred", "score", "phrase", "letters"],
            )

    given = docs.select(*carry, F.col(text).alias("judged_text"))
    kept = given.drop("judged_text").schema
    return given.mapInArrow(judged, kept.add("lang_pred", "string").add("score", "double").add("phrase", "double").add("letters", "long"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32 leaves another rest than 2 by 4."""
    docs = table(spark, sf_dir, "documents")
    samples = sample(docs.where(crc_rest(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(crc_rest(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify(docs, samples).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text is in one of the languages, with all their columns.

    Texts without a letter go, and texts of ``LEAST_LETTERS`` or more whose best language needs a phrase for every
    ``LEAST_PHRASE`` letters: letters without a language. The languages are learned from ``lang`` of the documents
    themselves, under the same folds as the query; where no document tells one, only texts without a letter go.
    """
    samples = sample(docs.where(crc_rest(F.col("doc_id"), 4) != 2))
    packed = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    judged = identify(packed, samples, carry=("row",))
    unlike = (F.col("lang_pred") != UNKNOWN) & (F.col("letters") >= LEAST_LETTERS) & (F.col("phrase") < LEAST_PHRASE)
    return judged.where((F.col("letters") > 0) & ~unlike).select("row.*")
