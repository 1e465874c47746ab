"""Byte-pair encoding and decoding by an index of pair occurrences.

The words of a batch of documents stand in one array of symbols. Every adjacent pair is looked up in the merge table
once, and the places of each pair are listed under its rank. The ranks that occur are then applied in ascending
order, each at all its places at once, and the pairs that arise or vanish beside a merge update the lists they are
in. No word spans white space, so a worker remembers the ids of what stands between white space, and each word is
encoded about once per worker, not once per place.

The text is prepared as the tokenizer's file says: canonical composition, runs of white space to one space, lower
case, split into words, bytes as letters. Decoding joins the tokens of the ids by a space.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import python_workers, table

#: Words whose ids a worker remembers, and characters of text whose new words are encoded together.
KNOWN_WORDS = 600_000
BATCH_CHARS = 8_000_000

_SPACES = regex.compile(r"\s+")
#: What Python splits a text at, but the tokenizer doesn't.
_NO_SPACES = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if it is printable in Latin-1, else the next letter from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """What the tokenizer's file says, as tables for numpy."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.whole = spec
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (ids | self.special).items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.final = np.array([ids[c + self.suffix] for c in letters], np.int64)
        self.size = max(self.tokens) + 1
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        # A merge must come after those that make its parts; then no merge brings up a pair of lower rank.
        first_made = {t: r for r, t in reversed(list(enumerate(self.made.tolist())))}
        last_made = {t: r for r, t in enumerate(self.made.tolist())}
        for rank, parts in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            if any(last_made.get(p, -1) >= rank for p in parts) or len(first_made) != len(merges):
                raise ValueError("the ranks of this vocabulary can't be applied in one ascending pass")
        keys = left * self.size + right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.same_parts = left == right
        self.table = [self.tokens.get(i, "").encode() for i in range(self.size)]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it is no merge."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.by_key[at], -1)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers. The words are UTF-8, none of them empty."""
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        total = len(symbol)
        after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
        after[ends - 1] = -1
        before[ends - lengths] = -1

        listed: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enlist(places: np.ndarray) -> None:
            """Put places of pairs on the lists of their ranks."""
            rank = self.ranks(symbol[places], symbol[after[places]])
            places, rank = places[rank >= 0], rank[rank >= 0]
            if not len(places):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            starts = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]])
            for r, part in zip(rank[starts].tolist(), np.split(places, starts[1:]), strict=True):
                if r not in listed:
                    listed[r] = []
                    heapq.heappush(active, r)
                listed[r].append(part)

        enlist(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            lists = listed.pop(rank)
            places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            follow = after[places]
            live = (symbol[places] >= 0) & (follow >= 0)
            places, follow = places[live], follow[live]
            live = self.ranks(symbol[places], symbol[follow]) == rank  # one side may have merged meanwhile
            places, follow = places[live], follow[live]
            if not len(places):
                continue
            if self.same_parts[rank]:
                # In a run of one symbol the pairs overlap; from the left, every other one is merged.
                taken, last = [], -1
                for k, (a, b) in enumerate(zip(places.tolist(), follow.tolist(), strict=True)):
                    if a != last:
                        taken.append(k)
                        last = b
                places, follow = places[taken], follow[taken]
            symbol[places] = self.made[rank]
            symbol[follow] = -1
            beyond = after[follow]
            after[places] = beyond
            inside = beyond >= 0
            before[beyond[inside]] = places[inside]
            previous = before[places]
            enlist(np.unique(np.concatenate([places[inside], previous[previous >= 0]])))
        kept = symbol >= 0
        counts = np.add.reduceat(kept, ends - lengths)
        flat = symbol[kept].astype("<u4").tobytes()
        cuts = np.concatenate([[0], np.cumsum(counts)]) * 4
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class Encoder:
    """Encodes and decodes texts, and remembers words."""

    def __init__(self, spec: str) -> None:
        self.vocabulary = Vocabulary(spec)
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self._library = None

    def _prepared(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if not text.isascii():
            if any(unicodedata.category(c) == "Cn" for c in set(text)):
                # Characters newer than this Python's tables: the tokenizer's own tables say what they are.
                return self._prepared_by_library(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no special form at a word's end
        return self.vocabulary.words.findall(_SPACES.sub(" ", text).lower())

    def _prepared_by_library(self, text: str) -> list[str]:
        from tokenizers import Tokenizer

        if self._library is None:
            self._library = Tokenizer.from_str(json.dumps(self.vocabulary.whole))
        text = self._library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        """Words and special tokens; the latter, which no word equals, are known from the start."""
        if "<|" not in text:
            return self._prepared(text)
        parts = self.vocabulary.cut.split(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self._prepared(part))]

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of pieces of text that end at white space."""
        if len(self.known) + len(self.chunks) > KNOWN_WORDS:
            self.known.clear()
            self.chunks.clear()
        known = self.known
        if not known:
            known.update({t: np.array([i], "<u4").tobytes() for t, i in self.vocabulary.special.items()})
        split = [self.words(c) for c in chunks]
        new = list({w: None for words in split for w in words if w not in known})
        if new:
            known.update(zip(new, self.vocabulary.encode_words([w.encode() for w in new]), strict=True))
        self.chunks.update(zip(chunks, [b"".join([known[w] for w in words]) for words in split], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        split = [[t] if _NO_SPACES.search(t) else t.split() for t in texts]
        new = set().union(*split).difference(self.chunks)
        if new:
            held = len(self.chunks)
            self._learn(sorted(new))
            if len(self.chunks) < held + len(new):  # what was forgotten is needed too
                self._learn(sorted(set().union(*split).difference(self.chunks)))
        known = self.chunks
        return [b"".join([known[c] for c in chunks]) for chunks in split]

    def decode(self, ids: bytes) -> bytes:
        """The tokens of the ids, joined by a space, in UTF-8."""
        token = self.vocabulary.table
        return b" ".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()])


_encoders: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(spec)
    return _encoders[name]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` (UTF-8).

    ``vocabulary`` is the text of the tokenizer's file; it is broadcast, its size does not depend on the documents. A
    null or empty text has no ids and decodes to an empty text. Nothing is shuffled.
    """
    spark = docs.sparkSession
    python_workers(spark)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)

        def finish(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [t or "" for b in waiting for t in b.column("encoded_text").to_pylist()]
            ids = iter(encoder.encode(texts))
            for batch in waiting:
                own = [next(ids) for _ in range(batch.num_rows)]
                kept = [n for n in batch.schema.names if n != "encoded_text"]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(n) for n in kept],
                        pa.array(own, pa.binary()),
                        pa.array([encoder.decode(x) for x in own], pa.binary()),
                    ],
                    names=[*kept, "ids", "decoded"],
                )

        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += batch.column("encoded_text").nbytes
            if size > BATCH_CHARS:
                yield from finish(waiting)
                waiting, size = [], 0
        if waiting:
            yield from finish(waiting)

    given = docs.select(*carry, F.col(text).alias("encoded_text"))
    kept = given.drop("encoded_text").schema
    return given.mapInArrow(run, kept.add("ids", "binary").add("decoded", "binary"))


def read_vocabulary(path: str) -> str:
    """The text of a tokenizer's file, which the driver reads."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of every document's ids and of their decoded text. ``path`` is the tokenizer's file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    encoded = encode(table(spark, sf_dir, "documents"), read_vocabulary(path))
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
