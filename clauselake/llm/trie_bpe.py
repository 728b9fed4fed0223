"""BPE encoding of whole texts by depth-first traversal of a trie of distinct words.

A sequence of tokens is the BPE encoding of its text exactly when every token encodes
to itself and every two neighbours, merged on their own, stay the two they are. So the
encoding of a prefix is known from its last token, and the last token of a longer
prefix is the one token that ends there and stands well behind the last token before
it. The trie holds each shared prefix once, and its last token is found once.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.llm.kept import keep
from clauselake.llm.shingles import small_batches

END = "</w>"
HELD = 120_000  # words, and chunks, that each half of a worker's memory holds
# fixed values: the word pattern of the vocabulary file (as JSON), and what it comes to for
# printable ASCII in lower case
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"


class TrieEncoder:
    """Encoder for a ``tokenizers`` file with BPE, a normalizer and a word pattern."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
            raise ValueError("expected BPE with word ends")
        self.normalize = tokenizer.normalizer.normalize_str
        self.pieces = tokenizer.pre_tokenizer.pre_tokenize_str
        if WORD not in json.dumps(spec["pre_tokenizer"], ensure_ascii=False):
            raise ValueError("expected the known word pattern")
        self.plain = re.compile(PLAIN).findall
        self.ids = model["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.names = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        listed = sorted(self.special, key=len, reverse=True)
        self.at_special = re.compile("(" + "|".join(map(re.escape, listed)) + ")") if listed else None
        # every end of a token that encodes to itself: its id where it is such a token, else -1
        self.tails: dict[str, int] = {}
        self.sizes = [0] * (max(self.names) + 1)  # tokens' lengths in symbols
        for token, number in self.ids.items():
            symbols = self._symbols(token)
            self.sizes[number] = len(symbols)
            if self._merge(symbols) == [token]:
                for i in range(1, len(symbols)):
                    self.tails.setdefault(token[i:], -1)
                self.tails[token] = number
        self.longest = max(map(len, self.tails), default=1)  # a tail of more characters is none
        self.fits: dict[int, bool] = {}  # by left id * 2^32 + right id
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}
        self.old_chunks: dict[str, bytes] = {}

    @staticmethod
    def _symbols(token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            bare = token[: -len(END)]
            return [*bare[:-1], bare[-1] + END]
        return list(token)

    def _merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few symbols: the pair of least rank first, the leftmost of equals."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = [self.ranks.get(p) for p in zip(symbols, symbols[1:], strict=False)]
            known = [r for r in ranks if r is not None]
            if not known:
                break
            i = ranks.index(min(known))
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _fits(self, pair: int) -> bool:
        """Do two neighbouring tokens stay the two they are when merged on their own?"""
        ends = [self.names[pair >> 32], self.names[pair & 0xFFFFFFFF]]
        kept = self._merge(self._symbols(ends[0]) + self._symbols(ends[1])) == ends
        self.fits[pair] = kept
        return kept

    def _last(self, word: str, stop: int, end: str, before: list[int]) -> int:
        """Last token of ``word[:stop] + end``; ``before[i]`` is the last token of ``word[:i]``.

        Only the characters that the longest token could cover are looked at.
        """
        tails, fits, found = self.tails, self.fits, []
        at, low = stop, max(0, stop - self.longest)
        while at > low:
            at -= 1
            number = tails.get(word[at:stop] + end if end else word[at:stop])
            if number is None:
                break
            if number >= 0:
                if not at:
                    return number
                found.append((before[at] << 32) | number)
        for pair in reversed(found):
            if (known := fits.get(pair)) is None:
                known = self._fits(pair)
            if known:
                return pair & 0xFFFFFFFF
        raise ValueError(f"no token for {word[stop - 1] + end!r}")

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Ids of distinct words (in the byte alphabet), by one traversal of their trie.

        Sorted words are the leaves of their trie in depth-first order: from one to the
        next the walk climbs to the end of their common prefix and goes down again.
        ``before`` is the path's state, kept for the prefix that both share.
        """
        out: dict[str, bytes] = {}
        before, above, sizes = [0], "", self.sizes
        for word in sorted(words):
            depth = 0
            for x, y in zip(above, word, strict=False):
                if x != y:
                    break
                depth += 1
            del before[depth + 1 :]
            for at in range(len(before), len(word)):
                before.append(self._last(word, at, "", before))
            tokens = [self._last(word, len(word), END, before)]
            at = len(word) - sizes[tokens[0]]
            while at:
                tokens.append(before[at])
                at -= sizes[before[at]]
            tokens.reverse()
            out[word] = array("I", tokens).tobytes()
            above = word
        return out

    def _split(self, chunk: str) -> list[str]:
        if chunk.isascii() and chunk.isprintable():  # as the pattern below, without its Unicode
            return self.plain(chunk.lower())
        return [p for p, _ in self.pieces(self.normalize(chunk))]

    def learn(self, chunks: set[str]) -> None:
        """Remember the ids of chunks of text without blanks between.

        When the memory is full the current half becomes the old one, from which what is
        met again is taken over, and the old half goes.
        """
        if len(self.chunks) + len(chunks) > HELD:
            self.old_chunks, self.chunks = self.chunks, {"": b""}
        if len(self.words) + len(chunks) > HELD:
            self.old_words, self.words = self.words, {}
        again = chunks & self.old_chunks.keys()
        for chunk in again:
            self.chunks[chunk] = self.old_chunks[chunk]
        split = {c: self._split(c) for c in chunks - again}
        new = {w for ws in split.values() for w in ws}.difference(self.words)
        again = new & self.old_words.keys()
        for word in again:
            self.words[word] = self.old_words[word]
        self.words.update(self.encode_words(new - again))
        for chunk, ws in split.items():
            if len(ws) == 1:
                self.chunks[chunk] = self.words[ws[0]]
            else:
                self.chunks[chunk] = b"".join([self.words[w] for w in ws])

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text (little-endian, 32 bits)."""
        cut = [self._cut(t or "") for t in texts]
        for start in range(0, len(cut), 64):
            some = cut[start : start + 64]
            seen = set().union(*(part for parts in some for part in parts[::2]))
            new = seen.difference(self.chunks)
            if new:
                full = len(self.chunks) + len(new) > HELD
                self.learn(seen - {""} if full else new)
            known = self.chunks
            for parts in some:
                yield b"".join(
                    [
                        self.special[part].to_bytes(4, "little")
                        if i % 2
                        else b"".join([known[c] for c in part])
                        for i, part in enumerate(parts)
                    ]
                )

    def rest(self) -> None:
        """Give memory back between tasks; the current words stay."""
        self.chunks, self.old_chunks, self.old_words = {"": b""}, {}, {}

    def _cut(self, text: str) -> list:
        """Chunks between special tokens (even places) and the tokens (odd places).

        Blanks, tabs and line ends always separate words, and normalization does not
        reach across them, so each chunk stands alone.
        """
        parts = self.at_special.split(text) if self.at_special else [text]
        for i in range(0, len(parts), 2):
            plain = parts[i].replace("\n", " ").replace("\t", " ").replace("\r", " ")
            parts[i] = plain.split(" ")
        return parts

    def decode(self, ids: bytes) -> str:
        """Token names joined by blanks: what a tokenizer without a decoder gives."""
        return " ".join(map(self.names.__getitem__, array("I", ids)))


def encoder(path: str) -> TrieEncoder:
    """The worker's encoder of a vocabulary file, kept from task to task."""
    return keep(path, lambda: TrieEncoder(path))


def encode(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = True
) -> DataFrame:
    """``doc_id, ids, decoded`` for every row: whole text, in the row's own partition.

    Without ``decoded`` that column is null. ``ids`` is binary (unsigned 32-bit,
    little-endian). A null or empty text has no ids. Null ids and repeated rows are kept as they are; other columns are not carried. Words
    are distinct per worker, so nothing is shuffled. ``path`` must be readable on every
    executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            for start in range(0, batch.num_rows, 128):
                own = encoder(path)
                done = list(own.encode(column.slice(start, 128).to_pylist()))
                texts = [own.decode(ids) if decoded else None for ids in done]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(start, 128),
                        pa.array(done, pa.binary()),
                        pa.array(texts, pa.string()),
                    ],
                    names=["doc_id", "ids", "decoded"],
                )
        encoder(path).rest()

    small_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` and the digests of ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
