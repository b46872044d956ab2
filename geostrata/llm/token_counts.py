"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is run through the merges alone; those that come
out as one token form a table. A text is cut into pre-tokens; a pre-token in the
table counts one, and only the others are merged.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostrata.llm.common import chunks, table

#: How a byte-level vocabulary cuts texts. A fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest run of white space that the compiled splitter gets.
BLANKS = 4096
LONG_BLANK = regex.compile(rf"\s{{{BLANKS}}}")
#: Remembered merge results in a worker; above it the memory starts anew.
MEMO = 400_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Counts and ids of byte-level BPE texts, equal to the library's for the same file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"]:
            raise ValueError(f"{path} is not plain byte-level BPE")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take neighbours are not handled")
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.letters = byte_letters()
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["model"]["merges"])}
        # letters first: no other branch can start where that one does, so the order doesn't change the cuts
        self.cut = regex.compile(r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.seen: set[str] = set()
        self.odd: set[str] = set()
        bytes_of = {c: b for b, c in self.letters.items()}
        self.engine, self.fast = self._engine(bytes_of)
        #: Proved: text of a vocabulary string that the merges alone turn into just that token, and its id.
        self.whole: dict[str, int] = {}
        for s, i in self.vocab.items():
            if s in self.specials:
                continue
            try:
                word = bytes(bytes_of[c] for c in s).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.merged(word) == [i]:
                self.whole[word] = i
        self.counts = _Counts(self)

    def _engine(self, bytes_of: dict[str, int]):
        """A compiled merger of one pre-token and of a text, where each merge makes the next id after the single bytes, so that ids serve as ranks."""
        first = len(self.letters)
        if len(self.vocab.keys() - self.specials.keys()) != first + len(self.ranks) or any(self.vocab.get(a + b) != first + i for (a, b), i in self.ranks.items()):
            return None, None
        import tiktoken

        ids = {bytes(bytes_of[c] for c in s): i for s, i in self.vocab.items() if s not in self.specials}
        made = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
        return made._encode_single_piece, made.encode_ordinary

    def merged(self, word: str) -> list[int]:
        return self.merge(word) if self.engine is None else self.engine(word.encode())

    def merge(self, word: str) -> list[int]:
        """Token ids of one pre-token, by rank order of the merges."""
        parts = [self.letters[b] for b in word.encode()]
        ranks = self.ranks
        if len(parts) > 64:
            return self._merge_long(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.vocab[p] for p in parts]

    def _merge_long(self, parts: list[str]) -> list[int]:
        """The same by a heap over linked parts: n log n for very long pre-tokens."""
        import heapq

        n, ranks = len(parts), self.ranks
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j] = a + b, False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (p := before[i]) >= 0 and (r := ranks.get((parts[p], parts[i]))) is not None:
                heapq.heappush(heap, (r, p, parts[p], parts[i]))
        return [self.vocab[p] for p, ok in zip(parts, alive, strict=True) if ok]

    def agrees(self, text: str) -> bool:
        """Whether every character of ``text`` is classed by our pattern as by the library; each is tried on first sight."""
        new = set(text) - self.seen
        for c in new:
            probe = f"a{c}1{c}!{c} {c}\n{c}{c}a {c}1"
            own, at = self.cut(probe), 0
            spans = [(at, at := at + len(w)) for w in own]
            if spans != [s for _, s in self.library.pre_tokenizer.pre_tokenize_str(probe)] or self.fast and self.fast(probe) != self.library.encode(probe, add_special_tokens=False).ids:
                self.odd.add(c)
        self.seen |= new
        return not self.odd or self.odd.isdisjoint(text)

    def count(self, text: str) -> int:
        if not self.agrees(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if self.split_special is not None and "<" in text and self.split_special.search(text):
            parts = self.split_special.split(text)
            return len(parts) // 2 + sum(sum(map(self.counts.__getitem__, self.cut(p))) for p in parts[::2])
        return sum(map(self.counts.__getitem__, self.cut(text)))

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 16-bit numbers (vocabularies up to 65,536)."""
        if not self.agrees(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)
        if self.split_special is not None and "<" in text and self.split_special.search(text):
            out: list[int] = []
            for i, p in enumerate(self.split_special.split(text)):
                out += [self.specials[p]] if i % 2 else self._ids(p)
            return np.array(out, "<u2")
        return np.array(self._ids(text), "<u2")

    def _ids(self, text: str) -> list[int]:
        # the compiled splitter runs out of stack on very long runs of white space
        if self.fast is not None and (len(text) < BLANKS or not LONG_BLANK.search(text)):
            return self.fast(text)
        return [i for w in self.cut(text) for i in ([self.whole[w]] if w in self.whole else self.merge(w))]


class _Counts(dict):
    def __init__(self, encoder: Encoder):
        super().__init__(dict.fromkeys(encoder.whole, 1))
        self.encoder = encoder

    def __missing__(self, word: str) -> int:
        n = len(self.encoder.merged(word))
        if len(word) <= 64:
            if len(self) > MEMO + len(self.encoder.whole):
                self.clear()
                self.update(dict.fromkeys(self.encoder.whole, 1))
            self[word] = n
        return n


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(docs: DataFrame, tokenizer: str | None = None, text: str = "text", id_column: str = "doc_id", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each whole text.

    Null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated rows;
    an empty table gives none; other columns are ignored, so their names can't clash.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in chunks(batches, "text"):
            texts = batch.column(1)
            n = [enc.count(t) if t else 0 for t in texts.to_pylist()]
            size = pc.binary_length(texts.fill_null("")).cast(pa.int64())
            yield pa.record_batch([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents: nulls, empty and long texts, repeats and empty tables as in ``count_tokens``."""
    return count_tokens(table(spark, sf_dir, "documents"))
