"""BPE by a prefix-sharing trie.

The byte pair encoding of a word's prefix ends in one token, and this token alone is what the encoding of
longer prefixes builds on: the prefix without it is encoded as before. So a prefix's state is its last
token, and the state of a prefix one symbol longer is the token that ends there and may follow the state of
what precedes it. Whether two tokens may stand side by side is decided by undoing their merges from the
latest on: had the merge across the border come earlier, they would not.

The distinct words of a slice of documents form a trie. It is walked depth first, with the states from the root
to the present node on a stack, so that the encoding of a prefix that many words share is computed once. Walking
the sorted words and keeping the stack up to the prefix shared with the word before is that very walk;
nodes are never kept beyond the present path. A word's last symbol carries the end mark and so is a leaf.

Encodings of pieces between spaces are kept in a bounded cache per worker. Documents are encoded where they lie:
there is no shuffle, and a task holds one slice of texts.

Defined cases: a null or empty text has no tokens and decodes to the empty text; the texts of special tokens
are special tokens, as the library has it; repeated rows give equal rows; an empty table gives no rows;
columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stagewatch.llm.common import Recent, slices, table, texts, tidy
from stagewatch.llm.registry import query

#: Of each cache's newer generation, entries and about so many bytes; the older one has as many.
CACHE_ENTRIES = 100_000
CACHE_BYTES = 12 << 20
#: Longer pieces are encoded each time they occur.
CACHED_CHARACTERS = 100
ENTRY_BYTES = 150  # of an entry besides its texts
NEIGHBOURS = 1 << 18  # pairs remembered

# Fixed values of the vocabulary's splitter: its pattern, for the characters of PLAIN, and names of bytes
# that have no character of their own.
PLAIN = re.compile("[!-;=-~\nÀ-ÖØ-öø-įı-ſ]+")
PLAIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\na-z0-9ß-öø-ſ]+")
BYTE_NAMES = {b: 256 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


#: Symbols by which the tokens that can end a prefix are looked up.
ENDING = 3


def _sizes(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """By the last ``ENDING`` symbols (or fewer, at a word's start): sizes of the tokens that end so, longest first."""
    sizes: dict[str, set[int]] = {}
    for t in tokens:
        for n in range(1, min(ENDING, len(t)) + 1):
            sizes.setdefault(t[-n:], set()).add(len(t))
    # A token shorter than the ending ends every text with that ending.
    return {
        e: tuple(sorted(own.union(*[sizes.get(e[k:], set()) & {len(e) - k} for k in range(1, len(e))]), reverse=True))
        for e, own in sizes.items()
    }


class Vocabulary:
    """Tokens, ids and merges of a word BPE with an end mark."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        import json

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.mark: str = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t.encode() for t, i in [*self.ids.items(), *self.special.items()]}
        self.splitter = Tokenizer.from_file(path)
        self.merge: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank = dict.fromkeys(self.ids.values(), -1)
        for rank, (left, right) in enumerate(model["merges"]):
            token = self.ids[left + right]
            pair = (self.ids[left], self.ids[right])
            self.merge[pair] = rank
            if self.rank[token] < 0:
                self.rank[token], self.halves[token] = rank, pair
        self.neighbours = Neighbours(self)
        # A token that its own merges would never leave whole cannot end a prefix.
        usable = {t: i for t, i in self.ids.items() if i not in self.halves or self.holds(*self.halves[i], self.rank[i])}
        self.inner = {t: i for t, i in usable.items() if not t.endswith(self.mark)}
        self.final = {t.removesuffix(self.mark): i for t, i in usable.items() if t.endswith(self.mark)}
        self.inner_sizes = _sizes(self.inner)
        self.final_sizes = _sizes(self.final)

    def holds(self, left: int, right: int, before: float) -> bool:
        """No merge across the border of ``left`` and ``right`` comes earlier than ``before``."""
        while True:
            across = self.merge.get((left, right))
            if across is not None and across < before:
                return False
            a, b = self.rank[left], self.rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:  # undo the later merge; of equal ones the left came first
                before, left = a, self.halves[left][1]
            else:
                before, right = b + 1, self.halves[right][0]


class Neighbours(dict):
    """Whether two tokens can stand side by side in an encoding; found once for each pair asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) > NEIGHBOURS:
            self.clear()
        found = self[pair] = self.vocabulary.holds(*pair, float("inf"))
        return found


def encode_words(vocabulary: Vocabulary, words: Iterable[str]) -> dict[str, list[int]]:
    """Token ids of each distinct word, by one depth-first walk of the trie of all of them."""
    inner, final = vocabulary.inner, vocabulary.final
    neighbours = vocabulary.neighbours
    inner_sizes, final_sizes = vocabulary.inner_sizes, vocabulary.final_sizes

    def sizes(of: dict[str, tuple[int, ...]], ending: str) -> tuple[int, ...]:
        while ending not in of and len(ending) > 1:
            ending = ending[1:]
        return of.get(ending, ())

    out: dict[str, list[int]] = {}
    # Of the path's prefix of each length: last token and its number of symbols.
    token: list[int] = [-1]
    width: list[int] = [0]
    path = ""
    for word in sorted(set(words)):
        body = len(word) - 1
        shared = 0
        limit = min(body, len(token) - 1)
        if path[:limit] == word[:limit]:
            shared = limit
        else:
            low, high = 0, limit  # binary search for the length of the shared prefix
            while high - low > 1:
                mid = (low + high) // 2
                if path[:mid] == word[:mid]:
                    low = mid
                else:
                    high = mid
            shared = low
        del token[shared + 1 :], width[shared + 1 :]
        for end in range(shared + 1, body + 1):
            # The encoding is unique, so any order of trial finds it; most often the last token grows.
            size = width[end - 1] + 1
            t = inner.get(word[end - size : end])
            if t is not None and (size == end or neighbours[token[end - size], t]):
                token.append(t)
                width.append(size)
                continue
            ending = word[max(0, end - ENDING) : end]
            for size in inner_sizes.get(ending) or sizes(inner_sizes, ending):
                if size > end:
                    continue
                t = inner.get(word[end - size : end])
                if t is not None and (size == end or neighbours[token[end - size], t]):
                    token.append(t)
                    width.append(size)
                    break
            else:
                raise ValueError(f"no token ends at {end} of {word[:80]!r}")
        path = word
        ending = word[-ENDING:]
        for size in final_sizes.get(ending) or sizes(final_sizes, ending):
            if size > body + 1:
                continue
            t = final.get(word[body + 1 - size :])
            if t is not None and (size == body + 1 or neighbours[token[body + 1 - size], t]):
                break
        else:
            raise ValueError(f"no token ends {word[:80]!r}")
        ids, at = [t], body + 1 - size
        while at:
            ids.append(token[at])
            at -= width[at]
        out[word] = ids[::-1]
    return out


def _little(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class TrieEncoder:
    """Encodes and decodes texts; see ``encoder_of``."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.vocabulary.special)) + ")")
        self.pieces = Recent(CACHE_ENTRIES, CACHE_BYTES)  # piece: ids and their names, both as bytes
        self.words = Recent(CACHE_ENTRIES, CACHE_BYTES)

    def _words(self, piece: str) -> list:
        """Words of a piece, in the alphabet of bytes, and ids of special tokens."""
        if PLAIN.fullmatch(piece):  # composed Latin letters, digits, ASCII marks: the library's steps in short
            found = PLAIN_WORD.findall(piece.lower())
            return found if piece.isascii() else [w.encode().decode("latin-1").translate(BYTE_NAMES) for w in found]
        found: list = []
        for text in self.split_special.split(piece) if "<|" in piece else (piece,):
            if text in self.vocabulary.special:
                found.append(self.vocabulary.special[text])
            elif text:
                splitter = self.vocabulary.splitter
                normal = splitter.normalizer.normalize_str(text)
                found.extend([w for w, _ in splitter.pre_tokenizer.pre_tokenize_str(normal)])
        return found

    def _learn(self, pieces: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Encode pieces that are not in the cache yet: the trie holds all of their new words. Returns the long ones."""
        names = self.vocabulary.names
        parts = [self._words(piece) for piece in pieces]
        words = {w for found in parts for w in found if w.__class__ is str}
        new = encode_words(self.vocabulary, self.words.missing(words))
        known = {w: self.words[w] for w in words if w in self.words} | new
        for w, ids in new.items():
            if len(w) <= CACHED_CHARACTERS:
                self.words.keep(w, ids, ENTRY_BYTES + 10 * len(w))
        long = {}
        for piece, found in zip(pieces, parts, strict=True):
            if len(found) == 1 and found[0].__class__ is str:
                own = known[found[0]]
            else:
                own = [i for w in found for i in (known[w] if w.__class__ is str else (w,))]
            entry = (_little(own), b" ".join([names[i] for i in own]))
            if len(piece) <= CACHED_CHARACTERS:
                self.pieces.keep(piece, entry, ENTRY_BYTES + 2 * len(piece) + len(entry[0]) + len(entry[1]))
            else:
                long[piece] = entry
        return long

    def encode(self, batch: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text the ids as little-endian 32-bit numbers, and the text they decode to, in UTF-8."""
        split = [text.split(" ") for text in batch]
        long = self._learn(self.pieces.missing(set().union(*split)))
        known = self.pieces if not long else {**self.pieces, **long}
        out = []
        for pieces in split:
            found = [known[x] for x in pieces]
            out.append((b"".join([x[0] for x in found]), b" ".join([x[1] for x in found if x[0]])))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Names of the tokens, one space between."""
        return b" ".join([self.vocabulary.names[i] for i in ids]).decode()


@lru_cache(maxsize=1)
def encoder_of(path: str) -> TrieEncoder:
    """The worker's encoder: built once per process, its caches serve the tasks that follow."""
    return TrieEncoder(path)


def bpe_encode(docs: DataFrame, path: str | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian 32-bit), n_tokens and the decoded text's hash; with ``keep_text`` the text too.

    ``path`` is the vocabulary's place on the executors; unset, the installed public one's.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers as public

        encoder = encoder_of(str(path or public.path("word_bpe_49k.json")))
        for part in slices(batches, "text", 2 << 20):
            found = encoder.encode(texts(part, "text"))
            decoded = [text for _, text in found]
            arrays = [
                part.column("doc_id"),
                pa.array([ids for ids, _ in found], pa.binary()),
                pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
                pa.array([hashlib.sha256(text).hexdigest() for text in decoded], pa.string()),
            ]
            names = ["doc_id", "ids", "n_tokens", "decoded_sha256"]
            if keep_text:
                arrays.append(pa.array([text.decode() for text in decoded], pa.string()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, ids binary, n_tokens long, decoded_sha256 string" + ", decoded string" * keep_text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(encode), schema)


@query("op3_trie_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")
