"""Byte-level BPE with word ends: encoding by a segment tree over adjacent pair ranks, and decoding.

For each piece of text the leaves of a segment tree hold the merge rank of a symbol and its right neighbour;
an inner node holds the least of its children. The root is the leftmost pair of lowest rank. A merge changes three
leaves, each in logarithmic time, until the root says that no pair can be merged. So a piece of n bytes takes
O(n log n), however long it is.

Defined cases: a null or empty text, or one of blanks only, has no ids and decodes to the empty string. Rows are
independent of each other: repeated rows and ids come out as often as they came in, an empty table gives none.
Columns other than the text pass through.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from saltmarsh.llm.common import slices

#: Unicode white space, as the tokenizer's \s reads it.
BLANKS = "\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: How the tokenizer cuts a text without blanks into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + BLANKS + r"\p{L}\p{N}]+"
#: Words and pieces that a worker remembers, twice each: when the new ones are as many, the older ones are forgotten.
WORDS, PIECES_KEPT = 100_000, 300_000
NONE = 1 << 62
#: Children of a node of the segment tree; min() over a short slice is one step in C.
FAN = 16


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or for the others the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Vocabulary:
    """What encoding needs of a tokenizer file (a few MB, whatever the corpus holds)."""

    def __init__(self, text: str) -> None:
        spec, self.text = json.loads(text), text
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.names = {i: s for s, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        # the pair (a, b) as one number -> rank << 32, and -> the merged symbol
        pairs = [(vocab[a] << 32 | vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        self.ranks = {p: rank << 32 for rank, (p, _) in enumerate(pairs)}
        self.results = dict(pairs)


def merged(symbols: list[int], ranks: dict[int, int], results: dict[int, int]) -> list[int]:
    """The symbols after all merges, the leftmost pair of lowest rank first.

    levels[0] has a leaf for each symbol: the rank of its pair with the next symbol, then its place, so that the
    least is the leftmost of lowest rank. A node above holds the least of FAN children; the top level is one node wide.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    rank = ranks.get
    leaves = [rank(a << 32 | b, NONE) for a, b in zip(symbols, symbols[1:])]
    leaves = [x + i if x != NONE else NONE for i, x in enumerate(leaves)]
    leaves.append(NONE)
    levels = [leaves]
    while len(levels[-1]) > FAN:
        below = levels[-1]
        levels.append([min(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    top, deep = levels[-1], len(levels) > 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (least := min(top)) != NONE:
        i = least & 0xFFFFFFFF
        j = after[i]
        symbol = symbols[i] = results[symbols[i] << 32 | symbols[j]]
        symbols[j] = -1
        leaves[j] = NONE
        nxt = after[i] = after[j]
        if nxt < n:
            before[nxt] = i
            x = rank(symbol << 32 | symbols[nxt], NONE)
            leaves[i] = x + i if x != NONE else NONE
        else:
            leaves[i] = NONE
        prev = before[i]
        if prev >= 0:
            x = rank(symbols[prev] << 32 | symbol, NONE)
            leaves[prev] = x + prev if x != NONE else NONE
        if deep:
            changed = {i // FAN, j // FAN, max(prev, 0) // FAN}
            for below, level in zip(levels, levels[1:]):
                for k in changed:
                    level[k] = min(below[k * FAN : k * FAN + FAN])
                changed = {k // FAN for k in changed}
    return [s for s in symbols if s >= 0]


class Recent(dict):
    """A bounded memory of a function of short strings: the entries used last, in two generations."""

    def __init__(self, function: Callable[[str], bytes], most: int) -> None:
        self.function, self.most, self.older = function, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of texts, as int32 bytes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.pieces, self.words = regex.compile(PIECES), regex.compile(f"[^{BLANKS}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")")
        self.library: Tokenizer | None = None
        self.of_word, self.of_piece = Recent(self.word, WORDS), Recent(self.piece, PIECES_KEPT)

    def word(self, word: str) -> bytes:
        if word.isascii():
            found = self.pieces.findall(word.lower())
        elif "Cn" in map(unicodedata.category, word):
            found = self.newer(word)
        else:
            text = unicodedata.normalize("NFC", word)
            # letter by letter: a final sigma gets no form of its own
            text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
            found = self.pieces.findall(text)
        return self.of_piece[found[0]] if len(found) == 1 else b"".join([self.of_piece[p] for p in found])

    def newer(self, word: str) -> list[str]:
        """Pieces of a word with characters that Python's tables lack: which of them are letters, the library's tables say."""
        if self.library is None:
            self.library = Tokenizer.from_str(self.vocabulary.text)
        text = self.library.normalizer.normalize_str(word)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def piece(self, piece: str) -> bytes:
        raw, inner = piece.encode(), self.vocabulary.inner
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.vocabulary.last[raw[-1]]
        return array("i", merged(symbols, self.vocabulary.ranks, self.vocabulary.results)).tobytes()

    def plain(self, text: str) -> bytes:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # blanks for Python, but not for the tokenizer
        words = self.words.findall(text) if odd else text.split()
        return b"".join(map(self.of_word.__getitem__, words))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as int32 bytes."""
        special = self.vocabulary.special
        if not any(x in text for x in special):
            return self.plain(text)
        return b"".join(array("i", [special[x]]).tobytes() if k % 2 else self.plain(x) for k, x in enumerate(self.specials.split(text)))


def load(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file, read on the driver and sent to the executors; its size is that of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


_encoders: dict[int, Encoder] = {}


def _encoder(sent: Broadcast) -> Encoder:
    """One for each worker process and tokenizer."""
    key = hash(sent.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(sent.value))
    return _encoders[key]


def _ids(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))


def encode(df: DataFrame, tokenizer: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the ids of the text as array<int>; with decoded, also the ids decoded again in the same pass.

    A column that has one of the new names already is replaced.
    """
    sent, df = load(df.sparkSession, tokenizer), df.drop(*[c for c in (ids, decoded) if c and c != text])
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    fields += [T.StructField(decoded, T.StringType(), False)] if decoded else []
    schema, at = T.StructType(df.schema.fields + fields), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent)
        name = encoder.vocabulary.names.__getitem__
        for whole in batches:
            for batch in slices(whole):
                parts = [encoder.encode(t or "") for t in batch.column(at).to_pylist()]
                new = [_ids(parts)]
                if decoded:
                    new.append(pa.array([" ".join(map(name, np.frombuffer(p, dtype=np.int32).tolist())) for p in parts], pa.string()))
                yield pa.RecordBatch.from_arrays(batch.columns + new, names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for: the names of the symbols joined by blanks. Null ids decode to the empty string; an unknown id is an error."""
    sent, df = load(df.sparkSession, tokenizer), df.drop(decoded) if decoded != ids else df
    schema, at = T.StructType([*df.schema.fields, T.StructField(decoded, T.StringType(), False)]), df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = _encoder(sent).vocabulary.names.__getitem__
        for whole in batches:
            for batch in slices(whole):
                texts = [" ".join(map(name, x or [])) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
