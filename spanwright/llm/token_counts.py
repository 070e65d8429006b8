"""Token counts with a published tokenizer: two tiers of lookup on the map side, no pre-token is shuffled.

A subword tokenizer first cuts a text into pre-tokens and encodes each by itself, so a text has as many tokens as its
pre-tokens together, and few pre-tokens make up most of any corpus.

1. Every task counts the pre-tokens of all its texts in a summary of bounded size (lossy counting: at each
   overflow the rare ones go) and hands on its ``TASK_ENTRIES`` most frequent. Their sums give the frequent ones of the corpus.
2. The first tier is a compact table of at most ``TABLE_BYTES``: the frequent pre-tokens in one string, their lengths in tokens
   one byte each. It is broadcast.
3. What misses it goes through a cache in each Python worker, of bounded size; what misses that too is encoded by the library.

The tables decide only how fast a text is counted. Documents never leave their task, and what the first step hands on
does not grow with a task's input.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwright.llm.common import without

#: Pre-tokens that a task counts at a time and that it hands on; longer ones than LONGEST characters are never frequent.
TASK_COUNTED, TASK_ENTRIES, LONGEST = 1 << 18, 1 << 12, 48
#: Bytes of the broadcast table, and entries of a worker's cache.
TABLE_BYTES, CACHED = 1 << 21, 1 << 17
#: Characters of a text that are cut into pre-tokens at a time.
SLICE = 1 << 20

#: The contractions of the byte-level pre-tokenizer, and the code points up to which its classes are written out below.
_CONTRACTIONS, _PLAIN = ("s", "t", "re", "ve", "m", "ll", "d"), 0x250


def _class(belongs: Callable[[str], bool]) -> str:
    """The code points below ``_PLAIN`` that belong, as ranges of a character class."""
    out, start = [], None
    for i in range(_PLAIN + 1):
        inside = i < _PLAIN and belongs(chr(i))
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{i - 1:04x}")
            start = None
    return "".join(out)


def byte_level_pattern() -> re.Pattern:
    """The byte-level pre-tokenizer's rule for code points below ``_PLAIN``: classes of letters, numbers and blanks in ``re``."""
    letter = _class(lambda c: unicodedata.category(c)[0] == "L")
    number = _class(lambda c: unicodedata.category(c)[0] == "N")
    blank = _class(lambda c: c.isspace() and c not in "\x1c\x1d\x1e\x1f")
    endings = "|".join(_CONTRACTIONS)
    return re.compile(f"'(?:{endings})| ?(?:[{letter}]+|[{number}]+|[^{blank}{letter}{number}]+)|[{blank}]+(?![^{blank}])|[{blank}]+")


_PATTERN = byte_level_pattern()
_CUT = re.compile(r"(?<=\S)(?= \w)")


class Counting:
    """A tokenizer in a worker: texts to pre-tokens, pre-tokens to lengths."""

    def __init__(self, kind: str, data: bytes):
        self.cache: dict[str, int] = {}
        if kind == "sentencepiece":
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.whole = lambda text: len(pieces.encode(text, num_threads=1))
            self.pre_tokens = None
            return
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(data.decode("utf-8"))
        own.no_truncation()
        own.no_padding()
        self.whole = lambda text: len(own.encode(text, add_special_tokens=False).ids)
        self.model, self.normalizer, self.split = own.model, own.normalizer, own.pre_tokenizer
        added = own.get_added_tokens_decoder().values()
        simple = all(not (t.single_word or t.lstrip or t.rstrip or t.normalized) for t in added)
        names = sorted((t.content for t in added), key=lambda s: (-len(s), s))
        #: Added tokens stand for themselves wherever their strings occur, the longest of those that begin at one place.
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        import json

        rule = json.loads(data).get("pre_tokenizer") or {}
        self.byte_level = rule == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and own.normalizer is None
        self.pre_tokens = self._pre_tokens if self.split is not None and simple else None

    def _pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text without added tokens, a bounded list at a time where blanks allow it."""
        if not self.byte_level:
            text = self.normalizer.normalize_str(text) if self.normalizer is not None else text
            yield [piece for piece, _ in self.split.pre_tokenize_str(text)]
            return
        at = 0
        while at < len(text):
            cut = _CUT.search(text, at + SLICE) if len(text) - at > SLICE else None
            end = cut.start() if cut else len(text)
            part = text[at:end] if at or cut else text
            at = end
            # a blank behind a non-blank always begins a pre-token, so parts do not depend on each other
            yield _PATTERN.findall(part) if part.isascii() or max(part) < chr(_PLAIN) else self._by_library(part)

    def _by_library(self, part: str) -> list[str]:
        return [part[a:b] for _, (a, b) in self.split.pre_tokenize_str(part)]

    def length(self, piece: str) -> int:
        """Tokens of one pre-token, by the library; short ones are remembered."""
        n = self.cache.get(piece)
        if n is None:
            n = len(self.model.tokenize(self.split.pre_tokenize_str(piece)[0][0] if self.byte_level else piece))
            if len(piece) <= LONGEST:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[piece] = n
        return n

    def parts(self, text: str) -> tuple[int, list[str]]:
        """Number of added tokens in a text, and what stands between them."""
        if self.added is None or not self.added.search(text):
            return 0, [text]
        return len(self.added.findall(text)), [p for p in self.added.split(text) if p]


_WORKER: dict[str, object] = {}


def _kept(name: str, make: Callable[[], object]) -> object:
    """What a worker process makes once and keeps for its next tasks; a few at most."""
    if name not in _WORKER:
        if len(_WORKER) > 8:
            _WORKER.clear()
        _WORKER[name] = make()
    return _WORKER[name]


def _count_frequent(tokenizer):
    """mapInArrow: texts -> the most frequent pre-tokens of a task with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, kind, data = tokenizer.value
        own: Counting = _kept(name, lambda: Counting(kind, data))
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for part in own.parts(text.as_py() or "")[1]:
                    for pieces in own.pre_tokens(part):
                        seen.update(pieces)
                if len(seen) > TASK_COUNTED:  # the rarer half goes
                    seen = Counter(dict(seen.most_common(TASK_COUNTED // 2)))
        top = [(p, n) for p, n in seen.most_common(TASK_ENTRIES) if n > 1 and len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    return run


def frequent_table(texts: DataFrame, tokenizer, make: Callable[[], Counting], table_bytes: int = TABLE_BYTES) -> tuple[bytes, np.ndarray]:
    """The frequent pre-tokens of the one text column, joined by a zero byte, and their lengths in tokens (a byte each).

    ``table_bytes`` bounds both together. Pre-tokens of more than 255 tokens or with a zero byte are left to the caches.
    """
    found = texts.mapInArrow(_count_frequent(tokenizer), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    own, size, pieces, lengths = make(), 0, [], []
    # a row takes two bytes at least, so the limit bounds what the driver reads
    for row in found.orderBy(F.desc("n"), "piece").limit(table_bytes // 4).collect():
        n, data = own.length(row.piece), row.piece.encode("utf-8")
        if n > 255 or b"\0" in data:
            continue
        size += len(data) + 2
        if size > table_bytes:
            break
        pieces.append(data)
        lengths.append(n)
    return b"\0".join(pieces), np.array(lengths, np.uint8)


def tokenizer_file(path: str) -> tuple[str, str, bytes]:
    """(digest, library, content) of a tokenizer's file: ``.json`` or ``.model``. It is read by the driver and travels by broadcast."""
    with open(path, "rb") as f:
        data = f.read()
    if not path.endswith((".json", ".model")):
        raise ValueError(f"a tokenizer is a .json or a .model file, not {path}")
    return hashlib.sha256(data).hexdigest(), "sentencepiece" if path.endswith(".model") else "tokenizers", data


def count_tokens(docs: DataFrame, path: str, *, limit: int = 512, text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of each text.

    The counts are those of the library that belongs to the file at ``path``, without begin, end or padding tokens and without truncation;
    strings of added tokens count as the library's default has it. A null text is empty and has 0 tokens. Repeated rows are counted each;
    other columns pass through, columns named as the new ones are replaced. Tokenizers whose pre-tokens do not stand for themselves
    (``.model`` files, none declared, added tokens that take blanks with them) are asked for whole texts.
    """
    spark, docs = docs.sparkSession, without(docs, ["n_bytes", "n_tokens", "over_limit"])
    name, kind, data = tokenizer_file(path)
    shipped = spark.sparkContext.broadcast((name, kind, data))
    own = Counting(kind, data)
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    first = frequent_table(texts, shipped, lambda: own, table_bytes) if own.pre_tokens else (b"", np.zeros(0, np.uint8))
    table = spark.sparkContext.broadcast(first)
    label = hashlib.sha256(name.encode() + first[0]).hexdigest()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, kind, data = shipped.value
        own: Counting = _kept(name, lambda: Counting(kind, data))
        tier = _kept(label, lambda: dict(zip(table.value[0].decode("utf-8").split("\0"), table.value[1].tolist())))

        def tokens(text: str) -> int:
            if own.pre_tokens is None:
                return own.whole(text) if text else 0
            total, parts = own.parts(text)
            for part in parts:
                for pieces in own.pre_tokens(part):
                    lengths = list(map(tier.get, pieces))
                    misses = lengths.count(None)
                    if misses:
                        lengths = [own.length(p) if n is None else n for p, n in zip(pieces, lengths)]
                    total += sum(lengths)
            return total

        for batch in batches:
            row = batch.column(0)
            texts = batch.column(1)
            bytes_, counts = [], []
            for text in texts:
                bytes_.append(len(text.as_buffer()) if text.is_valid else 0)
                counts.append(tokens(text.as_py() or ""))
            columns = [row.field(i) for i in range(row.type.num_fields)]
            counts = np.array(counts, np.int64)
            new = [pa.array(bytes_, pa.int64()), pa.array(counts), pa.array(counts > limit)]
            yield pa.RecordBatch.from_arrays([*columns, *new], names=[*(f.name for f in row.type), "n_bytes", "n_tokens", "over_limit"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, schema)
