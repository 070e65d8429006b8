"""Language identification by multilingual mixture inference.

A language is a distribution over hashed letter trigrams, learned from labelled rows. A
document is a mixture of languages: expectation-maximisation estimates the proportions, and
the set of languages is the one whose likelihood, less a penalty for each further language,
is largest. Texts are read whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import without

GRAMS = 1 << 16
#: Letters that one step of the vectorised inference holds at a time with eight languages, fewer with more (longer texts go alone).
STEP_CHARS = 1 << 20


@dataclass(frozen=True)
class LanguageModel:
    """``probs[gram, language]``; its size is bounded by the number of languages times ``GRAMS``."""

    langs: tuple[str, ...]
    probs: np.ndarray


@functools.cache
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.bool_)


def _codes(text: str) -> np.ndarray:
    """Lower-case letters as code points; every run of other characters is one blank."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[c]
    c = np.where(letter, c, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return c[keep]


def _grams(c: np.ndarray) -> np.ndarray:
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(15))) & np.uint32(GRAMS - 1)


def _padded(text: str | None) -> np.ndarray | None:
    """Codes between blanks, or None where there is no letter."""
    c = _codes(text) if text else None
    if c is None or not (c != 32).any():
        return None
    blank = np.array([32], np.uint32)
    return np.concatenate([blank, c, blank])


def fit(rows: DataFrame, *, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_docs: int = 20_000, smoothing: float = 0.1, max_langs: int = 500) -> LanguageModel:
    """Learns from rows with a language. About ``sample_docs`` rows of each language are used,
    picked by a hash of the id, all of them where there are fewer; this bounds the fit, and
    every text used is read whole. Rows without language or letters teach nothing."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = tuple(sorted(counts))
    if not langs:
        return LanguageModel((), np.zeros((GRAMS, 0)))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_docs / n))).otherwise(share)
    picked = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                if (c := _padded(text.as_py())) is not None:
                    seen.setdefault(lang.as_py(), np.zeros(GRAMS, np.int64))[:] += np.bincount(_grams(c), minlength=GRAMS)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "gram", "n"])

    table = picked.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    n = np.full((GRAMS, len(langs)), smoothing)
    n[table["gram"].to_numpy(), table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=np.int64)] += table["n"].to_numpy()
    return LanguageModel(langs, n / n.sum(axis=0))


def _em(p: np.ndarray, w: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: np.ndarray, pi: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``rounds`` and the log-likelihood of each document under them."""
    for _ in range(rounds):
        q = p * (w / (p * pi[doc]).sum(axis=1))[:, None]
        pi = pi * np.add.reduceat(q, starts, axis=0) / n[:, None]
    like = np.add.reduceat(w * np.log((p * pi[doc]).sum(axis=1)), starts)
    return pi, like


def infer(codes: list[np.ndarray], probs: np.ndarray, *, max_set: int | None = None, penalty: float = 4.0, rounds: int = 8) -> np.ndarray:
    """Proportions (documents x languages) of padded code arrays; a set grows while the penalised likelihood does, up to
    ``max_set`` languages or all."""
    lens = np.array([len(c) - 2 for c in codes])
    doc = np.repeat(np.arange(len(codes), dtype=np.int64), lens)
    key, w = np.unique(doc * GRAMS + np.concatenate([_grams(c) for c in codes]), return_counts=True)
    doc, p = key // GRAMS, probs[key % GRAMS]
    starts = np.searchsorted(doc, np.arange(len(codes)))
    n, w = lens.astype(float), w.astype(float)
    pi, _ = _em(p, w, doc, starts, n, np.full((len(codes), probs.shape[1]), 1 / probs.shape[1]), rounds)
    rank = np.argsort(np.argsort(-pi, axis=1, kind="stable"), axis=1, kind="stable")
    best = (rank == 0).astype(float)
    _, like = _em(p, w, doc, starts, n, best + 1e-12, 0)
    open_ = np.arange(len(codes))
    for k in range(2, min(max_set or probs.shape[1], probs.shape[1]) + 1):
        pick = np.isin(doc, open_)
        at = np.searchsorted(open_, doc[pick])
        start = np.where(rank[open_] < k, np.maximum(pi[open_], 1e-6), 0.0)
        got, more = _em(p[pick], w[pick], at, np.searchsorted(at, np.arange(len(open_))), n[open_], start / start.sum(axis=1, keepdims=True), 4)
        better = more - like[open_] > penalty * np.log(n[open_] + 1)
        open_ = open_[better]
        if not len(open_):
            break
        best[open_], like[open_] = got[better], more[better]
    return best


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` and ``lang_mix``.

    ``lang_pred`` is the language of the largest proportion (ties to the smaller name), ``score``
    that proportion, ``lang_mix`` the selected languages with their proportions. A null text, a
    text without any letter and every text under an empty model get ``und``, 0 and no mix.
    Only the text is read. Columns named as the new ones are replaced; no row is lost.
    """
    docs = without(docs, ["lang_pred", "score", "lang_mix"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            pred, score, mix = ["und"] * len(batch), [0.0] * len(batch), [[] for _ in range(len(batch))]
            held: list[tuple[int, np.ndarray]] = []

            def settle() -> None:
                if held:
                    for (i, _), row in zip(held, infer([c for _, c in held], m.probs)):
                        row = row / row.sum()
                        pred[i], score[i] = m.langs[int(row.argmax())], float(min(1.0, row.max()))
                        mix[i] = [{"lang": m.langs[j], "share": float(row[j])} for j in np.flatnonzero(row > 0)]
                    held.clear()

            size = 0
            for i, text in enumerate(batch.column(at)):
                if m.langs and (c := _padded(text.as_py())) is not None:
                    if size + len(c) > STEP_CHARS * 8 // max(8, len(m.langs)):
                        settle()
                        size = 0
                    held.append((i, c))
                    size += len(c)
            settle()
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, kind)], names=[*names, "lang_pred", "score", "lang_mix"])

    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("array<struct<lang:string,share:double>>").alias("lang_mix")).schema
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for the third of the ids that is never learned from; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
