"""Models behind small interfaces, each with a deterministic stand-in that needs no network.

A provider turns Columns into a Column (run by Arrow batches), so that the plan around it stays declarative.
"""
from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import tokens


class Embedder(Protocol):
    def embed(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, query: Column, text: Column) -> Column: ...


class Generator(Protocol):
    def generate(self, prompt: Column) -> Column: ...


class TokenVectors(Protocol):
    def of(self, words: list[str]) -> np.ndarray:
        """A unit vector (a row) of each word."""


class PairScorer(Protocol):
    """Scores pairs of texts in batches, as a cross-encoder does: whole batches go through one call."""

    def load(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Once a worker: what scores a batch of questions and texts."""


class PageReader(Protocol):
    def read(self, image: Column) -> Column: ...


@dataclass(frozen=True)
class HashEmbedder:
    """Unit vectors from hashed tokens: each token adds 1 or -1 in one of dim places."""

    dim: int = 64

    def embed(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf("array<double>")
        def vectors(rows: pd.Series) -> pd.Series:
            out = []
            for hashes in rows:
                v = np.zeros(dim)
                h = np.asarray(hashes, dtype=np.int64)
                np.add.at(v, h % dim, np.where((h >> 32) & 1, 1.0, -1.0))
                n = np.linalg.norm(v)
                out.append(v / n if n else v)
            return pd.Series(out)

        return vectors(F.transform(tokens(text), lambda t: F.xxhash64(t)))


@dataclass(frozen=True)
class DigestVectors:
    """A word's vector: the 32 hexadecimal digits of its MD5, about their middle, at length 1."""

    def of(self, words: list[str]) -> np.ndarray:
        held = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in words), dtype=np.uint8)
        digits = np.stack([held >> 4, held & 15], axis=1).reshape(-1, 32) - 7.5
        return digits / np.sqrt((digits**2).sum(1, keepdims=True))


@dataclass(frozen=True)
class DigestEmbedder:
    """A text's vector: the sum of its words' DigestVectors, at length 1; zeros without words."""

    def embed(self, text: Column) -> Column:
        @F.pandas_udf("array<double>")
        def vectors(rows: pd.Series) -> pd.Series:
            words = [list(x) for x in rows]
            every = sorted(set().union(*words)) if words else []
            known, place = np.asarray(DigestVectors().of(every)), {w: k for k, w in enumerate(every)}
            sums = [known[[place[w] for w in x]].sum(axis=0) if x else np.zeros(32) for x in words]
            return pd.Series([v / n if (n := np.sqrt((v**2).sum())) else v for v in sums])

        return vectors(tokens(text))


def cut_pair(a: list[str], b: list[str], limit: int) -> tuple[list[str], list[str]]:
    """The first words of both, together at most limit: the longer one is cut first."""
    short, room = min(len(a), len(b)), limit // 2
    if len(a) + len(b) <= limit:
        return a, b
    keep = limit - short if short <= room else limit - room
    return (a[:keep], b[: limit - keep]) if len(a) >= len(b) else (a[: limit - keep], b[:keep])


@dataclass(frozen=True)
class CrossEncoder:
    """A reranker over a model that reads question and text together, in batches of `batch` pairs (Arrow, one model a
    worker), each pair cut to `limit` words."""

    scorer: PairScorer
    batch: int = 64
    limit: int = 512

    def score(self, query: Column, text: Column) -> Column:
        scorer, limit = self.scorer, self.limit

        def make() -> Callable:
            run = scorer.load()

            def predict(queries: np.ndarray, texts: np.ndarray) -> np.ndarray:
                pairs = [cut_pair((q or "").lower().split(), (t or "").lower().split(), limit) for q, t in zip(queries, texts)]
                return np.asarray(run([a for a, _ in pairs], [b for _, b in pairs]), dtype=np.float64)

            return predict

        return predict_batch_udf(make, return_type=DoubleType(), batch_size=self.batch)(query, text)


@dataclass(frozen=True)
class SharedWords:
    """A pair scorer's stand-in: the distinct words of the question that the text holds, a share of -5 to 5."""

    def load(self) -> Callable[[list, list], np.ndarray]:
        return lambda queries, texts: np.array([-5 + 10 * len(set(q) & set(t)) / max(1, len(set(q))) for q, t in zip(queries, texts)])


@dataclass(frozen=True)
class OverlapReranker:
    """The part of the question's distinct tokens that the text holds, scaled to low..high."""

    low: float = -5.0
    high: float = 5.0

    def score(self, query: Column, text: Column) -> Column:
        asked = F.array_distinct(tokens(query))
        part = F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.size(asked), F.lit(1))
        return self.low + (self.high - self.low) * part


@dataclass(frozen=True)
class ExtractiveGenerator:
    """The first `words` words of the prompt's last paragraph but one, or of the prompt."""

    words: int = 40

    def generate(self, prompt: Column) -> Column:
        return F.array_join(F.slice(F.split(F.trim(prompt), r"\s+"), 1, self.words), " ")


@dataclass(frozen=True)
class TokenCutter:
    """Cuts texts to their first `limit` tokens by a tokenizer's file (tokenizers library), at a place between characters:
    a character of which only a part is in goes. Special tokens' names in a text are text."""

    file: str
    limit: int = 2048

    def cut(self, text: Column) -> Column:
        file, limit = self.file, self.limit

        @F.pandas_udf("string")
        def first(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(file)
            own.no_truncation()
            own.encode_special_tokens = True
            fits = fits_by_bytes if by_bytes(own) else fits_by_characters
            for rows in batches:
                yield rows.map(lambda t: t if t is None or fits(t, limit) else within(own, t, limit))

        return first(text)


#: Tokens that a character may take: a text of so many fewer characters than the limit needs no tokenizer.
LONGEST = 4


def fits_by_characters(text: str, limit: int) -> bool:
    return len(text) <= limit // LONGEST


def fits_by_bytes(text: str, limit: int) -> bool:
    return len(text) <= limit // LONGEST or len(text.encode()) <= limit


def by_bytes(tokenizer) -> bool:
    """Whether each token takes a byte of the text at least: byte-level pairs of text as it is."""
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import ByteLevel

    cut = tokenizer.pre_tokenizer
    return isinstance(tokenizer.model, BPE) and isinstance(cut, ByteLevel) and not cut.add_prefix_space and tokenizer.normalizer is None


def within(tokenizer, text: str, limit: int) -> str:
    """text up to where its token after the first limit begins."""
    places = tokenizer.encode(text, add_special_tokens=False).offsets
    return text[: places[limit][0]] if len(places) > limit else text


@dataclass(frozen=True)
class PlainPages:
    """Reads a page that is UTF-8 text; stands in for character recognition."""

    def read(self, image: Column) -> Column:
        return F.decode(image, "UTF-8")


def first_reading(image: Column, readers: list[PageReader]) -> Column:
    """Readers in order of preference; the first that gives text wins."""
    return F.coalesce(*[F.nullif(r.read(image), F.lit("")) for r in readers], F.lit(None).cast("string"))


@dataclass
class CallPolicy:
    """Retries, waits and the change of model for calls to a service. State is one partition's: as many partitions as
    callers that the service should see.

    A refused call (rate limit) waits pause seconds, or what the service says plus margin; after `breaker` refused calls in
    a row the next model takes over, and when none is left the rest of the partition is given back undone.
    """

    models: tuple[str, ...]
    attempts: int = 3
    pause: float = 60.0
    margin: float = 5.0
    other_pause: float = 5.0
    switch_pause: float = 10.0
    spacing: float = 1.0
    breaker: int = 5
    sleep: Callable[[float], None] = time.sleep

    def run(self, items: Iterator[tuple], call: Callable[[str, tuple], str], good: Callable[[str], bool] = bool) -> Iterator[tuple[tuple, str | None]]:
        """(item, reply or None) for each item; call raises RateLimited or any other error. good: whether a reply is of use,
        which ends a row of refusals; it raises where the item must be asked again."""
        model, refused = 0, 0
        for item in items:
            reply = None
            for _ in range(self.attempts):
                if model == len(self.models):
                    break
                try:
                    reply = call(self.models[model], item)
                    refused = 0 if good(reply) else refused
                    break
                except RateLimited as error:
                    refused += 1
                    wait = error.wait + self.margin if error.wait is not None else self.pause
                    if refused >= self.breaker:
                        model, refused, wait = model + 1, 0, self.switch_pause
                    if model < len(self.models):
                        self.sleep(wait)
                except Exception:  # noqa: BLE001  (a service may fail in any way; the item is given back undone)
                    reply = None
                    self.sleep(self.other_pause)
            yield item, reply
            if model < len(self.models):
                self.sleep(self.spacing)


class RateLimited(Exception):
    """A service refused a call; wait: the seconds that it asks for, if it says."""

    def __init__(self, wait: float | None = None):
        super().__init__(wait)
        self.wait = wait
