"""Tokenizers by file, one per Python worker, with what the operators on tokens need of their vocabularies.

Every text is encoded in parts: a single space with neither white space nor U+2581 on either side is a cut that all of
these tokenizers make too (checked for each vocabulary; else texts stay whole). What a part gives is kept by part in a
bounded table, since most of running text is made of few words.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import sentencepiece
import tiktoken
import tokenizers
from sentencepiece import sentencepiece_model_pb2

#: What stands for a space in the pieces of a SentencePiece model.
BLANK = "▁"
#: A space that is cut at: the part after it begins with that space for a byte-level tokenizer, and gets it back as the
#: prefix that a SentencePiece model adds.
CUT = re.compile("(?<=[^\\s▁]) (?=[^\\s▁])")
#: White space that parts() then looks at place by place.
ODD = re.compile(r"[^\S \n]")
#: Parts that a worker remembers; then it begins anew.
REMEMBERED = 1 << 18
#: The split pattern of byte-level tokenizers with use_regex (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def version(file: str) -> str:
    """A digest of what an encoding depends on: the file and the library's version."""
    library = sentencepiece.__version__ if file.endswith(".model") else tokenizers.__version__
    with open(file, "rb") as f:
        return hashlib.sha256(library.encode() + b"\n" + f.read()).hexdigest()


def parts(text: str) -> list[str]:
    """text cut at CUT; where each space is such a place, by the plain split."""
    plain = text[:1] != " " and text[-1:] != " " and not any(x in text for x in ("  ", " \n", "\n ", BLANK)) and not ODD.search(text)
    return text.split(" ") if plain else CUT.split(text)


class Remembered(dict):
    """By part of a text what learn says of it: learn takes parts that are new and gives a value for each. Of some `most`
    parts, besides those of the text at hand."""

    def __init__(self, learn: Callable[[list[str]], list], most: int = REMEMBERED):
        super().__init__()
        self.learn, self.most = learn, most

    def of(self, parts: list[str]) -> Iterator:
        if len(self) > self.most:
            self.clear()
        if new := [x for x in set(parts) if x not in self]:
            self.update(zip(new, self.learn(new)))
        return map(self.__getitem__, parts)


def whole(part: str) -> bool:
    """Whether a part has no blank inside: in a text of such parts each begins where a token begins with a blank."""
    return part != "" and " " not in part and BLANK not in part


@cache
def pieces_of(file: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=file)


@cache
def plain_pieces(file: str) -> bool:
    """Whether a SentencePiece model takes texts as they are but for a blank in front, and no piece spans a cut."""
    with open(file, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    spec = model.normalizer_spec
    as_is = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    whole = model.trainer_spec.model_type == model.trainer_spec.BPE and not model.trainer_spec.treat_whitespace_as_suffix
    inner = re.compile(f"[^{BLANK}]{BLANK}")
    user = any(p.type == p.USER_DEFINED for p in model.pieces)
    return bool(as_is and whole and not user and not any(inner.search(p.piece) for p in model.pieces))


@cache
def tokenizer_of(file: str) -> tokenizers.Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    out = tokenizers.Tokenizer.from_file(file)
    out.no_truncation()
    out.no_padding()
    return out


def counter(file: str) -> Callable[[str], int]:
    """Counts a text's tokens: by sentencepiece for .model, by tokenizers for .json."""
    if not file.endswith(".model"):
        own = tokenizer_of(file)
        return lambda text: len(own.encode(text, add_special_tokens=False).ids)
    sp = pieces_of(file)
    if not plain_pieces(file):
        return lambda text: len(sp.encode(text))
    first = np.array([sp.id_to_piece(i).startswith(BLANK) for i in range(len(sp))])

    def learn(new: list[str]) -> list[int]:
        easy = list(filter(whole, new))
        starts = np.flatnonzero(first[np.array(ids := sp.encode(" ".join(easy)), dtype=np.int64)])
        n = dict(zip(easy, np.diff(starts, append=len(ids)).tolist())) if len(starts) == len(easy) else {}
        return [n[x] if x in n else len(sp.encode(x)) for x in new]

    known = Remembered(learn)
    return lambda text: sum(known.of(parts(text)))


def unicode_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    shown = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    hidden = [b for b in range(256) if b not in shown]
    return {c: b for b, c in (shown | {b: chr(256 + k) for k, b in enumerate(hidden)}).items()}


class Encoder:
    """ids of a text with a space in front, by entries, the bytes of each id. in_parts: CUT cuts no token of encode."""

    def __init__(self, entries: dict[int, bytes], encode: Callable[[str], list[int]], in_parts: bool):
        size = max(entries) + 1
        self.entries, self.encode, self.in_parts = entries, encode, in_parts
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.lengths = np.zeros(size, dtype=np.int64)
        self.lengths[list(entries)] = [len(x) for x in entries.values()]
        self.first = np.zeros(size, dtype=bool)
        self.first[list(entries)] = [x.startswith(b" ") for x in entries.values()]
        self.remembered = Remembered(self.learn, REMEMBERED // 2)

    def spelled(self, text: str) -> np.ndarray | None:
        """The ids; None where their bytes joined are not a space and the text."""
        ids = self.encode(text)
        return np.array(ids, dtype=self.dtype) if b"".join(map(self.entries.__getitem__, ids)) == b" " + text.encode() else None

    def learn(self, new: list[str]) -> list[bytes | None]:
        easy = list(filter(whole, new))
        found: dict[str, bytes] = {}
        if easy and (ids := self.spelled(" ".join(easy))) is not None and len(starts := np.flatnonzero(self.first[ids])) == len(easy):
            data, at = ids.tobytes(), (np.append(starts, len(ids)) * self.dtype.itemsize).tolist()
            found = {x: data[a:b] for x, a, b in zip(easy, at, at[1:])}
        return [found[x] if x in found else None if (ids := self.spelled(x)) is None else ids.tobytes() for x in new]

    def __call__(self, text: str) -> np.ndarray | None:
        """As spelled()."""
        if not self.in_parts:
            return self.spelled(text)
        try:
            return np.frombuffer(b"".join(self.remembered.of(parts(text))), dtype=self.dtype)
        except TypeError:  # a part without ids
            return None


@cache
def encoder(file: str) -> Encoder:
    """Of the text with a space in front, without special tokens. A byte-level BPE (.json) whose merges stand in the order
    of their ids is run by tiktoken, which gives the same ids faster; a SentencePiece model (.model) adds the space."""
    if file.endswith(".model"):
        sp = pieces_of(file)
        entries = {i: bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(map(sp.id_to_piece, range(len(sp))))}
        return Encoder(entries, sp.encode, plain_pieces(file))
    with open(file, encoding="utf-8") as f:
        whole = json.load(f)
    at, model = unicode_bytes(), whole["model"]
    special = {x["content"] for x in whole["added_tokens"]}
    entries = {i: bytes(map(at.__getitem__, t)) for t, i in model["vocab"].items() if t not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    before = whole["pre_tokenizer"]
    usual = before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not whole["normalizer"] and not model["ignore_merges"]
    if usual and all(a < b for a, b in zip(merged, merged[1:])) and sorted(entries) == list(range(len(entries))):
        own = tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks={b: i for i, b in entries.items()}, special_tokens={})
        return Encoder(entries, lambda part: own.encode_ordinary(" " + part), True)
    slow = tokenizers.Tokenizer.from_file(file)
    slow.encode_special_tokens = True
    return Encoder(entries, lambda text: slow.encode(" " + text, add_special_tokens=False).ids, False)


def texts_of(column) -> Iterator[str]:
    """The strings of an Arrow column, one after the other."""
    for i in range(len(column)):
        yield column[i].as_py()
