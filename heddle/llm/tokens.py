"""Token ids of whole texts by the tokenizers library; the pieces between spaces are looked up in a bounded table."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bounds a worker's memory: its table is emptied beyond so many words and pieces, or ids of them.
MAX_WORDS, MAX_IDS = 700_000, 6_000_000
#: Longer pieces are not remembered.
LONGEST_PIECE = 64
#: Every white space of Python, Unicode and regular expressions; a space beside another one may be part of a longer token.
WHITE = "[\t-\r\x1c- \u0085  ᠎ -​    　﻿]"
#: Letters that normalise to themselves but for case, plain punctuation and single line ends: pre-tokens of their own.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "[.,;:!?%*&$#]+"
WORD_AND_MARKS = f"^(?P<word>{LETTERS})(?P<marks>(?:{MARKS})?)$"
PLAIN = re.compile(f" ?{LETTERS}(?:{MARKS})?(?:\n{LETTERS}(?:{MARKS})?)*")
UNIT = re.compile(f" ?{LETTERS}|{MARKS}|\n")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of `column` each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


class Encoder:
    """encode(texts) gives the ids of the texts, as the library gives them for each whole text.

    Where the tokenizer's pre-tokenizer always cuts before a lone space, a text's ids are those of its pieces joined, so
    each distinct piece of a batch is looked up once. Pieces that are a plain word and punctuation are put together from
    the ids that the tokenizer's model gives the two; other pieces go to the library. Texts with runs of white space that
    hold a space further in (byte-level vocabularies), or with the string of an added token, and all texts of other
    tokenizers, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.kind = self._kind(spec)
        self.largest = max(self.tokenizer.get_vocab().values(), default=0)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self._forget()

    @staticmethod
    def _kind(spec: dict) -> str:
        """`space`: a word's token holds the space before it; `plain`: white space is dropped, letters lower-cased."""
        pre, norm = spec.get("pre_tokenizer") or {}, json.dumps(spec.get("normalizer"))
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm == "null":
            return "space"
        steps = pre.get("pretokenizers", [])
        if len(steps) == 2 and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "") and steps[1].get("type") == "ByteLevel" and '"NFC"' in norm and '"Lowercase"' in norm:
            return "plain"
        return ""

    def _forget(self) -> None:
        """An empty table: the row of each word, run of punctuation or piece, and the rows' ids; row 0 has none."""
        self.rows: dict[str, int] = {"": 0}
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _words(self, words: list[str]) -> list[list[int]]:
        """Pre-tokens of letters, with or without a space before, by the model alone."""
        tokenize, lower, space = self.tokenizer.model.tokenize, self.kind == "plain", BYTE_LETTERS[32]
        out = []
        for w in words:
            if lower:
                w = w.lower()
            if not w.isascii():
                w = w.encode().decode("latin-1").translate(BYTE_LETTERS)
            elif w[0] == " ":
                w = space + w[1:]
            out.append([t.id for t in tokenize(w)])
        return out

    def _add(self, ids: list[list[int]]) -> int:
        """Appends rows; returns the first one's number."""
        first = len(self.ends) - 1
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return first

    def _units(self, units: list[str]) -> np.ndarray:
        """The rows of distinct words and runs of punctuation, all of which are remembered."""
        found = list(map(self.rows.get, units))
        new = [i for i, r in enumerate(found) if r is None]
        if new:
            names = [units[i] for i in new]
            letters = [n[-1].isalpha() for n in names]
            words, marks = iter(self._words([n for n, a in zip(names, letters, strict=True) if a])), iter(self._whole([n for n, a in zip(names, letters, strict=True) if not a]))
            row = self._add([next(words if a else marks) for a in letters])
            self.rows.update(zip(names, range(row, row + len(names)), strict=True))
            for k, i in enumerate(new, row):
                found[i] = k
        return np.array(found, np.int64)

    def _pieces(self, pieces: list[str]) -> np.ndarray:
        """The rows of any pieces; those of several plain words are put together, the others go to the library."""
        found = list(map(self.rows.get, pieces))
        new = [i for i, r in enumerate(found) if r is None]
        if new:
            plain = [UNIT.findall(pieces[i]) if PLAIN.fullmatch(pieces[i]) else None for i in new]
            units = list(dict.fromkeys(chain.from_iterable(filter(None, plain))))
            at = dict(zip(units, self._units(units).tolist(), strict=True))
            flat, ends = self.flat, self.ends.tolist()
            hard = iter(self._whole([pieces[i] for i, p in zip(new, plain, strict=True) if p is None]))
            ids = [next(hard) if p is None else [x for u in p for x in flat[ends[at[u]] : ends[at[u] + 1]].tolist()] for p in plain]
            for row, i in enumerate(new, self._add(ids)):
                found[i] = row
                if len(pieces[i]) <= LONGEST_PIECE:
                    self.rows[pieces[i]] = row
        return np.array(found, np.int64)

    def _list(self) -> pa.LargeListArray:
        return pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.flat))

    def _spoken(self, words: pa.Array) -> tuple[np.ndarray, pa.LargeListArray]:
        """For the words after a text's first: the place of each in a list of the ids of the distinct ones."""
        before = " " if self.kind == "space" else ""
        coded = words.dictionary_encode()
        pieces = coded.dictionary
        parts = pc.extract_regex(pieces, WORD_AND_MARKS)
        plain = np.asarray(parts.is_valid())
        rows = np.zeros((len(pieces), 2), np.int64)
        some = parts.filter(pa.array(plain))
        for k, (name, lead) in enumerate((("word", before), ("marks", ""))):
            units = pc.struct_field(some, name).dictionary_encode()
            names = units.dictionary.to_pylist()
            rows[plain, k] = self._units([lead + n for n in names] if lead else names)[np.asarray(units.indices)]
        rows[~plain, 0] = self._pieces([before + p for p in pieces.filter(pa.array(~plain)).to_pylist()])
        ids = self._list().take(pa.array(rows.ravel())).flatten()
        ends = np.concatenate([[0], np.cumsum(np.diff(self.ends)[rows].sum(axis=1))])
        return np.asarray(coded.indices).astype(np.int64), pa.LargeListArray.from_arrays(pa.array(ends), ids)

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts go to the library whole."""
        odd = np.zeros(len(texts), bool)
        if self.kind == "space":
            odd |= np.asarray(pc.match_substring_regex(texts, f"{WHITE} (?:{WHITE}|$)"))
        elif not self.kind:
            odd[:] = True
        for s in self.added:
            odd |= np.asarray(pc.match_substring(texts, s, ignore_case=True))
        return odd

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): text i, of which null is empty, has ids[ends[i]:ends[i + 1]], the last of which is `end`."""
        if len(self.rows) > MAX_WORDS or len(self.flat) > MAX_IDS:
            self._forget()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = self._odd(texts)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts, " ")
        words, starts = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
        starts -= starts[0]
        at, known = self._spoken(words)
        # After the distinct pieces: what ends a text, the texts' first pieces where they differ from later ones, whole texts.
        more = [[end]]
        if self.kind == "space":
            first = words.take(pa.array(starts[:-1])).dictionary_encode()
            rows = self._pieces(first.dictionary.to_pylist())
            own = self._list().take(pa.array(rows)).to_pylist()
            at[starts[:-1]] = len(known) + 1 + np.asarray(first.indices)
            more += own
        at[starts[:-1][odd]] = len(known) + len(more) + np.arange(odd.sum())
        more += self._whole(texts.filter(pa.array(odd)).to_pylist())
        every = pa.concat_arrays([known, pa.array(more, pa.large_list(pa.uint32()))])
        at = np.insert(at, starts[1:], len(known))
        starts += np.arange(len(starts))
        sizes = np.diff(np.asarray(every.offsets))[at]
        ids = np.asarray(every.take(pa.array(at)).flatten())
        return ids, np.concatenate([[0], np.cumsum(sizes)])[starts]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget_encoders() -> None:
    """Gives back what a worker keeps for encoding; for the first tasks of steps that do not encode, as Spark uses workers again."""
    if _encoders:
        _encoders.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc's alone
            ctypes.CDLL("libc.so.6").malloc_trim(0)
