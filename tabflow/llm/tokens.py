"""Token ids of whole texts by a public tokenizer file; a word that a Python worker has met is not encoded again."""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bounds the memory of a worker's caches, three quarters of it for words, not what is encoded: what is forgotten is encoded again.
CACHED_WORDS = 400_000
#: Texts whose parts are told apart at a time, which takes some twenty times their size.
RUN_BYTES = 1 << 20
_BATCH_CHARS = 1 << 18
#: Latin letters, then punctuation without an apostrophe: both vocabularies cut between the two and nowhere else.
_WORD = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>[!-&(-/:-@\[-`{-~]*)$"
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character that stands for each byte in byte-level vocabularies.
_SPELLED = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _safe(piece: str) -> bool:
    """Whether the tokenizers cut before the blank that stands before this piece, whatever stands before that."""
    return bool(piece) and not piece[0].isspace() and piece[0] != "᠎"


class Encoder:
    """Encodes with ``tokenizers`` and remembers the ids of what stands between blanks.

    Both vocabularies cut a text before their merges, and one such cut lies before every blank that a visible character follows.
    So the ids of a text are those of its parts, cut there, in order. Blanks before white space stay inside a part.
    The different parts of a run of texts are found by Arrow, and most are a word and what stands after it: only words are remembered then.

    A special token's string in a text is that token, as in the library's plain call, or plain text with ``plain``. Texts that may hold one
    go through the library whole.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.special = None if plain else Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: What all of them begin with, up to the first letter, as letters may change their case.
        self.sign = re.match(r"[\W_]*", os.path.commonprefix(added))[0] if added else None
        self.known: dict[str | tuple[str], bytes] = {}
        #: Words after a blank, and words that start a line inside a text.
        self.words: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}
        self.rests: dict[str, bytes] = {}
        rules = json.loads(self.tokenizer.to_str())
        self.lower = rules["normalizer"] is not None
        self.blank = "" if self.lower else "Ġ"
        self.newline = array("I", self._ids("\n")).tobytes()
        self.mark, self.mark_id = next((c, ids[0]) for c in "•★♥™©§*" if len(ids := self._ids(" " + c)) == 1)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, new: set) -> None:
        """Lines of one word are looked up; the rest goes through the whole tokenizer, in one text with a mark of one token between."""
        known, match, mark = self.known, re.compile(_WORD).fullmatch, self.mark
        long = []
        for p in new:
            if type(p) is tuple:
                known[p] = array("I", self._ids(p[0]) if p[0] else []).tobytes()
            elif all(lines := [match(line) for line in p.split("\n")]):
                # Both vocabularies cut before and after a line's end between two visible characters.
                known[p] = self._line(lines[0], self.words, self.blank) + b"".join(self.newline + self._line(m, self.starts, "") for m in lines[1:])
            elif mark in p:
                known[p] = array("I", self._ids(" " + p)).tobytes()
            else:
                long.append(p)
        while long:
            taken, size = 0, 0
            while taken < len(long) and size < _BATCH_CHARS:
                size += len(long[taken])
                taken += 1
            head, long = long[:taken], long[taken:]
            ids = np.array(self._ids(" " + f" {mark} ".join(head)), "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids)).tolist()
            if len(ends) != len(head):
                raise AssertionError("a part of a text gave the token of the mark")
            at = 0
            for p, end in zip(head, ends, strict=True):
                known[p] = ids[at:end].tobytes()
                at = end + 1

    def _merged(self, pieces: Sequence[str], blank: str = "") -> Iterator[bytes]:
        """Pieces that no rule cuts go to the merges at once."""
        tokenize = self.tokenizer.model.tokenize
        for p in pieces:
            if self.lower:
                p = p.lower()
            if not p.isascii():
                p = p.encode().decode("latin-1").translate(_SPELLED)
            yield array("I", [t.id for t in tokenize(blank + p)]).tobytes() if p else b""

    def _line(self, m: re.Match, cache: dict[str, bytes], blank: str) -> bytes:
        """A line of one word, which starts the text's line if it has no blank before it."""
        word, rest = m.groups()
        if (ids := cache.get(word)) is None:
            ids = cache[word] = next(self._merged([word], blank))
        return ids + self._rests([rest])[0] if rest else ids

    def _words(self, words: list[str]) -> list[bytes]:
        return self._found(words, self.words, self.blank, CACHED_WORDS * 3 // 4)

    def _rests(self, rests: list[str]) -> list[bytes]:
        """What stands after a word; there are few different ones."""
        return self._found(rests, self.rests, "", 10_000)

    def _found(self, pieces: list[str], cache: dict[str, bytes], blank: str, most: int) -> list[bytes]:
        """The ids of different pieces. What was learned first is what is met most often, so that stays when the cache is full."""
        out = list(map(cache.get, pieces))
        new = [k for k, ids in enumerate(out) if ids is None]
        for k, ids in zip(new, self._merged([pieces[k] for k in new], blank), strict=True):
            out[k] = cache[pieces[k]] = ids
        if len(cache) > most:
            for piece in list(islice(cache, most // 2, None)):
                del cache[piece]
        return out

    def encode(self, texts: Sequence[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; none for null."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, "right")))
            run = column.slice(at, to - at).fill_null("")
            special = pc.match_substring(run, self.sign) if self.special is not None and self.sign is not None else None
            if special is None or not pc.any(special).as_py():
                yield from self._run(run)
            else:
                plain = self._run(run.filter(pc.invert(special)))
                for text, whole in zip(run, special.to_pylist(), strict=True):
                    yield np.array(self.special.encode(text.as_py(), add_special_tokens=False).ids, "<u4") if whole else next(plain)
            at = to

    def _run(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each different part is looked up once a run; texts where blanks stand before white space are cut one by one."""
        if not len(texts):
            return
        lists = pc.split_pattern(texts, " ")
        first = lists.offsets.to_numpy().astype(np.int64)
        first, parts = first - first[0], lists.flatten().dictionary_encode()
        place = parts.indices.to_numpy()
        heads = parts.dictionary.take(pa.array(place[first[:-1]])).to_pylist()
        split = pc.extract_regex(parts.dictionary, _WORD)
        simple = split.is_valid().to_numpy(zero_copy_only=False)
        word, rest = (pc.fill_null(pc.struct_field(split, f), "").dictionary_encode() for f in ("word", "rest"))
        others = parts.dictionary.filter(pa.array(~simple)).to_numpy(zero_copy_only=False).tolist()

        later = np.ones(len(place), bool)
        later[first[:-1]] = False  # no blank before the head of a text
        unsafe = np.zeros(len(simple), bool)
        unsafe[~simple] = [not _safe(p) for p in others]
        odd = np.add.reduceat(unsafe[place] & later, first[:-1]) > 0
        met = np.zeros(len(simple), bool)
        met[place[later & ~np.repeat(odd, np.diff(first))]] = True
        others = [p if m else None for p, m in zip(others, met[~simple].tolist(), strict=True)]

        # Entries: words, what stands after words, other parts, heads of texts. Each part is two of them.
        words, rests = (c.dictionary.to_numpy(zero_copy_only=False).tolist() for c in (word, rest))
        ids = self._words(words) + self._rests(rests)
        wanted = [*others, *((h,) for h in heads)]
        new = set(wanted).difference(self.known, [None])
        if len(self.known) + len(new) > CACHED_WORDS // 4:
            self.known, self.starts = dict(islice(self.known.items(), CACHED_WORDS // 8)), {}
            new = set(wanted).difference(self.known, [None])
        self._learn(new)
        ids += [b"" if p is None else self.known[p] for p in wanted]
        nothing = len(words) + rests.index("") if "" in rests else len(ids)
        ids.append(b"")

        one, two = word.indices.to_numpy().astype(np.int64), rest.indices.to_numpy() + np.int64(len(words))
        one[~simple], two[~simple] = len(words) + len(rests) + np.arange(len(others)), nothing
        entry = np.stack([one[place], two[place]], axis=1)
        entry[first[:-1]] = np.stack([len(words) + len(rests) + len(others) + np.arange(len(heads)), np.full(len(heads), nothing)], axis=1)
        entry = entry.ravel()
        size = np.array([len(i) for i in ids]) // 4
        begin, size = (np.cumsum(size) - size)[entry], size[entry]
        ends = np.cumsum(size)
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]
        ends = ends[2 * first[1:] - 1].tolist()
        at = 0
        for k, end in enumerate(ends):
            yield next(self._encode([texts[k].as_py()])) if odd[k] else flat[at:end]
            at = end

    def _encode(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        for at in range(0, len(texts), 200):
            cut = []
            for text in texts[at : at + 200]:
                pieces = (text or "").split(" ")
                pieces[0] = (pieces[0],)  # no blank before it
                cut.append(pieces)
            new = set(chain.from_iterable(cut)).difference(self.known)
            unsafe = {p for p in new if isinstance(p, str) and not _safe(p)}
            if unsafe:
                cut = [p if unsafe.isdisjoint(p) else self._joined(p, unsafe) for p in cut]
                new = set(chain.from_iterable(cut)).difference(self.known)
            if len(self.known) + len(new) > CACHED_WORDS // 4:
                # What was learned first is what is met most often.
                self.known, self.starts = dict(islice(self.known.items(), CACHED_WORDS // 8)), {}
                new = set(chain.from_iterable(cut)).difference(self.known)
            self._learn(new)
            for pieces in cut:
                yield np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<u4")

    @staticmethod
    def _joined(pieces: list, unsafe: set[str]) -> list:
        first, out = pieces[0][0], []
        for piece in pieces[1:]:
            if piece not in unsafe:
                out.append(piece)
            elif out:
                out[-1] += " " + piece
            else:
                first += " " + piece
        return [(first,), *out]


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file, kept from task to task (functions travel by value, so their modules do not last)."""
    kept = sys.modules.setdefault("tabflow_kept_encoders", types.ModuleType("tabflow_kept_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
