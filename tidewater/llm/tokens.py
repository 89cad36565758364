"""Token ids of a public vocabulary, fast for many texts.

The tokenizer drops white space, never joins words across it, and is blind to case, so
the ids of a text are those of its lower-cased white-space-separated chunks in order; marks
at the end of a chunk, after a letter or a digit, are a token of their own. Chunks repeat, so
each is encoded once and kept, up to ``CACHE`` chunks in each Python worker, in two Arrow
arrays: Arrow finds the places of all chunks of a batch there and takes their ids, and Python
sees new chunks only. Those go to the tokenizer many at a time, as one text with a separator
that none of them has. Words of small letters are what the vocabulary's normaliser and its
splitting leave as they are, so both are left out for them.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import drops

CACHE = 300_000
#: Chunks longer than this are encoded but not kept.
LONG_CHUNK = 64
#: Separator of chunks, and how many go together.
SEPARATOR, TOGETHER = b"|", 128
#: Small letters of ASCII and letters of Latin-1 in UTF-8, whose capitals become small.
_WORD = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
#: Marks that never go together with a letter or digit before them (an apostrophe does with a letter after it).
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The vocabulary's characters for the bytes that words of small letters have and Latin-1 shows otherwise.
_SHOWN = {"\x9f": "\u0141", "\xa0": "\u0142", "\xad": "\u0143"}
_workers: dict[str, Encoder] = {}
drops.append(_workers.clear)


def _bytes_level(words: bytes) -> str:
    """Words as the vocabulary writes them, in small letters, a character for each byte; ASCII letters stand for themselves."""
    if words.isascii():
        return words.decode()
    out = words.decode().lower().encode().decode("latin-1")
    for byte, shown in _SHOWN.items():
        out = out.replace(byte, shown)
    return out


def _stem(chunk: bytes) -> bytes:
    """The chunk without the marks at its end, if they are a token of their own or several."""
    stem = chunk.rstrip(_MARKS)
    last = stem[-1:]
    return stem if last.isalnum() or stem[-2:-1] == b"\xc3" and last not in b"\x97\xb7" else chunk


class Encoder:
    """Ids as little-endian unsigned 16-bit numbers; the vocabulary must have fewer than 65,536."""

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = None
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.limit = cache
        #: Chunks and their ids; the empty one is what is before or after white space at a text's edges.
        self.chunks = self.ids = pa.array([b""], pa.large_binary())
        (self.separator,) = self.tokenizer.encode(SEPARATOR.decode(), add_special_tokens=False).ids

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        return [np.array(x.ids, "<u2").tobytes() for x in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]

    def _chunks(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """The ids of chunks without ASCII white space."""
        out: dict[bytes, bytes] = {}
        words, rest, alone = [], [], []
        for c in chunks:
            (words if c.isalpha() or _WORD(c) else alone if SEPARATOR in c else rest).append(c)
        groups, texts = [], []
        for tokenizer, own in ((self.words, words), (self.tokenizer, rest)):
            cut = [own[at : at + TOGETHER] for at in range(0, len(own), TOGETHER)]
            groups += cut
            joined = [b" | ".join(g) for g in cut]
            joined = [x.decode() for x in joined] if tokenizer is self.tokenizer else [_bytes_level(x) for x in joined]
            texts += tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        for group, found in zip(groups, texts, strict=True):
            ids = np.array(found.ids, "<u2")
            cuts = np.flatnonzero(ids == self.separator)
            if len(cuts) != len(group) - 1:
                alone += group
                continue
            data, ends = ids.tobytes(), [*(2 * cuts).tolist(), 2 * len(ids)]
            starts = [0, *(2 * cuts + 2).tolist()]
            out.update(zip(group, [data[a:b] for a, b in zip(starts, ends, strict=True)], strict=True))
        out.update(zip(alone, self._plain(alone), strict=True))
        return out

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new chunks, and after them those of their stems and marks that are new as well."""
        stems = {c: stem for c in new if len(stem := _stem(c)) < len(c)}
        own = set(new).difference(stems)
        parts = pa.array({*stems.values(), *(c[len(stem) :] for c, stem in stems.items())} - own, pa.large_binary())
        at = pc.index_in(self.chunks, value_set=parts)  # Arrow hashes the fewer of both
        met = at.is_valid()
        known = dict(zip(parts.take(at.filter(met)).to_pylist(), self.ids.filter(met).to_pylist(), strict=True))
        more = [x for x in parts.to_pylist() if x not in known]
        known.update(self._chunks([*own, *more]))
        return {c: known[stems[c]] + known[c[len(stems[c]) :]] if c in stems else known[c] for c in new} | {x: known[x] for x in more}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.chunks) > self.limit:  # the first ones are the most frequent
            keep = max(1, self.limit // 2)
            self.chunks, self.ids = self.chunks[:keep], self.ids[:keep]
        # A special token's string in a text is rare: such a text goes to the tokenizer as it is.
        special = [i for i, x in enumerate(texts) if b"<|" in x]
        plain = texts
        if special:
            plain = list(texts)
            for i in special:
                plain[i] = b""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(plain, pa.large_binary()).view(pa.large_string())))
        chunks = lists.flatten().cast(pa.large_binary())
        coded = chunks.dictionary_encode()
        at = pc.index_in(self.chunks, value_set=coded.dictionary)  # few of the batch are hashed, not all that are known
        met = at.is_valid()
        places = np.full(len(coded.dictionary), -1)
        places[at.filter(met).to_numpy()] = np.flatnonzero(met.to_numpy(zero_copy_only=False))
        ids, new = self.ids, places < 0
        if new.any():
            # New chunks stand after the known ones.
            learned = self._learn(coded.dictionary.filter(pa.array(new)).to_pylist())
            places[new] = len(ids) + np.arange(np.count_nonzero(new))
            names, values = pa.array(learned, pa.large_binary()), pa.array(learned.values(), pa.large_binary())
            ids = pa.concat_arrays([ids, values])
            kept = pc.less_equal(pc.binary_length(names), LONG_CHUNK)
            self.chunks, self.ids = pa.concat_arrays([self.chunks, names.filter(kept)]), pa.concat_arrays([self.ids, values.filter(kept)])
        joined = ids.take(pa.array(places)).take(coded.indices)
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, np.int64, len(joined) + 1, 8 * joined.offset) if len(joined) else np.zeros(1, np.int64)
        cuts = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int64)].tolist()
        view = memoryview(data) if data is not None else memoryview(b"")
        out = [bytes(view[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in special:
            out[i] = self._plain([texts[i]])[0]
        return out


def encoder(path: str) -> Encoder:
    """This worker's encoder; it lives as long as the worker."""
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]
