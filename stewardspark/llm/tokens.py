"""Encoding with a public tokenizer inside Arrow tasks, each different piece once.

In a byte-level BPE whose words are found by its usual pattern, a space and the
letters after it are a word by themselves wherever a character follows that is
surely no letter, and a text may be cut at both ends of it. Texts are cut there,
many at once as bytes, and Arrow finds the different pieces among them. Each different
word then goes through the library's BPE model once, each different rest through the
whole library in batches of equal bytes, and both are remembered. A text with one of the tokenizer's special strings, and any other kind of
tokenizer, is encoded whole.
"""

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORDS = re.compile(f"( [{_LETTERS}]+(?![A-Za-z\x80-\U0010ffff]))")

#: Bytes at which a word's letters end: all of ASCII but letters.
_STOPS = np.array([not (b >= 128 or chr(b).isalpha()) for b in range(256)])

BATCH_BYTES = 256 << 10
#: About so many bytes of pieces and ids are remembered, in a Python worker.
REMEMBERED = 96 << 20
LONG = 48
#: Bytes that a remembered piece takes beside its characters and ids, roughly.
_ENTRY = 180


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in printable else next(free)) for b in range(256)]


def _packed(ids: Iterable[int]) -> bytes:
    """Ids side by side, 32 bits each: put together for a text without a look at each."""
    return array("I", ids).tobytes()


class Encoder:
    """Ids, or with ``lengths`` only their number, of texts.

    Memory: the pieces of one group of texts, and ``REMEMBERED`` bytes of short pieces
    until ``forget`` is called.
    """

    def __init__(self, path: str, lengths: bool = False):
        self.known: dict = {}
        self.held = 0
        self.keep = len if lengths else _packed
        self.special, self.model = [], None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.encode = lambda texts: [
            e if lengths else e.ids
            for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        before, model = kind.get("pre_tokenizer") or {}, kind["model"]
        added = kind.get("added_tokens") or []
        if (
            kind.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "end_of_word_suffix", "continuing_subword_prefix"))
        ):
            self.model, self.letters = tokenizer.model, _byte_letters()
            self.special = [t["content"] for t in added]

    def batched(self, texts: Iterable[str]) -> Iterator:
        """What the library gives for each text, in batches balanced by bytes."""
        batch, size = [], 0
        for text in texts:
            batch.append(text)
            size += len(text) if text.isascii() else len(text.encode())
            if size >= BATCH_BYTES:
                yield from self.encode(batch)
                batch, size = [], 0
        if batch:
            yield from self.encode(batch)

    def _cuts(self, texts: pa.Array, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the pieces of ``texts`` begin in their bytes ``data``, and where the last one ends."""
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        if self.model is None:
            return np.flatnonzero(cut)
        stops = cut.copy()
        stops[:-1] |= _STOPS[data]
        stops = np.flatnonzero(stops)
        spaces = np.flatnonzero(data[stops[:-1]] == 32)
        first, last = stops[spaces], stops[spaces + 1]
        word = last - first > 1
        # Beyond ASCII, À to ÿ are letters but for × and ÷: two bytes, of which the first is C3.
        other = data >= 0x80
        if other.any():
            latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
            other[:-1] &= ~latin
            other[1:] &= ~latin
            other = np.flatnonzero(other)
            at = np.searchsorted(first, other, "right") - 1
            word[at[(at >= 0) & (other < np.append(last, 0)[at])]] = False
        for special in self.special:
            whole = pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
            if whole.any():
                word &= ~whole[np.searchsorted(bounds, first, "right") - 1]
        cut[first[word]] = True
        cut[last[word]] = True
        return np.flatnonzero(cut)

    def _words(self, words: list[str]) -> Iterator:
        """What the library's model gives for each word: a space and letters."""
        for at in range(0, len(words), 4096):
            tokenize, space = self.model.tokenize, self.letters[32]
            # Letters of ASCII stand for themselves; no word holds a line feed.
            spelt = "\n".join(words[at : at + 4096]).replace(" ", space)
            if not spelt.replace(space, "").isascii():
                spelt = "\n".join(["".join([self.letters[b] for b in w.encode()]) for w in words[at : at + 4096]])
            found = list(map(tokenize, spelt.split("\n")))
            if self.keep is len:
                yield from map(len, found)
                continue
            packed, end = _packed([t.id for tokens in found for t in tokens]), 0
            for n in map(len, found):
                begin, end = end, end + 4 * n
                yield packed[begin:end]

    def learn(self, pieces: list[str]) -> list:
        """What each of ``pieces``, which differ, has."""
        known = self.known
        new = [p for p in pieces if p not in known]
        words = list(filter(_WORDS.fullmatch, new)) if self.model is not None else []
        found = dict(zip(words, self._words(words), strict=True))
        rest = [p for p in new if p not in found]
        found.update(zip(rest, map(self.keep, self.batched(rest)), strict=True))
        out = [known[p] if p in known else found[p] for p in pieces]
        for piece, ids in found.items():
            if self.held >= REMEMBERED:
                break
            if len(piece) <= LONG:
                self.held += _ENTRY + len(piece) + (0 if self.keep is len else len(ids))
                known[piece] = ids
        return out

    def forget(self) -> None:
        """Give back what is remembered: a worker lives on after its task."""
        self.known, self.held = {}, 0

    def _grouped(self, texts: pa.Array | Iterable[str]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """For many texts at a time: what their different pieces have, which piece follows which, and
        the number of pieces before each text and in all."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(list(texts), pa.large_string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        _, offsets, held = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0]
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + 16 * BATCH_BYTES)))
            end = min(end, len(texts))
            bounds = offsets[begin : end + 1] - offsets[begin]
            size = int(bounds[-1])
            data = np.frombuffer(held, np.uint8, size, int(offsets[begin])) if size else np.zeros(0, np.uint8)
            cuts = self._cuts(texts.slice(begin, end - begin), data, bounds)
            pieces = pa.Array.from_buffers(
                pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]
            ).dictionary_encode()
            different = pieces.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
            yield self.learn(different), pieces.indices.to_numpy(), np.searchsorted(cuts, bounds)
            begin = end

    def ids(self, texts: pa.Array | Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text; null texts are empty."""
        for found, pieces, bounds in self._grouped(texts):
            sizes = np.array(list(map(len, found)), np.int64) // 4
            sums = np.append(0, np.cumsum(sizes[pieces]))
            # From the place in the different pieces' ids to the place among all ids.
            moved = (np.cumsum(sizes) - sizes)[pieces] - sums[:-1]
            at = np.repeat(moved, sizes[pieces])
            at += np.arange(len(at))
            ids, ends = np.frombuffer(b"".join(found), np.uint32)[at], sums[bounds].tolist()
            yield from (ids[a:b] for a, b in zip(ends, ends[1:]))

    def counts(self, texts: pa.Array | Iterable[str]) -> list[int]:
        """Number of ids of each text, for an encoder of lengths; null texts are empty."""
        out = []
        for found, pieces, bounds in self._grouped(texts):
            sums = np.append(0, np.cumsum(np.array(found, np.int64)[pieces]))
            out += np.diff(sums[bounds]).tolist()
        return out


@lru_cache(maxsize=4)
def encoder(path: str, lengths: bool = False) -> Encoder:
    """One per Python worker and tokenizer."""
    return Encoder(path, lengths)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
