"""Byte pair encoding by backtracking over longest matches, and decoding by offsets.

A sequence of tokens is what merging in rank order gives exactly if every two
neighbours in it are compatible, that is, if merging their joined text leaves
the same two tokens. So a word is encoded by taking the longest token that
starts at each place (found by one Aho-Corasick pass), going to shorter ones or
a step back where neighbours are not compatible. Compatibility of a pair is
worked out once and kept in a table. The time is linear in the length of the
word, where merging is quadratic or needs a queue.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import ChainMap
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from larkbeam.llm.batches import map_batches, per_worker
from larkbeam.llm.spans import SHORT, mixed, slices, span_hashes, spans

#: Words in a worker's table, and pairs, before it is emptied: bounds its memory.
TABLE_ENTRIES = 800_000

#: Words that take their steps together.
WORDS = 10_000

#: Bytes of text that are encoded together.
BLOCK = 1 << 19

_ASCII_SPACE = re.compile(rb"[\t-\r ]")

#: Text in which normalising is lower-casing, one character for one.
_LATIN = re.compile("[!-~\xa1-\u012f\u0131-\u017f]+").fullmatch
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _latin_of(kind: str) -> str:
    return "".join(chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


def _latin_words() -> re.Pattern[str]:
    letters, numbers = _latin_of("L"), _latin_of("N")
    return re.compile(f"{_CONTRACTIONS}|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")


class IdTable:
    """Ids by hash of the text, in arrays, so that many are looked up at once."""

    def __init__(self, entries: int = TABLE_ENTRIES):
        self.entries = entries
        bits = int(entries * 2).bit_length()
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.zeros(1 << bits, np.uint64)
        self.begin = np.zeros(1 << bits, np.int64)
        self.count = np.zeros(1 << bits, np.int64)
        self.clear()

    def clear(self) -> None:
        self.n, self.used = 0, 0
        self.key[:] = 0
        self.ids = np.empty(1 << 16, np.uint32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        at = (keys >> self._shift).astype(np.int64)
        found = self.key[at]
        out = np.where(found == keys, at, -1)
        open_ = np.flatnonzero((found != keys) & (found != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self._mask
            found = self.key[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (found != 0)]
        return out

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        flat = np.frombuffer(b"".join(ids), "<u4")
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        places = (keys >> self._shift).tolist()
        key, at = self.key, self.used
        for k, place, own in zip(keys.tolist(), places, ids):
            while key[place]:
                place = (place + 1) & self._mask
            key[place] = k
            self.begin[place], self.count[place] = at, len(own) // 4
            at += len(own) // 4
        self.used = at
        self.n += len(ids)


class BacktrackingBpe:
    """The model of a tokenizer file: words, as byte characters, to ids."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[Iterable[str]], suffix: str = ""):
        self.suffix = suffix
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merged_at: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            whole, pair = vocab[a + b], (vocab[a], vocab[b])
            self.merged_at.setdefault(pair, rank)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = pair, rank
        self.last = len(self.rank) + 1
        self._ids = {
            self._spelled(token): i
            for token, i in vocab.items()
            if i in self.parts and self._reachable(i) or self._is_base(token)
        }
        size = max(vocab.values()) + 1
        self._length, self._shorter = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self._matches = ahocorasick.Automaton()
        for spelled, i in self._ids.items():
            self._length[i] = len(spelled)
            starts = (spelled[:n] for n in range(len(spelled) - 1, 0, -1))
            self._shorter[i] = next((self._ids[s] for s in starts if s in self._ids), -1)
            self._matches.add_word(spelled, (i, len(spelled) - 1))
        self._matches.make_automaton()
        self._pairs = IdTable(TABLE_ENTRIES // 4)

    def _is_base(self, token: str) -> bool:
        return len(token.removesuffix(self.suffix) if self.suffix else token) == 1

    def _spelled(self, token: str) -> str:
        """A character for each unit: the last unit of a word is another one than elsewhere."""
        if self.suffix and token.endswith(self.suffix) and token != self.suffix:
            return self.word(token.removesuffix(self.suffix))
        return token

    def word(self, text: str) -> str:
        return text[:-1] + chr(0xE000 + ord(text[-1])) if self.suffix else text

    def _unmerged(self, left: int, right: int, bound: int) -> bool:
        """Whether no merge across the two comes before rank ``bound``.

        Takes the last merges back, one at a time, on whichever side was merged
        later. A merge across the border that ranks before the one taken back
        would have come first. Of equal ranks, the one further left comes first.
        """
        while True:
            if self.merged_at.get((left, right), self.last) < bound:
                return False
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a > b:
                bound, left = a, self.parts[left][1]
            elif b >= 0:
                bound, right = b + 1, self.parts[right][0]
            else:
                return True

    def _reachable(self, token: int) -> bool:
        """Whether merging the token's own text gives it; others never occur."""
        left, right = self.parts[token]
        whole = self._unmerged(left, right, self.rank[token])
        return whole and all(x not in self.parts or self._reachable(x) for x in (left, right))

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair may be neighbours, from the table, to which new pairs are added."""
        pairs = self._pairs
        keys = mixed((left.astype(np.uint64) << np.uint64(32)) + right.astype(np.uint64) + np.uint64(1))
        place = pairs.find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            different, first = np.unique(keys[new], return_index=True)
            if pairs.n + len(different) > pairs.entries:
                pairs.clear()
                return self.compatible(left, right)
            both = zip(left[new[first]].tolist(), right[new[first]].tolist())
            pairs.add(different, [b"fits" * self._unmerged(a, b, self.last) for a, b in both])
            place[new] = pairs.find(keys[new])
        return pairs.count[place] > 0

    def encode_long(self, text: str) -> bytes:
        """The ids of one word of any length."""
        word = self.word(text)
        longest = [-1] * len(word)
        for end, (token, back) in self._matches.iter(word):
            longest[end - back] = token
        dead = bytearray(len(word) + 1)
        fits: dict[tuple[int, int], bool] = {}
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(word):
            end = at + int(self._length[token])
            good = not dead[end]
            if good and out:
                pair = out[-1], token
                if pair not in fits:
                    fits[pair] = self._unmerged(*pair, self.last)
                good = fits[pair]
            if good:
                out.append(token)
                at = end
                token = longest[at] if at < len(word) else -1
                continue
            token = int(self._shorter[token])
            if token < 0:
                dead[at] = 1
                token = out.pop()
                at -= int(self._length[token])
        return np.array(out, "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of words, given as byte characters, as 32-bit numbers. All words take their steps together."""
        words = [self.word(t) for t in texts]
        joined = "\0".join([*words, ""])
        longest = np.full(len(joined) + 1, -1, np.int64)
        for end, (token, back) in self._matches.iter(joined):
            longest[end - back] = token  # longer ones come later
        length, shorter = self._length, self._shorter
        size = np.array([len(w) for w in words], np.int64)
        stop = np.cumsum(size + 1) - 1
        dead = np.zeros(len(joined) + 1, bool)  # ends from which the rest cannot be encoded
        out = np.zeros((len(words), int(size.max(initial=0)) + 1), np.int64)
        depth = np.zeros(len(words), np.int64)
        at = stop - size
        live = np.flatnonzero(size)
        token = longest[at]
        while len(live):
            own = token[live]
            end = at[live] + length[own]
            good = ~dead[end]
            second = good & (depth[live] > 0)
            after = live[second]
            good[second] = self.compatible(out[after, depth[after] - 1], own[second])
            went, stuck = live[good], live[~good]
            out[went, depth[went]] = own[good]
            depth[went] += 1
            at[went] = end[good]
            token[went] = longest[at[went]]
            token[stuck] = shorter[token[stuck]]
            back = stuck[token[stuck] < 0]
            dead[at[back]] = True
            depth[back] -= 1
            token[back] = out[back, depth[back]]
            at[back] -= length[token[back]]
            live = live[at[live] < stop[live]]
        rows, width = out.astype("<u4").tobytes(), 4 * out.shape[1]
        return [rows[i * width : i * width + 4 * n] for i, n in enumerate(depth.tolist())]


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte: itself if it can be seen, else one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Whole texts to ids and back, for a tokenizer file with byte characters.

    Text between white space is encoded once and then found by its hash of 64
    bits, if it is short. Ten million different words share one with a
    probability of about 1 in 400,000.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.model = BacktrackingBpe(model["vocab"], merges, model["end_of_word_suffix"] or "")
        library = Tokenizer.from_file(path)
        self._normalizer, self._pre = library.normalizer, library.pre_tokenizer
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        found = "|".join(re.escape(s) for s in sorted(self._special, key=len, reverse=True))
        self._special_pattern = re.compile(f"({found})") if found else None
        self._split = _latin_words().findall
        self._shown = {byte: char for char, byte in _byte_characters().items()}
        self._table = IdTable()
        self._words: dict[str, bytes] = {}
        size = max([*model["vocab"].values(), *self._special.values()]) + 1
        names = [""] * size
        for token, i in [*model["vocab"].items(), *self._special.items()]:
            names[i] = token
        self._names = _Offsets(names)
        self._decimals = _Offsets([str(i) for i in range(size)])

    def _words_of(self, chunk: str) -> list[str]:
        """The words of text without white space, as byte characters.

        Neither normalising nor splitting reaches across white space.
        """
        if not _LATIN(chunk):
            return [w for w, _ in self._pre.pre_tokenize_str(self._normalizer.normalize_str(chunk))]
        words = self._split(chunk.lower())
        if chunk.isascii():
            return words
        return [w.encode().decode("latin-1").translate(self._shown) for w in words]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        known = self._words
        if len(known) > TABLE_ENTRIES // 2:
            known.clear()
        words = [self._words_of(c) for c in chunks]
        new = {w for own in words for w in own if w not in known}
        fresh = {}
        usual = sorted((w for w in new if len(w) <= SHORT), key=len)
        for i in range(0, len(usual), WORDS):
            known.update(zip(usual[i : i + WORDS], self.model.encode_many(usual[i : i + WORDS])))
        for word in new:
            if len(word) > SHORT:
                fresh[word] = self.model.encode_long(word)
        if fresh:
            known = ChainMap(known, fresh)
        return [known[own[0]] if len(own) == 1 else b"".join([known[w] for w in own]) for own in words]

    def _block(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the text, and the starts of its words with their numbers of ids."""
        table, array = self._table, np.frombuffer(data, np.uint8)
        starts, ends = spans(array)
        if table.n + len(starts) > table.entries or table.used > 4 * table.entries:
            table.clear()
        short = ends - starts <= SHORT
        keys = span_hashes(array, starts, ends) | np.uint64(1)
        place = np.where(short, table.find(keys), -1)
        new = np.flatnonzero(short & (place < 0))
        if len(new):
            different, first = np.unique(keys[new], return_index=True)
            at = new[first]
            words = [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            table.add(different, self._chunks(words))
            place[new] = table.find(keys[new])
        begin, count, ids = table.begin[place], table.count[place], table.ids
        long = np.flatnonzero(~short)
        if len(long):
            own = self._chunks([data[a:b].decode() for a, b in zip(starts[long], ends[long])])
            count[long] = [len(x) // 4 for x in own]
            begin[long] = table.used + np.cumsum(count[long]) - count[long]
            ids = np.concatenate([ids[: table.used], *[np.frombuffer(x, "<u4") for x in own]])
        return ids[slices(count, begin)], starts, count

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts without special tokens, in blocks of many short ones or parts of a long one."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting: list[tuple[int, bytes]] = []
        size = 0

        def encode() -> None:
            ids, starts, count = self._block(b" ".join([part for _, part in waiting]))
            ends = np.cumsum([len(part) + 1 for _, part in waiting])
            upto = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(starts, ends)]
            for (i, _), own in zip(waiting, np.split(ids, upto[:-1])):
                out[i].append(own)
            waiting.clear()

        for i, text in enumerate(texts):
            for part in _parts(text):
                waiting.append((i, part))
                size += len(part)
                if size >= BLOCK:
                    encode()
                    size = 0
        if waiting:
            encode()
        return [own[0] if len(own) == 1 else np.concatenate(own) for own in out]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        special = self._special_pattern
        parts, owners = [], []
        for i, text in enumerate(texts):
            own = special.split(text) if special and special.search(text) else [text]
            parts += own
            owners += [i] * len(own)
        if len(parts) == len(texts):
            return self._plain([t.encode() for t in parts])
        plain = self._plain([b"" if p in self._special else p.encode() for p in parts])
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for i, part, ids in zip(owners, parts, plain):
            out[i].append(np.array([self._special[part]], np.uint32) if part in self._special else ids)
        return [np.concatenate(own) for own in out]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the token texts with a space between, as there is no decoder in the file."""
        return self._names.joined(ids)

    def decimals(self, ids: np.ndarray) -> bytes:
        return self._decimals.joined(ids)


class _Offsets:
    """The offset table: text i, with a space after it, is at offset[i] of one array of bytes."""

    def __init__(self, texts: list[str]):
        spelled = [f"{text} ".encode() for text in texts]
        self._length = np.array([len(s) for s in spelled], np.int64)
        self._offset = np.cumsum(self._length) - self._length
        self._bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        return self._bytes[slices(self._length[ids], self._offset[ids])].tobytes()[:-1]


def _parts(text: bytes) -> Iterator[bytes]:
    """The text, cut at white space if it is long."""
    at = 0
    while len(text) - at > 2 * BLOCK:
        cut = _ASCII_SPACE.search(text, at + BLOCK)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def encoder(path: str) -> Encoder:
    """The encoder of a file, made once in each Python worker."""
    return per_worker(("bpe", path), lambda: Encoder(path))


def encode_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    path: str,
    columns: str,
    derive: Callable[[Encoder, np.ndarray], tuple],
) -> DataFrame:
    """``columns`` that ``derive`` makes from the ids of every text, beside ``keep``.

    Texts are encoded whole. A null text counts as empty and has no ids. Other
    columns of ``df`` are ignored, and equal rows give equal rows. An empty
    table gives an empty one.
    """

    def work() -> Callable[[list], list[tuple]]:
        enc = encoder(path)
        return lambda texts: [derive(enc, ids) for ids in enc.encode_all([t or "" for t in texts])]

    return map_batches(df, keep, text, work, columns)


def token_ids(df: DataFrame, keep: list[str], text: str, path: str) -> DataFrame:
    """``ids array<int>`` of every text, and ``decoded string`` made from them."""
    return encode_texts(
        df, keep, text, path, "ids array<int>, decoded string",
        lambda enc, ids: (ids.tolist(), enc.decode_bytes(ids).decode()),
    )
