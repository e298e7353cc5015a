"""Token counts that follow edits, by a tree of counted segments for each document.

A text is cut where white space follows another character, or where letters, numbers and
other characters meet: no pre-token reaches across such a place, so segments are counted apart and a
tree holds the sums. An edit is found by going down the tree, and only the
segments that it touches are encoded again, with the neighbour where a cut is no
longer such a place. Then the sums above them are brought up to date. A tree with no room
for the new segments is laid out anew, which encodes nothing.

A run of letters, of numbers or of other characters is one pre-token, however long, and is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import unicodedata
from collections.abc import Callable

import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkbeam.llm.batches import map_batches, per_worker

#: Characters of a segment, about.
SEGMENT = 32



def _kind(code: int) -> str:
    """L for letters, N for numbers, O for other visible characters, if they have been so since Unicode 3.2."""
    now, then = (db.category(chr(code))[0] for db in (unicodedata, unicodedata.ucd_3_2_0))
    return "" if now != then else now if now in "LN" else "O" if now in "PSM" else ""


def _cuts() -> str:
    ranges: dict[str, str] = {"L": "", "N": "", "O": ""}
    for kind, run in itertools.groupby(range(0x21, 0x10000), _kind):
        if kind:
            codes = list(run)
            ranges[kind] += f"\\u{codes[0]:04x}-\\u{codes[-1]:04x}"
    letter, number, other = ranges.values()
    # after an apostrophe, letters may belong to it
    return (
        f"(?<=[{letter}{number}{other}])(?=[ \n])|(?<=[{letter}])(?=[{number}{other}])|"
        f"(?<=[{number}])(?=[{letter}{other}])|(?<=[{other}])(?<!')(?=[{letter}{number}])"
    )


_CUT = re.compile(_cuts())


def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def counter(path: str) -> Callable[[str], int]:
    """How many tokens a text has, by a file of ranks that each worker loads once."""
    encoding = per_worker(("ranks", path), lambda: _encoding(path))
    return lambda text: len(encoding.encode_ordinary(text))


def segments(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > 2 * SEGMENT:
        cut = _CUT.search(text, at + SEGMENT)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


class CountedText:
    """A text with the number of its tokens, kept while it is edited."""

    def __init__(self, text: str, count: Callable[[str], int]):
        self._count, self.encoded = count, 0
        self._lay_out([self._counted(part) for part in segments(text)])
        self.at_first = self.encoded

    def _counted(self, part: str) -> tuple[str, int]:
        self.encoded += len(part)
        return part, self._count(part) if part else 0

    def _lay_out(self, counted: list[tuple[str, int]]) -> None:
        """A tree over the segments, with a free place after each."""
        self._size = 2 << (len(counted) - 1).bit_length()
        self._parts = [""] * self._size
        self._chars, self._tokens = [0] * (2 * self._size), [0] * (2 * self._size)
        for i, one in enumerate(counted):
            self._put(2 * i, *one)
        for i in range(self._size - 1, 0, -1):
            self._add_up(i)

    def _put(self, i: int, part: str, tokens: int) -> None:
        self._parts[i] = part
        self._chars[self._size + i], self._tokens[self._size + i] = len(part), tokens

    def _add_up(self, i: int) -> None:
        self._chars[i] = self._chars[2 * i] + self._chars[2 * i + 1]
        self._tokens[i] = self._tokens[2 * i] + self._tokens[2 * i + 1]

    @property
    def tokens(self) -> int:
        return self._tokens[1]

    @property
    def length(self) -> int:
        return self._chars[1]

    def text(self) -> str:
        return "".join(self._parts)

    def _find(self, at: int) -> tuple[int, int]:
        """The segment that holds the character at ``at``, and where it begins."""
        node, begin = 1, 0
        while node < self._size:
            node *= 2
            if at - begin >= self._chars[node] and self._chars[node + 1]:
                begin += self._chars[node]
                node += 1
        return node - self._size, begin

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from ``start`` up to ``end``; both are brought into the text."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        first, begin = self._find(start)
        last, last_begin = self._find(max(start, end - 1))
        if last < first:
            last, last_begin = first, begin
        stop = last_begin + len(self._parts[last])
        changed = self._parts[first][: start - begin] + new + self._parts[last][end - last_begin :]
        # take in neighbours until both ends are places where segments may be cut
        while begin:
            before, at = self._find(begin - 1)
            if changed and _CUT.search(self._parts[before][-1] + changed[0]):
                break
            changed, first, begin = self._parts[before] + changed, before, at
        while stop < self.length:
            after, at = self._find(stop)
            if changed and _CUT.search(changed[-1] + self._parts[after][0]):
                break
            changed, last, stop = changed + self._parts[after], after, at + len(self._parts[after])
        pieces = [self._counted(part) for part in segments(changed)]
        while len(pieces) > last - first + 1 and last + 1 < self._size and not self._parts[last + 1]:
            last += 1  # a free place
        if len(pieces) > last - first + 1:
            leaves = list(zip(self._parts, self._tokens[self._size :]))
            self._lay_out([leaf for leaf in leaves[:first] + pieces + leaves[last + 1 :] if leaf[0]] or [("", 0)])
            return
        for i in range(first, last + 1):
            self._put(i, *(pieces[i - first] if i - first < len(pieces) else ("", 0)))
        low, high = (self._size + first) // 2, (self._size + last) // 2
        while low:
            for i in range(low, high + 1):
                self._add_up(i)
            low, high = low // 2, high // 2


def edited_counts(df: DataFrame, keep: list[str], text: str, edits: str, path: str) -> DataFrame:
    """Token counts before and after the edits of every row, beside ``keep``.

    ``edits`` is an array of structs ``start``, ``stop`` and ``new``, applied one
    after the other; each counts characters of the text as it then is, and
    places beyond the text count as its end. ``encoded_again`` is how many
    characters had to be encoded for them. Null texts count as empty, null
    arrays as no edits, and null fields as 0 or no text. Equal rows give equal
    rows. Other columns are ignored. An empty table gives an empty one. Texts of any length are followed whole.
    """
    both = df.select(*keep, F.struct(F.col(text).alias("text"), F.col(edits).alias("edits")).alias("_both"))

    def work() -> Callable[[list], list[tuple]]:
        count = counter(path)

        def follow(row: dict) -> tuple:
            own = CountedText(row["text"] or "", count)
            before = own.tokens
            for e in row["edits"] or []:
                own.edit(e["start"] or 0, e["stop"] or 0, e["new"] or "")
            again = own.encoded - own.at_first
            digest = hashlib.sha256(own.text().encode()).hexdigest()
            return before, own.tokens, again, own.length, digest

        return lambda rows: [follow(row) for row in rows]

    added = "tokens_before long, tokens_after long, encoded_again long, n_chars long, text_sha256 string"
    return map_batches(both, keep, "_both", work, added)
