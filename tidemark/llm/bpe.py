"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece exactly one vocabulary token can be the last token of that prefix's
encoding. Storing this token per prefix gives the encoding by walking back from the end, makes an
append exact (earlier entries never change) and lets an edit keep all entries before it.

Null text is encoded as empty text. Rows are independent: repeated rows and extra columns pass
through unchanged, an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, texts_mapped

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Entries of token pairs in one generation of a worker's memory, and of words.
REMEMBERED, REMEMBERED_WORDS = 250_000, 300_000
#: Spaces between two such characters always start a new piece, so texts can be cut there first.
BETWEEN_WORDS = re.compile(r"(?<=[!-~À-ÖØ-öø-ÿ]) (?=[!-~À-ÖØ-öø-ÿ])")
#: Marks that end a word and are pieces of their own there.
MARKS = ",.;:!?"
CLOSED = re.compile(r"[!-~À-ÖØ-öø-ÿ]").match
#: White space as the tokenizer's pattern means it: the Unicode property, without the separators U+001C to U+001F.
WHITE = r"\t-\r \x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def piece_pattern(pattern: str):
    """The splitting pattern with its white space class spelled out."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))


def each_of(values: dict, keys) -> Iterable:
    """The value of each key."""
    return itemgetter(*keys)(values) if len(keys) > 1 else [values[k] for k in keys]


class Recent(dict):
    """A bounded memory: a full generation becomes the old one, and what is asked for again moves over."""

    def __init__(self, size: int, make):
        super().__init__()
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Suffixes:
    """For every place of a string the longest token that ends there, and from a token the next shorter one."""

    def __init__(self):
        self.goto: dict[int, int] = {}
        self.token, self.fail = [-1], [0]
        self.size: dict[int, int] = {}
        self.shorter: dict[int, int] = {}
        self.steps = Recent(REMEMBERED, self._step)

    def add(self, spelled: str, rank: int) -> None:
        at = 0
        for byte in spelled.encode("latin-1"):
            after = self.goto.get(at << 8 | byte)
            if after is None:
                after = self.goto[at << 8 | byte] = len(self.token)
                self.token.append(-1)
                self.fail.append(0)
            at = after
        self.token[at] = rank
        self.size[rank] = len(spelled)

    def _step(self, key: int) -> int:
        at, byte = key >> 8, key & 255
        while (after := self.goto.get(at << 8 | byte)) is None:
            if not at:
                return 0
            at = self.fail[at]
        return after

    def link(self) -> None:
        """Where to go on when a byte does not fit, from short prefixes to long ones."""
        below: dict[int, list[tuple[int, int]]] = {}
        for key, after in self.goto.items():
            below.setdefault(key >> 8, []).append((key & 255, after))
        level = [0]
        while level:
            deeper = []
            for at in level:
                for byte, after in below.get(at, ()):
                    back = self.fail[after] = self._step(self.fail[at] << 8 | byte) if at else 0
                    if self.token[after] >= 0:
                        self.shorter[self.token[after]] = self.token[back]
                    else:
                        self.token[after] = self.token[back]
                    deeper.append(after)
            level = deeper


class PrefixTable:
    """Last valid token of every prefix of a byte string, for one vocabulary of ranks.

    Byte strings are handled as text of the same code points, one for each byte, which is what the
    automaton that finds all tokens ending at a place reads.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.spelled = {rank: token for token, rank in self.ranks.items()}
        self.longest, self.none = max(map(len, ranks)), max(self.tokens) + 1
        #: Of each token of several bytes the two parts of its last merge.
        self.halves: dict[int, tuple[int, int]] = {}
        self.suffixes = Suffixes()
        for token, rank in self.ranks.items():
            merged, last = self.merged(token)
            if merged == [rank]:  # only a token whose own bytes merge into it can end an encoding
                self.suffixes.add(token, rank)
                if last:
                    self.halves[rank] = last
        self.suffixes.link()
        #: Whether merges come by rising rank: then two tokens' last merges tell whether they stay apart.
        self.rising = all(max(pair) < rank or len(self.spelled[rank]) == 2 for rank, pair in self.halves.items()) and all(
            part in self.halves or len(self.spelled[part]) == 1 for pair in self.halves.values() for part in pair
        )
        self.follows = Recent(REMEMBERED, lambda pair: self.apart(*divmod(pair, self.none)))

    def merged(self, data: str) -> tuple[list[int], tuple[int, int] | None]:
        """Ranks after merging the lowest-ranked neighbours, leftmost first, and the last pair merged; for short strings."""
        parts, last = list(data), None
        rank, none = self.ranks.get, self.none
        pairs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) != none:
            i = pairs.index(best)
            last = parts[i], parts[i + 1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts], last and (self.ranks[last[0]], self.ranks[last[1]])

    def apart(self, left: int, right: int) -> bool:
        """Whether merging keeps these two tokens apart when they are neighbours.

        Going back in time, the later of both tokens' last merges is undone again and again. What then
        touches at the border were neighbours at that time, and would have merged if a token of theirs
        came before the next merge of either.
        """
        spelled = self.spelled
        if not self.rising:
            return self.merged(spelled[left] + spelled[right])[0] == [left, right]
        rank, halves, none = self.ranks.get, self.halves.get, self.none
        until_left = until_right = none
        while True:
            joint = rank(spelled[left] + spelled[right], none)
            if joint < until_left and joint <= until_right and joint != none:
                return False
            parts_left, parts_right = halves(left), halves(right)
            if parts_left and (not parts_right or left > right):
                until_left, left = left, parts_left[1]
            elif parts_right:
                until_right, right = right, parts_right[0]
            else:
                return True

    def extend(self, data: str, last: list[int], states: list[int] | None = None) -> list[int]:
        """Fill ``last`` (one token per prefix already known, entry 0 unused) up to all of ``data``.

        ``states``, if given, has the automaton's state after each of these prefixes, and is filled too.
        """
        steps, longest_token, shorter, size_of = self.suffixes.steps, self.suffixes.token, self.suffixes.shorter, self.suffixes.size
        follows, base, known = self.follows, self.none, len(last) - 1
        if states is None:
            states = [0]
            for c in data[max(0, known - self.longest) : known]:
                states[0] = steps[states[0] << 8 | ord(c)]
        state = states[-1]
        for end, byte in enumerate(data[known:].encode("latin-1"), known + 1):
            state = steps[state << 8 | byte]
            states.append(state)
            token = longest_token[state]
            while token >= 0:
                start = end - size_of[token]
                if not start or follows[last[start] * base + token]:
                    break
                token = shorter[token]
            if token < 0:
                raise ValueError("the ranks do not cover every byte")
            last.append(token)
        return last

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """Exact state after appending; no earlier entry changes."""
        return data + more, self.extend((data + more).decode("latin-1"), list(last))

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """State after replacing ``data[start:end]``: work stops once the old entries line up again."""
        out, shift = data[:start] + new + data[end:], len(new) - (end - start)
        state, same, text = last[: start + 1], 0, out.decode("latin-1")
        for at in range(start + 1, len(out) + 1):
            self.extend(text[:at], state)
            before = at - shift
            same = same + 1 if before > end and state[at] == last[before] else 0
            if same >= self.longest:
                return out, state + last[before + 1 :]
        return out, state

    def walk(self, last: list[int]) -> list[int]:
        ids, at, spelled = [], len(last) - 1, self.spelled
        while at > 0:
            token = last[at]
            ids.append(token)
            at -= len(spelled[token])
        return ids[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        spelled = data.decode("latin-1")
        token = self.ranks.get(spelled)
        if token is not None:
            return [token]
        return self.walk(self.extend(spelled, [0]))

    def encode_sorted(self, pieces: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of pieces in order of their bytes, each an append to the prefix that it shares with the one before."""
        before, last, states, ranks = "", [0], [0], self.ranks
        for piece in pieces:
            spelled, shared = piece.decode("latin-1"), 0
            token = ranks.get(spelled)
            if token is not None:
                yield [token]
                continue
            for a, b in zip(spelled, before):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            self.extend(spelled, last, states)
            before = spelled
            yield self.walk(last)


class Encoder:
    """Texts to ids and back; every text is encoded whole."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.prefixes = PrefixTable(ranks)
        self.split = piece_pattern(pattern).findall
        self.decimals = {rank: str(rank) for rank in self.prefixes.tokens}
        self._words, self._others = Recent(REMEMBERED_WORDS, self._word), Recent(REMEMBERED // 10, self._piece)

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(self.prefixes.encode_piece(piece.encode()))

    def _pieces(self, text: str) -> tuple[int, ...]:
        known, others = self._words.__getitem__, self._others.__getitem__
        make = lambda p: self._piece(p) if len(p) > 64 else known(p[1:]) if p[0] == " " and p[1:].isalpha() and CLOSED(p[1]) and CLOSED(p[-1]) else others(p)
        return tuple(chain.from_iterable(map(make, self.split(text))))

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a space and ``word``, for what stands between two spaces; () if it does not stand for itself."""
        if not (CLOSED(word[:1]) and CLOSED(word[-1:])):
            return ()
        if word.isalpha():
            return self._piece(" " + word)
        if word[-1] in MARKS and word[:-1].isalpha() and CLOSED(word[-2]):
            return self._words[word[:-1]] + self._others[word[-1]]
        return self._pieces(" " + word)

    def foresee(self, texts: Iterable[str]) -> None:
        """Remember the words of ``texts`` that are not known, from one sorted pass over their letters."""
        words = set().union(*(text.split(" ") for text in texts)).difference(self._words, self._words.old)
        stems = {w[:-1] if w[-1:] in MARKS else w for w in words if len(w) <= 200}
        new = sorted(s for s in stems if s.isalpha() and s not in self._words and CLOSED(s) and CLOSED(s[-1]))
        for stem, ids in zip(new, self.prefixes.encode_sorted((" " + stem).encode() for stem in new)):
            self._words[stem] = tuple(ids)

    def encode(self, text: str) -> list[int]:
        first, *rest = text.split(" ")
        if CLOSED(first[-1:]) and (not rest or max(map(len, rest)) <= 200):
            parts = list(map(self._words.__getitem__, rest))
            if all(parts):
                return list(chain(self._pieces(first), chain.from_iterable(parts)))
        first, *rest = BETWEEN_WORDS.split(text)
        known = self._words.__getitem__
        return list(chain(self._pieces(first), chain.from_iterable(len(w) <= 200 and known(w) or self._pieces(" " + w) for w in rest)))

    def decode(self, ids) -> bytes:
        return b"".join(each_of(self.prefixes.tokens, ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(key: str, ranks, pattern: str) -> Encoder:
    """The worker process's encoder for a broadcast of ranks, by the digest of both; it outlives tasks."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks.value, pattern)
    return _ENCODERS[key]


def encode_documents(df: DataFrame, path: str | None = None, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Encode ``text`` of every row by the ranks at ``path`` and decode it again.

    Returns ``keep`` and n_tokens, ids (if ``with_ids``), ids_sha256, decoded_sha256. The rank file
    (about 1 MB, fixed) is read on the driver and broadcast.
    """
    spark = df.sparkSession
    table_of_ranks, pattern = read_ranks(path or public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN
    key = hashlib.sha256(repr((sorted(table_of_ranks.items()), pattern)).encode()).hexdigest()
    ranks = spark.sparkContext.broadcast(table_of_ranks)
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))

    def work(texts: list[str]) -> list:
        encoder = encoder_for(key, ranks, pattern)
        counts, ids_of, listed, decoded, decimals = [], [], [], [], encoder.decimals
        encoder.foresee(texts)
        for value in texts:
            ids = encoder.encode(value)
            counts.append(len(ids))
            ids_of.append(np.array(ids, dtype=np.int32) if with_ids else None)
            listed.append(hashlib.sha256(",".join(each_of(decimals, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
        return [counts, ids_of, listed, decoded] if with_ids else [counts, listed, decoded]

    ids = "ids array<int>, " if with_ids else ""
    return texts_mapped(kept, "_text", f"n_tokens bigint, {ids}ids_sha256 string, decoded_sha256 string", work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: whole texts of ``documents``, encoded and decoded."""
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
