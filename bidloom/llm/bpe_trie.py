"""BPE encoding by depth-first traversal of a trie of distinct words, and decoding.

A word's encoding is fixed by one number per prefix: the last token of the
prefix's own encoding. A token ends the encoding of a prefix exactly when it is
a suffix of it and stays apart from the last token of what precedes it. So the
distinct words of a batch form a trie, the traversal gives each node its last
token from the nodes above, and words that share a prefix share that work. The
tokens of a word are read back from its last node.

The texts stay where Spark has them: a narrow map over the scan, without a
shuffle. A task remembers the words it has met in two halves: when the newer one
is full it becomes the older one, whose words move up as they are met again and
are forgotten otherwise. So memory is bounded by ``most_words`` whatever the
number of distinct words, and words that keep coming are encoded once. All are
forgotten when the task ends.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from bidloom.llm.spans import slices

END = "</w>"
MOST_WORDS = 240_000

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0D\x20a-z0-9]+")


def byte_letters() -> list[str]:
    """The printable letter of each byte: its own where it has one, else the next free one above 255."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(free)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a word-end BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.ids: dict[str, int] = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.letters = byte_letters()
        self.merge_rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(spec["model"]["merges"]):
            pair = self.ids[left], self.ids[right]
            made = self.ids[left + right]
            if any(part in self.halves and self.halves[part][0] >= rank for part in pair) or made in self.halves:
                raise ValueError("merges must be in the order in which their parts are made")
            self.merge_rank[pair] = rank
            self.halves[made] = rank, *pair
        self.longest = max(len(self._bare(t)) for t in self.ids)
        self.known: dict[int, bool] = {}
        wanted = sorted(self.special, key=len, reverse=True)
        self.split_special = regex.compile("|".join(map(regex.escape, wanted))) if wanted else None

    @staticmethod
    def _bare(token: str) -> str:
        return token.removesuffix(END) if token != END else token

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token that touch one of its ends, largest first, with the rank that uses each up."""
        out, used = [], float("inf")
        while True:
            out.append((token, used))
            if token not in self.halves:
                return out
            used, *parts = self.halves[token]
            token = parts[side]

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay two: no merge across their border ever comes first."""
        stays = self.known[left << 20 | right] = self._stay_apart(left, right)
        return stays

    def _stay_apart(self, left: int, right: int) -> bool:
        a, b = self._spine(left, 1), self._spine(right, 0)
        i, j = len(a) - 1, len(b) - 1
        while True:
            (x, x_used), (y, y_used) = a[i], b[j]
            rank = self.merge_rank.get((x, y))
            # at equal rank the merge further left is done first
            if rank is not None and rank < x_used and rank <= y_used:
                return False
            if i == 0 and j == 0:
                return True
            if x_used <= y_used:
                i -= 1
            else:
                j -= 1


class Trie:
    """Encodings of words, found by walking the trie of the new ones depth first.

    Sorted words are their trie in depth-first order: what a word shares with the
    one before it is the path they have in common, and ``last`` holds the state
    (last token) of each node on the present path. A node is visited once however
    many words pass through it; memory is one path, not all nodes.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.size = {i: len(vocabulary._bare(t)) for t, i in vocabulary.ids.items()}
        self.texts = {i: str(i) for i in vocabulary.names}
        self.to_letters = {b: letter for b, letter in enumerate(vocabulary.letters)}
        self.ids: dict[str, str] = {}
        self.names: dict[str, str] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all words but the special tokens."""
        self.age()
        self.age()

    def age(self) -> None:
        """Forget the older half; the newer one takes its place and starts again with the special tokens."""
        special = self.vocabulary.special
        self.older: tuple[dict[str, str], dict[str, str]] = self.ids, self.names
        self.ids = {mark: str(i) for mark, i in special.items()}
        self.names = {mark: mark for mark in special}

    def recall(self, words: set[str]) -> None:
        """Have the encodings of all these words in the newer half."""
        new = words.difference(self.ids)
        old_ids, old_names = self.older
        met = [w for w in new if w in old_ids]
        for word in met:
            self.ids[word] = old_ids[word]
            self.names[word] = old_names[word]
        new.difference_update(met)
        if new:
            self.learn(new)

    def learn(self, words: set[str]) -> None:
        vocabulary, size = self.vocabulary, self.size
        token_of, known, apart, longest = vocabulary.ids.get, vocabulary.known.get, vocabulary.apart, vocabulary.longest
        texts, names = self.texts, vocabulary.names
        last = [-1]
        before = ""
        # latin-1 letters sort as their bytes do; the word itself is found again from them
        for coded in sorted([w.encode("utf-8").decode("latin-1") for w in words]):
            plain = coded.isascii() and coded.isprintable()
            letters = coded if plain else coded.translate(self.to_letters)
            whole = len(letters)
            closed = letters + END
            # nodes shared with the word before; a word's own end is a leaf of its own
            shared, most = 0, min(whole, len(before)) - 1
            while shared < most and coded[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, whole + 1):
                # the state: the suffix token that stays apart from the last token before it
                stop = depth if depth < whole else None
                for start in range(depth - 1, max(depth - longest, 0) - 1, -1):
                    token = token_of(closed[start:stop])
                    if token is None:
                        continue
                    if not start:
                        break
                    left = last[start]
                    stays = known(left << 20 | token)
                    if stays or stays is None and apart(left, token):
                        break
                else:
                    raise ValueError(f"no token ends {closed[:stop]!r}")
                last.append(token)
            tokens = []
            depth = whole
            while depth:
                token = last[depth]
                tokens.append(token)
                depth -= size[token]
            tokens.reverse()
            word = coded if coded.isascii() else coded.encode("latin-1").decode("utf-8")
            self.ids[word] = " ".join([texts[t] for t in tokens])
            self.names[word] = " ".join([names[t] for t in tokens])
            del last[whole:]
            before = coded


def pieces(text: str, vocabulary: Vocabulary) -> list[str]:
    """The words of a text in order; special tokens stand for themselves.

    Blanks never enter a word, so replacing their runs changes nothing here.
    """
    parts, marks = [text], []
    if vocabulary.split_special is not None and vocabulary.split_special.search(text):
        marks = vocabulary.split_special.findall(text)
        parts = vocabulary.split_special.split(text)
    out: list[str] = []
    for k, part in enumerate(parts):
        if part.isascii():
            out += _ASCII_PIECES.findall(part.lower())
        else:
            # each letter is lower-cased by itself: no final sigma
            out += _PIECES.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        if k < len(marks):
            out.append(marks[k])
    return out


class Codec:
    """Encodes and decodes texts; keeps what it has learned between calls."""

    def __init__(self, path: str, most_words: int = MOST_WORDS) -> None:
        self.vocabulary = Vocabulary(path)
        self.trie = Trie(self.vocabulary)
        self.most_words = most_words

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[str, str, int]]:
        """Ids joined by a space, decoded text and number of tokens of each text."""
        if len(self.trie.ids) > self.most_words // 2:
            self.trie.age()
        split = [pieces(t, self.vocabulary) if t else [] for t in texts]
        self.trie.recall(set().union(*split))
        ids, names = self.trie.ids.__getitem__, self.trie.names.__getitem__
        for words in split:
            coded = " ".join(map(ids, words))
            yield coded, " ".join(map(names, words)), coded.count(" ") + (coded != "")


@lru_cache(maxsize=1)
def _codec(path: str, most_words: int) -> Codec:
    return Codec(path, most_words)


def encode_decode(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_words: int = MOST_WORDS,
    texts: bool = True,
) -> DataFrame:
    """Token ids and decoded text of every document.

    ``tokenizer`` is the path of the vocabulary file on every executor. Returns
    the id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one
    space), ``decoded_sha256`` and, with ``texts``, ``ids`` (array of int) and
    ``decoded``. Special tokens written in a text become their ids.

    A null text counts as empty: no tokens, and the digest of nothing. Null and
    repeated ids pass through, each row by itself. Other columns are not read.
    Texts of any length are encoded whole, in time linear in their length.
    """
    kind = [("_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    if texts:
        kind += [("ids", "array<int>"), ("decoded", "string")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer, most_words)
        for whole in batches:
            for batch in slices(whole, "_text", 1 << 20):
                rows = list(codec(batch.column("_text").to_pylist()))
                columns = [
                    batch.column("_id"),
                    pa.array([n for _, _, n in rows], pa.int64()),
                    pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d, _ in rows], pa.string()),
                ]
                if texts:
                    columns += [
                        pa.array([[int(i) for i in ids.split()] for ids, _, _ in rows], pa.list_(pa.int32())),
                        pa.array([d for _, d, _ in rows], pa.string()),
                    ]
                yield pa.RecordBatch.from_arrays(columns, [n for n, _ in kind])
        # the process outlives the task: only the vocabulary stays in it
        codec.trie.clear()
        codec.vocabulary.known.clear()

    rows = docs.selectExpr(f"cast(`{id_col}` as bigint) as _id", f"cast(`{text_col}` as string) as _text")
    coded = rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in kind))
    return coded.withColumnRenamed("_id", id_col)
