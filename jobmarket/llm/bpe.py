"""BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a word is determined by the last token of each of its prefixes: token t ends
prefix p if the prefix before it has last token s, and s followed by t encodes to itself.
Distinct words in sorted order are the depth-first traversal of their trie: moving from one
word to the next keeps the states of the shared prefix and computes only what branches off.
Words met before are remembered per worker, up to a bound.

No shuffle: every task encodes the words of its own documents.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from jobmarket.llm.common import returning, table

#: words a worker remembers before it starts anew
REMEMBERED = 300_000
#: characters of documents whose new words are encoded together
BATCH_CHARS = 1 << 20
#: marks the symbol that ends a word; never a byte-level character
END = "\x01"
SUFFIX = "</w>"
SPACES = r"\t-\r \x85\xa0  -     　"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
ASCII_WORDS = re.compile(rf"{CONTRACTIONS}|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
WORDS = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Vocabulary and merges of a tokenizer file, and the encodings found so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: name for name, i in vocab.items()} | {i: name for name, i in self.special.items()}
        self.characters = byte_characters()
        keys = {}
        for c in self.characters.values():
            keys[c], keys[c + SUFFIX] = c, c + END
        self.ids = {key: vocab[name] for name, key in keys.items()}
        self.rank, self.split, self.merges = {}, {}, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            key = keys[a + b] = keys[a] + keys[b]
            token = self.ids[key] = vocab[a + b]
            if token in self.rank:
                raise ValueError(f"two merges make the token {a + b!r}")
            left, right = self.ids[keys[a]], self.ids[keys[b]]
            self.rank[token], self.split[token], self.merges[left, right] = rank, (left, right), rank
        self.width = {i: len(key) for key, i in self.ids.items()}
        # a token that its own characters don't encode to never occurs
        self.ids = {key: i for key, i in self.ids.items() if self._whole(i)}
        # lengths of the tokens that end with the same two characters, longest first
        lengths: dict[str, set[int]] = {}
        for key in self.ids:
            lengths.setdefault(key[-2:], set()).add(len(key))
        self.lengths = {tail: sorted(found, reverse=True) for tail, found in lengths.items()}
        self.valid: dict[int, bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def _whole(self, token: int) -> bool:
        return token not in self.split or self._apart(*self.split[token], self.rank[token])

    def _apart(self, left: int, right: int, limit: float = float("inf")) -> bool:
        """Whether no merge of rank below ``limit`` ever joins ``left`` and ``right`` while they are formed.

        Goes back in time: the later of the two merges at the boundary is undone, and a merge across
        the boundary must not come before it.  Of equal ranks the merge further left comes first.
        """
        rank, merges = self.rank, self.merges
        while True:
            if merges.get((left, right), float("inf")) < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit, left = a, self.split[left][1]
            else:
                limit, right = b + 1, self.split[right][0]

    def _last(self, word: str, end: int, last: list[int]) -> int:
        """Last token of the prefix of ``word`` up to ``end``; last[i] is that of the prefix up to i."""
        ids, valid = self.ids, self.valid
        for length in self.lengths.get(word[max(0, end - 2) : end], ()):
            if length > end:
                continue
            start = end - length
            token = ids.get(word[start:end])
            if token is None:
                continue
            if not start:
                return token
            pair = last[start] << 20 | token
            found = valid.get(pair)
            if found is None:
                found = valid[pair] = self._apart(last[start], token)
            if found:
                return token
        if word[end - 1] != END:  # else the last symbol is the one-character token with the word end, tried above
            return ids[word[end - 1]]
        raise ValueError(f"no token ends at {end} of {word!r}")

    def learn(self, words: set[str]) -> None:
        """Encode words of byte-level characters into ``known``, in one traversal of their trie."""
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        if len(self.valid) > REMEMBERED:
            self.valid.clear()
        ordered = sorted((self._spelled(w), w) for w in words)
        last, path = [0], ""
        for spelled, word in ordered:
            shared = 0
            for a, b in zip(path, spelled):
                if a != b:
                    break
                shared += 1
            del last[min(shared, len(last) - 1) + 1 :]
            for end in range(len(last), len(spelled)):
                last.append(self._last(spelled, end, last))
            path = spelled
            # the last character and the word end are one symbol
            whole, tokens = spelled + END, []
            end, token = len(whole), self._last(whole, len(whole), last)
            while end:
                tokens.append(token)
                end -= self.width[token]
                token = last[end]
            self.known[word] = tuple(reversed(tokens))

    def forget(self) -> None:
        """Give up what was remembered of words, before the worker turns to other tasks."""
        self.known.clear()
        self.valid.clear()

    def _spelled(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(map(self.characters.__getitem__, word.encode()))

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        # lower-casing is per character: a sigma at the end of a word is no exception
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of every text.  Special tokens in a text are their own ids."""
        split = [[(p, self.special.get(p)) for p in self.parts.split(t)] if "<|" in t else [(t, None)] for t in texts]
        pieces = [[[special] if special is not None else self.words(p) for p, special in parts] for parts in split]
        new = {w for parts in pieces for ws in parts for w in ws if not isinstance(w, int)} - self.known.keys()
        self.learn(new)
        known = self.known
        out = []
        try:
            for parts, names in zip(pieces, split):
                ids: list[int] = []
                for ws, (_, special) in zip(parts, names):
                    ids.extend(ws if special is not None else chain.from_iterable([known[w] for w in ws]))
                out.append(ids)
        except KeyError:  # remembered words were given up for the new ones
            self.known.clear()
            return self.encode_all(texts)
        return out

    def decode(self, ids) -> str:
        """Tokens joined by a space, as a tokenizer file without a decoder does."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    group, size = [], 0
    for value in texts:
        text = value.as_py() or ""
        group.append(text)
        size += len(text)
        if size >= BATCH_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str | None = None, ids: bool = True, decoded: bool = False, digests: bool = False) -> DataFrame:
    """doc_id and n_tokens with ids (array), decoded (text), and SHA-256 of both, as asked for.

    Whole texts are encoded; a null text counts as empty and gives no tokens.  Row for row: repeated
    rows repeat, an empty table gives an empty result, other columns are ignored.
    """
    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("n_tokens", "long")]
    fields += [("ids", "array<int>")] * ids + [("decoded", "string")] * decoded
    fields += [("ids_sha256", "string"), ("decoded_sha256", "string")] * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = encoder(path or default_path())  # the workers' own file
        digits = [str(i) for i in range(max(kernel.names) + 1)]
        for batch in batches:
            at = 0
            for group in _groups(batch.column(1)):
                encoded = kernel.encode_all(group)
                columns = [batch.column(0).slice(at, len(group)), pa.array([len(x) for x in encoded], pa.int64())]
                at += len(group)
                if ids:
                    offsets = np.cumsum([0, *map(len, encoded)])
                    flat = np.fromiter(chain.from_iterable(encoded), np.int32, offsets[-1])
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat)))
                if decoded:
                    columns.append(pa.array([kernel.decode(x) for x in encoded]))
                if digests:
                    for spell in (lambda x: " ".join([digits[i] for i in x]), kernel.decode):
                        columns.append(pa.array([hashlib.sha256(spell(x).encode()).hexdigest() for x in encoded]))
                yield pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])
        kernel.forget()

    return docs.select("doc_id", "text").mapInArrow(returning(run), ", ".join(f"{n} {t}" for n, t in fields))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), ids=False, digests=True)
