"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word exactly one token can be its last: a token that ends there and is
compatible with the unique last token of the prefix before it.  The tokens that end at each position
come from one walk of a suffix-link automaton over the vocabulary; the pair test replays, in merge
order, how both tokens grow towards their common border.  Back-pointers from the whole word give the
ids that merging by rank would give, in time linear in the word for a fixed vocabulary.  Words that aren't
remembered are gathered, and their prefixes of one length are looked at together, in arrays (``Prefixes``).

The vocabulary is a ``tokenizers`` JSON file of a BPE model with a word-end suffix, whose path is a
parameter; it is read on the driver and travels with the function.  Its normaliser, pre-tokenizer and model have
to be of the kind that is implemented here (``KIND``); any other is refused.

Rows: a null or empty text has no ids and decodes to the empty text.  Repeated rows are repeated.
Extra columns pass through; one that has an output's name is replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import table

#: Chunks of text that each worker remembers; beyond that those go that weren't met lately.
REMEMBERED = 1 << 18
#: Chunks that are looked at together; bytes of a word in arrays, longer ones go alone.
CHUNKS, LETTERS = 1 << 17, 63
#: States of the automaton that each worker remembers; forgotten all at once beyond that.
STATES = 1 << 14
#: Places (a power of two) in each of both tables of pairs.
PLACES = 20
#: Code points of text that are encoded before their results are handed on.
TOGETHER = 1 << 20
_NEVER = 1 << 40
#: The code points with the White_Space property.
_BREAKS = re.compile("[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD_ASCII = re.compile("[\x1c-\x1f]")
#: The usual pattern of words, and chunks that it is known to cut into Latin letters and one sign at most.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([,.;:!?]?)")
#: What a file has to say: NFC, white space as one space, lower case; words by a pattern, as bytes; no other options.
KIND = {
    "normalizer": [("NFC",), ("Replace", "\\s+", " "), ("Lowercase",)],
    "pre_tokenizer": [("Split", "Removed", True), ("ByteLevel", False, False)],
    "model": {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


def kind_of(spec: dict) -> dict:
    """What KIND says of a vocabulary file."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    normal = [(n["type"], *((n["pattern"].get("Regex"), n["content"]) if n["type"] == "Replace" else ())) for n in steps]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = [(p["type"], *((p["behavior"], p["invert"]) if p["type"] == "Split" else (p.get("add_prefix_space"), p.get("use_regex", True)))) for p in splits]
    return {"normalizer": normal, "pre_tokenizer": split, "model": {k: spec["model"].get(k, v) for k, v in KIND["model"].items()}}


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable in Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Prefixes:
    """The last tokens of all prefixes of many words at once.

    Arrays hold the automaton's steps and the tokens that end at its states, longest first, as far as words led there;
    a pair test's answer is in the first or second of two tables, at the places that its tokens hash to.
    """

    def __init__(self, tokens: dict[str, int], letters: list[str], final: dict[str, str], fit):
        self.tokens, self.fit, self.size = tokens, fit, np.zeros(max(tokens.values()) + 1, np.int64)
        self.symbols = [*letters, *(final[c] for c in letters)]
        self.begun = {t[:k] for t in tokens for k in range(len(t) + 1)}
        self.size[list(tokens.values())] = [len(t) for t in tokens]
        self.pairs = np.full((2, 1 << PLACES), -1, np.int64)
        self.forget()

    def forget(self) -> None:
        self.names, self.index = [""], {"": 0}
        self.to, self.ends = np.full((256, 512), -1, np.int32), np.full((256, 8), -1, np.int32)

    def state(self, name: str) -> int:
        if (found := self.index.get(name)) is None:
            found = self.index[name] = len(self.names)
            self.names.append(name)
            ends = [self.tokens[t] for t in (name[k:] for k in range(len(name))) if t in self.tokens]
            if found == len(self.to):
                self.to, self.ends = (np.concatenate((x, np.full_like(x, -1))) for x in (self.to, self.ends))
            if len(ends) > self.ends.shape[1]:
                self.ends = np.pad(self.ends, ((0, 0), (0, len(ends) - self.ends.shape[1])), constant_values=-1)
            self.ends[found, : len(ends)] = ends
        return found

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        after = self.to[state, symbol]
        if len(new := np.flatnonzero(after < 0)):
            for key in np.unique(state[new].astype(np.int64) << 9 | symbol[new]).tolist():
                name = self.names[key >> 9] + self.symbols[key & 511]
                while name not in self.begun:
                    name = name[1:]
                found = self.state(name)
                self.to[key >> 9, key & 511] = found
            after = self.to[state, symbol]
        return after

    def fits(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The pair test of each token after the one before it."""
        key = before.astype(np.int64) << 20 | token
        hashed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        first, second = (hashed >> np.uint64(64 - PLACES)).astype(np.int64), (hashed >> np.uint64(44 - PLACES) & np.uint64((1 << PLACES) - 1)).astype(np.int64)
        held = self.pairs[0, first]
        if len(away := np.flatnonzero(held >> 1 != key)):
            held[away] = self.pairs[1, second[away]]
            away = away[held[away] >> 1 != key[away]]
        if len(away):
            found, at, back = np.unique(key[away], return_index=True, return_inverse=True)
            answers = np.array([k << 1 | self.fit(k >> 20, k & 0xFFFFF) for k in found.tolist()], np.int64)
            a, b = first[away][at], second[away][at]
            free = self.pairs[0, a] < 0
            self.pairs[0, a[free]] = answers[free]
            self.pairs[1, b[~free]] = answers[~free]
            held[away] = answers[back]
        return (held & 1).astype(bool)

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of one to LETTERS bytes."""
        if len(self.names) > STATES:
            self.forget()
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-length, kind="stable")
        flat, start = np.frombuffer(b"".join(words), np.uint8), (np.cumsum(length) - length)[order]
        down = length[order]
        most = int(down[0])
        last = np.full((most + 1, len(words)), -1, np.int32)  # of the prefix of so many bytes; none of the empty one
        state = np.zeros(len(words), np.int64)
        for k in range(1, most + 1):
            n = int(np.searchsorted(-down, -k, "right"))
            symbol = flat[start[:n] + k - 1].astype(np.int64)
            symbol[down[:n] == k] += 256
            state = self.step(state[:n], symbol)
            rows, rank = np.arange(n), 0
            while len(rows):
                token = self.ends[state[rows], rank].astype(np.int64)
                if (token < 0).any():
                    raise ValueError("no token ends a prefix")
                size = self.size[token]
                fit = size == k
                rest = np.flatnonzero(~fit)
                fit[rest] = self.fits(last[k - size[rest], rows[rest]], token[rest])
                last[k, rows[fit]] = token[fit]
                rows, rank = rows[~fit], rank + 1
        # back from the whole words: ids from the last to the first
        at, rows, ids, owner = down.copy(), np.arange(len(words)), [], []
        while len(rows):
            token = last[at[rows], rows]
            ids.append(token)
            owner.append(rows)
            at[rows] -= self.size[token]
            rows = rows[at[rows] > 0]
        ids, owner = np.concatenate(ids)[::-1], np.concatenate(owner)[::-1]
        by = np.argsort(order[owner], kind="stable")
        packed, ends = ids[by].astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(order[owner], minlength=len(words)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]


class PrefixCoder:
    """Encoder and decoder for one vocabulary file's content."""

    def __init__(self, content: str):
        self.content = content
        self._load()

    def __getstate__(self) -> dict:
        return {"content": self.content, "unreachable": self.unreachable}

    def __setstate__(self, state: dict) -> None:
        self.content = state["content"]
        self._load(state["unreachable"])

    def _load(self, unreachable: frozenset[int] | None = None) -> None:
        spec = json.loads(self.content)
        model = spec["model"]
        if (found := kind_of(spec)) != KIND or not model.get("end_of_word_suffix") or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"a vocabulary of another kind: {found}")
        suffix = model["end_of_word_suffix"]
        self.letters = byte_letters()
        self.names: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        words = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(words)
        self.plain = _PLAIN.fullmatch if words == _WORDS else lambda chunk: None
        # symbols: a letter, or its counterpart in a private plane at the end of a word
        self.final = {c: chr(0xF0000 + ord(c)) for c in self.letters}
        body = lambda t: t[: -len(suffix) - 1] + self.final[t[-len(suffix) - 1]] if t.endswith(suffix) and len(t) > len(suffix) else t
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        vocab = model["vocab"]
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = made
            self.parts[made] = vocab[a], vocab[b]
        if any(max(p) >= t for t, p in self.parts.items()):
            raise ValueError("ids must be in the order of the merges")
        self.size = {i: len(body(t)) for t, i in vocab.items()}
        self._right: dict[int, list[int]] = {}
        self._left: dict[int, list[int]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        symbols = {i: body(t) for t, i in vocab.items()}
        self.unreachable = self._find_unreachable() if unreachable is None else unreachable
        self._prefixes = Prefixes({t: i for i, t in symbols.items() if i not in self.unreachable}, self.letters, self.final, self._fit)

    @cached_property
    def ends(self) -> ahocorasick.Automaton:
        """For words that go alone."""
        out = ahocorasick.Automaton()
        for t, i in self._prefixes.tokens.items():
            out.add_word(t, i)
        out.make_automaton()
        return out

    def _find_unreachable(self) -> frozenset[int]:
        """Tokens that merging by rank never gives for their own symbols: parts that can't meet as they should."""
        lost: set[int] = set()
        for made in sorted(self.parts):
            a, b = self.parts[made]
            if a in lost or b in lost or not self._fit(a, b, made):
                lost.add(made)
        return frozenset(lost)

    def _edge(self, token: int, side: int, known: dict[int, list[int]]) -> list[int]:
        """The tokens at one border of ``token`` while it is merged, from its symbol up to itself."""
        if (found := known.get(token)) is None:
            found = [*self._edge(self.parts[token][side], side, known), token] if token in self.parts else [token]
            known[token] = found
        return found

    def _fit(self, a: int, b: int, final: int = _NEVER) -> bool:
        """Whether no merge crosses the border of ``a`` and ``b`` before both are complete.

        ``final``: a merge of both that may follow.  Of equal merges the leftmost comes first, so one
        across the border yields to an equal one on its left but precedes one on its right.
        """
        left, right = self._edge(a, 1, self._right), self._edge(b, 0, self._left)
        i = j = 0
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else _NEVER
            next_right = right[j + 1] if j + 1 < len(right) else _NEVER
            across = self.merged.get((left[i], right[j]), _NEVER)
            if next_left == next_right == _NEVER:
                return across == _NEVER or across == final
            if across < next_left and across <= next_right:
                return False
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _word(self, symbols: str) -> list[int]:
        last: list[int] = [-1] * (len(symbols) + 1)
        for at, token in self.ends.iter(symbols):
            if last[at + 1] < 0:
                start = at + 1 - self.size[token]
                if start:
                    key = last[start], token
                    if (fits := self._fits.get(key)) is None:
                        if len(self._fits) > REMEMBERED:
                            self._fits.clear()
                        fits = self._fits[key] = self._fit(*key)
                    if not fits:
                        continue
                last[at + 1] = token
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at -= self.size[last[at]]
        return ids[::-1]

    def _cut(self, chunk: str) -> tuple[str, ...] | list[str]:
        """The words, in lower case, of a piece of text without white space."""
        low = "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()
        if plain := self.plain(low):
            return plain.groups() if plain[2] else (low,)
        return self.words.findall(low)

    def _many(self, words: set[str]) -> dict[str, bytes]:
        """Packed ids of different words."""
        data = [(w, w.encode()) for w in words]
        short = [x for x in data if len(x[1]) <= LETTERS]
        found = dict(zip([w for w, _ in short], self._prefixes([b for _, b in short]))) if short else {}
        for word, own in data:
            if len(own) > LETTERS:
                letters = [self.letters[b] for b in own]
                letters[-1] = self.final[letters[-1]]
                found[word] = np.array(self._word("".join(letters)), "<u4").tobytes()
        return found

    def _coded(self, parts: list[list[str]]) -> list[bytes]:
        """Packed ids of each list of chunks."""
        known, older = self._known, self._older
        new = set().union(*parts).difference(known)
        if older:
            again = {c: older[c] for c in new if c in older}
            known |= again
            new.difference_update(again)
        cut = {c: self._cut(c) for c in new}
        words = self._many(set().union(*cut.values()))
        known |= {c: words[own[0]] if len(own) == 1 else b"".join([words[w] for w in own]) for c, own in cut.items()}
        out = [b"".join(map(known.__getitem__, part)) for part in parts]
        for c in new:
            if len(c) >= 64:
                del known[c]
        if len(known) > REMEMBERED // 2:
            self._known, self._older = {}, known
        return out

    def _parts(self, text: str | None) -> Iterator[bytes | list[str]]:
        """Chunks of text, and packed ids of special tokens between them."""
        for part in self.split_special.split(text or "") if self.split_special and "<|" in (text or "") else (text or "",):
            if part in self.special:
                yield np.array([self.special[part]], "<u4").tobytes()
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            # what split() takes for white space beyond the property is in _ODD_ASCII
            chunks = _BREAKS.split(part) if _ODD_ASCII.search(part) else part.split()
            yield from (chunks[at : at + CHUNKS] for at in range(0, len(chunks), CHUNKS))

    def encode_many(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = []
        waiting: list[list[str]] = []
        places: list[tuple[list[bytes], int]] = []
        size = 0

        def more() -> None:
            for (own, place), packed in zip(places, self._coded(waiting)):
                own[place] = packed
            waiting.clear()
            places.clear()

        for text in texts:
            out.append([])
            for part in self._parts(text):
                if isinstance(part, bytes):
                    out[-1].append(part)
                    continue
                places.append((out[-1], len(out[-1])))
                out[-1].append(b"")
                waiting.append(part)
                size += len(part)
                if size >= CHUNKS:
                    more()
                    size = 0
        if waiting:
            more()
        return [own[0] if len(own) == 1 else b"".join(own) for own in out]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_many([text])[0]

    def decode(self, packed: bytes) -> str:
        """The tokens' strings; the file has no decoder, so they are joined by spaces."""
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(packed, "<u4").tolist()])


def read_vocabulary(path: str) -> PrefixCoder:
    with open(path, encoding="utf-8") as file:
        return PrefixCoder(file.read())


def encode(docs: DataFrame, coder: PrefixCoder, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the packed ids of every whole text (binary, 4 bytes an id)."""
    sent = docs.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for texts in batches:
            yield pd.Series(own.encode_many(texts), dtype=object)

    return docs.withColumn(out, F.pandas_udf(run, "binary").asNondeterministic()(F.col(text)))


def decode(docs: DataFrame, coder: PrefixCoder, ids: str = "ids", out: str = "decoded") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for packed in batches:
            yield pd.Series([own.decode(p) if p else "" for p in packed], dtype=object)

    return docs.withColumn(out, F.pandas_udf(run, "string").asNondeterministic()(F.col(ids)))


def round_trip(docs: DataFrame, coder: PrefixCoder) -> DataFrame:
    """doc_id, ids and decoded of every row, in one pass that holds results of about TOGETHER characters of text at a time."""
    sent = docs.sparkSession.sparkContext.broadcast(coder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for pdf in batches:
            at = 0
            while at < len(pdf):
                texts, size = [], 0
                while at + len(texts) < len(pdf) and size < TOGETHER:
                    texts.append(pdf["text"].iat[at + len(texts)])
                    size += len(texts[-1] or "")
                ids = own.encode_many(texts)
                decoded = [own.decode(p) for p in ids]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at : at + len(ids)].astype("Int64").array, "ids": ids, "decoded": decoded})
                at += len(ids)

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids binary, decoded string")


def digests(docs: DataFrame, coder: PrefixCoder) -> DataFrame:
    coded = round_trip(docs, coder)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), read_vocabulary(default_path()))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(docs, read_vocabulary(default_path()))


QUERIES = {"op9_bpe_prefix": op9_bpe_prefix}
ORACLES: dict[str, str] = {}
