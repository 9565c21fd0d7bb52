"""BPE encoding and decoding with forced-boundary splitting.

For vocabularies with word ends: NFC, white space as separator, lower case, a pre-token pattern, bytes
as characters, merges inside a pre-token. Two adjacent byte characters that occur inside no vocabulary
token can never be merged across, so a pre-token is cut between them; the fragments are encoded one by
one and their ids concatenated. Fragments, like white-space-free chunks, recur, so each worker keeps
both, and the pre-tokens, in bounded caches.

Nulls: a null text is encoded as the empty text, which has no ids and decodes to the empty text. Texts
are encoded whole, whatever their length. Rows, repeated ones too, are encoded one by one; an empty table gives an empty
result; extra columns are ignored. Tokenizers of another kind are an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dialogmill.llm.common import prepare_python, table

TOKENIZER = "word_bpe_49k.json"
#: Entries of a cache before its older half goes.
CACHE = 600_000
#: Unicode white space, as the tokenizer's patterns have it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def tokenizer_path(name: str) -> str:
    import os

    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


# fixed value: the pre-tokens of the vocabularies with word ends that are handled here
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def drops_white_space(spec: dict) -> bool:
    """Whether a tokenizer is of the kind that WordBpe does: byte-level merges within pre-tokens that hold no white space, with word ends."""
    model, pre, normal = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    split = pre.get("pretokenizers") or [{}]
    return (
        model.get("type") == "BPE" and bool(model.get("end_of_word_suffix")) and not model.get("continuing_subword_prefix") and not model.get("dropout") and not model.get("unk_token")
        and [x.get("type") for x in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": WORD_PATTERN} and split[0]["behavior"] == "Removed" and split[0]["invert"] and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
        and [x.get("type") for x in normal.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"])
    )


class Recent(dict):
    """A cache of make(key) in two generations of at most half of ``size`` each."""

    def __init__(self, make, size: int = CACHE):
        super().__init__()
        self.make, self.half, self.older = make, max(1, size // 2), {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not drops_white_space(spec):
            raise ValueError(f"{path} is no tokenizer with word ends that drops white space")
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in (*self.vocab.items(), *self.special.items()):
            self.tokens[i] = t
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pre = regex.compile(split.replace(r"\s", SPACE))
        self.ascii = re.compile(split.replace(r"\s", SPACE).replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
        self.library = Tokenizer.from_file(path)  # normalises and splits what isn't Latin, as its Unicode version has it
        self.byte = byte_characters()
        self.together = {pair for t in self.vocab for pair in self._pairs(t)}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.blanks = re.compile(f"[{SPACE}]+")
        self.odd = re.compile("[\x1c-\x1f]")  # blank to str.split, not to the tokenizer
        self.fragments, self.words, self.chunks = Recent(self.merge), Recent(self.encode_word), Recent(self.encode_chunk)

    def symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.end]

    def _pairs(self, token: str) -> Iterator[tuple[str, str]]:
        own = self.symbols(token[: -len(self.end)]) if token.endswith(self.end) and token != self.end else list(token)
        return zip(own, own[1:])

    def cut(self, symbols: list[str]) -> list[tuple[str, ...]]:
        """Fragments between forced boundaries."""
        if self.together.issuperset(zip(symbols, symbols[1:])):
            return [tuple(symbols)]
        at = [0, *[i + 1 for i, pair in enumerate(zip(symbols, symbols[1:])) if pair not in self.together], len(symbols)]
        return [tuple(symbols[a:b]) for a, b in zip(at, at[1:])]

    def merge(self, symbols: tuple[str, ...]) -> tuple[int, ...]:
        """Ids of one fragment: the lowest rank first, leftmost among equals."""
        if len(symbols) > 40:
            return self._merge_long(symbols)
        own, rank, none = list(symbols), self.ranks.get, 1 << 60
        ranks = [rank(pair, none) for pair in zip(own, own[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            own[i] += own.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((own[i - 1], own[i]), none)
            if i < len(ranks):
                ranks[i] = rank((own[i], own[i + 1]), none)
        return tuple([self.vocab[s] for s in own if s in self.vocab])

    def _merge_long(self, symbols: tuple[str, ...]) -> tuple[int, ...]:
        """The same with a heap and a linked list, n log n for long fragments."""
        own: list[str | None] = list(symbols)
        after, before = list(range(1, len(own) + 1)), list(range(-1, len(own) - 1))
        heap = [(r, i, own[i], own[i + 1]) for i in range(len(own) - 1) if (r := self.ranks.get((own[i], own[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if own[i] != a or j >= len(own) or own[j] != b:
                continue
            own[i], own[j] = a + b, None
            after[i] = after[j]
            if after[i] < len(own):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(own) and (r := self.ranks.get((own[x], own[y]))) is not None:
                    heapq.heappush(heap, (r, x, own[x], own[y]))
        return tuple(self.vocab[s] for s in own if s is not None and s in self.vocab)

    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens, as byte characters, of a text without white space."""
        low = chunk.lower()
        if low.isascii():
            if low.isalpha():
                return [low]
            if low.isprintable():
                return self.ascii.findall(low)
        elif max(low) < "\u0250" and "\u0130" not in chunk:  # here Unicode's versions agree and lower() goes letter by letter
            low = unicodedata.normalize("NFC", chunk).lower()
            return [x if x.isascii() and x.isprintable() else "".join(map(self.byte.__getitem__, x.encode("utf-8"))) for x in self.pre.findall(low)]
        return [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def encode_word(self, word: str) -> tuple[int, ...]:
        fragments = self.cut(self.symbols(word))
        if len(fragments) == 1:
            return self.merge(fragments[0])
        return tuple(chain.from_iterable(map(self.fragments.__getitem__, fragments)))

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of a text without white space."""
        pieces = self.pieces(chunk)
        return self.words[pieces[0]] if len(pieces) == 1 else tuple(chain.from_iterable(map(self.words.__getitem__, pieces)))

    def _split(self, text: str) -> list[str]:
        return [x for x in self.blanks.split(text) if x] if self.odd.search(text) else text.split()

    def encode(self, text: str) -> list[int]:
        if "<" not in text or self.at_special is None or not self.at_special.search(text):
            return list(chain.from_iterable(map(self.chunks.__getitem__, self._split(text))))
        out: list[int] = []
        for i, part in enumerate(self.at_special.split(text)):
            out += [self.special[part]] if i % 2 else chain.from_iterable(map(self.chunks.__getitem__, self._split(part)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The library's decoding without a decoder: tokens, special ones too, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """One for each worker, with its caches."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, ids, decoded for every row of ``docs`` (doc_id, text)."""
    prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path(tokenizer))
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, the digests of encode()'s results and, if asked, the ids; the digests are made where the ids are."""
    prepare_python(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path(tokenizer))
        for batch in (b.slice(at, 100) for b in batches for at in range(0, b.num_rows, 100)):
            n, a, b, c = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                packed = np.array(ids, "<u4")
                n.append(len(ids))
                a.append(hashlib.sha256(packed.tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                if with_ids:
                    c.append(packed.view("<i4"))
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(c, pa.list_(pa.int32()))} if with_ids else {}))

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else ""))


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
