"""Token counts by a two-tier lookup on the map side.

Tier one is a table of the lengths in tokens of frequent pre-tokens, made from a sample of about ``SAMPLE_DOCS`` documents, at most
``TABLE_ROWS`` entries, and broadcast. The sample is counted where its documents are and its counts are added up at the driver. Tier two, in each
worker, encodes what the table misses with the tokenizers library, all misses of a batch at once, and
keeps the lengths in a bounded cache. No pre-token is ever shuffled. The sample decides how often tier
one hits, never the counts.

Counts are the library's: special strings inside texts are special tokens, as its default has it;
none are added. The pre-tokens are white-space-free chunks for vocabularies with word ends whose tokenizer drops white space;
other .json tokenizers split by their own pre-tokenizer, and texts with special strings are encoded whole. In
sentencepiece models, and tokenizers without a pre-tokenizer, pieces may depend on the neighbouring chunk, so texts
are encoded whole, without the tables. Files of another kind are an error.

Nulls: a null text counts as the empty text: no bytes, no tokens. Texts are counted whole, whatever their length; a count of
exactly the limit isn't over it. Rows, repeated ones too, are counted one by one; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogmill.llm.bpe import SPACE, TOKENIZER, drops_white_space, tokenizer_path
from dialogmill.llm.common import prepare_python, table

TABLE_ROWS = 32_768
SAMPLE_DOCS = 2_000
CACHE = 300_000
LIMIT = 2048


class Counted:
    """Token counts by lookups of a text's pieces: the table, then the cache, then the library."""

    def __init__(self, path: str, frequent: dict[str, int], cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.frequent, self.cache, self.size = frequent, {}, cache

    def split(self, text: str) -> tuple[list[str], int]:
        """(pieces to look up, tokens besides)."""
        raise NotImplementedError

    def lengths(self, pieces: list[str]) -> list[int]:
        raise NotImplementedError

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.split(t) for t in texts]
        misses = {c for pieces, _ in split for c in pieces if c not in self.frequent and c not in self.cache}
        if len(self.cache) + len(misses) > self.size:
            self.cache = {}
            misses = {c for pieces, _ in split for c in pieces if c not in self.frequent}
        missed = list(misses)
        for at in range(0, len(missed), 10_000):
            part = missed[at : at + 10_000]
            self.cache.update(zip(part, self.lengths(part), strict=True))
        first, second = self.frequent.get, self.cache.__getitem__
        return [n + sum(second(c) if (own := first(c)) is None else own for c in pieces) for pieces, n in split]


class WordCounter(Counted):
    """For a tokenizer whose pre-tokens end at white space: pieces are chunks without white space."""

    blanks, odd = re.compile(f"[{SPACE}]+"), re.compile("[\x1c-\x1f]")

    def split(self, text: str) -> tuple[list[str], int]:
        n = 0
        if "<" in text and self.at_special and self.at_special.search(text):
            n = len(self.at_special.findall(text))
            text = self.at_special.sub(" ", text)
        return ([x for x in self.blanks.split(text) if x] if self.odd.search(text) else text.split()), n

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]


class PieceCounter(Counted):
    """For any tokenizer with a pre-tokenizer: pieces are what that makes of the text, and the model encodes each."""

    def split(self, text: str) -> tuple[list[str], int]:
        if self.at_special and self.at_special.search(text):
            return [], len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)], 0

    def lengths(self, pieces: list[str]) -> list[int]:
        return [len(self.tokenizer.model.tokenize(x)) for x in pieces]


class LibraryCounter:
    """For a tokenizer without a pre-tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


class WholeCounter:
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


def kind_of(path: str) -> type:
    """The counter for a file, by what it says about itself."""
    if path.endswith(".model"):
        return WholeCounter
    if not path.endswith(".json"):
        raise ValueError(f"{path} is neither a .json nor a .model file")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if drops_white_space(spec):
        return WordCounter
    return PieceCounter if spec.get("pre_tokenizer") else LibraryCounter


def frequent_lengths(docs: DataFrame, tokenizer: str, rows: int = TABLE_ROWS, sample_docs: int = SAMPLE_DOCS) -> dict[str, int]:
    """piece -> tokens of the most frequent pieces of about ``sample_docs`` documents.

    The share that is picked follows the number of documents, so that what comes to the driver doesn't grow with them.
    """
    share = min(1.0, sample_docs / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, seen = tokenizer_path(tokenizer), Counter()
        counter = None
        for batch in batches:
            for text in batch.column(0):
                counter = counter or kind_of(path)(path, {})
                seen.update(counter.split(text.as_py() or "")[0])
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["piece", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    seen: Counter = Counter()
    for r in sample.mapInArrow(run, "piece string, n long").toLocalIterator():
        seen[r["piece"]] += r["n"]
    top = [c for c, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:rows] if n > 1]
    path = tokenizer_path(tokenizer)
    return dict(zip(top, kind_of(path)(path, {}).lengths(top), strict=True)) if top else {}


_COUNTERS: dict = {}


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, table_rows: int = TABLE_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    prepare_python(spark)
    kind = kind_of(tokenizer_path(tokenizer))
    looked_up = issubclass(kind, Counted)
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer, table_rows) if looked_up else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        path = tokenizer_path(tokenizer)
        own = kind_of(path)
        counter = own(path, frequent.value) if looked_up else own(path)
        if looked_up:  # the cache outlives the task
            counter.cache = _COUNTERS.setdefault(path, counter.cache)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n_bytes, n = [len(t.encode("utf-8", "surrogatepass")) for t in texts], counter.counts(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        if looked_up:
            _COUNTERS[path] = counter.cache

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
