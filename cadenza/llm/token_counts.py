"""Token counts by a map-side two-tier lookup.

The subword model never merges across a space, so a text's token count is the sum of the
lengths of its space-separated pre-tokens.  Tier one is a compact table of the corpus's frequent
pre-tokens, broadcast; tier two is a bounded cache in each worker for the rest.  Pre-tokens are never
shuffled: the first pass sends a bounded summary of each task to an accumulator, which the driver merges as tasks end.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import small_batches

MODEL = "piece_bpe_32k.model"
#: Entries of the broadcast table; pre-tokens longer than MAX_KEY characters never enter it, so its size has a fixed bound.
FREQUENT, MAX_KEY = 16_384, 48
#: Entries that a task sends to the driver from the first pass, and those that a task or the driver holds while counting.
PER_TASK, HELD = 2_048, 200_000
#: Entries of a worker's cache of misses.
CACHE = 250_000
_RUNS = re.compile(" *[^ ]+| +")
_models: dict[str, sentencepiece.SentencePieceProcessor] = {}
_misses: dict[str, dict[str, int]] = {}


def _model(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _models:
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def pretoken_length(model: sentencepiece.SentencePieceProcessor, key: str) -> int:
    """Tokens of one pre-token: ``key`` is what follows the first of its leading spaces."""
    return len(model.encode(key, num_threads=1)) if key else 1


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first leading space (the model adds one to the text)."""
    if "▁" in text:  # the model's own mark for a space
        text = text.replace("▁", " ")
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [run[1:] for run in _RUNS.findall(" " + text)]
    return text.split(" ")


class Frequent(AccumulatorParam):
    """Merges the tasks' counts of pre-tokens; it holds HELD of them, and of more than that the frequent quarter."""

    def zero(self, value: Counter) -> Counter:
        return Counter()

    def addInPlace(self, value1: Counter, value2: Counter) -> Counter:
        value1.update(value2)
        return trimmed(value1)


def trimmed(counts: Counter) -> Counter:
    """Rare ones leave; the table only decides which lookups are fast."""
    return Counter(dict(counts.most_common(HELD // 4))) if len(counts) > HELD else counts


def frequent_lengths(docs: DataFrame, text_col: str = "text", model_path: str | None = None, entries: int = FREQUENT) -> dict[str, int]:
    """Token lengths of the corpus's frequent pre-tokens: at most ``entries`` of at most MAX_KEY characters."""
    model = _model(model_path or public_tokenizers.path(MODEL))
    merged = docs.sparkSession.sparkContext.accumulator(Counter(), Frequent())

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in small_batches(batches):
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(pretokens(text))
            seen = trimmed(seen)
        merged.add(Counter({k: n for k, n in seen.most_common(PER_TASK) if len(k) <= MAX_KEY}))
        yield pa.RecordBatch.from_arrays([pa.array([len(seen)], pa.int64())], ["n"])

    docs.select(F.col(text_col).alias("text")).mapInArrow(summarise, "n long").agg(F.max("n")).collect()
    top = sorted(merged.value.items(), key=lambda x: (-x[1], x[0]))[:entries]
    return {k: pretoken_length(model, k) for k, _ in top}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = 4096, entries: int = FREQUENT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    A null text counts as empty: 0 bytes, 0 tokens.  Other columns of ``docs`` are not read; a null
    id stays null and repeated rows each give their row.  ``model_path`` must be readable on every executor.
    """
    path = model_path or public_tokenizers.path(MODEL)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text_col, path, entries))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, misses, model = table.value, _misses.setdefault(path, {}), _model(path)
        for batch in small_batches(batches):
            n_bytes, n_tokens = [], []
            for text in batch.column(1).to_pylist():
                if not text:
                    n_bytes.append(0)
                    n_tokens.append(0)
                    continue
                keys = pretokens(text)
                found = list(map(first.get, keys))
                total = 0
                if None in found:
                    rest = [k for k, n in zip(keys, found) if n is None]
                    total = sum(n for n in found if n is not None)
                    lengths = list(map(misses.get, rest))
                    if None in lengths:
                        if len(misses) > CACHE:
                            misses.clear()
                        for i, n in enumerate(lengths):
                            if n is None:
                                k = rest[i]
                                n = misses.get(k)
                                if n is None:
                                    n = misses[k] = pretoken_length(model, k)
                                lengths[i] = n
                    total += sum(lengths)
                else:
                    total = sum(found)
                n_bytes.append(len(text.encode()))
                n_tokens.append(total)
            n = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), n, pa.array([v > limit for v in n_tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
