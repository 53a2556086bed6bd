"""Benchmark decontamination: an FM-index per shard of documents, searched for test phrases.

A phrase is a run of ``window`` consecutive words of a benchmark item; an item of fewer words
is one phrase. Each task cuts its documents into shards of bounded size, indexes a shard and
searches all phrases backwards at once. The index's alphabet is the benchmark's vocabulary:
any other word is a separator, and so is a run of known words shorter than the shortest
phrase, since no phrase can lie in either. Nothing is shuffled.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has
no phrases; rows of one item id count as one item; items without an id are listed as an empty
id; repeated documents give repeated rows; an empty benchmark finds nothing. Columns beside the
named ones are never read by ``contamination`` and kept as they are by ``decontaminated``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.common import Batches, free_name, slices
from tallywork.llm.fm_index import FmIndex
from tallywork.operators.stages import written

#: Words are runs of ASCII digits, letters and any other characters beyond ASCII, in lower case.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Occurrences located together.
ROWS_AT_ONCE = 1 << 20

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])
FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Phrases:
    """The phrases of some benchmark items, as numbers; 0 stands for any word they lack."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            found = words(text)
            for start in range(max(1, len(found) - window + 1) if found else 0):
                owners[tuple(found[start : start + window])].add(item)
        self.numbers: dict[bytes, int] = {}
        for phrase in owners:
            for word in phrase:
                self.numbers.setdefault(word, len(self.numbers) + 1)
        self.alphabet = len(self.numbers) + 1
        self.owners = [sorted(x) for x in owners.values()]
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.matrix = np.zeros((len(owners), window), np.int64)
        for row, phrase in zip(self.matrix, owners):
            row[window - len(phrase) :] = [self.numbers[w] for w in phrase]

    @classmethod
    def of(cls, state: dict) -> Phrases:
        """The phrases with these attributes, which travel as plain data."""
        phrases = cls.__new__(cls)
        phrases.__dict__.update(state)
        return phrases

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text of a shard: its words, the word ranges hit, the items that hit."""
        counts, numbers = [], [np.zeros(1, np.int64)]
        for text in texts:
            found = words(text)
            counts.append(len(found))
            numbers.append(np.fromiter(map(self.numbers.get, found, repeat(0)), np.int64, len(found)))
            numbers.append(np.zeros(1, np.int64))
        out: list[tuple[int, list, list]] = [(n, [], []) for n in counts]
        if not self.owners:
            return out
        sequence = np.concatenate(numbers)
        known = np.diff((sequence > 0).astype(np.int8))
        starts, ends = np.flatnonzero(known == 1) + 1, np.flatnonzero(known == -1) + 1
        long = ends - starts >= self.lengths.min()
        starts, sizes = starts[long], (ends - starts)[long] + 1  # with the separator behind
        if not len(starts):
            return out
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        place = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
        index = FmIndex(sequence[place], self.alphabet)
        low, high = index.search(self.matrix, self.lengths)
        first = np.concatenate(([0], np.cumsum(np.array(counts) + 1))) + 1  # the place of each text's first word
        cover = np.zeros(index.size + 1, np.int64)
        owned: dict[int, set[str]] = defaultdict(set)
        for phrase, row in intervals(low, high, ROWS_AT_ONCE):
            at = index.locate(row)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + self.lengths[phrase], -1)
            document = np.searchsorted(first, place[at], side="right") - 1
            for d, p in zip(*np.divmod(np.unique(document * len(self.owners) + phrase), len(self.owners))):
                owned[int(d)].update(self.owners[p])
        hit = place[np.flatnonzero(np.cumsum(cover)[:-1] > 0)]
        breaks = np.flatnonzero(np.diff(hit) > 1) + 1
        for run in np.split(hit, breaks) if len(hit) else []:
            d = int(np.searchsorted(first, run[0], side="right")) - 1
            out[d][1].append((int(run[0] - first[d]), int(run[-1] - first[d]) + 1))
        for d, items in owned.items():
            out[d][2].extend(sorted(items))
        return out


def intervals(low: np.ndarray, high: np.ndarray, most: int) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """All rows of the intervals, with the interval each is in, at most ``most`` at a time."""
    offsets = np.concatenate(([0], np.cumsum(np.maximum(high - low, 0))))
    for start in range(0, int(offsets[-1]), most):
        every = np.arange(start, min(start + most, offsets[-1]))
        interval = np.searchsorted(offsets, every, side="right") - 1
        yield interval, low[interval] + every - offsets[interval]


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges as a union: sorted, touching and overlapping ones made one."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(s, e) for s, e in out]


def character_spans(text: str | None, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as code-point ranges of the text."""
    if not hits:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[s][0], at[e - 1][1]) for s, e in hits]


def blocks(benchmark: DataFrame, item: str, text: str, most: int) -> Iterable[list[tuple[str, str | None]]]:
    """The benchmark in blocks of about ``most`` bytes, each fetched when it is needed."""
    chosen = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text}`").alias("t"))
    total = chosen.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-total // most))
    for b in range(count):
        yield [tuple(r) for r in chosen.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == b).collect()]


def _scanned(
    documents: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int,
    shard_bytes: int, block_bytes: int,
) -> tuple[DataFrame, str]:
    """``documents`` with one more column of what was found, and that column's name."""
    spark = documents.sparkSession
    result = free_name("found", documents.columns)
    schema = T.StructType([*documents.schema.fields, T.StructField(result, FOUND)])
    out, passes = documents, 0
    for rows in blocks(benchmark, item, item_text, block_bytes):
        phrases = spark.sparkContext.broadcast(vars(Phrases(rows, window)))

        def scan(batches: Batches, state=phrases, later=passes > 0) -> Batches:
            phrases = Phrases.of(state.value)
            for batch in batches:
                for piece in slices(batch, text, shard_bytes):
                    texts = piece.column(text).to_pylist()
                    before = piece.column(result).to_pylist() if later else [None] * len(texts)
                    found = []
                    for t, old, (n, hits, items) in zip(texts, before, phrases.scan(texts)):
                        if old:
                            hits = merged([*hits, *((h["start"], h["end"]) for h in old["hits"])])
                            items = sorted({*items, *old["items"]})
                        spans = character_spans(t, hits)
                        found.append((n, [{"start": s, "end": e} for s, e in hits], items, [{"start": s, "end": e} for s, e in spans]))
                    column = pa.array([dict(zip(("n_words", "hits", "items", "spans"), f)) for f in found], FOUND_ARROW)
                    kept = [c for c, name in zip(piece.columns, piece.schema.names) if name != result]
                    names = [name for name in piece.schema.names if name != result]
                    yield pa.RecordBatch.from_arrays([*kept, column], [*names, result])

        if passes:
            out = written(out, "decontaminate")
        out, passes = out.mapInArrow(scan, schema), passes + 1
    return out, result


def contamination(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = 10, shard_bytes: int = 24 << 20, block_bytes: int = 64 << 20,
) -> DataFrame:
    """Per document: its key, ``n_words``, ``hits`` (word ranges), ``items`` and ``spans`` (code points).

    ``block_bytes`` bounds the part of the benchmark that is broadcast at a time; a larger
    benchmark takes several passes over the documents.
    """
    chosen = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    found, name = _scanned(chosen, benchmark, "text", item, item_text, window, shard_bytes, block_bytes)
    return found.select(F.col("key").alias(key), *(F.col(name)[c].alias(c) for c in FOUND.names))


def decontaminated(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = 10, shard_bytes: int = 24 << 20, block_bytes: int = 64 << 20, drop_emptied: bool = False,
) -> DataFrame:
    """``documents`` with the hit spans cut out of their texts; a text of hits only becomes empty.

    Each span gives way to one line break. Cutting may bring words together that form a phrase
    again, so changed texts are scanned again until none is hit; each round is a table. With
    ``drop_emptied`` a row goes if it was hit and nothing but white space is left.
    """
    hit, done, rest = free_name("hit", documents.columns), [], documents
    while True:
        found, name = _scanned(rest, benchmark, text, item, item_text, window, shard_bytes, block_bytes)
        spans = F.col(name)["spans"]
        whole = F.col(f"`{text}`")
        starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
        ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(whole).cast("long")))
        left = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(whole, p["a"] + 1, p["b"] - p["a"])), "\n")
        changed = F.when(F.size(spans) > 0, left).otherwise(whole)
        columns = [changed.alias(c) if c == text else F.col(f"`{c}`") for c in documents.columns]
        cut = written(found.select(*columns, (F.size(spans) > 0).alias(hit)), "decontaminated")
        done.append(cut.where(~F.col(hit)).drop(hit))
        again = cut.where(F.col(hit)).drop(hit)
        rest = again.where(F.col(f"`{text}`").rlike(r"\S"))
        if not drop_emptied:
            done.append(again.where(~F.col(f"`{text}`").rlike(r"\S")))
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, done)
