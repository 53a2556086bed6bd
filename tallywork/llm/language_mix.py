"""Language ID by mixture inference.

A word's likelihood in a language is that of its letter trigrams, counted in hashed buckets
over all labelled documents. Expectation-maximisation estimates each document's proportions of
languages from its words. The language set is the one of the best penalised likelihood among
the sets of the k largest proportions; the search stops at one language where no larger set
can win, as the likelihood of all languages bounds that of any set.

Proportions compare the learned languages with each other only. Whether a text is of any of them
is told by its fit, the mean log-likelihood of its trigrams in its language: ``typical_fits``
learns over all labelled documents how low that may be.

Defined results: a null text, or one without letters, is ``und`` with score 0 and no
proportions; so is every text if no document is labelled. Ties go to the language that sorts
first. Rows are judged one by one, so repeated rows repeat. An empty text is never learned
from; nor is a null label.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.common import Batches, free_name, slices

UNKNOWN = "und"
BUCKET_BITS = 16
#: The table of log-likelihoods is gathered and broadcast; it may not hold more than this.
MODEL_BYTES = 256 << 20
#: A fit is too low at twice the distance from the mean that this share of labelled documents exceeds; shorter texts have more room.
UNTYPICAL, ROOM, LEAST_TRIGRAMS = 1e-3, 4.0, 50
ITERATIONS, SETTLED = 40, 1e-3

LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case; other ASCII becomes a space, bytes beyond it stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

MIX = T.StructType([
    T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("proportions", T.MapType(T.StringType(), T.DoubleType())), T.StructField("fit", T.DoubleType()), T.StructField("trigrams", T.LongType()),
])
MIX_ARROW = pa.struct([("language", pa.string()), ("score", pa.float64()), ("proportions", pa.map_(pa.string(), pa.float64())), ("fit", pa.float64()), ("trigrams", pa.int64())])


def has_letter(text: str) -> bool:
    """Whether a character is of the letter categories; numbers in other forms, which the pattern takes too, are not."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def letters(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(LETTERS)


def trigrams(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each trigram around a letter, and the places of those letters.

    ``joined`` begins and ends with a space, so each letter has neighbours.
    """
    a = np.frombuffer(joined, np.uint8)
    middle = np.flatnonzero(a[1:-1] != 32) + 1
    code = (a[middle - 1].astype(np.uint32) << 16) | (a[middle].astype(np.uint32) << 8) | a[middle + 1]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS), middle


def trigram_counts(documents: DataFrame, text: str, language: str, piece_bytes: int = 4 << 20) -> DataFrame:
    """How often each bucket occurs per language (language, bucket, n), over all labelled rows."""

    def count(batches: Batches) -> Batches:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in slices(batch, "text", piece_bytes):
                by_language: dict[str, list[bytes]] = {}
                for label, value in zip(piece.column("language").to_pylist(), piece.column("text").to_pylist()):
                    by_language.setdefault(label, []).append(letters(value))
                for label, parts in by_language.items():
                    buckets, _ = trigrams(b" " + b" ".join(parts) + b" ")
                    counted = np.bincount(buckets, minlength=1 << BUCKET_BITS)
                    totals[label] = totals[label] + counted if label in totals else counted
        for label, counted in totals.items():
            seen = np.flatnonzero(counted)
            yield pa.RecordBatch.from_pydict({
                "language": pa.array([label] * len(seen), pa.string()), "bucket": pa.array(seen, pa.int32()), "n": pa.array(counted[seen], pa.int64()),
            })

    labelled = documents.select(F.col(f"`{language}`").alias("language"), F.col(f"`{text}`").alias("text"))
    labelled = labelled.where("language IS NOT NULL AND text IS NOT NULL AND text != ''")
    return labelled.mapInArrow(count, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))


def learn(labelled: DataFrame, text: str = "text", language: str = "lang", model_bytes: int = MODEL_BYTES) -> tuple[list[str], np.ndarray]:
    """The languages in order, and the log-likelihood of each bucket (row) in each (column)."""
    counts = trigram_counts(labelled, text, language)
    names = sorted(r[0] for r in labelled.where(F.col(f"`{language}`").isNotNull()).select(F.col(f"`{language}`").alias("l")).distinct().limit(model_bytes >> BUCKET_BITS).collect())
    if len(names) * (4 << BUCKET_BITS) > model_bytes:
        raise ValueError(f"{len(names)} languages or more exceed the {model_bytes} bytes a model may hold")

    def column(cells: pa.Table) -> pa.Table:
        """The log-likelihoods of a language, of at most one cell per bucket."""
        n = np.zeros(1 << BUCKET_BITS)
        n[cells.column("bucket").to_numpy()] = cells.column("n").to_numpy()
        logs = np.log((n + 0.5) / (n.sum() + 0.5 * (1 << BUCKET_BITS))).astype(np.float32)
        return pa.table({"language": cells.column("language")[:1], "logs": pa.array([logs.tobytes()], pa.binary())})

    table = np.zeros((1 << BUCKET_BITS, len(names)), np.float32)
    table[:] = np.log(0.5 / (0.5 * (1 << BUCKET_BITS)))
    for row in counts.groupBy("language").applyInArrow(column, "language string, logs binary").toLocalIterator():
        table[:, names.index(row["language"])] = np.frombuffer(row["logs"], np.float32)
    return names, table


def expectation_maximisation(likelihood: np.ndarray, starts: np.ndarray, owner: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood (but for a constant) per document, from proportions to begin with.

    ``likelihood`` has a row per word, the largest of each row 1; ``starts`` is the first word
    of each document and ``owner`` the document of each word. A proportion of 0 stays 0.
    """
    sizes = np.bincount(owner, minlength=len(starts))[:, None]
    for _ in range(ITERATIONS):
        joint = likelihood * share[owner]
        joint /= joint.sum(axis=1, keepdims=True)
        new = np.add.reduceat(joint, starts, axis=0) / sizes
        moved = np.abs(new - share).max()
        share = new
        if moved < SETTLED:
            break
    fit = np.add.reduceat(np.log(np.einsum("wl,wl->w", likelihood, share[owner])), starts)
    return share, fit


def _infer_together(parts: list[bytes], table: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: proportions of the chosen language set, mean log-likelihood of a trigram in each language, trigrams.

    Every text has a letter byte.
    """
    sizes = np.array([len(p) + 1 for p in parts])
    text_starts = np.concatenate(([1], 1 + np.cumsum(sizes)[:-1]))
    buckets, middle = trigrams(b" " + b" ".join(parts) + b" ")
    first = np.concatenate(([True], np.diff(middle) > 1))
    word_starts = np.flatnonzero(first)
    words = np.add.reduceat(table[buckets], word_starts, axis=0)
    owner = np.searchsorted(text_starts, middle[word_starts], side="right") - 1
    starts = np.flatnonzero(np.concatenate(([True], np.diff(owner) > 0)))
    n_trigrams = np.bincount(np.searchsorted(text_starts, middle, side="right") - 1, minlength=len(parts))
    fits = np.add.reduceat(words, starts, axis=0, dtype=np.float64) / n_trigrams[:, None]
    top = words.max(axis=1, keepdims=True)
    likelihood = np.maximum(np.exp(words - top), 1e-30)

    languages = table.shape[1]
    single = np.add.reduceat(words - top, starts, axis=0)
    best = single.argmax(axis=1)
    chosen = np.zeros((len(parts), languages), np.float32)
    chosen[np.arange(len(parts)), best] = 1
    if languages == 1:
        return chosen, fits, n_trigrams
    every = np.full((len(parts), languages), 1 / languages, np.float32)
    full, full_fit = expectation_maximisation(likelihood, starts, owner, every)
    cost = penalty * np.log(np.maximum(2, np.bincount(owner, minlength=len(parts))))
    score = single.max(axis=1)  # of the set chosen so far; k languages cost k - 1 times
    open_ = np.flatnonzero(full_fit - cost > score)
    order = np.argsort(-full, axis=1, kind="stable")
    for k in range(2, languages + 1):
        open_ = open_[full_fit[open_] - (k - 1) * cost[open_] > score[open_]]
        if not len(open_):
            break
        inside = np.zeros((len(open_), languages), bool)
        np.put_along_axis(inside, order[open_, :k], True, axis=1)
        begin = np.where(inside, np.maximum(full[open_], 1e-6), 0)
        position = np.full(len(parts), -1)
        position[open_] = np.arange(len(open_))
        mine = np.flatnonzero(position[owner] >= 0)
        mine_owner = position[owner[mine]]
        share, fit = expectation_maximisation(
            likelihood[mine], np.flatnonzero(np.concatenate(([True], np.diff(mine_owner) > 0))), mine_owner,
            (begin / begin.sum(axis=1, keepdims=True)).astype(np.float32),
        )
        better = fit - (k - 1) * cost[open_] > score[open_]
        chosen[open_[better]] = share[better]
        score[open_[better]] = (fit - (k - 1) * cost[open_])[better]
    return chosen, fits, n_trigrams


def mixtures(texts: list[str | None], names: list[str], table: np.ndarray, penalty: float) -> list[dict]:
    """Language, score, proportions and fit of each text."""
    out: list[dict] = [{"language": UNKNOWN, "score": 0.0, "proportions": [], "fit": None, "trigrams": 0} for _ in texts]
    at = [i for i, t in enumerate(texts) if names and t and has_letter(t)]
    if not at:
        return out
    for i, share, fit, n in zip(at, *_infer_together([letters(texts[i]) for i in at], table, penalty)):
        best = int(share.argmax())
        out[i] = {
            "language": names[best], "score": min(1.0, float(share[best])),
            "proportions": [(names[j], float(share[j])) for j in np.flatnonzero(share > 0)], "fit": float(fit[best]), "trigrams": int(n),
        }
    return out


def _with_mix(documents: DataFrame, model: tuple[list[str], np.ndarray], text: str, name: str, penalty: float) -> DataFrame:
    names, table = model
    state = documents.sparkSession.sparkContext.broadcast((names, table))
    piece = max(64 << 10, (4 << 20) // max(1, len(names)))

    def run(batches: Batches) -> Batches:
        names, table = state.value
        for batch in batches:
            for part in slices(batch, text, piece):
                column = pa.array(mixtures(part.column(text).to_pylist(), names, table, penalty), MIX_ARROW)
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, name])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(name, MIX)]))


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text", penalty: float = 2.0) -> DataFrame:
    """Per document: its key, ``language`` (of the largest proportion), ``score`` (that proportion), ``proportions``.

    ``penalty`` times the logarithm of the number of words is the cost of one more language.
    """
    chosen = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    mixed = _with_mix(chosen, model, "text", "mix", penalty)
    return mixed.select(F.col("key").alias(key), *(F.col("mix")[c].alias(c) for c in MIX.names))


def typical_fits(
    labelled: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", language: str = "lang", untypical: float = UNTYPICAL, least_trigrams: int = LEAST_TRIGRAMS,
) -> dict[str, tuple[float, float]]:
    """Of each learned language: the least fit of a long text, and the spread of a single trigram.

    Learned over all labelled documents of ``least_trigrams`` or more: one row per language comes back.
    """
    names, table = model
    state = labelled.sparkSession.sparkContext.broadcast((names, table))

    def measure(batches: Batches) -> Batches:
        names, table = state.value
        for batch in batches:
            rows = []
            for label, value in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist()):
                if label in names and value:
                    logs = table[trigrams(b" " + letters(value) + b" ")[0], names.index(label)]
                    if len(logs) >= least_trigrams:
                        rows.append((label, float(logs.mean(dtype=np.float64)), float(logs.var(dtype=np.float64)), len(logs)))
            columns = zip(*rows) if rows else ((), (), (), ())
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["language", "fit", "spread", "n"])

    chosen = labelled.select(F.col(f"`{language}`").alias("language"), F.col(f"`{text}`").alias("text")).where("language IS NOT NULL AND text IS NOT NULL")
    measured = chosen.mapInArrow(measure, "language string, fit double, spread double, n long")
    rows = measured.groupBy("language").agg(
        (F.sum(F.col("fit") * F.col("n")) / F.sum("n")).alias("mean"), (F.sum(F.col("spread") * F.col("n")) / F.sum("n")).alias("variance"),
        F.percentile_approx("fit", untypical, 10_000).alias("low"),
    ).collect()
    return {r["language"]: (2 * r["low"] - r["mean"], float(np.sqrt(r["variance"]))) for r in rows}


def accepted(
    documents: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", least_score: float = 0.5, penalty: float = 2.0,
    fits: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """The rows of ``documents`` in which one language has at least ``least_score`` of the words.

    Given ``typical_fits``, rows that fit their language worse go too; a language without any
    is not judged.
    """
    name = free_name("mix", documents.columns)
    mixed = _with_mix(documents, model, text, name, penalty)
    mix = F.col(name)
    typical = F.lit(True)
    for language, (low, spread) in (fits or {}).items():
        far = mix["fit"] < F.lit(low) - ROOM * spread / F.sqrt(mix["trigrams"])
        typical &= ~F.coalesce((mix["language"] == language) & far, F.lit(False))
    kept = mixed.where((mix["language"] != UNKNOWN) & (mix["score"] >= least_score) & typical)
    return kept.select(*(F.col(f"`{c}`") for c in documents.columns))


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is of the fold kept from learning; a null key is not."""
    return F.coalesce(F.crc32(F.encode(F.col(f"`{key}`").cast("string"), "utf-8")) % folds == fold, F.lit(False))
