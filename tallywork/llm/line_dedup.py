"""Substring dedup: equal paragraphs, lines or sentences of the whole corpus, the earliest kept.

A unit is a paragraph (between empty lines), a line, or a sentence of a line (up to a full stop
before a space), of any length. Units are compared after normalising: ASCII letters in lower
case, each run of ASCII white space one space, none at the ends, no full stop at the end. Digests
of units are grouped globally, each level by itself; the occurrence of the least (id, start)
stays, all others are repeated. Repeated units that are neighbours make a run, and runs of
``least_run`` code points or more are removed, with the breaks within them: a passage goes whole,
with its short lines, and in any script, while a phrase or a short line that happens to be in
other texts too stays. Offsets are code points of the text as it was. A passage's earliest
occurrence survives, as its units are the earliest there.

Digests are counted before they are shuffled. Those that make up more than one in ``SPREAD`` of
all units, which are fewer than ``SPREAD`` whatever the corpus, are dealt over ``SALTS`` keys, so
that a line that most documents share does not meet in one task; the others meet once each.

Defined results: a null or empty text has no units; rows of one id are one document for the
ranking, so equal units at the same place of both stay or go together, and rows without an id
are one document too, which ranks last; an empty table gives no rows. Other columns are not
read by ``repeated_units`` and kept by ``without``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.common import Batches, free_name
from tallywork.operators.stages import written

LEAST_RUN = 80
SALTS, SPREAD = 64, 10_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: What stands between two units of a level.
BREAKS = {"paragraph": re.compile(r"\n[ \t\r]*\n\s*"), "line": re.compile(r"\n"), "sentence": re.compile(r"\n|(?<=\.) ")}
LEVELS = ("line", "sentence")
FIELDS = ("digest", "start", "end", "next")
UNIT = pa.struct([(n, pa.int64() if n != "digest" else pa.binary()) for n in FIELDS])
SPANS = "array<struct<start:bigint,end:bigint,next:bigint>>"


def units(text: str, levels: tuple[str, ...]) -> list[tuple[bytes, int, int, int | None]]:
    """Digest, start and end of each unit that has words, and the start of the one of its level behind it."""
    out = []
    for level in levels:
        start, found = 0, []
        for end, following in [*(m.span() for m in BREAKS[level].finditer(text)), (len(text), 0)]:
            words = text[start:end].encode("utf-8", "surrogatepass").translate(LOWER).rstrip(b" \t\r\n\v\f.").split()
            if words:
                found.append((hashlib.blake2b(b" ".join(words), digest_size=16, person=level.encode()).digest(), start, end))
            start = following
        out += [(*u, v) for u, v in zip(found, [*(u[1] for u in found[1:]), None])]
    return out


def unit_table(documents: DataFrame, key: str, text: str, levels: tuple[str, ...]) -> DataFrame:
    """Per document: ``key`` and ``units`` (digest, start, end, next)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found = [[dict(zip(FIELDS, u)) for u in units(t.as_py() or "", levels)] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(UNIT))], ["key", "units"])

    chosen = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = chosen.schema["key"].dataType.simpleString()
    return chosen.mapInArrow(run, f"key {kind}, units array<struct<digest:binary,start:bigint,end:bigint,next:bigint>>")


def repeated_units(
    documents: DataFrame, key: str = "doc_id", text: str = "text", levels: tuple[str, ...] = LEVELS, least_run: int = LEAST_RUN,
) -> DataFrame:
    """Per document: its key, ``n_units`` and ``removed``, the spans (start, end) to remove, in order and apart."""
    table = written(unit_table(documents, key, text, levels), "units")
    place = F.struct(F.col("key").isNull().alias("unnamed"), F.col("key"), F.col("start"))
    each = table.select("key", F.explode("units").alias("u")).select("key", "u.*")
    counted = each.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first != last")
    first = written(counted.select("digest", "first", "n"), "first-units")
    total = table.agg(F.sum(F.size("units"))).first()[0] or 0
    # At most SPREAD digests can be so frequent, so their list has a bounded size.
    frequent = first.where(F.col("n") > total / SPREAD).select("digest", F.lit(SALTS).alias("salts"))
    salted = each.join(F.broadcast(frequent), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("key", "start"), F.col("salts")), F.lit(0)))
    dealt = first.withColumn("salt", F.explode(F.when(F.col("n") > total / SPREAD, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    gone = salted.join(dealt.select("digest", "first", F.col("salt").cast("long").alias("salt")), ["digest", "salt"]).where(~place.eqNullSafe(F.col("first")))
    # The spans of a document are bounded by its own length.
    spans = gone.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end", "next"))).alias("spans"))
    runs = F.filter(united("spans"), lambda s: s["end"] - s["start"] >= least_run)
    spans = spans.select("key", F.transform(runs, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("removed"))
    counts = table.select("key", F.size("units").cast("long").alias("n_units")).alias("c")
    joined = counts.join(spans.alias("s"), F.col("c.key").eqNullSafe(F.col("s.key")), "left")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return joined.select(F.col("c.key").alias(key), "n_units", F.coalesce("removed", none).alias("removed"))


def united(spans: str) -> Column:
    """Sorted spans, those that overlap or are neighbours made one."""

    def joined(last: Column, s: Column) -> Column:
        further = s["end"] > last["end"]
        return F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.when(further, s["next"]).otherwise(last["next"]).alias("next"),
        )

    def add(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        meets = (F.size(done) > 0) & ((last["end"] > s["start"]) | F.coalesce(last["next"] == s["start"], F.lit(False)))
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined(last, s)))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, F.expr(f"cast(array() as {SPANS})"), add)


def without(documents: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with the spans of ``repeated_units`` cut out, each with the break behind it."""
    name, other = free_name("removed", documents.columns), free_name("removed_key", documents.columns)
    cut = spans.select(F.col(f"`{key}`").alias(other), F.col("removed").alias(name)).where(F.size(name) > 0).distinct()
    joined = documents.join(cut, documents[f"`{key}`"].eqNullSafe(cut[other]), "left")
    whole = F.col(f"`{text}`")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(name, lambda s: s["end"] + 1))
    ends = F.concat(F.transform(name, lambda s: s["start"]), F.array(F.char_length(whole).cast("long")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(whole, p["a"] + 1, F.greatest(p["b"] - p["a"], F.lit(0))))
    changed = F.when(F.col(name).isNotNull(), F.array_join(pieces, "")).otherwise(whole)
    return joined.select(*(changed.alias(c) if c == text else F.col(f"`{c}`") for c in documents.columns))
