"""Secret scans: known shapes, and a battery of randomness tests over every long token.

A token is a run of at least ``MIN_TOKEN`` characters of the base-64 alphabets. Its encoding is
inferred from the characters it uses; then its symbols are tested for a uniform alphabet
(chi-squared over groups of symbols), for runs above and below the alphabet's middle, and for
correlation with their successors. The three together give one statistic (Fisher's), which is
large where chance is rejected: a token looks random if chance is not.

How ordinary tokens do in the battery is learned from the whole corpus: all words of every text, but
for those that may hold a secret, are run together and cut into tokens of usual lengths, and
the logarithms of their statistics have a mean and a spread per encoding and length. A token's
p-value is the chance that an ordinary one is as random; an encoding that ordinary tokens hardly
have takes what all of that length give. All tokens of the corpus form one family, those within
known shapes too, in which false discoveries are controlled with weights in proportion to length.
The family is summed up in a histogram of fixed size, so no step gathers more than small sums.

Defined results: a null text is empty and has no spans; repeated rows are judged alike and each
counts in the family; an empty table gives no rows. Other columns are not read by ``scan`` and
are kept by ``redacted``. Tokens within a known shape are no spans of their own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywork.llm.common import Batches, free_name
from tallywork.operators.stages import written

# The three known shapes.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_WORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "random")

MIN_TOKEN = 20
TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")
#: In a word that may itself be a secret; and what is left out where words are run together.
LONG = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN}}}")
NOT_TOKEN = re.sub(rb"[A-Za-z0-9]", b"", bytes(range(256)))

# Letters from the common to the rare ones, so that groups of neighbours are as common, and the tests tell prose from chance.
LOWER, UPPER, DIGITS = "etaoinsrhdlucmfywgpbvkxqjz", "ETAOINSRHDLUCMFYWGPBVKXQJZ", "0123456789"
#: Ordinary tokens have these lengths in turn (the text's length tells the first).
ORDINARY_SIZES = (20, 26, 34, 44, 64)
#: Characters of ordinary tokens that are tested at a time.
TESTED_AT_ONCE = 1 << 21
#: Ordinary tokens of an encoding and length that make a null of their own, and the least spread of logarithms.
LEAST_ORDINARY, LEAST_SPREAD = 30, 0.3
#: Statistics beyond this are as far from chance as any; they count as this, so that odd tokens do not widen the spread.
MOST_STATISTIC = 150.0
#: Name and symbols of each encoding, the narrow ones first.
ENCODINGS = (
    ("hex", "abcdef" + DIGITS), ("hex", "ABCDEF" + DIGITS), ("base32", UPPER + "234567"),
    ("alpha", LOWER), ("alpha", UPPER), ("base36", LOWER + DIGITS), ("base36", UPPER + DIGITS),
    ("alpha52", LOWER + UPPER), ("base62", LOWER + UPPER + DIGITS), ("base64", LOWER + UPPER + DIGITS + "+/"),
    ("base64url", LOWER + UPPER + DIGITS + "-_"), ("mixed", LOWER + UPPER + DIGITS + "+/-_="),
)
PLACES = {alphabet: {c: i for i, c in enumerate(alphabet)} for _, alphabet in ENCODINGS}
SYMBOLS = [(name, alphabet, frozenset(alphabet)) for name, alphabet in ENCODINGS]
#: The same by byte: each encoding's places, and a bit for each encoding that has the byte.
PLACE_OF = np.array([[alphabet.find(chr(c)) for c in range(128)] for _, alphabet in ENCODINGS], np.int16)
ENCODINGS_OF = sum((PLACE_OF[i] >= 0).astype(np.int32) << i for i in range(len(ENCODINGS)))

#: Below this, the battery says a token is not by chance.
NOT_BY_CHANCE = 1e-3
#: Share of false discoveries allowed.
FALSE_SHARE = 1e-2
#: Histogram of -log10(p / length): bins of this width, the last open.
BIN_WIDTH, BINS = 0.05, 2400

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("encoding", T.StringType()), T.StructField("statistic", T.DoubleType()), T.StructField("inside", T.BooleanType()),
]))
SPANS_ARROW = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("statistic", pa.float64()), ("inside", pa.bool_()),
]))
ORDINARY = T.ArrayType(T.StructType([
    T.StructField("encoding", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.DoubleType()), T.StructField("ss", T.DoubleType()),
]))
ORDINARY_ARROW = pa.list_(pa.struct([("encoding", pa.string()), ("size", pa.int32()), ("n", pa.int64()), ("s", pa.float64()), ("ss", pa.float64())]))


def above(z: float) -> float:
    """The chance that a standard normal value is above ``z``."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_above(x: float, freedom: int) -> float:
    """The chance that a chi-squared value is above ``x`` (cube-root approximation)."""
    spread = 2 / (9 * freedom)
    return above(((x / freedom) ** (1 / 3) - 1 + spread) / math.sqrt(spread))


def infer(token: str) -> tuple[str, str]:
    used = set(token)
    return next((name, alphabet) for name, alphabet, symbols in SYMBOLS if used <= symbols)


def battery(token: str) -> tuple[str, float] | None:
    """Encoding, and the statistic of the three tests together.

    None for tokens of digits only, which are numbers, and for those of one symbol.
    """
    token = token.rstrip("=")
    if len(token) < MIN_TOKEN or token.isdigit() or len(set(token)) < 2:
        return None
    name, alphabet = infer(token)
    places, size, n = PLACES[alphabet], len(alphabet), len(token)
    symbols = [places[c] for c in token]

    groups = max(2, min(size, n // 5))
    counts = [0] * groups
    room = [0] * groups
    for s in range(size):
        room[s * groups // size] += 1
    for s in symbols:
        counts[s * groups // size] += 1
    uniform = sum((c - n * r / size) ** 2 / (n * r / size) for c, r in zip(counts, room))
    p_uniform = chi_squared_above(uniform, groups - 1)

    high = [s * 2 >= size for s in symbols]
    ups = sum(high)
    downs = n - ups
    p_runs = 0.0
    if ups and downs:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 1 + 2 * ups * downs / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * above(abs(runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0

    middle = sum(symbols) / n
    off = [s - middle for s in symbols]
    serial = sum(a * b for a, b in zip(off, off[1:])) / sum(a * a for a in off)
    p_serial = 2 * above(abs(serial + 1 / n) * math.sqrt(n))

    together = -2 * sum(math.log(max(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
    return name, together


def logarithm(statistic: float) -> float:
    return math.log(min(max(statistic, 1e-3), MOST_STATISTIC))


def size_of(length: int) -> int:
    """The usual length that stands for this one: the longest that is no longer."""
    return max([x for x in ORDINARY_SIZES if x <= length], default=ORDINARY_SIZES[0])


def _each(function, values: np.ndarray) -> np.ndarray:
    return np.fromiter(map(function, values.tolist()), float, len(values))


def batteries(tokens: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """Encodings and the statistics of their tokens, as ``battery`` gives them; a row of bytes is a token of letters and digits."""
    n = tokens.shape[1]
    tokens = tokens[(tokens != tokens[:, :1]).any(axis=1) & (tokens > ord("9")).any(axis=1)]
    shared = np.bitwise_and.reduce(ENCODINGS_OF[tokens], axis=1)
    narrowest, out = shared & -shared, []
    for i, (name, alphabet) in enumerate(ENCODINGS):
        rows = tokens[narrowest == 1 << i]
        if not len(rows):
            continue
        symbols, size = PLACE_OF[i][rows], len(alphabet)

        groups = max(2, min(size, n // 5))
        group_of = np.arange(size) * groups // size
        cells = np.arange(len(rows))[:, None] * groups + group_of[symbols]
        counts = np.bincount(cells.ravel(), minlength=len(rows) * groups).reshape(-1, groups)
        expected = n * np.bincount(group_of, minlength=groups) / size
        p_uniform = _each(lambda x: chi_squared_above(x, groups - 1), ((counts - expected) ** 2 / expected).sum(axis=1))

        high = symbols * 2 >= size
        ups = high.sum(axis=1)
        runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
        mean = 1 + 2 * ups * (n - ups) / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _each(above, np.abs(runs - mean) / np.sqrt(np.where(spread > 0, spread, 1)))
        p_runs = np.where((ups == 0) | (ups == n), 0.0, np.where(spread > 0, p_runs, 1.0))

        off = symbols - symbols.mean(axis=1)[:, None]
        serial = np.einsum("ij,ij->i", off[:, :-1], off[:, 1:]) / np.einsum("ij,ij->i", off, off)
        p_serial = 2 * _each(above, np.abs(serial + 1 / n) * math.sqrt(n))

        out.append((name, -2 * sum(np.log(np.maximum(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))))
    return out


def run_together(text: str) -> bytes:
    """Letters and digits of all words, but for words that may hold a secret."""
    words = [w for w in text.split() if not ("=" in w or ":" in w or len(w) >= MIN_TOKEN and LONG.search(w))]
    return "".join(words).encode("ascii", "ignore").translate(None, NOT_TOKEN)


def cuts(length: int, turn: int) -> dict[int, list[np.ndarray]]:
    """Starts by length of the tokens that ``length`` characters are cut into.

    What is too short for the length in turn is a token of its own, or lengthens the last one if
    it is no token; every character counts unless all are too few for a token.
    """
    sizes = [ORDINARY_SIZES[(turn + i) % len(ORDINARY_SIZES)] for i in range(len(ORDINARY_SIZES))]
    rounds, rest = divmod(length, sum(sizes))
    starts = {size: [np.arange(rounds) * sum(sizes) + sum(sizes[:i])] for i, size in enumerate(sizes) if rounds}
    at, last = length - rest, (sizes[-1] if rounds else 0)
    for size in sizes:
        if length - at < size:
            break
        starts.setdefault(size, []).append(np.array([at]))
        at, last = at + size, size
    rest = length - at
    if rest >= MIN_TOKEN:
        starts.setdefault(rest, []).append(np.array([at]))
    elif rest and last:
        starts[last][-1] = starts[last][-1][:-1]
        starts.setdefault(last + rest, []).append(np.array([at - last]))
    return starts


def ordinary_sums(texts: Iterable[str]) -> list[tuple[str, int, int, float, float]]:
    """What the ordinary tokens of texts give: encoding, usual length, number, sum of logarithms and of their squares."""
    sums: dict[tuple[str, int], list[float]] = {}
    held: list[bytes] = []
    starts: dict[int, list[np.ndarray]] = {}
    filled = 0

    def test() -> None:
        joined = np.frombuffer(b"".join(held), np.uint8)
        for length, found in starts.items():
            every, step = np.concatenate(found), max(1, TESTED_AT_ONCE // length)
            for i in range(0, len(every), step):
                for name, statistics in batteries(joined[every[i : i + step, None] + np.arange(length)]):
                    values = np.log(np.clip(statistics, 1e-3, MOST_STATISTIC))
                    of = sums.setdefault((name, size_of(length)), [0, 0.0, 0.0])
                    of[:] = of[0] + len(values), of[1] + values.sum(), of[2] + (values * values).sum()

    for text in texts:
        joined = run_together(text)
        for length, found in cuts(len(joined), len(text) % len(ORDINARY_SIZES)).items():
            starts.setdefault(length, []).extend(x + filled for x in found)
        held.append(joined)
        filled += len(joined)
        if filled >= TESTED_AT_ONCE:
            test()
            held, starts, filled = [], {}, 0
    test()
    return [(*key, int(n), float(s), float(ss)) for key, (n, s, ss) in sums.items()]


def ordinary_tokens(text: str) -> list[tuple[str, int, int, float, float]]:
    return ordinary_sums([text])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the known shapes, leftmost and without overlap within a kind."""
    found = []
    small = text.lower()
    if any(w in small for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found


def spans_of(text: str) -> list[tuple[str, int, int, str | None, float | None, bool]]:
    """Base spans and all tokens with their statistic, and whether they lie within a base span."""
    found = base_spans(text)
    tokens = list(TOKEN.finditer(text))
    for m in tokens:  # a hexadecimal run lies within a token
        found += [("hex", m.start() + h.start(), m.start() + h.end()) for h in HEX.finditer(m[0])]
    out = [(*f, None, None, False) for f in found]
    for m in tokens:
        if tested := battery(m[0]):
            out.append(("random", *m.span(), *tested, any(s <= m.start() and m.end() <= e for _, s, e in found)))
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0])))


def _listed(rows, names: tuple[str, ...], kind: pa.DataType) -> pa.Array:
    return pa.array(([dict(zip(names, f)) for f in row] for row in rows), kind, size=len(rows))


def _with_spans(df: DataFrame, text: str, name: str, ordinary: str) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            spans = _listed([spans_of(t) for t in texts], tuple(SPANS.elementType.names), SPANS_ARROW)
            # What a batch gives stands in its first row.
            usual = _listed([ordinary_sums(texts), *[()] * (len(texts) - 1)][: len(texts)], tuple(ORDINARY.elementType.names), ORDINARY_ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans, usual], [*batch.schema.names, name, ordinary])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, SPANS), T.StructField(ordinary, ORDINARY)]))


#: Per encoding and length, and for all encodings under None: mean and spread of the logarithm of ordinary tokens' statistic.
Null = dict[tuple[str | None, int], tuple[float, float]]


def ordinary_null(found: DataFrame, ordinary: str) -> Null:
    """Learned over all texts; at most a row per encoding and length comes back."""
    each = found.select(F.inline(ordinary))
    rows = each.groupBy("encoding", "size").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")).collect()
    sums: dict[tuple[str | None, int], list[float]] = {}
    for r in rows:
        for key in ((r["encoding"], r["size"]), (None, r["size"])):
            held = sums.setdefault(key, [0, 0.0, 0.0])
            held[:] = held[0] + r["n"], held[1] + r["s"], held[2] + r["ss"]
    return {
        key: (s / n, math.sqrt(max(ss / n - (s / n) ** 2, LEAST_SPREAD**2)))
        for key, (n, s, ss) in sums.items() if n >= LEAST_ORDINARY or key[0] is None and n > 1
    }


def bin_of(null: Null, encoding: str, length: int, statistic: float) -> int:
    """The bin of a token's -log10(p / length); without any ordinary token nothing is known, and p is 1."""
    at = ORDINARY_SIZES.index(size_of(length))
    # A shorter ordinary token is closer to chance, so its null is the safe one to take.
    near = (*ORDINARY_SIZES[at::-1], *ORDINARY_SIZES[at + 1 :])
    known = next((null[key] for size in near for key in ((encoding, size), (None, size)) if key in null), None)
    p = above((known[0] - logarithm(statistic)) / known[1]) if known else 1.0
    return min(BINS - 1, max(0, int(-math.log10(max(p, 1e-118) / length) / BIN_WIDTH)))


def by_chance(statistic: float) -> float:
    """The chance that a random token is as irregular."""
    return chi_squared_above(statistic, 6)


def threshold(found: DataFrame, spans: str, null: Null, false_share: float = FALSE_SHARE) -> int:
    """The least bin whose tokens count as discoveries, from the histogram of the whole corpus.

    With weights in proportion to length, a token counts if p / length is at most
    ``false_share`` times the number of discoveries over the length of all tokens.
    """

    def count(batches: Batches) -> Batches:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for encoding, start, end, statistic in zip(*(c.to_pylist() for c in batch.columns)):
                held = sums.setdefault(bin_of(null, encoding, end - start, statistic), [0, 0])
                held[0], held[1] = held[0] + 1, held[1] + end - start
        yield pa.RecordBatch.from_pydict({
            "bin": pa.array(list(sums), pa.int32()), "n": pa.array([n for n, _ in sums.values()], pa.int64()), "length": pa.array([x for _, x in sums.values()], pa.int64()),
        })

    tokens = found.select(F.inline(spans)).where("kind = 'random'").select("encoding", "start", "end", "statistic")
    by_bin = tokens.mapInArrow(count, "bin int, n long, length long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).collect()
    length = sum(r["length"] for r in by_bin)
    counted, best = 0, BINS
    for r in sorted(by_bin, key=lambda r: -r["bin"]):
        counted += r["n"]
        if 10 ** (-r["bin"] * BIN_WIDTH) <= false_share * counted / length:
            best = r["bin"]
    return best


#: What is left of a span once it is judged.
KEPT = T.ArrayType(T.StructType(SPANS.elementType.fields[:4]))
KEPT_ARROW = pa.list_(pa.struct(list(SPANS_ARROW.value_type)[:4]))


def _judge(found: DataFrame, spans: str, ordinary: str, false_share: float) -> Callable[[Iterable[tuple]], list[tuple]]:
    """A filter for a text's spans that leaves base spans and discoveries only, as kind, start, end, encoding."""
    null = ordinary_null(found, ordinary)
    least = threshold(found, spans, null, false_share)

    def kept(row: Iterable[tuple]) -> list[tuple]:
        return [
            (kind, start, end, encoding) for kind, start, end, encoding, statistic, inside in row
            if kind != "random" or not inside and by_chance(statistic) >= NOT_BY_CHANCE and bin_of(null, encoding, end - start, statistic) >= least
        ]

    return kept


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text", false_share: float = FALSE_SHARE) -> DataFrame:
    """Per document: its key and ``spans`` (kind, start, end, encoding), in code points, by start.

    The spans of all tokens are written once to the shared folder, without texts.
    """
    chosen = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    found = written(_with_spans(chosen, "text", "spans", "ordinary").select("key", "spans", "ordinary"), "secrets")
    kept = _judge(found, "spans", "ordinary", false_share)

    def judge(batches: Batches) -> Batches:
        for batch in batches:
            rows = (kept(s.values() for s in row) for row in batch.column("spans").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key"), _listed([*rows], tuple(KEPT.elementType.names), KEPT_ARROW)], ["key", "spans"])

    fields = [found.schema["key"], T.StructField("spans", KEPT)]
    return found.select("key", "spans").mapInArrow(judge, T.StructType(fields)).select(F.col("key").alias(key), "spans")


def redacted(documents: DataFrame, text: str = "text", mark: str = "[SECRET]", false_share: float = FALSE_SHARE) -> DataFrame:
    """``documents`` with each secret in a text replaced by ``mark``, overlapping ones together.

    Texts are searched twice, for the limits and to be cut, rather than written once more; only spans are.
    """
    name = free_name("spans", documents.columns)
    chosen = documents.select(F.col(f"`{text}`").alias("text"))
    kept = _judge(written(_with_spans(chosen, "text", "spans", "ordinary").select("spans", "ordinary"), "secrets"), "spans", "ordinary", false_share)

    def judge(batches: Batches) -> Batches:
        for batch in batches:
            rows = [kept(spans_of(t or "")) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _listed(rows, tuple(KEPT.elementType.names), KEPT_ARROW)], [*batch.schema.names, name])

    found = documents.mapInArrow(judge, T.StructType([*documents.schema.fields, T.StructField(name, KEPT)]))
    whole, spans = F.col(f"`{text}`"), F.col(name)
    # Cuts in order: a span starts a new cut if it lies behind all before it.
    merged = F.aggregate(
        spans, F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["e"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["s"].alias("s"), F.greatest(F.element_at(done, -1)["e"], s["end"]).alias("e"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("s"), s["end"].alias("e"))))),
    )
    found = found.withColumn(name, merged)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(name, lambda s: s["e"]))
    ends = F.concat(F.transform(name, lambda s: s["s"]), F.array(F.char_length(whole).cast("long")))
    rest = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(whole, p["a"] + 1, p["b"] - p["a"])), mark)
    changed = F.when(F.size(name) > 0, rest).otherwise(whole)
    return found.select(*(changed.alias(c) if c == text else F.col(f"`{c}`") for c in documents.columns))
