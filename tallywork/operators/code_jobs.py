"""Checks of the Python code in a corpus of texts.

Equal blocks are common (the same opening lines, the same short solution), so blocks are
counted first and each distinct one is parsed once.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.functions.code_check import finding, longest_valid_prefix
from tallywork.functions.text import CODE_BLOCK, open_code_suffix

# Fixed values of the roll-back rule.
MAX_SUFFIX_BREAKS = 5
NAMES_COMMENT = "# Define symbols "


def code_blocks(texts: DataFrame, *keep: str) -> DataFrame:
    """Every closed python block of a text."""
    return texts.select(*keep, F.explode(F.regexp_extract_all("text", F.lit(CODE_BLOCK), F.lit(1))).alias("code"))


def code_check_report(texts: DataFrame, allowed: Collection[str] = ()) -> DataFrame:
    """Blocks per method and finding: 'ok', 'syntax_error', 'too_deep', or 'undefined' with the name.

    A block is parsed once, however many methods have it, with a count per method.
    """
    allowed = frozenset(allowed)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = [finding(code, allowed) for code in batch["code"]]
            yield pd.DataFrame(
                {
                    "counts": batch["counts"],
                    "finding": [found for found, _ in results],
                    "names": [names or [None] for _, names in results],
                }
            )

    per_method = code_blocks(texts, "method").groupBy("code", "method").agg(F.count("*").alias("blocks"))
    # As many counts as there are methods.
    distinct = per_method.groupBy("code").agg(F.collect_list(F.struct("method", "blocks")).alias("counts"))
    counted = "counts array<struct<method:string,blocks:bigint>>"
    judged = distinct.select("code", "counts").mapInPandas(judge, f"{counted}, finding string, names array<string>")
    return (
        judged.select("finding", "names", F.inline("counts"))
        .select("method", "finding", "blocks", F.explode("names").alias("name"))
        .groupBy("method", "finding", "name")
        .agg(F.sum("blocks").alias("blocks"))
    )


def valid_prefix_table(codes: DataFrame, allowed: Collection[str] = ()) -> DataFrame:
    """``code`` -> prefix, suffix, names for each distinct code."""
    allowed = frozenset(allowed)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [longest_valid_prefix(code, allowed) for code in batch["code"]]
            yield pd.DataFrame(
                {
                    "code": batch["code"],
                    "prefix": [p for p, _, _ in parts],
                    "suffix": [s for _, s, _ in parts],
                    "names": [n for _, _, n in parts],
                }
            )

    return codes.select("code").distinct().mapInPandas(
        split, "code string, prefix string, suffix string, names array<string>"
    )


def must_roll_back(suffix: str, names: list[str]) -> bool:
    return bool(names) or suffix.count("\n") > MAX_SUFFIX_BREAKS or "\n\n" in suffix


def rewrite_decision(requests: DataFrame, allowed: Collection[str] = ()) -> DataFrame:
    """For each ``buffer`` with open code: roll it back or not, and the buffer to go on with.

    Requests and checked codes meet by a digest. A check gives back how much of the code to
    keep, the names, and the decision; the buffer is cut behind the join, so no code text goes
    through it.
    """
    allowed = frozenset(allowed)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [longest_valid_prefix(code, allowed) for code in batch["code"]]
            yield pd.DataFrame(
                {
                    "digest": batch["digest"],
                    "dropped": [len(code) - len(prefix) for code, (prefix, _, _) in zip(batch["code"], parts)],
                    "names": [n for _, _, n in parts],
                    "rolled_back": [must_roll_back(s, n) for _, s, n in parts],
                }
            )

    code = open_code_suffix("buffer")
    opened = requests.where(code != "")
    distinct = opened.select(F.sha2(code, 256).alias("digest"), code.alias("code")).distinct()
    checked = distinct.mapInPandas(decide, "digest string, dropped int, names array<string>, rolled_back boolean")
    joined = opened.withColumn("digest", F.sha2(code, 256)).join(checked, "digest")
    comment = F.when(F.size("names") > 0, F.concat(F.lit(NAMES_COMMENT), F.array_join("names", " "))).otherwise("")
    kept = F.substr("buffer", F.lit(1), F.length("buffer") - F.col("dropped"))
    return joined.select(
        *requests.columns, "names", "rolled_back",
        F.when(F.col("rolled_back"), F.concat(kept, comment)).otherwise(F.col("buffer")).alias("new_buffer"),
    )
