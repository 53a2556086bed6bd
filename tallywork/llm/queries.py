"""The operators of this subpackage as queries over the given tables, with their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywork.llm import (
    block_topk, chat_format, decontaminate, hard_negatives, language_mix, line_dedup, mixing, packing, prefix_trie, secret_scan, simhash, site_templates, warc_zip,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is the DuckDB text giving the same rows."""

    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DECONTAMINATION_SQL = rf"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + 9], ' ') AS phrase
  FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(i) WHERE len(w) > 0),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
runs AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM docs, (SELECT DISTINCT size FROM phrases), unnest(range(1, len(w) - size + 2)) AS u(i)),
found AS (SELECT doc_id, i, size, item_id FROM runs JOIN phrases USING (size, phrase)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM found, unnest(range(size)) AS u(k) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op1_decontaminate", DECONTAMINATION_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word phrases of the benchmark in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, h: total + h["end"] - h["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@query("op2_language_mix")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled ones of three folds in four."""
    documents = table(spark, sf_dir, "documents")
    model = language_mix.learn(documents.where(~language_mix.held_out()))
    # The operator's rows carry the key only, from which the fold follows.
    mixed = language_mix.identify(documents, model)
    return mixed.select("doc_id", language_mix.held_out().alias("held_out"), F.col("language").alias("lang_pred"), "score", "proportions")


def joined_spans(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sizes AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\') AS body,
         length(replace(replace(replace(role, '\', '\\'), '<', '<\'), '[', '[\')) AS r FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + r + 8 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM sizes GROUP BY conv_id
"""
CONTROL = "</s>[INST] ok [/INST]"


@query("op3_chat_format", CHAT_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, then read back; one more holds control strings."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL).alias("text"),
    )
    messages = said.unionByName(extra).withColumn("parts", chat_format.text_parts(F.col("text")))
    chats = chat_format.formatted(messages)
    read = chats.select(
        "conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"),
        chat_format.under_mask(F.col("formatted"), F.col("loss")).alias("trained"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"), F.sha2(F.col("trained"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known shapes of secrets and random-looking tokens in every document."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


@query(
    "op5_warc_zip",
    """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
last AS (SELECT digest, max(page_id) AS id FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN last.id IS DISTINCT FROM page_id AND last.id IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last.id IS DISTINCT FROM page_id THEN last.id END AS refers_to
FROM p LEFT JOIN last USING (digest)
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC packages and read back."""
    packages = warc_zip.write_packages(table(spark, sf_dir, "pages"))
    records = warc_zip.read_packages(spark, packages, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op6_block_topk",
    """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum([x[1] * x[2] FOR x IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows, by inner product, of every fiftieth embedding."""
    return block_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


LINE_DEDUP_SQL = rf"""
WITH lines AS (
  SELECT doc_id, i, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
        FROM documents)),
parts AS (
  SELECT doc_id, i, k, start, part || CASE WHEN k < n THEN '.' ELSE '' END AS part
  FROM (SELECT doc_id, i, start, len(string_split(line, '. ')) AS n, unnest(string_split(line, '. ')) AS part,
               generate_subscripts(string_split(line, '. '), 1) AS k FROM lines)),
units AS (
  SELECT doc_id, 'line' AS level, line AS unit, start FROM lines
  UNION ALL
  SELECT doc_id, 'sentence', part, start + sum(length(part) + 1) OVER (PARTITION BY doc_id, i ORDER BY k) - length(part) - 1 FROM parts),
words AS (
  SELECT doc_id, level, start, start + length(unit) AS stop,
         regexp_extract_all(rtrim(translate(unit, {LETTERS}), ' .' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[^\x20\x09-\x0D]+') AS w
  FROM units),
named AS (SELECT doc_id, level, start, stop, array_to_string(w, ' ') AS unit,
                 lead(start) OVER (PARTITION BY doc_id, level ORDER BY start) AS following FROM words WHERE len(w) > 0),
gone AS (
  SELECT doc_id, start, stop, following FROM (
    SELECT *, row_number() OVER (PARTITION BY level, unit ORDER BY doc_id, start) AS rank FROM named) WHERE rank > 1),
marked AS (
  SELECT *, CASE WHEN start < max(stop) OVER before OR start = max(following) OVER before THEN 0 ELSE 1 END AS fresh FROM gone
  WINDOW before AS (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM marked),
spans AS (SELECT doc_id, min(start) AS start, max(stop) AS stop FROM islands GROUP BY doc_id, island HAVING max(stop) - min(start) >= {line_dedup.LEAST_RUN}),
listed AS (
  SELECT doc_id, count(*) AS n, sum(stop - start) AS chars,
         string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY start) AS spans
  FROM spans GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(counted.n, 0) AS n_units, coalesce(listed.n, 0) AS n_removed,
       CAST(coalesce(chars, 0) AS BIGINT) AS removed_chars, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN counted USING (doc_id)
"""


@query("op7_line_dedup", LINE_DEDUP_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated passages of every document, by its lines and sentences."""
    found = line_dedup.repeated_units(table(spark, sf_dir, "documents"))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    listed = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_units", F.size("removed").cast("long").alias("n_removed"), length.alias("removed_chars"), listed.alias("spans"))


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the component of near copies of every document."""
    found = simhash.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# The mixture of the query and of the pipeline: domains by the last digit of a source's name.
DOMAIN = """CASE WHEN right(source, 1) IN ('0', '1', '2', '3') THEN 'web' WHEN right(source, 1) IN ('4', '5', '6') THEN 'books'
                 WHEN right(source, 1) IN ('7', '8') THEN 'code' ELSE 'wiki' END"""
WEIGHTS = {
    ("web",): 40, ("books",): 30, ("code",): 20, ("wiki",): 10,
    ("web", "en"): 3, ("books", "en"): 2, ("web", "en", "src0"): 4,
}
SHARE, MOST_EPOCHS, SEED = 0.8, 2, 7


def tree() -> dict[str, Column]:
    return {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}


def _level_sql(depth: int) -> str:
    """The budgets of one level of the tree from those of the level above."""
    path = ("domain", "lang", "source")[:depth]
    names, parent = ", ".join(path), path[:-1]
    cases = "".join(
        " WHEN " + " AND ".join(f"{c} = '{n}'" for c, n in zip(path, stated)) + f" THEN {w}" for stated, w in WEIGHTS.items() if len(stated) == depth
    )
    weight = f"CASE{cases} ELSE 1 END" if cases else "1"
    same = " AND ".join(f"n.{c} IS NOT DISTINCT FROM u.{c}" for c in parent) or "true"
    above = f"level{depth - 1}" if parent else "(SELECT whole AS budget FROM total)"
    by = f"PARTITION BY {', '.join(parent)}" if parent else ""
    order = f"({by} ORDER BY fill, {', '.join(f'{c} NULLS FIRST' for c in path)} ROWS UNBOUNDED PRECEDING)"
    return f"""
nodes{depth} AS (SELECT {names}, sum(tokens) * {MOST_EPOCHS} AS room, {weight} AS weight FROM leaves GROUP BY {names}),
filled{depth} AS (
  SELECT {", ".join(f"n.{c}" for c in path)}, n.room, n.weight, u.budget AS above, CAST(n.room AS DOUBLE) / n.weight AS fill
  FROM nodes{depth} AS n JOIN {above} AS u ON {same} WHERE n.room > 0),
summed{depth} AS (
  SELECT *, sum(room) OVER {order} AS room_so_far, sum(weight) OVER ({by}) - sum(weight) OVER {order} AS weight_behind FROM filled{depth}),
full{depth} AS (SELECT *, CAST(room_so_far AS DOUBLE) + fill * CAST(weight_behind AS DOUBLE) <= CAST(above AS DOUBLE) AS is_full FROM summed{depth}),
taken{depth} AS (
  SELECT *, coalesce(sum(room) FILTER (is_full) OVER ({by}), 0) AS taken, sum(weight) FILTER (NOT is_full) OVER ({by}) AS open FROM full{depth}),
level{depth} AS (
  SELECT {names}, CASE WHEN is_full THEN CAST(room AS BIGINT)
                       ELSE CAST(floor(CAST(above - taken AS DOUBLE) / CAST(open AS DOUBLE) * weight) AS BIGINT) END AS budget
  FROM taken{depth}),"""


MIXING_SQL = rf"""
WITH docs AS (
  SELECT *, {DOMAIN} AS domain, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM docs GROUP BY domain, lang, source),
total AS (SELECT CAST(floor(CAST(coalesce(sum(tokens), 0) AS DOUBLE) * {SHARE}) AS BIGINT) AS whole FROM leaves),
{_level_sql(1)}{_level_sql(2)}{_level_sql(3)}
plan AS (
  SELECT b.*, l.tokens AS leaf_tokens, b.budget // l.tokens AS whole, b.budget % l.tokens AS rest FROM level3 AS b JOIN leaves AS l
    ON b.domain IS NOT DISTINCT FROM l.domain AND b.lang IS NOT DISTINCT FROM l.lang AND b.source IS NOT DISTINCT FROM l.source),
placed AS (
  SELECT d.doc_id, d.domain, d.lang, d.source, d.tokens, p.whole, p.rest,
         md5('{SEED}:' || CAST(CAST(p.whole AS BIGINT) AS VARCHAR) || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS place
  FROM docs AS d JOIN plan AS p
    ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
timed AS (
  SELECT *, whole + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE UNBOUNDED PRECEDING) <= rest
                         THEN 1 ELSE 0 END AS times FROM placed)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS n_tokens, CAST(unnest(range(CAST(times AS BIGINT))) AS BIGINT) AS epoch FROM timed
"""


@query("op9_mixing", MIXING_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of all words, mixed to the weights, each document as often as it is read."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    chosen = mixing.mixed(documents, tree(), SHARE, WEIGHTS, most_epochs=MOST_EPOCHS, seed=SEED)
    return chosen.select("doc_id", F.expr(DOMAIN).alias("domain"), "lang", "source", mixing.token_count(F.col("text")).alias("n_tokens"), "epoch")


@query("op10_site_templates")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = site_templates.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), into="text")
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op11_best_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2,048 tokens, as few as can be."""
    import public_tokenizers

    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    placed = packing.packed(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.id AS anchor, a.label = b.label AS same, b.id AS id, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (
  SELECT p.anchor, p.id AS positive, p.score AS positive_score, s.id AS negative, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, negative AS negative_id, positive_score, negative_score
FROM n WHERE rank <= 10
"""


@query("op12_hard_negatives", HARD_NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth embedding and each of its five positives, ten rows of other labels within its window."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


# The check digest of a number's digits bit by bit, as the database has no function for it.
CRC_SQL = """xor(4294967295, list_reduce(
    flatten([[ord(c), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(conv AS VARCHAR), '')]),
    lambda crc, x : xor(xor(crc, x) // 2, 3988292384 * (xor(crc, x) % 2)), 4294967295))"""

TRIE_SQL = f"""
WITH t AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv, count(*) AS size, conv - conv % 100 AS base FROM t GROUP BY conv),
headed AS (SELECT *, {CRC_SQL} % 6 AS head FROM convs),
sized AS (SELECT h.conv, h.base, h.head, least(h.head, coalesce(b.size, 0)) AS lent FROM headed AS h LEFT JOIN convs AS b ON b.conv = h.base),
turns AS (
  SELECT s.conv, t.place AS depth, t.role, t.text FROM sized AS s JOIN t ON t.conv = s.base AND t.place <= s.lent
  UNION ALL SELECT s.conv, t.place - s.head + s.lent, t.role, t.text FROM sized AS s JOIN t ON t.conv = s.conv AND t.place > s.head),
path AS (
  SELECT conv, depth, length(text) AS chars, string_agg(sha256(len(role) || ':' || role || text), '') OVER (PARTITION BY conv ORDER BY depth) AS key FROM turns
  UNION ALL SELECT conv, 0, 0, '' FROM convs),
nodes AS (SELECT key, any_value(depth) AS depth, min(conv) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM path GROUP BY key),
kids AS (SELECT key[: (depth - 1) * 64] AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
each AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
totals AS (
  SELECT p.key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * e.chars) AS saved
  FROM each AS e JOIN path AS p ON p.conv = e.conv_id AND p.depth <= e.depth GROUP BY p.key),
last AS (SELECT conv, max_by(key, depth) AS key FROM path GROUP BY conv),
ends AS (SELECT key, string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) AS ids FROM last GROUP BY key)
SELECT e.conv_id, CAST(e.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, e.n_convs, e.n_children, t.n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM each AS e JOIN totals AS t USING (key) LEFT JOIN nodes AS a ON e.depth > 0 AND a.key = e.key[: (e.depth - 1) * 64] LEFT JOIN ends USING (key)
"""


@query("op13_prefix_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each begun with the first turns of the hundred's first one."""
    head, base = F.crc32(F.col("conv").cast("string")) % 6, F.col("conv") - F.col("conv") % 100
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), head, base, most_head=5)
