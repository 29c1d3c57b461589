"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histoloom.session import importable_on_workers, shared_path, table

import public_tokenizers

from histoloom.llm import ann, chat, decontamination, line_dedup, packing, periodic_runs, sharding, simhash, source_audit, substring_dedup, superminhash, token_files, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed into sequences of at most 1024 ids."""
    placed = packing.place_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packing.merge_leftovers(placed.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, number of links and decision of every line of 20 characters or more, at 2 edits."""
    return line_dedup.line_classes(table(spark, sf_dir, "documents")).drop("doc")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document in 24 shards of equal row counts."""
    docs = sharding.with_digests(table(spark, sf_dir, "documents"))
    placed = sharding.shard_rows(docs, shards=24, seed=20240, order=["doc_id", "text_crc32", "size"])
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document; labels of held-out documents teach nothing."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    scored = toxicity.with_scores(docs, toxicity.train(docs, labels, ~held_out), "score")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to token files in doc_id order and read back."""
    folder = shared_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, verbatim or paraphrased, with the item."""
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered turns of every maximal conversation."""
    return chat.render_turns(chat.maximal_conversations(table(spark, sf_dir, "conversations")))


#: Prefix strings of whole conversations; a conversation stays if its own is no proper prefix of another's.
CHAT_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS number FROM turns),
said AS (SELECT conv_id, number, role, text, to_json({'role': role, 'text': text})::VARCHAR AS said FROM numbered),
prefix AS (SELECT *, md5(string_agg(said, '|') OVER (PARTITION BY conv_id ORDER BY number)) AS p, max(number) OVER (PARTITION BY conv_id) AS n FROM said),
kept AS (
  SELECT min(conv_id) AS conv_id FROM prefix a
  WHERE number = n AND NOT EXISTS (SELECT 1 FROM prefix b WHERE b.number = a.number AND b.p = a.p AND b.n > b.number)
  GROUP BY number, p),
written AS (
  SELECT conv_id, number, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS segment, coalesce(role, '') = 'assistant' AS learned
  FROM said WHERE conv_id IN (SELECT conv_id FROM kept))
SELECT conv_id, number::BIGINT AS number,
  (coalesce(sum(length(segment)) OVER (PARTITION BY conv_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, segment, learned
FROM written
"""


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose vec_id is divisible by 20."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage to remove, at offsets of its document."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles, near-duplicate component and decision of every document, at two words and a similarity of 0.8."""
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), percent=80, words_each=2)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document and digests of them and of the collapsed text; in a tenth of the documents (by the hash of doc_id) the end is made to repeat first.

    A null doc_id has no decimal form: such a document is taken as written.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n, words = F.floor(h / 10), F.size("words").cast("long"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumns({"g": g, "words": F.when(h % 10 == 0, words)}).withColumn("a", F.when(n > 0, F.col("g") % n))
    docs = docs.withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    made = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    docs = docs.select("doc_id", F.when(F.col("p").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.with_runs(docs).withColumn("first", F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["start"].alias("start"), r["period"].alias("period")))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    milli = F.floor(1000 * F.col("first.length") / F.col("first.period"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "first.start", "first.length", "first.period", milli.alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of sources of a lang, and the terms of every source that stand over the lang's."""
    return source_audit.divergence(table(spark, sf_dir, "documents"), min_docs=30, top=50)


#: All terms of all groups side by side, with those that a group lacks.
AUDIT_SQL = r"""
WITH rows AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
texts AS (SELECT lang, text, source, count(*) AS copies FROM rows GROUP BY ALL),
cut AS (SELECT lang, source, copies, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts),
counts AS (SELECT lang, source, term, sum(copies) AS n FROM cut GROUP BY ALL),
kept AS (SELECT lang, term FROM (SELECT lang, term, source, text, any_value(copies) AS copies FROM cut GROUP BY ALL) GROUP BY ALL HAVING sum(copies) >= 30),
of_lang AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM rows),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, o.v FROM groups g JOIN kept k ON k.lang = g.lang JOIN of_lang o ON o.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p FROM grid),
whole AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n, any_value(v) AS v FROM grid GROUP BY ALL)),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
over AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM over))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


_QUERIES: dict[str, Query] = {
    "op1_packing": op1_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_chat": op5_chat,
    "op6_toxicity": op6_toxicity,
    "op7_token_files": op7_token_files,
    "op8_ann": op8_ann,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_simhash": op10_simhash,
    "op11_superminhash": op11_superminhash,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_audit": op13_source_audit,
}
_SQL: dict[str, str] = {"op5_chat": CHAT_SQL, "op13_source_audit": AUDIT_SQL}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over documents."""
    import corpus_pipeline  # stands beside the package

    return corpus_pipeline.run(spark, sf_dir)


_QUERIES["pipeline"] = pipeline


def _prepared(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable_on_workers(spark)
        return function(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _prepared(function) for name, function in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
