"""Driver queries of the llm operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelweave.llm import bpe, lm, merkle, near, packing, preference, quality, ranker, secrets, sharding, topk, toxicity, trie
from parcelweave.llm.sql import merkle_sql, near_sql, quality_sql, trie_sql
from parcelweave.session import fresh_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, repetition coverage and verdict of every document."""
    rules = quality.Rules()
    found = quality.quality(table(spark, sf_dir, "documents"), rules=rules)
    by_length = [
        F.get(measures, F.lit(i)).alias(f"{name}_{k}_chars")
        for name, measures, lengths in (("dup", "dup_gram_chars", rules.repeated), ("top", "top_gram_chars", rules.top))
        for i, k in enumerate(lengths)
    ]
    return found.select("doc_id", *quality.COUNTS, *by_length, *quality.FLAGS)


SQL["op1_repetition"] = quality_sql(quality.Rules())


def remainder(folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


@query
def op2_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a model of those whose remainder by 7 isn't 2."""
    held_out = F.coalesce(remainder(7) == 2, F.lit(False))
    scores = lm.score(table(spark, sf_dir, "documents"), ~held_out)
    return scores.withColumn("held_out", ~F.col("learnt")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a packed sequence."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"))
    digest = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.place_pieces(digest).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and its number of links."""
    found = near.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies")


SQL["op4_jaccard_join"] = near_sql(near.Settings())


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from labels whose remainder by 5 isn't 0."""
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.is_held_out(F.col("doc_id"))
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    return toxicity.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every vector whose id is divisible by 20."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL["op6_top_k"] = """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole c ON q.r <> c.r
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with another's last answer: one prompt, two masked completions."""
    turns = preference.turns_of(table(spark, sf_dir, "conversations"), "conv_id")
    chosen = turns.withColumn("pair", F.col("pair").cast("long"))
    found = preference.paired_examples(preference.swapped_pairs(preference.gathered(chosen)))

    def ranges(mask: str) -> Column:
        return F.expr(f"array_join(transform({mask}, r -> concat_ws('-', r.begin, r.end)), ',')").alias(mask)

    return found.select(
        F.col("pair").alias("conv_id"), "prompt_turns", "prompt", "chosen", "rejected",
        ranges("chosen_mask"), ranges("rejected_mask"),
    )


SQL["op7_preferences"] = """
WITH turns AS (
  SELECT conv_id, turn, said.role AS role, said.text AS text FROM (
    SELECT conv_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS said
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn)
), last AS (
  SELECT conv_id, max(turn) AS final, arg_max(text, turn) AS answer FROM turns WHERE role = 'assistant' GROUP BY conv_id
), swap AS (
  SELECT a.conv_id, a.final, b.answer AS other FROM last a JOIN last b ON b.conv_id = xor(a.conv_id, 1)
), sides AS (
  SELECT 'chosen' AS side, conv_id, turn, role, text FROM turns
  UNION ALL
  SELECT 'rejected', t.conv_id, turn, role, CASE WHEN turn = final THEN other ELSE text END
  FROM turns t JOIN swap s USING (conv_id) WHERE turn <= final
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn) - 1 AS position FROM sides
), met AS (
  SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.position, b.position) AS position,
    coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM placed WHERE side = 'chosen') a
  FULL JOIN (SELECT * FROM placed WHERE side = 'rejected') b ON a.conv_id = b.conv_id AND a.position = b.position
), common AS (
  SELECT conv_id, coalesce(min(position) FILTER (NOT same), count(*)) AS common FROM met GROUP BY conv_id
), rendered AS (
  SELECT conv_id, CASE WHEN position < common THEN 'prompt' ELSE side END AS part, position,
    '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body,
    position >= common AND role = 'assistant' AS trained
  FROM placed JOIN common USING (conv_id) WHERE position >= common OR side = 'chosen'
), ranged AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (
    PARTITION BY conv_id, part ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begin
  FROM rendered
)
SELECT conv_id, count(*) FILTER (part = 'prompt') AS prompt_turns,
  coalesce(string_agg(head || body, '' ORDER BY position) FILTER (part = 'prompt'), '') AS prompt,
  CASE WHEN count(*) FILTER (part IN ('prompt', 'chosen')) > 0
    THEN coalesce(string_agg(head || body, '' ORDER BY position) FILTER (part = 'chosen'), '') END AS chosen,
  CASE WHEN count(*) FILTER (part IN ('prompt', 'rejected')) > 0
    THEN coalesce(string_agg(head || body, '' ORDER BY position) FILTER (part = 'rejected'), '') END AS rejected,
  coalesce(string_agg(begin || '-' || begin + length(body), ',' ORDER BY begin) FILTER (part = 'chosen' AND trained), '') AS chosen_mask,
  coalesce(string_agg(begin || '-' || begin + length(body), ',' ORDER BY begin) FILTER (part = 'rejected' AND trained), '') AS rejected_mask
FROM ranged GROUP BY conv_id
"""


def span_text(spans: str) -> Column:
    """kind:start:end of every span of an array, comma-joined in its order."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets of every document."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = {kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)") for kind in secrets.KINDS}
    return found.select(
        "doc_id",
        *[count[kind].alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(span_text("filter(spans, s -> s.kind <> 'entropy')"), 256).alias("base_sha256"),
        span_text("spans").alias("spans"),
    )


#: Bytes of text of a shard.
SHARD_BYTES = 1 << 20


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return sharding.shard_rows(table(spark, sf_dir, "documents"), SHARD_BYTES)


SQL["op9_sharding"] = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
    ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 2) << 30)
      | (('0x' || substr(md5(coalesce(text, '')), 1, 8))::BIGINT >> 2) AS hash
  FROM documents
), cells AS (
  SELECT hash, sum(bytes) AS b, count(*) AS n FROM hashed GROUP BY hash
), levels AS (
  SELECT hash, depth, hash >> (60 - depth) AS prefix, b, n FROM cells, range(0, 61) AS r(depth)
), sums AS (
  SELECT depth, prefix, sum(b)::BIGINT AS shard_bytes, sum(n)::BIGINT AS shard_rows FROM levels GROUP BY ALL
), leaves AS (
  SELECT hash, min(depth) AS depth FROM levels JOIN sums USING (depth, prefix)
  WHERE shard_bytes <= {SHARD_BYTES} OR depth = 60 GROUP BY hash
)
SELECT h.doc_id, h.bytes, l.depth::INTEGER AS depth, s.prefix,
  CASE WHEN s.shard_bytes <= {SHARD_BYTES} THEN 0 ELSE
    (row_number() OVER (PARTITION BY h.hash ORDER BY h.bytes) - 1) // greatest({SHARD_BYTES} // greatest(h.bytes, 1), 1)
  END::BIGINT AS part, s.shard_bytes, s.shard_rows
FROM hashed h JOIN leaves l USING (hash) JOIN sums s ON s.depth = l.depth AND s.prefix = h.hash >> (60 - l.depth)
"""


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op11_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learnt from labels whose remainder by 5 isn't 0; 0.3 lies at the cut."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~ranker.is_held_out(F.col("doc_id")))
    model, sample = ranker.train(docs, labels)
    at = fresh_dir(spark, "strengths")
    ranker.strengths(docs, model).write.parquet(at)
    scored = spark.read.parquet(at)
    score = ranker.chance(F.col("strength"), ranker.strength_cut(scored, sample), 0.3)
    return scored.select("doc_id", ranker.is_held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int")
    )


#: What a document's leaf digests, in this order.
LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof by descent, and the root it folds to after some texts were lower-cased."""
    docs = table(spark, sf_dir, "documents").select(*LEAF_FIELDS)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.coalesce(remainder(5) == 0, F.lit(False))
    text = F.when(tampered, F.translate("text", capitals, capitals.lower())).otherwise(F.col("text"))
    changed = F.when(tampered, F.unhex(merkle.digest([text if f == "text" else F.col(f) for f in LEAF_FIELDS])))
    manifest = merkle.build(docs, LEAF_FIELDS, "source", "doc_id", {"doc_id": F.col("doc_id"), "changed": changed})
    asked = manifest.leaves(spark).select("tree", "rank", "c_doc_id", "c_changed")
    found = merkle.proofs(spark, manifest, asked)
    leaf = merkle.hexadecimal(F.coalesce("c_changed", "leaf"))
    return found.select(
        F.col("c_doc_id").alias("doc_id"),
        merkle.hexadecimal(F.col("leaf")).alias("leaf"),
        merkle.hexadecimal(F.col("subroot")).alias("subroot"),
        F.lit(manifest.root).alias("root"),
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        merkle.fold(leaf, F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


SQL["op12_merkle_manifest"] = merkle_sql(LEAF_FIELDS, merkle.FAN)


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie over conversations that share their first turns with another."""
    turns = trie.turns_of(table(spark, sf_dir, "conversations"))
    convs = turns.filter("place = 0").select("conv")
    return trie.prefix_trie(trie.share_heads(turns), convs)


SQL["op13_prefix_trie"] = trie_sql()
