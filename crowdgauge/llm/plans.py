"""One query ``opN_<name>`` for each operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdgauge.llm import (
    chains,
    hard_negatives,
    knn_join,
    langid,
    lexical,
    line_dedup,
    mixing,
    multi_index,
    ngram_join,
    packing,
    rollup,
    sentence_pieces,
    substring,
)
from crowdgauge.llm.queries import query, table
from crowdgauge.runtime import ensure_checkpoint_dir, pin


@query("op1_ngram_jaccard")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9: size, component and whether the document is the smallest."""
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query("op2_pack_sequences")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query(
    "op3_line_dedup",
    r"""
    WITH l AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents
    ), s AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS o
        FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
    ), w AS (
        SELECT doc_id, o, line AS l1, lead(line, 1) OVER d AS l2, lead(line, 2) OVER d AS l3
        FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY o)
    ), f AS (
        SELECT doc_id, o, row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, o) AS turn
        FROM w WHERE l3 IS NOT NULL
    ), gone AS (
        SELECT DISTINCT doc_id, o + k AS o FROM f, (VALUES (0), (1), (2)) AS t(k) WHERE turn > 1
    ), kept AS (
        SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text,
               count(*) AS n
        FROM l LEFT JOIN s ON l.doc_id = s.doc_id AND l.i = s.i
        LEFT JOIN gone ON gone.doc_id = s.doc_id AND gone.o = s.o
        WHERE gone.o IS NULL GROUP BY l.doc_id
    ), sizes AS (
        SELECT s.doc_id, count(*) AS n_lines, count(gone.o) AS n_removed
        FROM s LEFT JOIN gone ON gone.doc_id = s.doc_id AND gone.o = s.o GROUP BY s.doc_id
    )
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
           CASE WHEN d.text IS NOT NULL THEN md5(coalesce(kept.text, '')) END AS kept_md5
    FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many repeated windows cover, and what is left."""
    done = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), counts=True)
    return done.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(~langid.held_out()))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), langid.held_out().alias("held_out"), "text")
    return langid.identify(slim, model).select("doc_id", "held_out", "lang_pred", "score")


@query(
    "op6_curriculum_mix",
    r"""
    WITH d AS (
        SELECT doc_id, source, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS hashed,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
        FROM documents
    ), s AS (
        SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
               row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
        FROM d GROUP BY source
    ), w AS (
        SELECT *, CAST(CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
               1.5 * sum(source_size) OVER () AS due
        FROM s
    ), r AS (
        SELECT *, 2 * source_size AS most, 2 * source_size / weight AS ratio FROM w
    ), l AS (
        SELECT *, (due - coalesce(sum(most) OVER (ORDER BY ratio, place
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (ORDER BY ratio, place
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM r
    ), t AS (
        SELECT l.*, least(most, weight * (SELECT min_by(level, ratio) FROM l WHERE level <= ratio)) AS target
        FROM l
    ), c AS (
        SELECT d.*, t.source_size, t.target, t.place,
               coalesce(sum(size) OVER (PARTITION BY t.place ORDER BY hashed, doc_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
    ), p AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS rounds,
               before / target AS done
        FROM c
    )
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
           CAST(rounds * size + greatest(0, least(size, floor(target) - rounds * source_size - before)) AS BIGINT)
               AS taken,
           CASE WHEN rounds * size + greatest(0, least(size, floor(target) - rounds * source_size - before)) > 0
                THEN round(CASE place % 3
                    WHEN 0 THEN 2 * done / (1.5 + sqrt(2.25 - 2 * done))
                    WHEN 1 THEN done
                    ELSE 2 * done / (0.5 + sqrt(0.25 + 2 * done)) END, 9) END AS first_position
    FROM p
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, sorted by its first training position."""
    plan = mixing.demand(table(spark, sf_dir, "documents"))
    first = F.round(F.get("passes", F.lit(0))["position"], 9)
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken", first.alias("first_position")
    ).orderBy("first_position", "doc_id")


@query("op8_substring_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document and those that windows of 50 words repeat from smaller ids."""
    done = substring.dedup_substrings(table(spark, sf_dir, "documents"), k=50)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op7_embedding_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 among vectors of a label, and their components."""
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


@query(
    "op9_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
        FROM embeddings
        WHERE embedding IS NOT NULL
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    ), r AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM s
    )
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best others of every twentieth vector."""
    return knn_join.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op4_toxicity_chain")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of low quality, then of toxicity, of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    given = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return chains.predict(docs, chains.learn(docs, given, ["low_quality", "toxic"]))


#: Words; words that hold a letter or digit; runs of letters and digits and single other characters.
_COUNTS = {
    "words": r"[^\x20\x09-\x0D]+",
    "spoken": r"[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*",
    "pieces": r"[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]",
}


@query(
    "op10_token_rollup",
    r"""
    WITH d AS (
        SELECT source, lang,
               row_number() OVER (PARTITION BY text ORDER BY doc_id) AS turn, text,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]*[\p{L}\p{N}][^\x20\x09-\x0D]*')) AS spoken,
               len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\x20\x09-\x0D\p{L}\p{N}]')) AS pieces
        FROM documents
    ), k AS (SELECT * FROM d WHERE turn = 1 OR text IS NULL)
    SELECT source, lang, 'words/1' AS tokenizer, count(*) AS documents, CAST(sum(spoken) AS BIGINT) AS tokens
    FROM k GROUP BY source, lang
    UNION ALL
    SELECT source, lang, 'words/2', count(*), CAST(sum(pieces) AS BIGINT) FROM k GROUP BY source, lang
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five batches over all documents: loaded under one tokenizer, counts revised,
    loaded under a second one, copies of earlier texts deleted from both, two batches sent again."""
    docs = table(spark, sf_dir, "documents")
    count = lambda p: F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("bigint")
    sized = pin(
        docs.select(
            "doc_id", "source", "lang", F.md5("text").alias("digest"), *(count(p).alias(n) for n, p in _COUNTS.items())
        )
    )
    firsts = sized.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"))
    copies = pin(sized.join(firsts, "digest").filter("doc_id > first"))

    def change(rows: DataFrame, op: str, tokenizer: str, tokens: str, old: str | None = None) -> DataFrame:
        before = F.col(old) if old else F.lit(None).cast("bigint")
        return rows.select(
            F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"),
            F.col(tokens).alias("tokens"), before.alias("old_tokens"),
        )

    load = change(sized, "insert", "words/1", "words")
    gone = change(copies, "delete", "words/1", "spoken").unionByName(change(copies, "delete", "words/2", "pieces"))
    totals = rollup.TokenRollup(spark, f"{ensure_checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}")
    totals.commit("load", load)
    totals.commit("recount", change(sized, "revise", "words/1", "spoken", "words"))
    totals.commit("second tokenizer", change(sized, "insert", "words/2", "pieces"))
    totals.commit("copies", gone)
    totals.compact()
    totals.commit("load", load)
    totals.commit("copies", gone)
    return totals.totals()


@query(
    "op12_bag_search",
    r"""
    WITH t AS (
        SELECT doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS raw
        FROM documents
    ), d AS (
        SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM t
    ), sizes AS (
        SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id
    ), g AS (
        SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS l FROM sizes
    ), i AS (
        SELECT DISTINCT item_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
        FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS raw
              FROM benchmark)
    ), tf AS (
        SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term
    ), w AS (
        SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM tf, g GROUP BY term, big_n
    ), s AS (
        SELECT i.item_id, tf.doc_id,
               CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // l)))) AS BIGINT) AS score
        FROM tf JOIN w USING (term) JOIN sizes USING (doc_id) JOIN i USING (term), g
        GROUP BY i.item_id, tf.doc_id
    ), r AS (
        SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
        FROM s WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for each benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


@query("op13_sentence_pieces")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    done = sentence_pieces.encode(table(spark, sf_dir, "documents"))
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2(digits, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op11_hard_negatives",
    """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
        FROM embeddings
        WHERE embedding IS NOT NULL AND label IS NOT NULL
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
               CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
        FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)
    ), p AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
            FROM s WHERE same
        ) WHERE place <= 5
    ), n AS (
        SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id,
               p.score AS positive_score, s.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)
                    AS INTEGER) AS rank
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
            AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
    )
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every hundredth vector, with every seventh label moved."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)
