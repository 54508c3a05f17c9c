"""Queries of the training-data operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iqlake.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from iqlake.llm.substring import drop_repeats

    rows = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_budgeted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back from the windows of all conversations and one whose texts are control strings."""
    from iqlake.llm.chat import chat_windows, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = rows.union(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string"))
    return read_back(chat_windows(rows, tokenizer_path("byte_bpe_50k.tiktoken")))


def op3_consistent_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from iqlake.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"), 40)


def op4_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from iqlake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2048)


def op5_relational_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the 32,000-piece model, and back."""
    from iqlake.llm.pieces import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), digest=True)


def op8_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from iqlake.llm.jaccard import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"), 4, 85)


def op9_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed sequences, their binary columns as digests."""
    from iqlake.llm.token_output import packed_matrix

    rows = packed_matrix(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))
    return rows.select("block", "row", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"), "cu_seqlens", "doc_ids", "pieces", "starts")


def op10_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    from iqlake.llm.quality import score

    return score(table(spark, sf_dir, "documents"))


def op7_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from iqlake.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_sorted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from iqlake.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"))


def op12_tight_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from iqlake.llm.repair import damage, repair

    return repair(damage(table(spark, sf_dir, "conversations")), absent_col="absent")


def op13_radix_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; ids divisible by 7 have a label that is wrong by one."""
    from iqlake.llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from iqlake.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and callable(fn)}


def oracle_sql() -> dict[str, str]:
    words = """words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM
                (SELECT doc_id, regexp_extract_all(TEXT, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents))"""
    return {
        "op1_recompression": f"""
            WITH {words.replace("TEXT", "text")},
            wins AS (SELECT doc_id, k, md5(string_agg(word, ' ') OVER w) AS name FROM words
                WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
                QUALIFY count(*) OVER w = 20),
            again AS (SELECT doc_id, k FROM wins QUALIFY row_number() OVER (PARTITION BY name ORDER BY doc_id, k) > 1),
            gone AS (SELECT DISTINCT doc_id, k + d AS k FROM again, range(20) t(d))
            SELECT doc_id, count(word) AS n_words, count(gone.k) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE gone.k IS NULL), '')) AS kept_sha256
            FROM documents LEFT JOIN words USING (doc_id) LEFT JOIN gone USING (doc_id, k) GROUP BY doc_id""",
        "op8_signature_trees": f"""
            WITH RECURSIVE {words.replace("TEXT", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")},
            runs AS (SELECT doc_id, k, max(k) OVER (PARTITION BY doc_id) AS n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS name FROM words),
            sets AS (SELECT DISTINCT doc_id, md5(name) AS name FROM runs WHERE k <= n - 3 OR (n < 4 AND k = 1)),
            sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
            met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sets a JOIN sets b ON a.name = b.name AND a.doc_id <> b.doc_id GROUP BY 1, 2),
            links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
            reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
            SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce((SELECT min(b) FROM reach WHERE a = documents.doc_id), doc_id) AS component_id
            FROM documents LEFT JOIN sizes USING (doc_id)""",
        "op11_sorted_runs": r"""
            WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
            lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM cut),
            keyed AS (SELECT doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
            often AS (SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keep <> doc_id) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE keep IS NULL OR keep = doc_id), '')) AS kept_sha256
            FROM keyed LEFT JOIN often USING (k) GROUP BY doc_id""",
        "op12_tight_arcs": r"""
            WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
            kinds AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, 1 + length(name)), lambda k: CAST(ascii(name[k]) AS BIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind FROM named),
            rows AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
                FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0)),
            placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM rows),
            judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 3
                WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 1 ELSE 0 END AS fault, role[1] AS initial, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY p) AS before FROM placed),
            before(x, z, l, w, t) AS (VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 5, 'user:' || chr(10)), (1, 2, 'I', 5, 'user:' || chr(10)), (2, 3, 'I', 5, 'assistant:' || chr(10)), (3, 2, 'I', 5, 'user:' || chr(10)),
                (0, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 2, 'II', 10, 'assistant:' || chr(10) || 'user:' || chr(10)), (3, 3, 'II', 10, 'user:' || chr(10) || 'assistant:' || chr(10))),
            over_row(z, l, y, w, initial) AS (VALUES (0, 'D', 0, 2, ''), (1, 'D', 1, 2, ''), (2, 'D', 2, 2, ''), (3, 'D', 3, 2, ''), (0, 'K', 1, 0, 's'), (0, 'K', 2, 0, 'u'), (1, 'K', 2, 0, 'u'), (3, 'K', 2, 0, 'u'), (2, 'K', 3, 0, 'a'),
                (0, 'R', 2, 1, ''), (1, 'R', 2, 1, ''), (2, 'R', 3, 1, ''), (3, 'R', 2, 1, '')),
            nodes AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS p, 0 AS z, {'c': CAST(0 AS BIGINT), 'a': '', 'r': ''} AS v FROM conversations
                UNION ALL SELECT n.conv_id, n.p + 1, e.y, min({'c': n.v.c + b.w + e.w + CASE WHEN e.l <> 'D' AND j.fault = 1 THEN 5 ELSE 0 END, 'a': n.v.a || b.l || e.l,
                    'r': n.v.r || b.t || CASE e.l WHEN 'D' THEN '' ELSE CASE WHEN e.l = 'K' THEN j.role WHEN e.y = 2 THEN 'user' ELSE 'assistant' END || ':' || j.text || chr(10) END})
                FROM nodes n JOIN judged j ON j.conv_id IS NOT DISTINCT FROM n.conv_id AND j.p = n.p + 1 JOIN before b ON b.x = n.z JOIN over_row e ON e.z = b.z AND (e.l = 'D' OR j.fault < 2) AND (e.l <> 'K' OR e.initial = j.initial)
                GROUP BY n.conv_id, n.p, e.y),
            sums AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE fault = 2) AS blank, count(*) FILTER (WHERE fault = 3) AS duplicate, count(*) FILTER (WHERE fault = 1) AS truncated,
                count(*) FILTER (WHERE p > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM judged GROUP BY conv_id),
            ends AS (SELECT n.conv_id, min({'c': n.v.c + b.w, 'a': n.v.a || b.l, 'r': n.v.r || b.t}) AS v FROM nodes n LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM n.conv_id JOIN before b ON b.x = n.z AND b.z IN (0, 3) WHERE n.p = coalesce(s.n, 0) GROUP BY n.conv_id)
            SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
                e.v.c AS cost, e.v.a AS audit, sha256(left(e.v.r, CAST(greatest(0, length(e.v.r) - 1) AS BIGINT))) AS repaired_sha256 FROM ends e LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id""",
        "op13_radix_selection": """
            WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            anchors AS (SELECT * FROM rows WHERE vec_id % 100 = 0),
            scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, CAST(list_sum(list_transform(range(1, 1 + len(a.v)), lambda k: a.v[k] * r.v[k])) AS BIGINT) AS score
                FROM anchors a, rows r WHERE a.vec_id <> r.vec_id),
            positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
            ranked AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
                FROM positives JOIN scored USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
            SELECT * FROM ranked WHERE rank <= 5""",
        "op6_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    }
