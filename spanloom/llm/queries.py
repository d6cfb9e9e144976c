"""Registered queries of the operators, each over its whole table, with SQL twins where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spanloom.llm import (
    automata, backoff, bitslice, conversation_repair, kdtree, lemp, mixing, order_minhash, ppm, quality, token_counts, warc, wumanber,
)
from spanloom.llm.common import read, remainder
from spanloom.session import cut_lineage, shared_folder

LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_fair_mix(spark, folder):
    return mixing.mix(read(spark, folder, "documents"), "doc_id", "text", "source")


OP1_SQL = r"""WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '17', coalesce(doc_id::VARCHAR, 'null'))), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496::DOUBLE AS u FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS weight
  FROM docs GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER (
            ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS FIRST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sources),
chosen AS (SELECT level FROM levels WHERE cap >= level * weight ORDER BY cap / weight, level LIMIT 1),
goals AS (
  SELECT source, source_size, budget, least(cap, coalesce((SELECT level FROM chosen) * weight, cap)) AS target FROM levels),
queued AS (
  SELECT d.doc_id, d.source, d.size, d.u, g.source_size, g.target, g.budget, coalesce(sum(d.size) OVER (
           PARTITION BY d.source ORDER BY d.u, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
entries AS (
  SELECT q.*, turn, (before + turn * source_size + size)::DOUBLE / target AS finish
  FROM queued q, (SELECT unnest([0, 1]) AS turn) WHERE turn = 0 OR before + turn * source_size < target),
played AS (
  SELECT *, sum(size) OVER (ORDER BY CASE WHEN target > 0 THEN finish ELSE 0 END, source NULLS LAST, turn, u, doc_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM entries)
SELECT doc_id, size, source_size, target, sum(CASE WHEN upto <= budget THEN size ELSE 0 END)::BIGINT AS taken
FROM played GROUP BY ALL"""


def op2_bit_slices(spark, folder):
    index = bitslice.written_index(read(spark, folder, "embeddings"), "vec_id", "embedding")
    return bitslice.top_k(index, index.where("key % 50 = 0"), 5)


OP2_SQL = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS code FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.code, c.code)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id IS DISTINCT FROM c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5"""


def op3_order_minhash(spark, folder):
    return order_minhash.near_classes(read(spark, folder, "documents"), "doc_id", "text")


def op4_quality(spark, folder):
    stats = cut_lineage(quality.measured(read(spark, folder, "documents"), "doc_id", "text"), "statistics")
    labels = read(spark, folder, "labels").where(~quality.held_out("doc_id"))
    scored = quality.score(stats, quality.fit(stats, labels, "doc_id", "quality"), "doc_id")
    return scored.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_warc_segments(spark, folder):
    """Write the archives, then read every record back."""
    pages = read(spark, folder, "pages")
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(pages, path, "page_id", "url", "html")
    return warc.read_pages(spark, path).select(
        F.col("key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"))


OP5_SQL = """WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""


def crc_sql(key: str) -> str:
    """crc32 of a decimal number as text, in SQL: eight shift-and-xor steps for each character."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_concat([xor(c, ch)], list_resize([0::BIGINT], 8, 0)), lambda x, i: {step})"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({key}::VARCHAR, ''), "
            f"lambda t: ascii(t)::BIGINT)), lambda c, ch: {byte}), 4294967295)")


def op6_backoff_automaton(spark, folder):
    held = remainder("doc_id", 5) == 1
    scored = backoff.score(read(spark, folder, "documents"), "doc_id", "text", held)
    # sums of logarithms in any order agree to the sixth decimal
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


OP6_SQL = rf"""WITH d AS (
  SELECT doc_id, {crc_sql('doc_id')} % 5 = 1 AS held_out,
         list_concat(['END '], coalesce(regexp_extract_all({LOWER_SQL}, '[^\x20\x09-\x0D]+'), []), ['END ']) AS t FROM documents),
steps AS (SELECT doc_id, held_out, t[i] AS u, t[i + 1] AS v FROM (SELECT *, unnest(range(1, len(t))) AS i FROM d)),
words AS (SELECT v, count(*) FILTER (NOT held_out) AS c FROM steps GROUP BY v),
pairs AS (SELECT u, v, count(*) FILTER (NOT held_out) AS c FROM steps GROUP BY u, v),
sums AS (SELECT sum(c)::BIGINT AS n, count(*) FILTER (c > 0) AS k FROM words)
SELECT s.doc_id, s.held_out, count(*) AS n_tokens, count(*) FILTER (w.c > 0) AS n_known, any_value(n) AS train_tokens,
       round(sum(log10((w.c + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (k + 1)))), 6) AS base_score,
       round(sum(log10((p.c + {backoff.STRENGTH}::DOUBLE * ((w.c + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (k + 1))))
                       / (h.c + {backoff.STRENGTH}::DOUBLE))), 6) AS score
FROM steps s JOIN words w ON w.v = s.v JOIN words h ON h.v = s.u JOIN pairs p ON p.u = s.u AND p.v = s.v, sums
GROUP BY s.doc_id, s.held_out"""


def op7_wu_manber(spark, folder):
    found = wumanber.contaminated_spans(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark"))
    hits = wumanber.hit_words(F.col("spans"))
    return found.select(
        "row.doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hits > 0).alias("contaminated"))


OP7_SQL = rf"""WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
patterns AS (
  SELECT DISTINCT item_id, width, array_to_string(w[s : s + width - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 10) AS width, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS s
  FROM d, (SELECT DISTINCT width FROM patterns) WHERE len(w) >= width),
found AS (
  SELECT p.doc_id, p.s, p.width, q.item_id
  FROM (SELECT doc_id, s, width, array_to_string(w[s : s + width - 1], ' ') AS gram FROM places) p
  JOIN patterns q ON p.width = q.width AND p.gram = q.gram),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + width)) AS pos FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""


def op8_ppm_language(spark, folder):
    docs = read(spark, folder, "documents")
    held = remainder("doc_id", 4) == 2
    model = ppm.train(docs.where(~held), "text", "lang", "doc_id")
    found = ppm.predict(docs.select("doc_id", "text"), model, "text", keep=["doc_id"]).select("row.doc_id", "lang_pred", "score")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_kd_shards(spark, folder):
    shards = kdtree.kd_shards(read(spark, folder, "documents"), "doc_id", "text", ["lang", "source"], shards=8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op10_suffix_automata(spark, folder):
    done = automata.remove_repeats(read(spark, folder, "documents"), "doc_id", "text")
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
places AS (
  SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
later AS (SELECT doc_id, s FROM places QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM later),
numbers AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, w[i] AS word, i AS pos FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN numbers USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def op11_lemp_negatives(spark, folder):
    key, label = F.col("vec_id"), F.col("label")
    moved = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    index = lemp.index_rows(read(spark, folder, "embeddings"), "vec_id", "embedding", moved)
    return lemp.hard_negatives(index, index.where("key % 100 = 0"))


OP11_SQL = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS code FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = o.label AS same, o.vec_id, list_inner_product(a.code, o.code)::BIGINT AS score
  FROM v a JOIN v o ON a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM o.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""


def op12_token_counts(spark, folder):
    import public_tokenizers

    counted = token_counts.count_tokens(read(spark, folder, "documents").select("doc_id", "text"), "text",
                                        public_tokenizers.path("piece_bpe_32k.model"))
    size = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("bigint")
    return counted.select("row.doc_id", size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op13_hirschberg_repair(spark, folder):
    rows = conversation_repair.damaged(read(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    done = conversation_repair.repair(rows)
    key = F.when(F.col("id") != "n", F.expr("substring(id, 2)")).cast("bigint")
    return done.select(key.alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


OP13_SQL = rf"""WITH RECURSIVE r AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fate FROM conversations),
d AS (
  SELECT c, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM r WHERE fate <> 0),
n AS MATERIALIZED (
  SELECT *, row_number() OVER (
           PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text), copy) AS i FROM d),
f AS (
  SELECT c, turn, role, text, i, role[1] AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS stop,
         row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS k,
         lag(role[1]) OVER (PARTITION BY c ORDER BY i) AS before FROM n),
g AS (
  SELECT *, stop = '' AS blank, stop <> '' AND k > 1 AS duplicate, stop <> '' AND k = 1 AND stop NOT IN ('.', '!', '?') AS truncated
  FROM f),
closure(p, s, inserts) AS (
  VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
moves(s, edit, q, price, letter) AS (
  VALUES (0, 'D', 0, 4, ''), (1, 'D', 1, 4, ''), (2, 'D', 2, 4, ''), (3, 'D', 3, 4, ''), (0, 'R', 2, 3, ''), (1, 'R', 2, 3, ''),
         (2, 'R', 3, 3, ''), (3, 'R', 2, 3, ''), (0, 'K', 1, 0, 's'), (0, 'K', 2, 0, 'u'), (1, 'K', 2, 0, 'u'), (3, 'K', 2, 0, 'u'),
         (2, 'K', 3, 0, 'a')),
paths AS (
  SELECT DISTINCT c, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM r
  UNION ALL
  SELECT g.c, g.i, m.q, min({{'cost': t.best.cost + 3 * x.inserts + m.price + CASE WHEN truncated AND edit <> 'D' THEN 3 ELSE 0 END,
                             'audit': t.best.audit || repeat('I', x.inserts) || m.edit}})
  FROM paths t JOIN g ON g.c = t.c AND g.i = t.i + 1 JOIN closure x ON x.p = t.q JOIN moves m ON m.s = x.s
  WHERE edit = 'D' OR NOT (blank OR duplicate) AND (edit = 'R' OR letter = initial)
  GROUP BY g.c, g.i, m.q),
totals AS (
  SELECT c, max(i) AS n, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps FROM g GROUP BY c),
chosen AS (
  SELECT p.c, min({{'cost': p.best.cost + 3 * e.n, 'audit': p.best.audit || repeat('I', e.n)}}) AS best
  FROM paths p JOIN totals t ON t.c = p.c AND t.n = p.i JOIN (VALUES (0, 0), (1, 2), (2, 1), (3, 0)) e(q, n) ON e.q = p.q GROUP BY p.c),
letters AS (
  SELECT c, place, audit[place] AS edit, len(replace(audit[1 : place], 'I', '')) AS i
  FROM (SELECT c, best.audit AS audit, unnest(range(1, len(best.audit) + 1)) AS place FROM chosen)),
lines AS (
  SELECT l.c, place, edit, CASE WHEN edit = 'I' THEN '' ELSE g.text END AS text, g.role,
         row_number() OVER (PARTITION BY l.c ORDER BY place) - 1 AS nth,
         edit = 'K' AND g.initial = 's' AS opening
  FROM letters l LEFT JOIN g ON g.c = l.c AND g.i = l.i WHERE edit <> 'D'),
spoken AS (
  SELECT c, place, text, CASE WHEN edit = 'K' THEN role WHEN (nth - max(opening::INTEGER) OVER (PARTITION BY c)) % 2 = 0 THEN 'user'
                              ELSE 'assistant' END AS role FROM lines),
mended AS (SELECT c, string_agg(role || ':' || text, chr(10) ORDER BY place) AS body FROM spoken GROUP BY c)
SELECT DISTINCT r.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM r LEFT JOIN totals USING (c) LEFT JOIN chosen USING (c) LEFT JOIN mended USING (c)"""


QUERIES = {
    "op1_fair_mix": (op1_fair_mix, OP1_SQL),
    "op2_bit_slices": (op2_bit_slices, OP2_SQL),
    "op3_order_minhash": (op3_order_minhash, None),
    "op4_quality": (op4_quality, None),
    "op5_warc_segments": (op5_warc_segments, OP5_SQL),
    "op6_backoff_automaton": (op6_backoff_automaton, OP6_SQL),
    "op7_wu_manber": (op7_wu_manber, OP7_SQL),
    "op8_ppm_language": (op8_ppm_language, None),
    "op9_kd_shards": (op9_kd_shards, None),
    "op10_suffix_automata": (op10_suffix_automata, OP10_SQL),
    "op11_lemp_negatives": (op11_lemp_negatives, OP11_SQL),
    "op12_token_counts": (op12_token_counts, None),
    "op13_hirschberg_repair": (op13_hirschberg_repair, OP13_SQL),
}
