"""Neighbours, combinations and similarity summaries over the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.randomness import cumulative, softmax
from spanloom.operators import combinations as C
from spanloom.operators import neighbours as N
from spanloom.operators import similarity as S
from spanloom.session import cut_lineage
from suite.common import (
    BALANCED_DRAWS_SQL, SIZES, TAXONOMY_SQL, combos_sql, gumbel_sql, joined, neighbours_sql, popularity, read,
    size_sql, taxonomy, u_sql,
)

K, NEAR = 20, 0.2
CATEGORY_K, CATEGORY_NEAR = 5, 0.1


def knn_topk(spark, folder):
    return N.nearest(taxonomy(spark, folder), K, NEAR)


KNN_SQL = f"WITH {neighbours_sql(K, NEAR)} SELECT anchor, neighbour, sim, rank::INTEGER AS rank FROM nn"


def knn_per_category(spark, folder):
    return N.nearest_per_category(taxonomy(spark, folder), "category", CATEGORY_K, CATEGORY_NEAR)


CATEGORY_NN_SQL = f"""{TAXONOMY_SQL},
cnn AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor, category ORDER BY sim DESC, neighbour) AS rank FROM sims)
  WHERE rank <= {CATEGORY_K} AND sim > {CATEGORY_NEAR})"""
KNN_CATEGORY_SQL = f"WITH {CATEGORY_NN_SQL} SELECT anchor, category, neighbour, sim, rank::INTEGER AS rank FROM cnn"


def knn_topk_blocked(spark, folder):
    """The same search cut into blocks, as for a taxonomy too large to be sent to every task."""
    return N.nearest(taxonomy(spark, folder), K, NEAR, broadcast_rows=0, block_rows=200)


def knn_open_blocked(spark, folder):
    """Without a threshold and cut into blocks: a first pass bounds each name's k-th best, a second meets what is left."""
    return N.nearest(taxonomy(spark, folder), K, broadcast_rows=0, block_rows=200)


OPEN_SQL = f"WITH {neighbours_sql(K, -2.0)} SELECT anchor, neighbour, sim, rank::INTEGER AS rank FROM nn"


def lists(spark, folder, weighted=True, near=None):
    near = N.nearest(taxonomy(spark, folder), K, NEAR) if near is None else near.where(F.col("sim") > NEAR)
    return C.neighbour_lists(near, popularity(spark, folder) if weighted else None)


def combos(spark, folder, near=None):
    """Every name is drawn in two rounds; ``near`` is a search made before, without threshold."""
    tax = taxonomy(spark, folder)
    draws = C.balanced_numbered_draws(tax, 2 * tax.count())
    return C.combine(draws, lists(spark, folder, near=near), SIZES)


def shown(df):
    return df.select("draw_id", "anchor", joined("members").alias("members"), "size")


def balanced_combos(spark, folder):
    return shown(combos(spark, folder))


COMBOS_SQL = f"{neighbours_sql(K, NEAR)},\n{BALANCED_DRAWS_SQL},\n{combos_sql()}"
SHOWN_SQL = "SELECT draw_id::BIGINT AS draw_id, anchor, array_to_string(members, '|') AS members, len(members)::INTEGER AS size FROM combos"


def combo_size_hist(spark, folder):
    return C.size_histogram(combos(spark, folder))


def stochastic_combos(spark, folder, temperature=5.0):
    scores = popularity(spark, folder)
    draws = C.stochastic_draws(scores, 2 * scores.count(), temperature=temperature)
    return shown(C.combine(draws, lists(spark, folder), SIZES))


STOCHASTIC_SQL = f"""WITH {neighbours_sql(K, NEAR)},
weights AS (
  SELECT name, greatest(1, floor(exp(((SELECT min(score) FROM tax) - score) / 5.0::DOUBLE) * 1125899906842624::DOUBLE)::HUGEINT) AS w,
         {u_sql("'cdf'", 'name')} AS o FROM tax),
edges AS (SELECT name, w, sum(w) OVER (ORDER BY o, name) AS hi FROM weights),
total AS (SELECT sum(w)::HUGEINT AS t FROM weights),
aimed AS (
  SELECT id AS draw_id, least(floor({u_sql(42, "'anchor'", 'id')} * t::DOUBLE)::HUGEINT, t - 1) AS aim
  FROM (SELECT unnest(range((SELECT 2 * count(*) FROM tax))) AS id), total),
draws AS (SELECT draw_id, name AS anchor FROM aimed JOIN edges ON aim >= hi - w AND aim < hi),
{combos_sql()}
{SHOWN_SQL}"""


def name_weights(spark, folder):
    """Every name keeps a chance, even far below the best one."""
    scores = popularity(spark, folder)
    return C.draw_weights(scores, 1.0).select("name", F.col("w").cast("string").alias("weight"))


WEIGHTS_SQL = f"""WITH {TAXONOMY_SQL}
SELECT name, greatest(1, floor(exp((SELECT min(score) FROM tax) - score) * 1125899906842624::DOUBLE)::HUGEINT)::VARCHAR AS weight FROM tax"""


def subset_combos(spark, folder):
    tax = taxonomy(spark, folder)
    draws = C.balanced_draws(tax, tax.count() // 2)
    return shown(C.combine(draws, lists(spark, folder, weighted=False), SIZES, frequency_select=False))


SUBSET_SQL = f"""WITH {neighbours_sql(K, NEAR)},
draws AS (
  SELECT * FROM (SELECT row_number() OVER (ORDER BY {u_sql(42, 'name')}, name) - 1 AS draw_id, name AS anchor FROM tax)
  WHERE draw_id < (SELECT count(*) // 2 FROM tax)),
{combos_sql(by_popularity=False)}
{SHOWN_SQL}"""


def category_affinity(spark, folder):
    rows = S.category_affinity(taxonomy(spark, folder))
    return rows.select("category", "other", F.round("mean_sim", 9).alias("mean_sim"), F.round("p", 9).alias("p"))


AFFINITY_CTE = f"""raw AS (
  SELECT a.category, b.category AS other, avg(list_cosine_similarity(a.e, b.e)) AS m
  FROM tax a JOIN tax b ON a.name <> b.name GROUP BY ALL),
affinity AS (
  SELECT category, other, m, exp(m / 0.1::DOUBLE) / sum(exp(m / 0.1::DOUBLE)) OVER (PARTITION BY category) AS p FROM raw)"""
AFFINITY_SQL = f"""WITH {TAXONOMY_SQL}, {AFFINITY_CTE}
SELECT category, other, round(m, 9) AS mean_sim, round(p, 9) AS p FROM affinity"""


def diverse(spark, folder, weighted):
    tax = taxonomy(spark, folder)
    draws = C.balanced_numbered_draws(tax, 2 * tax.count())
    near = lambda pairs: N.nearest_of_pairs(pairs, tax, "category", CATEGORY_K, CATEGORY_NEAR)
    scores = popularity(spark, folder) if weighted else None
    return shown(C.diverse_combinations(draws, tax, near, S.category_affinity(tax), SIZES, scores))


def diverse_sql(weighted):
    order = gumbel_sql("-c.score", 42, "'pick'", "s.draw_id", "c.neighbour") + " DESC, c.neighbour" if weighted else "c.rank"
    return f"""WITH {CATEGORY_NN_SQL}, {AFFINITY_CTE}, {BALANCED_DRAWS_SQL},
cdf AS (SELECT category, other, sum(p) OVER (PARTITION BY category ORDER BY other) AS hi, p FROM affinity),
slots AS (
  SELECT d.draw_id, d.anchor, tax.category, unnest(range(1, {size_sql('d.draw_id')})) AS slot
  FROM draws d JOIN tax ON tax.name = d.anchor),
aimed AS (SELECT *, {u_sql(42, "'slot'", 'draw_id', 'slot')} AS u FROM slots),
chosen AS (
  SELECT draw_id, anchor, slot, other AS slot_category,
         row_number() OVER (PARTITION BY draw_id, other ORDER BY slot) AS turn
  FROM aimed JOIN cdf ON cdf.category = aimed.category AND u >= hi - p AND u < hi),
ranked AS (
  SELECT DISTINCT s.draw_id, s.slot_category, c.neighbour, {order.split(' DESC')[0]} AS o
  FROM chosen s JOIN cnn c ON c.anchor = s.anchor AND c.category = s.slot_category),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY draw_id, slot_category ORDER BY o {'DESC' if weighted else ''}, neighbour) AS turn
  FROM ranked),
got AS (
  SELECT s.draw_id, list(p.neighbour ORDER BY s.slot) AS more
  FROM chosen s JOIN placed p USING (draw_id, slot_category, turn) GROUP BY s.draw_id),
combos AS (
  SELECT d.draw_id, d.anchor, list_concat([d.anchor], coalesce(g.more, [])) AS members
  FROM draws d LEFT JOIN got g USING (draw_id))
{SHOWN_SQL}"""


def words_to_avoid(spark, folder):
    near = cut_lineage(N.nearest(taxonomy(spark, folder), K), "near")
    out = N.neighbours_outside(combos(spark, folder, near), taxonomy(spark, folder), near=near)
    return out.select("draw_id", joined("avoid").alias("avoid"))


AVOID_CTE = """two AS (
  SELECT anchor, neighbour FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY sim DESC, neighbour) AS r FROM sims) WHERE r <= 2),
member AS (SELECT draw_id, members, unnest(members) AS anchor FROM combos),
outside AS (
  SELECT DISTINCT draw_id, neighbour FROM member JOIN two USING (anchor) WHERE NOT list_contains(members, neighbour)),
avoid AS (
  SELECT c.draw_id, coalesce(list(o.neighbour ORDER BY o.neighbour) FILTER (o.neighbour IS NOT NULL), []) AS avoid
  FROM combos c LEFT JOIN outside o USING (draw_id) GROUP BY c.draw_id)"""
AVOID_SQL = f"""WITH {COMBOS_SQL}, {AVOID_CTE}
SELECT draw_id::BIGINT AS draw_id, array_to_string(avoid, '|') AS avoid FROM avoid"""


def references(spark, folder):
    return read(spark, folder, "embeddings").join(
        read(spark, folder, "benchmark").select(F.col("item_id").alias("vec_id"), "text"), "vec_id"
    ).select(F.col("vec_id").alias("reference_id"), "embedding")


def reference_shots(spark, folder):
    found = N.nearest_references(combos(spark, folder), taxonomy(spark, folder), references(spark, folder), 3, 0.05)
    return found.select("draw_id", "reference_id", "sim", "rank")


REFERENCE_SQL = f"""WITH {COMBOS_SQL},
refs AS (SELECT vec_id AS reference_id, embedding::DOUBLE[] AS e FROM embeddings JOIN benchmark ON item_id = vec_id),
scored AS (
  SELECT m.draw_id, r.reference_id, round(avg(list_cosine_similarity(t.e, r.e)), 9) AS sim
  FROM (SELECT draw_id, unnest(members) AS name FROM combos) m JOIN tax t USING (name), refs r GROUP BY ALL)
SELECT draw_id::BIGINT AS draw_id, reference_id, sim, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY draw_id ORDER BY sim DESC, reference_id)::INTEGER AS rank FROM scored)
WHERE rank <= 3 AND sim > 0.05"""


def intra_label_similarity(spark, folder):
    rows = S.pair_similarity_by_label(taxonomy(spark, folder), "category")
    return rows.select("category", F.round("intra_sim", 9).alias("intra_sim"), "n")


INTRA_SQL = f"""WITH {TAXONOMY_SQL},
sizes AS (SELECT category, count(*) AS n FROM tax GROUP BY category),
pairs AS (
  SELECT a.category, sum(list_cosine_similarity(a.e, b.e)) AS total
  FROM tax a JOIN tax b ON a.category = b.category AND a.name < b.name GROUP BY a.category)
SELECT category, round(coalesce(total, 0) / (n * n)::DOUBLE, 9) AS intra_sim, n FROM sizes LEFT JOIN pairs USING (category)"""


def pairwise_diversity(spark, folder):
    return S.pair_similarity_histogram(taxonomy(spark, folder), 40, "name").select("bin", F.round("low", 9).alias("low"), "pairs")


DIVERSITY_SQL = f"""WITH {TAXONOMY_SQL}
SELECT least(floor((sim + 1) * 20), 39)::INTEGER AS bin, round(least(floor((sim + 1) * 20), 39) * 0.05::DOUBLE - 1, 9) AS low,
       count(*) AS pairs
FROM sims WHERE anchor < neighbour AND sim <> 0 GROUP BY ALL"""


def mean_diversity(spark, folder):
    return S.mean_pair_similarity(taxonomy(spark, folder)).select("n", "pairs", F.round("mean_sim", 9).alias("mean_sim"))


MEAN_SQL = f"""WITH {TAXONOMY_SQL}
SELECT (SELECT count(*) FROM tax) AS n, count(*) AS pairs,
       round((SELECT avg(list_cosine_similarity(a.e, b.e)) FROM tax a JOIN tax b ON a.name < b.name), 9) AS mean_sim
FROM sims WHERE anchor < neighbour"""


QUANTILES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def diversity_quantiles(spark, folder):
    """Exact quantiles of the similarity of all pairs."""
    found = S.pair_similarity_quantiles(taxonomy(spark, folder), QUANTILES, "name")
    return found.select("quantile", F.round("sim", 9).alias("sim"))


QUANTILES_SQL = f"""WITH {TAXONOMY_SQL},
q AS (SELECT unnest({QUANTILES}::DOUBLE[]) AS quantile),
held AS (SELECT list(sim ORDER BY sim) AS l, count(*) AS n FROM sims WHERE anchor < neighbour AND sim <> 0),
placed AS (SELECT quantile, l, quantile * (n - 1) AS place FROM q, held)
SELECT quantile, round(l[floor(place)::BIGINT + 1] + (l[ceil(place)::BIGINT + 1] - l[floor(place)::BIGINT + 1]) * (place - floor(place)), 9) AS sim
FROM placed"""


def sentence_label_similarity(spark, folder):
    """Each vector against the vector its label points to; some labels name no entity."""
    rows = read(spark, folder, "embeddings").select(
        "vec_id", "embedding", F.concat(F.lit("v"), (F.col("label") * 67 + F.floor(F.col("vec_id") / 3))).alias("label")
    )
    out = S.sentence_label_similarity(rows, taxonomy(spark, folder))
    return out.select("vec_id", "label", F.round("sim", 9).alias("sim"))


SENTENCE_LABEL_SQL = f"""WITH {TAXONOMY_SQL},
rows AS (SELECT vec_id, embedding::DOUBLE[] AS e, 'v' || (label * 67 + vec_id // 3) AS label FROM embeddings)
SELECT r.vec_id, r.label, round(list_cosine_similarity(r.e, t.e), 9) AS sim FROM rows r LEFT JOIN tax t ON t.name = r.label"""


def popularity_softmax(spark, folder):
    """Share of each name within its category, popular names (low scores) first."""
    rows = taxonomy(spark, folder).join(popularity(spark, folder), "name")
    share = C.with_softmax(rows, -F.col("score"), "p", ["category"], 5.0)
    return share.select("name", F.round("p", 9).alias("p"))


SOFTMAX_SQL = f"""WITH {TAXONOMY_SQL}
SELECT name, round(exp(-score / 5) / sum(exp(-score / 5)) OVER (PARTITION BY category), 9) AS p FROM tax"""


def capped_combos(spark, folder):
    """At most two members besides the anchor; sizes by uneven weights and a temperature."""
    tax = taxonomy(spark, folder)
    draws = C.balanced_numbered_draws(tax, tax.count())
    made = C.combine(draws, lists(spark, folder), [3.0, 1.0, 1.0, 2.0], temperature_size=0.2, upper_bound=2)
    return C.size_histogram(made.join(tax.select(F.col("name").alias("anchor"), "category"), "anchor"), by=["category"])


def _capped_sql():
    edges = cumulative(softmax(softmax([3.0, 1.0, 1.0, 2.0]), 0.2))[:-1]
    u = u_sql(42, "'size'", "draw_id")
    size = " + ".join(["1"] + [f"({u} >= {e!r}::DOUBLE)::INTEGER" for e in edges])
    return f"""WITH {neighbours_sql(K, NEAR)},
draws AS (SELECT row_number() OVER (ORDER BY {u_sql(42, 0, 'name')}, name) - 1 AS draw_id, name AS anchor, category FROM tax),
near AS (SELECT anchor, count(*) AS n FROM nn GROUP BY anchor)
SELECT category, (1 + least({size} - 1, 2, coalesce(n, 0)))::INTEGER AS size, count(*) AS combinations
FROM draws LEFT JOIN near USING (anchor) GROUP BY ALL"""


QUERIES = {
    "popularity_softmax": (popularity_softmax, SOFTMAX_SQL),
    "capped_combos": (capped_combos, _capped_sql()),
    "knn_topk": (knn_topk, KNN_SQL),
    "knn_topk_blocked": (knn_topk_blocked, KNN_SQL),
    "knn_open_blocked": (knn_open_blocked, OPEN_SQL),
    "knn_per_category": (knn_per_category, KNN_CATEGORY_SQL),
    "balanced_combos": (balanced_combos, f"WITH {COMBOS_SQL}\n{SHOWN_SQL}"),
    "stochastic_combos": (stochastic_combos, STOCHASTIC_SQL),
    "stochastic_combos_cold": (lambda s, f: stochastic_combos(s, f, 1.0), STOCHASTIC_SQL.replace("5.0::DOUBLE", "1.0::DOUBLE")),
    "name_weights": (name_weights, WEIGHTS_SQL),
    "subset_combos": (subset_combos, SUBSET_SQL),
    "combo_size_hist": (
        combo_size_hist,
        f"WITH {COMBOS_SQL}\nSELECT len(members)::INTEGER AS size, count(*) AS combinations FROM combos GROUP BY ALL",
    ),
    "category_affinity": (category_affinity, AFFINITY_SQL),
    "diverse_combos": (lambda s, f: diverse(s, f, False), diverse_sql(False)),
    "diverse_combos_weighted": (lambda s, f: diverse(s, f, True), diverse_sql(True)),
    "words_to_avoid": (words_to_avoid, AVOID_SQL),
    "reference_shots": (reference_shots, REFERENCE_SQL),
    "intra_label_similarity": (intra_label_similarity, INTRA_SQL),
    "pairwise_diversity": (pairwise_diversity, DIVERSITY_SQL),
    "mean_diversity": (mean_diversity, MEAN_SQL),
    "diversity_quantiles": (diversity_quantiles, QUANTILES_SQL),
    "sentence_label_similarity": (sentence_label_similarity, SENTENCE_LABEL_SQL),
}
