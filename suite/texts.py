"""Text expressions, taxonomy tables, tags and perplexity."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import fuzzy as Z
from spanloom.functions import text as X
from spanloom.operators import embedding as E
from spanloom.operators import fidelity as P
from spanloom.operators import tagging as G
from spanloom.operators import taxonomy as T
from suite.common import MESSAGES_SQL, joined, messages, ratio_sql, read, texts, token_set_sql

# RE2 classes that match what the Unicode-aware patterns match in Spark
W = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
SPACES = r"\s\x{0B}\x{1c}-\x{1f}\x{85}\p{Z}"


def drop_short(spark, folder):
    docs = read(spark, folder, "documents")
    return X.drop_short_text(docs, "text", 100).select("doc_id", X.word_count("text").alias("words"))


DROP_SHORT_SQL = f"""SELECT doc_id, words FROM (
  SELECT doc_id, len(regexp_extract_all(text, '[^{SPACES}]+'))::INTEGER AS words FROM documents) WHERE words > 100"""


def strip_html(spark, folder):
    return read(spark, folder, "pages").select("page_id", X.replace_html_tags("html").alias("text"))


STRIP_HTML_SQL = """SELECT page_id, array_to_string(list_transform(regexp_split_to_array(html, '<[^\n]*?>'),
  lambda p, i: CASE WHEN i = 1 THEN p WHEN (i - 1) % 10 = 0 THEN '. ' || p ELSE ' ' || p END), '') AS text FROM pages"""


def clean_text(spark, folder):
    """Documents with their line ends written out as backslash-n."""
    raw = F.replace("text", F.lit("\n"), F.lit("\\n"))
    return texts(spark, folder).select("doc_id", X.clean_text(raw).alias("text"))


CLEAN_SQL = rf"""SELECT doc_id, replace(regexp_replace(regexp_replace(
  replace(replace(text, chr(10), '\n'), '\n', '. '), '^[{SPACES}]+', ''), '[{SPACES}]+$', ''), '..', '.') AS text FROM documents"""


def anonymize(spark, folder):
    return texts(spark, folder).select("doc_id", X.anonymize_text("text").alias("text"))


# RE2 has ASCII word boundaries only: letters beyond ASCII are spelled as _x<code>_ while the patterns run
ANONYMIZE_SQL = r"""WITH letters AS (
  SELECT list(DISTINCT c) AS l FROM (SELECT unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS c FROM documents)
  WHERE regexp_matches(c, '[\p{L}\p{M}\p{Nd}]')),
spelled AS (
  SELECT doc_id, l, list_reduce(list_concat([text], coalesce(l, [])), lambda t, c: replace(t, c, '_x' || unicode(c) || '_')) AS t
  FROM documents, letters),
masked AS (
  SELECT doc_id, l, regexp_replace(regexp_replace(regexp_replace(t,
    '\b[A-Z][a-z]*\s[A-Z][a-z]*\b', 'REDACTED_NAME', 'g'), '\b\d{10,12}\b', 'REDACTED_PHONE', 'g'),
    '\b[\w\.-]+@[\w\.-]+\.\w+\b', 'REDACTED_EMAIL', 'g') AS t FROM spelled)
SELECT doc_id, list_reduce(list_concat([t], coalesce(l, [])), lambda t, c: replace(t, '_x' || unicode(c) || '_', c)) AS text
FROM masked"""


def marked(spark, folder):
    return messages(spark, folder).withColumn("marked", X.annotate_spans("text", "mentions"))


MARKED_SQL = f"""WITH {MESSAGES_SQL},
marked AS (
  SELECT *, list_reduce(list_concat([text], mentions), lambda acc, s: replace(acc, s, '@@' || s || '##')) AS marked
  FROM msgs)"""


def annotate_and_extract(spark, folder):
    return marked(spark, folder).select("record_id", "marked", joined(X.extract_spans("marked")).alias("spans"))


ANNOTATE_SQL = rf"""{MARKED_SQL}
SELECT record_id, marked,
       array_to_string(list_transform(regexp_extract_all(marked, '@@([^\n]*?)##', 1), lambda s: lower(s)), '|') AS spans
FROM marked"""


def annotation_status(spark, folder):
    rows = marked(spark, folder)
    opened = F.replace("marked", F.lit("##"), F.lit("@@"))
    whole = F.concat(F.lit(" @@"), "text", F.lit("## "))
    return rows.select(
        "record_id", X.annotation_status("text").alias("plain"), X.annotation_status("marked").alias("marked"),
        X.annotation_status(opened).alias("opened"), X.covers_whole_sentence(whole).alias("whole"),
    )


STATUS = """CASE WHEN NOT contains({0}, '@@') AND NOT contains({0}, '##') THEN 'NO-ANNOT'
            WHEN contains({0}, '@@') AND NOT contains({0}, '##') THEN 'BAD-BOUNDS' ELSE 'OK' END"""
STATUS_SQL = f"""{MARKED_SQL}
SELECT record_id, {STATUS.format('text')} AS plain, {STATUS.format('marked')} AS marked,
       {STATUS.format("replace(marked, '##', '@@')")} AS opened,
       text <> '' AND NOT contains(text, '@@') AND NOT contains(text, '##') AS whole
FROM marked"""


def parts(spark, folder):
    """Parts as taxonomy rows with gaps in the deeper levels."""
    part = read(spark, folder, "part")
    return part.select(
        F.col("p_partkey").alias("unique_id"), F.concat(F.lit("e"), "p_partkey").alias("element_id"),
        F.col("p_type").alias("level1"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("level2"),
        F.when(F.col("p_size") > 20, F.col("p_name")).alias("level3"),
        F.when(F.col("p_size") > 40, F.concat_ws(" ", "p_brand", "p_name")).alias("level4"),
        F.col("p_name").alias("example"), F.when(F.col("p_retailprice") > 901, F.col("p_type")).alias("definition"),
        F.col("p_name").alias("name"), "p_size",
    )


PARTS_SQL = """parts AS (
  SELECT p_partkey AS unique_id, 'e' || p_partkey AS element_id, p_type AS level1,
         CASE WHEN p_size > 10 THEN p_brand END AS level2, CASE WHEN p_size > 20 THEN p_name END AS level3,
         CASE WHEN p_size > 40 THEN p_brand || ' ' || p_name END AS level4, p_name AS example,
         CASE WHEN p_retailprice > 901 THEN p_type END AS definition, p_name AS name, p_size
  FROM part)"""


def merge_taxonomy(spark, folder):
    rows = parts(spark, folder)
    merged = T.merge_taxonomies(rows.where("p_size < 25"), rows.where("p_size >= 25"))
    return merged.select("name", "unique_id", "level1", "p_size")


MERGE_SQL = f"""WITH {PARTS_SQL}
SELECT name, unique_id, level1, p_size FROM parts
QUALIFY row_number() OVER (PARTITION BY name ORDER BY p_size >= 25, unique_id) = 1"""


def complete_taxonomy(spark, folder):
    return T.complete_taxonomy(parts(spark, folder))


COMPLETE_SQL = f"""WITH {PARTS_SQL}
SELECT unique_id, element_id, level1, level2, level3, level4, example, definition,
       concat_ws(': ', level2, level3, level4, definition) AS name_definition
FROM parts WHERE definition IS NOT NULL AND level2 IS NOT NULL"""


def lowest_level(spark, folder):
    named = [(f"level{i}", f"Type Level {i}") for i in range(1, 5)]
    return parts(spark, folder).select("unique_id", X.lowest_level(*named).alias("lowest"))


LOWEST_SQL = f"""WITH {PARTS_SQL}
SELECT unique_id, coalesce(level4 || '_Type Level 4', level3 || '_Type Level 3', level2 || '_Type Level 2',
                           level1 || '_Type Level 1') AS lowest FROM parts"""


def clean_alt_names(spark, folder):
    raw = F.concat(
        F.when(F.col("p_size") > 25, "Other names: ").otherwise(""), F.lit("1. "), "p_type", F.lit("\n2. "), "p_brand",
        F.lit(", "), "p_name", F.lit(" kit, "), "p_type", F.lit(", , a b c d e f g h i j"),
    )
    return read(spark, folder, "part").select("p_partkey", X.clean_alternative_names("p_name", raw).alias("names"))


ALT_SQL = r"""WITH raw AS (
  SELECT p_partkey, p_name, (CASE WHEN p_size > 25 THEN 'Other names: ' ELSE '' END) || '1. ' || p_type || chr(10) || '2. ' ||
         p_brand || ', ' || p_name || ' kit, ' || p_type || ', , a b c d e f g h i j' AS t FROM part),
flat AS (SELECT p_partkey, p_name, replace(t, chr(10), ', ') AS t FROM raw),
body AS (SELECT p_partkey, p_name, CASE WHEN contains(t, ':') THEN split_part(t, ':', 2) ELSE t END AS t FROM flat),
names AS (SELECT p_partkey, p_name, string_split(regexp_replace(t, '\d+\. ', '', 'g'), ', ') AS l FROM body),
one AS (SELECT p_partkey, p_name, unnest(l) AS n, unnest(range(len(l))) AS i FROM names),
kept AS (
  SELECT p_partkey, n, min(i) AS i FROM one
  WHERE n <> '' AND NOT contains(n, p_name) AND len(regexp_extract_all(n, '\S+')) < 10 GROUP BY ALL)
SELECT p_partkey, coalesce(string_agg(n, ', ' ORDER BY i), '') AS names FROM part LEFT JOIN kept USING (p_partkey) GROUP BY p_partkey"""

WORD = "[a-z]{5,}"


def keyword_tag(spark, folder):
    """Words and word pairs of the benchmark as the dictionary, looked up in all documents."""
    items = read(spark, folder, "benchmark")
    found = items.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), 0)).alias("w")).distinct()
    size = F.length("w")
    singles = found.where(size >= 6).select(
        F.when(size == 6, "Languages").when(size == 7, "Certifications").otherwise("Technologies").alias("level1"),
        F.col("w").alias("level2"))
    pairs = items.select(F.lit("Phrases").alias("level1"), F.regexp_extract("text", "[a-z]+ [a-z]+", 0).alias("level2"))
    short = found.where(size == 5).select(
        F.upper(F.substring("w", 1, 2)).alias("level2"), F.concat("w", F.lit(", x"), "w").alias("alternative_names_clean"))
    tags = G.keyword_tags(
        texts(spark, folder), "doc_id", "text", singles.unionByName(pairs).where("level2 <> ''"),
        {"Technologies": short}, "job")
    return tags.select("doc_id", "tag", joined("values").alias("found"))


KEYWORD_SQL = rf"""WITH found AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{WORD}')) AS w FROM benchmark),
entries AS (
  SELECT w AS term, CASE length(w) WHEN 6 THEN 'Languages' WHEN 7 THEN 'Certifications' ELSE 'Technologies' END AS tag, w AS v
  FROM found WHERE length(w) >= 6
  UNION SELECT regexp_extract(text, '[a-z]+ [a-z]+'), 'Phrases', regexp_extract(text, '[a-z]+ [a-z]+') FROM benchmark
  UNION SELECT t, 'Technologies', upper(substr(w, 1, 2)) FROM (SELECT w, unnest([w, 'x' || w]) AS t FROM found WHERE length(w) = 5)
  UNION SELECT t, 'Technologies_alternative_names', t FROM (SELECT unnest([w, 'x' || w]) AS t FROM found WHERE length(w) = 5)),
atoms AS (SELECT doc_id, regexp_extract_all(text, '{W}+[#+]*|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+') AS a FROM documents),
places AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM atoms),
grams AS (
  SELECT doc_id, i, a[i] AS g FROM places WHERE regexp_matches(a[i], '^{W}')
  UNION ALL SELECT doc_id, i, a[i] || a[i + 1] || a[i + 2] FROM places WHERE regexp_matches(a[i], '^{W}') AND i + 2 <= len(a)),
hits AS (SELECT doc_id, tag, v, i FROM grams JOIN entries ON term = g)
SELECT doc_id, tag, CASE WHEN starts_with(tag, 'Technologies')
         THEN array_to_string(list_sort(list_distinct(list(v))), '|') ELSE array_to_string(list(v ORDER BY i, v), '|') END AS found
FROM hits GROUP BY doc_id, tag"""

SIGNED = [".NET", "(ISC)2", "C#", "ASP.NET", "(en)", "net.", "R&D", "the,", "et de", "in.", ", die", "y, la"]


def signed_terms(spark, folder):
    """Terms that start, end or hold signs, in all documents and in a sentence before each; those glued to a word are no hits."""
    docs = texts(spark, folder).select("doc_id", F.concat(
        F.lit("(ISC)2 or .NET, ASP.NET, C# (but not C), (ISC)23, R&D, R&D. ("), "lang", F.lit(")\n"), "text").alias("text"))
    terms = spark.sql("SELECT explode(array(" + ", ".join(f"'{t}'" for t in SIGNED) + ")) AS term")
    found = G.term_hits(docs, "doc_id", "text", terms)
    return found.groupBy("doc_id", "term").agg(F.count("*").alias("hits"))


SIGNED_SQL = rf"""WITH d AS (
  SELECT doc_id, '(ISC)2 or .NET, ASP.NET, C# (but not C), (ISC)23, R&D, R&D. (' || lang || ')' || chr(10) || text AS t FROM documents),
terms(term, lead, words, tail) AS (
  VALUES ('.NET', '.', 'NET', ''), ('(ISC)2', '(', 'ISC)2', ''), ('C#', '', 'C#', ''), ('ASP.NET', '', 'ASP.NET', ''), ('(en)', '(', 'en', ')'),
         ('net.', '', 'net', '.'), ('R&D', '', 'R&D', ''), ('the,', '', 'the', ','), ('et de', '', 'et de', ''), ('in.', '', 'in', '.'),
         (', die', ', ', 'die', ''), ('y, la', '', 'y, la', '')),
cut AS (
  SELECT doc_id, regexp_extract(t, '^[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+') AS ahead,
         regexp_extract_all(regexp_replace(t, '^[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+', ''), '{W}+[#+]*|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+') AS a FROM d),
places AS (SELECT doc_id, ahead, a, unnest(range(1, len(a) + 1, 2)) AS i FROM cut),
grams AS (
  SELECT doc_id, a[i] AS g, CASE WHEN i > 1 THEN a[i - 1] ELSE ahead END AS before, i = 1 AS first, coalesce(a[i + 1], '') AS after,
         i + 1 >= len(a) AS last FROM places
  UNION ALL SELECT doc_id, a[i] || a[i + 1] || a[i + 2], CASE WHEN i > 1 THEN a[i - 1] ELSE ahead END, i = 1, coalesce(a[i + 3], ''),
         i + 3 >= len(a) FROM places WHERE i + 2 <= len(a))
SELECT doc_id, term, count(*) AS hits FROM grams JOIN terms ON g = words
WHERE (lead = '' OR ends_with(before, lead) AND (len(before) > len(lead) OR first))
  AND (tail = '' OR starts_with(after, tail) AND (len(after) > len(tail) OR last))
GROUP BY ALL"""

PRICES = {"system": (1.5e-6, 2e-6), "user": (3e-5, 6e-5), "assistant": (2e-5, 2e-5)}


def cost_by_model(spark, folder):
    """Each role stands for a model; words stand for tokens."""
    rows = read(spark, folder, "conversations")
    cost = X.token_cost(F.col("role"), X.word_count("text"), F.length("text"), PRICES)
    return rows.groupBy(F.col("role").alias("model")).agg(F.round(F.sum(cost), 6).alias("cost"), F.count("*").alias("requests"))


COST_SQL = f"""WITH prices(model, i, o) AS (VALUES {', '.join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, (i, o) in PRICES.items())})
SELECT model, round(sum(len(regexp_extract_all(text, '[^{SPACES}]+')) * i + length(text) * o), 6) AS cost, count(*) AS requests
FROM conversations JOIN prices ON model = role GROUP BY model"""


def bigram_perplexity(spark, folder):
    rows = P.ngram_perplexity(texts(spark, folder), "doc_id", "text")
    return rows.select("doc_id", "tokens", F.round("perplexity", 4).alias("perplexity"))


PERPLEXITY_CTE = f"""tokens AS (SELECT doc_id, list_concat(['<s>'], regexp_extract_all(lower(text), '[^{SPACES}]+')) AS t FROM documents),
places AS (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM tokens),
counts AS (SELECT doc_id, t[i] AS w1, t[i + 1] AS w2, count(*) AS n FROM places GROUP BY ALL),
pairs AS (SELECT w1, w2, sum(n) AS n FROM counts GROUP BY ALL),
contexts AS (SELECT w1, sum(n) AS c FROM pairs GROUP BY w1),
vocab AS (SELECT count(DISTINCT w2) AS v FROM pairs),
logs AS (SELECT w1, w2, ln((n + 1)::DOUBLE / (c + v)::DOUBLE) AS lp FROM pairs JOIN contexts USING (w1), vocab),
ppl AS (
  SELECT doc_id, sum(n)::BIGINT AS tokens, exp(-sum(n * lp) / sum(n)) AS perplexity
  FROM counts JOIN logs USING (w1, w2) GROUP BY doc_id)"""
PERPLEXITY_SQL = f"WITH {PERPLEXITY_CTE} SELECT doc_id, tokens, round(perplexity, 4) AS perplexity FROM ppl"


def popularity_scores(spark, folder):
    """Mean perplexity of the documents of each source."""
    docs = texts(spark, folder)
    scored = P.ngram_perplexity(docs, "doc_id", "text").join(docs.select("doc_id", F.col("source").alias("name")), "doc_id")
    return P.popularity_scores(scored).select("name", F.round("score", 4).alias("score"))


POPULARITY_SQL = f"""WITH {PERPLEXITY_CTE}
SELECT source AS name, round(avg(perplexity), 4) AS score FROM ppl JOIN documents USING (doc_id) GROUP BY source"""


def hash_embed(spark, folder):
    rows = E.hash_embed(texts(spark, folder), "text", 256)
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return rows.select("doc_id", F.round(length, 9).alias("squared_length"), F.size("embedding").alias("dimensions"))


HASH_EMBED_SQL = "SELECT doc_id, 1.0::DOUBLE AS squared_length, 256::INTEGER AS dimensions FROM documents"


def level_pairs(spark, folder):
    """JSON answers with a level per mention; broken JSON gives no pairs."""
    rows = messages(spark, folder)
    pairs = F.transform("mentions", lambda m, i: F.concat(F.lit('"'), m, F.lit('": "level '), i.cast("string"), F.lit('"')))
    json = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.when(F.col("role") == "system", "").otherwise("}"))
    levels = X.parse_levels(json)
    return rows.select("record_id", joined(F.transform(levels, lambda e: e["skill"])).alias("skills"),
                       joined(F.transform(levels, lambda e: e["level"])).alias("levels"))


LEVELS_SQL = f"""WITH {MESSAGES_SQL}
SELECT record_id, CASE WHEN role = 'system' THEN '' ELSE array_to_string(mentions, '|') END AS skills,
       CASE WHEN role = 'system' THEN '' ELSE array_to_string(list_transform(mentions, lambda m, i: 'level ' || (i - 1)), '|') END AS levels
FROM msgs"""


def list_column_parse(spark, folder):
    """Lists printed as text, read back; a text cut short is marked as corrupt."""
    from spanloom.operators.requests import list_text
    from spanloom.sources.tables import parse_list_column

    rows = messages(spark, folder)
    items = F.concat("mentions", F.array(F.lit("it's"), F.lit('say "x"')))
    printed = list_text(items)
    cut = F.when(F.col("role") == "system", F.lit("no list at all")).otherwise(printed)
    parsed = parse_list_column(rows.select("record_id", cut.alias("skills")), "skills")
    return parsed.select("record_id", joined("skills").alias("skills"), F.col("_corrupt").alias("corrupt"))


LIST_SQL = f"""WITH {MESSAGES_SQL}
SELECT record_id, CASE WHEN role <> 'system' THEN array_to_string(list_concat(mentions, ['it''s', 'say "x"']), '|') END AS skills,
       role = 'system' AS corrupt FROM msgs"""


def entity_names(spark, folder):
    """Name part of "name : definition", with a second separator inside the definition."""
    text = F.concat("p_name", F.lit(" : "), "p_type", F.lit(" : "), "p_brand")
    return read(spark, folder, "part").select("p_partkey", X.name_before_definition(text).alias("name"))


def distinct_sentences(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", F.col("text").alias("sentence"))
    return T.distinct_sentences(docs, "sentence", ["doc_id"]).select("doc_id", F.length("sentence").alias("characters"))


def name_ratios(spark, folder):
    """Ratio and token-set ratio of a part's brand and type against its name, once per distinct pair."""
    pair = read(spark, folder, "part").select(F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("other"))
    return pair.distinct().select("name", "other", Z.ratio_udf("name", "other").alias("ratio"),
                                  Z.token_set_ratio_udf("name", "other").alias("token_set_ratio"))


NAME_RATIOS_SQL = f"""WITH pairs AS (SELECT DISTINCT p_name AS name, p_type || ' ' || p_brand AS other FROM part),
{token_set_sql('pairs', 'name', 'other', 'scored')}
SELECT name, other, {ratio_sql('name', 'other')} AS ratio, score::INTEGER AS token_set_ratio FROM scored"""


QUERIES = {
    "entity_names": (entity_names, "SELECT p_partkey, p_name AS name FROM part"),
    "distinct_sentences": (
        distinct_sentences,
        "SELECT min(doc_id) AS doc_id, length(text)::INTEGER AS characters FROM documents GROUP BY text"),
    "name_ratios": (name_ratios, NAME_RATIOS_SQL),
    "drop_short": (drop_short, DROP_SHORT_SQL),
    "strip_html": (strip_html, STRIP_HTML_SQL),
    "clean_text": (clean_text, CLEAN_SQL),
    "anonymize": (anonymize, ANONYMIZE_SQL),
    "annotate_and_extract": (annotate_and_extract, ANNOTATE_SQL),
    "annotation_status": (annotation_status, STATUS_SQL),
    "merge_taxonomy": (merge_taxonomy, MERGE_SQL),
    "complete_taxonomy": (complete_taxonomy, COMPLETE_SQL),
    "lowest_level": (lowest_level, LOWEST_SQL),
    "clean_alt_names": (clean_alt_names, ALT_SQL),
    "keyword_tag": (keyword_tag, KEYWORD_SQL),
    "signed_terms": (signed_terms, SIGNED_SQL),
    "cost_by_model": (cost_by_model, COST_SQL),
    "bigram_perplexity": (bigram_perplexity, PERPLEXITY_SQL),
    "popularity_scores": (popularity_scores, POPULARITY_SQL),
    "hash_embed": (hash_embed, HASH_EMBED_SQL),
    "level_pairs": (level_pairs, LEVELS_SQL),
    "list_column_parse": (list_column_parse, LIST_SQL),
}
