"""Dictionary terms found in texts by a trie over words.

A text is cut into words and gaps once and walked once: from each word the trie
is followed for as long as words and gaps agree, and every term that ends on the
way is a hit. The cost of a text depends neither on the number of terms nor on
their lengths, and no n-grams are written out.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# A word with its trailing # or + (so that C, C# and C++ differ), or the gap between words.
ATOM = r"(?U)\w+[#+]*|[^\w]+"
BEFORE_WORDS = r"(?U)^[^\w]+"
# Signs before the first word, the words, signs after the last one.
TERM = r"(?Us)^([^\w]*)(.*\w[#+]*)([^\w]*)$"
#: Bytes of terms in one trie; a larger dictionary is looked up in several passes, cut by first words.
TRIE_BYTES = 16 << 20


def atoms(text: Column) -> Column:
    """Words at even places, the gaps between them at odd places; text before the first word is cut."""
    return F.regexp_extract_all(F.regexp_replace(text, BEFORE_WORDS, ""), F.lit(ATOM), 0)


def term_words(term: Column) -> Column:
    return F.regexp_count(term, F.lit(r"(?U)\w+[#+]*"))


class Trie:
    """Terms by their words and inner gaps; a node maps a gap and the next word to a node.

    A node holds the terms that end there as (signs before, signs after, values).
    """

    def __init__(self, terms):
        """``terms``: (atoms of the words, signs before, signs after, values)."""
        self.first = {}
        for parts, lead, tail, values in terms:
            node = self.first.setdefault(parts[0], ({}, []))
            for i in range(1, len(parts), 2):
                node = node[0].setdefault((parts[i], parts[i + 1]), ({}, []))
            node[1].append((lead, tail, values))

    def hits(self, parts: list[str], before: str):
        """(place, values) of every term in a text of words and gaps; place 1 is the first word."""
        first, n = self.first, len(parts)
        for i in range(0, n, 2):
            node, j = first.get(parts[i]), i
            while node is not None:
                if node[1]:
                    gap, after = parts[i - 1] if i else before, parts[j + 1] if j + 1 < n else ""
                    for lead, tail, values in node[1]:
                        # beyond a term's signs there is another sign, or the end of the text
                        led = not lead or gap.endswith(lead) and (len(gap) > len(lead) or not i)
                        if led and (not tail or after.startswith(tail) and (len(after) > len(tail) or j + 2 >= n)):
                            yield i + 1, values
                node = node[0].get((parts[j + 1], parts[j + 2])) if node[0] and j + 2 < n else None
                j += 2


def _walked(box, columns: list[str], schema: pa.Schema):
    def run(batches):
        trie = Trie(box.value)
        for batch in batches:
            rows, places, found = [], [], []
            for i, (parts, before) in enumerate(zip(batch["atoms"].to_pylist(), batch["before"].to_pylist(), strict=True)):
                for place, values in trie.hits(parts or [], before or ""):
                    rows.append(i)
                    places.append(place)
                    found.append(values)
            out = [batch["key"].take(pa.array(rows, pa.int64())), pa.array(places, pa.int32())]
            out += [pa.array([v[c] for v in found], schema.field(name).type) for c, name in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(out, names=["key", "place", *columns])

    return run


def dictionary_hits(df: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    """(key, place, entry columns): every occurrence of a term, as whole words, case-sensitive.

    ``place`` counts words and gaps from 1, so words have odd places. Nested and
    overlapping terms all count. Signs around a term's words, as in ``.NET`` and
    ``(ISC)2``, are compared with the gaps around its words; beyond them there
    must be a space, another sign or the end of the text. Null texts have no
    hits, terms without a word are never found. The trie is sent to the tasks; a
    dictionary beyond TRIE_BYTES takes a pass over the texts for each part of
    that size, so no part grows with the dictionary.
    """
    spark = df.sparkSession
    part = lambda i: F.regexp_extract("term", TERM, i)
    wanted = entries.where(term_words(F.col("term")) > 0).select(
        atoms(part(2)).alias("__atoms"), part(1).alias("__lead"), part(3).alias("__tail"), F.struct(*entries.columns).alias("__values"))
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("__values.term").cast("bigint")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(size / TRIE_BYTES))
    texts = df.select(F.col(key).alias("key"), atoms(F.col(text)).alias("atoms"), F.regexp_extract(text, BEFORE_WORDS, 0).alias("before"))
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("place", T.IntegerType()), *entries.schema.fields])
    arrow, found = to_arrow_schema(T.StructType(entries.schema.fields)), None
    for k in range(passes):
        some = wanted.where(F.pmod(F.xxhash64(F.col("__atoms")[0]), F.lit(passes)) == k).toArrow().to_pylist()
        terms = [(r["__atoms"], r["__lead"], r["__tail"], tuple(r["__values"][c] for c in entries.columns)) for r in some]
        hits = texts.mapInArrow(_walked(spark.sparkContext.broadcast(terms), entries.columns, arrow), schema)
        found = hits if found is None else found.unionByName(hits)
    return found.withColumnRenamed("key", key)


def term_hits(df: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term") -> DataFrame:
    """(key, place, term): every occurrence of a term in a text."""
    return dictionary_hits(df, key, text, terms.select(F.col(term).alias("term")).distinct()).select(key, "place", "term")


def synonym_terms(synonyms: DataFrame, canonical: str = "level2", names: str = "alternative_names_clean") -> DataFrame:
    """(term, canonical) from ", " lists of alternative names."""
    return synonyms.where(F.col(names).isNotNull()).select(
        F.explode(F.split(names, ", ")).alias("term"), F.col(canonical).alias("canonical")
    ).where("term <> ''").distinct()


# Categories with synonyms, the column that lists the synonyms
# found, and the category left out for course texts.
SYNONYM_COLUMNS = {
    "Technologies": "Technologies_alternative_names",
    "Certifications": "Certification_alternative_names",
}
COURSE = "course"
LANGUAGES = "Languages"


def keyword_tags(
    df: DataFrame, key: str, text: str, terms: DataFrame, synonyms: dict[str, DataFrame] | None = None,
    data_type: str = "job",
) -> DataFrame:
    """(key, tag, values): for each text and category the terms found.

    ``terms`` has (level1 = category, level2 = term). Categories with synonyms
    hold distinct canonical terms; the others list every hit in text order. The
    synonyms found appear under their own tag.
    """
    synonyms = synonyms or {}
    # kind 0: hit of a term, kind 1: hit of a synonym
    entries = terms.select(F.col("level2").alias("term"), F.col("level1").alias("tag"),
                           F.col("level2").alias("value"))
    if data_type == COURSE:
        entries = entries.where(F.col("tag") != LANGUAGES)
    for category, table in synonyms.items():
        pairs = synonym_terms(table)
        entries = entries.unionByName(pairs.select("term", F.lit(category).alias("tag"), F.col("canonical").alias("value")))
        entries = entries.unionByName(
            pairs.select("term", F.lit(SYNONYM_COLUMNS[category]).alias("tag"), F.col("term").alias("value"))
        )
    entries = entries.distinct()
    found = dictionary_hits(df, key, text, entries)
    as_set = F.col("tag").isin(*[t for c in synonyms for t in (c, SYNONYM_COLUMNS[c])]) if synonyms else F.lit(False)
    # one text's hits of one category: bounded by the text itself
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda h: h["value"])
    grouped = found.groupBy(key, "tag").agg(listed.alias("values"))
    return grouped.select(
        key, "tag", F.when(as_set, F.array_sort(F.array_distinct("values"))).otherwise(F.col("values")).alias("values")
    )


def tag_columns(df: DataFrame, key: str, tags: DataFrame, names: list[str]) -> DataFrame:
    """Join the tags back as one array column per name; texts without hits get empty lists."""
    none = F.array().cast("array<string>")
    wide = tags.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("tag", "values"))).alias("__tags"))
    return df.join(wide, key, "left").select(
        *df.columns, *[F.coalesce(F.try_element_at("__tags", F.lit(n)), none).alias(n) for n in names]
    )
