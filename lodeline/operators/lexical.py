"""Fielded inverted index and BM25 retrieval for batches of queries.

The index is three tables: ``postings(field, term, doc, tf, dl)``, ``terms(field, term, df)`` and ``fields(field, avgdl, n)``. Statistics cover all documents, whatever the filters of a query. A query is a row; a single query is a batch of one.
Postings carry the length of their document field, so scoring needs one join on the term and one partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.runtime import bounded, is_literal, materialize

K1, B = 1.2, 0.75
MOST_REQUESTS = 10_000
MOST_FILTERS = 1_000_000


@dataclass
class Index:
    postings: DataFrame
    fields: DataFrame
    terms: DataFrame


def small(df: DataFrame) -> DataFrame:
    """Broadcast what is literal; the size of anything else is left to adaptive execution, which measures it."""
    return F.broadcast(df) if is_literal(df) else df


def token_fields(docs: DataFrame, fields: dict[str, Column], doc: str = "doc", kept: Sequence[str] = ()) -> DataFrame:
    """``doc, field, dl, tokens`` and the kept columns: one row for each document and field, in one narrow pass."""
    entries = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(c, F.array().cast("array<string>")).alias("tokens")) for n, c in fields.items()])
    return docs.select(F.col(doc).alias("doc"), *kept, F.explode(entries).alias("f")).select("doc", *kept, "f.field", F.size("f.tokens").alias("dl"), "f.tokens")


def frequencies(tokens: Column) -> Column:
    """``term, tf`` of an array of tokens, in built-in expressions: sorted once, then cut where the token changes.

    What a lambda's body holds is evaluated for each element; arrays it looks into are therefore bound to a variable of an outer lambda.
    """

    def cut(own: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: (i == 1) | (F.element_at(own, i) != F.element_at(own, F.greatest(i - 1, F.lit(1)))))
        return F.element_at(F.transform(F.array(starts), lambda at: counted(own, at)), 1)

    def counted(own: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.size(own)), F.array(F.size(own) + 1))
        return F.zip_with(starts, ends, lambda a, b: F.struct(F.element_at(own, a).alias("term"), (b - a).cast("bigint").alias("tf")))

    # an array of none or one, so that empty token arrays give no pairs
    held = F.filter(F.array(F.array_sort(tokens)), lambda own: F.size(own) > 0)
    return F.flatten(F.transform(held, cut))


def build(tokens: DataFrame, terms: DataFrame | None = None, kept: Sequence[str] = ()) -> Index:
    """From ``doc, field, dl, tokens``, a row for every document and field.

    Lengths are the sizes of the token arrays and frequencies are counted within them, so neither postings nor field statistics shuffle occurrences. With
    ``terms`` only the postings of these terms are made (for a batch over a table without a stored index); all statistics of these terms stay global.
    ``kept``: columns of the document that its postings carry, so that hard filters are predicates on a posting.
    """
    fields = tokens.groupBy("field").agg((F.sum("dl") / F.count("*")).alias("avgdl"), F.count("*").alias("n"))
    if terms is None:  # a document's tokens stand in one row: its postings need no shuffle, and its terms count once each
        postings = tokens.select("field", "doc", "dl", *kept, F.explode(frequencies(F.col("tokens"))).alias("p")).select("field", "doc", "dl", *kept, "p.term", "p.tf")
        distinct = tokens.select("field", F.explode(F.array_distinct("tokens")).alias("term"))
    else:
        occurrences = tokens.select("field", "doc", "dl", *kept, F.explode("tokens").alias("term")).join(small(terms.select("term").distinct()), "term", "left_semi")
        postings = materialize(occurrences.groupBy("field", "doc", "dl", "term").agg(F.count("*").alias("tf"), *[F.first(c).alias(c) for c in kept]))  # read for scores and for document frequencies
        distinct = postings
    return Index(postings, fields, distinct.groupBy("field", "term").agg(F.count("*").alias("df")))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def score(queries: DataFrame, index: Index, boosts: dict[str, float] | None = None, eligible: DataFrame | None = None, requests: DataFrame | None = None, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """The keys, ``doc, score``: sum over distinct query terms and fields of boost * idf * saturated tf.

    queries: the keys, ``term``; keys beyond ``qid`` tell apart several searches under one request. Filters are applied before aggregation (they can't
    change a score, as statistics are global): eligible: ``qid, doc`` or ``doc``, for sets that come from elsewhere; requests: the hard filters of each
    query (``passes``), for postings that carry the documents' columns, so that no set of eligible documents is made.
    """
    q = queries.select(*keys, "term").distinct()
    hits = index.postings.join(small(q), "term")
    if requests is not None:
        hits = hits.join(bounded(requests, MOST_REQUESTS, "requests"), "qid").filter(passes())
    if eligible is not None:
        hits = hits.join(eligible, [c for c in ("qid", "doc") if c in eligible.columns], "left_semi")
    # a term's weight: only the queried terms' statistics are joined
    weights = index.terms.join(small(q.select("term").distinct()), "term", "left_semi")
    hits = hits.join(weights, ["field", "term"]).join(F.broadcast(index.fields), "field")  # one row for each field
    boost = F.lit(1.0)
    if boosts:
        boost = F.coalesce(F.element_at(F.create_map(*[x for k, v in boosts.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("field")), F.lit(0.0))
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    part = boost * idf(F.col("n"), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    return hits.groupBy(*keys, "doc").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, id_order: Column | None = None, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """Rank by score and id inside each query; k by query is pushed below the sort by Spark's group limit."""
    w = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), (id_order if id_order is not None else F.col("doc").cast("string")))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def passes() -> Column:
    """Whether a row with ``location, duty, visible, updated_ms`` passes the filters ``locations, duties, minimum_ms`` of a request.

    Filters hold taxonomy terms (null: no match at all; empty: no restriction). The time bound is inclusive, there is no upper one.
    """
    within = lambda terms, value: F.col(terms).isNotNull() & ((F.size(terms) == 0) | F.array_contains(terms, F.col(value)))
    return (F.col("visible") == "1") & (F.col("updated_ms") >= F.col("minimum_ms")) & within("locations", "location") & within("duties", "duty")


def eligible_rows(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """``qid, doc`` that pass a request's hard filters, each once.

    docs: ``doc, location, duty, visible, updated_ms``; requests: ``qid, locations, duties, minimum_ms``, see ``passes``. Requests that restrict places
    meet their documents by an equi-join on the place, others that restrict duties on the duty; only what restricts neither is tested against every
    document, since all of them may be its result.
    """
    visible = docs.filter(F.col("visible") == "1").select("doc", "location", "duty", "visible", "updated_ms")
    r = requests.filter(F.col("locations").isNotNull() & F.col("duties").isNotNull())
    by_place = r.filter(F.size("locations") > 0).withColumn("location", F.explode(F.array_distinct("locations")))
    by_duty = r.filter((F.size("locations") == 0) & (F.size("duties") > 0)).withColumn("duty", F.explode(F.array_distinct("duties")))
    free = r.filter((F.size("locations") == 0) & (F.size("duties") == 0))
    found = [visible.join(bounded(by_place, MOST_FILTERS, "places of requests"), "location"), visible.join(bounded(by_duty, MOST_FILTERS, "duties of requests"), "duty"), visible.join(bounded(free, MOST_REQUESTS, "requests"))]
    a, b, c = (f.filter(passes()).select("qid", "doc") for f in found)
    return a.unionByName(b).unionByName(c)
