"""Queries over vectors and fragments and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import text as tx
from ..functions.vectors import dot, hash_embedding
from ..operators import quotes
from ..operators import search as op

def _vectors(spark, d):
    return views.table(spark, d, "embeddings").select(F.concat(F.lit("fragment-v"), F.col("vec_id").cast("string")).alias("fragment_id"), "vec_id", "embedding")


def _asked(spark, d):
    """The stated queries of a search: every vector whose number is divisible by 20."""
    return views.table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def vector_topk(spark, d):
    return op.nearest_each(_vectors(spark, d), _asked(spark, d), 10).select("query_id", "fragment_id", F.round("similarity", 4).alias("similarity"))


def vector_index_topk(spark, d):
    """`vector_topk` by the inverted-file index."""
    vectors = _vectors(spark, d)
    index = op.fit_index(vectors, 10)
    return op.nearest_in_index(op.in_lists(vectors, index, "fragment_id"), _asked(spark, d), index, 10).select("query_id", "fragment_id", F.round("similarity", 4).alias("similarity"))


def hybrid_search(spark, d):
    """Documents stand for the fragments of the vectors of their number."""
    texts = views.table(spark, d, "documents").select(F.concat(F.lit("fragment-v"), F.col("doc_id").cast("string")).alias("fragment_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("document_id"), "text")
    hidden = views.documents(spark, d).where("hidden").select("document_id")
    return op.hybrid_each(_vectors(spark, d), texts, _asked(spark, d), "the and ention of", hidden, 8)


def cosine_pairs(spark, d):
    """Each vector against the next."""
    v = views.table(spark, d, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", F.round(dot(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def hash_embed(spark, d):
    """The embeddings of the conversations' texts: the places in use and their weights."""
    rows = views.table(spark, d, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    found = hash_embedding(rows, "id", "text").select("id", F.posexplode("embedding").alias("place", "weight"))
    return found.where("weight > 0").select("id", F.col("place").cast("long").alias("place"), F.round("weight", 6).alias("weight"))


def quote_in_source(spark, d):
    """Which documents hold which benchmark passages."""
    docs = views.table(spark, d, "documents").select("doc_id", tx.quote_key(F.col("text")).alias("hay"))
    items = views.table(spark, d, "benchmark").select("item_id", tx.quote_key(F.col("text")).alias("needle"))
    return quotes.passages_in(docs, items)


QUERIES = {f.__name__: f for f in (vector_topk, vector_index_topk, hybrid_search, cosine_pairs, hash_embed, quote_in_source)}

_DOT = "round(list_dot_product(q.embedding::double[], e.embedding::double[]), 8)"
_KEY = "trim(regexp_replace(translate(lower(text), '«»\"''“”„‘’—–-' || chr(173) || chr(8209), repeat(' ', 14)), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))"

ORACLE_SQL = {
    "vector_topk": f"""select q.vec_id as query_id, 'fragment-v' || e.vec_id as fragment_id, round({_DOT}, 4) as similarity from embeddings q, embeddings e where q.vec_id % 20 = 0
        qualify row_number() over (partition by q.vec_id order by {_DOT} desc, 'fragment-v' || e.vec_id) <= 10""",
    "hybrid_search": f"""with {views.SQL}, shown as (select vec_id, embedding, (cast(contains(lower(text), 'and') as int) + cast(contains(lower(text), 'ention') as int)
            + cast(contains(lower(text), 'of') as int) + cast(contains(lower(text), 'the') as int)) / 4.0 as share
          from embeddings join documents on doc_id = vec_id where 'doc-' || doc_id not in (select document_id from docs_v where hidden)),
        near as (select q.vec_id as query_id, 'fragment-v' || e.vec_id as fragment_id, {_DOT} as s, e.share from embeddings q, shown e where q.vec_id % 20 = 0
          qualify row_number() over (partition by q.vec_id order by s desc, fragment_id) <= 24)
        select query_id, fragment_id, round(s * 0.72 + 0.28 * share, 4) as score from near where score > 0
        qualify row_number() over (partition by query_id order by score desc, fragment_id) <= 8""",
    "cosine_pairs": "select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "hash_embed": r"""with w as (select conv_id || '-' || turn as id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')) as word from conversations),
        c as (select id, cast('0x' || substr(sha256(word), 1, 4) as int) % 64 as place, count(*) as n from w group by all)
        select id, cast(place as bigint) as place, round(n / sqrt(sum(n * n) over (partition by id)), 6) as weight from c""",
    "quote_in_source": f"with a as (select doc_id, {_KEY} as hay from documents), b as (select item_id, {_KEY} as needle from benchmark) select doc_id, item_id from a join b on contains(hay, needle)",
}
