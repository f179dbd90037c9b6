"""Driver queries of the similarity joins over conversations, parts and vectors (survey
D15-D17, I6), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from talus.operators import similarity
from talus.operators.graph import cut
from talus.plans.ranked import read

# Bags of words as normalised maps, for the SQL of this module.
BAGS = """w AS (SELECT id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS token FROM c),
t AS (SELECT id, token, count(*)::DOUBLE AS tf FROM w WHERE token <> '' GROUP BY ALL), n AS (SELECT id, sqrt(sum(tf * tf)) AS l FROM t GROUP BY 1)"""


def _prompts(spark, sf_dir):
    """All turns in one order."""
    return read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "text")


def semantic_cache(spark, sf_dir):
    """Every turn looks for the earlier turn that is most alike, in any conversation."""
    return similarity.cache_lookups(_prompts(spark, sf_dir), "seq", "text", 0.9)


CACHE = f"""WITH c AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), {BAGS},
s AS (SELECT a.id, b.id AS other, round_even(sum(a.tf * b.tf) / (any_value(x.l) * any_value(y.l)), 6) AS s FROM t a JOIN t b ON a.token = b.token AND b.id < a.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id GROUP BY 1, 2),
m AS (SELECT id, max(s) AS s, arg_min(other, struct_pack(s := -s, o := other)) AS other FROM s WHERE s >= 0.9 GROUP BY 1)
SELECT c.id AS seq, m.s IS NOT NULL AS hit, m.other AS best, m.s AS similarity FROM c LEFT JOIN m ON c.id = m.id"""


def cache_hit_ratio(spark, sf_dir):
    return similarity.hit_ratio(semantic_cache(spark, sf_dir))


RATIO = f"""SELECT count(*) AS entries, sum(hit::INT)::BIGINT AS hits, sum((NOT hit)::INT)::BIGINT AS misses, round_even(avg(hit::INT), 4) AS hit_ratio FROM ({CACHE})"""


def skill_leaders(spark, sf_dir):
    """The distinct names of parts as skills: each joins the first leader with a cosine of 0.5 or more."""
    names = cut(read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).where("p_name is not null").distinct())  # parts are read once
    bags = similarity.bags(names.withColumn("text", F.col("name")), ["name"], "text")
    # Names with one bag (the same words in another order) are alike at 1: the first stands for them.
    first = cut(bags.groupBy(F.to_json("bag").alias("b")).agg(F.min("name").alias("first"), F.min_by("bag", "name").alias("bag")))
    pairs = similarity.cosine_pairs(first.select("first", "bag"), "first", 0.5).select("a", "b")
    led = similarity.greedy_leaders(pairs, first.select("first"), at_once=similarity.LEADER_EDGES)
    named = bags.select("name", F.to_json("bag").alias("b")).join(first.select("b", "first"), "b")
    return named.join(led, F.col("first") == led["name"]).select(named["name"], "leader")


LEADERS = f"""WITH RECURSIVE c AS (SELECT DISTINCT p_name AS id, p_name AS text FROM part WHERE p_name IS NOT NULL), {BAGS},
e AS (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.token = b.token AND a.id <> b.id JOIN n x ON x.id = a.id JOIN n y ON y.id = b.id GROUP BY 1, 2
  HAVING round_even(sum(a.tf * b.tf) / (any_value(x.l) * any_value(y.l)), 6) >= 0.5),
o AS (SELECT row_number() OVER (ORDER BY n.id) AS pos, n.id AS name, coalesce(list(e.b) FILTER (e.b IS NOT NULL), []) AS near FROM n LEFT JOIN e ON e.a = n.id GROUP BY n.id),
g AS (SELECT 0::BIGINT AS pos, []::VARCHAR[] AS leaders, NULL::VARCHAR AS name, NULL::VARCHAR AS leader
  UNION ALL SELECT pos, CASE WHEN hit IS NULL THEN list_append(leaders, name) ELSE leaders END, name, coalesce(hit, name)
  FROM (SELECT o.pos, leaders, o.name, list_filter(leaders, lambda x: list_contains(near, x))[1] AS hit FROM g JOIN o ON o.pos = g.pos + 1))
SELECT name, leader FROM g WHERE name IS NOT NULL"""


def vector_topk_pruned(spark, sf_dir):
    """Every tenth vector against all, through the cluster-pruned index."""
    e = read(spark, sf_dir, "embeddings")
    out, _ = similarity.dense_top_k(e.where("vec_id % 10 = 0"), e, "vec_id", "vec_id", "embedding", 5)
    return out.select("query", "id", "similarity", F.col("rank").cast("long").alias("rank"))


PRUNED = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query, e.vec_id AS id, round_even(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) AS similarity FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 10 = 0)
SELECT * FROM (SELECT query, id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s) WHERE rank <= 5"""

QUERIES = {
    "semantic_cache": (semantic_cache, CACHE), "cache_hit_ratio": (cache_hit_ratio, RATIO), "skill_leaders": (skill_leaders, LEADERS), "vector_topk_pruned": (vector_topk_pruned, PRUNED),
}
