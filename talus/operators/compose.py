"""Compositions over postings: acquisition and ingestion gates, report filters, reviews and
outcomes, feedback-adjusted ranking, snapshots, gaps, history-wide publishing, retries, loads
and profiles (survey groups A, B, D, E, F, G, I, J, L, M)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.lookup import small
from talus.operators.merge import first_per_key


# ------------------------------------------------------------------ gates in a row
def acquire(df: DataFrame, reasons: list[tuple[str, Column]], keys: list[tuple[str, Column]], seq: str) -> DataFrame:
    """`df` with `outcome`: the first reason that holds, else the first of `keys` by which an
    earlier survivor is known, else 'inserted'. A null key is never known."""
    outcome = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        outcome = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(outcome)
    rows = df.withColumns({"outcome": outcome, **{f"__k{i}": k for i, (_, k) in enumerate(keys)}})
    for i, (name, _) in enumerate(keys):
        key = f"__k{i}"
        known = rows.where(F.col("outcome").isNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(seq).alias("__first"))
        rows = rows.join(known, key, "left")
        rows = rows.withColumn("outcome", F.when(F.col("outcome").isNull() & (F.col(seq) > F.col("__first")), F.lit(name)).otherwise(F.col("outcome"))).drop("__first")
    return rows.withColumn("outcome", F.coalesce("outcome", F.lit("inserted"))).drop(*[f"__k{i}" for i in range(len(keys))])


def ingestion_gate(df: DataFrame, geo_ok: Column, language_fail: Column, visa_fail: Column, status: Column, senior: Column, non_intern: Column) -> DataFrame:
    """eligible, and the first reason against it in the order place, language, visa,
    seniority, internship, eligibility."""
    reason = (
        F.when(~geo_ok, "non_eu").when(language_fail, "language").when(visa_fail, "visa").when(senior, "seniority")
        .when(non_intern, "non_intern").when(F.coalesce(status, F.lit("UNCHECKED")) == "REJECTED", "eligibility")
    )
    return df.withColumns({"eligible": reason.isNull(), "reason": reason})


def above_threshold(jobs: DataFrame, scores: DataFrame, key: str, score: str, least: float, expired: Column) -> DataFrame:
    return jobs.where(~F.coalesce(expired, F.lit(False))).join(scores.where(F.col(score) >= least), key).orderBy(F.desc(score), key)


def unscored_open(jobs: DataFrame, scores: DataFrame, key: str, status: str, risk: str | None = None) -> DataFrame:
    """Rows without a score that aren't rejected and, with `risk`, aren't of high risk."""
    rows = jobs.join(scores.select(key).distinct(), key, "left_anti").where(F.coalesce(F.col(status), F.lit("UNCHECKED")) != "REJECTED")
    return rows if risk is None else rows.where(~F.col(risk).eqNullSafe("HIGH"))


# ------------------------------------------------------------------ joins and rankings
def outcomes(applications: DataFrame, jobs: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Applications with their posting, and the score where there is one."""
    return applications.join(jobs, key).join(scores, key, "left")


def reviews(queue: DataFrame, jobs: DataFrame, key: str, created: str, state: str | None = None) -> DataFrame:
    """The review queue with its postings, newest first."""
    rows = queue if state is None else queue.where(F.col("state") == state)
    return rows.join(jobs, key).orderBy(F.desc(created), F.desc(key))


def feedback_rank(items: DataFrame, weights: DataFrame, target: str, score: str, tie: str) -> DataFrame:
    """Items with `adjusted`, the score moved by the weight of their target, and their rank."""
    from talus.operators.ranking import global_rank

    moved = items.join(weights, target, "left").withColumn("adjusted", F.bround(F.col(score) + F.coalesce("weight", F.lit(0.0)), 4)).drop("weight")
    return global_rank(moved, [F.desc("adjusted"), F.asc(tie)], 16)


def top_opportunities(ranked: DataFrame, recommendations: DataFrame, metrics: DataFrame, key: str, limit: int) -> DataFrame:
    """The first `limit` ranked rows that have both a recommendation and metrics."""
    return ranked.join(recommendations, key).join(metrics, key).orderBy("rank").limit(limit)


# ------------------------------------------------------------------ market and cost
def latest_benchmark(df: DataFrame, keys: list[str], captured: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (*keys, captured)]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(captured, *rest), captured).alias("b"))
    return best.select(*keys, f"b.{captured}", *[f"b.{c}" for c in rest])


def demand_snapshot(df: DataFrame, role: str, place: str, skills: Column, captured: Column) -> DataFrame:
    """(role, demand, places, skills, captured_at): counts of rows, by place and by skill."""
    counts = lambda rows, name: rows.where(F.col("x").isNotNull() & (F.col("x") != "")).groupBy(role, "x").agg(F.count(F.lit(1)).alias("n")).groupBy(role).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("x", "n")))).alias(name))
    total = df.groupBy(role).agg(F.count(F.lit(1)).alias("demand"))
    places = counts(df.select(role, F.col(place).alias("x")), "places")
    skilled = counts(df.select(role, F.explode(skills).alias("x")), "skills")
    return total.join(places, role, "left").join(skilled, role, "left").withColumn("captured_at", captured)


def demand_sets(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n) for each dimension in one pass; empty values don't count."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("value <> ''").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def provider_health(calls: DataFrame, provider: str, ok: Column, time: str, seconds: int = 60, threshold: float = 0.5) -> DataFrame:
    """Calls, error rate and failover of each provider, and its calls in the last seconds
    before the newest call of all."""
    last = calls.agg(F.max(time).alias("__now"))  # one row
    recent = F.sum((F.col(time) >= F.col("__now") - F.expr(f"interval {seconds} seconds")).cast("long"))
    g = calls.crossJoin(F.broadcast(last)).groupBy(provider).agg(F.count(F.lit(1)).alias("calls"), F.sum((~ok).cast("long")).alias("errors"), recent.alias("throughput"))
    rate = F.bround(F.col("errors") / F.col("calls"), 4)
    return g.withColumns({"error_rate": rate, "failover": rate >= threshold})


def skill_gaps(required: DataFrame, held: DataFrame, prerequisites: DataFrame, profile: str, skill: str) -> DataFrame:
    """(profile, skill, priority, prerequisites, place): required skills that a profile lacks,
    those with prerequisites first. prerequisites: (node, reaches, depth)."""
    missing = required.select(profile, skill).distinct().join(held.select(profile, skill).distinct(), [profile, skill], "left_anti")
    chain = F.transform(F.sort_array(F.collect_list(F.struct("depth", "reaches"))), lambda x: x["reaches"])
    chains = prerequisites.groupBy(F.col("node").alias(skill)).agg(chain.alias("prerequisites"))
    rows = missing.join(chains, skill, "left")
    first = F.col("prerequisites").isNotNull()
    place = F.row_number().over(Window.partitionBy(profile).orderBy(F.when(first, 0).otherwise(1), skill))
    return rows.select(profile, skill, F.when(first, "foundational").otherwise("high").alias("priority"), "prerequisites", place.alias("place"))


# ------------------------------------------------------------------ events and runs
def publish_once(incoming: DataFrame, history: DataFrame, event_id: str, kind: str, key: str, seq: str) -> DataFrame:
    """The rows of `incoming` whose id and (kind, key) neither history nor an earlier row of
    the batch has; a null key is known by its id only."""
    fresh = first_per_key(incoming, [event_id], seq).join(history.select(event_id).distinct(), event_id, "left_anti")
    seen = history.where(F.col(key).isNotNull()).select(kind, key).distinct()
    keyed = first_per_key(fresh.where(F.col(key).isNotNull()), [kind, key], seq).join(seen, [kind, key], "left_anti")
    return keyed.unionByName(fresh.where(F.col(key).isNull()))


def with_retries(df: DataFrame, outcome: Column, tries: int) -> DataFrame:
    """`topic` and `attempts` of each row: outcome says at which try the handler succeeds;
    later than `tries`, or null for never, is the dead-letter topic after all tries."""
    good = F.coalesce(outcome <= tries, F.lit(False))
    return df.withColumns({"attempts": F.when(good, outcome).otherwise(F.lit(tries)).cast("long"), "topic": F.when(good, "done").otherwise("dlq")})


def trail(events: DataFrame, tenant: str, stamp: Column, order: str, limit: int, offset: int = 0) -> DataFrame:
    """Audit rows of one tenant, newest first."""
    return events.where(stamp == tenant).orderBy(F.desc(order)).offset(offset).limit(limit)


def run_record(runs: DataFrame, started: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per run: what it has recorded last in place of what it started with."""
    joined = started.alias("s").join(runs.alias("r"), key, "left")
    return joined.select(key, *[F.coalesce(F.col(f"r.{c}"), F.col(f"s.{c}")).alias(c) for c in columns])


def backfill(source: DataFrame, condition: Column, target: DataFrame, key: str) -> DataFrame:
    """`target` with the filtered rows of `source` that it lacks; running it again adds none."""
    return target.unionByName(source.where(condition).select(*target.columns).join(target.select(key), key, "left_anti").select(*target.columns))


def roll_back(target: DataFrame, load: str, batch) -> DataFrame:
    """`target` without the rows of one load."""
    return target.where(~F.col(load).eqNullSafe(batch))


def upsert_in_place(target: DataFrame, source: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of `source` in place of those with equal keys, at their position; new keys come
    after the last one, in the order of the key."""
    old = target.select(key, F.col(position).alias("__at"))
    end = target.agg(F.coalesce(F.max(position), F.lit(-1)).alias("__end"))  # one row
    new = source.join(old, key, "left")
    known, fresh = new.where("__at is not null"), new.where("__at is null").drop("__at")
    from talus.operators.ranking import global_rank

    added = global_rank(fresh, [F.asc(key)], 16, "__n").crossJoin(F.broadcast(end))
    rest = target.join(source.select(key), key, "left_anti")
    placed = known.withColumn(position, F.col("__at")).drop("__at").unionByName(added.withColumn(position, F.col("__end") + F.col("__n")).drop("__n", "__end"))
    return rest.unionByName(placed.select(*rest.columns))


# ------------------------------------------------------------------ profiles and dictionaries
def profile_phrases(profiles: DataFrame, key: str, sections: list[Column], placeholder: str = "FILL_IN") -> DataFrame:
    """(key, place, phrase): arrays of phrases, section after section; placeholders and blanks
    are left out."""
    every = F.concat(*[F.coalesce(s, F.array().cast("array<string>")) for s in sections])
    kept = F.filter(F.transform(every, lambda p: F.trim(p)), lambda p: (p != "") & ~p.startswith(placeholder))
    return profiles.select(key, F.posexplode(kept).alias("place", "phrase"))


def profile_chunks(profiles: DataFrame, key: str, sections: list[tuple[str, Column, Column]]) -> DataFrame:
    """(key, source, text): a chunk of each entry of a section, behind the section's context."""
    rows = [profiles.select(key, F.lit(name).alias("source"), F.explode(entries).alias("e"), context.alias("c")) for name, context, entries in sections]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.where(F.trim("e") != "").select(key, "source", F.concat_ws(": ", "c", "e").alias("text"))


def profile_mapping(df: DataFrame, key: str, flat: str, nested: Column, prefixes: dict[str, str]) -> DataFrame:
    """Lists of a map by key prefix, in the order of its keys; the nested value of a field
    comes first, where there is one. `prefixes`: field -> prefix."""
    lists = lambda p: F.flatten(F.transform(F.array_sort(F.map_keys(F.map_filter(flat, lambda k, v: k.startswith(p)))), lambda k: F.col(flat)[k]))
    return df.select(key, *[F.coalesce(F.try_element_at(nested, F.lit(field)), lists(p)).alias(field) for field, p in prefixes.items()])


def seed_missing(target: DataFrame, seeds: DataFrame, key: str, valid: Column, seq: str) -> DataFrame:
    """Valid seed rows whose key the target lacks; of each key the first by `seq`."""
    from talus.operators.merge import first_per_key

    return first_per_key(seeds.where(F.coalesce(valid, F.lit(False))), [key], seq).join(target.select(key), key, "left_anti")


def category_weights(df: DataFrame, role: str, primary: str, secondary: str) -> DataFrame:
    """(role, category, weight): primary or secondary; a category in both is secondary."""
    both = df.select(role, F.explode(primary).alias("category"), F.lit("primary").alias("weight")).unionByName(df.select(role, F.explode(secondary).alias("category"), F.lit("secondary").alias("weight")))
    return both.groupBy(role, "category").agg(F.max("weight").alias("weight"))


def enrich_json(raw: Column, values: dict[str, Column]) -> Column:
    """A JSON object of texts with more fields; a null or broken object counts as empty."""
    base = F.coalesce(F.from_json(raw, "map<string,string>"), F.create_map().cast("map<string,string>"))
    fresh = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])
    return F.to_json(F.map_concat(F.map_filter(base, lambda k, v: ~k.isin(*values)), fresh))


def isolated(value: Column, error: Column) -> Column:
    """struct(ok, value, error): a bad item carries its error instead of ending the batch."""
    return F.struct(value.isNotNull().alias("ok"), value.alias("value"), F.when(value.isNull(), error).alias("error"))


def with_hook(df: DataFrame, hook, *columns: str, name: str = "value") -> DataFrame:
    """`df` with a column of the caller's own function of columns (built-in or pandas UDF)."""
    return df.withColumn(name, hook(*[F.col(c) for c in columns]))


def demand_of_roles(profiles: DataFrame, roles: DataFrame, on: Column) -> DataFrame:
    """Profiles with the roles that a condition matches; the dictionary is counted first."""
    return profiles.join(small(roles), on)
