"""Requests for samples that are still to do, and models by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridscore.functions.runs import chat_request, generate_request, with_model_defaults
from gridscore.sources.shared import new_path, store
from gridscore.sources.sizes import few


_CLASS = r"\[!?\]?[^\]]*\]"
#: What stands at the ends of a tag and of a pattern, so that a gram can hold to an end.
_BEGIN, _END = "\x02", "\x03"


def glob_regex(pattern: Column) -> Column:
    """A glob (*, ?, [..], [!..]) as an anchored regular expression; a bracket that nothing closes is itself."""
    def token(t):
        own = F.regexp_replace(F.substring(t, 2, F.length(t) - 2), r"([\\\[\]&^])", r"\\$1")
        negated = F.regexp_replace(F.substring(t, 3, F.length(t) - 3), r"([\\\[\]&^])", r"\\$1")
        some = F.when(t.startswith("[!"), F.concat(F.lit("[^"), negated, F.lit("]"))).otherwise(F.concat(F.lit("["), own, F.lit("]")))
        return F.when(t == "*", ".*").when(t == "?", ".").when(F.length(t) > 1, some).otherwise(F.regexp_replace(t, r"([.^$+{}()|\\\[\]])", r"\\$1"))

    return F.concat(F.lit("(?s)^"), F.array_join(F.transform(F.regexp_extract_all(pattern, F.lit(f"(?s){_CLASS}|."), 0), token), ""), F.lit("$"))


def _grams(text: Column, n: int) -> Column:
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _keys_of(rules: DataFrame, longest: int) -> DataFrame:
    """(pattern, rule, size, key): what a tag must have in common with a pattern. The grams of its literal pieces of the greatest size, up to three, that it has,
    the ends of a tag being letters; a pattern without any letter has the lengths that fit, of which `longest` is the last."""
    marked = F.concat(F.lit(_BEGIN), F.lower("pattern"), F.lit(_END))
    pieces = F.split(marked, f"(?s){_CLASS}|[*?]", -1)
    own = lambda n: F.filter(F.flatten(F.transform(pieces, lambda p: _grams(p, n))), lambda g: ~g.isin(_BEGIN, _END))
    rows = rules.select("pattern", "rule", own(3).alias("k3"), own(2).alias("k2"), own(1).alias("k1"))
    one = F.size(F.regexp_extract_all("pattern", F.lit(f"(?s){_CLASS}|[?]"), 0))
    most = F.when(F.contains("pattern", F.lit("*")), F.greatest(one, F.lit(longest))).otherwise(one)
    lengths = F.transform(F.sequence(one, most), lambda n: n.cast("string"))
    best = F.when(F.size("k3") > 0, F.struct(F.lit(3).alias("size"), F.col("k3").alias("keys"))).when(F.size("k2") > 0, F.struct(F.lit(2).alias("size"), F.col("k2").alias("keys")))
    best = best.when(F.size("k1") > 0, F.struct(F.lit(1).alias("size"), F.col("k1").alias("keys"))).otherwise(F.struct(F.lit(0).alias("size"), lengths.alias("keys")))
    return rows.withColumn("b", best).select("pattern", "rule", "b.size", F.explode(F.array_distinct("b.keys")).alias("key"))


def pattern_matches(tags: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, tag) of every distinct tag that a glob matches without case. tags: (tag); patterns: (pattern).

    A pattern is looked up by the rarest of its grams: tags meet patterns by equality of a gram, and the rule decides. So the work is in
    proportion to tags that share a pattern's rarest gram; no side is held whole by a task, and no pair is tried that shares nothing.
    """
    spark = tags.sparkSession
    tags = tags.select("tag").where("tag IS NOT NULL").distinct()
    rules = patterns.select("pattern").where("pattern IS NOT NULL").distinct().withColumn("rule", glob_regex(F.lower("pattern")))
    longest = tags.agg(F.max(F.length("tag")).alias("n")).first()["n"]
    if longest is None:
        return spark.createDataFrame([], "pattern string, tag string")
    keys = store(_keys_of(rules, longest), new_path(spark, "pattern-keys"))
    sizes = [r["size"] for r in keys.select("size").distinct().collect()]  # of 0 to 3
    marked = F.concat(F.lit(_BEGIN), F.lower("tag"), F.lit(_END))

    def keyed(size: int) -> Column:
        own = _grams(marked, size) if size else F.array(F.length("tag").cast("string"))
        return F.transform(own, lambda k: F.struct(F.lit(size).alias("size"), k.alias("key")))

    all_keys = F.concat(F.array().cast("array<struct<size:int,key:string>>"), *[keyed(n) for n in sizes])
    posted = store(tags.select("tag", F.explode(F.array_distinct(all_keys)).alias("k")).select("tag", "k.*"), new_path(spark, "tag-keys"))
    counts = posted.groupBy("size", "key").agg(F.count("*").alias("n"))
    rated = keys.where("size > 0").join(counts.hint("merge"), ["size", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("pattern", "rule", "size").agg(F.min_by("key", F.struct("n", "key")).alias("key"))
    chosen = rarest.unionByName(keys.where("size = 0"))
    met = posted.join(chosen.hint("merge"), ["size", "key"]).where(F.rlike(F.lower("tag"), F.col("rule")))
    return met.select("pattern", "tag").distinct()


def installed_models(models: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, tag): a row for each installed tag of each target, so that no row grows with the inventory. models: (tag); targets: (id, model_tag, model_patterns).

    An exact tag matches itself; where there is none, each pattern is matched without case.
    """
    tags = models.select("tag").distinct()
    exact = targets.where(F.col("model_tag").isNotNull()).select("id", F.col("model_tag").alias("tag")).join(tags.hint("merge"), "tag").select("id", "tag")
    wanted = targets.where(F.col("model_tag").isNull()).select("id", F.explode("model_patterns").alias("pattern")).distinct()
    met = store(pattern_matches(tags, wanted), new_path(tags.sparkSession, "matches"))
    return wanted.join(met.hint("merge"), "pattern").select("id", "tag").union(exact).distinct()


def match_models(models: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its installed tags, sorted, and a status (see installed_models, which has a row for each tag)."""
    found = installed_models(models, targets).groupBy("id").agg(F.sort_array(F.collect_list("tag")).alias("installed"))
    out = targets.select("id").join(found.hint("merge"), "id", "left")
    return out.select("id", F.coalesce("installed", F.array().cast("array<string>")).alias("installed"), F.when(F.col("installed").isNotNull(), "available").otherwise("not_installed").alias("status"))


def build_requests(pending: DataFrame, samples: DataFrame, targets: DataFrame, prompts: DataFrame) -> DataFrame:
    """A request row for each pending sample. targets: (run_id, model, kind, prompt_id, min_image_side, long_image_side, num_ctx, num_predict, max_tokens, top_k)."""
    t = targets.withColumn("s", with_model_defaults(*[F.col(c) for c in ("model", "prompt_id", "min_image_side", "long_image_side", "num_ctx")])).drop("prompt_id", "min_image_side", "long_image_side", "num_ctx").select("*", "s.*").drop("s")
    rows = pending.join(samples.select("dataset", "sample_id", "image").hint("merge"), ["dataset", "sample_id"]).join(few(t), "run_id").join(few(prompts), "prompt_id")
    body = F.when(F.col("kind") == "chat", chat_request(*[F.col(c) for c in ("model", "text", "image", "max_tokens", "top_k")])).otherwise(generate_request(*[F.col(c) for c in ("model", "text", "image", "num_predict", "num_ctx")]))
    return rows.select("dataset", "run_id", "sample_id", "model", "prompt_id", "min_image_side", "long_image_side", body.alias("body"))
