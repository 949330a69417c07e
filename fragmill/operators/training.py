"""Training pairs from tags: attribution of a tag to one fragment of each member by token lift, hard negatives from tags that
occur together, and the pairs and triplets built of them.

Tables: fragments (entity, fragment, tokens), one row per fragment; members (tag, entity, pos), pos being a member's place in
its tag's list; tags (tag, description)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.tokens import content_tokens, spaced
from ..sources.scratch import written
from .sequences import adjacent_pairs, hash_order


@dataclass(frozen=True)
class Attribution:
    """Fixed values of the attribution."""

    min_margin: float = 0.5
    min_rate: float = 0.5
    min_rate_sample: int = 8
    min_members: int = 20
    min_global_df: int = 25
    min_local_count: int = 3
    unknown_lift: float = -0.5
    anchor_lift: float = 1.5


def global_df(fragments: DataFrame) -> DataFrame:
    """(token, gdf) over all fragments."""
    return fragments.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("gdf"))


def token_lift(fragments: DataFrame, members: DataFrame, tags: DataFrame | None = None, p: Attribution = Attribution()) -> DataFrame:
    """(tag, token, lift): how much more frequent a token is among a tag's members than in all fragments.  The words of a
    tag's own name and description have at least anchor_lift."""
    return _lift(written(fragments.select("entity", "tokens"), "fragment-tokens"), members, tags, p)  # three parts of the plan read them


def _lift(fragments: DataFrame, members: DataFrame, tags: DataFrame | None, p: Attribution) -> DataFrame:
    counts = global_df(fragments).where(F.col("gdf") >= p.min_global_df)
    total = fragments.agg(F.count("*").alias("total"))
    local = members.select("tag", "entity").distinct().join(fragments, "entity")
    local_df = local.select("tag", F.explode("tokens").alias("token")).groupBy("tag", "token").agg(F.count("*").alias("n")).where(F.col("n") >= p.min_local_count)
    local_total = local.groupBy("tag").agg(F.count("*").alias("local_total"))
    lift = F.log((F.col("n") / F.col("local_total")) / (F.col("gdf") / F.col("total")))
    found = local_df.join(counts, "token").join(local_total, "tag").crossJoin(F.broadcast(total)).select("tag", "token", lift.alias("lift"))
    if tags is None:
        return found
    anchors = tags.select("tag", F.explode(content_tokens(F.concat_ws(" ", spaced(F.col("tag")), F.col("description")))).alias("token")).join(counts.select("token"), "token", "left_semi")
    both = found.unionByName(anchors.select("tag", "token", F.lit(p.anchor_lift).alias("lift")))
    return both.groupBy("tag", "token").agg(F.max("lift").alias("lift"))


def attribute(fragments: DataFrame, members: DataFrame, tags: DataFrame | None = None, p: Attribution = Attribution(), gate: bool = True) -> DataFrame:
    """(tag, entity, fragment, margin): the fragment that justifies the tag on each member.

    A member with one fragment needs no evidence (margin null).  One with several gets the fragment whose mean lift leads by
    min_margin, if the tag has min_members members.  A tag that resolves too few of its members is dropped whole."""
    fragments, members = written(fragments, "fragments"), written(members.select("tag", "entity").distinct(), "members")  # tokens are made once
    own = members.join(fragments, "entity")
    sizes = fragments.groupBy("entity").agg(F.count("*").alias("k"))
    facets = members.join(sizes, "entity")
    per_tag = facets.groupBy("tag").agg(F.count("*").alias("n"), F.count(F.when(F.col("k") > 1, 1)).alias("multis"))
    lift = _lift(fragments, members, tags, p)
    exploded = own.select("tag", "entity", "fragment", F.explode_outer("tokens").alias("token"))
    scored = exploded.join(lift, ["tag", "token"], "left").groupBy("tag", "entity", "fragment").agg(F.avg(F.coalesce("lift", F.lit(p.unknown_lift))).alias("score"))
    w = Window.partitionBy("tag", "entity").orderBy(F.desc("score"), "fragment")
    best = scored.withColumn("margin", F.col("score") - F.lead("score").over(w)).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    ran = (F.col("multis") > 0) & (F.col("n") >= p.min_members)
    picks = best.join(per_tag, "tag").where(F.col("margin").isNull() | (ran & (F.col("margin") >= p.min_margin)))
    picks = picks.select("tag", "entity", "fragment", "margin")
    if not gate:
        return picks
    resolved = picks.where(F.col("margin").isNotNull()).groupBy("tag").agg(F.count("*").alias("resolved"))
    judged = per_tag.join(resolved, "tag", "left").where(ran & (F.col("multis") >= p.min_rate_sample) & (F.coalesce("resolved", F.lit(0)) / F.col("multis") < p.min_rate))
    return picks.join(judged.select("tag"), "tag", "left_anti")


def co_tags(members: DataFrame, sample: int | None = None, min_overlap: int = 3, most: int = 12) -> DataFrame:
    """(tag, other, n, association, place): the tags most associated with each tag, by overlap over the other's size.

    All members of a tag are counted; with a sample, only so many of its first ones are, against all members of the others."""
    sizes = members.groupBy("tag").agg(F.count("*").alias("size"))
    overlap = _overlap(members) if sample is None else _sampled_overlap(members, sample)
    ranked = overlap.where(F.col("n") >= min_overlap).join(sizes.withColumnRenamed("tag", "other"), "other").withColumn("association", F.col("n") / F.col("size"))
    place = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("association"), F.desc("other")))
    return ranked.withColumn("place", place).where(F.col("place") <= most).select("tag", "other", "n", "association", "place")


def _overlap(members: DataFrame) -> DataFrame:
    """(tag, other, n): rows of a tag whose entity is a member of the other tag.  A pair of tags is met once for both directions."""
    held = members.groupBy("tag", "entity").agg(F.count("*").alias("m"))
    other = held.select(F.col("tag").alias("other"), "entity", F.col("m").alias("back"))
    met = held.join(other, "entity").where("tag < other").groupBy("tag", "other").agg(F.sum("m").alias("n"), F.sum("back").alias("back"))
    ways = F.explode(F.array(F.struct("tag", "other", "n"), F.struct(F.col("other").alias("tag"), F.col("tag").alias("other"), F.col("back").alias("n"))))
    return met.select(ways.alias("way")).select("way.*")


def _sampled_overlap(members: DataFrame, sample: int) -> DataFrame:
    first = members.withColumn("_n", F.row_number().over(Window.partitionBy("tag").orderBy("pos"))).where(F.col("_n") <= sample)
    first = written(first.select("tag", "entity"), "first-members")  # a few rows for each tag: Spark sees how large they are
    others = members.select(F.col("tag").alias("other"), "entity").join(first.select("entity").distinct(), "entity", "left_semi").distinct()
    return first.join(others, "entity").where("tag <> other").groupBy("tag", "other").agg(F.count("*").alias("n"))


def hard_negatives(members: DataFrame, cap: int = 2000, **options: int | None) -> DataFrame:
    """(tag, entity, pool_pos): members of associated tags that aren't members of the tag, the strongest association first.

    Of each associated tag only the first cap candidates count: behind them none can be among the tag's first cap, as those before
    it have the same tag and an earlier place or a smaller id.  So the first members of each associated tag are looked at, twice as
    many as the cap, and eight times as many each time only for the pairs of tags that don't yet have cap candidates and have more
    members.  A member listed twice counts at its first place."""
    members = written(members.groupBy("tag", "entity").agg(F.min("pos").alias("pos")), "members")
    near = written(co_tags(members, **options), "co-tags")  # a few rows for each tag: Spark sees how large they are
    sizes = members.groupBy(F.col("tag").alias("other")).agg(F.count("*").alias("size"))
    left, looked, pool = written(near.join(sizes, "other").select("tag", "other", "place", "size"), "pairs"), 2 * cap, None
    own, nearest = Window.partitionBy("other").orderBy("pos", "entity"), Window.partitionBy("tag", "other").orderBy("pos", "entity")
    while True:
        listed = members.select(F.col("tag").alias("other"), "entity", "pos").join(left.select("other").distinct(), "other", "left_semi")
        listed = listed.withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= looked).drop("_k")
        candidates = written(left.join(listed, "other").select("tag", "other", "place", "entity", "pos"), "candidates")
        known = members.select("tag", "entity").join(candidates.select("entity").distinct(), "entity", "left_semi")
        found = candidates.join(known, ["tag", "entity"], "left_anti").withColumn("_n", F.row_number().over(nearest)).where(F.col("_n") <= cap)
        found = written(found.drop("_n"), "found")
        counts = found.groupBy("tag", "other").agg(F.count("*").alias("n"))
        short = left.join(counts, ["tag", "other"], "left").where((F.coalesce("n", F.lit(0)) < cap) & (F.col("size") > looked)).drop("n")
        short = written(short.select("tag", "other", "place", "size"), "pairs")
        done = found.join(short.select("tag", "other"), ["tag", "other"], "left_anti")
        pool = done if pool is None else pool.unionByName(done)
        if short.isEmpty():
            break
        left, looked = short, 8 * looked
    first = pool.groupBy("tag", "entity").agg(F.min(F.struct("place", "pos")).alias("at"))
    # by the parts of the struct, which sort faster than it
    place = F.row_number().over(Window.partitionBy("tag").orderBy("at.place", "at.pos", "entity"))
    return first.withColumn("pool_pos", place).where(F.col("pool_pos") <= cap).select("tag", "entity", "pool_pos")


def distinct_texts(picks: DataFrame, order: str) -> DataFrame:
    """One pick per tag and text, the first by order."""
    return picks.withColumn("_n", F.row_number().over(Window.partitionBy("tag", "text").orderBy(order))).where("_n = 1").drop("_n")


def self_pairs(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("text").alias("anchor"), F.col("text").alias("positive")).distinct()


def tag_pairs(picks: DataFrame, order: str, salt: str, limit: int = 150) -> DataFrame:
    """(tag, anchor, positive): texts of one tag in pairs, not two of one entity; picks has tag, entity, text and order."""
    rows = distinct_texts(picks, order).withColumn("item", F.struct("entity", "text"))
    pairs = adjacent_pairs(rows.select("tag", "item", "text"), ["tag"], hash_order(salt, "tag", "text"), "item", limit)
    return pairs.where("left.entity <> right.entity").select("tag", F.col("left.text").alias("anchor"), F.col("right.text").alias("positive"))


def triplets(picks: DataFrame, pools: DataFrame, anchors: DataFrame, order: str, salt: str, limit: int = 600) -> DataFrame:
    """(tag, anchor, positive, negative): every anchor (tag, anchor) with up to limit texts of its tag, each with one text of the
    tag's pool (tag, text) that is no text of the tag; negative is null where the pool is empty, which makes the row a pair."""
    own = distinct_texts(picks, order)
    few = own.withColumn("_n", F.row_number().over(Window.partitionBy("tag").orderBy(hash_order(salt, "tag", "text"), "text"))).where(F.col("_n") <= limit)
    usable = pools.select("tag", "text").distinct().join(own.select("tag", "text"), ["tag", "text"], "left_anti")
    numbered = usable.withColumn("slot", F.row_number().over(Window.partitionBy("tag").orderBy(hash_order(salt + " pool", "text"), "text")) - 1)
    sizes = usable.groupBy("tag").agg(F.count("*").alias("size"))
    rows = few.join(anchors, "tag").join(sizes, "tag", "left")
    draw = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(salt), "anchor", "text"), 256), 1, 8), 16, 10).cast("bigint"), F.col("size"))
    rows = rows.withColumn("slot", F.when(F.col("size") > 0, draw)).select("tag", "anchor", F.col("text").alias("positive"), "slot")
    return rows.join(numbered.withColumnRenamed("text", "negative"), ["tag", "slot"], "left").select("tag", "anchor", "positive", "negative")
