"""Catalogues: feeds with their counts, groups by author, tags, ordering and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriatim.operators.merge import unused


def tag_counts(posts: DataFrame) -> DataFrame:
    """blog_id, tag, n: posts of each blog by tag; a tag counts once a post."""
    return posts.select("blog_id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("blog_id", "tag").agg(F.count("*").alias("n"))


def with_blog(rows: DataFrame, blogs: DataFrame) -> DataFrame:
    """``rows`` with their blog as a struct, null where there is none."""
    b = blogs.select(F.col("id").alias("blog_id"), F.struct(*blogs.columns).alias("blog"))
    return rows.join(b, "blog_id", "left")


def feed_counts(feeds: DataFrame, blogs: DataFrame, posts: DataFrame, counted: bool = False) -> DataFrame:
    """``feeds`` with ``n_posts``: tagged posts of a feed with a tag, else the blog's stored count, or with ``counted`` its rows."""
    own, all_ = unused("tagged", feeds), unused("whole", feeds)
    tagged = tag_counts(posts).withColumnRenamed("tag", "tag_filter").withColumnRenamed("n", own)
    if counted:
        whole = posts.groupBy("blog_id").agg(F.count("*").alias(all_))
    else:
        whole = blogs.select(F.col("id").alias("blog_id"), F.col("post_count").cast("long").alias(all_))
    has_tag = F.coalesce("tag_filter", F.lit("")) != ""
    d = feeds.join(tagged, ["blog_id", "tag_filter"], "left").join(whole, "blog_id", "left")
    return d.select(*feeds.columns, F.coalesce(F.when(has_tag, F.col(own)).otherwise(F.col(all_)), F.lit(0)).alias("n_posts"))


def feed_posts(feed_tag: Column, posts: DataFrame) -> DataFrame:
    """Posts of a feed: all where it has no tag."""
    return posts.filter((F.coalesce(feed_tag, F.lit("")) == "") | F.array_contains("tags", feed_tag))


def feed_lists(feeds: DataFrame, posts: DataFrame, bucket: Column, first: int | None = 50) -> DataFrame:
    """feed_id, place, post_id, n_posts: every feed's posts in order, those of its tag where it has one, at most the ``first`` of each; ``bucket`` of post_index as for ``numbered``."""
    f = feeds.select(F.col("id").alias("feed_id"), "blog_id", F.coalesce("tag_filter", F.lit("")).alias("tag"))
    whole = posts.select("blog_id", F.lit("").alias("tag"), F.col("id").alias("post_id"), "post_index")
    tagged = posts.select("blog_id", F.explode(F.array_distinct("tags")).alias("tag"), F.col("id").alias("post_id"), "post_index").filter("tag <> ''")
    d = numbered(whole.unionByName(tagged), ["blog_id", "tag"], [F.asc("post_index"), F.asc("post_id")], "place", bucket)
    counts = d.groupBy("blog_id", "tag").agg(F.count("*").alias("n_posts"))
    d = d.filter(F.col("place") <= first) if first else d
    return f.join(d, ["blog_id", "tag"]).join(counts, ["blog_id", "tag"]).select("feed_id", "place", "post_id", "n_posts")


def by_author(feeds: DataFrame, awaiting: list[str]) -> DataFrame:
    """author, feeds (names in order), place: groups in the catalogue's order, authors that await permission last."""
    g = feeds.withColumn("author", F.coalesce(F.nullif("author", F.lit("")), F.lit("Unknown"))).groupBy("author").agg(F.sort_array(F.collect_list(F.struct("name", "slug"))).alias("f"))
    last = F.col("author").isin(awaiting) if awaiting else F.lit(False)
    w = Window.orderBy(F.when(last, 1).otherwise(0), F.collate("author", "UNICODE"), "author")
    return g.select("author", F.transform("f", lambda x: x["name"]).alias("feeds"), F.row_number().over(w).alias("place"))


def blog_tags(posts: DataFrame) -> DataFrame:
    """blog_id and all its posts' tags, sorted, each once."""
    return posts.select("blog_id", F.explode_outer("tags").alias("t")).groupBy("blog_id").agg(F.array_sort(F.collect_set("t")).alias("tags"))


def inverted(themes: DataFrame) -> DataFrame:
    """path and its themes in the order of ``position``, from (position, theme, paths)."""
    d = themes.select("position", "theme", F.explode("paths").alias("path"))
    return d.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "theme"))), lambda x: x["theme"]).alias("themes"))


def at_limit(subscriptions: DataFrame, most: int = 3) -> DataFrame:
    """subscriber_id, n, at_limit: running subscriptions of each subscriber."""
    d = subscriptions.filter(F.col("is_active") & ~F.col("is_completed"))
    return d.groupBy("subscriber_id").agg(F.count("*").alias("n")).withColumn("at_limit", F.col("n") >= most)


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str = "post_index", bucket: Column | None = None) -> DataFrame:
    """Rows numbered from 1 within ``group`` by ``order``, which is unique there.

    ``bucket`` never falls along ``order`` (a date's month, an id's thousands, a name's first letters).  With it rows are
    ranked within group and bucket, and the counts of the buckets before are added, so a hot group is ranked by many
    tasks; the counts are a row for each group and bucket.
    """
    if bucket is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    b, base = unused("bucket", rows), unused("base", rows)
    d = rows.withColumn(b, bucket)
    before = Window.partitionBy(*group).orderBy(F.asc_nulls_first(b)).rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*group, b).agg(F.count("*").alias(base)).withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    counts = counts.select(*(F.col(g).alias(unused(g, rows)) for g in group), F.col(b).alias(f"{b}_"), base)
    own = F.row_number().over(Window.partitionBy(*group, b).orderBy(*order))
    same = reduce(Column.__and__, [*(F.col(g).eqNullSafe(F.col(unused(g, rows))) for g in group), F.col(b).eqNullSafe(F.col(f"{b}_"))])
    return d.withColumn(name, own).join(counts, same).select(*rows.columns, (F.col(name) + F.col(base)).cast("int").alias(name))


def neighbour(rows: DataFrame, group: list[str], order: list[str], value: str, name: str, ahead: bool = True, bucket: Column | None = None) -> DataFrame:
    """``rows`` with the ``value`` of the next row (or the one before) of their ``group`` by ``order``, which is unique there; null at the end.

    ``bucket`` never falls along ``order``.  With it rows find their neighbour within group and bucket, and those at a
    bucket's border take it from the nearest bucket that has rows: one row for each group and bucket holds the values at
    its ends, so no task has more than a bucket.
    """
    step = F.lead if ahead else F.lag
    keys = [F.asc_nulls_first(c) for c in order]
    if bucket is None:
        return rows.withColumn(name, step(value).over(Window.partitionBy(*group).orderBy(*keys)))
    b, inner, edge, border = (unused(x, rows) for x in ("bucket", "inner", "edge", "border"))
    d = rows.withColumn(b, bucket)
    within = Window.partitionBy(*group, b).orderBy(*keys)
    d = d.withColumn(inner, step(value).over(within)).withColumn(edge, step(F.lit(1)).over(within).isNull())
    at = F.struct(*(F.struct(F.col(c).isNotNull(), F.col(c)) for c in order))  # as nulls first
    ends = d.groupBy(*group, b).agg((F.min_by if ahead else F.max_by)(F.struct(value), at).alias(border))
    ends = ends.withColumn(border, step(border).over(Window.partitionBy(*group).orderBy(F.asc_nulls_first(b)))[value])
    ends = ends.select(*(F.col(g).alias(unused(g, rows)) for g in group), F.col(b).alias(f"{b}_"), border)
    same = reduce(Column.__and__, [*(F.col(g).eqNullSafe(F.col(unused(g, rows))) for g in group), F.col(b).eqNullSafe(F.col(f"{b}_"))])
    return d.join(ends, same).select(*rows.columns, F.when(F.col(edge), F.col(border)).otherwise(F.col(inner)).alias(name))


def coloured(rows: DataFrame, order: list[Column], bucket: Column, colours: int = 10, name: str = "colour") -> DataFrame:
    """``rows`` with a colour's number, in turn along ``order``; ``bucket`` as for ``numbered``."""
    nothing = unused("all", rows)
    d = numbered(rows.withColumn(nothing, F.lit(0)), [nothing], order, name, bucket)
    return d.drop(nothing).withColumn(name, F.pmod(F.col(name) - 1, F.lit(colours)))


def dated(undated_first: bool = True) -> Column:
    """The key that sorts ISO strings, with undated rows first or last."""
    return F.coalesce(F.nullif("published_at", F.lit("")), F.lit("0000" if undated_first else "9999"))


def sections(headings: DataFrame, group: str, position: str, end: Column, bucket: Column | None = None) -> DataFrame:
    """Each heading's extent, up to the next one's position or ``end``; ``bucket`` as for ``neighbour``."""
    return neighbour(headings, [group], [position], position, "until", bucket=bucket).withColumn("until", F.coalesce("until", end))


def concatenated(parts: list[DataFrame], order: list[Column]) -> DataFrame:
    """Several series one after the other, numbered anew from 1 as ``post_index``: each by itself, and on from the sizes of those before."""
    series = unused("series", *parts)
    d = reduce(DataFrame.unionByName, (p.withColumn(series, F.lit(i)) for i, p in enumerate(parts)))
    nothing = unused("all", *parts)
    return numbered(d.withColumn(nothing, F.lit(0)), [nothing], order, bucket=F.col(series)).drop(series, nothing)


def site_entries(app_url: str, feeds: DataFrame, blogs: DataFrame, pages: list[tuple[str, float]]) -> DataFrame:
    """url and priority of fixed pages, active feeds and active blogs."""
    fixed = feeds.sparkSession.createDataFrame([(f"{app_url}{p}", w) for p, w in pages], "url string, priority double")
    f = feeds.filter("is_active").select(F.concat(F.lit(f"{app_url}/feeds/"), "slug").alias("url"), F.lit(0.8).alias("priority"))
    b = blogs.filter("is_active").select(F.concat(F.lit(f"{app_url}/blogs/"), "slug").alias("url"), F.lit(0.7).alias("priority"))
    return fixed.unionByName(f).unionByName(b)


def single(df: DataFrame, required: bool = True):
    """The only row; an error for several, and for none if it is required."""
    rows = df.limit(2).collect()
    if len(rows) > 1 or (required and not rows):
        raise ValueError(f"expected one row, found {'several' if rows else 'none'}")
    return rows[0] if rows else None


def top_requests(board: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` requests with most votes; ties by age, then id."""
    return board.orderBy(F.desc("vote_count"), F.asc("created_at"), F.asc("id")).limit(n)
