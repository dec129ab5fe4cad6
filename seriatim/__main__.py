"""The command line: ``python -m seriatim <command> ...``.

    clean posts.json out --base-url URL        cleaned posts as arrays by many tasks, and their pictures
    upload posts.json --store DIR --slug S --name N --url U [--author A] [--dry-run]
    subscribe --store DIR --email E --blog S [--frequency 7]
    check --store DIR [--as-of T] [--verbose]
    send --store DIR --letters DIR [--as-of T] [--limit N] [--dry-run]
    scrape-curated links.json pages.parquet out.parquet
    scrape-book index.parquet pages.parquet out.parquet --prefix /b/ --base-url URL

Pages come recorded (url, html), nothing is fetched.  Only here is the clock the default for ``--as-of``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seriatim import commands
from seriatim.session import session
from seriatim.sources import files, strategies


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seriatim")
    sub = p.add_subparsers(dest="command", required=True)

    def add(command: str, *places: str, **options) -> argparse.ArgumentParser:
        c = sub.add_parser(command)
        for x in places:
            c.add_argument(x)
        for x, how in options.items():
            c.add_argument(f"--{x.replace('_', '-')}", **how)
        return c

    need, flag = {"required": True}, {"action": "store_true"}
    now = {"default": None, "help": "an instant in UTC, by default now"}
    add("clean", "posts", "out", base_url=need)
    add("upload", "posts", store=need, slug=need, name=need, url=need, author={}, author_email={}, dry_run=flag, as_of=now)
    add("subscribe", store=need, email=need, blog=need, frequency={"type": int, "default": 7}, as_of=now)
    add("check", store=need, verbose=flag, as_of=now)
    add("send", store=need, letters={"default": None}, limit={"type": int, "default": None}, dry_run=flag, app_url={"default": "https://reader.example.org"}, source={"default": "reader"}, reply_to={"default": None}, as_of=now)
    add("scrape-curated", "links", "pages", "out")
    add("scrape-book", "index", "pages", "out", prefix=need, base_url=need)
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    as_of = F.lit(getattr(a, "as_of", None) or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    store = commands.Store(spark, a.store) if getattr(a, "store", None) else None
    if a.command == "clean":
        d = commands.clean(files.posts_file(spark, a.posts), a.base_url)
        files.write_large_array(d.drop("cleaned").withColumn("file", F.lit("posts")), f"{a.out}/posts", [F.asc("post_index"), F.asc("url")], "file", F.floor(F.col("post_index") / 1024))
        pictures = files.write_images(d, f"{a.out}/pictures")
        print(f"cleaned posts in {a.out}/posts" + (f", pictures in {a.out}/pictures" if pictures else ""))
    elif a.command == "upload":
        posts = files.posts_file(spark, a.posts)
        if a.dry_run:
            print(f"would upload {posts.count()} posts to {a.slug}")
            return 0
        blog = spark.createDataFrame([(a.slug, a.name, a.url, a.author, a.author_email)], "slug string, name string, url string, author string, author_email string")
        commands.upload(store, blog, posts.withColumn("blog", F.lit(a.slug)), as_of)
        print(f"uploaded {store.read('posts').join(store.read('blogs').filter(F.col('slug') == a.slug).select(F.col('id').alias('blog_id')), 'blog_id').count()} posts to {a.slug}")
    elif a.command == "subscribe":
        missing = commands.subscribe(store, spark.createDataFrame([(a.email, a.blog, a.frequency)], "email string, blog string, frequency_days int"), as_of)
        if not missing.isEmpty():
            print(f"no blog {a.blog}", file=sys.stderr)
            return 1
        print(f"subscribed {a.email} to {a.blog}, every {a.frequency} days")
    elif a.command == "check":
        due = commands.check(store, as_of)
        print(f"{due.count()} due")
        if a.verbose:
            for r in due.select("subscriber_email", "blog_name", "post_index", "total_posts").orderBy("subscriber_email", "blog_name").toLocalIterator():
                print(f"  {r['subscriber_email']}: {r['blog_name']} ({r['post_index']}/{r['total_posts']})")
    elif a.command == "send":
        if not a.dry_run and not a.letters:
            print("send needs --letters, a folder that isn't there yet", file=sys.stderr)
            return 2
        n = commands.send(store, a.letters, as_of, a.app_url, a.source, a.reply_to, a.limit, a.dry_run)
        print(f"{'would send' if a.dry_run else 'sent'} {n}")
    elif a.command == "scrape-curated":
        found = files.curated_posts(files.links_file(spark, a.links), spark.read.parquet(a.pages))
        found.write.parquet(a.out)
        print(f"{spark.read.parquet(a.out).count()} posts in {a.out}")
    elif a.command == "scrape-book":
        found = strategies.book_chapters(spark.read.parquet(a.index), spark.read.parquet(a.pages), a.prefix, a.base_url)
        found.write.parquet(a.out)
        print(f"{spark.read.parquet(a.out).count()} chapters in {a.out}")
    return 0


if __name__ == "__main__":
    sys.exit(run(session(), parser().parse_args()))
