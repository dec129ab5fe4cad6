"""Queries of text, date and URL functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriatim.functions import dates, text, urls
from seriatim.plans.binding import Tables, sql
from seriatim.plans.registry import query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", "text")


SLUG = "substr(regexp_replace(regexp_replace(regexp_replace(trim(lower({0})), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)"
WORDS = "len(list_filter(regexp_split_to_array({0}, '[\\s\\x1C-\\x1F]+'), lambda w: w <> ''))"
HEAD = "substr(text, 1, 250)"


def _until(c: str) -> str:
    return f"nullif(regexp_extract({HEAD}, '(?s)^(.{{51,199}}{c})', 1), '')"


@query(f"SELECT doc_id, {SLUG.format('text')} AS slug FROM documents")
def f01_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query(f"""SELECT doc_id, CASE WHEN text = '' THEN '' ELSE coalesce({_until('[.]')}, {_until('!')}, {_until('[?]')},
  CASE WHEN length({HEAD}) > 200 AND regexp_extract({HEAD}, '(?s)^(.{{51,199}}) ', 1) <> '' THEN regexp_extract({HEAD}, '(?s)^(.{{51,199}}) ', 1) || '...' END,
  substr({HEAD}, 1, 200) || CASE WHEN length(text) > 200 THEN '...' ELSE '' END) END AS excerpt FROM documents""")
def f03_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query("SELECT doc_id, CASE WHEN position(' ' IN substr(text, 1, 200)) > 0 THEN regexp_extract(substr(text, 1, 200), '(?s)^(.*) ', 1) ELSE substr(text, 1, 200) END || '...' AS excerpt FROM documents")
def f04_excerpts_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.excerpt_words(F.col("text")).alias("excerpt"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 150 THEN text ELSE CASE WHEN length(regexp_extract(substr(text, 1, 150), '(?s)^(.*) ', 1)) > 100
  THEN regexp_extract(substr(text, 1, 150), '(?s)^(.*) ', 1) ELSE substr(text, 1, 150) END || '...' END AS excerpt FROM documents""")
def f05_excerpts_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.excerpt_short(F.col("text")).alias("excerpt"))


@query(f"""SELECT doc_id, CAST(n AS INTEGER) AS words, CAST(greatest(1, round_even(n / 250.0, 0)) AS INTEGER) AS minutes, CAST(greatest(1, floor(n / 250.0)) AS INTEGER) AS minutes_floor
  FROM (SELECT doc_id, {WORDS.format('text')} AS n FROM documents)""")
def f06_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).alias("words"))
    return d.select("doc_id", "words", text.reading_minutes(F.col("words")).alias("minutes"), text.reading_minutes_floor(F.col("words")).alias("minutes_floor"))


@query(f"SELECT source AS blog_id, CAST(sum({WORDS.format('text')}) AS BIGINT) AS words FROM documents GROUP BY source")
def a11_words_by_blog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).documents
    return d.select(F.col("source").alias("blog_id"), text.word_count(F.col("text")).cast("long").alias("w")).groupBy("blog_id").agg(F.sum("w").alias("words"))


@query("""SELECT l_orderkey, l_linenumber, n, CASE WHEN n > 0 THEN CAST(round_even(l_linenumber / n * 100, 0) AS INTEGER) ELSE 0 END AS even, CASE WHEN n > 0 THEN CAST(floor(l_linenumber / n * 100 + 0.5) AS INTEGER) ELSE 0 END AS half_up FROM (SELECT *, l_quantity - 5 AS n FROM lineitem)""")
def f09_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).table("lineitem").withColumn("n", F.col("l_quantity") - 5)  # some have no total
    i, n = F.col("l_linenumber"), F.col("n")
    return d.select("l_orderkey", "l_linenumber", "n", text.progress_percent(i, n).alias("even"), text.progress_percent_half_up(i, n).alias("half_up"))


@query("SELECT doc_id, trim(regexp_replace(text, '[\\s\\x1C-\\x1F]+', ' ', 'g')) AS text FROM documents")
def f15_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.normalize_space(F.col("text")).alias("text"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, 'FOR PRIVATE (?:DISTRIBUTION|CIRCULATION)(?: ONLY)?\\s*\\n?', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text
  FROM (SELECT doc_id, regexp_replace(chr(10) || '- 12 -' || chr(10) || 'FOR PRIVATE CIRCULATION ONLY' || chr(10) || replace(text, '.', chr(10) || chr(10) || chr(10)), '\\n\\s*-\\s*\\d+\\s*-\\s*\\n', chr(10), 'g') AS t FROM documents)""")
def f16_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("\n- 12 -\nFOR PRIVATE CIRCULATION ONLY\n"), F.replace("text", F.lit("."), F.lit("\n\n\n")))
    return _docs(spark, sf_dir).select("doc_id", text.clean_scan(raw).alias("text"))


@query("""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: trim(p)), lambda p: p <> ''),
  lambda p: '<p>' || regexp_replace(replace(replace(replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '  +', ' ', 'g') || '</p>'), chr(10)) AS html FROM documents""")
def f17_paragraphs_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.paragraphs_html(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("html"))


@query("""SELECT doc_id, len(p) AS n, array_to_string(p, chr(10) || chr(10)) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '([\\p{L}\\p{N}_])-\\s+([\\p{L}\\p{N}_])', '\\1\\2', 'g'), '^\\s+|\\s+$', '', 'g')),
  lambda x: length(x) >= 20 AND NOT regexp_matches(x, '(?i)^(Figure|Table|Picture|Box)\\s+\\d') AND NOT starts_with(x, 'DOI:') AND NOT regexp_matches(x, '^PART\\s+[IVX]+') AND NOT regexp_matches(x, '^[\\d\\s.,<>%]+$')) AS p FROM documents)""")
def f18_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", text.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("p"))
    return d.select("doc_id", F.size("p").alias("n"), F.array_join("p", "\n\n").alias("text"))


@query("SELECT doc_id, regexp_replace('(1,2–3)' || text, '\\(\\d{1,3}(?:\\s*[,–—-]\\s*\\d{1,3})*\\)', '', 'g') AS text FROM documents")
def f19_no_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.strip_citations(F.concat(F.lit("(1,2–3)"), "text")).alias("text"))


@query("SELECT doc_id, regexp_replace(translate('“It’s”  ' || text, '‘’“”', '''''\"\"'), '  +', ' ', 'g') AS text FROM documents")
def f20_straight_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.straight_quotes(F.concat(F.lit("“It’s”  "), "text")).alias("text"))


@query("SELECT page_id, regexp_replace(regexp_extract(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)?', 1), '/+$', ''), '([^/]*)$', 1), '\\.html$', '') AS slug FROM pages")
def f23_url_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).table("pages").select("page_id", urls.slug_of(F.col("url")).alias("slug"))


@query("SELECT p_partkey, trim(split_part(p_name || ' | ' || p_type, '|', 1)) AS title, array_to_string(list_transform(string_split(lower(replace(p_name, '-', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS shown FROM part")
def f25_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).table("part")
    return d.select("p_partkey", text.title_part(F.concat_ws(" | ", "p_name", "p_type"), "|").alias("title"), text.title_from_slug(F.col("p_name")).alias("shown"))


@query("""SELECT page_id, url, split_part(url, '/', 3) AS authority, coalesce(nullif(regexp_extract(url, '[?&]page=([^&]*)', 1), ''), '1') AS page FROM pages""")
def src16_url_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).table("pages")
    return d.select("page_id", "url", urls.authority(F.col("url")).alias("authority"), urls.parameter(F.col("url"), "page", "1").alias("page"))


_PATH = "regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)', 1)"
_BAD = "(tag/|category/|author/|page/|about|contact|privacy|terms|feed|sitemap|wp-content/|wp-admin/)"


@query(f"SELECT page_id, regexp_replace({_PATH}, '/+$', '') <> '' AND NOT regexp_matches(lower(regexp_replace({_PATH}, '/+$', '')), '/{_BAD}') AS is_post, len(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) >= 2 OR (len(list_filter(string_split({_PATH}, '/'), lambda x: x <> '')) = 1 AND length(replace({_PATH}, '/', '')) > 10) AS is_link FROM pages")
def p03_post_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages are posts of their own host (P-03), and which would an archive page's links take (P-04)."""
    d = Tables(spark, sf_dir).table("pages")
    return d.select("page_id", urls.is_post(F.col("url"), F.col("url")).alias("is_post"), urls.is_archive_link(F.col("url")).alias("is_link"))


_SITE = "regexp_extract(url, '^[a-z]+://[^/?#]*')"
_ABOVE = "regexp_replace(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), '[^/]+/$', '')"


@query(f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN {_SITE} || {_ABOVE} || 'p/' || CAST(page_id AS VARCHAR) WHEN 1 THEN {_SITE} || '/a/c?q#f' WHEN 2 THEN split_part(url, '//', 1) || '//other.org/x'
  WHEN 3 THEN regexp_extract(url, '^[^?#]*') || '?q=1' ELSE regexp_extract(url, '^[^#]*') || '#f' END AS url FROM pages""")
def f40_joined_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative references of five kinds, resolved against each page's URL."""
    k = F.col("page_id")
    href = F.when(k % 5 == 0, F.concat(F.lit("../p/./"), k.cast("string"))).when(k % 5 == 1, "/a/b/../c?q#f").when(k % 5 == 2, "//other.org/x").when(k % 5 == 3, "?q=1").otherwise("#f")
    return Tables(spark, sf_dir).table("pages").select("page_id", urls.join(F.col("url"), href).alias("url"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 6 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00') WHEN o_orderkey % 10 = 6 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') WHEN o_orderkey % 10 = 7 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00')
  WHEN o_orderkey % 10 = 8 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+02:00') ELSE 'unknown ' || CAST(o_orderkey AS VARCHAR) END AS iso FROM orders""")
def f70_parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    formats = [*dates.DAY_FORMATS, "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+0200'"]
    raw = F.coalesce(*(F.when(k % 10 == i, F.date_format(d, f)) for i, f in enumerate(formats)), F.concat(F.lit("unknown "), k.cast("string")))
    return Tables(spark, sf_dir).table("orders").select("o_orderkey", dates.parse_date(raw).alias("iso"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS first, strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%dT00:00:00') AS last FROM orders""")
def f71_dates_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.date_format("o_orderdate", "MMMM d, yyyy"), F.date_format(F.date_add(F.to_date("o_orderdate"), 40), "MMMM d yyyy")
    t = F.concat(F.lit("First on "), a, F.lit(", then on "), b, F.lit("."))
    return Tables(spark, sf_dir).table("orders").select("o_orderkey", dates.first_date(t).alias("first"), dates.last_date(t).alias("last"))


@query("SELECT p_partkey, CAST(DATE '1787-10-27' + CAST(p_partkey AS INTEGER) AS DATE) AS day, CAST(dayofweek(DATE '1787-10-27' + CAST(p_partkey AS INTEGER)) AS INTEGER) AS weekday FROM part")
def f73_serial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = dates.serial_date(F.col("p_partkey"))
    return Tables(spark, sf_dir).table("part").select("p_partkey", day.alias("day"), dates.weekday(day).alias("weekday"))


_LOCAL = "date_trunc('day', timezone(coalesce(timezone, 'America/New_York'), timezone('UTC', next_send_at))) + to_days(frequency_days)"
_SNAP = "to_days(CASE WHEN preferred_day IS NOT NULL AND frequency_days >= 7 THEN CAST((preferred_day - dayofweek({0}) + 7) % 7 AS INTEGER) ELSE 0 END)"


@query(sql("subscriptions", f"""SELECT id, timezone('UTC', timezone(coalesce(timezone, 'America/New_York'), d + {_SNAP.format('d')} + to_hours(coalesce(preferred_hour, 9)))) AS next_send_at
  FROM (SELECT *, {_LOCAL} AS d FROM subscriptions)"""))
def s01_next_send_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    d = Tables(spark, sf_dir).subscriptions
    return d.select("id", dates.next_send_local(c("next_send_at").cast("timestamp"), c("frequency_days"), c("preferred_day"), c("preferred_hour"), c("timezone")).cast("timestamp_ntz").alias("next_send_at"))


_INSTANT = "date_trunc('day', timezone(coalesce(timezone, 'America/New_York'), timezone('UTC', next_send_at + to_hours(24 * frequency_days))))"


@query(sql("subscriptions", f"""SELECT id, timezone('UTC', timezone(coalesce(timezone, 'America/New_York'), d + to_hours(coalesce(preferred_hour, 9)))) + {_SNAP.format('d')} AS next_send_at
  FROM (SELECT *, {_INSTANT} AS d FROM subscriptions)"""))
def s02_next_send_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    zone, hour = F.coalesce("timezone", F.lit(dates.DEFAULT_ZONE)), F.coalesce(c("preferred_hour").cast("int"), F.lit(dates.DEFAULT_HOUR))
    d = Tables(spark, sf_dir).subscriptions
    return d.select("id", dates.next_send_instant(c("next_send_at").cast("timestamp"), c("frequency_days"), c("preferred_day"), hour, zone).cast("timestamp_ntz").alias("next_send_at"))


@query(sql("subscriptions", "SELECT id, next_send_at + to_days(frequency_days) AS next_send_at FROM subscriptions"))
def s03_next_send_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Tables(spark, sf_dir).subscriptions
    return d.select("id", dates.next_send_simple(F.col("next_send_at").cast("timestamp"), F.col("frequency_days")).cast("timestamp_ntz").alias("next_send_at"))


@query("SELECT event_id, user_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), 0) AS k, coalesce(json_extract_string(props, '$.none'), '') AS missing FROM events")
def f62_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.from_json("props", "k INT, none STRING")
    d = Tables(spark, sf_dir).table("events").withColumn("p", p)
    return d.select("event_id", "user_id", F.coalesce("p.k", F.lit(0)).alias("k"), F.coalesce("p.none", F.lit("")).alias("missing"))


@query("""SELECT n_nationkey, '{"name":"' || n_name || '","position":' || CAST(n_nationkey AS VARCHAR) || '}' AS json FROM nation""")
def f63_json_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured data of a listing; null fields are left out."""
    s = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"), F.lit(None).cast("string").alias("url")))
    return Tables(spark, sf_dir).table("nation").select("n_nationkey", s.alias("json"))


@query("SELECT c_custkey, replace(replace(c_name, '#', '%23'), ' ', '%20') AS part FROM customer")
def f31_url_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).table("customer").select("c_custkey", text.url_component(F.col("c_name")).alias("part"))


@query("SELECT n_nationkey, '<b>name:</b> ' || n_name || '<br><b>region:</b> ' || CAST(n_regionkey AS VARCHAR) AS html FROM nation")
def prj08_detail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.create_map(F.lit("name"), F.col("n_name"), F.lit("note"), F.lit(None).cast("string"), F.lit("region"), F.col("n_regionkey").cast("string"))
    return Tables(spark, sf_dir).table("nation").select("n_nationkey", text.detail_lines(m).alias("html"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'X' || p_name || chr(10) || 'Next Line' WHEN 1 THEN 'x' || chr(10) || p_name ELSE 'Xyz' || chr(10) || p_name END AS text FROM part")
def f21_rejoined_capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names behind a line that is a capital, a small letter, or too long."""
    first = F.when(F.col("p_partkey") % 4 == 0, "X").when(F.col("p_partkey") % 4 == 1, "x").otherwise("Xyz")
    lines = F.concat_ws("\n", first, F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, "Next Line"))
    return Tables(spark, sf_dir).table("part").select("p_partkey", text.rejoin_capitals(lines).alias("text"))


@query("SELECT p_partkey, p_name AS subject FROM part")
def f27_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as headings, with a journal's name behind."""
    head = F.concat("p_name", F.lit(". From the Daily Advertiser. Thursday, 1787"))
    return Tables(spark, sf_dir).table("part").select("p_partkey", text.subject_cut(head, [" For the ", " From the "], ["Journal", "Packet", "Advertiser"]).alias("subject"))


_SLUG = "regexp_replace(regexp_replace(trim(regexp_replace(translate(lower(text), '—–''’', '--'), '[^a-z0-9\\s-]', '', 'g')), '\\s+', '-', 'g'), '-+', '-', 'g')"


@query(f"SELECT doc_id, 'ch1-' || CASE WHEN length(s) <= 60 THEN s WHEN position('-' IN s[1:60]) > 0 THEN regexp_extract(s[1:60], '^(.*)-', 1) ELSE s[1:60] END AS slug FROM (SELECT doc_id, {_SLUG} AS s FROM documents)")
def f02_section_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.section_slug(F.lit("ch1"), F.col("text")).alias("slug"))


_S = "regexp_replace(x, '^\\s+|\\s+$', '', 'g')"


@query(f"""SELECT doc_id, array_to_string(list_filter(string_split('42 The Long Road' || chr(10) || text, chr(10)), lambda x: NOT (
  (regexp_matches({_S}, '^\\d{{1,3}}\\s+[A-Z]') AND lower(regexp_replace({_S}, '^\\d{{1,3}}\\s+', '')) = 'the long road') OR (regexp_matches({_S}, '^[A-Z].*\\s+\\d{{1,3}}$') AND lower(regexp_replace({_S}, '\\s+\\d{{1,3}}$', '')) = 'the long road')
  OR regexp_matches({_S}, '^[A-Z][A-Z\\s’—,-]+\\d{{1,3}}$') OR starts_with({_S}, 'DOI:'))), chr(10)) AS text FROM documents""")
def p16_page_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a page header put before them and taken out again."""
    raw = F.concat(F.lit("42 The Long Road\n"), "text")
    return _docs(spark, sf_dir).select("doc_id", text.without_page_headers(raw, ["the long road"]).alias("text"))
