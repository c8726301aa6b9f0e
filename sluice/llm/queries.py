"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, langid, linededup, mixing, quality, sharding, simhash, tokens, urlfilter, warc
from sluice.llm.shared import Scratch

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives in the shared folder and back."""
    path = Scratch(spark, "archives").new_path("warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdicts of all documents."""
    found = quality.quality(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found).withColumnRenamed("id", "doc_id")


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy of all documents in the flattest mixture that repeats no source over four times, with its block and position."""
    found = mixing.mixture(_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").withColumn("weight", F.round("weight", 9))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.withColumnRenamed("id", "doc_id")


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 40 shards, numbers of rows at most one apart."""
    found = sharding.shard(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: First host labels of unwanted kinds in the tables.
FAMILIES = ("adult", "casino-win", "free-bets", "ads-track", "cheap-pills", "spam-farm")


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of the query: URLs of every other page of the unwanted families, written in another way, and two URLs a page that no page has.

    Pages of these families whose URL is on no listed page, in whatever spelling, are not on the list.
    """
    rest = F.substring_index("url", "://", -1)
    hosts, paths = F.regexp_replace(urlfilter.host(F.col("url")), r"^www\.", ""), urlfilter.path(F.col("url"))
    label = F.regexp_extract(urlfilter.host(F.col("url")), r"^(?:www\.|m\.|blog\.)?([^.]*)", 1)
    family = F.exists(F.array(*[F.lit(f) for f in FAMILIES]), lambda f: label.startswith(f))
    port = F.when(hosts.contains(":"), "").otherwise(":80")
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    other = F.concat(F.lit("HTTP://www."), F.upper(hosts), port, paths, F.lit("/?utm_source=list&"), query, F.lit("#top"))
    known = pages.where(family & (F.col("page_id") % 2 == 0)).select(other.alias("url"))
    unknown = pages.select(F.explode(F.array(*[F.concat(F.lit(f"http://archive{k}."), hosts, paths) for k in (1, 2)])).alias("url"))
    return known.unionByName(unknown)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and listed URLs over all pages."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    found = urlfilter.judge(pages, listed_urls(pages))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines of all documents, and the documents that have them first."""
    found = linededup.line_report(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return found.withColumn("first_ids", F.array_join(F.transform("first_ids", lambda i: i.cast("string")), ","))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    found = tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return found.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_decontaminate": op4_decontaminate,
    "op5_mixture": op5_mixture,
    "op6_language": op6_language,
    "op7_shards": op7_shards,
    "op8_urls": op8_urls,
    "op9_lines": op9_lines,
    "op10_token_counts": op10_token_counts,
}

_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)

OP3_SQL = f"""
with split as (
  select doc_id, coalesce(text, '') as t from documents
), parts as (
  select doc_id, t,
    regexp_extract_all(t, '[^ \\t-\\r]+') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) as l
  from split
), windows as (
  select doc_id, i, w[i:i+4] as win
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from parts where len(w) >= 5)
), repeated as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from windows) where n > 1
), covered as (
  select doc_id, count(distinct i + k) as n from repeated, (select unnest(range(5)) as k) group by doc_id
), base as (
  select doc_id, len(w) as n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(l) - len(list_distinct(l)) as n_dup_lines,
    len(l) as n_lines,
    len(list_filter(w, lambda x: lower(x) in ({_STOP}))) as n_stop,
    len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t-\\r]*[-*•]'))) as n_bullet,
    len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t-\\r]*$'))) as n_ellipsis,
    coalesce(covered.n, 0) as n_repeat_words
  from parts left join covered using (doc_id)
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
    and word_chars / n_words between 2 and 15 and n_symbols / n_words <= 0.1 and n_stop / n_words >= 0.02
    and n_dup_lines / n_lines <= 0.5 and n_bullet / n_lines <= 0.9 and n_ellipsis / n_lines <= 0.5 as kept
from base
"""

_MATCH_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

OP4_SQL = f"""
with d as (select doc_id, {_MATCH_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_MATCH_WORDS} as w from benchmark),
bw as (
  select distinct item, n, array_to_string(w[i:i+n-1], ' ') as win
  from (select item, w, least(len(w), 13) as n, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from b where len(w) > 0)
),
lens as (select distinct n from bw),
dw as (
  select doc_id, n, i, array_to_string(w[i:i+n-1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)
),
hits as (select doc_id, i, dw.n, item from dw join bw on dw.win = bw.win and dw.n = bw.n),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits)) group by doc_id),
items as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as ids from hits group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join items using (doc_id)
"""

OP8_SQL = r"""
with u as (
  select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages
), s as (
  select page_id, rest,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))) as fields
  from u
), c as (
  select *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
      || case when len(fields) > 0 then '?' || array_to_string(fields, '&') else '' end as key,
    case
      when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
      when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
      when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
      when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
      when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/'
    end as rule
  from s
), listed as (
  select distinct key from c where regexp_matches(regexp_extract(host, '^(?:www\.|m\.|blog\.)?([^.]*)', 1), '^(adult|casino-win|free-bets|ads-track|cheap-pills|spam-farm)') and page_id % 2 = 0 and key <> ''
)
select page_id, host, path, rule,
  case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when listed.key is not null then 'block' else 'allow' end as verdict
from c left join listed on c.key = listed.key
""".replace("\\\\", "\\")

OP2_SQL = """
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
g as (select d, max(page_id) as first from p where n >= 1000 group by d)
select page_id, n as payload_bytes, d as payload_digest,
  case when page_id < first then 'revisit' else 'response' end as record_type,
  case when page_id < first then first end as refers_to
from p left join g using (d)
"""

#: DuckDB's edit distance counts bytes: the letters beyond ASCII of the tables become single bytes that the tables lack.
_BEYOND = "ÍéèÉßêíçÇÑÈóÓöüÖäÜñÊÄ"
_ONE_BYTE = "".join(chr(c) for c in (*range(1, 9), *range(14, 32)))[: len(_BEYOND)]

OP9_SQL = f"""
with recursive parts as (
  select doc_id, string_split(text, chr(10)) as p from documents where text is not null
), places as (
  select doc_id, i, p[i + 1] as line from (select doc_id, p, unnest(range(len(p))) as i from parts) where regexp_matches(p[i + 1], '[^ \\t-\\r]')
), u as (
  select line, row_number() over (order by line) as k, length(line) as n, translate(line, '{_BEYOND}', '{_ONE_BYTE}') as b from (select distinct line from places)
), near as (
  select a.k as x, b.k as y from u a join u b on a.k < b.k and b.n between a.n - {linededup.EDITS} and a.n + {linededup.EDITS}
  where levenshtein(a.b, b.b) <= least({linededup.EDITS}, least(a.n, b.n) // {linededup.CHARS_AN_EDIT})
), edges as (
  select x, y from near union all select y, x from near
), reach(k, r) as (
  select distinct x, x from edges union select reach.k, edges.y from reach join edges on edges.x = reach.r
), class as (
  select k, min(r) as c from reach group by k
), placed as (
  select doc_id, i, k, coalesce(c, k) as c from places join u using (line) left join class using (k)
), firsts as (
  select *, first_value(struct_pack(d := doc_id, i := i)) over (partition by c order by doc_id, i) as class_first, first_value(struct_pack(d := doc_id, i := i)) over (partition by k order by doc_id, i) as own_first from placed
), counted as (
  select doc_id, count(*) as n_lines, count(*) filter (class_first.d <> doc_id or class_first.i <> i) as n_dup_lines, count(*) filter (class_first <> own_first) as n_near_lines,
    array_to_string(list_sort(list(distinct class_first.d) filter (class_first.d <> doc_id or class_first.i <> i)), ',') as first_ids
  from firsts group by doc_id
)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_near_lines, 0) as n_near_lines, coalesce(first_ids, '') as first_ids
from documents left join counted using (doc_id)
""".replace("\\\\", "\\")


def _draw(what: str) -> str:
    return f"cast('0x' || substr(md5('{what}:0:' || turn || ':' || key), 1, {mixing.PLACE_BITS // 4}) as bigint)"


OP5_SQL = f"""
with recursive d as (
  select doc_id, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) as n,
    md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as key from documents
), tok as (
  select source, cast(sum(n) as double) as t from d group by source
), whole as (
  select sum(t) as b from tok
), steps(step, low, high) as (
  select 0, cast(0 as double), cast(1 as double)
  union all
  select step + 1, case when over then mid else low end, case when over then high else mid end from (
    select step, low, high, mid, (select max(pow(t / b, mid) / t) * max(b) / sum(pow(t / b, mid)) from tok, whole where t > 0) > {mixing.MAX_REPEATS} as over from (select *, (low + high) / 2 as mid from steps) as m
  ) as o where step < {mixing._STEPS}
), chosen as (
  select case when (select max(b / t) / count(*) from tok, whole where t > 0) <= {mixing.MAX_REPEATS} then 0 else high end as x from steps where step = {mixing._STEPS}
), shares as (
  select source, t, case when t > 0 then pow(t / b, x) / (select sum(pow(t / b, x)) from tok, whole, chosen where t > 0) else 0 end as w, b from tok, whole, chosen
), planned as (
  select source, t, w, case when t > 0 then round(w * b / t, 9) else 0 end as uses from shares
), turned as (
  select doc_id, source, n, key, t, w, uses, unnest(range(greatest(cast(ceil(uses) as bigint), 1))) as turn from d join planned using (source)
), placed as (
  select *, {_draw("place")} as place, {_draw("order")} as ord from turned
), offsets as (
  select *, turn + case when t > 0 then coalesce(sum(n) over (partition by source, turn order by place range between unbounded preceding and 1 preceding), 0) / t else 0 end as share from placed
), copies as (
  select *, case when share < uses then least({mixing.BLOCKS - 1}, cast(floor(share / uses * {mixing.BLOCKS}) as integer)) end as block from offsets
)
select doc_id, source, cast(n as bigint) as n_tokens, round(w, 9) as weight, cast(case when block is not null then turn end as integer) as copy, block,
  case when block is not null then row_number() over (partition by block order by ord, source, doc_id, turn) - 1 end as position
from copies where block is not null or turn = 0
""".replace("\\\\", "\\")

ORACLES: dict[str, str] = {"op5_mixture": OP5_SQL, "op9_lines": OP9_SQL, "op2_warc": OP2_SQL, "op3_quality": OP3_SQL, "op4_decontaminate": OP4_SQL, "op8_urls": OP8_SQL}
