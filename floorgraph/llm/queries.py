"""The corpus operators' queries over the driver's tables, and SQL where it can say the same."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from floorgraph.llm import ann, bpe_trie, decontaminate, divergence, hilbert, line_dedup, lm_score, secret_scan, simhash, toxicity, url_lists, warc, yinyang
from floorgraph.llm.common import bounded_batches
from floorgraph.llm.common import table as read_table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return read_table(spark, sf_dir, name)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = hilbert.hilbert_shards(table(spark, sf_dir, "documents"), n_shards=40, law="rows")
    return shards.withColumn("grown_shard", F.lit(None).cast("int"))


class _Decimals(dict):
    def __missing__(self, number: int) -> str:
        text = self[number] = str(number)
        return text


_decimal = _Decimals()  # of the vocabulary's ids at most


def digest_tokens(ids: list[int], decoded: str) -> tuple[int, str, str]:
    hexed = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    return len(ids), hexed(" ".join(map(_decimal.__getitem__, ids))), hexed(decoded)


def op2_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encode_decode(table(spark, sf_dir, "documents"), VOCABULARY, finish=digest_tokens, fields="n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).drop("header_digest")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def dated_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries for the hosts of ``pages``, by a rule on the host's MD5: the tables hold no list.

    A third of the hosts are added to "blocked" on a day of 2024, and of those
    every second is removed 120 days later and every fourth added again after
    60 more; every tenth is also put on "review" from 1 February on.  Two
    parent domains are listed for a quarter each.
    """
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("domain")).where("domain is not null").distinct()
    h = hosts.withColumn("h", F.conv(F.substring(F.md5("domain"), 1, 7), 16, 10).cast("long"))
    start = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("h") % 366).cast("int"))
    row = lambda name, action, at: F.struct(F.lit(name).alias("list_name"), "domain", F.lit(action).alias("action"), at.alias("at"))
    when = lambda test, entry: F.when(test, entry)
    listed = F.array(
        when(F.col("h") % 3 == 0, row("blocked", "add", start)),
        when(F.col("h") % 6 == 0, row("blocked", "remove", F.date_add(start, 120))),
        when(F.col("h") % 12 == 0, row("blocked", "add", F.date_add(start, 180))),
        when(F.col("h") % 10 == 0, row("review", "add", F.to_date(F.lit("2024-02-01")))),
    )
    fixed = pages.sparkSession.sql(
        "select * from values ('parents', 'example.net', 'add', date'2024-04-01'), ('parents', 'example.net', 'remove', date'2024-07-01'), "
        "('parents', 'example.org', 'add', date'2024-10-01'), ('parents', 'example.org', 'remove', date'2025-01-01') as t(list_name, domain, action, at)"
    )
    return h.select(F.explode(F.array_compact(listed)).alias("e")).select("e.*").unionAll(fixed)


def op8_dated_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id") * 37, F.lit(540)).cast("int"))
    found = url_lists.match_captures(pages.withColumn("fetched_on", fetched), dated_entries(pages))
    return found.withColumn("fetched_on", F.date_format("fetched_on", "yyyy-MM-dd"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "weighted_hits", "matched")


#: The sources whose documents are the target corpus of op10.
TARGET_SOURCES = ("src1", "src2")


def op10_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(table(spark, sf_dir, "documents"), F.col("source").isin(*TARGET_SOURCES))
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op12_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed=3)


def listed_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    count = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *[F.size(count(k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(listed_spans(count(*base)).cast("binary"), 256).alias("base_sha256"), listed_spans(F.col("spans")).alias("spans"),
    )


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_hilbert_shards, op2_trie_bpe, op3_containment, op4_simhash_groups, op5_warc_index, op6_line_dedup,
            op7_learned_partitions, op8_dated_url_lists, op9_toxicity, op10_cross_entropy,
            op11_source_divergence, op12_yinyang_clusters, op13_secret_scan,
        )
    }


_WORDS = r"regexp_split_to_array(trim(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), E' \t\n\x0b\x0c\r'), '[\x09-\x0D\x20]+')"
_LINES = r"string_split(coalesce(text, ''), chr(10))"
_KEY = r"translate(trim(l, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"[w for w in regexp_split_to_array(lower(coalesce(text, '')), '[\x09-\x0D\x20!-\/:-@\[-`\{-~]+') if w <> '']"


def _shingled(source: str, key: str, n: str = "5") -> str:
    """Runs of ``n`` words, a SQL expression of the row; an item of fewer words is one run, a document then none."""
    return f"""select {key}, n, array_to_string(w[i:i+n-1], ' ') as s
        from (select {key}, n, w, unnest(generate_series(1, len(w) - n + 1)) as i
              from (select {key}, w, {n} as n from (select {key}, {_PLAIN} as w from {source}) where len(w) > 0))"""


def _lloyd(k: int, rounds: int) -> str:
    """Plain rounds over all centroids: the assignment ``a{r}`` and the centroids ``c{r}`` of every round."""
    near = """a{r} as materialized (select r, vec_id, v, d, j from (select r, vec_id, v, j, d, row_number() over (partition by r order by d, j) as n
                from (select r, vec_id, v, j, list_sum([(v[i] - c[i]) * (v[i] - c[i]) for i in range(1, 65)])::bigint as d from x cross join c{r})) where n = 1)"""
    moved = """c{s} as materialized (select j, coalesce(m, c) as c from c{r} left join (select j, list((t - ((t % n) + n) % n) // n order by i)::bigint[] as m
                from (select j, i, sum(e) as t, count(*) as n from (select j, unnest(v) as e, unnest(range(1, 65)) as i from a{r}) group by j, i) group by j) using (j))"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [moved.format(r=r, s=r + 1), near.format(r=r + 1)]
    return f"""
            with e as (select vec_id, embedding::double[] as e from embeddings where len(embedding) = 64),
                 x as materialized (select row_number() over () as r, vec_id, [floor(1024 * f)::bigint for f in e] as v from e
                                    where len([f for f in e if f is not null and not isnan(f) and not isinf(f)]) = 64),
                 c0 as materialized (select row_number() over (order by h, v) - 1 as j, v as c from (select v, sha256('3:' || coalesce(vec_id::varchar, '')) as h from x) qualify j < {k}),
                 {", ".join(steps)}
            select vec_id, j::int as cluster, d as distance, (sum(d) over (partition by j))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia,
                   sha256(array_to_string(c, ',')) as centroid_sha256
            from a{rounds} join c{rounds} using (j)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_containment": f"""
            with b as (select distinct * from ({_shingled('benchmark', 'item_id', 'least(5, len(w))')})),
                 d as (select distinct * from ({_shingled('documents', 'doc_id', 'unnest((select list(distinct n) from b))')})),
                 n as (select item_id, count(*) as n_shingles from b group by item_id)
            select doc_id, item_id, count(*)::bigint as matched, n_shingles::bigint as n_shingles, count(*) / n_shingles::double as containment
            from d join b using (n, s) join n using (item_id) group by doc_id, item_id, n_shingles
            having count(*) >= ceil(0.8 * n_shingles - 1e-9)""",
        "op5_warc_index": """
            with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as d, strlen(coalesce(html, ''))::bigint as n from pages),
                 f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
            select page_id, n as payload_bytes, d as payload_digest,
                   case when n >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
                   case when n >= 100 and page_id <> first_id then first_id end as refers_to
            from p left join f using (d)""",
        "op6_line_dedup": f"""
            with l as (select doc_id, i, lines[i] as l from (select doc_id, lines, unnest(generate_series(1, len(lines))) as i
                       from (select doc_id, {_LINES} as lines from documents))),
                 k as (select doc_id, i, l, {_KEY} as k from l),
                 c as (select k from k where k <> '' group by k having count(distinct doc_id) >= 10),
                 m as (select doc_id, i, l, k in (select k from c) as gone from k)
            select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
                   sha256(coalesce(string_agg(l, chr(10) order by i) filter (not gone), '')) as kept_sha256
            from m group by doc_id""",
        "op8_dated_url_lists": r"""
            with p as (select page_id, nullif(regexp_extract(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]*)', 1), '') as host,
                       (date '2024-01-01' + ((page_id * 37) % 540)::int)::date as fetched_on from pages),
                 h as (select host as domain, ('0x' || substr(md5(host), 1, 7))::bigint as h from (select distinct host from p where host is not null)),
                 s as (select domain, h, (date '2024-01-01' + (h % 366)::int)::date as start from h),
                 e as (select 'blocked' as list_name, domain, start as f, case when h % 6 = 0 then (start + 120)::date end as t from s where h % 3 = 0
                       union all select 'blocked', domain, (start + 180)::date, null from s where h % 12 = 0
                       union all select 'review', domain, date '2024-02-01', null from s where h % 10 = 0
                       union all select 'parents', 'example.net', date '2024-04-01', date '2024-07-01'
                       union all select 'parents', 'example.org', date '2024-10-01', date '2025-01-01'),
                 m as (select page_id, e.domain, list_name from p join e on (host = e.domain or ends_with(host, '.' || e.domain)) and fetched_on >= f and (t is null or fetched_on < t)),
                 a as (select page_id, count(*)::bigint as n_active, arg_min(domain, (-length(domain), domain, list_name)) as domain, arg_min(list_name, (-length(domain), domain, list_name)) as list_name from m group by page_id)
            select page_id, host, strftime(fetched_on, '%Y-%m-%d') as fetched_on, n_active is not null as blocked, coalesce(n_active, 0)::bigint as n_active, domain, list_name
            from p left join a using (page_id)""",
        "op10_cross_entropy": f"""
            with w as (select doc_id, source in ('src1', 'src2') as t, [x for x in {_WORDS.format(t='text')} if x <> ''] as w from documents),
                 x as (select doc_id, coalesce(t, false) as t, unnest(w) as w, generate_subscripts(w, 1) as i from w),
                 z as (select *, coalesce(lag(w) over (partition by doc_id order by i), '<s> ') as v from x),
                 n as (select count(*) filter (t) as nt, count(*) as nb, count(distinct w) as size from z),
                 u as (select w, count(*) filter (t) as t, count(*) as b from z group by w),
                 f as (select v, count(*) filter (t) as t, count(*) as b from z group by v),
                 g as (select v, w, count(*) filter (t) as t, count(*) as b from z group by v, w),
                 p as (select g.v, g.w, -ln(0.3 * (u.t + 1) / (nt + size) + 0.7 * g.t / greatest(f.t, 1)) as lt,
                              -ln(0.3 * (u.b + 1) / (nb + size) + 0.7 * g.b / greatest(f.b, 1)) as lb
                       from g join u on g.w = u.w join f on g.v = f.v, n),
                 s as (select doc_id, count(*)::bigint as n_tokens, avg(lt) as lt, avg(lb) as lb from z join p using (v, w) group by doc_id)
            select doc_id, coalesce(n_tokens, 0)::bigint as n_tokens, round(lt, 6) as target_loss, round(lb, 6) as background_loss, round(lt - lb, 6) as score
            from documents left join s using (doc_id)""",
        "op12_yinyang_clusters": _lloyd(8, 10),
        "op11_source_divergence": r"""
            with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
                 x as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as item from d),
                 k as (select lang, item, count(*) as n from x group by lang, item having count(distinct r) >= 10),
                 v as (select lang, count(item) as v, coalesce(sum(n), 0) as total from (select distinct lang from d) left join k using (lang) group by lang),
                 g as (select distinct lang, source from d),
                 c as (select g.lang, g.source, k.item, coalesce(s.n, 0) as n, k.n as all_n
                       from g join k using (lang) left join (select lang, source, item, count(*) as n from x group by all) s using (lang, source, item)),
                 t as (select lang, source, sum(n) as total from c group by lang, source),
                 p as (select lang, source, item, n, (1 + 1000000000::hugeint * (n + 2) // (t.total + 2 * v.v))::bigint as p,
                              (1 + 1000000000::hugeint * (all_n + 2) // (v.total + 2 * v.v))::bigint as q
                       from c join t using (lang, source) join v using (lang)),
                 pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
                           from p a join p b on a.lang = b.lang and a.item = b.item and a.source <> b.source group by all),
                 f as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pairs.value, 0)::bigint as value
                       from g a join g b on a.lang = b.lang and a.source <> b.source
                       left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
                       union all select lang, source, 'term', item, ((p - q) * (p - q) // (p + q))::bigint from p where n > 0 and p > q)
            select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from f
            qualify part = 'pair' or rank <= 10""",
    }
