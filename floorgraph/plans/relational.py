"""Queries of lookups, filters, joins, set operations and aggregates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floorgraph.functions import text as tx
from floorgraph.operators import aggregates as ag
from floorgraph.operators import lookup as lk
from floorgraph.operators import navigation as nv
from floorgraph.sources.tables import read_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""select l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag from lineitem where l_orderkey = 7 and l_linenumber = 1""")
def edge_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = lk.lookup(read_table(spark, d, "lineitem"), l_orderkey=7, l_linenumber=1)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")


@query("""
with r as (select i as req_id, case when i % 5 = 0 then null else ['BUILDING','AUTOMOBILE','MACHINERY','HOUSEHOLD'][i % 4 + 1] end as segment,
                  case when i % 3 = 0 then null else (i * 7) % 25 end as nation, case when i % 7 = 6 then -1 when i % 2 = 1 then i else null end as cust from (select unnest(generate_series(0, 19)) as i))
select req_id, count(c_custkey)::bigint as n_matches, case when count(c_custkey) = 0 then 'none' when count(c_custkey) = 1 then 'ok' else 'ambiguous' end as status,
       case when count(c_custkey) = 1 then min(c_custkey) end as c_custkey
from r left join customer on (segment is null or segment = c_mktsegment) and (nation is null or nation = c_nationkey) and (cust is null or cust = c_custkey) group by req_id""")
def optional_filter_status(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    segments = F.array(*[F.lit(s) for s in ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD")])
    requests = spark.range(20).select(
        i.alias("req_id"),
        F.when(i % 5 != 0, F.element_at(segments, (i % 4 + 1).cast("int"))).alias("segment"),
        F.when(i % 3 != 0, (i * 7) % 25).alias("nation"),
        F.when(i % 7 == 6, F.lit(-1)).when(i % 2 == 1, i).alias("cust"),
    )
    pairs = {"segment": "c_mktsegment", "nation": "c_nationkey", "cust": "c_custkey"}
    return lk.resolve_optional(F.broadcast(requests), read_table(spark, d, "customer"), "req_id", "c_custkey", pairs)  # twenty requests


@query("""
select g.gender, event_type, count(*)::bigint as n from events
join (values ('male', 'click'), ('male', 'view'), ('female', 'purchase'), ('female', 'view'), ('accessible', 'signup')) g(gender, kind) on event_type = kind group by all
union all select 'any', event_type, count(*)::bigint from events group by event_type""")
def subtype_in_filter(spark: SparkSession, d: str) -> DataFrame:
    """Requested groups of subtypes; no list of subtypes means no filter."""
    wanted = {"male": ["click", "view"], "female": ["purchase", "view"], "accessible": ["signup"], "any": []}
    requests = spark.createDataFrame([(k, v) for k, v in wanted.items()], "gender string, kinds array<string>")
    events = read_table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return events.join(requests, (F.size("kinds") == 0) | F.array_contains("kinds", F.col("event_type"))).select("gender", "event_type", "n")


@query("""select p_partkey, p_name, p_name ilike '%' || 'RED' || '%' as by_like, contains(p_name, 'red') as by_text from part where p_name ilike '%RED%' or contains(p_type, 'SMALL')""")
def label_ilike(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    like = F.ilike("p_name", F.concat(F.lit("%"), F.lit("RED"), F.lit("%")))
    return part.where(like | F.contains("p_type", F.lit("SMALL"))).select("p_partkey", "p_name", like.alias("by_like"), F.contains("p_name", F.lit("red")).alias("by_text"))


@query("""
select p_partkey, case when p_type like '%ECONOMY%' then 'gate' when p_type like '%PROMO%' then 'exit' when p_type like '%STANDARD%' then 'toilet' end as facility_type,
       case when p_size < 15 then 'male' when p_size < 30 then 'female' when p_size < 40 then 'both' else 'accessible' end as subtype,
       coalesce(case when p_size > 45 then 'platform' end, case when p_type like '%ECONOMY%' then 'gate' end, nullif(p_brand, ''), 'unknown') as app_type
from part where p_type like '%ECONOMY%' or p_type like '%PROMO%' or p_type like '%STANDARD%'""")
def facility_classify(spark: SparkSession, d: str) -> DataFrame:
    t, s = F.col("p_type"), F.col("p_size")
    kind = F.when(t.contains("ECONOMY"), "gate").when(t.contains("PROMO"), "exit").when(t.contains("STANDARD"), "toilet")
    subtype = F.when(s < 15, "male").when(s < 30, "female").when(s < 40, "both").otherwise("accessible")
    app = tx.first_non_empty(F.when(s > 45, F.lit("platform")), F.when(t.contains("ECONOMY"), F.lit("gate")), F.col("p_brand"), F.lit("unknown"))
    return read_table(spark, d, "part").select("p_partkey", kind.alias("facility_type"), subtype.alias("subtype"), app.alias("app_type")).where("facility_type is not null")


@query("""
select c_custkey, o_orderkey, o_orderpriority from (
  select o_custkey as c_custkey, o_orderkey, o_orderpriority, row_number() over (partition by o_custkey order by case when o_orderpriority like '1%' then 0 else 1 end, o_orderdate, o_orderkey) as r from orders) where r = 1""")
def priority_first_row(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority", "o_orderdate")
    urgent = F.when(F.col("o_orderpriority").startswith("1"), 0).otherwise(1)
    return lk.first_by(orders, ["c_custkey"], [urgent, F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("""
with s as (select s_suppkey, s_name, 'st ' || s_suppkey || ' (' || upper(s_name) || ' Alias' || (s_suppkey % 5) || ')' as title from supplier),
     k as (select s_suppkey, s_name, regexp_replace(lower(trim(title)), '\\s+', '', 'g') as k from s),
     t as (select s_suppkey, s_name, unnest(list_distinct([x for x in list_concat([k], regexp_extract_all(k, '\\(([^()]*)\\)', 1), [regexp_replace(k, '\\([^()]*\\)', '', 'g')]) if x <> ''])) as tok from k),
     r as (select distinct case s_suppkey % 3 when 0 then s_suppkey::varchar when 1 then 'ST ' || s_suppkey else 'nobody' || s_suppkey end as request from supplier),
     q as (select request, regexp_replace(lower(trim(request)), '\\s+', '', 'g') as tok from r),
     b as (select request, arg_min(s_suppkey, (s_name, s_suppkey)) as best from q join t using (tok) group by request)
select r.request, coalesce(e.s_suppkey::varchar, best::varchar, r.request) as resolved, case when e.s_suppkey is not null then 'exact' when best is not null then 'token' else 'echo' end as how
from r left join supplier e on r.request = e.s_suppkey::varchar left join b using (request)""")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    supplier = read_table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    title = F.concat(F.lit("st "), key, F.lit(" ("), F.upper("s_name"), F.lit(" Alias"), (F.col("s_suppkey") % 5).cast("string"), F.lit(")"))
    names = supplier.select(key.alias("id"), "s_name", "s_suppkey", title.alias("title"))
    request = F.when(F.col("s_suppkey") % 3 == 0, key).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("ST "), key)).otherwise(F.concat(F.lit("nobody"), key))
    requests = supplier.select(request.alias("request"))
    return lk.resolve_alias(requests, names, "request", "id", tx.name_tokens(F.col("request")), tx.name_tokens(F.col("title")), ["s_name", "s_suppkey"])


@query(r"""select page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown') as part,
       case when ends_with(url, '/') then left(url, length(url) - 1) else url end as bare from pages""")
def safe_path(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").select("page_id", tx.safe_part(F.col("url")).alias("part"), tx.without_suffix(F.col("url"), "/").alias("bare"))


@query("""select event_id, coalesce(json_extract_string(props, '$.k'), 'none') as k, coalesce(json_extract_string(props, '$.missing'), 'none') as missing from events""")
def json_text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    props = F.to_json(F.from_json("props", "map<string,string>"))
    return read_table(spark, d, "events").select("event_id", tx.json_value(props, "$.k", F.lit("none")).alias("k"), tx.json_value(props, "$.missing", F.lit("none")).alias("missing"))


@query("""
select n_nationkey, n_name as name, false as is_alias from nation
union all select n_nationkey, lower(n_name), true from nation where lower(n_name) <> n_name
union all select n_nationkey, left(n_name, 3), true from nation where left(n_name, 3) <> n_name and n_regionkey < 2""")
def alias_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's own row and one for each alias that is not its name."""
    name, aliases = F.col("n_name"), F.array(F.lower("n_name"), F.when(F.col("n_regionkey") < 2, F.left("n_name", F.lit(3))))
    nation = read_table(spark, d, "nation")
    own = nation.select("n_nationkey", name.alias("name"), F.lit(False).alias("is_alias"))
    others = nation.select("n_nationkey", "n_name", F.explode(F.array_distinct(aliases)).alias("name")).where("name is not null and name <> n_name")
    return own.unionByName(others.select("n_nationkey", "name", F.lit(True).alias("is_alias")))


_DIRECTED = """d as (select c_nationkey as a, s_nationkey as b, count(*)::bigint as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
      join supplier on l_suppkey = s_suppkey group by all)"""


def _directed(spark: SparkSession, d: str) -> DataFrame:
    """Shipments between a customer's and a supplier's nation."""
    lines = read_table(spark, d, "lineitem").join(read_table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read_table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.count("*").alias("n"))


@query(f"""
with {_DIRECTED},
     v as (select a || '_' || b as k, (a * 100 + b)::int as video from (select unnest(generate_series(0, 24)) as a), (select unnest(generate_series(0, 24)) as b) where a <= b and (a + b) % 3 <> 0)
select d.a, d.b, n, coalesce(x.video, y.video) as video, case when x.k is not null then 'directed' when y.k is not null then 'sorted' else 'missing' end as found_by,
       coalesce('videos/' || coalesce(x.k, y.k) || '.mp4', 'none') as url
from d left join v x on d.a || '_' || d.b = x.k left join v y on least(d.a, d.b) || '_' || greatest(d.a, d.b) = y.k""")
def video_match_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Edges matched by their directed key, else by the sorted one."""
    ends = spark.range(625).select((F.col("id") / 25).cast("int").alias("va"), (F.col("id") % 25).cast("int").alias("vb")).where("va <= vb and (va + vb) % 3 <> 0")
    videos = ends.select(F.concat_ws("_", "va", "vb").alias("k"), (F.col("va") * 100 + F.col("vb")).alias("video"))
    directed, ordered = F.concat_ws("_", "a", "b"), F.concat_ws("_", F.least("a", "b"), F.greatest("a", "b"))
    out = lk.with_fallback_key(_directed(spark, d), videos, directed, ordered, "k", "video")
    key = F.when(F.col("found_by") == "directed", directed).when(F.col("found_by") == "sorted", ordered)
    return out.withColumn("url", F.coalesce(F.concat(F.lit("videos/"), key, F.lit(".mp4")), F.lit("none")))


@query("""
with c as (select distinct o_custkey, o_orderstatus from orders where o_orderkey % 2 = 0), p as (select distinct o_custkey, o_orderstatus from orders where o_orderkey % 2 = 1)
select c.o_custkey, c.o_orderstatus, case when c.o_orderstatus = 'F' then 'skipped' else 'missing' end as class from c anti join p on c.o_custkey = p.o_custkey and c.o_orderstatus = p.o_orderstatus""")
def missing_edges(spark: SparkSession, d: str) -> DataFrame:
    orders = read_table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    keys = ["o_custkey", "o_orderstatus"]
    halves = [orders.where(F.col("o_orderkey") % 2 == k).select(*keys).distinct() for k in (0, 1)]
    return lk.missing_rows(*halves, keys).withColumn("class", F.when(F.col("o_orderstatus") == "F", "skipped").otherwise("missing"))


@query("""
select x.s_suppkey as from_key, y.s_suppkey as to_key, 'platform_platform' as pair_type from supplier x join supplier y on x.s_suppkey <> y.s_suppkey and x.s_nationkey <> y.s_nationkey
union all select s_suppkey, n_nationkey, 'platform_exit' from supplier, nation where n_regionkey = 1
union all select n_nationkey, s_suppkey, 'exit_platform' from supplier, nation where n_regionkey = 1""")
def od_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Origin-destination pairs: platforms with each other, with exits, and back."""
    p = read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    e = read_table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("bigint").alias("exit"))
    # in blocks of few goals, mostly for start after start of one nation: columns of files then repeat what is a few kB before, and take little disk
    blocks = max(-(-p.count() // 4096), 4 * spark.sparkContext.defaultParallelism)
    start = p.repartitionByRange(4 * spark.sparkContext.defaultParallelism, "s_nationkey").select(F.col("s_suppkey").alias("from_key"), F.col("s_nationkey").alias("_from"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_asked"))
    start = start.repartition(blocks, "_asked")
    goal = p.select(F.col("s_suppkey").alias("to_key"), F.col("s_nationkey").alias("_to"), F.pmod(F.xxhash64("s_suppkey"), F.lit(blocks)).cast("int").alias("_block")).repartition(blocks, "_block")
    both = start.join(goal.hint("shuffle_hash"), (F.col("_asked") == F.col("_block")) & (F.col("from_key") != F.col("to_key")) & (F.col("_from") != F.col("_to"))).select("from_key", "to_key")
    both = both.withColumn("pair_type", F.lit("platform_platform"))
    exits = p.join(F.broadcast(e)).select(F.col("s_suppkey").alias("from_key"), F.col("exit").alias("to_key"))  # at most a region's nations
    out = exits.withColumn("pair_type", F.lit("platform_exit"))
    back = exits.select(F.col("to_key").alias("from_key"), F.col("from_key").alias("to_key"), F.lit("exit_platform").alias("pair_type"))
    return both.unionByName(out).unionByName(back)


@query("""select x.n_nationkey as a, y.n_nationkey as b, abs(x.n_nationkey - y.n_nationkey)::int as dist from nation x join nation y on x.n_regionkey = y.n_regionkey and x.n_nationkey <> y.n_nationkey and abs(x.n_nationkey - y.n_nationkey) <= 10""")
def layer_pairs_radius(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within a layer and a radius, both directions."""
    n = read_table(spark, d, "nation")
    x, y = n.select(F.col("n_nationkey").alias("a"), "n_regionkey"), n.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    half = x.join(y, "n_regionkey").where((F.col("a") < F.col("b")) & (F.col("b") - F.col("a") <= 10)).select("a", "b", (F.col("b") - F.col("a")).alias("dist"))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))


@query("""select conv_id, turn, lag(role) over w as previous_role, lead(turn) over w as next_turn, p.turn is not null as has_exact_next from conversations c
left join (select conv_id as cid, turn from conversations) p on p.cid = c.conv_id and p.turn = c.turn + 1 window w as (partition by conv_id order by c.turn)""".replace("select conv_id, turn,", "select conv_id, c.turn as turn,").replace("lead(turn)", "lead(c.turn)"))
def neighbour_rows(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "conversations").select("conv_id", "turn", "role")
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = F.lead("turn").over(w)
    return c.select("conv_id", "turn", F.lag("role").over(w).alias("previous_role"), after.alias("next_turn"), F.coalesce(after == F.col("turn") + 1, F.lit(False)).alias("has_exact_next"))


@query("""
with e as (select vec_id, label, embedding::double[] as v from embeddings),
     m as (select label, i, avg(v[i]) as m from (select vec_id, label, v, unnest(generate_series(1, 64)) as i from e) group by label, i),
     q as (select e.label, e.vec_id, sum((v[i] - m) * (v[i] - m)) as d2 from e join m on e.label = m.label group by e.label, e.vec_id)
select label, arg_min(vec_id, (round(d2, 9), vec_id)) as vec_id, round(min(d2), 4) as d2, count(*)::bigint as n from q group by label""")
def representative_argmin(spark: SparkSession, d: str) -> DataFrame:
    """The member nearest to its group's mean vector."""
    e = read_table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    mean = e.groupBy("label").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(64)]).alias("m"), F.count("*").alias("n"))
    # a row for each label: joined by Spark's own size rule
    near = e.join(mean, "label").withColumn("d2", F.aggregate(F.zip_with("v", "m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    best = near.groupBy("label").agg(F.min(F.struct(F.round("d2", 9).alias("r"), "vec_id", "d2")).alias("b"), F.min("d2").alias("d"), F.count("*").alias("n"))
    return best.select("label", "b.vec_id", F.round("d", 4).alias("d2"), "n")


@query("""select l_suppkey, string_agg(distinct l_linenumber, ',' order by l_linenumber) as cars, count(distinct l_linenumber)::bigint as n from lineitem group by l_suppkey""")
def cars_per_platform(spark: SparkSession, d: str) -> DataFrame:
    cars = F.sort_array(F.collect_set("l_linenumber"))
    return read_table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.array_join(cars.cast("array<string>"), ",").alias("cars"), F.size(cars).cast("bigint").alias("n"))


@query("""
with o as (select c_nationkey as nation, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice from orders join customer on o_custkey = c_custkey),
     f as (select nation, arg_min(o_orderstatus, o_orderkey) as o_orderstatus, arg_min(o_totalprice, o_orderkey) as o_totalprice, count(*)::bigint as n_records from o group by nation),
     s as (select nation, o_orderpriority, min(o_orderkey) as k from o group by all)
select f.nation, o_orderstatus, o_totalprice, n_records, string_agg(s.o_orderpriority, '|' order by k) as priorities from f join s using (nation) group by all""")
def edge_first_seen(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("nation", F.col("c_nationkey"))
    out = ag.first_seen(o, ["nation"], F.col("o_orderkey"), ["o_orderstatus", "o_totalprice"], ["o_orderpriority"])
    return out.select("nation", "o_orderstatus", "o_totalprice", "n_records", F.array_join("o_orderpriority_seen", "|").alias("priorities"))


@query("""
select o_custkey, sum(n)::bigint as used_by_count, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) as kinds from (
  select o_custkey, o_orderstatus, count(*) as n from orders where o_orderkey % 2 = 0 group by all union all select o_custkey, o_orderstatus, count(*) from orders where o_orderkey % 2 = 1 group by all) group by o_custkey""")
def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    """Records of two exports merged: counts added, lists united."""
    o = read_table(spark, d, "orders")
    half = lambda k: o.where(F.col("o_orderkey") % 2 == k).groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_set("o_orderstatus").alias("kinds"))
    both = half(0).unionByName(half(1)).groupBy("o_custkey").agg(F.sum("n").alias("used_by_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))
    return both.select("o_custkey", "used_by_count", F.array_join("kinds", ",").alias("kinds"))


@query("""select coalesce(r_name, 'total') as region, count(*)::bigint as customers, count(distinct c_mktsegment)::bigint as segments, max(c_acctbal) as most
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name)""")
def od_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer").join(read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = c.rollup("r_name").agg(F.count("*").alias("customers"), F.countDistinct("c_mktsegment").alias("segments"), F.max("c_acctbal").alias("most"))
    return out.select(F.coalesce("r_name", F.lit("total")).alias("region"), "customers", "segments", "most")


@query("""
with w as (select p_brand, p_type, sum(p_size) as w, min(p_partkey) as o from part group by all)
select p.p_brand, round(sum(p_retailprice * p_size) / sum(p_size), 4) as centre, min(p_size) as lo, max(p_size) as hi, count(*)::bigint as members, any_value(t.p_type) as dominant
from part p join (select p_brand, arg_max(p_type, (w, -o)) as p_type from w group by p_brand) t using (p_brand) group by p.p_brand""")
def weighted_centroid_dominant(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part")
    centre = part.groupBy("p_brand").agg(
        F.round(ag.weighted_mean(F.col("p_retailprice"), F.col("p_size")), 4).alias("centre"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"), F.count("*").alias("members")
    )
    top = ag.dominant(part, "p_brand", "p_type", F.col("p_size"), F.col("p_partkey"))
    return centre.join(top.withColumnRenamed("p_type", "dominant"), "p_brand")


@query("""
with b as (select l_returnflag, floor(l_extendedprice / 2400)::bigint as bin, count(*)::bigint as n, avg(l_extendedprice) as mean from lineitem group by all)
select t.l_returnflag, t.bin, t.n, round(b.mean, 4) as mean, m.med as median_discount from (select l_returnflag, arg_max(bin, (n, -bin)) as bin, max(n) as n from b group by l_returnflag) t
join b using (l_returnflag, bin) join (select l_returnflag, median(l_discount) as med from lineitem group by all) m using (l_returnflag)""")
def histogram_mode(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem")
    mode = ag.histogram_mode(lines, "l_returnflag", "l_extendedprice", 2400)
    return mode.withColumn("mean", F.round("mean", 4)).join(lines.groupBy("l_returnflag").agg(F.median("l_discount").alias("median_discount")), "l_returnflag")


@query("""
with p as (select c_nationkey as k, c_acctbal as s, case when c_custkey % 25 = c_nationkey then null else 3 - c_acctbal * 0.5 + c_custkey % 7 end as t from customer
           union all select 100, 1.0, 4.0 union all select 101, null, null union all select 102, 1.0, 2.0 union all select 102, 1.1, 9.0 union all select 103, 0.0, 1.0 union all select 103, 1.0, 3.0),
     g as (select k, count(case when s is not null and t is not null then 1 end)::bigint as n, max(s) - min(s) as span, avg(s) as ms, avg(t) as md, regr_slope(t, s) as sl, regr_intercept(t, s) as ic from p group by k)
select k, n, case when n = 0 then 'identity' when n >= 2 and span >= 0.25 then 'scale_translate' else 'translation' end as method,
       round(case when n >= 2 and span >= 0.25 then abs(sl) else 1.0 end, 4) as scale,
       round(case when not (n >= 2 and span >= 0.25) then coalesce(md - ms, 0) when sl < 0 then md - abs(sl) * ms else ic end, 4) as "offset" from g""")
def axis_fit(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    t = F.when(F.col("c_custkey") % 25 != F.col("c_nationkey"), 3 - F.col("c_acctbal") * 0.5 + F.col("c_custkey") % 7)
    fixed = spark.createDataFrame([(100, 1.0, 4.0), (101, None, None), (102, 1.0, 2.0), (102, 1.1, 9.0), (103, 0.0, 1.0), (103, 1.0, 3.0)], "k int, s double, t double")
    points = c.select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("s"), t.alias("t")).unionByName(fixed)
    out = ag.axis_fit(points, "k", "s", "t")
    return out.withColumn("scale", F.round("scale", 4)).withColumn("offset", F.round("offset", 4))


@query("""
with g as (select l_returnflag as k, count(case when l_quantity is not null and l_extendedprice is not null then 1 end)::bigint as n, max(l_quantity) - min(l_quantity) as span, avg(l_quantity) as ms, avg(l_extendedprice) as md,
                  regr_slope(l_extendedprice, l_quantity) as sl, regr_intercept(l_extendedprice, l_quantity) as ic from lineitem group by l_returnflag)
select k, n, case when n = 0 then 'identity' when n >= 2 and span >= 0.25 then 'scale_translate' else 'translation' end as method,
       round(case when n >= 2 and span >= 0.25 then abs(sl) else 1.0 end, 4) as scale,
       round(case when not (n >= 2 and span >= 0.25) then coalesce(md - ms, 0) when sl < 0 then md - abs(sl) * ms else ic end, 4) as "offset" from g""")
def axis_fit_lines(spark: SparkSession, d: str) -> DataFrame:
    """Price by quantity for each return flag, over all lines."""
    out = ag.axis_fit(read_table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice").withColumnRenamed("l_returnflag", "k")
    return out.withColumn("scale", F.round("scale", 4)).withColumn("offset", F.round("offset", 4))


@query("""
select c_custkey, round(c_acctbal - lo + 50, 4) as acctbal_centred, round(case when hi - lo + 100 < 100 then 1000 else hi - lo + 100 end, 4) as acctbal_canvas
from customer, (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)""")
def auto_center(spark: SparkSession, d: str) -> DataFrame:
    out = ag.centre(read_table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("acctbal")), ["acctbal"])
    return out.select("c_custkey", F.round("acctbal_centred", 4).alias("acctbal_centred"), F.round("acctbal_canvas", 4).alias("acctbal_canvas"))


@query("""
select b.v as threshold, min(n)::bigint as min_lines, max(n)::bigint as max_lines, sum(n)::bigint as total_lines, count(*)::bigint as orders
from (select l_orderkey, max(l_quantity) as q, count(*) as n from lineitem group by l_orderkey) join (values (10.0), (20.0), (30.0), (40.0)) b(v) on q >= b.v group by b.v""".replace("b.v as threshold", "b.v::double as threshold"))
def sweep_summary(spark: SparkSession, d: str) -> DataFrame:
    """Least, most and all lines of an order for each threshold of a sweep."""
    orders = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("q"), F.count("*").alias("n"))
    runs = orders.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(float(t)) for t in (10, 20, 30, 40)]), lambda t: F.col("q") >= t)))
    return runs.groupBy("threshold").agg(F.min("n").alias("min_lines"), F.max("n").alias("max_lines"), F.sum("n").alias("total_lines"), F.count("*").alias("orders"))


@query("""
select o_custkey, o_orderkey, round(coalesce(sum(delta) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0), 4) as offset_before,
       round(coalesce(sum(delta) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) + delta, 4) as offset_after from (select o_custkey, o_orderkey, o_totalprice - 150000 as delta from orders)""")
def ordered_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_totalprice") - 150000).alias("delta"))
    out = ag.running_fold(rows, "o_custkey", ["o_orderkey"], "delta")
    return out.select("o_custkey", "o_orderkey", F.round("offset_before", 4).alias("offset_before"), F.round("offset_after", 4).alias("offset_after"))


@query("""
with m as (select c_nationkey, avg(c_acctbal) as y from customer group by all), c as (select * from (values (0, 3000.0), (1, 4500.0), (2, 6000.0)) c(band, cy))
select c_nationkey, 'B' || row_number() over (order by round(y, 6), c_nationkey) as layer, round(y, 4) as y,
       (select arg_min(band, (abs(round(y, 6) - cy), band)) from c) as band from m""")
def band_labels(spark: SparkSession, d: str) -> DataFrame:
    """Nations labelled B1, B2, … by mean balance, and the nearest of fixed bands."""
    m = read_table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("y"))
    centres = {0: 3000.0, 1: 4500.0, 2: 6000.0}
    near = F.array_min(F.array(*[F.struct(F.abs(F.round("y", 6) - c).alias("d"), F.lit(b).alias("band")) for b, c in centres.items()]))["band"]
    # one row for each nation
    rank = F.row_number().over(Window.orderBy(F.round("y", 6), "c_nationkey"))
    return m.select("c_nationkey", F.concat(F.lit("B"), rank.cast("string")).alias("layer"), F.round("y", 4).alias("y"), near.alias("band"))


@query("""select user_id, string_agg(event_type, ',' order by t, event_type) as kinds from (select user_id, event_type, min(event_id) as t from events group by all) group by user_id""")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    out = ag.first_seen(read_table(spark, d, "events"), ["user_id"], F.col("event_id"), ["event_type"], ["event_type"])
    return out.select("user_id", F.array_join("event_type_seen", ",").alias("kinds"))


@query("""select user_id, string_agg(event_type || '@' || event_id, ', ' order by ts, event_id) as doors from events where event_type <> 'view' group by user_id
union all select user_id, '-' from (select distinct user_id from events) anti join (select distinct user_id from events where event_type <> 'view') using (user_id)""")
def door_summary(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    shown = F.when(F.col("event_type") != "view", F.struct("ts", "event_id", F.concat_ws("@", "event_type", F.col("event_id").cast("string")).alias("s")))
    doors = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["s"]), ", ")
    return e.groupBy("user_id").agg(doors.alias("doors")).select("user_id", F.coalesce(F.nullif("doors", F.lit("")), F.lit("-")).alias("doors"))


@query("""
with b as (select o_custkey as k, o_orderkey as ord, o_totalprice as v, 1 as batch from orders where o_orderkey % 2 = 0 union all select o_custkey, o_orderkey, o_totalprice, 2 from orders where o_orderkey % 2 = 1)
select k, batch, ord, v from (select *, row_number() over (partition by k order by batch desc, ord desc) as r from b) where r = 1""")
def upsert_partition(spark: SparkSession, d: str) -> DataFrame:
    """Later batches override earlier ones by key."""
    o = read_table(spark, d, "orders")
    batch = lambda rest, n: o.where(F.col("o_orderkey") % 2 == rest).select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("v"), F.lit(n).alias("batch"))
    return lk.prefer(batch(0, 1).unionByName(batch(1, 2)), "k", F.col("batch"), F.col("ord")).select("k", "batch", "ord", "v")


@query("""
select s_suppkey as id, s_name as name, 'original' as origin from supplier where s_suppkey not in (select s_suppkey from supplier where s_acctbal < 0)
union all select id, 'manual ' || id, 'manual' from (select s_suppkey * 2 as id from supplier) where id not in (select s_suppkey from supplier where not s_acctbal < 0)""")
def hidden_manual_union(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier")
    originals = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("original").alias("origin"))
    manual = s.select((F.col("s_suppkey") * 2).alias("id")).select("id", F.concat(F.lit("manual "), F.col("id").cast("string")).alias("name"), F.lit("manual").alias("origin"))
    return lk.union_visible(originals, s.where("s_acctbal < 0").select(F.col("s_suppkey").alias("id")), manual, "id")


@query("""
with used as (select distinct 'poly_' || lpad((s_suppkey * 2 + 1)::varchar, 3, '0') as id from supplier)
select number::int as number, id from (select unnest(generate_series(1, (select count(*) + 12 from used))) as number) , lateral (select 'poly_' || lpad(number::varchar, 3, '0') as id)
where id not in (select id from used) order by number limit 12""")
def next_ids(spark: SparkSession, d: str) -> DataFrame:
    used = read_table(spark, d, "supplier").select(F.format_string("poly_%03d", (F.col("s_suppkey") * 2 + 1).cast("int")).alias("id"))
    return lk.free_ids(used, "id", "poly", 12).select("number", "id")


@query("""select c_mktsegment, coalesce(max(try_cast(regexp_extract(c_name, '(\\d+)$', 1) as bigint)), 0) + 1 as next_number, lpad((coalesce(max(try_cast(regexp_extract(c_name, '(\\d+)$', 1) as bigint)), 0) + 1)::varchar, 9, '0') as padded
from customer group by c_mktsegment""")
def next_id_max(spark: SparkSession, d: str) -> DataFrame:
    return lk.next_number(read_table(spark, d, "customer"), "c_name", ["c_mktsegment"]).withColumn("padded", F.lpad(F.col("next_number").cast("string"), 9, "0"))


@query("""select s_suppkey, coalesce(nullif(case when s_acctbal < 0 then '' else s_name end, ''), nullif('', ''), 'node ' || s_suppkey) as label, s_nationkey from supplier where s_nationkey in (1, 3, 5, 7, 11, 13) and coalesce(s_name, '') <> ''""")
def typed_key_projection(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier").where(F.col("s_nationkey").isin(1, 3, 5, 7, 11, 13) & (F.coalesce("s_name", F.lit("")) != ""))
    name = F.when(F.col("s_acctbal") < 0, F.lit("")).otherwise(F.col("s_name"))
    return s.select("s_suppkey", tx.first_non_empty(name, F.lit(""), F.concat(F.lit("node "), F.col("s_suppkey").cast("string"))).alias("label"), "s_nationkey")


@query("""
with n as (select s_suppkey::varchar as id, row_number() over (order by s_suppkey) as number, 'N' || lpad((row_number() over (order by s_suppkey))::varchar, 4, '0') as k, s_name from supplier),
     r as (select * from (values (1, 'node', '3'), (2, 'node', 'N0002'), (3, 'node', '9999'), (4, 'name', 'Supplier#000000001'), (5, 'node', 'N0007'), (6, 'name', 'nobody'), (7, 'bus', '1')) r(req, kind, ref))
select req, kind, ref, coalesce(a.id, b.id, c.id) as node_id from r left join n a on a.id = ref left join n b on b.number::varchar = ref left join n c on c.k = ref where kind = 'node'
union all select req, kind, ref, n.id from r left join n on n.s_name = ref where kind = 'name' union all select req, kind, ref, null from r where kind = 'bus'""")
def node_ref_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints by kind: nodes by id, number or key text, names by name; unknown kinds resolve to nothing."""
    s = read_table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_suppkey", "s_name")
    nodes = nv.numbered(s.withColumn("graph", F.lit("one")), "graph", ["s_suppkey"]).withColumn("key", F.format_string("N%04d", "number"))  # a station's nodes
    rows = [(1, "node", "3"), (2, "node", "N0002"), (3, "node", "9999"), (4, "name", "Supplier#000000001"), (5, "node", "N0007"), (6, "name", "nobody"), (7, "bus", "1")]
    r = spark.createDataFrame(rows, "req int, kind string, ref string")
    by_node = lk.resolve_nodes(r.where("kind = 'node'"), nodes, "ref", "id", "number", "key")
    by_name = r.where("kind = 'name'").join(nodes, F.col("ref") == F.col("s_name"), "left").select("req", "kind", "ref", F.col("id").alias("node_id"))
    other = r.where("kind not in ('node', 'name')").select("req", "kind", "ref", F.lit(None).cast("string").alias("node_id"))
    return by_node.unionByName(by_name).unionByName(other)


@query("""
with q as (select unnest(generate_series(-3, 3)) * 10 as id)
select q.id::bigint as id, p_partkey is not null as known, p_name from q left join part on p_partkey = q.id""")
def membership_check(spark: SparkSession, d: str) -> DataFrame:
    """Requested ids that exist with their rows, and those that do not."""
    part = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    asked = spark.range(-3, 4).select((F.col("id") * 10).alias("id"))
    known = part.join(F.broadcast(asked), "id", "left_semi").select("id", F.lit(True).alias("known"), "p_name")  # seven ids
    unknown = asked.join(part, "id", "left_anti").select("id", F.lit(False).alias("known"), F.lit(None).cast("string").alias("p_name"))
    return known.unionByName(unknown)


@query("""
with l as (select l_orderkey, arg_max(l_partkey, (l_linenumber, l_partkey)) as l_partkey, max(l_linenumber) as line from lineitem group by l_orderkey),
     a as (select n_nationkey, n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) as r from nation),
     b as (select s_suppkey, s_nationkey % 5 as region, row_number() over (partition by s_nationkey % 5 order by s_acctbal desc, s_suppkey) as r from supplier)
select 'attach' as kind, o_orderkey as a, l_partkey as b, line::bigint as c from orders left join l on o_orderkey = l_orderkey
union all select 'zip', n_nationkey, s_suppkey, a.r from a join b on a.n_regionkey = b.region and a.r = b.r""")
def attach_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """The last line of each order attached to it; two ranked lists zipped by ordinal."""
    lines = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("b"), F.max("l_linenumber").cast("bigint").alias("c"))
    attached = read_table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.lit("attach").alias("kind"), F.col("o_orderkey").alias("a"), "b", "c")
    rank = lambda by, *order: F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("bigint")
    a = read_table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("a"), F.col("n_regionkey").alias("g"), rank("n_regionkey", "n_nationkey").alias("c"))
    s = read_table(spark, d, "supplier").withColumn("g", F.col("s_nationkey") % 5)
    b = s.select(F.col("s_suppkey").alias("b"), "g", rank("g", F.desc("s_acctbal"), "s_suppkey").alias("c"))
    return attached.unionByName(a.join(b, ["g", "c"]).select(F.lit("zip").alias("kind"), "a", "b", "c"))


@query("""
with r as (select 'order_without_lines' as rule, 'ERROR' as level, o_orderkey as id from orders anti join lineitem on o_orderkey = l_orderkey
 union all select 'balance_missing', 'ERROR', c_custkey from customer where c_acctbal is null union all select 'balance_negative', 'WARN', c_custkey from customer where c_acctbal < 0
 union all select 'alone_in_nation', 'WARN', min(s_suppkey) from supplier group by s_nationkey having count(*) < 2)
select rule, level, id, (select count(*) from r where level = 'ERROR') = 0 as valid from r""")
def quality_rules(spark: SparkSession, d: str) -> DataFrame:
    """One row for each breach of a rule; valid without errors."""
    orders, lines = read_table(spark, d, "orders"), read_table(spark, d, "lineitem")
    customer, supplier = read_table(spark, d, "customer"), read_table(spark, d, "supplier")
    row = lambda df, rule, level, key: df.select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.col(key).alias("id"))
    found = row(orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti"), "order_without_lines", "ERROR", "o_orderkey")
    found = found.unionByName(row(customer.where("c_acctbal is null"), "balance_missing", "ERROR", "c_custkey")).unionByName(row(customer.where("c_acctbal < 0"), "balance_negative", "WARN", "c_custkey"))
    alone = supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("s_suppkey")).where("n < 2")
    found = found.unionByName(row(alone, "alone_in_nation", "WARN", "s_suppkey"))
    errors = found.agg((F.count(F.when(F.col("level") == "ERROR", 1)) == 0).alias("valid"))
    return found.join(F.broadcast(errors))  # one row


@query("""
with h as (select distinct user_id from events where event_type = 'error')
select user_id, count(*)::bigint as n, coalesce(max(layer), 'none') as layer from (
 select user_id, case when value > 50 then 'B1' else null end as layer from events where user_id not in (select user_id from h) union all select user_id, 'M' from events where event_type = 'purchase') group by user_id""")
def hidden_replay(spark: SparkSession, d: str) -> DataFrame:
    """Ids that the log touches are hidden; the visible ones and the manual ones are the working set."""
    e = read_table(spark, d, "events").select("user_id", "event_type", "value")
    hidden = e.where("event_type = 'error'").select("user_id").distinct()
    shown = e.join(hidden, "user_id", "left_anti").select("user_id", F.when(F.col("value") > 50, "B1").alias("layer"))
    manual = e.where("event_type = 'purchase'").select("user_id", F.lit("M").alias("layer"))
    return shown.unionByName(manual).groupBy("user_id").agg(F.count("*").alias("n"), F.coalesce(F.max("layer"), F.lit("none")).alias("layer"))


@query("""select c_custkey, case when t = '-0' then '0' else t end as number, replace(c_name, '#', '%23') as name from (select *, regexp_replace(regexp_replace(printf('%.6f', c_acctbal), '0+$', ''), '\\.$', '') as t from customer)""")
def compact_number(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select("c_custkey", tx.compact_number(F.col("c_acctbal")).alias("number"), tx.url_part(F.col("c_name")).alias("name"))


@query("""
with t as (select l_orderkey, l_linenumber, case when l_quantity < 3 then 'x' else l_linenumber || ' - ' || (l_partkey % 4 + 1) end as label from lineitem where l_returnflag = 'R'),
     p as (select *, try_cast(nullif(regexp_extract(label, '^\\s*(\\d+)\\s*-\\s*(\\d+)\\s*$', 1), '') as int) as car, try_cast(nullif(regexp_extract(label, '^\\s*(\\d+)\\s*-\\s*(\\d+)\\s*$', 2), '') as int) as door from t)
select l_orderkey, l_linenumber, car, door, ((car - 1) * 4 + door)::int as ordinal, row_number() over (partition by l_orderkey order by (car - 1) * 4 + door, l_linenumber)::int as place from p where car is not null""")
def path_door_parse(spark: SparkSession, d: str) -> DataFrame:
    """Doors parsed from "c - d", unparsable ones dropped, in order."""
    lines = read_table(spark, d, "lineitem").where("l_returnflag = 'R'")
    label = F.when(F.col("l_quantity") < 3, F.lit("x")).otherwise(F.concat_ws(" - ", F.col("l_linenumber").cast("string"), (F.col("l_partkey") % 4 + 1).cast("string")))
    car, door = tx.door_parts(F.col("label"))
    rows = lines.select("l_orderkey", "l_linenumber", label.alias("label")).select("l_orderkey", "l_linenumber", car.alias("car"), door.alias("door")).where("car is not null")
    rows = rows.withColumn("ordinal", tx.door_ordinal(F.col("car"), F.col("door"), 4))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("ordinal", "l_linenumber")))
