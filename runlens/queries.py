"""Registered queries over the driver's tables, and the same results as DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapt, storage
from .functions import scalar
from .operators import catalogue as cat
from .operators import detect, forest, panels, report, sampling, status, sweeps
from .operators import features as feat
from .operators import reference as ref
from .plans import incremental, steps
from .sources import readers, writers
from .streaming import monitor

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

C = adapt.COLUMNS
FEATURES = [f"{m}_{s}" for m in adapt.METRICS for s in ("mean", "std", "median")] + ["occupancy", "frac_dead"]


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six places, integers as they are."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    """Registers a query under its function's name; ``sql`` follows the shared views below."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = f"with {VIEWS}{sql if sql.lstrip().startswith(',') else chr(10) + sql}"
        return f

    return add


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


_stats = ",\n".join(f"coalesce(avg({m}), 0) as {m}_mean, coalesce(stddev_samp({m}), 0) as {m}_std, coalesce(median({m}), 0) as {m}_median" for m in adapt.METRICS)
_ref = ",\n".join(f"avg({c}) as m_{c}, case when count(*) > 1 then greatest(stddev_pop({c}), 1e-6) else 1.0 end as s_{c}" for c in C)
_z = ", ".join(f"(s.{c} - r.m_{c}) / r.s_{c} as {c}" for c in C)
VIEWS = f"""
hits as (
  select year(l_shipdate)::int as run, month(l_shipdate)::int as subrun, (l_suppkey % 16)::int as channel, l_orderkey as event_id,
         l_quantity as quantity, l_extendedprice / 1000 as price, l_tax as tax, l_discount as discount from lineitem),
file_events as (select run, subrun, count(distinct event_id) as n from hits group by run, subrun),
grouped as (
  select run, subrun, channel, {_stats}, count(distinct event_id) as n_events,
         count(distinct case when discount = 0 then event_id end) as n_dead from hits group by run, subrun, channel),
features as (
  select g.* exclude (n_events, n_dead), n_events / f.n::double as occupancy, n_dead / n_events::double as frac_dead
  from grouped g join file_events f using (run, subrun)),
scored as (select * from features where not (channel = 3 and subrun = 7) and not (channel = 15 and subrun <> 5)),
good as (select * from scored where run <= {adapt.LAST_GOOD_RUN} and channel <> 15),
refw as (select channel, {_ref} from good group by channel),
ref_long as (
  {" union all ".join(f"select channel, '{c}' as feature, count(*) as n, avg({c}) as mean, case when count(*) > 1 then greatest(stddev_pop({c}), 1e-6) else 1.0 end as std from good group by channel" for c in C)}),
z as (select s.run, s.subrun, s.channel, {_z}, r.channel is not null as known from scored s left join refw r using (channel)),
known_log as (
  select run, subrun, channel, known, greatest({", ".join(f"abs({c})" for c in C)}) as max_z,
         concat_ws(';', {", ".join(f"case when abs({c}) > {adapt.Z} then '{c}' end" for c in C)}) as trig from z),
log as (
  select run, subrun, channel, (not known or trig <> '') as anomalous,
         case when not known then 'new_channel' when trig <> '' then 'statistical' else '' end as method,
         case when known then trig else 'new_channel' end as triggered_features, case when known then max_z end as max_z from known_log
  union all
  select f.run, f.subrun, c.channel, true, 'missing_channel', 'missing_channel', null
  from (select distinct run, subrun from scored) f cross join refw c
  where not exists (select 1 from scored s where s.run = f.run and s.subrun = f.subrun and s.channel = c.channel)),
streak as (
  select *, sum(anomalous::int) over (partition by run, channel order by subrun rows between {adapt.N - 1} preceding and current row) as streak from log),
per_file as (
  select run, subrun, count(*) filter (anomalous) as n_anomalous, count(*) filter (streak = {adapt.N}) as n_persistent,
         coalesce(max(max_z) filter (anomalous), 0) as worst_z from streak group by run, subrun),
status as (
  select run, subrun, n_anomalous, n_persistent, n_anomalous - n_persistent as n_transient, worst_z,
         case when n_persistent >= {adapt.LEAST} or n_anomalous >= {adapt.BULK} or worst_z >= {adapt.EXTREME} then 'alert'
              when n_persistent > 0 then 'warn'
              when n_anomalous - n_persistent > 0 and count(*) over (partition by run) < {adapt.N} then 'pend' else 'ok' end as status from per_file),
cat as (
  select run, subrun, (run * 13 + subrun) % 5 <> 0 as loose, (run * 13 + subrun) % 3 <> 0 as medium, (run * 13 + subrun) % 3 = 1 as tight
  from (select distinct run, subrun from scored) where subrun <> 2),
judged as (
  select s.*, case when c.run is null then 'unknown' when c.medium then 'known_good' else 'not_certified' end as gt
  from status s left join cat c using (run, subrun)),
board as (
  select year(o_orderdate)::int as run, month(o_orderdate)::int as subrun,
         {", ".join(f"(count(*) filter (substr(o_orderpriority, 1, 1) = '{i}'))::double as b{i}" for i in range(1, 6))} from orders group by 1, 2),
sweep_log as (
  select t.z as z_threshold, run, subrun, channel, coalesce(max_z > t.z, false) as anomalous, max_z from log cross join (values (2.0::double), (2.5::double), (3.0::double)) t(z)),
tiers as (
  select 'z' || z_threshold as model, z_threshold, run, subrun, count(*) filter (anomalous) as bad from sweep_log group by z_threshold, run, subrun),
flags as (
  select model, z_threshold, run, subrun, (bad < 3)::int as loose, (bad < 2)::int as medium, (bad < 1)::int as tight from tiers),
truth as (select run, subrun, medium as good from cat)"""


# ---- features and reference

@query(f"select run, subrun, channel, {_r(*FEATURES)} from features")
def channel_features(spark, sf_dir):
    return adapt.features(spark, sf_dir)


@query(f"select run, subrun, channel, {_r('occupancy', 'frac_dead')} from features where frac_dead > 0")
def occupancy_dead(spark, sf_dir):
    return adapt.features(spark, sf_dir, ["occupancy", "frac_dead"]).where("frac_dead > 0").select("run", "subrun", "channel", "occupancy", "frac_dead")


@query(f"select channel, feature, n, {_r('mean', 'std')} from ref_long")
def reference_stats(spark, sf_dir):
    return adapt.stats(adapt.scored(adapt.features(spark, sf_dir, C)))


@query("select * from (" + " union all ".join(f"select run, subrun, channel, '{c}' as feature, round({c}, 6) as z from z" for c in C) + ")")
def zscores_long(spark, sf_dir):
    return adapt.zscores(spark, sf_dir).unpivot(["run", "subrun", "channel"], C, "feature", "z")


@query(f"select run, subrun, channel, trig as triggered_features, {_r('max_z')} from known_log where trig <> ''")
def layer1_flags(spark, sf_dir):
    z = adapt.zscores(spark, sf_dir).withColumns({"t": detect.triggered(C, adapt.Z), "max_z": detect.max_abs_z(C)})
    return z.where(F.size("t") > 0).select("run", "subrun", "channel", F.array_join("t", ";").alias("triggered_features"), "max_z")


@query(f"select run, subrun, channel, anomalous, method, triggered_features, {_r('max_z')} from log")
def detection_log(spark, sf_dir):
    return adapt.log(spark, sf_dir).drop("if_score")


@query("select run, subrun, channel, method from log where method in ('new_channel', 'missing_channel')")
def missing_new_channels(spark, sf_dir):
    return adapt.log(spark, sf_dir).where("method in ('new_channel', 'missing_channel')").select("run", "subrun", "channel", "method")


@query("""select channel, feature, sum(n)::bigint as n, round(avg(x), 6) as mean, round(var_pop(x) * count(*), 6) as m2 from (
""" + " union all ".join(f"select channel, '{c}' as feature, {c} as x, 1 as n from good" for c in C) + ") group by channel, feature")
def welford_merge(spark, sf_dir):
    """State of 1992-1994 merged with that of later good runs equals the state of all."""
    g = adapt.good(adapt.scored(adapt.features(spark, sf_dir, C)))
    return ref.merge_states(ref.reference_state(g.where("run <= 1994"), C), ref.reference_state(g.where("run > 1994"), C))


@query("""
, v as (select channel, run * 100 + subrun as o, case when subrun % 4 <> 0 then quantity_mean end as x from good),
seq as (select channel, list(x order by o) as xs from v group by channel),
fold as (select channel, list_reduce(xs, lambda s, x: struct_pack(n := s.n + 1, mean := coalesce(s.mean + (x.x - s.mean) / (s.n + 1), s.mean),
  m2 := coalesce(s.m2 + (x.x - s.mean) * (x.x - (s.mean + (x.x - s.mean) / (s.n + 1))), s.m2), x := 0.0::double),
  struct_pack(n := 0::bigint, mean := 0.0::double, m2 := 0.0::double, x := 0.0::double)) as s
  from (select channel, list_transform(xs, lambda x: struct_pack(n := 0::bigint, mean := 0.0::double, m2 := 0.0::double, x := x)) as xs from seq))
select channel, s.n as n, round(s.mean, 6) as mean, round(s.m2, 6) as m2 from fold""")
def welford_fold(spark, sf_dir):
    g = adapt.good(adapt.scored(adapt.features(spark, sf_dir, C)))
    v = g.select("channel", (F.col("run") * 100 + F.col("subrun")).alias("o"), F.when(F.col("subrun") % 4 != 0, F.col("quantity_mean")).alias("x"))
    return ref.ordered_fold(v, ["channel"], "o")


@query(f"select channel, feature, n, {_r('mean', 'std')}, (select count(*) from (select distinct run, subrun from good)) as n_files from ref_long")
def incremental_reference(spark, sf_dir):
    """Three updates with lists that overlap, one of them of copies elsewhere, give the reference of all good files, each counted once."""
    g = storage.written(adapt.good(adapt.scored(adapt.features(spark, sf_dir, C))), "good")
    name = F.format_string("/data/%d/Digitizer_run%d_subrun%d.csv", "run", "run", "subrun")
    files = g.select("run", "subrun").distinct().withColumn("filename", name)
    elsewhere = files.withColumn("filename", F.concat(F.lit("/copy"), "filename"))
    folder = f"{storage.scratch_dir(spark)}/growing-{uuid.uuid4().hex}"
    extract = lambda new: g.join(new.select("run", "subrun"), ["run", "subrun"], "left_semi")
    for own in (files.where("run <= 1994"), files.where("run >= 1994").unionByName(elsewhere.where("run <= 1995")), elsewhere):
        version = incremental.add_files(spark, folder, own, extract, C)
    return ref.reference_stats(version.state).where("n > 0").withColumn("n_files", F.lit(version.n_files).cast("long"))


@query("""
, names as (select distinct run, subrun, '/data/' || run || '/Digitizer_run' || run || '_subrun' || subrun || '.csv' as filename from features)
select run, subrun, filename from names where subrun % 3 <> 0""")
def seen_files_anti(spark, sf_dir):
    name = F.concat(F.lit("Digitizer_run"), F.col("run").cast("string"), F.lit("_subrun"), F.col("subrun").cast("string"), F.lit(".csv"))
    files = adapt.hits(spark, sf_dir).select("run", "subrun").distinct()
    seen = files.where("subrun % 3 = 0").select(F.concat(F.lit("elsewhere/"), name).alias("filename"))
    return ref.unseen(files.select("run", "subrun", F.concat(F.lit("/data/"), F.col("run").cast("string"), F.lit("/"), name).alias("filename")), seen)


@query("select channel, count(*) as n_files, round((select count(*) from features)::double / (select count(distinct channel) from features), 6) as mean_files from features group by channel")
def coverage(spark, sf_dir):
    return report.coverage(adapt.features(spark, sf_dir, []))


@query("""
, own as (select feature, avg(mean) as m, stddev_pop(mean) as s, median(std) as mid, min(mean) as low, max(mean) as high from ref_long group by feature)
select channel, feature, round((mean - m) / (s + 1e-9), 6) as mean_norm, round(ln(1 + std / mid), 6) as std_log, round((mean - low) / (high - low), 6) as mean_unit
from ref_long join own using (feature)""")
def reference_normalised(spark, sf_dir):
    return report.normalised_reference(adapt.stats(adapt.scored(adapt.features(spark, sf_dir, C))))


# ---- side tables and run configuration

@query("""
, f as (select distinct run, subrun from scored)
select f.run, f.subrun, 'trigger_rate' as channel, null::int as channel_num, """ + ", ".join(f"b{i} as triggerRate_bit{i}" for i in range(1, 6)) + ", null::double as LVDStotal from f left join board using (run, subrun) " + """
union all select f.run, f.subrun, 'trigger_lvds_total', null, null, null, null, null, null, o.n from f left join
(select year(o_orderdate)::int as run, month(o_orderdate)::int as subrun, count(*)::double as n from orders group by 1, 2) o using (run, subrun)""")
def trigger_pseudo_rows(spark, sf_dir):
    f = adapt.scored(adapt.features(spark, sf_dir, C))
    columns = [*(f"triggerRate_bit{i}" for i in range(1, 6)), "LVDStotal"]
    return feat.with_pseudo_rows(f, f, adapt.board(spark, sf_dir), adapt.lvds(spark, sf_dir), columns).where("channel_num is null")


@query("""
, c(run, p1, p2, p3, p4, p5, trig, has) as (values (1994, 1, 2, 0, 5, 10, 31, true), (1995, 1, 2, 4, 5, 10, 29, true), (1996, null, null, null, null, null, 31, false))
select b.run, b.subrun, """ + ", ".join(f"round(case when ((c.trig >> {i - 1}) & 1) = 0 then null when c.run is null then b{i} when c.p{i} > 0 then b{i} / c.p{i} end, 6) as triggerRate_bit{i}" for i in range(1, 6)) + " from board b left join c using (run)")
def prescale_normalise(spark, sf_dir):
    return feat.normalised_rates(adapt.board(spark, sf_dir), adapt.configs(spark))


@query("select l_orderkey, l_linenumber, " + ", ".join(f"((l_partkey >> {i}) & 1)::int as bit{i}" for i in range(16)) + " from lineitem")
def trigger_bit_decode(spark, sf_dir):
    """All 16 bits of all rows."""
    rows = adapt.table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", *[scalar.bit(F.col("l_partkey"), i).cast("int").alias(f"bit{i}") for i in range(16)])


_masked = "f.run = 1995 and ((238 >> (f.channel // 2)) & 1) = 0"


@query("select run, subrun, channel, " + ", ".join(f"round(case when not ({_masked}) then {c} end, 6) as {c}" for c in C) + " from scored f")
def mask_channels(spark, sf_dir):
    f = adapt.scored(adapt.features(spark, sf_dir, C)).withColumn("channel_num", F.col("channel"))
    return feat.null_masked(f, adapt.configs(spark), C).select("run", "subrun", "channel", *C)


@query("""
, p as (select year(o_orderdate)::int as run, month(o_orderdate)::int as subrun, (o_custkey % 8)::int as pin, count(*)::double as v from orders group by 1, 2, 3)
select s.run, s.subrun, s.channel, p.v as LVDSpin from scored s left join p on p.run = s.run and p.subrun = s.subrun and p.pin = s.channel // 2""")
def lvds_pin_join(spark, sf_dir):
    return feat.with_lvds_pin(adapt.scored(adapt.features(spark, sf_dir, C)), adapt.lvds(spark, sf_dir)).select("run", "subrun", "channel", "LVDSpin")


@query(f"select run, subrun, channel, {_masked} as masked, " + ", ".join(f"round({c}, 6) as raw_{c}, round(case when not ({_masked}) then {c} end, 6) as norm_{c}" for c in C) + " from scored f")
def raw_vs_normalised(spark, sf_dir):
    f = adapt.scored(adapt.features(spark, sf_dir, C)).withColumn("channel_num", F.col("channel"))
    return report.raw_and_normalised(f, feat.null_masked(f, adapt.configs(spark), C), C)


# ---- log, status, runs

@query("select run, subrun, count(*) as n_total, count(*) filter (anomalous) as n_bad, round(count(*) filter (anomalous) / count(*)::double, 6) as frac_bad from log group by run, subrun")
def file_counts(spark, sf_dir):
    return status.file_counts(adapt.log(spark, sf_dir))


@query("""
, r as (select *, row_number() over (partition by run, subrun order by max_z desc, channel) as k from log where anomalous and max_z is not null)
select f.run, f.subrun, round(coalesce(r.max_z, 0), 6) as worst_z, r.channel as worst_channel from (select distinct run, subrun from log) f left join r on r.run = f.run and r.subrun = f.subrun and r.k = 1""")
def worst_channel(spark, sf_dir):
    return status.worst_channel(adapt.log(spark, sf_dir))


@query(f"select run, subrun, channel, streak::bigint as streak, streak = {adapt.N} as persistent from streak where anomalous")
def persistence(spark, sf_dir):
    return status.streaks(adapt.log(spark, sf_dir), adapt.N).where("anomalous").select("run", "subrun", "channel", "streak", "persistent")


@query(f"select run, subrun, n_anomalous, n_persistent, n_transient, {_r('worst_z')}, status from status")
def file_status(spark, sf_dir):
    return adapt.status(spark, sf_dir)


@query("""
, i as (select *, row_number() over (partition by run order by subrun) - 1 as file_index from status),
d as (select *, case when status = 'alert' then 'drop' when file_index < 2 and n_anomalous > 0 then 'hold' else 'list' end as decision from i),
n as (select *, first(case when decision <> 'hold' then decision end ignore nulls) over (partition by run order by subrun rows between 1 following and unbounded following) as coming from d)
select run, subrun, file_index::int as file_index, decision, case when decision = 'hold' then coalesce(coming = 'list', false) else decision = 'list' end as listed from n""")
def probation_good_list(spark, sf_dir):
    return status.good_list(adapt.status(spark, sf_dir), 3)


_classes = """
, f as (select run, subrun, count(*) filter (anomalous) >= 1 as bad from log group by run, subrun),
a as (select run, channel from log where anomalous group by run, channel having count(distinct subrun) = (select count(*) from f where f.run = log.run)),
p as (select run, string_agg(channel::varchar, ';' order by channel::varchar) as pc from a group by run),
r as (select run, count(*) filter (not bad) as n_good_subruns, count(*) filter (bad) as n_bad_subruns, max(subrun) filter (not bad) as last_good_subrun, min(subrun) filter (bad) as first_bad_subrun from f group by run)
"""


@query(_classes + """select run, case when n_bad_subruns = 0 and n_good_subruns >= 2 and pc is not null then 'persistent_fault' when n_bad_subruns = 0 then 'good' when n_good_subruns = 0 then 'bad' when first_bad_subrun > last_good_subrun then 'partial' else 'mixed' end as classification,
n_good_subruns, n_bad_subruns, last_good_subrun, first_bad_subrun, coalesce(pc, '') as persistent_channels from r left join p using (run)""")
def run_classification(spark, sf_dir):
    return status.classify_runs(adapt.log(spark, sf_dir), 1)


@query("""
, l as (select run, subrun, event_type as channel, max(value) > 99 as anomalous from (select dayofmonth(ts)::int as run, (hour(ts) // 6)::int as subrun, event_type, value from events) group by 1, 2, 3),
n as (select run, count(distinct subrun) as k from l group by run),
a as (select l.run, channel from l join n using (run) where anomalous group by l.run, channel, k having count(*) = k)
select run, string_agg(channel, ';' order by channel) as persistent_channels from a group by run""")
def persistent_faults(spark, sf_dir):
    """Event types that are out of range in each quarter of a day."""
    rows = adapt.table(spark, sf_dir, "events").select(F.dayofmonth("ts").alias("run"), F.expr("int(hour(ts) div 6)").alias("subrun"), F.col("event_type").alias("channel"), "value")
    log = rows.groupBy("run", "subrun", "channel").agg((F.max("value") > 99).alias("anomalous"))
    return status.classify_runs(log, 10**6).where("persistent_channels <> ''").select("run", "persistent_channels")


# ---- catalogue and evaluation

@query("select run, subrun, loose, medium, tight from cat where (loose or medium or tight) and run between 1993 and 1996")
def quality_filter(spark, sf_dir):
    return cat.select_catalogue(adapt.catalogue(adapt.hits(spark, sf_dir)), "All", 1993, 1996).drop("position")


@query("select count(*) as n_entries, count(distinct run) as n_runs, count(*) filter (loose) as n_loose, count(*) filter (medium) as n_medium, count(*) filter (tight) as n_tight, count(*) filter (loose or medium or tight) as n_all from cat")
def catalogue_counts(spark, sf_dir):
    return cat.catalogue_counts(adapt.catalogue(adapt.hits(spark, sf_dir)))


@query("""
, f as (select distinct run, subrun from hits)
select run, subrun from f where run = 1993 or (run = 1994 and subrun = 5) or run = 1996""")
def catalogue_expand(spark, sf_dir):
    entries = spark.createDataFrame([(1993, -1), (1994, 5), (1994, 77), (1996, -1), (1996, 3), (2050, -1)], "run int, subrun int")
    return cat.expand_catalogue(entries, adapt.hits(spark, sf_dir))


@query("select run, subrun, loose, medium, tight, 'v1' as tag from cat where tight")
def catalogue_json(spark, sf_dir):
    """The catalogue written as positional JSON rows, a document a run, and parsed again; an earlier version of each entry loses."""
    c = adapt.catalogue(adapt.hits(spark, sf_dir))
    row = lambda t, tag: F.concat_ws("", F.lit("["), F.concat_ws(",", F.col("run").cast("string"), F.col("subrun").cast("string"), *[t(q) for q in cat.QUALITIES], F.lit("0"), F.lit(f'"{tag}"')), F.lit("]"))
    own = c.groupBy("run").agg(F.array_join(F.concat(F.collect_list(row(lambda _: F.lit("false"), "v0")), F.collect_list(row(lambda q: F.col(q).cast("string"), "v1"))), ",").alias("rows"))
    text = own.select(F.concat(F.lit('{"data": ['), F.col("rows"), F.lit("]}")).alias("value"))
    return cat.last_entries(readers.parse_catalogue(text)).where("tight").select("run", "subrun", "loose", "medium", "tight", "tag")


@query("select gt, " + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("ok", "warn", "pend", "alert")) + " from judged group by gt")
def ground_truth_crosstab(spark, sf_dir):
    return cat.crosstab(cat.ground_truth(adapt.status(spark, sf_dir), adapt.catalogue(adapt.hits(spark, sf_dir)), "Medium"))


@query("select gt, status, count(*) as n, (sum(count(*)) over (partition by gt))::bigint as total, round(100.0 * count(*) / sum(count(*)) over (partition by gt), 6) as percent from judged group by gt, status")
def eval_rates(spark, sf_dir):
    return cat.rates(cat.ground_truth(adapt.status(spark, sf_dir), adapt.catalogue(adapt.hits(spark, sf_dir)), "Medium"))


def _as_files(rows):
    """Documents take the part of files of one run."""
    return rows.select(F.lit(0).alias("run"), F.col("doc_id").alias("subrun"), *[c for c in rows.columns if c != "doc_id"])


@query("select case quality when 1 then 'known_good' when 0 then 'not_certified' else 'unknown' end as gt, count(*) as n from documents left join labels using (doc_id) group by 1")
def label_ground_truth(spark, sf_dir):
    docs, labels = adapt.table(spark, sf_dir, "documents"), adapt.table(spark, sf_dir, "labels")
    entries = labels.select("doc_id", *[(F.col("quality") == 1).alias(q) for q in cat.QUALITIES], F.lit(0).alias("position"))
    return cat.ground_truth(_as_files(docs.select("doc_id")), _as_files(entries), "Medium").groupBy("gt").agg(F.count("*").alias("n"))


@query("select case quality when 1 then 'known_good' else 'unknown' end as gt, count(*) as n from documents left join labels using (doc_id) group by 1")
def list_ground_truth(spark, sf_dir):
    """The same from a plain list of good documents."""
    docs, labels = adapt.table(spark, sf_dir, "documents"), adapt.table(spark, sf_dir, "labels")
    return cat.from_list(_as_files(docs.select("doc_id")), _as_files(labels.where("quality = 1").select("doc_id"))).groupBy("gt").agg(F.count("*").alias("n"))


@query("select run, subrun, (status in ('ok', 'warn', 'pend'))::int as loose, (status in ('ok', 'warn'))::int as medium, (status = 'ok')::int as tight from status")
def framework_tiers(spark, sf_dir):
    return cat.framework_tiers(adapt.status(spark, sf_dir))


# ---- reports

@query("select channel, count(*) as n from log where anomalous group by channel order by n desc, channel limit 40")
def channel_frequency(spark, sf_dir):
    return report.channel_frequency(adapt.log(spark, sf_dir))


@query("select feature, count(*) as n from (select unnest(string_split(triggered_features, ';')) as feature from log) where feature not in ('', 'nan') group by feature order by n desc, feature limit 20")
def feature_frequency(spark, sf_dir):
    return report.feature_frequency(adapt.log(spark, sf_dir))


@query("select run, count(*) as n_subruns, count(*) filter (status = 'ok') as n_good, count(*) filter (status = 'pend') as n_pend, round(100.0 * count(*) filter (status = 'ok') / count(*), 6) as pct_good from status group by run")
def run_ok_share(spark, sf_dir):
    return report.run_ok_share(adapt.status(spark, sf_dir))


@query("select run, count(*) as n_subruns, count(*) filter (status = 'alert') as n_bad, count(*) filter (status = 'warn') as n_warn, count(*) filter (status = 'pend') as n_pend, count(*) filter (status = 'ok') as n_good, round(100.0 * (1 - count(*) filter (status = 'alert') / count(*)::double), 6) as pct_good from status group by run")
def persistence_run_summary(spark, sf_dir):
    return report.persistence_summary(adapt.status(spark, sf_dir))


@query("""
, own as (select * from status where (run * 13 + subrun) % 7 <> 0)
select r.run, s.subrun, coalesce(case o.status when 'ok' then 1 when 'pend' then 2 when 'warn' then 3 when 'alert' then 4 end, 0)::int as code
from (select distinct run from own) r cross join (select distinct subrun from own) s left join own o on o.run = r.run and o.subrun = s.subrun""")
def status_grid(spark, sf_dir):
    """Every seventh file has no data."""
    return report.status_grid(adapt.status(spark, sf_dir).where((F.col("run") * 13 + F.col("subrun")) % 7 != 0))


@query("select run, subrun, count(*) filter (anomalous) as n_bad, round(count(*) filter (anomalous) / count(*)::double, 6) as frac_bad, any_value(s.status) as status from log join status s using (run, subrun) group by run, subrun")
def anomaly_rate(spark, sf_dir):
    log = adapt.log(spark, sf_dir)
    return report.anomaly_rate(log, status.file_status(log, adapt.N, adapt.LEAST, adapt.BULK, adapt.EXTREME))


@query(f"select run, subrun, channel, round(max_z, 6) as max_z, case when not anomalous then 'ok' when (sum(anomalous::int) over (partition by run, subrun)) >= {adapt.BULK} or coalesce(max_z >= {adapt.EXTREME}, false) then 'alert' else 'warn' end as severity from log")
def channel_severity(spark, sf_dir):
    return report.channel_severity(adapt.log(spark, sf_dir), adapt.BULK, adapt.EXTREME)


@query(" union all ".join(f"select run, subrun, channel, '{c}' as feature, round(case when {c} is not null then least(abs({c}), 50) end, 6) as z from z" for c in C))
def z_heatmap(spark, sf_dir):
    """The heatmap of all runs."""
    return report.z_heatmap(adapt.zscores(spark, sf_dir), C)


@query("select s_suppkey as channel, s_nationkey as layer, s_nationkey % 4 as row, round(s_nationkey % 4 + case when s_suppkey % 2 = 0 then 0.2::double else -0.2::double end, 6) as y from supplier")
def geometry_first(spark, sf_dir):
    s = adapt.table(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_suppkey").alias("channel"), F.col("s_suppkey").alias("event_id"), F.col("s_nationkey").alias("layer"), (F.col("s_nationkey") % 4).alias("row"), F.lit(0).alias("column"))
    twice = rows.unionByName(rows.withColumns({"event_id": F.col("event_id") + 1, "layer": F.lit(99)}))
    return report.geometry(twice).select("channel", "layer", "row", scalar.row_offset(F.col("row"), F.col("channel")).alias("y"))


@query("""
, r as (select *, row_number() over (partition by run, subrun order by max_z desc, channel) as k, count(*) over (partition by run, subrun) as a from log where anomalous and max_z is not null)
select run, subrun, channel, method, triggered_features, round(max_z, 6) as max_z, k::int as rank, greatest(a - 2, 0) as more from r where k <= 2""")
def top_channels(spark, sf_dir):
    return report.top_channels(adapt.log(spark, sf_dir), 2)


@query(f"""
, r as (select *, row_number() over (partition by run, subrun order by max_z desc, channel) as k, count(*) over (partition by run, subrun) as a from log where anomalous and max_z is not null),
w as (select run, subrun, string_agg('ch' || channel || ' (' || triggered_features || ')', ', ' order by k) filter (k <= 2) || case when max(a) > 2 then ' and ' || (max(a) - 2) || ' more' else '' end as worst, any_value(channel) filter (k = 1) as top from r group by run, subrun),
t as (select run, subrun, count(*) as n_total from log group by run, subrun)
select s.run, s.subrun, 'run ' || s.run || ' subrun ' || s.subrun || ': ' || concat_ws('  |  ',
  case when n_persistent >= {adapt.LEAST} then n_persistent || ' persistent' || case when n_transient > 0 then ' + ' || n_transient || ' transient' else '' end || ' anomalous ch  (window: {adapt.N} files)' end,
  case when n_anomalous >= {adapt.BULK} then n_anomalous || '/' || n_total || ' anomalous ch  [bulk ≥{adapt.BULK}]' end,
  case when worst_z >= {adapt.EXTREME} then 'extreme z=' || printf('%.1f', worst_z) || ' on ch' || top end) || coalesce(' | ' || worst, '') as text
from status s join t using (run, subrun) left join w using (run, subrun) where status = 'alert'""")
def alert_text(spark, sf_dir):
    log = adapt.log(spark, sf_dir)
    s = status.file_status(log, adapt.N, adapt.LEAST, adapt.BULK, adapt.EXTREME)
    return report.alert_text(log, s, adapt.LEAST, adapt.BULK, adapt.EXTREME, 2, adapt.N)


#: Lines of the anomalous rows of largest z, by the columns given first; the second follows from them.
_lines = """
, lw as (select *, row_number() over (partition by {by} order by max_z desc, {then}channel::varchar) as k, count(*) over (partition by {by}) as a from log where anomalous and max_z is not null),
lines as (select {by}, string_agg('  ch' || channel || ': max_z=' || printf('%.1f', max_z) || '  if_score=nan  features=[' || triggered_features || ']', chr(10) order by k) filter (k <= {n})
          || case when max(a) > {n} then chr(10) || '  ... and ' || (max(a) - {n}) || ' more anomalous channels' else '' end as lines,
          string_agg(channel::varchar, ',' order by k) filter (k <= {n}) as top_channels from lw group by {by})
"""
_snapshot = _lines.format(by="run", then="subrun, ", n=5) + """
, s as (select run, count(distinct subrun) as n_subruns, count(distinct subrun) filter (anomalous) as n_bad_subruns, count(*) filter (anomalous) as n_anomalous from log group by run),
snap as (select k.run, coalesce(n_subruns, 0) as n_subruns, coalesce(n_bad_subruns, 0) as n_bad_subruns, coalesce(n_anomalous, 0) as n_anomalous, coalesce(top_channels, '') as top_channels,
  case when n_subruns is null then '  (run ' || k.run || ' not found in log — annotation used without snapshot)'
       else '  Subruns in log: ' || n_subruns || '  |  subruns with anomalies: ' || n_bad_subruns || chr(10) || '  Total anomalous channel-entries: ' || n_anomalous || chr(10) || '  Top channels (by max_z):' || chr(10) || coalesce(lines, '  (no anomaly data)') end as snapshot
  from (values (1993), (1997), (2050)) k(run) left join s using (run) left join lines using (run))
"""


@query(_snapshot + "select * from snap")
def historical_snapshot(spark, sf_dir):
    return report.historical_snapshot(adapt.log(spark, sf_dir), spark.createDataFrame([(1993,), (1997,), (2050,)], "run int"))


@query(_lines.format(by="run, subrun", then="", n=2) + f"""
, t as (select run, subrun, count(*) as n_total, count(*) filter (anomalous) as n_all from log group by run, subrun),
w as (select run, subrun, channel as top from lw where k = 1)
select s.run, s.subrun, 'Run ' || s.run || ', subrun ' || s.subrun || ' — ALERT' || chr(10) || 'Conditions: ' || concat_ws(', ',
  case when n_persistent >= {adapt.LEAST} then n_persistent || ' persistent' || case when n_transient > 0 then ' + ' || n_transient || ' transient' else '' end || ' anomalous ch  (window: {adapt.N} files)' end,
  case when n_anomalous >= {adapt.BULK} then n_anomalous || '/' || n_total || ' anomalous ch  [bulk ≥{adapt.BULK}]' end,
  case when worst_z >= {adapt.EXTREME} then 'extreme z=' || printf('%.1f', worst_z) || ' on ch' || top end)
  || chr(10) || 'Anomalous channels (' || n_all || ' total, top by max_z):' || chr(10) || coalesce(lines, '  (no anomaly data)') as text
from status s join t using (run, subrun) left join lines using (run, subrun) left join w using (run, subrun) where status = 'alert'""")
def alert_block(spark, sf_dir):
    log = adapt.log(spark, sf_dir)
    s = status.file_status(log, adapt.N, adapt.LEAST, adapt.BULK, adapt.EXTREME)
    return report.alert_block(log, s, adapt.LEAST, adapt.BULK, adapt.EXTREME, 2, adapt.N)


_CASES = [(1993, "hv", "trip", "ramp down", None), (1993, "daq", "crash", None, "restart"), (2050, None, None, None, None)]


@query(_snapshot + f"""
, kb(run, category, cause, action, recovery) as (values {", ".join("(" + ", ".join("null" if x is None else repr(x) for x in c) + ")" for c in _CASES)})
select kb.run, category, '### Case: run ' || kb.run || chr(10) || 'Anomaly data (auto-injected from log):' || chr(10) || snapshot || chr(10) || 'Human annotation:' || chr(10) || '  Category : ' || coalesce(category, 'unknown') || chr(10)
  || '  Cause    : ' || coalesce(cause, 'unspecified') || chr(10) || '  Action   : ' || coalesce(action, 'unspecified') || chr(10) || '  Recovery : ' || coalesce(recovery, 'unspecified') as block from kb join snap using (run)""")
def case_blocks(spark, sf_dir):
    """The knowledge base's cases as the prompt has them."""
    cases = spark.createDataFrame(_CASES, "run int, category string, cause string, action string, recovery string")
    return report.case_blocks(report.annotated(cases, adapt.log(spark, sf_dir))).select("run", "category", "block")


@query("""
, r as (select *, row_number() over (partition by run, subrun order by max_z desc, channel) as k from log where anomalous and max_z is not null),
c as (select run, subrun, k::int as rank, method as category, case when k = 1 then 'high' else 'low' end as confidence, unnest(case when k = 1 then [run - 1, 1993] else [null] end)::int as matched_run from r where k <= 2),
kb(matched_run, case_category, case_cause, case_action) as (values (1993, 'hv', 'trip', 'ramp down'), (1993, 'daq', 'crash', null), (1995, 'cal', null, null))
select distinct run, subrun, rank, category, confidence, matched_run, case_category, case_cause, case_action from c left join kb using (matched_run)""")
def answer_cases(spark, sf_dir):
    """Answers of the asked-for form, made of the log, as text: parsed, laid out by candidate and joined with the annotated cases."""
    top = report.top_channels(adapt.log(spark, sf_dir), 2)
    runs = F.when(F.col("rank") == 1, F.array(F.col("run") - 1, F.lit(1993))).otherwise(F.array().cast("array<int>"))
    one = F.struct("rank", F.col("method").alias("category"), runs.alias("matched_runs"), F.when(F.col("rank") == 1, "high").otherwise("low").alias("confidence"))
    answers = top.groupBy("run", "subrun").agg(F.to_json(F.struct(F.sort_array(F.collect_list(one)).alias("candidates"), F.lit("why").alias("reasoning"))).alias("response"))
    cases = spark.createDataFrame([(1993, "hv", "trip", "ramp down"), (1993, "daq", "crash", None), (1995, "cal", None, None)], "run int, category string, cause string, action string")
    return report.matched_cases(report.candidates(report.parsed_response(answers)), cases)


# ---- text and union

@query("select distinct (o_custkey % 40)::int as run, (o_orderkey % 30)::int as subrun, 'x/DIGITIZER_run' || (o_custkey % 40) || '_subrun' || (o_orderkey % 30) || '.csv' as path from orders where o_orderkey % 7 <> 0 union all select distinct null::int, null::int, 'x/other_' || (o_custkey % 40) || '.csv' from orders")
def filename_parse(spark, sf_dir):
    o = adapt.table(spark, sf_dir, "orders")
    own = o.where("o_orderkey % 7 <> 0").select(F.concat(F.lit("x/DIGITIZER_run"), (F.col("o_custkey") % 40).cast("string"), F.lit("_subrun"), (F.col("o_orderkey") % 30).cast("string"), F.lit(".csv")).alias("path"))
    rows = own.distinct().unionByName(o.select(F.concat(F.lit("x/other_"), (F.col("o_custkey") % 40).cast("string"), F.lit(".csv")).alias("path")).distinct())
    return rows.select(scalar.file_run(scalar.base_name(F.col("path"))).alias("run"), scalar.file_subrun(scalar.base_name(F.col("path"))).alias("subrun"), "path")


#: Tags of models, made of each order's columns, and what they say.
_tagged = """
, o as (
  select year(o_orderdate) as y, o_custkey % 30 as c, o_orderkey % 9 + 2 as z, o_custkey % 4 as k, o_orderkey % 3 * 100 as t, o_orderkey % 11 <> 0 as has_z, o_orderkey % 2 = 0 as no_trigger, o_orderkey % 5 = 0 as no_lvds, o_orderkey % 7 = 0 as no_config,
         case substr(o_orderpriority, 1, 1) when '1' then 'Loose' when '2' then 'Medium' when '3' then 'Tight' when '4' then 'All' end as q from orders),
tagged as (
  select 'sweep_' || case when y < 1995 then '260429' else '260521' end || '_ifContamination_0p' || lpad(c::varchar, 2, '0') || case when has_z then '_zThreshold_' || z || 'sigma' else '' end
         || case when k > 0 then '_alertConsec_' || k else '' end || case when t > 0 then '_nEst_' || t || '_maxSamp_' || t * 2 else '' end || coalesce('_' || q, '')
         || case when no_trigger then '_noTrigger' else '' end || case when no_lvds then '_noLVDS' else '' end || case when no_config then '_ignoreTriggerConfig' else '' end as tag,
         case when y < 1995 then '260429' else '260521' end as sweep, c / 100.0::double as contamination, case when has_z then z::double end as z_threshold, nullif(k, 0) as consecutive, nullif(t, 0) as n_trees, nullif(t * 2, 0) as max_samples,
         q as quality, not no_trigger as use_trigger, not no_lvds as use_lvds, not no_config as use_trigger_config from o)
"""


def _tags(spark, sf_dir):
    o = adapt.table(spark, sf_dir, "orders")
    part = lambda when, text, *columns: F.when(when, F.format_string(text, *columns)).otherwise("")
    k, t, key = F.col("o_custkey") % 4, F.col("o_orderkey") % 3 * 100, F.col("o_orderkey")
    sweep = F.when(F.year("o_orderdate") < 1995, "260429").otherwise("260521")
    quality = F.element_at(F.array(*[F.lit(f"_{q}") for q in ("Loose", "Medium", "Tight", "All", "")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    tag = F.concat(F.lit("sweep_"), sweep, F.format_string("_ifContamination_0p%02d", F.col("o_custkey") % 30), part(key % 11 != 0, "_zThreshold_%dsigma", key % 9 + 2), part(k > 0, "_alertConsec_%d", k), part(t > 0, "_nEst_%d_maxSamp_%d", t, t * 2), F.when(quality == "_", "").otherwise(quality), part(key % 2 == 0, "_noTrigger"), part(key % 5 == 0, "_noLVDS"), part(key % 7 == 0, "_ignoreTriggerConfig"))
    return o.groupBy(tag.alias("tag"), sweep.alias("sweep")).agg(F.count("*").alias("n"))


@query(_tagged + "select tag, contamination, z_threshold, consecutive::int as consecutive, n_trees::int as n_trees, max_samples::int as max_samples, quality, use_trigger, use_lvds, use_trigger_config, count(*) as n from tagged group by all")
def tag_parse(spark, sf_dir):
    return _tags(spark, sf_dir).select("tag", *[x.alias(k) for k, x in scalar.tag_fields(F.col("tag")).items()], "n")


@query(_tagged + "select tag, contamination, z_threshold, sweep, count(*) as n from tagged where z_threshold is not null group by all")
def sweep_union(spark, sf_dir):
    """Models of two sweeps as one table; tags that are no part of a sweep drop out."""
    parts = [_tags(spark, sf_dir).where(F.col("sweep") == kind) for kind in ("260521", "260429")]
    return scalar.with_tag_fields(parts[0].unionByName(parts[1])).select("tag", "contamination", "z_threshold", "sweep", "n")


@query("select event_type, json_extract_string(props, '$.k')::bigint as k, count(*) as n from events group by 1, 2")
def json_props(spark, sf_dir):
    e = adapt.table(spark, sf_dir, "events")
    return e.select("event_type", F.from_json("props", "k bigint")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("select run, subrun, " + ", ".join(f"b{i} as triggerRate_bit{i}" for i in range(1, 6)) + " from board")
def repeated_header_parse(spark, sf_dir):
    """Trigger tables written as text, a header before each row and noise around, and parsed again."""
    b = adapt.board(spark, sf_dir)
    names = [f"triggerRate_bit{i}" for i in range(1, 6)]
    head = "subrunnum, " + ",  ".join(names) + ", triggerRate_tot\n"
    line = F.concat(F.lit(head), F.concat_ws(" , ", F.col("subrun").cast("string"), *[F.col(c).cast("string") for c in names], F.lit("n/a")), F.lit("\n\n"))
    text = b.groupBy("run").agg(F.concat(F.lit("7, 1, 1\n"), F.array_join(F.collect_list(line), "")).alias("value"))
    rows = readers.trigger_rows(text.select(F.concat(F.lit("d/TriggerBoard_run"), F.col("run").cast("string"), F.lit(".csv")).alias("path"), "value"))
    return feat.first_by_file(rows).select("run", "subrun", *names)


@query("""
, e as (select user_id, event_type, event_id, row_number() over (partition by user_id, event_type order by event_id) as k from events)
select user_id, event_type, event_id from e where k = 1""")
def ordered_dedupe(spark, sf_dir):
    """First appearance of each pair."""
    return sampling.first_appearances(adapt.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("""select run, subrun, channel, anomalous, round(max_z, 6) as max_z, null::varchar as note from log where run <= 1994 union all
select run, subrun, channel, anomalous, null, 'old' from log where run > 1994 or run is null""")
def combine_logs(spark, sf_dir):
    """Two logs that hold all runs between them."""
    log = adapt.log(spark, sf_dir)
    new = log.where("run <= 1994").select("run", "subrun", "channel", "anomalous", "max_z")
    return writers.combine_logs([new, log.where("run > 1994 or run is null").select("channel", "subrun", "run", "anomalous", F.lit("old").alias("note"))])


# ---- sweeps and votes

def _sweep(spark, sf_dir):
    return sweeps.sweep_flags(adapt.log(spark, sf_dir), sweeps.grid(spark, z_threshold=[2.0, 2.5, 3.0]))


def _flags(spark, sf_dir):
    bad = _sweep(spark, sf_dir).groupBy("z_threshold", "run", "subrun").agg(F.count_if("anomalous").alias("bad"))
    return bad.select(F.concat(F.lit("z"), F.col("z_threshold").cast("string")).alias("model"), "z_threshold", "run", "subrun", *[(F.col("bad") < k).cast("int").alias(t) for k, t in ((3, "loose"), (2, "medium"), (1, "tight"))])


def _truth(spark, sf_dir):
    return adapt.catalogue(adapt.hits(spark, sf_dir)).select("run", "subrun", F.col("medium").alias("good"))


@query("""
, o as (select *, sum(anomalous::int) over (partition by z_threshold, run, channel order by subrun rows between 1 preceding and current row) = 2 as p from sweep_log)
select z_threshold, run, subrun, count(*) filter (anomalous) as n_anomalous, count(*) filter (p) as n_persistent from o group by z_threshold, run, subrun""")
def sweep_status_grid(spark, sf_dir):
    """Status counts of every threshold from one scoring and one window."""
    swept = status.status_sweep(adapt.log(spark, sf_dir), sweeps.grid(spark, z_threshold=[2.0, 2.5, 3.0]), 2)
    return swept.select("z_threshold", "run", "subrun", "n_anomalous", "n_persistent")


def _model_sql(ok: str) -> str:
    return f"""select model, count(*) as n, count(*) filter (good) as n_known_good, count(*) filter (good and loose + medium + tight = 0) as fp, count(*) filter (good and {ok} = 1) as tn,
round(100.0 * count(*) filter (good and loose + medium + tight = 0) / count(*) filter (good), 6) as fp_percent, round(100.0 * count(*) filter (good and {ok} = 1) / count(*) filter (good), 6) as tn_percent,
round(100.0 * count(*) filter ({ok} = 1) / count(*), 6) as ok_percent from flags left join truth using (run, subrun) group by model"""


@query(_model_sql("tight"))
def model_fp_tn(spark, sf_dir):
    return sweeps.model_metrics(_flags(spark, sf_dir), _truth(spark, sf_dir), "tight")


@query(_model_sql("loose"))
def model_fp_tn_loose(spark, sf_dir):
    return sweeps.model_metrics(_flags(spark, sf_dir), _truth(spark, sf_dir), "loose")


@query("select model, run, round(100.0 * avg(tight), 6) as ok_percent from flags group by model, run")
def per_run_ok_rate(spark, sf_dir):
    return sweeps.model_metrics(_flags(spark, sf_dir), _truth(spark, sf_dir), "tight", ("run",)).select("model", "run", "ok_percent")


@query("select model, round(avg(r), 6) as mean_ok_percent from (select model, run, 100.0 * avg(tight) as r from flags group by model, run) group by model")
def mean_ok_ranking(spark, sf_dir):
    return sweeps.mean_ok_rate(_flags(spark, sf_dir))


@query("""
, c as (select 'm' || z_threshold as model, count(*) filter (good) as k, count(*) filter (good and loose = 0) as a, count(*) filter (good and tight = 1) as o from flags left join truth using (run, subrun) group by z_threshold)
select model, k as n_known_good, a as fp, o as tn, round(100.0 * a / k, 6) as fp_percent, round(100.0 * o / k, 6) as tn_percent from c""")
def confusion_metrics(spark, sf_dir):
    judged = _flags(spark, sf_dir).join(_truth(spark, sf_dir), ["run", "subrun"], "left")
    gt = F.when(F.col("good"), "known_good").otherwise("other")
    s = F.when(F.col("loose") == 0, "alert").when(F.col("tight") == 1, "ok").otherwise("warn")
    counts = judged.groupBy(F.concat(F.lit("m"), F.col("z_threshold").cast("string")).alias("model"), gt.alias("gt"), s.alias("status")).agg(F.count("*").alias("n"))
    return sweeps.from_confusion(counts)


_votes = """
, pan(panel, model) as (values ('all', 'z2.0'), ('all', 'z2.5'), ('all', 'z3.0'), ('ab', 'z2.0'), ('ab', 'z3.0')),
v as (select model, run, subrun, tight as ok from flags where not (model = 'z3.0' and subrun = 11)),
s as (select panel, count(*) as size from pan group by panel),
f as (select panel, size, run, subrun, size - sum(ok) as bad from v join pan using (model) join s using (panel) group by panel, size, run, subrun having count(*) = size),
k as (select f.*, coalesce(good, false) as kg, kk.k from f left join truth using (run, subrun) join (values (1), (2), (3)) kk(k) on kk.k <= f.size)
"""


def _votes_of(spark, sf_dir):
    v = _flags(spark, sf_dir).where("not (model = 'z3.0' and subrun = 11)").select("run", "subrun", "model", F.col("tight").alias("ok"))
    pan = spark.createDataFrame([("all", "z2.0"), ("all", "z2.5"), ("all", "z3.0"), ("ab", "z2.0"), ("ab", "z3.0")], "panel string, model string")
    return v, pan


@query(_votes + "select panel, k::bigint as k, count(*) as n_scored, count(*) filter (kg) as n_known_good, round(100.0 * count(*) filter (kg and bad >= k) / count(*) filter (kg), 6) as fp_percent, round(100.0 * count(*) filter (bad < k) / count(*), 6) as coverage_percent from k group by panel, k")
def vote_k_sweep(spark, sf_dir):
    v, pan = _votes_of(spark, sf_dir)
    return sweeps.vote_metrics(v, _truth(spark, sf_dir), pan)


@query("""
, v as (select model || t.tier as model, z_threshold, run, subrun, case t.tier when 'L' then loose when 'M' then medium else tight end as ok
        from flags cross join (values ('L'), ('M'), ('T')) t(tier) where not (model = 'z3.0' and subrun = 11)),
p as (select a.model || '+' || b.model || '+' || c.model as panel, a.ok + b.ok + c.ok = 0 as bad, coalesce(t.good, false) as kg
      from v a join v b on a.run = b.run and a.subrun = b.subrun and a.model < b.model join v c on c.run = a.run and c.subrun = a.subrun and b.model < c.model
      left join truth t on t.run = a.run and t.subrun = a.subrun
      where 2.0 in (a.z_threshold, b.z_threshold, c.z_threshold) and 3.0 in (a.z_threshold, b.z_threshold, c.z_threshold)),
m as (select panel, count(*) as n_scored, count(*) filter (kg) as n_known_good, 100.0 * count(*) filter (kg and bad) / count(*) filter (kg) as fp_percent, 100.0 * count(*) filter (not bad) / count(*) as coverage_percent
      from p group by panel having count(*) filter (kg) > 0),
r as (select *, row_number() over (order by fp_percent, coverage_percent desc, panel) as a, row_number() over (order by coverage_percent desc, fp_percent, panel) as b from m)
select 'fp' as best, panel, n_scored, n_known_good, round(fp_percent, 6) as fp_percent, round(coverage_percent, 6) as coverage_percent from r where a <= 5
union all select 'coverage', panel, n_scored, n_known_good, round(fp_percent, 6), round(coverage_percent, 6) from r where b <= 5""")
def panel_search(spark, sf_dir):
    """Triples of nine models (three thresholds, three tiers), one member at least of thresholds 2 and 3."""
    tiers = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.col(c).alias("ok")) for t, c in (("L", "loose"), ("M", "medium"), ("T", "tight"))]))
    votes = storage.written(_flags(spark, sf_dir).where("not (model = 'z3.0' and subrun = 11)").select("run", "subrun", "model", "z_threshold", tiers.alias("t")).select("run", "subrun", F.concat("model", "t.tier").alias("model"), "z_threshold", "t.ok"), "votes")
    thresholds = {r["model"]: r["z_threshold"] for r in votes.select("model", "z_threshold").distinct().collect()}
    by_fp, by_coverage = panels.panel_search(votes, _truth(spark, sf_dir), 3, 5, thresholds=thresholds, both=(2.0, 3.0))
    return by_fp.select(F.lit("fp").alias("best"), "*").unionByName(by_coverage.select(F.lit("coverage").alias("best"), "*"))


@query(_votes + "select panel, k::bigint as k, count(*) as n_scored, count(*) filter (kg) as n_known_good, round(100.0 * count(*) filter (kg and bad >= k) / count(*) filter (kg), 6) as fp_percent, round(100.0 * count(*) filter (bad < k) / count(*), 6) as coverage_percent from k where k = 2 group by panel, k")
def vote_metrics(spark, sf_dir):
    v, pan = _votes_of(spark, sf_dir)
    return sweeps.vote_metrics(v, _truth(spark, sf_dir), pan, spark.createDataFrame([(2,)], "k bigint"))


@query("""
, m as (select distinct model, z_threshold from flags)
select a.model || '+' || b.model as panel, u.model from m a join m b on b.model > a.model join m u on u.model in (a.model, b.model) where 2.0 in (a.z_threshold, b.z_threshold) and 3.0 in (a.z_threshold, b.z_threshold)""")
def panel_pairs(spark, sf_dir):
    models = spark.createDataFrame([("z2.0", 2.0), ("z2.5", 2.5), ("z3.0", 3.0)], "model string, z_threshold double")
    return sweeps.panels(models, 2, (2.0, 3.0))


@query("""
, d as (select distinct ((o_orderkey * 7) // 3)::bigint as run from orders where o_orderkey is not null), i as (select run, run - row_number() over (order by run) as g from d)
select min(run) as first_run, max(run) as last_run, count(*) as n from i group by g""")
def run_islands(spark, sf_dir):
    """Blocks of neighbouring numbers made from order keys."""
    return sweeps.run_islands(adapt.table(spark, sf_dir, "orders").select(F.expr("(o_orderkey * 7) div 3").alias("run")))


@query("""
, p as (select p_brand as z_threshold, p_partkey as model, p_retailprice as fp_percent, row_number() over (partition by p_brand order by p_retailprice nulls last, p_partkey) as rank from part)
select z_threshold, model, fp_percent, rank::int as rank from p where rank <= 3""")
def topn_per_group(spark, sf_dir):
    p = adapt.table(spark, sf_dir, "part")
    return sweeps.best_per_threshold(p.select(F.col("p_brand").alias("z_threshold"), F.col("p_partkey").alias("model"), F.col("p_retailprice").alias("fp_percent")), 3)


@query("""
, g as (select c_nationkey, c_mktsegment, count(*) as n_total from customer group by 1, 2), m as (select *, max(n_total) over (partition by c_nationkey) as most from g)
select * from m where n_total < most""")
def partial_eval_audit(spark, sf_dir):
    g = adapt.table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n_total"))
    return sweeps.partial_evaluations(g, ["c_nationkey"])


@query("""
, w as (select n_nationkey, s from nation cross join (values (1), (2), (3)) t(s))
select n_nationkey, s from w where (n_nationkey + s) % 4 <> 0""")
def sweep_to_do(spark, sf_dir):
    wanted = adapt.table(spark, sf_dir, "nation").select("n_nationkey").join(sweeps.grid(spark, s=[1, 2, 3]).select(F.col("s").cast("int").alias("s")))
    return sweeps.still_to_do(wanted, wanted.where("(n_nationkey + s) % 4 = 0"))


@query(_votes + """select panel, run, count(*) as n_scored, round(100.0 * count(*) filter (bad < 2) / count(*), 6) as ok_percent from f group by panel, run""")
def vote_run_rates(spark, sf_dir):
    v, pan = _votes_of(spark, sf_dir)
    return sweeps.vote_run_rates(v, _truth(spark, sf_dir), pan, 2)


@query("""
, m as (select p_partkey as model, (p_size % 4 + 5)::double as z_threshold, p_retailprice as fp_percent from part),
k as (select *, case z_threshold when 6 then 0 when 8 then 1 else 2 end as part from m where fp_percent is not null),
r as (select *, row_number() over (partition by part order by fp_percent, model) as r from k),
c as (select *, row_number() over (order by part, fp_percent, model) as place from r where r <= case when part = 2 then 100 else 50 end)
select model, z_threshold, fp_percent from c where place <= 100""")
def panel_candidates(spark, sf_dir):
    p = adapt.table(spark, sf_dir, "part")
    m = p.select(F.col("p_partkey").alias("model"), (F.col("p_size") % 4 + 5).cast("double").alias("z_threshold"), F.col("p_retailprice").alias("fp_percent"))
    return sweeps.panel_candidates(m, 100, both=(6.0, 8.0))


@query("""
, q as (select *, loose or medium or tight as good, (loose or medium or tight) and run between 1993 and 1996 as ranged from cat)
select count(*) as total, count(*) filter (good) as after_quality, count(distinct run) filter (good) as quality_runs, count(*) filter (ranged) as after_range, count(distinct run) filter (ranged) as range_runs,
greatest(1, round_even(count(*) filter (ranged) * 0.3, 0))::bigint as after_fraction from q""")
def catalogue_stages(spark, sf_dir):
    return cat.stage_counts(adapt.catalogue(adapt.hits(spark, sf_dir)), "All", 0.3, 1993, 1996)


@query("""
, k as (select case when tight then 'tight' else 'other' end as tag, run from cat)
select tag, count(*) as n_entries, count(distinct run) as n_runs from k group by tag""")
def catalogue_tags(spark, sf_dir):
    return cat.tag_counts(adapt.catalogue(adapt.hits(spark, sf_dir)).withColumn("tag", F.when(F.col("tight"), "tight").otherwise("other")))


@query("""
, f as (select distinct run, subrun from hits), e(run, subrun) as (values (1993, -1), (1994, 5), (1994, 77), (1996, -1), (1996, 3), (2050, -1))
select run, subrun from e where (subrun <> -1 and not exists (select 1 from f where f.run = e.run and f.subrun = e.subrun)) or (subrun = -1 and not exists (select 1 from f where f.run = e.run))""")
def catalogue_misses(spark, sf_dir):
    entries = spark.createDataFrame([(1993, -1), (1994, 5), (1994, 77), (1996, -1), (1996, 3), (2050, -1)], "run int, subrun int")
    return cat.unmatched(entries, adapt.hits(spark, sf_dir))


@query("""
, f as (select run, subrun, count(*) as n, count(*) filter (anomalous) as bad from log group by run, subrun)
select sum(n)::bigint as n_rows, count(*) as n_files, count(distinct run) as n_runs, sum(bad)::bigint as n_anomalous, count(*) filter (bad > 0) as n_bad_files from f""")
def log_counts(spark, sf_dir):
    return report.log_counts(adapt.log(spark, sf_dir))


@query("select run, subrun, status from status where run in (select o_custkey % 4 + 1992 from orders)")
def training_runs(spark, sf_dir):
    """Files of the runs of a training list."""
    runs = adapt.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4 + 1992).cast("int").alias("run"))
    return cat.in_runs(adapt.status(spark, sf_dir), runs).select("run", "subrun", "status")


@query("""
, c(run, p1, p2, p3, p4, p5, trig) as (values (1994, 1, 2, 0, 5, 10, 31), (1995, 1, 2, 4, 5, 10, 29), (1996, null, null, null, null, null, 31))
""" + " union all ".join(f"select b.run, b.subrun, {i} as bit, b{i} as raw, round(case when ((c.trig >> {i - 1}) & 1) = 0 then null when c.run is null then b{i} when c.p{i} > 0 then b{i} / c.p{i} end, 6) as normalised, c.p{i}::double as prescale from board b left join c using (run)" for i in range(1, 6)))
def rates_before_and_after(spark, sf_dir):
    return feat.rates_before_and_after(adapt.board(spark, sf_dir), adapt.configs(spark))


@query("""
, k as (select s_suppkey as channel, max_z, row_number() over (partition by s_suppkey) as r from supplier join (select channel, max(max_z) as max_z from log group by channel) l on l.channel = s_suppkey)
select s_suppkey as channel, s_nationkey as layer, s_nationkey % 4 as row, 0 as "column", round(coalesce(max_z, 0), 6) as max_z, round(s_nationkey % 4 + case when s_suppkey % 2 = 0 then 0.2::double else -0.2::double end, 6) as y
from supplier join k on channel = s_suppkey""")
def geometry_map(spark, sf_dir):
    """The place of each supplier that has a channel's number, with the largest z of that channel."""
    s = adapt.table(spark, sf_dir, "supplier")
    places = s.select(F.col("s_suppkey").alias("channel"), F.lit(1).alias("event_id"), F.col("s_nationkey").alias("layer"), (F.col("s_nationkey") % 4).alias("row"), F.lit(0).alias("column"))
    return report.geometry_map(places, adapt.log(spark, sf_dir).groupBy("channel").agg(F.max("max_z").alias("max_z")))


@query("""
, k(run, category, cause) as (values (1993, 'hv', 'trip'), (1993, 'daq', 'crash'), (2050, 'cal', null)),
s as (select run, count(distinct subrun) as n_subruns, count(*) filter (anomalous) as n_anomalous from log group by run)
select k.run, category, cause, coalesce(n_subruns, 0) as n_subruns, coalesce(n_anomalous, 0) as n_anomalous from k left join s using (run)""")
def annotated_cases(spark, sf_dir):
    """A knowledge base's cases with the history of their runs."""
    cases = spark.createDataFrame([(1993, "hv", "trip"), (1993, "daq", "crash"), (2050, "cal", None)], "run int, category string, cause string")
    return report.annotated(cases, adapt.log(spark, sf_dir)).select("run", "category", "cause", "n_subruns", "n_anomalous")


# ---- curves and profiles of sweeps

_tiers = """
, tier(tier) as (values ('loose'), ('medium'), ('tight')),
f as (select model || '_' || tier as model, z_threshold, tier, run, subrun, loose + medium + tight = 0 as alert, case tier when 'loose' then loose when 'medium' then medium else tight end = 1 as ok from flags cross join tier),
metrics as (
  select model, z_threshold, tier, 100.0 * count(*) filter (alert and good) / nullif(count(*) filter (good), 0) as fp_percent, 100.0 * count(*) filter (ok) / count(*) as ok_percent
  from f left join truth using (run, subrun) group by model, z_threshold, tier)
"""


def _tier_metrics(spark, sf_dir):
    """(metrics of each model and tier, rates of their runs)."""
    flags, truth = storage.written(_flags(spark, sf_dir), "flags"), _truth(spark, sf_dir)
    out = []
    for by in ((), ("run",)):
        parts = [sweeps.model_metrics(flags, truth, t, ("z_threshold", *by)).withColumn("tier", F.lit(t)) for t in ("loose", "medium", "tight")]
        out.append(parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("model", F.concat_ws("_", "model", "tier")))
    return out


@query(_tiers + """
, long as (select model, z_threshold, tier, 'fp_percent' as metric, fp_percent as y from metrics where fp_percent is not null union all select model, z_threshold, tier, 'ok_percent', ok_percent from metrics),
g as (select case when grouping(z_threshold) = 0 then 'z_threshold' when grouping(tier) = 0 then 'tier' end as parameter, case when grouping(z_threshold) = 0 then z_threshold::varchar when grouping(tier) = 0 then tier end as value, metric,
             count(*) as n, avg(y) as mean, min((y, model)) as low, min((-y, model)) as high from long group by grouping sets ((metric, z_threshold), (metric, tier), (metric)))
select parameter, value, metric, n, round(mean, 6) as mean, round(low[1], 6) as lowest, low[2] as lowest_model, round(-high[1], 6) as highest, high[2] as highest_model from g""")
def sweep_marginals(spark, sf_dir):
    return sweeps.marginals(_tier_metrics(spark, sf_dir)[0], ["z_threshold", "tier"], ["fp_percent", "ok_percent"])


@query(_tiers + """

select model, count(*) as n, count(*) filter (good) as n_known_good, count(*) filter (good and loose + medium + tight = 0) as fp, round(100.0 * count(*) filter (good and loose + medium + tight = 0) / count(*) filter (good), 6) as fp_percent
from (select * from flags where model <> 'z2.5' or subrun = 2) left join truth using (run, subrun) group by model having count(*) filter (good) > 0""")
def flat_metrics(spark, sf_dir):
    """Rates of the models that have known-good files; one model scored only files without ground truth."""
    flags = _flags(spark, sf_dir).where("model <> 'z2.5' or subrun = 2")
    return sweeps.flat_metrics(flags, _truth(spark, sf_dir)).select("model", "n", "n_known_good", "fp", "fp_percent")


@query(_tiers + """
select tier, z_threshold, 'fp_percent' as metric, round(fp_percent, 6) as y from metrics where tier <> 'loose' and fp_percent is not null
union all select tier, z_threshold, 'ok_percent', round(ok_percent, 6) from metrics where tier <> 'loose'""")
def sweep_curves(spark, sf_dir):
    return sweeps.curves(_tier_metrics(spark, sf_dir)[0].where("tier <> 'loose'"), "z_threshold", ["tier"], ["fp_percent", "ok_percent"])


@query(_tiers + """
, rates as (select model, run, 100.0 * count(*) filter (ok) / count(*) as ok_percent from f group by model, run),
means as (select model, avg(ok_percent) as value from rates group by model),
fp as (select model, z_threshold, fp_percent as value from metrics where fp_percent is not null),
ranked as (
  select 'fp' as best, model, value, row_number() over (order by value, model) as rank, 4 as most from fp
  union all select 'fp_z' || z_threshold, model, value, row_number() over (partition by z_threshold order by value, model), 2 from fp
  union all select 'coverage', model, value, row_number() over (order by value desc, model), 4 from means)
select best, rank::int as rank, model, round(value, 6) as value, run, round(ok_percent, 6) as ok_percent from ranked join rates using (model) where rank <= most""")
def best_profiles(spark, sf_dir):
    metrics, rates = _tier_metrics(spark, sf_dir)
    return sweeps.best_profiles(metrics, rates, 4, 2)


# ---- forest, sampling, streaming

_fixed = [(*n, 256) for n in [(0, 0, 0, 25.0, 1, 2, 0.0), (0, 1, -1, 0.0, -1, -1, 2.0), (0, 2, 1, 40.0, 3, 4, 0.0), (0, 3, -1, 0.0, -1, -1, 3.0), (0, 4, -1, 0.0, -1, -1, 4.0), (1, 0, 1, 38.0, 1, 2, 0.0), (1, 1, -1, 0.0, -1, -1, 1.5), (1, 2, -1, 0.0, -1, -1, 5.0)]]


@query("""
, h as (select run, subrun, channel, ((case when coalesce(quantity_mean, 0) <= 25 then 2.0 when coalesce(price_mean, 0) <= 40 then 3.0 else 4.0 end) + (case when coalesce(price_mean, 0) <= 38 then 1.5 else 5.0 end)) / 2 as d from features)
select run, subrun, channel, round(-power(2, -d / (2 * (ln(255) + 0.5772156649015329) - 2 * 255 / 256.0::double)), 6) as if_score from h""")
def fixed_forest_score(spark, sf_dir):
    """Scores by a small literal forest."""
    nodes = spark.createDataFrame(_fixed, forest.NODES)
    f = adapt.features(spark, sf_dir, ["quantity_mean", "price_mean"])
    return forest.score_forest(f, ["quantity_mean", "price_mean"], nodes).select("run", "subrun", "channel", "if_score")


@query("select round(quantile_cont(quantity_mean, 0.01), 6) as offset_value from features")
def percentile_offset(spark, sf_dir):
    return forest.offset_table(adapt.features(spark, sf_dir, ["quantity_mean"]), 0.01, "quantity_mean").withColumnRenamed("offset", "offset_value")


@query()
def forest_scores(spark, sf_dir):
    """A forest of the good files' z-scores, scores and flags of all files."""
    z = storage.written(adapt.zscores(spark, sf_dir), "zscores")
    sample = forest.training_sample(adapt.good(z), C, steps.KEY)
    nodes = storage.written(forest.fit_forest(sample, C, steps.KEY, n_trees=100), "forest")
    offset = forest.contamination_offset(forest.score_forest(sample, C, nodes), 0.05)
    return forest.flag_forest(forest.score_forest(z, C, nodes), offset).select("run", "subrun", "channel", "if_score", "if_flag")


@query()
def seeded_sample(spark, sf_dir):
    """A fifth of the files, the same for the same seed."""
    files = adapt.hits(spark, sf_dir).select("run", "subrun").distinct()
    return sampling.fraction_sample(files, 0.2, ["run", "subrun"])


@query(f"""
, i as (select *, (row_number() over (partition by run order by subrun) - 1)::int as file_index from status),
d as (select *, case when n_persistent >= {adapt.LEAST} or n_anomalous >= {adapt.BULK} or worst_z >= {adapt.EXTREME} then 'drop' when file_index < {adapt.N - 1} and n_anomalous > 0 then 'hold' else 'list' end as decision from i)
select run, subrun, file_index, n_anomalous::int as n_anomalous, n_persistent::int as n_persistent, decision from d""")
def stream_persistence(spark, sf_dir):
    """The log as a stream of files in two batches, judged by keyed state; equals the batch status."""
    folder = f"{storage.scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    log = storage.written(adapt.log(spark, sf_dir).select("run", "subrun", F.col("channel").cast("string").alias("channel"), "anomalous", "max_z"), "log")
    for part in ("subrun <= 6", "subrun > 6"):  # a file's rows stay together; older files come first
        log.where(part).repartition(4, "run").write.mode("append").parquet(f"{folder}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/log")
    monitor.run_to_end(monitor.live_status(stream, adapt.N, adapt.LEAST, adapt.BULK, adapt.EXTREME), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").drop("status", "released")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalous channels of all files, worst first."""
    return adapt.log(spark, sf_dir).where("anomalous").orderBy(F.desc_nulls_last("max_z"), "run", "subrun", "channel")
