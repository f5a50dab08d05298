"""Job, queue, page, history and event queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire import engine
from quire.adapters import EVENTS_SQL, JOB_PAGES_SQL, JOBS_SQL, job_events, job_pages, jobs, table
from quire.functions import scalars as fn
from quire.operators import lines, queue
from quire.plans.registry import query

J, P, E = JOBS_SQL, JOB_PAGES_SQL, EVENTS_SQL


@query("src02_validation", f"WITH {J}, v AS (SELECT job_id, CASE WHEN job_id % 17 = 0 THEN 'missing' WHEN job_id % 19 = 0 THEN 'directory' WHEN NOT ends_with(lower(input_path), '.pdf') THEN 'not a pdf' END AS reason FROM jb) SELECT job_id, CASE WHEN reason IS NOT NULL THEN 'validation' END AS kind, reason FROM v")
def _(spark, d):
    j = jobs(spark, d)
    reason = F.when(F.col("job_id") % 17 == 0, "missing").when(F.col("job_id") % 19 == 0, "directory").when(~fn.is_pdf(F.col("input_path")), "not a pdf")
    return j.withColumn("reason", reason).select("job_id", F.when(F.col("reason").isNotNull(), "validation").alias("kind"), "reason")


@query("src03_metadata", f"WITH {J} SELECT job_id, regexp_extract(input_path, '([^/]*)$', 1) AS name, finished_at - started_at AS size FROM jb")
def _(spark, d):
    return jobs(spark, d).select("job_id", fn.base_name(F.col("input_path")).alias("name"), (F.col("finished_at") - F.col("started_at")).alias("size"))


@query("src05_encryption", f"WITH {E} SELECT event_id, regexp_matches(lower(message), 'encrypt|password') AS encrypted FROM ev WHERE message IS NOT NULL")
def _(spark, d):
    return job_events(spark, d).filter("message IS NOT NULL").select("event_id", fn.names_encryption(F.col("message")).alias("encrypted"))


@query("src07_pages", f"WITH {P} SELECT job_id, page_number FROM jp")
def _(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").cast("int").alias("n"))
    return n.select("job_id", F.explode(F.sequence(F.lit(1), "n")).alias("page_number"))


@query("src15_language_packs", "WITH r AS (SELECT DISTINCT c_mktsegment AS lang FROM customer UNION SELECT 'XX'), h AS (SELECT DISTINCT c_mktsegment AS lang FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment < 'H') SELECT lang, CASE WHEN h.lang IS NULL THEN 'missing' ELSE 'skipped' END AS state FROM r LEFT JOIN h USING (lang)")
def _(spark, d):
    c = table(spark, d, "customer")
    wanted = c.select(F.col("c_mktsegment").alias("lang")).union(spark.createDataFrame([("XX",)], "lang string")).distinct()
    have = c.filter("c_custkey % 2 = 0 AND c_mktsegment < 'H'").select(F.col("c_mktsegment").alias("lang"), F.lit(True).alias("have")).distinct()
    return wanted.join(have, "lang", "left").select("lang", F.when(F.col("have"), "skipped").otherwise("missing").alias("state"))


@query("src16_first_candidate", "SELECT s_nationkey AS nation, arg_min(s_name, s_suppkey) AS library FROM supplier WHERE s_acctbal > 0 GROUP BY s_nationkey")
def _(spark, d):
    return table(spark, d, "supplier").filter("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.min_by("s_name", "s_suppkey").alias("library"))


@query("snk01_output_names", f"""WITH {J}, n AS (SELECT job_id, regexp_replace(regexp_extract(input_path, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') AS stem FROM jb),
r AS (SELECT job_id, stem, row_number() OVER (PARTITION BY stem ORDER BY job_id) - 1 AS nth FROM n),
f AS (SELECT *, CASE WHEN CAST(substr(stem, 5) AS BIGINT) % 3 = 0 THEN nth + 1 ELSE nth END AS k FROM r)
SELECT job_id, concat(stem, '_cleaned', CASE WHEN k > 0 THEN concat('_', k) ELSE '' END, '.pdf') AS output_name FROM f""")
def _(spark, d):
    j = jobs(spark, d).withColumn("stem", fn.stem(F.col("input_path")))
    taken = table(spark, d, "orders").filter("o_custkey % 3 = 0").select(F.concat(F.lit("scan"), "o_custkey", F.lit("_cleaned.pdf")).alias("output_name"))
    return queue.output_names(j, "stem", "job_id", taken).select("job_id", "output_name")


@query("snk07_codec", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 > 0 THEN 'CCITTFaxDecode' ELSE 'FlateDecode' END END AS codec FROM part")
def _(spark, d):
    bitonal = F.when(F.col("p_size") % 3 > 0, F.lit("bits"))
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.when(bitonal.isNotNull(), "CCITTFaxDecode").otherwise("FlateDecode")).alias("codec"))


@query("jn01_replacements", f"WITH {P}, r AS (SELECT job_id, page_number, page_ms AS bytes FROM jp WHERE message IS NULL AND NOT has_text) SELECT jp.job_id, jp.page_number, r.bytes FROM jp LEFT JOIN r USING (job_id, page_number)")
def _(spark, d):
    p = job_pages(spark, d)
    r = p.filter("message IS NULL AND NOT has_text").select("job_id", "page_number", F.col("page_ms").alias("bytes"))
    return p.select("job_id", "page_number").join(r, ["job_id", "page_number"], "left")


@query("jn02_text_layers", f"WITH {P}, l AS (SELECT job_id, page_number + 1 AS page_number, page_ms AS words FROM jp WHERE page_ms > 25) SELECT job_id, page_number, words FROM jp JOIN l USING (job_id, page_number)")
def _(spark, d):
    p = job_pages(spark, d)
    layers = p.filter("page_ms > 25").select("job_id", (F.col("page_number") + 1).alias("page_number"), F.col("page_ms").alias("words"))
    return p.select("job_id", "page_number").join(layers, ["job_id", "page_number"])


@query("flt01_existing_text", f"WITH {P} SELECT job_id, page_number FROM jp WHERE NOT (job_id % 2 = 0 AND has_text)")
def _(spark, d):
    mode = F.when(F.col("job_id") % 2 == 0, "skip").otherwise("rasterize")
    return job_pages(spark, d).filter(~((mode == "skip") & F.coalesce("has_text", F.lit(False)))).select("job_id", "page_number")


@query("flt07_pending", f"WITH {J} SELECT job_id FROM jb WHERE status = 'queued' AND job_id % 3 <> 0")
def _(spark, d):
    return jobs(spark, d).withColumn("queued", F.col("job_id") % 3 == 0).filter((queue.status_label(F.col("status")) == "pending") & ~F.col("queued")).select("job_id")


@query("flt08_removable", f"WITH {J} SELECT job_id, status IN ('queued', 'cancelled') AS removable FROM jb")
def _(spark, d):
    return jobs(spark, d).select("job_id", F.col("status").isin("queued", "cancelled").alias("removable"))


@query("flt09_needs_password", f"WITH {J}, e AS (SELECT DISTINCT input_path FROM jb WHERE job_id % 4 = 0), p AS (SELECT DISTINCT input_path FROM jb WHERE job_id % 12 = 0) SELECT job_id FROM jb WHERE input_path IN (SELECT input_path FROM e) AND input_path NOT IN (SELECT input_path FROM p)")
def _(spark, d):
    j = jobs(spark, d)
    encrypted, cached = (j.filter(f"job_id % {n} = 0").select("input_path").distinct() for n in (4, 12))
    return j.join(encrypted, "input_path", "left_semi").join(cached, "input_path", "left_anti").select("job_id")


@query("flt11_error_class", f"WITH {E} SELECT event_id, CASE WHEN message IS NULL THEN NULL WHEN regexp_matches(lower(message), 'encrypt|password') THEN 'encrypted' ELSE 'pipeline' END AS kind FROM ev")
def _(spark, d):
    return job_events(spark, d).select("event_id", queue.error_kind(F.col("message")).alias("kind"))


@query("flt12_stale_rows", f"WITH {J} SELECT job_id FROM jb WHERE job_id % 3 <> 0 OR status <> 'completed'")
def _(spark, d):
    j = jobs(spark, d).withColumn("queued", F.col("job_id") % 3 == 0)
    snapshot = j.filter("status <> 'completed'").select("job_id")
    return j.filter("NOT queued").select("job_id").union(j.filter("queued").join(snapshot, "job_id", "left_semi").select("job_id"))


@query("prj01_options", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'pdfa' ELSE 'pdf' END AS output_type, CAST(p_size * 10 AS BIGINT) AS resolution_dpi, concat_ws('+', 'eng', CASE WHEN p_size > 25 THEN 'spa' END) AS languages, p_size AS memory_pages FROM part")
def _(spark, d):
    p = table(spark, d, "part").withColumns({"archive": F.col("p_size") % 2 == 0, "resolution": (F.col("p_size") * 10).cast("string"), "langs": F.filter(F.array(F.lit("eng"), F.when(F.col("p_size") > 25, "spa")), lambda x: x.isNotNull())})
    return p.select("p_partkey", F.when(F.col("archive"), "pdfa").otherwise("pdf").alias("output_type"), F.col("resolution").cast("long").alias("resolution_dpi"), F.array_join("langs", "+").alias("languages"), F.col("p_size").alias("memory_pages"))


@query("prj02_config", "WITH c AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size END AS a, p_size + 100 AS b, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'deu' END AS x, CASE WHEN p_size % 5 > 0 THEN 'fra' END AS y FROM part) SELECT p_partkey, coalesce(a, b) AS max_concurrent, coalesce(nullif(x, ''), y, 'eng') AS languages FROM c")
def _(spark, d):
    s = F.col("p_size")
    x, y = F.when(s % 4 == 0, "").when(s % 4 == 1, "deu"), F.when(s % 5 > 0, "fra")
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.when(s % 3 == 0, s), s + 100).alias("max_concurrent"), F.coalesce(F.nullif(x, F.lit("")), y, F.lit("eng")).alias("languages"))


@query("prj03_settings", "SELECT p_partkey, ['otsu','bradley-roth','fixed'][p_size % 3 + 1] AS binarization, 128 AS fixed_threshold, CASE WHEN p_size % 2 = 0 THEN 'radon' ELSE 'disabled' END AS deskew_mode, p_size % 5 AS denoise_level FROM part")
def _(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.element_at(F.lit(["otsu", "bradley-roth", "fixed"]), s % 3 + 1).alias("binarization"), F.lit(128).alias("fixed_threshold"), F.when(s % 2 == 0, "radon").otherwise("disabled").alias("deskew_mode"), (s % 5).alias("denoise_level"))


@query("prj04_password_strip", "SELECT c_custkey, to_json({'path': c_name, 'languages': CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'deu' END, 'memory_pages': c_nationkey}) AS stored, c_custkey % 2 = 0 AS had_password FROM customer")
def _(spark, d):
    """What is stored of a job's options: all but the password, which some jobs have."""
    c = table(spark, d, "customer")
    password = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("password")
    options = F.struct(F.col("c_name").alias("path"), F.when(F.col("c_custkey") % 3 > 0, "deu").alias("languages"), password, F.col("c_nationkey").alias("memory_pages"))
    o = c.select("c_custkey", options.alias("o"))
    return o.select("c_custkey", F.to_json(F.col("o").dropFields("password"), {"ignoreNullFields": "false"}).alias("stored"), F.col("o.password").isNotNull().alias("had_password"))


@query("prj12_error_kind", f"""WITH {E}, k AS (SELECT event_id, message, CASE WHEN regexp_matches(lower(message), 'password|encrypt') THEN 'encrypted' WHEN event_id % 5 = 0 THEN 'io' ELSE 'parse' END AS kind FROM ev WHERE message IS NOT NULL)
SELECT event_id, concat(CASE kind WHEN 'encrypted' THEN 'Encrypted PDF: ' WHEN 'io' THEN 'I/O error: no such file: ' ELSE 'PDF parse error: ' END, message) AS told FROM k""")
def _(spark, d):
    e = job_events(spark, d).filter("message IS NOT NULL")
    locked = F.lower("message").rlike("password|encrypt")
    reason = F.when(~locked & (F.col("event_id") % 5 == 0), F.concat(F.lit("no such file: "), "message")).otherwise(F.col("message"))
    return e.select("event_id", engine.failure(reason).alias("told"))


@query("prj05_status", f"WITH {J} SELECT job_id, CASE status WHEN 'running' THEN 'processing' WHEN 'completed' THEN 'complete' WHEN 'failed' THEN 'error' WHEN 'cancelled' THEN 'paused' ELSE 'pending' END AS label FROM jb")
def _(spark, d):
    return jobs(spark, d).select("job_id", queue.status_label(F.col("status")).alias("label"))


@query("prj06_psm", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 4 ELSE 11 END AS psm FROM part")
def _(spark, d):
    name = F.element_at(F.lit(["auto", "block", "column", "sparse"]), F.col("p_size") % 4 + 1)
    return table(spark, d, "part").select("p_partkey", F.create_map(*[F.lit(x) for x in ("auto", 3, "block", 6, "column", 4, "sparse", 11)])[name].alias("psm"))


@query("prj07_profile", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'balanced' WHEN 1 THEN 'max-compression' WHEN 2 THEN 'high-fidelity' ELSE 'custom' END AS profile FROM part")
def _(spark, d):
    built_in = queue.profiles(spark)  # three rows
    fields = [c for c in built_in.columns if c not in ("name", "ord")]
    settings = F.struct(*fields)
    pick = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 4).alias("kind"))
    chosen = pick.join(F.broadcast(built_in.withColumnRenamed("ord", "kind").drop("name")), "kind", "left").withColumn("fixed_threshold", F.coalesce("fixed_threshold", F.lit(1)))
    match = chosen.select("p_partkey", settings.alias("mine")).join(F.broadcast(built_in.select("name", "ord", settings.alias("theirs"))), F.col("mine") == F.col("theirs"), "left")
    return match.groupBy("p_partkey").agg(F.coalesce(F.min_by("name", "ord"), F.lit("custom")).alias("profile"))


@query("prj08_section_reset", "SELECT p_partkey, 2 AS denoise_level, 'otsu' AS binarization, p_size AS memory_pages FROM part")
def _(spark, d):
    balanced = dict(zip([f.split()[0] for f in queue.PROFILE_FIELDS.split(", ")], queue.PROFILES[0], strict=True))
    mine = table(spark, d, "part").select("p_partkey", F.lit(9).alias("denoise_level"), F.lit("fixed").alias("binarization"), F.col("p_size").alias("memory_pages"))
    return mine.withColumns({c: F.lit(balanced[c]) for c in ("denoise_level", "binarization")})


@query("prj09_outcome", f"WITH {E} SELECT event_id, CASE WHEN job_id % 10 = 0 THEN 'cancelled' WHEN status = 'completed' THEN 'completed' ELSE 'failed' END AS outcome, CASE WHEN job_id % 10 <> 0 AND status = 'completed' THEN 100 ELSE current_page END AS percent, CASE WHEN job_id % 10 <> 0 THEN message END AS message FROM ev WHERE status IN ('completed', 'failed')")
def _(spark, d):
    e, cancelled, done = job_events(spark, d).filter("status IN ('completed', 'failed')"), F.col("job_id") % 10 == 0, F.col("status") == "completed"
    return e.select("event_id", F.when(cancelled, "cancelled").when(done, "completed").otherwise("failed").alias("outcome"), F.when(~cancelled & done, 100).otherwise(F.col("current_page")).alias("percent"), F.when(~cancelled, F.col("message")).alias("message"))


@query("prj10_concurrency", "SELECT p_partkey, coalesce(greatest(CASE WHEN p_size % 3 = 0 THEN p_size - 5 END, CASE WHEN p_size % 3 = 0 THEN 1 END), greatest(p_size // 2, 1)) AS files, least(greatest(p_size // 2, 1), 4) AS jobs FROM part")
def _(spark, d):
    s = F.col("p_size")
    half = F.greatest(F.floor(s / 2).cast("int"), F.lit(1))
    return table(spark, d, "part").select("p_partkey", F.when(s % 3 == 0, F.greatest(s - 5, F.lit(1))).otherwise(half).alias("files"), F.least(half, F.lit(4)).alias("jobs"))


@query("prj13_start_gate", "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'no files' WHEN c_nationkey = 1 THEN 'no output dir' WHEN c_acctbal < 0 THEN 'nothing pending' WHEN c_custkey % 7 = 0 THEN 'needs password' ELSE 'run' END AS gate FROM customer")
def _(spark, d):
    gate = F.when(F.col("c_nationkey") == 0, "no files").when(F.col("c_nationkey") == 1, "no output dir").when(F.col("c_acctbal") < 0, "nothing pending").when(F.col("c_custkey") % 7 == 0, "needs password").otherwise("run")
    return table(spark, d, "customer").select("c_custkey", gate.alias("gate"))


@query("jn03_relink", f"WITH {J}, a AS (SELECT job_id, input_path, row_number() OVER (PARTITION BY input_path ORDER BY job_id) AS n FROM jb), b AS (SELECT job_id * 10 AS row_id, input_path, row_number() OVER (PARTITION BY input_path ORDER BY job_id) AS n FROM jb WHERE status <> 'completed') SELECT row_id, a.job_id FROM b LEFT JOIN a USING (input_path, n)")
def _(spark, d):
    j = jobs(spark, d)
    nth = F.row_number().over(Window.partitionBy("input_path").orderBy("job_id"))
    mine = j.filter("status <> 'completed'").select((F.col("job_id") * 10).alias("row_id"), "input_path", nth.alias("n"))
    return mine.join(j.select("job_id", "input_path", nth.alias("n")), ["input_path", "n"], "left").select("row_id", "job_id")


@query("jn04_events_to_rows", f"WITH {J}, {E} SELECT event_id, jb.job_id, input_path FROM ev JOIN jb ON ev.job_id = jb.job_id")
def _(spark, d):
    return job_events(spark, d).select("event_id", "job_id").join(jobs(spark, d).select("job_id", "input_path"), "job_id")


@query("jn05_snapshot", f"WITH {J}, s AS (SELECT job_id, status FROM jb WHERE job_id % 2 = 0) SELECT jb.job_id, s.status AS backend_status, s.job_id IS NOT NULL AS known FROM jb LEFT JOIN s ON jb.job_id = s.job_id")
def _(spark, d):
    j = jobs(spark, d)
    s = j.filter("job_id % 2 = 0").select("job_id", F.col("status").alias("backend_status"), F.lit(True).alias("known"))
    return j.select("job_id").join(s, "job_id", "left").select("job_id", "backend_status", F.coalesce("known", F.lit(False)).alias("known"))


@query("jn06_passwords", f"WITH {J}, p AS (SELECT input_path, max(job_id) AS secret FROM jb WHERE job_id % 9 = 0 GROUP BY input_path) SELECT job_id, secret IS NOT NULL AS has_password FROM jb LEFT JOIN p USING (input_path)")
def _(spark, d):
    j = jobs(spark, d)
    p = j.filter("job_id % 9 = 0").groupBy("input_path").agg(F.max("job_id").alias("secret"))
    return j.join(p, "input_path", "left").select("job_id", F.col("secret").isNotNull().alias("has_password"))


@query("jn07_catalogue", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def _(spark, d):
    known = table(spark, d, "nation").filter("n_nationkey < 20")
    return table(spark, d, "customer").join(known, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("ag01_counters", f"WITH {P} SELECT job_id, count(*) AS pages, CAST(sum(page_ms) AS BIGINT) AS total_ms FROM jp GROUP BY job_id")
def _(spark, d):
    return job_pages(spark, d).groupBy("job_id").agg(F.count("*").alias("pages"), F.sum("page_ms").alias("total_ms"))


@query("ag02_average_ms", f"WITH {P}, c AS (SELECT job_id, page_ms, sum(page_ms) OVER (PARTITION BY job_id ORDER BY page_number) AS cum FROM jp) SELECT job_id, CAST(sum(cum) // count(*) AS BIGINT) AS cumulative_mean, CAST(sum(page_ms) // count(*) AS BIGINT) AS mean FROM c GROUP BY job_id")
def _(spark, d):
    cum = F.sum("page_ms").over(Window.partitionBy("job_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0))
    p = job_pages(spark, d).withColumn("cum", cum)
    return p.groupBy("job_id").agg(F.expr("sum(cum) div count(*)").alias("cumulative_mean"), F.expr("sum(page_ms) div count(*)").alias("mean"))


@query("ag03_percent", f"WITH {P} SELECT job_id, page_number, CAST(floor(CAST(100 AS DOUBLE) * page_number / count(*) OVER (PARTITION BY job_id) + 0.5) AS BIGINT) AS percent FROM jp")
def _(spark, d):
    total = F.count("*").over(Window.partitionBy("job_id"))
    return job_pages(spark, d).select("job_id", "page_number", queue.percent(F.col("page_number"), total).alias("percent"))


@query("ag04_status_counts", f"WITH {J} SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running FROM jb")
def _(spark, d):
    return jobs(spark, d).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("completed", "queued", "running")))


@query("ag05_page_errors", f"WITH {P} SELECT job_id, count(message) AS errors, CASE WHEN count(message) = 0 THEN NULL WHEN job_id % 2 = 1 THEN concat('page ', min(CASE WHEN message IS NOT NULL THEN page_number END), ': ', arg_min(message, CASE WHEN message IS NOT NULL THEN page_number END)) WHEN count(message) = count(*) THEN concat('all ', count(*), ' pages failed') END AS failure FROM jp GROUP BY job_id")
def _(spark, d):
    bad = F.when(F.col("message").isNotNull(), F.col("page_number"))
    p = job_pages(spark, d).groupBy("job_id").agg(F.count("message").alias("errors"), F.count("*").alias("n"), F.min(bad).alias("page"), F.min_by("message", bad).alias("first"))
    failure = F.when(F.col("errors") == 0, None).when(F.col("job_id") % 2 == 1, F.concat(F.lit("page "), "page", F.lit(": "), "first")).when(F.col("errors") == F.col("n"), F.concat(F.lit("all "), "n", F.lit(" pages failed")))
    return p.select("job_id", "errors", failure.alias("failure"))


@query("ag09_languages", "SELECT source, string_agg(DISTINCT lang, '+' ORDER BY lang) AS languages FROM documents GROUP BY source")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), "+").alias("languages"))


@query("ag10_same_password", f"WITH {J} SELECT priority, count(DISTINCT CASE WHEN job_id % 3 = 0 THEN input_path ELSE '' END) <= 1 AS same FROM jb GROUP BY priority")
def _(spark, d):
    return jobs(spark, d).groupBy("priority").agg((F.count_distinct(F.coalesce(F.when(F.col("job_id") % 3 == 0, F.col("input_path")), F.lit(""))) <= 1).alias("same"))


@query("ag11_pack_groups", "SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_name) FILTER (n_nationkey % 3 = 0) AS downloaded, string_agg(n_name, ',' ORDER BY n_name) FILTER (n_nationkey % 3 = 1) AS skipped, count(*) FILTER (n_nationkey % 3 = 2) AS errors FROM nation GROUP BY n_regionkey")
def _(spark, d):
    k = F.col("n_nationkey") % 3

    def names(kind: int) -> F.Column:
        return F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(k == kind, F.col("n_name")))), ","), F.lit(""))

    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(names(0).alias("downloaded"), names(1).alias("skipped"), F.count_if(k == 2).alias("errors"))


@query("ag12_badge", f"WITH {J} SELECT status, least(count(*), 99) AS badge FROM jb GROUP BY status")
def _(spark, d):
    return jobs(spark, d).groupBy("status").agg(F.least(F.count("*"), F.lit(99).cast("long")).alias("badge"))


@query("wn02_cumulative_ms", f"WITH {P} SELECT job_id, page_number, CAST(sum(page_ms) OVER (PARTITION BY job_id ORDER BY page_number) AS BIGINT) AS elapsed FROM jp")
def _(spark, d):
    w = Window.partitionBy("job_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    return job_pages(spark, d).select("job_id", "page_number", F.sum("page_ms").over(w).alias("elapsed"))


@query("wn03_latest_state", f"WITH {E} SELECT job_id, event_id, status, current_page FROM ev QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY at_ms DESC, event_id DESC) = 1")
def _(spark, d):
    return queue.latest(job_events(spark, d), "job_id", "at_ms", "event_id").select("job_id", "event_id", "status", "current_page")


@query("wn04_suffix", f"WITH {J} SELECT job_id, row_number() OVER (PARTITION BY input_path ORDER BY job_id) - 1 AS suffix FROM jb")
def _(spark, d):
    return jobs(spark, d).select("job_id", (F.row_number().over(Window.partitionBy("input_path").orderBy("job_id")) - 1).cast("long").alias("suffix"))


@query("or02_dequeue", f"WITH {J} SELECT job_id FROM jb WHERE status = 'queued' ORDER BY seq LIMIT 4")
def _(spark, d):
    return jobs(spark, d).filter("status = 'queued'").orderBy("seq").limit(4).select("job_id")


@query("lm01_history", f"WITH {J} SELECT job_id, greatest(finished_at - started_at, 0) AS duration_ms FROM jb WHERE status = 'completed' ORDER BY finished_at DESC, job_id DESC LIMIT 100")
def _(spark, d):
    done = jobs(spark, d).filter("status = 'completed'").orderBy(F.desc("finished_at"), F.desc("job_id")).limit(queue.HISTORY_LIMIT)
    return done.select("job_id", F.greatest(F.col("finished_at") - F.col("started_at"), F.lit(0)).alias("duration_ms"))


@query("lm02_logs", f"WITH {E} SELECT event_id, status FROM ev ORDER BY event_id DESC LIMIT 500")
def _(spark, d):
    return job_events(spark, d).orderBy(F.desc("event_id")).limit(queue.LOG_LIMIT).select("event_id", "status")


@query("lm03_first_match", f"WITH {P} SELECT job_id, min(page_number) AS page_number FROM jp WHERE NOT has_text GROUP BY job_id")
def _(spark, d):
    return job_pages(spark, d).filter("NOT has_text").groupBy("job_id").agg(F.min("page_number").alias("page_number"))


@query("lm04_chips", "WITH n AS (SELECT n_regionkey AS region, list(n_name ORDER BY n_nationkey) AS l FROM nation GROUP BY n_regionkey) SELECT region, array_to_string(l[1:4], ',') AS chips, len(l) - 4 AS more FROM n")
def _(spark, d):
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("l"))
    return n.select("region", F.array_join(F.slice("l.n_name", 1, 4), ",").alias("chips"), (F.size("l") - 4).cast("long").alias("more"))


@query("set01_append", f"WITH {J} SELECT job_id, input_path FROM jb UNION ALL SELECT job_id, input_path FROM jb WHERE job_id % 2 = 0")
def _(spark, d):
    j = jobs(spark, d).select("job_id", "input_path")
    return j.unionByName(j.filter("job_id % 2 = 0"))


@query("set02_remove", f"WITH {J} SELECT job_id FROM jb WHERE job_id % 8 <> 0")
def _(spark, d):
    j = jobs(spark, d).select("job_id")
    return j.join(j.filter("job_id % 8 = 0"), "job_id", "left_anti")


@query("set03_clear", f"WITH {J} SELECT 'history' AS kept, count(*) AS n FROM jb WHERE status IN ('completed', 'failed') UNION ALL SELECT 'queue', 0")
def _(spark, d):
    """Clearing empties the queue and leaves the history."""
    j = jobs(spark, d).select("job_id", "status")
    history = j.filter("status IN ('completed', 'failed')")
    queue_after = j.join(j.select("job_id"), "job_id", "left_anti")
    return history.agg(F.lit("history").alias("kept"), F.count("*").alias("n")).union(queue_after.agg(F.lit("queue").alias("kept"), F.count("*").alias("n")))


@query("set04_upsert_profile", "WITH old AS (SELECT p_partkey AS ord, trim(p_brand) AS name, p_size AS v FROM part QUALIFY row_number() OVER (PARTITION BY trim(p_brand) ORDER BY p_partkey) = 1), new AS (SELECT trim(p_brand) AS name, max(p_size) AS v FROM part WHERE p_size > 40 GROUP BY 1) SELECT coalesce(old.name, new.name) AS name, old.ord, coalesce(new.v, old.v) AS v FROM old FULL JOIN new ON old.name = new.name")
def _(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.trim("p_brand").alias("name"), F.col("p_size").alias("v"))
    old = p.groupBy("name").agg(F.min_by(F.struct("ord", "v"), "ord").alias("o")).select("name", "o.ord", F.col("o.v").alias("old_v"))
    new = p.filter("v > 40").groupBy("name").agg(F.max("v").alias("new_v"))
    return old.join(new, "name", "full").select("name", "ord", F.coalesce("new_v", "old_v").alias("v"))


@query("set05_reprocess", f"WITH {J} SELECT job_id, CASE WHEN job_id % 6 = 0 THEN 'pending' ELSE status END AS status, CASE WHEN job_id % 6 = 0 THEN FALSE ELSE job_id % 2 = 0 END AS queued FROM jb")
def _(spark, d):
    again = F.col("job_id") % 6 == 0
    return jobs(spark, d).select("job_id", F.when(again, "pending").otherwise(F.col("status")).alias("status"), F.when(again, False).otherwise(F.col("job_id") % 2 == 0).alias("queued"))


@query("set06_password_reset", f"WITH {J}, bad AS (SELECT DISTINCT input_path FROM jb WHERE job_id % 14 = 0), c AS (SELECT DISTINCT input_path FROM jb WHERE job_id % 7 = 0) SELECT input_path FROM c WHERE input_path NOT IN (SELECT input_path FROM bad)")
def _(spark, d):
    j = jobs(spark, d)
    return j.filter("job_id % 7 = 0").select("input_path").distinct().join(j.filter("job_id % 14 = 0").select("input_path"), "input_path", "left_anti")


@query("fn03_timestamp", f"WITH {J} SELECT job_id, strftime(epoch_ms(started_at), '%Y-%m-%d %H:%M:%S') AS started FROM jb")
def _(spark, d):
    return jobs(spark, d).select("job_id", F.date_format(F.timestamp_millis("started_at"), "yyyy-MM-dd HH:mm:ss").alias("started"))


@query("fn05_saturating", f"WITH {J} SELECT job_id, greatest(started_at - finished_at, 0) AS back, greatest(finished_at - started_at, 0) AS duration_ms FROM jb")
def _(spark, d):
    a, b = F.col("started_at"), F.col("finished_at")
    return jobs(spark, d).select("job_id", F.greatest(a - b, F.lit(0)).alias("back"), F.greatest(b - a, F.lit(0)).alias("duration_ms"))


@query("fn06_integers", "SELECT p_partkey, (p_size + 7) // 8 AS ceil_div, least(greatest(p_size, 10), 40) AS clamped, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS rounded, CAST(trunc(p_retailprice) AS BIGINT) AS truncated FROM part")
def _(spark, d):
    s, r = F.col("p_size"), F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.expr("int((p_size + 7) div 8)").alias("ceil_div"), F.least(F.greatest(s, F.lit(10)), F.lit(40)).alias("clamped"), fn.round_half_up(r).alias("rounded"), r.cast("long").alias("truncated"))


@query("fn09_trig", "SELECT p_partkey, round(sin(radians(CAST(p_size AS DOUBLE))), 6) AS s, round(cos(radians(CAST(p_size AS DOUBLE))), 6) AS c, round(sqrt(pow(p_size, 2) + 1), 6) AS r FROM part")
def _(spark, d):
    t = F.radians(F.col("p_size").cast("double"))
    return table(spark, d, "part").select("p_partkey", F.round(F.sin(t), 6).alias("s"), F.round(F.cos(t), 6).alias("c"), F.round(F.sqrt(F.pow("p_size", F.lit(2)) + 1), 6).alias("r"))


@query("fn10_bits", "SELECT p_partkey, (p_size << 3) | 1 AS a, (p_size >> 2) & 3 AS b FROM part")
def _(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.shiftleft(s, 3).bitwiseOR(F.lit(1)).alias("a"), F.shiftright(s, 2).bitwiseAND(F.lit(3)).alias("b"))


@query("fn12_strings", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '+') AS joined, upper(trim(p_brand)) = upper('Brand#11') AS same FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.split("p_name", " "), "+").alias("joined"), (F.upper(F.trim("p_brand")) == F.upper(F.lit("Brand#11"))).alias("same"))


@query("fn15_arrays", "SELECT p_partkey, string_split(p_name, ' ') = string_split(lower(p_name), ' ') AS same, string_split(p_name, ' ')[1] AS first FROM part")
def _(spark, d):
    a = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", (a == F.split(F.lower("p_name"), " ")).alias("same"), F.get(a, 0).alias("first"))


@query("fn16_maps", "SELECT n_regionkey AS region, string_agg(concat(n_nationkey, ': ', n_name), '; ' ORDER BY n_nationkey) AS listing FROM nation GROUP BY n_regionkey")
def _(spark, d):
    entries = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    m = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.map_from_entries(entries).alias("m"))
    return m.select("region", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"].cast("string"), F.lit(": "), e["value"])), "; ").alias("listing"))


@query("fn18_enums", f"WITH {J} SELECT job_id, status IN ('queued', 'running', 'completed', 'failed', 'cancelled') AS valid, concat(upper(status[1]), status[2:]) AS label FROM jb")
def _(spark, d):
    return jobs(spark, d).select("job_id", F.col("status").isin("queued", "running", "completed", "failed", "cancelled").alias("valid"), F.initcap("status").alias("label"))


@query("st02_throttle", f"""WITH RECURSIVE {E}, o AS (SELECT job_id, event_id, at_ms // 1000000 AS t, row_number() OVER (PARTITION BY job_id ORDER BY at_ms // 1000000, event_id) AS n FROM ev),
k AS (SELECT job_id, event_id, t, n, t AS last, TRUE AS keep FROM o WHERE n = 1
  UNION ALL SELECT o.job_id, o.event_id, o.t, o.n, CASE WHEN o.t - k.last >= 50 THEN o.t ELSE k.last END, o.t - k.last >= 50 FROM k JOIN o ON o.job_id = k.job_id AND o.n = k.n + 1)
SELECT job_id, event_id FROM k WHERE keep""")
def _(spark, d):
    """Times in thousands of seconds here, so that the 50-unit gap bites on these events."""
    e = job_events(spark, d).select("job_id", "event_id", F.expr("at_ms div 1000000").alias("t"))
    return queue.throttled(e, "job_id", "t", "event_id").select("job_id", "event_id")


@query("st03_transitions", f"WITH {E}, l AS (SELECT event_id, status, lag(status) OVER (PARTITION BY job_id ORDER BY at_ms, event_id) AS before FROM ev) SELECT before, status, count(*) AS n FROM l GROUP BY ALL")
def _(spark, d):
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("at_ms", "event_id"))
    return job_events(spark, d).withColumn("before", before).groupBy("before", "status").agg(F.count("*").alias("n"))


@query("st04_admission", f"WITH {J}, f AS (SELECT count(*) FILTER (status = 'running') AS busy, min(CASE WHEN status = 'queued' THEN seq END) AS head FROM jb) SELECT head, busy, busy < 4 AND NOT (head % 2 = 0 AND busy > 0) AS dispatch FROM f")
def _(spark, d):
    f = jobs(spark, d).agg(F.count_if(F.col("status") == "running").alias("busy"), F.min(F.when(F.col("status") == "queued", F.col("seq"))).alias("head"))
    return f.select("head", "busy", ((F.col("busy") < 4) & ~((F.col("head") % 2 == 0) & (F.col("busy") > 0))).alias("dispatch"))


@query("st09_event_fold", f"WITH {E}, l AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY at_ms DESC, event_id DESC) = 1) SELECT job_id, status, CASE WHEN status = 'completed' THEN 100 ELSE current_page END AS progress FROM l")
def _(spark, d):
    return queue.latest(job_events(spark, d), "job_id", "at_ms", "event_id").select("job_id", "status", F.when(F.col("status") == "completed", 100).otherwise(F.col("current_page")).alias("progress"))


@query("ag08_mean_angle", """WITH a AS (SELECT l_orderkey AS page_id, CASE WHEN l_partkey * 7 % 180 > 90 THEN l_partkey * 7 % 180 - 180 ELSE l_partkey * 7 % 180 END AS a FROM lineitem)
SELECT page_id, round(avg(CASE WHEN abs(a) <= 20 THEN a END), 9) AS skew FROM a GROUP BY page_id""")
def _(spark, d):
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_partkey") * 7 % 180).alias("angle"))
    return lines.mean_skew(found).select("page_id", F.round("skew", 9).alias("skew"))


@query("img13_deskew", """SELECT p_partkey AS part, CASE p_size % 3 WHEN 0 THEN -((p_partkey % 101 - 50) / CAST(10 AS DOUBLE)) WHEN 1 THEN -CAST(coalesce(CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 41 - 20 END, 0) AS DOUBLE) ELSE 0.0 END + 0.0 AS turn FROM part""")
def _(spark, d):
    p, size = F.col("p_partkey"), F.col("p_size")
    mode = F.element_at(F.lit(["radon", "hough", "disabled"]), size % 3 + 1)
    return table(spark, d, "part").select(p.alias("part"), (lines.deskew_turn(mode, (p % 101 - 50) / 10.0, F.when(p % 4 > 0, p % 41 - 20).cast("double")) + 0.0).alias("turn"))
