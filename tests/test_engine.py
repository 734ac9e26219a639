"""Datasets built by hand, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sedimenta import cache, config, storage
from sedimenta.cli import parser
from sedimenta.cli import run as cli_run
from sedimenta.config import Settings
from sedimenta.errors import BudgetExceeded, EngineError, IngestError, QueryError, SchemaConflict, SessionLost
from sedimenta.functions import sketches, times
from sedimenta.functions.rewrite import prepare, rewrite
from sedimenta.metrics import Metrics
from sedimenta.operators import aggregates, filters, native_query
from sedimenta.plans.fluent import connect
from sedimenta.schema import DatasetSchema, Field
from sedimenta.session import Engine
from sedimenta.sources.dataset import Dataset
from sedimenta.sources.ingest import Roles, ingest

ROWS = [
    ("2023-01-01 01:00:00", 1, 100, "us"), ("2023-01-01 02:00:00", 2, 200, "de"), ("2023-01-01 03:00:00", 1, 300, "us"),
    ("2023-01-01 23:59:59", 2, 400, "de"), ("2023-01-02 00:00:00", 3, 500, "us"), ("2023-01-02 05:00:00", 3, 600, "de"),
]
ROLES = Roles("ts", ("fare",), ("vendor",), ("country",))


def write(spark, rows, schema, **options):
    path = storage.scratch(spark, "in")
    w = spark.createDataFrame(rows, schema).coalesce(1).write
    if options:
        w.options(**options).csv(path)
    else:
        w.parquet(path)
    return path


@pytest.fixture(scope="module")
def taxi(spark):
    prepare(spark)
    root = f"{storage.scratch(spark, 'lake')}/taxi"
    ingest(spark, write(spark, ROWS, "ts string, vendor long, fare long, country string"), root, ROLES, "parquet")
    return Dataset.open(spark, root)


def test_shards_and_inspect(taxi):
    assert [tuple(r) for r in taxi.shards().orderBy("shard").collect()] == [("2023-01-01", 4, 1672534800, 1672617599), ("2023-01-02", 2, 1672617600, 1672635600)]
    assert {r["field"]: r["terms"] for r in taxi.inspect("2023-01-01").collect()} == {"ts": None, "fare": None, "vendor": 2, "country": 2}


def test_where_time_prunes_directories(taxi):
    df = taxi.where_time(1672617600, 1672639999)
    assert df.count() == 2
    assert "PartitionFilters: [isnotnull(_shard" in df._jdf.queryExecution().toString()
    assert taxi.where_time(1672617599, 1672617600).count() == 2


def test_native_query_and_text(taxi):
    r = native_query.run(taxi, ["fare"], ["country=us"])
    assert (r.num_docs, r.matched, r.metrics[0].sum) == (6, 3, 900)
    assert native_query.render(r).split("\n")[1:] == ["shards:   2 scanned", "filter:   country=us", "matched:  3 / 6 docs", "fare:   sum = 900"]
    assert native_query.run(taxi, ["fare"], ["vendor=2..3"], "avg").metrics[0].value("avg") == "425.00"
    none = native_query.run(taxi, ["fare"], ["country=zz"], "min")
    assert (none.matched, none.metrics[0].sum, none.metrics[0].value("min"), none.metrics[0].value("avg")) == (0, 0, "n/a", "n/a")


def test_window_keeps_whole_shards(taxi):
    r = native_query.run(taxi, ["fare"], start="2023-01-01 23:00:00", end="2023-01-01")
    assert (r.num_docs, r.metrics[0].sum) == (4, 1000)
    assert "no shards found" in native_query.render(native_query.run(taxi, ["fare"], start="2024-01-01"))
    with pytest.raises(QueryError):
        native_query.run(taxi, ["fare"], start="2023-01-02", end="2023-01-01")


@pytest.mark.parametrize("text", ["v=..", "v=", "v100", "=us"])
def test_filters_refused(text):
    with pytest.raises(QueryError):
        filters.parse(text)


def test_filters_read(spark):
    assert filters.parse("q=a=b") == filters.Clause("q", value="a=b")
    assert filters.parse("v=1..2") == filters.Clause("v", lo="1", hi="2")
    assert str(filters.parse("v=..200")) == "v=..200"
    schema = DatasetSchema((Field("v", "int"), Field("m", "metric")))
    for bad in ("v=x", "v=9..1", "m=1", "zz=1"):
        with pytest.raises(QueryError):
            filters.condition(filters.parse(bad), schema)


def test_sql_over_dataset(spark, taxi):
    engine = Engine(spark, taxi.root.rsplit("/", 1)[0])
    token = engine.open()
    rows = lambda q: [tuple(r.values()) for r in engine.run(q, token).to_pylist()]
    assert rows("SELECT sum(fare) FROM taxi") == [(2100,)]
    assert rows("SELECT country, sum(fare) FROM taxi GROUP BY country ORDER BY country") == [("de", 1200), ("us", 900)]
    assert rows("SELECT count(*), sum(fare), avg(fare), approx_distinct(vendor), approx_percentile_cont(fare, 0.5) FROM taxi WHERE country = 'zz'") == [(0, None, None, 0.0, None)]
    assert rows("SELECT theta_intersect((SELECT theta(vendor) FROM taxi WHERE country='us'), (SELECT theta(vendor) FROM taxi WHERE country='de'))") == [(1,)]
    assert rows("SELECT \"fare\" FROM taxi WHERE ts = TIMESTAMP_NTZ '2023-01-02 00:00:00'") == [(500,)]
    with pytest.raises(QueryError):
        engine.run("SELECT * FROM nowhere", token)
    with pytest.raises(QueryError):
        engine.run("CREATE VIEW v AS SELECT 1")


def test_session_life(spark, taxi):
    now = [0.0]
    engine = Engine(spark, taxi.root.rsplit("/", 1)[0], clock=lambda: now[0])
    a, b = engine.open(), engine.open()
    engine.run("CREATE VIEW cheap AS SELECT * FROM taxi WHERE fare < 300", a)
    assert engine.run("SELECT count(*) AS n FROM cheap", a).to_pylist() == [{"n": 2}]
    with pytest.raises(QueryError):
        engine.run("SELECT * FROM cheap", b)
    assert {(r["name"], r["kind"]) for r in engine.tables(a).collect()} == {("taxi", "TABLE"), ("cheap", "VIEW")}
    t = engine.ticket("SELECT 1 AS x", a)
    assert engine.fetch(t, a).to_pylist() == [{"x": 1}]
    with pytest.raises(QueryError):
        engine.fetch(t, a)
    p = engine.prepare("SELECT count(*) AS n FROM taxi", a)
    assert engine.execute(p, a).to_pylist() == [{"n": 6}]
    p = engine.prepare("SELECT count(*) AS n FROM taxi WHERE country = :c AND fare >= :least", a)
    assert engine.execute(p, a, {"c": "us", "least": 0}).to_pylist()[0]["n"] > engine.execute(p, a, {"c": "zz", "least": 0}).to_pylist()[0]["n"] == 0
    for bad in ("SELEC 1", "SELECT * FROM nowhere WHERE a = 1"):
        with pytest.raises(QueryError):
            engine.prepare(bad, a)
    with pytest.raises(QueryError):
        engine.execute(p, a)
    engine.close_statement(p, a)
    with pytest.raises(QueryError):
        engine.execute(p, a)
    engine.close(b)
    engine.close(b)
    now[0] = 1801
    with pytest.raises(SessionLost):
        engine.run("SELECT 1", a)
    assert engine.columns("taxi").count() == 4 and engine.info().count() > 3
    engine.drain(0)
    with pytest.raises(EngineError):
        engine.open()


def test_admission(spark, taxi):
    small = Engine(spark, taxi.root.rsplit("/", 1)[0], Settings(memory=100))
    for whole in ("SELECT * FROM taxi", "SELECT fare + 1 AS f, country FROM taxi", "SELECT fare FROM taxi UNION ALL SELECT fare FROM taxi"):
        with pytest.raises(BudgetExceeded):
            small.run(whole)
    assert small.run("SELECT count(*) AS n FROM taxi").to_pylist() == [{"n": 6}]
    assert len(Engine(spark, taxi.root.rsplit("/", 1)[0]).run("SELECT * FROM taxi")) == 6


def test_top_k_in_sql(spark, taxi):
    engine = Engine(spark, taxi.root.rsplit("/", 1)[0])
    top = lambda sql: [(r["value"], r["count"]) for r in engine.run(sql).to_pylist()[0]["top"]]
    rows = "(SELECT explode(array('b', 'a', 'a', 'b', 'c', NULL, NULL, NULL)) AS v)"
    assert top(f"SELECT approx_top_k(v, 2) AS top FROM {rows}") == [("a", 2), ("b", 2)]
    assert top(f"SELECT approx_top_k(v, 9, 1) AS top FROM {rows}") == [("a", 2), ("b", 2), ("c", 1)]
    assert top(f"SELECT approx_top_k(v, 2) AS top FROM {rows} WHERE v = 'zz'") == []
    with pytest.raises(QueryError):
        engine.run("SELECT approx_top_k(fare, 0) FROM taxi")


def test_one_sharding_a_dataset(spark, taxi):
    """Runs that cut shards otherwise are refused, and names that do not agree are not used for pruning."""
    from dataclasses import replace

    path, root = storage.scratch(spark, "in"), storage.scratch(spark, "lake")
    days = lambda *d: spark.createDataFrame([(x,) for x in d], "t string").select(F.to_timestamp_ntz("t").alias("ts"), F.lit(1).alias("v")).write.mode("overwrite").parquet(path)
    days("2024-01-05T00:00:00", "2024-03-01T00:00:00")
    for by in ("monthly", "weekly", "hourly", "daily"):
        ingest(spark, path, f"{root}-{by}", Roles("ts", ("v",), shard_by=by), "parquet")
        d = Dataset.open(spark, f"{root}-{by}")
        assert d.sharding() == by
        assert d.where_time(1704412800, 1704412800).count() == 1 and d.where_time(1704412800, None).count() == 2 and d.where_time(None, 1704412799).count() == 0
        old = Dataset(spark, d.root, replace(d.schema, sharding=None))
        assert old.where_time(1704412800, 1704412800).count() == 1 and old.where_time(1709251200).count() == 1
    with pytest.raises(SchemaConflict):
        ingest(spark, path, f"{root}-monthly", Roles("ts", ("v",), shard_by="daily"), "parquet")
    mixed = Dataset.open(spark, f"{root}-monthly")
    mixed.stored().where("false").write.mode("append").parquet(mixed.root)
    spark.createDataFrame([(1706745600, 1)], "ts long, v long").write.parquet(f"{mixed.root}/_shard=2024-02-01")
    both = Dataset(spark, mixed.root, replace(mixed.schema, sharding=None))
    assert both.sharding() == "none" and both.where_time(1704067200, 1709078400).count() == 2


def test_fluent_text(spark, taxi):
    engine = Engine(spark, taxi.root.rsplit("/", 1)[0])
    with connect(engine) as c:
        s = c.session("taxi")
        assert s.filter("a = 1").filter("b = 2").to_sql() == "SELECT * FROM taxi WHERE (a = 1) AND (b = 2)"
        assert s.filter("p = 1").group_by("k", "l").select("count(*) AS n").to_sql() == "SELECT count(*) AS n FROM taxi WHERE (p = 1) GROUP BY k, l"
        assert s.query().to_sql() == "SELECT * FROM taxi"
        base = s.filter("a = 1")
        base.filter("b = 2")
        assert base.to_sql() == "SELECT * FROM taxi WHERE (a = 1)"
        s.define("twice", "fare * 2").define("w", "vendor + 1")
        assert s.select("sum(twice)").to_sql() == "SELECT sum(twice) FROM (SELECT *, (fare * 2) AS twice, (vendor + 1) AS w FROM taxi) AS _t"
        assert s.select("sum(twice) AS s").fetch().to_pylist() == [{"s": 4200}]
        assert c.session_from_sql("SELECT 1 AS x").select("x").to_sql() == "SELECT x FROM (SELECT 1 AS x) AS _base"
        engine.close(s.token)  # lost: the next statement opens another
        assert s.select("count(*) AS n").fetch().to_pylist() == [{"n": 6}]
        for bad in (lambda: s.define("1bad", "x"), lambda: c.session(""), lambda: c.session_from_sql(" ")):
            with pytest.raises(ValueError):
                bad()
        with pytest.raises(NotImplementedError):
            c.session("taxi", time_range=(1, 2))
    with pytest.raises(SessionLost):
        s.fetch()


def test_ingest_scales_and_nulls(spark):
    rows = spark.createDataFrame([(1700000000, 7, "12.34", 1.5, "card"), (1700000001, None, "56.78", 2.25, None)], "t long, vendor int, fare string, dist double, pay string")
    path = storage.scratch(spark, "in")
    rows.select(F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"), "vendor", F.col("fare").cast("decimal(10,2)").alias("fare"), "dist", "pay").write.parquet(path)
    root = storage.scratch(spark, "lake")
    schema = ingest(spark, path, root, Roles("ts", ("fare", "dist"), ("vendor",), ("pay",)), "parquet")
    assert [(f.name, f.kind, f.scale, f.nullable) for f in schema.fields] == [
        ("ts", "time", 0, False), ("fare", "metric", 2, False), ("dist", "metric", 3, False), ("vendor", "int", 0, True), ("pay", "string", 0, True),
    ]
    assert [tuple(r)[:5] for r in Dataset.open(spark, root).stored().orderBy("ts").collect()] == [(1700000000, 1234, 1500, 7, "card"), (1700000001, 5678, 2250, None, None)]
    assert ingest(spark, path, storage.scratch(spark, "lake"), Roles("ts", ("dist",), scales={"dist": 2}), "parquet").field("dist").scale == 2
    with pytest.raises(IngestError):
        ingest(spark, path, root, Roles("ts", ("fare",), scales={"fare": 2}), "parquet")


def test_ingest_text(spark):
    path = write(spark, [("ts", "val", "zone"), ("1700000000", "10", "a"), ("1700000050", "", ""), ("1700000100", "30", "c")], "a string, b string, c string", sep=",")
    root = storage.scratch(spark, "lake")
    ingest(spark, path, root, Roles("ts", ("val",), (), ("zone",)), "csv")
    assert [(r["val"], r["zone"]) for r in Dataset.open(spark, root).stored().orderBy("ts").collect()] == [(10, "a"), (None, None), (30, "c")]
    bad = write(spark, [("ts", "val"), ("1700000000", "1.5")], "a string, b string", sep=",")
    for roles in (Roles("ts", ("val",)), Roles("ts", ("other",)), Roles("ts", ("val",), scales={"val": 1})):
        with pytest.raises(IngestError):
            ingest(spark, bad, storage.scratch(spark, "lake"), roles, "csv")
    with pytest.raises(IngestError):
        Roles("ts", ("val",), ("val",))


def test_reingest_replaces_a_shard_and_conflicts_change_nothing(spark):
    root = storage.scratch(spark, "lake")
    run = lambda rows, kind, roles: ingest(spark, write(spark, rows, f"ts string, val {kind}"), root, roles, "parquet")
    run([("2023-01-01", 1), ("2023-01-02", 2)], "long", Roles("ts", ("val",)))
    run([("2023-01-02", 20), ("2023-01-02", None)], "long", Roles("ts", ("val",)))
    d = Dataset.open(spark, root)
    assert sorted((r["val"] or 0) for r in d.stored().collect()) == [0, 1, 20] and d.schema.field("val").nullable
    with pytest.raises(SchemaConflict):
        run([("2023-01-03", "x")], "string", Roles("ts", (), (), ("val",)))
    assert d.stored().count() == 3


def test_times(spark):
    texts = ["1700000000", "2023-11-14T22:13:20Z", "2023-11-14T23:13:20+01:00", "2023-11-14 22:13:20", "2023-11-14", "20231114", "junk", "2023", "T10:00", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(times.seconds_of_text(F.col("t")))
    assert [r[0] for r in df.collect()] == [1700000000] * 4 + [1699920000, 20231114, None, 2023, None, None]
    before = spark.sql("SELECT TIMESTAMP_NTZ '1969-12-31 23:59:58.5' AS t")
    assert before.select(times.seconds_of(F.col("t"), before.schema["t"].dataType)).first()[0] == -1
    assert times.parse_bound("2023-01-14", end_of_day=True) - times.parse_bound("2023-01-14") == 86_399
    for by, name in (("hourly", "2023-11-14T22"), ("daily", "2023-11-14"), ("weekly", "2023-11-09"), ("monthly", "2023-11"), ("none", "all")):
        assert spark.range(1).select(times.shard_name(F.lit(1700000000).cast("bigint"), by)).first()[0] == name == times.shard_name_of(1700000000, by)


def test_sketches(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", None), (None, "z")], "k string, v string")
    top = {r["k"]: [tuple(t) for t in r["top"]] for r in sketches.top_k(df, "v", 2, ["k"]).collect()}
    assert top == {"a": [("x", 2), ("y", 1)], "b": [], None: [("z", 1)]}
    assert [tuple(t) for t in sketches.top_k(df, "v", 5).first()["top"]] == [("x", 2), ("y", 1), ("z", 1)]
    n = spark.range(100_000).agg(sketches.theta_estimate(sketches.theta("id")), sketches.approx_distinct("id")).first()
    assert abs(n[0] - 100_000) < 5000 and abs(n[1] - 100_000) < 1000
    assert sketches.lg_entries(4096) == 12 and sketches.lg_entries(5000) == 13 and sketches.lg_entries(2) == 4


def test_distinct_is_exact(spark):
    """Beyond what the sketch holds, and per group on either side of it."""
    df = spark.range(100_000).select("id", F.when(F.col("id") < 50, "few").otherwise("many").alias("k"))
    assert tuple(df.agg(sketches.distinct("id"), sketches.distinct("k"), sketches.distinct(F.when(F.lit(False), F.col("k")))).first()) == (100_000, 2, 0)
    assert {tuple(r) for r in df.groupBy("k").agg(sketches.distinct("id")).collect()} == {("few", 50), ("many", 99_950)}


@pytest.mark.parametrize("name", ["approx_distinct_global", "approx_distinct_group", "fluent_define"])
def test_distinct_queries_on_many_values(spark, tmp_path, name):
    import duckdb

    from sedimenta.plans import engine_queries

    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS l_suppkey, i * 7 AS l_partkey FROM range(40000) t(i)) TO '{tmp_path}/lineitem.parquet'")
    con.execute(
        "COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i % 2) DAY AS ts, i AS user_id, 'click' AS event_type, i / 100 AS value FROM range(80000) t(i)) "
        f"TO '{tmp_path}/events.parquet'"
    )
    for table in ("lineitem", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    expected = con.execute(engine_queries.oracle_sql()[name])
    columns, rows = [c[0] for c in expected.description], expected.fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in engine_queries.queries()[name](spark, str(tmp_path)).collect()) == sorted(rows)


def test_rewrite():
    assert rewrite("SELECT 'theta(x)', \"theta\" FROM t -- theta(x)") == "SELECT 'theta(x)', \"theta\" FROM t -- theta(x)"
    assert rewrite("select approx_distinct( f(a, b) )") == "select theta_sketch_estimate(theta_sketch_agg(f(a, b), 14))"
    assert rewrite("create or replace view v as select 1").startswith("create or replace TEMPORARY view")
    with pytest.raises(QueryError):
        rewrite("select theta(1")


def test_fields_terms_groups(spark):
    df = spark.createDataFrame([("US", 9, 10, 1), ("US", 9, 20, 1), ("UK", 10, 30, 2), ("US", 11, 40, 2), ("UK", 10, 50, 1)], "country string, hour int, revenue long, g int")
    rows = aggregates.field_terms(df, ["country", "hour"], [F.sum("revenue").alias("s")], F.when(F.col("g") == 1, 1).otherwise(0)).collect()
    assert {(r["field"], r["term"], r["group"]): r["s"] for r in rows} == {("country", "US", 1): 30, ("country", "UK", 1): 50, ("hour", "9", 1): 30, ("hour", "10", 1): 50}


def test_cache(spark, taxi):
    c = cache.FilterCache(taxi.frame(), most=2)
    assert c.where("fare > 100").count() == 5 and c.where("fare > 100", "country = 'us'").count() == 2
    c.where("fare > 100")
    assert (c.misses, c.narrowed, c.hits) == (1, 1, 1)
    c.clear()
    r = cache.write_rollup(taxi, "by_country", ["country"], ["fare"])
    assert {x["country"]: (x["docs"], x["sum_fare"]) for x in cache.from_rollup(r, ["country"], ["fare"]).collect()} == {"us": (3, 900), "de": (3, 1200)}


def test_config_and_metrics(tmp_path):
    assert [config.parse_size(x) for x in ("10GB", "512MiB", "7", "1.5k")] == [10**10, 2**29, 7, 1536] and config.parse_size("50%", 10) == 5
    for bad in ("x", "10 zb", "150%", "50%"):
        with pytest.raises(EngineError):
            config.parse_size(bad, 10 if bad == "150%" else None)
    (tmp_path / "c.toml").write_text('memory = "1GB"\nidle_seconds = 5\n')
    s = config.Settings.load({"idle_seconds": 9}, str(tmp_path / "c.toml"), {"SEDIMENTA_MEMORY": "2GB"})
    assert (s.memory, s.idle_seconds, s.session_share) == (2 * 10**9, 9, 20)
    m = Metrics()
    m.record("SELECT 1", 0.02, 1)
    m.record("bad", 20.0, None, "QueryError")
    assert 'le="0.025"} 1' in m.text() and m.status()["failures"] == 1 and len(m.status()["recent"]) == 2


def test_http(spark, taxi):
    import json
    import urllib.request

    from sedimenta.ops_http import answer, serve

    engine = Engine(spark, taxi.root.rsplit("/", 1)[0])
    engine.run("SELECT count(*) AS n FROM taxi")
    server = serve(engine, port=0)
    try:
        get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{p}", timeout=10).read().decode()
        assert get("/healthz") == "ok" and get("/readyz") == "ready"
        assert json.loads(get("/status.json"))["queries"] == 1 and "sedimenta_query_seconds_count 1" in get("/metrics")
        assert "count(*)" in get("/status") and get("/favicon.svg").startswith("<svg")
    finally:
        server.shutdown()
    engine.drain(0)
    assert answer(engine, "/readyz")[0] == 503 and answer(engine, "/nothing")[0] == 404


def test_filters_are_kept_within_a_share(spark, taxi):
    root = taxi.root.rsplit("/", 1)[0]
    engine = Engine(spark, root)
    assert engine.filtered("taxi", "fare > 100").count() == 5
    assert engine.filtered("taxi", "fare > 100", "fare < 500").count() == 3
    assert engine.filtered("taxi", "fare > 100").count() == 5
    text = engine.metrics.text()
    assert "sedimenta_filter_cache_entries 2" in text and "sedimenta_filter_cache_hits 2" in text and "sedimenta_filter_cache_misses 1" in text
    engine.forget("taxi")
    assert "sedimenta_filter_cache_bytes 0" in engine.metrics.text()
    small = Engine(spark, root, config.Settings(memory=100))
    assert small.filtered("taxi", "fare > 100").count() == 5
    assert "sedimenta_filter_cache_entries 0" in small.metrics.text()
    with pytest.raises(QueryError):
        engine.filtered("nothing", "fare > 100")


def test_serve_until_stopped(spark, taxi, capsys):
    import threading
    import urllib.request

    from sedimenta.cli import serve

    engine, stop = Engine(spark, taxi.root.rsplit("/", 1)[0]), threading.Event()
    engine.open()
    t = threading.Thread(target=serve, args=(engine, "127.0.0.1", 0, stop))
    t.start()
    try:
        for _ in range(100):
            at = capsys.readouterr().out.strip()
            if at:
                break
            stop.wait(0.1)
        url = at.rsplit(" ", 1)[1]
        assert urllib.request.urlopen(f"{url}/readyz", timeout=10).read() == b"ready"
    finally:
        stop.set()
        t.join(60)
    assert not t.is_alive() and engine.sessions == 0
    args = parser().parse_args(["serve", "lake", "--port", "9000"])
    assert (args.root, args.host, args.port) == ("lake", "127.0.0.1", 9000)


def test_result_forms(spark, taxi):
    with connect(Engine(spark, taxi.root.rsplit("/", 1)[0])) as c:
        q = c.session("taxi").select("fare")
        assert sorted(q.to_pandas()["fare"]) == [100, 200, 300, 400, 500, 600]
        assert [b.num_rows for b in q.batches(4)] == [4, 2]


def test_command_line(spark, taxi, capsys):
    cli_run(parser().parse_args(["query", taxi.root, "--metric", "fare", "--filter", "country=de", "--aggregate", "max"]), spark)
    cli_run(parser().parse_args(["sql", taxi.root, "SELECT count(*) AS n FROM t"]), spark)
    cli_run(parser().parse_args(["shard", "list", taxi.root]), spark)
    cli_run(parser().parse_args(["storage", "check", taxi.root]), spark)
    cli_run(parser().parse_args(["storage", "summarize", taxi.root]), spark)
    out = capsys.readouterr().out
    assert "max = 600" in out and "2023-01-02" in out and "objects" in out and "_shard=2023-01-01" in out


def test_stream(spark):
    from sedimenta.streaming import tumbling

    path, out, state = (storage.scratch(spark, x) for x in ("in", "out", "state"))
    spark.createDataFrame(ROWS, "t string, vendor long, fare long, country string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "fare").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp_ntz, fare long").parquet(path)
    tumbling.into_shards(stream, "ts", out, state).trigger(availableNow=True).start().awaitTermination()
    assert {(r["_shard"].isoformat() if hasattr(r["_shard"], "isoformat") else r["_shard"], r["n"]) for r in spark.read.parquet(out).groupBy("_shard").agg(F.count("*").alias("n")).collect()} == {("2023-01-01", 4), ("2023-01-02", 2)}
