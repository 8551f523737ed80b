"""Properties, plans, edge cases and streams of the location engine."""

import random

from compare import same
from pyspark.sql import functions as F

from geoloom.functions import address, geo, quality, text
from geoloom.operators import dedup, enrich, grid, html, sinks
from geoloom.plans.fixtures import locations, read
from geoloom.sources import readers
from geoloom.streaming import jobs


def test_scores_stay_in_range(spark, sf_dir):
    s = enrich.with_quality(locations(spark, sf_dir)).agg(F.min("quality_score"), F.max("quality_score")).first()
    assert 0 <= s[0] <= s[1] <= 100


def test_similarity_is_symmetric_and_one_for_equals(spark):
    rows = spark.createDataFrame([("12 main", "12 main"), ("abc", "xyz"), ("", ""), ("kitten", "sitting")], "a string, b string")
    for r in rows.select(text.similarity(F.col("a"), F.col("b")).alias("x"), text.similarity(F.col("b"), F.col("a")).alias("y"), text.similarity(F.col("a"), F.col("a")).alias("z")).collect():
        assert r.x == r.y and r.z == 1 and 0 <= r.x <= 1


def test_haversine(spark):
    r = spark.range(1).select(geo.haversine(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278)).alias("km"), geo.haversine(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)).alias("zero")).first()
    assert abs(r.km - 343.5) < 1 and r.zero == 0


def test_street_words_with_dots(spark):
    rows = spark.createDataFrame([("5 St. James Street NW",), ("1 Elm Ave. 3",)], "x string").select(address.street(F.col("x")).alias("y"))
    assert [r.y for r in rows.collect()] == ["5 St James St NW", "1 Elm Ave 3"]


def test_leaders_equal_a_walk(spark):
    rng = random.Random(5)
    for _ in range(3):
        n = 30
        edges = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(45)})
        led = {}
        for i in range(n):
            near = [a for a, b in edges if b == i and led[a] == a]
            led[i] = min(near) if near else i
        ids = spark.createDataFrame([(i,) for i in range(n)], "id bigint")
        found = dedup.leaders(spark.createDataFrame(edges, "id_a bigint, id_b bigint"), ids)
        assert {r.id: r.leader for r in found.collect()} == led


def test_whole_pairs_equal_all_pairs(spark, sf_dir):
    from geoloom.plans.entities import doubled

    rows = doubled(spark, sf_dir).drop("block")
    odd = [(-1, None, 89.9999, 10.0, "A"), (-2, None, 89.9999, -170.0, "A"), (-3, None, 10.0, 179.9995, "A"), (-4, None, 10.0, -179.9995, "A"), (-5, "Street", None, None, None), (-6, "Road", None, None, None), (-7, "5 Elm", 0.0, 3.0, "Q"), (-8, "5 Elm", 0.0, 9.0, "Q")]
    more = spark.createDataFrame(odd, "id bigint, location_address string, latitude double, longitude double, location_name string")
    rows = rows.unionByName(more, allowMissingColumns=True).cache()
    every = {(r.id_a, r.id_b): r.score for r in dedup.similar_pairs(rows, F.lit(1)).collect()}
    found = dedup.whole_pairs(rows).collect()
    assert {(r.id_a, r.id_b): r.score for r in found} == every and len(found) == len(every)
    assert (13, 100000013) in every and (-2, -1) in every and (-4, -3) in every and (-6, -5) in every and (-8, -7) in every


def test_whole_pairs_compare_a_text_once(spark, tmp_path):
    """Rows without coordinates that have one text are many, also where others of that text have coordinates."""
    rng = random.Random(3)
    texts = [(a, n, p) for a in ("12 Elm Street", "13 Elm Street", "n/a", None) for n in ("Shop 101", "Shop 102", "shop 102", None) for p in ("75001", "7500-1", None)]
    rows = [(i, *t, *rng.choice([(None, None), (10.0, 20.0), (10.02, 20.0), (None, 20.0)])) for i, t in enumerate(rng.choices(texts, k=260))]
    rows = spark.createDataFrame(rows, "id bigint, location_address string, location_name string, postcode string, latitude double, longitude double").cache()
    every = sorted((r.id_a, r.id_b, r.score) for r in dedup.similar_pairs(rows, F.lit(1)).collect())
    out = dedup.whole_pairs(rows)
    assert sorted((r.id_a, r.id_b, r.score) for r in out.collect()) == every and len(every) > 1000
    # a text has one row in what is compared, and the ids of all that have it
    held = [r.n for r in dedup._texts(rows.select("id", dedup.compared().alias("r"))).select(F.size("ids").alias("n")).collect()]
    assert sum(held) == 260 and len(held) < 80


def test_whole_leaders_equal_a_walk_over_all_pairs(spark):
    """However few rows are walked at once; of the odd ones some have nothing to compare, some one text."""
    rng = random.Random(11)
    texts = [(a, n, p) for a in ("12 Elm Street", "13 Elm Street", "n/a", None) for n in ("Shop 101", "Shop 102", "Inn 7", None) for p in ("75001", "75002", None)]
    rows = [(i * 3, *rng.choice(texts), *rng.choice([(None, None), (10.0, 20.0), (10.01, 20.0), (-5.0, 20.0)])) for i in range(150)]
    rows = spark.createDataFrame(rows, "id bigint, location_address string, location_name string, postcode string, latitude double, longitude double").cache()
    every = sorted((r.id_a, r.id_b) for r in dedup.similar_pairs(rows, F.lit(1)).collect())
    led, near = {}, {}
    for a, b in every:
        near.setdefault(b, []).append(a)
    for i in range(0, 450, 3):
        led[i] = min((a for a in near.get(i, []) if led[a] == a), default=i)
    for n in (40, 1000):
        found = dedup.whole_leaders(rows, at_once=n).collect()
        assert {r.id: r.leader for r in found} == led and len(found) == 150


def test_whole_leaders_pass_little_through_the_driver(spark, monkeypatch):
    """No plan holds all comparisons, as the driver keeps the plans; what is left to compare is counted by pairs."""
    joins, real = [], dedup.cut
    rows = [(i, f"{i % 7 + 1} Elm Street", f"Shop {i}", "75001", *((10.0, 20.0) if i < 4 else (None, None) if i < 6 else (i * 1.0, i * 2.0))) for i in range(20)]
    rows = spark.createDataFrame(rows, "id bigint, location_address string, location_name string, postcode string, latitude double, longitude double")

    def cut(df, name="cut"):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return real(df, name)

    monkeypatch.setattr(dedup, "cut", cut)
    assert dedup.whole_leaders(rows).count() == 20 and max(joins) <= 5
    assert dedup._work(rows.select("id", dedup.compared().alias("r"))) == (20, 20 * 2 + 27 * (25 + 13))  # row 10 lies where the first four do


def test_best_of_is_the_same_however_rows_are_dealt(spark, sf_dir):
    rows = locations(spark, sf_dir)
    one = dedup.best_of(rows, F.col("state"), F.col("id")).select("id")
    other = dedup.best_of(rows.repartition(7), F.col("state"), F.col("id")).select("id")
    assert sorted(r.id for r in one.collect()) == sorted(r.id for r in other.collect())


def test_pages_part_the_rows(spark, sf_dir):
    rows = grid.ordered(locations(spark, sf_dir), "postcode")
    got = [r.id for n in range(1, 5) for r in grid.page(rows, n, 40).collect()]
    assert len(got) == len(set(got)) == min(160, rows.count())


def test_top_k_and_pushdown_in_plans(spark, sf_dir):
    plan = grid.ordered(read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id"), "c_name").limit(5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    plan = read(spark, sf_dir, "customer").where("c_acctbal > 100").select("c_name")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,100.0)]" in plan and "c_mktsegment" not in plan


def test_native_columns_need_no_python(spark, sf_dir):
    plan = enrich.with_quality(enrich.enrich(locations(spark, sf_dir)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sequential_headers_find_all_57(spark):
    from geoloom.operators import dom_extract

    page = "<div>" + "".join(f"<h3>COUNTRY {c}</h3>" + "".join(f"<h3>City {c}x{i}</h3><p>{i} Long Street Number, Postal {10000 + i}</p>" for i in range(19)) for c in "ABC") + "</div>"
    nodes = html.nodes(spark.createDataFrame([(1, page)], "page_id bigint, html string"))
    assert dom_extract.sequential_headers(nodes).count() == 57


def test_tag_soup():
    nodes = html.walk("<ul><li>a<li>b<ul><li>c</ul></ul><p>x<p>y<script>if (a</p>b) {}</script>")
    assert [n["tag"] for n in nodes] == ["ul", "li", "li", "ul", "li", "p", "p", "script"]
    assert nodes[2]["end"] == 4 and nodes[1]["end"] == 1 and "".join(nodes[7]["all"]) == "if (a</p>b) {}"
    assert html.walk("") == [] and html.walk(None) == []


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id bigint, location_name string, location_address string, activity string, latitude double, longitude double, country_iso3 string, postcode string, state string, street_or_city string, footprint string, height int, phone string, email string, usage_share string, source_url string, source_type string, confidence double, method string")
    assert enrich.with_quality(enrich.enrich(none)).count() == 0
    assert dedup.similar_pairs(none, F.col("state")).count() == 0
    assert dedup.merge(none, "state").count() == 0


def test_csv_files(spark, sf_dir, tmp_path):
    grid.write_csv(locations(spark, sf_dir).limit(3), str(tmp_path / "csv"), ("location_name", "state"))
    assert spark.read.text(str(tmp_path / "csv")).count() == 3
    (tmp_path / "in.csv").write_text("Company Name,URL\nA,https://a.test\nB,\n")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "in.csv")).collect()] == [("A", "https://a.test")]
    sinks.write_json(locations(spark, sf_dir).limit(2), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_stream_equals_table(spark, sf_dir, tmp_path):
    events = read(spark, sf_dir, "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = jobs.sink(jobs.progress(jobs.job_events(stream)), "states")
    try:
        query.processAllAvailable()
        got = sorted(map(str, spark.table("states").collect()))
    finally:
        query.stop()
    assert got == sorted(map(str, jobs.progress(jobs.job_events(events)).collect()))


def test_phones_written_in_pairs(spark, tmp_path):
    from geoloom.plans import extraction

    rows = spark.createDataFrame([(1, "Tel +33 1 42 68 53 00"), (2, "+1-22-33-44"), (3, "none"), (4, None)], "doc_id bigint, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(tuple(r) for r in extraction.doc_phones(spark, str(tmp_path)).collect()) == [(1, "+33 1 42 68"), (2, "+1-22-33-44")]
    same(spark, str(tmp_path), extraction.doc_phones, extraction.SQL["doc_phones"])


def test_address_lines_of_long_documents(spark):
    from geoloom.operators import text_extract

    line = next(r.street for r in text_extract.pattern_lines(spark.createDataFrame([(1, "12 Main Street, Springfield, IL 62704")], "doc_id bigint, text string")).collect())
    docs = spark.createDataFrame([(1, "\n".join([line] + ["x"] * 1199 + [line]))], "doc_id bigint, text string")
    assert [r.pos for r in text_extract.pattern_lines(docs).orderBy("pos").collect()] == [0, 1200]
    assert [r.pos for r in text_extract.pattern_lines(docs, most=1000).collect()] == [0]


def test_levels(spark):
    rows = spark.createDataFrame([(90,), (89,), (70,), (50,), (49,)], "s int").select(quality.level(F.col("s")).alias("l"))
    assert [r.l for r in rows.collect()] == ["Excellent", "Good", "Good", "Fair", "Poor"]


def test_coordinates_of_keys_have_no_exponent(spark):
    found = {0.0005: "0.0005", -0.00012345: "-0.00012345", 1e-5: "1e-05", -1.5e-7: "-1.5e-07", 1e7: "10000000.0", 12345678.9: "12345678.9", 1e16: "1e+16", 179.99: "179.99"}
    rows = spark.createDataFrame([(x,) for x in found], "x double").select("x", address.plain_number(F.col("x")).alias("y"))
    assert {r.x: r.y for r in rows.collect()} == found
    none = F.lit(None).cast("string")
    key = spark.range(1).select(address.canonical_key(none, none, none, none, F.lit(0.0005), F.lit(-90.0)).alias("k")).first().k
    assert key == "coord_0.0005_-90.0"


def test_percents_are_rounded_as_in_sql(spark):
    rows = spark.createDataFrame([(23, 40), (1, 3), (0, 0), (40, 40)], "done bigint, total bigint")
    assert [r.p for r in rows.select(jobs.percent(F.col("done"), F.col("total")).alias("p")).collect()] == [58, 33, 0, 100]


def test_page_nodes_of_odd_pages_equal_sql(spark, tmp_path):
    from geoloom.plans import registry

    pages = [(1, "u", "<title> A &amp; &quot;b&quot; &amp</title><p>x</p>"), (2, "u", "<p>no title</p>"), (3, "u", ""), (4, "u", None), (5, "u", "plain"), (6, "u", "<title>a\nb</title>"), (7, "u", "<title>one</title><title>two</title>")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    same(spark, str(tmp_path), registry.queries()["page_nodes"], registry.oracle_sql()["page_nodes"])


def test_address_lines_beside_other_letters_equal_sql(spark, tmp_path):
    from geoloom.plans import registry

    docs = [(1, "Schäen, beer in enver der überver schenver des 4236897737206539 enerßst. Einüber 87.85.112.41 und stchß."), (2, "Über 87 schenver 42368 enerßst. Stä ein"), (3, "Unter 12 main 12345 Straße ohne Wort"), (4, "77 Oak Avenue, Austin, TX 78701"), (5, "no number of a street in this line")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    query, sql = registry.queries()["doc_address_lines"], registry.oracle_sql()["doc_address_lines"]
    assert {r.doc_id for r in query(spark, str(tmp_path)).collect()} >= {1, 4}
    same(spark, str(tmp_path), query, sql)


def test_rounds_and_walk_of_leaders_agree(spark, monkeypatch):
    rng = random.Random(7)
    n = 60
    edges = sorted({(i, i + 1) for i in range(n - 1)} | {tuple(sorted(rng.sample(range(n), 2))) for _ in range(40)})
    led = {}
    for i in range(n):
        led[i] = min((a for a, b in edges if b == i and led[a] == a), default=i)
    tables, real = [], dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df, name="cut": tables.append(name) or real(df, name))
    ids, pairs = spark.range(n), spark.createDataFrame(edges, "id_a bigint, id_b bigint")
    for walk in (0, 5, dedup.WALK):
        assert {r.id: r.leader for r in dedup.leaders(pairs, ids, walk=walk).collect()} == led
    assert tables.count("open") > 0 and len(tables) < n  # a chain isn't a round a row
