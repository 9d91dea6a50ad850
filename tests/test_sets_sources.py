import random

from gainsay.operators import predsets
from gainsay.plans import workloads
from gainsay.sources import dc_log, tables


def test_subsumption_against_brute_force(spark):
    rnd = random.Random(1)
    sets = {frozenset(["base", *rnd.sample("abcdef", rnd.randint(0, 4))]) for _ in range(40)}      # one member in all sets
    df = predsets.canonical(spark.createDataFrame([(rnd.sample(sorted(s), len(s)),) for s in sets for _ in range(2)], "members array<string>"))
    name = {frozenset(r.members): r.set_id for r in df.collect()}
    assert set(name) == sets and df.count() == len(sets)
    pairs = {(name[a], name[b]) for a in sets for b in sets if a < b}
    got = predsets.subsumption_pairs(df).collect()
    assert len(got) == len(pairs) and {(r.sub_id, r.sup_id) for r in got} == pairs
    assert {r.set_id for r in predsets.minimal_cover(df).collect()} == {name[b] for b in sets if not any(a < b for a in sets)}
    assert {(r.set_id, r.superset_id) for r in predsets.supersets(df).collect()} == pairs
    assert {(r.set_id, r.subset_id) for r in predsets.subsets(df).collect()} == {(b, a) for a, b in pairs}


def test_navigation_and_growth(spark):
    df = predsets.canonical(spark.createDataFrame([(["a ==", "b !="],)], "members array<string>"))
    down = {(r.member, r.from_id) for r in predsets.without_member(df).collect()}
    assert down == {("a ==", "b !="), ("b !=", "a ==")}
    up = predsets.with_member(df, spark.createDataFrame([("a == & b !=", "c <")], "set_id string, member string")).first()
    assert up.to_id == "a == & b != & c <"
    preds = spark.createDataFrame([("a", "=="), ("a", "!="), ("b", "=="), ("c", "<")], "col string, op string")
    start = spark.createDataFrame([(["a =="],)], "members array<string>")
    assert {r.set_id for r in predsets.grown_sets(start, preds, 3).collect()} == {"a ==", "a == & b ==", "a == & c <", "a == & b == & c <"}


def test_inputs(spark, tmp_path):
    typed = tmp_path / "typed.csv"
    typed.write_text("id(Integer),name(String),pay(Double)\n1,'Ann, B',2.5\n2,'Bob',x\n")
    got = tables.read_typed_csv(spark, str(typed))
    assert got.dtypes == [("id", "bigint"), ("name", "string"), ("pay", "double")]
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, "Ann, B", 2.5), (2, "Bob", None)]
    plain = tmp_path / "plain.csv"
    plain.write_text('1,"a \\"q\\" b"\nbad,"z"\n3,"c"\n')
    rows = tables.read_explicit_csv(spark, str(plain), "id int, s string").collect()
    assert sorted((r.id, r.s) for r in rows) == [(1, 'a "q" b'), (3, "c")]
    tables.inline_rows(spark, [(1, "x")], "a int, b string").createOrReplaceTempView("inline_view")
    assert tables.read_input(spark, "inline_view").count() == 1
    out = str(tmp_path / "slice")
    tables.export_columns(spark.table("inline_view"), ["b"], out)
    assert tables.read_input(spark, out).columns == ["b"]
    assert tables.materialise(spark.range(5).repartition(2)).count() == 5


def test_log_sections_across_small_blocks(spark, tmp_path):
    lines = ["!(a == a & )"]
    want = [("Unknown", "!(a == a & )")]
    for k in range(40):
        lines += ["section", f"--- part_{k} ---", "denial_constraint"] + [f"!(c{k} == c{k} & d{j} != d{j} & )" for j in range(k % 4)] + [""]
        want += [(f"part_{k}", f"!(c{k} == c{k} & d{j} != d{j} & )") for j in range(k % 4)]
    path = tmp_path / "log.txt"
    path.write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = dc_log.read_dc_log(spark, str(path)).orderBy("file", "block", "position").collect()
        assert len({r.block for r in got}) > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.section, r.denial_constraint) for r in got] == want


MOVIE_COLUMNS = {
    "char_name": "id name imdb_index imdb_id name_pcode_nf surname_pcode md5sum", "cast_info": "id person_id movie_id person_role_id note nr_order role_id",
    "role_type": "id role", "name": "id name imdb_index imdb_id gender name_pcode_cf name_pcode_nf surname_pcode md5sum",
    "aka_name": "id person_id name imdb_index name_pcode_cf name_pcode_nf surname_pcode md5sum", "person_info": "id person_id info_type_id info note",
    "info_type": "id info", "movie_info": "id movie_id info_type_id info note", "movie_info_idx": "id movie_id info_type_id info note",
    "title": "id title imdb_index kind_id production_year imdb_id phonetic_code episode_of_id season_nr episode_nr series_years md5sum",
    "kind_type": "id kind", "movie_keyword": "id movie_id keyword_id", "keyword": "id keyword phonetic_code",
    "company_name": "id name country_code imdb_id name_pcode_nf name_pcode_sf md5sum", "movie_companies": "id movie_id company_id company_type_id note",
    "company_type": "id kind", "complete_cast": "id movie_id subject_id status_id", "comp_cast_type": "id kind",
    "movie_link": "id movie_id linked_movie_id link_type_id", "link_type": "id link",
    "aka_title": "id movie_id title imdb_index kind_id production_year phonetic_code episode_of_id season_nr episode_nr note md5sum",
}


def test_movie_joins(spark):
    t = {}
    for name, cols in MOVIE_COLUMNS.items():
        names = cols.split()
        t[name] = spark.range(4).selectExpr(*["id" if c == "id" else f"id % 2 AS {c}" if c.endswith("_id") else f"concat('{c}', id) AS {c}" for c in names])
    assert len(workloads.MOVIE_JOINS) == 20
    for name, j in workloads.MOVIE_JOINS.items():
        got = workloads.movie_join(t, name)
        assert len(set(got.columns)) == len(got.columns) == len(t[j.left[0]].columns) + len(t[j.right[0]].columns) - len(j.drop)
        assert got.count() == 4, name
    both = workloads.complete_cast_join(t)
    assert both.columns == ["cc_id", "cc_movie_id", "cc_subject_id", "cc_status_id", "cc_subject_kind", "cc_status_kind"] and both.count() == 4
    assert len(workloads.STAR_JOINS) == 10


def test_run_means(spark):
    runs = spark.createDataFrame([("s", "e", 4, 10, 0.1, 1.0, 2.0, True), ("s", "e", 4, 10, 0.1, 3.0, 4.0, True), ("s", "e", 4, 10, 0.1, 99.0, 9.0, False)],
                                 "scenario string, engine string, attrs int, n_rows int, threshold double, seconds double, gigabytes double, ok boolean")
    row = workloads.run_means(runs).first()
    assert (row.mean_seconds, row.mean_gigabytes, row.n_runs) == (2.0, 3.0, 2)
