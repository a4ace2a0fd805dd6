"""What the profile keeps, and its counts on odd values."""

from __future__ import annotations

import random

from schemaloom.sources import profile


def test_only_what_is_counted_by_value_is_written(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("id", "id * 0.5D AS x", "timestamp_seconds(id) AS at", "array(id) AS a").write.parquet(f"{tmp_path}/t.parquet")
    written, kept = [], profile.kept
    monkeypatch.setattr(profile, "kept", lambda df: (written.append(kept(df)), written[-1])[1])
    p = profile.Profile(spark, str(tmp_path), (profile.whole("t", ("id", "int"), ("x", "num"), ("at", "time"), ("a", "raw")),))
    assert sum(df.count() for df in written) < 2500  # 2,000 values of id; numbers, times and arrays aren't counted by value
    got = {(r["snapshot_id"], r["name"]): r for r in p.stats.collect()}
    assert len(got) == 8
    assert {(s, n): (r["n_rows"], r["held"]) for (s, n), r in got.items()} == {(s, n): (k, k) for s, k in (("tables", 2000), ("tables/even", 1000)) for n in ("id", "x", "at", "a")}
    assert got["tables", "id"]["unique"] and (got["tables", "id"]["d"], got["tables/even", "id"]["d"], got["tables/even", "id"]["high"]) == (2000, 1000, 1998)
    assert (got["tables", "x"]["least"], got["tables", "x"]["most"], got["tables/even", "x"]["most"]) == (0.0, 999.5, 999.0)


def test_constants_modes_and_nulls(spark, tmp_path):
    rows = [(1, 0.0, 5.0, None, 7, "b"), (2, -0.0, 5.0, None, 7, "b"), (3, 0.0, None, None, 3, "a"), (4, 0.0, 5.0, None, 3, "a"), (None, 0.0, 5.0, None, 9, None)]
    spark.createDataFrame(rows, "id int, zero double, five double, none int, m int, l string").write.parquet(f"{tmp_path}/t.parquet")
    columns = (("id", "int", "id"), ("zero", "num", "zero"), ("five", "num", "five"), ("none", "int", "none"), ("m", "int", "m"), ("l", "label", "l"))
    p = profile.Profile(spark, str(tmp_path), (profile.Cut("f", "t", "CASE WHEN id < 5 THEN 'f/1' END", "'t'", columns, "m"), profile.whole("t", *((c, k) for c, k, _ in columns))))
    got = {(r["snapshot_id"], r["name"]): r for r in p.stats.collect()}
    assert len(got) == 24 and {s for s, _ in got} == {"f/1", "f/none", "tables", "tables/even"}
    assert {n for (s, n), r in got.items() if s == "tables" and r["constant"]} == {"five"}
    assert {n for (s, n), r in got.items() if s == "tables/even" and r["constant"]} == {"five"}  # zero holds 0.0 and -0.0 there too
    assert (got["f/1", "m"]["mode"], got["f/1", "m"]["mode_n"], got["f/none", "m"]["mode"]) == ("3", 2, "9")
    assert (got["tables", "none"]["d"], got["tables", "none"]["held"], got["tables", "none"]["unique"]) == (0, 0, False)
    assert (got["tables", "id"]["d"], got["tables", "id"]["held"], got["tables", "id"]["unique"]) == (4, 4, False)
    labels = {r["snapshot_id"]: r["labels"] for r in p._labels().collect()}
    assert labels == {"f/1": ["a", "b"], "tables": ["a", "b"], "tables/even": ["a", "b"]}


def test_inclusions_of_more_columns_than_a_mask_has_bits(spark, tmp_path):
    rng = random.Random(3)
    tables = {"t": [[i] + [rng.randrange(4, 20) for _ in range(66)] for i in range(20)], "u": [[i, i * 2 % 20] for i in range(30)]}
    cuts = []
    for name, rows in tables.items():
        spark.createDataFrame(rows, ", ".join(f"c{k} long" for k in range(len(rows[0])))).write.parquet(f"{tmp_path}/{name}.parquet")
        cuts.append(profile.whole(name, *((f"c{k}", "int") for k in range(len(rows[0])))))
    p = profile.Profile(spark, str(tmp_path), tuple(cuts))
    want = set()
    for s in ("tables", "tables/even"):
        held = {(t, f"c{k}"): [r[k] for r in rows if s == "tables" or r[0] % 2 == 0] for t, rows in tables.items() for k in range(len(rows[0]))}
        want |= {(s, *a, *b) for a, x in held.items() for b, y in held.items() if a[0] != b[0] and len(set(y)) == len(y) and set(x) <= set(y)}
    got = [(r["snapshot_id"], r["table_name"], r["name"], r["ref_table"], r["ref_name"]) for r in p.inclusions().collect()]
    assert sorted(got) == sorted(want) and len({x[2] for x in got}) > 63


def test_columns_without_repeats_are_not_counted_again_in_slices(spark, tmp_path):
    rows = [(1, "a", 5, "x"), (2, "a", 5, "y"), (4, "b", 6, "z"), (None, "b", 6, None), (9, "b", 7, "w"), (None, "c", None, None)]
    spark.createDataFrame(rows, "id int, g string, m int, w string").write.parquet(f"{tmp_path}/t.parquet")
    columns = (("id", "int"), ("m", "int"), ("w", "text"))
    p = profile.Profile(spark, str(tmp_path), (profile.Cut("f", "t", "g", "'t'", tuple((c, k, c) for c, k in columns), "id"), profile.whole("t", *columns)))
    assert {r["v"] for r in p._counts(("int", "slot"), whole=False).collect()} == {5, 6, 7}  # m alone
    assert p._counts(("text",), whole=False).count() == 0
    assert "Generate" not in p._counts(("int", "slot"), whole=True)._jdf.queryExecution().toString()  # nor are rows of tables multiplied
    got = {(r["snapshot_id"], r["name"]): (r["d"], r["mode"], r["mode_n"], r["unique"]) for r in p.stats.filter("feed = 'f'").collect()}
    assert got == {
        ("a", "id"): (2, "1", 1, True), ("a", "m"): (1, "5", 2, False), ("a", "w"): (2, None, 1, True),
        ("b", "id"): (2, "4", 1, False), ("b", "m"): (2, "6", 2, False), ("b", "w"): (2, None, 1, False),
        ("c", "id"): (0, None, None, False), ("c", "m"): (0, None, None, False), ("c", "w"): (0, None, None, False),
    }
